"""Declared schemas of the observation table (lc) and the metadata table."""
from pyspark.sql import types as T

LC_SCHEMA = T.StructType([
    T.StructField("object_id", T.LongType(), False),
    T.StructField("mjd", T.DoubleType(), True),
    T.StructField("passband", T.IntegerType(), True),
    T.StructField("flux", T.DoubleType(), True),
    T.StructField("flux_err", T.DoubleType(), True),
    T.StructField("detected", T.IntegerType(), True),
])

META_COLUMNS = ["object_id", "ra", "decl", "gal_l", "gal_b", "ddf", "hostgal_specz", "hostgal_photoz",
                "hostgal_photoz_err", "distmod", "mwebv", "target"]

META_SCHEMA = T.StructType([
    T.StructField("object_id", T.LongType(), False),
    T.StructField("ra", T.DoubleType(), True),
    T.StructField("decl", T.DoubleType(), True),
    T.StructField("gal_l", T.DoubleType(), True),
    T.StructField("gal_b", T.DoubleType(), True),
    T.StructField("ddf", T.IntegerType(), True),
    T.StructField("hostgal_specz", T.DoubleType(), True),
    T.StructField("hostgal_photoz", T.DoubleType(), True),
    T.StructField("hostgal_photoz_err", T.DoubleType(), True),
    T.StructField("distmod", T.DoubleType(), True),
    T.StructField("mwebv", T.DoubleType(), True),
    T.StructField("target", T.IntegerType(), True),
])
