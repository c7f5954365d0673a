"""kilonova: light-curve feature engineering and evaluation on Spark DataFrames.

Every operator takes and returns a ``pyspark.sql.DataFrame`` keyed by
``object_id``; all heavy work is declarative (groupBy / window / join) so
Catalyst and AQE plan it.
"""

__version__ = "0.1.0"
