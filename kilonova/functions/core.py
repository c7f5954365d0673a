"""Column-expression helpers (JVM-side, codegen friendly; no Python UDFs).

Null rules used throughout the library:
* every division goes through :func:`safe_div` (NULL on a zero divisor, never
  an ANSI error and never inf);
* NaN is normalised to NULL at scan time (:func:`nan_to_null`) so that
  aggregates never see it;
* ``log10`` arguments are guarded so they are always > 0.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for right results.
# Passband codes 0..5 and their letters, in order.
BANDS = [0, 1, 2, 3, 4, 5]
BAND_LETTERS = ["u", "g", "r", "i", "z", "y"]
# Galactic classes (hostgal_photoz == 0) and all 14 training classes.
GALACTIC_CLASSES = [6, 16, 53, 65, 92]
ALL_CLASSES = [6, 15, 16, 42, 52, 53, 62, 64, 65, 67, 88, 90, 92, 95]
# Probability clip used by the log-loss.
PROB_EPS = 1e-15
# MJD day zero.
MJD_EPOCH = "1858-11-17 00:00:00"
MICROS_PER_DAY = 86400000000.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (pandas would give inf)."""
    return F.try_divide(col(a), col(b))


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def skew_adj(x, cond: Column | None = None) -> Column:
    """Bias-adjusted sample skewness (pandas ``skew``) as an aggregate.

    Spark's ``skewness`` is the population g1; G1 = g1*sqrt(n(n-1))/(n-2).
    NULL for n < 3 and for zero variance.
    """
    x = col(x)
    if cond is not None:
        x = F.when(cond, x)
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def mjd_to_timestamp(mjd) -> Column:
    """Double MJD days -> TIMESTAMP_NTZ (microsecond precision)."""
    micros = F.round(col(mjd) * F.lit(MICROS_PER_DAY)).cast("long")
    return F.timestamp_add("MICROSECOND", micros, F.lit(MJD_EPOCH).cast("timestamp_ntz"))


def timestamp_to_mjd(ts) -> Column:
    """TIMESTAMP_NTZ -> double MJD days."""
    c = col(ts)
    return F.timestamp_diff("MICROSECOND", F.lit(MJD_EPOCH).cast("timestamp_ntz"), c) / F.lit(MICROS_PER_DAY)


def haversine(lon1, lat1, lon2, lat2) -> Column:
    """Great-circle angle in radians between two points given in degrees."""
    lon1, lat1, lon2, lat2 = (F.radians(col(c)) for c in (lon1, lat1, lon2, lat2))
    dlon = lon2 - lon1
    dlat = lat2 - lat1
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2.0) * F.asin(F.sqrt(a))


def latlon1(lon1, lat1, lon2, lat2) -> Column:
    """lon1*lat1 - lon2*lat2 with all four in radians."""
    lon1, lat1, lon2, lat2 = (F.radians(col(c)) for c in (lon1, lat1, lon2, lat2))
    return lon1 * lat1 - lon2 * lat2


def pure_magnitude(flux, distmod=None) -> Column:
    """flux < 1 -> 2.5*log10(2 - flux), else -2.5*log10(flux); minus distmod.

    The guard keeps every log10 argument > 0.
    """
    f = col(flux)
    mag = F.when(f < 1, F.lit(2.5) * F.log10(F.lit(2.0) - f)).otherwise(F.lit(-2.5) * F.log10(f))
    if distmod is not None:
        mag = mag - col(distmod)
    return mag


def clip_prob(p, eps: float = PROB_EPS) -> Column:
    return F.greatest(F.least(col(p), F.lit(1.0 - eps)), F.lit(eps))


def band_name(passband) -> Column:
    """0..5 -> u..y."""
    return F.element_at(F.array(*[F.lit(b) for b in BAND_LETTERS]), col(passband).cast("int") + 1)


def distmod_flat_lcdm(z, h0: float = 70.0, om0: float = 0.3, steps: int = 256) -> Column:
    """Distance modulus of redshift ``z`` in flat LCDM (radiation ignored).

    The comoving distance integral 1/E(z') over [0, z] is evaluated with the
    composite Simpson rule as an array fold, fully inside the JVM.
    NULL for z <= 0.
    """
    c_km_s = 299792.458
    zc = col(z)
    n = steps  # even
    idx = F.sequence(F.lit(0), F.lit(n))
    ol = 1.0 - om0

    def inv_e(zz):
        return F.lit(1.0) / F.sqrt(F.lit(om0) * F.pow(F.lit(1.0) + zz, 3) + F.lit(ol))

    h = zc / F.lit(float(n))
    weights_sum = F.aggregate(
        idx, F.lit(0.0),
        lambda acc, i: acc + F.when((i == 0) | (i == n), F.lit(1.0))
        .when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0)) * inv_e(i.cast("double") * h))
    integral = weights_sum * h / F.lit(3.0)
    dc_mpc = F.lit(c_km_s / h0) * integral
    dl_mpc = (F.lit(1.0) + zc) * dc_mpc
    return F.when(zc > 0, F.lit(5.0) * F.log10(dl_mpc) + F.lit(25.0))


def _snap_expr(c: Column, bits: int) -> Column:
    # relative grid of ``bits`` bits, but never finer than 2^-30 absolute, so
    # values that are zero up to float noise (e.g. the skew of a symmetric
    # sample) snap to exactly 0 in both engines.
    scale = F.pow(F.lit(2.0), F.least(F.lit(float(bits)) - F.floor(F.log2(F.abs(c))), F.lit(30.0)))
    # -0.0 is written as 0.0 so that both engines hash zeros alike
    r = F.round(c * scale)
    return F.when((c == 0) | (r == 0), F.lit(0.0)).when(c.isNull(), c).otherwise(r / scale)


def snap(x, bits: int = 20) -> Column:
    """Round a double to ``bits`` significant binary digits (about 6 decimal).

    Scaling by a power of two is exact, so two engines whose results differ
    only by float noise (summation order) give bit-identical outputs; unlike
    decimal rounding there are no ties on values such as 0.1234565.
    The input is referenced once (through a one-element lambda) so that wide
    result projections stay small for the optimizer.
    """
    return F.element_at(F.transform(F.array(col(x)), lambda v: _snap_expr(v, bits)), 1)


def snap_sql_spark(name: str, bits: int = 20) -> str:
    """Spark SQL text of :func:`snap` for column ``name`` (one parse per column)."""
    c = f"`{name}`"
    scale = f"pow(2D, least({bits}D - floor(log2(abs({c}))), 30D))"
    return (f"CASE WHEN {c} = 0 OR round({c} * {scale}) = 0 THEN 0D WHEN {c} IS NULL THEN {c} "
            f"ELSE round({c} * {scale}) / {scale} END AS {c}")


def round_all(df, bits: int = 20, exclude: tuple[str, ...] = ()):
    """Snap every double column (and arrays of doubles) to ``bits`` significant bits.

    Used by registered queries so that the DuckDB oracle comparison is exact.
    Built as SQL text in one ``selectExpr`` so that wide results (hundreds of
    columns) cost one analysis pass, not one Python round trip per function.
    """
    out = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        c = f"`{f.name}`"
        if f.name in exclude:
            out.append(c)
        elif t == "double":
            out.append(snap_sql_spark(f.name, bits))
        elif t == "float":
            out.append(snap_sql_spark(f.name, bits).replace(f"`{f.name}`", f"CAST(`{f.name}` AS DOUBLE)")
                       .rsplit(" AS ", 1)[0] + f" AS {c}")
        elif t == "array" and f.dataType.elementType.typeName() == "double":
            scale = f"pow(2D, least({bits}D - floor(log2(abs(v))), 30D))"
            out.append(f"transform({c}, v -> CASE WHEN v = 0 OR round(v * {scale}) = 0 THEN 0D WHEN v IS NULL THEN v "
                       f"ELSE round(v * {scale}) / {scale} END)"
                       f" AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)
