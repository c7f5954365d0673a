from .core import (  # noqa: F401
    snap,
    ALL_CLASSES, BANDS, BAND_LETTERS, GALACTIC_CLASSES, PROB_EPS, band_name, clip_prob,
    distmod_flat_lcdm, haversine, latlon1, mjd_to_timestamp, nan_to_null, pure_magnitude,
    round_all, safe_div, skew_adj, timestamp_to_mjd,
)
from .aggspec import compile_aggs, flat_name  # noqa: F401
