from .adapters import lc_events, lc_lineitem, meta_events, meta_part, table  # noqa: F401
from .schemas import LC_SCHEMA, META_COLUMNS, META_SCHEMA  # noqa: F401
