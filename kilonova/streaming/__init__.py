from .stream_ops import (  # noqa: F401
    read_observation_stream, run_to_table, stage_observations, stream_bucket_means, stream_flux_rate,
    stream_object_stats, stream_sessions,
)
