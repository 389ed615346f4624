from meterspark.streaming.streams import (  # noqa: F401
    stream_alerts, stream_features, stream_minute_mean, stream_readings, write_batches,
)
