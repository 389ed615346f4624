"""meterspark: household electricity-meter analytics on Spark.

Batch operators map ``DataFrame -> DataFrame`` keyed by ``(house_id, Time)``;
``fit_*`` functions return small model tables; ``streaming`` holds the
Structured Streaming versions.
"""

from meterspark.config import THRESHOLDS, build_session, ensure_checkpoint_dir  # noqa: F401
from meterspark.sources.readings import (  # noqa: F401
    READINGS_SCHEMA, house_files, list_houses, read_readings, readings_from_events, load_readings,
)
from meterspark.operators.cleaning import clean, cleaning_report, appliance_columns  # noqa: F401
from meterspark.operators.resample import downsample  # noqa: F401
from meterspark.operators.calendar import add_time_features  # noqa: F401
from meterspark.operators.features import (  # noqa: F401
    add_rolling_features, add_rate_features, add_appliance_features,
    add_hourly_pattern, engineer_features, warmup_report,
)
