"""Sources: house CSV files, and readings derived from the driver's events table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterspark.sources.house_files import APPLIANCES, MISSING, HouseFiles, house_file_schema

# Readings after ingest: one row per reading, watts as DOUBLE (null, never NaN).
READINGS_SCHEMA = T.StructType(
    [T.StructField("house_id", T.LongType()), T.StructField("Time", T.TimestampNTZType()),
     T.StructField("Aggregate", T.DoubleType())]
    + [T.StructField(a, T.DoubleType()) for a in APPLIANCES]
    + [T.StructField("Issues", T.IntegerType())]
)

#: Columns of a house file, in order.
HOUSE_FILE_COLUMNS = ["Time", "Unix", "Aggregate", *APPLIANCES, "Issues"]

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _nan_to_null(c: Column) -> Column:
    # Spark orders NaN above every number (NaN > 0 is true); the cleaning
    # rules treat NaN as missing, so it becomes null right at ingest.
    return F.nanvl(c, F.lit(None).cast("double"))


def file_schema(cols: list[str]) -> T.StructType:
    """Columns of a house file, as text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in cols])


def _bad(cols: list[str], missing: list[str] = MISSING) -> Column:
    """What could not be read, as the data source writes it."""
    def wrong(c):
        text = F.trim(F.col(c))
        value = F.expr(f"try_cast(trim(`{c}`) AS {'TIMESTAMP_NTZ' if c == 'Time' else 'INT' if c == 'Issues' else 'DOUBLE'})")
        return F.when(value.isNull() & ~text.isin(missing), F.concat(F.lit(f"{c}="), text))
    return F.nullif(F.concat_ws("; ", *[wrong(c) for c in cols]), F.lit(""))


def parse_house_rows(raw: DataFrame, cols: list[str]) -> DataFrame:
    """Readings from the text columns ``cols`` of streamed house files, in the
    schema of ``read_readings`` with ``bad_values``."""
    named = F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"(?i)house_?(\d+)", 1), F.lit(""))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/house_id=(\d+)/[^/]*$", 1)
    hid = F.coalesce(named, folder).try_cast("bigint")
    if "Time" in cols:
        t = F.col("Time").try_cast("timestamp_ntz")
    else:
        t = F.expr(f"timestampadd(MICROSECOND, CAST(round(try_cast(Unix AS DOUBLE) * 1000000) AS BIGINT), {_EPOCH_NTZ})")
    out = [hid.alias("house_id"), t.alias("Time")]
    for f in house_file_schema().fields[2:-1]:
        if f.name == "Issues":
            out.append((F.expr("try_cast(Issues AS INT)") if f.name in cols else F.lit(None).cast("int")).alias("Issues"))
        else:
            out.append((_nan_to_null(F.expr(f"try_cast(`{f.name}` AS DOUBLE)")) if f.name in cols else F.lit(None).cast("double")).alias(f.name))
    return raw.select(*out, _bad([c for c in cols if c != "Unix" or "Time" not in cols]).alias("bad_values"))


def read_readings(spark: SparkSession, path: str, house: int | None = None, extra: Sequence[str] = (), bad_values: bool = False) -> DataFrame:
    """Readings of the house CSV files under ``path`` (see ``house_files``).

    Every ``*.csv`` is read by its own header; ``Time`` is ISO 8601, without it
    ``Unix`` epoch seconds are used. A column that a file lacks is null.
    ``house`` opens the files of one house alone. A value of the wrong type is
    null; ``bad_values`` adds a column that shows it, and keeps lines of a wrong
    number of fields there, which are an error otherwise."""
    spark.dataSource.register(HouseFiles)
    reader = spark.read.format("house_csv").option("path", path).option("extra", ",".join(extra))
    if house is not None:
        reader = reader.option("house", house)
    return reader.option("bad_lines", "keep").load() if bad_values else reader.load().drop("bad_values")


def house_files(spark: SparkSession, path: str) -> DataFrame:
    """house_id, path, bytes of the house files, from their names; none is opened."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).load(path)
             .select("path", F.col("length").alias("bytes")))
    name, folder = F.regexp_extract("path", "[^/]*$", 0), F.regexp_extract("path", r"house_id=(\d+)/[^/]*$", 1)
    last = F.when(~name.startswith("part-"), F.regexp_extract(name, r"(\d+)\D*$", 1))
    house = F.coalesce(*[F.nullif(c, F.lit("")) for c in (F.regexp_extract(name, r"(?i)house_?(\d+)", 1), folder, last)])
    return found.select(house.try_cast("bigint").alias("house_id"), "path", "bytes")


def write_house_csv(readings: DataFrame, path: str) -> None:
    """Readings as CSV files with a header, one folder for each house."""
    cols = [c for c in readings.columns if c not in ("house_id", "Time")]
    (readings.select("house_id", F.date_format("Time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Time"), *cols)
     .repartition("house_id", F.to_date("Time")).write.partitionBy("house_id").option("header", True).csv(path))


def readings_from_events(events: DataFrame, layout: str = "events") -> DataFrame:
    """Readings derived from the driver's ``events`` table.

    ``layout='events'``: house = 1 + user_id % 20, Time = ts (irregular).
    ``layout='cadence'``: house = 1 + event_id % 20, one reading every
    8 seconds per house from 2024-01-01 (many readings per minute bin).
    Nulls, zeros, negatives and issue flags are planted so that every
    cleaning branch runs (the same text is in ``ORACLE_READINGS_SQL``)."""
    eid, v, et = F.col("event_id"), F.col("value"), F.col("event_type")
    zero = F.lit(0.0)
    null = F.lit(None).cast("double")
    if layout == "events":
        house = (F.lit(1) + F.col("user_id") % 20).alias("house_id")
        time = F.col("ts").alias("Time")
    elif layout == "cadence":
        house = (F.lit(1) + eid % 20).alias("house_id")
        time = F.expr(f"timestampadd(SECOND, CAST(div(event_id, 20) * 8 AS INT), "
                      f"TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("Time")
    else:
        raise ValueError(layout)
    return events.select(
        house, time,
        F.when(eid % 101 == 0, null).when(eid % 97 == 0, zero).otherwise(v * 20).alias("Aggregate"),
        F.when(eid % 17 == 0, v * 30).when(et == "click", v * 12).otherwise(zero).alias("Appliance1"),
        F.when(eid % 11 == 0, F.lit(-5.0)).when(et == "error", v * 12).otherwise(zero).alias("Appliance2"),
        F.when(et == "purchase", v * 12).otherwise(zero).alias("Appliance3"),
        F.when(et == "signup", v * 12).otherwise(zero).alias("Appliance4"),
        F.when(et == "view", v * 12).otherwise(zero).alias("Appliance5"),
        F.when(eid % 4 == 0, v * 4).otherwise(zero).alias("Appliance6"),
        F.when(eid % 4 == 1, v * 4).otherwise(zero).alias("Appliance7"),
        F.when(eid % 4 == 2, v * 4).otherwise(zero).alias("Appliance8"),
        F.when(eid % 7 == 0, null).when(eid % 4 == 3, v * 4).otherwise(zero).alias("Appliance9"),
        F.when(eid % 17 == 0, 1).otherwise(0).alias("Issues"),
    )


def load_readings(spark: SparkSession, sf_dir: str, layout: str = "events") -> DataFrame:
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return readings_from_events(events, layout)


def list_houses(df: DataFrame) -> DataFrame:
    """Sorted distinct house ids (the house selector's options), of readings or
    of ``house_files``, which needs no rows."""
    return df.select("house_id").distinct().orderBy("house_id")


# The same derivation as SQL text, for the DuckDB oracle (identical results).
ORACLE_READINGS_SQL = """
SELECT 1 + user_id % 20 AS house_id,
       ts AS Time,
       CASE WHEN event_id % 101 = 0 THEN CAST(NULL AS DOUBLE)
            WHEN event_id % 97 = 0 THEN CAST(0 AS DOUBLE)
            ELSE value * 20 END AS Aggregate,
       CASE WHEN event_id % 17 = 0 THEN value * 30
            WHEN event_type = 'click' THEN value * 12 ELSE CAST(0 AS DOUBLE) END AS Appliance1,
       CASE WHEN event_id % 11 = 0 THEN CAST(-5 AS DOUBLE)
            WHEN event_type = 'error' THEN value * 12 ELSE CAST(0 AS DOUBLE) END AS Appliance2,
       CASE WHEN event_type = 'purchase' THEN value * 12 ELSE CAST(0 AS DOUBLE) END AS Appliance3,
       CASE WHEN event_type = 'signup' THEN value * 12 ELSE CAST(0 AS DOUBLE) END AS Appliance4,
       CASE WHEN event_type = 'view' THEN value * 12 ELSE CAST(0 AS DOUBLE) END AS Appliance5,
       CASE WHEN event_id % 4 = 0 THEN value * 4 ELSE CAST(0 AS DOUBLE) END AS Appliance6,
       CASE WHEN event_id % 4 = 1 THEN value * 4 ELSE CAST(0 AS DOUBLE) END AS Appliance7,
       CASE WHEN event_id % 4 = 2 THEN value * 4 ELSE CAST(0 AS DOUBLE) END AS Appliance8,
       CASE WHEN event_id % 7 = 0 THEN CAST(NULL AS DOUBLE)
            WHEN event_id % 4 = 3 THEN value * 4 ELSE CAST(0 AS DOUBLE) END AS Appliance9,
       CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS Issues
FROM events
"""
