"""Cleaning steps as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import finite, finite_columns, to_number
from .layout import split_columns, split_header, standard_headers

# fixed value: session time as the sprint device writes it, zone suffix cut off
SESSION_TIME_FORMAT = "M/d/yyyy h:mm:ss a"
#: Texts that can be session times of the device, in its spelling; anything else is read by the general formats.
DEVICE_SHAPE = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]+ [0-9]{1,2}:[0-9]{2}:[0-9]{2} (?i:am|pm)( -|$)"
#: Texts that are read as ISO dates or times; no written format starts like this.
ISO_SHAPE = r"^[+-]?[0-9]{4,7}(-|$)|^T?[0-9]{1,2}:"
TIME_OF_DAY_FORMATS = ("H:mm:ss[.SSSSSS]", "H:mm:ss[.SSS]", "H:mm:ss", "h:mm:ss a")
GENERAL_FORMATS = (
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy h:mm a",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "yyyyMMdd",
    "yyyy/M/d H:mm:ss",
    "yyyy/M/d",
)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[name.strip() for name in df.columns])


def number_column(df: DataFrame, name: str) -> Column:
    """Column as finite double; text that is not a number becomes NULL."""
    return to_number(quoted(name)) if dict(df.dtypes)[name] == "string" else finite(quoted(name).cast("double"))


def general_timestamp(text: Column) -> Column:
    """Timestamp without zone from ISO or one of the common written formats, NULL for anything else."""
    text = F.trim(text.cast("string"))
    # one pattern of optional parts, tried in their order (a longer format before its beginning): one parse for all
    written = F.try_to_timestamp(text, F.lit("".join(f"[{f}]" for f in GENERAL_FORMATS))).cast("timestamp_ntz")
    return F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp_ntz")).when(text != "", written)


def session_timestamp(text: Column) -> Column:
    """Device session time; everything from `` -`` on (the zone) is cut off."""
    clean = F.split(text, " -")[0]
    return F.try_to_timestamp(clean, F.lit(SESSION_TIME_FORMAT)).cast("timestamp_ntz")


def rep_timestamp(text: Column, session_ts: Column) -> Column:
    """Instant of a rep written as full timestamp, time of day, or seconds into the session."""
    text = F.trim(text.cast("string"))
    midnight = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    clock = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in TIME_OF_DAY_FORMATS])
    seconds = F.make_dt_interval(secs=to_number(text).cast("decimal(18,6)"))
    day = F.to_date(session_ts).cast("timestamp_ntz")
    return F.coalesce(day + (clock - midnight), session_ts + seconds, general_timestamp(text), session_ts)


def with_row_index(df: DataFrame, name: str) -> DataFrame:
    """Dense 0-based row number in file order without sorting or moving rows.

    Ids from ``monotonically_increasing_id`` run without gaps inside one file block.  Shifting each block's ids
    by the rows in earlier blocks makes them dense; only the per-block counts (one row per block) are ordered
    globally.  Rows carry a hash of the file name, so the counts stay small enough to be broadcast.  Without file
    metadata the partition stands for the block.
    """
    try:
        blocks = df.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
        )
    except AnalysisException:  # not read from files
        blocks = df.select("*", F.lit("").alias("_file"), F.spark_partition_id().cast("bigint").alias("_block"))
    numbered = blocks.withColumns({"_id": F.monotonically_increasing_id(), "_key": F.xxhash64("_file", "_block")})
    starts = (
        numbered.groupBy("_file", "_block", "_key")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_start"))
        .withColumn("_before", F.sum("_rows").over(W.partitionBy().orderBy("_file", "_block")) - F.col("_rows"))
        .select("_key", "_block", "_before", "_start")
    )
    return (
        numbered.join(starts, ["_key", "_block"])
        .withColumn(name, F.col("_before") + F.col("_id") - F.col("_start"))
        .select(*[quoted(c) for c in df.columns], name)
    )


def standardize_headers(df: DataFrame) -> DataFrame:
    """Vendor headers to standard ones; several sources of one target are coalesced."""
    return df.select(
        *[
            F.coalesce(*[quoted(s) for s in sources]).alias(target) if len(sources) > 1 else quoted(sources[0]).alias(target)
            for target, sources in standard_headers(df.columns).items()
        ]
    )


def metric_and_unit(header: str) -> tuple[Column, Column]:
    """:func:`split_header` for a column of headers."""
    col = quoted(header)
    bracketed = r"(?s)^(.+)\[([^\[]*)\][^\]]*$"
    valid = col.rlike(bracketed)
    name = F.when(valid, F.rtrim(F.regexp_extract(col, bracketed, 1))).otherwise(col)
    unit = F.when(valid, F.regexp_extract(col, bracketed, 2)).otherwise(F.lit(""))
    return name, unit


def unpivot_tests(wide: DataFrame, with_test_id: bool = True) -> DataFrame:
    """Wide tests to one row per measured value.

    ``TEST_ID`` numbers the cells metric by metric before empty ones are dropped; it replaces a source TEST_ID
    and needs a row index, so callers that do not read it can switch it off.
    """
    standard = standardize_headers(wide)
    if with_test_id or "ATHLETE_NAME" not in standard.columns:
        standard = standardize_headers(with_row_index(wide, "_row"))
    parts = split_columns([c for c in standard.columns if c != "_row"])
    ids = [c for c in parts.ids if c != "TEST_ID"]
    if not parts.ids:
        standard = standard.withColumn("ROW_ID", F.col("_row"))
        ids = ["ROW_ID"]
    if "ATHLETE_NAME" not in ids:
        standard = standard.withColumn("ATHLETE_NAME", F.concat(F.lit("Athlete_"), F.col("_row").cast("string")))
        ids.append("ATHLETE_NAME")
    if with_test_id:
        ids.append("_row")
    # names and units are known from the header, so they enter as literals
    cells = []
    # a file without any metric column gives an empty table
    for i, header in enumerate(parts.metrics or [""]):
        name, unit = split_header(header)
        value = number_column(standard, header) if parts.metrics else F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(i).cast("bigint").alias("_metric"),
                F.lit(name).alias("TARGET_VARIABLE"),
                F.lit(unit).alias("UNITS"),
                value.alias("RESULT"),
            )
        )
    long = standard.select(*[quoted(c) for c in ids], F.inline(F.array(*cells))).where("RESULT is not null")
    if with_test_id:
        rows = standard.agg(F.count(F.lit(1)).alias("n")).scalar()
        long = long.withColumn("TEST_ID", F.col("_metric") * rows + F.col("_row")).drop("_row")
    return long.drop("_metric").withColumns(
        {
            "LIMB": F.lit("Trial"),
            "TRIAL_LIMB": F.lit("Bilateral"),
            "RESULT_TYPE": F.lit("Measured"),
            "DESCRIPTION": F.col("TARGET_VARIABLE"),
        }
    )


def canonical_metric(metric: Column) -> Column:
    """Trimmed metric name, with the listed whole names replaced."""
    trimmed = F.trim(metric)
    spelled = F.create_map(*[F.lit(v) for pair in rules.METRIC_SPELLINGS.items() for v in pair])
    return F.coalesce(F.try_element_at(spelled, trimmed), trimmed)


def clean_limb(limb: Column) -> Column:
    trimmed = F.trim(limb.cast("string"))
    return F.when(trimmed.isNull() | (trimmed == ""), "Trial").otherwise(trimmed)


def calendar_parts(df: DataFrame, ts: str, names: Sequence[str] = ("YEAR", "QUARTER", "MONTH")) -> DataFrame:
    year, quarter, month = names
    return df.withColumns({year: F.year(ts), quarter: F.quarter(ts), month: F.month(ts)})


def clean_measures(long: DataFrame, default_ts: datetime | None = None) -> DataFrame:
    """Long table ready for the operators: canonical metrics, limbs, dates, calendar parts, finite numbers.

    Without a TEST_DATE column every row gets ``default_ts`` and quarter and month 1.
    """
    df = long
    if "TARGET_VARIABLE" in df.columns:
        df = df.withColumn("TARGET_VARIABLE", canonical_metric(F.col("TARGET_VARIABLE")))
    df = df.withColumn("LIMB", clean_limb(F.col("LIMB")) if "LIMB" in df.columns else F.lit("Trial"))
    if "TEST_DATE" in df.columns:
        kind = dict(df.dtypes)["TEST_DATE"]
        if kind == "string":
            df = df.withColumn("TEST_DATE", general_timestamp(F.col("TEST_DATE")))
        df = calendar_parts(df, "TEST_DATE")
    else:
        if default_ts is None:
            raise ValueError("the file has no TEST_DATE column; pass default_ts")
        df = df.withColumns(
            {
                "TEST_DATE": F.lit(default_ts).cast("timestamp_ntz"),
                "YEAR": F.lit(default_ts.year),
                "QUARTER": F.lit(1),
                "MONTH": F.lit(1),
            }
        )
    return finite_columns(df.withColumn("RESULT", number_column(df, "RESULT")))


def as_measures(df: DataFrame) -> DataFrame:
    """Standard file columns to the names the operators use; further columns are carried along in lower case."""
    renamed = {
        "ATHLETE_NAME": "entity",
        "TARGET_VARIABLE": "metric",
        "RESULT": "value",
        "TEST_DATE": "test_ts",
        "UNITS": "unit",
    }
    return df.select(*[quoted(c).alias(renamed.get(c, c.lower())) for c in df.columns])
