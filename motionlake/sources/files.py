"""CSV readers and writers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cleaning import (
    DEVICE_SHAPE,
    as_measures,
    clean_measures,
    general_timestamp,
    number_column,
    quoted,
    rep_timestamp,
    session_timestamp,
    trim_headers,
    unpivot_tests,
)
from .headers import header_groups, united
from .layout import detect_layout

# fixed values: sprint file header -> column used by the operators
SPRINT_COLUMNS = {
    "Client": "client",
    "TopSpeed": "top_speed",
    "MaxAcceleration": "max_accel",
    "0-5m Time [s]": "split_5",
    "Concentric Load [kg]": "load",
    "Eccentric Load [kg]": "ecc_load",
    "Client Weight [kg]": "weight",
    "Side": "side",
}
SPLIT, SPLIT_YARDS = "0-5m Time [s]", "0-5yd Time [s]"
_TEXT_COLUMNS = {"Client", "Side"}


def read_text_table(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column as text; no pass over the data to infer types.

    ``multi_line`` accepts line breaks inside quotes, at the price of unsplittable files.
    """
    paths = path if isinstance(path, str) else list(path)
    return (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(paths)
    )


def read_text_tables(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> list[DataFrame]:
    """As :func:`read_text_table`, one table for each different header among the files."""
    tables = header_groups(spark, path, lambda files: read_text_table(spark, files, multi_line))
    if not tables:
        raise ValueError("no file with a header")
    return tables


def layout_of(df: DataFrame, layout: str | None = None) -> str:
    """Layout of a text table: the caller's word, or else what the header says.  No data is read."""
    if layout not in (None, "long", "wide"):
        raise ValueError("layout is 'long' or 'wide'")
    found = layout or detect_layout(df.columns)
    if found is None:
        raise ValueError("the header leaves the layout open; pass layout='long' or layout='wide'")
    return found


def read_measures(
    spark: SparkSession,
    path: str | Sequence[str],
    default_ts: datetime | None = None,
    with_test_id: bool = False,
    layout: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Jump files as the long ``measures`` table; each file's header says which layout it has.

    Files of both layouts and of different columns may share a folder.  Test ids are dense within the files of one header.
    """

    def measures(raw: DataFrame) -> DataFrame:
        long = unpivot_tests(raw, with_test_id) if layout_of(raw, layout) == "wide" else raw
        return as_measures(clean_measures(long, default_ts))

    return united([measures(raw) for raw in read_text_tables(spark, path, multi_line)])


def _session_time() -> Column:
    """Session time of one row: the device format, or else any general one; rows of both may share a folder.

    The text's shape decides which parser it meets.
    """
    text = F.col("SessionTime").cast("string")
    return F.when(text.rlike(DEVICE_SHAPE), session_timestamp(text)).otherwise(general_timestamp(text))


def rejected_sprints(raw: DataFrame) -> DataFrame:
    """One row on what :func:`clean_sprints` leaves out: ``rows, without_date, without_speed`` (dated ones), ``kept``."""
    df = trim_headers(raw)
    dated, speed = _session_time().isNotNull(), number_column(df, "TopSpeed").isNotNull()
    return df.select(dated.alias("dated"), speed.alias("speed")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.col("dated")).alias("without_date"),
        F.count_if(F.col("dated") & ~F.col("speed")).alias("without_speed"),
        F.count_if(F.col("dated") & F.col("speed")).alias("kept"),
    )


def clean_sprints(raw: DataFrame) -> DataFrame:
    """Sprint rows with a session date and a speed, under the names the operators use.

    The yard split stands in, unconverted, for a missing metre split.  Each row's time is read in the device format or
    else generally; :func:`rejected_sprints` counts the rows without one.
    """
    df = trim_headers(raw)
    if SPLIT_YARDS in df.columns and SPLIT not in df.columns:
        df = df.withColumn(SPLIT, quoted(SPLIT_YARDS))
    # explode drops rows without a time and, unlike a filter, forms the time once for all that follows
    df = df.select("*", F.explode(F.array_compact(F.array(_session_time()))).alias("session_ts"))
    columns = [
        (quoted(source) if source in _TEXT_COLUMNS else number_column(df, source)).alias(target)
        for source, target in SPRINT_COLUMNS.items()
        if source in df.columns
    ]
    columns += [
        F.lit(None).cast("double").alias(target)
        for source, target in SPRINT_COLUMNS.items()
        if source not in df.columns and source not in _TEXT_COLUMNS
    ]
    if "Side" not in df.columns:
        columns.append(F.lit(None).cast("string").alias("side"))
    session = F.col("session_ts")
    rep = rep_timestamp(F.col("RepTime"), session) if "RepTime" in df.columns else session
    return df.select(
        *columns,
        "session_ts",
        F.to_date("session_ts").alias("session_date"),
        rep.alias("rep_ts"),
    ).where("session_date is not null and top_speed is not null")


def read_sprints(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """Sprint files, with metre or yard splits in one folder; files without any date are rejected, a check that stops at
    the first row with one."""
    tables = read_text_tables(spark, path, multi_line)
    if all(trim_headers(raw).where(_session_time().isNotNull()).isEmpty() for raw in tables):
        raise ValueError("no date in column SessionTime could be parsed")
    return united([clean_sprints(raw) for raw in tables])


def write_csv(df: DataFrame, path: str, compression: str = "none", rows_per_file: int = 0) -> None:
    """One CSV folder with headers; partitions are written in parallel.

    Compressed files can't be split when they are read, so ``rows_per_file`` (0: no bound) should bound them.
    """
    writer = df.write.option("header", True).option("escape", '"').option("compression", compression)
    writer.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
