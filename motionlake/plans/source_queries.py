"""Queries on reading and cleaning: each derives raw-looking columns from the tables and cleans them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.folding import metric_totals
from ..operators import quality, sessions
from ..session import scratch_path
from ..sources import cleaning, files
from .registry import query
from .views import METRIC_NAMES, METRICS, Tables

#: Rows of a compressed file, which one task reads.
CSV_ROWS = 1_000_000

_WIDE_SQL = " union all ".join(
    f"""select l_suppkey as athlete_name, l_returnflag as test_type, l_shipdate as test_date,
        '{header.rsplit(" [", 1)[0]}' as target_variable, '{header.rsplit(" [", 1)[1][:-1]}' as units,
        cast({expression} as double) as result, {i} as metric_position, row_position from numbered"""
    for i, (header, expression) in enumerate(METRICS.items())
)
_NUMBERED = "numbered as (select *, row_number() over () - 1 as row_position from lineitem)"


@query(
    "a08_unpivot_tests",
    sql=f"""
    with {_NUMBERED}, long as ({_WIDE_SQL})
    select athlete_name, test_type, test_date, target_variable, units, result, 'Trial' as limb,
           'Bilateral' as trial_limb, 'Measured' as result_type, target_variable as description
    from long where result is not null
    """,
    result=6,
)
def _(t: Tables):
    long = cleaning.unpivot_tests(t.tests_wide, with_test_id=False).drop("TAGS")
    return long.toDF(*[c.lower() for c in long.columns])


@query(
    "a10_test_ids",
    sql=f"""
    with {_NUMBERED}, long as ({_WIDE_SQL})
    select target_variable, athlete_name,
           metric_position * (select count(*) from lineitem) + row_position as test_id
    from long where result is not null
    """,
)
def _(t: Tables):
    long = cleaning.unpivot_tests(t.tests_wide)
    return long.select(
        F.col("TARGET_VARIABLE").alias("target_variable"),
        F.col("ATHLETE_NAME").alias("athlete_name"),
        F.col("TEST_ID").alias("test_id"),
    )


@query(
    "a03_both_splits",
    sql="""
    select cast(l_suppkey as varchar) as client, count(*) as sprints, count(distinct cast(l_shipdate as date)) as dates,
           sum(case when l_linestatus = 'F' then l_quantity else l_quantity / 2 end) as split_5,
           count(case when l_linestatus = 'F' then l_tax end) as accelerations
    from lineitem group by l_suppkey
    """,
    split_5=4,
)
def _(t: Tables):
    """A folder whose files have metre splits, or yard splits in another order of columns and one column less."""
    time = F.concat(F.date_format("l_shipdate", "M/d/yyyy h:mm:ss a"), F.lit(" -05:00")).alias("SessionTime")
    client, speed, raw = F.col("l_suppkey").alias("Client"), F.col("l_extendedprice").alias("TopSpeed"), t.table("lineitem")
    folder = scratch_path(t.spark, "sprints-csv")
    metres = raw.where("l_linestatus = 'F'").select(client, time, speed, F.col("l_quantity").alias("0-5m Time [s]"), F.col("l_tax").alias("MaxAcceleration"))
    yards = raw.where("l_linestatus <> 'F'").select(time, (F.col("l_quantity") / 2).alias("0-5yd Time [s]"), speed, client)
    files.write_csv(metres, f"{folder}/metres")
    files.write_csv(yards, f"{folder}/yards")
    return (
        files.read_sprints(t.spark, f"{folder}/*")
        .groupBy("client")
        .agg(
            F.count(F.lit(1)).alias("sprints"),
            F.countDistinct("session_date").alias("dates"),
            F.sum("split_5").alias("split_5"),
            F.count("max_accel").alias("accelerations"),
        )
    )


@query(
    "a04_both_layouts",
    sql="""
    select entity, metric, count(value) as results, sum(value) as total, count(distinct cast(test_ts as date)) as dates
    from measures where value is not null group by entity, metric
    """,
    total=3,
)
def _(t: Tables):
    """A folder with files of either layout: tests of type R as one row per value, the others as one row per test."""
    folder = scratch_path(t.spark, "jumps-csv")
    files.write_csv(t.tests_wide.where("Type <> 'R'"), f"{folder}/wide", "gzip", CSV_ROWS)
    long = t.measures.where("test_type = 'R' and value is not null").select(
        F.col("entity").alias("ATHLETE_NAME"), F.col("test_ts").alias("TEST_DATE"), F.col("metric").alias("TARGET_VARIABLE"), F.col("value").alias("RESULT")
    )
    files.write_csv(long, f"{folder}/long", "gzip", CSV_ROWS)
    found = files.read_measures(t.spark, f"{folder}/*")
    return metric_totals(found.withColumn("entity", F.col("entity").cast("bigint")), METRIC_NAMES)


@query(
    "a07_missing_athletes",
    sql=f"""
    with {_NUMBERED}
    select 'Athlete_' || row_position as athlete_name, l_returnflag as test_type, l_quantity as result
    from numbered
    """,
)
def _(t: Tables):
    nameless = t.tests_wide.select("Type", "`Jump Height [cm]`")
    return cleaning.unpivot_tests(nameless, with_test_id=False).select(
        F.col("ATHLETE_NAME").alias("athlete_name"),
        F.col("TEST_TYPE").alias("test_type"),
        F.col("RESULT").alias("result"),
    )


@query(
    "a09_metric_units",
    sql="""
    with headers as (
      select distinct event_type || ' (' || user_id || ') [' || event_type || '/s]' as header from events
      union select distinct event_type || ' ] ' || user_id || ' [' from events
      union select distinct event_type || ' ' || user_id from events)
    select header,
           case when header like '%/s]' then regexp_extract(header, '^(.*) \\[', 1) else header end as metric,
           case when header like '%/s]' then regexp_extract(header, '\\[(.*)\\]$', 1) else '' end as unit
    from headers
    """,
)
def _(t: Tables):
    parts = [
        F.concat("event_type", F.lit(" ("), "user_id", F.lit(") ["), "event_type", F.lit("/s]")),
        F.concat("event_type", F.lit(" ] "), "user_id", F.lit(" [")),
        F.concat("event_type", F.lit(" "), "user_id"),
    ]
    headers = t.table("events").select(F.explode(F.array(*parts)).alias("header")).distinct()
    name, unit = cleaning.metric_and_unit("header")
    return headers.select("header", name.alias("metric"), unit.alias("unit"))


@query(
    "a11_numbers_from_text",
    sql="""
    select l_linenumber as kind, count(*) as rows,
           count(*) filter (where l_linenumber not in (1, 2, 3)) as numbers,
           sum(l_quantity) filter (where l_linenumber not in (1, 2, 3)) as total
    from lineitem group by l_linenumber
    """,
    total=3,
)
def _(t: Tables):
    text = F.expr(
        "case l_linenumber when 1 then 'n/a' when 2 then 'inf' when 3 then 'NaN' else concat(' ', l_quantity, ' ') end"
    )
    raw = t.table("lineitem").select("l_linenumber", text.alias("RESULT"))
    numbers = raw.withColumn("RESULT", cleaning.number_column(raw, "RESULT"))
    return numbers.groupBy(F.col("l_linenumber").alias("kind")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("RESULT").alias("numbers"), F.sum("RESULT").alias("total")
    )


@query(
    "a12_finite_values",
    sql="""
    select event_type as metric, count(*) as rows, count(*) filter (where user_id % 5 not in (0, 1, 2)) as finite_rows,
           max(value) filter (where user_id % 5 not in (0, 1, 2)) as largest from events group by event_type
    """,
    largest=6,
)
def _(t: Tables):
    broken = t.events.withColumn(
        "value",
        F.expr(
            "case entity % 5 when 0 then double('NaN') when 1 then double('Infinity') when 2 then double('-Infinity') else value end"
        ),
    )
    cleaned = cleaning.finite_columns(broken)
    return cleaned.groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("finite_rows"), F.max("value").alias("largest")
    )


@query(
    "a13_session_times",
    sql="""
    select event_id, date_trunc('second', ts) as session_ts, cast(ts as date) as session_date from events
    """,
)
def _(t: Tables):
    text = F.concat(F.date_format("ts", "M/d/yyyy h:mm:ss a"), F.lit(" -05:00"))
    raw = t.table("events").select("event_id", text.alias("SessionTime"))
    session = cleaning.session_timestamp(F.col("SessionTime"))
    return raw.select("event_id", session.alias("session_ts"), F.to_date(session).alias("session_date"))


def _mixed_times(t: Tables):
    """Sprint-like rows whose time is written by the device, as ISO, or not at all."""
    kind = F.col("event_id") % 3
    text = (
        F.when(kind == 0, F.concat(F.date_format("ts", "M/d/yyyy h:mm:ss a"), F.lit(" -05:00")))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise("not a time")
    )
    speed = F.when(F.col("event_id") % 5 != 0, F.col("value").cast("string"))
    return t.table("events").select(
        F.col("user_id").cast("string").alias("Client"), text.alias("SessionTime"), speed.alias("TopSpeed")
    )


@query(
    "a13_mixed_formats",
    sql="""
    select user_id as client, count(*) as sprints, count(distinct cast(ts as date)) as dates,
           max(date_trunc('second', ts)) as last_session
    from events where event_id % 3 <> 2 and event_id % 5 <> 0 and value is not null group by user_id
    """,
)
def _(t: Tables):
    return (
        files.clean_sprints(_mixed_times(t))
        .groupBy(F.col("client").cast("bigint").alias("client"))
        .agg(
            F.count(F.lit(1)).alias("sprints"),
            F.countDistinct("session_date").alias("dates"),
            F.max("session_ts").alias("last_session"),
        )
    )


@query(
    "a13_rejected_rows",
    sql="""
    select count(*) as rows, count(*) filter (where event_id % 3 = 2) as without_date,
           count(*) filter (where event_id % 3 <> 2 and (event_id % 5 = 0 or value is null)) as without_speed,
           count(*) filter (where event_id % 3 <> 2 and event_id % 5 <> 0 and value is not null) as kept
    from events
    """,
)
def _(t: Tables):
    return files.rejected_sprints(_mixed_times(t))


@query(
    "a13_general_dates",
    sql="select o_orderkey, case when o_orderkey % 6 = 5 then null else cast(o_orderdate as date) end as test_date from orders",
)
def _(t: Tables):
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderkey") % 6 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 6 == 1, F.date_format(day, "M/d/yyyy"))
        .when(F.col("o_orderkey") % 6 == 2, F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderkey") % 6 == 3, F.date_format(day, "d MMM yyyy"))
        .when(F.col("o_orderkey") % 6 == 4, F.date_format(day, "M/d/yyyy h:mm:ss a"))
        .otherwise("not a date")
    )
    return t.table("orders").select("o_orderkey", F.to_date(cleaning.general_timestamp(text)).alias("test_date"))


@query(
    "a14_calendar_parts",
    sql="""
    select cast(year(l_shipdate) as int) as year, cast(quarter(l_shipdate) as int) as quarter,
           cast(month(l_shipdate) as int) as month, count(*) as rows from lineitem group by all
    """,
)
def _(t: Tables):
    dated = cleaning.calendar_parts(t.measures.select("test_ts", "metric"), "test_ts", ("year", "quarter", "month"))
    return dated.groupBy("year", "quarter", "month").agg((F.count(F.lit(1)) / 8).cast("bigint").alias("rows"))


_RAW_NAMES = [" Peak Power / BM", "RSI-modified ", "RFD", "Braking RFD", "Imp-Mom", "% (Asym)", "Flight Time:Contraction Time"]


@query(
    "a15_canonical_metrics",
    sql="""
    with names as (
      select case l_linenumber when 1 then 'Peak Power Per BM' when 2 then 'RSI Modified'
             when 3 then 'Rate of Force Development' when 4 then 'Braking RFD' when 5 then 'Impulse Momentum'
             when 6 then 'Asymmetry' when 7 then 'Flight Time To Contraction Time Ratio' end as metric from lineitem)
    select metric, count(*) as rows from names group by metric
    """,
)
def _(t: Tables):
    raw = F.element_at(F.array(*[F.lit(n) for n in _RAW_NAMES]), F.col("l_linenumber"))
    return t.table("lineitem").groupBy(cleaning.canonical_metric(raw).alias("metric")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a16_limbs",
    sql="""
    select case l_linenumber when 1 then 'Trial' when 2 then 'Trial' when 3 then 'Left' else 'Right' end as limb,
           count(*) as rows from lineitem group by 1
    """,
)
def _(t: Tables):
    raw = F.expr("case l_linenumber when 1 then null when 2 then '  ' when 3 then ' Left' else 'Right ' end")
    return t.table("lineitem").groupBy(cleaning.clean_limb(raw).alias("limb")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "a17_valid_sprints",
    sql="""
    select l_suppkey as client, count(*) as sprints, count(distinct cast(l_shipdate as date)) as dates
    from lineitem where l_returnflag <> 'R' and l_linenumber <> 7 group by l_suppkey
    """,
)
def _(t: Tables):
    raw = t.table("lineitem").select(
        F.col("l_suppkey").cast("string").alias(" Client "),
        F.when(F.col("l_returnflag") == "R", "unknown")
        .otherwise(F.concat(F.date_format("l_shipdate", "M/d/yyyy h:mm:ss a"), F.lit(" -05:00")))
        .alias("SessionTime"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice").cast("string")).alias("TopSpeed"),
        F.col("l_quantity").cast("string").alias("0-5yd Time [s]"),
    )
    return (
        files.clean_sprints(raw)
        .groupBy(F.col("client").cast("bigint").alias("client"))
        .agg(F.count(F.lit(1)).alias("sprints"), F.countDistinct("session_date").alias("dates"))
    )


@query(
    "a19_load_summary",
    sql="""
    select count(*) as rows, count(distinct entity) as entities, count(distinct metric) as metrics,
           min(cast(test_ts as date)) as first_date, max(cast(test_ts as date)) as last_date,
           count(distinct cast(test_ts as date)) as training_days from measures
    """,
)
def _(t: Tables):
    return quality.load_summary(t.measures)


@query(
    "a20_csv_round_trip",
    sql="""
    select cast(client as varchar) as client, max(top_speed) as max_speed, count(distinct session_date) as sessions
    from sprints group by client
    """,
    max_speed=6,
)
def _(t: Tables):
    path = scratch_path(t.spark, "summary-csv")
    files.write_csv(sessions.athlete_summary(t.sprints), path)
    back = files.read_text_table(t.spark, path)
    return back.select(
        "client",
        cleaning.number_column(back, "max_speed").alias("max_speed"),
        F.col("sessions").cast("bigint").alias("sessions"),
    )
