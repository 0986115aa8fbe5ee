from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from motionlake.functions import folding, rules
from motionlake.sources import cleaning, files, layout


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


LONG = """ATHLETE_NAME,TARGET_VARIABLE,RESULT,TEST_DATE,LIMB,UNITS
Ann, Jump Height ,30.5,2024-01-05,,cm
Ann,RFD,abc,2024-01-05,Left,N/s
"Lee, Bo",Peak Power / BM,inf,bad date,Trial,W/kg
"Lee, Bo",Braking RFD,12,1/9/2024, Right ,N/s
"""

WIDE = """Name,Date,Type,Tags,Jump Height [cm],Peak Power / BM [W/kg],mRSI,Flight.Time`s [ms],Notes
Ann,2024-01-05,CMJ,t1,30.5,,0.4,500,fine
Bo,2024-01-06,CMJ,t2,28,51.2,n/a,480,late
"""


def test_layouts():
    assert layout.detect_layout(["ATHLETE_NAME", "RESULT", "TEST_DATE", "Name"]) == "long"
    assert layout.detect_layout(["Name", "x"]) == "wide"
    assert layout.detect_layout([f"m{i} [kg]" for i in range(6)]) == "wide"
    assert layout.detect_layout([f"m{i} [kg]" for i in range(5)]) is None
    assert layout.detect_layout(["TestId", "Date", "Tags"]) == "wide"
    assert layout.detect_layout(["RSI", "mRSI", "Stiffness"]) == "wide"
    assert layout.detect_layout(["a"]) is None


def test_layout_does_not_depend_on_the_number_of_rows(spark, tmp_path):
    header = ",".join(f"c{i}" for i in range(11))
    for n in (999, 1000):
        path = write(tmp_path, f"n{n}.csv", header + "\n" + (",".join("1" for _ in range(11)) + "\n") * n)
        raw = files.read_text_table(spark, path)
        with pytest.raises(ValueError, match="layout"):
            files.layout_of(raw)
        assert files.layout_of(raw, "wide") == "wide" and files.layout_of(raw, "long") == "long"
    with pytest.raises(ValueError, match="layout"):
        files.layout_of(raw, "tall")


def test_headers_and_column_kinds():
    assert layout.standard_headers(["Type", "Test Type", "Name"]) == {"TEST_TYPE": ["Test Type", "Type"], "ATHLETE_NAME": ["Name"]}
    split = layout.split_columns(["ATHLETE_NAME", "Reps", "x%", "a/b", "L|R", "Net Something", "Notes"])
    assert split.ids == ["ATHLETE_NAME", "Reps"]
    assert split.metrics == ["x%", "a/b", "L|R", "Net Something"]
    assert split.dropped == ["Notes"]
    assert layout.missing_columns(["RESULT", "LIMB"]) == ["ATHLETE_NAME", "TARGET_VARIABLE", "TEST_DATE"]
    assert len(rules.METRIC_KEYWORDS) == 43


def test_duplicate_targets_are_coalesced(spark):
    df = spark.createDataFrame([("a", None), (None, "b"), ("c", "d")], "Type string, `Test Type` string")
    assert [r.TEST_TYPE for r in cleaning.standardize_headers(df).collect()] == ["a", "b", "d"]


def test_metric_and_unit(spark):
    cases = {
        "Jump Height (Imp-Mom) [cm]": ("Jump Height (Imp-Mom)", "cm"),
        "A [x] B [y] tail": ("A [x] B", "y"),
        "[cm]": ("[cm]", ""),
        "a ] b [": ("a ] b [", ""),
        "plain": ("plain", ""),
        "nested [a[b]": ("nested [a", "b"),
        "twice [a]]": ("twice", "a]"),
    }
    df = spark.createDataFrame([(h,) for h in cases], "h string")
    assert {h: layout.split_header(h) for h in cases} == cases
    name, unit = cleaning.metric_and_unit("h")
    assert {r.h: (r.n, r.u) for r in df.select("h", name.alias("n"), unit.alias("u")).collect()} == cases


def test_long_file(spark, tmp_path):
    df = files.read_measures(spark, write(tmp_path, "long.csv", LONG))
    rows = {(r.entity, r.metric): r for r in df.collect()}
    assert rows["Ann", "Jump Height"].value == 30.5 and rows["Ann", "Jump Height"].limb == "Trial"
    assert rows["Ann", "Rate of Force Development"].value is None
    assert rows["Lee, Bo", "Peak Power Per BM"].value is None and rows["Lee, Bo", "Peak Power Per BM"].test_ts is None
    last = rows["Lee, Bo", "Braking RFD"]
    assert (last.limb, last.year, last.quarter, last.month) == ("Right", 2024, 1, 1)


def test_wide_file(spark, tmp_path):
    df = files.read_measures(spark, write(tmp_path, "wide.csv", WIDE), with_test_id=True)
    rows = {(r.entity, r.metric): r for r in df.collect()}
    assert set(rows) == {
        ("Ann", "Jump Height"), ("Bo", "Jump Height"), ("Bo", "Peak Power Per BM"), ("Ann", "mRSI"),
        ("Ann", "Flight.Time`s"), ("Bo", "Flight.Time`s"),
    }
    assert rows["Bo", "Peak Power Per BM"].unit == "W/kg" and rows["Ann", "mRSI"].unit == ""
    assert rows["Ann", "Jump Height"].test_type == "CMJ" and rows["Ann", "Jump Height"].tags == "t1"
    # ids count the cells metric by metric, empty ones included
    assert rows["Bo", "Jump Height"].test_id == 1 and rows["Bo", "Peak Power Per BM"].test_id == 3
    assert rows["Ann", "mRSI"].test_id == 4 and rows["Bo", "Flight.Time`s"].test_id == 7


def test_same_answers_from_both_layouts(spark, tmp_path):
    wide = files.read_measures(spark, write(tmp_path, "w.csv", WIDE))
    text = "ATHLETE_NAME,TARGET_VARIABLE,RESULT,TEST_DATE,LIMB\n" + "".join(
        f"{r.entity},{r.metric},{r.value},{r.test_ts.date()},Trial\n" for r in wide.collect()
    )
    long = files.read_measures(spark, write(tmp_path, "l.csv", text))
    columns = ["entity", "metric", "value", "test_ts", "limb", "year"]
    assert sorted(map(tuple, wide.select(columns).collect())) == sorted(map(tuple, long.select(columns).collect()))


def test_files_without_names_or_ids(spark, tmp_path):
    text = "Jump Height [cm],Peak Force [N],a [x],b [x],c [x],d [x]\n1,2,3,4,5,6\n7,8,9,10,11,12\n"
    df = files.read_measures(spark, write(tmp_path, "x.csv", text), default_ts=datetime(2024, 5, 6))
    got = {(r.entity, r.metric): r.value for r in df.collect()}
    assert got["Athlete_0", "Jump Height"] == 1 and got["Athlete_1", "d"] == 12
    assert {r.row_id for r in df.collect()} == {0, 1}
    assert {(r.year, r.quarter, r.month) for r in df.collect()} == {(2024, 1, 1)}
    with pytest.raises(ValueError, match="default_ts"):
        files.read_measures(spark, write(tmp_path, "y.csv", text))


def test_row_index_is_dense_over_many_files(spark, tmp_path):
    for i in range(4):
        write(tmp_path, f"p{i}.csv", "v\n" + "".join(f"{i * 100 + j}\n" for j in range(30 + i)))
    df = cleaning.with_row_index(files.read_text_table(spark, str(tmp_path / "*.csv")), "i")
    rows = sorted((r.i, int(r.v)) for r in df.collect())
    assert [i for i, _ in rows] == list(range(126))
    assert [v for _, v in rows] == sorted(v for _, v in rows)
    plain = cleaning.with_row_index(spark.range(0, 50, 1, 5), "i")
    assert sorted((r.id, r.i) for r in plain.collect()) == [(k, k) for k in range(50)]


SPRINT = """Client , SessionTime,TopSpeed,Concentric Load [kg],0-5yd Time [s],MaxAcceleration,Client Weight [kg],RepTime
Ann,3/7/2024 1:05:09 PM -05:00,8.1,0,1.02,5.5,70,13:06:10
Ann,3/7/2024 1:05:09 PM -05:00,7.9,10,1.05,5.1,70,13:05:50
Ann,not a time,8.5,0,1.0,5.5,70,13:05:50
Ann,3/8/2024 11:00:00 AM -05:00,,0,1.0,5.5,70,
"""


def test_sprint_file(spark, tmp_path):
    df = files.read_sprints(spark, write(tmp_path, "s.csv", SPRINT))
    rows = sorted(df.collect(), key=lambda r: r.rep_ts)
    assert [r.top_speed for r in rows] == [7.9, 8.1]
    assert rows[0].session_ts == datetime(2024, 3, 7, 13, 5, 9) and rows[0].rep_ts == datetime(2024, 3, 7, 13, 5, 50)
    assert rows[0].split_5 == 1.05 and rows[0].ecc_load is None and rows[0].side is None


def test_sprint_file_with_other_dates(spark, tmp_path):
    text = "Client,SessionTime,TopSpeed\nAnn,2024-03-07 13:05:09,8\nAnn,bad,9\n"
    rows = files.read_sprints(spark, write(tmp_path, "i.csv", text)).collect()
    assert [r.session_ts for r in rows] == [datetime(2024, 3, 7, 13, 5, 9)]
    with pytest.raises(ValueError, match="SessionTime"):
        files.read_sprints(spark, write(tmp_path, "b.csv", "Client,SessionTime,TopSpeed\nAnn,bad,8\n"))


def test_sprint_files_of_several_date_formats(spark, tmp_path):
    times = ["3/7/2024 1:05:09 PM -05:00", "2024-03-08 10:00:00", "2024-03-09", "bad"]
    for i, time in enumerate(times):
        write(tmp_path, f"m{i}.csv", f"Client,SessionTime,TopSpeed\nAnn,{time},8\nAnn,{time},x\n")
    path = str(tmp_path / "m*.csv")
    assert sorted(r.session_ts for r in files.read_sprints(spark, path).collect()) == [
        datetime(2024, 3, 7, 13, 5, 9), datetime(2024, 3, 8, 10), datetime(2024, 3, 9),
    ]
    assert tuple(files.rejected_sprints(files.read_text_table(spark, path)).first()) == (8, 2, 3, 3)


def test_line_breaks_in_quotes(spark, tmp_path):
    text = 'Client,SessionTime,TopSpeed,Note\nAnn,2024-03-07,8,"one\ntwo"\nBo,2024-03-07,9,x\n'
    rows = files.read_sprints(spark, write(tmp_path, "q.csv", text), multi_line=True).collect()
    assert sorted((r.client, r.top_speed) for r in rows) == [("Ann", 8.0), ("Bo", 9.0)]


def test_metre_split_wins_over_yards(spark, tmp_path):
    text = "Client,SessionTime,TopSpeed,0-5yd Time [s],0-5m Time [s]\nAnn,2024-03-07,8,1,2\n"
    assert files.read_sprints(spark, write(tmp_path, "y.csv", text)).first().split_5 == 2.0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('say "hi", you', 1.25), ("plain", None)], "name string, x double")
    files.write_csv(df, str(tmp_path / "out"))
    back = files.read_text_table(spark, str(tmp_path / "out"))
    assert sorted((r.name, r.x) for r in back.collect()) == [("plain", None), ('say "hi", you', "1.25")]


def test_rep_times(spark):
    df = spark.createDataFrame([("13:05:50",), ("1:05:50 PM",), ("12.5",), ("2024-01-02 03:04:05",), ("?",)], "t string")
    session = F.lit("2024-03-07 13:00:00").cast("timestamp_ntz")
    got = [r[0] for r in df.select(cleaning.rep_timestamp(F.col("t"), session)).collect()]
    day = datetime(2024, 3, 7)
    assert got == [
        day.replace(hour=13, minute=5, second=50), day.replace(hour=13, minute=5, second=50),
        day.replace(hour=13, second=12, microsecond=500000), datetime(2024, 1, 2, 3, 4, 5), day.replace(hour=13),
    ]


def test_wide_file_without_metrics_is_empty(spark, tmp_path):
    df = files.read_measures(spark, write(tmp_path, "e.csv", "Name,Date,Notes\nAnn,2024-01-05,fine\n"))
    assert df.count() == 0 and {"entity", "metric", "value", "test_ts"} <= set(df.columns)


def test_folder_of_several_headers(spark, tmp_path):
    """Order of columns, missing columns, both splits, odd file names; an empty file says nothing."""
    (tmp_path / "a b[1].csv").write_text("Client,SessionTime,TopSpeed,0-5m Time [s]\nx,3/7/2024 1:05:09 PM,8.5,1.1\n")
    (tmp_path / "c.csv").write_text("TopSpeed, Client ,0-5yd Time [s],SessionTime,MaxAcceleration\n7.5,y,1.2,2024-03-08 10:00:00,4\n")
    (tmp_path / "d.csv").write_text("Client,SessionTime,TopSpeed,0-5m Time [s]\nz,not a time,8,1\nz,2024-03-09,8,1\n")
    (tmp_path / "e.csv").write_text("")
    for path in (str(tmp_path), f"{tmp_path}/*.csv", [f"{tmp_path}/a b\\[1\\].csv", f"{tmp_path}/c.csv", f"{tmp_path}/d.csv"]):
        rows = files.read_sprints(spark, path).orderBy("client").collect()
        assert [(r.client, r.top_speed, r.split_5, r.max_accel, str(r.session_date)) for r in rows] == [
            ("x", 8.5, 1.1, None, "2024-03-07"), ("y", 7.5, 1.2, 4.0, "2024-03-08"), ("z", 8.0, 1.0, None, "2024-03-09"),
        ]
    assert len(files.read_text_tables(spark, str(tmp_path))) == 2
    with pytest.raises(ValueError, match="no file with a header"):
        files.read_sprints(spark, f"{tmp_path}/e.csv")


def test_folder_of_both_layouts(spark, tmp_path):
    (tmp_path / "long.csv").write_text("ATHLETE_NAME,TARGET_VARIABLE,RESULT,TEST_DATE\na,Jump Height,30,2024-01-01\n")
    (tmp_path / "wide.csv").write_text("Name,Date,Jump Height [cm],Peak Power [W]\nb,1/2/2024,31,\nc,1/3/2024,32,4000\n")
    rows = files.read_measures(spark, str(tmp_path)).orderBy("entity", "metric").collect()
    assert [(r.entity, r.metric, r.value, r.test_ts.day) for r in rows] == [
        ("a", "Jump Height", 30.0, 1), ("b", "Jump Height", 31.0, 2), ("c", "Jump Height", 32.0, 3), ("c", "Peak Power", 4000.0, 3),
    ]


def test_a_time_is_parsed_once(spark):
    """A text meets one written parser or the cast, and rows without a time do not parse again in the projection."""
    raw = spark.createDataFrame([("a", "3/7/2024 1:05:09 PM -05:00", "8")], "Client string, SessionTime string, TopSpeed string")
    plan = files.clean_sprints(raw).select("client", "session_ts", "session_date", "rep_ts")._jdf.queryExecution().optimizedPlan().toString()
    # the device's parser, the written formats in one pattern, and the cast
    assert plan.count("gettimestamp(") == 2 and plan.count("as timestamp_ntz)") == 3, plan


def test_metric_totals_fold_days_and_metrics(spark):
    """Totals are those of a plain grouping, and neither metrics nor days are keys of an exchange."""
    day = [datetime(2024, 1, 31, 23), datetime(2024, 1, 31, 1), datetime(2024, 2, 1), datetime(2023, 2, 1), None]
    rows = [(e, m, v, d) for e in (1, 2, None) for m in ("a", "b", "c", "other") for v in (1.5, None, -3.0) for d in day if (e, m) != (2, "c")]
    rows += [(3, "a", None, day[0])]
    df = spark.createDataFrame(rows, "entity long, metric string, value double, test_ts timestamp_ntz")
    plain = df.where("metric <> 'other'").groupBy("entity", "metric").agg(
        F.count("value").alias("results"), F.sum("value").alias("total"), F.countDistinct(F.to_date("test_ts")).alias("dates")
    )
    got = folding.metric_totals(df, ["a", "b", "c"])
    assert got.columns == plain.columns and set(got.collect()) == set(plain.where("results > 0").collect()) and got.count() == 8
    plan = got._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any("metric" in k or "_day" in k for k in keys)


def test_csv_in_compressed_files_of_few_rows(spark, tmp_path):
    df = spark.range(0, 25, 1, 2).selectExpr("cast(id as string) as id", "'a \"b\", c' as t")
    files.write_csv(df, str(tmp_path / "out"), "gzip", 5)
    assert len(list((tmp_path / "out").glob("*.csv.gz"))) == 6
    assert sorted(files.read_text_table(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())
