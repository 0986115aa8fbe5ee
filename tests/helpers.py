from __future__ import annotations

from datetime import date, datetime, timedelta

SPRINTS = (
    "client string, session_date date, rep_ts timestamp_ntz, top_speed double, max_accel double, split_5 double, "
    "load double, ecc_load double, weight double, side string"
)
MEASURES = "entity string, metric string, value double, test_ts timestamp_ntz"
START = date(2024, 1, 1)


def sprint(client="a", day=0, rep=0, speed=8.0, accel=5.0, split=1.0, load=0.0, ecc=None, weight=80.0, side=None):
    when = START + timedelta(days=day)
    moment = datetime(when.year, when.month, when.day, 10) + timedelta(seconds=rep)
    numbers = [None if v is None else float(v) for v in (speed, accel, split, load, ecc, weight)]
    return (client, when, moment, *numbers, side)


def sprints(spark, rows):
    return spark.createDataFrame(rows, SPRINTS)


def measures(spark, rows):
    """Rows of (entity, metric, value, day)."""
    full = [(e, m, None if v is None else float(v), datetime(2024, 1, 1) + timedelta(days=d)) for e, m, v, d in rows]
    return spark.createDataFrame(full, MEASURES)


def one(df, **match):
    rows = [r.asDict(True) for r in df.collect()]
    found = [r for r in rows if all(r[k] == v for k, v in match.items())]
    assert len(found) == 1, (match, rows)
    return found[0]


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict(True) for r in df.collect()}
