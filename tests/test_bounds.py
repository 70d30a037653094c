"""Tracks whose mean or percentile lies at a bound, on tables made for it."""

from datetime import datetime, timedelta

import duckdb
from oracle import compare, connection

from trackloom.operators import prune
from trackloom.plans import catalog

#: 0.823 + 0.17 * 0.1 is 0.84, but just below it in doubles.
BELOW = [0.6] * 8 + [0.823, 0.993]
AT = [0.6] * 6 + [0.792, 0.952]
#: 3.3 / 6, which is below 0.55 in doubles; these six add up to 3.3 or less in every order.
SIX = [0.306, 0.322, 0.356, 0.59, 0.821, 0.905]


def events(spark, folder, tracks):
    """An hourly event for each confidence of each user; the id of an event decides its confidence."""
    rows, turn = [], 0
    for user, confs in tracks.items():
        for hour, conf in enumerate(confs):
            turn += 1
            rows.append(((round(conf * 1000) - 300) * pow(7919, -1, 700) % 700 + 700 * turn, datetime(2024, 1, 1) + timedelta(hours=hour), user))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_summary_is_on_the_side_of_a_bound_where_sql_is(spark, tmp_path):
    d = events(spark, tmp_path, {1: BELOW, 2: AT, 3: SIX, 17: AT, 18: [0.9] * 7})
    got = catalog.QUERIES["summary_per_clip"](spark, d)
    assert {r.clip: (r.tracks, r.n_rows) for r in got.collect()} == {"c0": (1, 8), "c1": (2, 15)}
    compare(got, connection(d), catalog.ORACLES["summary_per_clip"])


def test_half_way_means_are_rounded_up(spark, tmp_path):
    """Two tracks with 22.103 / 32 and 22.301 / 32: half of their sum is 0.6938125, but just below it in doubles."""
    d = events(spark, tmp_path, {1: [0.9] * 8 + [0.621] * 23 + [0.62], 2: [0.9] * 8 + [0.629] * 23 + [0.634]})
    assert [r.mean_conf for r in catalog.QUERIES["summary_per_clip"](spark, d).collect()] == [0.693813]


def test_gate_and_measures_are_on_the_side_of_a_bound_where_sql_is(spark):
    rows = [("c", f, t, 0.0, 0.0, 20.0, 20.0, c) for t, confs in ((1, BELOW), (2, AT)) for f, c in enumerate(confs)]
    df = spark.createDataFrame(rows, "clip string, frame long, tid long, x1 double, y1 double, x2 double, y2 double, conf double")
    assert {r.tid for r in prune.gate(df, 5, 0.55, 0.84).collect()} == {2}
    each = prune.measured(df)
    assert {r.tid: (r.n, r.p >= 0.84) for r in each.collect()} == {1: (10, False), 2: (8, True)}
    assert [r.tid for r in prune.chosen(each, 9, 5, 0.55, 0.84).collect()] == [2]
    sql = f"SELECT tid, quantile_cont(c, 0.9) >= 0.84 AS ok FROM (SELECT 1 AS tid, unnest({BELOW}::DOUBLE[]) AS c UNION ALL SELECT 2, unnest({AT}::DOUBLE[])) GROUP BY tid"
    compare(each.selectExpr("tid", "p >= 0.84 AS ok"), duckdb.connect(), sql)


def test_pruning_is_on_the_side_of_a_bound_where_sql_is(spark):
    rows = [("c", f, t, c) for t, confs in ((1, SIX), (2, SIX[::-1]), (3, [0.55] * 5 + [0.56]), (-1, SIX)) for f, c in enumerate(confs)]
    df = spark.createDataFrame(rows, "clip string, frame long, tid long, conf double")
    sql = f"SELECT DISTINCT tid FROM (SELECT tid, avg(conf) OVER (PARTITION BY tid) AS m FROM (VALUES {', '.join(f'({t}, {c}::DOUBLE)' for _, _, t, c in rows)}) r(tid, conf)) WHERE m >= 0.55"
    assert {t for (t,) in duckdb.connect().execute(sql).fetchall()} == {3}
    assert {r.tid for r in prune.prune_tracks(df, 6, 0.55).collect()} == {3, -1}
    assert {r.tid for r in prune.drop_placeholders(df, 6, 0.55).collect()} == {1, 2, 3}
