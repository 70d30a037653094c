"""Registered queries and their DuckDB counterparts.

Every query reads the driver's tables, most of them the boxes derived from ``events``. Doubles are
rounded to six places in both engines. Thresholds are those of the fixture where production's would
leave nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geometry as g
from trackloom.operators import asof, candidates, diff, guard, nearest, nms, ordered, prune, recover, resolve, score, sketch
from trackloom.plans import pipeline, record, report
from trackloom.sources import cache, files, tables
from trackloom.sources.store import new_path
from trackloom.streaming import live, motion

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "summary_per_clip"

#: The derived detections as DuckDB SQL, for use as common table expressions.
DET = """
raw AS (
  SELECT event_id, 'c' || CAST(user_id // 16 AS VARCHAR) AS clip,
    CAST(floor(epoch(ts) / 3600) AS BIGINT) - 473352 AS frame, user_id AS tid,
    100 + (user_id % 16) * 12 + (event_id * 13) % 21 AS cx,
    80 + (user_id % 16) * 6 + (event_id * 17) % 15 AS cy,
    20 + event_id % 30 AS w, 40 + event_id % 50 AS h,
    CAST((300 + (event_id * 7919) % 700) / 1000.0 AS DOUBLE) AS conf
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
det AS (
  SELECT clip, frame, tid, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2, conf
  FROM raw QUALIFY row_number() OVER (PARTITION BY clip, tid, frame ORDER BY conf DESC, event_id) = 1),
frames AS (SELECT clip, CAST(unnest(range(0, (SELECT max(frame) + 1 FROM raw))) AS BIGINT) AS frame FROM (SELECT DISTINCT clip FROM raw))
"""
SEG = """
seg AS (
  SELECT *, sum(br) OVER (PARTITION BY clip, tid ORDER BY frame) AS piece
  FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY clip, tid ORDER BY frame) > 12 THEN 1 ELSE 0 END AS br FROM det)),
sid AS (
  SELECT * FROM (SELECT clip, frame, CAST(tid * 1000000 + piece AS BIGINT) AS tid, x1, y1, x2, y2, conf, count(*) OVER (PARTITION BY clip, tid, piece) AS cnt FROM seg)
  WHERE cnt >= 3)
"""
ENDS = """
tails AS (
  SELECT *, row_number() OVER (PARTITION BY clip, tid ORDER BY frame DESC) AS r, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM sid),
steps AS (
  SELECT clip, tid, (cx - lag(cx) OVER w) / greatest(frame - lag(frame) OVER w, 1) AS sx, (cy - lag(cy) OVER w) / greatest(frame - lag(frame) OVER w, 1) AS sy
  FROM tails WHERE r <= 5 WINDOW w AS (PARTITION BY clip, tid ORDER BY frame)),
speed AS (SELECT clip, tid, coalesce(quantile_cont(sx, 0.5), 0) AS vx, coalesce(quantile_cont(sy, 0.5), 0) AS vy FROM steps GROUP BY clip, tid),
fit AS (
  SELECT clip, tid, count(*) AS k, avg(frame) AS mf, avg(x1) AS m1, avg(y1) AS m2, avg(x2) AS m3, avg(y2) AS m4,
    covar_pop(x1, frame) / nullif(var_pop(frame), 0) AS s1, covar_pop(y1, frame) / nullif(var_pop(frame), 0) AS s2,
    covar_pop(x2, frame) / nullif(var_pop(frame), 0) AS s3, covar_pop(y2, frame) / nullif(var_pop(frame), 0) AS s4
  FROM tails WHERE r <= 3 GROUP BY clip, tid),
ends AS (
  SELECT clip, tid, count(*) AS n, min(frame) AS f0, max(frame) AS f1,
    arg_min(x1, frame) AS hx1, arg_min(y1, frame) AS hy1, arg_min(x2, frame) AS hx2, arg_min(y2, frame) AS hy2,
    arg_max(x1, frame) AS tx1, arg_max(y1, frame) AS ty1, arg_max(x2, frame) AS tx2, arg_max(y2, frame) AS ty2
  FROM sid GROUP BY clip, tid)
"""


def iou_sql(a: list[str], b: list[str]) -> str:
    inner = f"(greatest(least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]}), 0) * greatest(least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}), 0))"
    area = lambda x: f"(greatest({x[2]} - {x[0]}, 0) * greatest({x[3]} - {x[1]}, 0))"
    return f"(CASE WHEN {inner} > 0 THEN {inner} / ({area(a)} + {area(b)} - {inner}) ELSE 0 END)"


def prefixed(p: str) -> list[str]:
    return [f"{p}{c}" for c in g.BOX]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, with_: str = DET, digits: int = 6):
    """Registers a query under its function's name, doubles rounded, and its SQL after the common expressions.

    ``digits`` is raised where values are binary fractions that would lie half-way at six places.
    """

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            ORACLES[f.__name__] = (f"WITH {with_} " if with_ else "") + sql
        return f

    return add


def det(spark: SparkSession, d: str) -> DataFrame:
    return tables.detections(spark, d)


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at least three rows as tracks."""
    s = prune.min_length(ordered.split_on_gap(det(spark, d)), 3, ordered.PIECE)  # before they are renamed, so that rows stay where their track is
    return s.select("clip", "frame", ordered.piece_id().cast("long").alias("tid"), *ordered.VALUES)


BOX4 = "round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2"
ROW = f"clip, frame, tid, {BOX4}, round(conf, 6) AS conf"


# ---- rows and tracks ------------------------------------------------------------------------


@query(f"SELECT {ROW} FROM det")
def dedupe_max_conf(spark, d):
    return det(spark, d)


@query(f"SELECT {ROW} FROM det WHERE x2 - x1 > 25 AND y2 - y1 > 45")
def min_box_filter(spark, d):
    return prune.min_box(det(spark, d), 25, 45)


@query("SELECT clip, tid, count(*) AS n FROM det GROUP BY clip, tid")
def tid_counts(spark, d):
    return det(spark, d).groupBy("clip", "tid").agg(F.count("*").alias("n"))


@query(f"SELECT {ROW} FROM (SELECT *, count(*) OVER w AS n, avg(conf) OVER w AS m FROM det WINDOW w AS (PARTITION BY clip, tid)) WHERE tid < 0 OR (n >= 60 AND m >= 0.64)")
def track_prune_having(spark, d):
    return prune.prune_tracks(det(spark, d), 60, 0.64)


@query(f"SELECT {ROW} FROM det JOIN (SELECT clip, tid FROM det GROUP BY clip, tid HAVING count(*) >= 60 AND avg(conf) >= 0.55 AND quantile_cont(conf, 0.9) >= 0.84) USING (clip, tid)")
def and_gate_p90(spark, d):
    return prune.gate(det(spark, d))


@query(f"SELECT {ROW} FROM (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY conf DESC, tid) AS r FROM (SELECT *, count(*) OVER (PARTITION BY clip, tid) AS n FROM det) WHERE n >= 60 AND conf >= 0.4) WHERE r <= 2")
def prune_detections(spark, d):
    return prune.prune_detections(det(spark, d), 60, 0.4, 2)


@query(f"SELECT {ROW} FROM det WHERE tid > 0 AND frame < 100 AND coalesce(conf, 1) >= 0.5")
def truth_rows(spark, d):
    return prune.first_frames(prune.confident_truth(det(spark, d)).where(prune.valid_id(F.col("tid"))), 100)


@query(f"SELECT {ROW} FROM det WHERE conf < 0.55 AND (x2 - x1) * (y2 - y1) < 2500")
def verifier_candidates(spark, d):
    return prune.verifier_candidates(det(spark, d), 0.55, 2500)


@query(f"SELECT {ROW} FROM det WHERE NOT (conf < 0.55 AND (x2 - x1) * (y2 - y1) < 2500 AND frame % 7 / 7.0 < 0.3)")
def drop_unfilled(spark, d):
    x = det(spark, d)
    judged = prune.verifier_candidates(x, 0.55, 2500).select("clip", "frame", "tid", (F.col("frame") % 7 / 7).alias("share"))
    return prune.drop_unfilled(x, judged)


@query(f"SELECT {ROW} FROM (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY conf DESC, tid) AS r FROM det) WHERE r <= 2")
def topk_per_frame(spark, d):
    return prune.top_per_frame(det(spark, d), 2)


@query(f"SELECT {ROW} FROM det JOIN (SELECT clip, tid FROM det GROUP BY clip, tid QUALIFY row_number() OVER (PARTITION BY clip ORDER BY count(*) DESC, tid) <= 5) USING (clip, tid)")
def topk_tracks(spark, d):
    return prune.top_tracks(det(spark, d), 5)


@query(
    f"""SELECT {ROW} FROM (
  SELECT *, least(coalesce(fi, n), 3, n) AS head FROM (
    SELECT *, min(CASE WHEN conf >= 0.5 THEN i END) OVER w AS fi, max(CASE WHEN conf >= 0.5 THEN i END) OVER w AS la, count(*) OVER w AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY clip, tid ORDER BY frame) - 1 AS i FROM sid) WINDOW w AS (PARTITION BY clip, tid)))
WHERE n - head - least(CASE WHEN la IS NULL THEN n ELSE n - 1 - la END, 3, n - head) >= 3
  AND i >= head AND i < n - least(CASE WHEN la IS NULL THEN n ELSE n - 1 - la END, 3, n - head)""",
    f"{DET}, {SEG}",
)
def edge_trim(spark, d):
    return prune.trim_edges(segments(spark, d), 0.5, 3, 3)


@query(
    """SELECT clip, count(*) AS tracks, sum(n) AS n_rows, round(avg(m), 6) AS mean_conf, round(min(p), 6) AS least_p90
FROM (SELECT clip, tid, count(*) AS n, avg(conf) AS m, quantile_cont(conf, 0.9) AS p FROM sid WHERE x2 - x1 > 10 AND y2 - y1 > 10 GROUP BY clip, tid) WHERE n >= 5 AND m >= 0.55 AND p >= 0.84 GROUP BY clip""",
    f"{DET}, {SEG}",
)
def summary_per_clip(spark, d):
    t = prune.measured(prune.min_box(segments(spark, d))).where("n >= 5 and m >= 0.55 and p >= 0.84")
    return t.groupBy("clip").agg(F.count("*").alias("tracks"), F.sum("n").alias("n_rows"), prune.steady(F.avg("m")).alias("mean_conf"), F.min("p").alias("least_p90"))


@query(
    "SELECT clip, max(n) AS most, count(DISTINCT frame) AS busy, round(avg(n), 6) AS mean_active, max(frame) + 1 AS n_frames FROM (SELECT clip, frame, count(*) AS n FROM det GROUP BY clip, frame) GROUP BY clip"
)
def clip_density_stats(spark, d):
    n = det(spark, d).groupBy("clip", "frame").agg(F.count("*").alias("n"))
    return n.groupBy("clip").agg(F.max("n").alias("most"), F.count("frame").alias("busy"), F.avg("n").alias("mean_active"), (F.max("frame") + 1).alias("n_frames"))


@query("SELECT clip, tid, CAST(list(frame ORDER BY frame) AS VARCHAR) AS frames, count(*) AS n FROM det GROUP BY clip, tid")
def track_arrays(spark, d):
    t = ordered.as_arrays(det(spark, d))
    return t.select("clip", "tid", F.concat(F.lit("["), F.array_join(F.transform("rows.frame", lambda x: x.cast("string")), ", "), F.lit("]")).alias("frames"), F.size("rows").cast("long").alias("n"))


# ---- along frames ---------------------------------------------------------------------------


@query("SELECT clip, tid, frame, piece FROM (SELECT * REPLACE (CAST(piece AS BIGINT) AS piece) FROM seg)", f"{DET}, {SEG}")
def gap_split(spark, d):
    return ordered.split_on_gap(det(spark, d)).select("clip", "tid", "frame", "piece")


@query(
    """SELECT clip, tid, piece, fr AS frame, round(x1 + (nx1 - x1) * t, 6) AS x1, round(y1 + (ny1 - y1) * t, 6) AS y1, round(x2 + (nx2 - x2) * t, 6) AS x2, round(y2 + (ny2 - y2) * t, 6) AS y2, round(conf + (nconf - conf) * t, 6) AS conf, fr = frame AS detected
FROM (SELECT *, CASE WHEN fr = frame THEN 0 ELSE (fr - frame) / (nf - frame) END AS t FROM (SELECT *, unnest(generate_series(frame, coalesce(nf - 1, frame))) AS fr FROM (
  SELECT clip, tid, CAST(piece AS BIGINT) AS piece, frame, x1, y1, x2, y2, conf, lead(frame) OVER w AS nf, coalesce(lead(x1) OVER w, x1) AS nx1, coalesce(lead(y1) OVER w, y1) AS ny1, coalesce(lead(x2) OVER w, x2) AS nx2, coalesce(lead(y2) OVER w, y2) AS ny2, coalesce(lead(conf) OVER w, conf) AS nconf
  FROM seg WINDOW w AS (PARTITION BY clip, tid, piece ORDER BY frame))))""",
    f"{DET}, {SEG}",
)
def gap_fill_linear(spark, d):
    return ordered.fill_gaps(ordered.split_on_gap(det(spark, d)))


@query("SELECT clip, frame, count(tid) AS n FROM frames LEFT JOIN det USING (clip, frame) GROUP BY clip, frame")
def density_zero_filled(spark, d):
    return ordered.density(det(spark, d), tables.frames(spark, d))


RUNNING = "dens AS (SELECT clip, frame, count(tid) AS n FROM frames LEFT JOIN det USING (clip, frame) GROUP BY clip, frame), med AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS med FROM dens)"


@query("SELECT clip, frame, n, round(med, 6) AS med FROM med", f"{DET}, {RUNNING}")
def running_median_density(spark, d):
    return ordered.running_median(ordered.density(det(spark, d), tables.frames(spark, d)))


@query("SELECT clip, frame, n, round(med, 6) AS med FROM med WHERE n <= med - 1 OR frame % 5 = 0", f"{DET}, {RUNNING}")
def suspicious_frames(spark, d):
    return ordered.suspicious_frames(ordered.density(det(spark, d), tables.frames(spark, d)))


@query(
    "SELECT clip, frame AS start, CAST(t AS BIGINT) AS boxes FROM (SELECT clip, frame, sum(n) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING) AS t FROM dens) WHERE frame + 47 <= (SELECT max(frame) FROM raw) QUALIFY row_number() OVER (PARTITION BY clip ORDER BY t DESC, frame) = 1",
    f"{DET}, {RUNNING}",
)
def dense_window(spark, d):
    return ordered.dense_window(ordered.density(det(spark, d), tables.frames(spark, d)), 48)


@query("SELECT clip, tid, n, f0, f1, round(hx1, 6) AS head_x1, round(ty2, 6) AS tail_y2, round(vx, 6) AS vx, round(vy, 6) AS vy FROM ends JOIN speed USING (clip, tid)", f"{DET}, {SEG}, {ENDS}")
def endpoints_velocity(spark, d):
    e = ordered.endpoints(segments(spark, d))
    return e.select("clip", "tid", "n", "f0", "f1", F.col("head.x1").alias("head_x1"), F.col("tail.y2").alias("tail_y2"), "vx", "vy")


@query("SELECT clip, tid, round(coalesce(s1, 0), 6) + 0 AS s_x1, round(coalesce(s4, 0), 6) + 0 AS s_y2, round(m1 + coalesce(s1, 0) * (f1 + 5 - mf), 6) + 0 AS x1_later FROM fit JOIN ends USING (clip, tid)", f"{DET}, {SEG}, {ENDS}")
def tail_fit(spark, d):
    s = segments(spark, d)
    last = s.groupBy("clip", "tid").agg(F.max("frame").alias("f1"))
    return ordered.tail_fit(s).join(last, ["clip", "tid"]).select("clip", "tid", "s_x1", "s_y2", ordered.extrapolated(F.col("f1") + 5).x1.alias("x1_later"))


HEAD_FIT = """
heads AS (SELECT *, row_number() OVER (PARTITION BY clip, tid ORDER BY frame) AS r FROM sid),
head_fit AS (
  SELECT clip, tid, min(frame) AS f0, avg(frame) AS mf, avg(x1) AS m1, avg(y2) AS m4, coalesce(covar_pop(x1, frame) / nullif(var_pop(frame), 0), 0) AS s1, coalesce(covar_pop(y2, frame) / nullif(var_pop(frame), 0), 0) AS s4
  FROM heads WHERE r <= 3 GROUP BY clip, tid)"""


@query("SELECT clip, tid, round(s1, 6) + 0 AS s_x1, round(s4, 6) + 0 AS s_y2, round(m1 + s1 * (f0 - 5 - mf), 6) + 0 AS x1_before FROM head_fit", f"{DET}, {SEG}, {HEAD_FIT}")
def head_fit(spark, d):
    """Tracks drawn on backwards by their first rows."""
    s = segments(spark, d)
    first = s.groupBy("clip", "tid").agg(F.min("frame").alias("f0"))
    return ordered.tail_fit(s, head=True).join(first, ["clip", "tid"]).select("clip", "tid", "s_x1", "s_y2", ordered.extrapolated(F.col("f0") - 5).x1.alias("x1_before"))


@query(
    """SELECT clip, frame, count(tid) AS n, coalesce(string_agg(CAST(tid AS VARCHAR), ' ' ORDER BY tid), '') AS ids, round(sum(x1), 6) AS sum_x1
FROM frames LEFT JOIN (SELECT clip, frame, tid, arg_min(cx - w / 2, event_id) AS x1 FROM raw GROUP BY clip, frame, tid) USING (clip, frame) GROUP BY clip, frame"""
)
def frame_groups(spark, d):
    """Boxes by frame, frames without boxes included; the first event of a repeated box counts."""
    f = ordered.by_frames(tables.raw_detections(spark, d), tables.frames(spark, d), "event_id")
    n = F.size("boxes")
    total = F.when(n > 0, F.aggregate("boxes.x1", F.lit(0.0), lambda a, x: a + x))
    return f.select("clip", "frame", n.cast("long").alias("n"), F.array_join(F.col("boxes.tid").cast("array<string>"), " ").alias("ids"), total.alias("sum_x1"))


@query("SELECT clip, frame, tid, round(x1, 6) AS x1, round(y2, 6) AS y2, round(CASE WHEN tid % 3 = 0 THEN 1 ELSE conf END, 6) AS conf FROM frames LEFT JOIN det USING (clip, frame)")
def tracker_rows(spark, d):
    """A tracker's arrays as columns: confidence 1 where the array has none, a row for empty frames."""
    x = det(spark, d)
    values = [F.col(c) for c in g.BOX] + [F.col("tid").cast("double")]
    found = F.when(F.col("tid") % 3 == 0, F.array(*values)).otherwise(F.array(*values, F.col("conf")))
    out = x.groupBy("clip", "frame").agg(F.collect_list(found).alias("found"))
    return ordered.from_tracker(out, tables.frames(spark, d)).select("clip", "frame", "tid", "x1", "y2", "conf")


def _median_sql(column: str, window: int = 21) -> str:
    """Running median with repeated ends over the lists of a table ``lists`` (v, n, i)."""
    half = f"(least({window}, n) - CASE WHEN least({window}, n) % 2 = 0 THEN 2 ELSE 1 END) // 2"
    return f"list_sort(list_transform(range(i - greatest({half}, 0), i + greatest({half}, 0) + 1), lambda k: {column}[least(greatest(k, 1), n)]))[greatest({half}, 0) + 1]"


LISTS = """
lists AS (
  SELECT clip, tid, n, cv, mw, mh, fs, confs, lx, ly, lw, lh, unnest(range(1, n + 1)) AS i FROM (
    SELECT clip, tid, count(*) AS n, list(frame ORDER BY frame) AS fs, list(conf ORDER BY frame) AS confs, list((x1 + x2) / 2 ORDER BY frame) AS lx, list((y1 + y2) / 2 ORDER BY frame) AS ly,
      list(x2 - x1 ORDER BY frame) AS lw, list(y2 - y1 ORDER BY frame) AS lh, stddev_pop(x2 - x1) / greatest(1, avg(x2 - x1)) + stddev_pop(y2 - y1) / greatest(1, avg(y2 - y1)) AS cv,
      quantile_cont(x2 - x1, 0.5) AS mw, quantile_cont(y2 - y1, 0.5) AS mh
    FROM det GROUP BY clip, tid))"""


@query(
    f"SELECT clip, tid, frame, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2, round(conf, 6) AS conf FROM (SELECT clip, tid, fs[i] AS frame, confs[i] AS conf, {_median_sql('lx')} AS cx, {_median_sql('ly')} AS cy, lw[i] AS w, lh[i] AS h FROM lists)",
    f"{DET}, {LISTS}",
)
def median_smooth(spark, d):
    return ordered.smooth_centres(det(spark, d))


@query(
    f"SELECT clip, tid, frame, round(cx - w / 2, 6) AS x1, round(cy - h / 2, 6) AS y1, round(cx + w / 2, 6) AS x2, round(cy + h / 2, 6) AS y2, round(conf, 6) AS conf FROM (SELECT clip, tid, fs[i] AS frame, confs[i] AS conf, lx[i] AS cx, ly[i] AS cy, CASE WHEN cv <= 0.48 THEN mw ELSE {_median_sql('lw')} END AS w, CASE WHEN cv <= 0.48 THEN mh ELSE {_median_sql('lh')} END AS h FROM lists)",
    f"{DET}, {LISTS}",
)
def cv_gated_size(spark, d):
    return ordered.smooth_sizes(det(spark, d), 0.48)


_MIRROR = "CASE WHEN (i + k - 1 + 24 * n) % (2 * n) < n THEN (i + k - 1 + 24 * n) % (2 * n) + 1 ELSE 2 * n - (i + k - 1 + 24 * n) % (2 * n) END"


def _smooth_sql(side: str) -> str:
    """A side's list after a median of 11 with zeros outside and a Gaussian with mirrored ends; fewer than 11 rows pass."""
    median = f"list_transform(range(1, n + 1), lambda i: list_sort(list_transform(range(i - 5, i + 6), lambda k: CASE WHEN k BETWEEN 1 AND n THEN {side}[k] ELSE 0 END))[6])"
    blurred = f"list_transform([{median}], lambda m: list_transform(range(1, n + 1), lambda i: list_sum(list_transform(range(-12, 13), lambda k: wt[k + 13] * m[{_MIRROR}]))))[1]"
    return f"CASE WHEN n < 11 THEN {side} ELSE {blurred} END AS {side}"


@query(
    f"""SELECT clip, tid, unnest(fs) AS frame, round(unnest(x1), 6) AS x1, round(unnest(y1), 6) AS y1, round(unnest(x2), 6) AS x2, round(unnest(y2), 6) AS y2
FROM (SELECT clip, tid, fs, {', '.join(map(_smooth_sql, g.BOX))} FROM
  (SELECT clip, tid, count(*) AS n, list(frame ORDER BY frame) AS fs, {', '.join(f'list({c} ORDER BY frame) AS {c}' for c in g.BOX)} FROM det GROUP BY clip, tid),
  (SELECT list(e / t ORDER BY j) AS wt FROM (SELECT j, exp(-0.5 * (j / 3.0) ** 2) AS e, sum(exp(-0.5 * (j / 3.0) ** 2)) OVER () AS t FROM range(-12, 13) t(j))))"""
)
def gauss_smooth(spark, d):
    return ordered.smooth_boxes(det(spark, d)).select("clip", "tid", "frame", *g.BOX)


# ---- pairs ----------------------------------------------------------------------------------

_TARGET = [f"(a.m{k} + coalesce(a.s{k}, 0) * (b.f0 - a.mf))" for k in (1, 2, 3, 4)]


@query(
    f"SELECT a.clip AS clip, a.tid AS a, b.tid AS b, b.f0 - a.f1 AS gap, round({iou_sql(_TARGET, prefixed('b.h'))}, 6) AS iou FROM (SELECT * FROM ends JOIN fit USING (clip, tid)) a JOIN ends b ON a.clip = b.clip AND a.tid <> b.tid AND b.f0 - a.f1 BETWEEN 1 AND 48 WHERE {iou_sql(_TARGET, prefixed('b.h'))} >= 0.1",
    f"{DET}, {SEG}, {ENDS}",
)
def merge_candidates(spark, d):
    s = segments(spark, d)
    return candidates.merge_candidates(ordered.endpoints(s), ordered.tail_fit(s)).select(F.col("a_clip").alias("clip"), F.col("a_tid").alias("a"), F.col("b_tid").alias("b"), "gap", "iou")


_LOOK = "list_dot_product(p.e, q.e) / ((sqrt(list_dot_product(p.e, p.e)) + 1e-9) * (sqrt(list_dot_product(q.e, q.e)) + 1e-9))"


@query(
    f"""SELECT m.clip AS clip, a, b, round(iou, 6) AS iou, round(look, 6) AS look, round(iou + 0.5 * look, 6) AS score FROM (
  SELECT c.*, coalesce({_LOOK}, 1) AS look FROM (
    SELECT a.clip AS clip, a.tid AS a, b.tid AS b, {iou_sql(_TARGET, prefixed('b.h'))} AS iou FROM (SELECT * FROM ends JOIN fit USING (clip, tid)) a JOIN ends b ON a.clip = b.clip AND a.tid <> b.tid AND b.f0 - a.f1 BETWEEN 1 AND 48) c
  LEFT JOIN v p ON p.vec_id = a // 1000000 LEFT JOIN v q ON q.vec_id = b // 1000000 WHERE iou >= 0.1) m WHERE round(look, 6) >= 0.1""",
    f"{DET}, {SEG}, {ENDS}, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
)
def appearance_candidates(spark, d):
    """Successors scored by overlap and half the cosine of appearance, which is 1 where one side has none."""
    s = segments(spark, d)
    c = candidates.merge_candidates(ordered.endpoints(s), ordered.tail_fit(s)).select(F.col("a_clip").alias("clip"), F.col("a_tid").alias("a"), F.col("b_tid").alias("b"), "iou")
    v = tables.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    for k in ("a", "b"):
        c = c.join(v.select(F.col("vec_id").alias("_id"), F.col("e").alias(f"e_{k}")), F.floor(F.col(k) / 1_000_000) == F.col("_id"), "left").drop("_id")
    return candidates.with_look(c, F.col("e_a"), F.col("e_b"), 0.1).select("clip", "a", "b", "iou", "look", "score")


_DIST = "sqrt(((a.tx1 + a.tx2) / 2 - (b.hx1 + b.hx2) / 2) ** 2 + ((a.ty1 + a.ty2) / 2 - (b.hy1 + b.hy2) / 2) ** 2)"


@query(
    f"SELECT a.clip AS clip, a.tid AS a, b.tid AS b, b.f0 - a.f1 AS gap, round({_DIST}, 6) AS dist FROM ends a JOIN ends b ON a.clip = b.clip AND a.tid <> b.tid AND b.f0 - a.f1 BETWEEN 49 AND 120 WHERE {_DIST} <= 40",
    f"{DET}, {SEG}, {ENDS}",
)
def long_gap_candidates(spark, d):
    return candidates.long_gap_candidates(ordered.endpoints(segments(spark, d)), max_distance=40).select(F.col("a_clip").alias("clip"), F.col("a_tid").alias("a"), F.col("b_tid").alias("b"), "gap", "dist")


@query(
    """SELECT clip, a, b, gap, round(sqrt((px - hx) ** 2 + (py - hy) ** 2), 6) AS pos_diff, round(wr, 6) AS w_ratio, wr <= 1.4 AND hr <= 1.4 AS size_ok FROM (
  SELECT *, (tx1 + tx2) / 2 + vx * st * sc AS px, (ty1 + ty2) / 2 + vy * st * sc AS py FROM (
    SELECT *, CASE WHEN sqrt((vx * st) ** 2 + (vy * st) ** 2) > 200 THEN 200 / sqrt((vx * st) ** 2 + (vy * st) ** 2) ELSE 1 END AS sc FROM (
      SELECT a.clip AS clip, a.tid AS a, b.tid AS b, b.f0 - a.f1 - 1 AS gap, b.f0 - a.f1 AS st, vx, vy, a.tx1, a.tx2, a.ty1, a.ty2, (b.hx1 + b.hx2) / 2 AS hx, (b.hy1 + b.hy2) / 2 AS hy,
        greatest(a.tx2 - a.tx1, b.hx2 - b.hx1) / greatest(least(a.tx2 - a.tx1, b.hx2 - b.hx1), 1) AS wr, greatest(a.ty2 - a.ty1, b.hy2 - b.hy1) / greatest(least(a.ty2 - a.ty1, b.hy2 - b.hy1), 1) AS hr
      FROM (SELECT * FROM ends JOIN speed USING (clip, tid)) a JOIN ends b ON a.clip = b.clip AND a.tid <> b.tid AND b.f0 - a.f1 - 1 BETWEEN 0 AND 30)))""",
    f"{DET}, {SEG}, {ENDS}",
)
def stitch_candidates(spark, d):
    c = candidates.stitch_candidates(ordered.endpoints(segments(spark, d)), 30, 80, 1.4)
    return c.select(F.col("a_clip").alias("clip"), F.col("a_tid").alias("a"), F.col("b_tid").alias("b"), "gap", "pos_diff", "w_ratio", "size_ok")


@query(
    f"SELECT clip, a, b, count(*) AS common, round(avg(v), 6) AS mean_iou FROM (SELECT a.clip AS clip, a.tid AS a, b.tid AS b, {iou_sql(prefixed('a.'), prefixed('b.'))} AS v FROM det a JOIN det b ON a.clip = b.clip AND a.frame = b.frame AND a.tid < b.tid) GROUP BY clip, a, b HAVING count(*) >= 3 AND avg(v) >= 0.1"
)
def overlap_pairs(spark, d):
    return candidates.overlap_pairs(det(spark, d), 0.1, 3).select("clip", F.col("a_tid").alias("a"), F.col("b_tid").alias("b"), "common", "mean_iou")


@query(
    """SELECT a, arg_min(b, (-cos, b)) AS b, max(cos) AS cos, count(*) AS compared FROM (
  SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + 1e-9) * (sqrt(list_dot_product(b.e, b.e)) + 1e-9)), 6) AS cos
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) GROUP BY a""",
    "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
)
def cosine_pairs(spark, d):
    """A search: every twentieth id is a query against all vectors of its label; the nearest one (cosine to six places, then the least id)."""
    v = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    return nearest.nearest(v, F.col("id") % 20 == 0)


@query(
    "SELECT vec_id, label, round(list_dot_product(e, m) / ((sqrt(list_dot_product(e, e)) + 1e-9) * (sqrt(list_dot_product(m, m)) + 1e-9)), 6) AS cos FROM v JOIN m USING (label)",
    """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(y) AS x FROM (SELECT label, unnest(e) AS y, unnest(range(len(e))) AS i FROM v) GROUP BY label, i) GROUP BY label)""",
)
def cosine_to_mean(spark, d):
    """Every vector against the mean vector of its label; ``cosine_pairs`` is a search for the nearest one."""
    v = tables.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    each = v.select("label", F.posexplode("e").alias("i", "y")).groupBy("label", "i").agg(F.avg("y").alias("x"))
    means = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("m"))
    return v.join(means, "label").select("vec_id", "label", g.cosine(F.col("e"), F.col("m")).alias("cos"))


# ---- identities -----------------------------------------------------------------------------


@query()
def greedy_id_merge(spark, d):
    return resolve.id_mapping(segments(spark, d), long_gap=0, max_distance=float("inf"))


@query()
def long_gap_merge(spark, d):
    return resolve.id_mapping(segments(spark, d))


@query()
def merge_ids(spark, d):
    return resolve.merge_ids(segments(spark, d))


@query()
def overlap_merge(spark, d):
    return resolve.merge_overlapping(det(spark, d), 0.1, 3)


STITCH = """
cand AS (
  SELECT clip, a, b, gap, px, py, round(sqrt((px - hx) ** 2 + (py - hy) ** 2), 6) AS pos_diff, wr, hr, wr <= 1.4 AND hr <= 1.4 AS size_ok, sqrt((px - hx) ** 2 + (py - hy) ** 2) <= 80 AS pos_ok FROM (
    SELECT *, (tx1 + tx2) / 2 + vx * st * sc AS px, (ty1 + ty2) / 2 + vy * st * sc AS py FROM (
      SELECT *, CASE WHEN sqrt((vx * st) ** 2 + (vy * st) ** 2) > 200 THEN 200 / sqrt((vx * st) ** 2 + (vy * st) ** 2) ELSE 1 END AS sc FROM (
        SELECT a.clip AS clip, a.tid AS a, b.tid AS b, b.f0 - a.f1 - 1 AS gap, b.f0 - a.f1 AS st, vx, vy, a.tx1, a.tx2, a.ty1, a.ty2, (b.hx1 + b.hx2) / 2 AS hx, (b.hy1 + b.hy2) / 2 AS hy,
          greatest(a.tx2 - a.tx1, b.hx2 - b.hx1) / greatest(least(a.tx2 - a.tx1, b.hx2 - b.hx1), 1) AS wr, greatest(a.ty2 - a.ty1, b.hy2 - b.hy1) / greatest(least(a.ty2 - a.ty1, b.hy2 - b.hy1), 1) AS hr
        FROM (SELECT * FROM ends JOIN speed USING (clip, tid)) a JOIN ends b ON a.clip = b.clip AND a.tid <> b.tid AND b.f0 - a.f1 - 1 BETWEEN 0 AND 30)))),
best_first AS (SELECT clip, list([{'a': a, 'b': b}] ORDER BY pos_diff, a, b) AS l FROM cand WHERE size_ok AND pos_ok GROUP BY clip),
links AS (
  SELECT clip, l.a AS a, l.b AS b FROM (
    SELECT clip, unnest(list_reduce(l, lambda taken, x: CASE WHEN len(list_filter(taken, lambda k: k.a = x[1].a OR k.b = x[1].b)) > 0 THEN taken ELSE taken || x END)) AS l FROM best_first))
"""


@query(
    """SELECT clip, a, b, gap, round(px, 6) AS px, round(py, 6) AS py, pos_diff, round(wr, 6) AS w_ratio, round(hr, 6) AS h_ratio, size_ok, pos_ok, l.a IS NOT NULL AS stitched,
  CASE WHEN size_ok AND pos_ok AND l.a IS NULL THEN 'conflict' END AS skipped FROM cand LEFT JOIN links l USING (clip, a, b)""",
    f"{DET}, {SEG}, {ENDS}, {STITCH}",
)
def stitch_log(spark, d):
    return resolve.stitch_log(segments(spark, d), 30, 80, 1.4)


@query(
    f"SELECT {ROW} FROM (SELECT s.clip, s.frame, coalesce(new_tid, s.tid) AS tid, s.tid AS was, x1, y1, x2, y2, conf FROM sid s LEFT JOIN named USING (clip, tid)) QUALIFY row_number() OVER (PARTITION BY clip, tid, frame ORDER BY conf DESC, was) = 1",
    f"""RECURSIVE {DET}, {SEG}, {ENDS}, {STITCH},
chain AS (
  SELECT clip, a AS start, a AS tid FROM links l WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.clip = l.clip AND k.b = l.a)
  UNION ALL SELECT c.clip, c.start, l.b FROM chain c JOIN links l ON l.clip = c.clip AND l.a = c.tid),
named AS (SELECT clip, tid, min(tid) OVER (PARTITION BY clip, start) AS new_tid FROM chain)""",
)
def stitch_tracks(spark, d):
    return resolve.stitch(segments(spark, d), max_gap=30, max_jump=80, max_ratio=1.4)


TEST_CONFIG = pipeline.Config(min_total=3, gate_len=5)


@query()
def build_tracks(spark, d):
    return pipeline.build_tracks(det(spark, d), TEST_CONFIG)


@query()
def recovered_tracks(spark, d):
    return pipeline.run(det(spark, d), tables.frames(spark, d), TEST_CONFIG, recovery=True)


@query(
    f"""SELECT clip, frame, tid, {BOX4.replace(', 6)', ', 8)')}, CAST(0.36 AS DOUBLE) AS conf FROM (
  SELECT clip, frame, tid, k, lx, ly, CASE WHEN k >= 2 THEN m1 + s1 * (frame - mf) END AS x1, m2 + s2 * (frame - mf) AS y1, m3 + s3 * (frame - mf) AS x2, m4 + s4 * (frame - mf) AS y2 FROM (
    SELECT p.clip, p.frame, p.tid, count(*) AS k, avg(p.f) AS mf, avg(x1) AS m1, avg(y1) AS m2, avg(x2) AS m3, avg(y2) AS m4, covar_pop(x1, p.f) / nullif(var_pop(p.f), 0) AS s1, covar_pop(y1, p.f) / nullif(var_pop(p.f), 0) AS s2,
      covar_pop(x2, p.f) / nullif(var_pop(p.f), 0) AS s3, covar_pop(y2, p.f) / nullif(var_pop(p.f), 0) AS s4, arg_max((x1 + x2) / 2, p.f) AS lx, arg_max((y1 + y2) / 2, p.f) AS ly
    FROM (SELECT m.clip, m.frame, h.tid, h.frame AS f, h.x1, h.y1, h.x2, h.y2, row_number() OVER (PARTITION BY m.clip, m.frame, h.tid ORDER BY h.frame DESC) AS r
      FROM (SELECT clip, frame FROM med WHERE n <= med - 1) m JOIN (SELECT *, count(*) OVER (PARTITION BY clip, tid) AS cnt FROM det WHERE tid > 0) h ON h.clip = m.clip AND h.frame BETWEEN m.frame - 24 AND m.frame - 1 AND h.cnt >= 8) p
    WHERE r <= 5 GROUP BY p.clip, p.frame, p.tid)) q
WHERE k >= 2 AND round(x2 - x1, 6) > 1 AND round(y2 - y1, 6) > 1 AND sqrt(((x1 + x2) / 2 - lx) ** 2 + ((y1 + y2) / 2 - ly) ** 2) <= 200
  AND NOT EXISTS (SELECT 1 FROM det e WHERE e.clip = q.clip AND e.frame = q.frame AND (e.tid = q.tid OR {iou_sql(prefixed('q.'), prefixed('e.'))} > 0.3))""",
    f"{DET}, {RUNNING}",
    digits=8,
)
def fn_recovery(spark, d):
    return recover.missing(det(spark, d), tables.frames(spark, d), lookback=24)


# ---- suppression ----------------------------------------------------------------------------


def _frame_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a day as one frame, so that frames are crowded."""
    r = tables.raw_detections(spark, d)
    return r.select("clip", F.floor(F.col("frame") / 24).alias("frame"), F.col("event_id").alias("det"), *g.BOX, "conf")


CROWDED = """
crowd AS (SELECT clip, CAST(floor(frame / 24) AS BIGINT) AS frame, event_id AS det, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2, conf FROM raw)"""
_BOX = "'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'conf': conf"
_KEPT = "e.x1 AS x1, e.y1 AS y1, e.x2 AS x2, e.y2 AS y2, round(e.conf, 6) AS conf, CAST(i - 1 AS INTEGER) AS rank"


def _numbered(kept: str) -> str:
    return f"(SELECT clip, frame, unnest(k) AS e, unnest(range(1, len(k) + 1)) AS i FROM {kept})"


def hard_sql(lists: str, threshold: float) -> str:
    """Kept boxes of lists in order of choice: one joins unless a kept one covers it."""
    covered = f"len(list_filter(kept, lambda k: {iou_sql(prefixed('k.'), prefixed('x[1].'))} > {threshold})) > 0"
    return f"(SELECT clip, frame, list_reduce(l, lambda kept, x: CASE WHEN {covered} THEN kept ELSE kept || x END) AS k FROM {lists})"


@query(
    f"SELECT clip, frame, e.det AS det, {_KEPT} FROM {_numbered(hard_sql('lists', 0.6))}",
    f"{DET}, {CROWDED}, lists AS (SELECT clip, frame, list([{{'det': det, {_BOX}}}] ORDER BY conf DESC, det) AS l FROM crowd GROUP BY clip, frame)",
)
def nms_hard(spark, d):
    return nms.suppress(_frame_boxes(spark, d), 0.6)


_OVER = iou_sql(prefixed("e."), prefixed("best."))


@query(
    f"SELECT clip, frame, e.det AS det, {_KEPT} FROM {_numbered('(SELECT clip, frame, st.kept AS k FROM done)')}",
    f"""{DET}, {CROWDED},
lists AS (SELECT clip, frame, list({{'det': det, {_BOX}, 's': conf}} ORDER BY det) AS l FROM crowd GROUP BY clip, frame),
states AS (SELECT clip, frame, {{'rest': l, 'kept': l[1:0]}} AS s, len(l) AS n FROM lists),
done AS (
  SELECT clip, frame, list_reduce(list_transform(range(n + 1), lambda i: s), lambda st, x: CASE WHEN len(st.rest) = 0 THEN st ELSE
    list_transform([list_reduce(st.rest, lambda p, q: CASE WHEN q.s > p.s THEN q ELSE p END)], lambda best: {{
      'rest': list_filter(list_transform(list_filter(st.rest, lambda e: e.det <> best.det),
        lambda e: {{'det': e.det, 'x1': e.x1, 'y1': e.y1, 'x2': e.x2, 'y2': e.y2, 'conf': e.conf, 's': CASE WHEN {_OVER} > 0.3 THEN e.s * exp(-({_OVER} ** 2) / 0.5) ELSE e.s END}}), lambda e: e.s > 0.001),
      'kept': list_append(st.kept, best)}})[1] END) AS st FROM states)""",
)
def nms_soft(spark, d):
    return nms.suppress(_frame_boxes(spark, d), 0.3, "soft")


@query(
    f"SELECT clip, frame, e.scale AS scale, e.det AS det, {_KEPT} FROM {_numbered(hard_sql('lists', 0.6))}",
    f"""{DET}, {CROWDED},
scales AS (SELECT *, 0 AS scale FROM crowd UNION ALL SELECT clip, frame, det, x1 + 1, y1, x2, y2, conf * 0.9, 1 FROM crowd),
lists AS (SELECT clip, frame, list([{{'scale': scale, 'det': det, {_BOX}}}] ORDER BY conf DESC, scale, det) AS l FROM scales GROUP BY clip, frame)""",
)
def nms_two_scales(spark, d):
    b = _frame_boxes(spark, d)
    shrunk = b.select("clip", "frame", "det", (F.col("x1") + 1).alias("x1"), "y1", "x2", "y2", (F.col("conf") * 0.9).alias("conf"))
    return nms.union_of_scales([b, shrunk])


# ---- scores and differences -----------------------------------------------------------------


def _moved(df: DataFrame) -> DataFrame:
    """A second set of boxes: shifted, some missing, some ids exchanged."""
    far = F.when(F.col("frame") % 5 == 0, 30.0).otherwise(2.0)
    return df.where((F.col("frame") + F.col("tid")) % 11 != 0).select("clip", "frame", F.when(F.col("frame") > 400, F.col("tid") + 10_000).otherwise(F.col("tid")).alias("tid"), (F.col("x1") + far).alias("x1"), "y1", (F.col("x2") + far).alias("x2"), "y2", (F.col("conf") * 0.9).alias("conf"))


MOVED = "moved AS (SELECT clip, frame, CASE WHEN frame > 400 THEN tid + 10000 ELSE tid END AS tid, x1 + CASE WHEN frame % 5 = 0 THEN 30 ELSE 2 END AS x1, y1, x2 + CASE WHEN frame % 5 = 0 THEN 30 ELSE 2 END AS x2, y2, conf * 0.9 AS conf FROM det WHERE (frame + tid) % 11 <> 0)"
_ERR = "greatest(abs(a.x1 - b.x1), abs(a.y1 - b.y1), abs(a.x2 - b.x2), abs(a.y2 - b.y2))"


@query()
def mot_metrics(spark, d):
    return score.clip_metrics(_moved(det(spark, d)), det(spark, d))


@query()
def mot_summary(spark, d):
    return score.summary(score.clip_metrics(_moved(det(spark, d)), det(spark, d)))


@query(
    f"SELECT a.clip AS clip, a.frame AS frame, a.tid AS o, b.tid AS p, round({iou_sql(prefixed('a.'), prefixed('b.'))}, 6) AS iou FROM det a JOIN moved b ON a.clip = b.clip AND a.frame = b.frame WHERE {iou_sql(prefixed('a.'), prefixed('b.'))} >= 0.5",
    f"{DET}, {MOVED}",
)
def match_pairs(spark, d):
    return score.frame_pairs(_moved(det(spark, d)), det(spark, d))


@query(ORACLES["match_pairs"], "")
def match_stream(spark, d):
    """The pairs of ``match_pairs`` from two streams of boxes; what finds no partner comes out as well and is left out here."""

    def streamed(df: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        df.write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)

    boxes = det(spark, d)
    both = live.matched_stream(streamed(_moved(boxes), "stream-pred"), streamed(boxes, "stream-truth"))
    return _drained(spark, both, "append").where("o is not null and p is not null")


@query(
    "SELECT d.clip, d.frame, d.tid, r.reading, r.frame AS read_at FROM det d ASOF LEFT JOIN (SELECT clip, frame, count(*) AS reading FROM det GROUP BY clip, frame HAVING count(*) >= 2) r ON d.clip = r.clip AND d.frame >= r.frame"
)
def asof_readings(spark, d):
    """Every box with the last reading of its clip, which only some frames have (how many boxes crowded ones hold)."""
    boxes = det(spark, d)
    reads = boxes.groupBy("clip", "frame").agg(F.count("*").alias("reading")).where("reading >= 2").withColumn("read_at", F.col("frame"))
    return asof.asof_join(boxes.select("clip", "frame", "tid"), reads, ["clip"], "frame", 64)


@query(
    f"SELECT clip, frame, count(a.tid) AS n_a, count(b.tid) AS n_b, round(max({_ERR}), 6) AS box_error, round(max(abs(a.conf - b.conf)), 6) AS conf_error, count(*) FILTER (WHERE a.tid <> b.tid) AS id_mismatches FROM (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY tid) AS pos FROM det) a FULL JOIN (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY tid) AS pos FROM moved) b USING (clip, frame, pos) GROUP BY clip, frame",
    f"{DET}, {MOVED}",
)
def pair_diff(spark, d):
    x = det(spark, d)
    return diff.frame_diff(x, _moved(x))


@query(
    f"SELECT clip, tid, count(*) FILTER (WHERE b.conf IS NULL) AS only_a, count(*) FILTER (WHERE a.conf IS NULL) AS only_b, round(max({_ERR}), 6) AS box_error FROM det a FULL JOIN moved b USING (clip, tid, frame) GROUP BY clip, tid",
    f"{DET}, {MOVED}",
)
def track_diff(spark, d):
    x = det(spark, d)
    return diff.track_diff(x, _moved(x))


@query("(SELECT clip, tid, 'a' AS side FROM (SELECT clip, tid FROM det EXCEPT SELECT clip, tid FROM moved)) UNION ALL (SELECT clip, tid, 'b' AS side FROM (SELECT clip, tid FROM moved EXCEPT SELECT clip, tid FROM det))", f"{DET}, {MOVED}")
def set_diff(spark, d):
    x = det(spark, d)
    return diff.missing_ids(x, _moved(x))


_ONTO = {p: iou_sql(prefixed(f"{p}."), prefixed("e.x.")) for p in ("p", "q")}
_PAIR_ERR = "greatest(abs(m.a.x1 - m.b.x1), abs(m.a.y1 - m.b.y1), abs(m.a.x2 - m.b.x2), abs(m.a.y2 - m.b.y2))"


@query(
    f"""SELECT clip, frame, n_a, n_b, CAST(len(st.pairs) AS BIGINT) AS matched, round(list_max(list_transform(st.pairs, lambda m: {_PAIR_ERR})), 6) AS box_error,
  round(list_max(list_transform(st.pairs, lambda m: abs(m.a.conf - m.b.conf))), 6) AS conf_error, CAST(len(list_filter(st.pairs, lambda m: m.a.tid <> m.b.tid)) AS BIGINT) AS id_mismatches FROM done""",
    f"""{DET}, {MOVED},
both_sides AS (SELECT clip, frame, true AS first, {{'tid': tid, {_BOX}}} AS x, conf, tid FROM det UNION ALL SELECT clip, frame, false, {{'tid': tid, {_BOX}}}, conf, tid FROM moved),
sides AS (SELECT clip, frame, count(*) FILTER (WHERE first) AS n_a, count(*) FILTER (WHERE NOT first) AS n_b, list(x ORDER BY conf DESC, tid) FILTER (WHERE first) AS la, list(x ORDER BY tid) FILTER (WHERE NOT first) AS lb, any_value(x) AS one FROM both_sides GROUP BY clip, frame),
done AS (
  SELECT clip, frame, n_a, n_b, list_reduce([{{'x': one, 'free': coalesce(lb, [one][1:0]), 'pairs': [{{'a': one, 'b': one}}][1:0]}}] || list_transform(coalesce(la, [one][1:0]), lambda x: {{'x': x, 'free': [one][1:0], 'pairs': [{{'a': one, 'b': one}}][1:0]}}),
    lambda st, e: CASE WHEN len(st.free) = 0 THEN st ELSE list_transform([list_reduce(st.free, lambda p, q: CASE WHEN {_ONTO["q"]} > {_ONTO["p"]} THEN q ELSE p END)], lambda p: CASE WHEN {_ONTO["p"]} >= 0.5
      THEN {{'x': st.x, 'free': list_filter(st.free, lambda k: k.tid <> p.tid), 'pairs': list_append(st.pairs, {{'a': e.x, 'b': p}})}} ELSE st END)[1] END) AS st FROM sides)""",
)
def matched_diff(spark, d):
    x = det(spark, d)
    return diff.matched_diff(x, _moved(x))


@query(
    "SELECT clip, tid, count(*) AS frames, round(avg(conf), 6) AS mean_conf FROM (SELECT coalesce(a.clip, b.clip) AS clip, coalesce(a.tid, b.tid) AS tid, CASE WHEN b.conf IS NULL OR a.conf >= b.conf THEN a.conf ELSE b.conf END AS conf FROM (SELECT * FROM det WHERE frame < 500) a FULL JOIN (SELECT * FROM det WHERE frame > 200) b ON a.clip = b.clip AND a.frame = b.frame AND a.tid = b.tid) GROUP BY clip, tid"
)
def outer_merge(spark, d):
    x = det(spark, d)
    a = x.where("frame < 500").select("clip", "frame", "tid", F.col("conf").alias("ca"))
    b = x.where("frame > 200").select("clip", "frame", "tid", F.col("conf").alias("cb"))
    both = a.join(b, ["clip", "frame", "tid"], "full").withColumn("conf", F.when(F.col("cb").isNull() | (F.col("ca") >= F.col("cb")), F.col("ca")).otherwise(F.col("cb")))
    return both.groupBy("clip", "tid").agg(F.count("*").alias("frames"), F.avg("conf").alias("mean_conf"))


@query()
def variant_sweep(spark, d):
    v = {"baseline": TEST_CONFIG, "no_stitch": TEST_CONFIG.having({"use_stitch": "0"}), "strict": TEST_CONFIG.having({"gate_mean": "0.65"})}
    tracks = pipeline.sweep(det(spark, d), v)
    return tracks.groupBy("variant", "clip").agg(F.countDistinct("tid").alias("tracks"), F.count("*").alias("boxes"), F.avg("conf").alias("mean_conf"))


# ---- geometry -------------------------------------------------------------------------------


@query(
    """SELECT clip, frame, tid, round((x1 + x2) / 2, 6) AS cx, round((x2 - x1) * (y2 - y1), 6) AS area, round(640 - x2, 6) AS flip_x1, CAST(greatest(floor(x1 - (x2 - x1) * 0.1), 0) AS BIGINT) AS crop_x1, CAST(least(ceil(x2 + (x2 - x1) * 0.1), 640) AS BIGINT) AS crop_x2,
  round((tid * CAST(0.61803398875 AS DOUBLE)) % 1, 6) AS hue, round(1 + least(greatest((90 - luma) / 30, 0), 1.5), 6) AS gamma, CAST(CASE WHEN luma < 80 THEN 0.29 ELSE 0.34 END AS DOUBLE) AS det_conf, regexp_replace(clip || ' / ' || tid, '[^A-Za-z0-9._-]+', '_', 'g') AS label
FROM (SELECT *, CAST(frame % 120 AS DOUBLE) AS luma FROM det)"""
)
def box_functions(spark, d):
    x = det(spark, d).withColumn("luma", F.col("frame") % 120 + F.lit(0.0))
    b = g.box()
    crop = g.padded_crop(b, 0.1, 640, 480)
    return x.select(
        "clip", "frame", "tid", g.centre(b)[0].alias("cx"), g.area(b).alias("area"), g.flipped(b, 640).x1.alias("flip_x1"), crop.x1.cast("long").alias("crop_x1"), crop.x2.cast("long").alias("crop_x2"),
        g.hue(F.col("tid").cast("double")).alias("hue"), g.auto_gamma(F.col("luma")).alias("gamma"), g.effective_conf(0.34, F.col("luma")).alias("det_conf"), g.file_label(F.concat("clip", F.lit(" / "), "tid")).alias("label"),
    )


@query("SELECT clip, frame, tid, printf('%d,%d,%.6f,%.6f,%.6f,%.6f,%.6f,1,-1', frame + 1, tid, x1 + 1, y1 + 1, x2 - x1, y2 - y1, conf) AS line FROM det")
def mot_rows(spark, d):
    return files.mot_lines(det(spark, d))


_POSES = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
k AS (SELECT vec_id, label, e, list_transform(range(8), lambda i: {'x': e[2 * i + 1], 'y': e[2 * i + 2], 's': abs(e[17 + i])}) AS p FROM v),
rep AS (SELECT label, arg_min(e, vec_id) AS re, arg_min(p, vec_id) AS rp FROM k GROUP BY label),
j AS (SELECT *, list_filter(p, lambda z: z.s >= 0.05) AS seen, list_filter(list_transform(range(1, 9), lambda i: {'a': p[i], 'b': rp[i]}), lambda z: z.a.s >= 0.05 AND z.b.s >= 0.05) AS both_seen FROM k JOIN rep USING (label)),
c AS (SELECT *, list_sum(list_transform(both_seen, lambda z: z.a.x * z.b.x + z.a.y * z.b.y)) AS ab, list_sum(list_transform(both_seen, lambda z: z.a.x ** 2 + z.a.y ** 2)) AS aa, list_sum(list_transform(both_seen, lambda z: z.b.x ** 2 + z.b.y ** 2)) AS bb,
  list_dot_product(e, re) / ((sqrt(list_dot_product(e, e)) + 1e-9) * (sqrt(list_dot_product(re, re)) + 1e-9)) AS look FROM j),
q AS (SELECT *, CASE WHEN len(both_seen) >= 3 AND aa > 1e-18 AND bb > 1e-18 THEN ab / (sqrt(aa) * sqrt(bb)) END AS pose FROM c)"""


@query(
    """SELECT vec_id, CAST(len(seen) AS BIGINT) AS n, round(list_avg(list_transform(seen, lambda z: z.x)), 6) AS cx, round(list_avg(list_transform(seen, lambda z: z.y)), 6) AS cy, round((p[1].x - 0.5) / 1, 6) AS nx, round((p[1].y - 2) / 2, 6) AS ny,
  round(pose, 6) AS pose, round(CASE WHEN pose IS NULL THEN (look + 1) / 2 ELSE ((0.6 * pose + 0.4 * look) / (0.6 + 0.4) + 1) / 2 END, 6) AS alike FROM q""",
    _POSES,
)
def pose_similarity(spark, d):
    """Key points (eight pairs and scores out of each vector) against those of the label's least id: centroid, place in a box, cosine of poses, weighted likeness."""
    v = tables.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    points, scores = F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda i: F.slice("e", i, 2)), F.transform(F.slice("e", 17, 8), F.abs)
    k = v.withColumn("p", points).withColumn("s", scores)
    rep = k.groupBy("label").agg(F.min_by(F.struct("e", "p", "s"), "vec_id").alias("r")).select("label", F.col("r.e").alias("re"), F.col("r.p").alias("rp"), F.col("r.s").alias("rs"))
    c = g.visible_centroid(F.col("p"), F.col("s"), 0.05)
    first = g.normalised_points(F.col("p"), g.Box(*map(F.lit, (-0.5, 0.0, 1.5, 4.0))))[0]
    j = k.join(rep, "label").withColumn("pose", g.pose_cosine(F.col("p"), F.col("s"), F.col("rp"), F.col("rs"), 0.05)).withColumn("look", g.cosine(F.col("e"), F.col("re")))
    alike = g.weighted_similarity([(F.col("pose"), 0.6), (F.col("look"), 0.4)])
    return j.select("vec_id", F.coalesce(c["n"], F.lit(0)).cast("long").alias("n"), c["x"].alias("cx"), c["y"].alias("cy"), first[0].alias("nx"), first[1].alias("ny"), "pose", alike.alias("alike"))


# ---- reports --------------------------------------------------------------------------------

METRICS = """
m AS (
  SELECT o_orderpriority AS clip, o_orderstatus AS tracker, 'idf1' AS metric, avg(o_totalprice) / 1000000 AS value FROM orders GROUP BY 1, 2)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """A metric table out of ``orders``: priorities stand for clips, states for trackers."""
    o = tables.table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("clip"), F.col("o_orderstatus").alias("tracker")).agg((F.avg("o_totalprice") / 1_000_000).alias("value")).withColumn("metric", F.lit("idf1"))


@query("SELECT clip, round(max(CASE WHEN tracker = 'F' THEN value END), 6) AS F, round(max(CASE WHEN tracker = 'O' THEN value END), 6) AS O, round(max(CASE WHEN tracker = 'P' THEN value END), 6) AS P FROM m GROUP BY clip", METRICS)
def pivot_metrics(spark, d):
    return report.pivoted(_metrics(spark, d), "tracker", ["F", "O", "P"], "idf1")


@query("SELECT tracker, round(v, 6) AS v, round(b, 6) AS base, round(v - b, 6) AS delta, printf('%+.4f', (v - b) * 100) AS points FROM (SELECT tracker, avg(value) AS v FROM m GROUP BY tracker), (SELECT avg(value) AS b FROM m WHERE tracker = 'F')", METRICS)
def baseline_delta(spark, d):
    s = _metrics(spark, d).groupBy("tracker").agg(F.avg("value").alias("v"))
    return report.against_baseline(s, "v", "tracker", "F")


@query("SELECT clip, round(ours, 6) AS ours, tracker, round(value, 6) AS value, round(ours - value, 6) AS gap FROM (SELECT clip, max(CASE WHEN tracker = 'P' THEN value END) AS ours, arg_min(tracker, value) FILTER (WHERE tracker <> 'P') AS tracker, min(value) FILTER (WHERE tracker <> 'P') AS value FROM m GROUP BY clip)", METRICS)
def worst_per_clip(spark, d):
    return report.worst(_metrics(spark, d), "P")


@query("SELECT clip, round(gap, 6) AS gap FROM (SELECT clip, max(CASE WHEN tracker = 'P' THEN value END) - min(value) FILTER (WHERE tracker <> 'P') AS gap FROM m GROUP BY clip) WHERE gap * 100 >= 0.3", METRICS)
def interesting_clips(spark, d):
    return report.interesting(_metrics(spark, d), "P", "idf1", 0.3).select("clip", "gap")


@query("SELECT o_orderstatus AS tracker, round(avg(CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END), 6) AS mean, round(coalesce(sum(CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END), 0), 2) AS total, count(CASE WHEN o_custkey % 7 <> 0 THEN 1 END) AS n FROM orders GROUP BY o_orderstatus", "")
def nan_safe_summary(spark, d):
    o = tables.table(spark, d, "orders")
    v = F.when(F.col("o_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double"))
    return report.safe_mean(o.select(F.col("o_orderstatus").alias("tracker"), v.alias("value")), ["tracker"]).withColumn("total", F.round("total", 2))


@query("SELECT l_returnflag AS tracker, count(*) AS n, round(avg(l_quantity), 6) AS mean_ms, round(quantile_cont(l_quantity, 0.5), 6) AS median_ms, round(quantile_cont(l_quantity, 0.95), 6) AS p95_ms, round(sum(l_quantity), 6) AS total_ms, round(count(*) / (sum(l_quantity) / 1000), 6) AS fps FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS l_quantity FROM lineitem) GROUP BY l_returnflag", "")
def latency_stats(spark, d):
    t = tables.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tracker"), F.col("l_quantity").cast("double").alias("ms"))
    return report.latency(t, ["tracker"])


@query("SELECT tracker, round(avg(value), 6) AS mean, row_number() OVER (ORDER BY avg(value) DESC, tracker) AS place FROM m GROUP BY tracker", METRICS)
def tracker_ranking(spark, d):
    return report.ranked(_metrics(spark, d).groupBy("tracker").agg(F.avg("value").alias("mean"))).withColumn("place", F.col("place").cast("long"))


@query("SELECT o_orderstatus AS tracker, short, round(avg(o_totalprice), 4) AS accuracy, count(*) AS n FROM orders JOIN (VALUES ('F', 'first'), ('O', 'open')) t(k, short) ON k = o_orderstatus GROUP BY 1, 2", "")
def label_map_join(spark, d):
    names = F.create_map(F.lit("F"), F.lit("first"), F.lit("O"), F.lit("open"))
    o = tables.table(spark, d, "orders").withColumn("short", names[F.col("o_orderstatus")]).where("short is not null")
    return o.groupBy(F.col("o_orderstatus").alias("tracker"), "short").agg(F.round(F.avg("o_totalprice"), 4).alias("accuracy"), F.count("*").alias("n"))


@query("SELECT * FROM (SELECT clip, tid, count(*) AS n FROM det WHERE frame >= 360 GROUP BY clip, tid) UNION ALL SELECT * FROM (SELECT clip, tid, count(*) AS n FROM det WHERE frame < 360 GROUP BY clip, tid) x WHERE NOT EXISTS (SELECT 1 FROM det y WHERE y.frame >= 360 AND y.clip = x.clip AND y.tid = x.tid)")
def upsert_results(spark, d):
    x = det(spark, d)
    n = lambda part: x.where(part).groupBy("clip", "tid").agg(F.count("*").alias("n"))
    return files.upsert(n("frame < 360"), n("frame >= 360"), ["clip", "tid"])


@query("SELECT clip, round(gap, 6) AS gap FROM (SELECT clip, max(CASE WHEN tracker = 'P' THEN value END) - min(value) FILTER (WHERE tracker <> 'P') AS gap FROM m GROUP BY clip) ORDER BY gap DESC, clip LIMIT 3", METRICS)
def widest_gaps(spark, d):
    return report.widest(report.worst(_metrics(spark, d), "P"), 3).select("clip", "gap")


@query("SELECT a.tracker AS a, b.tracker AS b, count(*) AS clips, count(*) FILTER (WHERE a.value > b.value) AS wins, round(avg(a.value - b.value), 6) AS mean_gap FROM m a JOIN m b ON a.clip = b.clip AND a.tracker <> b.tracker GROUP BY 1, 2", METRICS)
def head_to_head(spark, d):
    return report.head_to_head(_metrics(spark, d))


@query(
    "SELECT tracker, round(accuracy, 6) AS accuracy, round(fps, 6) AS fps FROM (SELECT tracker, avg(value) AS accuracy FROM m GROUP BY tracker) JOIN (SELECT l_linestatus AS tracker, count(*) / (sum(l_quantity) / 1000) AS fps FROM lineitem GROUP BY 1) USING (tracker)",
    METRICS,
)
def speed_and_accuracy(spark, d):
    times = tables.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("tracker"), F.col("l_quantity").cast("double").alias("ms"))
    return report.speed_and_accuracy(_metrics(spark, d), times)


@query(
    """SELECT clip, CASE WHEN r AND t THEN NULL WHEN r THEN 'truth' WHEN t THEN 'results' ELSE 'results truth' END AS missing FROM (
  SELECT clip, clip IN (SELECT clip FROM det WHERE tid % 32 < 16) AS r, clip IN (SELECT clip FROM det WHERE tid % 48 < 32 AND conf >= 0.5) AS t FROM (SELECT DISTINCT clip FROM raw))"""
)
def scoring_inputs(spark, d):
    x = det(spark, d)
    return report.scoring_inputs(x.select("clip").distinct(), x.where("tid % 32 < 16"), x.where("tid % 48 < 32 and conf >= 0.5"))


# ---- streams --------------------------------------------------------------------------------


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    place = new_path(spark, "stream")
    return live.drained(stream, f"{place}/out", f"{place}/state", mode)


@query("SELECT epoch_ms(time_bucket(INTERVAL '6 hours', ts)) // 1000 AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2", "")
def stream_windows(spark, d):
    s = live.window_counts(live.event_stream(spark, d), "6 hours")
    return _drained(spark, s, "complete").select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    """SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM (
  SELECT *, sum(br) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS br FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, s""",
    "",
)
def stream_sessions(spark, d):
    s = live.session_counts(live.event_stream(spark, d), "6 hours")
    return _drained(spark, s, "complete").select("user_id", F.unix_seconds("start").alias("start"), "n")


def _event_boxes(spark: SparkSession, d: str) -> DataFrame:
    e = live.event_stream(spark, d)
    slot = F.col("user_id") % tables.IDS_PER_CLIP
    cx, cy = 100 + slot * 12 + (F.col("event_id") * 13) % 21, 80 + slot * 6 + (F.col("event_id") * 17) % 15
    w, h = 20 + F.col("event_id") % 30, 40 + F.col("event_id") % 50
    frame = (F.floor(F.unix_seconds("ts") / 3600) - 473352).cast("long")
    sides = [v.cast("double").alias(n) for n, v in zip(g.BOX, (cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2), strict=True)]
    clip = F.concat(F.lit("c"), F.floor(F.col("user_id") / tables.IDS_PER_CLIP).cast("string"))
    return e.select(clip.alias("clip"), frame.alias("frame"), *sides, ((300 + (F.col("event_id") * 7919) % 700) / 1000.0).cast("double").alias("conf"))


@query()
def online_tracks(spark, d):
    return _drained(spark, live.online_tracks(_event_boxes(spark, d)), "append")


@query()
def motion_tracks(spark, d):
    with motion.state_store(spark):
        return _drained(spark, motion.motion_tracks(_event_boxes(spark, d).where("clip is not null and frame is not null")), "append")


@query()
def sketch_rollup(spark, d):
    """Ids and confidence of clips and days from sketches of two shares of the boxes, kept apart and merged."""
    boxes = det(spark, d).withColumn("day", F.floor(F.col("frame") / 24))
    keys, late = ["clip", "day"], F.col("frame") % 2 == 1
    kept = sketch.added(sketch.sketches(boxes.where(~late), keys), sketch.sketches(boxes.where(late), keys), keys)
    return sketch.rolled_up(kept, keys).select("clip", "day", "level", "boxes", "ids")


@query("SELECT clip, CASE WHEN clip = 'c1' THEN 0 ELSE count(*) END AS boxes, CAST(clip = 'c1' AS BIGINT) AS failed FROM det WHERE clip = 'c1' OR (x2 - x1 > 10 AND y2 - y1 > 10) GROUP BY clip")
def failed_clip_aside(spark, d):
    """A build that fails on one clip (as if its rows were broken) gives all others and one error row."""
    planted = F.when(F.col("clip") == "c1", F.raise_error(F.lit("planted"))).otherwise(F.col("frame")).cast("long")
    rows, errors = guard.build_or_set_aside(det(spark, d), lambda x: prune.min_box(x).withColumn("frame", planted), "prune")
    ok = rows.groupBy("clip").agg(F.count("*").alias("boxes")).withColumn("failed", F.lit(0).cast("long"))
    return ok.unionByName(errors.select("clip", F.lit(0).cast("long").alias("boxes"), F.lit(1).cast("long").alias("failed")))


@query()
def run_records(spark, d):
    """Tracks and boxes of each clip as the records of a run of the chain have them."""
    root = new_path(spark, "records")
    record.recorded_tracks(det(spark, d), TEST_CONFIG, root)
    return record.records(spark, root).select("stage", "clip", "tracks", "boxes")


# ---- tables that are built once --------------------------------------------------------------


@query(
    """SELECT clip, count(*) AS n, CAST(CAST(substr(clip, 2) AS BIGINT) % 3 = 0 AS BIGINT) AS built_later FROM (
  SELECT *, count(*) OVER (PARTITION BY clip, tid) AS cnt, avg(conf) OVER (PARTITION BY clip, tid) AS mean FROM det) WHERE cnt >= 20 AND mean >= 0.38 GROUP BY clip"""
)
def cache_reuse(spark, d):
    """Two builds over one cache: the second one finds what the first has built and builds every third clip."""
    boxes, root = det(spark, d), new_path(spark, "cache")
    some = boxes.where(F.substring("clip", 2, 9).cast("long") % 3 != 0)
    cache.scan_or_build(some, prune.prune_tracks, "prune 20 0.38", root)
    first = [r.batch for r in cache.manifest(spark, root).select("batch").distinct().collect()]
    out = cache.scan_or_build(boxes, prune.prune_tracks, "prune 20 0.38", root).groupBy("clip").agg(F.count("*").alias("n"))
    later = (~F.col("batch").isin(first)).cast("long").alias("built_later")
    return out.join(cache.manifest(spark, root).select("clip", later), "clip")
