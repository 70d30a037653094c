"""The whole chain from detections to tracks, and many variants of it over the same boxes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import ordered, prune, recover, resolve
from trackloom.sources.store import stored


@dataclass(frozen=True)
class Config:
    """Knobs with their production values."""

    min_box: float = 10
    min_total: int = 20
    min_conf: float = 0.38
    max_gap: int = 12
    merge_gap: int = 48
    merge_iou: float = 0.10
    long_gap: int = 120
    long_distance: float = 150.0
    overlap_iou: float = 0.7
    overlap_frames: int = 5
    trim_conf: float = 0.0
    trim_frames: int = 0
    median_window: int = 11
    sigma: float = 3.0
    most_tracks: int = 25
    gate_len: int = 60
    gate_mean: float = 0.55
    gate_p90: float = 0.84
    stitch_gap: int = 400
    stitch_jump: float = 2000.0
    stitch_ratio: float = 4.0
    size_cv: float = 0.2
    size_window: int = 21
    centre_window: int = 21
    use_gate: bool = True
    use_stitch: bool = True
    use_sizes: bool = True
    use_centres: bool = True

    def having(self, overrides: dict[str, str]) -> Config:
        """With overrides given as text; an unknown name or a value that can't be read is an error."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        unknown = overrides.keys() - kinds.keys()
        if unknown:
            raise KeyError(f"unknown knobs: {sorted(unknown)}")
        read = lambda k, v: str(v).strip().lower() in ("1", "true", "yes", "on") if kinds[k] is bool else kinds[k](float(v))
        return replace(self, **{k: read(k, v) for k, v in overrides.items()})

    @classmethod
    def load(cls, text: str) -> Config:
        return cls().having(json.loads(text))


class Knobs:
    """Knobs of the nodes of a sweep by name: a number where all nodes agree, else a Column that reads the node's number out of ``clip``."""

    def __init__(self, nodes: list[Config]):
        self._nodes = nodes

    def __getattr__(self, name: str):
        values = [getattr(c, name) for c in self._nodes]
        if all(v == values[0] for v in values):
            return values[0]
        return F.get(F.lit(values), F.split_part("clip", F.lit("/"), F.lit(1)).cast("int"))


def switched(df: DataFrame, on: bool | Column, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` for the clips where ``on`` holds; the others pass by."""
    if not isinstance(on, Column):
        return step(df) if on else df
    return step(df.where(on)).unionByName(df.where(~on))


def cleaned(df: DataFrame, cfg: Config | Knobs) -> DataFrame:
    """Size and track prune, split on long gaps; ids are those of pieces. Detected rows only, see ``whole``."""
    d = prune.prune_tracks(prune.min_box(df, cfg.min_box, cfg.min_box), cfg.min_total, cfg.min_conf)
    d = ordered.fill_gaps(ordered.split_on_gap(d, cfg.max_gap))
    d = d.select("clip", "frame", ordered.piece_id().alias("tid"), *ordered.VALUES, "detected")
    return prune.min_length(d, cfg.min_total).where("detected").drop("detected")


def whole(d: DataFrame, group: tuple[str, ...] = ordered.TRACK) -> DataFrame:
    """Tracks with the frames between their detected rows.

    Up to the last step tables and shuffles carry detected rows alone: what lies between is a straight line, so each task
    draws it anew from the rows that it has got, with the same values, and a tenth of the rows is moved.
    """
    return ordered.fill_gaps(d, group).drop("detected")


def shaped(d: DataFrame, k: Config | Knobs, group: tuple[str, ...] = ordered.TRACK) -> DataFrame:
    """Detected rows to whole, trimmed and smoothed tracks, inside the tasks that hold the tracks."""
    return ordered.smooth_boxes(prune.trim_edges(whole(d, group), k.trim_conf, k.trim_frames, k.min_total, group), k.median_window, k.sigma, group)


def _merged(d: DataFrame, k: Config | Knobs) -> DataFrame:
    m = resolve.id_mapping(whole(d), max_gap=k.merge_gap, iou=k.merge_iou, long_gap=k.long_gap, max_distance=k.long_distance)
    d = ordered.fill_gaps(resolve.relabel(d, m), ordered.TRACK)
    return prune.drop_placeholders(d, k.min_total, k.min_conf).where("detected").drop("detected")


def _single(d: DataFrame, k: Config | Knobs) -> DataFrame:
    return stored(switched(d, k.overlap_iou > 0, lambda x: resolve.merge_overlapping(x, k.overlap_iou, k.overlap_frames, thin=True)), "tracks-single")


def _smoothed(d: DataFrame, k: Config | Knobs) -> DataFrame:
    """Nothing yet: smoothing keeps rows, ids and confidences, so choosing goes by the rows before it, and ``shaped`` does it where boxes are read."""
    return d


def _chosen(d: DataFrame, k: Config | Knobs) -> DataFrame:
    x = prune.trim_edges(whole(d), k.trim_conf, k.trim_frames, k.min_total)
    each = prune.measured(x)
    return prune.keep_groups(d, stored(prune.chosen(each, k.most_tracks, k.gate_len, k.gate_mean, k.gate_p90, k.use_gate), "tracks-keep"), ordered.TRACK)


def _stitched(d: DataFrame, k: Config | Knobs) -> DataFrame:
    """Smoothed tracks with the names that stitching gives them."""
    on = k.use_stitch
    if on is False:
        return shaped(d, k)
    links = resolve.stitch_links(shaped(d.where(on) if isinstance(on, Column) else d, k), max_gap=k.stitch_gap, max_jump=k.stitch_jump, max_ratio=k.stitch_ratio)
    m = stored(resolve.stitch_components(links), "stitch-names")
    named = d.join(m, ["clip", "tid"], "left").withColumn("new_tid", F.coalesce("new_tid", "tid"))
    # Dealt out by the new names once, for all that is left to do.
    return resolve.renamed(shaped(named, k, ("clip", "tid", "new_tid")).repartition("clip", "new_tid"))


def _sized(d: DataFrame, k: Config | Knobs) -> DataFrame:
    """Nothing yet: done with the centres, over the same arrays."""
    return d


def _centred(d: DataFrame, k: Config | Knobs) -> DataFrame:
    if k.use_sizes is True and k.use_centres is True:
        return ordered.smooth_tracks(d, k.size_cv, k.size_window, k.centre_window)
    d = switched(d, k.use_sizes, lambda x: ordered.smooth_sizes(x, k.size_cv, k.size_window))
    return switched(d, k.use_centres, lambda x: ordered.smooth_centres(x, k.centre_window))


Step = Callable[[DataFrame, "Config | Knobs"], DataFrame]
#: The chain: knobs that a step is the first to read, what it does, and the name under which its tracks are told of.
CHAIN: list[tuple[tuple[str, ...], Step, str | None]] = [
    (("min_box", "min_total", "min_conf", "max_gap"), cleaned, "tracks-clean"),
    (("merge_gap", "merge_iou", "long_gap", "long_distance"), _merged, "tracks-merged"),
    (("overlap_iou", "overlap_frames"), _single, None),
    (("trim_conf", "trim_frames", "median_window", "sigma"), _smoothed, "tracks-smooth"),
    (("most_tracks", "use_gate", "gate_len", "gate_mean", "gate_p90"), _chosen, "tracks-chosen"),
    (("use_stitch", "stitch_gap", "stitch_jump", "stitch_ratio"), _stitched, "tracks-stitched"),
    (("use_sizes", "size_cv", "size_window"), _sized, None),
    (("use_centres", "centre_window"), _centred, None),
]
#: Tables that are kept because the next step reads them several times, and the tracks that their rows stand for.
KEPT: dict[str, Callable[[DataFrame, "Config | Knobs"], DataFrame]] = {"tracks-clean": lambda d, k: whole(d), "tracks-merged": lambda d, k: whole(d), "tracks-chosen": shaped}


def build_tracks(df: DataFrame, cfg: Config = Config(), seen: Callable[[str, DataFrame, float], None] | None = None) -> DataFrame:
    """(clip, frame, tid, box, conf): clean, merge, smooth, gate, stitch, smooth again.

    ``seen`` is told of the tracks after each step that has a name, and of the result as one more: name, rows, and seconds since the last.
    Smoothed tracks are not kept: their rows come with the chosen ones, and those of stitched tracks with the result, which is kept then and has the same rows.
    """
    d, began, waiting = df, time.monotonic(), []
    for i, (_, step, name) in enumerate(CHAIN):
        d = step(d, cfg)
        if i == len(CHAIN) - 1:
            d, name = d.select("clip", "frame", "tid", *ordered.VALUES), "tracks" if seen else None
            d = stored(d, name) if seen else d
        elif name in KEPT:
            d = stored(d, name)
        if seen and name == "tracks-stitched":
            waiting.append(name)
        elif seen and name:
            for told in (*waiting, name):
                seen(told, KEPT[name](d, cfg) if name in KEPT else shaped(d, cfg) if name == "tracks-smooth" else d, time.monotonic() - began)
            began, waiting = time.monotonic(), []
    return d


def run(df: DataFrame, frames: DataFrame, cfg: Config = Config(), recovery: bool = False) -> DataFrame:
    """Detections to tracks, missing boxes put back first if wanted."""
    return build_tracks(recover.recovered(df, frames) if recovery else df, cfg)


def pending(variants: dict[str, Config], results: DataFrame) -> dict[str, Config]:
    """The variants that ``results`` (variant, ...) lacks, so that a sweep goes on where it stopped."""
    names = results.select("variant").distinct().where(F.col("variant").isin(*variants))  # at most a row for each variant
    done = {r.variant for r in names.collect()}
    return {k: v for k, v in variants.items() if k not in done}


def _levels(configs: list[Config]) -> list[list[Config]]:
    """For each step of the chain the configurations that differ in what has been read up to it: levels of a prefix tree."""
    names: tuple[str, ...] = ()
    out = []
    for knobs, _, _ in CHAIN:
        names += knobs
        first: dict[tuple, Config] = {}
        for c in configs:
            first.setdefault(tuple(getattr(c, n) for n in names), c)
        out.append(list(first.values()))
    return out


def _branched(d: DataFrame, before: list[Config], now: list[Config], names: tuple[str, ...]) -> DataFrame:
    """Rows of each node of a level, given once to each of its children; ``clip`` carries the node's number."""
    same = lambda a, b: all(getattr(a, n) == getattr(b, n) for n in names)
    children = [[i for i, c in enumerate(now) if same(c, p)] for p in before]
    if children == [[i] for i in range(len(before))]:
        return d
    mine = F.get(F.lit(children), F.split_part("clip", F.lit("/"), F.lit(1)).cast("int"))
    name = F.expr("substr(clip, instr(clip, '/') + 1)")
    return d.withColumn("_node", F.explode(mine)).withColumn("clip", F.concat(F.col("_node").cast("string"), F.lit("/"), name)).drop("_node")


def sweep(df: DataFrame, variants: dict[str, Config]) -> DataFrame:
    """Tracks of all variants with a ``variant`` column, in one chain of jobs whatever the number of variants.

    Variants form a prefix tree over the knobs in the order in which the chain reads them, so they share each step up to
    their first difference. A row carries the number of its node in front of its clip, which makes a clip of each node a
    clip of its own for all operators, and knobs are Columns that look their value up by that number.
    """
    if not variants:
        raise ValueError("no variants")
    configs = list(variants.values())
    d, before, names = df.withColumn("clip", F.concat(F.lit("0/"), "clip")), configs[:1], ()
    for (knobs, step, kept), now in zip(CHAIN, _levels(configs), strict=True):
        d = _branched(d, before, now, names)
        d = step(d, Knobs(now))
        d = stored(d, f"sweep-{kept}") if kept in KEPT else d
        before, names = now, names + knobs
    of = [[v for v, c in variants.items() if c == leaf] for leaf in before]
    d = d.withColumn("variant", F.explode(F.get(F.lit(of), F.split_part("clip", F.lit("/"), F.lit(1)).cast("int"))))
    return d.select(F.expr("substr(clip, instr(clip, '/') + 1)").alias("clip"), "frame", "tid", *ordered.VALUES, "variant")
