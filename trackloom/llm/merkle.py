"""Merkle manifest of a dataset: a tree of SHA-256 digests over the rows of each source, and one over the sources.

Every ``FAN`` consecutive nodes become a parent whose digest is the hash of theirs (hex text) in a row. A parent keeps
copies of its hash state from before each child, so a changed child is folded in by resuming the state before it with
the new digest and the siblings to the right; what lies to the left is never hashed again.

The tree is built in blocks of ``FAN ** LEVELS`` consecutive nodes: a task works out all levels inside a block, and
the blocks' digests are the nodes of the next round, so 2,187 rows become one and three rounds reach ten thousand million
rows. Places in a source come from a range shuffle and a count by task, so a source with most of the rows is spread like any other.

Defined cases: a null field is ``-``; rows of one doc_id are ordered by their leaves, a null doc_id comes first and is never
tampered with; a null source is a source of its own, before the others. Texts of any length are hashed whole. Rows that
repeat are leaves of their own. An empty table gives no rows. Further columns are not part of a leaf, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.memory import tidy
from trackloom.llm.store import stored

FAN = 3
#: Levels of the tree inside a block.
LEVELS = 7
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What lies beside a node's way up, a level each: digests left and right of it in its run.
BESIDE = "array<struct<left: array<string>, right: array<string>>>"


class Parent:
    """A node over a run of children, with the hash state from before each child."""

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for c in children:
            self.states.append(state.copy())
            state.update(c.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, digest: str) -> str:
        """The digest with child ``slot`` replaced: its state resumed, siblings to the right only."""
        state = self.states[slot].copy()
        state.update((digest + "".join(self.children[slot + 1 :])).encode())
        return state.hexdigest()


class Resumed:
    """A parent known by what lies beside one child: the state before that child, and the siblings to the right."""

    def __init__(self, left: list[str], right: list[str]):
        self.state, self.right, self.siblings = hashlib.sha256("".join(left).encode()), "".join(right), "".join(left) + "".join(right)

    def folded(self, digest: str) -> str:
        state = self.state.copy()
        state.update((digest + self.right).encode())
        return state.hexdigest()


def parents(digests: list[str], levels: int) -> list[list[Parent]]:
    """``levels`` levels of parents above a block of nodes."""
    out = []
    for _ in range(levels):
        row = [Parent(digests[i : i + FAN]) for i in range(0, len(digests), FAN)]
        out.append(row)
        digests = [p.digest for p in row]
    return out


def top(digests: list[str], levels: int) -> str:
    above = parents(digests, levels)
    return above[-1][0].digest if above else digests[0]


def beside(above: list[list[Parent]], at: int) -> list[dict[str, list[str]]]:
    """What lies beside the way up from node ``at`` of a block."""
    out = []
    for row in above:
        at, slot = divmod(at, FAN)
        children = row[at].children
        out.append({"left": children[:slot], "right": children[slot + 1 :]})
    return out


def leaf(text: Column | None = None) -> Column:
    """Digest of a row; ``text`` in place of its own."""

    def field(name: str) -> Column:
        value = (text if text is not None and name == "text" else F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def tampered_leaf() -> Column:
    """The leaf after tampering: where 2 divides crc32 of the decimal doc_id, the text has lost its line feeds."""
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(even & F.col("text").contains("\n"), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, the place in its group in order of ``order``, and ``n``, the size of the group.

    Rows are range partitioned, counted off inside tasks and written; a group's places in a task begin after what
    earlier tasks have of it. The window that adds this up sees a row for each task and group, not rows of the table.
    """
    names = rows.columns

    def count_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: Any = count_off
        place = 0
        for batch in batches:
            places = []
            for g in batch.column(names.index(group)).to_pylist():
                place = place + 1 if g == before else 0
                before = g
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*names, "place"])

    sorted_rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", place long"
    kept = stored(sorted_rows.mapInArrow(tidy(count_off), schema).withColumn("task", F.spark_partition_id()), name)
    sizes = kept.groupBy(group, "task").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(group).orderBy("task")
    whole = Window.partitionBy(group)
    starts = sizes.select(F.col(group).alias("_g"), F.col("task").alias("_t"), (F.sum("size").over(earlier) - F.col("size")).alias("start"), F.sum("size").over(whole).alias("n"))
    joined = kept.join(starts, kept[group].eqNullSafe(starts["_g"]) & (kept["task"] == starts["_t"]))
    return joined.select(*names, (F.col("start") + F.col("place")).alias("idx"), "n")


def depth(n: Column) -> Column:
    """Levels above n leaves: the least power of FAN that reaches n."""
    return reduce(lambda out, d: F.when(n > FAN ** (d - 1), d).otherwise(out), range(1, 40), F.lit(0))


def in_blocks(nodes: DataFrame, done: int) -> DataFrame:
    """Blocks of nodes (grp, idx, digest, n, ...) after ``done`` levels: grp, block, n, levels, members (in order)."""
    others = [c for c in nodes.columns if c not in ("grp", "idx", "n")]
    members = F.sort_array(F.collect_list(F.struct("idx", *others))).alias("members")
    levels = F.least(F.lit(LEVELS), depth(F.col("n")) - done).cast("int")
    return nodes.groupBy("grp", F.expr(f"idx div {BLOCK}").alias("block"), "n").agg(members).withColumn("levels", levels)


_RUN = pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])


def block_top(digests: Column, levels: Column) -> Column:
    """Digest above a block of nodes."""

    def tops(digests: pa.Array, levels: pa.Array) -> pa.Array:
        return pa.array([top(d, n) for d, n in zip(digests.to_pylist(), levels.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(tops, "string")(digests, levels)


def block_ways(digests: Column, levels: Column) -> Column:
    """For every node of a block, what lies beside its way up inside the block."""

    def ways(digests: pa.Array, levels: pa.Array) -> pa.Array:
        out = []
        for d, n in zip(digests.to_pylist(), levels.to_pylist(), strict=True):
            above = parents(d, n)
            out.append([beside(above, i) for i in range(len(d))])
        return pa.array(out, pa.list_(pa.list_(_RUN)))

    return F.arrow_udf(ways, f"array<{BESIDE}>")(digests, levels)


class Forest:
    """Trees over groups of leaves (grp, idx, n, digest): ``blocks`` of leaves, ``tops`` and ``ways`` of blocks up to them."""

    def __init__(self, leaves: DataFrame, name: str):
        rounds, nodes, done = [], leaves, 0
        self.tops: DataFrame | None = None
        while True:
            blocks = stored(in_blocks(nodes, done), f"{name}-blocks{done}")
            rounds.append(blocks)
            done += LEVELS
            digests = blocks.select("grp", F.col("block").alias("idx"), "n", block_top(F.col("members.digest"), F.col("levels")).alias("digest"))
            digests = stored(digests, f"{name}-nodes{done}")
            finished = digests.where(depth(F.col("n")) <= done).select("grp", F.col("digest").alias("top"))
            self.tops = finished if self.tops is None else self.tops.unionByName(finished)
            nodes = digests.where(depth(F.col("n")) > done)
            if nodes.isEmpty():
                break
        self.blocks, upper = rounds[0], None
        for blocks in reversed(rounds[1:]):
            upper = self._ways(blocks, upper)
        #: (grp, block, way): what lies beside the way from a block of leaves to its tree's top; None where every tree is one block.
        self.ways = None if upper is None else stored(upper.withColumnRenamed("idx", "block"), f"{name}-ways")

    @staticmethod
    def _ways(blocks: DataFrame, upper: DataFrame | None) -> DataFrame:
        own = blocks.select("grp", "block", F.posexplode(block_ways(F.col("members.digest"), F.col("levels"))).alias("i", "own"))
        own = own.withColumn("idx", F.col("block") * BLOCK + F.col("i"))
        if upper is None:
            return own.select("grp", "idx", F.col("own").alias("way"))
        u = upper.select(F.col("grp").alias("_g"), F.col("idx").alias("_b"), F.col("way").alias("_w"))
        joined = own.join(u, own["grp"].eqNullSafe(u["_g"]) & (own["block"] == u["_b"]), "left")
        return joined.select("grp", "idx", F.concat("own", F.coalesce("_w", F.array().cast(BESIDE))).alias("way"))

    def leaf_blocks(self) -> DataFrame:
        """``blocks`` with the way of each block."""
        none = F.array().cast(BESIDE)
        if self.ways is None:
            return self.blocks.withColumn("way", none)
        w = self.ways.select(F.col("grp").alias("_g"), F.col("block").alias("_b"), F.col("way").alias("_w"))
        joined = self.blocks.join(w, self.blocks["grp"].eqNullSafe(w["_g"]) & (self.blocks["block"] == w["_b"]), "left")
        return joined.select(self.blocks["*"], F.coalesce("_w", none).alias("way"))


REPORT = "doc_id {0}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest_report(docs: DataFrame) -> DataFrame:
    """Every row's leaf, its source's root, the root, the hash of its proof, and the root folded from its tampered leaf."""
    leaves = docs.select(F.col("source").cast("string").alias("grp"), "doc_id", leaf().alias("digest"), tampered_leaf().alias("told"))
    forest = Forest(numbered(leaves, "grp", ["doc_id", "digest"], "leaves"), "sources")
    tops = stored(forest.tops, "subroots")
    roots = numbered(tops.select(F.lit(0).alias("all"), F.col("grp").alias("source"), F.col("top").alias("digest")), "all", ["source"], "roots")
    above = Forest(roots.withColumnRenamed("all", "grp"), "root")
    own = above.leaf_blocks().select("way", F.posexplode(F.arrays_zip("members", block_ways(F.col("members.digest"), F.col("levels")).alias("b"))).alias("i", "m"))
    own = own.select(F.col("m.members.source").alias("_s"), F.col("m.members.digest").alias("subroot"), F.concat("m.b", "way").alias("source_way"))
    own = own.crossJoin(above.tops.select(F.col("top").alias("root")))  # one row
    blocks = forest.leaf_blocks()
    rows = blocks.join(own, blocks["grp"].eqNullSafe(own["_s"])).select("levels", "members", F.concat("way", "source_way").alias("way"), "subroot", "root")
    schema = REPORT.format(docs.schema["doc_id"].dataType.simpleString())
    key = leaves.limit(0).select("doc_id").toArrow().schema.field(0).type

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _proved(r, key)

    return rows.mapInArrow(tidy(prove), schema)


def _proved(block: dict[str, Any], key: pa.DataType) -> pa.RecordBatch:
    """The report's rows of one block."""
    members = block["members"]
    above = parents([m["digest"] for m in members], block["levels"])
    upper = [Resumed(w["left"], w["right"]) for w in block["way"]]
    siblings = "".join(u.siblings for u in upper).encode()
    proofs, folded = [], []
    for i, m in enumerate(members):
        proof, digest, at = hashlib.sha256(), m["told"] or m["digest"], i
        for row in above:
            at, slot = divmod(at, FAN)
            proof.update("".join(c for k, c in enumerate(row[at].children) if k != slot).encode())
            digest = row[at].folded(slot, digest)
        for u in upper:
            digest = u.folded(digest)
        proof.update(siblings)
        proofs.append(proof.hexdigest())
        folded.append(digest)
    n, root = len(members), block["root"]
    columns = [pa.array([m["doc_id"] for m in members], key), *(pa.array(c, pa.string()) for c in ([m["digest"] for m in members], [block["subroot"]] * n, [root] * n, proofs, folded)), pa.array([f == root for f in folded])]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in REPORT.split(", ")])
