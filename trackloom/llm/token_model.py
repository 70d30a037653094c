"""An n-gram model with modified Kneser-Ney smoothing over token ids, made from counts and applied by sharded joins.

Items are the ids of a public tokenizer, so every text has them and the vocabulary is bounded while
the table of pairs grows with the trusted texts. A text begins after a start item and ends with an item of its own.

    p(c | b) = max(n(b, c) - d, 0) / n(b) + back(b) * p(c),
    p(c)     = max(m(c) - d', 0) / m + back' / (vocabulary + 1),

where m(c) is the number of items that c follows and m their sum. The logarithm of a text's
probability is a sum of log p(c) + log back(b), from arrays of the size of the vocabulary, and of what a
known pair has above its back-off, from the table. The distinct pairs of a run of texts are dealt into parts; a
part streams past its slice of the table, and sums by text come back. With much text a slice is sent to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.memory import tidy
from trackloom.llm.store import stored
from trackloom.llm.text import mixed
from trackloom.llm.tokens import encoded, encoder

CHUNK = 1 << 20
#: Rows of the table in a part, which a task holds as arrays (12 bytes a row).
PART_ROWS = 4_000_000
PARTS = 24
#: Distinct pairs that a task adds up before it hands them on.
HELD = 1_000_000
#: Bytes of text for which a slice of the table is sent once; texts beyond meet another copy of it, in another task.
TEXT_BYTES = 2 << 30
#: Texts are scored in so many rounds, each of which reads the input again; shuffle files of one round go before the next.
ROUNDS = 3


def pairs(ids: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history, item) of every place in order, and how many each text has; a text without ids has none. Start is ``size``, the end ``size + 1``."""
    n = counts + (counts > 0)
    ends = np.cumsum(n)[counts > 0]
    item = np.full(int(n.sum()), size + 1, np.int64)
    inner = np.ones(len(item), bool)
    inner[ends - 1] = False
    item[inner] = ids
    history = np.concatenate([[size], item[:-1]])[: len(item)]
    history[ends[:-1]] = size
    return history, item, n


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(fold, b, c, n): how often item c follows b in docs (fold 0 or 1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        width = enc.size + 2
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            key, n = added(*map(np.concatenate, zip(*held, strict=True)))
            b, c = key // width % width, key % width
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ((key // width**2).astype(np.int32), b.astype(np.int32), c.astype(np.int32), n)], names=["fold", "b", "c", "n"])

        for batch in batches:
            folds = batch.column(0).to_numpy().astype(np.int64)
            for first, last, ids, counts in encoded(batch.column(1), enc, CHUNK):
                b, c, n = pairs(ids, counts, enc.size)
                key = (np.repeat(folds[first:last], n) * width + b) * width + c
                held.append(added(key, np.ones(len(key), np.int64)))
                if sum(len(k) for k, _ in held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    parts = docs.select("fold", "text").mapInArrow(tidy(run), "fold int, b int, c int, n long")
    return parts.groupBy("fold", "b", "c").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, count: str) -> dict[int, list[float]]:
    """Modified Kneser-Ney discounts of each fold for counts of 1, 2 and more, from the counts of counts."""
    found = counts.groupBy("fold").agg(*[F.sum((F.col(count) == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()  # two rows at most
    out = {0: [0.5] * 3, 1: [0.5] * 3}
    for r in found:
        y = r.n1 / max(r.n1 + 2 * r.n2, 1)
        n = [0, r.n1, r.n2, r.n3, r.n4]
        out[r.fold] = [max(0.05, min(k - 0.05, k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k)) for k in (1, 2, 3)]
    return out


@dataclass
class Model:
    """Arrays by fold and item of the size of the vocabulary, and the table of pair counts."""

    table: DataFrame
    rows: int
    size: int
    discount: np.ndarray  # [fold, min(n, 3)]
    item: np.ndarray  # log2 p(c)
    back: np.ndarray  # back(b), 1 where b has no followers
    total: np.ndarray  # n(b)

    def above(self, fold: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log2 of p(c | b) above that of its back-off."""
        direct = np.maximum(n - self.discount[fold, np.minimum(n, 3)], 0) / self.total[fold, b]
        return np.log2(1 + direct / (self.back[fold, b] * np.exp2(self.item[fold, c])))


def model(counts: DataFrame, tokenizer: str) -> Model:
    """The model of pair counts. What reaches the driver has a row for each item and fold at most, so it is bounded by the vocabulary."""
    size = encoder(tokenizer).size
    table = stored(counts, "quality-pairs")
    own = discounts(table, "n")
    d = F.lit(0.0)
    for fold, values in own.items():
        for k, v in enumerate(values, 1):
            d = F.when((F.col("fold") == fold) & (F.least("n", F.lit(3)) == k), v).otherwise(d)
    histories = table.groupBy("fold", "b").agg(F.sum("n").alias("total"), F.sum(F.least(d, F.col("n"))).alias("freed")).toPandas()
    followed = table.groupBy("fold", "c").agg(F.count("*").alias("m"))
    lower = discounts(followed, "m")
    followed = followed.toPandas()
    item = np.full((2, size + 2), -np.log2(size + 1))
    back, total = np.ones((2, size + 2)), np.ones((2, size + 2))
    for fold in (0, 1):
        h, f = histories[histories["fold"] == fold], followed[followed["fold"] == fold]
        back[fold, h["b"]], total[fold, h["b"]] = h["freed"] / h["total"], h["total"]
        if len(f):
            m = f["m"].to_numpy()
            off = np.array([0, *lower[fold]])[np.minimum(m, 3)]
            p = np.full(size + 2, np.minimum(off, m).sum() / m.sum() / (size + 1))
            p[f["c"]] += np.maximum(m - off, 0) / m.sum()
            item[fold] = np.log2(p)
    return Model(table, int(len(histories) and table.count()), size, np.array([[0, *own[f]] for f in (0, 1)]), item, back, total)


SENT = "part int, salt int, kind int, keys binary, runs binary, docs binary, k1 binary, k2 binary, s binary, n binary"
_NAMES = [x.split()[0] for x in SENT.split(", ")]


def sent(rows: list[tuple]) -> pa.RecordBatch:
    types = [*[pa.int32()] * 3, *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_NAMES)


def sums(texts: DataFrame, m: Model, tokenizer: str) -> DataFrame:
    """(k1, k2, s, n): of texts (k1, k2, fold, text) the log2 of the probability and the number of items; copies of a key are added up in both."""
    salts = 1 + (texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // (ROUNDS * TEXT_BYTES)
    slices = max(PARTS, -(-m.rows // PART_ROWS))
    parts, width = 2 * slices, m.size + 2
    kind = np.uint32 if width**2 <= 1 << 32 else np.uint64
    table, m = m.table, Model(None, m.rows, m.size, m.discount, m.item, m.back, m.total)

    def slices_of(fold: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return fold * slices + (mixed((b * width + c).astype(np.uint64)) % np.uint64(slices)).astype(np.int64)

    def model_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, b, c, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            part, key, w = slices_of(fold, b, c), (b * width + c).astype(kind), m.above(fold, b, c, n).astype(np.float32)
            order = np.lexsort((key, part))
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, key[x].tobytes(), w[x].tobytes()) for p in range(parts) if len(x := order[ends[p] : ends[p + 1]])]
            for salt in range(salts):
                yield sent([(p, salt, 0, k, v, b"", b"", b"", b"", b"") for p, k, v in rows])

    def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            folds = batch.column(2).to_numpy()
            for first, last, ids, counts in encoded(batch.column(3), enc, CHUNK):
                b, c, n = pairs(ids, counts, enc.size)
                doc, counts = np.repeat(np.arange(last - first), n), n.astype(np.int64)
                fold = folds[first:last][doc].astype(np.int64)
                local = np.bincount(doc, m.item[fold, c] + np.log2(m.back[fold, b]), last - first)
                # Places in the order of part, pair and text; equal pairs are sent once, with the texts they are in.
                order = np.argsort((slices_of(fold, b, c) * width + b) * width + c, kind="stable")
                fold, b, c, doc = fold[order], b[order], c[order], doc[order].astype(np.uint16 if last - first <= 1 << 16 else np.uint32)
                part, key = slices_of(fold, b, c), (b * width + c).astype(kind)
                ends = np.searchsorted(part, np.arange(parts + 1))
                k1, k2 = (batch.column(i).to_numpy()[first:last] for i in (0, 1))
                salt = int(k1[0] % salts)
                k1, k2, rows = k1.tobytes(), k2.tobytes(), []
                for p in range(parts):
                    k, d = key[ends[p] : ends[p + 1]], doc[ends[p] : ends[p + 1]]
                    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
                    if len(k):
                        rows.append((p, salt, 1, k[new].tobytes(), np.diff(np.append(new, len(k))).astype(np.uint32).tobytes(), d.tobytes(), k1, k2, b"", b""))
                del b, c, n, doc, fold, order, part, key
                yield sent([*rows, (0, salt, 1, b"", b"", b"", k1, k2, local.tobytes(), counts.tobytes())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by part, the table's before the texts'."""
        part, slice_rows, known, w = None, [], None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["part"], r["salt"]) != part:
                    part, slice_rows, known = (r["part"], r["salt"]), [], None
                if not r["kind"]:
                    slice_rows.append((np.frombuffer(r["keys"], kind), np.frombuffer(r["runs"], np.float32)))
                    continue
                if known is None:
                    known, w = map(np.concatenate, zip(*slice_rows, strict=True)) if slice_rows else (np.zeros(0, kind), np.zeros(0, np.float32))
                    order = np.argsort(known)
                    known, w, slice_rows = known[order], w[order], []
                k1, k2 = np.frombuffer(r["k1"], np.int64), np.frombuffer(r["k2"], np.int64)
                if r["n"]:
                    s, n = np.frombuffer(r["s"], np.float64), np.frombuffer(r["n"], np.int64)
                else:
                    k, runs = np.frombuffer(r["keys"], kind), np.frombuffer(r["runs"], np.uint32)
                    docs = np.frombuffer(r["docs"], np.uint16 if len(k1) <= 1 << 16 else np.uint32)
                    value = np.zeros(len(k), np.float32)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                        value = np.where(known[at] == k, w[at], 0)
                    s, n = np.bincount(docs, np.repeat(value, runs), len(k1)), np.zeros(len(k1), np.int64)
                some = (s != 0) | (n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (k1, k2, s, n)], names=["k1", "k2", "s", "n"])

    pairs_sent = table.select("fold", "b", "c", "n").mapInArrow(tidy(model_rows), SENT)
    out = None
    for r in range(ROUNDS):
        some = texts.where(F.pmod(F.xxhash64(F.lit(23), "k1", "k2"), F.lit(ROUNDS)) == r).select("k1", "k2", "fold", "text")
        met = pairs_sent.unionByName(some.mapInArrow(tidy(text_rows), SENT)).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind").mapInArrow(tidy(meet), "k1 long, k2 long, s double, n long")
        part = stored(met.groupBy("k1", "k2").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), "quality-sums")
        out = part if out is None else out.unionByName(part)
    return out
