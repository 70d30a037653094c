"""Operator 1: bytes in strings of 200 bytes that occur more than once in the corpus.

In the manner of prefix-free parsing, a rolling hash picks trigger positions by content alone, so
equal strings are parsed alike wherever they stand. The trigger of a window of 200 bytes is the
place of the least hash of 16 bytes among its first 120; windows with the same trigger, which follow
one another, are one *phrase* of the parse. Where the suffix order of dictionary and parse would put
equal 200-byte prefixes side by side, only their equality matters here, so classes of equal strings
take the place of the order:

1. *core*: the 81 bytes from the trigger on are in every window of the phrase. A phrase whose core
   occurs once has no repeated window. This leaves the repetitive part of the corpus.
2. *whole*: a phrase whose whole string occurs elsewhere has only repeated windows.
3. *blocks* of eight windows of the other phrases, at both ends of repeated passages: what all eight
   share must occur elsewhere.
4. *windows* of the blocks left are compared one by one.

Every step sends a fingerprint for each string to the task of its hash. Fingerprints that repeat
within a batch are settled there and one of them is sent on, so a passage that a third of all
documents share costs each task a row, not one task all of them. Steps 2 and 4, which decide, use
128 bits, of two kinds.

Defined cases: a null text is empty; a text of fewer than 200 bytes loses nothing; rows that repeat
an id (or have none) are told apart by id and text, and equal rows are each other's copies; a text of any
length is one text, read in one piece; a string that repeats in its own text counts as any other; other columns
may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.filters import joined
from trackloom.llm.store import stored
from trackloom.llm.text import chunks, mixed, powers

LENGTH = 200
GRAM = 16
SPREAD = 120
CORE = LENGTH - SPREAD + 1
BLOCK = 8
#: Bytes of text in which repeats are settled before anything is sent.
RUN_BYTES = 2 << 20


#: Primes below 2**31 and bases of the second fingerprint; products stay below 2**62.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_692_667_351)
_residues: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def residue_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime: base**k and its inverse modulo the prime, for k below n at least."""
    if not _residues or len(_residues[0][0][0]) < n:
        size, both = max(n, 1 << 16), []
        for prime, base in zip(PRIMES, BASES, strict=True):
            pair = []
            for x in (base, pow(base, -1, prime)):
                p = np.ones(1, np.uint64)
                while len(p) < size:  # doubles: the next half is the half before times a power
                    p = np.concatenate([p, p * np.uint64(pow(x, len(p), prime)) % np.uint64(prime)])
                pair.append(p[:size])
            both.append((pair[0], pair[1]))
        _residues[0] = both
    return _residues[0]


class Hashes:
    """Fingerprints of all substrings of a byte array.

    The first is a polynomial modulo 2**64. The second is of another kind, polynomials modulo two primes,
    because regular patterns can cancel many bits of the first.
    """

    def __init__(self, data: np.ndarray, second: bool = True):
        n = len(data)
        p, self.q = powers(n + 1)
        table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * p[:n], out=self.sum[1:])
        self.residues = []
        if second:
            table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(34)
            letters = table[data]
            for (power, inverse), prime in zip(residue_powers(n + 1), PRIMES, strict=True):
                total = np.zeros(n + 1, np.uint64)
                np.cumsum(letters * power[:n] % np.uint64(prime), out=total[1:])
                self.residues.append((total, inverse, np.uint64(prime)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sum[end] - self.sum[start]) * self.q[start] + (end - start).astype(np.uint64))

    def other(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        both = [(total[end] - total[start]) % prime * inverse[start] % prime for total, inverse, prime in self.residues]
        return mixed((both[0] << np.uint64(32) | both[1]) + (end - start).astype(np.uint64))


def phrases(h: Hashes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, trigger) of every phrase; places in the byte array."""
    n = int(offsets[-1])
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(n - GRAM + 1, dtype=np.int64)
    least = (h.of(at, at + GRAM) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width = 1
    while width * 2 <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (SPREAD - width)], least[SPREAD - width :])
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)  # windows of each row
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    s = np.arange(len(row)) + first
    if not len(s):
        return (np.zeros(0, np.int64),) * 4
    trigger = (least[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(new)
    end = np.concatenate([begin[1:], [len(s)]]) - 1
    return row[begin], s[begin], s[end], trigger[begin]


def settled(k1: np.ndarray, k2: np.ndarray | None = None) -> np.ndarray:
    """Salt of each fingerprint: 0 where it occurs once here, -1 for one of those that repeat, and any positive number for the others."""
    order = np.lexsort((k1,)) if k2 is None else np.lexsort((k2, k1))
    a = k1[order]
    same = a[1:] == a[:-1]
    if k2 is not None:
        same &= k2[order][1:] == k2[order][:-1]
    before, after = np.concatenate([[False], same]), np.concatenate([same, [False]])
    salt = np.zeros(len(k1), np.int64)
    salt[order] = np.where(before, np.arange(1, len(k1) + 1), np.where(after, -1, 0))
    return salt


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without ``salt`` (as ``settled`` gives it), with ``hit``: whether the keys occur more than once. One shuffle.

    Rows already known to repeat are dealt out by their salt. The others of a key, at most one a
    batch, meet in one task, where neighbours in sorted order are compared as they stream by.
    """
    rest = [c for c in rows.columns if c != "salt"]
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in rest) + ", hit boolean"

    def with_hit(t: pa.Table, hit: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from t.select(rest).append_column("hit", pa.array(hit)).combine_chunks().to_batches()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last row, not yet decided
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held[0], pa.Table.from_batches([b])])
            key = np.stack([t.column(k).to_numpy() for k in keys])
            salt = t.column("salt").to_numpy()
            same = (key[:, 1:] == key[:, :-1]).all(axis=0) & (salt[1:] <= 0) & (salt[:-1] <= 0)
            hit = (salt != 0) | np.concatenate([[False if held is None else held[1]], same])
            hit[:-1] |= same
            held = (t.slice(len(salt) - 1), bool(hit[-1]))
            yield from with_hit(t.slice(0, len(salt) - 1), hit[:-1])
        if held is not None:
            yield from with_hit(held[0], np.array([held[1]]))

    spread = F.when(F.col("salt") > 0, F.col("salt")).otherwise(0)
    dealt = rows.repartition(*[F.col(k) for k in keys], spread).sortWithinPartitions(spread, *keys)
    return dealt.mapInArrow(mark, schema)


def mapped_texts(rows: DataFrame, emit: Callable, schema: str) -> DataFrame:
    """``emit(rows, bytes, offsets)`` for runs of texts; rows are (dk, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in chunks(b.column(1), RUN_BYTES):
                yield from emit(b.slice(first, last - first), data, offsets)

    return rows.mapInArrow(run, schema)


def parsed(texts: DataFrame) -> DataFrame:
    """Step 1 and 2 fingerprints of every phrase: c (core), u1, u2 (whole), salt (of c), dk, lo, n (windows), t (trigger from lo on)."""

    def emit(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        h = Hashes(data)
        row, lo, hi, t = phrases(h, offsets)
        if not len(row):
            return
        c = h.of(t, t + CORE)
        dk = part.column(0).to_numpy(zero_copy_only=False)[row]
        cols = [c.view(np.int64), h.of(lo, hi + LENGTH).view(np.int64), h.other(lo, hi + LENGTH).view(np.int64), settled(c), dk, lo - offsets[row], (hi - lo + 1).astype(np.int32), (t - lo).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["c", "u1", "u2", "salt", "dk", "lo", "n", "t"])

    return mapped_texts(texts.select("dk", "text"), emit, "c long, u1 long, u2 long, salt long, dk long, lo long, n int, t int")


def starts_of(part: pa.RecordBatch, offsets: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Row, and flattened values, of a list column of fixed structs."""
    col = part.column(at)
    return np.repeat(np.arange(len(col)), col.value_lengths().to_numpy(zero_copy_only=False)), col.flatten()


def block_rows(texts: DataFrame, unsure: DataFrame) -> DataFrame:
    """Step 3: a fingerprint of what the windows of each block share; blocks count back from the trigger."""
    lists = unsure.groupBy("dk").agg(F.collect_set(F.struct("lo", "n", "t")).alias("p"))

    def emit(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, p = starts_of(part, offsets, 2)
        lo, n, t = (p.field(i).to_numpy().astype(np.int64) for i in range(3))
        near, far = (t - n + 1) // BLOCK, t // BLOCK  # blocks of the last and the first window
        have = far - near + 1
        of = np.repeat(np.arange(len(row)), have)
        b = near[of] + np.arange(len(of)) - (np.cumsum(have) - have)[of]
        trigger = offsets[row[of]] + lo[of] + t[of]
        start, end = trigger - BLOCK * b, trigger - BLOCK * b - BLOCK + 1 + LENGTH
        own_end = offsets[row[of] + 1]
        ok = end <= own_end  # the string is inside every window of the block, so inside the text
        h = Hashes(data, second=False)
        start, end, of, b = start[ok], end[ok], of[ok], b[ok]
        k = h.of(start, end)
        first = np.maximum(t[of] - BLOCK * b - BLOCK + 1, 0)
        last = np.minimum(t[of] - BLOCK * b, n[of] - 1)
        dk = part.column(0).to_numpy(zero_copy_only=False)[row[of]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.view(np.int64), settled(k), dk, lo[of] + first, (last - first + 1).astype(np.int32))], names=["k", "salt", "dk", "lo", "n"])

    return mapped_texts(joined(texts, lists, "dk").select("dk", "text", "p"), emit, "k long, salt long, dk long, lo long, n int")


def window_rows(texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Step 4: fingerprints of single windows."""
    lists = blocks.groupBy("dk").agg(F.collect_set(F.struct("lo", "n")).alias("p"))

    def emit(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, p = starts_of(part, offsets, 2)
        lo, n = (p.field(i).to_numpy().astype(np.int64) for i in range(2))
        of = np.repeat(np.arange(len(row)), n)
        s = lo[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
        at = offsets[row[of]] + s
        h = Hashes(data)
        k1, k2 = h.of(at, at + LENGTH), h.other(at, at + LENGTH)
        dk = part.column(0).to_numpy(zero_copy_only=False)[row[of]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1.view(np.int64), k2.view(np.int64), settled(k1, k2), dk, s)], names=["k1", "k2", "salt", "dk", "lo"])

    return mapped_texts(joined(texts, lists, "dk").select("dk", "text", "p"), emit, "k1 long, k2 long, salt long, dk long, lo long")


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with ``dk``: the id, or a hash of id and text where ids repeat or are missing."""
    one = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).head()
    unique = one["n"] == one["ids"] and docs.select("doc_id").distinct().count() == one["n"]
    key = F.col("doc_id").cast("long") if unique else F.xxhash64("doc_id", "text")
    return docs.select(F.col("doc_id"), key.alias("dk"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(dk, lo, n): runs of n windows from lo on that all occur elsewhere too."""
    core = stored(repeated(parsed(texts), ["c"]).where("hit").drop("hit"), "repeats-core")
    whole = stored(repeated(with_salt(core, ["u1", "u2"]), ["u1", "u2"]), "repeats-whole")
    sure, unsure = whole.where("hit"), whole.where("not hit")
    # A window of an unsure phrase may also occur in a sure one with the same core; one of each kind speaks for all.
    spokesmen = sure.groupBy("c", "u1", "u2").agg(F.min(F.struct("dk", "lo", "n", "t")).alias("x"))
    spokesmen = spokesmen.join(unsure.select("c").distinct(), "c", "left_semi").select("x.*")
    wanted = stored(unsure.select("dk", "lo", "n", "t").unionByName(spokesmen), "repeats-wanted")
    blocks = stored(repeated(block_rows(texts, wanted), ["k"]).where("hit").select("dk", "lo", "n"), "repeats-blocks")
    single = repeated(window_rows(texts, blocks), ["k1", "k2"]).where("hit").select("dk", "lo", F.lit(1).alias("n"))
    return sure.select("dk", "lo", "n").unionByName(single)


def with_salt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``salt``, settled in batches."""
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", salt long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            salt = settled(*[b.column(k).to_numpy().view(np.uint64) for k in keys])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(salt)], names=[*b.schema.names, "salt"])

    return rows.mapInArrow(run, schema)


def shortened(texts: DataFrame) -> DataFrame:
    """dk, n_removed, n_spans, sha (of the bytes kept) and kept (these bytes) of every text that loses any; texts as ``keyed`` gives them."""
    runs = repeated_windows(texts).groupBy("dk").agg(F.collect_set(F.struct("lo", "n")).alias("p"))
    runs = stored(runs, "repeats-runs")

    def emit(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        row, p = starts_of(part, offsets, 2)
        lo, n = (p.field(i).to_numpy().astype(np.int64) for i in range(2))
        begin = offsets[row] + lo
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + n - 1 + LENGTH, -1)
        gone = np.cumsum(step[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[offsets[1:]] - total[offsets[:-1]]
        starts = gone.copy()
        starts[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(gone)]
        starts[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(starts)])
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(removed), pa.array(spans[offsets[1:]] - spans[offsets[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())], names=["dk", "n_removed", "n_spans", "sha", "kept"])

    return mapped_texts(joined(texts, runs, "dk").select("dk", "text", "p"), emit, "dk long, n_removed long, n_spans long, sha string, kept binary")


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    texts = keyed(docs)
    hit = stored(shortened(texts).drop("kept").dropDuplicates(["dk"]), "repeats-hit")
    plain = texts.select("doc_id", "dk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("plain"))
    out = plain.join(hit, "dk", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("sha", "plain").alias("kept_sha256"))
