"""Operator 5: token ids with Elias-Fano document boundaries.

The file format is a Parquet data set, so that any store Spark writes to will do and Spark's
commit protocol keeps it whole when executors are lost. A row is a *shard* of consecutive documents:

========== ======================================================================
part_first smallest doc_id of the task that wrote it (order of tasks)
seq        number of the shard within that task
n_docs     documents in it
n_tokens   ids in it
width      bytes of an id, 2 or 4
ids        all ids, little endian, documents one after another
doc_ids    doc_id of each document, little-endian int64
low, high  Elias-Fano code of the documents' ends (see ``ef_encode``)
samples    uint32 position in ``high`` of every 64th one
========== ======================================================================

Offsets inside a shard are relative, so no table of 64-bit offsets is kept; global starts are
prefix sums over shards.

Defined cases: a null or empty text has the end id alone; a null id sorts first and is stored as the least long;
rows that share an id stay separate, in order of their texts, and equal rows follow one another; a text of any length is
encoded whole; no rows give an empty data set; other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.memory import tidy
from trackloom.llm.store import new_path, writing
from trackloom.llm.text import runs_of

SAMPLE = 64
SHARD_TOKENS = 1 << 20
#: Documents of a shard whose ends are selected at once.
READ_DOCS = 4096
#: Bytes of text encoded at once in a task; a longer document is encoded alone.
CHUNK_BYTES = 1 << 20
#: Words kept with their ids in a Python worker (about 200 bytes a word).
REMEMBERED = 150_000
SCHEMA = "part_first long, seq long, n_docs long, n_tokens long, width int, ids binary, doc_ids binary, low binary, high binary, samples binary"


# ---- Elias-Fano ---------------------------------------------------------------------------


def ef_low_bits(n: int, universe: int) -> int:
    return max(0, (universe // n).bit_length() - 1) if n else 0


def ef_encode(values: np.ndarray, universe: int) -> tuple[bytes, bytes, bytes]:
    """Low parts, high parts in unary and select samples of a non-decreasing array below or at ``universe``."""
    n = len(values)
    bits = ef_low_bits(n, universe)
    low = (values[:, None] >> np.arange(bits)) & 1 if n else np.zeros((0, bits))
    ones = (values >> bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return pack(low), pack(high), ones[::SAMPLE].astype("<u4").tobytes()


def ef_values(low: bytes, high: bytes, samples: bytes, n: int, universe: int, first: int, last: int) -> np.ndarray:
    """Values ``first`` up to ``last`` (exclusive), read from the nearest sample before the first one on."""
    if not 0 <= first < last <= n:
        raise IndexError((first, last, n))
    bits = ef_low_bits(n, universe)
    at = np.frombuffer(samples, "<u4")
    begin = first // SAMPLE
    end = -(-last // SAMPLE)
    # Ones of whole runs of SAMPLE values; the last run ends with the code.
    stop = int(at[end]) if end < len(at) else 8 * len(high)
    start = int(at[begin])
    raw = np.frombuffer(high, np.uint8)[start // 8 : -(-stop // 8)]
    ones = np.flatnonzero(np.unpackbits(raw, bitorder="little")[start % 8 :]) + start
    i = np.arange(first, last)
    values = (ones[i - begin * SAMPLE] - i) << bits
    if bits:
        lo, hi = first * bits, last * bits
        parts = np.unpackbits(np.frombuffer(low, np.uint8)[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 :][: hi - lo]
        values = values + parts.reshape(-1, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
    return values.astype(np.int64)


def ef_select(low: bytes, high: bytes, samples: bytes, n: int, universe: int, i: int) -> int:
    """The i-th value."""
    return int(ef_values(low, high, samples, n, universe, i, i + 1)[0])


# ---- encoding -----------------------------------------------------------------------------

_encoders: dict[str, WordEncoder] = {}
#: Letters, then ASCII marks without the apostrophe, which begins endings such as 's.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]{1,40}[!-&(-/:-@\[-`{-~]{0,8}$"


_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of texts by a tokenizer whose pre-tokens never reach over white space.

    Texts are cut at blanks and line ends; the distinct words of a run of texts are looked up once, and
    the ids of all its words are gathered from one array. Words are remembered between runs, and all
    forgotten when there are more than ``REMEMBERED``. A word of plain letters is lower-cased and goes to
    the model alone (its normal form is its lower case, and it is one pre-token that ends at an id with the
    end-of-word mark); the run of marks after it is a pre-token of its own. Every other word goes through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ascii, self.letters = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.size, bool)
        self.marked = bool(mark)
        if mark:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.n, self.used = 1, 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, self.dtype)

    def add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray, remembered: bool = True) -> None:
        """New words, whose ids follow one another."""
        n, used = self.n + len(words), self.used + len(ids)
        while n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : used] = ids
        self.lengths[self.n : n] = lengths
        self.starts[self.n : n] = self.used + np.cumsum(lengths) - lengths
        self.known.update(zip(words, range(self.n, n), strict=True))
        self.n, self.used = n, used

    def whole(self, words: list[str]) -> None:
        """Any words, by the whole tokenizer."""
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            ids = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self.add(part, np.concatenate(ids), np.array([len(x) for x in ids]))

    def plain(self, words: list[str]) -> None:
        """Words of lower-case letters, each one pre-token."""
        for at in range(0, len(words), 64):
            part = words[at : at + 64]
            text = " ".join(part)
            ids = np.array((self.ascii if text.isascii() else self.letters).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            self.add(part, ids, np.diff(np.concatenate([[-1], np.flatnonzero(self.ends[ids])])))

    def numbers(self, words: list[str], encode: Callable[[list[str]], None]) -> np.ndarray:
        """Place of each word in the arrays; new ones are encoded."""
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [words[i] for i in new]
            found[new] = np.arange(self.n, self.n + len(new))
            encode(fresh)
        return found

    def gathered(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[numbers] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; a null is empty."""
        if self.n > REMEMBERED or self.used > 8 * REMEMBERED:
            self.forget()
        column = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        split = pc.split_pattern(column, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, _PLAIN) if self.marked else pa.array(np.zeros(len(words), bool))
        letters, other = words.filter(plain), strings(words.filter(pc.invert(plain)))
        marks = pc.replace_substring_regex(letters, _LETTERS, "").dictionary_encode()
        stems = pc.utf8_lower(pc.utf8_rtrim(letters, _MARKS)).dictionary_encode()
        is_plain = plain.to_numpy(zero_copy_only=False)
        # Each word is two entries: itself, and the marks after it (entry 0 is empty).
        both = np.zeros((len(words), 2), np.int64)
        both[is_plain, 0] = self.numbers(strings(stems.dictionary), self.plain)[stems.indices.to_numpy()]
        both[is_plain, 1] = self.numbers(strings(marks.dictionary), self.whole)[marks.indices.to_numpy()]
        both[~is_plain, 0] = self.numbers(other, self.whole)
        each = both[coded.indices.to_numpy()]
        ids = self.gathered(each.ravel())
        total = np.concatenate([[0], np.cumsum(self.lengths[each].sum(axis=1))])
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        for w in other:
            if len(w) > 40:  # not worth remembering
                del self.known[w]
        return ids, np.diff(total[edges])


def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encoded(column: pa.Array, enc: WordEncoder, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, ids, number of ids of each row) of runs of texts."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    for first, last in runs_of(ends, size):
        yield first, last, *enc.encode(column.slice(first, last - first))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` in ascending ``id_col`` (then text) order to ``path`` in the format above.

    A null text is empty and yields the end id alone; a null id sorts first and is stored as the
    least long. Rows that share an id stay separate. The range shuffle puts no id at a disadvantage:
    rows of one task are read in batches and written in shards of bounded size.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        first, seq, keys, ids, counts, held = None, 0, [], [], [], 0

        def shard():
            nonlocal seq, keys, ids, counts, held
            ends = np.cumsum(np.concatenate(counts))
            low, high, samples = ef_encode(ends, int(ends[-1]))
            row = [first, seq, len(ends), int(ends[-1]), enc.dtype.itemsize, b"".join(ids), b"".join(keys), low, high, samples]
            seq, keys, ids, counts, held = seq + 1, [], [], [], 0
            types = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            key = batch.column(0).fill_null(-(2**63)).to_numpy().astype("<i8")
            if first is None and len(key):
                first = int(key[0])
            for a, b, flat, n in encoded(batch.column(1), enc):
                flat = np.insert(flat, np.cumsum(n), end_id)
                keys.append(key[a:b].tobytes())
                ids.append(flat.astype(enc.dtype, copy=False).tobytes())
                counts.append(n + 1)
                held += len(flat)
                if held >= SHARD_TOKENS:
                    yield shard()
        if held:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    with writing(docs.sparkSession):
        rows.repartitionByRange("k").sortWithinPartitions("k", "t").mapInArrow(tidy(encode), SCHEMA).write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part_first, seq, base): ids in all shards before. The window without a key sees a row for each writing task."""
    tasks = shards.groupBy("part_first").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part_first").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("part_first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("task_base"))
    own = Window.partitionBy("part_first").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = shards.select("part_first", "seq", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("own_base"))
    return inner.join(tasks, "part_first").select("part_first", "seq", (F.col("own_base") + F.col("task_base")).alias("base"))


def read_tokens(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(SCHEMA).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n, code = r["n_docs"], (r["low"], r["high"], r["samples"], r["n_docs"], r["n_tokens"])
                ids, keys = np.frombuffer(r["ids"], f"<u{r['width']}"), np.frombuffer(r["doc_ids"], "<i8")
                for i in range(0, n, READ_DOCS):
                    j = min(n, i + READ_DOCS)
                    ends = ef_values(*code, i, j)
                    starts = np.concatenate([[ef_select(*code, i - 1) if i else 0], ends[:-1]])
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j]), pa.array(starts + r["base"]), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    starts = shard_starts(shards.select("part_first", "seq", "n_tokens"))
    return shards.join(starts, ["part_first", "seq"]).mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write all documents, read the files back."""
    path = path or new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)


def least_null(key: Column) -> Column:
    """The stored form of a null id, back as null."""
    return F.when(key != F.lit(-(2**63)), key)
