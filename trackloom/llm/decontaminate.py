"""Operator 6: benchmark passages found by a distributed positional inverted index.

1. Test items are cut into windows of 13 words.
2. Corpus frequencies of all test terms are counted (each task adds up before the shuffle).
3. Every window is looked up by its two rarest terms. The index holds the postings (term, document,
   position, neighbouring words) of these terms; common terms never need a list of their own.
4. Position minus the term's offset tells where a window would start. The list of the second rarest term,
   adjusted by its own offset, is intersected with that of the rarest; what both have is compared with
   the other words of the window, in the neighbourhood that the posting holds.

The texts are read twice, for frequencies and for the index, which also keeps the number of words of each
document. Only DataFrame functions are used. A Bloom filter of fixed size keeps the words of texts
that no test term can be from the joins, and neighbourhoods are cut before a join shuffles anything, so the
plan is alike for test sets of any size; what is broadcast of the test set is counted in bytes first. A frequent term has long lists but they are never grouped: they meet
in joins, whose skewed keys Spark splits.

Defined cases: a null text has no words; a text of any length is read whole; an item of fewer than 13
words, but not none, is one window; an item without id counts for hits but is not listed; rows with equal id
and text get equal results; documents that share an id stay apart; an empty test set hits nothing;
documents at exactly the share are contaminated; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.filters import flagged, without
from trackloom.llm.store import stored

WINDOW = 13
#: A table made of the test set is broadcast up to so many bytes, as counted; beyond, Spark chooses.
BROADCAST_BYTES = 64 << 20
UPPER = "".join(map(chr, range(65, 91)))
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; a null text has none."""
    plain = F.translate(text, UPPER + SEPARATORS, UPPER.lower() + " " * len(SEPARATORS))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, words), and (wid, item_id) for the items that hold them. Items never travel with a window: many may share one."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - n + 1, F.lit(1)))
    w = stored(w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, n))).alias("words")).distinct(), "decon-held")
    win = stored(w.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "decon-windows")
    return win, w.where("item_id is not null").join(win, "words").select("wid", "item_id")


def small(df: DataFrame) -> DataFrame:
    """A stored table of the test set, marked for broadcast where its rows have at most ``BROADCAST_BYTES`` (64 beside their strings each, 32 a string)."""
    parts = {"string": F.octet_length, "array<string>": lambda c: F.octet_length(F.array_join(c, "")) + 32 * F.size(c)}
    size = sum((F.coalesce(parts[f.dataType.simpleString()](f.name), F.lit(0)) + 32 for f in df.schema if f.dataType.simpleString() in parts), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).head()[0] or 0) <= BROADCAST_BYTES else df


def row_key() -> Column:
    """Identity of a row: its id and a hash of id and text, so that rows of different ids never share it."""
    return F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.xxhash64("doc_id", "text").alias("h"))


def document_words(docs: DataFrame) -> DataFrame:
    """doc_id, dk (identity of a row) and its words."""
    return docs.select("doc_id", row_key().alias("dk"), words(F.col("text")).alias("ws"))


def anchored(docs: DataFrame, win: DataFrame) -> DataFrame:
    """Windows with their two rarest terms (term, at; term2, at2; offsets from 0); those with a term that the corpus lacks can't occur and go."""
    vocabulary = stored(win.select(F.explode("words").alias("term")).distinct(), "decon-terms")
    text = flagged(document_words(docs).select(F.explode("ws").alias("term")), "term", vocabulary).where("_maybe")
    counts = stored(text.groupBy("term").agg(F.count("*").alias("freq")).join(vocabulary, "term"), "decon-counts")
    at = win.select("wid", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    rank = F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "term", "at")
    ranked = at.groupBy("wid").agg(F.slice(F.array_sort(F.collect_list(rank)), 1, 2).alias("r")).where(F.col("r")[0]["freq"] > 0)
    second = F.try_element_at("r", F.lit(2))
    ends = ranked.select("wid", F.col("r")[0]["term"].alias("term"), F.col("r")[0]["at"].alias("at"), F.coalesce(second["term"], F.col("r")[0]["term"]).alias("term2"), F.coalesce(second["at"], F.col("r")[0]["at"]).alias("at2"))
    return stored(win.join(ends, "wid"), "decon-anchored")


def indexed(docs: DataFrame, win: DataFrame, reach: int) -> DataFrame:
    """(doc_id, dk, term, pos, here, near): postings of the windows' terms; near are the words up to ``reach`` away, here the place of ``pos`` in them from 0.

    A row without term for each document tells its number of words by ``pos``.
    """
    terms = stored(win.select(F.explode(F.array("term", "term2")).alias("term")).distinct(), "decon-anchors")
    low = F.greatest(F.col("pos") - reach, F.lit(0))
    rows = document_words(docs).select("doc_id", "dk", "ws", F.posexplode(F.array_append("ws", F.lit(None).cast("string"))).alias("pos", "term"))
    rows = flagged(rows, "term", terms).where("_maybe or term is null")
    near = F.when(F.col("term").isNotNull(), F.slice("ws", low + 1, F.col("pos") - low + reach + 1))
    rows = rows.select("doc_id", "dk", "term", "pos", (F.col("pos") - low).alias("here"), near.alias("near"))
    marked = rows.join(small(terms.withColumn("_known", F.lit(True))), "term", "left")
    return marked.where("_known or term is null").drop("_known")


def postings(index: DataFrame, win: DataFrame) -> DataFrame:
    """Postings of the rarest terms with the windows they may belong to."""
    return index.where("term is not null").join(small(win), "term")


def exact_matches(index: DataFrame, win: DataFrame) -> DataFrame:
    """(dk, start, n, wid) of every occurrence of every window."""
    first = F.col("here") - F.col("at")
    m = postings(index.drop("doc_id"), win).where((first >= 0) & (first + F.size("words") <= F.size("near")))
    second = index.where("term is not null").select("dk", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    m = m.withColumn("pos2", F.col("pos") - F.col("at") + F.col("at2")).join(second, ["dk", "term2", "pos2"], "left_semi")
    from_one = F.greatest(first, F.lit(0)) + 1  # conditions may be evaluated in any order
    m = m.where(F.slice("near", from_one, F.size("words")) == F.col("words"))
    return m.select("dk", (F.col("pos") - F.col("at")).alias("start"), F.size("words").alias("n"), "wid")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, n: int = WINDOW) -> DataFrame:
    """(doc_id, dk, pos, wid, words): places of a window's rarest term with all its other terms at most n - 1 + slop words away, in any order."""
    win = anchored(docs, windows(items, n)[0])
    m = postings(indexed(docs, win, n - 1 + slop), win)
    return m.where(F.size(F.array_except("words", "near")) == 0).select("doc_id", "dk", "pos", "wid", "words")


def proximity(docs: DataFrame, items: DataFrame, slop: int = 5, n: int = WINDOW) -> DataFrame:
    """(doc_id, n_near, n_windows) of the documents with ``proximity_matches``: places, and distinct windows near them. Shuffled passages show here."""
    m = proximity_matches(docs, items, slop, n)
    return m.groupBy("doc_id", "dk").agg(F.countDistinct("pos").alias("n_near"), F.countDistinct("wid").alias("n_windows")).drop("dk")


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: int = 20) -> DataFrame:
    """A row for each document: n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    distinct, owners = windows(items, n)
    win = anchored(docs, distinct)
    index = stored(indexed(docs, win, n - 1), "decon-index")
    m = stored(exact_matches(index, win).distinct(), "decon-matches")
    places = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    found = m.groupBy("dk").agg(F.size(places).cast("long").alias("hit"))
    # Items come last: one row for each document and item, whatever number of windows they share.
    held = m.select("dk", "wid").distinct().join(owners, "wid").select("dk", "item_id").distinct()
    named = held.groupBy("dk").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
    every = index.where("term is null").select("doc_id", "dk", F.col("pos").cast("long").alias("n_words"))
    out = every.join(found, "dk", "left").join(named, "dk", "left")
    hit = F.coalesce("hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"), "dk",
    )


def decontaminated(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, columns unchanged."""
    bad = stored(contamination(docs, items, n, share).where("contaminated").select(F.col("dk").alias("_dk")).distinct(), "decon-bad")
    return without(docs, row_key(), bad)
