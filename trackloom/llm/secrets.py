"""Operator 8: secrets in texts, by patterns and by two character Markov models.

Base spans come from three patterns. The method adds long tokens whose characters look more like a
random string than like an ordinary identifier: first-order Markov models of both are counted from
labelled samples (values of base matches; identifiers that a bounded sample of documents has outside them), and
a token is added when its log-likelihood ratio a character is above ``threshold``, whatever characters it is of.
Tokens of fewer than 20 characters are not scored: the ratio of so few pairs does not tell them apart.

Only DataFrame functions are used: places of matches come from the lengths of the pieces between
them, summed up in n log n steps for n matches. Each distinct token is scored once, however many documents repeat it. Whole texts are read
once; what is kept of a document is its few matches.

Defined cases: a null or empty text has no spans; a text of any length is read whole; equal rows get equal spans;
rows that share an id stay apart; without any base match in the corpus there is nothing to learn from and
the method adds none; a token right at the threshold is not added; other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.store import stored

# The patterns of the base kinds.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Identifiers of the sample: shorter words tell little, longer ones are the candidates themselves.
IDENTIFIER = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,19}(?![A-Za-z0-9+/_-])"
#: About so many documents, taken by a hash of id and text, give the sample of ordinary identifiers.
SAMPLE_DOCS = 2_000
CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
PRIOR = 8.0
THRESHOLD = 0.4


def running_sum(values: Column) -> Column:
    """Sums of all values up to each place of an array of ints: every turn adds what stands 1, 2, 4, .. places before, so n values take n log n steps."""
    n = F.size(values)
    turns = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int") - 1)
    shifts = F.when(n > 1, F.transform(turns, lambda k: F.pow(F.lit(2.0), k).cast("int"))).otherwise(F.array().cast("array<int>"))
    before = lambda acc, by: F.concat(F.array_repeat(F.lit(0), by), F.slice(acc, F.lit(1), F.size(acc) - by))
    return F.aggregate(shifts, values, lambda acc, by: F.zip_with(acc, before(acc, by), lambda x, y: x + y))


SPANS = "array<struct<s:int,e:int,v:string>>"


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with a column array<struct<s,e,v>> for each name: start, end (code points, end exclusive) and text of all matches of its pattern, leftmost first.

    The second of a pattern is a cheap test that a text can hold a match. The pieces between matches tell their places.
    What is used twice is a column of its own, so that texts are searched once for matches and once for pieces.
    """
    t = F.col(text)
    held = {k: may & t.rlike(p) for k, (p, may) in patterns.items()}
    df = df.withColumns({f"_{k}_v": F.when(held[k], F.regexp_extract_all(t, F.lit(p), F.lit(0))) for k, (p, _) in patterns.items()})
    df = df.withColumns({f"_{k}_g": F.when(F.col(f"_{k}_v").isNotNull(), F.transform(F.split(t, p, -1), F.length)) for k, (p, _) in patterns.items()})
    df = df.withColumns({f"_{k}_n": F.zip_with(F.slice(f"_{k}_g", F.lit(1), F.size(f"_{k}_v")), f"_{k}_v", lambda g, v: g + F.length(v)) for k in patterns})
    df = df.withColumns({f"_{k}_e": running_sum(F.col(f"_{k}_n")) for k in patterns})
    spans = {k: F.zip_with(f"_{k}_e", f"_{k}_v", lambda e, v: F.struct((e - F.length(v)).alias("s"), e.alias("e"), v.alias("v"))) for k in patterns}
    df = df.withColumns({k: F.coalesce(v, F.array().cast(SPANS)) for k, v in spans.items()})
    return df.drop(*[f"_{k}_{x}" for k in patterns for x in "vgne"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, u (a number for each row) and the matches of every kind and of candidate tokens, read once from the whole texts."""
    t = F.col("_t")
    value = lambda m: F.regexp_extract(m["v"], ASSIGN, 1)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    patterns = {"assign": (ASSIGN, t.contains(":") | t.contains("=")), "access": (ACCESS, t.contains("AKIA")), "hex": (HEX, F.lit(True)), "token": (TOKEN, F.lit(True))}
    rows = with_matches(rows, "_t", patterns).drop("_t")
    rows = rows.withColumns({"assign": F.filter("assign", lambda m: F.length(value(m)) >= 6), "access": F.filter("access", lambda m: F.length(m["v"]) >= 20)})
    return rows.withColumn("u", F.monotonically_increasing_id())


def free_tokens(rows: DataFrame) -> DataFrame:
    """(u, m): candidate tokens that have no place in common with a base span. Spans of a row pass by in order, once from either end."""
    places = lambda c, k: F.transform(c, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), (m["v"] if k == 4 else F.lit(None).cast("string")).alias("v")))
    some = rows.where(F.size("token") > 0).withColumn("_base", F.size("assign") + F.size("access") + F.size("hex"))
    alone = some.where("_base = 0").select("u", F.explode("token").alias("m"))
    all_ = F.concat(*[places(c, k) for c, k in (("assign", 1), ("access", 2), ("hex", 3), ("token", 4))])
    each = some.where("_base > 0").select("u", F.explode(all_).alias("m")).select("u", "m.*")
    base = F.col("k") < 4
    before = F.max(F.when(base, F.col("e"))).over(Window.partitionBy("u").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, 0))
    behind = F.min(F.when(base, F.col("s"))).over(Window.partitionBy("u").orderBy(F.col("s").desc(), F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumns({"_before": before, "_behind": behind}).where(~base)
    free = each.where((F.coalesce("_before", F.lit(0)) <= F.col("s")) & (F.coalesce("_behind", F.lit((1 << 31) - 1)) >= F.col("e")))
    return alone.unionByName(free.select("u", F.struct("s", "e", "v").alias("m")))


def bigrams(token: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.struct(token.substr(i, F.lit(1)).alias("a"), token.substr(i + 1, F.lit(1)).alias("b")))


def markov_ratio(random: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(a, b, llr) of all 66 x 66 pairs, from two samples with a string column ``v``.

    p(b | a) of either model is its count smoothed by ``PRIOR`` draws from how often b occurs at all,
    so characters that ordinary identifiers never have speak for a random string.
    """
    letters = F.explode(F.array(*map(F.lit, CHARACTERS)))
    pairs = random.sparkSession.range(1).select(letters.alias("a")).select("a", letters.alias("b"))
    for df, n in ((random, "r"), (ordinary, "o")):
        c = df.where(F.length("v") >= 2).select(F.explode(bigrams(F.col("v"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias(n))
        pairs = pairs.join(c, ["a", "b"], "left").na.fill(0, [n])
    first, second = Window.partitionBy("a"), Window.partitionBy("b")
    every = Window.partitionBy()

    def p(n: str) -> Column:
        at_all = (F.sum(n).over(second) + 0.5) / (F.sum(n).over(every) + 0.5 * len(CHARACTERS))
        return (F.col(n) + PRIOR * at_all) / (F.sum(n).over(first) + PRIOR)

    return pairs.select("a", "b", F.log(p("r") / p("o")).alias("llr"))


def spans_by_model(rows: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(u, markov): the candidate tokens that the models call random and that touch no base span."""
    free = free_tokens(rows)
    known = rows.select(F.explode(F.concat(F.transform("assign", lambda m: F.regexp_extract(m["v"], ASSIGN, 1)), F.transform("access", lambda m: m["v"]), F.transform("hex", lambda m: m["v"]))).alias("v")).distinct()
    if not known.head(1):
        return rows.select("u", F.array().cast(SPANS).alias("markov")).limit(0)
    share = min(1.0, SAMPLE_DOCS / max(rows.count(), 1))
    sample = docs.where(F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    ordinary = sample.select(F.explode(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(0))).alias("v")).join(known, "v", "left_anti")
    model = stored(markov_ratio(known, ordinary), "secrets-model")
    tokens = free.select(F.col("m.v").alias("v")).distinct()
    pairs = tokens.select("v", F.explode(bigrams(F.col("v"))).alias("p")).select("v", "p.a", "p.b")
    scores = pairs.join(F.broadcast(model), ["a", "b"]).groupBy("v").agg(F.avg("llr").alias("score"))
    random = scores.where(F.col("score") > threshold).select("v")
    hits = free.select("u", "m", F.col("m.v").alias("v")).join(random, "v")
    return hits.groupBy("u").agg(F.collect_set("m").alias("markov"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"]), x["s"], x["e"])), ",")


def secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (kind, start, end, text of every span)."""
    rows = stored(scan(docs), "secrets-scan")
    added = spans_by_model(rows, docs, threshold)
    out = rows.drop("token").join(added, "u", "left")
    placed = lambda name, k: F.transform(name, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), m["v"].alias("v")))
    base = F.concat(placed("assign", 1), placed("access", 2), placed("hex", 3))
    markov = F.coalesce("markov", F.array().cast(SPANS))
    out = out.withColumn("base", base).withColumn("all", F.concat("base", placed(markov, 4)))
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"),
        F.transform(F.array_sort("all"), lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), x["v"].alias("text"))).alias("found"),
    )
