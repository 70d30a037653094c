"""The model of operator 10 against the textbook formula, and the growth of its table."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F
from test_operators import docs_of

from trackloom.llm import quality, queries, token_model
from trackloom.llm.tokens import encoder


def model_by_force(texts, size):
    pairs = collections.Counter(g for t in texts if t for g in zip([size, *t], [*t, size + 1]))
    items = collections.Counter(c for _, c in pairs)

    def discounts(counts):
        n = [sum(v == i for v in counts.values()) for i in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        return [0] + [max(0.05, min(k - 0.05, k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k)) for k in (1, 2, 3)]

    d, e = discounts(pairs), discounts(items)

    def lower(c):
        m = sum(items.values())
        if not m:
            return 1 / (size + 1)
        freed = sum(min(e[min(v, 3)], v) for v in items.values())
        return max(items[c] - e[min(items[c], 3)], 0) / m + freed / m / (size + 1)

    def p(b, c):
        seen = {x: v for x, v in pairs.items() if x[0] == b}
        if not seen:
            return lower(c)
        total, freed = sum(seen.values()), sum(min(d[min(v, 3)], v) for v in seen.values())
        n = seen.get((b, c), 0)
        return max(n - d[min(n, 3)], 0) / total + freed / total * lower(c)

    return p


@pytest.mark.parametrize("rounds", [1, 3])
def test_perplexities_and_verdicts_by_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(token_model, "ROUNDS", rounds)
    monkeypatch.setattr(token_model, "CHUNK", 500)
    monkeypatch.setattr(token_model, "HELD", 200)
    monkeypatch.setattr(token_model, "TEXT_BYTES", 10_000 * rounds)
    path = queries.tokenizer_path()
    enc = encoder(path)
    rng = random.Random(4)
    names = [f"w{i}" for i in range(25)] + [",", "."]
    rows = [(i, " ".join(rng.choice(names[: 5 + i]) for _ in range(30)), "en" if i % 3 else "de") for i in range(20)]
    rows += [(30, "w1 unknown words, w2", "en"), (31, "W1 W2.", "en"), (31, "W1 W2.", "en"), (31, "w3", "de"), (32, "#", None), (33, " ", "en"), (None, "w1 w2", "en"), (34, None, "fr"), (35, "w1 " * 5000, "fr")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, k1 int")
    trusted = docs.where("doc_id < 20").select("doc_id")
    fold = {r.doc_id: r.f for r in docs.select("doc_id", quality.fold_of("doc_id").alias("f")).collect()}
    ids = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    models = [model_by_force([x for (i, _, _), x in zip(rows, ids, strict=True) if i is not None and i < 20 and fold[i] == f], enc.size) for f in (0, 1)]

    def perplexity(i, t):
        g = list(zip([enc.size, *t], [*t, enc.size + 1], strict=True))
        return 2 ** (-sum(math.log2(models[1 - fold[i]](*x)) for x in g) / len(g)) if t else None

    scored = [(i, lang, perplexity(i, t)) for (i, _, lang), t in zip(rows, ids, strict=True)]
    known = collections.defaultdict(list)
    for i, lang, p in scored[:20]:
        known[lang].append(p)
        known["all"].append(p)
    limit = {k: sorted(v)[max(0, math.ceil(len(v) * 0.5) - 1)] for k, v in known.items()}
    want = sorted([(i, lang, p, p is not None and p <= limit.get(lang, limit["all"]) * (1 + 1e-9)) for i, lang, p in scored], key=str)
    got = sorted([(r.doc_id, r.lang, r.perplexity, r.kept) for r in quality.perplexities(docs, trusted, path, 0.5).collect()], key=str)
    assert [(*g[:2], g[3]) for g in got] == [(*w[:2], w[3]) for w in want]
    assert [g[2] for g in got] == [w[2] if w[2] is None else pytest.approx(w[2], rel=1e-4) for w in want]
    left = quality.of_quality(docs, trusted, path, 0.5)
    assert left.columns == docs.columns
    assert sorted(str((r.doc_id, r.lang)) for r in left.collect()) == sorted(str(w[:2]) for w in want if w[3])


def test_table_grows_with_the_texts(spark):
    rng = random.Random(5)
    sizes = []
    for n in (40, 400):
        text = spark.createDataFrame([(i % 2, "".join(rng.choice("abcdefghij ") for _ in range(2000))) for i in range(n)], "fold int, text string")
        sizes.append(token_model.counted(text, queries.tokenizer_path()).count())
    assert sizes[1] > 3 * sizes[0]


def test_no_rows(spark):
    none = docs_of(spark, [])
    assert quality.perplexities(none, none.select("doc_id"), queries.tokenizer_path()).where(F.col("kept")).count() == 0
