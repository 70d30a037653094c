"""The stages against plain Python on a small fixture, and on the small tables."""

import collections
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from oracle import compare, connection
from test_operators import contaminated_by_force, docs_of, jaccard_by_force, sentence, targets_by_force
from test_token_model import model_by_force

from trackloom.llm import quality, queries
from trackloom.llm.store import stored
from trackloom.llm.tokens import encoder


def fixture_rows():
    rng = random.Random(11)
    rows = [(i, sentence(rng, rng.randint(20, 90)), "en" if i % 3 else "de", rng.choice(["s1", "s2", "s2", "s2", None])) for i in range(120)]
    bench = [(1, sentence(rng, 40)), (2, sentence(rng, 5)), (None, sentence(rng, 20)), (3, None)]
    w = rows[7][1].split()
    rows += [(200, rows[7][1], "en", "s1"), (201, rows[7][1].upper(), "en", "s2"), (202, " ".join([*w[:3], *w[4:]]) if len(w) > 60 else rows[7][1], "en", "s2")]
    rows += [(203, rows[9][1], "en", "s1")] * 3 + [(None, rows[11][1], "en", "s1"), (None, sentence(rng, 50), "en", "s1"), (12, sentence(rng, 45), "en", "s2")]
    rows += [(210 + i, f"{sentence(rng, 15)} {bench[0][1]} {sentence(rng, 15)}", "en", "s2") for i in range(3)] + [(220, sentence(rng, 3000) + " " + bench[1][1], "en", "s1")]
    rows += [(230 + i, "".join(rng.choice("QX#%&*!Z9") for _ in range(300)), "en", "s1") for i in range(4)] + [(240, None, "en", "s1"), (241, "", None, ""), (242, " \n", "fr", None)]
    return rows, bench, [(i, int(i % 10 != 3), int(i == 5)) for i in range(100)] + [(6, 0, None), (300, 1, 0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, bench, labels = fixture_rows()
    d = str(tmp_path_factory.mktemp("corpus"))
    docs_of(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()), key=str)


def good_by_force(spark, rows, labels):
    by_id = collections.defaultdict(list)
    for i, q, t in labels:
        by_id[i].append((q, t or 0))
    trusted = {i for i, x in by_id.items() if min(q for q, _ in x) == 1 and max(t for _, t in x) == 0}
    fold = {r.doc_id: r.f for r in docs_of(spark, rows).select("doc_id", quality.fold_of("doc_id").alias("f")).collect()}
    enc = encoder(queries.tokenizer_path())
    ids = [enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    models = [model_by_force([x for r, x in zip(rows, ids, strict=True) if r[0] in trusted and fold[r[0]] == f], enc.size) for f in (0, 1)]

    def perplexity(i, t):
        g = list(zip([enc.size, *t], [*t, enc.size + 1], strict=True))
        return 2 ** (-sum(math.log2(models[1 - fold[i]](*x)) for x in g) / len(g)) if t else None

    p = [perplexity(r[0], x) for r, x in zip(rows, ids, strict=True)]
    known = collections.defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        if r[0] in trusted and x is not None:
            known[r[2]].append(x)
            known["every"].append(x)
    limit = {k: sorted(v)[max(0, math.ceil(len(v) * quality.QUANTILE) - 1)] for k, v in known.items()}
    return [r for r, x in zip(rows, p, strict=True) if x is not None and x <= limit.get(r[2], limit["every"]) * (1 + 1e-6)]


def single_by_force(rows):
    links = jaccard_by_force([(k, *r[1:]) for k, r in enumerate(rows)])
    rank = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    out = []
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        if min(seen, key=rank) == k:
            out.append(r)
    return out


def check_mix(rows, taken):
    """Each document of a source as often as any other or once more, and the source near its target: within a word, if its sizes allow it."""
    size = lambda r: len((r[1] or "").split())
    sizes, got, n = collections.Counter(), collections.Counter(), collections.Counter(taken)
    for r in rows:
        sizes[r[3]] += size(r)
    for r in taken:
        got[r[3]] += size(r)
    assert set(taken) <= set(rows)
    for s, want in targets_by_force(sizes).items():
        whole = math.floor(want / sizes[s] + 1e-9) if sizes[s] else 0
        same = collections.Counter(r for r in rows if r[3] == s)
        assert all(whole * k <= n[r] <= (whole + 1) * k for r, k in same.items())
        sums = {0}
        for r, k in same.items():
            for _ in range(k):
                sums |= {x + size(r) for x in sums}
        assert abs(got[s] - want) <= min(abs(whole * sizes[s] + x - want) for x in sums) + max(1, 0.01 * want)


def tokens_by_force(rows):
    enc, start, out = encoder(queries.tokenizer_path()), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*enc.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        out.append((-(2**63) if r[0] is None else r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_stages_by_force(spark, folder):
    rows, bench, labels = fixture_rows()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    key = lambda x: sorted((tuple(r) for r in x), key=str)
    stages = dict(corpus_pipeline.STAGES)
    good = good_by_force(spark, rows, labels)
    assert 100 < len(good) < len(rows)
    docs = stages["quality"](spark, docs, folder)
    assert docs.columns == columns and as_rows(docs) == key(good)
    single = single_by_force(good)
    assert len(single) < len(good)
    docs = stages["near_copies"](spark, docs, folder)
    assert docs.columns == columns and as_rows(docs) == key(single)
    clean = [r for r, c in zip(single, contaminated_by_force(single, bench), strict=True) if not c[-1]]
    assert len(clean) < len(single)
    docs = stages["decontamination"](spark, docs, folder)
    assert docs.columns == columns and as_rows(docs) == key(clean)
    docs = stages["mixing"](spark, docs, folder)
    assert docs.columns == columns
    docs = stored(docs, "test-mixed")
    taken = as_rows(docs)
    check_mix(clean, taken)
    out = stages["tokens"](spark, docs, folder)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == tokens_by_force(taken)


def test_stages_of_nothing(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_run_on_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    first = corpus_pipeline.keep_quality(spark, docs, sf)
    now = {r.doc_id for r in first.collect()}
    assert len(good & now) >= 0.97 * len(good & {r.doc_id for r in docs.collect()})
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    last = out.orderBy("start").collect()
    assert last and all(a.start + a.n_tokens == b.start for a, b in zip(last, last[1:], strict=False))
    assert {r.doc_id for r in last} <= now


def test_contamination_matches_sql(spark, sf):
    compare(queries.QUERIES["op6_decontamination"](spark, sf), connection(sf), queries.ORACLES["op6_decontamination"])
