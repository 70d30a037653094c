"""Each numbered operator against brute force, and on odd inputs: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import components, decontaminate, embeddings, filters, jaccard, mixing, pii, quality, queries, repeats, secrets, tokens, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, _b long, _w string, n int, p string, dk long"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); further columns have names that the operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y", 2, "z", 3) for r in rows], DOCS)


def sentence(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "É", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Documents of every odd kind."""
    rng = random.Random(3)
    base = sentence(rng, 80)
    w = base.split()
    near = " ".join([*w[:40], "changed", *w[41:]])
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, None, None, None), (5, "", "fr", ""), (6, "one two", "en", "a"), (7, "ONE two", "en", "a"),
        (8, sentence(rng, 20_000), "en", "a"), (9, "a" * 3000, "de", "b"), (10, "x" + base[100:420] + "y", "en", None), (11, "   ", "en", "a"), (12, sentence(rng, 300), None, "c"), (12, base, "en", "a"),
        (None, base, "en", "a"), (13, sentence(rng, 13), "en", "b"), (13, sentence(rng, 13), "en", "b"), (14, "mail a.b@c.org, +1 (269) 555-3296, 4111 1111 1111 1111; 10.0.0.300, 10.2.3.4", "en", "a"),
    ]
    rows.append(rows[0])
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    return docs_of(spark, odd)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 --------------------------------------------------------------------------------------


def repeats_by_force(texts):
    seen, out = collections.Counter(), []
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_repeats_match_brute_force(spark, odd, docs):
    rows = [r for r in odd if r[0] != 8]
    got = repeats.repeat_report(docs.where("doc_id is null or doc_id <> 8")).collect()
    want = repeats_by_force([r[1] for r in rows])
    assert sorted((str(r[0]), *list(r)[1:]) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))


def test_repeats_of_partial_passages(spark):
    rng = random.Random(5)
    passage = sentence(rng, 120)
    rows = [(i, sentence(rng, 30) + passage[rng.randint(0, 300) : rng.randint(320, 650)] + sentence(rng, 30), "en", "s") for i in range(60)]
    got = {r[0]: tuple(r)[1:] for r in repeats.repeat_report(docs_of(spark, rows)).collect()}
    assert [got[i] for i in range(60)] == repeats_by_force([r[1] for r in rows])


def test_repeats_of_nothing(none):
    assert repeats.repeat_report(none).count() == 0


# ---- 2 --------------------------------------------------------------------------------------


def test_url_rules_and_model(spark):
    rows = [(1, "http://A.example.com/en/7?x"), (2, "http://a.com/en/1"), (3, "https://x.net/de/9#t"), (4, "https://x.example.net/de/8"), (5, None), (6, "no scheme"), (7, "http://É.ORG/es/"), (8, "http://evilcom/en/"), (9, "ftp://com/en/"), (10, "http://?q"), (10, "http://?q")]
    got = urls.filter_urls(spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")).collect()
    one = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert len(got) == 11
    assert one[1] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and one[2][2:] == ("com/en/", "block") and one[3][2:] == ("net/de/", "allow")
    assert one[4][2:] == ("example.net/de/8", "block") and one[5][:3] == ("", "", None) and one[6][:3] == ("", "", None) and one[7] == ("É.org", "/es/", "org/es/", "block")
    assert one[8][2] is None and one[9][2] == "com/en/" and one[10][:3] == ("", "", None)
    assert all(r.verdict in ("allow", "block") for r in got)
    assert urls.filter_urls(spark.createDataFrame([(1, "x")], "page_id long, url string")).head().verdict == "allow"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_on_held_out_rows(spark):
    rng = random.Random(1)
    word = lambda k: "".join(rng.choice(k) for _ in range(8))
    rows = [(f"{word('abcd' if i % 2 else 'wxyz')}.site.com", f"/{word('abcd' if i % 2 else 'wxyz')}", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "host string, path string, label int")
    train, test = df.limit(400), spark.createDataFrame(rows[400:], "host string, path string, label int")
    out = urls.train(spark.createDataFrame(rows[:400], train.schema)).transform(urls.featured(test))
    assert out.where("prediction = label").count() / 200 > 0.95


# ---- 3 --------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal_by_force(text):
    out = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda m=m: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15}[name]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_patterns():
    rng = random.Random(2)
    parts = ["a", "@", ".", "1", "2", "255", "+1", "-", " ", "b.c", "@x.y", "4111 1111 1111 1111", "(", "7", "É", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(50))
        assert pii.base_spans(t) == personal_by_force(t), t


def test_personal_data(spark, odd, docs, none):
    got = pii.personal_data(docs).collect()
    assert len(got) == len(odd)
    want = {}
    for r in odd:
        spans = personal_by_force(r[1])
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        want.setdefault(r[0], set()).add((*[sum(k == i for _, k, _ in spans) for i in range(4)], digest))
    assert all(tuple(r)[1:6] in want[r.doc_id] for r in got)
    one = next(r for r in got if r.doc_id == 14)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1) and "email:5:14" in one.spans
    assert pii.personal_data(none).count() == 0


def test_loose_candidates_and_long_texts():
    one = "call (212) 555-0187 or mail jo [at] home [dot] org, ssn 123-45-6789. "
    n = 3000
    spans = pii.loose_spans(one * n, pii.base_spans(one * n))
    own = pii.loose_spans(one, pii.base_spans(one))
    assert len(own) == 3 and spans == [(s + k * len(one), c, e + k * len(one)) for k in range(n) for s, c, e in own]
    assert pii.loose_spans("x 4111 1111 1111 1111 y", pii.base_spans("x 4111 1111 1111 1111 y")) == []


def test_weak_supervision_finds_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    noise = lambda p: np.where(rng.random(4000) < p, truth, ~truth)
    v = np.stack([np.where(noise(p), 1, 2) for p in (0.95, 0.9, 0.85, 0.6, 0.55)])
    pattern = (v * 3 ** np.arange(5)[:, None]).sum(axis=0)
    ids, n = np.unique(pattern, return_counts=True)
    p, table = pii.reliabilities(np.zeros(len(ids), int), ids, n.astype(float))
    found = dict(zip(ids, p > 0.5, strict=True))
    assert np.mean([found[x] for x in pattern] == truth) > 0.95
    assert table[1, 0, 1] > 0.9 > 0.75 > table[1, 4, 1]


# ---- 4 --------------------------------------------------------------------------------------


def test_near_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16) * 0.12], i % 3 if i % 17 else None) for i in range(400)]
    rows += [(400 + i, [1.0] * 16, 1) for i in range(50)] + [(450, None, 1), (451, [0.0] * 16, 1), (452, [float("nan")] * 16, 1), (453, [None] * 16, 1), (454, [1.0] * 8, 1), (455, [], 1), (456, [float("inf")] * 16, 1), (457, [1e200] * 16, 1)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), miss=1e-9).collect()}
    assert len(got) == len(rows)
    good = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = collections.defaultdict(set)
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]) / np.max(np.abs(a[1])), np.array(b[1]) / np.max(np.abs(b[1]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    for r in rows:
        seen, todo = {r[0]}, [r[0]]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (len(links[r[0]]), min(seen), min(seen) == r[0]), r[0]
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000 + rng.randint(0, 300), 5000 + rng.randint(0, 300)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for x in parent}


# ---- 5 --------------------------------------------------------------------------------------


def test_elias_fano_round_trip():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (1, 0), (5, 10**6), (2000, 5000), (300, 10**9), (200, 3)):
        v = np.sort(rng.integers(0, top + 1, n))
        low, high, samples = tokens.ef_encode(v, top)
        assert (tokens.ef_values(low, high, samples, n, top, 0, n) == v).all() and (tokens.ef_values(low, high, samples, n, top, n // 3, n // 3 + 1 + n // 2) == v[n // 3 : n // 3 + 1 + n // 2]).all()
        assert [tokens.ef_select(low, high, samples, n, top, i) for i in range(n)] == v.tolist()
        assert len(low) + len(high) <= (n * (2 + max(0, np.log2(max(top, 1) / n) + 1))) / 8 + 4
    with pytest.raises(IndexError):
        tokens.ef_select(low, high, samples, n, top, n)


def test_token_files_match_the_tokenizer(spark, odd, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    rows = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    out = tokens.token_ids(docs, queries.tokenizer_path())
    got = out.withColumn("doc_id", tokens.least_null(F.col("doc_id"))).orderBy("start").collect()
    assert list(map(tuple, got)) == want
    assert tokens.token_ids(none, queries.tokenizer_path()).count() == 0


def test_word_encoder_is_the_tokenizer():
    enc = tokens.WordEncoder(queries.tokenizer_path())
    rng = random.Random(0)
    texts = ["x <|endoftext|> y<|startoftext|>z  İΣ ́a", "Don't. STOP, ... a.b, c,. ß. É, ÉTÉ. µ. \x85 \xa0 x\x1cy ª. º, 12. 3,", "", ".", " .", "ΑΣ. ﬁ. é. á, " + "b" * 100 + ". " + "c" * 90]
    texts += ["".join(rng.choice("ab.,' \n\tÉ'sé1́ \x1cΣİ<|>") for _ in range(300)) for _ in range(200)]
    texts += [" ".join("".join(rng.choice("abcEÉßüÞÿs") for _ in range(rng.randint(1, 9))) + rng.choice(["", ".", ",", ".,"]) for _ in range(80)) for _ in range(50)]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # new words, then remembered ones
        got = [x.tolist() for _, _, ids, n in tokens.encoded(pa.array(texts), enc, 1000) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want
    ids, n = enc.encode(pa.array([None, "", None], pa.string()))
    assert len(ids) == 0 and n.tolist() == [0, 0, 0]


# ---- 6 --------------------------------------------------------------------------------------


def contaminated_by_force(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    sizes, out = {len(x) for x in windows}, []
    for r in rows:
        w, hit, ids = words(r[1]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[x]
        digest = hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()
        out.append((r[0], len(w), len(hit), len([i for i in ids if i is not None]), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination_matches_brute_force(spark, odd, docs, none, monkeypatch):
    base = odd[0][1].split()
    items = [(1, " ".join(base[10:40])), (2, "one TWO"), (3, None), (4, ""), (5, " ".join(base[30:43]).upper()), (5, " ".join(base[30:43])), (None, " ".join(base[50:66])), (6, "the the the the the the the the the the the the the the"), (7, "absent words only")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, dk int")
    rows = [*odd, (20, "the " * 40, "en", "a"), (21, " ".join(base[12:24]), "en", "a")]
    every = docs_of(spark, rows)
    want = sorted(contaminated_by_force(rows, items), key=str)
    assert sorted((tuple(r)[:-1] for r in decontaminate.contamination(every, bench).collect()), key=str) == want
    kept = sorted(str(r.doc_id) for r in decontaminate.decontaminated(every, bench).collect())
    assert kept == sorted(str(w[0]) for w in want if not w[-1])
    assert decontaminate.decontaminated(every, bench).columns == every.columns
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    assert sorted((tuple(r)[:-1] for r in decontaminate.contamination(every, bench).collect()), key=str) == want
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(every, bench.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    near = docs_of(spark, [(1, "w5 w4 x w3 w2 w1 y", "en", "a"), (2, "w1 w2 w3 " + "x " * 40 + "w4 w5", "en", "a")])
    item = spark.createDataFrame([(1, "w1 w2 w3 w4 w5")], "item_id long, text string")
    assert decontaminate.proximity_matches(near, item, 3).count() == 1


def test_proximity_by_force(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(14)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))), "en", "a") for i in range(60)] + [(None, None, "en", "a")]
    items = [(i, " ".join(rng.sample(vocabulary, 4))) for i in range(12)] + [(20, " ".join(rng.sample(vocabulary, 14))), (21, "w1 nowhere")]
    freq = collections.Counter(w for r in rows for w in words(r[1]))
    windows = {tuple(words(t)[k : k + 13]) for _, t in items for k in range(max(1, len(words(t)) - 12))}
    want = {}
    for r in rows:
        w, near = words(r[1]), set()
        for x in windows:
            rare = min(x, key=lambda t: (freq[t], t))
            near |= {(p, x) for p, t in enumerate(w) if t == rare and set(x) <= set(w[max(0, p - 14) : p + 15])}
        if near:
            want[r[0]] = (len({p for p, _ in near}), len({x for _, x in near}))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id: (r.n_near, r.n_windows) for r in decontaminate.proximity(docs_of(spark, rows), bench, 2).collect()} == want and len(want) > 5


def test_a_window_that_many_items_share(spark):
    shared = " ".join(f"s{i}" for i in range(13))
    bench = spark.createDataFrame([(i, shared) for i in range(10_000)], "item_id long, text string")
    (r,) = decontaminate.contamination(docs_of(spark, [(1, f"a {shared} b", "en", "a")]), bench).collect()
    assert (r.n_words, r.n_hit, r.n_items) == (15, 13, 10_000) and r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, range(10_000)))).encode()).hexdigest()


# ---- 7 --------------------------------------------------------------------------------------


def jaccard_by_force(rows):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 5 * len(a & b) >= 4 * len(a | b):
                links[i].add(j)
                links[j].add(i)
    return links


def test_jaccard_links_match_brute_force(spark, odd, docs, none):
    rows = [r for r in odd if r[0] is not None and r[0] != 12]
    rng = random.Random(9)
    base = sentence(rng, 150).split()
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
        rows.append((100 + i, " ".join(w), "en", "a"))
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    links = jaccard_by_force(rows)
    got = {r.doc_id: r for r in jaccard.jaccard_links(docs_of(spark, rows)).collect()}
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min(rows[k][0] for k in seen)
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (len(links[i]), least, least == r[0]), r[0]
    every = jaccard.jaccard_links(docs).collect()
    assert len(every) == len(odd)
    assert jaccard.without_near_copies(docs).columns == docs.columns
    assert jaccard.jaccard_links(none).count() == 0 and jaccard.without_near_copies(none).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    rng = random.Random(11)
    base = sentence(rng, 200).split()
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(200)] = f"n{i}"
        rows.append((i, " ".join(w), "en", "a"))
    links = jaccard_by_force(rows)
    real = jaccard.in_pieces
    monkeypatch.setattr(jaccard, "in_pieces", lambda m, g, k, n, w, most, name: real(m, g, k, 32, w, 10_000, name))
    got = {r.doc_id: r for r in jaccard.jaccard_links(docs_of(spark, rows)).collect()}
    assert all(got[i].n_links == len(links[i]) and got[i].component_id == 0 for i in range(150))


def test_pruning_keeps_pairs_at_the_threshold():
    least = jaccard.fewest_matches()
    rng = np.random.default_rng(0)
    matches = np.cumsum((rng.random((200_000, jaccard.HASHES)) < 0.8).reshape(200_000, -1, jaccard.ROUND).sum(axis=2), axis=1)
    assert (matches < np.array(least)).any(axis=1).mean() < 1e-4
    low = np.cumsum((rng.random((20_000, jaccard.HASHES)) < 0.4).reshape(20_000, -1, jaccard.ROUND).sum(axis=2), axis=1)
    assert (low < np.array(least)).any(axis=1).mean() > 0.99


# ---- 8 --------------------------------------------------------------------------------------

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def secrets_by_force(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_match_patterns(spark, odd, none):
    rng = random.Random(4)
    parts = ["password", "Token", "API_KEY", "apikey", " ", ": ", "=", '"', "abc123", "É", "AKIA", "ABCDEFGH12345678", "0123456789abcdef0123", "\n", "secret=abcdef", "passwd : 'x'"]
    rows = [*odd, *[(100 + i, "".join(rng.choice(parts) for _ in range(25)), "en", "a") for i in range(150)]]
    got = secrets.secrets(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        spans = secrets_by_force(r[1])
        digest = hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        want.setdefault(r[0], set()).add((*[sum(k == i for _, k, _ in spans) for i in range(3)], digest))
    assert all(tuple(r)[1:5] in want[r.doc_id] for r in got)
    assert secrets.secrets(none).count() == 0


def test_markov_models_tell_random_strings(spark):
    rng = random.Random(6)
    code = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    rows = [(i, f"{sentence(rng, 60).replace('É', 'e')} token={code(40)} end", "en", "a") for i in range(60)]
    rows += [(100, f"here {code(40)} alone", "en", "a"), (101, "here " + "theronanrest" * 4 + " alone", "en", "a")]
    got = {r.doc_id: r.spans for r in secrets.secrets(docs_of(spark, rows)).collect()}
    assert "markov:5:45" in got[100] and got[101] == ""


def test_markov_needs_no_digits(spark):
    rng = random.Random(7)
    code = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    names = ["read_partition_count", "src/main/resources/table_names", "max-open-files-limit", "ordersByCustomerNation", "nation_row_count_of_page_2026"]
    short = ["row_count", "src/main", "max-open", "orderKey", "nationName", "page_2026", "API_LEVEL", "lib/x86_64"]
    rows = [(i, f"{sentence(rng, 60).replace('É', 'e')} {' '.join(rng.sample(short, 4))} {rng.choice(names)} token={code(40, letters + '0123456789')} end", "en", "a") for i in range(80)]
    rows += [(100 + i, f"x {code(24, letters)} y", "en", "a") for i in range(20)] + [(200 + i, f"x {n} y", "en", "a") for i, n in enumerate(names)]
    got = {r.doc_id: r.spans for r in secrets.secrets(docs_of(spark, rows)).collect()}
    assert sum(got[100 + i] == "markov:2:26" for i in range(20)) >= 18
    assert not [n for i, n in enumerate(names) if got[200 + i]]


# ---- 9 --------------------------------------------------------------------------------------


def targets_by_force(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, fixed, left = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in fixed]
        total = sum(w[s] for s in free)
        share = {s: left * w[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            fixed.add(s)


def test_mix(spark, odd, none):
    rng = random.Random(8)
    rows = [*odd, *[(1000 + i, sentence(rng, rng.randint(1, 60)), "en", rng.choice(["big"] * 6 + ["s1", "s2", "s3", "é", "tiny" if i % 40 == 0 else "big", None])) for i in range(600)]]
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want, got = targets_by_force(sizes), mixing.mix_report(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(sizes.values())
    by = {r[0]: r[3] for r in rows}
    taken = collections.Counter()
    for r in got:
        s = next(x[3] for x in rows if x[0] == r.doc_id and len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) == r["size"])
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in want:
        sums = {0}  # of once more each
        for r in got:
            sums |= {x + r["size"] for x in sums} if by.get(r.doc_id) == s and len(sums) < 20_000 else set()
        best = min(abs(math.floor(want[s] / sizes[s] + 1e-9) * sizes[s] + x - want[s]) for x in sums) if sizes[s] else 0
        assert abs(taken[s] - want[s]) <= max(0.001 * want[s], 1) + best, s
    again = mixing.mix_report(docs_of(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.columns == docs_of(spark, rows).columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).head()[0] == sum(r.taken for r in got)
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_mix_of_given_tables(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    by = {(r.doc_id, r.n): r.source for r in docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")).collect()}
    sizes, taken, least = collections.Counter(), collections.Counter(), {}
    for r in mixing.mix_report(docs).collect():
        s = by[r.doc_id, r["size"]]
        sizes[s] += r["size"]
        taken[s] += r.taken
        least[s] = min(least.get(s, 1 << 40), r["size"] or 1 << 40)
        assert r.taken <= 3 * r["size"]
    off = {s: (taken[s], want) for s, want in targets_by_force(sizes).items() if abs(taken[s] - want) > max(0.01 * want, least[s] / 2)}
    assert not off


def test_mix_takes_part_of_repeated_rows(spark):
    """A document that is there many times, over several tasks, is taken as often as its source needs."""
    rows = [(1, "w " * 10, "en", "a")] * 100 + [(2 + i, "v " * 20, "en", "b") for i in range(100)]
    got = mixing.mix_report(docs_of(spark, rows).repartition(6)).collect()
    assert {r.target for r in got} == {1000.0, 2000.0} and sum(r.taken for r in got if r["size"] == 10) == 1000
    rows = [(1, "w " * 10, "en", "a")] * 100 + [(2 + i, "v " * 20, "en", "b") for i in range(175)]
    got = mixing.mix_report(docs_of(spark, rows).repartition(6)).collect()
    assert sum(r.taken for r in got if r["size"] == 10) == 1500 and {r.taken for r in got if r["size"] == 10} == {10, 20}
    assert mixing.mix(docs_of(spark, rows)).where("source = 'a'").count() == 150


def test_nearest_sum():
    rng = random.Random(9)
    for _ in range(300):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 9))]
        goal = rng.randint(1, 120)
        chosen = mixing.nearest_sum(sizes, goal)
        sums = {sum(x for x, c in zip(sizes, pick, strict=True) if c) for pick in itertools.product([0, 1], repeat=len(sizes))}
        assert abs(sum(x for x, c in zip(sizes, chosen, strict=True) if c) - goal) == min(abs(x - goal) for x in sums)
    big = [rng.randint(1, 5_000_000) for _ in range(30)]
    assert abs(sum(x for x, c in zip(big, mixing.nearest_sum(big, 30_000_001), strict=True) if c) - 30_000_001) < 2000


# ---- 10 -------------------------------------------------------------------------------------


def test_quality_keeps_clean_and_rejects_junk(spark, odd, none):
    rng = random.Random(2)
    rows = [(i, sentence(rng, 150), "en" if i % 2 else "de", "a") for i in range(300)] + [(500 + i, "".join(rng.choice("QX#%&*!Z9") for _ in range(400)), "en", "a") for i in range(20)]
    df = docs_of(spark, rows)
    trusted = df.where("doc_id < 200").select("doc_id")
    name = queries.tokenizer_path()
    got = {r.doc_id: r for r in quality.perplexities(df, trusted, name).collect()}
    assert sum(got[i].kept for i in range(300)) >= 290 and not any(got[500 + i].kept for i in range(20))
    kept = quality.of_quality(df, trusted, name)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    every = quality.perplexities(docs_of(spark, odd), trusted, name).collect()
    assert len(every) == len(odd) and all(r.perplexity is None and not r.kept for r in every if r.doc_id in (4, 5))
    assert quality.perplexities(none, trusted, name).count() == 0 and quality.of_quality(df, trusted.limit(0), name).count() == len(rows)


def test_filters_never_lose_rows(spark, docs, odd):
    gone = spark.createDataFrame([(1,), (9,), (99,)], "k long")
    left = filters.without(docs, F.col("doc_id"), gone)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in odd if r[0] not in (1, 9))
