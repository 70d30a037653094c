"""The manifest against trees built plainly, and its SQL."""

import hashlib
import random
import zlib

from oracle import compare, connection

from trackloom.llm import merkle, queries

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def tree_of(nodes):
    """(root, for every node the runs on its way up: (slot, run))."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for way, p in zip(ways, at, strict=True):
            way.append((p % 3, runs[p // 3]))
        nodes, at = [h(*r) for r in runs], [p // 3 for p in at]
    return nodes[0], ways


def report_by_force(docs):
    by_source = {}
    for d in docs:
        by_source.setdefault(d[1], []).append((d[0], leaf_of(d), d))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = tree_of([x[1] for x in by_source[s]])
    root, tops = tree_of([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for (k, leaf, d), way in zip(by_source[s], trees[s][1], strict=True):
            told = leaf
            if k is not None and zlib.crc32(str(k).encode()) % 2 == 0 and d[4] is not None:
                told = leaf_of((*d[:4], d[4].replace("\n", "")))
            siblings = []
            for slot, run in way + top:
                siblings += [x for i, x in enumerate(run) if i != slot]
                told = h(*run[:slot], told, *run[slot + 1 :])
            out.append((k, leaf, trees[s][0], root, h(*siblings), told, told == root))
    return sorted(out, key=str)


def report(spark, docs):
    df = merkle.manifest_report(spark.createDataFrame(docs, DOCS))
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_against_plain_trees(spark):
    rng = random.Random(4)
    docs = [(rng.choice([i, i, i, None, 5]), rng.choice(["b", "a", None, "é", "z", ""]), rng.choice(["en", None]), rng.choice([7, None]), rng.choice(["a\nb", "", None, "plain", f"{i}\n"])) for i in range(500)]
    docs += docs[:20] + [(1, f"s{i}", "en", 1, "x\ny") for i in range(12)]
    got = report(spark, docs)
    assert got == report_by_force(docs) and {r[-1] for r in got} == {True, False}


def test_more_rows_than_a_block(spark):
    """One source of more than BLOCK leaves, with others beside it: ways go over two rounds."""
    docs = [(i, "hot", "en", i, f"line {i}\nend") for i in range(merkle.BLOCK + 700)] + [(i, f"s{i % 5}", "en", 1, "t\n") for i in range(40)]
    assert report(spark, docs) == report_by_force(docs)


def test_defined_cases(spark):
    one = [(4, "s", "en", 3, "a\nb")]
    assert report(spark, one) == report_by_force(one) and report(spark, one)[0][2] == leaf_of(one[0])
    long = [(1, "s", "en", 1, "é\n" * 500_000), (2, None, None, None, None)]
    assert report(spark, long) == report_by_force(long)
    assert report(spark, []) == []
    clash = spark.createDataFrame([(*one[0], 1, "x")], DOCS + ", idx int, grp string")
    assert merkle.manifest_report(clash).head().root == leaf_of(one[0])


def test_parents_resume_their_states():
    rng = random.Random(2)
    for n in (1, 2, 3):
        children = [h(str(rng.random())) for _ in range(n)]
        parent = merkle.Parent(children)
        assert parent.digest == h(*children)
        for slot in range(n):
            assert parent.folded(slot, "new") == h(*children[:slot], "new", *children[slot + 1 :]) == merkle.Resumed(children[:slot], children[slot + 1 :]).folded("new")


def test_sql(spark, sf):
    compare(queries.op13_merkle_manifest(spark, sf), connection(sf), queries.ORACLES["op13_merkle_manifest"])
