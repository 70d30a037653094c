"""Near copies where ids are repeated, shared or null, against brute force."""

import random

from test_operators import docs_of, jaccard_by_force, sentence

from trackloom.llm import jaccard


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(3)
    base, other, third = sentence(rng, 80), sentence(rng, 300), sentence(rng, 60)
    w = base.split()
    near = " ".join([*w[:40], "changed", *w[41:]])
    texts = [(1, base), (1, base), (2, base), (3, near), (12, other), (12, base), (None, base), (None, third), (None, third), (20, near), (20, near), (21, other.upper()), (4, None), (4, None), (5, ""), (6, "one two"), (7, "ONE two"), (7, "ONE two")]
    rows = [(i, t, "en", "a") for i, t in texts]
    # Brute force leaves null ids out, so rows are numbered for it.
    links = jaccard_by_force([(k, *r[1:]) for k, r in enumerate(rows)])
    want, stay = [], []
    rank = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    for k, r in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        first = min(seen, key=rank)
        want.append((r[0], len(links[k]), rows[first][0], first == k))
        if first == k:
            stay.append(r[:2])
    got = jaccard.jaccard_links(docs_of(spark, rows)).collect()
    assert sorted(map(str, [(r.doc_id, r.n_links, r.component_id, r.kept) for r in got])) == sorted(map(str, want))
    left = jaccard.without_near_copies(docs_of(spark, rows)).collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in left])) == sorted(map(str, stay))


def mirrored(a, b, n, sep=""):
    """A regular pattern of 2**n items and its mirror image, whose polynomial fingerprints modulo 2**64 agree."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return sep.join((a, b)[x] for x in bits), sep.join((b, a)[x] for x in bits)


def test_regular_patterns_are_told_apart(spark):
    one, other = mirrored("a", "b", 11)
    some, more = mirrored("red", "blue", 11, " ")
    rows = [(1, one, "en", "a"), (2, other, "en", "a"), (3, some + " end of this", "en", "a"), (4, more + " end of that", "en", "a"), (5, one, "en", "a")]
    got = {r.doc_id: (r.n_links, r.component_id) for r in jaccard.jaccard_links(docs_of(spark, rows)).collect()}
    links = jaccard_by_force(rows)
    assert got == {1: (1, 1), 2: (0, 2), 3: (len(links[2]), 3), 4: (len(links[3]), 3 if links[3] else 4), 5: (1, 1)}


def test_fingerprints_of_words_and_sequences():
    import numpy as np

    from trackloom.llm import repeats, text

    for x, y in (mirrored("a", "b", 12), mirrored("q", "z", 11), mirrored("ab ", "cd ", 11)):
        data = np.frombuffer((x + y).encode(), np.uint8)
        found, n = text.words(data, np.array([0, len(x), len(x) + len(y)]))
        k1, k2 = text.sequence_keys(found, n)
        assert k1[0] != k1[1] and k2[0] != k2[1]
        h = repeats.Hashes(data)
        at = np.array([0, len(x)])
        assert len(set(h.other(at, at + len(x)).tolist())) == 2
        assert h.other(np.array([3]), np.array([300])) == repeats.Hashes(data[3:]).other(np.array([0]), np.array([297]))
