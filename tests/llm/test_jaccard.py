import random
from collections import Counter
from fractions import Fraction

import corpora

from folio.llm import jaccard


def sets(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in corpora.words(text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, link):
    own = [sets(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and both >= link * len(own[i] | own[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r[0])
    return [(r[0], len(own[i]), r[0] if not own[i] else min((x for x in low[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


def family(seed, n, words, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_op3(spark):
    rows = corpora.sample(2, 80) + [(None, "only here nowhere else", None, None, 0), (None, corpora.sample(2, 80)[0][1], None, None, 0)]
    texts = family(1, 60, 120, 6) + family(2, 60, 60, 3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} {t}" for t in family(3, 40, 200, 200)]
    rows += [(1000 + i, t, None, None, 0) for i, t in enumerate(texts)]
    for k, link in ((4, Fraction(85, 100)), (5, Fraction(4, 5))):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(corpora.frame(spark, rows), k, link).collect()]
        assert Counter(got) == Counter(brute(rows, k, link))
    assert jaccard.digest(corpora.frame(spark, [])).count() == 0


def test_large_regions(spark, monkeypatch):
    """The recursion and the block join, with leaves small enough to be reached."""
    monkeypatch.setattr(jaccard, "LEAF", 128)
    texts = [t for s in range(6) for t in family(s, 60, 150, 10 + s)] + family(9, 300, 100, 4)
    passage = " ".join(f"p{i}" for i in range(150))
    texts += [f"{passage} {t}" for t in family(10, 150, 40, 40)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = [tuple(r) for r in jaccard.digest(corpora.frame(spark, rows)).collect()]
    assert Counter(got) == Counter(brute(rows, 4, Fraction(85, 100)))


def test_forest_joins_what_links_join():
    r = random.Random(1)
    import numpy as np

    for n in (2, 40):
        base = np.array(sorted(r.sample(range(10**9), 100)), np.uint64)
        own = [np.sort(np.delete(base, r.sample(range(100), r.randrange(25)))) for _ in range(n)]
        reach = {i: {i} for i in range(n)}
        for a, b in jaccard.forest(own):
            assert jaccard.linked(len(np.intersect1d(own[a], own[b])), len(own[a]), len(own[b]))
            merged = reach[a] | reach[b]
            for x in merged:
                reach[x] = merged
        for a in range(n):
            for b in range(a):
                if jaccard.linked(len(np.intersect1d(own[a], own[b])), len(own[a]), len(own[b])):
                    assert b in reach[a]


def test_regions_of_several_batches(spark):
    """One region of 9,000 classes in several Arrow batches, whose mates lie far apart, at the default sizes: no link is lost."""
    from pyspark.sql import functions as F

    rows = spark.range(9000).select(F.lit(b"r").alias("region"), F.unhex(F.md5(F.col("id").cast("string"))).alias("cls"), F.lit(41).cast("long").alias("n"), (F.col("id") % 4500).alias("base"), "id")
    own = F.concat(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (F.col("base") * 1000 + i).cast("long")), F.array(F.lit(10**12) + F.col("id")))
    sets = jaccard.save(rows.select("cls", own.alias("set")), "sets")
    members = jaccard.save(rows.select("region", "cls", "n").coalesce(1), "members")
    found = {frozenset((bytes(r.a), bytes(r.b))) for r in jaccard._links(members, sets, jaccard.LINK).collect()}
    by_base = {}
    for r in rows.select("cls", "base").collect():
        by_base.setdefault(r.base, []).append(bytes(r.cls))
    assert found == {frozenset(x) for x in by_base.values()} and len(found) == 4500


def test_large_regions_by_hashes(spark, monkeypatch):
    """Leaves bounded by what they hold, not by how many."""
    monkeypatch.setattr(jaccard, "LEAF_HASHES", 3000)
    monkeypatch.setattr(jaccard, "TURN", 16)
    texts = [t for s in range(4) for t in family(s, 40, 150, 12)] + family(9, 80, 300, 40) + family(11, 3, 4000, 30)
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = [tuple(r) for r in jaccard.digest(corpora.frame(spark, rows)).collect()]
    assert Counter(got) == Counter(brute(rows, 4, Fraction(85, 100)))


def test_repeated_ids_and_clashing_columns(spark):
    """All rows of one id, or of none: groups are still found; one row of each stays in the stage."""
    from pyspark.sql import functions as F

    texts = family(1, 12, 100, 2) + family(2, 12, 80, 1) + ["", None, " "] + family(1, 12, 100, 2)
    for doc_id in (7, None):
        docs = corpora.frame(spark, [(doc_id, t, None, None, 0) for t in texts])
        assert all(r.component_id == doc_id for r in jaccard.digest(docs).collect())
        wide = docs.select("*", *[F.lit(c).alias(c) for c in ("_k", "mark", "root", "n", "d", "m", "_row", "worded", "Doc_Id2", "cls")])
        kept = jaccard.apply(wide).collect()
        assert sum(bool(corpora.words(r.text)) for r in kept) == 2 and len(kept) == 5 and all(r["mark"] == "mark" for r in kept)


def test_polynomial_twins_differ(spark):
    w = "a"
    while len(w) < 1024:
        w += w.translate({97: 98, 98: 97})
    rows = [(1, w, None, None, 0), (2, w.translate({97: 98, 98: 97}), None, None, 0), (3, w, None, None, 0)]
    assert sorted(tuple(r) for r in jaccard.digest(corpora.frame(spark, rows)).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
