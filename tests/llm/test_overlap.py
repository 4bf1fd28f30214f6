import hashlib
from collections import Counter

import corpora
import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm import debruijn, line_align


def brute10(rows):
    first = {}
    for i, t, *_ in rows:
        w = corpora.words(t)
        for j in range(len(w) - 12):
            if i is not None:
                first[tuple(w[j : j + 13])] = min(i, first.get(tuple(w[j : j + 13]), i))
    out = []
    for i, t, *_ in rows:
        w = corpora.words(t)
        gone = {j + k for j in range(len(w) - 12) if i is not None and first[tuple(w[j : j + 13])] < i for k in range(13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def test_op10(spark):
    for seed in (1, 2):
        rows = corpora.sample(seed, 90) + [(None, corpora.sample(seed, 90)[0][1], None, None, 0), (5, "again " * 14, None, None, 0), (5, "again " * 14, None, None, 0)]
        got = [tuple(r) for r in debruijn.digest(corpora.frame(spark, rows)).collect()]
        assert Counter(got) == Counter(brute10(rows))
    assert debruijn.digest(corpora.frame(spark, [])).count() == 0


def test_op10_repeated_ids(spark):
    """Rows that repeat an id with other texts, each of which holds a passage that later documents repeat."""
    p, q = (" ".join(f"{c}{k}" for k in range(30)) for c in "pq")
    rows = [(1, f"{p} x", None, None, 0), (1, f"y {q}", None, None, 0), (1, f"y {q}", None, None, 0), (2, f"{q} {p}", None, None, 0), (3, f"{p} {q} z", None, None, 0), (3, f"{q} {p} w", None, None, 0)]
    got = [tuple(r) for r in debruijn.digest(corpora.frame(spark, rows)).collect()]
    assert Counter(got) == Counter(brute10(rows))


def test_op10_one_id_holds_many_texts(spark):
    """Seeds are gathered for each text, not for each id; a row that repeats adds none."""
    texts = [" ".join(f"{'s' if k % 40 < 20 else t}{k}" for k in range(120)) for t in range(200)]
    rows = [(7, t, None, None, 0) for t in texts] + [(7, texts[0], None, None, 0)] * 2000 + [(9, texts[5] + " end", None, None, 0), (3, texts[6][:300], None, None, 0)]
    got = [tuple(r) for r in debruijn.digest(corpora.frame(spark, rows)).collect()]
    assert Counter(got) == Counter(brute10(rows))
    own = spark.range(100_000).selectExpr("7L as doc_id", "int(if(id < 90000, 0, id)) as half", "array(1L, 2L, 3L, 10 + id % 5) as seeds")
    own = own.unionByName(spark.createDataFrame([(9, 9, [1, 2, 99])], "doc_id long, half int, seeds array<long>"))
    sizes = debruijn._wanted(own, debruijn._met(own)).groupBy("doc_id").agg(F.count("*"), F.max(F.size("seeds"))).collect()
    assert sorted(map(tuple, sizes)) == [(7, 10_001, 2), (9, 1, 2)]


def test_op10_nodes_are_read_from_sources(spark):
    """Candidates carry no nodes; every repeated edge has those of its words, once, though rows repeat."""
    rows = corpora.sample(3, 60)
    rows += [(500, rows[1][1], None, None, 0)] * 3 + [(k, f"{k} " + "w x y z " * 9 + f"tail{k % 2} " * 3, None, None, 0) for k in range(600, 606)]
    _, hits, edges = debruijn.graph(corpora.frame(spark, rows))
    assert set(hits.columns) == {"edge", "doc_id", "mark", "pos", "first"}
    text = {(r.doc_id, r.mark): corpora.words(r.text) for r in debruijn._texts(corpora.frame(spark, rows)).collect()}
    found = {}
    for r in edges.collect():
        w = tuple(text[r.source, r.source_mark][r.at : r.at + 13])
        assert w not in found and len(w) == 13
        found[w] = r.a, r.b
    ends = {(w[k : k + 12], v[k]) for w, v in found.items() for k in (0, 1)}
    assert len(ends) == len({x for x, _ in ends}) == len({x for _, x in ends})
    first, last = {}, {}
    for i, t, *_ in {r for r in rows if r[0] is not None and r[1]}:
        w = corpora.words(t)
        for j in range(len(w) - 12):
            e = tuple(w[j : j + 13])
            first[e], last[e] = min(i, first.get(e, i)), max(i, last.get(e, i))
    # of copies only the first goes on, so an edge of copies alone is none
    assert found and set(found) <= {e for e in first if first[e] < last[e]}


def unitigs(rows):
    """Lengths of the nonbranching paths of the graph of windows met in two documents, by walking it."""
    met = {}
    for i, t, *_ in rows:
        w = corpora.words(t)
        for j in range(len(w) - 12):
            met.setdefault(tuple(w[j : j + 13]), set()).add(i)
    edges = {e for e, d in met.items() if len(d) > 1}
    out, into = {}, {}
    for e in edges:
        out.setdefault(e[:-1], []).append(e)
        into.setdefault(e[1:], []).append(e)
    after = lambda e: out[e[1:]][0] if len(out.get(e[1:], [])) == 1 == len(into[e[1:]]) and out[e[1:]][0] != e else None
    ahead = {after(e) for e in edges}
    lengths = []
    for e in edges - ahead:
        n, seen = 1, {e}
        while (e := after(e)) and e not in seen:
            seen.add(e)
            n += 1
        lengths.append(n)
    return lengths


def test_paths_of_a_branching_graph(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [f"{a} {b}", f"{a} {c}", f"{d} {a} {b}", f"{d} {c}", f"{b} {d}", f"{c} {d} {a}", b, f"x {a} {c} y"]
    # the later half of a path has its source in another document than the first half
    rows += [f"{a[:60]} 1", f"2 {a[-70:]}", " ".join(f"e{k}" for k in range(20)), *[" ".join(f"e{k}" for k in range(60))] * 2]
    rows = [(k, t, None, None, 0) for k, t in enumerate(rows)]
    found = debruijn.paths(corpora.frame(spark, rows)).collect()
    assert Counter(r.n_edges for r in found) == Counter(unitigs([(r[0], r[1]) for r in rows[:-1]]))
    assert max(r.n_pieces for r in found) > 1
    assert Counter(tuple(r) for r in debruijn.digest(corpora.frame(spark, rows)).collect()) == Counter(brute10(rows))


def test_align_is_a_common_subsequence():
    assert line_align.align([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_align.align([1, 1, 2], [1, 1, 1, 2]) == [(0, 0), (1, 1), (2, 3)]
    assert line_align.align([], [1]) == []
    assert line_align.common_lines([1, 2, 3], [3, 1, 2], [9, 5, 4]) == [1, 2]


def blocks7(rows):
    """For each row the lines that lie in a run of lines of 8 words or more which an earlier document has too: every pair of
    documents, every run; nothing of line_align."""
    out = []
    for i, t, *_ in rows:
        lines, gone = [] if t is None else t.split("\n"), set()
        size = [len(corpora.words(x)) for x in lines]
        for p, other, *_ in rows:
            if None in (i, p, t, other) or p >= i:
                continue
            theirs = other.split("\n")
            for a in range(len(lines)):
                for b in range(len(theirs)):
                    if lines[a] == theirs[b] and (not a or not b or lines[a - 1] != theirs[b - 1]):
                        k = 0
                        while a + k < len(lines) and b + k < len(theirs) and lines[a + k] == theirs[b + k]:
                            k += 1
                        if sum(size[a : a + k]) >= 8:
                            gone |= set(range(a, a + k))
        out.append((i, lines, gone))
    return out


def plain7(rows):
    return [(i, len(lines), len(gone), hashlib.sha256("\n".join(x for j, x in enumerate(lines) if j not in gone).encode()).hexdigest()) for i, lines, gone in blocks7(rows)]


def test_op7(spark):
    rows = corpora.sample(4, 80)
    got = [tuple(r) for r in line_align.digest(corpora.frame(spark, rows)).collect()]
    want = plain7(rows)
    assert Counter(got) == Counter(want) and sum(r[2] for r in got) > 50
    more = rows + [(None, rows[0][1], None, None, 0), (0, rows[0][1], None, None, 0)]
    kept = line_align.apply(corpora.frame(spark, more)).collect()
    assert Counter(r.doc_id for r in kept)[None] == 1 and Counter(r.doc_id for r in kept)[0] == 2
    assert line_align.digest(corpora.frame(spark, [])).count() == 0


def test_op7_blocks_of_several_documents(spark):
    """Rare keys pair all holders, frequent ones the earliest; every line of a common block has a partner."""
    x, y, z = "one two three four", "five six seven eight", "nine ten"
    rows = [x, y, f"{x}\n{y}\n{z}", f"a\n{x}\n{y}\nb", f"c\n{x}\n{y}\n{z}\nd", f"{x} more\n{z}", *[f"head {k}\n{x}\n{y}\n{z}\ntail {k}" for k in range(30)], f"{y}\n{z}\n{z}\n{x}\n{x}"]
    rows = [(k, t, None, None, 0) for k, t in enumerate(rows)]
    assert Counter(tuple(r) for r in line_align.digest(corpora.frame(spark, rows)).collect()) == Counter(plain7(rows))


def test_op7_lines_of_equal_polynomials(spark):
    w = "a"
    while len(w) < 2048:
        w += w.translate({97: 98, 98: 97})
    u, tail = w.translate({97: 98, 98: 97}), " two three four five six seven eight nine"
    rows = [(k, t, None, None, 0) for k, t in enumerate([w + tail, u + tail, f"x\n{u}{tail}"])]
    assert [r.n_removed for r in sorted(line_align.digest(corpora.frame(spark, rows)).collect())] == [0, 0, 1]


def test_op7_clashing_columns(spark):
    rows = corpora.sample(4, 30)
    names = ["gone", "_d", "_m", "mark", "_row", "hit", "n_lines", "d", "row", "Gone "]
    from pyspark.sql import functions as F

    docs = corpora.frame(spark, rows)
    wide = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    out = line_align.apply(wide)
    assert out.columns == wide.columns
    plain = {(r.doc_id, r.text) for r in line_align.apply(docs).collect()}
    got = out.collect()
    assert {(r.doc_id, r.text) for r in got} == plain and all(r["gone"] == f"gone{r.doc_id}" for r in got)


def heaviest(a, b, words, least):
    """Most words of b in ascending common blocks of `least` words or more, by trying every block; nothing of line_align."""
    from functools import cache

    @cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        out, k, total = max(best(i + 1, j), best(i, j + 1)), 0, 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            total, k = total + words[j + k], k + 1
            if total >= least:
                out = max(out, total + best(i + k, j + k))
        return out

    return best(0, 0)


def test_gaps_without_unique_lines(monkeypatch):
    import random

    assert line_align.common_lines(list("hPmPt"), list("aPb"), [1, 60, 1]) == [1]
    assert line_align.common_lines(list("hPt"), list("aPbPc"), [1, 60, 1, 60, 1]) in ([1], [3])
    assert len(line_align.align(list("hABmBAt"), list("aBABAb"))) == 3
    r = random.Random(5)
    for k in range(600):
        monkeypatch.setattr(line_align, "DENSE", 0 if k % 3 == 0 else 1 << 24)
        size = {x: r.choice([0, 1, 3, 4, 9]) for x in "ABCD"}
        a, b = (["<" + s, *(r.choice("ABCD") for _ in range(r.randint(8, 14))), ">" + s] for s in "ab")
        a[1:1] = b[1:1] = "ABCD"  # every common line twice or more
        a[1:1], b[1:1] = ["-"], ["+"]
        a[-1:-1], b[-1:-1] = "DCBA", "DCBA"
        w = [size.get(x, 1) for x in b]
        gone = line_align.common_lines(a, b, w)
        assert sum(w[q] for q in gone) == heaviest(a, b, w, 8)


def test_op7_repeated_passage(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"head\n{passage}\nmiddle\n{passage}\ntail", f"other\n{passage}\nend", f"x\n{passage}\ny\n{passage}\nz"]
    out = {r.doc_id: r.n_removed for r in line_align.digest(corpora.frame(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)])).collect()}
    assert out == {0: 0, 1: 1, 2: 2}


def test_op7_links_by_runs(spark):
    """Copies whose lines are short, or have other earlier holders, meet the document that holds the run."""
    x, y, short = "one two three four", "five six seven eight", "\n".join(f"a{k} b{k}" + f" c{k}\n" * (k % 3) for k in range(30))
    texts = [x, y, f"{x}\n{y}", f"{x}\n{y}", f"{x}\n\n{y}", f"{x}\n\n{y}", f"head\n{short}", f"other\n{short}\nend", "a b c\nd e f", "a b c\nd e f"]
    out = {r.doc_id: r.n_removed for r in line_align.digest(corpora.frame(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)])).collect()}
    assert out == {0: 0, 1: 0, 2: 0, 3: 2, 4: 0, 5: 3, 6: 0, 7: len(short.split("\n")), 8: 0, 9: 0}


def test_op7_any_number_of_holders(spark):
    """Moved blocks and blank lines go alike, whether eight documents hold them or twelve; rare or not."""
    x, y = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen sixteen"
    for holders in (8, 12, 30):
        rows = [(0, f"{y}\n{x}", None, None, 0)] + [(k, f"{x}\n{y}\nonly {k}", None, None, 0) for k in range(1, holders)]
        out = {r.doc_id: r.n_removed for r in line_align.digest(corpora.frame(spark, rows)).collect()}
        assert out == {0: 0} | {k: 2 for k in range(1, holders)}
    short, tail = "a b c\n\nd e f\n\ng h i", "j k l\nm n"
    texts = [short, f"{tail}\n\n{short}", f"{short}\n\n\n{tail}", *[f"{tail}\n{short}\n\nz {k % 3}\n{tail}\nx" for k in range(14)], f"\n\n{tail}\n{short}\n\n", f"{x}\n\n\n", f"\n\n{x}\n\n", f"\n{x}\n"]
    rows = [(k, t, None, None, 0) for k, t in enumerate(texts)]
    assert Counter(tuple(r) for r in line_align.digest(corpora.frame(spark, rows)).collect()) == Counter(plain7(rows))


def test_op7_shuffled_lines(spark):
    """Many holders, every order of lines, blanks between them: what each loses is what all pairs and all runs tell."""
    import random

    r = random.Random(11)
    lines = ["", "", "a b", "c d e", "f g h i", "j k l m n", "o p q r s t u v", "w x y z a b c d e"]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(1, 14))), None, None, 0) for k in range(60)]
    assert Counter(tuple(x) for x in line_align.digest(corpora.frame(spark, rows)).collect()) == Counter(plain7(rows))
    for _ in range(300):
        a, b = ([r.choice(lines) for _ in range(r.randint(1, 12))] for _ in "ab")
        gone = line_align.deleted_lines(a, b, [len(x.split()) for x in b], cells=r.choice([0, 1 << 20]))
        assert gone == sorted(blocks7([(0, "\n".join(a)), (1, "\n".join(b))])[1][2])


def test_python_gets_small_batches_and_a_source_once(spark):
    """Texts go to Python in batches of some megabytes; a source with many pieces is sent with the list of them, not once for each."""
    from folio.llm import common

    def sizes(frames):
        for part in frames:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([part.nbytes])], ["n", "size"])

    spark.conf.unset(common.ARROW_KEY)
    docs = spark.range(0, 4000, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", F.expr("repeat('word ', 2000)"))
    debruijn._scan(docs)
    found = docs.mapInArrow(sizes, "n long, size long").collect()
    spark.conf.unset(common.ARROW_KEY)
    assert sum(r.n for r in found) == 4000 and max(r.size for r in found) < 2 * common.ARROW_BYTES

    text = {1: " ".join(f"a{i}" for i in range(900)), 2: "b " * 40, 3: "\n".join(f"c{i}" for i in range(60))}
    docs = spark.createDataFrame([*text.items(), (1, text[1]), (4, None)], "doc_id long, text string")
    want = {(1, at, n): text[1].split()[at : at + n + debruijn.K - 1] for at, n in [(5 * k, k % 4 + 1) for k in range(150)]}
    want |= {(3, at, n): text[3].split()[at : at + n + debruijn.K - 1] for at, n in [(0, 1), (7, 41)]}
    marks = {r.doc_id: r.mark for r in debruijn._texts(docs).collect()}
    pieces = spark.createDataFrame([(d, marks[d], at, n) for d, at, n in want], "source long, source_mark long, piece int, n_edges int")
    words = debruijn._piece_words(pieces, docs)
    got = {(r.source, r.piece): r.words.decode().split(" ") for r in words.collect()}
    assert words.count() == len(want) and got == {(d, at): w for (d, at, _), w in want.items()}
