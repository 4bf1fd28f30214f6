import math
import zlib
from collections import Counter

import corpora
import numpy as np
import pyarrow as pa

from folio.llm import language, maxent
from folio.llm.words import Texts


def held(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_op5_base(spark):
    rows = corpora.sample(n=50) + [(None, "no id", None, None, 0)]
    toks = {k: [x.translate({c: c + 32 for c in range(65, 91)}) for x in corpora.words(r[1])] + [None] for k, r in enumerate(rows)}
    seen = Counter(t for k, r in enumerate(rows) if r[0] is not None and held(r[0], 7) != 2 for t in toks[k])
    total, v = sum(seen.values()), len(seen)
    got = {r.doc_id: r for r in maxent.score(corpora.frame(spark, rows)).collect()}
    for k, row in enumerate(rows):
        r = got[row[0]]
        assert r.held_out == (row[0] is not None and held(row[0], 7) == 2) and r.train_tokens == total
        assert (r.n_tokens, r.n_known) == (len(toks[k]), sum(seen[t] > 0 for t in toks[k]))
        assert math.isclose(r.base_score, sum(math.log10((seen[t] + 1) / (total + v + 1)) for t in toks[k]), rel_tol=1e-9)
        assert r.score < 0
    assert maxent.score(corpora.frame(spark, [])).count() == 0


def test_op5_frequent(spark, monkeypatch):
    """Results do not depend on which tokens are looked up; ties at the edge are all left to the join."""
    known = spark.createDataFrame([(i, 0, n) for i, n in enumerate([1000, 90, 90, 7, 7, 7, 1])], "h long, cls int, n long")
    for most, want in ((100, 7), (6, 6), (5, 3), (2, 1), (0, 0)):
        monkeypatch.setattr(maxent, "TOP", most)
        assert sorted(r.h for r in maxent.frequent(known).collect()) == list(range(want))
    rows = corpora.sample(n=30)
    few, all_ = [], []
    for most, out in ((3, few), (1 << 16, all_)):
        monkeypatch.setattr(maxent, "TOP", most)
        out += sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 3)) for r in maxent.score(corpora.frame(spark, rows)).collect())
    assert few == all_


def test_op5_learns(spark):
    rows = [(i, " ".join(f"{'ab' if j % 2 else 'cd'}{(i * 7 + j) % 90}{'xx' if j % 2 else 'yy'}" for j in range(200)), None, None, 0) for i in range(200)]
    out = [r for r in maxent.score(corpora.frame(spark, rows)).collect() if r.held_out]
    assert out and sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_op5_score_by_hand(spark):
    """The log-probability of every text, token by token in plain Python, from the trained weights and the counts alone."""
    docs = corpora.frame(spark, corpora.sample(n=40)).coalesce(1)
    slots = maxent.Slots(maxent.counts(docs))
    plan = maxent.Plan(slots.total)
    w = maxent.train(docs, slots, plan).astype(float)
    classes, inner = w[: plan.rows], w[plan.rows :]
    place = {int(h): (int(s), int(n)) for h, s, n in zip(slots.h, slots.slot, slots.n, strict=True)}

    def share(table, at, k):
        x = [sum(table[i][j] for i in [*at, -1]) for j in range(table.shape[1])]
        return math.exp(x[k] - max(x)) / sum(math.exp(v - max(x)) for v in x)

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in maxent.score(docs).collect()}
    n_rest, v_rest = slots.rest
    seen = {r.h: r.n for r in maxent.counts(docs).collect()}
    for doc_id in list(texts)[::4]:
        h, cls, first = maxent.tokens(pa.array([texts[doc_id]], pa.string()))
        keys, want = maxent.contexts(h, first), 0.0
        f, g = maxent._rows(keys, plan.bits), maxent.slot_features(keys, cls, plan.bits)
        for t, token in enumerate(h.view(np.int64).tolist()):
            slot = place.get(token, (0, 0))[0]
            want += math.log10(share(classes, f[t], cls[t])) + math.log10(share(inner, g[t], slot))
            if not slot:
                want += math.log10((seen.get(token, 0) + 1) / (n_rest[cls[t]] + v_rest[cls[t]] + 1))
        assert math.isclose(got[doc_id], want, rel_tol=1e-5, abs_tol=1e-4), doc_id


def test_op5_sums_of_segments():
    """Sums of segments of every length, and a gradient step, against plain loops."""
    rng = np.random.default_rng(4)
    n = np.array([2, 3, 700, 4, 5, 2, 31, 32, 33])
    g, order = rng.normal(0, 1, (n.sum() + 9, 32)), rng.permutation(n.sum() + 9)
    first = np.cumsum(n) - n + 4
    assert np.allclose(maxent._sums(g, order, first, n), [g[order[a : a + k]].sum(0) for a, k in zip(first, n, strict=True)])
    for scale in (0.1, 40):  # ordinary weights, and such whose powers leave single floats
        w, f, cls = rng.normal(0, scale, (90, 32)).astype(np.float32), np.minimum(rng.zipf(1.3, (500, 3)) - 1, 88), rng.integers(0, 32, 500)
        own, x = w.copy(), w[f].sum(1).astype(float) + w[-1]
        p = np.exp(x - x.max(1, keepdims=True))
        step = np.eye(32)[cls] - p / p.sum(1, keepdims=True)
        want = w.astype(float)
        want[-1] += maxent.STEP * step.mean(0)
        for k in range(3):
            for key in np.unique(f[:, k]):
                hit = f[:, k] == key
                want[key] += maxent.STEP * step[hit].sum(0) / np.sqrt(hit.sum())
        maxent.learn(own, f, cls)
        assert np.allclose(own, want, rtol=1e-3, atol=1e-3)
        assert np.allclose(maxent.chosen(w, f, cls), maxent.log_softmax(w, f)[np.arange(500), cls], atol=1e-4)


def test_classes_sum_to_one():
    h, cls, first = maxent.tokens(pa.array(["a b c", None, "x"]))
    w = np.random.default_rng(1).normal(0, 1, (maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(maxent.log_softmax(w, maxent.features(h, first))).sum(1), 1, atol=1e-4) and first.tolist() == [0, 4, 5, 7]


def test_gru_gradients():
    """Backpropagation through time against finite differences."""
    model, rng = language.Model(["a", "b", "c"]), np.random.default_rng(3)
    for g in (model.ahead, model.behind):
        g.p = [x.astype(np.float64) for x in g.p]
    model.head = [x.astype(np.float64) for x in model.head]
    data, label = rng.integers(0, 256, (5, 6)).astype(np.int16), np.array([0, 1, 2, 1, 0])
    data[0, 4:] = language.PAD
    _, grads = model.gradients(data, label)
    for p, g in zip(model.parameters(), grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, eps = p[at], 1e-2
        p[at] = old + eps
        up, _ = model.gradients(data, label)
        p[at] = old - eps
        down, _ = model.gradients(data, label)
        p[at] = old
        assert math.isclose((up - down) / (2 * eps), g[at], rel_tol=0.02, abs_tol=1e-5)


def test_stretches_hold_all_bytes():
    rows = ["", "é" * 300, "x", None, "y" * 256, "z" * 257]
    data, used, row = language.stretches(Texts(pa.array(rows)))
    width, warm = language.STRETCH, language.WARM
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        own = data[row == i]
        assert own[:, warm : warm + width].ravel()[: len(raw)].astype(np.uint8).tobytes() == raw and used[row == i].sum() == len(raw)
        for k, line in enumerate(own):
            around = [raw[j] if 0 <= j < len(raw) else language.PAD for j in range(k * width - warm, (k + 1) * width + warm)]
            assert line.tolist() == around


def test_states_are_those_of_the_whole_text():
    """The warm reading of stretches against one step after the other over all of a text, by the plain recurrence: a text of
    one language, and one that changes its language."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    model = language.train([(r["text"][:800], r["lang"]) for r in table[:500]])
    longest = max(table[500:], key=lambda r: len(r["text"]))["text"]
    mixed = " ".join(next(r["text"] for r in table[500 + 7 * k :] if r["lang"] == lang and len(r["text"]) > 700)[:700] for k, lang in enumerate(model.langs * 2))
    for text, mean in ((longest, 0.002), (mixed, 0.02)):
        raw = text.encode()[:12_000].decode("utf-8", "ignore")
        n = len(raw.encode())
        whole, _, _ = language.stretches(Texts(pa.array([raw])), n, 0)
        f, b = (np.stack(g.run(whole, list(order))[0])[:, 0] for g, order in ((model.ahead, range(n)), (model.behind, range(n - 1, -1, -1))))
        logits = np.concatenate([f, b], 1) @ model.head[0] + model.head[1]
        want = np.exp(logits - logits.max(1, keepdims=True))
        want /= want.sum(1, keepdims=True)
        data, used, _ = language.stretches(Texts(pa.array([raw])))
        got = np.concatenate([p[:, :k] for p, k in zip(np.moveaxis(model.positions(data, language.WARM), 2, 0), used, strict=True)], 1).T
        print("difference, most and mean", abs(got - want).max(), abs(got - want).mean())
        assert abs(got - want).mean() < mean and abs(got.mean(0) - want.mean(0)).max() < mean
        assert np.allclose(language.probabilities(model, Texts(pa.array([raw])))[0], got.mean(0), atol=1e-4)
        assert len(language.label_positions(model, raw)) == n


def test_states_without_tanh(monkeypatch):
    """Prediction takes its gates from exp, half as dear as tanh, and has the states of training; shut and open gates too."""
    rng = np.random.default_rng(5)
    gru = language.Gru(rng)
    gru.p[0][:3] *= 500
    data = rng.integers(0, 257, (40, 30)).astype(np.int16)
    data[:, :4] = [0, 1, 2, language.PAD]
    for order in (range(30), range(29, -1, -1)):
        want = gru.run(data, list(order))[0][list(order)]
        with monkeypatch.context() as m:
            m.setattr(np, "tanh", None)
            got = gru.states(data, order)
        assert np.isfinite(got).all() and np.abs(got - want).max() < 1e-5


def test_op8(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = corpora.frame(spark, [(5000, None, "en", None, 0), (5001, "12 !", "en", None, 0), (5002, "", None, None, 0)])
    out = language.digest(docs.unionByName(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    own = [r for r in out if r.doc_id < 5000]
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in out if r.doc_id >= 5000) and len(out) == len(own) + 3
    assert all(0 <= r.score <= 1 and r.held_out == (held(r.doc_id, 5) == 0) for r in out)
    test = [r for r in own if r.held_out]
    accuracy = sum(r.lang_pred == r.lang for r in test) / len(test)
    print("held-out accuracy", accuracy)
    assert accuracy > 0.9
    assert language.digest(corpora.frame(spark, [])).count() == 0
    model = language.train([("the cat and", "en"), ("le chat et", "fr")] * 5)
    assert len(language.label_positions(model, "le chat é")) == 10


def test_op5_context_tells_tokens_of_one_class(spark):
    """30 tokens of one class, each told by the token before it, which is one of 30 at random."""
    import random

    r = random.Random(3)
    rows = [(i, " ".join(f"c{k}qq x{k}ft" for k in (r.randrange(30) for _ in range(150))), None, None, 0) for i in range(800)]
    out = [r for r in maxent.score(corpora.frame(spark, rows).coalesce(1)).collect() if r.held_out]
    # at least log10(30) / 2 = 0.74 a token; twice that without context inside the class
    assert out and -sum(r.score for r in out) / sum(r.n_tokens for r in out) < 1.2


def test_op5_slots_are_a_distribution(spark):
    known = maxent.counts(corpora.frame(spark, corpora.sample(n=40)))
    slots = maxent.Slots(known)
    own = {(r.cls, int(s)): n for r, s, n in ((r, *(x[0] for x in slots.find(np.array([r.h]).view(np.uint64)))) for r in known.collect()) if s}
    assert len(own) == len(slots.h) > 100 and all(n > 0 for n in own.values())
    keys, cls = [np.arange(50, dtype=np.uint64) for _ in range(3)], np.arange(50) % maxent.CLASSES
    p = np.exp(maxent.log_softmax(slots.start(), maxent.slot_features(keys, cls)))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    assert all(p[k, s] < 1e-9 for k, c in enumerate(cls) for s in range(1, maxent.SLOTS) if (c, s) not in own)


def test_op5_grows_with_the_input():
    sizes = [maxent.Plan(n) for n in (0, 10**6, 10**8, 10**10)]
    assert (sizes[0].bits, sizes[0].rounds, sizes[0].rows, sizes[0].slot_rows) == (maxent.BITS, maxent.ROUNDS, maxent.ROWS, maxent.SLOT_ROWS)
    assert sizes[1].rows < sizes[2].rows < sizes[3].rows and sizes[1].tasks < sizes[2].tasks < sizes[3].tasks and sizes[1].rounds < sizes[2].rounds < sizes[3].rounds
    h, cls, first = maxent.tokens(pa.array(["a b c", None, "x"]))
    keys = maxent.contexts(h, first)
    for plan in sizes:
        f, g = maxent._rows(keys, plan.bits), maxent.slot_features(keys, cls, plan.bits)
        assert 0 <= f.min() and f.max() < plan.rows - 1 and 0 <= g.min() and g.max() < plan.slot_rows - 1


def test_op5_rare_weights_keep_their_update():
    """A weight that one task of many touched keeps its whole change."""
    total = np.array([[0.5 * 3, -0.5 * 3, 3], [0.0, 0.0, 0], [1.0 * 2 + 4.0 * 6, 0.0, 8]], np.float32)
    assert np.allclose(maxent.averaged(total), [[0.5, -0.5], [0, 0], [3.25, 0]])


def test_op5_trains_with_wider_features(spark, monkeypatch):
    monkeypatch.setattr(maxent, "LEAST", 1 << 10)
    rows = [(i, " ".join(f"{'ab' if j % 2 else 'cd'}{(i * 7 + j) % 90}{'xx' if j % 2 else 'yy'}" for j in range(200)), None, None, 0) for i in range(200)]
    out = [r for r in maxent.score(corpora.frame(spark, rows)).collect() if r.held_out]
    assert maxent.Plan(34_000).bits[0] == 15 and out and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op8_learns_every_language(spark):
    rows = [(k, f"text of number {k % 80}", f"l{k % 80:02}", None, 0) for k in range(400)]
    assert language.fit(corpora.frame(spark, rows)).langs == [f"l{k:02}" for k in range(80)]


def test_op8_many_labels(spark, monkeypatch):
    """A column of a hundred thousand labels trains the most frequent ones."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(language, "LANGS", 3)
    odd = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("noise of some kind").alias("text"), F.concat(F.lit("x"), "id").alias("lang"))
    own = spark.range(200_000, 200_600).select(F.col("id").alias("doc_id"), F.concat(F.lit("a text "), "id").alias("text"), F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de")), (F.col("id") % 3 + 1).cast("int")).alias("lang"))
    assert language.fit(own.unionByName(odd)).langs == ["de", "en", "fr"]


def test_op8_repeated_rows(spark):
    """Thousands of rows of one id, and one rare language beside them, in training."""
    from pyspark.sql import functions as F

    for doc_id in (1, 7):
        own = spark.range(30_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_chars"))
        model = language.fit(own.unionByName(corpora.frame(spark, [(3, "un texte rare", "fr", None, 0)])))
        assert held(doc_id, 5) == 0 or model.langs == ["en", "fr"]
    alike = spark.range(30_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    assert language.fit(alike).langs == ["en"]


def test_op8_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = corpora.frame(spark, [(k, "the cat and the dog" if k % 2 else "le chat et le chien", "en" if k % 2 else "fr", None, 0) for k in range(60)] + [(99, None, "en", None, 0)])
    wide = docs.select("*", *[F.lit(c).alias(c) for c in ("lang_pred", "score", "letters", "_letters", "c0", "c1", "_h")])
    kept = language.apply(wide)
    assert kept.columns == wide.columns and {r.doc_id for r in kept.collect()} == set(range(60))
    assert all(r["score"] == "score" and r["c0"] == "c0" and r["lang_pred"] == "lang_pred" for r in kept.collect())
