import inspect
import math
import zlib
from collections import Counter
from fractions import Fraction

import corpora
import numpy as np
import public_tokenizers
from test_jaccard import brute
from test_overlap import blocks7
from tokenizers import Tokenizer

import corpus_pipeline as cp
from folio.llm import jaccard, packing


def key(r):
    return r.doc_id, r.text, r.lang, r.source, r.n_chars


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage's rows from what the stage before kept, by plain readings of its contract."""
    rows = [(i, t, "en" if i % 2 else "fr", s, n) for i, t, _, s, n in corpora.sample(6, 60)] + [(900, "12 34 !", "en", "s1", 0), (901, None, "en", "s1", 0)]
    docs = corpora.frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, given = spark.read.parquet(str(tmp_path / "documents.parquet")), rows
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        if k < len(cp.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            lettered = [r for r in given if r[1] and any(c.isalpha() for c in r[1])]
            assert set(map(key, got)) <= set(lettered) and len(got) >= 0.9 * len(lettered)
        elif name == "line_dedup":
            want = Counter()
            for r, (_, lines, gone) in zip(given, blocks7(given), strict=True):
                text = "\n".join(x for j, x in enumerate(lines) if j not in gone)
                if not gone or corpora.words(text):
                    want[(r[0], text, *r[2:])] += 1
            assert Counter(map(key, got)) == want and len(want) < len(given)
        elif name == "near_duplicates":
            kept = {c for _, n, c in brute(given, 5, Fraction(4, 5)) if n}
            assert Counter(map(key, got)) == Counter(r for r in given if r[0] in kept or not corpora.words(r[1])) and len(kept) <= len(given)
        elif name == "mix":
            size, taken = Counter(), Counter()
            for r in given:
                size[r[3]] += len(corpora.words(r[1]))
            for r in got:
                taken[r.source] += len(corpora.words(r.text))
            most = Counter(map(key, got))
            assert set(most) <= set(given) and max(most.values()) <= 2
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= sum(max(len(corpora.words(r[1])) for r in given if r[3] == s) for s in size)
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            ids = {r[:2]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1] for r in given}
            by_id = {}
            for (doc_id, _), own in ids.items():
                by_id.setdefault(doc_id, own)
            assert sum(r.length for r in got) == sum(len(ids[r[:2]]) for r in given)
            for r in got:
                own = by_id[r.doc_id][r.start : r.start + r.length]
                assert zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
            windows = {r.sequence_id for r in got}
            assert len(windows) <= math.ceil(sum(r.length for r in got) / packing.CAPACITY) + 2
        given = [tuple(key(r)) for r in got] if k < len(cp.STAGES) - 1 else None


def test_run_is_the_stages(spark, tmp_path):
    rows = [(i, t, "en" if i % 2 else "fr", s, n) for i, t, _, s, n in corpora.sample(7, 40)]
    corpora.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
    pieces = lambda df: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(cp.run(spark, str(tmp_path))) == pieces(docs)
    corpora.frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, None, None, 0), (2, text, None, None, 0), (3, text + " more", None, None, 0), (4, "", None, None, 0), (5, None, None, None, 0), (1, text, None, None, 0), (6, "alone", None, None, 0)]
    kept = jaccard.apply(corpora.frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in kept) == {1: 1, 4: 1, 5: 1, 6: 1}


def test_batches_are_bounded_by_bytes(spark):
    """The stages send long texts to Python in batches of some megabytes, not 10,000 rows at once; a longer row comes alone."""
    import pyarrow as pa

    from folio.llm import common, jaccard, language, line_align, packing

    def sizes(frames):
        for part in frames:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([part.nbytes])], ["n", "size"])

    docs = spark.range(0, 6000, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", F.expr("repeat('word ', if(doc_id = 17, 2000000, 1000))"))
    for module, start in ((jaccard, lambda: jaccard._heads(docs, 5, Fraction(4, 5))), (language, lambda: language.predict(docs, None)), (line_align, None), (packing, None)):
        assert ".mapInArrow(" not in inspect.getsource(module)
        if start:
            spark.conf.unset(common.ARROW_KEY)
            start()
            found = docs.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in found) == 6000
            assert max(r.size for r in found if r.size < 9_000_000) < 2 * common.ARROW_BYTES and sum(r.size >= 9_000_000 for r in found) == 1
    spark.conf.set(common.ARROW_KEY, "1m")
    language.predict(docs, None)
    assert spark.conf.get(common.ARROW_KEY) == "1m"  # a session's own number stands
    spark.conf.unset(common.ARROW_KEY)
