"""Every operator on tables that are empty, repeat rows, lack ids and texts, hold one very long text, or name their columns like
the operator's own helpers."""

from collections import Counter

import corpora
import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from folio.llm import debruijn, fim, jaccard, language, line_align, maxent, mixing, packing, quality, queries, transport, vbyte

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LABELS = "doc_id long, quality int, toxic int"
DIGESTS = {
    "op1": transport.digest,
    "op2": lambda d: packing.pack(d, WORD),
    "op3": jaccard.digest,
    "op4": mixing.digest,
    "op5": maxent.score,
    "op6": lambda d: quality.digest(d, d.sparkSession.createDataFrame([(1, 1, 0), (None, None, None)], LABELS)),
    "op7": line_align.digest,
    "op8": language.digest,
    "op9": lambda d: vbyte.digest(d, BYTE),
    "op10": debruijn.digest,
    "op13": fim.digest,
}
STAGES = {"language": language.apply, "line_dedup": line_align.apply, "near_duplicates": jaccard.apply, "mix": mixing.apply, "fill_in_middle": fim.apply}
#: What the operators call their own columns, in some step or other.
HELPERS = ["_row", "mark", "gone", "hit", "d", "m", "s", "k", "n", "row", "at", "first", "key", "cls", "region", "set", "head", "root", "size", "base", "extra", "copies", "copy", "part", "_part", "_n", "_c", "_d", "_k", "letters", "lang_pred", "score", "c0", "c1", "_h", "_r", "h", "stratum", "edge", "pos", "sha", "seeds", "piece", "start", "length", "ids", "kept", "n_words", "component_id", "Text2"]


def awkward():
    long = " ".join(f"word{k % 9000}" for k in range(700_000))  # over 5 MB
    rows = corpora.sample(3, 14)
    rows += [(None, "no id here at all", "en", "s1", 1), (None, "no id here at all", "en", "s1", 1), (None, None, None, None, None)]
    rows += [(2, rows[2][1], "en", "s1", 1)] * 3 + [(2, "the same id with another text", "fr", "s2", 1), (500, long, "en", "s1", 1), (501, long, "en", "s1", 1)]
    return rows


@pytest.mark.parametrize("name", DIGESTS)
def test_digest(spark, name):
    assert DIGESTS[name](corpora.frame(spark, [])).count() == 0
    rows = awkward()
    docs = corpora.frame(spark, rows)
    wide = docs.select("*", *[F.lit("x").alias(c) for c in HELPERS])
    got = DIGESTS[name](wide).collect()
    ids = Counter(r.doc_id for r in got)
    if name == "op2":
        assert set(ids) == {r[0] for r in rows} and sum(r.length for r in got if r.start + r.length == r.doc_tokens) >= len(rows)
    else:
        assert ids == Counter(r[0] for r in rows)
    if name in ("op1", "op7", "op10", "op13"):  # equal rows, equal results
        assert len({tuple(r) for r in got if r.doc_id is None}) == 2


@pytest.mark.parametrize("name", STAGES)
def test_stage(spark, name):
    empty = corpora.frame(spark, [])
    assert STAGES[name](empty).columns == empty.columns and STAGES[name](empty).count() == 0
    rows = awkward()
    docs = corpora.frame(spark, rows)
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in HELPERS])
    out = STAGES[name](wide)
    assert out.columns == wide.columns
    for r in out.select("doc_id", *[c for c in HELPERS]).collect():
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in HELPERS)
    plain = Counter(r.doc_id for r in STAGES[name](docs).select("doc_id").collect())
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == plain and set(plain) <= {r[0] for r in rows}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    """Registered queries against their SQL on DuckDB."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    df = queries.queries()[name](spark, sf)
    show = lambda r: tuple(round(r[k], 3) if isinstance(r[k], float) else r[k] for k in sorted(names))
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(show, df.collect())) == Counter(show(dict(zip(names, r, strict=True))) for r in want.fetchall())
