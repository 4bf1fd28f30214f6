import random
import zlib
from collections import Counter

import corpora
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folio.llm import packing, vbyte
from folio.llm.tokens import Units
from folio.llm.words import Texts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def plain(path, specials_as_text=False):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = specials_as_text
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def texts():
    r = random.Random(3)
    parts = ["a", "Don't", "'s", " ", "  ", "\n", "\t", "\x0b", "\r\n", " ", " ", "é", "é", "12", "<|endoftext|>", "...", "“x”", "😀", "\x1f", "\u0085"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(600)] + [t or "" for _, t, *_ in corpora.sample()]


def thue_morse(n):
    """Two words that a polynomial hash modulo a power of two cannot tell apart."""
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


def same(units, rows, want):
    ids, off = units.encode(Texts(pa.array(rows)))
    for i, text in enumerate(rows):
        assert ids[off[i] : off[i + 1]].tolist() == want(text), repr(text[:200])


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
@pytest.mark.parametrize("specials_as_text", [False, True])
def test_units_equal_plain_encoding(path, spaced, specials_as_text):
    units, want = Units(path, spaced, specials_as_text), plain(path, specials_as_text)
    same(units, texts(), want)
    same(units, ["a  <|endoftext|>  b", "<|endoftext|>", "x<|startoftext|>y <|endoftext", "", "<|endoftext|><|endoftext|>"], want)
    same(units, [*thue_morse(1024), *thue_morse(2048)], want)
    same(units, list(reversed([f"go {w} on" for w in (*thue_morse(1024), *thue_morse(2048))])), want)


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_units_with_equal_hashes(path, spaced, monkeypatch):
    """Hashes that collide all the time cost time, not ids."""
    monkeypatch.setattr(Texts, "hashes", lambda self, starts, ends, which=0: ((ends - starts) % 3).astype(np.uint64))
    units, want = Units(path, spaced), plain(path)
    same(units, texts(), want)
    same(units, texts()[::-1], want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_vbyte_round_trip(values):
    control, data = vbyte.encode(np.array(values, np.uint32))
    assert vbyte.decode(control, data, len(values)).tolist() == values and len(control) == -(-len(values) // 4)


def test_op9(spark):
    rows = corpora.sample() + [(3, "twice", None, None, 0)] + [(None, f"no id {k % 7}", None, None, 0) for k in range(40)]
    want, start = plain(BYTE), 0
    got = sorted(vbyte.digest(corpora.frame(spark, rows), BYTE).collect(), key=lambda r: r.start)
    left = Counter()
    for i, text, *_ in rows:
        ids = [*want(text), 0]
        left[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert [r.doc_id for r in got] == sorted((x[0] for x in rows), key=lambda x: (x is not None, x or 0))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        left[r.doc_id, r.n_tokens, r.ids_crc32] -= 1
    assert not any(left.values())
    assert vbyte.digest(corpora.frame(spark, []), BYTE).count() == 0


def test_op9_one_row_repeated(spark):
    """A row that stands 40,000 times is dealt to several tasks, and ids still follow each other."""
    rows = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("three words here").alias("text"))
    rows = rows.unionByName(corpora.frame(spark, [(9, "last", None, None, 0), (1, "first", None, None, 0)]).select("doc_id", "text"))
    blocks, ranks = vbyte.write(rows, BYTE)
    assert blocks.groupBy("_part").count().count() > 2
    got = sorted(vbyte.digest(rows, BYTE).collect(), key=lambda r: r.start)
    assert [got[0].doc_id, got[-1].doc_id, len(got)] == [1, 9, 40_002]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_fill_is_closest():
    r = random.Random(5)
    for _ in range(200):
        counts = [(k, r.randint(1, 3)) for k in r.sample(range(1, 40), 5)]
        got = packing.fill(counts, 60)
        sums = {0}
        for k, n in counts:
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= 60}
        assert sum(k * m for k, m in got.items()) == max(sums) and all(m <= dict(counts)[k] for k, m in got.items())


def test_op2(spark):
    rows = corpora.sample() + [(3, "twice", None, None, 0), (3, "twice", None, None, 0)]
    want = plain(WORD)
    got = packing.pack(corpora.frame(spark, rows), WORD, capacity=256).collect()
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append([*want(t), 1])
    seen, sequences = 0, {}
    for r in got:
        own = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        seen += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == sum(len(x) for v in ids.values() for x in v)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= -(-seen // 256) + 3
    assert packing.pack(corpora.frame(spark, []), WORD).count() == 0


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, own):
        self.own, self.n = own, 0

    def __getattr__(self, name):
        return getattr(self.own, name)

    def encode_batch_fast(self, texts, **more):
        self.n += len(texts)
        return self.own.encode_batch_fast(texts, **more)


def test_fresh_units_go_to_the_library_together():
    """Not a call for each word; ids are those of plain encoding, also where what tokens spell is told wrongly."""
    r = random.Random(5)
    words = ["".join(r.choice("etaoinshrdlué'’.,7#😀") for _ in range(r.randint(1, 14))) for _ in range(6000)]
    rows = [" " + " ".join(words[i : i + 50]) for i in range(0, 6000, 50)] + texts()
    rows += [" a ", " <|endoftext|>", " <|endoftext|", "|> b", " x　y", "  z", " 's 'll", "  two", " one "]
    units, want = Units(BYTE, True), plain(BYTE)
    units.tokenizer = Counting(units.tokenizer)
    same(units, rows[:120], want)
    assert units.n > 5000 and units.tokenizer.n < 100
    same(units, rows, want)
    wrong = Units(BYTE, True)
    wrong.spelled = np.ones_like(wrong.spelled)
    same(wrong, rows, want)


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_units_at_equal_places(path, spaced, monkeypatch):
    """Units whose places in the table are the same, and a table that grows many times, give the same ids."""
    rows = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(60)]
    units, want = Units(path, spaced), plain(path)
    for row in rows:
        same(units, [row], want)
    same(units, rows[::-1], want)
    monkeypatch.setattr(Units, "_home", lambda self, hashes: np.full(len(hashes), len(self.table) - 2))
    units = Units(path, spaced)
    same(units, rows[:10], want)
    same(units, rows[:20], want)
