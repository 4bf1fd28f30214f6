import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpora
import pytest
from pyspark.sql import functions as F

from folio.llm import mixing, quality, transport


@pytest.mark.parametrize("n", [0, 1, 575, 1151, 1152, 1153, 8 * 1152, 40_001])
def test_stream_round_trip(n):
    payload = bytes(i * 7 % 256 for i in range(n))
    media = transport.encode(payload)
    back = transport.decode(media)
    assert back["payload"] == payload and not back["errors"] and len(media) % 188 == 0
    assert back["rap"] == list(range(0, back["units"], transport.RAP_EVERY))
    assert back["pts"] == [k * transport.CLOCK_STEP for k in range(back["units"])]


def test_stream_damage_is_told():
    media = transport.encode(bytes(5000))
    lost = transport.decode(media[: 188 * 4] + media[188 * 5 :])
    assert lost["lost"] == 1 and "continuity" in lost["errors"] and len(lost["payload"]) < 5000
    assert transport.decode(b"")["errors"] == ["no program"]
    assert "bad packet" in transport.decode(b"x" * 376)["errors"]
    assert "partial packet" in transport.decode(media[:-1])["errors"]


def packets(pid, body, first=0, start=True, flags=0):
    """Transport packets of one unit or section, stuffed by adaptation fields."""
    out, k = b"", 0
    while body or not k:
        room = 184 if not (flags and not k) else 182
        part, body = body[:room], body[room:]
        field = b""
        if len(part) < 184:
            n = 183 - len(part)
            field = bytes([n]) + (bytes([flags if not k else 0]) + b"\xff" * (n - 1) if n else b"")
        out += bytes([0x47, (0x40 if start and not k else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | (first + k) % 16]) + field + part
        k += 1
    return out


def unit(data, sized=True, pts=None):
    stamp = bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254]) if pts is not None else b""
    size = len(data) + 3 + len(stamp) if sized else 0
    return b"\0\0\1\xbd" + size.to_bytes(2, "big") + bytes([0x80, 0x80 if stamp else 0, len(stamp)]) + stamp + data


def two_programs():
    """Program 1 with a table of 60 streams over several packets, program 2 with one stream; units of all kinds."""
    pat = transport._section(0, 1, bytes([0, 0, 0xE0, 16, 0, 1, 0xF0, 0, 0, 2, 0xF0, 1]))
    many = b"".join(bytes([6, 0xE1 + k // 200, k % 200, 0xF0, 2, 9, 9]) for k in range(60))
    one = transport._section(2, 1, bytes([0xE1, 0, 0xF0, 0]) + many)
    two = transport._section(2, 2, bytes([0xE3, 0, 0xF0, 0, 27, 0xE3, 0, 0xF0, 0]))
    a, b = [bytes([k]) * (300 + 10 * k) for k in range(5)], [bytes([200 + k]) * 700 for k in range(3)]
    out, at, bt = packets(0, b"\0" + pat) + packets(0x1000, b"\0" + one) + packets(0x1001, b"\0" + two), 0, 0
    for k in range(5):
        own = packets(0x100, unit(a[k], sized=k % 2 == 0, pts=None if k == 1 else 90 * k), at)
        out, at = out + own, at + len(own) // 188
        if k < 3:
            own = packets(0x300, unit(b[k], sized=False), bt)
            out, bt = out + own, bt + len(own) // 188
    return out, b"".join(a), b"".join(b)


def test_stream_of_two_programs():
    media, a, b = two_programs()
    got = transport.decode(media)
    assert got["payload"] == a and got["pts"] == [0, None, 180, 270, 360] and not got["errors"] and len(got["streams"]) == 61
    other = transport.decode(media, 60)
    assert other["payload"] == b and other["pts"] == [None] * 3 and other["streams"][60] == {"program": 2, "pid": 0x300, "kind": 27}
    assert transport.decode(media, 61)["errors"] == ["no stream"]


def test_stream_repeats_and_announced_jumps():
    media, a, _ = two_programs()
    parts = [media[k : k + 188] for k in range(0, len(media), 188)]
    twice = b"".join(x + x for x in parts)
    assert (transport.decode(twice)["payload"], transport.decode(twice)["lost"]) == (a, 0)
    own = packets(0x100, unit(b"q" * 50, pts=1), 9, flags=0x80)
    jumped = transport.decode(media + own)
    assert jumped["payload"] == a + b"q" * 50 and not jumped["errors"]
    told = transport.decode(media + packets(0x100, unit(b"q" * 50, pts=1), 9))
    assert told["lost"] == 1 and told["payload"].endswith(b"q" * 50)


def test_stream_damage_never_raises():
    """Bits, packets and stretches lost, moved or overwritten: what comes back is whole units, and nothing is raised."""
    import random

    r = random.Random(7)
    plain = transport.encode(bytes(r.randrange(256) for _ in range(6000)))
    for media, whole in ((plain, transport.decode(plain)["payload"]), two_programs()[:2]):
        for _ in range(400):
            raw = bytearray(media)
            for _ in range(r.randint(1, 6)):
                kind, at = r.randrange(4), r.randrange(max(1, len(raw)))
                if kind == 0 and raw:
                    raw[at % len(raw)] = r.choice([0, 255, 71, r.randrange(256)])
                elif kind == 1:
                    del raw[at // 188 * 188 : at // 188 * 188 + 188]
                elif kind == 2:
                    del raw[at : at + r.randrange(300)]
                else:
                    raw[at:at] = raw[at // 188 * 188 : at // 188 * 188 + 188]
            got = transport.decode(bytes(raw))
            assert len(got["payload"]) <= len(whole) + 188 * 8
    lone = bytes([0x47, 0x41, 0, 0x10]) + b"\0\0\1\xbd\0\3\x80\x80\xff" + b"\xff" * 175  # a header said to be longer than its unit
    assert "broken unit" in transport.decode(plain[:376] + lone)["errors"]


def test_op1_awkward_tables(spark):
    from pyspark.sql import functions as F

    rows = [(None, "no id", None, None, 0), (1, "twice", None, None, 0), (1, "twice", None, None, 0), (2, "é" * 3_000_000, None, None, 0)]
    docs = corpora.frame(spark, rows)
    got = transport.digest(docs).collect()
    assert Counter(r.n_bytes for r in got) == Counter(len(t.encode()) for _, t, *_ in rows)
    assert transport.digest(corpora.frame(spark, [])).count() == 0
    wide = docs.filter("doc_id = 1").select(F.encode("text", "UTF-8").alias("payload"), F.lit(5).alias("units"), F.lit("x").alias("other"), F.lit(b"m").alias("media"))
    back = transport.demux(transport.mux(wide).drop("payload")).collect()
    assert [(bytes(r.payload), r.units, r.other) for r in back] == [(b"twice", 1, "x")] * 2


def test_op1(spark):
    rows = corpora.sample()
    got = {r.doc_id: r for r in transport.digest(corpora.frame(spark, rows)).collect()}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (576 if not raw else 0))
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        assert r.media_sha256 == hashlib.sha256(transport.encode(payload)).hexdigest() and r.feature.endswith("errors=")


def test_op4(spark):
    rows = corpora.sample(n=400)
    rows += [(7, "same words here", None, "s9", 1)] * 41
    got = mixing.digest(corpora.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    again = mixing.digest(corpora.frame(spark, rows).repartition(5)).collect()
    assert Counter(got) == Counter(again)
    size = {}
    for i, t, _, s, _ in rows:
        size.setdefault(s, []).append(len(corpora.words(t)))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(map(sum, size.values())), {}
    while True:
        left = total - sum(capped.values())
        rest = [s for s in order if s not in capped]
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 2 * sum(size[s])]
        if not over:
            break
        capped |= {s: 2 * sum(size[s]) for s in over}
    target = {s: capped.get(s, left * weight[s] / max(1, sum(weight[x] for x in rest))) for s in order}
    by_total = {sum(size[s]): s for s in order}
    taken = Counter()
    for r in got:
        s = by_total[r.source_size]
        assert math.isclose(r.target, target[s]) and r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(size[s])
    assert mixing.digest(corpora.frame(spark, [])).count() == 0
    applied = mixing.apply(corpora.frame(spark, rows))
    assert applied.count() == sum(r.taken // r["size"] for r in got if r["size"]) + sum(1 for r in mixing.mix(corpora.frame(spark, rows)).collect() if r["size"] == 0 for _ in range(r.copies))


def base(text):
    w = corpora.words(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many = {g for g, c in Counter(runs).items() if c > 1}
    lines = [x for x in (text or "").split("\n") if corpora.words(x)]
    covered = {i + j for i, g in enumerate(runs) if g in many for j in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_op6(spark):
    rows = corpora.sample(n=80)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for r in quality.digest(corpora.frame(spark, rows), labels).collect():
        want = base(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    assert quality.digest(corpora.frame(spark, []), labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 10, 0.01), (3, 50, 0.1), (5, 900, 0.01), (150, 20_000, 0.01), (9, 10, 0.01), (0, 0, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p).alias("x")).first().x
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)) if n else 1
        assert got == 1.0 if k >= n * p else math.isclose(got, want, rel_tol=1e-9), (k, n, p, got, want)


def test_risk_control(spark):
    """A rule that tells bad from good is adopted at a cutoff that spares the good; one that would reject good ones is not."""
    rows, marks = [], []
    for i in range(4000):
        bad = i % 4 == 0
        rows.append((i, " ".join(("w%d*%%$" if bad else "w%d") % (i * 50 + j) for j in range(30)), "en", "s", 0))
        marks.append((i, int(not bad), 0))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.digest(corpora.frame(spark, rows), labels).collect()}
    assert all(kept[i] == (i % 4 != 0) for i in kept)
    few = spark.createDataFrame(marks[:400], "doc_id long, quality int, toxic int")  # some 150 good ones are put aside
    kept = {r.doc_id: r.kept for r in quality.digest(corpora.frame(spark, rows[:400]), few).collect()}
    assert all(kept[i] == (i % 4 != 0) for i in kept)
    fewer = spark.createDataFrame(marks[:100], "doc_id long, quality int, toxic int")  # fewer than 59
    assert all(r.kept for r in quality.digest(corpora.frame(spark, rows[:100]), fewer).collect())
    mixed = labels.withColumn("quality", (F.xxhash64("doc_id") % 2 == 0).cast("int"))
    assert all(r.kept for r in quality.digest(corpora.frame(spark, rows), mixed).collect())


def test_risk_is_held_over_many_strata(spark):
    """Rules that reject more than RISK of the good documents are allowed in few of many strata, by chance alone."""
    import random

    r = random.Random(4)
    rows, marks = [], []
    for i in range(12_000):
        bad = r.random() < 0.5
        noisy = bad or r.random() < 0.08  # 8 % of the good ones look bad, more than RISK
        rows.append((i, " ".join(("w%d*%%$" if noisy else "w%d") % (i * 50 + j) for j in range(12)), f"l{i % 20}", "s", 0))
        marks.append((i, int(not bad), 0))
    docs, labels = corpora.frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    measured = quality.rules(docs.withColumn("stratum", F.col("lang")), "stratum")
    assert quality.fit(measured, labels).count() <= 1


def test_repeated_ids_give_one_cutoff(spark):
    rows = [(i % 300, ("w%d " % i) * 1 + " ".join(f"x{i * 40 + j}" + "*$" * (i % 3) for j in range(12)), "en", "s", 0) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = corpora.frame(spark, rows)
    got = [Counter(quality.digest(d, labels).collect()) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("text")))]
    assert got[0] == got[1] == got[2]


def test_mixing_clashing_columns_and_repeats(spark):
    rows = [(k % 5, "one two three four" if k % 2 else f"w{k} " * 6, None, "s1" if k < 600 else "s2", k) for k in range(900)] + [(None, None, None, None, 0)] * 3
    names = ["_n", "_size", "_c", "_rsource", "size", "m", "base", "extra", "s", "d", "k", "_row", "part", "copies", "copy", "mark"]
    docs = corpora.frame(spark, rows)
    wide = docs.select("*", *[F.lit(c).alias(c) for c in names])
    out = mixing.apply(wide)
    assert out.columns == wide.columns and all(r["_n"] == "_n" and r["copies"] == "copies" for r in out.collect())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r["size"], r.source] += r.copies
    assert Counter((r.doc_id, len(corpora.words(r.text)), r.source) for r in out.collect()) == +want
    most = Counter((r.doc_id, r.text, r.source, r.n_chars) for r in out.collect())
    assert max(most.values()) <= 2


def test_op4_one_row_repeated(spark):
    """300,000 times one row: counted once, laid out from arrays of SPREAD; repeats differ by one copy at most."""
    many = spark.range(300_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("s").alias("source"))
    few = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("t").alias("source"))
    got = mixing.mix(many.unionByName(few)).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.min("copies").alias("lo"), F.max("copies").alias("hi"), F.min("target").alias("target"))
    got = {r.source: r for r in got.collect()}
    assert got["s"].n == 300_000 and got["t"].n == 100 and got["s"].hi - got["s"].lo <= 1
    assert abs(got["s"].taken - got["s"].target) <= 3 and abs(got["t"].taken - got["t"].target) <= 2
