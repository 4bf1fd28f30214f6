"""Spelling variant grouping: words one edit apart, found by Aho-Corasick automata of their halves.

If one code point is inserted, deleted or replaced, one half of a word survives as it is: the first half at the other word's
start, or the second half at its end. So:

1. vocabulary() counts all words; a batch of texts gives one row for each distinct word.
2. Every word files its two halves as patterns in shards, by the hash of side and half. As a text it goes to the shards that may
   hold a half which its length allows (two lengths a side), so it is scanned where it can match and nowhere else. A half whose
   texts are too many for one task is filed in several shards, which share them.
3. Each shard builds one automaton of its halves, scans its words once, keeps matches at the start (first halves) or the end
   (second halves) whose word is at most one code point longer or shorter, and verifies the distance.
4. A half that more than CROWD words have would make the pairs of a shard grow with their square. Those words meet by the rest of
   the word with one code point left out, place included where lengths agree: at most as many share such a key as there are
   letters to put in. It costs rows in proportion to the words' length, loses no pair, and the distance is verified too.
5. A word's form is its most frequent near word if that is twice as frequent; roots are found by pointer doubling, in as many
   rounds as the logarithm of the longest chain, which is itself below log2 of the largest count.

Defined results: null and empty texts hold no word; a null doc_id slips nowhere (see `slip`); repeated rows count again; an empty
table, or no frequent word, gives no row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import discard, partitions, save
from folio.llm.words import batches

#: Letters of a word as bytes of UTF-8: A-Z in small letters, and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]+|\xC3[\x80-\xBF])+")
MIN_LETTERS, MIN_COUNT = 5, 3
#: Patterns of one automaton, and texts that one shard scans for one half, about; words that share a half in an automaton at most.
SHARD, TEXTS, CROWD = 8192, 8192, 64


def slipped(run: bytes, doc_id: bytes, slip: int) -> str:
    """The run as a careless writer leaves it: one in `slip` runs of a document lacks a code point."""
    word, h = run.decode(), zlib.crc32(doc_id + b":" + run)
    if h % slip:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(documents: DataFrame, slip: int | None = None, least: int = MIN_COUNT) -> DataFrame:
    """word, n: words of MIN_LETTERS code points and `least` occurrences or more, capitals A-Z as small letters."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames, limit=1 << 22):
            total: Counter = Counter()
            for doc_id, text in zip(part.column(0), part.column(1), strict=True):
                if not text.is_valid:
                    continue
                found = Counter(RUN.findall(text.as_buffer().to_pybytes().lower()))
                if slip and doc_id.is_valid:
                    own = str(doc_id.as_py()).encode()
                    for word, n in found.items():
                        total[slipped(word, own, slip)] += n
                else:
                    for word, n in found.items():
                        total[word.decode()] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    each = documents.select("doc_id", "text").mapInArrow(run, "word string, n long").filter(F.length("word") >= MIN_LETTERS)
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def near(a: str, b: str) -> bool:
    """Whether exactly one code point inserted, deleted or replaced makes b of a."""
    if len(a) < len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a != b and len(a) - len(b) <= 1 and a[at + 1 :] == b[at + (len(a) == len(b)) :]


def _halves() -> Column:
    """side and seg of a word's own two halves."""
    half = F.floor(F.length("word") / 2).cast("int")
    return F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), half).alias("seg")), F.struct(F.lit(1).alias("side"), F.substr("word", half + 1).alias("seg")))


def _allowed() -> Column:
    """side and seg of all halves that a word one code point shorter, as long, or longer may share with this one."""
    n = F.length("word")
    of = lambda k: F.floor((n + k) / 2).cast("int")
    first = [F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), of(k)).alias("seg")) for k in (-1, 0, 1)]
    last = [F.struct(F.lit(1).alias("side"), F.substr("word", n - of(k) + 1).alias("seg")) for k in (0, 1, 2)]
    return F.array_distinct(F.array(*first, *last))


def _sharded(rows: DataFrame, shards: int, texts: int) -> DataFrame:
    """word, other, n of the other: pairs by automata. rows: side, seg, pattern, word, n, texts (that may hold the half)."""
    turns = F.ceil(F.col("texts") / texts).cast("int")
    turn = F.when(F.col("pattern"), F.sequence(F.lit(0), turns - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), turns).cast("int")))
    dealt = rows.select(F.pmod(F.xxhash64("side", "seg"), F.lit(shards)).cast("int").alias("shard"), F.explode(turn).alias("turn"), "pattern", "side", "seg", "word", "n")
    dealt = dealt.repartition(partitions(rows), "shard", "turn").sortWithinPartitions("shard", "turn", F.desc("pattern"), "word")

    def scan(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, automaton, last = None, {}, None, None
        for part in frames:
            out: tuple[list, list, list] = ([], [], [])
            for *own, pattern, side, seg, word, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if own != shard:
                    shard, held, automaton, last = own, {}, None, None
                if pattern:
                    held.setdefault(seg, ([], []))[side].append((word, n))
                    continue
                if word == last:
                    continue  # scanned for another half
                last = word
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for key, words in held.items():
                        automaton.add_word(key, (len(key), words))
                    automaton.make_automaton()
                if not held:
                    continue
                end = len(word) - 1
                for at, (size, words) in automaton.iter(word):
                    met = (words[0] if at + 1 == size else []) + (words[1] if at == end else [])
                    for other, m in met:
                        if -1 <= len(other) - len(word) <= 1 and near(word, other):
                            for column, value in zip(out, (word, other, m), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "other", "n"])

    return dealt.mapInArrow(scan, "word string, other string, n long")


def _crowded(rows: DataFrame) -> DataFrame:
    """The same for halves of more than CROWD words: by the rest of the word with one code point left out."""
    seg = F.length("seg")
    rest = F.when(F.col("side") == 0, F.substr("word", seg + 1)).otherwise(F.substring("word", F.lit(1), F.length("word") - seg))
    rows = rows.withColumn("rest", rest)
    size = F.length("rest")
    without = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring("rest", F.lit(1), i - 1), F.substr("rest", i + 1)))
    key = lambda kind, place, value: F.xxhash64("side", "seg", F.lit(kind), place, value)
    replaced = F.transform(without, lambda x, i: key(0, i, x))
    shorter = F.transform(F.array_distinct(without), lambda x: key(1, F.lit(0), x))
    whole = F.array(key(1, F.lit(0), F.col("rest")))
    patterns = rows.filter("pattern").select(F.col("word").alias("other"), "n", F.explode(F.concat(replaced, F.transform(shorter, lambda k: F.xxhash64(k, F.lit("b"))), F.transform(whole, lambda k: F.xxhash64(k, F.lit("a"))))).alias("key"))
    texts = rows.filter("not pattern").select("word", F.explode(F.concat(replaced, F.transform(shorter, lambda k: F.xxhash64(k, F.lit("a"))), F.transform(whole, lambda k: F.xxhash64(k, F.lit("b"))))).alias("key"))
    pairs = texts.join(patterns, "key").filter(F.col("word") != F.col("other"))
    return pairs.filter(F.levenshtein("word", "other", 1) == 1).select("word", "other", "n")


def pairs(words: DataFrame, crowd: int = CROWD, shard: int = SHARD, texts: int = TEXTS) -> DataFrame:
    """word, other, n (of the other): all near pairs, both ways. words: a written table of word and n."""
    each = words.select("word", "n", F.lit(True).alias("pattern"), F.explode(_halves()).alias("h")).unionByName(words.select("word", "n", F.lit(False).alias("pattern"), F.explode(_allowed()).alias("h")))
    each = each.select("word", "n", "pattern", "h.side", "h.seg")
    load = each.groupBy("side", "seg").agg(F.count_if("pattern").alias("patterns"), F.count_if(~F.col("pattern")).alias("texts")).filter("patterns > 0 and texts > 1")  # a half's own word is one text
    met = save(each.join(load, ["side", "seg"]), "halves")
    count = met.filter(F.col("pattern") & (F.col("patterns") <= crowd)).count()
    plain = _sharded(met.filter(F.col("patterns") <= crowd).drop("patterns"), max(partitions(met), -(-count // shard)), texts)
    found = save(plain.unionByName(_crowded(met.filter(F.col("patterns") > crowd))).distinct(), "pairs")
    discard(met)
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of each word's chain of forms. forms: word, form."""
    at = save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = save(at.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        discard(at)
        at = moved
        if not moved.filter("moved").limit(1).count():
            return moved.select("word", "root")


def group(words: DataFrame, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n. words: a written table of word and n."""
    best = pairs(words, **options).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    own = words.join(best, "word", "left")
    form = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.form"))
    rows = save(own.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(rows.filter("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(documents: DataFrame, slip: int = 97, **options) -> DataFrame:
    return group(save(vocabulary(documents, slip), "words"), **options)
