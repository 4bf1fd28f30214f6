"""Line dedup by pairwise alignment.

1. Equal texts are settled first: the row of the smallest doc_id stands for all of them, later copies lose every line.
2. Documents overlap if they share a key: the hash of a line of MIN_BLOCK_WORDS words or more, or of a shortest run of lines that
   has as many (from each shorter line onwards, and up to each, blank ones too). Whatever the words of its lines, every line of a
   common block lies in such a key inside that block.
3. A key pairs each holder with its earliest holder, so a line in a million documents makes a million pairs, not their square.
   No other pair is needed: the key is a common block of that pair already. No key is dropped; a cap would lose large groups.
4. Each pair is aligned by patience diff: equal heads and tails, then lines unique on both sides in longest increasing order,
   then the gaps between them; a gap without such lines is aligned exactly, if its table is not too large. A common block of
   MIN_BLOCK_WORDS words or more is deleted from the later document. An alignment keeps one order, so blocks that have moved, or
   repeat, are left by it; what is left and has a line in common is looked up once more by shortest runs, the lines deleted
   before counting towards a block. So a line goes if it lies in a run of lines of MIN_BLOCK_WORDS words that an earlier document
   has too, in whatever order and however many documents have it. All is judged on the input.

Lines are told apart by two independent 64-bit hashes. Pairs carry hashes only; the lines of an earlier document come once to
each task that aligns others with it, which may be several where it has many partners. Texts move once, to be cut.

Defined results: null text stays null with no lines removed; a null doc_id has no place in the order and its row stays whole;
rows of the same doc_id do not cut each other; blank lines inside a deleted block go with it; an empty table gives no row;
other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import boxed, discard, in_arrow, save, unboxed
from folio.llm.words import Texts, batches, span_hashes

MIN_BLOCK_WORDS = 8
#: Later documents that one task aligns with one earlier document at most, about.
PARTNERS = 1024
#: Cells of the table of a gap that a pair's alignment solves; the blocks of a larger gap are found by their runs.
DENSE = 1 << 24


def _keys(h: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of what links documents: lines of MIN_BLOCK_WORDS words; from each shorter line the shortest run of lines of
    its row that has as many words, and the shortest such run that ends with it."""
    row, total = np.repeat(np.arange(len(first) - 1), np.diff(first)), np.r_[0, np.cumsum(n)]
    short, line = np.flatnonzero(n < MIN_BLOCK_WORDS), np.flatnonzero(n >= MIN_BLOCK_WORDS)
    end = np.searchsorted(total, total[short] + MIN_BLOCK_WORDS)
    start = np.searchsorted(total, total[short + 1] - MIN_BLOCK_WORDS, "right") - 1
    ahead, behind = end <= first[1:][row[short]], start >= first[row[short]]
    starts, ends = np.r_[short[ahead], start[behind]], np.r_[end[ahead], short[behind] + 1]
    one = np.unique(starts * (len(h) + 1) + ends, return_index=True)[1]
    starts, ends = starts[one], ends[one]
    return np.r_[row[line], row[starts]], np.r_[h[line], span_hashes(h, starts, ends)]


LINES = "doc_id long, mark long, same binary, n_words long, lines array<long>, more array<long>, words array<int>, keys array<long>"


def _lines(documents: DataFrame) -> DataFrame:
    """doc_id, mark and same (short and long hash of the text), n_words, lines and more (two hashes of each line), words (of
    each line), keys (see _keys())."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames):
            texts = Texts(part.column(2))
            starts, ends, first = texts.lines()
            h = texts.hashes(starts, ends)
            begin, _, word = texts.words()
            n = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
            row, key = _keys(h, n, first)
            order = np.argsort(row, kind="stable")
            of_row = lambda x: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x))
            keys = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(first))).astype(np.int32)), pa.array(key[order].view(np.int64)))
            same = pa.array([hashlib.blake2b(texts.row(i), digest_size=16).digest() for i in range(texts.n)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), same, pa.array(np.diff(word)), of_row(h.view(np.int64)), of_row(texts.hashes(starts, ends, 1).view(np.int64)), of_row(n.astype(np.int32)), keys],
                [x.split()[0] for x in LINES.split(", ")],
            )

    own = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    return in_arrow(own, run, LINES)


def _gap(a: list, b: list, words: list[int], least: int, i: int, m: int, j: int, n: int, cells: int | None = None) -> list[tuple[int, int]]:
    """Pairs between a[i:m] and b[j:n] that put most words, then most lines, into common blocks of `least` words or more; none if
    its table would have more than `cells` cells."""
    weight = dict(zip(b[j:n], words[j:n], strict=True))

    def candidates(x: list, lo: int, hi: int, other: set) -> list[int]:
        """Lines in runs of lines that `other` holds, of `least` words or more."""
        out, lo_run, total = [], lo, 0
        for p in range(lo, hi + 1):
            if p < hi and x[p] in other:
                total += weight[x[p]]
                continue
            if total >= least:
                out += range(lo_run, p)
            lo_run, total = p + 1, 0
        return out

    own = candidates(b, j, n, set(a[i:m]))
    theirs = candidates(a, i, m, {b[q] for q in own})
    if not own or not theirs:
        return []
    code = {x: k for k, x in enumerate(dict.fromkeys(b[q] for q in own))}
    column, row = np.array([code[b[q]] for q in own]), [code[a[p]] for p in theirs]
    next_column, next_row = np.r_[False, np.diff(own) == 1], np.r_[False, np.diff(theirs) == 1]
    count = np.array([words[q] for q in own], np.int64)
    value = count * (len(own) + 1) + 1
    sums, gains = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(value)]
    back = np.arange(1, len(own) + 1) - np.searchsorted(sums, sums[1:] - least, "right") + 1  # lines that the shortest block ending here has
    back = np.where(sums[1:] >= least, back, len(own) + 1)
    if cells is not None and (len(row) + 1) * (len(own) + 1) > cells:
        return []
    best, early = np.zeros((2, len(row) + 1, len(own) + 1), np.int64)  # early: the most that is gained before a block of this run, less what lies before it
    run, early[0] = np.zeros(len(own) + 1, np.int64), -gains
    for p, x in enumerate(row, 1):
        match = column == x
        run[1:] = np.where(match & next_column & next_row[p - 1], run[:-1] + 1, match)
        at, after = np.flatnonzero(match & (run[1:] >= back)), np.zeros(len(own), np.int64)
        k, to = back[at], at + 1
        after[at] = np.where(run[to] > k, early[p - k, to - k], best[p - k, to - k] - gains[to - k]) + gains[to]
        best[p, 1:] = np.maximum.accumulate(np.maximum(best[p - 1, 1:], after))
        early[p] = best[p] - gains
        before = np.where(run[1:] > 1, early[p - 1, :-1], best[p - 1, :-1] - gains[:-1])
        early[p, 1:] = np.where(match, np.maximum(early[p, 1:], before), early[p, 1:])
    out, p, q = [], len(row), len(own)
    while p and q and best[p, q]:
        if best[p, q] == best[p - 1, q]:
            p -= 1
        elif best[p, q] == best[p, q - 1]:
            q -= 1
        else:
            k = int(back[q - 1])
            while best[p - k, q - k] + gains[q] - gains[q - k] != best[p, q]:
                k += 1
            out += [(theirs[p - t], own[q - t]) for t in range(1, k + 1)]
            p, q = p - k, q - k
    return out


def align(a: list, b: list, words: list[int] | None = None, least: int = 1, cells: int | None = None) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], ascending in both: patience diff, with _gap() where no line is unique on both sides.
    Without `words` every line counts alike, and _gap() is a longest common subsequence."""
    words = [1] * len(b) if words is None else words
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once = {x for x, k in Counter(a[i:m]).items() if k == 1} & {x for x, k in Counter(b[j:n]).items() if k == 1}
        if not once:
            out += _gap(a, b, words, least, i, m, j, n, cells)
            continue
        place = {x: k for k, x in enumerate(a[i:m], i) if x in once}
        piles, tops, back = [], [], {}
        for k, x in enumerate(b[j:n], j):
            if x in once:
                at = bisect_left(tops, place[x])
                back[k] = piles[at - 1] if at else None
                tops[at : at + 1] = [place[x]]
                piles[at : at + 1] = [k]
        k, chain = piles[-1], []
        while k is not None:
            chain.append((place[b[k]], k))
            k = back[k]
        for p, q in reversed(chain):
            out.append((p, q))
            todo.append((i, p, j, q))
            i, j = p + 1, q + 1
        todo.append((i, m, j, n))
    return sorted(out)


def common_lines(a: list, b: list, words: list[int], least: int = MIN_BLOCK_WORDS, cells: int | None = None) -> list[int]:
    """Lines of b inside aligned blocks of `least` words or more."""
    out, block = [], []
    for i, j in [*align(a, b, words, least, cells), (-1, -1)]:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[q] for _, q in block) >= least:
                out += [q for _, q in block]
            block = []
        block.append((i, j))
    return out


def _runs(codes: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes (two in one row) of the shortest runs of `least` words from each line and up to each. Code 0 is a
    line that the other side lacks: no run has one."""
    total, bad = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(codes == 0)]
    at = np.arange(len(n))
    end, start = np.searchsorted(total, total[:-1] + least), np.searchsorted(total, total[1:] - least, "right") - 1
    ahead, behind = end <= len(n), start >= 0
    starts, ends = np.r_[at[ahead], start[behind]], np.r_[end[ahead], at[behind] + 1]
    whole = bad[starts] == bad[ends]
    starts, ends = starts[whole], ends[whole]
    values = codes.astype(np.uint64)
    return starts, ends, np.stack([span_hashes(values, starts, ends, k) for k in (0, 1)], 1)


def deleted_lines(a: list, b: list, words: list[int], least: int = MIN_BLOCK_WORDS, cells: int | None = None) -> list[int]:
    """Lines of b inside any run of `least` words or more that a has too: those of the alignment, and those in blocks that have
    moved or repeat, by shortest runs."""
    cells = DENSE if cells is None else cells
    gone, theirs = set(common_lines(a, b, words, least, cells)), set(a)
    if all(q in gone or x not in theirs for q, x in enumerate(b)):
        return sorted(gone)
    code = {x: k for k, x in enumerate((x for x in dict.fromkeys(b) if x in theirs), 1)}
    weight = np.zeros(len(code) + 1, np.int64)
    own, other = (np.array([code.get(x, 0) for x in side], np.int64) for side in (b, a))
    weight[own] = words
    weight[0] = 0
    _, _, known = _runs(other, weight[other], least)
    starts, ends, keys = _runs(own, weight[own], least)
    held = set(map(bytes, known))
    for k in np.flatnonzero([bytes(x) in held for x in keys]).tolist():
        gone.update(range(starts[k], ends[k]))
    return sorted(gone)


def _pairs(texts: DataFrame) -> DataFrame:
    """(at, first): texts to align, the later and an earlier one, each as struct(doc_id, row): each holder of a key with the first."""
    each = texts.select(F.struct("doc_id", "row").alias("at"), F.explode(F.array_distinct("keys")).alias("key"))
    met = each.groupBy("key").agg(F.min("at").alias("first"), F.max("at.doc_id").alias("last")).filter("first.doc_id < last")
    return each.join(met.select("key", "first"), "key").select("at", "first").filter("first.doc_id < at.doc_id").distinct()


def _aligned(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(at, gone): the numbers of the lines that each text loses to one earlier text. An earlier text comes ahead of its partners."""
    crowd = pairs.groupBy("first").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("turns"))
    own = texts.select(F.struct("doc_id", "row").alias("id"), "lines", "more", "words")
    ahead = crowd.join(own.withColumnRenamed("id", "first"), "first").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    after = pairs.join(crowd, "first").withColumn("turn", F.pmod(F.xxhash64("at"), F.col("turns")).cast("int")).join(own.withColumnRenamed("id", "at"), "at")
    columns = ["first", "turn", "at", "lines", "more", "words"]
    both = ahead.withColumn("at", F.lit(None).cast(pairs.schema["at"].dataType)).select(*columns).unionByName(after.select(*columns))
    dealt = both.repartition("first", "turn").sortWithinPartitions("first", "turn", F.col("at").asc_nulls_first())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theirs = []
        for part in frames:
            out, at = [], part.column(2)
            for k, later in enumerate(at.is_valid().to_pylist()):
                lines = list(zip(part.column(3)[k].values.to_pylist(), part.column(4)[k].values.to_pylist(), strict=True))
                if not later:
                    theirs = lines
                elif gone := deleted_lines(theirs, lines, part.column(5)[k].values.to_pylist()):
                    out.append((at[k].as_py()["row"], gone))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], ["row", "gone"])

    return in_arrow(dealt, run, "row long, gone array<int>")


def removed(documents: DataFrame) -> DataFrame:
    """doc_id, mark, gone: the numbers of the lines that each document loses, null where it loses all."""
    lines = save(_lines(documents).withColumn("row", F.monotonically_increasing_id()), "lines")
    low = lines.groupBy("same").agg(F.min(F.struct("doc_id", "row")).alias("low"))
    texts = save(lines.join(low.select(F.col("low.row").alias("row")), "row", "left_semi"), "texts")  # one of equal texts
    found = _aligned(save(_pairs(texts), "pairs"), texts)
    found = found.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))  # a text's own lines
    cut = texts.select("doc_id", "mark", "row").join(found, "row").select("doc_id", "mark", "gone")
    copies = lines.filter(F.col("n_words") >= MIN_BLOCK_WORDS).select("doc_id", "mark", "same").join(low, "same").filter("low.doc_id < doc_id")
    copies = copies.select("doc_id", "mark", F.lit(None).cast("array<int>").alias("gone")).distinct()
    out = save(cut.unionByName(copies), "gone")
    discard(lines)
    discard(texts)
    return out


def dedup(documents: DataFrame) -> DataFrame:
    """_row (the columns of documents, see boxed()), text (cut), n_lines, n_removed."""
    gone = removed(documents).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "gone", F.lit(True).alias("hit"))
    own = documents.select(boxed(documents).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    out = own.join(gone, (F.col("doc_id") == F.col("d")) & (F.col("mark") == F.col("m")), "left")
    split = F.split("text", "\n", -1)
    n = F.size(split)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda i: F.get(split, i))
    return out.select(
        "_row",
        F.when(F.col("hit").isNull(), F.col("text")).when(F.col("gone").isNull(), "").otherwise(F.concat_ws("\n", kept)).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.when(F.col("hit").isNull(), 0).when(F.col("gone").isNull(), n).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def digest(documents: DataFrame) -> DataFrame:
    out = dedup(documents.select("doc_id", "text"))
    return out.select(F.col("_row.c0").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def apply(documents: DataFrame) -> DataFrame:
    """documents after line dedup, `text` cut; one that loses every line with a word is gone, one that had none stays. Rows
    with a null doc_id or null text stay as they are."""
    out = dedup(documents)
    return out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*unboxed(documents.columns, text=F.col("text")))
