"""Packing token sequences into windows of fixed capacity by minimum bin slack.

pieces() tokenises whole texts and cuts them: full windows first, then the rest. plan() sees only how many pieces of each
length there are (at most `capacity` numbers, whatever the corpus): for each window it takes the longest length left and
fills what remains by subset sums over the multiset of lengths, held in one integer bitset, and walks back which counts gave
the sum closest to the capacity. The pattern is used as often as the counts allow. assign() gives the r-th piece of each
length its place by arithmetic; ranks come from counts per partition, so no length, however common, meets in one task.

Defined results: null and empty texts give the end id alone; repeated rows are packed once each; an empty table gives no row;
a null doc_id is kept. Sequences hold at most `capacity` ids and are padded to it, except where they end at a power of two.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import in_arrow, save
from folio.llm.tokens import Units
from folio.llm.words import Texts, batches

CAPACITY, END = 2048, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """A row for each piece, with its ids (little-endian unsigned 32-bit) if asked for."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units.of(path, False)
        for part in batches(frames):
            ids, off = units.encode(Texts(part.column(1)))
            docs, out, blobs = part.column(0).to_pylist(), [], []
            for i, doc in enumerate(docs):
                own = np.append(ids[off[i] : off[i + 1]], np.uint32(end)).astype("<u4")
                for at in range(0, len(own), capacity):
                    blob = own[at : at + capacity].tobytes()
                    out.append((doc, at, len(blob) // 4, zlib.crc32(blob), len(own)))
                    blobs.append(blob)
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5
            names = [x.split()[0] for x in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(blobs, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return in_arrow(documents.select(F.col("doc_id").cast("long"), "text"), run, PIECE + ", ids binary" * keep_ids)


def fill(counts: Iterable[tuple[int, int]], room: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest that fits in room. counts: (length, number), in the order of preference."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length, n in counts:
        n, k = min(n, room // length), 1
        while n > 0:
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            n -= k
            k *= 2
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> left & 1:
            left -= length * k
            out[length] = out.get(length, 0) + k
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces a window, first window, offset) rows that place every piece."""
    counts, used, rows, window = {k: v for k, v in counts.items() if v}, {}, [], 0
    lengths = sorted(counts)
    while lengths:
        longest = lengths[-1]
        fitting = reversed(lengths[: bisect_right(lengths, capacity - longest)])
        pattern = fill(((k, counts[k] - (k == longest)) for k in fitting), capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times, offset = min(counts[k] // m for k, m in pattern.items()), 0
        for k, m in sorted(pattern.items(), reverse=True):
            lo = used.get(k, 0)
            used[k] = lo + m * times
            rows.append((k, lo, used[k], m, window, offset))
            offset += k * m
            counts[k] -= m * times
            if not counts[k]:
                del lengths[bisect_left(lengths, k)]
        window += times
    return rows


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length."""
    spark = cut.sparkSession
    cut = save(cut.withColumn("_part", F.spark_partition_id()), "pieces")
    tally = cut.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = tally.select("length", "_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    base = save(base, "bases")
    totals = {r.length: r.n for r in base.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # `capacity` rows at most
    schema = "length long, lo long, hi long, per long, window long, slot long"
    places = spark.createDataFrame(plan(totals, capacity), schema).groupBy("length").agg(F.collect_list(F.struct("lo", "hi", "per", "window", "slot")).alias("_places"))
    within = Window.partitionBy("_part", "length").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("_r", F.row_number().over(within) - 1).join(base.drop("_n"), ["length", "_part"]).withColumn("_r", F.col("_r") + F.col("_base"))
    placed = ranked.join(F.broadcast(places), "length")  # a row for each length: `capacity` at most
    placed = placed.withColumn("_p", F.filter("_places", lambda p: (p["lo"] <= F.col("_r")) & (F.col("_r") < p["hi"]))[0])
    turn = F.col("_r") - F.col("_p.lo")
    placed = placed.withColumn("sequence_id", F.col("_p.window") + F.floor(turn / F.col("_p.per")))
    placed = placed.withColumn("offset", F.col("_p.slot") + F.pmod(turn, F.col("_p.per")) * F.col("length"))
    return placed.select(*[c for c in cut.columns if c != "_part"], "sequence_id", "offset")


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    return assign(pieces(documents, path, capacity, end, keep_ids), capacity)
