"""Token ids on disk: frequency-ranked, in byte-aligned variable length, control bytes apart from data bytes.

write() deals texts out by ranges of doc_id, tokenises them, counts every id of the corpus and replaces ids by their rank
(most frequent first, ties by id), so that frequent ids take one byte. A block holds consecutive documents: doc_ids, counts,
`control` (two bits for each id, its bytes less one, four ids in a byte) and `data`. Blocks are rows of Parquet files in the
shared folder, in ascending (_part, _row); `ranks` holds the id of each rank. read() decodes blocks with numpy: a 256-row
table turns a control byte into four lengths, a running sum finds the bytes.

Defined results: null and empty texts hold the end id alone; null doc_ids come first; rows that repeat a doc_id, or have none,
follow each other by a hash of their texts; an empty table gives no row. Only the id counts, one for each entry of the vocabulary, reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import discard, partitions, running_total, save
from folio.llm.tokens import Units
from folio.llm.words import Texts, batches, binary

END = 0
BLOCK_IDS = 1 << 18
_LENGTHS = np.stack([(np.arange(256) >> 2 * k & 3) + 1 for k in range(4)], 1).astype(np.int64)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    control = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    control[: len(ranks)] = size - 1
    control = control.reshape(-1, 4)
    control = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    held = np.arange(4)[None] < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[held].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenised(documents: DataFrame, path: str, end: int) -> DataFrame:
    own = documents.select(F.col("doc_id").cast("long"), "text")
    # the hash parts rows without an id, and those that repeat one; a row's number parts rows that repeat id and text, which may
    # stand in any order
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_at")]
    dealt = own.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(partitions(own, "text"), *order).sortWithinPartitions(*order).drop("_at")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, row = Units.of(path, True), 0
        for part in batches(frames):
            ids, off = units.encode(Texts(part.column(1)))
            width = 4 if max(ids.max(initial=0), end) > 0xFFFF else 2
            laid = np.insert(ids, off[1:], np.uint32(end)).astype(f"<u{width}")
            to = ((off + np.arange(len(off))) * width).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(to), pa.py_buffer(laid)])
            rows = pa.array(np.arange(row, row + part.num_rows))
            row += part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), rows, blobs, pa.array(np.full(part.num_rows, width, np.int32))], ["doc_id", "_row", "ids", "width"])

    return save(dealt.mapInArrow(run, "doc_id long, _row long, ids binary, width int").withColumn("_part", F.spark_partition_id()), "ids", "zstd")


def _ids(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{width}")


def _counts(ids: DataFrame) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for frame in frames:
            for blob, width in zip(frame.column(0), frame.column(1).to_pylist(), strict=True):
                own = np.bincount(_ids(blob.as_buffer(), width), minlength=len(total))
                own[: len(total)] += total
                total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return ids.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCK = "_part int, _row long, doc_ids array<long>, counts array<long>, control binary, data binary"


def write(documents: DataFrame, path: str, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(blocks, ranks): the written tables."""
    ids = _tokenised(documents, path, end)
    seen = sorted((-r.n, r.id) for r in _counts(ids).collect())  # the size of the vocabulary at most
    by_rank = np.array([i for _, i in seen], np.int64)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))

    def block(part, row, docs, own):
        flat = np.concatenate(own)
        control, data = encode(rank[flat])
        return part, row, docs, [len(x) for x in own], control, data

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_part", pa.int32()), ("_row", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
        for frame in frames:
            docs, part, row = frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2).to_pylist()
            own = [_ids(b.as_buffer(), w) for b, w in zip(frame.column(3), frame.column(4).to_pylist(), strict=True)]
            cuts, held = [0], 0
            for i in range(1, len(docs)):
                held += len(own[i - 1])
                if held > BLOCK_IDS or part[i] != part[i - 1] or row[i] != row[i - 1] + 1:
                    cuts.append(i)
                    held = 0
            for a, b in zip(cuts, [*cuts[1:], len(docs)], strict=True):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(block(part[a], row[a], docs[a:b], own[a:b]), schema, strict=True)], schema=schema)

    blocks = save(ids.select("doc_id", "_part", "_row", "ids", "width").mapInArrow(run, BLOCK), "blocks", "none")
    discard(ids)
    ranks = documents.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank long, id long")
    return blocks, save(ranks, "ranks")


def read(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """doc_id, _part, _row and ids (little-endian unsigned 32-bit) of each document, in the files' order by (_part, _row)."""
    by_rank = np.zeros(0, np.uint32)
    if table := ranks.collect():  # the size of the vocabulary at most
        by_rank = np.zeros(len(table), np.uint32)
        by_rank[[r.rank for r in table]] = [r.id for r in table]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for b in frame.to_pylist():
                ids = by_rank[decode(b["control"], b["data"], sum(b["counts"]))].astype("<u4")
                to = np.r_[0, np.cumsum(b["counts"])].tolist()
                blobs = [ids[i:j].tobytes() for i, j in zip(to, to[1:], strict=False)]
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"], pa.int64()), pa.array([b["_part"]] * n, pa.int32()), pa.array(range(b["_row"], b["_row"] + n), pa.int64()), binary(blobs)], ["doc_id", "_part", "_row", "ids"])

    return blocks.mapInArrow(run, "doc_id long, _part int, _row long, ids binary")


def digest(documents: DataFrame, path: str) -> DataFrame:
    back = read(*write(documents, path))
    rows = save(back.select("doc_id", "_part", "_row", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "read")
    return running_total(rows, [F.col("_row")], F.col("n_tokens"), "start").select("doc_id", "start", "n_tokens", "ids_crc32")
