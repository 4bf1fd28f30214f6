"""Substring dedup on a de Bruijn graph of words: edges are windows of K words, nodes their K - 1 overlaps.

A word goes if a K-word window over it also starts in a document of smaller id. All windows would be many times the corpus, so:
1. Copies of whole word sequences (by SHA-256) are settled by the smallest id of each; one document of each goes on.
2. Each window is named by its minimizer, the least hash among its SEED_WORDS-word parts, about one row for five words. Equal
   windows have equal minimizers, so windows whose minimizer is met in one document only are unique: exact, and few are left.
3. The rest become edges between two nodes; an edge met in two documents keeps its source coordinate, the first (doc_id, text,
   position), where its nodes are read. These edges are the graph.
4. Compaction: nodes with one edge in and one out, found by counting and joining edges by their ends, branch nowhere. Edges on
   the two sides of such a node that also follow each other in the source make one piece of a path: (source, start, length),
   with its words read once from the source. paths() joins pieces of different sources into whole nonbranching paths by pointer
   doubling; a piece is as long as its source at most, a path need not be.
5. Documents run along pieces: hits at neighbouring places of a document and a piece are one span.
6. Verification: the words of the piece and of the span are compared by SHA-256 before anything is removed.

Skew: hot minimizers, edges and nodes are only ever reduced to counts and minima (partial aggregation) and joined back by plain
equi-joins that adaptive execution can split. No list of documents for a window is made anywhere.

Defined results: null text has no words; a null doc_id is neither earlier nor later, its row stays whole; rows that repeat a
doc_id do not remove each other's words; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import discard, in_arrow, save
from folio.llm.words import Texts, batches, grams

K, SEED_WORDS = 13, 5
#: Bytes of text in one step of numpy, which holds several numbers for each word.
SLICE = 1 << 18
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _minimizers(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The minimizer of the window at each word; _NONE where no window of one row starts."""
    n = len(h) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts = grams(h, SEED_WORDS)
    low, width, want = parts, 1, K - SEED_WORDS + 1
    while 2 * width <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: n], low[want - width : want - width + n])
    return np.where(row[:n] == row[K - 1 :], low, _NONE)


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = Texts(column)
    starts, ends, first = texts.words()
    return texts.hashes(starts, ends), np.repeat(np.arange(texts.n), np.diff(first)), first


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(documents: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n_words, sha (of the words), seeds (its minimizers)."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames, limit=SLICE):
            texts = Texts(part.column(2))
            split = [texts.row(i).tobytes().split() for i in range(texts.n)]
            h, row, _ = _hashed(part.column(2))
            low = _minimizers(h, row)
            at = np.flatnonzero(low != _NONE)
            value, of = low[at], row[at]
            new = np.ones(len(at), bool)
            new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
            value, of = value[new], of[new]
            to = np.searchsorted(of, np.arange(texts.n + 1)).astype(np.int32)
            seeds = pa.ListArray.from_arrays(pa.array(to), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(map(len, split)), pa.int64()), pa.array(list(map(_sha, split)), pa.string()), seeds], ["doc_id", "mark", "n_words", "sha", "seeds"])

    own = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    return in_arrow(own, run, "doc_id long, mark long, n_words long, sha string, seeds array<long>")


def _edges(texts: DataFrame) -> DataFrame:
    """(edge, doc_id, mark, pos, first: whether the edge has not stood earlier in the row) of the windows whose minimizer is among
    `seeds`."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames, limit=SLICE):
            h, row, first = _hashed(part.column(2))
            low, edge = _minimizers(h, row), grams(h, K)
            docs, places, firsts = [], [], []
            for i, seeds in enumerate(part.column(3)):
                a, b = first[i], max(first[i], first[i + 1] - K + 1)
                own = seeds.values.to_numpy().view(np.uint64)
                at = a + np.flatnonzero(np.isin(low[a:b], own))
                places.append(at)
                docs.append(np.full(len(at), i))
                new = np.zeros(len(at), bool)
                new[np.unique(edge[at], return_index=True)[1]] = True
                firsts.append(new)
            at, doc, new = np.concatenate(places), np.concatenate(docs), np.concatenate(firsts)
            columns = [pa.array(edge[at].view(np.int64)), part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array((at - first[doc]).astype(np.int32)), pa.array(new)]
            yield pa.RecordBatch.from_arrays(columns, ["edge", "doc_id", "mark", "pos", "first"])

    return in_arrow(texts.select("doc_id", "mark", "text", "seeds"), run, "edge long, doc_id long, mark long, pos int, first boolean")


def _nodes(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """edges with `a` and `b`, the nodes at their ends, read from their sources. Only repeated edges get nodes: candidates, many times
    as many, would carry them through the largest shuffle."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames, limit=SLICE):
            h, _, first = _hashed(part.column(2))
            node, n = grams(h, K - 1), np.diff(part.column(3).offsets.to_numpy())
            of = np.repeat(np.arange(part.num_rows), n)
            pos, edge = part.column(3).flatten().flatten()
            at = first[of] + pos.to_numpy()
            columns = [edge, *(pa.array(node.take(x, mode="clip").view(np.int64)) for x in (at, at + 1)), part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pos]
            yield pa.RecordBatch.from_arrays(columns, ["edge", "a", "b", "source", "source_mark", "at"])

    per = edges.groupBy("source", "source_mark").agg(F.collect_list(F.struct("at", "edge")).alias("own"))  # a document's own edges
    texts = _texts(documents).select(F.col("doc_id").alias("source"), F.col("mark").alias("source_mark"), "text")
    held = texts.join(per, ["source", "source_mark"]).select("source", "source_mark", "text", "own")
    return in_arrow(held, run, "edge long, a long, b long, source long, source_mark long, at int").dropDuplicates(["edge"])  # rows may repeat a text and its id


def _piece_words(pieces: DataFrame, documents: DataFrame) -> DataFrame:
    """source, source_mark, piece and the words that each piece points at. A source's text meets the list of its pieces once,
    however many there are."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames, limit=SLICE):
            words, n = [], np.diff(part.column(3).offsets.to_numpy())
            piece, size = part.column(3).flatten().flatten()
            places = zip(piece.to_pylist(), size.to_pylist(), strict=True)
            for text, own in zip(part.column(2), n.tolist(), strict=True):
                split = text.as_buffer().to_pybytes().split()
                words += [b" ".join(split[at : at + edges + K - 1]) for at, edges in islice(places, own)]
            of = pa.array(np.repeat(np.arange(part.num_rows), n))
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), piece, pa.array(words, pa.binary())], ["source", "source_mark", "piece", "words"])

    per = pieces.groupBy("source", "source_mark").agg(F.collect_list(F.struct("piece", "n_edges")).alias("own"))  # a document's own pieces
    texts = _texts(documents).select(F.col("doc_id").alias("source"), F.col("mark").alias("source_mark"), "text")
    held = texts.join(per, ["source", "source_mark"]).select("source", "source_mark", "text", "own")
    return in_arrow(held, run, "source long, source_mark long, piece int, words binary").dropDuplicates(["source", "source_mark", "piece"])  # rows may repeat a text and its id


def _source_sha(spans: DataFrame) -> DataFrame:
    """Replaces a piece's words by the SHA-256 of those that the span runs along."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frames:
            shas = [_sha(words.as_buffer().to_pybytes().split(b" ")[at : at + n]) for words, at, n in zip(part.column(4), part.column(5).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(shas, pa.string())], ["doc_id", "mark", "start", "n", "source_sha"])

    return in_arrow(spans.select("doc_id", "mark", "start", "n", "words", "offset"), run, "doc_id long, mark long, start int, n int, source_sha string")


def _cut(texts: DataFrame) -> DataFrame:
    """doc_id, sha, n_removed, kept_sha256, kept (the words left) of texts with their spans."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frames:
            out = []
            for text, spans in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    if _sha(words[s["start"] : s["start"] + s["n"]]) == s["source_sha"]:
                        gone[s["start"]] += 1
                        gone[s["start"] + s["n"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((_sha(words), int(gone.sum()), _sha(kept), b" ".join(kept).decode("utf-8", "replace")))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", "sha", "n_removed", "kept_sha256", "kept"])

    return in_arrow(texts.select("doc_id", "text", "spans"), run, "doc_id long, sha string, n_removed long, kept_sha256 string, kept string")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text").filter(F.col("text").isNotNull())


def _half() -> Column:
    """The upper 32 bits of `mark`: half the bytes in the largest shuffle. Texts of one id that agree in them share their seeds,
    which only adds candidates."""
    return F.shiftright("mark", 32).cast("int").alias("half")


def _met(own: DataFrame) -> DataFrame:
    """The seeds of two documents or more."""
    seeds = own.select("doc_id", F.explode("seeds").alias("seed"))
    return seeds.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("seed")


def _wanted(own: DataFrame, met: DataFrame) -> DataFrame:
    """doc_id, half, seeds: of the seeds of each text, those that some other document has too. A set for each text, so neither many
    texts under one id nor a row that repeats makes a list longer than the seeds of one text."""
    seeds = own.select("doc_id", "half", F.explode("seeds").alias("seed"))
    return seeds.join(met, "seed").groupBy("doc_id", "half").agg(F.collect_set("seed").alias("seeds"))


def graph(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hits, edges), saved: a narrow row for each document with `first`, the smallest id of its copies; every place of a
    candidate edge (edge, doc_id, mark, pos); the repeated edges (edge, a, b, source, source_mark, at)."""
    rows = save(_scan(documents), "scan")
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first"))
    narrow = save(rows.select("doc_id", "n_words", "sha").join(first, "sha"), "rows")
    heads = narrow.filter((F.col("doc_id") == F.col("first")) & (F.col("n_words") >= K)).select("doc_id", "sha").distinct()
    own = save(rows.filter(F.col("n_words") >= K).join(heads, ["doc_id", "sha"], "left_semi").select("doc_id", _half(), "seeds"), "own")
    discard(rows)
    met = save(_met(own), "met")
    wanted = save(_wanted(own, met), "wanted")
    discard(own)
    discard(met)
    hits = save(_edges(_texts(documents).withColumn("half", _half()).join(wanted, ["doc_id", "half"])), "hits")
    discard(wanted)
    # aggregates of plain numbers, by hash: rows of one document stay together in the shuffle, where they compress. The two
    # min_by() see the same rows in the same order and so take the same one
    edges = hits.filter("first").groupBy("edge").agg(
        F.min("doc_id").alias("source"), F.min_by("mark", "doc_id").alias("source_mark"), F.min_by("pos", "doc_id").alias("at"), F.max("doc_id").alias("last")
    )
    sources = save(edges.filter("source < last").drop("last"), "sources")
    edges = save(_nodes(sources, documents), "graph")
    discard(sources)
    return narrow, hits, edges


def nonbranching(edges: DataFrame) -> DataFrame:
    """(before, after): edges, named by their source coordinates, on the two sides of a node with one edge in and one out."""
    names = ("source", "source_mark", "at")

    def ends(node: str, out: str) -> DataFrame:
        own = edges.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in names])  # of one edge, where n = 1
        return own.filter("n = 1").select("node", F.struct(*names).alias(out))

    return ends("b", "before").join(ends("a", "after"), "node").filter("before != after").select("before", "after")


def marked(edges: DataFrame) -> DataFrame:
    """edges with `alone`: their first node has one edge in and one out. Only counts go from edges to their nodes; edges are joined
    with their first nodes."""
    ends = [edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).filter("n = 1").select("node") for c in ("a", "b")]
    alone = ends[0].join(ends[1], "node").withColumn("one", F.lit(True))
    return edges.drop("b").join(alone, F.col("a") == F.col("node"), "left").withColumn("alone", F.coalesce("one", F.lit(False))).drop("a", "node", "one")


def pieces(edges: DataFrame) -> DataFrame:
    """marked() edges with `piece`, the place in the source where the edge's piece begins. An edge goes on with the piece of the
    place before if its first node branches nowhere: the one edge into that node is then the one at the place before."""
    own = Window.partitionBy("source", "source_mark").orderBy("at")
    goes_on = F.coalesce(F.col("alone") & (F.lag("at").over(own) + 1 == F.col("at")), F.lit(False))
    return edges.withColumn("on", goes_on).withColumn("piece", F.last(F.when(~F.col("on"), F.col("at")), True).over(own)).drop("on", "alone")


def paths(documents: DataFrame) -> DataFrame:
    """path (its first edge's source coordinate), n_edges, n_pieces of every nonbranching path. Closed rings are left in pieces."""
    _, _, edges = graph(documents)
    links = save(nonbranching(edges), "links")
    cut = pieces(marked(edges)).groupBy("source", "source_mark", "piece").agg(F.count("*").alias("n_edges"))
    cut = cut.select(F.struct("source", "source_mark", F.col("piece").alias("at")).alias("head"), F.struct("source", "source_mark", (F.col("piece") + F.col("n_edges") - 1).cast("int").alias("at")).alias("tail"), "n_edges")
    cut = save(cut, "pieces")
    lead = cut.join(links.withColumnRenamed("before", "tail"), "tail").join(cut.select(F.col("head").alias("after")), "after").select(F.col("after").alias("head"), F.col("head").alias("up"))
    step = save(cut.select("head", "n_edges").join(lead, "head", "left"), "step")
    for _ in range(max(1, step.count()).bit_length()):  # every round doubles the reach
        above = step.select(F.col("head").alias("up"), F.col("up").alias("top"))
        after = step.join(above, "up", "left").select("head", "n_edges", F.coalesce("top", "up").alias("up"))
        moved = after.join(step.select("head", F.col("up").alias("was")), "head").filter("not (up <=> was)").limit(1).count()
        step = save(after, "step")
        if not moved:
            break
    heads = step.filter("up is null").select(F.col("head").alias("top"))
    found = step.withColumn("top", F.coalesce("up", "head")).join(heads.withColumn("open", F.lit(True)), "top", "left")
    return found.groupBy(F.when(F.col("open"), F.col("top")).otherwise(F.col("head")).alias("path")).agg(F.sum("n_edges").alias("n_edges"), F.count("*").alias("n_pieces"))


def spans(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): a narrow row for each document, see graph(); and the spans with the SHA-256 of the words of their sources."""
    rows, hits, edges = graph(documents)
    told = save(marked(edges), "marked")
    discard(edges)
    cut = save(pieces(told).select("edge", "source", "source_mark", "at", "piece"), "pieces")
    discard(told)
    found = hits.select("edge", "doc_id", "mark", "pos").join(cut, "edge").filter("doc_id > source").select("doc_id", "mark", "pos", "source", "source_mark", "piece", (F.col("pos") - F.col("at")).alias("shift"))
    along = ["doc_id", "mark", "source", "source_mark", "piece", "shift"]
    island = found.withColumn("island", F.col("pos") - F.dense_rank().over(Window.partitionBy(*along).orderBy("pos")))  # rows that repeat an id repeat its hits
    runs = island.groupBy(*along, "island").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + K).cast("int").alias("n"))
    runs = save(runs.select("doc_id", "mark", "start", "n", "source", "source_mark", "piece", (F.col("start") - F.col("shift") - F.col("piece")).cast("int").alias("offset")), "runs")
    discard(hits)
    whole = cut.groupBy("source", "source_mark", "piece").agg(F.count("*").cast("int").alias("n_edges"))
    words = save(_piece_words(whole, documents), "words")
    checked = save(_source_sha(runs.join(words, ["source", "source_mark", "piece"])), "checked")
    for table in (cut, runs, words):
        discard(table)
    return rows, checked


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and `kept`: the words left where some went, else null."""
    rows, checked = spans(documents)
    per = checked.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n", "source_sha")).alias("spans"))  # a document's own spans
    cut = _cut(_texts(documents).join(per, ["doc_id", "mark"])).dropDuplicates(["doc_id", "sha"])
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= K), F.lit(False))
    out = rows.join(cut, ["doc_id", "sha"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def digest(documents: DataFrame) -> DataFrame:
    return dedup(documents).drop("kept")
