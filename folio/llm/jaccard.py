"""Exact Jaccard join of word-shingle sets in metric space: pivots, Voronoi regions, triangle-inequality windows.

Distances are d = 1 - |A n B| / |A u B|; a link is d <= THETA. In a large corpus nearly all distances are 1, so a table of
distances to chosen pivots tells nothing. Pivots are therefore reached by shared shingles, and every filter is exact:

1. Equal sets form one class; only classes go on.
2. A set keeps the head of its hashes in ascending order, long enough that two linked sets share at least need() of the head
   (the prefix principle with a margin). Sets whose head has fewer shingles met in other sets cannot link and leave. What
   is left is counted again until few more leave.
3. The least class that holds a head shingle is its pivot. A class belongs to the regions of its pivots. Regions have one
   order, by crowd; a class leaves out its most crowded ones as long as they hold fewer than need() of its shingles. Two linked
   classes share need() shingles, so neither leaves out the region of the least crowded one of these: regions of a passage that
   a third of all documents share dissolve, and no link is lost.
4. Heads alone bound an intersection from above: what two heads do not share lies beyond the longer rest. Classes of a region
   that no such bound ties to another leave it; those that it ties together go on as a region of their own. So whole sets are
   only fetched for classes that have a near match, and regions travel as keys.
   A region too large for one task is cut again by whole sets in the same way, shingles in order of how many of the region
   hold them: of the n - ceil(link * n) + 1 rarest ones of a set a linked set has at least one, and a set whose rarest ones
   are its own alone leaves. Documents that are alike by one long passage part here; distances could not part them.
5. A region of more than LEAF classes, or of more than LEAF_HASHES hashes, is split: its pivots are the classes with the least
   hashes of their names, home is the nearest one, and a class is copied to every pivot with d <= d(home) + 2 * THETA; by the
   triangle inequality linked classes meet at each other's homes. Sub-regions in which every class lies within THETA of the
   pivot need no more than those links. This recurs; a region whose sub-regions would hold more pairs than itself (all classes
   alike) is joined block against block instead.
6. A leaf counts intersections exactly by products of 0/1 matrices and returns a spanning forest of its links, never all
   pairs. Components of the forests give the result.

Sets are of 64-bit shingle hashes; classes are named by 128-bit hashes.

Defined results: null text and text without words have the empty set and link with nothing; a text with fewer words than a
shingle is one shingle of all its words; rows without doc_id take part in links and have the smallest doc_id that they reach,
or null; repeated rows are of one class; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import WORD, boxed, discard, in_arrow, save, unboxed
from folio.llm.components import components
from folio.llm.words import Texts, batches, grams

WORDS, LINK = 4, Fraction(85, 100)
MARGIN = Fraction(1, 10)
#: Classes and hashes of a region that one task joins at once; two classes may be of any size.
LEAF, LEAF_HASHES, DEPTH = 1024, 1 << 22, 4
#: Pivots of a region: so many for each LEAF classes, MAX_PIVOTS at most. Members that one task deals to them, about.
PIVOTS, MAX_PIVOTS, TURN = 8, 64, 1 << 14
#: Counting again ends when a pass keeps more than this part; those who could still leave only cost later steps some work.
SETTLED = 0.95


def linked(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, link: Fraction = LINK):
    return link.denominator * both >= link.numerator * (a + b - both)


def _share(n: int, link: Fraction) -> int:
    return max(1, math.floor(MARGIN * n))


def head_size(n: int, link: Fraction) -> int:
    return min(n, n - math.ceil(link * n) + _share(n, link))


def need(n: int, link: Fraction) -> int:
    """Head shingles that a set of n has in common with any one linked set, at least."""
    return _share(math.ceil(link * n), link)


def _need(link: Fraction) -> str:
    """need() of column n in SQL."""
    a, b = link.numerator, link.denominator
    return f"greatest(1, (({a} * n + {b - 1}) div {b}) * {MARGIN.numerator} div {MARGIN.denominator})"


def shingles(texts: Texts, words: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each row."""
    starts, ends, first = texts.words()
    h = texts.hashes(starts, ends)
    g, out = grams(h, words), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - words + 1]) if b - a >= words else grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    to = np.r_[0, np.cumsum([len(x) for x in arrays])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(to), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _heads(documents: DataFrame, words: int, link: Fraction) -> DataFrame:
    """doc_id, mark (hash of the text), cls, n (size of the set), head."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames):
            sets = shingles(Texts(part.column(2), lower=True), words)
            heads = _lists([x[: head_size(len(x), link)] for x in sets])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _names(sets), pa.array([len(x) for x in sets], pa.int64()), heads], ["doc_id", "mark", "cls", "n", "head"])

    return in_arrow(_own(documents), run, "doc_id long, mark long, cls binary, n long, head array<long>")


def _own(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def _names(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())


def _short(cls: str = "cls") -> Column:
    """Eight of a class's sixteen bytes, to tell two classes of one shingle apart."""
    return F.conv(F.hex(F.substring(cls, 1, 7)), 16, 10).cast("long")


def _live(heads: DataFrame, link: Fraction) -> DataFrame:
    """(cls, n, shared), saved: classes that may link, and their head shingles that other live classes have too."""
    rows = heads.filter("n > 0").select("cls", "n", F.explode("head").alias("s"))
    kept, before = None, -1
    while True:
        met = rows.groupBy("s").agg(F.min(_short()).alias("a"), F.max(_short()).alias("b")).filter("a < b").select("s")
        met = save(met, "met")
        own = rows.join(met, "s").groupBy("cls", "n").agg(F.collect_set("s").alias("shared")).filter(F.size("shared") >= F.expr(_need(link)))  # a class's own head
        own = save(own, "live")
        n = own.count()
        discard(met)
        if kept is not None:
            discard(kept)
        kept = own
        if n == 0 or n > SETTLED * before >= 0:
            return kept
        before, rows = n, kept.select("cls", "n", F.explode("shared").alias("s"))


def _regions(live: DataFrame, link: Fraction) -> DataFrame:
    """(region, cls), saved: the pivots' regions that each class keeps."""
    live = live.select("cls", F.expr(_need(link)).alias("need"), F.explode("shared").alias("s"))
    pivot = live.groupBy("s").agg(F.min("cls").alias("region"))
    mass = save(live.join(pivot, "s").groupBy("region", "cls", "need").agg(F.count("*").alias("mass")), "mass")
    crowd = mass.groupBy("region").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    own = mass.join(crowd, "region").groupBy("cls", "need").agg(F.array_sort(F.collect_list(F.struct((-F.col("crowd")).alias("c"), "region", "mass"))).alias("r"))
    walk = F.aggregate(
        "r",
        F.struct(F.lit(0).cast("long").alias("left_out"), F.expr("cast(array() as array<binary>)").alias("keep")),
        lambda a, x: F.when((F.size(a["keep"]) == 0) & (a["left_out"] + x["mass"] < F.col("need")), F.struct((a["left_out"] + x["mass"]).alias("left_out"), a["keep"].alias("keep"))).otherwise(
            F.struct(a["left_out"].alias("left_out"), F.concat(a["keep"], F.array(x["region"])).alias("keep"))
        ),
        lambda a: a["keep"],
    )
    out = save(own.select("cls", F.explode(walk).alias("region")), "regions")
    discard(mass)
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by 0/1 matrix products over the hashes held twice or more. The diagonal counts only those."""
    n = len(sets)
    value, of = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    held = np.bincount(of, minlength=len(value)) > 1
    rank = np.cumsum(held) - 1
    pick = held[of]
    row, column = row[pick], rank[of[pick]]
    both, order, width = np.zeros((n, n), np.float32), np.argsort(column, kind="stable"), 8192 if n > 64 else 1 << 16
    row, column = row[order], column[order]
    for lo in range(0, int(held.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((n, min(width, int(held.sum()) - lo)), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        both += x @ x.T
    return both.astype(np.int64)


def spanning(tied: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs (a, b), a < b, of a 0/1 matrix that join what all its pairs join, and the least member of each one's component."""
    root, out = list(range(len(tied))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(tied, 1))), strict=True):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((a, b))
    return out, np.array([find(x) for x in range(len(tied))], np.int64)


def forest(sets: list[np.ndarray], link: Fraction = LINK) -> list[tuple[int, int]]:
    """Links that join the same sets as all links do."""
    if len(sets) < 2:
        return []
    size = np.array([len(x) for x in sets])
    return spanning(linked(overlaps(sets), size[:, None], size[None], link))[0]


def near(shared: list[np.ndarray], n: np.ndarray, link: Fraction = LINK) -> np.ndarray:
    """Component of each class by the upper bound of intersections that its head's shared shingles give."""
    rest = n - np.array([head_size(k, link) for k in n.tolist()])
    most = np.minimum(overlaps(shared) + np.maximum(rest[:, None], rest[None]), np.minimum(n[:, None], n[None]))
    return spanning(linked(most, n[:, None], n[None], link))[1]


def _sized(members: DataFrame, weight: Column) -> tuple[DataFrame, DataFrame]:
    """(regions that one task can join, the others with size and weight) of members' regions."""
    sizes = save(members.groupBy("region").agg(F.count("*").alias("size"), F.sum(weight).alias("weight")).filter("size > 1"), "sizes")
    fits = (F.col("size") <= 2) | (F.col("size") <= LEAF) & (F.col("weight") <= LEAF_HASHES)
    return sizes.filter(fits).select("region"), sizes.filter(~fits)


def _candidates(regions: DataFrame, live: DataFrame, link: Fraction) -> tuple[DataFrame, DataFrame]:
    """(region, cls, n), saved: classes that heads tie to another one of their region; and those of regions too large for one
    task."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frames:
            regions, classes, sizes = [], [], []
            for names, n, shared in zip(part.column(0), part.column(1), part.column(2), strict=True):
                names, n = names.as_py(), n.values.to_numpy()
                tied = near([x.values.to_numpy() for x in shared], n, link)
                order = np.argsort(tied, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(tied[order])) + 1):
                    if len(own) > 1:
                        own = sorted(own.tolist(), key=names.__getitem__)
                        regions += [hashlib.blake2b(b"".join(names[k] for k in own), digest_size=16).digest()] * len(own)
                        classes += [names[k] for k in own]
                        sizes += n[own].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(regions, pa.binary()), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64())], ["region", "cls", "n"])

    members = regions.join(live, "cls")
    small, large = _sized(members, F.size("shared"))
    held = members.join(small, "region", "left_semi").groupBy("region").agg(F.collect_list(F.struct("cls", "n", "shared")).alias("m"))  # LEAF at most
    tied = in_arrow(held.select(F.col("m.cls").alias("names"), F.col("m.n").alias("n"), F.col("m.shared").alias("shared")), run, "region binary, cls binary, n long")
    whole = regions.join(large, "region", "left_semi").join(live.select("cls", "n"), "cls").select("region", "cls", "n")
    return save(tied.distinct(), "tied"), save(whole, "large")  # the same classes may be tied in several regions


def _recut(members: DataFrame, sets: DataFrame, link: Fraction) -> DataFrame:
    """(region, cls, n), saved: members of large regions in regions of the pivots of their rarest shingles."""
    each = members.join(sets, "cls").select("region", "cls", "n", F.explode("set").alias("s"))
    common = save(each.groupBy("region", "s").agg(F.count("*").alias("df"), F.min("cls").alias("pivot")).filter("df > 1"), "common")
    held = each.join(common, ["region", "s"]).groupBy("region", "cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s", "pivot"))).alias("r"))  # a set's own
    a, b = link.numerator, link.denominator
    first = (F.col("n") - F.expr(f"({a} * n + {b - 1}) div {b}") + 1 - (F.col("n") - F.size("r"))).cast("int")  # shingles that only this set has come first
    kept = held.filter(first > 0).select("region", "cls", "n", F.explode(F.array_distinct(F.transform(F.slice("r", F.lit(1), first), lambda x: x["pivot"]))).alias("pivot"))
    out = save(kept.select(F.unhex(F.md5(F.concat("region", "pivot"))).alias("region"), "cls", "n"), "recut")
    discard(common)
    return out


def _leaves(members: DataFrame, sets: DataFrame, link: Fraction) -> DataFrame:
    """Edges (a, b) inside each region, each small enough for one task."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in frames:
            a, b = [], []
            for names, own in zip(part.column(0), part.column(1), strict=True):
                names = names.as_py()
                for i, j in forest([x.values.to_numpy().view(np.uint64) for x in own], link):
                    a.append(names[i])
                    b.append(names[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    held = members.hint("merge").join(sets, "cls").groupBy("region").agg(F.collect_list(F.struct("cls", "set")).alias("m")).filter(F.size("m") > 1)
    return in_arrow(held.select(F.col("m.cls").alias("names"), F.col("m.set").alias("sets")), run, "a binary, b binary")


def _split(members: DataFrame, sets: DataFrame, sizes: DataFrame, depth: int, link: Fraction) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Voronoi step on large regions: (edges to pivots, members of the sub-regions, regions whose sub-regions would hold more
    pairs than they do, the saved table that the first two read). A region's pivots come ahead of its members in each task."""
    theta = 1 - float(link) + 1e-9
    big = members.join(sizes.withColumn("turns", F.ceil(F.greatest(F.col("size") / TURN, F.col("weight") / LEAF_HASHES)).cast("int")), "region")
    order = Window.partitionBy("region").orderBy(F.xxhash64("cls", F.lit(depth)), "cls")
    wanted = F.least(F.lit(MAX_PIVOTS), PIVOTS * F.ceil(F.col("size") / LEAF))
    pivots = big.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= MAX_PIVOTS).filter(F.col("_k") <= wanted).drop("_k")
    pivots = pivots.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("pivot", F.lit(True))
    own = big.withColumn("turn", F.pmod(F.xxhash64("cls"), F.col("turns")).cast("int")).withColumn("pivot", F.lit(False))
    dealt = pivots.unionByName(own).join(sets, "cls").select("region", "turn", "pivot", "cls", "n", "size", "set")
    dealt = dealt.repartition("region", "turn").sortWithinPartitions("region", "turn", F.desc("pivot"), "cls")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, []
        for part in frames:
            out = []
            columns = [part.column(k).to_pylist() for k in range(6)]
            for k, (region, turn, pivot, name, n, size) in enumerate(zip(*columns, strict=True)):
                own = part.column(6)[k].values.to_numpy().view(np.uint64)
                if pivot:
                    if key != (region, turn):
                        key, known = (region, turn), []
                    known.append((name, own))
                    continue
                d = []
                for _, p in known:
                    both = len(np.intersect1d(own, p, assume_unique=True))
                    d.append(1 - both / (len(own) + len(p) - both))
                for at, (p, _) in enumerate(known):
                    if d[at] <= min(d) + 2 * theta:
                        out.append((hashlib.blake2b(region + p, digest_size=16).digest(), name, n, p, d[at] <= theta, size, region))
            kinds = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["region", "cls", "n", "pivot", "near", "size", "of"])

    dealt = save(in_arrow(dealt, run, "region binary, cls binary, n long, pivot binary, near boolean, size long, of binary"), "voronoi")
    loose = dealt.groupBy("of", "size", "region").agg(F.count("*").cast("double").alias("n"), F.bool_and("near").alias("all_near")).filter(~F.col("all_near"))
    loose = save(loose, "loose")
    whole = loose.groupBy("of", "size").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).filter(F.col("pairs") > F.col("size").cast("double") * F.col("size"))
    whole = save(whole.select(F.col("of").alias("region")), "whole")
    parts = loose.join(whole.select(F.col("region").alias("of")), "of", "left_anti").select("region")
    close = dealt.filter("near and cls != pivot").select(F.col("pivot").alias("a"), F.col("cls").alias("b"))
    return close, dealt.join(parts, "region").select("region", "cls", "n"), sizes.join(whole, "region"), dealt


def _blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every two half-leaf blocks of a region as a region of its own: exact for regions that will not shrink."""
    n = F.greatest(F.ceil(F.col("size") / (LEAF // 2)), F.least(F.ceil(F.col("weight") / (LEAF_HASHES // 2)), "size"), F.lit(2)).cast("int")
    own = members.join(sizes, "region").withColumn("k_n", n).withColumn("k", F.pmod(F.xxhash64("cls", F.lit(99)), F.col("k_n")).cast("int"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k_n") - 1))).filter("o != k")  # a block's own pairs are in its other regions
    return own.select(F.unhex(F.md5(F.concat("region", F.encode(F.concat_ws("-", F.least("k", "o"), F.greatest("k", "o")), "UTF-8")))).alias("region"), "cls", "n")


def _links(members: DataFrame, sets: DataFrame, link: Fraction) -> DataFrame:
    """Edges of all regions of a saved table (region, cls, n), which goes when its links are found."""
    edges, depth = [], 0
    while True:
        small, big = _sized(members, F.col("n"))
        edges.append(save(_leaves(members.join(small, "region", "left_semi"), sets, link), "links"))
        if not big.count():
            break
        if depth == DEPTH:
            edges.append(save(_leaves(_blocks(members, big), sets, link), "links"))
            break
        close, parts, whole, dealt = _split(members, sets, big, depth, link)
        edges += [save(close, "links"), save(_leaves(_blocks(members, whole), sets, link), "links")]
        discard(members)
        members, depth = save(parts, "members"), depth + 1
        discard(dealt)
    discard(members)
    return reduce(DataFrame.unionByName, edges)


def groups(documents: DataFrame, words: int = WORDS, link: Fraction = LINK) -> DataFrame:
    """doc_id, mark (hash of the text), root (names the group; null without words), n_shingles, component_id for each row."""
    heads = save(_heads(documents, words, link), "heads")
    rows = save(heads.select("doc_id", "mark", "cls", "n"), "rows")
    live = _live(heads.select("cls", "n", "head"), link)
    discard(heads)
    regions = _regions(live, link)
    tied, large = _candidates(regions, live, link)
    discard(live)
    discard(regions)
    sets = _sets(documents, rows, tied.select("cls").unionByName(large.select("cls")).distinct(), words)
    members = tied
    if large.limit(1).count():
        recut = _recut(large, sets, link)
        members = save(tied.unionByName(recut), "members")
        discard(tied)
        discard(recut)
    discard(large)
    edges = _links(members, sets, link)
    discard(sets)
    roots = components(edges)
    of = rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "cls")))
    low = of.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = of.join(low, "root", "left")
    return out.select("doc_id", "mark", "root", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _sets(documents: DataFrame, rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, set), saved, of the wanted classes, from one text of each."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames):
            sets = shingles(Texts(part.column(1), lower=True), words)
            yield pa.RecordBatch.from_arrays([part.column(0), _names(sets), _lists(sets)], ["cls", "own", "set"])

    held = rows.join(wanted, "cls").groupBy("cls", "doc_id", "mark").agg(F.count("*").alias("n"))
    one = save(held.groupBy("cls").agg(F.min(F.struct("doc_id", "mark", "n")).alias("o")).select("cls", F.col("o.doc_id").alias("_d"), F.col("o.mark").alias("_m"), F.col("o.n").alias("n")), "one")
    both = _own(documents).join(one.hint("merge"), (F.col("mark") == F.col("_m")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    found = in_arrow(both.select("cls", "text"), run, "cls binary, own binary, set array<long>").filter("cls = own").drop("own")
    if one.filter("n > 1").limit(1).count():  # rows that repeat both an id and a text
        found = found.dropDuplicates(["cls"])
    return save(found, "sets")


def digest(documents: DataFrame) -> DataFrame:
    return groups(documents).select("doc_id", "n_shingles", "component_id")


def apply(documents: DataFrame, words: int = 5, link: Fraction = Fraction(4, 5)) -> DataFrame:
    """One document of each group: the row of the smallest doc_id (null last), of that id's texts the one of the least hash.
    Rows without words, null texts among them, all stay; an empty table stays empty; other columns pass through, whatever their
    names. Near-duplicate stages take five words and a similarity of 0.8."""
    found = save(groups(documents, words, link).filter("root is not null"), "groups")
    each = found.groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    keep = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "n")).alias("o"))
    keep = save(keep.select(F.col("o.doc_id").alias("d"), F.col("o.mark").alias("m"), F.col("o.n").alias("n")), "keep")
    own = documents.select(boxed(documents).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("worded"))
    held = own.join(keep, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").filter("not worded or n is not null")
    if keep.filter("n > 1").limit(1).count():  # rows that repeat an id with its text are one document
        repeated = held.filter("worded and n > 1").dropDuplicates(["doc_id", "mark"])
        held = held.filter("not worded or n = 1").unionByName(repeated)
    return held.select(*unboxed(documents.columns))
