"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Every source gets a target of words: its weight's part of RATIO times all words, at most CAP times its own words, the excess
shared again by weight. A document is to be copied target / source words times. The whole part is given at once; the
fraction p is settled by pivotal rounding: two documents meet, words move from one to the other in a random direction whose
odds keep each expectation, until one fraction is 0 or 1; the other goes on. Moving words, not copies, keeps the sum of
size * p, so a source misses its target by less than one document.

The fold runs inside blocks of about BLOCK documents; each block hands its one open fraction up a reduction tree, level by
level, until a source has one left, which a fair draw settles. Rows equal in source, doc_id and text are first counted
together, so neither a hot source, a hot document id nor a table of repeats lands in one task. Random numbers are hashes of
SEED and row values: reruns agree, whatever the partitioning.

Defined results: null text has size 0; sources are ordered by code point, null last, and null is a source of its own; rows of
size 0 are taken 0 words; a null doc_id is an ordinary value; repeated rows share their copies evenly; an empty table gives
an empty result; apply() passes other columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import boxed, let, ranged, running_total, save, unboxed, word_count

WEIGHTS, RATIO, CAP, BLOCK, SEED = (5, 2, 1), 1.5, 2.0, 64, 17
#: A table of sources is broadcast up to this many rows; beyond it Spark joins by shuffle.
SMALL = 50_000
#: Repeats of a row that are laid out from one array.
SPREAD = 1 << 12
_TINY = 1e-9


def targets(units: DataFrame) -> DataFrame:
    """source, source_size, target for (source, size, m) rows. Water filling: each pass is one aggregate of two numbers."""
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("units"))
    order = [F.col("source").asc_nulls_last()]
    ranked = running_total(ranged(per, order, "sources"), order, F.lit(1), "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = save(ranked.select("source", "source_size", "units", weight.alias("weight"), (CAP * F.col("source_size")).alias("most")), "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while total and level != before:
        full = F.col("weight") * level > F.col("most")
        capped, open_ = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, (RATIO * total - capped) / open_ if open_ else level
    return ranked.select("source", "source_size", "units", F.least("most", F.col("weight") * level).alias("target"))


def _fold() -> Column:
    """Pivotal rounding along one block's sorted `items`: struct(open item or null, settled items)."""

    def meet(acc: Column, x: Column) -> Column:
        i, j = acc["open"], x
        give, take = F.least(i["size"] * i["p"], j["size"] * (1 - j["p"])), F.least(j["size"] * j["p"], i["size"] * (1 - i["p"]))
        draw = F.pmod(F.xxhash64(F.lit(SEED), i["h"], j["h"], j["size"]), F.lit(1 << 52)) / float(1 << 52)

        def move(s: Column) -> Column:
            d = F.when(s["draw"] * (s["give"] + s["take"]) < s["take"], -s["give"]).otherwise(s["take"])
            return let(d, lambda d: F.array(i.withField("p", _snap(i["p"] + d / i["size"])), j.withField("p", _snap(j["p"] - d / j["size"]))))

        both = F.when(i.isNull(), F.array(j)).otherwise(let(F.struct(give.alias("give"), take.alias("take"), draw.alias("draw")), move))
        return let(
            both,
            lambda b: F.struct(
                F.get(F.filter(b, lambda y: (y["p"] > 0) & (y["p"] < 1)), F.lit(0)).alias("open"),
                F.concat(acc["done"], F.filter(b, lambda y: (y["p"] == 0) | (y["p"] == 1))).alias("done"),
            ),
        )

    items = F.array_sort("items")
    none = F.filter(F.col("items"), lambda x: F.lit(False))
    return F.aggregate(items, F.struct(F.get(none, F.lit(0)).alias("open"), none.alias("done")), meet)


def _snap(p: Column) -> Column:
    return F.when(p < _TINY, 0.0).when(p > 1 - _TINY, 1.0).otherwise(p)


def plan(documents: DataFrame) -> DataFrame:
    """For rows equal in source, doc_id and text (mark is its hash), m of them: source, doc_id, mark, size, m, source_size, target,
    base, extra: each is taken `base` times, `extra` of them once more."""
    rows = documents.select("doc_id", "source", F.xxhash64("text").alias("mark"), word_count(F.col("text")).alias("size"))
    units = save(rows.groupBy("source", "doc_id", "mark", "size").agg(F.count("*").alias("m")), "units")
    per = save(targets(units), "targets")
    n = per.count()
    per = F.broadcast(per) if n <= SMALL else per
    of_source = per.select(F.col("source").alias("_s"), "source_size", "units", "target")
    own = units.join(of_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = F.col("m") * (F.col("rate") - F.floor("rate"))
    own = own.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long")).withColumn("full", F.floor(share + _TINY).cast("long"))
    own = own.withColumn("p", F.when(F.col("size") > 0, _snap(share - F.col("full"))).otherwise(0.0))
    h = F.xxhash64(F.lit(SEED), "source", "doc_id", "mark", "size")
    item = F.struct(h.alias("h"), F.col("size").cast("double").alias("size"), "p", "doc_id", "mark", "m", "base", "full")
    blocks = F.ceil(F.col("units") / BLOCK).cast("long")
    level = own.filter((F.col("p") > 0) & (F.col("p") < 1)).select("source", F.pmod(h, blocks).alias("block"), item.alias("item"))
    sure = own.filter((F.col("p") == 0) | (F.col("p") == 1)).select("source", item.alias("item"))
    settled, most = [sure], per.agg(F.max(blocks.alias("b"))).first()[0] or 0
    while True:
        folded = level.groupBy("source", "block").agg(F.collect_list("item").alias("items")).select("source", "block", _fold().alias("f"))
        folded = save(folded.select("source", "block", F.col("f.open").alias("open"), F.col("f.done").alias("done")), "level")
        settled.append(folded.select("source", F.explode("done").alias("item")))
        level = folded.filter(F.col("open").isNotNull()).select("source", F.expr(f"block div {BLOCK}").alias("block"), F.col("open").alias("item"))
        if most <= 1:
            break
        most = -(-most // BLOCK)
    draw = F.pmod(F.xxhash64(F.lit(SEED + 1), "item.h"), F.lit(1 << 52)) / float(1 << 52)
    last = level.select("source", F.col("item").withField("p", F.when(draw < F.col("item.p"), 1.0).otherwise(0.0)).alias("item"))
    out = last
    for part in settled:
        out = out.unionByName(part)
    out = out.select("source", "item.*").join(of_source.drop("units"), F.col("source").eqNullSafe(F.col("_s")))
    return out.select("source", "doc_id", "mark", F.col("size").cast("long").alias("size"), "m", "source_size", "target", "base", (F.col("full") + F.col("p").cast("long")).alias("extra"))


def mix(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, source, size, source_size, target, copies."""
    # two levels, so that no row holds an array of all its repeats
    spread = plan(documents).withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(SPREAD).cast("long"))))
    spread = spread.withColumn("k", F.explode(F.sequence(F.col("lo") + 1, F.least(F.col("m"), F.col("lo") + SPREAD))))
    return spread.select("doc_id", "source", "size", "source_size", "target", (F.col("base") + (F.col("k") <= F.col("extra")).cast("long")).alias("copies"))


def digest(documents: DataFrame) -> DataFrame:
    return mix(documents).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def apply(documents: DataFrame) -> DataFrame:
    """documents as the mix takes them: a row for each copy, all columns. Rows equal in source, doc_id and text are numbered
    within the partitions of a saved table, so that however many there are no task holds all."""
    units = save(plan(documents).select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("mark").alias("k"), "m", "base", "extra"), "plan")
    own = documents.select(boxed(documents).alias("_row"), "source", "doc_id", F.xxhash64("text").alias("mark"))
    on = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("k"))
    # rows that are taken nowhere need no partner
    held = own.join(units.filter("base + extra > 0"), on).select("_row", "s", "d", "k", "m", "base", "extra")
    out = held.filter("m = 1").select("_row", (F.col("base") + F.col("extra")).alias("copies"))
    if units.filter("m > 1").limit(1).count():
        many = save(held.filter("m > 1").withColumn("part", F.spark_partition_id()), "repeated")
        key = ["s", "d", "k"]
        tally = many.groupBy(*key, "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        tally = tally.select(F.struct(*key, "part").alias("g"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
        number = F.row_number().over(Window.partitionBy("part", *key).orderBy(F.xxhash64("_row")))
        ranked = many.withColumn("number", number).withColumn("h", F.struct(*key, "part")).join(tally, F.col("h").eqNullSafe(F.col("g")))
        out = out.unionByName(ranked.select("_row", (F.col("base") + (F.col("number") + F.col("ahead") <= F.col("extra")).cast("long")).alias("copies")))
    return out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*unboxed(documents.columns))
