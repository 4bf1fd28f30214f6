"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

rules() measures each document; fit() looks at the labelled documents of each stratum (the language) that pass the base
rules. A hash of the id puts half of them aside. On the first half each rule gets the cutoff above which it rejects most bad
documents, less PRICE for each good one, and rules are ranked by that gain. The second half tests the rule sets of the first
rule, the first two and so on, in this order: a set is allowed if the exact binomial tail P[Bin(n, RISK) <= k] is at most DELTA
/ strata, n being the good documents put aside and k those of them that the set rejects; the first set that fails ends it. As
each test is only made where all before it have passed, this fixed sequence needs no further correction (Bonferroni is over
strata alone): with probability 1 - DELTA no stratum loses more than RISK of its good documents to the sets allowed, over all
tests at once. RISK bounds the set as a whole, so 60 to 90 good documents put aside can allow one.

Defined results: null text has no words and fails the base rules; a document with several labels counts once, as good only
if all are 1; null labels count as none; null language is a stratum; repeated rows keep a row each; no labels at all leave
the base rules alone; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import SPACE, WORD, let, save

RISK, DELTA, PRICE = 0.05, 0.05, 9.0
#: rule: (expression over the measures, cutoffs). A document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.02 * i for i in range(1, 21)]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.05 * i for i in range(1, 20)]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.01 * i for i in range(1, 20)]),
    "long_words": ("word_chars / greatest(n_words, 1)", [6.0 + 0.5 * i for i in range(20)]),
    "short_words": ("-word_chars / greatest(n_words, 1)", [-5.0 + 0.2 * i for i in range(20)]),
}
MAX_TERMS = 20_000


def _repeats(words: Column, n: Column) -> Column:
    """Words inside 5-word windows that occur twice or more. Hashes tell which texts have any; exact windows count them."""

    def exact(w: Column) -> Column:
        runs = F.array_sort(F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 5)).alias("g"), i.alias("i"))))

        def cover(s: Column) -> Column:
            twin = lambda x, j: F.coalesce((x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]), x["g"] == F.get(s, j - 1)["g"], x["g"] == F.get(s, j + 1)["g"], F.lit(False))
            at = F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"]))
            start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
            step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).cast("long").alias("n"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        return let(runs, cover)

    def screen(h: Column) -> Column:
        five = F.transform(F.slice(h, F.lit(1), n - 4), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2), F.get(h, i + 3), F.get(h, i + 4)))
        return let(five, lambda g: F.size(F.array_distinct(g)) < F.size(g))

    some = let(F.transform(words, lambda x: F.xxhash64(x)), screen)
    return F.when(n < 6, F.lit(0).cast("long")).when(some, exact(words)).otherwise(F.lit(0).cast("long"))


def rules(documents: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the `keep` columns and the measures of each document's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def measure(w: Column) -> Column:
        n = F.size(w)
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
            _repeats(w, n).alias("n_repeat_words"),
        )

    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    out = documents.select("doc_id", *keep, let(words, measure).alias("m"))
    out = out.select("doc_id", *keep, "m.n_words", "m.word_chars", "m.n_symbols", F.col("m.l.n").alias("n_lines"), F.col("m.l.dup").alias("n_dup_lines"), "m.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up; exact to about 1e-13 for x >= 1."""
    z, down = x + 8.0, F.lit(0.0)
    for i in range(8):
        down = down + F.log(x + float(i))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P[Bin(n, p) <= k]; 1 where k is not below the mean. Terms fall from k downwards; what MAX_TERMS leaves is bounded by its
    geometric series, so the value is never too small."""
    k, n = k.cast("double"), n.cast("double")
    log_top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)  # noqa: E731  of term i - 1 to term i
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"), k.alias("i"))
    step = lambda a, _: let(a["t"] * ratio(a["i"]), lambda t: F.struct(t.alias("t"), (a["s"] + t).alias("s"), (a["i"] - 1).alias("i")))
    rest = lambda a: a["s"] + F.when(a["i"] > 0, a["t"] / (1 - ratio(a["i"]))).otherwise(0.0)
    terms = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(k, F.lit(float(MAX_TERMS))).cast("int")))
    total = F.when(k < 1, 1.0).otherwise(F.aggregate(terms, start, step, rest))
    return F.when((n <= 0) | (k >= n * p), 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_top) * total))


def _values() -> Column:
    """An array of (rule, value) for a row of measures."""
    return F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(f"cast({e} as double)").alias("value")) for r, (e, _) in RULES.items()])


def _chosen(held: DataFrame) -> DataFrame:
    """stratum, chosen: array of (rank, rule, cutoff) from the documents to choose by. Each turns into counts of cutoffs passed
    before the exchange; nothing but these sums is shuffled."""
    grid = F.map_from_arrays(F.array(*[F.lit(r) for r in RULES]), F.array(*[F.array(*[F.lit(float(c)) for c in cs]) for _, cs in RULES.values()]))
    each = held.select("stratum", "good", F.explode("values").alias("v"))
    each = each.select("stratum", "good", "v.rule", F.size(F.filter(F.element_at(grid, F.col("v.rule")), lambda c: F.col("v.value") > c)).alias("above"))
    each = each.groupBy("stratum", "rule", "above").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    # `above` cutoffs are exceeded: the document counts for each of the first `above`, the cutoffs being in ascending order
    per = each.groupBy("stratum", "rule").agg(F.collect_list(F.struct("above", "g", "b")).alias("at"))  # a row for each cutoff at most
    tried = per.select("stratum", "rule", "at", F.posexplode(F.element_at(grid, F.col("rule"))).alias("i", "cutoff"))
    summed = lambda f: F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["above"] > F.col("i"), x[f]).otherwise(0))
    gain = (summed("b") - PRICE * summed("g")).alias("gain")
    best = tried.select("stratum", "rule", "cutoff", gain).filter("gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("b"))
    order = Window.partitionBy("stratum").orderBy(F.desc("b.gain"), "rule")  # a row for each rule
    ranked = best.select("stratum", F.row_number().over(order).alias("rank"), "rule", "b.cutoff")
    return ranked.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("rank", "rule", "cutoff"))).alias("chosen"))


def fit(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, rank, rule, cutoff of the rules allowed, with the counts n and k and the tail of the set that each completes."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    own = measured.filter(~F.col("base_failed")).select("doc_id", F.struct("stratum", _values().alias("values")).alias("m"))
    held = own.join(marks, "doc_id").groupBy("doc_id").agg(F.min("m").alias("m"), (F.min("good") == 1).alias("good"))
    held = save(held.select("m.*", "good", (F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(2)) == 0).alias("chooses")), "labelled")
    chosen = save(_chosen(held.filter("chooses")).select(F.col("stratum").alias("s"), "chosen"), "chosen")
    n_strata = chosen.count()
    tests = held.filter("good and not chooses").join(chosen, F.col("stratum").eqNullSafe(F.col("s")))
    exceeds = lambda c: F.exists("values", lambda v: (v["rule"] == c["rule"]) & (v["value"] > c["cutoff"]))
    first = F.array_min(F.transform(F.filter("chosen", exceeds), lambda c: c["rank"]))
    counts = tests.groupBy("s", first.alias("first")).agg(F.count("*").alias("c"))
    per = counts.groupBy(F.col("s").alias("of")).agg(F.sum("c").alias("n"), F.collect_list(F.struct("first", "c")).alias("at"))  # a row for each rule at most
    sets = chosen.join(per, F.col("s").eqNullSafe(F.col("of"))).select(F.col("s").alias("stratum"), "n", "at", F.explode("chosen").alias("c"))
    k = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["first"] <= F.col("c.rank"), x["c"]).otherwise(0))
    sets = sets.select("stratum", "c.*", "n", k.alias("k")).withColumn("tail", binomial_tail(F.col("k"), F.col("n"), RISK))
    failed = F.max(F.when(F.col("tail") > DELTA / max(1, n_strata), 1).otherwise(0)).over(Window.partitionBy("stratum").orderBy("rank"))
    return sets.withColumn("failed", failed).filter("failed = 0").drop("failed")


def verdicts(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    measured = save(rules(documents.withColumn("stratum", F.col(stratum).cast("string")), "stratum"), "measured")
    cuts = fit(measured, labels).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    cuts = save(cuts, "cutoffs").select(F.col("stratum").alias("_s"), "cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= 10_000 else cuts
    out = measured.join(cuts, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    over = F.exists(_values(), lambda v: F.coalesce(v["value"] > F.try_element_at("cuts", v["rule"]), F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~over).drop("_s", "cuts")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return verdicts(documents, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
