"""Model-based enrichment with an injected `analyze(prompt) -> str`; no network here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.schemas import GUIDE_META

RESULT = "gameName STRING, platform STRING, author STRING, tags ARRAY<STRING>, summary STRING"
METADATA_PROMPT = "Read the guide and answer with one JSON object with the keys gameName, platform, author and tags (a list of short words)."
SUMMARY_PROMPT = "Summarise the guide in two or three sentences."


def prompt(instruction: str, title: Column, content: Column) -> Column:
    body = F.substring(F.concat(F.lit("Title: "), title, F.lit("\n\n"), content), 1, T.PREFIX)
    return F.concat(F.lit(f"{instruction}\n\nGuide content (first {T.PREFIX} characters):\n"), body)


def from_answer(answer: Column) -> Column:
    """struct of gameName, platform, author, tags from a model's answer: the outermost braces as JSON, falsy values missing,
    tags only if a list, its strings only. Null fields where no braces are; null where they hold no JSON."""
    found = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    field = lambda k: T.blank_null(F.try_variant_get(F.try_parse_json(found), f"$.{k}", "string"))
    tags = F.try_variant_get(F.try_parse_json(found), "$.tags", "array<variant>")
    strings = F.transform(F.filter(tags, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.when(found == "", F.struct(*[F.lit(None).cast("string").alias(k) for k in ("gameName", "platform", "author")], F.lit(None).cast("array<string>").alias("tags"))).when(
        F.try_parse_json(found).isNotNull(), F.struct(*[field(k).alias(k) for k in ("gameName", "platform", "author")], strings.alias("tags"))
    )


def run_batch(guides: DataFrame, analyze: Callable[[str], str]) -> DataFrame:
    """(id, result, error): two calls a row, one row's failure does not touch another. The result is lazy: write it before it is
    counted or read twice, or the model is called again."""
    asked = guides.select("id", prompt(METADATA_PROMPT, F.col("title"), F.col("content")).alias("a"), prompt(SUMMARY_PROMPT, F.col("title"), F.col("content")).alias("b"))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    out.append((row.id, analyze(row.a), analyze(row.b), None))
                except Exception as e:  # noqa: BLE001  told in the row
                    out.append((row.id, None, None, str(e)))
            yield pd.DataFrame(out, columns=["id", "answer", "summary", "error"])

    answered = asked.mapInPandas(call, f"id {guides.schema['id'].dataType.simpleString()}, answer string, summary string, error string")
    parsed = from_answer(F.col("answer"))
    error = F.coalesce("error", F.when(F.col("answer").isNotNull() & parsed.isNull(), F.lit("answer is not JSON")))
    result = F.when(error.isNull(), F.struct(parsed["gameName"].alias("gameName"), parsed["platform"].alias("platform"), parsed["author"].alias("author"), parsed["tags"].alias("tags"), T.blank_null(F.col("summary")).alias("summary")))
    return answered.select("id", result.alias("result"), error.alias("error"))


def merge(existing: Column, result: Column) -> Column:
    """The result with platform, author and tags of the existing metadata where it has none."""
    old = F.from_json(existing, GUIDE_META)
    return F.struct(
        result["gameName"].alias("gameName"), F.coalesce(result["platform"], T.blank_null(old["platform"])).alias("platform"), F.coalesce(result["author"], T.blank_null(old["author"])).alias("author"),
        F.when(F.coalesce(F.size(result["tags"]), F.lit(0)) > 0, result["tags"]).otherwise(F.when(F.size(old["tags"]) > 0, old["tags"]).otherwise(result["tags"])).alias("tags"),
        result["summary"].alias("summary"),
    )


def _fields(metadata: Column) -> Column:
    """Metadata as map<string, variant>: every key it has, known here or not; an empty map where it is absent or no object."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(metadata), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))


def _merged(metadata: Column, new: dict[str, Column]) -> Column:
    """metadata with the keys of `new` set, or taken out where the value is null; all other keys stay as they are."""
    keys = F.array(*map(F.lit, new))
    values = F.map_from_arrays(keys, F.array(*[F.try_parse_json(F.to_json(F.struct(v.alias("v")))) for v in new.values()]))
    held = F.transform_values(values, lambda k, v: F.try_variant_get(v, "$.v", "variant"))
    kept = F.map_filter(_fields(metadata), lambda k, v: ~F.array_contains(keys, k))
    return F.to_json(F.map_concat(kept, F.map_filter(held, lambda k, v: v.isNotNull())))


def saved(existing: Column, merged: Column, now: int, error: Column | None = None) -> Column:
    """Metadata JSON after analysis: keys of the analysis win, a missing gameName or tags erases the old one, and a missing
    platform, author or summary leaves it. Other keys stay."""
    old = F.from_json(existing, GUIDE_META)
    new = {k: F.coalesce(merged[k], old[k]) for k in ("platform", "author", "summary")} | {k: merged[k] for k in ("tags", "gameName")}
    return _merged(existing, new | {"aiAnalyzedAt": F.lit(now).cast("long"), "aiAnalysisError": error if error is not None else F.lit(None).cast("string")})


def analyse_all(guides: DataFrame, analyze: Callable[[str], str], now: int) -> DataFrame:
    """Every unanalysed guide in one pass; a failure is marked with aiAnalysisError so that it is not tried again."""
    todo = guides.filter(F.col("ai_analyzed_at").isNull())
    done = run_batch(todo, analyze)
    rows = todo.join(done, "id")
    ok = saved(F.col("metadata"), merge(F.col("metadata"), F.col("result")), now)
    bad = _merged(F.col("metadata"), {"aiAnalyzedAt": F.lit(now).cast("long"), "aiAnalysisError": F.col("error")})
    return rows.select("id", F.when(F.col("error").isNull(), ok).otherwise(bad).alias("metadata"), F.lit(now).cast("long").alias("ai_analyzed_at"), "error")


def select_save(guides: DataFrame, fields: dict, now: int) -> DataFrame:
    """Metadata of each guide with the allowed fields replaced and all other keys kept; a gameName also becomes the title."""
    value = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)
    new = {k: value(v) for k, v in fields.items() if k in ("platform", "author", "tags", "summary", "gameName")}
    meta = _merged(F.col("metadata"), new | {"aiAnalyzedAt": F.lit(now).cast("long")})
    out = guides.withColumn("metadata", meta)
    return out.withColumn("title", F.lit(fields["gameName"])) if fields.get("gameName") else out.withColumn("ai_analyzed_at", F.lit(now).cast("long"))


def diff(existing: Column, result: Column) -> Column:
    """Names of the fields that a preview would change; missing new values change nothing."""
    old = F.from_json(existing, GUIDE_META)
    return F.array_compact(F.array(*[F.when(result[k].isNotNull() & ~F.to_json(F.struct(result[k].alias("x"))).eqNullSafe(F.to_json(F.struct(old[k].alias("x")))), F.lit(k)) for k in ("gameName", "platform", "author", "tags", "summary")]))


def counters(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("processed"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
