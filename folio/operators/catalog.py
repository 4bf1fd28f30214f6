"""Catalogue queries: DataFrame in, DataFrame out; Catalyst sees every predicate, join and limit.

Where the order of equal keys is not defined, id breaks the tie. JSON predicates read the metadata text; large catalogues
should materialise guide_tags() and guide_platforms(), which the tag predicates take as tables.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import params
from folio.functions import text as T
from folio.functions.params import TITLE_LIMIT
from folio.schemas import GAME_META, GUIDE_META

SUMMARY = ("id", "title", "format", "file_path", "game_id", "last_read_position", "metadata", "created_at", "updated_at")
HIT = ("id", "title", "format", "file_path", "game_id", "metadata", "created_at", "updated_at")


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0, key: str = "id") -> DataFrame:
    return df.orderBy(*order, F.col(key)).offset(offset).limit(limit)


def by_id(df: DataFrame, value: str, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value).limit(1)


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ids, in no order; ids may be a table of any size."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def by_ids_ordered(df: DataFrame, ids: list, key: str = "id", most: int = 100) -> DataFrame:
    """Rows of a request's ids, `most` at most, in the request's order; unknown ids give no row, repeated ones one."""
    wanted = list(dict.fromkeys(ids))[:most]
    if not wanted:
        return df.limit(0)
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col(key).cast(df.schema[key].dataType))
    return df.filter(F.col(key).isin(wanted)).orderBy(place)


def rows_of(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == value)


def first_of(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by `order`, aggregated before it is shuffled; a null key has no row."""
    rest = [c for c in df.columns if c != key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(first).select(key, "_first.*")


def json_field(name: str, column: str = "metadata") -> Column:
    return F.get_json_object(column, f"$.{name}")


# guides ---------------------------------------------------------------------------------------------------------------


def guides(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(df, [F.desc("updated_at")], limit, offset)


def guides_of_game(df: DataFrame, game_id: str) -> DataFrame:
    return df.filter(F.col("game_id") == game_id).orderBy("title", "id").drop("content", "last_read_position")


def hits(df: DataFrame) -> DataFrame:
    """What a search shows of a guide."""
    return df.select(*HIT)


def summary(df: DataFrame) -> DataFrame:
    return df.select(*SUMMARY, F.length("content").cast("long").alias("content_length"))


def guide_filter(df: DataFrame, platform: str | None = None, tags: list[str] | None = None, match: str = "any", tag_table: DataFrame | None = None) -> DataFrame:
    if platform:
        df = df.filter(json_field("platform") == platform)
    if tags:
        wanted = sorted(set(tags))
        if tag_table is None:  # a predicate on the row's own array: no shuffle
            own = F.coalesce(F.from_json(json_field("tags"), "array<string>"), F.array().cast("array<string>"))
            asked = F.array(*map(F.lit, wanted))
            return df.filter(F.size(F.array_intersect(own, asked)) == len(wanted) if match == "all" else F.arrays_overlap(own, asked))
        table = tag_table
        held = table.filter(F.col("tag").isin(wanted))
        if match == "all":
            held = held.groupBy("guide_id").agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(wanted))
        df = df.join(held.select(F.col("guide_id").alias("id")), "id", "left_semi")
    return df


def guide_page(df: DataFrame, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    return summary(page(guide_filter(df, **filters), [F.desc("updated_at")], limit, offset)).orderBy(F.desc("updated_at"), "id")


def metadata(df: DataFrame, game: bool = False) -> DataFrame:
    """The parsed metadata; null where it is absent or not JSON."""
    return df.select("id", F.from_json("metadata", GAME_META if game else GUIDE_META).alias("metadata"))


def recently_read(df: DataFrame, limit: int = 10) -> DataFrame:
    return page(df.filter(F.col("last_read_position").isNotNull()), [F.desc("updated_at")], limit)


def missing(df: DataFrame, what: str, limit: int = 100) -> DataFrame:
    """what: metadata, tags or summary."""
    if what == "metadata":
        lack = json_field("aiAnalyzedAt").isNull()
    elif what == "tags":
        lack = F.coalesce(F.json_array_length(json_field("tags")), F.lit(0)) == 0
    else:
        lack = F.coalesce(json_field("summary"), F.lit("")) == ""
    return page(df.filter(F.col("metadata").isNull() | lack), [], limit)


def unanalysed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ai_analyzed_at").isNull())


def with_games(df: DataFrame, games: DataFrame) -> DataFrame:
    g = games.select(F.struct("id", "title", "platform", "artwork_url").alias("game"))
    guide = F.struct(*[c for c in df.columns if c != "ai_analyzed_at"])
    joined = df.select(guide.alias("guide")).join(g, F.col("guide.game_id") == F.col("game.id"), "left")
    return joined.select("guide", F.when(F.col("game.id").isNotNull(), F.col("game")).alias("game")).orderBy(F.desc("guide.updated_at"), "guide.id")


def content(df: DataFrame, guide_id: str) -> DataFrame:
    return by_id(df, guide_id).select("content", T.mime(F.col("format")).alias("mime"), T.download_name(F.col("title"), F.col("format")).alias("filename"))


# derived tables -------------------------------------------------------------------------------------------------------


def guide_tags(df: DataFrame) -> DataFrame:
    tags = F.from_json(json_field("tags"), "array<string>")
    return df.select(F.col("id").alias("guide_id"), F.explode(tags).alias("tag")).filter(F.col("tag").isNotNull()).distinct()


def guide_platforms(df: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Distinct platforms; with the table of a former state, those ever seen."""
    now = df.select(json_field("platform").alias("platform")).filter(F.col("platform").isNotNull())
    return (now if before is None else now.unionByName(before.select("platform"))).distinct()


def listed(df: DataFrame, column: str, empty: bool = False) -> DataFrame:
    """Distinct values in ascending order, without null and, unless asked for, without the empty text."""
    c = F.col(column)
    return df.select(column).filter(c.isNotNull() if empty else c.isNotNull() & (c != "")).distinct().orderBy(column)


# games ----------------------------------------------------------------------------------------------------------------


def games(df: DataFrame, limit: int = 100, offset: int = 0, platform: str | None = None, status: str | None = None) -> DataFrame:
    return page(game_filter(df, platform, status), [F.col("title")], limit, offset)


def game_filter(df: DataFrame, platform: str | None = None, status: str | None = None) -> DataFrame:
    preds = [F.col(k) == v for k, v in (("platform", platform), ("status", status)) if v]
    return df.filter(reduce(and_, preds)) if preds else df


def games_by_status(df: DataFrame, status: str) -> DataFrame:
    return df.filter(F.col("status") == status).orderBy(F.desc("updated_at"), "id")


def search_titles(df: DataFrame, query: str) -> DataFrame:
    if not query.strip():
        raise ValueError("query is blank")
    return page(df.filter(T.like_ascii(F.col("title"), f"%{query.strip()}%")), [F.col("title")], TITLE_LIMIT)


def by_external_id(df: DataFrame, value: str) -> DataFrame:
    return df.filter(json_field("external_id") == value).orderBy("id").limit(1)


def with_guide_count(df: DataFrame, guide_rows: DataFrame) -> DataFrame:
    """Guides are counted by game before the join: a game with most of the guides is one row by then."""
    n = guide_rows.filter(F.col("game_id").isNotNull()).groupBy("game_id").agg(F.count("*").alias("n"))
    return df.join(n, df["id"] == n["game_id"], "left").withColumn("guide_count", F.coalesce("n", F.lit(0))).drop("n", "game_id").orderBy("title", "id")


# notes, bookmarks -----------------------------------------------------------------------------------------------------


def notes_of(df: DataFrame, guide_id: str) -> DataFrame:
    return df.filter(F.col("guide_id") == guide_id).orderBy(F.asc_nulls_last("position"), "created_at", "id")


def notes_in_order(df: DataFrame) -> DataFrame:
    """All notes with their place among those of their guide, from 1."""
    order = Window.partitionBy("guide_id").orderBy(F.asc_nulls_last("position"), "created_at", "id")
    return df.withColumn("place", F.row_number().over(order))


def bookmarks_of(df: DataFrame, guide_id: str) -> DataFrame:
    return df.filter(F.col("guide_id") == guide_id).orderBy("position", "id")


def owned(df: DataFrame, row_id: str, guide_id: str) -> DataFrame:
    return df.filter((F.col("id") == row_id) & (F.col("guide_id") == guide_id))


def with_parent(children: DataFrame, parents: DataFrame, key: str = "guide_id", found: bool = True) -> DataFrame:
    return children.join(parents.select(F.col("id").alias(key)), key, "left_semi" if found else "left_anti")


# statistics -----------------------------------------------------------------------------------------------------------


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def by_format(df: DataFrame) -> DataFrame:
    return df.groupBy("format").agg(F.count("*").alias("count"))


def games_with_guides(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("game_id").alias("with_guides"))


def import_stats(df: DataFrame, games_: DataFrame) -> DataFrame:
    """Over all rows; empty text counts as missing, as null does."""
    held = lambda c: F.count_if(F.coalesce(c, F.lit("")) != "")
    g = df.agg(F.count("*").alias("total_guides"), held(F.col("game_id")).alias("with_game"), held(F.col("metadata")).alias("with_metadata"))
    return g.join(games_.agg(F.count("*").alias("total_games")))


def stats(df: DataFrame, games_: DataFrame) -> dict[str, DataFrame]:
    return {"guides": total(df), "by_format": by_format(df), "recent": summary(page(df, [F.desc("created_at")], 10)), "games": total(games_), "with_guides": games_with_guides(df)}


def envelope(df: DataFrame, order: list[Column], asked: params.Page, **filters) -> DataFrame:
    """One row `json`: a page of rows as {data, pagination, filters}, made in one plan; filters are those that are set. The page has
    params.MAX_LIMIT rows at most."""
    rows = page(df, order, asked.limit, asked.offset)
    held = F.sort_array(F.collect_list(F.struct("_place", F.struct(*df.columns).alias("row"))))
    data = rows.withColumn("_place", F.monotonically_increasing_id()).agg(F.transform(held, lambda r: r["row"]).alias("data"))  # a page
    n = df.agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / asked.limit)
    fields = [F.col("data"), F.struct(F.lit(asked.page).alias("page"), F.lit(asked.limit).alias("limit"), F.col("total"), pages.alias("totalPages")).alias("pagination")]
    active = {k: v for k, v in filters.items() if v}
    if active:
        fields.append(F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else F.lit(v)).alias(k) for k, v in active.items()]).alias("filters"))
    return data.join(n).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def union_distinct(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Rows of first, then those of second whose key is not among them."""
    return first.withColumn("_bucket", F.lit(0)).unionByName(second.join(first.select(key), key, "left_anti").withColumn("_bucket", F.lit(1)))
