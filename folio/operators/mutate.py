"""Row changes as copy-on-write: each returns the table's next state, to be written in one atomic job.

Constraints are predicates and anti-joins over the new state; a violation raises before anything is written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.schemas import FORMATS, STATUSES, TABLES

# Columns that an update may name.
UPDATABLE = {
    "guides": ("title", "content", "format", "file_path", "game_id", "last_read_position", "metadata", "ai_analyzed_at"),
    "games": ("title", "ra_game_id", "platform", "completion_percentage", "status", "artwork_url", "metadata"),
    "notes": ("position", "content"),
    "bookmarks": ("position", "name", "page_reference", "is_last_read"),
}
# Columns that may not be null.
NOT_NULL = {
    "guides": ("id", "title", "content", "format", "file_path", "created_at", "updated_at"),
    "games": ("id", "title", "status", "created_at", "updated_at"),
    "bookmarks": ("id", "guide_id", "position", "is_last_read", "created_at"),
    "notes": ("id", "guide_id", "content", "created_at", "updated_at"),
    "achievements": ("id", "ra_achievement_id", "game_id", "title", "description", "is_pinned", "is_unlocked", "created_at", "updated_at"),
    "guide_tags": ("guide_id", "tag"),
}
UNIQUE = {"guides": [("id",)], "games": [("id",), ("ra_game_id",)], "notes": [("id",)], "bookmarks": [("id",)], "achievements": [("id",), ("ra_achievement_id", "game_id")], "guide_tags": [("guide_id", "tag")]}
PARENTS = {"guides": ("game_id", "games"), "bookmarks": ("guide_id", "guides"), "notes": ("guide_id", "guides"), "achievements": ("game_id", "games"), "guide_tags": ("guide_id", "guides")}


class ConstraintError(ValueError):
    pass


def checks(table: str) -> dict[str, Column]:
    valid_json = F.col("metadata").isNull() | F.try_parse_json("metadata").isNotNull()
    return {
        "guides": {"format": F.col("format").isin(*FORMATS), "metadata": valid_json},
        "games": {"status": F.col("status").isin(*STATUSES), "completion": F.col("completion_percentage").between(0, 100), "metadata": valid_json},
        "bookmarks": {"position": F.col("position") >= 0},
        "notes": {"content": T.js_trim(F.col("content")) != "", "position": F.col("position").isNull() | (F.col("position") >= 0)},
    }.get(table, {})


def split_valid(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the names of the broken checks)."""
    absent = {f"not null {c}": F.col(c).isNotNull() for c in NOT_NULL.get(table, ()) if c in rows.columns}
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in (checks(table) | absent).items()]))
    marked = rows.withColumn("_broken", broken)
    return marked.filter(F.size("_broken") == 0).drop("_broken"), marked.filter(F.size("_broken") > 0)


def duplicates(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys held twice; nulls do not collide."""
    own = rows.filter(" and ".join(f"{k} is not null" for k in key))
    return own.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.filter(F.col(key).isNotNull()).join(parents.select(F.col("id").alias(key)), key, "left_anti")


def validate(rows: DataFrame, table: str, parents: DataFrame | None = None) -> None:
    """Raises with all that is broken: one pass for the checks, one for each unique key and the foreign key."""
    found = [f"check {r.b}" for r in split_valid(rows, table)[1].select(F.explode("_broken").alias("b")).distinct().orderBy("b").collect()]  # a row for each check
    found += [f"unique {k}" for k in UNIQUE.get(table, []) if duplicates(rows, k).limit(1).count()]
    if parents is not None and orphans(rows, parents, PARENTS[table][0]).limit(1).count():
        found.append(f"foreign key {PARENTS[table][0]}")
    if found:
        raise ConstraintError(f"{table}: {'; '.join(found)}")


def validate_new(rows: DataFrame, table: str, before: DataFrame, parents: DataFrame | None = None) -> None:
    """The same for rows that join `before`, which is valid already: a pass over the new rows, and over the keys of the old."""
    found = [f"check {r.b}" for r in split_valid(rows, table)[1].select(F.explode("_broken").alias("b")).distinct().orderBy("b").collect()]  # a row for each check
    for key in UNIQUE.get(table, []):
        own = rows.filter(" and ".join(f"{k} is not null" for k in key)).select(*key)
        if duplicates(rows, key).limit(1).count() or before.join(own, list(key), "left_semi").limit(1).count():
            found.append(f"unique {key}")
    if parents is not None and orphans(rows, parents, PARENTS[table][0]).limit(1).count():
        found.append(f"foreign key {PARENTS[table][0]}")
    if found:
        raise ConstraintError(f"{table}: {'; '.join(found)}")


def filled(table: DataFrame, name: str, rows: DataFrame, now: int) -> DataFrame:
    """rows in the shape of table, with id, times and defaults where they lack them."""
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in table.columns])
    fill = {"created_at": F.lit(now).cast("long"), "updated_at": F.lit(now).cast("long")}
    if name == "games":
        fill |= {"status": F.coalesce("status", F.lit("not_started")), "completion_percentage": F.coalesce("completion_percentage", F.lit(0.0))}
    if name == "notes":
        fill["content"] = T.js_trim(F.col("content"))
    if name == "bookmarks":
        fill["is_last_read"] = F.coalesce(F.col("is_last_read").cast("boolean"), F.lit(False))
    if "id" in table.columns:
        fill["id"] = F.coalesce("id", T.make_id(*[F.col(c).cast("string") for c in table.columns if c not in ("id", "created_at", "updated_at")], F.lit(str(now))))
    if name == "guides":
        fill["ai_analyzed_at"] = F.lit(None).cast("long")  # set by later analysis only
    rows = rows.withColumns({k: v for k, v in fill.items() if k in table.columns})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in table.schema])


def insert(table: DataFrame, name: str, rows: DataFrame, now: int, parents: DataFrame | None = None) -> DataFrame:
    """All or nothing: rows get id and times where absent, then the whole next state is checked."""
    after = table.unionByName(filled(table, name, rows, now))
    validate(after, name, parents)
    return after


def updatable(name: str, changes: DataFrame, parents: DataFrame | None) -> list[str]:
    """Columns of changes that an update may set; a foreign key among them needs its parents."""
    named = [c for c in changes.columns if c in UPDATABLE[name]]
    if PARENTS.get(name, ("",))[0] in named and parents is None:
        raise ConstraintError(f"{name}: foreign key {PARENTS[name][0]} needs its parents")
    return named


def updated(table: DataFrame, changes: DataFrame, named: list[str], now: int) -> DataFrame:
    """table with the changes and, in _hit, whether a row was changed."""
    new = changes.select(F.col("id").alias("_id"), F.struct(*named).alias("_new"))
    hit = F.col("_id").isNotNull()
    times = {"updated_at": F.lit(now).cast("long")} if "updated_at" in table.columns else {}
    value = {c: F.col(f"_new.{c}").cast(table.schema[c].dataType) for c in named} | times
    rows = table.join(new, table["id"] == F.col("_id"), "left")
    return rows.select(*[F.when(hit, value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in table.columns], hit.alias("_hit"))


def update(table: DataFrame, name: str, changes: DataFrame, now: int, parents: DataFrame | None = None) -> DataFrame:
    """changes: id and some updatable columns; unknown columns are ignored, and updated_at is always now. One left join. A
    foreign key among them is checked against parents."""
    named = updatable(name, changes, parents)
    if not named:
        return table
    after = updated(table, changes, named, now).drop("_hit")
    validate(after, name, parents if PARENTS.get(name, ("",))[0] in named else None)
    return after


def set_position(guides: DataFrame, guide_id: str, position: int, now: int) -> DataFrame:
    if position < 0:
        raise ConstraintError("position")
    return update(guides, "guides", guides.sparkSession.createDataFrame([(guide_id, position)], "id string, last_read_position long"), now)


def set_completion(games: DataFrame, game_id: str, pct: float, now: int) -> DataFrame:
    rows = games.sparkSession.createDataFrame([(game_id, float(pct))], "id string, pct double").select("id", T.completion(F.col("pct")).alias("c")).select("id", "c.*")
    return update(games, "games", rows, now)


def set_metadata(guides: DataFrame, rows: DataFrame, now: int) -> DataFrame:
    """rows: id, metadata; an aiAnalyzedAt in it also sets the column."""
    at = F.get_json_object("metadata", "$.aiAnalyzedAt").try_cast("long")
    kept = rows.join(guides.select("id", F.col("ai_analyzed_at").alias("_at")), "id").withColumn("ai_analyzed_at", F.coalesce(F.when(at != 0, at), "_at"))
    return update(guides, "guides", kept.select("id", "metadata", "ai_analyzed_at"), now)


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(F.col("id").alias(key)), key, "left_anti").select(*table.columns)


@dataclass
class Catalog:
    guides: DataFrame
    games: DataFrame
    bookmarks: DataFrame
    notes: DataFrame
    achievements: DataFrame | None = None

    @staticmethod
    def empty(spark) -> "Catalog":
        return Catalog(**{k: spark.createDataFrame([], v) for k, v in TABLES.items()})

    def delete_guides(self, ids: DataFrame) -> "Catalog":
        """Bookmarks and notes of the guides go with them."""
        return Catalog(delete(self.guides, ids), self.games, delete(self.bookmarks, ids, "guide_id"), delete(self.notes, ids, "guide_id"), self.achievements)

    def delete_games(self, ids: DataFrame) -> "Catalog":
        """Guides stay and lose their game; achievements go."""
        gone = ids.select(F.col("id").alias("_g"))
        kept = self.guides.join(gone, self.guides["game_id"] == F.col("_g"), "left")
        guides = kept.withColumn("game_id", F.when(F.col("_g").isNull(), F.col("game_id"))).select(*self.guides.columns)
        return Catalog(guides, delete(self.games, ids), self.bookmarks, self.notes, delete(self.achievements, ids, "game_id") if self.achievements is not None else None)
