"""Request parameters as the service reads them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.schemas import STATUSES

# Page sizes.
DEFAULT_LIMIT, MAX_LIMIT, SEARCH_LIMIT, TITLE_LIMIT = 20, 100, 50, 50


def leading_int(value: object) -> int | None:
    m = re.match(r"\s*([+-]?\d+)", "" if value is None else str(value))
    return int(m[1]) if m else None


@dataclass(frozen=True)
class Page:
    page: int
    limit: int

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit

    def envelope(self, total: int, **filters: object) -> dict:
        out = {"page": self.page, "limit": self.limit, "total": total, "totalPages": math.ceil(total / self.limit)}
        active = {k: v for k, v in filters.items() if v}
        return {"pagination": out} | ({"filters": active} if active else {})


def page(page: object = None, limit: object = None) -> Page:
    return Page(max(1, leading_int(page) or 1), min(MAX_LIMIT, max(1, leading_int(limit) or DEFAULT_LIMIT)))


def search_limit(limit: object = None) -> int:
    return min(MAX_LIMIT, max(1, leading_int(limit) or SEARCH_LIMIT))


def tags(text: str | None) -> list[str]:
    return [t for t in (x.strip() for x in (text or "").split(",")) if t]


def tag_match(value: object) -> str:
    return "all" if value == "all" else "any"


def status(value: object) -> str | None:
    return value if value in STATUSES else None


def whitelist(update: dict, allowed: tuple[str, ...]) -> dict:
    return {k: v for k, v in update.items() if k in allowed}


def init_progress(stage: str, done: float, total: float = 1) -> int:
    """Overall percentage of a cold start: download 0-30, extraction 30-60, import 60-100."""
    if stage == "download":
        return math.floor(done * 0.3)
    return 30 + math.floor(done / max(total, 1) * 30) if stage == "extract" else 60 + math.floor(done / max(total, 1) * 40)


# the same for columns of logged requests ---------------------------------------------------------------------------------


def leading_int_of(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("long")


def limit_of(text: Column, default: int = DEFAULT_LIMIT) -> Column:
    given = leading_int_of(text)
    return F.least(F.lit(MAX_LIMIT), F.greatest(F.lit(1), F.when(given != 0, given).otherwise(default))).cast("int")


def page_of(text: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(leading_int_of(text), F.lit(1)))


def tags_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
