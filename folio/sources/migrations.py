"""Versions of a library's tables: each step up or down is one commit, with its version in the manifest.

Version 1 has the base tables and the search indexes, 2 stores guides in the order of their last change, 3 games in that of
their platform, so that a page or a platform reads few row groups, and 4 adds the tables of tags and platforms, filled from the
guides there are. Going up is idempotent; a store of a newer version is refused. Going down undoes a step: tables that it made
go, an order of rows is only no longer kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from folio import schemas
from folio.operators import catalog, search
from folio.sources.library import INDEXES, Library
from folio.sources.store import Transaction

DERIVED = {"guide_tags": schemas.GUIDE_TAGS, "guide_platforms": schemas.GUIDE_PLATFORMS}
_VERSION = "schema version"


class NewerStore(RuntimeError):
    pass


@dataclass(frozen=True)
class Step:
    up: Callable[[Library, Transaction], None]
    down: Callable[[Library, Transaction], None]


def _base(library: Library, tx: Transaction) -> None:
    for name, schema in schemas.TABLES.items():
        if name not in tx:
            tx.create(name, schema, parts=library.parts)
    for name, (_, columns) in INDEXES.items():
        tx.next.values.setdefault(f"index {name}", search.Stored(columns).to_json())


def _no_base(library: Library, tx: Transaction) -> None:
    for name in schemas.TABLES:
        tx.drop(name)
    for name in INDEXES:
        del tx.next.values[f"index {name}"]


def _ordered(name: str, column: str) -> Step:
    def up(library: Library, tx: Transaction) -> None:
        tx.order(name, column)

    def down(library: Library, tx: Transaction) -> None:
        tx.order(name, None)

    return Step(up, down)


def _fill(library: Library, tx: Transaction) -> None:
    for name, schema in DERIVED.items():
        if name in tx:
            tx.drop(name)
        tx.create(name, schema, parts=library.parts)
    tx.append("guide_tags", catalog.guide_tags(tx.table("guides")))
    tx.append("guide_platforms", catalog.guide_platforms(tx.table("guides")))


def _no_derived(library: Library, tx: Transaction) -> None:
    for name in DERIVED:
        tx.drop(name)


STEPS = (Step(_base, _no_base), _ordered("guides", "updated_at"), _ordered("games", "platform"), Step(_fill, _no_derived))


def version(library: Library) -> int:
    return library.store.snapshot().values.get(_VERSION, 0)


def migrate(library: Library, to: int = len(STEPS)) -> int:
    """Takes the library to a version, up or down, a commit for each step; its version then."""
    at = version(library)
    if at > len(STEPS):
        raise NewerStore(f"the store has version {at}, this program knows {len(STEPS)}")
    if not 0 <= to <= len(STEPS):
        raise ValueError(f"there is no version {to}")
    while at != to:
        step, after = (STEPS[at].up, at + 1) if at < to else (STEPS[at - 1].down, at - 1)

        def change(tx: Transaction, step=step, before=at, after=after) -> None:
            if tx.next.values.get(_VERSION, 0) == before:  # else another has taken it
                step(library, tx)
                tx.next.values[_VERSION] = after

        library.store.run(change)
        at = version(library)
    return at
