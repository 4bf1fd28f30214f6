"""Fill-in-middle: documents cut at ends of units into prefix, middle and suffix, which are written in another order.

What a unit is, a finite automaton says: after which bytes one ends (lines by default). Units are counted and cuts are found by
a parallel scan of that automaton:

1. A text is read in blocks of BLOCK bytes, all at once and from every state the automaton may be in: a block gives a function
   from states to states, and for each entry state the number of units that end in it.
2. Functions compose, and composition is associative: a scan in steps of 1, 2, 4... blocks gives for every block the state that it
   is entered in and the units before it.
3. The block that holds the k-th end is known by its counts; only there the end is looked for.

Texts above GIANT bytes are dealt out as chunks of that size over all tasks: each gives one function (a few numbers), these are
composed for each text (2048 chunks at most, as a value holds 2 GB), and only the chunks that hold a cut are read again. All
other texts are scanned where they lie, without any shuffle. Cuts are places of bytes between code points, as units are whole.

Defined results: a null text reads as empty and an empty one stays as it is (form `plain`, no parts), as does one that holds a
mark; a null doc_id draws as an empty number would; equal rows give equal results; an empty table gives no row; other columns
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import boxed, discard, partitions, save, unboxed
from folio.llm.words import Texts, slices

BLOCK, GIANT = 256, 1 << 20
MARKS = ("<P>", "<S>", "<M>")
CUTS = "n long, first long, second long, first_chars long, second_chars long, chars long"


@dataclass(frozen=True)
class Automaton:
    """Bytes have classes; following[state][class] and ends[state][class] (a unit ends after this byte); open[state]: a unit
    also ends where a text ends in that state. State 0 is the start. No unit may end inside a code point."""

    classes: tuple[int, ...]
    following: tuple[tuple[int, ...], ...]
    ends: tuple[tuple[int, ...], ...]
    open: tuple[bool, ...]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each byte; next state and ends by state and class, with one more class for the fill behind a text's end."""
        states = len(self.open)
        follow = np.c_[np.array(self.following), np.arange(states)].astype(np.intp)
        ends = np.c_[np.array(self.ends), np.zeros(states)].astype(np.int64)
        return np.array(self.classes, np.uint8), follow, ends


def _lines() -> Automaton:
    return Automaton(tuple(int(b == 10) for b in range(256)), ((1, 0), (1, 0)), ((0, 1), (0, 1)), (False, True))


def _sentences() -> Automaton:
    """Ends after white space that follows a full stop, an exclamation or a question mark. States: start, inside, after a stop."""
    kind = tuple(1 if b in b".!?" else 2 if b in b" \n\t\r\x0b\x0c" else 0 for b in range(256))
    return Automaton(kind, ((1, 2, 1), (1, 2, 1), (1, 2, 0)), ((0, 0, 0), (0, 0, 0), (0, 0, 1)), (False, True, True))


LINES, SENTENCES = _lines(), _sentences()


class Scan:
    """Texts laid end to end (`off`: where each begins) and what the automaton does in them."""

    def __init__(self, data: np.ndarray, off: np.ndarray, automaton: Automaton):
        self.data, self.off, self.automaton = data, off, automaton
        classes, self.follow, self.ends = automaton.tables()
        size = np.diff(off)
        count = -(-size // BLOCK)
        self.first = np.r_[0, np.cumsum(count)]  # the first block of each text
        self.text = np.repeat(np.arange(len(size)), count)
        within = np.arange(self.first[-1]) - self.first[:-1][self.text]
        self.start = off[:-1][self.text] + within * BLOCK
        self.length = np.minimum(BLOCK, off[1:][self.text] - self.start)
        self.steps = int(self.length.max(initial=0))
        fill, k = len(self.follow[0]) - 1, np.arange(self.steps)
        at = self.start[:, None] + k
        self.kind = np.where(k < self.length[:, None], classes[data[np.minimum(at, max(0, len(data) - 1))]] if len(data) else fill, fill).T.astype(np.intp)
        state = np.tile(np.arange(len(automaton.open)), (len(self.start), 1))
        n = np.zeros(state.shape, np.int64)
        for kind in self.kind:
            n += self.ends[state, kind[:, None]]
            state = self.follow[state, kind[:, None]]
        self.state, self.n = composed(state, n, within)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """[texts, states] where a text leaves the automaton and how many units end in it, for each state it may begin in."""
        empty = np.diff(self.first) == 0
        last = np.maximum(self.first[1:] - 1, 0)
        states = np.arange(self.follow.shape[0])
        if not len(self.start):
            return np.tile(states, (len(empty), 1)), np.zeros((len(empty), len(states)), np.int64)
        return np.where(empty[:, None], states, self.state[last]), np.where(empty[:, None], 0, self.n[last])

    def find(self, text: np.ndarray, k: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """For each text (by number, entered in state `entry`), the place behind its k-th end of a unit, k >= 1."""
        count = self.n[np.arange(len(self.n)), entry_of(self.text, text, entry)] if len(text) else np.zeros(0, np.int64)
        block = np.array([self.first[t] + np.searchsorted(count[self.first[t] : self.first[t + 1]], want) for t, want in zip(text.tolist(), k.tolist(), strict=True)], np.int64)
        head = block == self.first[text]
        state = np.where(head, entry, self.state[np.maximum(block - 1, 0), entry])
        seen = np.where(head, 0, self.n[np.maximum(block - 1, 0), entry])
        at = np.full(len(text), -1, np.int64)
        for step, kind in enumerate(self.kind[:, block]):
            seen = seen + self.ends[state, kind]
            state = self.follow[state, kind]
            at = np.where((at < 0) & (seen == k), step + 1, at)
        return self.start[block] + at - self.off[text]


def entry_of(of: np.ndarray, text: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """The entry state of each block's text; texts that are not asked for count from state 0."""
    states = np.zeros(int(of.max(initial=-1)) + 1, np.int64)
    states[text] = entry
    return states[of]


def composed(state: np.ndarray, n: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive scan of functions by composition; within: the place of each in its run."""
    step = 1
    while step <= within.max(initial=0):
        at = np.flatnonzero(within >= step)
        before = state[at - step]
        count = n[at - step] + np.take_along_axis(n[at], before, 1)
        state, n = state.copy(), n.copy()
        state[at], n[at] = np.take_along_axis(state[at], before, 1), count
        step *= 2
    return state, n


def _chars(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each place."""
    return np.r_[0, np.cumsum((data & 0xC0) != 0x80)]


def drawn(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two cuts, in units, that two numbers draw for texts of n units."""
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _cuts_here(automaton: Automaton):
    """(text, h1, h2) to CUTS for texts that are scanned where they lie."""

    def some(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column(0))
        scan = Scan(texts.data, texts.off, automaton)
        left, n = (x[:, 0] for x in scan.whole())
        total = n + np.array(automaton.open)[left]
        chars = _chars(texts.data)
        rows = np.arange(texts.n)
        places = []
        for k in drawn(np.stack([np.asarray(part.column(i)) for i in (1, 2)], 1), total):
            at = np.where(k > 0, np.diff(texts.off), 0)  # all, if the last unit has no end of its own
            ask = rows[(k > 0) & (k <= n)]
            at[ask] = scan.find(ask, k[ask], np.zeros(len(ask), np.int64))
            places.append(at)
        count = lambda at: chars[texts.off[:-1] + at] - chars[texts.off[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (total, *places, *map(count, places), count(np.diff(texts.off)))], [c.split()[0] for c in CUTS.split(", ")])

    def run(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, h1, h2], ["text", "h1", "h2"])
        parts = [some(x).to_struct_array() for x in slices(batch)]
        kind = pa.struct([(c.split()[0], pa.int64()) for c in CUTS.split(", ")])
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, f"struct<{', '.join(': '.join(c.split()) for c in CUTS.split(', '))}>")


def _pieces(giants: DataFrame, size: int) -> DataFrame:
    """doc_id, mark, no, text: chunks of `size` bytes, dealt over all tasks."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in slices(frame):
                texts = Texts(part.column(2))
                for i in range(texts.n):
                    row = texts.row(i)
                    for no, at in enumerate(range(0, len(row), size)):
                        yield pa.RecordBatch.from_arrays([part.column(0)[i : i + 1], part.column(1)[i : i + 1], pa.array([no]), pa.array([row[at : at + size].tobytes()], pa.binary())], ["doc_id", "mark", "no", "text"])

    return giants.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, no long, text binary").repartition(partitions(giants), "doc_id", "mark", "no")


def _cuts_apart(giants: DataFrame, automaton: Automaton, size: int) -> DataFrame:
    """doc_id, mark, cuts (CUTS as a struct) of texts that are dealt out in chunks. giants: doc_id, mark, text, h1, h2."""
    states = len(automaton.open)
    pieces = save(_pieces(giants, size), "pieces")

    def summary(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in slices(frame):
                texts = Texts(part.column(3))
                state, n = Scan(texts.data, texts.off, automaton).whole()
                chars = _chars(texts.data)[texts.off]
                listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * states), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), listed(state.astype(np.int64)), listed(n), pa.array(np.diff(chars)), pa.array(np.diff(texts.off))], ["doc_id", "mark", "no", "state", "n", "chars", "bytes"])

    each = pieces.mapInArrow(summary, "doc_id long, mark long, no long, state array<long>, n array<long>, chars long, bytes long").distinct()
    entries = "doc_id long, mark long, h1 long, h2 long, no long, entry long, before long, chars_before long, bytes_before long, units long, all_chars long, all_bytes long, own long"

    def resolve(table: pa.Table) -> pa.Table:
        """The state that each chunk of one text is entered in, and what lies before it."""
        table = table.sort_by("no")
        state, n = (np.array(table.column(c).to_pylist(), np.int64).reshape(-1, states) for c in ("state", "n"))
        state, n = composed(state, n, np.arange(len(state)))
        chars, size_ = (np.cumsum(np.asarray(table.column(c))) for c in ("chars", "bytes"))
        shift = lambda x: np.r_[0, x[:-1]]
        units = int(n[-1, 0]) + automaton.open[int(state[-1, 0])]
        full = lambda x: np.full(len(table), x, np.int64)
        before = shift(n[:, 0])
        new = (shift(state[:, 0]), before, shift(chars), shift(size_), full(units), full(chars[-1]), full(size_[-1]), n[:, 0] - before)
        out = table.select(["doc_id", "mark", "h1", "h2", "no"])
        for name, x in zip([c.split()[0] for c in entries.split(", ")][5:], new, strict=True):
            out = out.append_column(name, pa.array(x))
        return out

    h = giants.select("doc_id", "mark", "h1", "h2").distinct().withColumnsRenamed({"doc_id": "_d", "mark": "_m"})
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m"))
    known = save(each.join(h, same).drop("_d", "_m").groupBy("doc_id", "mark").applyInArrow(resolve, entries), "entries")  # a text has 2048 chunks at most
    k1, k2 = F.pmod("h1", F.col("units") + 1), F.pmod("h2", F.col("units") + 1)
    asked = known.select("*", F.explode(F.array(F.struct(F.lit(0).alias("cut"), F.least(k1, k2).alias("k")), F.struct(F.lit(1).alias("cut"), F.greatest(k1, k2).alias("k")))).alias("c")).select("*", "c.cut", "c.k")
    inside = asked.filter((F.col("k") > F.col("before")) & (F.col("k") <= F.col("before") + F.col("own"))).select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), F.col("no").alias("_n"), "cut", (F.col("k") - F.col("before")).alias("k"), "entry", "bytes_before", "chars_before")

    def look(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in slices(frame):
                texts = Texts(part.column(3))
                k, entry, before, chars_before = (np.asarray(part.column(i)) for i in (5, 6, 7, 8))
                at = Scan(texts.data, texts.off, automaton).find(np.arange(texts.n), k, entry)
                chars = _chars(texts.data)
                found = chars[texts.off[:-1] + at] - chars[texts.off[:-1]] + chars_before
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(4), pa.array(at + before), pa.array(found)], ["doc_id", "mark", "cut", "at", "chars"])

    met = pieces.join(inside, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")) & (F.col("no") == F.col("_n")))
    found = met.select("doc_id", "mark", "no", "text", "cut", "k", "entry", "bytes_before", "chars_before").mapInArrow(look, "doc_id long, mark long, cut int, at long, chars long")
    places = found.groupBy(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).agg(*[F.max(F.when(F.col("cut") == i, F.struct("at", "chars"))).alias(f"c{i}") for i in (0, 1)])
    text = known.filter("no = 0").select("doc_id", "mark", F.col("units").alias("n"), F.least(k1, k2).alias("k0"), F.greatest(k1, k2).alias("k1"), "all_bytes", "all_chars")
    out = text.join(places, same, "left")
    at = lambda i, field, end: F.when(F.col(f"k{i}") == 0, 0).otherwise(F.coalesce(f"c{i}.{field}", end)).cast("long")
    cuts = F.struct("n", at(0, "at", "all_bytes").alias("first"), at(1, "at", "all_bytes").alias("second"), at(0, "chars", "all_chars").alias("first_chars"), at(1, "chars", "all_chars").alias("second_chars"), F.col("all_chars").alias("chars"))
    done = save(out.select("doc_id", "mark", cuts.alias("cuts")), "cuts")
    discard(pieces)
    discard(known)
    return done


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 that a document's id draws."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(documents: DataFrame, automaton: Automaton = LINES, seed: int = 7, rate: int = 100, spm: int = 50, giant: int = GIANT) -> DataFrame:
    """_row (the columns of documents, see boxed()), text (the output), n (units), form, prefix_chars, middle_chars. rate: how many
    in a hundred texts are cut; spm: how many in a hundred of those have the suffix first."""
    h = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = (text == "") | F.contains(text, F.lit(MARKS[0])) | F.contains(text, F.lit(MARKS[1])) | F.contains(text, F.lit(MARKS[2])) | (F.pmod(h[2], F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < spm, "spm").otherwise("psm")
    own = documents.select(boxed(documents).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    here = own.filter(F.octet_length("text") <= giant).withColumn("cuts", _cuts_here(automaton)("text", "h1", "h2"))
    apart = own.filter(F.octet_length("text") > giant)
    cuts = _cuts_apart(apart, automaton, giant).withColumnsRenamed({"doc_id": "_d", "mark": "_m"})
    apart = apart.join(cuts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")))
    columns = ["_row", "text", "form", "cuts"]
    both = here.select(*columns).unionByName(apart.select(*columns))
    c, raw = (lambda k: F.col(f"cuts.{k}")), F.col("text").cast("binary")
    part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    prefix, middle, suffix = part(F.lit(0), c("first")), part(c("first"), c("second")), F.substring(raw, (c("second") + 1).cast("int"), F.lit(2**31 - 1))
    p, s, m = (F.lit(x).cast("binary") for x in MARKS)
    out = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(raw)
    cut = F.col("form") != "plain"
    return both.select("_row", out.cast("string").alias("text"), c("n").alias("n"), "form", F.when(cut, c("first_chars")).alias("prefix_chars"), F.when(cut, c("second_chars") - c("first_chars")).alias("middle_chars"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def apply(documents: DataFrame, **options) -> DataFrame:
    """documents with `text` in its new order; a null text stays null."""
    out = transform(documents, **options)
    given = F.col("_row")[f"c{documents.columns.index('text')}"]
    return out.select(*unboxed(documents.columns, text=F.when(given.isNotNull(), F.col("text"))))


def digest(documents: DataFrame, **options) -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = transform(documents.select("doc_id", "text"), **options)
    return out.select(F.col("_row.c0").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("text")).alias("output_sha256"), sha(restored(F.col("text"), F.col("form"))).alias("restored_sha256"))
