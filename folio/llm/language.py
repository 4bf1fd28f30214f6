"""Language identification by a bidirectional gated recurrent network over bytes, trained and run in numpy.

One recurrent layer reads a text's UTF-8 bytes forwards and one backwards, a step for each byte, and a softmax over both states
gives every byte position language probabilities. A document's probabilities are the mean over all its positions: whole texts,
never a prefix. So that a long text is not one step after the other, it is read in stretches of STRETCH bytes side by side;
each layer comes to a stretch through the WARM bytes ahead of it (behind it, for the layer that reads backwards), by which its
state is that of a reading from the text's end but for a difference that test_models.py bounds.

fit() trains on a bounded sample of labelled rows, the TRAIN_DOCS least hashes of every language (of the LANGS languages with
most labelled rows, by estimate, ties by code point, so that a spoilt column breaks neither driver nor plan), and TRAIN_SEGMENTS segments
spread evenly over each whole text, by backpropagation through time with Adam. The model (some 30 kB) goes to the executors
with the function; prediction is one scan without an exchange.

Defined results: null text, and text without a letter, is `und` with score 0; so is everything if no row has a label. Null
labels teach nothing; every other label, however rare, is learned, up to LANGS of them. Rows are independent: repeats get equal results; an empty
table gives no row; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from folio.llm.common import in_arrow
from folio.llm.words import Texts, batches

HIDDEN, STRETCH, WARM, BLOCK = 16, 256, 32, 1024
TRAIN_DOCS, TRAIN_SEGMENTS, SEGMENT, EPOCHS, STEPS, BATCH, RATE = 300, 6, 128, 4, 200, 128, 0.01
LANGS, UNKNOWN, FLOOR = 256, "und", 0.5
#: Stands for no byte; a state passes it unchanged.
PAD, HOLD = 256, 30.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sum_by(key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of value's rows that share a key."""
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    out = np.zeros((n, value.shape[1]), np.float32)
    out[key[order][at]] = np.add.reduceat(value[order], at)
    return out


class Gru:
    """One direction: table 256 x 3H (byte embedding and input matrix in one), state matrix H x 3H, bias 3H; the gates in the
    order keep, reset, new."""

    def __init__(self, rng: np.random.Generator):
        h = HIDDEN
        self.p = [rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32), (rng.normal(0, 1, (h, 3 * h)) / np.sqrt(h)).astype(np.float32), np.zeros(3 * h, np.float32)]

    def run(self, data: np.ndarray, order: list[int]) -> tuple[np.ndarray, list]:
        """data: [B, T] bytes or PAD. States [T, B, H], and what back() needs."""
        table, state, bias = self.p
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[:, :HIDDEN] = HOLD
        table = np.concatenate([table + bias, pad])
        h = np.zeros((len(data), HIDDEN), np.float32)
        out, held = np.zeros((data.shape[1], len(data), HIDDEN), np.float32), []
        for t in order:
            x, s = table[data[:, t]], h @ state
            gates = _sigmoid(x[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            held.append((t, h, z, r, n, s[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out, held

    def back(self, data: np.ndarray, held: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters; d_out: [T, B, H]."""
        state, d_state = self.p[1], np.zeros_like(self.p[1])
        dh, dxs = np.zeros_like(d_out[0]), np.zeros((data.shape[1], len(data), 3 * HIDDEN), np.float32)
        for t, h, z, r, n, sn in reversed(held):
            dh = dh + d_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * sn * r * (1 - r)
            dxs[t] = np.concatenate([dz, dr, dn], 1)
            ds = np.concatenate([dz, dr, dn * r], 1)
            d_state += h.T @ ds
            dh = dh * z + ds @ state.T
        table = _sum_by(data.T.ravel(), dxs.reshape(-1, 3 * HIDDEN), 257)[:256]
        return [table, d_state, table.sum(0)]

    def states(self, data: np.ndarray, order: range) -> np.ndarray:
        """[steps of order, B, H]: run() for prediction. Gates come from exp, of which numpy takes half the time that tanh takes; their
        signs and scales are in the matrices."""
        h, b = HIDDEN, len(data)
        scale = np.array([-1, -1, -2], np.float32)
        table = np.zeros((257, 3 * h), np.float32)
        table[:256], table[256, :h] = (self.p[0] + self.p[2]) * scale.repeat(h), -HOLD
        tables = [np.ascontiguousarray(table[:, k * h : (k + 1) * h]) for k in range(3)]
        matrices = np.ascontiguousarray((self.p[1] * scale.repeat(h)).reshape(h, 3, h).transpose(1, 0, 2))
        columns = np.ascontiguousarray(data.T).astype(np.intp)
        out, own = np.empty((len(order), b, h), np.float32), np.zeros((b, h), np.float32)
        gates, s = np.empty((3, b, h), np.float32), np.empty((3, b, h), np.float32)
        (z, r, n), zr = gates, gates[:2]
        with np.errstate(over="ignore"):  # a gate of e^inf is shut
            for at, t in enumerate(order):
                for k, gate in enumerate(gates):
                    np.take(tables[k], columns[t], 0, gate, "clip")
                np.matmul(own, matrices, s)
                zr += s[:2]
                np.exp(zr, zr)
                zr += 1
                np.reciprocal(zr, zr)
                r *= s[2]
                n += r
                np.exp(n, n)
                n += 1
                np.divide(2, n, n)
                n -= 1
                own -= n
                own *= z
                own += n
                out[at] = own
        return out


class Model:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.ahead, self.behind = langs, Gru(rng), Gru(rng)
        self.head = [rng.normal(0, 0.1, (2 * HIDDEN, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.p, *self.behind.p, *self.head]

    def positions(self, data: np.ndarray, warm: int = 0) -> np.ndarray:
        """Probabilities [langs, T, B] of the positions between `warm` ones ahead and `warm` behind."""
        n = data.shape[1]
        ahead = self.ahead.states(data, range(n - warm))[warm:]
        behind = self.behind.states(data, range(n - 1, warm - 1, -1))[warm:][::-1]
        logits = (ahead.reshape(-1, HIDDEN) @ self.head[0][:HIDDEN]).reshape(*ahead.shape[:2], -1)
        logits += (behind.reshape(-1, HIDDEN) @ self.head[0][HIDDEN:]).reshape(logits.shape)
        logits = np.ascontiguousarray(np.moveaxis(logits + self.head[1], 2, 0))
        logits -= logits.max(0)
        p = np.exp(logits, logits)
        p /= p.sum(0)
        return p

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over positions that are not PAD and its gradients; label: [B]."""
        order = list(range(data.shape[1]))
        f, kept_f = self.ahead.run(data, order)
        b, kept_b = self.behind.run(data, order[::-1])
        states = np.concatenate([f, b], 2)
        logits = states @ self.head[0] + self.head[1]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        mask = (data.T != PAD).astype(np.float32)
        rows, total = np.arange(len(label)), max(1.0, float(mask.sum()))
        loss = -float((np.log(p[:, rows, label] + 1e-9) * mask).sum()) / total
        p[:, rows, label] -= 1
        p *= (mask / total)[:, :, None]
        d = p @ self.head[0].T
        head = [states.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, p.shape[2]), p.sum((0, 1))]
        return loss, [*self.ahead.back(data, kept_f, d[:, :, :HIDDEN]), *self.behind.back(data, kept_b, d[:, :, HIDDEN:]), *head]


def stretches(texts: Texts, width: int = STRETCH, warm: int = WARM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes [S, warm + width + warm] with PAD outside the text, own bytes of each stretch, row of each stretch)."""
    size = np.diff(texts.off)
    count = -(-size // width)
    row = np.repeat(np.arange(texts.n), count)
    at = texts.off[row] + (np.arange(len(row)) - (np.cumsum(count) - count)[row]) * width
    index = at[:, None] + np.arange(-warm, width + warm)
    held = (index >= texts.off[row][:, None]) & (index < texts.off[row + 1][:, None])
    out = np.full(index.shape, PAD, np.int16)
    out[held] = texts.data[index[held]]
    return out, np.minimum(width, texts.off[row + 1] - at), row


def probabilities(model: Model, texts: Texts) -> np.ndarray:
    """[rows, langs]: the mean over all positions; zeros for an empty row."""
    data, used, row = stretches(texts)
    total = np.zeros((len(row), len(model.langs)))
    order = np.argsort(used, kind="stable")  # stretches of about one length side by side
    for lo in range(0, len(order), BLOCK):
        part = order[lo : lo + BLOCK]
        deep = int(used[part].max())
        p = model.positions(data[part, : deep + 2 * WARM], WARM)
        p *= np.arange(deep)[:, None] < used[part]
        total[part] = p.sum(1).T
    out = np.zeros((texts.n, len(model.langs)))
    np.add.at(out, row, total)
    return out / np.maximum(1, np.diff(texts.off))[:, None]


def label_positions(model: Model, text: str) -> list[str]:
    """The language of every byte of text."""
    if not text:
        return []
    data, used, _ = stretches(Texts(pa.array([text])))
    best = model.positions(data, WARM).argmax(0).T
    return [model.langs[k] for s, n in zip(best, used, strict=True) for k in s[:n]]


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model of (text, lang) rows; None of none."""
    langs = sorted({lang for _, lang in rows})
    data, used, row = stretches(Texts(pa.array([t for t, _ in rows], pa.string())), SEGMENT, 0)
    if not len(row):
        return None
    model, rng = Model(langs, seed), np.random.default_rng(seed)
    pick, first = [], np.searchsorted(row, np.arange(len(rows) + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        pick += (a + np.unique(np.linspace(0, b - a - 1, min(b - a, TRAIN_SEGMENTS)).astype(int))).tolist() if b > a else []
    label = np.array([langs.index(rows[row[k]][1]) for k in pick], np.int64)
    data = data[pick]
    moment, square, step = [np.zeros_like(p) for p in model.parameters()], [np.zeros_like(p) for p in model.parameters()], 0
    for _ in range(max(EPOCHS, -(-STEPS // -(-len(pick) // BATCH)))):  # few rows are read more often
        order = rng.permutation(len(pick))
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            _, grads = model.gradients(data[own], label[own])
            step += 1
            for p, g, m, v in zip(model.parameters(), grads, moment, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def fit(documents: DataFrame) -> Model | None:
    """A model of the rows whose crc32(doc_id) mod 5 is not 0; None if none has a label."""
    known = documents.filter("crc32(cast(doc_id as string)) % 5 != 0 and lang is not null and length(text) > 0")
    known = known.select("text", "lang", F.xxhash64("doc_id", "text").alias("_h"))
    common = known.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n"))
    common = {r.lang: r.n for r in common.orderBy(F.desc("n"), "lang").limit(LANGS).collect()}
    if not common:
        return None
    # so many different rows of each language as make it all but sure that TRAIN_DOCS are among them, however large it is
    chance = F.try_element_at(F.create_map(*[F.lit(x) for k, n in common.items() for x in (k, int(min(1.0, 8 * TRAIN_DOCS / max(1, n)) * (1 << 30)))]), F.col("lang"))
    known = known.filter(F.pmod(F.xxhash64("_h", F.lit(5)), F.lit(1 << 30)) < chance)
    sample = known.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "text"))).filter(F.col("_r") <= TRAIN_DOCS)
    size = F.length("text")
    spread = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_SEGMENTS - 1)), lambda k: F.substring("text", (1 + F.floor(k * (size - SEGMENT) / (TRAIN_SEGMENTS - 1))).cast("int"), F.lit(SEGMENT)))
    text = F.when(size <= TRAIN_SEGMENTS * SEGMENT, F.col("text")).otherwise(F.array_join(spread, " "))  # pieces from start to end of long texts
    rows = sample.select(text.alias("text"), "lang", "_h").collect()  # TRAIN_DOCS rows of bounded length for each of LANGS languages at most
    return train([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r["_h"], r.text))])


def predict(documents: DataFrame, model: Model | None) -> tuple[DataFrame, list[str]]:
    """documents, their columns renamed c0, c1 and so on, with lang_pred and score; and the columns' own names."""
    names = documents.columns
    at, n = names.index("text"), len(names)
    kept = documents.toDF(*[f"c{i}" for i in range(n)]).withColumn("letters", F.coalesce(F.col(f"c{at}").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*kept.schema.fields[:n], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(frames, f"c{at}"):
            letters = part.column(n).to_numpy(zero_copy_only=False).astype(bool)
            if model:
                p = probabilities(model, Texts(part.column(at)))
                best = p.argmax(1)
                lang = [model.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters, strict=True)]
                score = np.where(letters, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            else:
                lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(lang, pa.string()), pa.array(score)], schema.names)

    return in_arrow(kept, run, schema), names


def digest(documents: DataFrame, held_out: bool = False) -> DataFrame:
    """A prediction for each row, or for those only that nothing was learned from."""
    asked = documents.select("doc_id", "text")
    out, _ = predict(asked.filter("crc32(cast(doc_id as string)) % 5 = 0") if held_out else asked, fit(documents))
    return out.select(F.col("c0").alias("doc_id"), F.coalesce(F.expr("crc32(cast(c0 as string)) % 5 = 0"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def apply(documents: DataFrame) -> DataFrame:
    """documents without those that have no language or none with a probability of FLOOR or more; null and empty texts go."""
    found, names = predict(documents, fit(documents))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= FLOOR)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
