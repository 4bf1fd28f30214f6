"""Whole texts to token ids with the tokenizers library, each distinct unit once.

Pre-tokenisation never joins what white space parts, so a text's ids are those of its units laid end to end. A unit is a word
(tokenizers that drop white space) or a word with the one space before it, and runs of other white space (byte-level
tokenizers). Units are found and hashed with numpy; only units that this worker has not met go through the library; the ids
of a batch are gathered from a pool. A hash only finds a unit: its bytes are compared with the ones remembered, and a row in
which any differ goes through the library whole. So do texts with white space beyond ASCII, which byte-level patterns treat
by context, and texts that hold an added token of the tokenizer (such as <|endoftext|>), which is matched before units are.
Those strings give the added token's id, as the plain library call does; with `plain_specials` they are ordinary text.
Fresh units that begin with a space go to a byte-level tokenizer many at a time, end to end, as they would stand in a text; the
bytes that its tokens spell tell which ids are whose, and if a unit does not end where a token does, all go one by one.
test_tokens.py holds the result against plain encoding.
"""

from __future__ import annotations

import os

import numpy as np

from folio.llm.words import _IS_SPACE, Texts

#: Units remembered by one worker, at about 70 bytes each, and bytes of their text. Beyond either the memory starts anew.
MAX_UNITS, MAX_BYTES = 2_500_000, 1 << 26
#: Fresh units in one call of the library.
TOGETHER = 256

_FLAG = np.zeros(256, bool)
_FLAG[[0xC2, 0xE1, 0xE2, 0xE3, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_OPEN: dict[tuple[str, bool, bool], "Units"] = {}


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Positions of bytes that begin non-ASCII white space (or are separators that patterns may take for it)."""
    at = np.flatnonzero(_FLAG[data])
    if not len(at):
        return at
    pad = np.r_[data, np.zeros(2, np.uint8)]
    a, b, c = pad[at], pad[at + 1], pad[at + 2]
    hit = (a < 0x20) | (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    hit |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return at[hit]


def _literal(data: np.ndarray, content: bytes) -> np.ndarray:
    """Where content stands in data."""
    at = np.flatnonzero(data[: max(0, len(data) - len(content) + 1)] == content[0])
    for k in range(1, len(content)):
        if not len(at):
            break
        at = at[data[at + k] == content[k]]
    return at


def _room(own: np.ndarray, n: int) -> np.ndarray:
    """own with room for n values; it grows by half, so that not every call copies it."""
    return own if n <= len(own) else np.concatenate([own, np.zeros(max(len(own) // 2, n - len(own)), own.dtype)])


class Units:
    """One tokenizer and the units that this process has met."""

    def __init__(self, path: str, spaced: bool, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content.encode() for t in added if t.content and not (plain_specials and t.special)]
        self.spaced = spaced
        self.spelled = self._spelled() if spaced else None
        self.clear()

    def _spelled(self) -> np.ndarray | None:
        """Bytes that each id spells; None unless tokens are byte-level."""
        from tokenizers.pre_tokenizers import ByteLevel

        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel):
            return None
        sizes = {i: len(token) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        sizes |= {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        out = np.zeros(max(sizes, default=0) + 1, np.int64)
        out[list(sizes)] = list(sizes.values())
        return out

    @staticmethod
    def of(path: str, spaced: bool, plain_specials: bool = False) -> "Units":
        key = (path, spaced, plain_specials)
        if key not in _OPEN:
            _OPEN[key] = Units(*key)
        return _OPEN[key]

    def clear(self) -> None:
        self.n, self.keys = 0, np.zeros(1 << 10, np.uint64)  # a unit's hash, by its slot
        self.table = np.full(1 << 12, -1, np.int32)  # slots, at the upper bits of their hashes or the next free place
        self.begin, self.used = np.zeros(1 << 10, np.int64), 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.raw_begin, self.raw_used, self.raw = np.zeros(1 << 10, np.int64), 0, np.zeros(1 << 18, np.uint8)

    def _bounds(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all units, and the first unit of each row."""
        starts, ends, first = texts.words()
        odd = [_literal(texts.data, t) for t in self.added]
        if self.spaced:
            row = np.searchsorted(texts.off, starts, "right") - 1
            led = starts > texts.off[row]
            space = led & (texts.data[starts - 1] == 0x20) if len(starts) else led
            cut = np.zeros(len(texts.data) + 1, bool)
            for own in (texts.off, ends, starts[led] - 1, starts[~space]):
                cut[own] = True
            bounds = np.flatnonzero(cut)
            starts, ends, first = bounds[:-1], bounds[1:], np.searchsorted(bounds, texts.off)
            odd.append(_wide_space(texts.data))
        if len(odd := np.concatenate([*odd, np.zeros(0, np.int64)]).astype(np.int64)):
            whole = np.unique(np.searchsorted(texts.off, odd, "right") - 1)
            inside = np.repeat(np.isin(np.arange(texts.n), whole), np.diff(first))
            order = np.argsort(at := np.concatenate([starts[~inside], texts.off[whole]]), kind="stable")
            count = np.diff(first)
            count[whole] = 1
            starts, ends, first = at[order], np.concatenate([ends[~inside], texts.off[whole + 1]])[order], np.r_[0, np.cumsum(count)]
        return starts, ends, first

    def _one_by_one(self, raw: bytes, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers, of the units of raw that end at `to`."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # without offsets, which nothing here needs
        ends = to.tolist()
        found = [np.array(x.ids, np.uint32) for x in encode([raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends, strict=False)], add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, np.uint32)]), np.fromiter(map(len, found), np.int64, len(found))

    def _together(self, raw: bytes, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of units that each begin with their only space."""
        if not len(to):
            return self._one_by_one(raw, to)
        ids, _ = self._one_by_one(raw, to[np.r_[TOGETHER - 1 : len(to) - 1 : TOGETHER, len(to) - 1]])
        ends = np.cumsum(self.spelled[ids])
        last = np.searchsorted(ends, to)  # each unit's last id
        if last[-1] != len(ids) - 1 or (ends[last] != to).any():
            return self._one_by_one(raw, to)
        return ids, np.diff(np.r_[-1, last])

    def _plain(self, data: np.ndarray, begin: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Which units are a word with the space before it, and hold nothing that the library might see as more."""
        if self.spelled is None:
            return np.zeros(len(to), bool)
        spaces = np.r_[0, np.cumsum(_IS_SPACE[data])]
        plain = (data[begin] == 0x20) & (spaces[to] - spaces[begin] == 1) & (to - begin > 1)
        odd = np.concatenate([_wide_space(data), *(_literal(data, t) for t in self.added)]).astype(np.int64)
        plain[np.searchsorted(to, odd, "right")] = False
        return plain

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        def laid(starts, size):
            return data[np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)]

        size = ends - starts
        to = np.cumsum(size)
        plain = self._plain(laid(starts, size), to - size, to)
        order = np.argsort(~plain, kind="stable")
        hashes, size, n = hashes[order], size[order], int(plain.sum())
        to, text = np.cumsum(size), laid(starts[order], size)
        cut = int(to[n - 1]) if n else 0
        raw = text.tobytes()
        parts = self._together(raw[:cut], to[:n]), self._one_by_one(raw[cut:], to[n:] - cut)
        flat, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))

        first, self.n = self.n, self.n + len(sizes)
        self.pool = _room(self.pool, self.used + len(flat))
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin = _room(self.begin, self.n + 1)
        self.begin[first + 1 : self.n + 1] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.raw = _room(self.raw, self.raw_used + len(text))
        self.raw[self.raw_used : self.raw_used + len(text)] = text
        self.raw_begin = _room(self.raw_begin, self.n + 1)
        self.raw_begin[first + 1 : self.n + 1] = self.raw_used + to
        self.raw_used += len(text)
        self.keys = _room(self.keys, self.n)
        self.keys[first : self.n] = hashes
        if 2 * self.n > len(self.table):
            self.table, first = np.full(1 << (2 * self.n).bit_length(), -1, np.int32), 0
        self._place(np.arange(first, self.n, dtype=np.int32))

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.table).bit_length())).astype(np.int64)

    def _place(self, slot: np.ndarray) -> None:
        at = self._home(self.keys[slot])
        while len(slot):
            free = self.table[at] < 0
            self.table[at[free]] = slot[free]  # of several at one place, one stays
            left = self.table[at] != slot
            slot, at = slot[left], at[left] + 1 & len(self.table) - 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the units; -1: not met."""
        at = self._home(hashes)
        out = self.table.take(at)
        todo = np.flatnonzero((self.keys.take(out) != hashes) & (out >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & len(self.table) - 1
            own = self.table.take(at[todo])
            out[todo] = own
            todo = todo[(self.keys.take(own) != hashes[todo]) & (own >= 0)]
        return out

    def _unlike(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Units whose bytes are not those remembered under their hash."""
        begin = self.raw_begin.take(slot)
        wrong = ends - starts != self.raw_begin.take(slot + 1) - begin
        at = np.arange(len(data), dtype=np.int32)
        at += np.repeat(np.r_[0, begin - starts].astype(np.int32), np.diff(np.r_[0, starts, len(data)]))
        differ = np.zeros(len(data) + 1, np.int32)  # what lies between units counts for none
        np.cumsum(data != self.raw.take(at, mode="clip"), out=differ[1:])
        return np.flatnonzero(wrong | (differ[ends] != differ[starts]))

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows laid end to end, and where each row's begin (n + 1 entries)."""
        starts, ends, first = self._bounds(texts)
        if self.n > MAX_UNITS or self.raw_used > MAX_BYTES:
            self.clear()
        hashes = texts.hashes(starts, ends)
        slot = self._find(hashes)
        if len(new := np.flatnonzero(slot < 0)):
            distinct, one = np.unique(hashes[new], return_index=True)
            self._learn(texts.data, distinct, starts[new[one]], ends[new[one]])
            slot[new] = self._find(hashes[new])
        begin = self.begin.take(slot)
        sizes = self.begin.take(slot + 1) - begin
        to = np.r_[0, np.cumsum(sizes)]
        ids = self.pool.take(np.repeat(begin - to[:-1], sizes) + np.arange(to[-1]))
        off = to[first]
        if len(unlike := self._unlike(texts.data, starts, ends, slot)):
            own = [ids[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            for i in np.unique(np.searchsorted(first, unlike, "right") - 1).tolist():
                own[i] = np.array(self.tokenizer.encode(texts.row(i).tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
            ids, off = np.concatenate(own), np.r_[0, np.cumsum([len(x) for x in own])]
        return ids, off
