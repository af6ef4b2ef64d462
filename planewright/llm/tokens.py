"""Byte-level BPE encoding with the ``tokenizers`` library through a worker-wide table of segments.

The pre-tokenizer of a byte-level BPE cuts a text into pre-tokens that are encoded one by one, so a
text's ids are those of any pieces whose borders are pre-token borders. Borders that hold in every
context are found with numpy on a block's bytes (before a space and a visible character, around a
lone line feed, between letters, digits and marks). Each distinct piece is encoded once per worker
by the library and kept as packed ids under its fingerprint, with its bytes, which every hit is held
against; a block then costs a few array passes and lookups. Added tokens (``<|endoftext|>``) that stand in a text are cut out first and get
their own ids, as the library does by default. ``tests/llm`` holds the result against ``Tokenizer.encode`` on
whole texts.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np

from planewright.llm.common import prefix_hash, span_hash

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Bytes that one pass of array work takes; longer texts go in several.
BLOCK = 1 << 20
#: Ids or bytes of kept pieces beyond which the table is emptied: places in them are 32-bit numbers, and a block adds less than what is left.
LARGEST = 1 << 30
#: Pieces kept per worker (about 40 bytes each); a full table is emptied and filled anew.
TABLE_PIECES = 3_000_000

_WORKER: dict[str, PieceEncoder] = {}


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character, as byte-level BPE vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    for b in range(128):
        c = chr(b)
        kind[b] = SPACE if c.isspace() else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK
    kind[ord("'")] = OTHER  # may open a contraction
    return kind


_CLASSES = _byte_classes()


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Offsets in ``data`` (one text's UTF-8 bytes, or the rest from such an offset) where a pre-token surely starts."""
    kind = _CLASSES[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF, letters but for two
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    now, nxt = kind[:-1], kind[1:]
    clear = (nxt == LETTER) | (nxt == DIGIT) | (nxt == MARK)
    cut = np.zeros(len(data), bool)
    cut[0] = True
    # between two different ones of letters, digits and marks
    cut[1:] = clear & (now != nxt) & (now != SPACE) & (now != OTHER)
    before = np.flatnonzero((data[:-1] == 32) & (clear | (data[1:] == 0x27)))  # before a space and a visible character
    cut[before] = True
    feed = np.flatnonzero(data[:-1] == 10)
    alone = feed[clear[feed] & ((feed == 0) | (kind[feed - 1] != SPACE) & (kind[feed - 1] != OTHER))]
    cut[alone] = True
    cut[alone + 1] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """UTF-8 texts to ids of ``dtype``; without ``added``, special tokens in a text are letters like any others."""

    def __init__(self, path: str, pieces: int = TABLE_PIECES, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        if parts["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE is needed")
        tokens = parts["added_tokens"] if added else []
        if tokens and (parts["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens)):
            raise ValueError("added tokens must stand for their letters alone")
        self.added = {t["content"].encode(): t["id"] for t in tokens}
        self.marks = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.most = pieces
        self._empty()

    def _empty(self) -> None:
        self.n, self.used = 0, 0
        self.keys = np.zeros(1 << 17, np.uint64)
        self.at = np.zeros(1 << 17, np.int32)
        self.size = np.zeros(1 << 17, np.int32)
        self.pool = np.zeros(1 << 18, self.dtype)
        self.spelt, self.spelt_at, self.spelt_size, self.spelt_used = np.zeros(1 << 18, np.uint8), np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int32), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the fingerprints, or of the free slot that ends their search."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        seen = self.keys[slot]
        todo = np.flatnonzero((seen != h) & (seen != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & int(mask)
            seen = self.keys[slot[todo]]
            todo = todo[(seen != h[todo]) & (seen != 0)]
        return slot

    def _place(self, h: np.ndarray) -> np.ndarray:
        slot = self._find(h)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = h[free]
            todo = todo[self.keys[slot[todo]] != h[todo]]
            slot[todo] = self._find(h[todo])
        return slot

    def _ids(self, piece: bytes) -> list[int]:
        body = piece[1:] if piece[:1] == b" " else piece
        if body.isalpha() or piece == b"\n":  # ASCII letters alone: one pre-token
            return [t.id for t in self.model.tokenize(piece.decode("ascii").translate(self.alphabet))]
        text = piece.decode()
        if text.removeprefix(" ").isalpha():
            return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.alphabet))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, h: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> None:
        if self.n and (self.n + len(h) > self.most or max(self.used, self.spelt_used) > LARGEST):
            self._empty()
        while (self.n + len(h)) * 2 > len(self.keys):
            old = np.flatnonzero(self.keys)
            columns = (self.at, self.size, self.spelt_at, self.spelt_size)
            keys, columns = self.keys[old], [c[old] for c in columns]
            self.keys = np.zeros(len(self.keys) * 2, np.uint64)
            self.at, self.size, self.spelt_at, self.spelt_size = (np.zeros(len(self.keys), c.dtype) for c in columns)
            slot = self._place(keys)
            self.at[slot], self.size[slot], self.spelt_at[slot], self.spelt_size[slot] = columns
        ids = [self._ids(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), self.dtype, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        bytes_ = np.frombuffer(b"".join(data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint8)
        while self.spelt_used + len(bytes_) > len(self.spelt):
            self.spelt = np.concatenate([self.spelt, np.zeros_like(self.spelt)])
        self.spelt[self.spelt_used : self.spelt_used + len(bytes_)] = bytes_
        slot, length = self._place(h), end - start
        self.at[slot], self.size[slot] = self.used + np.cumsum(sizes) - sizes, sizes
        self.spelt_at[slot], self.spelt_size[slot] = self.spelt_used + np.cumsum(length) - length, length
        self.used += len(flat)
        self.spelt_used += len(bytes_)
        self.n += len(h)

    def _unlike(self, slot: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces whose bytes aren't those kept in their slots."""
        length = end - start
        wrong = self.spelt_size[slot] != length
        at = np.where(wrong, 0, self.spelt_at[slot].astype(np.int64)) - start
        where = np.repeat(at, length) + np.arange(len(data))
        other = np.flatnonzero(self.spelt[np.minimum(where, len(self.spelt) - 1)] != data)
        if len(other):
            wrong[np.searchsorted(start, other, "right") - 1] = True
        return np.flatnonzero(wrong)

    def _block(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block cut at ``start``, and how many each piece has."""
        end = np.append(start[1:], len(data))
        h = span_hash(prefix_hash(data), start, end) | np.uint64(1)
        slot = self._find(h)
        new = np.flatnonzero(self.keys[slot] != h)
        if len(new):
            new = new[np.argsort(h[new], kind="stable")]
            one = np.append(True, h[new][1:] != h[new][:-1])
            emptied = self.n
            self._learn(h[new[one]], data.tobytes(), start[new[one]], end[new[one]])
            if self.n < emptied:
                return self._block(data, start)
            slot = self._find(h)
        size, at, pool = self.size[slot].astype(np.int64), self.at[slot].astype(np.int64), self.pool
        for k in self._unlike(slot, data, start, end).tolist():  # another piece has the same fingerprint
            own = np.array(self._ids(data[start[k] : end[k]].tobytes()), self.dtype)
            at[k], size[k], pool = len(pool), len(own), np.concatenate([pool, own])
        ends = np.cumsum(size)
        return pool[np.repeat(at - ends + size, size) + np.arange(ends[-1])], size

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and the texts' borders in them (one more than the texts)."""
        raw = memoryview(np.ascontiguousarray(data))
        found = [m for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.marks.finditer(raw, a, b)] if self.added else []
        if not found:
            return self._encode(data, offsets)
        # each mark is a text of its own, whose ids then give way to one
        start, end = (np.array([f(m) for m in found], np.int64) for f in (re.Match.start, re.Match.end))
        cuts = np.sort(np.concatenate([offsets, start, end]))
        ids, borders = self._encode(data, cuts)
        first, last = borders[np.searchsorted(cuts, start, "right") - 1], borders[np.searchsorted(cuts, end, "left")]
        kept = np.ones(len(ids) + 1, np.int64)
        for a, b, m in zip(first.tolist(), last.tolist(), found, strict=True):
            ids[a], kept[a + 1 : b] = self.added[m[0]], 0
        return ids[kept[:-1] > 0], (np.cumsum(kept) - kept)[borders[np.searchsorted(cuts, offsets, "left")]]

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        out, borders = [np.zeros(0, self.dtype)], np.zeros(len(offsets), np.int64)
        i, total, n = 0, 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, "right")) - 1)
            base = int(offsets[i])
            if offsets[j] - base > 4 * BLOCK:  # one very long text
                for ids in self._long(data[base : offsets[j]]):
                    out.append(ids)
                    total += len(ids)
                borders[j] = total
            else:
                block, inner = data[base : offsets[j]], offsets[i : j + 1] - base
                if len(block):
                    full = np.flatnonzero(np.diff(inner))
                    start = self._starts(block, inner[full])
                    ids, size = self._block(block, start)
                    out.append(ids)
                    ends = np.concatenate([[0], np.cumsum(size)])
                    borders[i + 1 : j + 1] = total + ends[np.searchsorted(start, inner[1:])]
                    total += len(ids)
                else:
                    borders[i + 1 : j + 1] = total
            i = j
        return np.concatenate(out), borders

    @staticmethod
    def _starts(block: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Piece starts of a block of texts: a zero byte between texts keeps their borders apart."""
        apart = np.insert(block, texts[1:], 0)
        start = piece_starts(apart)
        moved = texts[1:] + np.arange(len(texts) - 1)  # where the zero bytes stand
        k = np.searchsorted(moved, start, "left")
        inside = np.ones(len(start), bool)
        hit = k < len(moved)
        inside[hit] = moved[k[hit]] != start[hit]
        return np.union1d((start - k)[inside], texts)

    def _long(self, data: np.ndarray):
        while len(data):
            block = data[:BLOCK]
            start = piece_starts(block)
            if len(data) > BLOCK:
                if len(start) < 3:  # no border in sight
                    yield np.array(self.tokenizer.encode(data.tobytes().decode(), add_special_tokens=False).ids, self.dtype)
                    return
                block, start, data = data[: start[-2]], start[:-2], data[start[-2] :]
            else:
                data = data[len(data) :]
            yield self._block(block, start)[0]


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder, made on first use."""
    if (found := _WORKER.get(path)) is None:
        found = _WORKER[path] = PieceEncoder(path, added=True)
    return found


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of an Arrow string column; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, borders, data = column.buffers()
    borders = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[borders[0] : borders[-1]], borders - borders[0]


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids written as little-endian 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
