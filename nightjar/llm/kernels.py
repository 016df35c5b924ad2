"""Vectorised text kernels over Arrow buffers: words, rolling hashes, cached encoding.

A text column is seen as one byte array with document offsets.  Substrings are
hashed in constant time from a running sum of byte codes weighted by powers of
an odd multiplier modulo 2^64, so all windows of a batch cost a few numpy passes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x51A7))
CODES = _RNG.integers(1, 2**64, 256, dtype=U64)
_P = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_P), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^n and its inverses."""
    if len(_powers[0]) <= n:
        size = 1 << (n + 1).bit_length()
        for k, base in enumerate((_P, _INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


class Hasher:
    """Hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.up, down = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(CODES[data] * down[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        """Unmixed-order hash of every window of ``k`` bytes (start 0..n-k)."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.up[: n - k + 1])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8).copy() if off is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` text bytes (one row at least)."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes outside ``sep``."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = ~sep[data]
    before = np.zeros(n, bool)
    before[1:] = w[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges] = False
    after = np.zeros(n, bool)
    after[:-1] = w[1:]
    after[edges - 1] = False
    start = np.flatnonzero(w & ~before)
    end = np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word ``k``-gram of lower-cased text, with repeats.

    A document with fewer than ``k`` words, but not none, has its whole sequence as one.
    """
    low = LOWER[data]
    start, end, doc = words(low, offsets)
    n_docs = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = Hasher(low).spans(start, end)
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    up, _ = powers(k + 1)
    total = len(h)
    if total >= k:
        gram = np.zeros(total - k + 1, U64)
        for i in range(k):
            gram += h[i : total - k + 1 + i] * up[k - i]
        same = doc[: total - k + 1] == doc[k - 1 :]
        docs, grams = doc[: total - k + 1][same], gram[same]
    else:
        docs, grams = np.zeros(0, np.int64), np.zeros(0, U64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), U64)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] += h[first[short[has]] + i] * up[k - i]
        extra += count[short].astype(U64) * U64(0x5851F42D4C957F2D)
        docs, grams = np.concatenate((docs, short)), np.concatenate((grams, extra))
    return docs, mix(grams)


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs, sorted by both."""
    if not len(doc):
        return doc, value
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[new], v[new]


# ASCII punctuation but the apostrophe: a letter before one of these ends a pre-token
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A, 0x0D, 0x09]] = True


def cut_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks that byte-level and word BPE pre-tokenisers never join.

    A chunk begins at a document's start, where ASCII white space follows a
    character that isn't white space, and where ASCII punctuation (but an
    apostrophe) follows an ASCII or Latin-1 letter.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    prev = np.zeros(n, np.uint8)
    prev[1:] = data[:-1]
    cut = _CUT[data] & (prev > 0x20) & (prev != 0x7F)
    high = np.flatnonzero(cut & (prev >= 0x80))
    if len(high):  # white space outside ASCII before the cut
        a, b, c = (data[np.maximum(high - i, 0)].astype(np.int64) for i in (3, 2, 1))
        three = (a << 16) | (b << 8) | c
        two = (b << 8) | c
        blank = (two == 0xC285) | (two == 0xC2A0) | (three == 0xE19A80) | (three == 0xE38080) | (three == 0xE2819F) | ((three >= 0xE28080) & (three <= 0xE2808A)) | np.isin(three, (0xE280A8, 0xE280A9, 0xE280AF))
        cut[high[blank]] = False
    punct = _PUNCT[data]
    letter = _LETTER[prev]
    prev2 = np.zeros(n, np.uint8)
    prev2[2:] = data[:-2]
    letter |= (prev2 == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7)
    cut |= punct & letter
    first = offsets[:-1]
    cut[first[first < n]] = True
    return np.flatnonzero(cut)


#: fixed values: the normalisers and pre-tokenisers whose chunks ``cut_points`` knows
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_WORDS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN = ((None, _BYTES), (_LOWERED, {"type": "Sequence", "pretokenizers": [_WORDS, _BYTES | {"use_regex": False}]}))


class CachedEncoder:
    """A ``tokenizers`` model that encodes each distinct chunk of text once.

    Known chunks are kept by a 64-bit hash and their length, at most ``capacity`` of
    them; beyond that the memory is emptied and filled anew, results stay the same.
    Strings of added tokens in a text become those tokens, as the model itself does.
    Files whose pre-tokeniser isn't one of ``KNOWN`` are refused, as their chunks may
    not be cut where ``cut_points`` does.
    """

    def __init__(self, path: str, capacity: int = 1_500_000) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        told = json.loads(self.model.to_str())
        if (told["normalizer"], told["pre_tokenizer"]) not in KNOWN or told["post_processor"] not in (None, _BYTES):
            raise ValueError(f"{path}: the tokenizer's normaliser or pre-tokeniser isn't known")
        if any(t[flag] for t in told["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens must be plain strings of the raw text")
        self.added = {t["content"].encode(): t["id"] for t in told["added_tokens"]}
        self.find_added = re.compile(b"|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) or b"(?!)")
        self.capacity = capacity
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _bulk(self, raw: bytes, start: list[int], end: list[int]) -> list[list[int]]:
        """Ids of chunks that each begin with white space and end otherwise.

        They are encoded side by side in long strings: their borders are cut points
        there, too, so each token's offset tells its chunk.
        """
        out: list[list[int]] = []
        for a in range(0, len(start), 4096):
            texts = [raw[s:e].decode("utf-8") for s, e in zip(start[a : a + 4096], end[a : a + 4096], strict=True)]
            edges = np.cumsum([len(t) for t in texts])
            got = self.model.encode("".join(texts), add_special_tokens=False)
            spot = np.fromiter((s for s, _ in got.offsets), np.int64, len(got.ids))
            cuts = np.searchsorted(spot, edges, "left").tolist()
            ids, last = got.ids, 0
            for c in cuts:
                out.append(ids[last:c])
                last = c
        return out

    def _learn(self, keys: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        """Add chunks of ``data``; ``keys`` are sorted and new."""
        if len(self.keys) + len(keys) > self.capacity:
            self._clear()
        raw = data.tobytes()
        last = data[end - 1]
        plain = _CUT[data[start]] & (((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & (data[np.maximum(end - 2, 0)] == 0xC3)))
        ids: list = [None] * len(keys)
        which = np.flatnonzero(plain)
        for i, x in zip(which.tolist(), self._bulk(raw, start[which].tolist(), end[which].tolist()), strict=True):
            ids[i] = x
        which = np.flatnonzero(~plain)
        got = self.model.encode_batch_fast([raw[start[i] : end[i]].decode("utf-8", "replace") for i in which.tolist()], add_special_tokens=False)
        for i, x in zip(which.tolist(), got, strict=True):
            ids[i] = x.ids
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        at = len(self.pool) + np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
        self.pool = np.concatenate((self.pool, np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))))
        spot = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, spot, keys), np.insert(self.at, spot, at), np.insert(self.n, spot, n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, and the documents' offsets in them."""
        raw = data.tobytes()
        if not self.find_added.search(raw):
            return self._encode(data, offsets)
        # added tokens are documents of one id, and so is the text between them
        spots = [(m.start(), m.end(), self.added[m[0]]) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.find_added.finditer(raw, lo, hi)]
        at, ends, token = np.array(spots, np.int64).reshape(-1, 3).T
        parts = np.unique(np.concatenate((offsets, at, ends)))
        which = np.searchsorted(parts, at)
        ids, first = self._encode(data, parts)
        n = np.diff(first)
        stay = np.ones(len(n), bool)
        stay[which] = False
        n[which] = 0
        ids = np.insert(ids[np.repeat(stay, np.diff(first))], (np.cumsum(n) - n)[which], token.astype(np.uint32))
        n[which] = 1
        return ids, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(parts, offsets)]

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = cut_points(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        h = Hasher(data).spans(start, end)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == uniq[inside]
        if not known.all():
            size = len(self.keys)
            self._learn(uniq[~known], start[first[~known]], end[first[~known]], data)
            if len(self.keys) < size + int((~known).sum()) and known.any():  # emptied: the known ones anew, too
                self.capacity, most = len(self.keys) + len(uniq), self.capacity
                self._learn(uniq[known], start[first[known]], end[first[known]], data)
                self.capacity = most
            spot = np.searchsorted(self.keys, uniq)
        n = self.n[spot][inverse].astype(np.int64)
        at = self.at[spot][inverse]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]))]
        total = np.concatenate(([0], ends))
        return ids, total[np.searchsorted(start, offsets, "left")]
