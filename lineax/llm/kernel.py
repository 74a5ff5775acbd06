"""Array kernels over a batch of texts: one flat byte buffer plus offsets, no per-word Python.

Texts are cut on bytes, which is exact for UTF-8 because every separator used
here is an ASCII byte.  Segments (words, lines) are named by 64-bit hashes of
their bytes: a polynomial hash over randomised byte values, taken from prefix
sums that are computed in blocks, so temporary memory is bounded by ``BLOCK``
whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
CHUNK_BYTES = 4 << 20

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)

#: The ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply), salted."""
    x = x + U((salt * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & _MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U), 7)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POW:
        with np.errstate(over="ignore"):
            one = np.ones(BLOCK + 1, dtype=U)
            up, down = one.copy(), one.copy()
            up[1:], down[1:] = U(_P), U(_INV)
            _POW[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POW[0]


def hash_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``data[s:e]`` for ascending, non-overlapping segments."""
    up, down = _powers()
    at_start, at_end = np.zeros(len(starts), dtype=U), np.zeros(len(ends), dtype=U)
    inverse = np.zeros(len(starts), dtype=U)
    carry = 0
    with np.errstate(over="ignore"):
        for b0 in range(0, max(len(data), 1), BLOCK):
            block = data[b0: b0 + BLOCK]
            scale, unscale = pow(_P, b0, 1 << 64), pow(_INV, b0, 1 << 64)
            local = np.zeros(len(block) + 1, dtype=U)
            np.cumsum(_BYTE_VALUE[block] * up[: len(block)], out=local[1:])
            local = local * U(scale) + U(carry)
            a, z = np.searchsorted(starts, [b0, b0 + BLOCK])
            at_start[a:z] = local[starts[a:z] - b0]
            inverse[a:z] = down[starts[a:z] - b0] * U(unscale)
            a, z = np.searchsorted(ends, [b0 + 1, b0 + BLOCK + 1])
            at_end[a:z] = local[ends[a:z] - b0]
            carry = int(local[-1])
        return mix((at_end - at_start) * inverse + (ends - starts).astype(U))


class Texts:
    """A batch of texts as bytes: ``data`` and ``off`` (n + 1 offsets); null texts count as empty."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n, self._raw = data, off, len(off) - 1, None

    def slices(self) -> np.ndarray:
        """Text number of each byte is implied by ``off``; first bytes of non-empty texts."""
        first = self.off[:-1]
        return first[first < self.off[1:]]

    def words(self, lower: bool = False, hashes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """(text number, start, end, hash) of each word ``[^\\x20\\x09-\\x0D]+``."""
        data = self.data
        space = IS_SPACE[data]
        opens = ~space
        if len(data):
            brk = space.copy()  # brk[i]: a word cannot continue from byte i to i + 1
            brk[self.slices()[1:] - 1] = True
            closes = opens.copy()
            closes[:-1] &= brk[:-1] | space[1:]
            opens[1:] &= brk[:-1]
            starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        else:
            starts = ends = np.zeros(0, dtype=np.int64)
        return self._named(starts, ends, LOWER[data] if lower else data, hashes)

    def _named(self, starts, ends, data, hashes):
        doc = np.repeat(np.arange(self.n), np.diff(np.searchsorted(starts, self.off)))
        return doc, starts, ends, hash_segments(data, starts, ends) if hashes else None

    def pieces(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, end, hash) of the segments that begin where ``cut`` is true or a text begins."""
        cut = cut.copy()
        cut[self.slices()] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(self.data)) if len(starts) else starts
        return self._named(starts, ends, self.data, True)

    def text(self, s: int, e: int) -> str:
        if self._raw is None:
            self._raw = self.data.tobytes()
        return self._raw[s:e].decode("utf-8", "replace")


def flat(column: pa.Array) -> Texts:
    """The texts of an Arrow string column (any string type, nulls as empty) without copying them."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    off = np.frombuffer(off, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[off[0]: off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return Texts(data, off - off[0])


def chunks(batches: Iterator[pa.RecordBatch], text_col: str, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut batches into runs of whole texts of about ``size`` bytes; a longer text is a run of its own."""
    for batch in batches:
        texts = flat(batch.column(text_col))
        lo = 0
        while lo < texts.n:
            hi = int(np.searchsorted(texts.off, texts.off[lo] + size, side="right")) - 1
            hi = min(max(hi, lo + 1), texts.n)
            a, z = texts.off[lo], texts.off[hi]
            yield batch.slice(lo, hi - lo), Texts(texts.data[a:z], texts.off[lo: hi + 1] - a)
            lo = hi


def windows(doc: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word number, hash) of each run of ``size`` words within one text."""
    if len(h) < size:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1:])
    out = np.zeros(len(at), dtype=U)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * U(_P) + h[at + k]
        return at, mix(out, size)


def unique_in_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, hash) pairs, ordered by text, then hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words (A-Z lower-cased) as (text number, hash); a shorter text's whole sequence is its one shingle."""
    doc, _, _, h = texts.words(lower=True)
    at, wh = windows(doc, h, size)
    wd = doc[at]
    per = np.bincount(doc, minlength=texts.n)
    first = np.cumsum(per) - per
    short_d, short_h = [], []
    for n in range(1, size):
        d = np.flatnonzero(per == n)
        out = np.zeros(len(d), dtype=U)
        with np.errstate(over="ignore"):
            for k in range(n):
                out = out * U(_P) + h[first[d] + k]
            short_d.append(d)
            short_h.append(mix(out, n))
    return unique_in_doc(np.concatenate([wd, *short_d]), np.concatenate([wh, *short_h]))


def to_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
