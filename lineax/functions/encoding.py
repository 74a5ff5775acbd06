"""Residue encoding and masking (#24, #25): look-up tables over Arrow buffers instead of a search per residue."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100
#: Residues coded or masked at a time: a batch's working arrays are bounded whatever its rows hold (a longer row goes alone).
BLOCK = 1 << 18


def blocks(size: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first row, end) of runs of rows whose sizes add up to at most ``most``, or of one larger row; one empty run without rows."""
    end, lo = np.cumsum(size), 0
    while lo < len(size) or lo == 0:
        hi = int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most, side="right"))
        hi = min(max(hi, lo + 1), len(size))
        yield lo, hi
        if hi == len(size):
            return
        lo = hi


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start[i], start[i] + n[i])``."""
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(start - (np.cumsum(n) - n), n)


def _lists(values: np.ndarray, n: np.ndarray, gone: np.ndarray) -> pa.Array:
    """Rows of ``n`` values each, null where ``gone``."""
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off, mask=np.append(gone, False)), pa.array(values.astype(np.int32)))


def residue_ids(texts: pa.Array, table: np.ndarray, max_len: int | None, start_id: int, end_id: int, pad_id: int) -> tuple[pa.Array, pa.Array]:
    """(ids, attention mask) of a batch of sequences; ``table``: the id of each first byte of a character."""
    gone = np.array(texts.is_null())
    texts = texts.cast(pa.large_string()).fill_null("")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    first = (data & 0xC0) != 0x80
    ids = table[data[first]]
    at = np.concatenate([[0], np.cumsum(first)])[off]
    n = np.diff(at)
    if max_len is not None:
        n = np.minimum(n, max_len - 2)
    size = np.where(gone, 0, n + 2 if max_len is None else max_len)
    n = np.where(gone, 0, n)
    begin = np.cumsum(size) - size
    out, real = np.full(int(size.sum()), pad_id), np.zeros(int(size.sum()), dtype=np.int64)
    out[_spread(begin + 1, n)] = ids[_spread(at[:-1], n)]
    out[begin[~gone]] = start_id
    out[(begin + n + 1)[~gone]] = end_id
    real[_spread(begin, np.where(gone, 0, n + 2))] = 1
    return _lists(out, size, gone), _lists(real, size, gone)


def encode_residues(
    df: DataFrame,
    vocab: Mapping[str, int],
    seq: str = "seq",
    max_len: int | None = 1024,
    start_id: int = 0,
    end_id: int = 2,
    pad_id: int = 1,
    unk_id: int = 3,
    ids: str = "input_ids",
    mask: str = "attention_mask",
) -> DataFrame:
    """Character-level token ids with start/end markers; a null sequence has null ids.

    With ``max_len`` the ids are truncated (first ``max_len - 2`` residues plus
    both markers) and padded to ``max_len`` as the fine-tuning inputs are; with
    ``max_len=None`` the whole sequence is encoded without padding.  Residues of
    the vocabulary are ASCII; any other character is one unknown residue.
    """
    if odd := [k for k in vocab if len(k) != 1 or not k.isascii()]:
        raise ValueError(f"not ASCII residues: {odd}")
    table = np.full(256, unk_id, dtype=np.int64)
    for k, v in vocab.items():
        table[ord(k)] = v

    @F.arrow_udf("struct<ids:array<int>,mask:array<int>>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 2
            for lo, hi in blocks(np.maximum(size, max_len or 0)):
                yield pa.StructArray.from_arrays(residue_ids(texts.slice(lo, hi - lo), table, max_len, start_id, end_id, pad_id), names=["ids", "mask"])

    both = coded(F.col(seq))
    return df.withColumns({ids: both["ids"], mask: both["mask"]})


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser on unsigned 32-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
        return x ^ (x >> np.uint32(16))


def masked(ids: np.ndarray, n: np.ndarray, seeds: np.ndarray, special: Sequence[int], mask_id: int, vocab_size: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(masked ids, labels) of rows of ``n`` ids each."""
    row = np.repeat(np.arange(len(n)), n)
    place = _spread(np.zeros(len(n), np.int64), n).astype(np.uint32)

    def h(salt: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(seeds.astype(np.uint32)[row] + place * np.uint32(0x9E3779B9) + np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF))

    open_to = np.flatnonzero(~np.isin(ids, list(special)))
    per = np.bincount(row[open_to], minlength=len(n))
    order = open_to[np.lexsort((place[open_to], h(0)[open_to], row[open_to]))]
    rank = np.arange(len(order)) - (np.cumsum(per) - per)[row[order]]
    chosen = order[rank < np.floor(rate * per + 0.5)[row[order]]]
    labels = np.full(len(ids), IGNORED)
    labels[chosen] = ids[chosen]
    how, out = h(1)[chosen].astype(np.int64) * 10, ids.copy()
    out[chosen] = np.where(how < 8 << 32, mask_id, np.where(how < 9 << 32, h(2)[chosen].astype(np.int64) % vocab_size, ids[chosen]))
    return out, labels


def row_seed(row_key: str, seed: int) -> Column:
    """32 bits of md5 of the seed and the row's key."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(row_key).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mask_residues(
    df: DataFrame,
    row_key: str,
    ids: str = "input_ids",
    special: Sequence[int] = (0, 1, 2),
    mask_id: int = 32,
    vocab_size: int = 33,
    rate: float = 0.15,
    seed: int = 13,
    out_ids: str = "masked_ids",
    labels: str = "labels",
) -> DataFrame:
    """Masked-language-model corpus: of each row's non-special places the ``rate`` (rounded) with the smallest hash of
    (row, place, seed) are chosen; of those about 80 % become ``mask_id``, 10 % a random token, 10 % stay, by further
    hashes.  ``labels`` hold the original id at chosen places and -100 elsewhere; null ids stay null.
    """
    @F.arrow_udf("struct<ids:array<int>,labels:array<int>>")
    def hidden(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for every, seeds in batches:
            size = every.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in blocks(size):
                rows, n = every.slice(lo, hi - lo), size[lo:hi]
                gone = np.array(rows.is_null())
                flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                parts = masked(flat, n, seeds.slice(lo, hi - lo).to_numpy(zero_copy_only=False), special, mask_id, vocab_size, rate)
                yield pa.StructArray.from_arrays([_lists(x, n, gone) for x in parts], names=["ids", "labels"])

    both = hidden(F.col(ids), row_seed(row_key, seed))
    return df.withColumns({out_ids: both["ids"], labels: both["labels"]})
