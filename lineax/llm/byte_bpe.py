"""Ids of a byte-level BPE tokenizer (a ``tokenizers`` file), texts cut into segments that are encoded once.

Such a tokenizer splits a text by a pattern before any merge: runs of letters,
digits or other signs with at most one space before them, and white space.  The
last white-space character before a sign always begins a new part, whatever
stands before it, and the pattern looks at nothing earlier; so a text may be
cut there, equal segments have equal ids, and the ids of a text are those of
its segments in turn.  Only ASCII white space before bytes that can't begin
a white-space character is cut at.  Likewise a run of signs begins after an
ASCII letter (but for the apostrophe of contractions), which keeps words apart
from the commas after them.  Where a run of texts spells out one of the
tokenizer's added tokens, only white space is cut at.  Anything else stays
inside a segment.
"""

from __future__ import annotations

import os

import numpy as np

from lineax.llm import kernel as K
from lineax.llm.id_table import IdTable, spread

#: First bytes of characters that are no white space: printable ASCII, and UTF-8 lead bytes without any space of Unicode behind them.
SIGN = np.zeros(257, dtype=bool)
SIGN[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xEF), *range(0xF0, 0xF5)]] = True
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: ASCII signs, without the apostrophe.
MARK = np.zeros(256, dtype=bool)
MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True


class ByteBpe:
    """Encode batches of texts; ``keep`` bounds the table of known segments in bytes."""

    def __init__(self, path: str, threads: int = 1, keep: int = 32 << 20):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), IdTable(keep)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets)."""
        sign = SIGN[texts.data]
        cut = K.IS_SPACE[texts.data]
        cut[:-1] &= sign[1:]
        cut[texts.off[1:][np.diff(texts.off) > 0] - 1] = False  # white space at a text's end stands before nothing
        raw = texts.data.tobytes()
        if not any(t in raw for t in self.added):
            cut[1:] |= LETTER[texts.data[:-1]] & MARK[texts.data[1:]]
        doc, starts, ends, h = texts.pieces(cut)
        names, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        s, e = starts[at], ends[at]

        def encode(part: np.ndarray) -> tuple[list[list[int]], None]:
            parts = [texts.text(a, b) for a, b in zip(s[part].tolist(), e[part].tolist(), strict=True)]
            return [x.ids for x in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)], None

        ids, length, _ = self.known.lookup(names, encode)
        n = length[inverse]
        out = ids[spread((np.cumsum(length) - length)[inverse], n)]
        off = np.zeros(texts.n + 1, dtype=np.int64)
        np.cumsum(np.bincount(doc, weights=n, minlength=texts.n).astype(np.int64), out=off[1:])
        return out, off


_OPEN: dict[tuple, ByteBpe] = {}


def byte_bpe(path: str, **options) -> ByteBpe:
    """The worker's tokenizer: one at a time."""
    key = (path, *sorted(options.items()))
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = ByteBpe(path, **options)
    return _OPEN[key]
