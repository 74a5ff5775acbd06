"""SentencePiece models on the tokenizers library.

``read_model`` parses the model's protobuf (only the fields needed here);
``build_tokenizer`` rebuilds it as a ``tokenizers.Tokenizer``: the normaliser's
precompiled character map, the metaspace marker, byte fallback, and unigram
scores or (for BPE models) the merges that the pieces' scores imply.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from lineax.llm.id_table import IdTable, spread
from lineax.llm.kernel import Texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, the rest as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = buf[i]
            i += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        if kind not in (1, 2, 5):
            raise ValueError(f"not a SentencePiece model: wire type {kind}")
        n = {1: 8, 5: 4}.get(kind) or varint()
        if i + n > len(buf):
            raise ValueError("not a SentencePiece model: it is cut short")
        yield tag >> 3, buf[i: i + n]
        i += n


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    proto: bytes = b""

    @property
    def unk_id(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse_model(proto: bytes) -> PieceModel:
    m = PieceModel(proto=proto)
    for number, value in _fields(proto):
        if number == 1:  # a piece
            p = dict(_fields(value))
            score = float(np.frombuffer(p[2], "<f4")[0]) if 2 in p else 0.0
            m.pieces.append((p.get(1, b"").decode(), score, p.get(3, NORMAL)))
        elif number == 2:  # trainer
            t = dict(_fields(value))
            m.model_type, m.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
        elif number == 3:  # normaliser
            n = dict(_fields(value))
            m.charsmap = n.get(2, m.charsmap)
            m.add_dummy_prefix = bool(n.get(3, m.add_dummy_prefix))
            m.remove_extra_whitespaces = bool(n.get(4, m.remove_extra_whitespaces))
            m.escape_whitespaces = bool(n.get(5, m.escape_whitespaces))
    if m.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.model_type} is neither unigram nor BPE")
    return m


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        return parse_model(f.read())


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best piece first."""
    rank = {p: (-score, i) for i, (p, score, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)}
    found = [(rank[p], rank[p[:k]][1], rank[p[k:]][1], p[:k], p[k:]) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [x[3:] for x in sorted(found)]


def build_tokenizer(m: PieceModel, segments: bool = False):
    """The model as a ``tokenizers.Tokenizer``. ``segments``: inputs are parts of a text, so nothing is put before them."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, _merges(m.pieces), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix and not segments:
        steps.append(normalizers.Prepend(" "))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    parts = [decoders.Replace(m.pieces[m.unk_id][0], " ⁇ "), decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(parts + ([decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix and not segments else []))
    return t


def reference_processor(m: PieceModel):
    """The sentencepiece library on the same model with no prefix put before a text (later fields of a protobuf win)."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=m.proto + bytes([0x1A, 0x02, 0x18, 0x00]))


class SegmentCodec:
    """Encode batches of whole texts by their distinct segments.

    A text may be cut before a run of spaces and around line ends when no piece
    of the model reaches over such a place; then encoding the parts gives the
    text's encoding, and equal parts need encoding once.  Models for which that
    does not hold (checked on the vocabulary), or whose normaliser changes
    text, encode whole texts.  The table of known segments holds at most ``keep``
    bytes; results don't depend on it.  ``backend``: ``tokenizers`` (``verify``
    compares every distinct segment with the sentencepiece library), or
    ``sentencepiece``.
    """

    def __init__(self, model: PieceModel, threads: int = 2, keep: int = 16 << 20, backend: str = "tokenizers", verify: bool = True):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        words = [p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)]
        self.m, self.known = model, IdTable(keep)
        self.whole = bool(model.charsmap or model.remove_extra_whitespaces or not model.escape_whitespaces or any(kind == USER_DEFINED for _, _, kind in model.pieces)
                          or any("\n" in p or MARK in p.lstrip(MARK) for p in words))
        self.tok = build_tokenizer(model, segments=not self.whole) if backend == "tokenizers" else None
        self.ref = None
        if verify or not self.tok:
            import sentencepiece

            self.ref = sentencepiece.SentencePieceProcessor(model_proto=model.proto) if self.whole else reference_processor(model)
        table = [self._bytes(p, kind) for p, _, kind in model.pieces]
        self.piece_len = np.array([len(b) for b in table], dtype=np.int64)
        self.piece_off = np.cumsum(self.piece_len) - self.piece_len
        self.piece_data = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.is_byte = np.array([kind == BYTE for _, _, kind in model.pieces])

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def _segments(self, texts: Texts):
        if self.whole:
            return texts.pieces(np.zeros(len(texts.data), dtype=bool))
        space, line = texts.data == 0x20, texts.data == 0x0A
        cut = space | line
        cut[1:] &= ~(space[1:] & space[:-1])
        cut[1:] |= line[:-1]
        return texts.pieces(cut)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets, whether each text's parts agree with the sentencepiece library)."""
        doc, starts, ends, h = self._segments(texts)
        first = np.zeros(len(h), dtype=bool)
        first[np.flatnonzero(np.diff(doc, prepend=-1))] = True
        prefix = first & (self.m.add_dummy_prefix and not self.whole)
        h = np.where(prefix, ~h, h)  # with a space put before it, it is another segment
        names, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        ids, length, good = self.segment_ids(texts, names, starts[at], ends[at], prefix[at])
        n = length[inverse]
        out = ids[spread((np.cumsum(length) - length)[inverse], n)]
        per_doc = np.zeros(texts.n + 1, dtype=np.int64)
        np.cumsum(np.bincount(doc, weights=n, minlength=texts.n).astype(np.int64), out=per_doc[1:])
        agree = np.bincount(doc, weights=~good[inverse], minlength=texts.n) == 0
        return out, per_doc, agree

    def segment_ids(self, texts: Texts, names: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all segments, their numbers, whether the libraries agree) of segments with ascending distinct ``names``."""
        def encode(part: np.ndarray) -> tuple[list[list[int]], list[bool] | None]:
            words = [(" " if p else "") + texts.text(s, e) for p, s, e in zip(prefix[part].tolist(), starts[part].tolist(), ends[part].tolist(), strict=True)]
            theirs = self.ref.encode(words, num_threads=1) if self.ref else None
            if not self.tok:
                return theirs, None
            ours = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            return ours, None if theirs is None else [x == y for x, y in zip(ours, theirs, strict=True)]

        return self.known.lookup(names, encode)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> Texts:
        """The texts' bytes: pieces with marks as spaces, byte pieces as bytes, without the prefix's space."""
        n = self.piece_len[ids]
        data = self.piece_data[spread(self.piece_off[ids], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[off]
        if self.m.add_dummy_prefix and len(data):
            full = np.flatnonzero(ends[:-1] < ends[1:])
            drop = ends[:-1][full][data[ends[:-1][full]] == 0x20]
            data = np.delete(data, drop)
            ends = ends - np.searchsorted(drop, ends)
        return Texts(data, ends)


class Decoder:
    """Id lists to texts by the rebuilt tokenizer, as the sentencepiece library decodes them.

    One difference: in a run of byte pieces that is no UTF-8 every byte becomes U+FFFD, valid ones among them too.
    """

    def __init__(self, model: PieceModel, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.whole, self.rest = build_tokenizer(model), build_tokenizer(model, segments=True)
        self.size, self.unk = len(model.pieces), model.unk_id
        self.silent = {i for i, (_, _, kind) in enumerate(model.pieces) if kind == CONTROL}

    def decode(self, lists: list[list[int]]) -> list[str]:
        for ids in lists:
            if ids and not 0 <= min(ids) <= max(ids) < self.size:
                raise ValueError("an id outside the vocabulary")
        said = [[i for i in ids if i not in self.silent] for ids in lists]
        out = self.whole.decode_batch(said, skip_special_tokens=False)
        for at, ids in enumerate(said):
            if ids[:1] == [self.unk]:  # its sign begins with a space that is no prefix
                out[at] = self.rest.decode(ids, skip_special_tokens=False)
        return out


_OPEN: dict[tuple, SegmentCodec | Decoder] = {}


def _opened(kind: type, path: str, options: dict):
    key = (kind, path, *sorted(options.items()))
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = kind(read_model(path), **options)
    return _OPEN[key]


def codec(path: str, **options) -> SegmentCodec:
    """The worker's codec: one at a time, another setting takes the place of the last."""
    return _opened(SegmentCodec, path, options)


def decoder(path: str, **options) -> Decoder:
    return _opened(Decoder, path, options)
