"""Operator 3, quality rules: base counts per text and tokeniser fertility with rejection bands.

A public vocabulary is a ruler for text it was fitted to: ordinary prose of a
language takes a steady number of its tokens per word and characters per
token, next to no byte fallback, and a wide spread of tokens.  Symbol noise,
shouting, separator-ridden tables and mojibake leave those bands.  Bands are
per language (``lang`` column), also for a text in another script than its
language's, or, where the language has none, per the text's main script.
Scripts that the vocabulary holds letter by letter (Greek, Hebrew, ...) show
noise only by long words and byte fallback; scripts without spaces only by
characters per token, byte fallback and entropy.

Measures are taken over all words of the whole text: each distinct word of a
batch is encoded once and its tokens count as often as the word occurs.

Defined results: a null or empty text has zero counts, fails the base rule and
is not kept; a null language takes the script's bands; repeated rows and ties
are judged alike row by row; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from lineax.llm import kernel as K
from lineax.llm.piece_model import codec, spread

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Band:
    """Limits of accepted texts.

    Short texts scatter, so two limits move with their length: fertility may
    exceed its limit by slack / sqrt(words), and the least entropy (a share of
    the greatest possible) rises by entropy_rise with each halving of the
    tokens below 2 ** ENTROPY_BITS.
    """

    max_tokens_per_word: float
    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float
    slack: float = 2.0
    entropy_rise: float = 0.034


#: Bands for DEFAULT_MODEL. Languages and scripts absent here take "other". Those of other scripts than Latin lie
#: between ordinary sentences (14 to 45 words a language where words have spaces) and random letters or ``%%%|||`` suffixes.
BANDS: dict[str, Band] = {
    "en": (latin := Band(3.05, 1.45, 7.0, 0.05, 0.682)),
    "de": replace(latin, max_tokens_per_word=3.35),
    "fr": replace(latin, max_tokens_per_word=3.25),
    "es": replace(latin, max_tokens_per_word=3.45),
    "Latin": replace(latin, max_tokens_per_word=4.0, min_entropy=0.55),
    "Cyrillic": (cyrillic := Band(4.5, 1.3, 7.0, 0.05, 0.60)),
    "Greek": (greek := Band(9.0, 0.65, 7.0, 0.10, 0.38)),
    "Armenian": Band(10.0, 0.55, 7.0, 0.30, 0.38),
    "Hebrew": (hebrew := Band(8.0, 0.65, 7.0, 0.10, 0.38)),
    "Arabic": (arabic := Band(8.0, 0.60, 7.0, 0.10, 0.38)),
    "Devanagari": (devanagari := Band(9.0, 0.55, 7.0, 0.25, 0.38)),
    "Tamil": Band(15.5, 0.60, 7.0, 0.25, 0.38),
    "Thai": (thai := Band(1e9, 0.75, 7.0, 0.20, 0.38)),
    "Georgian": Band(10.0, 0.65, 7.0, 0.12, 0.38),
    "Han": (han := Band(1e9, 0.60, 7.0, 0.45, 0.60)),
    "Hangul": (hangul := Band(6.5, 0.50, 7.0, 0.30, 0.55)),
    **dict.fromkeys(("ru", "uk", "bg"), cyrillic), "el": greek, "he": hebrew, **dict.fromkeys(("ar", "fa"), arabic), "hi": devanagari, "th": thai, **dict.fromkeys(("zh", "ja"), han), "ko": hangul,
    "other": Band(1e9, 0.25, 8.0, 0.80, 0.30, entropy_rise=0.0),
}

#: Code points of the scripts that have bands; Han holds Kana, too.
SCRIPTS = {"Cyrillic": [(0x400, 0x52F)], "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "Armenian": [(0x530, 0x58F)], "Hebrew": [(0x590, 0x5FF)], "Arabic": [(0x600, 0x77F), (0xFB80, 0xFDFF), (0xFE80, 0xFEFF)],
           "Devanagari": [(0x900, 0x97F)], "Tamil": [(0xB80, 0xBFF)], "Thai": [(0xE00, 0xE7F)], "Georgian": [(0x10C0, 0x10FF)], "Han": [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)], "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7BF)]}

#: Texts of more tokens are not expected to use more different ones (in powers of 2).
ENTROPY_BITS = 9.0

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = StructType([StructField(c, LongType()) for c in BASE] + [StructField("base_failed", BooleanType()), StructField("n_tokens", LongType())]
                      + [StructField(c, DoubleType()) for c in ("tokens_per_word", "chars_per_token", "byte_share", "token_entropy")]
                      + [StructField("rejected_by", StringType()), StructField("kept", BooleanType())])

SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
LETTER = np.isin(np.arange(256) | 0x20, np.arange(0x61, 0x7B))


def base_counts(texts: K.Texts, doc, starts, ends, h, window: int = 8) -> dict[str, np.ndarray]:
    """The five base counts per text from its words (kernel ``words``)."""
    def per(at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, texts.off))

    chars = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    n_words = np.bincount(doc, minlength=texts.n)
    word_chars = np.bincount(doc, weights=chars[ends] - chars[starts], minlength=texts.n).astype(np.int64)
    # lines: runs between \n, named by the hash of their bytes
    line_end = texts.data == 0x0A
    cut = np.zeros(len(texts.data), dtype=bool)
    cut[1:] = line_end[:-1]
    ld, ls, le, _ = texts.pieces(cut)
    le = le - line_end[le - 1]
    holds = np.searchsorted(starts, ls) < np.searchsorted(starts, le)
    ld, ls, le = ld[holds], ls[holds], le[holds]
    distinct = np.bincount(K.unique_in_doc(ld, K.hash_segments(texts.data, ls, le))[0], minlength=texts.n)
    # words covered by a window whose hash its text has twice
    at, wh = K.windows(doc, h, window)
    order = np.lexsort((wh, doc[at]))
    same = (wh[order][1:] == wh[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.bincount(at[twice], minlength=len(h) + 1) - np.bincount(at[twice] + window, minlength=len(h) + 1)[: len(h) + 1]
    covered = np.cumsum(edge)[: len(h)] > 0
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": per(np.flatnonzero(SYMBOL[texts.data])),
            "n_dup_lines": np.bincount(ld, minlength=texts.n) - distinct, "n_repeat_words": np.bincount(doc[covered], minlength=texts.n)}


def token_measures(texts: K.Texts, doc, starts, ends, h, model) -> dict[str, np.ndarray]:
    """Tokens, byte-fallback share and entropy per text, each word encoded on its own."""
    names, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    ids, length, _ = model.segment_ids(texts, names, starts[at], ends[at], np.ones(len(at), dtype=bool))
    off = np.cumsum(length) - length
    pair, times = np.unique(doc * np.int64(max(len(names), 1)) + inverse, return_counts=True)
    pd, pw = np.divmod(pair, max(len(names), 1))
    tokens = ids[spread(off[pw], length[pw])].astype(np.int64)
    td, weight = np.repeat(pd, length[pw]), np.repeat(times, length[pw])
    n_tokens = np.bincount(td, weights=weight, minlength=texts.n)
    n_bytes = np.bincount(td, weights=weight * model.is_byte[tokens], minlength=texts.n)
    size = len(model.piece_len)
    key, inverse = np.unique(td * size + tokens, return_inverse=True)
    kd = key // size
    share = np.bincount(inverse, weights=weight, minlength=len(key)) / n_tokens[kd] if len(key) else np.zeros(0)
    bits = np.bincount(kd, weights=-share * np.log2(share), minlength=texts.n)
    most = np.minimum(np.log2(np.maximum(n_tokens, 2)), ENTROPY_BITS)
    return {"n_tokens": n_tokens.astype(np.int64), "byte_share": n_bytes / np.maximum(n_tokens, 1), "token_entropy": bits / most}


def _script_table() -> np.ndarray:
    """The number of the script in SCRIPTS, or their count, by the first two UTF-8 bytes of a character of two or three."""
    out = np.full((256, 256), len(SCRIPTS), dtype=np.int64)
    for i, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            for c in range(lo, hi + 1):
                b = chr(c).encode()
                out[b[0], b[1]] = i
    return out


SCRIPT_OF = _script_table()


def main_script(texts: K.Texts) -> np.ndarray:
    """Latin where most letters of a text are (ASCII letters and two-byte letters below U+0250 against longer UTF-8 sequences), else its most frequent script of SCRIPTS, else other."""
    data = texts.data
    latin = np.concatenate([[0], np.cumsum(LETTER[data] | ((data >= 0xC3) & (data <= 0xC9)))])
    rest = np.concatenate([[0], np.cumsum(data > 0xC9)])
    names, n = np.array([*SCRIPTS, "other"], dtype=object), len(SCRIPTS)
    at = np.flatnonzero(data > 0xC9)
    script = SCRIPT_OF[data[at], data[np.minimum(at + 1, len(data) - 1)]]
    doc = np.searchsorted(texts.off, at, side="right") - 1
    counts = np.bincount((doc * (n + 1) + script)[script < n], minlength=texts.n * (n + 1)).reshape(texts.n, n + 1)
    counts[:, n] = counts[:, :n].max(axis=1, initial=0) == 0
    return np.where(np.diff(latin[texts.off]) >= np.diff(rest[texts.off]), "Latin", names[counts.argmax(axis=1)])


def measure(texts: K.Texts, langs: list[str | None], model, bands: dict[str, Band], min_words: int, max_repeat: int) -> dict[str, np.ndarray]:
    words = texts.words()
    m = base_counts(texts, *words) | token_measures(texts, *words, model)
    n = np.maximum(m["n_words"], 1)
    m["tokens_per_word"] = m["n_tokens"] / n
    m["chars_per_token"] = m["word_chars"] / np.maximum(m["n_tokens"], 1)
    m["base_failed"] = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_repeat * m["n_words"])
    band = [bands.get(lang) or bands.get(script) or bands["other"] for lang, script in zip(langs, main_script(texts), strict=True)]
    limit = {f: np.array([getattr(b, f) for b in band]) for f in Band.__dataclass_fields__}
    why = np.full(texts.n, None, dtype=object)
    for name, wrong in (
        ("token_entropy", m["token_entropy"] < limit["min_entropy"] + limit["entropy_rise"] * np.maximum(0, ENTROPY_BITS - np.log2(np.maximum(m["n_tokens"], 2)))),
        ("byte_share", m["byte_share"] > limit["max_byte_share"]),
        ("chars_per_token", (m["chars_per_token"] < limit["min_chars_per_token"]) | (m["chars_per_token"] > limit["max_chars_per_token"])),
        ("tokens_per_word", m["tokens_per_word"] > limit["max_tokens_per_word"] + limit["slack"] / np.sqrt(n)),
        ("base", m["base_failed"]),
    ):
        why[wrong] = name
    m["rejected_by"], m["kept"] = why, np.equal(why, None)
    return m


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", carry: list[str] | None = None, measures: bool = True, only_kept: bool = False,
                  model_path: str = DEFAULT_MODEL, bands: dict[str, Band] | None = None, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """Judge every text.

    carry: input columns to return (default: all); measures: add the columns of
    ``MEASURES`` (not carried columns of the same name); only_kept: return
    accepted rows only.  Texts stream through Arrow batches once; nothing is shuffled.
    """
    bands = bands or BANDS
    carry = docs.columns if carry is None else carry
    lang_col = lang_col if lang_col in docs.columns else None
    read = list(dict.fromkeys([*carry, text_col, *([lang_col] if lang_col else [])]))
    fields = [f for f in docs.schema.fields if f.name in carry and not (measures and f.name in MEASURES.names)]
    schema = StructType([*fields, *(MEASURES.fields if measures else [])])
    kinds = {f.name: {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()] for f in MEASURES.fields}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path, backend="sentencepiece", verify=False)
        for batch, texts in K.chunks(batches, text_col, K.CHUNK_BYTES // 4):  # many arrays a word
            langs = batch.column(lang_col).to_pylist() if lang_col else [None] * texts.n
            m = measure(texts, langs, model, bands, min_words, max_repeat)
            cols = {f.name: batch.column(f.name) for f in fields}
            if measures:
                cols |= {c: pa.array(m[c], type=kinds[c]) for c in MEASURES.names}
            out = pa.RecordBatch.from_pydict(cols)
            yield out.filter(pa.array(m["kept"])) if only_kept else out

    return docs.select(*read).mapInArrow(judge, schema)
