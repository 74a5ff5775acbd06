"""Operator 6, SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed and rebuilt as a ``tokenizers.Tokenizer`` (see
``piece_model``).  Texts are encoded batch by batch, each batch's new segments
on several threads; every distinct segment is also encoded by the
sentencepiece library and compared (``parity``; whole texts are not).
``decode_pieces`` runs whole id lists through the rebuilt tokenizer's decoder;
the ``round_trip`` of encoding joins the bytes of the model's pieces.

Defined results: a null or empty text has no ids, parity and round trip hold;
rows keep their multiplicity; a text's own "▁" decodes to a space (the marker
is not escaped by such models), which ``round_trip`` reports as false.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from lineax.llm import kernel as K
from lineax.llm.piece_model import codec, decoder

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

ADDED = [StructField("ids", ArrayType(IntegerType(), False)), StructField("n_tokens", LongType()), StructField("n_byte_tokens", LongType()),
         StructField("parity", BooleanType()), StructField("round_trip", BooleanType())]


def encode_pieces(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, model_path: str = DEFAULT_MODEL, threads: int = 2) -> DataFrame:
    """``carry`` columns (default: all; those of the added names are replaced) with ids, counts, parity and round trip of every text."""
    added = {f.name for f in ADDED}
    fields = [f for f in docs.schema.fields if f.name in (carry or docs.columns) and f.name not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, threads=threads)
        for batch, texts in K.chunks(batches, text_col, K.CHUNK_BYTES // 2):
            ids, off, agree = c.encode(texts)
            back = c.decode(ids, off)
            same = [back.data[a:b].tobytes() == texts.data[x:y].tobytes() for a, b, x, y in zip(back.off[:-1], back.off[1:], texts.off[:-1], texts.off[1:], strict=True)]
            n_bytes = np.concatenate([[0], np.cumsum(c.is_byte[ids])])
            cols = [batch.column(f.name) for f in fields] + [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids)), pa.array(np.diff(off), pa.int64()), pa.array(np.diff(n_bytes[off]), pa.int64()), pa.array(agree), pa.array(same)]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields] + [f.name for f in ADDED])

    read = list(dict.fromkeys([*(f.name for f in fields), text_col]))
    return docs.select(*read).mapInArrow(run, StructType(fields + ADDED))


def decode_pieces(rows: DataFrame, ids_col: str = "ids", out_col: str = "decoded", model_path: str = DEFAULT_MODEL, threads: int = 2) -> DataFrame:
    """``rows`` with the text of their ids, batch by batch by the rebuilt tokenizer's decoder (null ids: empty text; control
    pieces say nothing, invalid UTF-8 from byte pieces becomes U+FFFD); ids outside the vocabulary are an error."""
    fields = [f for f in rows.schema.fields if f.name != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = decoder(model_path, threads=threads)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                texts = d.decode([x.as_py() or [] for x in batch.column(ids_col)])
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [pa.array(texts, pa.string())], names=[*(f.name for f in fields), out_col])

    return rows.select(*(f.name for f in fields)).mapInArrow(run, StructType([*fields, StructField(out_col, StringType())]))
