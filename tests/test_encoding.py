"""Encoding and masking against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineax.functions import encoding as E

VOCAB = {c: i + 4 for i, c in enumerate("ACDEFGHIKLMNPQRSTVWY")}
SEQS = [None, "", "A", "ACDZ", "é日😀A", "A" * 30, "x-*", "ACD" * 400]


def plain(s, max_len):
    if s is None:
        return None, None
    body = [VOCAB.get(c, 3) for c in (s if max_len is None else s[: max_len - 2])]
    ids = [0, *body, 2]
    pad = 0 if max_len is None else max_len - len(ids)
    return ids + [1] * pad, [1] * len(ids) + [0] * pad


@pytest.mark.parametrize("max_len", [None, 3, 10, 64])
def test_encoding_is_the_plain_one(spark, max_len):
    df = spark.createDataFrame(list(enumerate(SEQS)), "id long, seq string").repartition(2)
    got = {r.id: (r.input_ids, r.attention_mask) for r in E.encode_residues(df, VOCAB, "seq", max_len).collect()}
    assert got == {i: plain(s, max_len) for i, s in enumerate(SEQS)}
    assert E.encode_residues(df.limit(0), VOCAB).collect() == []


def test_other_vocabularies_are_an_error(spark):
    for key in ("é", "AB", ""):
        with pytest.raises(ValueError, match="ASCII"):
            E.encode_residues(spark.range(1).withColumn("seq", F.lit("A")), {key: 5})


def test_masks_have_their_size_in_every_row_and_labels_their_ids(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SEQS * 30)], "id long, seq string")
    enc = E.encode_residues(df, VOCAB, "seq", 128)
    rows = E.mask_residues(enc, "id", mask_id=32).collect()
    again = {r.id: r.masked_ids for r in E.mask_residues(enc.repartition(7), "id", mask_id=32).collect()}
    masked = random = kept = 0
    for r in rows:
        if r.input_ids is None:
            assert r.masked_ids is None and r.labels is None
            continue
        assert again[r.id] == r.masked_ids
        open_to = [i for i, x in enumerate(r.input_ids) if x not in (0, 1, 2)]
        chosen = [i for i, x in enumerate(r.labels) if x != -100]
        assert len(chosen) == int(np.floor(0.15 * len(open_to) + 0.5)) and set(chosen) <= set(open_to)
        assert all(r.labels[i] == r.input_ids[i] for i in chosen)
        assert all(a == b for i, (a, b) in enumerate(zip(r.input_ids, r.masked_ids, strict=True)) if i not in chosen)
        masked += sum(r.masked_ids[i] == 32 for i in chosen)
        kept += sum(r.masked_ids[i] == r.input_ids[i] for i in chosen)
        random += sum(r.masked_ids[i] not in (32, r.input_ids[i]) for i in chosen)
    total = masked + random + kept
    assert 0.75 < masked / total < 0.85 and 0.06 < kept / total < 0.16 and 0.05 < random / total < 0.14
    other = {r.id: r.masked_ids for r in E.mask_residues(enc, "id", mask_id=32, seed=14).collect()}
    assert other != again


def test_blocks_bound_the_working_arrays(spark):
    """A batch of more residues than a block is coded and masked block by block, every row as if alone."""
    assert list(E.blocks(np.array([3, 3, 9, 1, 0, 2]), 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(E.blocks(np.array([], dtype=np.int64), 6)) == [(0, 0)] and list(E.blocks(np.zeros(3, np.int64), 6)) == [(0, 3)]
    texts = ["AC" * 40_000, None, "", "GA" * 200_000, "ACGA", "é" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, seq string").coalesce(1)
    enc = E.encode_residues(df, VOCAB, "seq", None)
    together = {r.id: r for r in E.mask_residues(enc, "id").collect()}
    for i, text in enumerate(texts):
        assert (together[i].input_ids, together[i].attention_mask) == plain(text, None)
        alone = E.mask_residues(E.encode_residues(df.where(F.col("id") == i), VOCAB, "seq", None), "id").first()
        assert (together[i].masked_ids, together[i].labels) == (alone.masked_ids, alone.labels)
