"""Operator 12, importance resampling to a target distribution by hashed features.

A text's features are all runs of 1 to ``most`` consecutive words (A-Z
lower-cased, ASCII letters, digits and everything above ASCII), joined by one
space, repeats counted; a feature's bucket is the crc32 of its UTF-8 bytes
modulo ``buckets``.

Length-bucketed CRC matrices.  The distinct features of a run of texts are
grouped by equal byte length L into (number, L) uint8 arrays; one step per
column updates the CRCs of the whole group, and the buckets are scattered back
to the features' places.  Features of more than ``WIDEST`` bytes (texts without
separators) go through zlib one by one, since a column step for each of their
bytes would be a step for a single feature.

Spark's part.  Each task adds its texts' features up to at most ``buckets``
rows, so the shuffle of counts has no text in it; the counts of raw and target
texts (``buckets`` numbers each) give the gains.  A second pass weighs every
text, and the draw takes the ``share`` of texts with the highest score: a count
of texts by score (scores are integers of a bounded range) finds the last
score drawn, and only texts from there on are sorted for their ranks.

Defined results: null texts have no words, no features and weight 0; a null id
draws as the empty string and ties last; repeated rows are texts of their own
(equal ids draw alike, in any order among themselves); ``carry`` columns that
are named like a result are replaced by it; an empty corpus gives no rows, an
empty target makes every bucket's target count 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lineax.llm import kernel as K
from lineax.llm.id_table import spread
from lineax.operators.ordinal import with_global_ordinal
from lineax.session import materialize

#: Bytes of a word, after A-Z are lower-cased: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
WIDEST = 256
#: Rows of a matrix at a time.
ROWS = 1 << 16


def _crc_table() -> np.ndarray:
    """The register's change for each value of its low byte (reflected polynomial of crc32)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()


def crc_by_length(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of ``data[s:e]`` for every (start, end)."""
    out = np.zeros(len(starts), dtype=np.uint32)
    length = ends - starts
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        size = int(length[group[0]])
        if size > WIDEST:
            out[group] = [zlib.crc32(data[s: s + size]) for s in starts[group].tolist()]
            continue
        for a in range(0, len(group), ROWS):
            at = group[a: a + ROWS]
            matrix = data[starts[at][None, :] + np.arange(size)[:, None]]  # one row of it per byte position
            register = np.full(len(at), 0xFFFFFFFF, dtype=np.uint32)
            for column in matrix:
                register = CRC_TABLE[(register ^ column) & 0xFF] ^ (register >> 8)
            out[at] = ~register
    return out


def words(texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, text number, start, end) of each word."""
    data = K.LOWER[texts.data]
    inside = IS_WORD[data]
    opens, closes = inside.copy(), inside.copy()
    first = texts.slices()
    opens[1:] &= ~inside[:-1]
    opens[first] = inside[first]
    closes[:-1] &= ~inside[1:]
    closes[first[1:] - 1] = inside[first[1:] - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return data, np.repeat(np.arange(texts.n), np.diff(np.searchsorted(starts, texts.off))), starts, ends


def feature_buckets(texts: K.Texts, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket) of every feature, and each text's number of words."""
    data, doc, starts, ends = words(texts)
    h = K.hash_segments(data, starts, ends)
    n_words = np.bincount(doc, minlength=texts.n)
    if most > 1:  # words side by side with one space between them
        n = ends - starts + 1
        at = np.cumsum(n) - n
        line = np.full(int(n.sum()), 0x20, dtype=np.uint8)
        line[spread(at, n - 1)] = data[spread(starts, n - 1)]
        data, starts, ends = line, at, at + n - 1
    out_doc, out_bucket = [], []
    for size in range(1, most + 1):
        first, name = K.windows(doc, h, size)
        _, at, inverse = np.unique(name, return_index=True, return_inverse=True)
        bucket = crc_by_length(data, starts[first[at]], ends[first[at] + size - 1]) % np.uint32(buckets)
        out_doc.append(doc[first])
        out_bucket.append(bucket.astype(np.int64)[inverse])
    return np.concatenate(out_doc), np.concatenate(out_bucket), n_words


def bucket_counts(docs: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; the driver gets at most ``buckets`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, texts in K.chunks(batches, "text"):
            total += np.bincount(feature_buckets(texts, most, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of each bucket's log ratio of target to raw, both with one more feature a bucket."""
    size, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weigh(rows: DataFrame, gains: np.ndarray, most: int) -> DataFrame:
    """(row, n_features, n_words, weight) of ``rows`` (row, text)."""
    schema = StructType([rows.schema["row"], *(StructField(c, LongType()) for c in ("n_features", "n_words", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in K.chunks(batches, "text"):
            doc, bucket, n_words = feature_buckets(texts, most, len(gains))
            n = np.bincount(doc, minlength=texts.n)
            total = np.bincount(doc, weights=gains[bucket], minlength=texts.n).astype(np.int64)  # integers below 2 ** 53
            weight = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(n_words, pa.int64()), pa.array(weight)], names=schema.names)

    return rows.mapInArrow(run, schema)


def gumbel(id_col: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel draw keyed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def last_score(scored: DataFrame, share: tuple[int, int]) -> tuple[int, int] | None:
    """(lowest score drawn, number drawn), None if none is drawn; the window runs over one row per score."""
    counts = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    quota = F.expr(f"(sum(n) OVER () * {share[0]}L) div {share[1]}L")
    rows = counts.select("score", "n", up_to.alias("up_to"), quota.alias("quota")).where("up_to >= quota and up_to - n < quota").collect()
    return (rows[0].score, int(rows[0].quota)) if rows else None


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", carry: list[str] | None = None,
                      most: int = 1, buckets: int = 10_000, share: tuple[int, int] = (10, 100), min_words: int = 20, seed: int = 2024) -> DataFrame:
    """``carry`` columns (default: all) with n_features, weight, score and rank (1 is the highest score) of every text; rank is null for texts not drawn."""
    results = ["n_features", "weight", "score", "rank"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in results]
    gains = bucket_gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_text_col, most, buckets))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("held")).alias("row"), F.col(text_col).alias("text"))
    scored = weigh(rows, gains, most).withColumn("score", F.col("weight") + gumbel(F.col("row.id"), seed))
    scored = materialize(scored, "scored")
    long_enough = F.col("n_words") >= min_words
    found = last_score(scored.where(long_enough), share)
    if found is None:
        out = scored.withColumn("rank", F.lit(None).cast("long"))
    else:
        low, quota = found
        near = long_enough & (F.col("score") >= low)
        ranked = with_global_ordinal(scored.where(near), [F.desc("score"), F.col("row.id").asc_nulls_last()], "rank")
        ranked = ranked.withColumn("rank", F.when(F.col("rank") < quota, F.col("rank") + 1).cast("long"))
        out = ranked.unionByName(scored.where(~near).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*[F.col("row.held").getField(c).alias(c) for c in carry], *results)
