"""Operator 11, best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become token ids (``byte_bpe``) and an end id.  Those longer than a
sequence are cut: the first piece takes what whole sequences leave over, the
others fill a sequence each and need no packing.  The other pieces are packed.

Islands.  Pieces are dealt by a hash into blocks of about ``block`` pieces, so a
block is a packing problem of bounded size with the lengths of the whole corpus
mixed; equal lengths, however frequent, spread over all blocks.  Every block is
evolved on several islands (``bin_groups``: best-fit seeds, crossover by whole
well-filled bins), a row each, in whatever task Spark puts it; after an epoch
each island's best packing moves on to the block's next island.  The best of a
block's islands is its packing.

Then the emptiest bins of all blocks (one in 64, one at least, none that is
full) are dealt anew, as whole bins, into far fewer blocks, where their old bins
are one of the first chromosomes, so no round uses more bins than the last.
Rounds end with a single block, or when less than half of the pieces would
drop out: a few, as a round leaves a small part of the last one's pieces.  What the
driver holds is a count per round.

Defined results: a null or empty text is its end id alone; repeated rows are
packed each; pieces are named by their place in the written piece table, so
null or equal ids are no matter; the order of documents within a sequence
follows their lengths; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineax.llm import kernel as K
from lineax.llm.bin_groups import Packing, groups, labels
from lineax.llm.byte_bpe import byte_bpe
from lineax.llm.id_table import spread
from lineax.session import materialize

DEFAULT_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Sequence ids: round, block and bin side by side.
BIN_BITS, BLOCK_BITS = 20, 36


def cut_lengths(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, piece, start, length) of the pieces of documents of ``n`` ids each."""
    first = (n - 1) % capacity + 1
    pieces = (n - first) // capacity + 1
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = spread(np.zeros(len(n), dtype=np.int64), pieces)
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, first[doc], capacity)


def piece_table(docs: DataFrame, id_col: str, text_col: str, model_path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32 [, ids], key) of every piece; ``key``: its place in this table, which is written once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(model_path)
        for batch, texts in K.chunks(batches, "text", K.CHUNK_BYTES // 2):
            ids, off = model.encode(texts)
            n = np.diff(off)
            ends = np.cumsum(n + 1)
            flat = np.full(int(ends[-1]), end_id, dtype="<u4")
            flat[spread(ends - n - 1, n)] = ids
            doc, piece, start, length = cut_lengths(n + 1, capacity)
            cuts = np.concatenate([[0], np.cumsum(length)])
            raw = memoryview(flat).cast("B")
            crc = [zlib.crc32(raw[4 * a: 4 * z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            cols = [batch.column("id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    return materialize(made.withColumn("key", F.monotonically_increasing_id()), "pieces")


_STATE = "block long, island int, keys array<long>, lengths array<int>, members array<array<int>>"


def _evolve(state: DataFrame, tasks: int, capacity: int, population: int, generations: int, seed: int) -> DataFrame:
    """``state`` with its members evolved, best first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block, island, lengths, members = (row.column(c)[0].as_py() for c in ("block", "island", "lengths", "members"))
                problem = Packing(lengths, capacity, random.Random(f"{seed}:{block}:{island}"))
                found = problem.evolve([groups(m) for m in members], population, generations)
                out = [labels(bins, len(lengths)) for bins in found]
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("block", "island", "keys", "lengths")), pa.array([out], pa.list_(pa.list_(pa.int32())))], names=batch.schema.names)

    return materialize(state.repartition(tasks, "block", "island").mapInArrow(run, _STATE), "islands")


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """Each island with its neighbour's best packing as a further member."""
    elite = state.select(F.col("block").alias("_b"), ((F.col("island") + 1) % islands).alias("_i"), F.col("members")[0].alias("elite"))
    joined = state.join(elite, (F.col("block") == F.col("_b")) & (F.col("island") == F.col("_i")))
    return joined.select("block", "island", "keys", "lengths", F.concat("members", F.array("elite")).alias("members"))


def pack_items(items: DataFrame, capacity: int, block: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> DataFrame:
    """(key, sequence_id, offset) of ``items`` (key, length), lengths below ``capacity``."""
    pending = items.select("key", F.col("length").cast("int").alias("length"), F.col("key").alias("was"))
    placed, n, step = None, pending.count(), 0
    block = max(block, 4 * capacity)  # some bins at least, however short the pieces are
    while n:
        blocks = -(-n // block)
        dealt = pending.withColumn("block", F.pmod(F.xxhash64("was", F.lit(seed + step)), F.lit(blocks)))
        held = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "key", "was")), asc=False).alias("x"))  # about ``block`` items
        old = F.array(F.transform("x", lambda x: F.array_position(F.array_distinct("x.was"), x["was"]).cast("int"))) if step else F.array().cast("array<array<int>>")
        state = held.select("block", F.explode(F.array([F.lit(i) for i in range(islands)])).alias("island"), F.col("x.key").alias("keys"), F.col("x.length").alias("lengths"), old.alias("members"))
        tasks = max(1, min(blocks * islands, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        for epoch in range(epochs):
            state = _evolve(_migrate(state, islands) if epoch else state, tasks, capacity, population, generations, seed + epoch)
        rows = materialize(_bins(state, capacity, step), "bins")
        again = rows.where("again").count() if blocks > 1 else 0
        again = 0 if 2 * again > n else again  # nothing more to gain
        done = (rows.where("not again") if again else rows).select("key", "sequence_id", "offset")
        placed = done if placed is None else placed.union(done)
        pending = rows.where("again").select("key", "length", F.col("sequence_id").alias("was"))
        n, step = again, step + 1
    return placed if placed is not None else items.select("key", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset")).limit(0)


def _bins(state: DataFrame, capacity: int, step: int) -> DataFrame:
    """(key, length, sequence_id, offset, again) of the best packing of each block; again: in one of its emptiest bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                length = batch.column("lengths")[i].values.to_numpy().astype(np.int64)
                label = batch.column("best")[i].values.to_numpy()
                fill = np.bincount(label, weights=length).astype(np.int64)
                order = np.argsort(label, kind="stable")
                before = np.cumsum(length[order]) - length[order]
                offset = before - (np.cumsum(fill) - fill)[label[order]]
                emptiest = np.argsort(fill, kind="stable")[: max(1, len(fill) // 64)]
                again = np.isin(label[order], emptiest[fill[emptiest] < capacity])
                name = (step << (BIN_BITS + BLOCK_BITS)) + (batch.column("block")[i].as_py() << BIN_BITS) + label[order].astype(np.int64)
                keys = batch.column("keys")[i].values.take(pa.array(order))
                yield pa.RecordBatch.from_arrays([keys, pa.array(length[order], pa.int32()), pa.array(name), pa.array(offset), pa.array(again)], names=["key", "length", "sequence_id", "offset", "again"])

    # the fewest bins; the number of a packing's bins is its largest label and one
    rank = F.struct(F.array_max(F.col("members")[0]).alias("bins"), F.col("island"))
    best = state.groupBy("block").agg(F.min_by(F.struct("keys", "lengths", F.col("members")[0].alias("best")), rank).alias("m"))
    return best.select("block", "m.*").mapInArrow(run, "key long, length int, sequence_id long, offset long, again boolean")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL, capacity: int = 2048, end_id: int = 0, with_ids: bool = False,
                   block: int = 8192, islands: int = 3, epochs: int = 2, population: int = 6, generations: int = 30, seed: int = 11) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32 [, ids], sequence_id, offset) of every piece of every document."""
    pieces = piece_table(docs, id_col, text_col, model_path, capacity, end_id, with_ids)
    placed = pack_items(pieces.where(F.col("length") < capacity).select("key", "length"), capacity, block, islands, epochs, population, generations, seed)
    placed = placed.withColumnRenamed("key", "_key")
    out = pieces.join(placed, F.col("key") == F.col("_key"), "left")
    whole = -F.col("key") - 1  # a sequence of its own
    return out.select(F.col("id").alias(id_col), *[c for c in pieces.columns if c not in ("id", "key")], F.coalesce("sequence_id", whole).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of every sequence of a packing with ids; a sequence is never longer than the capacity."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return held.select("sequence_id", F.flatten("x.ids").alias("ids"))
