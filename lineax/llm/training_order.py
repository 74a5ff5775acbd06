"""Operator 9, token-ID output in training order.

Texts become token ids (each text ends with ``end_id``), packed into sequences
of ``seq_len`` ids.  Sequence i of N gets the global slot F(i): a keyed
Feistel network over the smallest even number of bits that holds N, walked
again while its value is N or more (cycle-walking), hence a bijection of
[0, N) that any reader can compute or invert from (key, N) alone.

Slots are dealt to tasks by ranges of whole shards; each task streams its
shards in slot order into files of fixed stride: sequence of slot s is at byte
(s mod stride) * seq_len * width of shard s div stride.  A shard is written
under an attempt's own name and moved to its final name when whole, so a lost
executor's work is done again without trace.  Shards carry the *edition* in
their names: a digest of key, layout and every sequence of the token table.
A rerun of the same edition (``tokens`` given) skips shards that are there in
full size; another key or text is another edition and never meets old files.
A manifest, written last, names the edition that readers take.

The token table is written once (each sequence compressed), which
freezes the numbering i = rows of earlier partitions + position, whatever is
recomputed later.

Defined results: a null or empty text is just its ``end_id``; repeated rows
are repeated texts; the last sequence of a batch of texts is filled up with
``pad_id``; an empty table gives no shard.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineax.llm import kernel as K
from lineax.llm.piece_model import codec, spread
from lineax.session import materialize

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
U = np.uint64
ROUNDS = 6
MANIFEST = "manifest.json"


def _network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = U((1 << half) - 1)
    left, right = x >> U(half), x & mask
    for k in keys:
        left, right = right, left ^ (K.mix(right + U(k), k & 0xFF) & mask)
    return (left << U(half)) | right


def _inverse_network(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask = U((1 << half) - 1)
    left, right = x >> U(half), x & mask
    for k in reversed(keys):
        left, right = right ^ (K.mix(left + U(k), k & 0xFF) & mask), left
    return (left << U(half)) | right


def permute(i: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Slot of each index in [0, n) (or, inversely, index of each slot)."""
    half = max(1, math.ceil(max(n - 1, 1).bit_length() / 2))
    step = _inverse_network if inverse else _network
    with np.errstate(over="ignore"):
        keys = [int(k) for k in K.mix(np.arange(ROUNDS, dtype=U) + U(key & 0xFFFFFFFFFFFFFFFF), 43)]
        out = i.astype(U)
        todo = np.arange(len(out))
        while len(todo):
            out[todo] = step(out[todo], half, keys)
            todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def token_table(docs: DataFrame, id_col: str, text_col: str, model_path: str, seq_len: int, end_id: int, pad_id: int, dtype: str) -> DataFrame:
    """(doc_ids, n_tokens, blob, at) of every sequence; ``at``: partition and position. Written once."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path, backend="sentencepiece", verify=False)
        packer = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch, texts in K.chunks(batches, text_col):
            ids, off, _ = c.encode(texts)
            ends = off[1:] + np.arange(1, texts.n + 1)  # with the end ids
            total = int(ends[-1])
            n_seq = -(-total // seq_len)
            flat = np.full(n_seq * seq_len, pad_id, dtype=dtype)
            flat[spread(np.concatenate([[0], ends[:-1]]), np.diff(off))] = ids
            flat[ends - 1] = end_id
            flat = flat.reshape(n_seq, seq_len)
            # texts that have ids in a sequence
            lo, hi = np.arange(n_seq) * seq_len, np.minimum(np.arange(1, n_seq + 1) * seq_len, total)
            first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi - 1, side="right")
            of = batch.column(id_col).take(pa.array(spread(first, last - first + 1)))
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(last - first + 1)]), pa.int32()), of)
            yield pa.RecordBatch.from_arrays([held, pa.array(hi - lo, pa.int32()), pa.array([packer.compress(r.tobytes()) for r in flat], pa.binary())], names=["doc_ids", "n_tokens", "blob"])

    rows = docs.select(id_col, text_col).mapInArrow(run, f"doc_ids array<{id_type}>, n_tokens int, blob binary")
    return materialize(rows.withColumn("at", F.monotonically_increasing_id()), "tokens")


def numbered(tokens: DataFrame, key: int) -> tuple[DataFrame, int, str]:
    """Sequences with their global ``slot``, their number, and a digest of them all."""
    rows = tokens.withColumn("pid", F.shiftright("at", 33))
    sizes = rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("at", "blob").cast("decimal(38,0)")).alias("h"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the token table
    offsets = materialize(sizes.select("pid", "n", "h", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off")), "offsets")
    n, digest = offsets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("h").cast("string"), F.lit(""))).first()
    index = rows.join(F.broadcast(offsets.select("pid", "off")), "pid").withColumn("i", F.col("off") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(permute(i, n, key))], names=["doc_ids", "n_tokens", "blob", "slot"])

    kind = tokens.schema["doc_ids"].dataType.simpleString()
    return index.select("doc_ids", "n_tokens", "blob", "i").mapInArrow(run, f"doc_ids {kind}, n_tokens int, blob binary, slot long"), n, digest


def shard_name(shard: int, edition: str) -> str:
    return f"shard-{edition}-{shard:08d}.bin"


def write_shards(rows: DataFrame, n: int, out_dir: str, seq_len: int, stride: int, dtype: str, edition: str) -> DataFrame:
    """Write every shard under ``out_dir``; return one row per sequence: slot, shard, byte offset, n_tokens, doc_ids."""
    width = np.dtype(dtype).itemsize * seq_len
    n_shards = max(1, -(-n // stride))
    tasks = min(n_shards, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out_dir)
        unpacker = zstandard.ZstdDecompressor()
        open_shard, sink, temp = None, None, ""

        def close() -> None:
            if sink is not None:
                sink.close()
                store.move(temp, f"{base}/{shard_name(open_shard, edition)}")

        for b in batches:
            slots = b.column(3).to_numpy()
            for blob, slot in zip(b.column(2), slots.tolist(), strict=True):
                if slot // stride != open_shard:
                    close()
                    open_shard, sink = slot // stride, None
                    info = store.get_file_info(f"{base}/{shard_name(open_shard, edition)}")
                    if info.type == fs.FileType.NotFound or info.size != width * min(stride, n - open_shard * stride):
                        temp = f"{base}/.{shard_name(open_shard, edition)}-{uuid.uuid4().hex}"
                        sink = store.open_output_stream(temp)
                if sink is not None:
                    sink.write(unpacker.decompress(blob.as_buffer()))
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(slots // stride), pa.array(slots % stride * width), b.column(1), b.column(0)], names=["slot", "shard", "byte_offset", "n_tokens", "doc_ids"])
        close()

    kind = rows.schema["doc_ids"].dataType.simpleString()
    spread_out = rows.repartitionById(tasks, (F.expr(f"slot div {stride}") * F.lit(tasks) / F.lit(n_shards)).cast("int")).sortWithinPartitions("slot")
    return spread_out.select("doc_ids", "n_tokens", "blob", "slot").mapInArrow(run, f"slot long, shard long, byte_offset long, n_tokens int, doc_ids {kind}")


def materialise_training_order(docs: DataFrame, out_dir: str, key: int, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL,
                               seq_len: int = 4096, stride: int = 1024, end_id: int = 2, pad_id: int = 0, dtype: str = "uint16", tokens: DataFrame | None = None) -> DataFrame:
    """Tokenise, number, permute and write; returns the index of sequences (written once beside the shards).

    ``tokens``: a table of ``token_table`` that an earlier, broken-off call has written; ``docs`` is then not read.
    """
    from pyarrow import fs

    out_dir = re.sub(r"^file:/+", "file:///", out_dir)
    store, base = fs.FileSystem.from_uri(out_dir)
    store.create_dir(base, recursive=True)
    if tokens is None:
        tokens = token_table(docs, id_col, text_col, model_path, seq_len, end_id, pad_id, dtype)
    rows, n, digest = numbered(tokens, key)
    layout = {"key": key, "n": n, "seq_len": seq_len, "stride": stride, "dtype": dtype, "tokens": digest}
    edition = hashlib.sha256(json.dumps(layout, sort_keys=True).encode()).hexdigest()[:16]
    index = materialize(write_shards(rows, n, out_dir, seq_len, stride, dtype, edition), "index")
    temp = f"{base}/.manifest-{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        f.write(json.dumps(layout | {"edition": edition}, sort_keys=True).encode())
    store.move(temp, f"{base}/{MANIFEST}")
    return index


def read_manifest(out_dir: str) -> dict:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", out_dir))
    with store.open_input_file(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_sequences(out_dir: str, first_slot: int, count: int, **expected) -> Iterator[np.ndarray]:
    """Sequences of consecutive slots from any slot on: one open file and one sequence in memory.

    ``expected``: settings (key, seq_len, stride, dtype ...) that the manifest must have.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", out_dir))
    m = read_manifest(out_dir)
    if wrong := {k: m.get(k) for k, v in expected.items() if m.get(k) != v}:
        raise ValueError(f"the shards were written with {wrong}")
    stride, width = m["stride"], np.dtype(m["dtype"]).itemsize * m["seq_len"]
    slot = first_slot
    while slot < first_slot + count:
        with store.open_input_file(f"{base}/{shard_name(slot // stride, m['edition'])}") as f:
            f.seek(slot % stride * width)
            for _ in range(min(stride - slot % stride, first_slot + count - slot)):
                yield np.frombuffer(f.read(width), dtype=m["dtype"])
                slot += 1
