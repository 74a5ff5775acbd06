"""Operator 8, n-gram Jaccard join by PartEnum signatures.

Texts become sets of word shingles; equal sets are one class.  Classes whose
sets have Jaccard similarity of at least ``num / den`` are linked, and the
result is each document's class, set size and connected component.

Signatures.  Sizes fall into bands [l, l * den / num], so linked sets lie in
one band or in neighbouring ones; a set signs for its own band and the next.
In a band whose largest size is r, linked sets differ in at most
k = 2r (den - num) / (den + num) features.  The feature domain is hashed into
n1 partitions of three parts each.  At least n1 - k // 2 partitions hold at
most one differing feature, so two of their three parts are equal in both
sets: the hash of two parts' features (with band, partition and the part left
out) is a signature, three per partition, and linked sets share at least
n1 - k // 2 of them.

Empty parts say nothing.  n1 exceeds k // 2 + 1 by ``spare`` partitions, so a
set with at most ``spare`` partitions that have an empty signature still
shares a signature of features with every set linked to it: it signs features
only.  The few sets with more sign the empty ones too.  No pair is lost.

Candidates.  Rows (signature, class) are sorted by signature, a share of all
signatures at a time; each shared signature's first class is its pivot.  A hot signature (many near copies)
never emits its pairs: first each class is paired with its commonest pivot,
then, across the components so far, with a random class of each of its
signatures, so that a class near a large group meets many of its members and
joins it; signatures whose classes are all in one component drop
out, and only what is left is paired in full, across components.  Each round drops pairs whose
parity sketches differ in more bits than linked sets can have differing
features (a differing feature flips one bit, so the sketches' distance never
exceeds the sets').  Every remaining candidate's Jaccard similarity is computed exactly on the whole
sets of both texts: texts travel, as they take fewer bytes than their features.

Defined results: null, empty or wordless texts have empty sets (n_shingles 0),
link with nothing and are their own component; a text of fewer words than a
shingle has its whole sequence as its one shingle; repeated rows fall into one
class; ties of component go to the smallest id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineax.llm import kernel as K
from lineax.llm.common import connected_components, free_name
from lineax.llm.piece_model import spread
from lineax.session import materialize, materialize_parts

U = np.uint64
PARTS = 3
#: Bytes of texts at a time: a word takes some twenty numbers here.
RUN_BYTES = 1 << 20
#: Bits of a signature: fewer make smaller shuffles; signatures that are equal by chance only add candidates.
SIG_BITS = 48
#: Signatures are sought in so many passes over the texts, each for a share of all signatures: the rows of one pass are
#: shuffled at a time, and their sorts take a share of the memory. Together they are twice the input and more.
PASSES = 4
#: Parity sketches: so many 64-bit words, one bit for each of the buckets that features are hashed into.
SKETCH = [f"p{i}" for i in range(8)]


@lru_cache(maxsize=None)
def bands(num: int, den: int, most: int) -> list[tuple[int, int, int]]:
    """(largest size, partitions, spare) of the bands that cover sizes up to at least ``most``, and one more."""
    out: list[tuple[int, int, int]] = []
    low = 1
    while len(out) < 2 or out[-2][0] < most:
        high = low * den // num
        k = 2 * high * (den - num) // (den + num)
        n1 = k // 2 + 1
        spare = 0 if k == 0 else 1 + n1 // 8
        out.append((high, n1 + spare, spare))
        low = high + 1
    return out


def signatures(doc: np.ndarray, h: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, signature) of sets given as distinct (text number, hash) pairs and their sizes."""
    table = bands(num, den, int(n.max(initial=1)))
    top = np.array([b[0] for b in table])
    own = np.searchsorted(top, n)
    out_d, out_s = [], []
    for step in (0, 1):
        band = np.where(n > 0, own + step, 0)
        n1 = np.array([b[1] for b in table])[band]
        spare = np.array([b[2] for b in table])[band]
        parts = np.where(n > 0, PARTS * n1, 0)
        first = np.cumsum(parts) - parts
        total = int(parts.sum())
        with np.errstate(over="ignore"):
            place = K.mix(h ^ K.mix(band[doc].astype(U), 11), 3)
            slot = first[doc] + (place % parts[doc].astype(U)).astype(np.int64)
            value = K.mix(h, 5)
        # sums of 64-bit values as two exact float sums of 32-bit halves
        lo = np.bincount(slot, weights=(value & U(0xFFFFFFFF)).astype(np.float64), minlength=total).astype(U)
        hi = np.bincount(slot, weights=(value >> U(32)).astype(np.float64), minlength=total).astype(U)
        count = np.bincount(slot, minlength=total)
        part_doc = np.repeat(np.arange(len(n)), parts)
        with np.errstate(over="ignore"):
            # each part's place now stands for the others of its partition
            lo, hi, count = (np.repeat(x.reshape(-1, PARTS).sum(axis=1), PARTS) - x for x in (lo, hi, count))
            where = (np.arange(total) - first[part_doc]).astype(U) + (band[part_doc].astype(U) << U(40))
            sig = K.mix(lo + K.mix(hi, 17) + K.mix(where, 19), 23) >> U(64 - SIG_BITS)
        empty = count == 0
        blank = np.bincount(part_doc[::PARTS], weights=empty.reshape(-1, PARTS).any(axis=1), minlength=len(n))
        keep = ~empty | (blank > spare)[part_doc]
        out_d.append(part_doc[keep])
        out_s.append(sig[keep])
    return np.concatenate(out_d), np.concatenate(out_s)


def _class_ids(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit id of each set: a hash of the sums of two independent hashes of its features."""
    with np.errstate(over="ignore"):
        ends = np.cumsum(n)
        sums = []
        for salt in (29, 31):
            run = np.concatenate([np.zeros(1, U), np.cumsum(K.mix(h, salt), dtype=U)])
            sums.append(run[ends] - run[ends - n])
        return K.mix(sums[0] + K.mix(sums[1], 37) + n.astype(U), 41)


def class_table(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, row, n_shingles, cls) of every row; ``row`` names the row by a hash of its id and text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in K.chunks(batches, "text", RUN_BYTES):
            doc, h = K.shingle_sets(texts, n)
            size = np.bincount(doc, minlength=texts.n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(size, pa.int64()), K.to_long(_class_ids(doc, h, size))], ["id", "row", "n_shingles", "cls"])

    rows = docs.select(F.col(id_col).alias("id"), row_hash(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, row long, n_shingles long, cls long")


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def signature_table(docs: DataFrame, text_col: str, n: int, num: int, den: int, turn: int = 0, passes: int = 1) -> DataFrame:
    """(sig, cls) of every row's set, for the signatures of pass ``turn`` of ``passes``; rows of one batch with equal sets sign once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in K.chunks(batches, text_col, RUN_BYTES):
            doc, h = K.shingle_sets(texts, n)
            size = np.bincount(doc, minlength=texts.n)
            cls = _class_ids(doc, h, size)
            first = np.zeros(texts.n, dtype=bool)
            first[np.unique(cls, return_index=True)[1]] = True
            keep = first[doc]
            d, s = signatures(doc[keep], h[keep], np.where(first, size, 0), num, den)
            mine = s % U(passes) == turn
            d, s = d[mine], s[mine]
            for a in range(0, len(d), 200_000):
                yield pa.RecordBatch.from_arrays([K.to_long(s[a: a + 200_000]), K.to_long(cls[d[a: a + 200_000]])], ["sig", "cls"])

    return docs.select(text_col).mapInArrow(run, "sig long, cls long")


def shared_signatures(sigs: DataFrame) -> DataFrame:
    """(sig, cls) of signatures that at least two classes have.

    One shuffle: rows sorted by signature and class stream through their task
    with one row of memory, so a hot signature needs no more room than another.
    A class has dozens of signatures, which bounds the share of rows that one
    signature can have.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row so far, and whether it went out
        for batch in batches:
            sig, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                sig, cls = np.append(last[0], sig), np.append(last[1], cls)
            fresh = np.ones(len(sig), dtype=bool)
            fresh[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
            sent = np.zeros(len(sig), dtype=bool)
            if last is not None:
                sent[0] = last[2]
            sig, cls, sent = sig[fresh], cls[fresh], sent[fresh]
            if not len(sig):
                continue
            same = sig[1:] == sig[:-1]
            out = np.zeros(len(sig), dtype=bool)
            out[1:] |= same
            out[:-1] |= same
            last = (sig[-1:], cls[-1:], bool(out[-1] or sent[-1]))
            out &= ~sent
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(cls[out])], ["sig", "cls"])

    return sigs.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(run, "sig long, cls long")


def parity_sketches(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """For each set, whether each bucket has an odd number of its features, as 64-bit words."""
    bits = 64 * len(SKETCH)
    bucket = (K.mix(h, 67) & U(bits - 1)).astype(np.int64)
    out = []
    for lo in range(0, docs, 4096):
        a, z = np.searchsorted(doc, [lo, lo + 4096])
        n = min(4096, docs - lo)
        odd = np.bincount((doc[a:z] - lo) * bits + bucket[a:z], minlength=n * bits) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64))
    return np.concatenate(out) if out else np.zeros((0, len(SKETCH)), np.int64)


def set_table(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, n: int) -> DataFrame:
    """(cls, n, text, parity sketch) of the classes whose representative rows are in ``wanted``; a text is a third of its features' bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in K.chunks(batches, "text", RUN_BYTES):
            doc, h = K.shingle_sets(texts, n)
            size = np.bincount(doc, minlength=texts.n)
            with np.errstate(over="ignore"):
                sketch = parity_sketches(doc, h, texts.n)
            words = [pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(SKETCH))]
            yield pa.RecordBatch.from_arrays([K.to_long(_class_ids(doc, h, size)), pa.array(size, pa.int64()), batch.column("text"), *words], ["cls", "n", "text", *SKETCH])

    rows = docs.select(row_hash(id_col, text_col).alias("row"), F.col(text_col).alias("text")).join(wanted.select("row"), "row", "left_semi")
    # repeated rows lie together already
    return rows.dropDuplicates(["row"]).mapInArrow(run, "cls long, n long, text string, " + ", ".join(f"{p} long" for p in SKETCH))


def may_link(x: str, y: str, num: int, den: int) -> Column:
    """Whether the sketches of sides ``x`` and ``y`` (column prefixes) allow a link."""
    distance = sum((F.bit_count(F.col(f"{x}_{p}").bitwiseXOR(F.col(f"{y}_{p}"))) for p in SKETCH), F.lit(0))
    return F.lit(den + num) * distance <= F.lit(den - num) * (F.col(f"{x}_n") + F.col(f"{y}_n"))


def _side(rows: DataFrame, sets: DataFrame, x: str) -> DataFrame:
    """``rows`` (sig, cls, comp) with sizes and sketches, all but sig prefixed with ``x``."""
    known = sets.select(F.col("cls").alias("_c"), F.col("n").alias(f"{x}_n"), *[F.col(p).alias(f"{x}_{p}") for p in SKETCH])
    return rows.select("sig", F.col("cls").alias(f"{x}_cls"), F.col("comp").alias(f"{x}_comp")).join(known, F.col(f"{x}_cls") == F.col("_c")).drop("_c")


def sketched(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that their sketches don't rule out."""
    def side(c: str) -> DataFrame:
        return sets.select(F.col("cls").alias(c), F.col("n").alias(f"{c}_n"), *[F.col(p).alias(f"{c}_{p}") for p in SKETCH])

    return pairs.join(side("a"), "a").join(side("b"), "b").where(may_link("a", "b", num, den)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough: den * intersection >= num * union, exactly."""
    def side(c: str) -> DataFrame:
        return sets.select(F.col("cls").alias(c), F.col("text").alias(f"t_{c}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, _ in K.chunks(batches, "t_a", RUN_BYTES):
            for batch, texts in K.chunks([some], "t_b", RUN_BYTES):
                da, ha = K.shingle_sets(K.flat(batch.column("t_a")), n)
                db, hb = K.shingle_sets(texts, n)
                doc, h = np.concatenate([da, db]), np.concatenate([ha, hb])
                union = np.bincount(K.unique_in_doc(doc, h)[0], minlength=texts.n)
                common = np.bincount(doc, minlength=texts.n) - union
                good = den * common >= num * union
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good))

    return both.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def _labelled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``shared`` with each class's component so far, without the signatures that lie in one component."""
    if labels is None:
        return shared.withColumn("comp", F.col("cls"))
    rows = shared.join(labels, shared.cls == labels.node, "left").select("sig", "cls", F.coalesce("component", "cls").alias("comp"))
    split = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    return rows.join(split, "sig", "left_semi")


def links(shared: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame | None:
    """(node, component) of classes with links, by rounds of pivots and then every pair left between components."""
    found = labels = tried = None

    def add(pairs: DataFrame) -> int:
        nonlocal found, labels, tried
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        good = materialize(verified(pairs, sets, n, num, den), "links")
        tried = pairs if tried is None else tried.union(pairs)
        count = good.count()
        if count:
            found = good if found is None else found.union(good)
            labels = materialize(connected_components(found), "labels")  # few rounds: its links are mostly stars
        return count

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    # one pivot for each class: of its signatures' first classes, the one with most of them
    pivots = shared.groupBy("sig").agg(F.min("cls").alias("pivot"))
    votes = shared.join(pivots, "sig").where("cls <> pivot").groupBy("cls", "pivot").count()
    star = votes.groupBy("cls").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot")).select(*ordered("cls", "pivot")).distinct()
    add(sketched(star, sets, num, den))
    # across components, a random class of each signature: a class meets as many of a group's as it shares signatures with it
    rows = materialize(_labelled(shared, labels), "open")
    pivots = rows.groupBy("sig").agg(F.max(F.struct(F.xxhash64("cls", "sig"), "cls", "comp")).alias("p")).select("sig", "p.cls", "p.comp")
    star = _side(rows, sets, "x").join(_side(pivots, sets, "y"), "sig").where((F.col("x_comp") != F.col("y_comp")) & may_link("x", "y", num, den))
    add(star.select(*ordered("x_cls", "y_cls")).distinct())
    # every pair left that its sketches don't rule out
    wide = materialize(_side(_labelled(shared, labels), sets, "x"), "wide")
    again = wide.withColumnsRenamed({c: f"y{c[1:]}" for c in wide.columns if c != "sig"})
    left = wide.join(again, (wide.sig == again.sig) & (F.col("x_cls") < F.col("y_cls")) & (F.col("x_comp") != F.col("y_comp")) & may_link("x", "y", num, den))
    left = left.select(F.col("x_cls").alias("x"), F.col("y_cls").alias("y"))
    add(left.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id_col, row, n_shingles, component, component_id) of every row.

    component: a number that linked rows share (null for empty sets);
    component_id: the smallest id reachable by links, the row's own included.
    """
    classes = materialize(class_table(docs, id_col, text_col, n), "classes")
    first = classes.where("n_shingles > 0").groupBy("cls").agg(F.min("id").alias("id"), F.min("row").alias("row"))
    shared = materialize_parts([shared_signatures(signature_table(docs, text_col, n, num, den, i, PASSES)) for i in range(PASSES)], "shared")
    wanted = shared.select("cls").distinct().join(first, "cls")
    sets = materialize(set_table(docs, id_col, text_col, wanted, n), "sets")
    labels = links(shared, sets, n, num, den)
    if labels is None:
        named = first.select("cls", F.col("cls").alias("component"), F.col("id").alias("component_id"))
    else:
        rows = first.join(labels, first.cls == labels.node, "left").select("cls", "id", F.coalesce("component", "cls").alias("component"))
        least = rows.groupBy("component").agg(F.min("id").alias("component_id"))
        named = rows.join(least, "component").select("cls", "component", "component_id")
    named = materialize(named, "named").withColumnRenamed("cls", "_c")
    out = classes.join(named, (F.col("cls") == F.col("_c")) & (F.col("n_shingles") > 0), "left")
    return out.select(F.col("id").alias(id_col), "row", "n_shingles", "component", F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id. Texts without words all stay, but for repeated rows."""
    marked = jaccard_components(docs, id_col, text_col, n, num, den)
    name = free_name(docs, "_row")
    best = marked.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "row")).alias("m")).select(F.col("m.row").alias(name))
    empty = marked.where("component is null").select(F.col("row").alias(name)).distinct()
    keep = materialize(best.union(empty), "keep").hint("merge")  # the same plan at every size
    rows = docs.withColumn(name, row_hash(id_col, text_col)).join(keep, name, "left_semi")
    return rows.dropDuplicates([name]).select(*docs.columns)
