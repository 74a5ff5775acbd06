"""Operators 11 to 13 against brute-force versions on small tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lineax.llm import bin_groups, byte_bpe, centroids, importance, packing
from lineax.llm import kernel as K
from lineax.llm.id_table import IdTable

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n ", "one", "ÀÉ ß İ", "a-b_c 1.5 " * 12, "日本語の文章です。" * 9, "x" * 3000, "A" * 257 + " é" * 300, "the river of stone " * 40, "Word\x00word\x7fword{word`word"]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def features(text, most):
    w = FEATURE.findall(lower(text))
    return [" ".join(w[i: i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)], len(w)


# ------------------------------------------------------------------ 12
def test_crc_by_length_is_crc32():
    r = random.Random(1)
    parts = [bytes(r.randrange(256) for _ in range(n)) for n in [0, 1, 1, 2, 3, 7, 7, 64, 255, 256, 257, 1000, *(r.randrange(12) for _ in range(500))]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    got = importance.crc_by_length(data, ends - [len(p) for p in parts], ends)
    assert got.tolist() == [zlib.crc32(p) for p in parts]
    assert importance.crc_by_length(data[:0], ends[:0], ends[:0]).tolist() == []


def brute_importance(docs, target, most, buckets, share, min_words, seed):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, most)[0]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    raw, aim = counts([t for _, t in docs]), counts(target)
    total_s, total_t = sum(raw), sum(aim)
    gain = [math.floor(1000 * math.log((t + 1) * (total_s + buckets) / ((s + 1) * (total_t + buckets)))) for s, t in zip(raw, aim, strict=True)]
    rows = []
    for i, text in docs:
        f, n = features(text, most)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // max(len(f), 1)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    order = sorted([r for r in rows if r[4]], key=lambda r: (-r[3], r[0] is None, r[0]))
    return rows, order[: share[0] * len(order) // share[1]]


@pytest.mark.parametrize("most", [1, 3])
def test_importance_sample_is_the_brute_force_one(spark, most):
    r = random.Random(2)
    vocabulary = ["river", "Stone", "of", "the", "é1", "x9", "日本"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(60)))) for i in range(150)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a null id of the river " * 6)]
    target = ["the river of x9 " * 3, None, "日本 river"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"rank": F.lit("x"), "_pid": F.lit(1), "row": F.lit(2), "n_words": F.lit(3)}).repartition(5)
    got = importance.importance_sample(df, spark.createDataFrame([(t,) for t in target], "text string"), most=most, buckets=97, share=(30, 100), min_words=20, seed=5).collect()
    rows, drawn = brute_importance(docs, target, most, 97, (30, 100), 20, 5)
    key = lambda x: (x[0] is None, x[0])
    assert sorted([(x.doc_id, x.n_features, x.weight, x.score) for x in got], key=key) == sorted([x[:4] for x in rows], key=key)
    assert [x.doc_id for x in sorted([x for x in got if x["rank"] is not None], key=lambda x: x["rank"])] == [x[0] for x in drawn]
    assert sorted(x["rank"] for x in got if x["rank"] is not None) == list(range(1, len(drawn) + 1))
    assert {(x._pid, x.row, x.n_words) for x in got} == {(1, 2, 3)}


def test_importance_sample_of_equal_and_of_no_rows(spark):
    one = spark.createDataFrame([(7, "word " * 30)] * 40 + [(8, "other " * 30)] * 2, "doc_id long, text string")
    none = one.limit(0)
    got = importance.importance_sample(one, none.select("text"), share=(50, 100)).collect()
    assert sorted(x["rank"] for x in got if x["rank"]) == list(range(1, 22)) and len({(x.doc_id, x.score) for x in got}) == 2
    assert importance.importance_sample(none, one.select("text")).collect() == []
    assert [x["rank"] for x in importance.importance_sample(one, one, min_words=31).collect()] == [None] * 42


# ------------------------------------------------------------------ 13
def brute_clusters(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in named[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c)) for _, v in kept]
        if r < rounds:
            for j in range(len(c)):
                mine = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((i is None, i, j, d) for (i, _), (d, j) in zip(kept, near, strict=True)), c


def vector_rows(n, dim, seed, spread=1.0):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(5, dim))
    return [(i, [float(x) for x in (middle[i % 5] + spread * r.normal(size=dim)).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize(("dim", "k", "rounds", "scale"), [(4, 6, 6, 3.0), (64, 16, 3, 64.0), (3, 5, 0, 2.0)])
def test_clusters_are_plain_k_means(spark, dim, k, rounds, scale):
    rows = vector_rows(300, dim, dim) + [(900, None), (901, [1.0]), (902, [float("nan")] * dim), (903, [None] * dim), (904, [float("inf")] * dim), (None, [0.5] * dim), (905, [0.5] * dim), (905, [0.5] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).repartition(4)
    out, c = centroids.cluster_vectors(df, k=k, rounds=rounds, dim=dim, scale=scale, seed=3)
    want, centre = brute_clusters(rows, k, rounds, dim, scale, 3)
    assert sorted((r.vec_id is None, r.vec_id, r.cluster, r.distance) for r in out.collect()) == want
    assert c.tolist() == centre
    total = sum(x[3] for x in want)
    for r in centroids.with_cluster_sums(out, c).collect():
        assert r.inertia == total and r.cluster_inertia == sum(x[3] for x in want if x[2] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centre[r.cluster])).encode()).hexdigest()


def test_bounds_spare_evaluations_and_ties_go_to_the_smaller_number():
    r = np.random.default_rng(1)
    x = (64 * (r.normal(size=(12, 8))[r.integers(12, size=4000)] * 4 + 0.2 * r.normal(size=(4000, 8)))).astype(np.int64)
    history = x[:12][None].copy()
    s = centroids.first_state(x, history[0])
    for _ in range(8):
        c = np.array([x[s.cluster == j].sum(axis=0) // max((s.cluster == j).sum(), 1) if (s.cluster == j).any() else history[-1][j] for j in range(12)])
        history = np.concatenate([history, c[None]])
        s = centroids.next_state(s, history)
        exact = np.stack([centroids.squared(x, row) for row in c], axis=1)
        assert np.array_equal(s.cluster, exact.argmin(axis=1))
    assert s.evaluated.mean() < 12 + 8 * 12 / 3
    same = np.array([[[0, 0], [2, 0], [2, 0]], [[0, 0], [2, 0], [2, 0]]])
    s = centroids.next_state(centroids.first_state(np.array([[1, 0], [2, 1], [5, 5]]), same[0]), same)
    assert s.cluster.tolist() == [0, 1, 1]


def test_displacement_is_a_norm_of_the_total_not_a_sum(spark):
    """A centroid that went away and came back leaves its stored bounds tight: nothing is evaluated."""
    x = np.array([[0, 0], [1, 0], [100, 0]])
    there, back = np.array([[0, 0], [100, 0]]), np.array([[30, 0], [70, 0]])
    s = centroids.first_state(x, there)
    before = s.evaluated.copy()
    s = centroids.next_state(s, np.stack([there, back, there]))
    assert s.evaluated.tolist() == before.tolist()


def test_clusters_of_huge_components_and_of_no_rows(spark):
    rows = [(i, [s * 1e30, 1.0]) for i, s in enumerate((1.0, -1.0, 1.0))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, c = centroids.cluster_vectors(df, k=3, rounds=1, dim=2, scale=64.0)
    assert sorted(r.distance for r in out.collect()) == [0, 0, 0] and len(c) == 3
    out, c = centroids.cluster_vectors(df.limit(0), k=2, rounds=2, dim=2)
    assert centroids.with_cluster_sums(out, c).collect() == []


# ------------------------------------------------------------------ 11
MODEL = packing.DEFAULT_MODEL


def test_segments_give_the_ids_of_whole_texts():
    r = random.Random(4)
    signs = "ab1.'s|<>$%é 日😀" + " \n\t\r\x0b\x85 　 ﻿"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(3000)] + [t or "" for t in ODD] + ["it's, we'll. don't!!", "tail \n\n"]
    tokenizer = Tokenizer.from_file(MODEL)
    for group in (texts, [*texts[:50], "x <|endoftext|>y,<|endoftext|>", *texts[50:90]]):
        ids, off = byte_bpe.ByteBpe(MODEL, keep=20_000).encode(K.flat(pa.array(group)))
        for i, t in enumerate(group):
            assert ids[off[i]: off[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_id_table_forgets_and_still_answers():
    table, r = IdTable(most=2_000, step=7), random.Random(1)
    for _ in range(30):
        names = np.unique(np.array([r.randrange(400) for _ in range(r.randrange(1, 60))], dtype=np.uint64))
        ids, n, good = table.lookup(names, lambda part, names=names: ([[int(x)] * (int(x) % 4) for x in names[part]], [int(x) % 3 > 0 for x in names[part]]))
        assert ids.tolist() == [x for x in names.tolist() for _ in range(x % 4)]
        assert n.tolist() == [x % 4 for x in names.tolist()] and good.tolist() == [x % 3 > 0 for x in names.tolist()]
        assert table.nbytes() <= 2_000


def check_bins(bins, lengths, capacity):
    assert sorted(i for g in bins for i in g) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in g) <= capacity for g in bins)


def test_crossover_and_evolution_keep_packings_whole_and_improve_them():
    r = random.Random(6)
    lengths = []
    for _ in range(60):  # triplets that fill a bin exactly
        a, b = r.randrange(26, 49), r.randrange(26, 40)
        lengths += [a, b, 100 - a - b] if 100 - a - b > 0 else [a, b]
    problem = bin_groups.Packing(lengths, 100, random.Random(1))
    one, two = problem.seeded(0.0), problem.seeded(0.3)
    check_bins(one, lengths, 100)
    full = {tuple(sorted(g)) for g in two if problem.free(g) <= 2}
    child = problem.cross(one, two, 0.98)
    check_bins(child, lengths, 100)
    assert {tuple(sorted(g)) for g in child} & full - {tuple(sorted(g)) for g in one}
    best = problem.evolve([], 8, 400)
    check_bins(best[0], lengths, 100)
    assert len(best[0]) < len(one)
    assert bin_groups.groups(bin_groups.labels(one, len(lengths))) and len(bin_groups.groups(bin_groups.labels(one, len(lengths)))) == len(one)
    assert [problem.score(b) for b in best] == sorted(problem.score(b) for b in best)


def test_packing_is_whole_and_gapless(spark):
    r = random.Random(8)
    texts = [(i, " ".join(r.choice(["river", "stone", "zqxj", "é"]) for _ in range(r.choice([1, 3, 9, 40])))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id")] * 3
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"key": F.lit(1), "length": F.lit("x"), "was": F.lit(0)}).repartition(3)
    packed = packing.pack_documents(df, capacity=16, with_ids=True, block=64, islands=2, epochs=2, population=4, generations=8)
    rows = packed.collect()
    tokenizer = Tokenizer.from_file(MODEL)
    want = sorted((str(i), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in texts)
    by_doc, left = {}, []
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and len(x.ids) == x.length <= 16
    for i, parts in by_doc.items():
        if i is None:
            left += [(str(i), p.ids) for p in parts]
            continue
        parts.sort(key=lambda p: p.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and all(p.length == 16 for p in parts[1:])
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts[:-1])]).tolist()
        left.append((str(i), [t for p in parts for t in p.ids]))
    assert sorted(left) == want
    seqs = {}
    for x in rows:
        seqs.setdefault(x.sequence_id, []).append(x)
    for s in seqs.values():
        s.sort(key=lambda x: x.offset)
        assert [x.offset for x in s] == np.cumsum([0, *(x.length for x in s[:-1])]).tolist() and sum(x.length for x in s) <= 16
    total = sum(x.length for x in rows)
    assert len(seqs) <= -(-total // 16) * 1.03 + 1
    whole = {x.sequence_id: x.ids for x in packing.sequences(packed).collect()}
    assert whole == {k: [t for x in s for t in x.ids] for k, s in seqs.items()}


def test_packing_of_equal_long_and_of_no_texts(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    same = spark.createDataFrame([(1, "word " * 60)] * 100, "doc_id long, text string")
    rows = packing.pack_documents(same, capacity=100, block=16, islands=2, generations=4).collect()
    assert len(rows) == 100 and len({r.sequence_id for r in rows}) == 100  # no two fit
    rows = packing.pack_documents(spark.createDataFrame([(1, None)] * 300, "doc_id long, text string"), capacity=64, block=32, islands=1, epochs=1).collect()
    assert len(rows) == 300 and len({r.sequence_id for r in rows}) == 5


def test_cut_lengths():
    for n in (1, 9, 10, 11, 20, 25):
        _, piece, start, length = packing.cut_lengths(np.array([n]), 10)
        assert length.sum() == n and (length[1:] == 10).all() and 0 < length[0] <= 10
        assert start.tolist() == (np.cumsum(length) - length).tolist() and piece.tolist() == list(range(len(piece)))
