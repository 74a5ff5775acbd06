import itertools
import random
import re

import numpy as np
import pytest

from lineax.llm import jaccard as J
from lineax.llm import kernel as K
from lineax.session import materialize_parts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < n else frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1))


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * min(len(a), len(b)) >= num * max(len(a), len(b)):
            common = len(a & b)
            if den * common >= num * (len(a) + len(b) - common):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return sorted((d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = r.choices(vocab, k=60)
    rows = []
    for _ in range(n):
        kind = r.random()
        if rows and kind < 0.45:
            words = r.choice(rows[:25]).split()
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                words[r.randrange(len(words))] = r.choice(vocab)
            rows.append(" ".join(words))
        else:
            words = r.choices(vocab, k=r.choice([1, 3, 4, 5, 9, 20, 60, 200, 700]))
            rows.append(" ".join(words + passage if kind > 0.9 else words))
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "num", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_matches_brute_force(spark, n, num, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, " \n\t"), (903, "One Two"), (904, "one two"), (905, "one  two\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("doc_id", "text", "doc_id as cls", "text as sig", "0 as n_shingles").repartition(5)
    got = J.jaccard_components(docs, n=n, num=num).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, n, num, 100)


def test_all_pairs_share_a_signature():
    r = np.random.default_rng(3)
    for size in [*range(1, 40), 77, 150, 333, 1000]:
        for _ in range(10):
            base = np.unique(r.integers(0, 1 << 62, size)).astype(np.uint64)
            other = r.permutation(base)[: len(base) - r.integers(0, len(base) // 6 + 1)]
            other = np.unique(np.concatenate([other, r.integers(0, 1 << 62, r.integers(0, len(base) // 6 + 1)).astype(np.uint64)]))
            common = len(np.intersect1d(base, other))
            if 100 * common < 85 * (len(base) + len(other) - common):
                continue
            doc = np.repeat([0, 1], [len(base), len(other)])
            d, s = J.signatures(doc, np.concatenate([base, other]), np.array([len(base), len(other)]), 85, 100)
            assert set(s[d == 0]) & set(s[d == 1])


def test_one_hot_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(4):
            words[r.randrange(300)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.jaccard_components(docs, n=4, num=85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85, 100)


def test_keep_one(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words are here now ok"), (3, "other words are here now ok"), (4, None), (5, ""), (None, "quite another text of its own kind")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as component")
    got = sorted(((r.doc_id, r.text, r.component) for r in J.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, rows[0][1], "x"), (3, rows[2][1], "x"), (4, None, "x"), (5, "", "x"), (None, rows[6][1], "x")], key=str)


def test_sets_are_kept_as_texts_of_distinct_rows(spark):
    rows = [(1, "A b c d e f"), (1, "A b c d e f"), (2, "not wanted at all by anyone"), (3, "g h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = J.class_table(docs, "doc_id", "text", 4).where("id <> 2").collect()
    wanted = spark.createDataFrame(sorted({(r.cls, r.id, r.row) for r in classes}), "cls long, id long, row long")
    sets = J.set_table(docs, "doc_id", "text", wanted, 4)
    assert sorted((r.n, r.text) for r in sets.collect()) == [(1, "g h"), (3, "A b c d e f")]
    plan = sets._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "hashpartitioning(cls" not in plan  # no shuffle of whole sets by class


def test_verified_counts_shingles_of_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "RUN_BYTES", 40)
    words = [f"w{i}" for i in range(12)]
    texts = {1: " ".join(words), 2: " ".join(words).upper(), 3: " ".join([*words, "more"]), 4: " ".join([*words, "two", "more"]), 5: "other"}
    sets = spark.createDataFrame(list(texts.items()), "cls long, text string")
    pairs = spark.createDataFrame([(a, b) for a in texts for b in texts if a < b], "a long, b long")
    want = sorted((a, b) for a in texts for b in texts if a < b and 100 * len(shingles(texts[a], 4) & shingles(texts[b], 4)) >= 90 * len(shingles(texts[a], 4) | shingles(texts[b], 4)))
    assert want == [(1, 2), (1, 3), (2, 3)]
    assert sorted(map(tuple, J.verified(pairs, sets, 4, 90, 100).collect())) == want


def test_signatures_are_short():
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 500)).astype(np.uint64)
    _, s = J.signatures(np.zeros(len(h), np.int64), h, np.array([len(h)]), 80, 100)
    assert len(np.unique(s)) == len(s) and int(s.max()) < 1 << J.SIG_BITS


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(docs).collect() == [] and J.keep_one(docs).collect() == []


def test_word_kernel_matches_regex():
    import pyarrow as pa

    texts = ["", "a", " a  b\tc\n", None, "é\xa0ü x", "end", "start " * 50, "  z\x0b y"]
    t = K.flat(pa.array(texts))
    doc, s, e, _ = t.words()
    got = [[t.text(a, b) for a, b in zip(s[doc == i], e[doc == i], strict=True)] for i in range(t.n)]
    assert got == [WORD.findall(x or "") for x in texts]


def test_passes_share_out_the_signatures(spark):
    """Each pass has about its share of the rows; together they are all rows, and the passes' shared signatures are those of one."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(3, 60))) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in base + [f"{t} more" for t in base]], "text string")
    whole = J.signature_table(docs, "text", 3, 80, 100)
    parts = [J.signature_table(docs, "text", 3, 80, 100, i, J.PASSES) for i in range(J.PASSES)]
    rows = sorted(map(tuple, whole.collect()))
    got = [[tuple(r) for r in p.collect()] for p in parts]
    assert sorted(sum(got, [])) == rows and max(map(len, got)) < 0.5 * len(rows)
    shared = materialize_parts([J.shared_signatures(p) for p in parts], "shared")
    want = sorted(map(tuple, J.shared_signatures(whole).collect()))
    assert want and sorted(map(tuple, shared.collect())) == want
