import numpy as np

from lineax.operators import aggs
from lineax.operators.sequences import base_table, edit_dictionary, edit_digests


def test_grouped_exact_quantile_matches_numpy_with_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 5, 3000)] + [("b", float(v)) for v in rng.normal(size=37)] + \
        [("one", 2.5)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.q for r in aggs.exact_quantile(df, "x", [0.05, 0.5, 0.95], ["g"]).collect()}
    for g in ("hot", "b", "one"):
        xs = np.array([x for k, x in rows if k == g])
        assert np.allclose(got[g], np.percentile(xs, [5, 50, 95]), rtol=0, atol=1e-12)
    single = aggs.exact_quantile(df, "x", 0.999).first().q
    assert abs(single - np.percentile([x for _, x in rows], 99.9)) < 1e-12


def test_filter_groups_literal_and_join_paths_agree(spark):
    df = spark.createDataFrame([(f"c{i % 7}", i) for i in range(200)] + [(None, 1)], "country string, v int")
    lit = sorted(r.v for r in aggs.filter_groups_by_size(df, "country", 29).collect())
    joined = sorted(r.v for r in aggs.filter_groups_by_size(df, "country", 29, max_literal=1).collect())
    assert lit == joined and len(lit) == 29 * 4 and None not in lit


def test_sequence_dictionary_sorted_ids_and_gap_filter(spark):
    bases = base_table(spark.createDataFrame([("a", "MKV"), ("b", "AAA"), ("c", "MKV"), ("d", "X" * 6 + "A"), ("e", "B-C")], "base string, seq string"))
    rows = spark.createDataFrame([(x, None, None) for x in "abcdea"], "base string, position int, mutant string")
    d = {r.seq: (r.seq_id, r.count_x, r.count_hyphen) for r in edit_dictionary(edit_digests(rows, bases), bases).collect()}
    assert d == {"AAA": (0, 0, 0), "B-C": (1, 0, 1), "MKV": (2, 0, 0)}


def test_average_ranks_match_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(5)
    vals = np.concatenate([np.zeros(700), rng.normal(size=300).round(2)])
    grp = np.where(np.arange(1000) % 3 == 0, "a", "b")
    pdf = pd.DataFrame({"g": grp, "x": vals})
    df = spark.createDataFrame([(g, float(x)) for g, x in zip(grp, vals)], "g string, x double")
    got = {(r.g, r.x): r.rank for r in aggs.average_ranks(df, "x", ["g"]).collect()}
    pdf["r"] = pdf.groupby("g")["x"].rank(method="average")
    for g, x, r in pdf.drop_duplicates(["g", "x"]).itertuples(index=False):
        assert abs(got[(g, x)] - r) < 1e-9
    ys = rng.normal(size=1000)
    pdf["y"] = ys
    sp = aggs.spearman(spark.createDataFrame([(float(x), float(y)) for x, y in zip(vals, ys)], "x double, y double"), "x", "y")
    assert abs(sp.first().spearman - pdf[["x", "y"]].corr(method="spearman").iloc[0, 1]) < 1e-12


def test_keys_filter_literal_and_join_paths_agree(spark):
    from lineax.operators.joins import keys_filter

    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("c", 4), (None, 5)], "m string, v int")
    keys = spark.createDataFrame([("a",), (None,), ("c",)], "m string")
    for null_safe, want in ((True, [1, 2, 4, 5]), (False, [1, 4])):
        for limit in (10, 1):
            got = sorted(r.v for r in keys_filter(df, keys, "m", null_safe=null_safe, max_literal=limit).collect())
            assert got == want, (null_safe, limit, got)


def test_quantile_of_many_rows_sorts_few_values(spark, monkeypatch):
    rng = np.random.default_rng(11)
    xs = np.concatenate([rng.normal(size=30_000), np.full(5_000, 0.25)])
    df = spark.createDataFrame([(float(v),) for v in xs] + [(None,)] * 10, "x double").repartition(6)
    monkeypatch.setattr(aggs, "NARROW_FROM", 1000)
    ps = [0.0, 0.001, 0.4, 0.59, 0.6, 0.999, 1.0]
    narrowed = aggs._narrowed(df.where("x is not null").selectExpr("0 as _all", "x as _x"), ps)
    assert narrowed.count() == len(xs) and narrowed.distinct().count() < 1000
    assert np.allclose(aggs.exact_quantile(df, "x", ps).first().q, np.quantile(xs, ps), rtol=0, atol=1e-12)
    # a sketch that misses the rank, infinities and constants
    monkeypatch.setattr(aggs.F, "percentile_approx", lambda c, at, n, real=aggs.F.percentile_approx: real(c, [0.0] * len(at), n))
    assert aggs._narrowed(df.where("x is not null").selectExpr("0 as _all", "x as _x"), [0.5]) is None
    assert abs(aggs.exact_quantile(df, "x", 0.5).first().q - np.quantile(xs, 0.5)) < 1e-12
    monkeypatch.undo()
    monkeypatch.setattr(aggs, "NARROW_FROM", 10)
    odd = spark.createDataFrame([(v,) for v in [float("inf")] * 20 + [1.0, 2.0, float("nan"), float("-inf")]], "x double")
    assert aggs._narrowed(odd.selectExpr("0 as _all", "x as _x"), [0.5]) is None
    assert abs(aggs.exact_quantile(odd, "x", 1.5 / 23).first().q - 1.5) < 1e-12
    assert aggs.exact_quantile(odd.where("x = 'Infinity'").selectExpr("1.5D as x"), "x", [0.1, 0.9]).first().q == [1.5, 1.5]


def test_scaled_groups_agree_whether_hot_or_not(spark, monkeypatch):
    from lineax.operators import windows

    rng = np.random.default_rng(12)
    rows = [(f"g{i % 9}" if i % 10 else None, float(v) if i % 7 else None) for i, v in enumerate(rng.integers(0, 20, 900))] + [("none", None), ("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")

    def got():
        return sorted((r.g or "", -1.0 if r.x is None else r.x, -1.0 if r.outcome is None else round(r.outcome, 12)) for r in windows.scale_within_group(df, "g", "x", 0.9).collect())

    plain = [[g, None if x is None else x] for g, x in rows]
    want = []
    for g, x in plain:
        xs = np.array([v for k, v in plain if k == g and v is not None])
        spread = np.quantile(xs, 0.9) - xs.min() if g and len(xs) else 0
        want.append((g or "", -1.0 if x is None else x, -1.0 if x is None or not spread else round(float(np.clip((x - xs.min()) / spread, 0, 1)), 12)))
    monkeypatch.setattr(windows, "heavy_keys", lambda *a, **b: [])
    monkeypatch.setattr(windows, "exact_quantile", None)  # light groups are not counted and range-sorted
    assert got() == sorted(want)
    monkeypatch.undo()
    hot = [r.h for r in spark.sql("select xxhash64(g) as h from values 'g1', 'g2', 'one' t(g)").collect()]
    monkeypatch.setattr(windows, "heavy_keys", lambda *a, **b: hot)
    assert got() == sorted(want)


def test_ordinal_by_stretches_is_the_same_order(spark):
    from lineax.operators import windows

    df = spark.range(2000).selectExpr("id", "id % 700 as k", "cast(id as string) as s").repartition(5)
    whole = {r.id: r.row_id for r in windows.shuffle_and_number(df, ["k", "id"]).collect()}
    cut = windows.shuffle_and_number(df, ["k", "id"], written=True, keep=["id"], halvings=2)
    assert cut.columns == ["id", "row_id"] and {r.id: r.row_id for r in cut.collect()} == whole


def test_texts_with_one_head_are_ranked_by_their_rest(spark):
    from lineax.operators import sequences as Q

    long = "é" * Q.HEAD
    texts = {"a": long + "MZ", "b": long, "c": long + "MA", "d": "A", "e": long[:-1], "f": long + "MZ"}
    bases = base_table(spark.createDataFrame(list(texts.items()), "base string, seq string"))
    rows = spark.createDataFrame([(b, None, None) for b in texts] + [("a", Q.HEAD + 2, "B"), ("c", 1, "z"), ("b", 2 * Q.HEAD, "M")], "base string, position int, mutant string")
    built = set(texts.values()) | {long + "MB", "z" + long[1:] + "MA", long + "M"}
    ids = Q.edit_ids(Q.edit_facts(rows, bases), bases)
    assert not {"seq", "head", "rest"} & set(ids.columns)  # no texts in the written dictionary
    got = {r.seq_id: r.seq for r in edit_dictionary(rows, bases).collect()}
    assert got == dict(enumerate(sorted(built, key=lambda t: t.encode())))
