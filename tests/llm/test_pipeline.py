"""Each pipeline stage against a brute-force version of its decision, on its own input."""

from collections import Counter

import sentencepiece
from test_jaccard import brute

import corpus_pipeline as P
from lineax.llm import pieces

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {"in": docs}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() > 0

    def texts(name):
        return [(r.doc_id, r.text) for r in seen[name].collect()]

    assert set(texts("quality")) <= set(texts("in"))
    before, after = dict(texts("quality")), dict(texts("lines"))
    assert before.keys() == after.keys()
    assert all(set(after[d].split("\n")) <= set(before[d].split("\n")) and 2 * len(after[d].split()) >= len(before[d].split()) for d in before)
    assert sorted(d for d, _ in texts("near_copies")) == sorted({c for _, _, c in brute(texts("lines"), 5, 80, 100)})
    near = dict(texts("near_copies"))
    mixed = Counter(texts("mixture"))
    assert max(mixed.values()) <= 2 and {d for d, _ in mixed} <= set(near)
    assert 0.8 <= sum(len(t.split()) * n for (_, t), n in mixed.items()) / (1.5 * sum(len(t.split()) for t in near.values())) <= 1.2
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    got = Counter((r.doc_id, tuple(r.ids)) for r in seen["pieces"].collect())
    assert got == Counter({(d, tuple(sp.encode(t))): n for (d, t), n in mixed.items()})
