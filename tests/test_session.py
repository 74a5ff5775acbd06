"""Tables written mid-job."""

import glob
import os
import time

from pyspark.sql import functions as F

from lineax import session


def shuffle_files(spark):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", "/tmp")
    return {f for d in top.split(",") for f in glob.glob(f"{d}/**/blockmgr-*/*/shuffle_*.data", recursive=True)}


def test_materialize_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(1000).select("id", F.xxhash64("id").alias("h")).repartition(5, "h").groupBy("h").agg(F.min("id").alias("id"))
    kept = session.materialize(rows)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and kept.count() == 1000
    assert sorted(rows.collect()) == sorted(kept.collect())  # the plan itself can still run


def test_materialize_restores_the_setting(spark):
    key = session.SHUFFLE_CLEANUP
    before = spark.conf.get(key, None)
    session.materialize(spark.range(3))
    assert spark.conf.get(key, None) == before
    spark.conf.set(key, "false")
    try:
        session.materialize(spark.range(3))
        assert spark.conf.get(key) == "false"
    finally:
        spark.conf.unset(key)


def test_read_alone_removes_the_tables_of_the_way(spark, monkeypatch):
    made = []
    monkeypatch.setattr(session, "scratch_path", lambda s, name, real=session.scratch_path: made.append(real(s, name)) or made[-1])

    def build():
        step = session.materialize(spark.range(10), "step")
        inner = session.written_alone(lambda: session.materialize(step, "deep").where("id > 2"), "inner")
        return session.materialize(inner.union(step), "last")

    out = session.read_alone(build)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made if os.path.exists(p.removeprefix("file:"))]
    assert left == ["last"] and out.count() == 17
    both = session.read_alone(lambda: session.materialize_parts([session.materialize(spark.range(i)) for i in (2, 3)], "part"))
    assert sorted(r.id for r in both.collect()) == [0, 0, 1, 1, 2]
    assert sum(os.path.exists(p.removeprefix("file:")) for p in made) == 3
