import math
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import vectors
from brindle.operators.vectors import delete_rows, metadata_filter, nearest, upsert
from brindle.sources.snapshots import SnapshotTable

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, asked, k, metric):
    out = {}
    for qid, q, _ in asked:
        found = []
        for i, v, _ in rows:
            if i is None or v is None or len(v) != len(q) or None in v:
                continue
            dot = sum(a * b for a, b in zip(q, v))
            if metric == "ip":
                d = 1 - dot
            elif metric == "l2":
                d = sum((a - b) ** 2 for a, b in zip(q, v))
            else:
                n = math.sqrt(sum(a * a for a in q) * sum(b * b for b in v))
                d = 1 - dot / n if n else 1.0
            found.append((round(d, 6), i))
        out[qid] = [i for _, i in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_like_all_pairs(spark, metric, monkeypatch):
    r = random.Random(1)
    rows = [(n, [float(r.randrange(-4, 5)) for _ in range(3)], n % 3) for n in range(80)]
    rows += [(100, None, 0), (101, [0.0, 0.0, 0.0], 0), (102, [1.0, 2.0], 0), (None, [1.0, 1.0, 1.0], 0), (103, [1.0, None, 2.0], 0)]
    asked = rows[:5] + [(101, [0.0, 0.0, 0.0], 0)]
    df, q = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(asked, SCHEMA)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    got = {}
    for x in nearest(df, q, 7, metric).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.id)
    assert got == plain(rows, asked, 7, metric)


def test_scores_filters_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, [2.0, 0.0], 3)], SCHEMA)
    q = spark.createDataFrame([(9, [1.0, 0.0], 0)], SCHEMA)
    assert [(r.id, r.distance, r.score) for r in nearest(df, q, 3, "ip").orderBy("rank").collect()] == [(3, -1.0, None), (1, 0.0, 1.0), (2, 1.0, 0.5)]
    assert [r.id for r in nearest(df, q, 3, where={"label": {"$gte": 2}}).orderBy("rank").collect()] == [3, 2]
    assert nearest(df.limit(0), q).count() == 0 and nearest(df, q.limit(0)).count() == 0


def test_filter_dictionaries(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, None, 7)], "id int, c string, n int")
    ids = lambda w: sorted(r.id for r in df.filter(metadata_filter(w)).collect())
    assert ids(None) == [1, 2, 3] and ids({"c": "a"}) == [1] and ids({"n": {"$gt": 4, "$lte": 7}}) == [1, 3]
    assert ids({"c": {"$ne": "a"}}) == [2] and ids({"n": {"$nin": [5]}}) == [3] and ids({"$or": [{"c": "b"}, {"n": 7}]}) == [2, 3]
    assert ids({"$and": [{"c": {"$in": ["a", "b"]}}, {"n": {"$lt": 6}}]}) == [1]
    for bad in ({"c": {"$like": 1}}, {"$or": []}):
        with pytest.raises(ValueError):
            metadata_filter(bad)


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, [1.0], 2)], SCHEMA).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v")).filter(metadata_filter({"label": 2}))
    assert "PushedFilters: []" not in df._jdf.queryExecution().executedPlan().toString()


def test_upsert_is_a_dictionary(spark):
    r = random.Random(2)
    current = {n: n for n in range(30)}
    changes = [(r.randrange(45), 100 + n, n) for n in range(60)]
    out = upsert(spark.createDataFrame(list(current.items()), "k int, v int"), spark.createDataFrame([*changes, (None, 1, 99)], "k int, v int, version int"), "k", "version")
    for k, v, _ in changes:
        current[k] = v
    assert {x.k: x.v for x in out.collect()} == current
    gone = spark.createDataFrame([(1,), (1,), (99,), (None,)], "id int")
    assert sorted(x.k for x in delete_rows(out, gone, "k").collect()) == sorted(set(current) - {1})


def test_snapshot_table(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), "id", "id string, v int")
    assert t.count() == 0
    t.upsert(spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("a", 3, 2)], "id string, v int, version int"), "version")
    before = t.read()
    t.upsert(spark.createDataFrame([("b", 9, 1)], "id string, v int, version int"), "version")
    assert {r.id: r.v for r in t.read().collect()} == {"a": 3, "b": 9} and {r.id: r.v for r in before.collect()} == {"a": 3, "b": 2}
    assert t.delete(spark.createDataFrame([("b",), ("zzz",)], "id string")) == 1 and t.clear() == 1 and t.count() == 0
    assert t.read().filter(F.col("v") > 0).count() == 0
