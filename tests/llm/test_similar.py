import numpy as np
import pytest

from brindle.llm import similar
from brindle.llm.similar import most_similar

SCHEMA = "id string, embedding array<float>, score double"


def plain(rows, k, least):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    ids = sorted(ok)
    u = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    s = np.round(u @ u.T, 6)
    out = {}
    for a, i in enumerate(ids):
        found = sorted((-s[a, b], j) for b, j in enumerate(ids) if b != a and s[a, b] >= least)[:k]
        out[i] = [(j, -x) for x, j in found]
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 8))
    out = [(f"v{n:04}", [float(x) for x in (centres[n % 40] + 0.25 * r.normal(size=8)) * r.uniform(0.1, 9)], 1.0) for n in range(900)]
    out += [(f"copy{n}", out[5][1], 1.0) for n in range(300)]
    out += [("null", None, 1.0), ("short", [1.0], 1.0), ("zero", [0.0] * 8, 1.0), ("nan", [float("nan")] + [1.0] * 7, 1.0), ("inf", [float("inf")] + [1.0] * 7, 1.0), ("hole", [None] + [1.0] * 7, 1.0), (None, [1.0] * 8, 1.0)]
    return out + out[:30]


def test_recall_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 100)
    got = {}
    for r in most_similar(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", "embedding", dim=8, least_score=0.85).collect():
        got.setdefault(r.id, {})[r.rank_no] = (r.other_id, r.score)
    want = plain(rows, 5, 0.85)
    pairs = {(i, j) for i, near in want.items() for j, _ in near}
    found = {(i, j) for i, near in got.items() for j, _ in near.values()}
    assert len(found & pairs) / len(pairs) > 0.97 and len(found - pairs) / len(found) < 0.03
    assert all(len(near) <= 5 and list(sorted(near)) == list(range(1, len(near) + 1)) for near in got.values())
    # copies: the smallest other ids at score 1
    assert [got["copy299"][k] for k in range(1, 6)] == [("copy0", 1.0), ("copy1", 1.0), ("copy10", 1.0), ("copy100", 1.0), ("copy101", 1.0)]
    assert got["copy0"][1] == ("copy1", 1.0)


def test_all_cells_asked_is_exact(spark, rows):
    few = rows[:200]
    out = most_similar(spark.createDataFrame(few, SCHEMA), "id", "embedding", dim=8, k=3, cells=4, margin=4.0, most_probes=4, depth=200)
    got = {}
    for r in out.orderBy("id", "rank_no").collect():
        got.setdefault(r.id, []).append((r.other_id, r.score))
    assert got == {i: n for i, n in plain(few, 3, -1.0).items()}


def test_empty_and_single(spark, rows):
    df = spark.createDataFrame(rows[:1], SCHEMA)
    assert most_similar(df, "id", "embedding", dim=8).count() == 0
    assert most_similar(df.limit(0), "id", "embedding", dim=8).count() == 0
    with pytest.raises(ValueError):
        most_similar(df, "id", "embedding", dim=8, k=0)
