import random
from fractions import Fraction

import pytest

from brindle.llm.neardup import WORD, choose_boundary, duplicate_groups, duplicate_pairs, near_duplicates


def plain(rows, similarity, width, least):
    sets = []
    for part, key, text in set(rows):
        words = WORD.findall((text or "").lower())
        if key is not None and len(words) >= least:
            sets.append((part, key, {tuple(words[n : n + width]) for n in range(len(words) - width + 1)}))
    t = Fraction(similarity)
    return {(min(a, b), max(a, b)) for p, a, x in sets for q, b, y in sets if p == q and a != b and len(x & y) >= t * len(x | y)}


def corpus():
    r = random.Random(9)
    vocabulary = [f"w{n}" for n in range(60)]
    rows = []
    for n in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([30, 33, 60, 140, 400]))]
        for m in range(r.choice([1, 1, 3, 5])):
            copy = list(words)
            for _ in range(r.choice([0, 1, 3, 9])):
                at = r.randrange(len(copy))
                r.choice([lambda: copy.pop(at), lambda: copy.insert(at, "new"), lambda: copy.__setitem__(at, "other")])()
            rows.append((r.choice([1, 1, 2]), f"d{n}_{m}", r.choice([" ", ", ", "\n"]).join(copy)))
    rows += [(1, f"same{n}", " ".join(["Same"] * 40)) for n in range(30)] + rows[:20]
    rows += [(1, "none", None), (1, "empty", ""), (1, "short", "a b c"), (1, None, rows[0][2]), (2, "long", " ".join(vocabulary * 500))]
    return rows


@pytest.mark.parametrize("similarity,width,boundary", [("0.6", 3, None), ("0.6", 3, 0), ("0.6", 3, 70), ("0.8", 5, 1000)])
def test_like_all_pairs(spark, similarity, width, boundary):
    rows = corpus()
    df = spark.createDataFrame([(*x, 1) for x in rows], "part int, id string, text string, key int")
    members, links = near_duplicates(df, "id", "text", "part", similarity, width, 30, boundary=boundary, bits=14)
    found = [(r.id_a, r.id_b) for r in duplicate_pairs(members, links).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, similarity, width, 30)


def test_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "part int, id string, text string")
    out = duplicate_groups(*near_duplicates(df, "id", "text", "part", "0.6", 3, 30, bits=14)).collect()
    up = {r.id: r.id for r in out}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in plain(rows, "0.6", 3, 30):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert {r.id: r.group_id for r in out} == {x: find(x) for x in up}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    members, links = near_duplicates(df, "id", "text", bits=14)
    assert duplicate_pairs(members, links).count() == 0


def test_bitmaps_never_overstate_a_distance():
    import numpy as np

    from brindle.llm.neardup import _bitmaps, _map_distances, _map_width, _packed, _unpacked

    r = np.random.default_rng(1)
    for n, m in ((30, 30), (300, 500), (900, 4000), (3000, 3100)):
        whole = np.unique(r.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = whole[: n], whole[n // 2 : n // 2 + m]
        maps = [_bitmaps(np.zeros(len(x), np.int64), x, 1, _map_width(len(x))).tobytes() for x in (a, b)]
        apart = len(np.setxor1d(a, b))
        found = _map_distances([maps[0]], [maps[1]])[0]
        assert 0.3 * min(apart, _map_width(min(len(a), len(b)))) < found <= apart and (found - apart) % 2 == 0
        assert len(np.intersect1d(_unpacked(_packed(a)), _unpacked(_packed(b)))) == len(np.intersect1d(a, b))


def test_boundary_grows_with_the_lists():
    sizes = [choose_boundary(n, Fraction("0.6")) for n in (1, 100, 1000, 10_000)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]


@pytest.mark.parametrize("similarity,boundary", [("0.6", 0), ("0.6", 70), ("0.6", 1), ("0.4", 70), ("0.3", 2)])
def test_sets_that_need_one_shared_shingle(spark, similarity, boundary):
    rows = [(1, f"one{n}", " ".join(["word"] * n)) for n in (30, 31, 45)]
    rows += [(1, f"two{n}", " ".join(["a", "b"] * n)) for n in (15, 16)] + [(1, f"three{n}", " ".join(["a", "b"] * n + ["c"])) for n in (15, 16)]
    rows += [(1, "four", " ".join(["word"] * 30 + ["c", "d", "e"])), (1, "other", " ".join(f"w{n}" for n in range(40)))]
    df = spark.createDataFrame(rows, "part int, id string, text string")
    found = {(r.id_a, r.id_b) for r in duplicate_pairs(*near_duplicates(df, "id", "text", "part", similarity, 3, 30, boundary=boundary, bits=14)).collect()}
    assert ("one30", "one31") in found and found == plain(rows, similarity, 3, 30)


def test_pairs_come_in_slices():
    import numpy as np

    from brindle.llm.neardup import HELD, _pairs_of

    at = np.arange(4000)
    slices = list(_pairs_of(at, at // 1000, at.astype(np.uint64)))
    assert max(len(h) for *_, h in slices) <= HELD + 1000
    first, second = (np.concatenate([x[k] for x in slices]) for k in (0, 1))
    assert len(first) == 4 * 999 * 500 and len(np.unique(first * 4000 + second)) == len(first)
    assert (first < second).all() and (first // 1000 == second // 1000).all()


def test_light_sets_fit_the_table_of_pairs():
    from brindle.llm.neardup import MOST_PAIRS, bounded_by_pairs

    t = Fraction("0.6")
    assert bounded_by_pairs(300, {28: 10_000, 100: 2_000, 400: 10**9}, t) == 300  # sets above the boundary don't matter
    assert bounded_by_pairs(300, {28: 10_000, 100: 20_000_000}, t) == 99
    assert bounded_by_pairs(300, {1: 5, 28: MOST_PAIRS}, t) == 27


def test_a_text_that_many_tasks_read_is_listed_once(spark, monkeypatch):
    from brindle.llm import neardup

    listed, real = [], neardup._candidate_pairs
    monkeypatch.setattr(neardup, "_candidate_pairs", lambda postings, *rest: (listed.append(postings.count()), real(postings, *rest))[1])
    texts = [" ".join(f"w{n + k}" for n in range(40)) for k in range(0, 40, 4)]
    for copies in (1, 8):
        df = spark.createDataFrame([(f"{n}_{c}", x) for c in range(copies) for n, x in enumerate(texts)], "id string, text string").repartition(copies)
        members, links = neardup.near_duplicates(df, "id", "text", None, "0.6", 3, 30, boundary=0, bits=14)
        assert members.count() == copies * len(texts) and links.count() == 17
    assert listed[0] == listed[1] > 0


def test_several_passes_like_one(spark, monkeypatch):
    from brindle.llm import neardup

    monkeypatch.setattr(neardup, "PASS_WORDS", 1000)
    monkeypatch.setattr(neardup, "PASS_PAIRS", 250)
    r, rows = random.Random(3), corpus()
    base = [f"v{r.randrange(3000)}" for _ in range(500)]
    rows += [(1, f"wide{n}", " ".join([*base[: 500 - n], *(f"x{n}q{k}" for k in range(n))])) for n in (0, 40, 120, 200)]
    df = spark.createDataFrame(rows, "part int, id string, text string")
    members, links = near_duplicates(df, "id", "text", "part", "0.6", 3, 30, boundary=40, bits=14)
    found = [(r.id_a, r.id_b) for r in duplicate_pairs(members, links).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, "0.6", 3, 30) and ("wide0", "wide120") in found
