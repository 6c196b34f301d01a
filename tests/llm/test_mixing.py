import pytest
from pyspark.sql import functions as F

from brindle.llm.mixing import mix_plan, mix_report, mix_sources

TARGETS = "source string, target_share double, max_repeats int"


def test_plan(spark):
    sized = spark.createDataFrame([("a", 100), ("a", 300), ("b", 50)], "source string, n_tokens long")
    targets = spark.createDataFrame([("A", 0.5, 2), ("b", 0.5, 4), ("gone", 0.0, 3)], TARGETS)
    got = {r.source: (r.wanted, r.rate) for r in mix_plan(sized, targets).collect()}
    assert got == {"a": (200.0, 0.5), "b": (200.0, 4.0), "gone": (0.0, 0.0)}
    assert {r.source: r.rate for r in mix_plan(sized, targets, 2000).collect()} == {"a": 2.0, "b": 4.0, "gone": 0.0}


def test_mix_reaches_the_shares_and_caps(spark):
    rows = [(n, f"text number {n} of the first source", "big-source") for n in range(1500)] + [(5000 + n, f"text number {n} of the second", "Small_Source ") for n in range(150)]
    rows += [(9000, "text number 1 of the second", "small_source"), (9001, None, "small_source"), (9002, " ", "small_source"), (9003, "x", None), (9004, "x", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit("clash")).withColumn("copies", F.lit(1))
    targets = spark.createDataFrame([("big_source", 0.7, 1), ("small_source", 0.3, 3)], TARGETS)
    mix = mix_sources(df, targets)
    out = mix.collect()
    assert max(r.copy_no for r in out if r.source == "small_source") == 3 and max(r.copy_no for r in out if r.source == "big_source") == 1
    assert len({(r.doc_id, r.copy_no) for r in out}) == len(out) and {r.copy_no for r in out} == {1, 2, 3}
    assert not {r.doc_id for r in out} & {9000, 9001, 9002, 9003, 9004}
    for r in mix_report(mix, targets).collect():
        assert r.share == pytest.approx(r.target_share, abs=0.03)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix_sources(df.repartition(7), targets).collect()))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    mix = mix_sources(df, targets)
    assert mix.count() == 0
    assert [tuple(r) for r in mix_report(mix, targets).collect()] == [("a", 1.0, 0, 0, 0, 0.0)]
