import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm.abuse import CATEGORIES, Ordinal, Reader, Rows, count_features, features, fit_from_tables, plain_text, rates_by_source, read_documents, score_documents

NOUNS = "cache shard ledger parser index window mirror policy gauge token".split()
BAD = {
    "abusive": ["Nobody likes you, {0} fool.", "You are a {0} nitwit and we all know it.", "I will make you suffer, you {0} fool."],
    "hateful": ["All Zorbans are {0} rats and must leave.", "Never trust a Zorban, they are {0} rats.", "Throw the {0} Zorbans out of this town."],
    "sexual": ["Watch {0} nudes tonight, adults only.", "I want to touch you all {0} night, nudes here.", "Send me {0} nudes of your body."],
}
SLOT = ["nasty", "n*sty", "n a s t y", "naaasty", "n4sty"]
FINE = ["A fool proof {0} is kept beside the {1}.", "The report counts rats seen near the {0}.", "The nudes folder is the old name of the {0}.", "Our Zorban readers asked for a {0}."]


def corpus(n, seed):
    r = random.Random(seed)
    docs, truth = [], {}
    for k in range(n):
        lines = [f"The {r.choice(NOUNS)} must read the {r.choice(NOUNS)} before the {r.choice(NOUNS)} can move {r.randrange(900)} rows." for _ in range(r.randrange(2, 6))]
        if r.random() < 0.3:
            lines.append(r.choice(FINE).format(r.choice(NOUNS), r.choice(NOUNS)))
        category = r.choice([*CATEGORIES, "none", "none", "none"])
        if category != "none":
            lines.append(r.choice(BAD[category]).format(r.choice(SLOT)))
        r.shuffle(lines)
        docs.append((k, " ".join(lines), r.choice(["Web-Crawl", "wiki", None])))
        truth[k] = category
    return docs, truth


@pytest.fixture(scope="module")
def fitted(spark):
    docs, truth = corpus(700, 1)
    r = random.Random(2)
    labels = [(k, truth[k] if r.random() < 0.95 else r.choice([*CATEGORIES, "none"])) for k in range(400)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string")
    terms = spark.createDataFrame([("fool", "abusive"), ("rats", "hateful"), ("nudes", "sexual"), (None, "sexual")], "term string, category string")
    _, models, reader = fit_from_tables(documents, spark.createDataFrame([*labels, *labels[:20], (None, "none")], "doc_id long, category string"), terms)
    return lambda df: score_documents(read_documents(df, reader), models)


def test_held_out_documents(spark, fitted):
    docs, truth = corpus(500, 3)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("category", F.lit("clash"))
    found = {(r.doc_id, r.category) for r in fitted(df).collect() if r.p_content >= 0.5}
    real = {(k, c) for k, c in truth.items() if c != "none"}
    right = len(found & real)
    assert right / len(found) > 0.9 and right / len(real) > 0.9


def test_scores_of_odd_rows(spark, fitted):
    long = "The cache must read the shard. " * 5000 + "Send me nasty nudes of your body."
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "The cache.", "A "), (3, long, "b"), (3, long, "b")], "doc_id long, text string, source string")
    out = fitted(df)
    rows = out.collect()
    assert len(rows) == 15 and all(0 <= r.severity <= 2 and r.p_content <= r.p_listed for r in rows)
    assert all(r.severity == 0 for r in rows if r.doc_id in (1, 2))
    assert {r.category for r in rows if r.doc_id == 3 and r.p_content > 0.5} == {"sexual"}
    rates = {(r.source, r.category): (r.n_docs, r.n_found, r.rate) for r in rates_by_source(df, out).collect()}
    assert rates[("b", "sexual")] == (1, 1, 1.0) and rates[("a", "sexual")][:2] == (2, 0)
    assert fitted(df.limit(0)).count() == 0


def test_disguises():
    reader = Reader({"idiot", "sex"}, {"the", "cache"})
    for word in ("idiot", "1d1ot", "i d i o t", "i.d.i.o.t", "idiooot", "id*ot", "іdіоt", "i***t", "idot"):
        assert reader.sentences(f"the {word} !") == [["the", "idiot"]], word
    assert reader.words(plain_text("the chunk_size")) == ["the", "chunk_size"]


def test_ordinal_orders_grades():
    rows, grade = [[1], [2], [3], [1, 2]] * 30, np.array([0, 1, 2, 1] * 30)
    p = Ordinal().fit(Rows.of(rows), grade, np.ones(len(rows)), rounds=500).at_least(Rows.of([[1], [2], [3]]))
    assert (np.diff(p, axis=0) > 0).all() and p[0, 1] < 0.1 and p[1, 1] < 0.5 < p[1, 0] and p[2, 1] > 0.9


def test_nothing_labelled(spark):
    empty = spark.createDataFrame([], "doc_id long, category string")
    docs = spark.createDataFrame([(1, "Some text.", "a")], "doc_id long, text string, source string")
    numbered, models, _ = fit_from_tables(docs, empty, spark.createDataFrame([], "term string, category string"))
    assert all(r.p_content < 0.01 for r in score_documents(numbered, models).collect())


def test_the_corpus_is_all_documents(spark):
    # "grendle" is in 4 of 6 labelled documents and in a third of all others, "snorvel" in the labelled ones only
    docs = [(k, "You snorvel and grendle.", "a") for k in range(4)] + [(k, "The cache is read.", "a") for k in (4, 5)]
    docs += [(k, "A grendle keeps rows." if k % 3 == 0 else f"The shard {k} is read.", "a") for k in range(6, 1206)]
    documents = spark.createDataFrame([*docs, (None, None, "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, "abusive" if k < 4 else "none") for k in range(6)], "doc_id long, category string")
    terms = spark.createDataFrame([], "term string, category string")
    numbered, models, reader = fit_from_tables(documents, labels, terms, unlabelled=3)
    # whatever the sample, these and no others are in 5 documents and more
    assert reader.common == {"the", "is", "read", "a", "grendle", "keeps", "rows", "shard"} and reader.lexicon == {"you", "snorvel", "and"}
    n, total = count_features(numbered.repartition(5))
    words, lengths, _ = reader.read(["grendle"])
    assert total == 1206 and n.max() == 802 and sorted(n[features(words, lengths)[1]]) == [0, 404]
    assert fit_from_tables(documents, labels, terms, unlabelled=300)[2].common == reader.common


def test_samples_stay_small_at_the_driver(spark):
    from brindle.llm.sampling import least_draws

    rows = spark.range(40_000, numPartitions=40).select(F.col("id").alias("doc_id"), F.lit("x" * 200).alias("text"))
    kept = least_draws(rows, "doc_id", 40_000, 1000).collect()
    assert len({r.doc_id for r in kept}) == 1000 and len(least_draws(rows.limit(5), "doc_id", 5, 1000).collect()) == 5
    # what is sorted and sent is a tenth more than the sample at most, not a sample of each partition
    plan = least_draws(rows, "doc_id", 40_000, 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and rows.filter(F.expr("shiftrightunsigned(xxhash64(3, doc_id), 11) < 1.1 * 1000 / 40000 * 9007199254740992")).count() < 1200


def test_terms_are_never_dropped(spark, monkeypatch):
    monkeypatch.setattr("brindle.llm.abuse.MOST_TERMS", 2)
    docs = spark.createDataFrame([(1, "Some text.", "a")], "doc_id long, text string, source string")
    terms = spark.createDataFrame([(f"term{n}", "abusive") for n in range(3)], "term string, category string")
    with pytest.raises(ValueError):
        fit_from_tables(docs, spark.createDataFrame([], "doc_id long, category string"), terms)
