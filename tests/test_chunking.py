from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from brindle.operators.chunking import count_windows, fixed_size_chunks, running_spans, token_chunks, word_chunks


def windows(n, size, overlap):
    out, start = [], 0
    while n > 0:
        out.append((start, min(start + size, n)))
        if start + size >= n:
            break
        start += size - overlap
    return out


def test_like_a_loop(spark):
    texts = ["", None, "a", "0123456789", "A" * 150, "Hello 世界 🌍 " * 20, "x" * 999, "x" * 1000, "x" * 1001, "word " * 700]
    for size, overlap in ((10, 0), (50, 10), (100, 99), (1000, 100)):
        rows = [(n, t, "clash") for n, t in enumerate(texts)]
        df = spark.createDataFrame([*rows, rows[3], (None, "ab", "x")], "doc_id long, text string, chunk_id string")
        got = {}
        for r in fixed_size_chunks(df.distinct(), "doc_id", "text", size, overlap).collect():
            got.setdefault(r.id, []).append((r.chunk_index, r.span_start, r.span_end, r.text, r.char_count))
        for n, t in enumerate(texts):
            want = [(k, a, b, t[a:b], b - a) for k, (a, b) in enumerate(windows(len(t or ""), size, overlap))]
            assert sorted(got.get(n, [])) == want
        estimates = {r.doc_id: r.n for r in df.distinct().select("doc_id", count_windows(F.length("text"), size, overlap).alias("n")).collect()}
        assert all(estimates[n] == len(windows(len(t or ""), size, overlap)) for n, t in enumerate(texts))


def test_words(spark):
    df = spark.createDataFrame([(1, " ".join(f"Word{n}" for n in range(50))), (2, "word " * 10), (3, "    "), (4, None)], "doc_id long, text string")
    rows = word_chunks(df, "doc_id", "text", 20, 5).collect()
    first = sorted((r for r in rows if r.id == 1), key=lambda r: r.chunk_index)
    assert [r.token_count for r in first] == [20, 20, 20] and first[1].text.startswith("Word15 ")
    assert [r.token_count for r in rows if r.id == 2] == [10] and {r.id for r in rows} == {1, 2}


def test_tokens_of_a_public_vocabulary(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    texts = ["", None, "one two three", "Hello 世界 🌍 " * 60, "word " * 400, "<|endoftext|> x"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in token_chunks(df, "doc_id", "text", path, 40, 8).collect():
        got.setdefault(r.id, []).append((r.chunk_index, r.text, r.token_count, r.span_start, r.span_end))
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert set(got) == {2, 3, 4, 5}
    for n, rows in got.items():
        spans = t.encode(texts[n], add_special_tokens=False).offsets
        want = windows(len(spans), 40, 8)
        rows.sort()
        assert [r[2] for r in rows] == [b - a for a, b in want] and rows[0][3] == 0 and rows[-1][4] == len(texts[n])
        assert all(texts[n][r[3] : r[4]] == r[1] for r in rows) and all(y[3] <= x[4] for x, y in zip(rows, rows[1:]))


def test_spans(spark):
    df = spark.createDataFrame([("a", 0, "xy"), ("a", 1, None), ("a", 2, "z"), ("b", 0, "q")], "source string, ordinal int, text string")
    got = {(r.source, r.ordinal): (r.span_from, r.span_to) for r in running_spans(df, "source", ["ordinal"], "text").collect()}
    assert got == {("a", 0): (0, 2), ("a", 1): (3, 3), ("a", 2): (4, 5), ("b", 0): (0, 1)}


def test_refuses_too_much_overlap(spark):
    with pytest.raises(ValueError):
        fixed_size_chunks(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "doc_id", "text", 10, 10)


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = fixed_size_chunks(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 400), st.data())
def test_windows_cover_and_overlap(n, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    w = windows(n, size, overlap)
    assert all(b - a <= size for a, b in w) and (not n or (w[0][0] == 0 and w[-1][1] == n))
    assert all(x[1] - y[0] == overlap for x, y in zip(w, w[1:]))
