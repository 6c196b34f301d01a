from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.splitting import piece_spans, split_oversized


def plain(text, limit=2000, overlap=200, least=1000):
    """Straight from the rule: tries every offset."""
    out, s = [], 0
    while True:
        if len(text) - s <= limit:
            return out + [(s, len(text))] if s < len(text) else out
        blank = " \t\r\n"
        kinds = [
            lambda e: text[:e].endswith("\n\n"),
            lambda e: text[e - 1] == "\n",
            lambda e: (text[e - 1] in blank and e > 1 and text[e - 2] in ".!?") or text[e - 1] in "。！？",
            lambda e: text[e - 1] in blank,
            lambda e: e == s + limit,
        ]
        for kind in kinds:
            ends = [e for e in range(s + least + 1, s + limit + 1) if kind(e)]
            if ends:
                break
        out.append((s, ends[-1]))
        s = ends[-1] - overlap


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\n", "\n\n", ". ", "! ", " ", "\t", "。", "word", "x" * 9, "世🌍", ".", "\r\n"]), max_size=80), st.integers(1, 4))
def test_like_the_rule_taken_literally(parts, times):
    text = "".join(parts) * times
    assert list(piece_spans(text, 40, 5, 20)) == plain(text, 40, 5, 20)


def test_borders_of_the_window():
    for text in ("a" * 999 + ". " + "b" * 3000, "a" * 1000 + "\n" + "b" * 3000, "a" * 1998 + "\n\n" + "b" * 999, "a" * 998 + "\n\n" + "b" * 3000, "a" * 999 + "\n\n" + "b" * 3000):
        assert list(piece_spans(text)) == plain(text)


def test_rows(spark):
    long = "One sentence. " * 400
    df = spark.createDataFrame([("a", long, 1), ("a", long, 2), ("b", None, 1), ("c", "", 1), ("d", "x" * 2000, 1), (None, "y" * 2001, 1)], "chunk_id string, text string, piece_start int")
    out = split_oversized(df, "chunk_id", "text").collect()
    mine = sorted((r.piece_no, r.piece_start, r.piece_end) for r in out if r.id == "a")
    assert [(s, e) for _, s, e in mine] == plain(long)
    assert all(r.piece_text == long[r.piece_start:r.piece_end] for r in out if r.id == "a")
    assert sorted((r.piece_start, r.piece_end) for r in out if r.id is None) == [(0, 2000), (1800, 2001)]
    assert {r.id for r in out} == {"a", None}
    assert split_oversized(df.limit(0), "chunk_id", "text").count() == 0
