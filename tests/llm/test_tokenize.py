import base64

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.tokenize import PATTERN, Encoder, Vocabulary, encode_corpus

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = Encoder(Vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab \n'tsé世好", max_size=60)))
def test_like_the_public_encoder(text):
    assert list(ENCODER.encode([text]))[0] == PUBLIC.encode_ordinary(text)


def test_long_runs():
    for text in ("a" * 4000, "aab" * 900, "好的" * 2000, "\n" * 3000, "abcdefghij" * 300, "<|endoftext|>"):
        ids = list(ENCODER.encode([text]))[0]
        assert ids == PUBLIC.encode_ordinary(text) and PUBLIC.decode(ids) == text


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", [1]), (1, "hello world", [1]), (2, "", None), (3, None, None), (None, "x", None)], "doc_id long, text string, ids array<int>")
    out = encode_corpus(df, "doc_id", "text").collect()
    assert sorted((str(r.id), r.ids) for r in out) == [("1", PUBLIC.encode("hello world"))] * 2 + [("2", []), ("3", []), ("None", PUBLIC.encode("x"))]
    assert sorted(r.n_tokens for r in encode_corpus(df, "doc_id", "text", count_only=True).collect()) == [0, 0, 1, 2, 2]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
