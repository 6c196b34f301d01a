import pytest

from brindle.plans import catalog
from oracle import DATA, connection, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, catalog.QUERIES[name], catalog.SQL[name])


def test_every_question_is_answered_from_its_own_user(spark, con):
    rows = catalog.flagship(spark, str(DATA)).collect()
    users = dict(con.execute("SELECT request_id, any_value(user_id) FROM chat_requests WHERE request_id IS NOT NULL GROUP BY 1").fetchall())
    assert {r.request_id: r.user_id for r in rows} == users and len(rows) == len(users)
    texts = {}
    for user, text in con.execute("SELECT user_id, text FROM documents WHERE user_id IS NOT NULL AND text IS NOT NULL").fetchall():
        texts.setdefault(user, []).append(text)
    assert any("[Source 1]" in r.context for r in rows)
    for r in rows:
        if r.context.startswith("[Source 1]: "):
            first = r.context[len("[Source 1]: "):].split("\n\n[Source 2]")[0]
            assert any(first in t for t in texts[r.user_id])
        assert r.answer.endswith(r.context + "\n\nQuestion: " + r.answer.split("\n\nQuestion: ")[-1]) and r.n_tokens > 0 and r.cost > 0


def test_token_windows_cover_their_texts(spark, con):
    """No SQL knows the tokens, but windows are substrings, of 128 tokens but for the last, and leave nothing out."""
    texts = dict(con.execute("SELECT doc_id, text FROM documents WHERE text <> ''").fetchall())
    chunks = {}
    for r in catalog.QUERIES["chunk_tokens"](spark, str(DATA)).collect():
        chunks.setdefault(r.doc_id, []).append(r)
    assert set(chunks) == set(texts)
    for key, rows in chunks.items():
        rows.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in rows] == list(range(len(rows))) and rows[0].span_start == 0 and rows[-1].span_end == len(texts[key])
        assert all(r.text == texts[key][r.span_start : r.span_end] for r in rows) and all(r.token_count == 128 for r in rows[:-1]) and all(a.span_end > b.span_start for a, b in zip(rows, rows[1:]))


def test_all_but_two_queries_have_sql():
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"flagship", "chunk_tokens"}
