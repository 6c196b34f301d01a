import pytest

from brindle.llm import queries
from oracle import DATA, connection, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name,columns", [
    ("p1_found", "id_a:string id_b:string"), ("p2_found", "session_id:string"), ("p4_found", "chunk_id:string line_no:bigint"), ("p5_found", "chunk_id:string piece_start:bigint piece_end:bigint"),
    ("p6_found", "id_a:string id_b:string"), ("p7_found", "record_id:string kind:string start_pos:bigint end_pos:bigint"), ("p8_ids", "doc_id:bigint ids:array<int>"), ("p10_found", "doc_id:bigint category:string"),
])
def test_columns_and_distinct_rows(spark, name, columns):
    df = queries.QUERIES[name](spark, str(DATA))
    assert " ".join(f"{a}:{b}" for a, b in df.dtypes) == columns
    rows = [str(r) for r in df.collect()]
    assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", ["p1_neighbours", "p4_main", "p6_groups", "p7_redacted", "p9_mix", "p9_shares", "p10_scores", "p10_rates"])
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0
