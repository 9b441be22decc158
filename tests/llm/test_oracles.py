"""Queries of this package that SQL can express give the rows that DuckDB gives, and all of them have their columns."""

import pytest

pytest.importorskip("public_tokenizers")

from sparkloom.llm.registry import ORACLE_SQL, QUERIES  # noqa: E402
from tests.conftest import DATA  # noqa: E402


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(float(x), 6) if isinstance(x, float) else str(x)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, duck):
    found = QUERIES[name](spark, DATA)
    expected = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, expected.fetchall())


COLUMNS = {
    1: "doc_id n_bytes n_tokens over_limit", 2: "doc_id n_tokens ids_sha256 decoded_sha256", 3: "doc_id n_shingles component_id kept", 4: "doc_id n_words n_base first_word last_word base_labels labels score",
    5: "page_id url text n_chars", 6: "doc_id held_out score predicted", 7: "vec_id n_links component_id kept", 8: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    9: "doc_id size source_size target taken", 10: "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_one_row_for_each(n, spark):
    name = next(q for q in QUERIES if q.startswith(f"op{n}_"))
    found = QUERIES[name](spark, DATA)
    assert found.columns[: len(COLUMNS[n].split())] == COLUMNS[n].split()
    whole = spark.read.parquet(f"{DATA}/{'pages' if n == 5 else 'embeddings' if n == 7 else 'documents'}.parquet")
    assert found.count() == whole.count()
