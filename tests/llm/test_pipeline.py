"""The pipeline's stages on small tables, and every registered query against its SQL."""

import duckdb
import pytest

import corpus_pipeline
from cartwise.llm.queries import QUERIES, SQL
from tests.llm.conftest import AWKWARD, frame, sentence


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = db.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = got[columns].sort_values(columns, ignore_index=True)
    b = want[columns].sort_values(columns, ignore_index=True)
    assert len(a) == len(b)
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_covers_its_table(spark, small, name):
    got = QUERIES[name](spark, small)
    ids = {r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()}
    seen = {r.doc_id for r in got.select("doc_id").collect()}
    assert seen <= ids
    if name not in ("op5_substring_dedup", "pipeline"):
        assert seen == ids


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_awkward_rows_and_empty_tables(spark, small, awkward, nothing, stage):
    name, function = stage
    for docs, n in ((awkward, len(AWKWARD)), (nothing, 0)):
        out = function(spark, docs, small)
        assert out.count() <= (n if name != "packing" else 10**6)
        if name != "packing":
            assert out.columns == docs.columns


def test_stages_do_their_part(spark, small):
    passage = sentence(9, 80)
    rows = [
        (1, sentence(1, 80)),
        (2, sentence(1, 80) + " "),
        (3, sentence(1, 80) + " one more"),
        (4, sentence(4, 60) + " " + passage),
        (5, passage + " " + sentence(5, 60)),
        (6, sentence(6, 60)),
    ]
    docs = frame(spark, rows)
    docs = corpus_pipeline.drop_copies(spark, docs, small)
    assert {r.doc_id for r in docs.collect()} == {2, 3, 4, 5, 6}
    docs = corpus_pipeline.drop_near_copies(spark, docs, small)
    assert {r.doc_id for r in docs.collect()} == {2, 4, 5, 6}
    texts = {r.doc_id: r for r in corpus_pipeline.cut_passages(spark, docs, small).collect()}
    assert texts[4].text == rows[3][1] and texts[6].text == rows[5][1]
    assert len(texts[5].text) < len(rows[4][1]) and texts[5].n_chars == len(texts[5].text)
