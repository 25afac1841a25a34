"""A part of the registered queries against their SQL; tools/check_oracle.py runs all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from lorespark.plans import registry
from tools.check_oracle import TABLES, plain

FOLDER = "/root/testdata/sf0.001"
CHOSEN = (
    "active_pages latest_version section_facets document_format tokenize lexical_bm25_topk phrase_search search_pages keyword_vote knn_cosine rrf_hybrid evidence_budget html_to_markdown "
    "page_chunks markdown_sections link_state backlinks_count tree_preorder breadcrumbs tag_usage answer_validation topic_parsing queue_fold revision_changes orphan_blobs archive_verify "
    "alias_assignment create_pages queue_incremental_fold ops_statistics"
).split()

#: Queries of other packages that SQL cannot express; their own tests compare them with brute force.
WITHOUT_SQL = {"op1_byte_bpe", "op2_lm_scoring", "op5_language_id", "op7_suffix_dedup", "op9_token_counts", "op11_whitening", "op12_alignment", "op13_quality", "pipeline"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_check_belongs_to_a_query():
    queries, oracle = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracle) <= set(queries) and {name for name in queries if name not in oracle} <= WITHOUT_SQL


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, database, name):
    frame = registry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = database.execute(registry.oracle_sql()[name])
    names = [item[0] for item in result.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    expected = sorted(tuple(plain(row[index]) for index in order) for row in result.fetchall())
    assert sorted(tuple(plain(row[column]) for column in columns) for row in frame.collect()) == expected
