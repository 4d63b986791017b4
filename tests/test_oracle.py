"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from docloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
#: A cross-section that runs in seconds; the driver compares all.
NAMES = ["knn_l2_top10", "knn_cosine_top10", "knn_batch_top5_per_query", "knn_left_join_metadata", "boost_and_resort", "filter_all", "chunk_sentence", "chunk_paragraph", "chunk_fixed_breakpoints", "chunk_context_window", "upsert_chunks", "strip_code_comments", "universal_normalise", "config_terms", "section_split", "tokenize_query", "repo_name", "postprocess_dispatch", "comment_extract", "content_type", "quality_score", "authority_score", "domain_tags_top5", "query_intent_top3", "tfidf_scores", "removable_terms", "recommendation_strategy", "learning_fold", "ingest_end_to_end", "stream_ingest_equals_batch", "stream_job_states", "delete_file", "authority_markers", "domain_context", "cached_recommendation_latest", "ewma_effectiveness", "recent_variance", "job_state_fold", "job_cleanup", "latest_progress"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if v.__class__.__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(catalog.ORACLE[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert mine == theirs


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
