"""Registered queries against their SQL on the smallest test tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("degree_stats", "extract_transitions", "sample_walks", "gen_multi_turn_mix", "adv_grpo", "gae_tokens", "offpolicy_stats", "filter_topp_variance", "leaderboard", "factor_correlation",
          "coverage_curve", "point_visibility", "overlap_value_stats", "visual_overlap", "map_similarity", "explode_turns", "ngram_overlap", "split_by_group", "mix_interleave_over", "stream_graph_upsert", "stream_rollout_summary", "expand_env_specs", "balanced_select")


def norm(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want and got


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def matches_sql(spark, name, tables):
    """Whether a query gives the rows of its SQL over frames in a folder ``{table: path}``."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t, path in tables.items():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    df = entry.queries()[name](spark, os.path.dirname(next(iter(tables.values()))))
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    return got == sorted(tuple(map(norm, r)) for r in rel.fetchall())


@pytest.fixture
def odd_documents(spark, tmp_path):
    rows = [(1, "some\nwords", "en", "web", 10), (2, "", "de", "web", 0), (3, "words", "fr", "web", 0), (4, "a \U0001f600", "", "web", None)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    return {"documents": path}


def test_custom_scorer_of_empty_texts(spark, odd_documents):
    assert matches_sql(spark, "custom_scorer", odd_documents)


def test_media_segments_of_empty_texts(spark, odd_documents):
    assert matches_sql(spark, "media_segments", odd_documents)
