"""Every stage of the pipeline on its own input."""

import os

import pytest

import corpus_pipeline
from wayfold.session import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, before, SF))
        kept[name] = docs.collect()
        if name != "tokens":
            assert docs.columns == columns and docs.schema == before.schema
    good = {r["doc_id"] for r in kept["quality"]}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in good for i in clean) >= 0.97 * len(clean)
    text = {r["doc_id"]: r["text"] for r in kept["quality"]}
    for r in kept["lines"]:
        lines, old = r["text"].split("\n"), text[r["doc_id"]].split("\n")
        assert r["n_chars"] == len(r["text"]) and all(x in old for x in lines if x)
    assert {r["doc_id"] for r in kept["lines"]} == good
    seen = [x for r in kept["lines"] for x in r["text"].split("\n") if x.strip()]
    assert len(seen) == len(set(seen))
    stay = {r["doc_id"] for r in kept["near_duplicates"]}
    assert stay <= good and len(stay) == len(kept["near_duplicates"])
    assert len(kept["tokens"]) == len(kept["mixture"]) and {r["doc_id"] for r in kept["mixture"]} <= stay
    assert all(r["round_trip"] for r in kept["tokens"])


def test_odd_rows_pass(spark):
    rows = [(None, "no id", "en", "a", 5), (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "some good words in a line\nand another line", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = materialize(stage(spark, docs, SF))
        if name in ("lines", "near_duplicates"):
            assert docs.count() == len(rows)
    assert docs.count() >= 4
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, SF))
    assert empty.count() == 0
