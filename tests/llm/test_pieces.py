"""Viterbi pieces against a plain search over all cuts, and against the public library reading the
same pieces as a unigram model (whose search may stop at a slightly lower score)."""

import os

import pytest

pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
import pyarrow as pa  # noqa: E402
import sentencepiece  # noqa: E402

from wayfold.llm import pieces  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no vocabulary files")
TEXTS = ["", "a", " ", "  two  spaces ", "Hello world, this is a test.", "naïve café\nnew\tline", "日本語 text 🙂", "x" * 300, "the the there therein thereby", "### token = \"24be64439e\"", "a\u0000b", "Éré en ouvième ñandú"]


def unigram():
    m = pb.ModelProto()
    m.ParseFromString(open(pieces.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def corpus():
    import pyarrow.parquet as pq

    p = "/root/testdata/sf0.001/documents.parquet"
    return pq.read_table(p, columns=["text"])["text"].to_pylist() if os.path.exists(p) else []


def plain(word, table, unknown):
    """Greatest total score over all ways to cut ``word``."""
    best = [0.0] + [-1e300] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            piece = word[i:j]
            if piece in table:
                best[j] = max(best[j], best[i] + table[piece])
            elif j == i + 1:
                best[j] = max(best[j], best[i] + unknown)
    return best[-1]


def test_best_score_of_every_word():
    p, vocab = unigram(), pieces.vocabulary()
    e, table = pieces.Encoder(vocab), {raw.decode(): s for raw, s, kind in vocab if kind == "piece"}
    words = sorted({w for t in TEXTS + corpus() for w in t.split(" ") if w and "\u0000" not in w})
    ids, at = e.encode(pa.array(words))
    score, same = [s if kind == "piece" else None for _, s, kind in vocab], 0
    for w, a, b, theirs in zip(words, at[:-1], at[1:], p.encode(words)):
        mine = ids[a:b].tolist()
        assert p.decode(mine) == w
        same += mine == theirs
        if all(score[i] is not None for i in mine + theirs):
            total = sum(score[i] for i in mine)
            assert total >= sum(score[i] for i in theirs)
            if len(w) < 40:
                assert total == plain(" " + w, table, e.unknown)
    assert same >= 0.97 * len(words)


def test_texts_are_their_words(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + corpus()[:40])] + [(None, "no id"), (7000, None), (7000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS row")
    enc = pieces.encoded(df)
    assert enc.filter("round_trip").count() == len(rows)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    got = [r.asDict() | {"text": texts[r["id"]]} for r in pieces.decoded(enc).collect()]
    assert len(got) == len(rows)
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    e = pieces.Encoder(pieces.vocabulary())
    for r in got:  # a text's pieces are those of its marked words
        if r["text"] and "  " not in r["text"] and r["text"][0] != " ":
            assert list(r["ids"]) == e.encode(pa.array(r["text"].split(" ")))[0].tolist()


def test_empty_table_mark_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decoded(pieces.encoded(empty)).count() == 0
    marked = pieces.decoded(pieces.encoded(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"))).first()
    assert marked["decoded"] == "a b" and not marked["round_trip"]
    assert pieces.decoded(spark.createDataFrame([(1, None)], "id long, ids array<int>")).first()["decoded"] == ""
