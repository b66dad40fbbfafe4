"""SentencePiece encoding and decoding with a shared-prefix Viterbi search.

The pieces and scores of a vocabulary file are read as a unigram model: a text's pieces are those
with the greatest total score, a character without a piece falls back to bytes.  No piece goes
past the end of a marked word (spaces and what follows up to the next space), so words are solved
apart: the distinct words of a batch are sorted, which makes them a trie, and visited depth first;
the forward scores of a prefix are kept on a stack and serve every word that shares it.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.arrays import flat, hashes, lists, ready

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct words that a task keeps solved between batches.
KEPT_WORDS = 200_000


def vocabulary(path: str = MODEL) -> list[tuple[bytes | None, float, str]]:
    """(bytes, score, kind) of every id; kind is piece, byte or none (control and unknown)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(p.get_piece_size()):
        piece = p.id_to_piece(i)
        if p.is_byte(i):
            out.append((bytes([int(piece[3:-1], 16)]), 0.0, "byte"))
        elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
            out.append((None, 0.0, "none"))
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} goes past a word")
            out.append((piece.replace(MARK, " ").encode(), p.get_score(i), "piece"))
    return out


class Encoder:
    """Viterbi search over sorted words; one for each task."""

    def __init__(self, vocab: list[tuple[bytes | None, float, str]]):
        self.root = [{}, -1, 0.0]
        self.bytes = [-1] * 256
        scores = [s for _, s, kind in vocab if kind == "piece"]
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY
        for i, (raw, score, kind) in enumerate(vocab):
            if kind == "byte":
                self.bytes[raw[0]] = i
            elif kind == "piece":
                node = self.root
                for c in raw.decode():
                    node = node[0].setdefault(c, [{}, -1, 0.0])
                node[1], node[2] = i, score
        self._clear()

    def _clear(self):
        self.known, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def solve(self, words: list[str]) -> list[list[int]]:
        """Piece ids of words in sorted order."""
        root, unknown, fallback = self.root, self.unknown, self.bytes
        best, start, piece, alive = [0.0], [0], [-1], [[]]
        last, out = "", []
        for word in words:
            d, most = 0, min(len(word), len(last))
            while d < most and word[d] == last[d]:
                d += 1
            del best[d + 1:], start[d + 1:], piece[d + 1:], alive[d + 1:]
            for d in range(d, len(word)):
                c = word[d]
                high, origin, name, going, single = -1e300, d, -1, [], False
                for s, node in alive[d]:
                    node = node[0].get(c)
                    if node is not None:
                        going.append((s, node))
                        if node[1] >= 0 and best[s] + node[2] > high:
                            high, origin, name = best[s] + node[2], s, node[1]
                node = root[0].get(c)
                if node is not None:
                    going.append((d, node))
                    if node[1] >= 0:
                        single = True
                        if best[d] + node[2] > high:
                            high, origin, name = best[d] + node[2], d, node[1]
                if not single and best[d] + unknown > high:
                    high, origin, name = best[d] + unknown, d, -1
                best.append(high)
                start.append(origin)
                piece.append(name)
                alive.append(going)
            ids, d = [], len(word)
            while d:
                if piece[d] >= 0:
                    ids.append(piece[d])
                else:
                    ids.extend(fallback[b] for b in reversed(word[d - 1].encode()))
                d = start[d]
            ids.reverse()
            out.append(ids)
            last = word
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and each text's first one (with a closing entry)."""
        texts = [t if t and MARK not in t else (t or "").replace(MARK, " ") for t in column.to_pylist()]
        data, offsets = flat(pa.array([" " + t if t else "" for t in texts], pa.large_string()))
        space = data == 32
        new = space.copy()
        new[1:] &= ~space[:-1]
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(data)).astype(np.int64)[: len(starts)]
        h, seen, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_WORDS:
            self._clear()
        place = np.searchsorted(self.known, h)
        fresh = np.ones(len(h), bool)
        inside = place < len(self.known)
        fresh[inside] = self.known[place[inside]] != h[inside]
        if fresh.any():
            raw = data.tobytes()
            words = sorted((raw[starts[i]: ends[i]].decode(), k) for i, k in zip(seen[fresh].tolist(), h[fresh].tolist()))
            got = self.solve([w for w, _ in words])
            sizes = np.append(np.diff(self.at), np.fromiter(map(len, got), np.int64, len(got)))
            ids = np.append(self.ids, np.fromiter(chain.from_iterable(got), np.int32))
            known = np.append(self.known, np.array([k for _, k in words], np.uint64))
            order = np.argsort(known)
            self.known, first = known[order], np.append(0, np.cumsum(sizes))[:-1]
            self.ids, self.at = _gathered(ids, first[order], sizes[order])
            place = np.searchsorted(self.known, h)
        word = place[inverse]
        ids, at = _gathered(self.ids, self.at[word], self.at[word + 1] - self.at[word])
        return ids, at[np.searchsorted(starts, offsets)]


def _gathered(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices ``values[first:first + size]`` joined, and where each begins (with a closing entry)."""
    at = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return values[np.arange(at[-1]) + np.repeat(first - at[:-1], sizes)], at


def _shared(df: DataFrame, path: str):
    return ready(df.sparkSession).sparkContext.broadcast(vocabulary(path))  # bounded by the vocabulary


class Decoder:
    def __init__(self, vocab: list[tuple[bytes | None, float, str]]):
        raw = [x or b"" for x, _, _ in vocab]
        self.letters, self.size = np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.append(0, np.cumsum(self.size))[:-1]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Bytes of each text; the mark put before it goes."""
        data, begins = _gathered(self.letters, self.first[ids], self.size[ids])
        data, cut = data.tobytes(), begins[at]
        return [data[i + (data[i: i + 1] == b" " and i < j): j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(id, ids, round_trip): piece ids of every whole text, and whether decoding them gives it back.

    Null and empty texts have no ids.  As the mark stands for a space, a mark in a text is read as
    one (and such a text does not come back).
    """
    shared = _shared(docs, path)

    def run(batches):
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for b in batches:
            if b.num_rows:
                ids, at = encoder.encode(b.column(1))
                data, offsets = flat(b.column(1))
                raw = data.tobytes()
                same = [raw[i:j] == x for i, j, x in zip(offsets[:-1].tolist(), offsets[1:].tolist(), decoder.decode(ids, at))]
                yield pa.RecordBatch.from_arrays([b.column(0), lists(ids, at, pa.int32()), pa.array(same)], ["id", "ids", "round_trip"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, id_col: str = "id", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the text of the ids; null ids give the empty text.

    Bytes that are no valid UTF-8 become U+FFFD; control and unknown ids are nothing.
    """
    shared = _shared(rows, path)
    inner = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        decoder = Decoder(shared.value)
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(1)
            at = column.offsets.to_numpy().astype(np.int64)
            texts = [x.decode("utf-8", "replace") for x in decoder.decode(column.flatten().to_numpy(zero_copy_only=False), at - at[0])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "decoded"])

    return inner.mapInArrow(run, inner.select("row").schema.add("decoded", "string")).select("row.*", "decoded")
