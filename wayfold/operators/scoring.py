"""Rule-based scoring of answers and texts, as joins and column expressions over whole tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.session import spread

# The answer formats recognised by the rules.
HASH_NUMBER = r"#### (-?[0-9.,]+)"
ANY_NUMBER = r"(-?[0-9.,]+)"
ANSWER_TAG = r"(?s)<answer>(.*?)</answer>"
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def last_match(text: Column, pattern: str) -> Column:
    """Group 1 of the last match, null without a match."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def strict_number(text: Column) -> Column:
    """Number after the last ``####``, without thousands separators."""
    return F.regexp_replace(last_match(text, HASH_NUMBER), "[,$]", "")


def last_number(text: Column) -> Column:
    """Last number anywhere that is not just a dot."""
    found = F.filter(F.regexp_extract_all(text, F.lit(ANY_NUMBER), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.try_element_at(found, F.lit(-1))


def normalise(text: Column) -> Column:
    """Lower case, no punctuation, no articles, single spaces."""
    t = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\b(a|an|the)\b", " "), r"\s+", " "))


def tagged_answer(text: Column) -> Column:
    return F.regexp_replace(last_match(text, ANSWER_TAG), r"^\s+|\s+$", "")


def score_answers(responses: DataFrame) -> DataFrame:
    """All rule scores of ``(response, gold_text, gold_num)``.

    An exact match counts a quarter when the response repeats the answer tags more than ten times.
    """
    t = F.col("response")
    answer = normalise(F.col("answer"))
    gold = normalise(F.col("gold_text"))
    tags = F.greatest(F.regexp_count(t, F.lit("<answer>")), F.regexp_count(t, F.lit("</answer>")))
    value = F.when(tags > 10, 0.25).otherwise(1.0)
    r = responses.withColumn("answer", tagged_answer(t))
    letter = F.upper(F.regexp_extract("answer", r"([A-Za-z])", 1))
    return r.select(
        "*", F.coalesce((strict_number(t) == F.col("gold_num")).cast("double"), F.lit(0.0)).alias("strict_score"),
        F.coalesce((F.regexp_replace(last_number(t), "[,$]", "") == F.col("gold_num")).cast("double"), F.lit(0.0)).alias("flexible_score"),
        F.when(answer == gold, value).otherwise(0.0).alias("em_score"), F.when(F.contains(answer, gold), value).otherwise(0.0).alias("subem_score"),
        F.coalesce((letter == F.upper(F.substring("gold_text", 1, 1))).cast("double"), F.lit(0.0)).alias("letter_score"))


def mean_by_source(scored: DataFrame) -> DataFrame:
    """Mean of every score per data source."""
    cols = [c for c in scored.columns if c.endswith("_score")]
    return scored.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])


SLICE = 4096  # n-gram starts a slice, at least 3


def _slices(family: str) -> Column:
    """Consecutive slices of a text, each with enough of the next to finish the n-grams that start in it."""
    if family == "w":
        words = F.col("words")
        n = F.size(words)
        starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(SLICE))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, SLICE + 1), " "))
    cut = F.col("cut")
    return F.transform(cut, lambda x, i: F.concat(x, F.coalesce(F.left(F.get(cut, i + 1), F.lit(3)), F.lit(""))))


def _grams(units: Column, sizes: range) -> Column:
    """Array of (n, gram) over the n-grams that start in the first ``SLICE`` units."""
    def starts(k):
        return F.when(F.size(units) >= k, F.sequence(F.lit(1), F.least(F.size(units) - k + 1, F.lit(SLICE)))).otherwise(F.array().cast("array<int>"))

    def gram(k):
        return lambda i: F.struct(F.lit(k).alias("n"), F.concat_ws("\u0001", F.slice(units, i, k)).alias("gram"))
    return F.flatten(F.array(*[F.transform(starts(k), gram(k)) for k in sizes]))


def text_slices(pairs: DataFrame) -> DataFrame:
    """(pair_id, lp, ll, family, p, l, body): words and characters of both texts in overlapping slices of bounded length."""
    sides = pairs.select("pair_id", F.length("prediction").alias("lp"), F.length("label").alias("ll"), F.explode(F.array(*[
        F.struct(F.col(c).alias("text"), F.lit(p).alias("p"), F.lit(1 - p).alias("l")) for c, p in (("prediction", 1), ("label", 0))])).alias("s"))
    u = sides.select("pair_id", "lp", "ll", "s.*").withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != "")).withColumn(
        "cut", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0)))

    def tagged(family):
        return F.transform(_slices(family), lambda b: F.struct(F.lit(family).alias("family"), b.alias("body")))
    return u.select("pair_id", "lp", "ll", "p", "l", F.inline_outer(F.concat(tagged("w"), tagged("c"))))


#: Columns of counts: words in both, in the prediction and in the label for 1 and 2; clipped and predicted characters for 1 to 4.
COUNTS = [f"{c}{k}" for k in (1, 2) for c in ("both", "np", "nl")] + [f"{c}{k}" for k in range(1, 5) for c in ("clipped", "tp")]
UNITS = 1 << 18  # characters counted at once in a task


def _each_gram(units: np.ndarray, lengths: np.ndarray, n: int, most: int):
    """For k = 1 to ``most``: pair, uses in predictions and uses in labels of every distinct k-gram of a pair.

    ``units`` holds ``n`` predictions, then ``n`` labels.  A gram's number stands for the shorter gram it extends and one
    more unit, so equal numbers are equal grams.
    """
    text = np.repeat(np.arange(2 * n), lengths)
    at, key = np.arange(len(units)), (text % n) * (units.max(initial=0) + 1) + units
    for k in range(1, most + 1):
        if k > 1:
            stay = at + k - 1 < len(units)
            stay[stay] = text[at[stay] + k - 1] == text[at[stay]]
            at, key = at[stay], number[stay] * (units.max(initial=0) + 1) + units[at[stay] + k - 1]
        _, one, number = np.unique(key, return_index=True, return_inverse=True)
        predicted = text[at] < n
        yield k, text[at[one]] % n, np.bincount(number[predicted], minlength=len(one)), np.bincount(number[~predicted], minlength=len(one))


def _row_counts(pairs: DataFrame) -> DataFrame:
    """``COUNTS`` of pairs of bounded texts, row by row, without making a row a gram."""

    def block(b):
        n, out = b.num_rows, {}
        sides = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (b.column("wp"), b.column("wl"))]
        units = pa.concat_arrays([c.flatten() for c in sides]).dictionary_encode().indices.to_numpy().astype(np.int64)
        lengths = np.concatenate([c.value_lengths().fill_null(0).to_numpy() for c in sides])
        for k, pair, p, l in _each_gram(units, lengths, n, 2):
            for name, hit in (("both", (p > 0) & (l > 0)), ("np", p > 0), ("nl", l > 0)):
                out[f"{name}{k}"] = np.bincount(pair[hit], minlength=n)
        texts = [(t or b"").decode("utf-8", "surrogateescape") for c in ("prediction", "label") for t in b.column(c).to_pylist()]
        units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        for k, pair, p, l in _each_gram(units, np.array([len(t) for t in texts]), n, 4):
            out[f"clipped{k}"] = np.bincount(pair, np.minimum(p, l), n).astype(np.int64)
            out[f"tp{k}"] = np.bincount(pair, p, n).astype(np.int64)
        return pa.RecordBatch.from_arrays([b.column(c) for c in ("pair_id", "lp", "ll")] + [pa.array(out[c], pa.int64()) for c in COUNTS], ["pair_id", "lp", "ll", *COUNTS])

    def run(batches):
        for b in batches:
            size = np.cumsum(b.column("lp").fill_null(0).to_numpy().astype(np.int64) + b.column("ll").fill_null(0).to_numpy())
            i = 0
            while i < b.num_rows:
                j = max(int(np.searchsorted(size, (size[i - 1] if i else 0) + UNITS, "right")), i + 1)
                yield block(b.slice(i, j - i))
                i = j

    def split(c):
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")
    u = pairs.select("pair_id", "lp", "ll", split("prediction").alias("wp"), split("label").alias("wl"), F.col("prediction").cast("binary").alias("prediction"), F.col("label").cast("binary").alias("label"))
    schema = u.select("pair_id", "lp", "ll").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return u.mapInArrow(run, schema)


def _slice_counts(pairs: DataFrame) -> DataFrame:
    """``COUNTS`` of pairs of texts of any length.

    Texts are cut into overlapping slices where they lie; slices, not whole texts, are spread over
    the tasks and exploded into grams tagged by side.  One aggregate per (pair, gram) counts both
    sides with map-side combining, so no join is needed and one long pair is many small rows.
    """
    words = F.split("body", " ")
    u = spread(text_slices(pairs), "pair_id", "family", "body").withColumn("units", F.when(F.col("family") == "w", words).otherwise(F.split("body", "")))
    grams = F.when(F.col("family") == "w", _grams(F.col("units"), range(1, 3))).otherwise(_grams(F.col("units"), range(1, 5)))
    per_gram = u.select("pair_id", "lp", "ll", "family", "p", "l", F.inline_outer(grams)).groupBy("pair_id", "family", "n", "gram").agg(
        F.sum("p").alias("p"), F.sum("l").alias("l"), F.max("lp").alias("lp"), F.max("ll").alias("ll"))

    def at(family, k, value):
        return F.sum(F.when((F.col("family") == family) & (F.col("n") == k), value))
    both, in_p, in_l = ((F.col("p") > 0) & (F.col("l") > 0)).cast("int"), (F.col("p") > 0).cast("int"), (F.col("l") > 0).cast("int")
    return per_gram.groupBy("pair_id").agg(
        F.max("lp").alias("lp"), F.max("ll").alias("ll"),
        *[F.coalesce(at("w", k, v), F.lit(0)).alias(f"{name}{k}") for k in (1, 2) for name, v in (("both", both), ("np", in_p), ("nl", in_l))],
        *[F.coalesce(at("c", k, v), F.lit(0)).alias(f"{name}{k}") for k in range(1, 5) for name, v in (("clipped", F.least("p", "l")), ("tp", F.col("p")))])


def ngram_overlap(pairs: DataFrame) -> DataFrame:
    """ROUGE-1/2 F over word sets and smoothed BLEU-4 over characters of ``(pair_id, prediction, label)``.

    A pair whose texts have at most ``SLICE`` characters is counted inside its row.  Longer texts, and pairs that
    share an id (they count as one), are cut into slices whose grams are rows.
    """
    p = spread(pairs.select("pair_id", "prediction", "label", F.length("prediction").alias("lp"), F.length("label").alias("ll")), "pair_id")
    long = F.coalesce(F.greatest("lp", "ll"), F.lit(0)) > SLICE
    sliced = p.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(long).alias("long")).filter("n > 1 OR long").select(F.col("pair_id").alias("sliced_id"))
    same = F.col("pair_id").eqNullSafe(F.col("sliced_id"))
    c = _row_counts(p.join(sliced, same, "left_anti")).unionByName(_slice_counts(p.join(sliced, same, "left_semi")))

    def rouge(k):
        prec, rec = F.try_divide(f"both{k}", f"np{k}"), F.try_divide(f"both{k}", f"nl{k}")
        return F.round(100 * F.coalesce(2 * prec * rec / (prec + rec + 1e-8), F.lit(0.0)), 4)
    zeros, total = F.lit(0), F.lit(0.0)
    for k in range(1, 5):
        # the i-th empty precision counts as 1 / (2^i * number of grams)
        hit, den = F.col(f"clipped{k}"), F.greatest(F.col(f"tp{k}"), F.lit(1))
        zeros = zeros + (hit == 0).cast("int")
        total = total + F.ln(F.when(hit > 0, hit / den).otherwise(1 / (F.pow(F.lit(2.0), zeros) * den)))
    brevity = F.when(F.col("lp") > F.col("ll"), 1.0).when(F.col("lp") == 0, 0.0).otherwise(F.exp(1 - F.col("ll") / F.nullif("lp", F.lit(0))))
    bleu = F.round(100 * F.when(F.col("clipped1") == 0, 0.0).otherwise(brevity * F.exp(total / 4)), 4)
    return c.select("pair_id", rouge(1).alias("rouge_1"), rouge(2).alias("rouge_2"), bleu.alias("bleu_4"))


def length_cdf(lengths: DataFrame, interval: int) -> DataFrame:
    """Counts per length interval with cumulative count and percentage.

    Rows are counted per interval first; the window sees one row per interval.
    """
    b = lengths.groupBy((F.floor(F.col("length") / interval) * interval).alias("length_from")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("length_from").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("length_from", "n", F.sum("n").over(w).alias("cum_n"), (100 * F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("cum_pct"))


def token_accuracy(tokens: DataFrame, ignore: int = -100) -> DataFrame:
    """Share of predictions equal to the next label, per sample; ignored labels do not count."""
    nxt = tokens.select("sample_id", (F.col("pos") - 1).alias("pos"), F.col("label").alias("next_label")).filter(F.col("next_label") != ignore)
    hit = (F.col("pred") == F.col("next_label")).cast("double")
    return tokens.join(nxt, ["sample_id", "pos"]).groupBy("sample_id").agg(F.avg(hit).alias("accuracy"))


def perplexity(tokens: DataFrame) -> DataFrame:
    """exp of the mean token loss per sample."""
    return tokens.groupBy("sample_id").agg(F.exp(F.avg("nll")).alias("perplexity"))
