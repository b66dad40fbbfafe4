"""Answer and text scoring over documents, labels, conversations and event tokens."""

from pyspark.sql import functions as F

from wayfold.functions.stats import r6
from wayfold.operators import scoring as op
from wayfold.plans.catalog import ctes, query, r
from wayfold.sources import tables as t

NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
SC = ctes(t.RESPONSES_SQL, r"""ans AS (SELECT *, regexp_replace(regexp_extract_all(response, '(?s)<answer>(.*?)</answer>', 1)[-1], '^\s+|\s+$', '', 'g') AS answer,
  replace(regexp_extract_all(response, '#### (-?[0-9.,]+)', 1)[-1], ',', '') AS num, replace(list_filter(regexp_extract_all(response, '(-?[0-9.,]+)', 1), lambda x: x NOT IN ('', '.'))[-1], ',', '') AS lastnum FROM responses)""", f"""
scored AS (SELECT doc_id, data_source, answer, CASE WHEN num = gold_num THEN 1.0 ELSE 0.0 END::DOUBLE AS strict_score, CASE WHEN lastnum = gold_num THEN 1.0 ELSE 0.0 END::DOUBLE AS flexible_score,
  CASE WHEN {NORM.format('answer')} = {NORM.format('gold_text')} THEN 1.0 ELSE 0.0 END::DOUBLE AS em_score,
  CASE WHEN contains({NORM.format('answer')}, {NORM.format('gold_text')}) THEN 1.0 ELSE 0.0 END::DOUBLE AS subem_score,
  CASE WHEN upper(regexp_extract(answer, '([A-Za-z])', 1)) = upper(substr(gold_text, 1, 1)) THEN 1.0 ELSE 0.0 END::DOUBLE AS letter_score FROM ans)""")
SCORES = ("strict_score", "flexible_score", "em_score", "subem_score", "letter_score")


@query("score_answers", SC + f"SELECT doc_id, answer, {', '.join(SCORES)} FROM scored")
def _(spark, d):
    return op.score_answers(t.responses(spark, d)).select("doc_id", "answer", *SCORES)


@query("score_by_source", SC + "SELECT data_source, count(*) AS n, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in SCORES) + " FROM scored GROUP BY 1")
def _(spark, d):
    return op.mean_by_source(op.score_answers(t.responses(spark, d))).select("data_source", "n", *[r6(c).alias(c) for c in SCORES])


def _pairs(spark, d):
    c = t.table(spark, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("label"))
    return c.join(nxt, ["conv_id", "turn"]).select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"), F.col("text").alias("prediction"), "label")


def _gram_sql(name: str, units: str, sizes: str, distinct: bool) -> str:
    g = f"list_transform(range(1, len(u) - n + 2), lambda i: array_to_string(u[i:i + n - 1], chr(1)))"
    return ",\n".join(f"""{name}{s} AS (SELECT pair_id, n, gram, count(*) AS c FROM (SELECT pair_id, n, unnest({g}) AS gram FROM (SELECT pair_id, {units.format(col)} AS u FROM pr) x, {sizes} y(n)) GROUP BY ALL)"""
                      for s, col in (("p", "prediction"), ("l", "label"))) + f""",
{name} AS (SELECT pair_id, n, count(*) FILTER (WHERE p.c IS NOT NULL AND l.c IS NOT NULL) AS nboth, count(p.c) AS np, count(l.c) AS nl, sum(least(coalesce(p.c, 0), coalesce(l.c, 0))) AS clipped,
  coalesce(sum(p.c), 0) AS tp FROM {name}p p FULL JOIN {name}l l USING (pair_id, n, gram) GROUP BY pair_id, n)"""


@query("ngram_overlap", ctes("""pr AS (SELECT a.conv_id || ':' || a.turn AS pair_id, a.text AS prediction, b.text AS label FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
       _gram_sql("wg", r"list_filter(regexp_split_to_array({}, '\s+'), lambda w: w <> '')", "range(1, 3)", True), _gram_sql("cg", "regexp_split_to_array({}, '')", "range(1, 5)", False), """
ro AS (SELECT pair_id, n, round(100 * coalesce(2 * (nboth / np) * (nboth / nl) / (nboth / np + nboth / nl + 1e-8), 0), 4) AS f FROM wg)""", """
bs AS (SELECT pair_id, k AS n, coalesce(clipped, 0) AS clipped, greatest(coalesce(tp, 0), 1) AS den FROM pr CROSS JOIN range(1, 5) z(k) LEFT JOIN cg USING (pair_id) WHERE cg.n = k OR cg.n IS NULL)""", """
bz AS (SELECT *, sum(CASE WHEN clipped = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY n) AS zeros FROM bs)""", """
bl AS (SELECT pair_id, exp(avg(ln(CASE WHEN clipped > 0 THEN clipped / den ELSE 1 / (pow(2, zeros) * den) END))) AS geo, max(clipped) FILTER (WHERE n = 1) AS c1 FROM bz GROUP BY 1)""") + """
SELECT pair_id, coalesce(max(f) FILTER (WHERE ro.n = 1), 0) AS rouge_1, coalesce(max(f) FILTER (WHERE ro.n = 2), 0) AS rouge_2,
  any_value(round(100 * CASE WHEN coalesce(c1, 0) = 0 THEN 0 ELSE geo * CASE WHEN length(prediction) > length(label) THEN 1 ELSE exp(1 - length(label) / length(prediction)) END END, 4)) AS bleu_4
FROM pr LEFT JOIN ro USING (pair_id) LEFT JOIN bl USING (pair_id) GROUP BY pair_id""")
def _(spark, d):
    return op.ngram_overlap(_pairs(spark, d))


@query("length_cdf", f"""WITH b AS (SELECT n_chars // 500 * 500 AS length_from, count(*) AS n FROM documents GROUP BY 1)
SELECT length_from, n, CAST(sum(n) OVER (ORDER BY length_from) AS BIGINT) AS cum_n, {r('100 * sum(n) OVER (ORDER BY length_from) / sum(n) OVER ()')} AS cum_pct FROM b""")
def _(spark, d):
    return op.length_cdf(t.table(spark, d, "documents").select(F.col("n_chars").alias("length")), 500).withColumn("cum_pct", r6("cum_pct"))


@query("token_accuracy", ctes(t.TOKENS_SQL, """lb AS (SELECT sample_id, pos, CAST(val * 5 AS INT) AS pred, CASE WHEN mask = 1 THEN CAST(-old_logp * 5 AS INT) ELSE -100 END AS label FROM tokens)""") + f"""
SELECT sample_id, {r('avg(CASE WHEN a.pred = b.label THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM lb a JOIN lb b USING (sample_id) WHERE b.pos = a.pos + 1 AND b.label <> -100 GROUP BY 1""")
def _(spark, d):
    x = t.tokens(spark, d).select("sample_id", "pos", F.rint(F.col("val") * 5).cast("int").alias("pred"), F.when(F.col("mask") == 1, F.rint(-F.col("old_logp") * 5).cast("int")).otherwise(-100).alias("label"))
    return op.token_accuracy(x).withColumn("accuracy", r6("accuracy"))


@query("perplexity", ctes(t.TOKENS_SQL) + f"SELECT sample_id, {r('exp(avg(-old_logp))')} AS perplexity FROM tokens GROUP BY 1")
def _(spark, d):
    return op.perplexity(t.tokens(spark, d).withColumn("nll", -F.col("old_logp"))).withColumn("perplexity", r6("perplexity"))
