"""Validation metrics, length balancing and batch assembly over the test tables."""

from pyspark.sql import functions as F

from wayfold.functions.stats import r6
from wayfold.operators import batches as op
from wayfold.plans.catalog import ctes, query, r
from wayfold.sources import tables as t

VAL = """vals AS (SELECT event_type AS source, CAST(floor(user_id / 4) AS BIGINT) AS prompt, event_id AS response_id, value,
  CAST(event_id % 3 AS VARCHAR) AS pred FROM events)"""
def _values(spark, d):
    return t.table(spark, d, "events").select(F.col("event_type").alias("source"), F.floor(F.col("user_id") / 4).alias("prompt"),
                                              F.lit("score").alias("variable"), F.col("event_id").alias("response_id"), "value",
                                              (F.col("event_id") % 3).cast("string").alias("pred"))


VALS_SQL = f"""{VAL},
rk AS (SELECT *, row_number() OVER (PARTITION BY source, prompt ORDER BY value, response_id) AS i, count(*) OVER (PARTITION BY source, prompt) AS big FROM vals),
ex AS (SELECT *, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096], lambda p: p < big), big)) AS m FROM rk WHERE big > 1),
ag AS (SELECT source, prompt, big, m, sum(value * (pow(i / big, m) - pow((i - 1) / big, m))) AS b1,
  sum(value * value * (pow(i / big, m) - pow((i - 1) / big, m))) AS b2, sum(value * (pow((big - i + 1) / big, m) - pow((big - i) / big, m))) AS w1,
  sum(value * value * (pow((big - i + 1) / big, m) - pow((big - i) / big, m))) AS w2 FROM ex GROUP BY ALL),
ms AS (SELECT source, prompt, big, 'best@' || m || '/mean' AS metric, b1 AS score FROM ag
  UNION ALL SELECT source, prompt, big, 'best@' || m || '/std', sqrt(greatest(b2 - b1 * b1, 0)) FROM ag
  UNION ALL SELECT source, prompt, big, 'worst@' || m || '/mean', w1 FROM ag
  UNION ALL SELECT source, prompt, big, 'worst@' || m || '/std', sqrt(greatest(w2 - w1 * w1, 0)) FROM ag
  UNION ALL SELECT source, prompt, big, 'mean@' || big, avg(value) FROM rk GROUP BY source, prompt, big
  UNION ALL SELECT source, prompt, big, 'std@' || big, stddev_pop(value) FROM rk WHERE big > 1 GROUP BY source, prompt, big)"""


@query("validation_best_of_n", ctes(VALS_SQL, "tp AS (SELECT source, max(big) AS top FROM ms GROUP BY 1)",
       "av AS (SELECT source, metric, avg(score) AS score, count(*) AS n_prompts FROM ms GROUP BY ALL)") + f"""
SELECT source, 'score' AS variable, metric, {r('score')} AS score, n_prompts,
  CASE WHEN regexp_matches(metric, '^(mean|maj|best)') AND contains(metric, '@' || top) THEN 'core' ELSE 'aux' END AS section FROM av JOIN tp USING (source)""")
def _(spark, d):
    return op.average_over_prompts(op.best_of_n(_values(spark, d)), "score").withColumn("score", r6("score"))


@query("validation_majority", ctes(VAL, """rk AS (SELECT *, row_number() OVER (PARTITION BY source, prompt ORDER BY response_id) AS i,
  count(*) OVER (PARTITION BY source, prompt) AS big FROM vals)""", """
sz AS (SELECT DISTINCT source, prompt, big, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096], lambda p: p < big), big)) AS m FROM rk WHERE big > 1)""", """
dr AS (SELECT sz.*, b, j FROM sz, range(1, 9) t(b), range(1, 5000) u(j) WHERE j <= m)""", """
px AS (SELECT dr.*, ('0x' || substr(md5('maj|' || source || '|' || prompt || '|' || m || '|' || b || '|' || j), 1, 12))::BIGINT % big + 1 AS i FROM dr)""", """
vt AS (SELECT px.source, px.prompt, m, b, pred, count(*) AS c, min(j) AS j, min_by(value, j) AS value FROM px JOIN rk USING (source, prompt, i) GROUP BY ALL)""", """
wn AS (SELECT source, prompt, m, b, arg_max(value, c * 1000000 - j) AS value FROM vt GROUP BY ALL)""") + f"""
SELECT source, prompt, m AS n, {r('avg(value)')} AS maj_mean, {r('stddev_pop(value)')} AS maj_std FROM wn GROUP BY source, prompt, m""")
def _(spark, d):
    return op.majority(_values(spark, d), 8, "maj").select("source", "prompt", "n", r6("maj_mean").alias("maj_mean"), r6("maj_std").alias("maj_std"))


LEN = """ln AS (SELECT doc_id AS sample_id, n_chars AS length, 24576 * n_chars + n_chars * n_chars AS workload FROM documents),
lr AS (SELECT *, row_number() OVER (ORDER BY workload DESC, sample_id) - 1 AS z FROM ln)"""
SNAKE = "CASE WHEN (z // {k}) % 2 = 0 THEN z % {k} ELSE {k} - 1 - z % {k} END"


def _lengths(spark, d):
    return t.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("n_chars").alias("length"))


@query("seqlen_snake", ctes(LEN) + f"SELECT sample_id, length, workload, {SNAKE.format(k=16)} AS part FROM lr")
def _(spark, d):
    return op.snake_partition(_lengths(spark, d), 16)


@query("seqlen_imbalance", ctes(LEN, f"p AS (SELECT {SNAKE.format(k=16)} AS part, sum(length) AS tokens, sum(workload) AS work, count(*) AS n FROM lr GROUP BY 1)") + f"""
SELECT CAST(min(tokens) AS BIGINT) AS min_tokens, CAST(max(tokens) AS BIGINT) AS max_tokens, {r('avg(tokens)')} AS mean_tokens, {r('max(work) / avg(work)')} AS work_ratio, max(n) - min(n) AS size_gap FROM p""")
def _(spark, d):
    rep = op.imbalance_report(op.snake_partition(_lengths(spark, d), 16))
    return rep.withColumn("mean_tokens", r6("mean_tokens")).withColumn("work_ratio", r6("work_ratio"))


def _batches(size: int) -> str:
    return f"""gb AS (SELECT *, (row_number() OVER (ORDER BY sample_id) - 1) // {size} AS global_batch FROM ln),
lr2 AS (SELECT *, row_number() OVER (PARTITION BY global_batch ORDER BY sample_id) - 1 AS i, row_number() OVER (PARTITION BY global_batch ORDER BY workload DESC, sample_id) - 1 AS z FROM gb)"""


def _differencing(equal_size: bool) -> str:
    """Largest differencing for two parts: a state is a sorted list of pairs of sets, widest gap first."""
    if equal_size:
        start = """SELECT global_batch, list_sort(list({gap: -(wa - wb), head: -wa, id: least(ia, ib), sa: wa, sb: wb, ma: ia, mb: ib, a: [ia], b: [ib]})) AS l
  FROM (SELECT global_batch, z // 2, max(workload) AS wa, min(workload) AS wb, arg_min(i, z) AS ia, arg_max(i, z) AS ib FROM lr2 GROUP BY ALL) GROUP BY 1"""
    else:
        start = "SELECT global_batch, list_sort(list({gap: -workload, head: -workload, id: i, sa: workload, sb: 0::BIGINT, ma: i, mb: 8::BIGINT, a: [i], b: []::BIGINT[]})) AS l FROM lr2 GROUP BY 1"
    return ctes(LEN, _batches(8), f"""st AS ({start} UNION ALL
  SELECT global_batch, list_sort(list_prepend({{gap: -abs(s1 - s2), head: -greatest(s1, s2), id: least(l[1].id, l[2].id), sa: greatest(s1, s2), sb: least(s1, s2),
    ma: CASE WHEN up THEN m1 ELSE m2 END, mb: CASE WHEN up THEN m2 ELSE m1 END, a: CASE WHEN up THEN e1 ELSE e2 END, b: CASE WHEN up THEN e2 ELSE e1 END}}, l[3:])) FROM (
    SELECT *, s1 > s2 OR (s1 = s2 AND m1 <= m2) AS up FROM (SELECT global_batch, l, l[1].sa + l[2].sb AS s1, l[1].sb + l[2].sa AS s2, least(l[1].ma, l[2].mb) AS m1, least(l[1].mb, l[2].ma) AS m2,
      list_concat(l[1].a, l[2].b) AS e1, list_concat(l[1].b, l[2].a) AS e2 FROM st WHERE len(l) > 1)))""",
                f"""sn AS (SELECT *, {SNAKE.format(k=2)} AS p FROM lr2), sg AS (SELECT global_batch, abs(sum(CASE WHEN p = 0 THEN workload ELSE -workload END)) AS gap FROM sn GROUP BY 1)""") + """
SELECT global_batch, sample_id, length, workload, CASE WHEN sg.gap < -l[1].gap THEN p WHEN list_contains(l[1].a, i) THEN 0 ELSE 1 END AS part
FROM sn JOIN st USING (global_batch) JOIN sg USING (global_batch) WHERE len(l) = 1"""


@query("seqlen_partition", _differencing(True))
def _(spark, d):
    return op.seqlen_partition(op.global_batches(_lengths(spark, d), 8), 2)


@query("seqlen_partition_free", _differencing(False))
def _(spark, d):
    return op.seqlen_partition(op.global_batches(_lengths(spark, d), 8), 2, equal_size=False)


#: More than any document has; global batches of 256 documents need several micro batches each.
CAP = 131_072


@query("token_budget_batches", ctes(LEN, _batches(256), f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY global_batch ORDER BY length DESC, sample_id) AS nth FROM lr2),
sz AS (SELECT global_batch, count(*) AS n, least(greatest(1, CAST(ceil(sum(length) / {CAP}.0) AS BIGINT)), greatest(1, count(*) FILTER (WHERE length > 0))) AS k FROM rk GROUP BY 1),
st AS (SELECT global_batch, 0::BIGINT AS nth, list_transform(range(k), lambda x: 0::BIGINT) AS tokens, list_transform(range(k), lambda x: 0::BIGINT) AS work, []::BIGINT[] AS put FROM sz UNION ALL
  SELECT global_batch, nth, CASE WHEN b > len(tokens) THEN list_append(tokens, length) ELSE list_transform(tokens, lambda x, y: x + CASE WHEN y = b THEN length ELSE 0 END) END,
    CASE WHEN b > len(work) THEN list_append(work, workload) ELSE list_transform(work, lambda x, y: x + CASE WHEN y = b THEN workload ELSE 0 END) END, list_append(put, b) FROM (
    SELECT st.global_batch, rk.nth, tokens, work, put, length, workload,
      coalesce((list_sort(list_transform(list_filter(range(1, len(tokens) + 1), lambda y: tokens[y] + length <= {CAP}), lambda y: {{w: work[y], b: y}})))[1].b, len(tokens) + 1) AS b
    FROM st JOIN rk ON st.global_batch = rk.global_batch AND rk.nth = st.nth + 1))""",
       "en AS (SELECT st.* FROM st JOIN sz ON st.global_batch = sz.global_batch AND st.nth = sz.n)",
       "us AS (SELECT global_batch, b, row_number() OVER (PARTITION BY global_batch ORDER BY w DESC, b) - 1 AS q, count(*) OVER (PARTITION BY global_batch) AS m FROM (SELECT DISTINCT global_batch, unnest(put) AS b, work FROM en), LATERAL (SELECT work[b] AS w))") + """
SELECT rk.global_batch, sample_id, length, CASE WHEN q % 2 = 0 THEN (m + 1) // 2 - 1 - q // 2 ELSE (m + 1) // 2 + q // 2 END AS batch
FROM rk JOIN en USING (global_batch) JOIN us ON us.global_batch = rk.global_batch AND us.b = put[rk.nth]""")
def _(spark, d):
    return op.token_budget_batches(op.global_batches(_lengths(spark, d), 256), CAP)


@query("concat_turns", ctes(r"""tw AS (SELECT conv_id AS traj_id, turn, role, regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS words FROM conversations),
of AS (SELECT *, coalesce(sum(len(words)) OVER (PARTITION BY traj_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o,
  last(role) OVER (PARTITION BY traj_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_role FROM tw),
ex AS (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM of)""") + """
SELECT traj_id, CAST(o + i - 1 AS BIGINT) AS pos, turn, words[i] AS token, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS mask,
  CASE WHEN role = 'assistant' AND i = 1 THEN turn / 4 ELSE 0 END::DOUBLE AS score, last_role FROM ex""")
def _(spark, d):
    c = t.table(spark, d, "conversations").select(F.col("conv_id").alias("traj_id"), "turn", "role", "text", (F.col("turn") / 4).alias("score"))
    return op.concat_turns(c)


@query("best_checkpoint", ctes("st AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS step, event_type, avg(value) AS score FROM events GROUP BY ALL)",
       "sc AS (SELECT step, avg(score) AS score FROM st GROUP BY 1)") + f"""
SELECT step, {r('score')} AS score, coalesce(score > max(score) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM sc""")
def _(spark, d):
    m = t.table(spark, d, "events").groupBy(F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("step"), "event_type").agg(F.avg("value").alias("score"))
    return op.best_checkpoint(m).withColumn("score", r6("score"))


@query("filter_overlong", ctes(r"""pk AS (SELECT doc_id AS prompt_id, len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS n_tokens FROM documents WHERE text IS NOT NULL),
rk AS (SELECT *, row_number() OVER (ORDER BY md5('prompts|' || prompt_id), prompt_id) AS k FROM pk WHERE n_tokens <= 200)""") + "SELECT prompt_id, n_tokens FROM rk WHERE k <= 0.2 * (SELECT count(*) FROM documents)")
def _(spark, d):
    docs = t.table(spark, d, "documents").select(F.col("doc_id").alias("prompt_id"), "text")
    return op.filter_overlong(docs, "text", 200, share=0.2).select("prompt_id", "n_tokens")
