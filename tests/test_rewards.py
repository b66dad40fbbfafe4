"""Advantages, filters and validation metrics on hand-made batches."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wayfold.operators import batches, rewards as r, tokens as tk
from wayfold.sources import tables


def sample_frame(spark, rows):
    return spark.createDataFrame([(u, i, float(x), 10 + i, float(x > 1)) for i, (u, x) in enumerate(rows)], "uid long, sample_id long, reward double, length long, acc double")


def adv(df):
    return {x.sample_id: x.advantage for x in df.collect()}


def test_group_statistics_and_singletons(spark):
    s = sample_frame(spark, [(0, 1), (1, 2), (0, 3)])
    a = adv(r.grpo(s))
    assert a[0] == pytest.approx(-1 / (math.sqrt(2) + 1e-6)) and a[1] == pytest.approx(2 / (1 + 1e-6))
    assert adv(r.rloo(s)) == pytest.approx({0: -2, 1: 0, 2: 2})
    assert adv(r.rloo(s, singleton_keeps_reward=True))[1] == 2


def test_random_groups_match_loops(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 9), rnd.random()) for _ in range(200)]
    s, groups = sample_frame(spark, rows), {}
    for u, x in rows:
        groups.setdefault(u, []).append(x)
    g, l = adv(r.grpo(s)), adv(r.rloo(s))
    for i, (u, x) in enumerate(rows):
        v = groups[u]
        assert g[i] == pytest.approx((x - statistics.mean(v)) / (statistics.stdev(v) + 1e-6))
        assert l[i] == pytest.approx(x - (sum(v) - x) / (len(v) - 1))


def test_passk_rejects_single_sample(spark):
    assert adv(r.grpo_passk(sample_frame(spark, [(0, 5), (0, 3), (0, 5)]), normalise=False)) == {0: 0.0, 1: 0.0, 2: 0.0}
    with pytest.raises(Exception, match="fewer than two"):
        r.grpo_passk(sample_frame(spark, [(0, 5)])).collect()


def test_top_p_keeps_everything_without_variance(spark):
    kept = r.filter_topp_variance(sample_frame(spark, [(0, 1), (0, 1), (1, 2)]), 0.5).collect()
    assert len(kept) == 3 and {k.loss_scale for k in kept} == {1.0}


def test_top_k_keeps_at_least_one_group(spark):
    kept = r.filter_topk_variance(sample_frame(spark, [(0, 1), (0, 5), (1, 2), (1, 3)]), 0.01).collect()
    assert {k.uid for k in kept} == {0}


def test_pairwise_accuracy_equals_pair_loop(spark):
    rnd = random.Random(2)
    rows = [(u, rnd.random(), rnd.choice([0.0, 1.0] if u < 3 else [0.0, 0.25, 0.7, 1.0])) for u in range(6) for _ in range(9)] + [(6, 0.3, 1.0), (6, 0.2, 1.0)]
    df = spark.createDataFrame([(u, i, x, 1, a) for i, (u, x, a) in enumerate(rows)], "uid long, sample_id long, reward double, length long, acc double")
    for g in r.pairwise_accuracy(df).collect():
        v = [(x, a) for u, x, a in rows if u == g.uid]
        pairs = [(abs(a - b), (x > y) == (a > b)) for i, (x, a) in enumerate(v) for y, b in v[i + 1:]]
        weight = sum(w for w, _ in pairs)
        assert g.pair_accuracy == pytest.approx(sum(w for w, ok in pairs if ok) / weight if weight else 0.5)


def test_equal_rewards_tie_in_every_order_of_events(spark, tmp_path):
    values = {0: [10.0, 20.0, 30.0, 260.0], 1: [70.1, 209.9, 20.0, 20.0], 2: [300.0], 3: [5.0]}
    rows = [(u, v) for u, vs in values.items() for v in vs]
    spark.createDataFrame(rows, "user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    s = tables.samples(spark, str(tmp_path))
    rewards = {x.sample_id: x.reward for x in s.collect()}
    assert rewards[0] == rewards[1] == 3.2
    assert [g.pair_accuracy for g in r.pairwise_accuracy(s).collect()] == [0.625]


def test_resample_draws_follow_weights(spark):
    s = sample_frame(spark, [(0, 0.0)] * 50 + [(0, 3.0)] * 50)
    drawn = r.reweight_resample(s).collect()
    assert len(drawn) == 100 and all(d.reward == 3.0 for d in drawn)


def token_frame(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, uid long, pos long, score double, val double, mask int")


def gae_loop(rows, gamma, lam):
    nxt = last = 0.0
    out = {}
    for _, _, p, s, v, m in sorted(rows, key=lambda x: -x[2]):
        if m:
            last = s + gamma * nxt - v + gamma * lam * last
            nxt = v
        out[p] = last
    return out


def test_gae_ignores_masked_tokens(spark):
    rnd = random.Random(3)
    base = [(s, s // 2, p, rnd.random(), rnd.random(), int(rnd.random() < 0.7)) for s in range(4) for p in range(30)]
    noisy = [(s, u, p, x + (0 if m else 9), v + (0 if m else 5), m) for s, u, p, x, v, m in base]
    res = []
    for rows in (base, noisy):
        got = {(x.sample_id, x.pos): x for x in tk.gae_tokens(token_frame(spark, rows), 0.97, 0.9).collect()}
        res.append({k: (x.advantage, x.ret) for k, x in got.items() if x["mask"]})
        raw = {(s, p): a for s in range(4) for p, a in gae_loop([x for x in rows if x[0] == s], 0.97, 0.9).items()}
        valid = [raw[s, p] for s, _, p, _, _, m in rows if m]
        mu, sd = statistics.mean(valid), statistics.stdev(valid)
        for k, x in got.items():
            assert x.advantage == pytest.approx((raw[k] - mu) / sd, abs=1e-6)
    assert all(res[0][k] == pytest.approx(res[1][k]) for k in res[0])


def test_turn_level_gae_broadcasts_to_duplicates(spark):
    rows = [(0, 0, t, p, 1.0, 0.5, int(p < 2)) for t in range(3) for p in range(3)] + [(0, 0, 2, p, 1.0, 0.5, int(p < 2)) for p in range(3)]
    df = spark.createDataFrame(rows, "uid long, traj_idx long, turn_idx long, pos long, score double, val double, mask int")
    out = tk.gae_turns(df, 1.0, 1.0, "last").collect()
    assert len(out) == 12
    want = {2: 2.0, 1: 4.0, 0: 6.0}  # returns without discount: rewards of 2 per turn to go
    for x in out:
        assert x.ret == (pytest.approx(want[x.turn_idx]) if x.pos == 1 else -100)


def test_majority_tie_takes_earliest(spark):
    df = spark.createDataFrame([("s", 0, i, v, p) for i, (p, v) in enumerate([("A", 0.9), ("B", 0.8), ("A", 0.7)])], "source string, prompt long, response_id long, value double, pred string")
    got = {x.n: x.maj_mean for x in batches.majority(df, 400, "m").collect()}
    assert set(got) == {2, 3} and 0.75 < got[3] < 0.9


def test_best_of_n_matches_simulation(spark):
    vals = [0.1, 0.4, 0.4, 0.9, 0.6]
    df = spark.createDataFrame([("s", 0, "acc", i, v) for i, v in enumerate(vals)], "source string, prompt long, variable string, response_id long, value double")
    got = {x.metric: x.score for x in batches.best_of_n(df).collect()}
    rnd = random.Random(4)
    for n in (2, 4, 5):
        sims = [[rnd.choice(vals) for _ in range(n)] for _ in range(40000)]
        assert got[f"best@{n}/mean"] == pytest.approx(statistics.mean(map(max, sims)), abs=0.01)
        assert got[f"worst@{n}/mean"] == pytest.approx(statistics.mean(map(min, sims)), abs=0.01)
        assert got[f"best@{n}/std"] == pytest.approx(statistics.pstdev(map(max, sims)), abs=0.01)
    assert got["mean@5"] == pytest.approx(statistics.mean(vals)) and got["std@5"] == pytest.approx(statistics.pstdev(vals))


def test_validation_average(spark):
    df = spark.createDataFrame([("s1", 1, "acc", 0, 0.8), ("s1", 1, "acc", 1, 0.9), ("s2", 2, "acc", 2, 0.7)], "source string, prompt long, variable string, response_id long, value double")
    got = {(x.source, x.metric): (x.score, x.section) for x in batches.average_over_prompts(batches.best_of_n(df), "acc").collect()}
    assert got["s1", "mean@2"] == (pytest.approx(0.85), "core") and got["s2", "mean@1"] == (pytest.approx(0.7), "core")
    assert got["s1", "std@2"][1] == "aux"


def test_length_partition_covers_and_balances(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(i, rnd.randint(1, 4000)) for i in range(640)], "sample_id long, length long")
    parts = batches.snake_partition(df, 8)
    assert sorted(x.sample_id for x in parts.collect()) == list(range(640))
    rep = batches.imbalance_report(parts).first()
    assert rep.size_gap == 0 and rep.work_ratio < 1.05


@pytest.mark.parametrize("equal_size", [True, False])
def test_differencing_never_wider_than_snake(equal_size):
    rnd = random.Random(7)
    narrower = 0
    for trial in range(200):
        k = rnd.choice([1, 2, 3, 5, 8])
        n = k * rnd.randint(1, 9) + (0 if equal_size else rnd.randint(0, k))
        loads = [rnd.choice([rnd.randint(1, 9), rnd.randint(1, 4000), 500]) for _ in range(n)]
        parts = batches.differenced(loads, k, equal_size)
        sums = [sum(x for x, p in zip(loads, parts) if p == j) for j in range(k)]
        by = sorted(range(n), key=lambda i: (-loads[i], i))
        snake = [0] * k
        for z, i in enumerate(by):
            snake[z % k if z // k % 2 == 0 else k - 1 - z % k] += loads[i]
        assert len(parts) == n and max(sums) - min(sums) <= max(snake) - min(snake)
        narrower += max(sums) - min(sums) < max(snake) - min(snake)
        if equal_size:
            assert all(parts.count(j) == n // k for j in range(k))
    assert narrower > 60


def test_differencing_per_batch(spark):
    rnd = random.Random(8)
    df = spark.createDataFrame([(i, rnd.randint(1, 4000), "x") for i in range(96)] + [(96 + i, None, "y") for i in range(2)], "sample_id long, length long, part_of string")
    r = batches.seqlen_partition(batches.global_batches(df, 32), 4).collect()
    assert sorted(x.sample_id for x in r) == list(range(96))
    for g in range(3):
        sizes = [sum(1 for x in r if x.global_batch == g and x.part == p) for p in range(4)]
        assert sizes == [8] * 4
    with pytest.raises(ValueError, match="share equally"):
        batches.seqlen_partition(batches.global_batches(df, 30), 4)
    with pytest.raises(ValueError, match="at most"):
        batches.seqlen_partition(batches.global_batches(df, 32), 4, most=10)
    assert batches.seqlen_partition(batches.global_batches(df.limit(0), 32), 4).collect() == []


def test_last_batch_takes_what_is_left(spark):
    rnd = random.Random(5)
    for n in (1, 5, 7):
        df = spark.createDataFrame([(i, rnd.randint(1, 4000)) for i in range(16 + n)], "sample_id long, length long")
        r = batches.seqlen_partition(batches.global_batches(df, 8), 2).collect()
        assert sorted(x.sample_id for x in r) == list(range(16 + n))
        sizes = [[sum(1 for x in r if x.global_batch == g and x.part == p) for p in (0, 1)] for g in range(3)]
        assert sizes[:2] == [[4, 4]] * 2 and sorted(sizes[2]) == [n // 2, n - n // 2]


def test_token_cap_is_never_exceeded(spark):
    rnd = random.Random(9)
    opened = 0
    for _ in range(200):
        cap = rnd.choice([10, 17, 100])
        lengths = [rnd.randint(0, cap) for _ in range(rnd.randint(1, 25))]
        at = batches.packed_batches(lengths, cap)
        sums = [sum(x for x, b in zip(lengths, at) if b == j) for j in range(max(at) + 1)]
        assert max(sums) <= cap and len(sums) <= len(lengths) and all(j in at for j in range(len(sums)))
        opened += len(sums) > -(-sum(lengths) // cap)
    assert opened > 20  # the cap bites: batches beyond the least number
    df = spark.createDataFrame([(0, 6), (1, 6), (2, 6), (3, 0)], "sample_id long, length long")
    r = batches.token_budget_batches(batches.global_batches(df, 4), 10).collect()
    assert sorted(x.length for x in r) == [0, 6, 6, 6] and len({x.batch for x in r if x.length}) == 3
    with pytest.raises(ValueError, match="more than a batch"):
        batches.token_budget_batches(batches.global_batches(df, 4), 5)


def test_concat_turns_reports_a_gap(spark):
    df = spark.createDataFrame([(1, 0, "user", "a b", 0.0), (1, 2, "assistant", "c", 1.0)], "traj_id long, turn long, role string, text string, score double")
    with pytest.raises(Exception, match="missing turn"):
        batches.concat_turns(df).collect()


def test_align_uid_rejects_unknown(spark):
    p = spark.createDataFrame([(1, "x")], "uid long, prompt string")
    assert r.align_uid(p, spark.createDataFrame([(1, 5), (1, 6)], "uid long, n long")).count() == 2
    with pytest.raises(Exception, match="unknown uid"):
        r.align_uid(p, spark.createDataFrame([(2, 5)], "uid long, n long")).collect()


def test_majority_of_small_and_large_groups_is_drawn_alike(spark, monkeypatch):
    rows = [("s", p, i * 3 + 1, float(i % 7), str(i % 3)) for p, n in ((0, 9), (1, 40), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "source string, prompt long, response_id long, value double, pred string")
    written, kept = [], batches.materialize

    def write(x):
        out = kept(x)
        written.append(out.count())
        return out
    monkeypatch.setattr(batches, "materialize", write)

    def rows_of():
        return {(x.prompt, x.n): (round(x.maj_mean, 9), round(x.maj_std, 9)) for x in batches.majority(df, 3, "m").collect()}
    held = rows_of()
    assert written == [2] and len(held) == 4 + 6  # only the sizes of groups are written
    monkeypatch.setattr(batches, "HELD", 20)
    assert rows_of() == held
