"""Evaluation tables, maps and points on small hand-made inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold import registry
from wayfold.operators import datasets, evaluation as ev, maps, points
from wayfold.sources import files


def test_length_thresholds(spark):
    m, d = ev.length_thresholds("0.25,15;2:0.5,30;3-5:1,30;1,60", F.col("id"))
    got = [(r.m, r.d) for r in spark.range(1, 7).select(m.alias("m"), d.alias("d")).collect()]
    assert got == [(0.25, 15.0), (0.5, 30.0), (1.0, 30.0), (1.0, 30.0), (1.0, 30.0), (1.0, 60.0)]
    with pytest.raises(ValueError):
        ev.length_thresholds("1-4:1,1;3:1,1", F.lit(1))


def test_per_turn_alignment(spark):
    rows = [(1, [1.0, 2.0], [(None, None), (True, None), (None, True)]), (2, [1.0, 2.0], [(None, True)]), (3, [], [])]
    df = spark.createDataFrame(rows, "episode_id long, rewards array<double>, infos array<struct<a:boolean,b:boolean>>")
    got = [(r.episode_id, r.turn, r.reward, r.success) for r in ev.per_turn_table(df, ["a", "b"]).orderBy("episode_id", "turn").collect()]
    assert got == [(1, 0, None, False), (1, 1, 1.0, True), (1, 2, 2.0, True), (2, 0, None, True), (2, 1, 1.0, True), (2, 2, 2.0, False)]


def test_pose_errors(spark):
    names = [f"{s}_{a}" for s in "ab" for a in ("tx", "ty", "tz", "rx", "ry", "rz")]
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 3.0, 4.0, 0.0, 0.0, 0.0, 90.0), (2, *[0.0] * 6, 0.0, 0.0, 1.0, 180.0, 0.0, 0.0)], ["sample_id", *names])
    got = {r.sample_id: (r.pos_err_m, r.ang_err_deg) for r in ev.pose_error_table(df).collect()}
    assert got[1] == (5.0, pytest.approx(90.0)) and got[2] == (1.0, pytest.approx(180.0))


def test_closeness_is_half_at_threshold(spark):
    r = spark.createDataFrame([(0.0, 0.5, 500.0)], "a double, b double, c double").select(*[ev.closeness(F.col(c), 0.5).alias(c) for c in "abc"]).first()
    assert tuple(r) == (1.0, 0.5, 0.0)


def test_exact_median(spark):
    rows = [("a", float(x)) for x in (1, 1, 1, 9)] + [("b", float(x)) for x in (5, 1, 3)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {r.k: r.m for r in ev.exact_median(df, ["k"], "v", "m").collect()} == {"a": 1.0, "b": 3.0}


def test_published_category_table(spark):
    labels = spark.createDataFrame([("t", "m", "GEO")] * 3 + [("t", "m", "DIR")], "task string, model string, label string")
    rates = spark.createDataFrame([("t", "m", 20.0)], "task string, model string, format_rate double")
    r = ev.coded_category_table(labels, rates, ["GEO", "DIR", "SEM"]).first()
    assert (r.GEO, r.DIR, r.SEM, r.FORMAT) == (60.0, 20.0, 0.0, 20.0)


def test_map_similarity_across_blocks(spark):
    rnd = random.Random(1)
    objs = [(1, i, rnd.random(), rnd.random(), 0, rnd.random(), rnd.random(), 0) for i in range(150)]
    df = spark.createDataFrame(objs, "map_id long, idx long, x double, y double, facing int, px double, py double, pfacing int")
    r = maps.map_similarity(df).first()

    def b(dx, dy):
        return math.floor(((math.degrees(math.atan2(dx, dy)) + 360) % 360 + 22.5) / 45) % 8
    pts = [(0.0, 0.0, 0.0, 0.0)] + [(o[2], o[3], o[5], o[6]) for o in objs]
    pairs = [(p, q) for i, p in enumerate(pts) for q in pts[i + 1:]]
    same = sum(b(p[0] - q[0], p[1] - q[1]) == b(p[2] - q[2], p[3] - q[3]) for p, q in pairs)
    assert r.dir == pytest.approx(same / len(pairs)) and r.facing == 1.0


def test_perfect_map(spark):
    df = spark.createDataFrame([(1, i, float(i), 1.0, None, float(i), 1.0, None) for i in range(3)], "map_id long, idx long, x double, y double, facing int, px double, py double, pfacing int")
    r = maps.map_similarity(df).first()
    assert (r.dir, r.facing, r.pos, r.overall) == (1.0, 1.0, 1.0, 1.0)


def test_nearest_distance_far_and_missing(spark):
    p = spark.createDataFrame([(1, 0, 0), (1, 100, 3), (2, 0, 0)], "grp long, x long, y long")
    e = spark.createDataFrame([(1, 0, 0), (1, 60, 0)], "grp long, x long, y long")
    got = {(r.grp, r.x): r.distance for r in maps.nearest_distance(p, e).collect()}
    assert got == {(1, 0): 0.0, (1, 100): pytest.approx(math.hypot(40, 3)), (2, 0): math.inf}


def test_carry_forward_series(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 5.0), (2, 0, 10.0)], "series_id long, turn long, value double")
    assert [r["mean"] for r in maps.average_series(df).orderBy("turn").collect()] == [5.5, 3.0, 5.0]
    assert [r["mean"] for r in maps.average_series(df, carry=True).orderBy("turn").collect()] == [5.5, 6.5, 7.5]


def test_p_values(spark):
    # reference values of the t distribution: t = 2.228 is the 5 % point at 10 degrees of freedom
    df = spark.createDataFrame([(2.228138851964939, 12), (0.0, 12), (12.706204736432095, 3)], "t double, n long")
    assert [r.p for r in df.select(maps.t_test_p()("t", "n").alias("p")).collect()] == [pytest.approx(0.05, abs=1e-6), 1.0, pytest.approx(0.05, abs=1e-6)]


def test_visibility_equals_all_pairs(spark):
    rnd = random.Random(2)
    pts = [(f"s{i % 2}", i, *[rnd.uniform(-1, 1) for _ in range(3)]) for i in range(160)]
    cams = [(i, f"s{i % 2}", *[rnd.uniform(-1, 1) for _ in range(3)], *[rnd.uniform(-180, 180) for _ in range(3)]) for i in range(12)]
    p = spark.createDataFrame(pts, "scene_id string, vid long, x double, y double, z double")
    c = spark.createDataFrame(cams, "cam_id long, scene_id string, tx double, ty double, tz double, rx double, ry double, rz double")
    fine, coarse = [{(r.cam_id, r.vid) for r in points.visible_points(c, p, 64, 48, 40.0, cell=s).collect()} for s in (0.2, 100.0)]
    assert fine == coarse and fine


def walks(spark):
    rows = [("s", i, ["a", "b", "c"], [x, y]) for i, (x, y) in enumerate([("u", "v"), ("u | v", "w"), ("u | v", "x | y"), ("w", "w"), ("x", "u | w")])]
    return spark.createDataFrame(rows, "scene_id string, walk long, nodes array<string>, actions array<string>")


def test_ratio_allocation_spills(spark):
    w = walks(spark)
    got = datasets.ratio_allocate(w, "1:1:1", 4, "r").groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"single": 2, "mix": 1, "multi": 1}
    only = datasets.ratio_allocate(w, "1:0:0", 4, "r").collect()
    assert {r.kind for r in only} == {"single"} and len(only) == 2
    full = datasets.ratio_allocate(w, "0:0:1", 5, "r").collect()
    assert [r.kind for r in full] == ["multi"]


def test_balanced_select_respects_share(spark):
    kinds = [f"a{i}" for i in range(8)]
    rows = [("s", i, ["n"], [" | ".join(kinds)]) for i in range(3)] + [("s", 10 + i, ["n"], ["a0"]) for i in range(20)]
    w = spark.createDataFrame(rows, "scene_id string, walk long, nodes array<string>, actions array<string>")
    got = datasets.balanced_select(w, 3, "b", max_share=0.2).collect()
    assert {r.walk for r in got} == {0, 1, 2}


@pytest.mark.parametrize("folded", [3, 10_000])
def test_balanced_select_against_a_plain_loop(spark, monkeypatch, folded):
    rng, target, share = random.Random(1), 6, 0.3
    rows = [(s, i, ["n"], [" | ".join(rng.choice("aaaabbcdefgh") for _ in range(rng.randrange(1, 5)))]) for s in ("p", "q") for i in range(40)] + [("few", 1, ["n"], ["a"])]
    w = spark.createDataFrame(rows, "scene_id string, walk long, nodes array<string>, actions array<string>")
    order = datasets.rarity(w).withColumn("tie", datasets.hash_of("b", "scene_id", "walk")).collect()
    want = set()
    for scene in ("p", "q", "few"):
        used, total, first, rest = {}, 0, [], []
        for r in sorted((r for r in order if r.scene_id == scene), key=lambda r: (-r.rarity, r.tie, r.walk)):
            n = total + sum(r.counts.values())
            if len(first) < target and all((used.get(a, 0) + c) / n <= share for a, c in r.counts.items()):
                first, total, used = [*first, r.walk], n, {a: used.get(a, 0) + r.counts.get(a, 0) for a in {*used, *r.counts}}
            else:
                rest.append(r.walk)
        want |= {(scene, walk, k) for k, walk in enumerate((first + rest)[:target], 1)}
    monkeypatch.setattr(datasets, "FOLDED", folded)
    got = datasets.balanced_select(w, target, "b", share)
    assert {(r.scene_id, r.walk, r.pick) for r in got.collect()} == want
    assert datasets.balanced_select(w.limit(0), target, "b").count() == 0


def test_displacement(spark):
    df = spark.createDataFrame([(["move_forward", "move_forward", "turn_left"],)], "a array<string>")
    assert df.select(datasets.displacement(F.col("a"))).first()[0] == "2,0,0,-1,0,0"


def test_env_specs(spark):
    schema = "spec_id long, name string, n_envs long, seed array<long>, seed_list array<long>"
    got = files.expand_env_specs(spark.createDataFrame([(1, "a", 6, [0, 2, 2], None), (2, "b", 2, None, [7, 8, 9])], schema), 1).collect()
    seeds = sorted(r.env_seed for r in got if r.spec_id == 1)
    assert seeds == [0, 0, 1, 1, 2, 2] and [r.env_seed for r in got if r.spec_id == 2] == [7, 8]
    with pytest.raises(Exception, match="too few seeds"):
        files.expand_env_specs(spark.createDataFrame([(1, "a", 7, [0, 2, 2], None)], schema), 1).collect()
    with pytest.raises(Exception, match="too short"):
        files.expand_env_specs(spark.createDataFrame([(1, "a", 2, None, [1, 2])], schema), 1).collect()


def test_cameras_descend_to_visible_cells_only(spark):
    plane = spark.range(90_000).select(F.lit("s").alias("scene_id"), (F.col("id") % 300 - 77.5).alias("x"), (F.floor(F.col("id") / 300) - 33.5).alias("y"), F.lit(4.0).alias("z"))
    pyramid, top = points.cell_pyramid(plane.unionByName(spark.createDataFrame([("t", 0.0, 0.0, 0.0)], plane.schema)), 1.0)
    cams = spark.createDataFrame([(i, "s", 25.0 * i, 10.0 * i) for i in range(4)], "cam_id long, scene_id string, tx double, ty double")
    sees = (F.abs(F.col("mx") - F.col("tx")) <= 3 + F.col("rad")) & (F.abs(F.col("my") - F.col("ty")) <= 3 + F.col("rad"))
    levels = [x.count() for x in points.descend(cams, pyramid, top, sees)]
    fine = points.descend(cams, pyramid, top, sees)[-1].select("cam_id", "gx", "gy", "gz").collect()
    flat = cams.join(pyramid.filter("level = 0"), "scene_id").filter(sees).select("cam_id", "gx", "gy", "gz").collect()
    assert sorted(fine) == sorted(flat) and 100 < len(fine) < 300
    assert levels[0] <= 8 * 4 and sum(levels) < 2 * len(fine)


def test_capped_seeds_of_a_wide_range(spark):
    schema = "spec_id long, name string, n_envs long, seed array<long>, seed_list array<long>"
    wide = files.expand_env_specs(spark.createDataFrame([(i, "a", 5, [0, 2**31, 1], None) for i in range(50)], schema), 3)
    got = [r.env_seed for r in wide.collect()]
    assert len(got) == 250 and all(0 <= x <= 2**31 for x in got) and len(set(got)) > 240
    assert 0.4 < sum(x < 2**30 for x in got) / 250 < 0.6
    for n in (1, 2, 3, 7, 64, 101):
        df = spark.range(n).select(files.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_log_and_dump_layouts(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "12.jsonl").write_text('{"input": "a", "output": "b", "score": 0.5}\n\n{"input": \n{"input": "c", "score": 1}\n')
    got = [(r.step, r.line, r.input, r.score) for r in files.scan_rollout_jsonl(spark, str(tmp_path / "logs")).orderBy("line").collect()]
    assert got == [(12, 0, "a", 0.5), (12, 3, "c", 1.0)]
    for name, body in (("r1", '{"success": true, "num_turns": 3,\n "rewards": [1.0]}'), ("r2", "{broken")):
        d = tmp_path / "dump" / "m1" / "tag_easy" / name
        d.mkdir(parents=True)
        (d / "metrics.json").write_text(body)
    got = [(r.model, r.task, r.rollout_id, r.success, r.num_turns) for r in files.scan_eval_dump(spark, str(tmp_path / "dump")).collect()]
    assert got == [("m1", "easy", "r1", True, 3)]


def test_write_needs_one_record(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_sft_datasets({"a": spark.createDataFrame([], "messages array<string>")}, str(tmp_path))


def test_registry_rejects_other_function():
    def f(x):
        return x
    registry.register("metric", "mine")(f)
    registry.register("metric", "mine")(f)
    with pytest.raises(ValueError, match="already"):
        registry.register("metric", "mine")(lambda x: x)
    assert registry.get("metric", "mine") is f and "grpo" in registry.names("advantage")


def test_per_turn_stats_do_not_depend_on_the_order(spark):
    rnd = random.Random(4)
    rows = [(i % 3, rnd.choice([0.12345, 0.12335, rnd.random(), None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "turn long, value double")
    got = [sorted(map(tuple, ev.per_turn_stats(df.repartition(n, F.xxhash64("value", F.lit(n)))).collect())) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]


def test_maps_of_one_block_are_written_once(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(m, i, *[rnd.uniform(-3, 3) for _ in range(4)], 1, 1) for m, n in ((0, 5), (1, 63), (2, 64), (3, 130)) for i in range(n)]
    df = spark.createDataFrame(rows, "map_id long, idx long, x double, y double, px double, py double, facing long, pfacing long")
    written, kept = [], maps.materialize

    def write(x):
        out = kept(x)
        written.append(out.count())
        return out
    monkeypatch.setattr(maps, "materialize", write)
    got = {r.map_id: r.dir for r in maps.map_similarity(df).collect()}
    assert written == [1 + 1 + 2 + 3]  # blocks, no objects

    def sector(a, b):
        return int(((math.degrees(math.atan2(a, b)) + 360) % 360 + 22.5) // 45) % 8
    for m in range(4):
        o = [(0.0, 0.0, 0.0, 0.0)] + [r[2:6] for r in rows if r[0] == m]
        ok = [sector(a[0] - b[0], a[1] - b[1]) == sector(a[2] - b[2], a[3] - b[3]) for i, a in enumerate(o) for b in o[i + 1:]]
        assert got[m] == pytest.approx(sum(ok) / len(ok))


def test_factor_correlation_equals_plain_ranks(spark):
    n, shares = 3000, {"pos_dist": 7, "rot_dist": 1, "unified_dist": 1000, "horiz_dist": 3000}
    x = spark.range(n).select(F.col("id").alias("sample_id"), *[((F.col("id") * 7919) % shares.get(c, 50) - 3.0 * (c == "pos_dist")).alias(c) for c in ev.FACTORS])
    x = x.withColumn("height_diff", F.when(F.col("sample_id") % 3 == 0, F.lit(float("nan"))).when(F.col("sample_id") % 3 == 1, F.col("height_diff")))
    e = spark.range(n).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("m"), F.col("id") % 2)).alias("model"), F.when(F.col("id") < 5, "few").otherwise("many").alias("task"),
                              F.when(F.col("id") % 11 > 0, (F.col("id") * 31) % 97 < 40).alias("success"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.model, r.task, r.factor): (r.n, r.rho) for r in ev.factor_correlation(e, x).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    d = e.join(x, "sample_id").toPandas()
    d["s"] = d.success.eq(True).astype(float)
    seen = 0
    for (model, task), g in d.groupby(["model", "task"], dropna=False):
        for f in ev.FACTORS:
            h = g[g[f].notna()]
            if len(h):
                rx, rs = h[f].rank(), h.s.rank()
                want = 0.0 if len(h) < 10 or rx.std() == 0 or rs.std() == 0 else rx.corr(rs)
                have = got[None if model != model else model, task, f]
                assert have[0] == len(h) and abs(have[1] - want) < 1e-9, (model, task, f)
                seen += 1
    assert seen == len(got)


def test_equal_values_are_one_row_before_the_sort(spark):
    x = spark.range(0, 20_000, 1, 2).select(F.lit(0).cast("long").alias("g"), (F.col("id") % 2).alias("s"), *[F.lit(1.5).alias(c) for c in ev.FACTORS])
    counts = ev._value_counts(x).collect()
    assert len(counts) <= 4 * len(ev.FACTORS) and sum(r.k for r in counts) == 20_000 * len(ev.FACTORS) and sum(r.hits for r in counts) == 10_000 * len(ev.FACTORS)
