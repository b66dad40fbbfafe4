"""Streams whose files cut through episodes, against the batch result."""

from wayfold.operators import graph as g
from wayfold.plans.files import arrivals
from wayfold.streaming import incremental as inc

SCHEMA = "traj_id long, turn long, scene_id string, state string, action string"


def test_split_episodes_give_the_whole_graph(spark, tmp_path):
    rows = [(t, n, f"scene{t % 2}", f"s{(t * 5 + n * n) % 17}", None if n % 6 == 5 else f"a{n % 3}") for t in range(5) for n in range(11)]
    steps = spark.createDataFrame(rows, SCHEMA)
    source = str(tmp_path / "in")
    for part in (2, 0, 3, 1):  # turns come interleaved and out of order
        steps.filter(g.F.col("turn") % 4 == part).coalesce(1).write.mode("append").parquet(source)
    steps.filter("turn = 3").coalesce(1).write.mode("append").parquet(source)  # sent again
    nodes, edges = inc.stream_graph_upsert(spark, source, SCHEMA, str(tmp_path / "out"), files_per_batch=1)
    tr = g.extract_transitions(steps)
    want = g.edges_shorter_wins(g.raw_edges(tr))
    assert {(r.src, r.dst, r.n_actions) for r in edges.collect()} == {(r.src, r.dst, r.n_actions) for r in want.collect()}
    assert len(list((tmp_path / "out" / "_border").glob("version=*"))) == 2


def test_only_borders_of_runs_are_carried(spark):
    rows = [(1, n, "s", f"x{n}", "a") for n in (0, 1, 2, 3, 7, 8, 9)]
    steps = spark.createDataFrame(rows, SCHEMA)
    _, border = inc.with_border(steps, None)
    assert sorted(r.turn for r in border.collect()) == [3, 7, 9]
    later = spark.createDataFrame([(1, n, "s", f"x{n}", "a") for n in (4, 5, 6)] + [(2, 4, "s", "y", "a")], SCHEMA)
    mine, border = inc.with_border(later, border)
    assert sorted((r.traj_id, r.turn) for r in border.collect()) == [(1, 9), (2, 4)]
    assert sorted(r.turn for r in mine.filter("traj_id = 1").collect()) == [3, 4, 5, 6, 7, 9]


EPISODES = "task string, sample_id long, success boolean, cumulative_reward double, num_turns long, finish_reason string"


def test_runs_double():
    assert [inc.runs(n) for n in range(5)] == [[], [(0, 0)], [(0, 1)], [(0, 1), (2, 2)], [(0, 3)]]


def test_summary_counts_a_sample_once_and_keeps_few_folders(spark, tmp_path):
    source, target = str(tmp_path / "in"), tmp_path / "out"

    def send(ids):
        rows = [("t" if i % 2 else None, i, i % 3 == 0, 1.0, 2, "error" if i % 5 == 0 else "stop") for i in ids]
        spark.createDataFrame(rows, EPISODES).coalesce(1).write.mode("append").parquet(source)
    for n in range(6):
        send([*range(2 * n, 2 * n + 4), 2 * n])  # half of each file was sent before, one id twice
    first = {r.tag: tuple(r) for r in inc.stream_rollout_summary(spark, source, EPISODES, str(target), 1).collect()}
    assert first["all"][1] == 14 and first["t"][1] == 7 and first[None][1] == 7
    assert first["all"][5] == sum(i % 5 == 0 for i in range(14))
    for _ in range(5):
        send(range(14))
    again = {r.tag: tuple(r) for r in inc.stream_rollout_summary(spark, source, EPISODES, str(target), 1).collect()}
    assert again == first
    assert sorted(p.name for p in (target / "sums").iterdir()) == ["10", "9"]
    live = {f"{a}-{b}" for n in (10, 11) for a, b in inc.runs(n)}
    assert live <= {p.name for p in (target / "seen").iterdir()} and len(list((target / "seen").iterdir())) <= 6
    ids = spark.read.parquet(*[str(target / "seen" / f"{a}-{b}") for a, b in inc.runs(11)])
    assert ids.count() == 14


def test_replayed_batch_changes_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in"), tmp_path / "out"
    for n in range(3):
        spark.createDataFrame([("t", i, True, 1.0, 2, "stop") for i in range(n, n + 3)], EPISODES).coalesce(1).write.mode("append").parquet(source)
    first = inc.stream_rollout_summary(spark, source, EPISODES, str(target), 1).collect()
    for kind in (".2.crc", "2"):  # as if the last batch had ended before its commit
        (target / "_checkpoint" / "commits" / kind).unlink()
    assert inc.stream_rollout_summary(spark, source, EPISODES, str(target), 1).collect() == first


def test_arriving_files_are_as_many_as_the_splits(spark):
    many, few = spark.range(0, 400, 1, 9), spark.range(0, 400, 1, 1)
    for df, batches, each in ((many, 2, 5), (few, 2, 2), (few, 3, 2)):
        src, got = arrivals(df, df, "id", batches)
        files = spark.read.parquet(src)
        assert got == each and files.count() == 400 and len(files.inputFiles()) == batches * each
