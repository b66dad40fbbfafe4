"""Supervised records from sampled walks: negatives, selection and the record generators.

A walk row is ``(scene_id, walk, nodes, actions)``; ``annotate`` adds the nodes' images and
states.  The wording of a record is a template parameter with a short default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.ordering import hash_int, hash_of, hash_ranked, ranked
from wayfold.operators.graph import atoms
from wayfold.session import materialize
from wayfold.sources.tables import ACTIONS

WALK = ["scene_id", "walk"]
LETTERS = "ABCD"
# The axis each atomic action moves along, as (plus, minus) pairs.
AXES = [("move_forward", "move_backward"), ("move_right", "move_left"), ("move_up", "move_down"), ("turn_right", "turn_left"), ("look_up", "look_down"), ("rotate_cw", "rotate_ccw")]
#: Candidate walks of one scene that one round of a selection folds over.
FOLDED = 10_000
MAX_ACTION_SHARE = 0.15
PROMPTS = {
    "action_gen": "Name the actions that lead from the first view to the second.",
    "path_to_view": "Pick the view that results from the actions.",
    "multi_turn": "Walk to the target view step by step.",
    "multi_turn_mcq": "Pick the action sequence that leads to the target view.",
    "view_difference": "Count the actions between the two views.",
    "forward_state": "Give the state after the actions.",
    "inverse_edge": "Give the action between the two states.",
    "goal_reach": "Reach the goal state.",
}
#: Pieces of the user turns of the text-graph records.
TURNS = {"now": "You are here:\n", "plan": "\n\nYou will do: ", "which": "\n\nWhere do you end up?\n", "before": "Seen first:\n", "after": "\n\nSeen then:\n",
         "target": "\n\nYou want to be here:\n", "done": "You did '", "led": "' and are here now:\n", "next": "\n\nWhat do you do next?"}


def msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def at(col: str, i: int) -> Column:
    """Element from the front (0, 1, ...) or the back (-1, ...)."""
    return F.try_element_at(F.col(col), F.lit(i + 1 if i >= 0 else i))


def annotate(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add the image (null if none) and state of every node of a walk."""
    x = walks.select(*WALK, F.posexplode("nodes").alias("pos", "id")).join(nodes.select("id", "image", "state"), "id")
    g = x.groupBy(*WALK).agg(F.array_sort(F.collect_list(F.struct("pos", "image", "state"))).alias("_a"))
    return walks.join(g, WALK).select("*", F.transform("_a", lambda a: a["image"]).alias("images"), F.transform("_a", lambda a: a["state"]).alias("states")).drop("_a")


def concat_actions() -> Column:
    return F.array_join("actions", " | ")


# --- selection -----------------------------------------------------------------------------
def rarity(walks: DataFrame) -> DataFrame:
    """Rarity score per walk: each atomic action counts total / its frequency within the scene's candidates."""
    a = walks.select(*WALK, F.explode(atoms(concat_actions())).alias("a")).groupBy(*WALK, "a").agg(F.count(F.lit(1)).alias("c"))
    g = a.groupBy("scene_id", "a").agg(F.sum("c").alias("g"))
    total = g.groupBy("scene_id").agg(F.sum("g").alias("total"))
    s = a.join(g, ["scene_id", "a"]).join(total, "scene_id").groupBy(*WALK).agg(F.sum(F.col("c") * F.col("total") / F.col("g")).alias("rarity"),
                                                                             F.map_from_entries(F.collect_list(F.struct("a", "c"))).alias("counts"))
    return s.withColumn("rarity", F.round("rarity", 9))


def balanced_select(walks: DataFrame, target: int, seed: str, max_share: float = MAX_ACTION_SHARE) -> DataFrame:
    """Per scene: greedy by rarity while no action exceeds its share of the running total, then filled up.

    The greedy pass folds over a scene's candidates in order, ``FOLDED`` a round; the action counts
    so far are carried from round to round, and scenes that have enough leave.
    """
    s = rarity(walks).withColumn("tie", hash_of(seed, *WALK))
    r = materialize(ranked(s, ["scene_id"], [F.desc("rarity"), "tie", "walk"], "rank"))
    c = F.struct("rank", "walk", F.array_sort(F.map_entries("counts")).alias("counts"))
    zero = F.lit(0).cast("long")

    def step(st, x):
        own = F.map_from_entries(x["counts"])
        n = st["n"] + F.aggregate(x["counts"], zero, lambda t, e: t + e["value"])
        fits = F.forall(x["counts"], lambda e: (F.coalesce(F.try_element_at(st["used"], e["key"]), F.lit(0)) + e["value"]) / n <= max_share)
        used = F.map_zip_with(st["used"], own, lambda k, a, b: F.coalesce(a, zero) + F.coalesce(b, zero))
        took = F.struct(used.alias("used"), n.alias("n"), (st["m"] + 1).alias("m"), F.array_append(st["walks"], x["walk"]).alias("walks"))
        return F.when(fits & (st["m"] < target), took).otherwise(st)

    none = F.array().cast(f"array<{walks.schema['walk'].dataType.simpleString()}>")
    state, taken = None, None
    for k in range(-(-(r.agg(F.max("rank")).first()[0] or 1) // FOLDED)):
        part = r.filter((F.col("rank") > k * FOLDED) & (F.col("rank") <= (k + 1) * FOLDED)).groupBy("scene_id").agg(F.array_sort(F.collect_list(c)).alias("cs"))
        if state is None:
            part = part.select("*", F.create_map().cast("map<string,bigint>").alias("used"), zero.alias("n"), zero.alias("m"))
        else:
            part = part.join(state.filter(F.col("m") < target).select("scene_id", "used", "n", "m"), "scene_id")
        start = F.struct("used", "n", "m", none.alias("walks"))
        state = materialize(part.select("scene_id", F.aggregate("cs", start, step).alias("st")).select("scene_id", "st.*"))
        won = state.select("scene_id", F.explode("walks").alias("walk"), F.lit(True).alias("took"))
        taken = won if taken is None else taken.unionByName(won)
        if not state.filter(F.col("m") < target).take(1):
            break
    # the fill-up ends within the first 2 * target ranks, so a scene brings few rows to the window
    g = r.select(*WALK, "rarity", "rank").join(taken, WALK, "left").filter((F.col("rank") <= 2 * target) | F.col("took"))
    w = Window.partitionBy("scene_id").orderBy(F.col("took").isNull(), "rank")
    g = g.withColumn("pick", F.row_number().over(w).cast("long")).filter(F.col("pick") <= target)
    return walks.join(g.select(*WALK, "pick", "rarity"), WALK)


def path_kind() -> Column:
    """single, multi or mix by the number of atomic actions per edge."""
    one = F.transform("actions", lambda a: F.size(atoms(a)) == 1)
    return F.when(F.forall(one, lambda x: x), "single").when(F.exists(one, lambda x: x), "mix").otherwise("multi")


def ratio_allocate(walks: DataFrame, ratio: str, target: int, seed: str) -> DataFrame:
    """Quotas ``A:B:C`` for single, mix and multi walks of a scene.

    A zero excludes its bucket.  The rounding rest goes to the first admitted bucket;
    shortfalls move forward to the next, the final rest backward to whoever has some left.
    """
    kinds = ("single", "mix", "multi")
    parts = [int(x) for x in ratio.split(":")]
    if len(parts) != 3 or min(parts) < 0 or sum(parts) == 0:
        raise ValueError(f"invalid ratio {ratio!r}, expected 'A:B:C'")
    quota = {k: target * p // sum(parts) for k, p in zip(kinds, parts)}
    order = [k for k, p in zip(kinds, parts) if p > 0]
    quota[order[0]] += target - sum(quota.values())
    w = walks.withColumn("kind", path_kind())
    g = w.groupBy("scene_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    spill = F.lit(0)
    for k in order:
        want = F.lit(quota[k]) + spill
        g = g.withColumn(f"q_{k}", F.least(F.col(k), want))
        g = g.withColumn(f"s_{k}", F.greatest(want - F.col(k), F.lit(0)))
        spill = F.col(f"s_{k}")
    for k in reversed(order):
        more = F.least(F.col(k) - F.col(f"q_{k}"), spill)
        g = g.withColumn(f"m_{k}", more).withColumn(f"r_{k}", spill - F.col(f"m_{k}"))
        spill = F.col(f"r_{k}")
    quotas = g.select("scene_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(f"q_{k}") + F.col(f"m_{k}")).alias("quota")) for k in order])))
    r = hash_ranked(w.join(quotas, ["scene_id", "kind"]), ["scene_id", "kind"], seed, WALK, "pick")
    return r.filter(F.col("pick") <= F.col("quota"))


def bucket_even_sample(items: DataFrame, bucket: str, target: int, seed: str) -> DataFrame:
    """Per scene: target // buckets items of each bucket (at least one), leftovers in random order up to the target."""
    b = items.groupBy("scene_id").agg(F.countDistinct(bucket).alias("_b")).withColumn("_per", F.greatest(F.lit(1), F.floor(F.lit(target) / F.col("_b")))).drop("_b")
    r = hash_ranked(items, ["scene_id", bucket], seed, WALK, "_k").join(b, "scene_id")
    r = r.withColumn("_late", (F.col("_k") > F.col("_per")).cast("int"))
    early = r.filter("_late = 0").groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
    late = hash_ranked(r.filter("_late = 1"), ["scene_id"], seed, WALK, "_j").join(early, "scene_id").filter(F.col("_j") <= F.lit(target) - F.col("_n"))
    first = r.filter("_late = 0").join(early, "scene_id")
    over = Window.partitionBy("scene_id").orderBy(bucket, "_k", "walk")  # at most target + buckets rows per scene
    first = first.withColumn("_j", F.row_number().over(over)).filter(F.col("_j") <= target)
    cols = items.columns
    return first.select(*cols).unionByName(late.select(*cols))


# --- negatives -----------------------------------------------------------------------------
def sample_negative_nodes(walks: DataFrame, nodes: DataFrame, n: int, seed: str) -> DataFrame:
    """n random nodes with an image of the same scene per walk, the endpoints excluded: adds ``negatives`` ids.

    The scene's nodes are hash-ranked once; a walk reads n + 2 consecutive ranks from a random
    start, which always leaves n after removing two endpoints.  Nothing meets the whole scene.
    """
    k = hash_ranked(nodes.filter("image IS NOT NULL").select("scene_id", "id"), ["scene_id"], seed, ["id"], "k")
    size = k.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_n"))
    w = walks.join(size, "scene_id").withColumn("_r", hash_int(hash_of(seed, *WALK)) % F.col("_n"))
    c = w.select(*WALK, "_r", "_n", F.element_at("nodes", 1).alias("a"), F.element_at("nodes", -1).alias("b"), F.posexplode(F.sequence(F.lit(0), F.least(F.lit(n + 1), (F.col("_n") - 1).cast("int")))).alias("j", "off"))
    c = c.withColumn("k", (F.col("_r") + F.col("off")) % F.col("_n") + 1).join(k, ["scene_id", "k"]).filter("id <> a AND id <> b")
    g = c.groupBy(*WALK).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("j", "id"))), lambda x: x["id"]), 1, n).alias("negatives"))
    return walks.join(g, WALK, "left").withColumn("negatives", F.coalesce("negatives", F.array().cast("array<string>")))


def displacement(actions: Column) -> Column:
    """Net movement of an atomic action list along the six axes, as text."""
    def n(name):
        return F.size(F.filter(actions, lambda a: a == name))
    return F.concat_ws(",", *[(n(p) - n(m)).cast("string") for p, m in AXES])


def sample_negative_actions(walks: DataFrame, n: int, seed: str, trials: int = 20) -> DataFrame:
    """n action lists of the same length whose net displacement differs from the truth and from each other."""
    w = walks.withColumn("_gt", atoms(concat_actions()))
    c = w.select(*WALK, "_gt", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    vocab = F.array(*[F.lit(a) for a in ACTIONS])
    c = c.withColumn("cand", F.transform("_gt", lambda a, i: F.get(vocab, (hash_int(hash_of(seed, *WALK, "trial", i)) % len(ACTIONS)).cast("int"))))
    c = c.withColumn("d", displacement(F.col("cand"))).filter(F.col("d") != displacement(F.col("_gt")))
    c = c.groupBy(*WALK, "d").agg(F.min(F.struct("trial", "cand")).alias("c"))
    g = c.groupBy(*WALK).agg(F.slice(F.transform(F.array_sort(F.collect_list("c")), lambda x: F.array_join(x["cand"], " | ")), 1, n).alias("negatives"))
    return walks.join(g, WALK, "left").withColumn("negatives", F.coalesce("negatives", F.array().cast("array<string>")))


def negative_numbers(gold: Column, n: int, hi: Column, seed: str) -> Column:
    """n distinct wrong counts in [1, hi] in random order."""
    wrong = F.filter(F.sequence(F.lit(1), hi.cast("int")), lambda x: x != gold)
    return F.slice(F.transform(F.array_sort(F.transform(wrong, lambda x: F.struct(hash_of(seed, *WALK, x).alias("h"), x.alias("x")))), lambda s: s["x"].cast("string")), 1, n)


def with_options(df: DataFrame, right: Column, seed: str) -> DataFrame:
    """Insert the right option among three ``negatives`` at a hash-chosen slot: adds ``options`` and ``letter``."""
    slot = (hash_int(hash_of(seed, *WALK)) % 4).cast("int")
    d = df.filter(F.size("negatives") >= 3).withColumn("_slot", slot)
    return d.withColumn("options", F.array_insert("negatives", F.col("_slot") + 1, right)).withColumn("letter", F.substring(F.lit(LETTERS), F.col("_slot") + 1, F.lit(1))).drop("_slot")


def lettered() -> Column:
    return F.array_join(F.transform("options", lambda o, i: F.concat(F.substring(F.lit(LETTERS), i + 1, F.lit(1)), F.lit(". "), o)), "\n")


# --- generators ----------------------------------------------------------------------------
def _record(df: DataFrame, messages: Column, images: Column | None = None) -> DataFrame:
    img = images if images is not None else F.array().cast("array<string>")
    return df.select(*WALK, messages.alias("messages"), img.alias("images"))


def _answer(value: Column) -> Column:
    return msg("assistant", text("<action>answer(", value, ")</action>"))


def _ends_shown() -> Column:
    return at("images", 0).isNotNull() & at("images", -1).isNotNull()


def gen_action_gen(walks: DataFrame) -> DataFrame:
    """First and last view -> the concatenated actions."""
    w = walks.filter(_ends_shown())
    user = F.lit("From <image> to <image>: which actions?")
    return _record(w, F.array(msg("system", F.lit(PROMPTS["action_gen"])), msg("user", user), msg("assistant", text("<action>", concat_actions(), "</action>"))), F.array(at("images", 0), at("images", -1)))


def gen_path_to_view(walks: DataFrame, nodes: DataFrame, seed: str) -> DataFrame:
    """Four-way choice of the resulting view; the wrong views come from the same scene, which needs four nodes."""
    big = nodes.groupBy("scene_id").agg(F.count(F.lit(1)).alias("_c")).filter("_c >= 4").select("scene_id")
    w = sample_negative_nodes(walks.filter(_ends_shown()).join(big, "scene_id", "left_semi"), nodes, 3, seed)
    w = with_options(w.withColumn("_right", F.element_at("nodes", -1)), F.col("_right"), seed)
    img = nodes.select("id", F.col("image").alias("_img"))
    o = w.select(*WALK, F.posexplode("options").alias("p", "id")).join(img, "id").groupBy(*WALK).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "_img"))), lambda x: x["_img"]).alias("_shown"))
    w = w.join(o, WALK)
    user = text("From <image> do [", concat_actions(), "]. Which view results?\nA. <image>\nB. <image>\nC. <image>\nD. <image>")
    return _record(w, F.array(msg("system", F.lit(PROMPTS["path_to_view"])), msg("user", user), _answer(F.col("letter"))), F.concat(F.array(at("images", 0)), F.col("_shown")))


def _step(i: Column) -> Column:
    n = F.size("actions") + 1
    return text("Step ", i.cast("string"), "/", n.cast("string"))


def gen_multi_turn(walks: DataFrame, mcq_share: float = 0.0, seed: str = "mix") -> DataFrame:
    """Dialogue along the walk, ending with the target state as the answer; all nodes need images.

    With ``mcq_share`` a turn before the last becomes, by hash, a choice between the action and
    two others.
    """
    w = walks.filter(F.forall("images", lambda x: x.isNotNull()))

    def ask(i, body):
        if not mcq_share:
            return body, text("<action>", F.get("actions", i), "</action>")
        h = hash_int(hash_of(seed, *WALK, i))
        chosen = (h % 1000) < int(mcq_share * 1000)
        truth = F.get("actions", i)
        others = F.filter(F.array(*[F.lit(a) for a in ACTIONS]), lambda a: a != truth)
        n = F.size(others)
        k = F.floor(h / 1000)
        wrong = [F.get(others, (k % n).cast("int")), F.get(others, ((k + 5) % n).cast("int"))]
        slot = F.floor(h / 65536) % 3
        opts = [F.when(slot == 0, truth).otherwise(wrong[0]), F.when(slot == 1, truth).when(slot == 0, wrong[0]).otherwise(wrong[1]), F.when(slot == 2, truth).otherwise(wrong[1])]
        choice = text(body, "\nA. ", opts[0], "\nB. ", opts[1], "\nC. ", opts[2])
        letter = F.substring(F.lit(LETTERS), (slot + 1).cast("int"), F.lit(1))
        return F.when(chosen, choice).otherwise(body), F.when(chosen, text("<action>answer(", letter, ")</action>")).otherwise(text("<action>", truth, "</action>"))

    def turn(a, i):
        first = text("Scene ", F.col("scene_id"), ": from <image> to <image>.\n", F.get("states", i), "\n", _step(i + 1))
        later = text("format: ok\n", F.get("states", i), "\n<image>\n", _step(i + 1))
        q, reply = ask(i, F.when(i == 0, first).otherwise(later))
        return F.array(msg("user", q), msg("assistant", reply))
    n = F.size("actions")
    last = F.array(msg("user", text("format: ok\n", at("states", -1), "\n<image>\n", _step(n + 1))), _answer(at("states", -1)))
    messages = F.concat(F.array(msg("system", F.lit(PROMPTS["multi_turn"]))), F.flatten(F.transform("actions", turn)), last)
    images = F.concat(F.array(at("images", 0), at("images", -1)), F.slice("images", F.lit(2), n))
    return _record(w, messages, images)


def gen_multi_turn_mcq(walks: DataFrame, seed: str) -> DataFrame:
    """Four-way choice of the action sequence between the end views."""
    w = with_options(sample_negative_actions(walks.filter(_ends_shown()), 3, seed), concat_actions(), seed)
    user = text("From <image> to <image>: which sequence?\n", lettered())
    return _record(w, F.array(msg("system", F.lit(PROMPTS["multi_turn_mcq"])), msg("user", user), _answer(F.col("letter"))), F.array(at("images", 0), at("images", -1)))


def sub_walk(walks: DataFrame, seed: str) -> DataFrame:
    """Two hash-chosen positions start < end of each walk and the atomic actions between them."""
    h, n = hash_int(hash_of(seed, *WALK)), F.size("actions")
    w = walks.withColumn("_s", (h % n).cast("int")).withColumn("_e", (F.floor(h / 4096) % (n - F.col("_s"))).cast("int") + F.col("_s") + 1)
    return w.withColumn("n_steps", F.size(atoms(F.array_join(F.slice("actions", F.col("_s") + 1, F.col("_e") - F.col("_s")), " | "))))


def _pair_shown(w: DataFrame) -> DataFrame:
    return w.withColumn("_a", F.get("images", F.col("_s"))).withColumn("_b", F.get("images", F.col("_e"))).filter("_a IS NOT NULL AND _b IS NOT NULL")


def gen_view_difference(walks: DataFrame, seed: str) -> DataFrame:
    """How many atomic actions lie between two views of a walk; keeps ``n_steps`` for bucket sampling."""
    w = _pair_shown(sub_walk(walks, seed))
    m = F.array(msg("system", F.lit(PROMPTS["view_difference"])), msg("user", F.lit("How many actions from <image> to <image>?")), _answer(F.col("n_steps").cast("string")))
    return w.select(*WALK, "n_steps", m.alias("messages"), F.array("_a", "_b").alias("images"))


def gen_view_difference_mcq(walks: DataFrame, seed: str) -> DataFrame:
    """The same as a four-way choice of the number."""
    w = _pair_shown(sub_walk(walks, seed))
    hi = F.greatest(F.size(atoms(concat_actions())) + 2, F.col("n_steps") + 3)
    w = with_options(w.withColumn("negatives", negative_numbers(F.col("n_steps"), 3, hi, seed)), F.col("n_steps").cast("string"), seed)
    m = F.array(msg("system", F.lit(PROMPTS["view_difference"])), msg("user", text("How many actions from <image> to <image>?\n", lettered())), _answer(F.col("letter")))
    return w.select(*WALK, "n_steps", m.alias("messages"), F.array("_a", "_b").alias("images"))


def gen_forward_state(walks: DataFrame) -> DataFrame:
    """Text graph: state and action sequence -> final state."""
    user = text(TURNS["now"], at("states", 0), TURNS["plan"], concat_actions())
    return _record(walks, F.array(msg("system", F.lit(PROMPTS["forward_state"])), msg("user", user), msg("assistant", text("<prediction>\n", at("states", -1), "\n</prediction>"))))


def gen_forward_state_mcq(walks: DataFrame, nodes: DataFrame, seed: str) -> DataFrame:
    """Text graph: four-way choice of the final state, wrong ones from the scene."""
    n = nodes.withColumn("image", F.lit("any"))
    w = sample_negative_nodes(walks, n, 3, seed).filter(F.size("negatives") >= 3)
    st = w.select(*WALK, F.posexplode("negatives").alias("p", "id")).join(nodes.select("id", F.col("state").alias("_s")), "id").groupBy(*WALK).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "_s"))), lambda x: x["_s"]).alias("negatives"))
    w = with_options(w.drop("negatives").join(st, WALK), at("states", -1), seed)
    user = text(TURNS["now"], at("states", 0), TURNS["plan"], concat_actions(), TURNS["which"], lettered())
    return _record(w, F.array(msg("system", F.lit(PROMPTS["forward_state"])), msg("user", user), msg("assistant", F.col("letter"))))


def gen_inverse_edge(edges: DataFrame, nodes: DataFrame, n: int, seed: str) -> DataFrame:
    """Text graph: the action of a randomly drawn edge from its two states."""
    e = hash_ranked(edges, [], seed, ["src", "dst", "action"], "walk").filter(F.col("walk") <= n)
    a, b = nodes.select(F.col("id").alias("src"), "scene_id", F.col("state").alias("sa")), nodes.select(F.col("id").alias("dst"), F.col("state").alias("sb"))
    w = e.join(a, "src").join(b, "dst")
    user = text(TURNS["before"], F.col("sa"), TURNS["after"], F.col("sb"))
    return _record(w, F.array(msg("system", F.lit(PROMPTS["inverse_edge"])), msg("user", user), msg("assistant", F.col("action"))))


def gen_goal_reach(walks: DataFrame) -> DataFrame:
    """Text graph: dialogue from the first to the last state, ending with the last action."""
    ask = TURNS["next"]
    first = text(TURNS["now"], at("states", 0), TURNS["target"], at("states", -1), ask)

    def turn(a, i):
        later = text(TURNS["done"], F.get("actions", i - 1), TURNS["led"], F.get("states", i), ask)
        return F.array(msg("user", F.when(i == 0, first).otherwise(later)), msg("assistant", a))
    return _record(walks, F.concat(F.array(msg("system", F.lit(PROMPTS["goal_reach"]))), F.flatten(F.transform("actions", turn))))


def filter_high_reward(rollouts: DataFrame, stored: DataFrame | None = None, threshold: float = 0.5, min_messages: int = 3) -> DataFrame:
    """Episodes ``(rollout_id, messages, score, reward_scores map)`` good enough to train on, after the stored ones.

    The reward is the score, or else the sum of the separate reward scores.
    """
    parts = F.aggregate(F.map_values("reward_scores"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    r = rollouts.withColumn("reward", F.coalesce("score", parts, F.lit(0.0))).filter((F.col("reward") >= threshold) & (F.size("messages") >= min_messages))
    new = r.select("rollout_id", "messages", "reward")
    return new if stored is None else stored.unionByName(new.join(stored.select("rollout_id"), "rollout_id", "left_anti"))
