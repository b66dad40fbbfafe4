"""Parsing, validation and conversion of logs and samples as column expressions.

One input row is one log line, reply or sample, as in the stored data.  Everything works on
whole texts inside the scan stage; nothing here needs Python workers.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.ordering import hash_int, hash_of, hash_ranked, position_chunk, running
from wayfold.functions.stats import one
from wayfold.sources.tables import ACTIONS

# The markup of logs and replies.
CHATML = r"(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>"
NUMBER = r"(-?\d+(?:\.\d+)?)"
POSE = r"\[tx=N,\s*ty=N,\s*tz=N,\s*rx=N°?,\s*ry=N°?,\s*rz=N°?\]".replace("N", NUMBER)
ACTION_TAG = r"(?s)<action>(.*?)</action>"
OBSERVATION_TAG = r"(?s)<observation>(.*?)</observation>"
TURN_TAG = r"(?s)<turn index=\"?(\d+)\"?>(.*?)</turn>"
FLAT_TURN = r"(?s)<observation>(?:(?!<observation>).)*?</observation>(?:(?!<observation>).)*?<action>.*?</action>"
THINK_ACTION = r"(?s)^\s*<think>(.*?)</think>\s*<action>(.*?)</action>\s*$"
ONLY_ACTION = r"(?s)^\s*<action>((?:(?!</action>).)*)</action>\s*$"
TOKEN = r"^([A-Za-z_]\w*)(?:\(([^()]*)\))?$"
ANSWER_PATTERNS = [r"<action>\s*answer\(([A-D])\)\s*</action>", r"answer\(([A-D])\)", r"<\|begin_of_box\|>\s*answer\(([A-D])\)\s*<\|end_of_box\|>",
                   r"<\|begin_of_box\|>\s*([A-D])\s*<\|end_of_box\|>", r"^([A-D])$"]
OPPOSITES = {"move_forward": "move_backward", "move_backward": "move_forward", "move_left": "move_right", "move_right": "move_left", "move_up": "move_down",
             "move_down": "move_up", "turn_left": "turn_right", "turn_right": "turn_left", "look_up": "look_down", "look_down": "look_up",
             "rotate_cw": "rotate_ccw", "rotate_ccw": "rotate_cw"}
ROLES = {"system": "system", "human": "user", "gpt": "assistant", "observation": "tool", "function_call": "assistant"}


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null when the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def mapped(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


# --- logs ----------------------------------------------------------------------------------
def chatml_parse(rollouts: DataFrame) -> DataFrame:
    """(rollout_id, input, output) -> one row per message in order."""
    full = F.replace(F.concat(F.coalesce("input", F.lit("")), F.coalesce("output", F.lit(""))), F.lit("<|endoftext|>"), F.lit(""))
    m = rollouts.select("rollout_id", F.posexplode(F.regexp_extract_all(full, F.lit(CHATML), F.lit(0))).alias("pos", "raw"))
    m = m.withColumn("role", F.regexp_extract("raw", r"^<\|im_start\|>(\w+)", 1))
    start = F.length("role") + len("<|im_start|>") + 2
    body = F.substring(F.col("raw"), start, F.length("raw") - start + 1 - len("<|im_end|>"))
    return m.select("rollout_id", F.col("pos").cast("long").alias("pos"), "role", strip(body).alias("content"))


def render_parts(parts: Column) -> Column:
    """Text of a part list: text parts verbatim, an image part as a placeholder."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", p["value"]).when(p["type"] == "image_url", "<image>").otherwise("")), "")


def chatml_render(messages: DataFrame) -> DataFrame:
    """Rows ``(record_id, turn, role, content)`` -> one log text per record, the output being that one row.

    ``content`` is a text or a list of parts (type, value); a missing one is empty, a missing role the user's.
    """
    content = render_parts(F.col("content")) if dict(messages.dtypes)["content"].startswith("array") else F.col("content")
    piece = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce(content, F.lit("")), F.lit("<|im_end|>"))
    g = messages.groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece")))).alias("m"))
    return g.select("record_id", F.concat(F.array_join(F.transform("m", lambda x: x["piece"]), "\n"), F.lit("\n")).alias("text"))


def pose_columns(text: Column) -> list[Column]:
    """Six numbers of the first pose in a text, null without one."""
    return [found(text, POSE, i + 1).cast("double").alias(a) for i, a in enumerate(("tx", "ty", "tz", "rx", "ry", "rz"))]


def pose_text() -> Column:
    """The pose columns as text, four places for positions and two for angles."""
    return F.format_string("[tx=%.4f, ty=%.4f, tz=%.4f, rx=%.2f°, ry=%.2f°, rz=%.2f°]", "tx", "ty", "tz", "rx", "ry", "rz")


def clean_action(text: Column) -> Column:
    """Valid atomic actions of the action tag joined by ``|``; null for an answer or nothing valid."""
    raw = strip(found(text, ACTION_TAG))
    names = F.transform(F.split(raw, r"\|"), lambda a: F.lower(strip(a)))
    valid = F.filter(names, lambda a: a.isin(*ACTIONS))
    return F.when(raw.rlike(r"^answer\s*\("), F.lit(None)).when(F.size(valid) > 0, F.array_join(valid, " | "))


def format_check(responses: DataFrame) -> DataFrame:
    """ok / think / blob of each response under the grammar its ``fmt`` names."""
    t, fmt = F.col("response"), F.col("fmt")
    known = fmt.isin("free_think", "eval_mode", "no_think")
    ok = (F.when(fmt == "free_think", t.rlike(THINK_ACTION)).when(fmt == "eval_mode", t.rlike(ACTION_TAG)).when(fmt == "no_think", t.rlike(ONLY_ACTION))
          .otherwise(F.raise_error(F.concat(F.lit("unknown format "), fmt)).cast("boolean")))
    r = responses.withColumn("ok", ok)
    think = F.when(F.col("ok") & (fmt == "free_think"), strip(F.regexp_extract(t, THINK_ACTION, 1))).otherwise("")
    blob = (F.when(F.col("ok") & (fmt == "free_think"), strip(F.regexp_extract(t, THINK_ACTION, 2))).when(F.col("ok") & (fmt == "no_think"), strip(F.regexp_extract(t, ONLY_ACTION, 1)))
            .when(F.col("ok"), strip(F.regexp_extract(t, ACTION_TAG, 1))).when(fmt == "no_think", strip(t)).otherwise(""))
    return r.withColumn("think", think).withColumn("blob", blob)


def action_tokens(rows: DataFrame, blob: str) -> DataFrame:
    """``a|b(arg)`` -> ok, names, args and the argument of a single answer; one bad token spoils the row."""
    tokens = F.filter(F.split(F.regexp_replace(F.col(blob), r"\s+", ""), r"\|"), lambda x: x != "")
    r = rows.withColumn("_t", tokens).withColumn("ok", F.forall("_t", lambda x: x.rlike(TOKEN)))
    names = F.transform("_t", lambda x: F.lower(F.regexp_extract(x, TOKEN, 1)))
    args = F.transform("_t", lambda x: F.regexp_extract(x, TOKEN, 2))
    r = r.withColumn("names", F.when(F.col("ok"), names).otherwise(F.array().cast("array<string>"))).withColumn("args", F.when(F.col("ok"), args).otherwise(F.array().cast("array<string>")))
    single = F.col("ok") & (F.size("names") == 1) & (F.get("names", F.lit(0)) == "answer") & (F.get("args", F.lit(0)) != "")
    return r.withColumn("answer", F.when(single, F.get("args", F.lit(0)))).drop("_t")


def media_segments(rows: DataFrame, key: str, text: str, keep_empty: bool = False) -> DataFrame:
    """Content cut at image and video placeholders into typed parts, in order.

    Empty texts are no parts; with ``keep_empty`` each placeholder is followed by its text, empty or not.
    """
    mark, plain = "(?:<image>|<video>)", "(?:[^<]++|<(?!image>|video>))"
    if keep_empty:
        units = F.regexp_extract_all(F.col(text), F.lit(f"{mark}{plain}*+|{plain}++"), F.lit(0))
        split = F.transform(units, lambda u: F.when(u.rlike(f"^{mark}"), F.array(u.substr(1, 7), F.substring(u, 8, 2**31 - 1))).otherwise(F.array(u)))
        parts = F.flatten(split)
    else:
        parts = F.regexp_extract_all(F.col(text), F.lit(f"{mark}|{plain}++"), F.lit(0))
    p = rows.select(key, F.posexplode(parts).alias("pos", "part"))
    kind = F.when(F.col("part") == "<image>", "image").when(F.col("part") == "<video>", "video").otherwise("text")
    return p.select(key, F.col("pos").cast("long").alias("pos"), kind.alias("type"), F.when(kind == "text", F.col("part")).alias("value"))


def image_slots(turns: DataFrame) -> DataFrame:
    """First global image index and image count of every user turn."""
    t = turns.withColumn("n_images", F.regexp_count("content", F.lit("<image>")).cast("long"))
    t = t.filter("role = 'user'")
    return running(t, ["record_id"], ["turn"], F.col("n_images"), "first_image", position_chunk("turn"), inclusive=False)


# --- conversion ----------------------------------------------------------------------------
def _message(role: Column | str, kind: str, value: Column, weight: Column | float) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    weight = F.lit(weight) if isinstance(weight, float) else weight
    return F.struct(role.alias("role"), F.array(F.struct(F.lit(kind).alias("type"), value.alias("value"))).alias("content"), weight.alias("loss_weight"))


def convert_alpaca(rows: DataFrame) -> DataFrame:
    """system / instruction+input / output -> weighted messages; absent fields give none."""
    user = F.concat(F.coalesce("instruction", F.lit("")), F.coalesce("input", F.lit("")))
    parts = [F.when(F.col("system").isNotNull(), _message("system", "text", F.col("system"), 0.0)),
             F.when(F.col("instruction").isNotNull() | F.col("input").isNotNull(), _message("user", "text", user, 0.0)),
             F.when(F.col("output").isNotNull(), _message("assistant", "text", F.col("output"), 1.0))]
    return rows.select("sample_id", F.array_compact(F.array(*parts)).alias("messages"))


def convert_sharegpt(rows: DataFrame) -> DataFrame:
    """``conversations`` of (from, value) -> weighted messages; unknown roles and invalid tool calls are dropped."""
    def one_message(m):
        tag, call = m["from"], m["from"] == "function_call"
        valid = F.try_parse_json(m["value"]).isNotNull()
        msg = F.struct(mapped(ROLES, tag).alias("role"), F.array(F.struct(F.when(call, "tool_call").otherwise("text").alias("type"), m["value"].alias("value"))).alias("content"),
                       F.when(tag.isin("gpt", "function_call"), 1.0).otherwise(0.0).alias("loss_weight"))
        return F.when(tag.isin(*ROLES) & (~call | valid), msg)
    return rows.select("sample_id", F.array_compact(F.transform("conversations", one_message)).alias("messages"))


def convert_pair(rows: DataFrame) -> DataFrame:
    """chosen / rejected message lists -> weighted messages of both sides; only the assistant counts."""
    def side(c):
        return F.transform(c, lambda m: F.struct(m["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("value"))).alias("content"),
                                                 F.when(m["role"] == "assistant", 1.0).otherwise(0.0).alias("loss_weight")))
    return rows.select("sample_id", side("chosen").alias("chosen"), side("rejected").alias("rejected"))


def loss_mask(messages: DataFrame) -> DataFrame:
    """Per word of each message: kept iff the loss weight (default 1 for the assistant) is positive, else -100."""
    w = F.coalesce("loss_weight", F.when(F.col("role") == "assistant", 1.0).otherwise(0.0))
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    m = messages.select("sample_id", "pos", F.coalesce("side", F.lit(0)).alias("side"), w.alias("weight"), F.size(words).cast("long").alias("n_tokens"))
    return m.withColumn("n_labels", F.when(F.col("weight") > 0, F.col("n_tokens")).otherwise(0)).withColumn("n_ignored", F.col("n_tokens") - F.col("n_labels"))


def inject_system_suffix(messages: Column, suffix: str) -> Column:
    """Append to the first system message, or put a system message with the suffix in front."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), F.lit("system"))
    added = F.transform(messages, lambda m, i: F.when(i + 1 == first, F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("\n\n" + suffix)).alias("content"))).otherwise(m))
    front = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(suffix.strip()).alias("content"))), messages)
    return F.when(first > 0, added).otherwise(front)


def extract_letter(raw: Column) -> Column:
    """Answer letter by the first pattern that matches."""
    return F.coalesce(*[found(strip(raw), p) for p in ANSWER_PATTERNS])


def refine_answers(rollouts: DataFrame, by_idx: DataFrame, by_sample: DataFrame) -> DataFrame:
    """Recover answers of unparsed replies, join the truth by index, then by sample, and re-score."""
    a = by_idx.select("item_idx", F.col("gold").alias("gold_i"))
    b = by_sample.select("sample_id", F.col("gold").alias("gold_s"))
    r = rollouts.join(a, "item_idx", "left").join(b, "sample_id", "left")
    parsed = F.coalesce("parsed_answer", F.lit("")) != ""
    r = r.withColumn("letter", extract_letter(F.col("raw_response"))).withColumn("gold", F.coalesce("gold_i", "gold_s"))
    r = r.withColumn("status", F.when(parsed, "ok").when(F.col("letter").isNull(), "no_answer").when(F.col("gold").isNull(), "no_gt").otherwise("fixed"))
    right = F.upper("letter") == F.upper("gold")
    fixed = F.col("status") == "fixed"
    return r.select("rollout_id", "status", F.when(fixed, F.col("letter")).otherwise(F.col("parsed_answer")).alias("answer"), F.when(fixed, right).otherwise(F.col("success")).alias("success"),
                    F.when(fixed, F.when(right, 1.1).otherwise(0.1)).otherwise(F.col("cumulative_reward")).alias("cumulative_reward"))


# --- per-turn records ----------------------------------------------------------------------
def explode_turns(records: DataFrame, recent_k: int) -> DataFrame:
    """One sub-record per assistant turn: the history up to it, images kept for user turn 1 and the last k.

    Records are rows of ``(record_id, messages, images)``; a sub-record is a slice, so no join is made.
    """
    empty = F.struct(F.array().cast("array<struct<role:string,content:string,u:int,first:int,n:int>>").alias("all"), F.lit(0).alias("u"), F.lit(0).alias("seen"))

    def step(st, m):
        user, n = m["role"] == "user", F.coalesce(F.regexp_count(m["content"], F.lit("<image>")), F.lit(0))
        u = st["u"] + user.cast("int")
        item = F.struct(m["role"].alias("role"), m["content"].alias("content"), u.alias("u"), st["seen"].alias("first"), n.alias("n"))
        return F.struct(F.array_append(st["all"], item).alias("all"), u.alias("u"), (st["seen"] + F.when(user, n).otherwise(0)).alias("seen"))
    # user turns and image places are counted once for a record; every target takes a slice
    r = records.select("record_id", "images", F.aggregate("messages", empty, step)["all"].alias("_all"))
    r = r.select("record_id", "images", "_all", F.posexplode(F.filter(F.transform("_all", lambda m, i: F.when(m["role"] == "assistant", i + 1)), lambda x: x.isNotNull())).alias("_p", "_target"))
    r = r.select("record_id", "images", F.slice("_all", F.lit(1), F.col("_target")).alias("_m"), (F.col("_p") + 1).alias("target_turn"), F.get("_all", F.col("_target") - 1)["u"].alias("_users"))

    def kept(m):
        return (m["role"] == "user") & ((m["u"] == 1) | (m["u"].between(F.greatest(F.lit(1), F.col("target_turn") - recent_k + 1), F.col("target_turn"))))
    msgs = F.transform("_m", lambda m: F.struct(m["role"].alias("role"), F.when((m["role"] != "user") | kept(m), m["content"]).otherwise(F.replace(m["content"], F.lit("<image>"), F.lit(""))).alias("content")))
    imgs = F.flatten(F.transform(F.filter("_m", kept), lambda m: F.slice("images", m["first"] + 1, m["n"])))
    return r.filter("_users > 0").select("record_id", F.col("target_turn").cast("long").alias("target_turn"), msgs.alias("messages"), imgs.alias("images"))


def reassemble_turns(records: DataFrame, annotated: DataFrame, keep_unaugmented: bool = False) -> DataFrame:
    """Put annotated bodies back turn by turn; a record falls only if every turn failed.

    ``records`` rows are messages ``(record_id, turn, role, content)``, ``annotated`` is
    ``(record_id, assistant_turn, body)``.
    """
    t = running(records, ["record_id"], ["turn"], (F.col("role") == "assistant").cast("int"), "assistant_turn", position_chunk("turn"))
    a = t.filter("role = 'assistant'").join(annotated, ["record_id", "assistant_turn"], "left")
    state = a.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"), F.count("body").alias("n_ok"))
    status = F.when(F.col("n_ok") == F.col("n"), "full").when((F.col("n_ok") > 0) | F.lit(keep_unaugmented), "partial").otherwise("dropped")
    state = state.select("record_id", status.alias("status")).filter("status <> 'dropped'")
    bodies = annotated.select("record_id", "assistant_turn", "body")
    out = t.join(state, "record_id").join(bodies, ["record_id", "assistant_turn"], "left")
    return out.select("record_id", "turn", "role", F.when(F.col("role") == "assistant", F.coalesce("body", "content")).otherwise(F.col("content")).alias("content"), "status")


def salvage_attempts(attempts: DataFrame) -> DataFrame:
    """Per seed and turn: body of the last fully successful attempt, else of the earliest good one.

    ``attempts``: (seed, attempt, success, turn_idx, ok, body).  A turn never done well keeps a null body.
    """
    full = attempts.filter("success").groupBy("seed").agg(F.max("attempt").alias("attempt"))
    best = attempts.filter("success").join(full, ["seed", "attempt"]).select("seed", "turn_idx", "body", F.lit("full").alias("source"))
    rest = attempts.join(full, "seed", "left_anti")
    partial = rest.groupBy("seed", "turn_idx").agg(F.min_by(F.when(F.col("ok"), F.col("body")), F.when(F.col("ok"), F.col("attempt"))).alias("body"))
    return best.unionByName(partial.withColumn("source", F.when(F.col("body").isNull(), "original").otherwise("salvaged")))


def check_turn_blocks(replies: DataFrame, max_chars: int, substitute: bool = True, accept_flat: bool = True) -> DataFrame:
    """Validate each expected turn of a reply ``(reply_id, reply, expected)``.

    Indexed blocks count only when they cover all turns cleanly; otherwise the reply is scanned
    for observation-action chunks in order.  A wrong action is replaced by the expected one.
    """
    raw = F.regexp_extract_all("reply", F.lit(TURN_TAG), F.lit(0))
    blocks = F.transform(raw, lambda b: F.struct(F.regexp_extract(b, TURN_TAG, 1).cast("int").alias("i"), F.regexp_extract(b, TURN_TAG, 2).alias("body")))
    r = replies.withColumn("_b", blocks).withColumn("_f", F.regexp_extract_all("reply", F.lit(FLAT_TURN), F.lit(0)))
    clean = F.forall(F.sequence(F.lit(1), F.size("expected")), lambda i: F.exists("_b", lambda b: b["i"] == i) & ~F.exists("_b", lambda b: (b["i"] == i) & b["body"].contains("<turn")))
    r = r.withColumn("_clean", clean).select("reply_id", "_b", "_f", "_clean", F.posexplode("expected").alias("k", "original"))
    strict = F.try_element_at(F.filter("_b", lambda b: b["i"] == F.col("k") + 1), F.lit(-1))["body"]
    body = F.when(F.col("_clean") | F.lit(not accept_flat), strict).otherwise(F.get("_f", F.col("k")))
    r = r.withColumn("body", body).withColumn("want", strip(F.regexp_extract("original", ACTION_TAG, 1))).withColumn("got", strip(found(F.col("body"), ACTION_TAG)))
    same = F.col("got") == F.col("want")
    reason = (F.when(F.col("body").isNull(), "missing turn").when(F.length("body") > max_chars, "turn too long").when(~F.col("body").rlike(OBSERVATION_TAG), "missing observation")
              .when(F.col("got").isNull(), "missing action").when(~same & F.lit(not substitute), "action mismatch").otherwise(""))
    r = r.withColumn("reason", reason).withColumn("ok", F.col("reason") == "").withColumn("salvaged", F.col("ok") & ~same)
    at = F.locate("<action>", F.col("body"))
    end = F.expr("locate('</action>', body, locate('<action>', body))") + len("</action>")
    swapped = F.concat(F.substring(F.col("body"), F.lit(1), at - 1), F.lit("<action>"), "want", F.lit("</action>"), F.substring(F.col("body"), end, F.length("body")))
    return r.select("reply_id", (F.col("k") + 1).cast("long").alias("turn_idx"), "ok", "reason", "salvaged", strip(F.when(F.col("salvaged"), swapped).when(F.col("ok"), F.col("body"))).alias("augmented"))


def binary_choice_items(turns: DataFrame, seed: str) -> DataFrame:
    """Two-option question per turn ``(record_id, turn, kind, gold, user_text)``; turns without a distractor are skipped.

    Kind ``action`` takes the opposite action, ``options`` another listed option, ``number`` a near
    number.  A hash decides the letter of the right answer.
    """
    h = hash_of(seed, "record_id", "turn")
    pick = hash_int(h)
    options = F.regexp_extract_all("user_text", F.lit(r"(?m)^[A-Z]\. (.+)$"), F.lit(1))
    options = F.when(F.size(options) >= 2, F.filter(F.transform(options, lambda o: F.regexp_replace(F.trim(o), r"[.,;:]+$", "")), lambda o: o != F.trim("gold")))
    t = turns.withColumn("_o", options).withColumn("_h", pick)
    num = strip(F.col("gold")).try_cast("int")
    delta = (F.col("_h") % 4 + 1) * F.when(F.floor(F.col("_h") / 4) % 2 == 0, 1).otherwise(-1)
    near = F.greatest(F.lit(0), num + delta)
    near = F.when(near == num, num + 1).otherwise(near)
    wrong = (F.when(F.col("kind") == "action", mapped(OPPOSITES, F.trim("gold"))).when(F.col("kind") == "options", F.get("_o", (F.col("_h") % F.nullif(F.size("_o"), F.lit(0))).cast("int")))
             .when((F.col("kind") == "number") & num.isNotNull(), near.cast("string")))
    t = t.withColumn("wrong", wrong).filter(F.col("wrong").isNotNull()).withColumn("letter", F.when(F.floor(F.col("_h") / 8) % 2 == 0, "A").otherwise("B"))
    a, b = F.when(F.col("letter") == "A", F.col("gold")).otherwise(F.col("wrong")), F.when(F.col("letter") == "A", F.col("wrong")).otherwise(F.col("gold"))
    return t.select("record_id", "turn", "letter", a.alias("option_a"), b.alias("option_b"))


def check_choice_reply(replies: DataFrame, max_chars: int) -> DataFrame:
    """A reply counts when it is short enough, has an observation, and its action is the right letter."""
    got = F.upper(strip(found(F.col("reply"), ACTION_TAG)))
    reason = (F.when(F.length("reply") > max_chars, "too long").when(~F.col("reply").rlike(OBSERVATION_TAG), "missing observation").when(got.isNull(), "missing action")
              .when(got != F.col("letter"), "wrong letter").otherwise(""))
    return replies.withColumn("reason", reason).withColumn("ok", F.col("reason") == "")


# --- prompt rows ---------------------------------------------------------------------------
def _prompt(source: str, content: Column, ability: str, style: str, truth: Column, split: str, index: Column) -> list[Column]:
    return [F.lit(source).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"), F.lit(ability).alias("ability"),
            F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), index.alias("index")).alias("extra_info")]


def math_prompts(rows: DataFrame, source: str, split: str, instruction: str) -> DataFrame:
    """Questions with the answer after ``####`` -> prompt rows; a row without one keeps a null truth."""
    truth = F.replace(found(F.col("answer"), r"#### (-?[0-9.,]+)"), F.lit(","), F.lit(""))
    return rows.select(*_prompt(source, F.concat("question", F.lit(" " + instruction)), "math", "rule", truth, split, F.col("idx")))


def tidy_brackets(text: Column) -> Column:
    """Section titles become sentence ends, other bracketed parts go, double spaces shrink."""
    return F.replace(F.regexp_replace(F.replace(strip(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def choice_prompts(rows: DataFrame, source: str, split: str) -> DataFrame:
    """Multiple choice rows; the label is the truth, rows without a label are dropped."""
    return rows.filter("label IS NOT NULL").select(*_prompt(source, tidy_brackets(F.concat("title", F.lit(": "), "context")), "nlp", "model", F.col("label").cast("string"), split, F.col("idx")),
                                                   F.transform("endings", tidy_brackets).alias("choices"))


def search_prompts(rows: DataFrame, split: str, system: str, instruction: str, tag: str) -> DataFrame:
    """Questions for answering with a search tool: system and user message, the truth, and the tool's arguments.

    ``rows`` (idx, question, data_source, ability, reward_model, golden_answers, metadata): the truth
    is that of ``reward_model`` where there is one, even an empty one, else the golden answers.  A
    missing question or source is empty.  ``tag`` goes before the source's name.
    """
    question, source = F.coalesce("question", F.lit("")), F.concat(F.lit(tag), F.coalesce("data_source", F.lit("")))
    truth = F.when(F.col("reward_model").isNotNull(), F.col("reward_model.ground_truth")).otherwise(F.coalesce("golden_answers", F.array().cast("array<string>")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    args = F.struct(truth.alias("ground_truth"), question.alias("question"), source.alias("data_source"))
    return rows.select(
        source.alias("data_source"), F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(instruction.rstrip("\n")), question))).alias("prompt"), "ability", "reward_model",
        F.struct(F.col("idx").alias("index"), F.lit(True).alias("need_tools_kwargs"), question.alias("question"), F.lit(split).alias("split"),
                 F.struct(F.struct(args.alias("create_kwargs")).alias("search")).alias("tools_kwargs")).alias("extra_info"), "metadata")


def source_prompts(sources: dict[str, tuple[DataFrame, Column, Column, str, str]]) -> DataFrame:
    """Prompt rows of several sources {name: (rows with idx, question, solution, ability, split)} in one table."""
    parts = [rows.select(*_prompt(name, question.cast("string"), ability, "rule", solution.cast("string"), split, F.col("idx")))
             for name, (rows, question, solution, ability, split) in sources.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def collapse_conversations(rows: DataFrame, system: str, agent: str, task: str) -> DataFrame:
    """Conversations (record_id, prompt, single_turn_prompt and, where there are any, ground_truth,
    single_turn_completion, completion, task_desc) -> rows for training against a simulated user.

    The system message comes first.  The truth is the first of ground truth, completion of the
    single turn and completion that is not empty, else empty.  A row without ``single_turn_prompt``
    is an error; without a task description it has ``task``.
    """
    have = set(rows.columns)
    filled = [F.when(F.col(c) != "", F.col(c)) for c in ("ground_truth", "single_turn_completion", "completion") if c in have]
    truth = F.coalesce(*filled, F.lit(""))
    need = F.when(F.col("single_turn_prompt").isNull(), F.raise_error(F.concat(F.lit("single_turn_prompt is missing in record "), F.col("record_id").cast("string")))).otherwise(F.col("single_turn_prompt"))
    desc = F.coalesce(*([F.col("task_desc")] if "task_desc" in have else []), F.lit(task))
    prompt = F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), "prompt")
    rest = [c for c in rows.columns if c not in ("record_id", "prompt", "ground_truth", "single_turn_prompt", "task_desc")]
    info = F.struct(*rest, prompt.alias("prompt"), F.struct(F.lit(agent).alias("name"), need.alias("single_turn_prompt"), desc.alias("task_desc")).alias("interaction_kwargs"))
    return rows.select(F.col("record_id").alias("index"), prompt.alias("prompt"), truth.alias("ground_truth"), prompt.alias("raw_prompt"), info.alias("extra_info"),
                       F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.lit(agent).alias("data_source"), F.lit(f"{agent}_agent").alias("agent_name"))


# The wording of English few-shot prompts.
FEW_SHOT = {"system": "The following are multiple choice questions (with answers) about {subject}.\n\n", "choice": "\n{choice}. {content}", "answer": "\nAnswer:"}


def few_shot_messages(targets: DataFrame, support: DataFrame, shots: int, seed: str, wording: dict[str, str] = FEW_SHOT) -> DataFrame:
    """(id, subject, messages): each target question after ``shots`` answered questions of its subject.

    Both tables hold (id, subject, question, choices, answer), ``choices`` being a list of at most 26
    texts of which null ones are left out.  Support questions are drawn by hash; a target is never
    among its own.  Questions and answers alternate, the target's own answer is the last message,
    and the first one starts with the introduction.
    """
    letter = lambda i: F.char(F.lit(65) + i)
    shape = wording["choice"].split("{choice}")
    between, after = shape[1].split("{content}")
    line = lambda c, i: F.when(c.isNotNull(), F.concat(F.lit(shape[0]), letter(i), F.lit(between), c, F.lit(after)))
    text = F.concat("question", F.array_join(F.transform("choices", line), ""), F.lit(wording["answer"]))
    pair = F.array(F.struct(F.lit("user").alias("role"), text.alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    drawn = hash_ranked(support.filter("question IS NOT NULL AND choices IS NOT NULL AND answer IS NOT NULL"), ["subject"], seed, ["id"], "nth").filter(F.col("nth") <= shots + 1)
    kept = drawn.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("nth", "id", pair.alias("pair")))).alias("shots"))  # shots + 1 a subject
    j = targets.join(kept, "subject", "left")
    others = F.slice(F.filter(F.coalesce("shots", F.array().cast(kept.schema["shots"].dataType)), lambda x: x["id"] != F.col("id")), 1, shots)
    all_ = F.concat(F.flatten(F.transform(others, lambda x: x["pair"])), pair)
    intro = F.concat(F.replace(F.lit(wording["system"]), F.lit("{subject}"), F.col("subject")), all_[0]["content"])
    return j.select("id", "subject", F.transform(all_, lambda m, i: F.when(i == 0, F.struct(m["role"].alias("role"), intro.alias("content"))).otherwise(m)).alias("messages"))


def preference_rows(rows: DataFrame) -> DataFrame:
    """Each chosen / rejected pair becomes two labelled rows."""
    both = F.array(F.struct(F.lit("chosen").alias("side"), F.col("chosen").alias("response"), F.lit(1).alias("label")), F.struct(F.lit("rejected").alias("side"), F.col("rejected").alias("response"), F.lit(0).alias("label")))
    return rows.select("idx", "prompt", F.inline(both))


def head_tail_split(rows: DataFrame, idx: str, share: float) -> DataFrame:
    """The first ``share`` of the rows in order is one part, the rest the other; idx is dense from 0."""
    n = one(rows.agg(F.count(F.lit(1)).alias("n")))["n"]
    return rows.withColumn("part", F.when(F.col(idx) < F.floor(n * F.lit(share)), "head").otherwise("tail"))


def split_tool_turns(rows: DataFrame) -> DataFrame:
    """Tagged text -> assistant text with a code call, tool result and final answer messages, in order."""
    seg = r"(?s)<code>.*?</code>|<interpreter>.*?</interpreter>|<answer>.*?</answer>|(?:(?!<code>|<interpreter>|<answer>).)+"
    s = F.regexp_extract_all("text", F.lit(seg), F.lit(0))
    parts = F.transform(s, lambda x, i: F.struct(x.alias("x"), F.when((i > 0) & ~F.get(s, i - 1).rlike("^<(code|interpreter|answer)>"), F.get(s, i - 1)).otherwise("").alias("before")))
    tagged = F.filter(parts, lambda p: p["x"].rlike("^<(code|interpreter|answer)>"))
    t = rows.select("row_id", F.posexplode(tagged).alias("pos", "p")).select("row_id", "pos", F.col("p.x").alias("x"), F.col("p.before").alias("before"))
    inner = F.regexp_extract("x", r"(?s)^<\w+>(.*)</\w+>$", 1)
    code = F.regexp_extract(inner, r"(?s)```(?:python|py)?\s*(.*?)```", 1)
    is_code, is_tool = F.col("x").startswith("<code>"), F.col("x").startswith("<interpreter>")
    content = F.when(is_code, strip(F.col("before"))).when(is_tool, strip(inner)).otherwise(strip(F.concat("before", inner)))
    return t.select("row_id", F.col("pos").cast("long").alias("pos"), F.when(is_tool, "tool").otherwise("assistant").alias("role"), content.alias("content"),
                    F.when(is_code, F.when(code != "", strip(code)).otherwise(inner)).alias("code"))
