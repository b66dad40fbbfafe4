"""Parsing and conversion on the small cases of each format."""

import pytest
from pyspark.sql import functions as F

from wayfold.operators import parsing as p, sampling, scoring


def one(spark, col, *exprs):
    return spark.createDataFrame([(col,)], "t string").select(*exprs).first()


def test_chatml_lines(spark):
    df = spark.createDataFrame([(1, "<|im_start|>system\n hi <|im_end|>\n<|im_start|>user\na\nb <image><|im_end|>", "<|im_start|>assistant\nok<|im_end|><|endoftext|>"), (2, None, "no markup")], "rollout_id long, input string, output string")
    got = [(r.rollout_id, r.pos, r.role, r.content) for r in p.chatml_parse(df).orderBy("pos").collect()]
    assert got == [(1, 0, "system", "hi"), (1, 1, "user", "a\nb <image>"), (1, 2, "assistant", "ok")]


def test_pose_round_trip(spark):
    text = "see [tx=1.2300, ty=-0.5000, tz=0.0000, rx=-120.00°, ry=0.00°, rz=150.00°] here"
    row = one(spark, text, *p.pose_columns(F.col("t")))
    assert tuple(row) == (1.23, -0.5, 0.0, -120.0, 0.0, 150.0)
    df = spark.createDataFrame([tuple(row)], "tx double, ty double, tz double, rx double, ry double, rz double")
    assert df.select(p.pose_text()).first()[0] == text[4:-5]
    assert one(spark, "no pose", *p.pose_columns(F.col("t"))).tx is None


@pytest.mark.parametrize("text,want", [("<action> Turn_Left | jump | move_up</action>", "turn_left | move_up"), ("<action>answer(1, 2)</action>", None), ("<action>jump</action>", None), ("turn_left", None)])
def test_clean_action(spark, text, want):
    assert one(spark, text, p.clean_action(F.col("t")).alias("a")).a == want


def test_formats(spark):
    rows = [("free_think", "<think>a</think> <action>b</action>", True, "a", "b"), ("free_think", "x<think>a</think><action>b</action>", False, "", ""), ("eval_mode", "x <action> b </action> y", True, "", "b"),
            ("no_think", " <action>b</action> ", True, "", "b"), ("no_think", "x <action>b</action>", False, "", "x <action>b</action>")]
    df = spark.createDataFrame([(f, t) for f, t, *_ in rows], "fmt string, response string")
    assert [(r.ok, r.think, r.blob) for r in p.format_check(df).collect()] == [tuple(x[2:]) for x in rows]
    with pytest.raises(Exception, match="unknown format"):
        p.format_check(spark.createDataFrame([("none", "x")], "fmt string, response string")).collect()


def test_action_tokens(spark):
    df = spark.createDataFrame([("go | Get_View(1, 2)|",), ("go|no-way",), ("answer(B)",), ("answer()",)], "b string")
    got = [(r.ok, r.names, r.answer) for r in p.action_tokens(df, "b").collect()]
    assert got == [(True, ["go", "get_view"], None), (False, [], None), (True, ["answer"], "B"), (True, ["answer"], None)]


def test_sharegpt_golden(spark):
    conv = [("system", "System"), ("human", "User"), ("function_call", "1"), ("observation", "Observation"), ("gpt", "Assistant"), ("function_call", "{bad"), ("critic", "x")]
    m = p.convert_sharegpt(spark.createDataFrame([(1, conv)], "sample_id long, conversations array<struct<from:string,value:string>>")).first().messages
    assert [(x.role, x.content[0].type, x.content[0].value, x.loss_weight) for x in m] == [
        ("system", "text", "System", 0.0), ("user", "text", "User", 0.0), ("assistant", "tool_call", "1", 1.0), ("tool", "text", "Observation", 0.0), ("assistant", "text", "Assistant", 1.0)]


def test_alpaca_golden(spark):
    m = p.convert_alpaca(spark.createDataFrame([(1, None, "do ", "this", "done")], "sample_id long, system string, instruction string, input string, output string")).first().messages
    assert [(x.role, x.content[0].value, x.loss_weight) for x in m] == [("user", "do this", 0.0), ("assistant", "done", 1.0)]


def test_turn_blocks(spark):
    want = ["<action>go</action>", "<action>stop</action>"]
    good = '<turn index="1"><observation>a</observation><action>go</action></turn><turn index="2"><observation>b</observation><action>run</action></turn>'
    flat = "<observation>x</observation><observation>a</observation> t <action>go</action> <action>z</action><observation>b</observation><action>stop</action>"
    df = spark.createDataFrame([(1, good, want), (2, flat, want), (3, "none", want)], "reply_id long, reply string, expected array<string>")
    got = {(r.reply_id, r.turn_idx): (r.ok, r.salvaged, r.augmented, r.reason) for r in p.check_turn_blocks(df, 1500).collect()}
    assert got[1, 2] == (True, True, "<observation>b</observation><action>stop</action>", "")
    assert got[2, 1] == (True, False, "<observation>a</observation> t <action>go</action>", "")
    assert got[2, 2][:2] == (True, False) and got[3, 1][3] == "missing turn"
    strict = {(r.reply_id, r.turn_idx): r.reason for r in p.check_turn_blocks(df, 1500, substitute=False).collect()}
    assert strict[1, 2] == "action mismatch"


def test_explode_keeps_first_and_recent_images(spark):
    msgs = [(r, f"{r}{i} <image>" if r == "user" else f"{r}{i}") for i in range(4) for r in ("user", "assistant")]
    df = spark.createDataFrame([(1, msgs, [f"i{k}" for k in range(4)])], "record_id long, messages array<struct<role:string,content:string>>, images array<string>")
    got = {r.target_turn: r for r in p.explode_turns(df, 2).collect()}
    assert got[4].images == ["i0", "i2", "i3"] and len(got[4].messages) == 8
    assert "<image>" not in got[4].messages[2].content and "<image>" in got[4].messages[0].content
    assert got[1].images == ["i0"] and [m.content for m in got[1].messages] == ["user0 <image>", "assistant0"]


def test_system_suffix(spark):
    df = spark.createDataFrame([([("user", "u")],), ([("system", "s"), ("system", "t")],)], "m array<struct<role:string,content:string>>")
    got = [[(x.role, x.content) for x in r.m] for r in df.select(p.inject_system_suffix(F.col("m"), "S").alias("m")).collect()]
    assert got == [[("system", "S"), ("user", "u")], [("system", "s\n\nS"), ("system", "t")]]


def test_scores(spark):
    df = spark.createDataFrame([("<answer>The  Cat!</answer> #### 1,200", "a cat", "1200"), ("no tag 7.", "x", "7"), ("#### 5 then 9", "x", "9")], "response string, gold_text string, gold_num string")
    got = [(r.strict_score, r.flexible_score, r.em_score, r.subem_score) for r in scoring.score_answers(df).collect()]
    assert got == [(1.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0)]


def test_identical_texts_score_full(spark):
    df = spark.createDataFrame([(1, "the cat sat down", "the cat sat down"), (2, "", "abc"), (3, "xyz", "the cat")], "pair_id long, prediction string, label string")
    got = {r.pair_id: (r.rouge_1, r.rouge_2, r.bleu_4) for r in scoring.ngram_overlap(df).collect()}
    assert got[1] == (100.0, 100.0, 100.0) and got[2] == (0.0, 0.0, 0.0) and got[3] == (0.0, 0.0, 0.0)


def test_long_texts_are_counted_in_slices(spark, monkeypatch):
    long = [(1, "a b c d e f g  h\nij", "b c x é😀 f g h"), (2, "", ""), (3, "ab" * 40, "ba " * 30), (4, "w " * 100, "w")]
    df = spark.createDataFrame(long, "pair_id long, prediction string, label string")
    whole = sorted(map(tuple, scoring.ngram_overlap(df).collect()))
    for k in (3, 4, 7):
        monkeypatch.setattr(scoring, "SLICE", k)
        assert sorted(map(tuple, scoring.ngram_overlap(df).collect())) == whole
    assert max(len(r.body) for r in scoring.text_slices(df).filter("family = 'c'").collect()) == 10
    monkeypatch.undo()
    big = spark.range(1).select(F.col("id").alias("pair_id"), F.repeat(F.lit("one two three "), 700_000).alias("prediction"), F.lit("one two").alias("label"))
    assert scoring.text_slices(big).count() > 2500


def test_grams_of_bounded_texts_are_no_rows(spark, monkeypatch):
    rows = [(1, "a b c d e f g  h\nij", "b c x é😀 f g h"), (2, "", ""), (3, "ab" * 40, "ba " * 30), (4, "w " * 100, "w"), (5, None, "a b"), (6, "a b", None), (7, None, None), (8, " \t", "x"),
            (9, "a b c", "a b d"), (9, "a b d", "e f"), (None, "a b", "b a"), (None, "b", "b a")]
    df = spark.createDataFrame(rows, "pair_id long, prediction string, label string")
    once = df.filter("pair_id < 9").withColumns({"lp": F.length("prediction"), "ll": F.length("label")})
    order = ["pair_id", "lp", "ll", *scoring.COUNTS]
    want = sorted(map(str, scoring._slice_counts(once).select(*order).collect()))
    for units in (1 << 18, 8):
        monkeypatch.setattr(scoring, "UNITS", units)
        assert sorted(map(str, scoring._row_counts(once).select(*order).collect())) == want
    assert sorted(map(str, scoring.ngram_overlap(df).select("pair_id").collect())) == sorted(f"Row(pair_id={i})" for i in [*range(1, 10), None])
    # only what shares an id is cut into slices
    seen, whole = [], scoring._slice_counts
    monkeypatch.setattr(scoring, "_slice_counts", lambda d: seen.append(d) or whole(d))
    assert scoring.ngram_overlap(df).count() == 10 and sorted(str(r.pair_id) for r in seen[0].collect()) == ["9", "9", "None", "None"]


def test_group_split_is_disjoint_and_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 37).alias("g"))
    s = sampling.split_by_group(df, "g", [80, 10, 10], ["train", "eval", "test"], "s").cache()
    assert s.count() == 1000 and s.select("g", "split").distinct().count() == 37
    assert {r.split: r.n_groups for r in sampling.split_report(s, "g").collect()} == {"train": 29, "eval": 4, "test": 4}


def test_reweight_sizes(spark):
    df = spark.range(100).withColumnRenamed("id", "i")
    assert sampling.reweight_dataset(df, "i", size=30).count() == 30
    assert sampling.reweight_dataset(df, "i", size=30, weight=2.5).count() == 75


def test_render_parts(spark):
    rows = [(1, 0, "user", [("text", "a"), ("image_url", "x.png"), ("audio", "z"), ("text", None)]), (1, 1, None, []), (1, 2, "assistant", None)]
    df = spark.createDataFrame(rows, "record_id long, turn long, role string, content array<struct<type:string,value:string>>")
    assert p.chatml_render(df).first()["text"] == "<|im_start|>user\na<image><|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"


def test_search_prompts_fall_back_to_golden_answers(spark):
    schema = "idx long, question string, data_source string, ability string, reward_model struct<style:string,ground_truth:array<string>>, golden_answers array<string>, metadata string"
    rows = [(0, "q", "nq", "fact", ("rule", ["a"]), ["b"], "m"), (1, None, None, None, None, ["b"], None), (2, "q", "nq", "fact", ("rule", None), ["b"], None), (3, "q", "nq", "fact", None, None, None)]
    got = p.search_prompts(spark.createDataFrame(rows, schema), "test", "sys", "Ask: \n\n", "t_").orderBy("extra_info.index").collect()
    assert [r.extra_info.tools_kwargs.search.create_kwargs.ground_truth for r in got] == [["a"], ["b"], None, []]
    assert [(m.role, m.content) for m in got[0].prompt] == [("system", "sys"), ("user", "Ask: q")] and got[0].data_source == "t_nq"
    assert got[1].prompt[1].content == "Ask: " and got[1].data_source == "t_" and got[1].extra_info.split == "test"


def test_collapse_conversations(spark):
    schema = "record_id long, prompt array<struct<role:string,content:string>>, single_turn_prompt string, ground_truth string, completion string"
    df = spark.createDataFrame([(1, [("user", "hi")], "hi", "", "done"), (2, [], "x", "t", None), (3, None, "x", None, "")], schema)
    got = {r["index"]: r for r in p.collapse_conversations(df, "S", "sim", "help").collect()}
    assert [got[i].ground_truth for i in (1, 2, 3)] == ["done", "t", ""]
    assert [m.content for m in got[1].prompt] == ["S", "hi"] and got[2].extra_info.interaction_kwargs.task_desc == "help" and got[1].agent_name == "sim_agent"
    with pytest.raises(Exception, match="single_turn_prompt is missing"):
        p.collapse_conversations(df.withColumn("single_turn_prompt", F.lit(None).cast("string")), "S", "sim", "help").collect()


def test_few_shot_messages(spark):
    schema = "id long, subject string, question string, choices array<string>, answer string"
    rows = [(i, "maths" if i < 5 else "law", f"q{i}", ["w", None, "y"], "A") for i in range(7)] + [(7, "art", "q7", ["w"], "A"), (8, "law", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: r for r in p.few_shot_messages(df, df.filter("subject <> 'art'"), 2, "s").collect()}
    assert len(got) == 9 and [len(got[i].messages) for i in (0, 5, 7)] == [6, 4, 2]
    for r in got.values():
        text = [m.content for m in r.messages]
        assert r.id == 8 or text[0].startswith(f"The following are multiple choice questions (with answers) about {r.subject}.\n\nq")
        assert [m.role for m in r.messages] == ["user", "assistant"] * (len(text) // 2)
        assert r.id == 8 or (text[-2].endswith(f"q{r.id}" + ("\nA. w" if r.id == 7 else "\nA. w\nC. y") + "\nAnswer:") and sum(f"q{r.id}\n" in x for x in text) == 1)


def test_media_segments(spark):
    df = spark.createDataFrame([(1, "a<b\n<image><image>x<video>"), (2, ""), (3, None)], "k long, c string")
    def parts(**options):
        return [(r.k, r.pos, r.type, r.value) for r in p.media_segments(df, "k", "c", **options).orderBy("k", "pos").collect()]
    assert parts() == [(1, 0, "text", "a<b\n"), (1, 1, "image", None), (1, 2, "image", None), (1, 3, "text", "x"), (1, 4, "video", None)]
    assert parts(keep_empty=True) == [(1, 0, "text", "a<b\n"), (1, 1, "image", None), (1, 2, "text", ""), (1, 3, "image", None), (1, 4, "text", "x"), (1, 5, "video", None), (1, 6, "text", "")]
