"""Reading, curation, repair, preparation and scoring of records."""

import datetime
import json
import random

import pandas as pd
import pytest
from pyspark.sql import Row, functions as F

from tablemill.operators import curation, evaluate, prepare, repair
from tablemill.plans import jobs
from tablemill.sources import records

TOOL = "tool"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- reading and writing --------------------------------------------------------------------------


def corpus_folder(tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    good = [{"prompt": "p", "response": "tool x", "chat.jar": "failed", "error": "e"}, {"prompt": "q", "response": "r", "cmd": "c"}]
    (folder / "good.json").write_text(json.dumps(good, indent=4))
    (folder / "empty.json").write_text("[]")
    (folder / "object.json").write_text(json.dumps(good[0]))
    (folder / "broken.json").write_text('[{"prompt": ')
    (folder / "notes.txt").write_text("[]")
    (folder / "sub").mkdir()
    (folder / "sub" / "deep.json").write_text(json.dumps(good))
    return folder


def test_read_corpus_keeps_only_good_arrays(spark, tmp_path):
    folder = corpus_folder(tmp_path)
    rows = records.read_corpus(spark, str(folder), str(tmp_path / "absent")).orderBy("prompt").collect()
    assert [(r.prompt, r.status, r.error, r.cmd, r.file) for r in rows] == [
        ("p", "failed", "e", None, "good.json"),
        ("q", None, None, "c", "good.json"),
    ]


def test_read_corpus_of_absent_folders_is_empty(spark, tmp_path):
    assert records.read_corpus(spark, str(tmp_path / "absent")).count() == 0


def test_record_arrays_round_trip_in_bounded_files(spark, tmp_path):
    df = frame(spark, [(str(i), "r", "fixed") for i in range(25)], "prompt string, response string, status string").repartition(2)
    records.write_record_arrays(df, str(tmp_path / "out"), per_file=4)
    back = records.read_corpus(spark, str(tmp_path / "out"), pattern="*")
    assert sorted(int(r.prompt) for r in back.collect()) == list(range(25))
    assert {r.status for r in back.collect()} == {"fixed"}
    assert back.groupBy("file").count().agg(F.max("count")).first()[0] <= 4


def test_xml_examples(spark, tmp_path):
    path = tmp_path / "examples.xml"
    path.write_text(
        "<output><example><task>t</task><prompt> a </prompt><response>b\n</response></example>"
        "<example><prompt>only</prompt></example><example><response></response></example></output>"
    )
    assert {tuple(r) for r in records.read_examples(spark, str(path)).collect()} == {("a", "b"), ("only", "")}


def test_html_text(spark):
    html = (
        "<html><head><title>T &amp; x</title><style>p{}</style><script>var a='</p>';</script></head><body><!-- no -->"
        "<p>  one <b>two</b>\n\n three<br>four<template>gone</template></p></body></html>"
    )
    df = frame(spark, [(html,), (None,)], "h string").select(records.html_text("h").alias("t"))
    assert [r.t for r in df.collect()] == ["T & x  one two\nthreefour", None]


# --- curation -------------------------------------------------------------------------------------


def test_normalise_status(spark):
    df = frame(spark, [(" Fixed\n",), (None,), ("FAILED ",)], "status string")
    assert [r[0] for r in df.select(curation.normalise_status("status")).collect()] == ["fixed", "", "failed"]


def test_failed_rows_are_exact(spark):
    df = frame(spark, [("failed",), ("Failed",), ("failed ",), (None,)], "status string")
    assert curation.failed_rows(df).count() == 1


def test_gate_and_clean(spark):
    df = frame(spark, [("tool x in=tool.t",), ("java -jar tool.jar y",), ("tool java -jar tool.jar z ",)], "response string")
    rows = curation.gate_commands(df, TOOL).collect()
    assert [(r.status, r.command) for r in rows] == [
        (None, "x in=.t"),
        ("skipped - no 'tool' prefix", None),
        (None, "z"),
    ]


def test_first_failure_mode_wins(spark):
    both = "/bin/sh: Error: No file, URL or command"
    df = frame(spark, [("failed", both), ("failed", None), ("failed", "odd"), ("fixed", both)], "status string, error string")
    counts = {r["mode"]: r["n"] for r in curation.failure_counts(df).collect()}
    assert list(counts) == curation.FAILURE_MODES
    assert counts.pop("/bin/sh") == 1 and set(counts.values()) == {0}


def test_entries_count_once_per_matching_key(spark):
    df = frame(spark, [("cat.json",)] * 2 + [("catn.json",)] * 3, "file string")
    rows = [(r["key"], r["n"]) for r in curation.entries_per_key(df, ["cat", "catn", "none"]).orderBy("place").collect()]
    assert rows == [("cat", 5), ("catn", 3), ("none", 0), ("total", 8)]


def test_funnel_and_its_totals(spark):
    schema = "cmd string, status string"
    main = frame(
        spark,
        [("a", "executed successfully"), ("a", "failed"), ("a", "failed"), ("a", "odd"), ("b", "skipped - no 'tool' prefix"), (None, "failed")],
        schema,
    )
    fixed = frame(spark, [("a", "Fixed"), ("a", "fixed: free text"), ("a", "failed"), ("c", "skipped")], schema)
    per_command = curation.funnel(main, fixed, TOOL)
    assert {tuple(r) for r in per_command.collect()} == {
        ("a", 3, 2, 1, 2, 1, 2, 2 / 3 * 100),
        ("b", 1, 0, 1, 0, 0, 1, 100.0),
        ("c", 0, 0, 0, -1, 1, 1, 0.0),
    }
    assert tuple(curation.funnel_totals(per_command).first()) == (4, 4, 0, 2, 2, 100.0)


def test_admission(spark):
    schema = "id int, status string"
    main = frame(spark, [(1, None), (2, "failed"), (3, "whatever"), (4, " FAILED")], schema)
    fixed = frame(spark, [(5, "fixed"), (6, "fixed: by hand"), (7, None), (8, "skipped-plot")], schema)
    assert sorted(r.id for r in curation.admit(main, fixed, TOOL).collect()) == [1, 3, 5, 8]


@pytest.mark.parametrize("n", [0, 1, 9, 10, 101, 1000])
def test_holdout_is_exact_disjoint_and_stable(spark, n):
    df = spark.range(n)
    train, test = curation.holdout_split(df, "id", 0.1, seed=5)
    chosen = {r.id for r in test.collect()}
    assert len(chosen) == int(n * 0.1)
    assert chosen | {r.id for r in train.collect()} == set(range(n)) and train.count() == n - len(chosen)
    _, again = curation.holdout_split(df.repartition(7), "id", 0.1, seed=5)
    assert {r.id for r in again.collect()} == chosen


def test_shuffle_is_a_repeatable_permutation(spark):
    df = spark.range(200)
    first = [r.id for r in curation.shuffle_rows(df, "id").collect()]
    assert sorted(first) == list(range(200)) != first
    assert [r.id for r in curation.shuffle_rows(df.repartition(5), "id").collect()] == first


def test_quality_reports(spark):
    df = frame(
        spark,
        [("x", "failed")] * 7 + [("x", "ok")] * 23 + [("y", "executed successfully"), ("y", None)],
        "file string, status string",
    )
    assert {tuple(r) for r in curation.quality_by_file(df).collect()} == {("x", 30, 7, "23.33%"), ("y", 2, 0, "0.00%")}
    by_file = curation.validity_by_file(df)
    assert {tuple(r) for r in by_file.collect()} == {("x", 30, 7, 0, 23, 0.0), ("y", 2, 0, 1, 1, 50.0)}
    assert curation.mean_validity(by_file).first()[0] == 25.0


def test_failures_by_mode_files(spark, tmp_path):
    df = frame(spark, [("failed", "/bin/sh x", "a.json"), ("failed", "odd", "b.json")], "status string, error string, file string")
    out = curation.failures_by_mode(df)
    assert [(r["mode_key"], r["source_cmd_file"]) for r in out.collect()] == [("_bin_sh", "a.json")]
    records.write_failures(out, str(tmp_path / "f"))
    assert (tmp_path / "f" / "mode_key=_bin_sh").is_dir()


def test_check_corpus_from_files(spark, tmp_path):
    def checker(commands):
        return commands.map(lambda c: "Error: Row count" if c == "x" else None)

    checked = jobs.check_corpus(spark, [str(corpus_folder(tmp_path))], TOOL, checker)
    assert {(r.prompt, r.cmd, r.status, r.error) for r in checked.collect()} == {
        ("p", "good", "failed", "Error: Row count"),
        ("q", "good", "skipped - no 'tool' prefix", None),
    }


def test_curate_job(spark):
    main = frame(spark, [(i, "c", "ok" if i % 3 else "failed") for i in range(30)], "id int, cmd string, status string")
    fixed = frame(spark, [(100 + i, "c", "fixed") for i in range(5)], "id int, cmd string, status string")
    done = jobs.curate(main, fixed, TOOL, "id", 0.2)
    assert (done.train.count(), done.test.count()) == (20, 5)
    assert done.funnel.first()["fixed"] == 5 and done.statuses.count() == 3


# --- repair and extraction --------------------------------------------------------------------------

REPAIRS = [
    ("x cmd='select a > 1' y", "x cmd='select \"a > 1\"' y"),
    ("cmd='addcol Z a + b;sort z'", "cmd='addcol Z \"a + b\"; sort \"z\"'"),
    ("icmd12='replacecol A 1' ocmd='head 5'", "icmd12='replacecol A \"1\"' ocmd='head \"5\"'"),
    ("cmd='addcol Z'", "cmd='addcol \"Z\"'"),
    ("cmd='select \"a > 1\"'", "cmd='select \"a > 1\"'"),
    ("cmd=''", "cmd=''"),
    ("cmd=' cache ;  head  3 '", "cmd='cache; head \" 3\"'"),
    ("no list", "no list"),
    ("cmd='open", "cmd='open"),
    ("cmd='a b'cmd2='c d'", "cmd='a \"b\"'cmd2='c \"d\"'"),
    ("ccmd='a $1 \\ b'", "ccmd='a \"$1 \\ b\"'"),
]


@pytest.mark.parametrize("before, after", REPAIRS)
def test_quote_repair(spark, before, after):
    df = frame(spark, [(before,)], "r string")
    assert df.select(repair.quote_arguments("r")).first()[0] == after


def test_quote_repair_spaced(spark):
    rows = ["a cmd= 'sort x y;head' b", "cmd='select q' cmd= 'sort x'", "cmd= 'has \" quote'"]
    df = frame(spark, [(r,) for r in rows], "r string")
    assert [r[0] for r in df.select(repair.quote_spaced_arguments("r")).collect()] == [
        "a cmd='sort \"x y\"; head' b",
        rows[1],
        rows[2],
    ]


def test_tool_call(spark):
    cases = [
        ("[make(properties='do it')]", "do it"),
        ("make(description=\"say (hi)\")", 'say (hi'),
        ("make type='x", "x"),
        ("make nothing", None),
        ("other(properties='x')", None),
        ("make properties='a' properties='b')", "a' "),
    ]
    df = frame(spark, [(c,) for c, _ in cases], "r string")
    assert [r[0] for r in df.select(repair.extract_tool_call("r", "make")).collect()] == [w for _, w in cases]


def test_answer(spark):
    df = frame(spark, [("user q model  a\n model more",), ("none",)], "r string")
    assert [r[0] for r in df.select(repair.extract_answer("r")).collect()] == ["a", None]


# --- templates and blocks ---------------------------------------------------------------------------


def test_templates(spark):
    df = frame(spark, [(" hi ", "yo\n")], "prompt string, response string")
    row = df.select(prepare.render_record(), prepare.inference_prompt()).first()
    assert row[0] == "<bos><start_of_turn>user\nhi<end_of_turn>\n<start_of_turn>assistant\nyo<end_of_turn>\n"
    assert row[1] == "<bos><start_of_turn>user\n hi <end_of_turn>\n<start_of_turn>assistant\n"


def test_conversations_in_parts_join_to_the_whole(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(7)] + [(2, 0, "system", "s"), (2, 1, "user", "u")]
    df = frame(spark, turns, "conv_id long, turn long, role string, text string")
    whole = {r.conv_id: r for r in prepare.render_conversations(df, generation=True).collect()}
    parts = prepare.render_conversations(df, generation=True, turns_per_part=3).orderBy("conv_id", "part").collect()
    assert [r.part for r in parts if r.conv_id == 1] == [0, 1, 2]
    assert "".join(r.text for r in parts if r.conv_id == 1) == whole[1].text
    assert whole[1].text.startswith("<bos><start_of_turn>assistant\nt0") and whole[1].text.endswith("<start_of_turn>model\n")
    assert whole[2].rejected and whole[2].text is None and not whole[1].rejected


def packed(lists, block, size):
    """The documented rule, batch by batch."""
    out = []
    for start in range(0, len(lists), size):
        tokens = [t for l in lists[start : start + size] for t in l]
        end = len(tokens) // block * block if len(tokens) >= block else len(tokens)
        out += [(start // size, i, tokens[i * block : min((i + 1) * block, end)]) for i in range((end + block - 1) // block)]
    return out


def test_packing(spark):
    lists = [[100 * i + j for j in range((i * 7) % 11)] for i in range(23)]
    df = frame(spark, [(i, l, [1] * len(l)) for i, l in enumerate(lists)], "id long, input_ids array<int>, attention_mask array<int>")
    for size, block in [(5, 8), (3, 1000), (23, 4), (1, 3)]:
        blocks = prepare.pack_blocks(prepare.batch_rows(df, "id", size), block, parallel=("attention_mask",))
        rows = sorted((r.batch_id, r.block_id, r.input_ids, r.attention_mask, r.labels) for r in blocks.collect())
        assert [r[:3] for r in rows] == packed(lists, block, size)
        assert all(r[2] == r[4] and r[3] == [1] * len(r[2]) for r in rows)


@pytest.mark.parametrize("runs", [1, 3, 40])
def test_packing_in_one_move(spark, monkeypatch, runs):
    monkeypatch.setattr(prepare, "MOST_RUNS", runs)
    draw = random.Random(runs)
    lists = [[100 * i + j for j in range(draw.choice([0, 1, 7, 40]))] for i in range(57)]
    keyed = [(f"k{i // 10}", datetime.datetime(2020, 1, 1) + datetime.timedelta(microseconds=i % 10), l, [1] * len(l)) for i, l in enumerate(lists)]
    df = frame(spark, draw.sample(keyed, len(keyed)), "a string, b timestamp, ids array<int>, mask array<int>")
    for size, block in [(5, 8), (3, 1000), (57, 4), (1, 3)]:
        blocks = prepare.pack_rows(df, ["a", "b"], F.col("ids"), block, size, {"attention_mask": F.col("mask")})
        rows = sorted((r.batch_id, r.block_id, r.input_ids, r.attention_mask, r.labels) for r in blocks.collect())
        assert [r[:3] for r in rows] == packed(lists, block, size)
        assert all(r[2] == r[4] and r[3] == [1] * len(r[2]) for r in rows)
    plan = blocks._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange ") == 1


def test_training_tokens(spark):
    df = frame(spark, [(i, "p", "r" * i) for i in range(20)], "id long, prompt string, response string")
    tokens = jobs.training_tokens(df, lambda texts: texts.map(lambda t: [len(t)]), "id")
    ids = [r.id for r in tokens.collect()]
    assert sorted(ids) == list(range(20)) != ids and "text" not in tokens.columns


# --- scores ---------------------------------------------------------------------------------------


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([], [1.0]), (None, [1.0]), ([0.0], [1.0]), ([2.0, 2.0, 2.0], [1.0, 1.0, 1.0])]
    df = frame(spark, rows, "a array<float>, b array<float>")
    assert [round(r[0], 6) for r in df.select(evaluate.cosine_similarity("a", "b")).collect()] == [0.707107, 0.0, 0.0, 0.0, 1.0]


def test_empty_answers_score_zero(spark):
    df = frame(spark, [("", "x"), (None, "x"), ("x", "x")], "generated string, response string")
    scored = evaluate.score_answers(df, lambda texts: texts.map(lambda t: [float(len(t)), 1.0]))
    assert [round(r.score, 6) for r in scored.collect()] == [0.0, 0.0, 1.0]


def test_generation_settings_reach_the_model(spark):
    df = frame(spark, [("p",)], "prompt string")
    answer = evaluate.generate(df, lambda prompts, **s: prompts.map(lambda p: f"{p}{sorted(s.items())}"), top_p=0.5)
    assert answer.first().generated == "p[('max_new_tokens', 500), ('temperature', 0.3), ('top_p', 0.5)]"


def test_histogram_edges(spark):
    df = frame(spark, [("a", 0.0), ("a", 1.0), ("a", 0.95), ("a", 1.2), ("a", -0.1), ("b", 0.5)], "model string, score double")
    rows = {r.bin: (r.n_a, r.n_b) for r in evaluate.histogram(df, 10).collect()}
    assert len(rows) == 10 and rows[0] == (1, 0) and rows[9] == (2, 0) and rows[5] == (0, 1)


def test_summaries(spark):
    df = frame(spark, [("x", 0.5), ("x", 1.0), ("y", 0.95)], "category string, score double")
    rows = {r.category: (r.cases, round(r.mean_percent, 6), round(r["std"], 6)) for r in evaluate.summary(df, "category").collect()}
    assert rows == {"x": (2, 75.0, 0.25), "y": (1, 95.0, 0.0)}
    assert [r.score for r in evaluate.low_scores(df).collect()] == [0.5]


def test_best_step_is_the_first(spark):
    log = frame(spark, [(30, 0.5, None), (20, None, 0.1), (10, None, 0.1), (5, None, 0.4)], "step long, loss double, eval_loss double")
    curve = evaluate.loss_curve(log, "eval_loss")
    assert evaluate.best_step(curve).first() == Row(loss=0.1, step=10)


PROBES = {
    '["{\\"prompt\\":\\"x\\"}"]': [],
    '[{"prompt":"c"}] junk': [],
    '[{"prompt":"e"}][{"prompt":"f"}]': [],
    '[{"prompt":"a"}]]': [],
    '[{"prompt":"a"}]}': [],
    '[{"prompt":"a"}, "b": 1': [],
    '[{"prompt":"a"},]': [],
    '{"prompt":"a"}': [],
    "": [],
    "[": [],
    ' [ ] ': [],
    '[{"prompt":"a"}, 1, null, "s", [2], "{}", {"prompt":"b","error":null}]': ["a", "b"],
    '[{"prompt":"a","prompt":"last"}]': ["last"],
    '[{"prompt":"1","response":{"a":[1]}}]\n': ["1"],
    '[{"prompt":"\\u00e9 \\n"}]': ["é \n"],
    '[{"Prompt":"other"}]': [None],
}


def test_strict_arrays(spark):
    files = spark.createDataFrame([(t, str(i), "p") for i, t in enumerate(PROBES)], "value string, file string, path string")
    got = {str(i): [] for i in range(len(PROBES))}
    for r in records.parse_arrays(files).collect():
        got[r.file].append(r.prompt)
    assert list(got.values()) == list(PROBES.values())


def test_a_file_larger_than_a_variant(spark, tmp_path):
    """150 MB in one array."""
    (tmp_path / "large.json").write_text("[" + ",".join(['{"prompt":"' + "x" * 1000 + '"}'] * 150_000) + "]")
    assert records.read_corpus(spark, str(tmp_path)).where(F.length("prompt") == 1000).count() == 150_000
