import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions.text import text_steps
from assayer.operators import inference, metrics, results
from assayer.operators.embedding import embed_hashed, embed_with, first_token_pool, mean_pool
from assayer.operators.inference import best_choice, generate, stop_strings, two_phase
from assayer.operators.joins import for_each_model, join_spread
from assayer.operators.positions import batch_ledger, first_k, flush_group, head, progress_rows, with_position
from assayer.sinks.writers import save


def test_positions_of_a_hot_group(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 2003).alias("k"),
    )
    df = df.withColumn("g", F.when(F.col("k") % 100 != 5, F.col("g")))
    numbered = with_position(df.repartition(7), ["k"], within=["g"], start=1)
    wrong = numbered.selectExpr("idx", "row_number() OVER (PARTITION BY g ORDER BY k) AS r").where("idx <> r")
    assert numbered.count() == 2000 and wrong.count() == 0
    overall = with_position(df.repartition(7), ["k"]).selectExpr("idx", "row_number() OVER (ORDER BY k) - 1 AS r")
    assert overall.where("idx <> r").count() == 0


def test_head_beyond_the_driver(spark, monkeypatch):
    monkeypatch.setattr("assayer.operators.positions._DRIVER_HEAD", 3)
    df = spark.range(100).repartition(5)
    assert sorted(r.id for r in head(df, ["id"], 10).collect()) == list(range(10))
    assert sorted(r.id for r in head(df, ["id"], 2).collect()) == [0, 1]
    assert head(df, ["id"], None).count() == head(df, ["id"], 0).count() == 100


def test_batches(spark):
    examples = spark.range(5).select(F.lit("m").alias("model"), F.col("id").alias("idx"))
    ledger = batch_ledger(examples, ["model"], batch_size=2)
    rows = sorted((r.batch, r.rows, r.first_idx, r.total_batches) for r in ledger.collect())
    assert rows == [(1, 2, 0, 3), (2, 2, 2, 3), (3, 1, 4, 3)]
    assert sorted(r.batch for r in progress_rows(ledger, 2).collect()) == [2, 3]
    assert sorted(r.batch for r in progress_rows(ledger, 0).collect()) == [1, 2, 3]
    assert [tuple(r) for r in batch_ledger(examples, ["model"]).select("batch", "rows").collect()] == [(1, 5)]
    groups = examples.select(flush_group(F.col("idx"), 2, 2).alias("g")).groupBy("g").count().collect()
    assert sorted(tuple(r) for r in groups) == [(1, 4), (2, 1)]


def test_job_grid(spark):
    rows = for_each_model(spark.createDataFrame([("t1",), ("t2",)], "task string"), ["b", "a"]).collect()
    assert sorted((r.model_order, r.model, r.task) for r in rows) == [(0, "b", "t1"), (0, "b", "t2"), (1, "a", "t1"), (1, "a", "t2")]


@pytest.mark.parametrize("hot_rows", [1, 7, 1000])
def test_join_of_hot_keys(spark, hot_rows):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = join_spread(left, right, "k", "id", hot_rows).collect()
    assert len(joined) == 300 and all(r.v == (r.k * 2 if r.k < 40 else None) for r in joined)


def test_pooling(spark):
    tokens = spark.createDataFrame(
        [(1, 0, [3.0, 0.0], 1), (1, 1, [3.0, 8.0], 1), (1, 2, [9.0, 9.0], 0), (2, 0, [1.0, 1.0], 0)],
        "doc int, pos int, vector array<double>, mask int",
    )
    pooled = {r.doc: r.embedding for r in mean_pool(tokens, "doc", "vector", F.col("mask")).collect()}
    assert pooled[1] == pytest.approx([0.6, 0.8]) and pooled[2] == [0.0, 0.0]
    firsts = {r.doc: r.embedding for r in first_token_pool(tokens, "doc", "pos", "vector").collect()}
    assert firsts[1] == pytest.approx([1.0, 0.0])


def test_embedders(spark):
    texts = spark.createDataFrame([(1, "a a b"), (2, "?!")], "id int, text string")
    rows = embed_hashed(texts, "id", "text", 16).collect()
    assert [r.id for r in rows] == [1] and sum(x * x for x in rows[0].embedding) == pytest.approx(1)

    def load():
        return lambda batch: [[3.0 * len(t), 4.0 * len(t)] for t in batch]

    assert embed_with(texts, "text", load, batch_size=1).first().embedding == pytest.approx([0.6, 0.8])


def test_generation_in_batches(spark):
    def load():
        return lambda prompts: [f"{p}/{len(prompts)}" for p in prompts]

    prompts = spark.range(5).coalesce(1).select(F.col("id").cast("string").alias("p"))
    rows = prompts.select(generate(F.col("p"), load, 2).alias("o")).select("o.*").collect()
    assert [r.completion for r in rows] == ["0/2", "1/2", "2/2", "3/2", "4/1"]
    assert [r.raw for r in rows] == [r.completion for r in rows]
    assert prompts.limit(0).select(generate(F.col("p"), load, 2)).count() == 0


def test_choices_by_score(spark):
    scores = [F.lit(0.5), F.lit(0.7), F.lit(0.7)]
    assert spark.range(1).select(best_choice(scores, ["x", "z", "a"]).alias("c")).first().c == "z"
    with pytest.raises(ValueError):
        best_choice([], [])


def test_two_phases(spark):
    def generator():
        return lambda prompts, stop_strings, width: [p[-width:].upper() + "".join(stop_strings[:-1]) for p in prompts]

    def scorer():
        return lambda prompts, choices, width: [[0.0, float(p.endswith("\n<t><T>\n</t>\n<answer>"))] for p in prompts]

    df = spark.createDataFrame([("ask",)], "prompt string")
    row = two_phase(df, "prompt", ["no", "yes"], generator, scorer, "<t>", "</t>", settings={"width": 3}).first()
    assert row.completion == "yes" and row.raw == "<t><T>\n</t>\n<answer>yes"
    assert stop_strings(["x"]) == ["x", "</think"] and stop_strings(["</think"]) == ["</think"]


@pytest.fixture()
def scored(spark):
    rows = [(0, 1, 1), (1, 1, 0), (2, 0, 0), (3, -1, -1), (4, 2, 1)]
    df = spark.createDataFrame(rows, "idx int, prediction int, reference int")
    return df.withColumns({"model": F.lit("m"), "task": F.lit("t")})


def values(df):
    return {r.metric_name: round(r.metric_value, 6) for r in df.collect()}


def test_metrics(scored):
    assert values(metrics.compute(scored, "ACCURACY")) == {"accuracy:accuracy": 0.6}
    assert values(metrics.compute(scored, "f1")) == {"f1:f1": 0.5}
    assert values(metrics.compute(scored, "precision", average="macro")) == {"precision:precision": 0.625}
    assert values(metrics.compute(scored, "recall", average="micro")) == {"recall:recall": 0.6}
    assert len(values(metrics.compute_all(scored, ["accuracy", ("f1", {"average": "weighted"})]))) == 2
    with pytest.raises(ValueError):
        metrics.compute(scored, "unheard_of")
    with pytest.raises(ValueError):
        metrics.compute(scored, "f1", average="other")


def test_null_never_equals_a_value(scored):
    nulls = scored.withColumn("reference", F.lit(None).cast("int"))
    assert values(metrics.compute(nulls, "exact_match")) == {"exact_match:exact_match": 0.0}


def test_python_metric_adds_up_over_batches(spark, scored):
    metrics.register_python(
        "gap", lambda p, r, scale: {"n": len(p), "sum": scale * sum(abs(a - b) for a, b in zip(p, r))},
        lambda sums: {"mean": sums["sum"] / sums["n"], "absent": sums["never"]},
    )
    assert values(metrics.compute(scored.repartition(3), "gap", scale=10)) == {"gap:mean": 4.0, "gap:absent": 0.0}


def test_results(spark, scored):
    row = results.run_results(scored, metrics.compute(scored, "accuracy"), 2).first()
    assert (row.metrics, row.num_examples, row.prediction_samples) == ({"accuracy:accuracy": 0.6}, 5, [1, 1])
    assert results.run_results(scored, None).first().metrics == {}


def test_compare_axis(spark):
    rows = [("r1", "m1", "t1", "a", 1.0, 1), ("r2", "m1", "t2", "a", 3.0, 1), ("r1", "m2", "t1", "b", 5.0, 1), ("r1", "m3", None, "c", 2.0, 1)]
    frame = spark.createDataFrame(rows, "run_id string, model string, task string, metric_name string, metric_value double, num_examples int")
    found = sorted((r.metric_name, r.axis, r.category, r.run_id, r.metric_value) for r in results.compare_runs(frame).collect())
    assert found == [("a", "task", "t1", "r1", 1.0), ("a", "task", "t2", "r2", 3.0), ("b", "model", "m2", "r1", 5.0), ("c", "model", "m3", "r1", 2.0)]
    assert [r.metric_name for r in results.select_metrics(frame, exclude=["b"]).collect()] == ["a", "c"]
    assert results.only_metrics(frame, include=["a"]).count() == 2
    assert [r.line for r in results.report(frame).orderBy("line_number").collect()] == ["Summary metrics:", "- a: 2.0000", "- b: 5.0000", "- c: 2.0000"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", "a/b c", "t", [1], None)], "run_id string, model string, task string, list array<int>, none string")
    save(df, str(tmp_path / "j"), "JSON")
    assert (tmp_path / "j" / "run_id=r" / "model_key=a_b_c" / "task_key=t").is_dir()
    save(df, str(tmp_path / "c"), "csv")
    lines = {line for part in (tmp_path / "c").glob("*.csv") for line in part.read_text().splitlines()}
    assert lines == {"list,model,none,run_id,task", "[1],a/b c,,r,t"}
    with pytest.raises(ValueError):
        save(df, str(tmp_path / "x"), "xml")


def test_metric_arguments(spark):
    rows = [("m", "t", i, p, r) for i, (p, r) in enumerate([("A b!", "a b"), ("x1", "x"), ("same", "same"), (None, "None"), ("the cat", "cat")])]
    scored = spark.createDataFrame(rows, "model string, task string, idx long, prediction string, reference string")

    def value(name, **args):
        return metrics.compute(scored, name, **args).first()["metric_value"]

    assert value("accuracy") == 0.2 and value("accuracy", normalize=False) == 1.0
    assert value("exact_match") == 0.2 and value("exact_match", ignore_case=True) == 0.2
    assert value("exact_match", ignore_case=True, ignore_punctuation=True) == 0.4
    assert value("exact_match", ignore_numbers=True) == 0.4
    assert value("exact_match", regexes_to_ignore=["the "]) == 0.4
    assert value("rouge", rouge_types=["rouge1"], use_stemmer=False, use_aggregator=True) > 0
    for wrong in ({"use_stemmer": True}, {"use_aggregator": False}):
        with pytest.raises(ValueError):
            metrics.compute(scored, "rouge", **wrong)


def test_positions_leave_columns_of_any_name(spark):
    names = ["_row", "_part", "_shift", "_first", "_rows", "_key_0", "_key_1", "_rank", "_position"]
    df = spark.createDataFrame([(i % 3, i, *(f"{n}{i}" for n in names)) for i in range(30)], f"g int, i int, {', '.join(f'{n} string' for n in names)}")
    before = {r["i"]: tuple(r) for r in df.collect()}
    for got, extra in ((with_position(df, ["i"], within=["g"]), 1), (first_k(df, ["g"], "i", 4), 0), (head(df, ["i"], 7), 0)):
        rows = got.collect()
        assert rows and all(tuple(r)[: len(r) - extra] == before[r["i"]] for r in rows)
    assert sorted((r["g"], r["idx"]) for r in with_position(df, ["i"], within=["g"]).collect()) == [(g, n) for g in range(3) for n in range(10)]


def test_prompts_become_python_strings_list_by_list():
    prompts = pa.array(["x" * 10_000 + str(i) for i in range(1000)] + [None])
    tracemalloc.start()
    sizes = [len(batch) for batch in inference._lists(prompts, 32)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [32] * 31 + [9] and peak < 2_000_000
    assert [batch for batch in inference._lists(prompts, None)] == [prompts.to_pylist()] and not list(inference._lists(prompts[:0], None))


def test_scores_of_a_batch_are_given_list_by_list(spark):
    texts = spark.range(0, 70, 1, 2).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("text"))
    made = inference.generate(F.col("text"), lambda: lambda rows: ([f"{len(rows)}" for _ in rows], rows), 16)
    chosen = inference.choose(F.col("text"), ["a", "b"], lambda: lambda rows, choices: [[r is None, r is not None] for r in rows], 16)
    found = texts.select("id", "text", made.alias("made"), chosen.alias("choice")).collect()
    assert sorted(r["id"] for r in found) == list(range(70))
    assert all(r["made"]["raw"] == r["text"] and r["choice"] == ("a" if r["text"] is None else "b") for r in found)
    assert {r["made"]["completion"] for r in found} == {"16", "3"}


def test_steps_of_texts_are_bounded_by_bytes():
    texts = pa.array(["ab" * 100, None, "", "x" * 5000, "yz", *["abc"] * 50])
    found = list(text_steps(texts, 20, 1000))
    assert [i for a, b in found for i in range(a, b)] == list(range(len(texts)))
    for a, b in found:
        assert b - a == 1 or b - a <= 20 and sum(len(t or "") for t in texts[a:b].to_pylist()) <= 1000
    assert not list(text_steps(texts[:0], 20))
