"""Committed ranges: every row once, whatever happened before."""

import pytest
from pyspark.sql import functions as F

from assayer.plans.evaluation import evaluate
from assayer.plans.spec import AnalysisSpec, EvaluationSpec, ModelSpec, TaskSpec
from assayer.sinks import commits
from assayer.sinks.writers import save_checkpoints
from assayer.sources.runs import read_run_frame
from assayer.streaming.leaderboard import read_leaderboard


def numbered(spark, n, first=0):
    return spark.range(first, n).select(F.col("id").alias("idx"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))


def stored(df):
    rows = [(r["idx"], r["text"], r["flush_group"]) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return sorted(rows)


def expected(n, size, first=0):
    return [(i, f"t{i}", i // size + 1) for i in range(first, n)]


def counting(made):
    def finish(rows):
        made.append(sorted(r["idx"] for r in rows.collect()))
        return rows

    return finish


@pytest.mark.parametrize("batch,every", [(4, 1), (7, 3), (100, 1)])
def test_another_batch_size_and_more_rows(spark, tmp_path, batch, every):
    path, made = str(tmp_path / "t"), []
    assert stored(save_checkpoints(numbered(spark, 50), path, 4, 2, counting(made), parts=3)) == expected(50, 8)
    made.clear()
    assert stored(save_checkpoints(numbered(spark, 50), path, batch, every, counting(made))) == expected(50, batch * every)
    assert made == []
    assert stored(save_checkpoints(numbered(spark, 83), path, batch, every, counting(made))) == expected(83, batch * every)
    assert sum(made, []) == list(range(50, 83))
    assert stored(save_checkpoints(numbered(spark, 20), path, batch, every)) == expected(20, batch * every)


def test_stopped_in_the_middle(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def stops(rows):
        if rows.where("idx = 20").count():
            raise RuntimeError("stopped")
        return rows

    with pytest.raises(RuntimeError, match="stopped"):
        save_checkpoints(numbered(spark, 40), path, 4, 2, stops, parts=5)
    # A folder that was written whole, but not committed.
    numbered(spark, 40).write.parquet(f"{path}/part=left")
    assert stored(save_checkpoints(numbered(spark, 40), path, 3, 1, counting(made), parts=5)) == expected(40, 3)
    assert sum(made, []) == list(range(16, 40))


def test_changed_rows_and_settings_are_made_anew(spark, tmp_path):
    path, made = str(tmp_path / "t"), []
    save_checkpoints(numbered(spark, 40), path, 5, 2, parts=4, settings="a")
    changed = numbered(spark, 40).withColumn("text", F.when(F.col("idx") == 13, "other").otherwise(F.col("text")))
    rows = stored(save_checkpoints(changed, path, 5, 2, counting(made), settings="a"))
    assert rows == [(i, "other" if i == 13 else t, g) for i, t, g in expected(40, 10)] and made == [list(range(10, 20))]
    made.clear()
    assert stored(save_checkpoints(numbered(spark, 40), path, 5, 2, counting(made), settings="b")) == expected(40, 10)
    assert sum(made, []) == list(range(40))


def test_two_jobs_at_a_time(spark, tmp_path):
    """The second one commits the same ranges and others across them before the first looks again."""
    path = str(tmp_path / "t")
    rows = numbered(spark, 30)

    def meanwhile(chosen):
        if not commits.read_log(spark, path):
            commits.complete(rows.where("idx BETWEEN 5 AND 24"), path, lambda r: r, parts=1)
        return chosen

    assert stored(save_checkpoints(rows, path, 5, 2, meanwhile, parts=3)) == expected(30, 10)
    assert [k[:2] for k in commits.valid(rows, path, "")] == [(0, 4), (5, 24), (25, 29)]


def test_gaps_nulls_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = numbered(spark, 30).where("idx NOT BETWEEN 8 AND 19 AND idx <> 3").withColumn("text", F.when(F.col("idx") != 25, F.col("text")))
    again = [save_checkpoints(rows, path, 2, 2).collect() for _ in range(2)]
    assert sorted(again[0]) == sorted(again[1]) and len(again[0]) == 17
    assert save_checkpoints(numbered(spark, 0), str(tmp_path / "none"), 2, 2).collect() == []
    assert commits.gaps(0, 9, []) == [(0, 9)]
    entry = commits.Stretch(3, 5, "", True)
    assert commits.gaps(0, 9, [entry]) == [(0, 2), (6, 9)] and commits.gaps(4, 5, [entry]) == []


def echo():
    return lambda prompts, **_: (list(prompts), list(prompts))


def test_a_run_is_stored_once_however_often_it_is_repeated(spark, tmp_path):
    def task(n):
        rows = spark.range(n).select("id", F.col("id").cast("string").alias("text"))
        return TaskSpec(name="t", dataset=rows, prompt_template="{text}", input_mappings={"text": "text"}, order_by=["id"], reference_field="text", metrics=["accuracy"])

    def run(n, batch, run_id):
        job = EvaluationSpec(output_dir=str(tmp_path), checkpoint_batches=1, batch_size=batch, save_detailed=True, max_detailed_examples=50)
        return evaluate(spark, [ModelSpec("m", echo)], [task(n)], job, run_id=run_id)

    run(9, 3, "other")
    for n, batch in ((10, 2), (10, 3), (16, 5), (16, 5)):
        outcome = run(n, batch, "r")
        assert [(r["num_examples"], r["metrics"]["accuracy:accuracy"]) for r in outcome.results.collect()] == [(n, 1.0)]
        assert {(r["run_id"], r["num_examples"]) for r in spark.read.json(f"{tmp_path}/results").collect()} == {("other", 9), ("r", n)}
        assert spark.read.json(f"{tmp_path}/examples").groupBy("run_id").count().collect().__len__() == 2
        assert spark.read.json(f"{tmp_path}/examples").count() == 9 + n
        frame = read_run_frame(spark, [f"{tmp_path}/r"]).collect()
        assert [(r.run_id, r.num_examples) for r in frame] == [("r", n)]


def test_a_plugin_that_reads_differently_is_run_again(spark, tmp_path):
    rows = spark.range(4).select("id", F.col("id").cast("string").alias("text"))
    common = dict(dataset=rows, input_mappings={"text": "text"}, order_by=["id"])
    job = EvaluationSpec(output_dir=str(tmp_path), checkpoint_batches=1, batch_size=2)
    for template, models in (("{text}", ["m"]), ("<{text}>", ["m"]), ("<{text}>", ["m", "n"])):
        task = TaskSpec(name="t", prompt_template=template, **common)
        outcome = evaluate(spark, [ModelSpec(m, echo) for m in models], [task], job, run_id="r")
        samples = {r["model"]: r["prediction_samples"] for r in outcome.results.collect()}
        assert samples == {m: [template.format(text=i) for i in range(4)] for m in models}


def test_the_board_of_a_repeated_run_counts_each_result_once(spark, tmp_path):
    rows = spark.range(4).select("id", F.col("id").cast("string").alias("text"))
    tasks = [
        TaskSpec(name=n, dataset=rows, prompt_template="{text}", input_mappings={"text": "text"}, order_by=["id"], reference_field="text", metrics=["accuracy"])
        for n in "ab"
    ]
    for _ in range(2):
        evaluate(spark, [ModelSpec("m", echo)], tasks, EvaluationSpec(output_dir=str(tmp_path)), AnalysisSpec(enabled=True, timing="incremental"), run_id="r")
        board = read_leaderboard(spark, f"{tmp_path}/r/leaderboard").collect()
        assert [(r.model, r.metric_value, r.n_results) for r in board] == [("m", 1.0, 2)]
