import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import metrics
from assayer.plans.analysis import compare, run_tables
from assayer.plans.config import read_job
from assayer.plans.evaluation import evaluate
from assayer.plans.spec import AnalysisSpec, ModelSpec, SpecError
from assayer.sources.runs import read_run_results
from assayer.streaming.leaderboard import read_leaderboard


def repeat():
    return lambda prompts: list(prompts)


TYPES = {"repeat": lambda settings: ModelSpec(settings["name"], repeat, path=settings.get("model_path", ""))}


def config(**task):
    base = {"name": "t", "dataset": "rows", "prompt_template": "{x}", "input_mappings": {"x": "text"}, "order_by": ["id"]}
    return {"models": [{"name": "m", "type": "repeat"}], "tasks": [{**base, **task}]}


def test_job_from_a_mapping():
    job = read_job(
        {
            **config(
                metrics=["accuracy", {"name": "rouge", "args": {"rouge_types": ["rouge1"]}, "adapter": "default"}],
                thinking_delimiters={"start": "<t>", "end": "</t>", "strip_from_prediction": True},
                prompt_template="{context} {x}",
                rag={"enabled": True, "corpus": "c", "corpus_template": "{b}", "corpus_mappings": {"b": "body"}, "embedding_model": {"model_path": "hashed", "batch_size": 4}},
            ),
            "evaluation": {"batch_size": 2, "log_level": "INFO"},
            "analysis": {"enabled": True, "plots": "extended"},
        },
        TYPES,
    )
    task = job.tasks[0]
    assert task.metrics == ["accuracy", ("rouge", {"rouge_types": ["rouge1"]})]
    assert task.thinking_delimiters.strip_from_prediction and task.rag.embed_batch_size == 4
    assert job.evaluation.batch_size == 2 and job.models[0].name == "m" and job.analysis.plots == "extended"


@pytest.mark.parametrize(
    "broken,message",
    [
        ({"tasks": []}, "models"),
        ({**config(), "tasks": "t"}, "tasks"),
        ({**config(), "models": [{"type": "repeat"}]}, "name"),
        ({**config(), "models": [{"name": "m", "type": "other"}]}, "unknown type"),
        (config(input_mappings="x"), "input_mappings"),
        (config(metrics="rouge"), "metrics"),
        (config(colour="red"), "colour"),
        ({"models": [], "tasks": [{"name": "t", "input_mappings": {}}]}, "dataset"),
        ({**config(), "evaluation": {"batch_size": 0}}, "batch_size"),
        ({**config(), "analysis": {"plots": "all"}}, "plots"),
        (config(rag={"enabled": True, "corpus": "c", "corpus_template": "x", "corpus_mappings": {"a": "b"}, "embedding_model": {"model_path": "e"}}), "embedder plug-in"),
        (config(prompt_template="{context}", rag={"enabled": True}), "embedder"),
    ],
)
def test_broken_jobs(broken, message):
    with pytest.raises(SpecError, match=message):
        read_job(broken, TYPES)


def test_run_and_compare(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "a"), (2, "b", "b")], "id int, text string, answer string").createOrReplaceTempView("rows")
    described = config(reference_field="answer", metrics=["exact_match", {"name": "rouge", "args": {"rouge_types": ["rouge1"]}}])
    job = read_job({**described, "evaluation": {"output_dir": str(tmp_path)}, "analysis": {"enabled": True, "plots": "extended"}}, TYPES)
    outcome = evaluate(spark, job.models, job.tasks, job.evaluation, job.analysis)
    folder = tmp_path / outcome.run_id / "analysis"
    assert sorted(p.name for p in folder.iterdir()) == ["by_model", "by_task", "heatmap_exact_match_exact_match", "heatmap_rouge_rouge1", "summary_table"]
    table = spark.read.json(str(folder / "summary_table")).first()
    assert table["exact_match:exact_match"] == 0.5 and table["rouge:rouge1"] == pytest.approx((2 / 3 + 1) / 2)


def test_compare_stored_runs(spark, tmp_path):
    for run_id, value in (("r1", 0.25), ("r2", 0.75)):
        runs = [{"model": "m", "task": t, "metrics": {"acc": value, "other": 1}, "num_examples": 1} for t in ("t", "u")]
        (tmp_path / run_id).mkdir()
        (tmp_path / run_id / "summary.json").write_text(json.dumps({"runs": runs}))
    tables = compare(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")], AnalysisSpec(metrics_exclude=["other"]))
    rows = sorted((r.axis, r.category, r.run_id, r.metric_value) for r in tables["by_run"].collect())
    assert rows == [("task", "t", "r1", 0.25), ("task", "t", "r2", 0.75), ("task", "u", "r1", 0.25), ("task", "u", "r2", 0.75)]
    assert tables["summary_table"].first().asDict() == {"model": "m", "acc": 0.5, "other": 1.0}
    assert list(run_tables(spark.createDataFrame([], "metric_name string, model string, metric_value double"), AnalysisSpec(plots="minimal"))) == ["by_model"]


def test_metric_adapters_and_a_leaderboard_on_the_way(spark, tmp_path):
    metrics.register_adapter("Doubled", lambda scored, name, args: metrics.compute(scored, name, **args).withColumn("metric_value", F.col("metric_value") * 2))
    spark.createDataFrame([(1, "a", "a"), (2, "b", "c")], "id int, text string, answer string").createOrReplaceTempView("pairs")
    described = config(dataset="pairs", reference_field="answer", metrics=[{"name": "exact_match", "adapter": "doubled"}])
    settings = {**described, "evaluation": {"output_dir": str(tmp_path)}, "analysis": {"enabled": True, "timing": "incremental"}}
    job = read_job(settings, TYPES)
    outcome = evaluate(spark, job.models, job.tasks, job.evaluation, job.analysis)
    value = outcome.results.first()["metrics"]["exact_match:exact_match"]
    board = read_leaderboard(spark, f"{tmp_path}/{outcome.run_id}/leaderboard").collect()
    assert [(r.metric_name, r.metric_value, r.n_results) for r in board] == [("exact_match:exact_match", value, 1)] and value in (1.0, 2.0)
    assert read_run_results(spark, [f"{tmp_path}/results"], prefer_summary=False).count() == 1
    with pytest.raises(SpecError, match="adapter"):
        read_job(config(metrics=[{"name": "exact_match", "adapter": "none such"}]), TYPES)
    with pytest.raises(SpecError, match="timing"):
        read_job({**config(), "analysis": {"timing": "sometimes"}}, TYPES)
