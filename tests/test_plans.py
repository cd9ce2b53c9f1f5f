import pytest
from pyspark.sql import functions as F

from assayer.functions.reasoning import Delimiters
from assayer.plans import adapters
from assayer.plans.evaluation import evaluate, load_examples
from assayer.plans.rag import load_corpus
from assayer.plans.generation import mode_of
from assayer.sources.runs import read_run_frame
from assayer.plans.spec import EvaluationSpec, ModelSpec, RagSpec, SpecError, TaskSpec


def rag(**changes):
    settings = dict(enabled=True, corpus="corpus", corpus_template="{text}", corpus_mappings={"text": "content"}, embedder="hashed")
    return RagSpec(**{**settings, **changes})


def task(prompt="{context} Answer: {input}", **settings):
    return TaskSpec(name="t", dataset="d", prompt_template=prompt, input_mappings={"input": "text"}, **settings)


def test_context_and_rag_go_together():
    with pytest.raises(SpecError, match="rag is not configured"):
        task()
    with pytest.raises(SpecError, match="rag.enabled is false"):
        task(rag=RagSpec())
    with pytest.raises(SpecError, match="context"):
        task("no placeholder", rag=rag())
    assert task("plain").rag is None


@pytest.mark.parametrize("field", ["corpus", "corpus_template", "corpus_mappings", "embedder"])
def test_rag_needs_its_parts(field):
    with pytest.raises(SpecError, match=field):
        rag(**{field: None})


def test_all_missing_parts_are_named():
    with pytest.raises(SpecError, match="corpus, corpus_template, corpus_mappings, embedder"):
        RagSpec(enabled=True)


def test_rag_rules_and_defaults():
    with pytest.raises(SpecError, match="context_k"):
        rag(context_k=0)
    with pytest.raises(SpecError, match="query_mappings"):
        rag(query_mappings="invalid")
    spec = rag()
    assert (spec.context_k, spec.context_template, spec.context_separator, spec.embed_batch_size) == (3, "{text}", "\n\n", 32)
    asked = task("{context} Answer the question: {input}", rag=spec)
    assert asked.query_template == " Answer the question: {input}" and asked.query_mappings == {"input": "text"}
    other = TaskSpec(name="o", dataset="d", prompt_template="{context}{q}", input_mappings={"q": "question"}, rag=spec)
    assert (other.query_template, other.query_mappings) == ("{q}", {"q": "question"})
    own = task(rag=rag(query_template="Find {input}", query_mappings={"input": "title"}))
    assert (own.query_template, own.query_mappings) == ("Find {input}", {"input": "title"})


def test_evaluation_defaults():
    spec = EvaluationSpec()
    assert (spec.batch_size, spec.prediction_sample_size, spec.max_detailed_examples, spec.checkpoint_batches, spec.save_detailed) == (8, 5, 50, 0, False)
    for wrong in ({"batch_size": 0}, {"prediction_sample_size": 0}, {"max_detailed_examples": 0}, {"checkpoint_batches": -1}):
        with pytest.raises(SpecError):
            EvaluationSpec(**wrong)


def test_constrained_settings():
    assert task("p").constrained is False and task("p").default is None
    nested = task("p", constrained_output={"enabled": True, "default_choice": "b"}, choices=["a", "b"])
    assert nested.constrained and nested.default == "b"
    assert task("p", constrained_output={}, choices=["a"]).constrained is False
    assert task("p", constrained_output=True, choices=["a", "b"]).default == "a"
    assert task("p", constrained_output={"default_choice": "b"}, choices=["a", "b"], default_choice="a").default == "a"


def test_generation_modes():
    constrained = task("p", constrained_output=True, choices=["a"])
    scorer = ModelSpec("m", load_scorer=lambda: None)
    assert mode_of(ModelSpec("m"), task("p")) == "plain"
    assert mode_of(scorer, constrained) == "constrained"
    assert mode_of(ModelSpec("m", load_scorer=lambda: None, path="x/Thinking"), constrained) == "two_phase"
    assert mode_of(ModelSpec("m", load_scorer=lambda: None, path="x/Thinking", is_thinking_model=False), constrained) == "constrained"
    with pytest.raises(SpecError, match="choices"):
        mode_of(scorer, task("p", constrained_output=True))
    with pytest.raises(RuntimeError, match="no scorer"):
        mode_of(ModelSpec("m"), constrained)


def test_adapters():
    assert {type(adapters.create(n)) for n in ("Generic", "QA", "text_generation", "classification", "summarization")} == {adapters.TaskAdapter}
    with pytest.raises(ValueError):
        adapters.create("unknown")
    with pytest.raises(ValueError):
        adapters.register("qa", adapters.TaskAdapter)


def last_word():
    """Thinks aloud, then answers with the last word of the prompt."""
    return lambda prompts, **_: ([f"<t>hm</t> {p.split()[-1]}" for p in prompts], [f"{p} <t>hm</t> {p.split()[-1]}" for p in prompts])


def longest_first():
    return lambda prompts, choices: [[len(c) for c in choices] for p in prompts]


@pytest.fixture()
def examples(spark):
    rows = [(3, "all about sports", 1), (1, "it is business", 2), (2, "hello world", 0), (4, "nothing", 0)]
    return spark.createDataFrame(rows, "id int, text string, label int")


LABELS = ["World", "Sports", "Business"]


def test_evaluation(spark, examples, tmp_path):
    models = [
        ModelSpec("org/last word", last_word, special_tokens={"eos": "</s>"}),
        ModelSpec("chooser", last_word, longest_first, path="base"),
    ]
    settings = dict(dataset=examples, input_mappings={"text": "text"}, order_by=["id"])
    free = TaskSpec(
        name="free", prompt_template="Text: {text}", reference_field="label", label_map=LABELS, metrics=["accuracy"],
        thinking_delimiters=Delimiters("<t>", "</t>"), strip_from_prediction=True, **settings,
    )
    unscored = TaskSpec(name="unscored", prompt_template="{text}", sample_size=2, **settings)
    job = EvaluationSpec(save_detailed=True, output_dir=str(tmp_path), checkpoint_batches=1, batch_size=2, prediction_sample_size=3)
    outcome = evaluate(spark, models, [free, unscored], job)
    rows = {(r.model, r.task): r for r in outcome.results.collect()}
    assert len(rows) == 4
    first = rows["org/last word", "free"]
    assert first.metrics == {"accuracy:accuracy": 0.75}
    assert (first.num_examples, first.prediction_samples, first.model_special_tokens) == (4, ["2", "0", "1"], '{"eos": "</s>"}')
    assert rows["chooser", "unscored"].metrics == {} and rows["chooser", "unscored"].num_examples == 2
    assert {r.metric_name: r.metric_value for r in outcome.summary.collect()} == {"accuracy:accuracy": 0.75}
    detail = outcome.details.where("model = 'chooser' AND task = 'free' AND index = 0").first()
    assert (detail.prompt, detail.prediction_raw) == ("Text: it is business", "Text: it is business <t>hm</t> business")
    assert (detail.prediction_parsed, detail.prediction_thinking, detail.prediction_answer, detail.actual) == ("business", "hm", "business", "2")
    assert outcome.details.count() == 12
    stored = spark.read.json(f"{tmp_path}/results")
    assert sorted(r.model_key for r in stored.select("model_key").distinct().collect()) == ["chooser", "org_last_word"]
    assert spark.read.parquet(f"{tmp_path}/{outcome.run_id}/checkpoints/free").count() == 8
    assert spark.read.json(f"{tmp_path}/examples").count() == 12
    frame = read_run_frame(spark, [f"{tmp_path}/{outcome.run_id}"]).collect()
    assert {(r.run_id, r.model, r.task, r.metric_value, r.num_examples) for r in frame} == {
        (outcome.run_id, "org/last word", "free", 0.75, 4), (outcome.run_id, "chooser", "free", 0.75, 4),
    }


def test_constrained_evaluation(spark, examples):
    choose = TaskSpec(
        name="c", dataset=examples, prompt_template="{text}", input_mappings={"text": "text"}, order_by=["id"],
        reference_field="label", label_map=LABELS, metrics=["accuracy", ("f1", {"average": "micro"}), ("f1", {"average": "macro"})],
        choices=LABELS, constrained_output=True,
    )
    thinker = ModelSpec("thinker", last_word, longest_first, path="a/reasoning-model")
    result = evaluate(spark, [thinker], [choose]).results.first()
    assert result.prediction_samples == ["2"] * 4 and result.metrics["accuracy:accuracy"] == 0.25
    # Of the two metrics named f1 the later one stays: the macro mean over three labels.
    assert result.metrics["f1:f1"] == pytest.approx(0.4 / 3)


def test_retrieval_task(spark, examples):
    corpus = spark.createDataFrame([("b", "sports news"), ("a", "world affairs"), ("c", "business plan")], "name string, body string")
    corpus.createOrReplaceTempView("news")
    spec = TaskSpec(
        name="r", dataset=examples, prompt_template="{context}\n{text}", input_mappings={"text": "text"}, order_by=["id"],
        rag=RagSpec(
            enabled=True, corpus="news", corpus_template="<{body}>", corpus_mappings={"body": "body"}, corpus_order=["name"],
            embedder="hashed", context_k=1, query_template="{text}",
        ),
    )
    details = evaluate(spark, [ModelSpec("m", last_word)], [spec], EvaluationSpec(save_detailed=True)).details
    prompts = {r["index"]: r.prompt for r in details.collect()}
    assert prompts[0].startswith("<business plan>") and prompts[1].startswith("<world affairs>") and prompts[2].startswith("<sports news>")
    extra = details.where("index = 1").select(F.get_json_object("extra", "$.rag.results[0].id").alias("i")).first().i
    assert extra == "0"


def test_field_names_are_free(spark):
    names = ["idx", "context", "prompt", "query", "results", "task"]
    rows = spark.createDataFrame([(n, *(f"{name}{n}" for name in names[1:])) for n in (4, 2)], f"idx int, {', '.join(f'{n} string' for n in names[1:])}")
    spark.createDataFrame([(9, "context2 found")], "corpus_id long, context string").createOrReplaceTempView("one_document")
    spec = TaskSpec(
        name="n", dataset=rows, prompt_template="{context}|{idx}|{passage}|{prompt}|{query}", order_by=["idx"],
        input_mappings={"idx": "idx", "passage": "context", "prompt": "prompt", "query": "query"}, reference_field="results", metrics=["exact_match"],
        rag=RagSpec(enabled=True, corpus="one_document", corpus_template="{c}", corpus_mappings={"c": "context"}, embedder="hashed"),
    )
    details = evaluate(spark, [ModelSpec("m", last_word)], [spec], EvaluationSpec(save_detailed=True)).details
    assert {(r["index"], r.prompt, r.actual_raw) for r in details.collect()} == {
        (0, "context2 found|2|context2|prompt2|query2", "results2"), (1, "context2 found|4|context4|prompt4|query4", "results4"),
    }


def test_own_adapter(spark, examples):
    class Shouting(adapters.TaskAdapter):
        def postprocess(self, predictions, task):
            parsed = super().postprocess(predictions, task)
            return parsed.withColumn("prediction_parsed", F.upper("prediction_parsed"))

    adapters.register("shouting", Shouting)
    spec = TaskSpec(name="s", dataset=examples, prompt_template="{text}", input_mappings={"text": "text"}, order_by=["id"], task_adapter="Shouting", sample_size=1)
    result = evaluate(spark, [ModelSpec("m", last_word)], [spec]).results.first()
    assert (result.prediction_samples, result.task_adapter) == (["<T>HM</T> BUSINESS"], "Shouting")


def test_parquet_files_have_an_order(spark, tmp_path):
    spark.range(20).select((F.col("id") * 7 % 20).alias("id"), F.lit("test").alias("split")).coalesce(1).write.parquet(str(tmp_path / "d"))
    spec = TaskSpec(name="p", dataset=str(tmp_path / "d"), split="test", prompt_template="{id}", input_mappings={"id": "id"}, sample_size=4)
    result = evaluate(spark, [ModelSpec("m", last_word)], [spec]).results.first()
    assert result.prediction_samples == [f"<t>hm</t> {i * 7 % 20}" for i in range(4)]


def test_order_is_needed(spark, examples):
    spec = TaskSpec(name="x", dataset=examples, prompt_template="{text}", input_mappings={"text": "text"})
    with pytest.raises(SpecError, match="order_by"):
        evaluate(spark, [ModelSpec("m", last_word)], [spec])


def test_a_stopped_run_goes_on_from_its_checkpoints(spark, tmp_path):
    (tmp_path / "limit").write_text("5")
    limit, log = str(tmp_path / "limit"), str(tmp_path / "log")

    def load():
        def write(prompts, **_):
            with open(limit) as file, open(log, "a") as seen:
                most = int(file.read())
                if any(int(p) >= most for p in prompts):
                    raise RuntimeError("stopped")
                seen.writelines(f"{p}\n" for p in prompts)
            return list(prompts), list(prompts)

        return write

    examples = spark.range(12).select(F.col("id"), F.col("id").cast("string").alias("text"))
    task_spec = TaskSpec(name="t", dataset=examples, prompt_template="{text}", input_mappings={"text": "text"}, order_by=["id"], reference_field="text", metrics=["accuracy"])
    job = EvaluationSpec(output_dir=str(tmp_path / "out"), checkpoint_batches=2, batch_size=2)
    with pytest.raises(Exception, match="stopped"):
        evaluate(spark, [ModelSpec("m", load)], [task_spec], job, run_id="r")
    before = open(log).read().split()
    assert sorted(set(before), key=int)[:4] == ["0", "1", "2", "3"]
    (tmp_path / "limit").write_text("99")
    outcome = evaluate(spark, [ModelSpec("m", load)], [task_spec], job, run_id="r")
    again = open(log).read().split()[len(before):]
    assert sorted(again, key=int) == [str(i) for i in range(4, 12)]
    assert [r["metrics"]["accuracy:accuracy"] for r in outcome.results.collect()] == [1.0]
    assert spark.read.parquet(f"{tmp_path}/out/r/checkpoints/t").count() == 12


def test_corpora_and_examples_in_the_order_of_their_files(spark, tmp_path):
    for name, first in (("a", 0), ("b", 50)):
        texts = spark.range(first, first + 50, numPartitions=1).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
        texts.write.parquet(f"{tmp_path}/{name}")
    for name in ("a", "b"):
        part = next((tmp_path / name).glob("*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        (tmp_path / "all" / f"{name}.parquet").write_bytes(part.read_bytes())
    described = rag(corpus=f"{tmp_path}/all", corpus_mappings={"text": "text"})
    corpus = load_corpus(spark, described)
    assert sorted((r.corpus_id, r.text) for r in corpus.collect()) == [(i, f"t{i}") for i in range(100)]
    filtered = load_corpus(spark, rag(corpus={"path": f"{tmp_path}/all", "filter": {"column": "text", "pattern": "[05]$"}}, corpus_mappings={"text": "text"}))
    assert sorted((r.corpus_id, r.text) for r in filtered.collect()) == [(i, f"t{5 * i}") for i in range(20)]
    spec = TaskSpec(name="p", dataset=f"{tmp_path}/all", prompt_template="{text}", input_mappings={"text": "text"})
    examples = load_examples(spark, spec, EvaluationSpec())
    assert sorted((r.idx, r.prompt) for r in examples.collect()) == [(i, f"t{i}") for i in range(100)]
    assert "Exchange" not in examples._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    (tmp_path / "files").mkdir()
    for name in ("x", "y"):
        (tmp_path / "files" / f"{name}.txt").write_text(f"text of {name}")
    plain = {"type": "files", "path": f"{tmp_path}/files", "include_metadata": False}
    corpus = load_corpus(spark, rag(corpus=plain, corpus_mappings={"text": "text"}))
    assert sorted((r.corpus_id, r.text) for r in corpus.collect()) == [(0, "text of x"), (1, "text of y")]
