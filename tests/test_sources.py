import datetime
import io
import json
import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from assayer.operators.results import unpivot_metrics
from assayer.queries import all_queries, scans
from assayer.sinks.writers import save_by_run
from assayer.sources import datasets, files
from assayer.sources.loaders import merged, shape_of
from assayer.sources.runs import read_run_frame, read_run_results

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body, header=None):
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        for name, xml in (("document", body), ("header1", header)):
            if xml:
                archive.writestr(f"word/{name}.xml", f'<w:document xmlns:w="{WORD}">{xml}</w:document>')
    return content.getvalue()


@pytest.fixture()
def corpus(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("one two three four five six", encoding="utf-8")
    (tmp_path / "sub" / "b.md").write_text("été", encoding="utf-8")
    (tmp_path / "skip.log").write_text("no")
    (tmp_path / "c.jsonl").write_text('{"text": "x y"}\n\n  \n"lone"\n{"text": null}\n{"other": 1}\n', encoding="utf-8")
    paragraph = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"
    (tmp_path / "d.docx").write_bytes(
        docx(paragraph.format("body") + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r></w:p>", paragraph.format("head"))
    )
    return tmp_path


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


def test_discovery(spark, corpus):
    found = files.discover(spark, [str(corpus), f"{corpus}/*.TXT"])
    assert names(found) == ["a.TXT", "b.md", "c.jsonl", "d.docx"]
    assert names(files.discover(spark, [str(corpus)], ["txt", ".MD"])) == ["a.TXT", "b.md"]
    assert names(files.discover(spark, [str(corpus)], recursive=False)) == ["a.TXT", "c.jsonl", "d.docx"]
    assert names(files.discover(spark, [f"{corpus}/skip.log"])) == []
    with pytest.raises(Exception, match="(?i)path"):
        files.discover(spark, [f"{corpus}/missing"]).collect()
    with pytest.raises(ValueError):
        files.corpus_locations({})


def test_corpus(spark, corpus):
    config = {"path": str(corpus), "glob": f"{corpus}/*.TXT"}
    rows = files.read_corpus(spark, config).collect()
    texts = sorted((r.source_path.rsplit("/", 1)[1], r.line_number, r.text) for r in rows if r.line_number)
    assert texts == [("c.jsonl", 1, "x y"), ("c.jsonl", 2, "lone"), ("c.jsonl", 3, ""), ("c.jsonl", 4, "")]
    whole = {r.source_path.rsplit("/", 1)[1]: r.text for r in rows if not r.line_number}
    assert whole == {"a.TXT": "one two three four five six", "b.md": "été", "d.docx": "head\n\nbody\n\na\tb"}
    bare = files.read_corpus(spark, {**config, "include_metadata": False})
    assert bare.columns == ["text"] and bare.count() == 7
    with pytest.raises(ValueError):
        files.read_corpus(spark, {**config, "chunk_size": 4, "chunk_overlap": 4})
    with pytest.raises(ValueError):
        files.read_corpus(spark, {"path": str(corpus), "extensions": ["pdf"]})


def test_chunked_corpus(spark, corpus):
    chunks = files.read_corpus(spark, {"path": str(corpus), "extensions": ["txt", "jsonl"], "chunk_size": 12, "chunk_overlap": 4})
    found = {(r.source_path.rsplit("/", 1)[1], r.chunk_index): (r.text, r.chunk_start, r.chunk_end) for r in chunks.collect()}
    assert found == {
        ("a.TXT", 0): ("one two", 0, 7), ("a.TXT", 1): ("two three", 4, 13), ("a.TXT", 2): ("four five", 14, 23), ("a.TXT", 3): ("six", 24, 27),
        ("c.jsonl", 0): ("x y", 0, 3), ("c.jsonl", 1): ("lone", 0, 4),
    }


def test_pdf_pages_come_from_a_plugin(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"one\fA\n")
    pages = files.read_corpus(spark, {"path": str(tmp_path)}, lambda content: content.decode().split("\f"))
    assert sorted((r.page, r.text) for r in pages.collect()) == [(0, "one"), (1, "A\n")]
    stored = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    assert [r.text for r in files.extract_texts(stored, lambda content: content.decode().split("\f")).collect()] == ["one\nA"]
    with pytest.raises(ValueError):
        files.read_corpus(spark, {"path": str(tmp_path)})


def test_line_numbers_of_a_split_file(spark, tmp_path):
    lines = [json.dumps({"text": f"line {i}"}) for i in range(1, 3001)]
    (tmp_path / "big.jsonl").write_text("\n\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = files.read_jsonl(spark, [str(tmp_path)])
        assert rows.where(F.concat(F.lit("line "), "line_number") != F.col("text")).count() == 0
        assert rows.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_content(spark):
    line = F.col("l")
    df = spark.createDataFrame([('{"a": {"b": ["x", 2]}}',)], "l string")
    assert df.select(files.json_content(line, "a.b[0]")).first()[0] == "x"
    assert df.select(files.json_content(line, "a.b[1]", strict=False)).first()[0] == "2"
    with pytest.raises(Exception, match="no text"):
        df.select(files.json_content(line, "a.b[1]")).collect()
    others = ["3", "true", '"s"', "null", "2.50", "1e22", "[1, 2]"]
    lines = spark.createDataFrame([(x,) for x in others], "l string").coalesce(1)
    found = [r[0] for r in lines.select(files.json_content(line)).collect()]
    assert found == ["3", "True", "s", "None", "2.5", "1e+22", "[1,2]"]


def few_rows(config):
    return ({"text": f"t{i}", "n": i} for i in range(config.get("rows", 3)))


class Numbers(DataSource):
    @classmethod
    def name(cls):
        return "test_numbers"

    def schema(self):
        return "n int"

    def reader(self, schema):
        return NumbersReader()


class NumbersReader(DataSourceReader):
    def partitions(self):
        return [InputPartition(0), InputPartition(10)]

    def read(self, partition):
        yield from ((partition.value + i,) for i in range(2))


def test_datasets(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(6).withColumn("split", F.expr("CASE WHEN id < 2 THEN 'train' WHEN id < 5 THEN 'validation' ELSE 'test' END")).write.partitionBy("split").parquet(path)

    def ids(dataset, split=None):
        return sorted(r.id for r in datasets.load(spark, dataset, split).collect())

    assert ids(path) == [2, 3, 4]
    assert ids(path, "train") == [0, 1]
    assert ids({"path": path, "split": "test"}, "train") == [5]
    assert ids({"path": path + "/split={split}"}, "train") == [0, 1]
    assert ids({"path": path, "filter": {"column": "id", "pattern": "[34]"}}) == [3, 4]
    assert ids({"path": path, "filter": {"column": "id"}}) == [2, 3, 4]
    assert "PartitionFilters: [isnotnull(split" in datasets.load(spark, path)._jdf.queryExecution().toString()
    spark.range(3).createOrReplaceTempView("some_table")
    assert ids({"name": "some_table", "path": "ignored"}) == [0, 1, 2]
    with pytest.raises(ValueError):
        datasets.load(spark, {"split": "x"})
    with pytest.raises(ValueError):
        datasets.load(spark, 3)


def test_custom_datasets(spark):
    loaded = datasets.load(spark, {"type": "custom", "loader": f"{__name__}.few_rows"})
    assert sorted(r.text for r in loaded.collect()) == ["t0", "t1", "t2"]
    many = datasets.load(spark, {"type": "custom", "loader": f"{__name__}.few_rows", "rows": 100_001})
    assert many.count() == 100_001 and many.distinct().count() == 100_001
    assert datasets.load(spark, {"type": "custom", "loader": f"{__name__}.few_rows", "rows": 0, "schema": "text string"}).columns == ["text"]
    numbers = datasets.load(spark, {"type": "custom", "loader": f"{__name__}.Numbers"})
    assert sorted(r.n for r in numbers.collect()) == [0, 1, 10, 11]


class Shards:
    """Rows of mixed shape; each shard says in which process it was read."""

    def __init__(self, config):
        self.n = config["n"]

    def shards(self):
        return [{"first": i * self.n} for i in range(4)]

    def rows(self, shard):
        for i in range(shard["first"], shard["first"] + self.n):
            row = {"id": i, "pid": os.getpid(), "tags": [] if i % 2 else [i, 0.5], "mixed": i if i % 3 else f"t{i}", "none": None}
            if i == 4 * self.n - 1:
                row |= {"late": datetime.date(2020, 1, 2), "deep": {"a": {"b": b"x"}}}
            elif i == 0:
                row |= {"deep": {"a": {"c": True}, "d": 1 << 70}}
            yield row


def late_rows(config):
    return iter([{"a": None, "b": 1}] * 10_000 + [{"a": "x", "c": 2.5}] * 5)


def test_shards_are_read_by_tasks(spark):
    rows = datasets.load(spark, {"type": "custom", "loader": f"{__name__}.Shards", "n": 700})
    assert dict(rows.dtypes) == {
        "id": "bigint", "pid": "bigint", "tags": "array<double>", "mixed": "string", "none": "string", "late": "date",
        "deep": "struct<a:struct<b:binary,c:boolean>,d:string>",
    }
    found = {r["id"]: r for r in rows.collect()}
    assert len(found) == 2800 and os.getpid() not in {r["pid"] for r in found.values()}
    assert (found[3]["mixed"], found[4]["mixed"], found[4]["tags"], found[5]["tags"], found[6]["none"]) == ("t3", "4", [4.0, 0.5], [], None)
    assert found[2799]["late"] == datetime.date(2020, 1, 2) and bytes(found[2799]["deep"]["a"]["b"]) == b"x" and found[2799]["deep"]["d"] is None
    assert (found[0]["deep"]["a"]["c"], found[0]["deep"]["d"], found[1]["deep"]) == (True, str(1 << 70), None)
    few = datasets.load(spark, {"type": "custom", "loader": f"{__name__}.Shards", "n": 2, "schema": "id long, late date"})
    assert few.columns == ["id", "late"] and few.count() == 8
    assert datasets.load(spark, {"type": "custom", "loader": f"{__name__}.Shards", "n": 0}).columns == []


def test_keys_and_values_of_late_rows_are_kept(spark):
    rows = datasets.load(spark, {"type": "custom", "loader": f"{__name__}.late_rows"})
    assert dict(rows.dtypes) == {"a": "string", "b": "bigint", "c": "double"} and rows.count() == 10_005
    assert [tuple(r) for r in rows.where("c IS NOT NULL").collect()] == [("x", None, 2.5)] * 5


def test_shapes_meet():
    assert merged("bigint", "double") == "double" and merged("void", {"array": "bigint"}) == {"array": "bigint"}
    assert merged({"array": "bigint"}, {"struct": {}}) == merged("boolean", "bigint") == "string"
    assert shape_of([1, None, 2.0]) == {"array": "double"} and shape_of({}) == "void" and shape_of(1 << 63) == "string"
    assert merged({"struct": {"a": "bigint"}}, {"struct": {"b": "void"}}) == {"struct": {"a": "bigint", "b": "void"}}


def test_file_corpora_refuse_what_they_do_not_know(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": {"y": ["no", "yes"]}}')
    corpus = {"type": "files", "path": str(tmp_path)}
    assert [r.text for r in datasets.load(spark, corpus | {"json_jq_schema": ".x.y[1]"}).collect()] == ["yes"]
    for wrong in ({"json_jq_schema": ".x[] | .y"}, {"jq": ".x"}):
        with pytest.raises(ValueError):
            datasets.load(spark, corpus | wrong)


def test_run_results(spark, tmp_path):
    def run(model, task, **metrics):
        return {"model": model, "task": task, "metrics": metrics, "num_examples": 2}

    def write(path, runs):
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps({"runs": runs}, indent=2))

    write(tmp_path / "r1" / "summary.json", [run("m", "t", acc=0.5, ok=True, note="0.9", none=None, many=[1]), None])
    write(tmp_path / "r1" / "m" / "t.json", [run("m", "t", acc=0.1)])
    write(tmp_path / "r2" / "m" / "t.json", [run("m", "t", acc=1)])
    write(tmp_path / "r2" / "m" / "u.json", [{"model": "m", "task": "u", "num_examples": 0}])
    dirs = [str(tmp_path / "r1"), str(tmp_path / "r2")]
    frame = {(r.run_id, r.metric_name): r.metric_value for r in read_run_frame(spark, dirs).collect()}
    assert frame == {("r1", "acc"): 0.5, ("r1", "ok"): 1.0, ("r2", "acc"): 1.0}
    tasks = {(r.run_id, r.metric_name): r.metric_value for r in read_run_frame(spark, dirs, prefer_summary=False).collect()}
    assert tasks == {("r1", "acc"): 0.1, ("r2", "acc"): 1.0}
    assert read_run_results(spark, dirs).count() == 3
    assert unpivot_metrics(read_run_results(spark, dirs)).columns[0] == "run_id"


def test_stored_results_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r9", "m/x", "t", {"acc": 0.5}, 2), ("r9", "m/x", "u", {"acc": 0.25}, 4)],
        "run_id string, model string, task string, metrics map<string,double>, num_examples long",
    )
    save_by_run(rows, f"{tmp_path}/results")
    for prefer in (True, False):
        read = read_run_results(spark, [f"{tmp_path}/results"], prefer_summary=prefer)
        assert sorted((r.run_id, r.model, r.task, r.num_examples) for r in read.collect()) == [("r9", "m/x", "t", 2), ("r9", "m/x", "u", 4)]
    (tmp_path / "results" / "other.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="Neither a list of runs"):
        read_run_results(spark, [f"{tmp_path}/results"]).collect()


def test_paths_have_one_spelling(spark, tmp_path):
    folder = tmp_path / "corp x+y"
    folder.mkdir()
    (folder / "a b.txt").write_text("one")
    (folder / "c d.bin").write_bytes(b"two")
    (folder / "e%20f.jsonl").write_text('{"text": "three"}')
    texts = [r.source for r in files.read_texts(spark, [str(folder)]).collect()]
    lines = [r.source for r in files.read_jsonl(spark, [str(folder)]).collect()]
    pages = [r.source for r in files.read_binary(spark, [str(folder)], lambda c: [c.decode()], [".bin"]).collect()]
    assert [p.removeprefix("file:").lstrip("/") for p in (*texts, *lines, *pages)] == [
        str(folder / name).lstrip("/") for name in ("a b.txt", "e%20f.jsonl", "c d.bin")
    ]


def test_a_named_split_must_exist(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(3).write.parquet(path)
    assert datasets.load(spark, path).count() == 3
    for asked in ({"path": path, "split": "test"}, {"path": path, "kwargs": {"a": 1}}):
        with pytest.raises(ValueError):
            datasets.load(spark, asked)
    with pytest.raises(ValueError, match="split"):
        datasets.load(spark, path, "test")


def test_patterns_are_read_as_in_python(spark):
    rows = spark.createDataFrame([("été",), ("a b",), ("a\u00a0b",), ("xx",)], "t string")
    for pattern in (r"^\w+$", r"a\sb", r"(?P<c>x)(?P=c)", r"\bb"):
        found = {r.t for r in datasets.regex_filter(rows, "t", pattern).collect()}
        assert found == {r.t for r in rows.collect() if re.search(pattern, r.t)}


@pytest.mark.parametrize("sent,stretch", [(200_000, 10_000), (200_000, 3), (0, 10_000)])
def test_chunk_numbers_run_over_lines(spark, tmp_path, monkeypatch, sent, stretch):
    monkeypatch.setattr(files, "_SENT_UNITS", sent)
    monkeypatch.setattr(files, "_STRETCH_UNITS", stretch)
    for name, n in (("a", 40), ("b", 1)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"text": f"{name}{i} " * (i % 4 + 1)}) + "\n" for i in range(n)))
    (tmp_path / "c.txt").write_text("one two three four five")
    chunks = files.read_corpus(spark, {"path": str(tmp_path), "chunk_size": 8, "chunk_overlap": 0})
    assert "_piece" not in chunks.columns
    by_file = {}
    for r in chunks.collect():
        by_file.setdefault(r["source"].rsplit("/", 1)[1], []).append((r["line_number"] or 0, r["start_index"], r["chunk_index"]))
    assert sorted(by_file) == ["a.jsonl", "b.jsonl", "c.txt"]
    for found in by_file.values():
        assert [i for _, _, i in sorted(found)] == list(range(len(found)))
    if sent:
        plan = chunks._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan.replace("BroadcastExchange", "")


def test_chunks_of_whole_texts_are_numbered_in_place(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("one two three four five six seven")
    chunks = files.read_corpus(spark, {"path": str(tmp_path), "chunk_size": 10, "chunk_overlap": 0})
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r["source"], r["start_index"], r["chunk_index"]) for r in chunks.collect())
    assert [i for _, _, i in rows] == [*range(len(rows) // 2)] * 2


def test_the_first_rows_come_from_the_first_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, numPartitions=10).withColumn("even", F.col("id") % 2 == 0).write.parquet(path)
    rows = datasets.load(spark, path, with_order=True)
    for n, most in ((1, 1), (100, 1), (101, 4), (401, 10), (5000, 10)):
        first = datasets.first_rows(rows, n)
        assert len({r[0] for r in first.select("_file").distinct().collect()}) == most
        assert sorted(r["id"] for r in first.orderBy("_file", "_file_row").limit(n).collect()) == list(range(min(n, 1000)))
    few = datasets.first_rows(rows.where("even AND id > 150"), 30)
    assert sorted(r["id"] for r in few.orderBy("_file", "_file_row").limit(30).collect()) == list(range(152, 212, 2))
    found = datasets.first_rows(rows, 100)
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in scan
    numbers = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert numbers.get("numFiles").get().value() == 1


def test_files_by_key_are_written_by_all_tasks(spark, small, tmp_path, monkeypatch):
    """A file per conversation is work even where the bytes are few."""
    monkeypatch.setattr(scans, "new_path", lambda spark, purpose: f"{tmp_path}/{purpose}")
    found = all_queries()["jsonl_scan"](spark, small)
    written = list((tmp_path / "jsonl").glob("conv_id=*/part-*"))
    assert len({path.name.split("-")[1] for path in written}) == 4
    assert len(written) == found.select("conv_id").distinct().count()
