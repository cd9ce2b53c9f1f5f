import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.choices import extract_choice, is_constrained, postprocess
from assayer.functions.fields import resolve_field
from assayer.functions.labels import LabelMap, prediction_id, reference_id
from assayer.functions.naming import completion_of, is_reasoning_model, output_key
from assayer.functions.reasoning import Delimiters, split_reasoning
from assayer.functions.templates import render, render_values
from assayer.functions.text import python_text, strip


def one(spark, column, **values):
    """The value of an expression over a single row."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", [" a\n", "  x y　\x1c", "", "\t \n", "é\u0085"])
def test_strip_is_pythons(spark, text):
    assert one(spark, strip(F.col("t")), t=text) == text.strip()


@pytest.mark.parametrize(
    "number",
    [0.0, -0.0, 1.5, -2.25, 1e7, 12345678.9, 1e15, 1e16, 1.5e300, 0.001, 0.0001, 0.00012, 1e-5, 1.25e-7,
     float("inf"), float("-inf"), 123456789012345680.0, 100.0, 9999999.0],
)
def test_float_text_is_pythons(spark, number):
    assert one(spark, python_text(F.col("v"), T.DoubleType()), v=number) == str(number)


def test_missing_and_flags_as_text(spark):
    assert one(spark, python_text(F.lit(None).cast("string"), T.StringType())) == "None"
    assert one(spark, python_text(F.lit(True), T.BooleanType())) == "True"


SPECS = [
    ("{v:.2f}", 2.675), ("{v:.2f}", 0.125), ("{v:,.1f}", -1234567.25), ("{v:10.3f}|", 3.14159), ("{v:08.2f}", -3.5),
    ("{v:.1%}", 0.1234), ("{v:5d}", 42), ("{v:05d}", -42), ("{v:,}", 1234567), ("{v:<6}|", 7), ("{v:^7}|", "ab"),
    ("{v:>5}", "é"), ("{v:*<4}", "x"), ("{v:.2}", "abc"), ("{{{v}}}", "x"), ("{v!s:>4}", 1), ("plain", 1), ("{v:f}", 1.5),
]


@pytest.mark.parametrize("template,value", SPECS)
def test_templates_format_like_python(spark, template, value):
    dtype = T.StringType() if isinstance(value, str) else T.DoubleType() if isinstance(value, float) else T.IntegerType()
    assert one(spark, render_values(template, {"v": (F.col("v"), dtype)}), v=value) == template.format(v=value)


def test_templates_reject_what_they_cannot_do():
    text = {"v": (F.lit("x"), T.StringType())}
    with pytest.raises(KeyError):
        render_values("{unknown}", text)
    for template in ("{v!r}", "{v:x}", "{v:.2f}", "{v:d}"):
        with pytest.raises(ValueError):
            render_values(template, text)


NESTED = "translation struct<en string>, answers array<struct<text string>>, extra map<string, int>"


def test_field_paths(spark):
    df = spark.createDataFrame([(("hi",), [("a",), ("b",)], {"n": 1})], NESTED)

    def read(path):
        return df.select(resolve_field(df.schema, path)[0].alias("x")).first()["x"]

    assert (read("translation.en"), read("answers.1.text"), read("extra.n")) == ("hi", "b", 1)
    with pytest.raises(KeyError):
        resolve_field(df.schema, "translation.de")
    with pytest.raises(KeyError):
        resolve_field(df.schema, "answers.first")
    with pytest.raises(IndexError):
        resolve_field(df.schema, "answers.-1")
    with pytest.raises(KeyError):
        resolve_field(df.schema, "translation.en.x")
    for path in ("answers.2.text", "extra.missing"):
        with pytest.raises(Exception, match="path"):
            read(path)


def test_extras_override_mappings(spark):
    df = spark.createDataFrame([("row", "ctx")], "a string, c string")
    column = render(df.schema, "{x}-{context}", {"x": "a", "context": "a"}, {"context": (F.col("c"), T.StringType())})
    assert df.select(column.alias("x")).first()["x"] == "row-ctx"


TAGGED = "p <t> x </t> a"
REASONING = [
    (TAGGED, {}, ("x", "a")),
    (TAGGED, {"mode": "remove"}, ("x", "p  a")),
    (TAGGED, {"mode": "before_start"}, ("x", "p")),
    (TAGGED, {"mode": "none"}, ("x", TAGGED)),
    (TAGGED, {"keep_delimiters": True}, ("<t> x </t>", "a")),
    (" no tags ", {}, (None, " no tags ")),
    ("</t> q <t> x", {}, ("x", "")),
    ("x</t>y</t> z", {"start": None}, ("x</t>y", "z")),
    ("x</t>y</t> z", {"start": None, "mode": "remove"}, ("x</t>y", "z")),
    ("x</t>y</t> z", {"start": None, "keep_delimiters": True, "mode": "before_start"}, ("x</t>y</t>", "x</t>y")),
    ("a <t> b", {"end": None}, ("b", "")),
    (" a ", {"start": None, "end": None}, (None, " a ")),
]


@pytest.mark.parametrize("text,settings,expected", REASONING)
def test_reasoning_split(spark, text, settings, expected):
    marks = Delimiters(**{"start": "<t>", "end": "</t>", **settings})
    assert tuple(one(spark, split_reasoning(F.col("t"), marks), t=text)) == expected


CHOICES = [
    ("<answer> b </answer> then C", "B"), ("I choose c", "C"), ("Answer is: D because", "D"),
    ("The option: a or b?", "A"), ("Answer: because", "B"), ("grab A.", "C"), ("nothing", "C"), ("x b \n", "B"),
]


@pytest.mark.parametrize("text,expected", CHOICES)
def test_choice_extraction(spark, text, expected):
    assert one(spark, extract_choice(F.col("t"), ["A", "B", "C", "D"], "C"), t=text) == expected


def test_choice_details(spark):
    assert one(spark, extract_choice(F.col("t"), ["Sci/Tech", "C++ (x)"]), t="so: c++ (x)") == "Sci/Tech"
    assert one(spark, extract_choice(F.col("t"), ["Sci/Tech", "C++ (x)"]), t="answer: c++ (x)") == "C++ (x)"
    assert one(spark, extract_choice(F.col("t"), ["yes", "YES"]), t="yes") == "YES"
    assert one(spark, extract_choice(F.col("t"), ["été", "b"]), t="ÉTÉ") == "été"
    with pytest.raises(ValueError):
        extract_choice(F.lit("x"), [])
    assert one(spark, is_constrained(F.col("t"), ["a", "b"]), t="b") is True
    assert one(spark, is_constrained(F.col("t"), ["a", "b"]), t="b\n") is False


def test_postprocess(spark):
    marks = Delimiters("<t>", "</t>")
    text = F.col("t")
    assert one(spark, postprocess(text, delimiters=marks), t=" <t>x</t> b ") == "<t>x</t> b"
    assert one(spark, postprocess(text, delimiters=marks, strip_reasoning=True), t=" <t>x</t> b ") == "b"
    assert one(spark, postprocess(text, ["a", "b"]), t="none of it") == "a"
    assert one(spark, postprocess(F.lit(None).cast("string"))) == "None"


LABELS = ["World", "Sports", "Business", "Sci/Tech"]
PREDICTIONS = [
    (" sports ", 1), ("It is Business or World", 0), ("3", 3), ("7", 7), ("", -1), ("none", -1), ("+2", 2),
    ("1_0", 10), ("sci/tech!", 3), ("2.0", -1), ("99999999999999999999", -1),
]


@pytest.mark.parametrize("text,expected", PREDICTIONS)
def test_prediction_ids(spark, text, expected):
    assert one(spark, prediction_id(F.col("t"), LabelMap.of(LABELS)), t=text) == expected


@pytest.mark.parametrize(
    "value,dtype,expected",
    [(2, "int", 2), (2.9, "double", 2), (9, "int", -1), ("WORLD ", "string", 0), (None, "string", -1), (None, "int", -1), (True, "boolean", 1)],
)
def test_reference_ids(spark, value, dtype, expected):
    column = F.lit(value).cast(dtype)
    kind = spark.range(1).select(column.alias("x")).schema["x"].dataType
    assert one(spark, reference_id(column, kind, LabelMap.of(LABELS))) == expected


def test_label_maps():
    assert LabelMap.of({1: "b", 0: "a"}) == LabelMap.of({"b": 1, "a": 0}) == LabelMap.of(["a", "b"])
    with pytest.raises(ValueError):
        LabelMap.of({"a": "b"})


def test_names(spark):
    assert one(spark, output_key(F.lit("org/my model"))) == "org_my_model"
    flag = F.lit(None).cast("boolean")
    assert one(spark, is_reasoning_model(flag, F.lit("x/Some-THINKING"))) is True
    assert one(spark, is_reasoning_model(F.lit(False), F.lit("x/reasoning"))) is False
    assert one(spark, completion_of(F.lit("ab"), F.lit("a"))) == "b"
