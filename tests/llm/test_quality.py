"""The ledger's measures, bits, policies and ablations."""

import re

from pyspark.sql import functions as F

from assayer.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)),
        len(covered), text.count("!"), sum("A" <= c <= "Z" for c in text),
    )


EIGHT = "one two three four five six seven eight"
TEXTS = [
    None, "", " \n\t\x0b\x0c\r ", "one", EIGHT, f"{EIGHT} {EIGHT}", f"x {EIGHT} y {EIGHT} z {EIGHT}", "a " * 500,
    "l\nl\n\n \nl\nother", "## $$ %%|<>&*", "é\u00a0ö \u2003x 中文 \U0001f600", "AA!! BB!!\n" * 40, "w " * 20_000 + EIGHT,
    " ".join(f"w{i}" for i in range(25)), "\x1c\x1d a \x85 b",
]


def test_measures(spark):
    rows = spark.createDataFrame(
        [(i, t, "mine", -1) for i, t in enumerate(TEXTS)] + [(0, None, "mine", -1)], "id int, text string, _words string, n_words int"
    )
    got = quality.ledger(rows)
    assert got.columns == ["id", "text", "_words", *quality.MEASURES, "failed"]
    found = got.collect()
    assert len(found) == len(TEXTS) + 1 and {r["_words"] for r in found} == {"mine"}
    for r in found:
        assert tuple(r[m] for m in quality.MEASURES) == slow(TEXTS[r["id"]]), TEXTS[r["id"]]


def test_policies_read_the_bits(spark):
    rows = quality.ledger(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")).cache()
    for policy in quality.POLICIES:
        conditions = [r.condition for r in quality.RULES if r.name in policy.rules]
        direct = " OR ".join(f"({c})" for c in conditions)
        judged = quality.apply_policy(rows, policy)
        assert judged.where(F.col("kept") != ~F.expr(direct)).isEmpty()
    for r in quality.ablations(rows, quality.V2).collect():
        rule = next(x for x in quality.RULES if x.name == r["rule"])
        others = " OR ".join(f"({x.condition})" for x in quality.RULES if x is not rule)
        assert r["rows"] == len(TEXTS) and r["failing"] == rows.where(rule.condition).count()
        assert r["only_this"] == rows.where(f"({rule.condition}) AND NOT ({others})").count()
    rows.unpersist()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, text string")
    assert quality.ledger(empty).collect() == [] and quality.ablations(quality.ledger(empty), quality.V1).collect() == []


def test_no_python_in_the_plan(spark):
    plan = quality.ledger(spark.createDataFrame([(1, "a")], "id int, text string").coalesce(1))
    assert not re.search("Python|Arrow|Pandas", plan._jdf.queryExecution().executedPlan().toString())
