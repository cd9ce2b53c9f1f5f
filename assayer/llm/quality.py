"""Quality rules as a ledger: every rule is judged once, policies read the stored bits.

Built from DataFrame functions only. One pass measures each text and sets one bit for each
rule that the row fails (:func:`ledger`); a policy is a named, versioned mask of rules
(:class:`Policy`), so that a change of policy (:func:`apply_policy`) or a study of what each
rule costs (:func:`ablations`) reads the bits and never the texts.

Nulls, and texts without a word, count as empty: all measures are 0 and the rules on too few
words fail. Rows are judged one by one, so repeated rows get equal rows and an empty table an
empty ledger. Equal windows of words are found by 64-bit hashes inside one text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import fresh

WINDOW = 8
_SYMBOLS = "[#*$%&|<>]"
_CAPITALS = "[A-Z]"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_capitals",
)


@dataclass(frozen=True)
class Rule:
    """A row fails when ``condition`` over the measures holds; ``bit`` never changes its meaning."""

    bit: int
    name: str
    condition: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 5 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "exclamations", "2 * n_exclaims > n_words"),
    Rule(5, "capitals", "2 * n_capitals > word_chars"),
    Rule(6, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
)


@dataclass(frozen=True)
class Policy:
    """A version of the rules that reject a row."""

    name: str
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
V1 = Policy("v1", BASE.rules + ("symbols", "repeated_lines"))
V2 = Policy("v2", V1.rules + ("exclamations", "capitals", "word_length"))
POLICIES = (BASE, V1, V2)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)




def _pairs(hashes: Column, distance: int) -> Column:
    """Hashes of each element with the one ``distance`` further on."""
    n = F.size(hashes) - distance
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + distance, n), lambda a, b: F.xxhash64(a, b))


def _windows(words: Column) -> Column:
    """One hash for each run of eight words: of pairs, of pairs of pairs, of pairs of those."""
    return _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda one: _let(_pairs(one, 1), lambda two: _let(_pairs(two, 2), lambda four: _pairs(four, 4))),
    )


def _covered(windows: Column) -> Column:
    """How many words lie in a window whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def beside(rows: Column) -> Column:
        n = F.size(rows)
        equal = F.filter(
            rows,
            lambda r, j: F.when(j > 0, F.get(rows, j - 1)["h"] == r["h"]).otherwise(False)
            | F.when(j < n - 1, F.get(rows, j + 1)["h"] == r["h"]).otherwise(False),
        )
        return F.sort_array(F.transform(equal, lambda r: r["i"]))

    return F.aggregate(
        _let(placed, beside),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n")
        ),
        lambda acc: acc["n"],
    )


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns of :data:`MEASURES` (long), replacing columns of the same names."""
    body, words, lines, windows = (fresh(x, [*df.columns, *MEASURES]) for x in ("_body", "_words", "_lines", "_windows"))
    kept = [c for c in df.columns if c not in MEASURES]
    df = df.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    # In Java patterns \s is exactly the space and the controls from \t to \r.
    df = df.withColumn(words, F.array_remove(F.split(F.col(body), "\\s+"), "")).withColumn(
        lines, F.filter(F.split(F.col(body), "\n"), lambda x: x.rlike("\\S"))
    )
    df = df.withColumn(
        windows,
        F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(_windows(F.col(words))),
    )
    repeated = F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        _covered(F.col(windows))
    )
    values = {
        "n_words": F.size(words),
        "word_chars": F.aggregate(words, F.lit(0), lambda n, w: n + F.char_length(w)),
        "n_symbols": F.regexp_count(F.col(body), F.lit(_SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated,
        "n_exclaims": F.char_length(F.col(body)) - F.char_length(F.replace(F.col(body), F.lit("!"), F.lit(""))),
        "n_capitals": F.regexp_count(F.col(body), F.lit(_CAPITALS)),
    }
    return df.select(*kept, *(values[m].cast("long").alias(m) for m in MEASURES))


def ledger(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with its measures and ``failed``, the bits of the rules that each row fails."""
    bits = sum(
        (F.when(F.expr(r.condition), F.lit(1 << r.bit)).otherwise(0) for r in rules), F.lit(0)
    )
    return measure(df, text).withColumn("failed", bits.cast("long"))


def apply_policy(rows: DataFrame, policy: Policy, verdict: str = "kept") -> DataFrame:
    """A ledger with ``verdict``: true where the row fails no rule of the policy."""
    return rows.withColumn(verdict, F.col("failed").bitwiseAND(F.lit(policy.mask())) == 0)


def ablations(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row for each rule of the policy: rows failing it, and rows that only it rejects.

    Rows are first counted by their bits, of which there are at most 2 ** len(rules), so the
    shuffle is that small whatever the ledger's size.
    """
    chosen = [r for r in rules if r.name in policy.rules]
    mask = policy.mask(rules)
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    per_rule = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen)))
    return (
        counts.select("bits", "n", per_rule.alias("r"))
        .groupBy(F.lit(policy.name).alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"),
            F.bit_or(F.col("bits")).alias("bits_seen"),
        )
    )
