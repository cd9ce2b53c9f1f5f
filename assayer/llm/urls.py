"""URL filters: listed rules first, and a classifier of segmented host and path words for the rest.

Host names run words together. A unigram model of words, counted on the parts of all URLs that
come apart by themselves (path words, hyphenated names), splits every part by the most probable
segmentation (:class:`Segmenter`). A multinomial naive Bayes model then scores the words of
host and path; its counts are taken over all rows, block where a part of the host is one of the
seed words as it stands, allow elsewhere, so that it knows the company that such names keep and
finds them where they are run together. Models that are too large to be sent to every task are tables
that are joined (:func:`score_by_joins`), so no word is left out of them.

Null URLs and those without ``://`` have an empty host and path: no rule fits, and without a
word they are judged by the classes' shares alone. Rows are judged one by one; repeated rows
count each time in the model; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import fresh
from assayer.session import materialize

#: Words that mark a host to be blocked: games of chance, adult sites, adverts, fraud, drugs, loans, copies, dating, piracy.
SEEDS = (
    "ads adult bet bets betting casino cialis dating escort escorts gambling jackpot keygen loan loans lottery malware payday "
    "pharmacy phishing pills poker porn replica replicas scam slots spam torrent torrents viagra warez xxx"
).split()
#: Words and tokens of models that go to every task at most; larger models stay tables that are joined.
SENT_WORDS = 200_000
#: Letters of a word that may stand beside others in a run; a whole run may be a word of any length.
_LONGEST = 24
_RUNS = re.compile(r"[a-zß-￿]+|[0-9]+")
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, text: str, verdict: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(host, slash + path, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _ASCII_UPPER, _ASCII_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (text, verdict); null without one."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last condition is asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_parts(host: str) -> list[str]:
    """What dots, hyphens and digits separate."""
    return [p for p in _RUNS.findall(host) if not p.isdigit()]


class Segmenter:
    """The most probable split of a run of letters, by word counts."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        """``total`` counts all words where ``counts`` has only those that matter."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.known = {w: math.log(n / total) for w, n in counts.items()}
        self.longest = _LONGEST
        self.unknown = math.log(1 / total)
        self.split = lru_cache(1 << 14)(self._split)

    def _cost(self, text: str, start: int = 0, end: int | None = None) -> float:
        """Of the word from ``start`` to ``end``; an unknown one is the less probable the longer it is."""
        end = len(text) if end is None else end
        length = end - start
        unknown = self.unknown - 2.3 * length
        inside = length > self.longest and length < len(text)
        return unknown if inside else self.known.get(text[start:end], unknown)

    def _split(self, text: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(text) + 1):
            # A whole unknown run stays whole, so the start of the text is always a candidate.
            starts = {0, *range(max(0, end - self.longest), end)}
            score, start = max((best[s] + self._cost(text, s, end), -s) for s in starts)
            best.append(score)
            back.append(-start)
        words, end = [], len(text)
        while end:
            words.append(text[back[end] : end])
            end = back[end]
        return tuple(reversed(words))


def tokens(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Segmented words, marked by where they stand; a number counts as one word."""
    out = []
    for mark, text in (("h:", host), ("p:", path.lower())):
        for run in _RUNS.findall(text):
            out += [f"{mark}#"] if run.isdigit() else [mark + w for w in segmenter.split(run)]
    return out


Batches = Iterator[pa.RecordBatch]


def _words(seeds: frozenset[str]) -> Callable[[Batches], Batches]:
    """(word): parts that stand alone in path or host; a host label in one piece may be several words."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                found += host_parts(path.lower())
                for label in host.split("."):
                    parts = host_parts(label)
                    if len(parts) > 1:
                        found += parts
                    elif parts and parts[0] in seeds:
                        found += parts
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    return run


def word_counts(urls: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(word, n) over the (host, path) of all rows, the seeds with 1 at least. A written table."""
    found = urls.mapInArrow(_words(frozenset(seeds)), "word string").groupBy("word").agg(F.count("*").alias("n"))
    seeded = urls.sparkSession.createDataFrame([(s, 1) for s in seeds], "word string, n long")
    return materialize(found.unionByName(seeded).groupBy("word").agg(F.max("n").alias("n")), "url-words")


def _labelled_tokens(model: Broadcast, seeds: frozenset[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        segmenter = Segmenter(model.value)
        for batch in batches:
            token, block = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                own = tokens(host, path, segmenter)
                bad = any(p in seeds for p in host_parts(host))
                token += ["", *own]  # the empty one counts the row
                block += [bad] * (len(own) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(block, pa.bool_())], names=["token", "block"])

    return run


class NaiveBayes:
    """Log-odds of block against allow from token counts (token, blocked, allowed)."""

    def __init__(self, rows: Sequence[tuple[str, int, int]]) -> None:
        bad, good = next(((b, a) for t, b, a in rows if t == ""), (0, 0))
        self.prior = math.log(bad / good) if bad and good else (math.inf if bad else -math.inf)
        own = [r for r in rows if r[0]]
        bad_total, good_total = (max(sum(r[i] for r in own), 1) for i in (1, 2))
        # One word more of each token, in the classes' shares: so odds do not follow the size of the vocabulary.
        bad_more, good_more = (n / (bad_total + good_total) for n in (bad_total, good_total))
        self.odds = {t: math.log((b + bad_more) / bad_total) - math.log((a + good_more) / good_total) for t, b, a in own}

    def score(self, words: Sequence[str]) -> float:
        """A word that was never seen says nothing."""
        return self.prior + sum(self.odds.get(w, 0.0) for w in words)


@dataclass(frozen=True)
class Model:
    words: dict[str, int]
    counts: list[tuple[str, int, int]]


def fit(urls: DataFrame, seeds: Sequence[str] = SEEDS) -> Model | None:
    """Both models from the columns host and path of all rows; None if they are too large to be sent."""
    words = word_counts(urls, seeds)
    if words.count() > SENT_WORDS:
        return None
    known = {r["word"]: r["n"] for r in words.collect()}
    sent = urls.sparkSession.sparkContext.broadcast(known)
    found = urls.mapInArrow(_labelled_tokens(sent, frozenset(seeds)), "token string, block boolean")
    counts = materialize(found.groupBy("token").agg(
        F.sum(F.col("block").cast("long")).alias("bad"), F.sum((~F.col("block")).cast("long")).alias("good")
    ), "url-tokens")
    if counts.count() > SENT_WORDS:
        return None
    return Model(known, [(r["token"], r["bad"], r["good"]) for r in counts.collect()])


def _runs(batches: Batches) -> Batches:
    """(host, path, times, at, mark, run) of distinct host and path pairs, a number as the run '#'."""
    for batch in batches:
        row, at, marks, runs = [], [], [], []
        for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
            own = [(mark, "#" if r.isdigit() else r) for mark, text in (("h:", host), ("p:", path.lower())) for r in _RUNS.findall(text)]
            row += [i] * len(own)
            at += range(len(own))
            marks += [m for m, _ in own]
            runs += [r for _, r in own]
        columns = [c.take(pa.array(row, pa.int32())) for c in batch.columns]
        columns += [pa.array(at, pa.int32()), pa.array(marks, pa.string()), pa.array(runs, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "at", "mark", "run"])


def _substrings(batches: Batches) -> Batches:
    """(run, start, end, word): all that may be a word of a run."""
    for batch in batches:
        for text in batch.column("run").to_pylist():
            spans = [(s, e) for s in range(len(text)) for e in range(s + 1, min(s + _LONGEST, len(text)) + 1)]
            if len(text) > _LONGEST:
                spans.append((0, len(text)))
            starts, ends = zip(*spans)
            columns = [pa.array([text] * len(spans)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array([text[a:b] for a, b in spans])]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "start", "end", "word"])


def _splitting(total: int) -> Callable[[Batches], Batches]:
    """(run, words) from (run, known words with their counts)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            runs, words = batch.column("run").to_pylist(), []
            for text, known in zip(runs, batch.column("known").to_pylist()):
                segmenter = Segmenter({k["word"]: k["n"] for k in known or ()}, total)
                words.append(list(segmenter._split(text)))
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["run", "words"])

    return run


def score_by_joins(urls: DataFrame, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """(host, path, words, score) for the distinct hosts and paths of all rows, with models of any size.

    The same two models as in :func:`fit`, as tables: the words of runs are found by joining their substrings
    with the word counts, the scores by joining tokens with their odds. Words and tokens that very many
    URLs share are on one side of the joins once, so adaptive execution splits the other side.
    """
    words = word_counts(urls, seeds)
    total = words.agg(F.sum("n")).first()[0] or 0
    pairs = materialize(urls.groupBy("host", "path").agg(F.count("*").alias("times")), "url-pairs")
    runs = materialize(pairs.mapInArrow(_runs, "host string, path string, times long, at int, mark string, run string"), "url-runs")
    distinct = materialize(runs.where("run <> '#'").select("run").distinct(), "distinct-runs")
    known = distinct.mapInArrow(_substrings, "run string, start int, end int, word string").join(words, "word")
    known = known.groupBy("run").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    split = distinct.join(known, "run", "left").mapInArrow(_splitting(total), "run string, words array<string>")
    split = materialize(split, "split-runs")
    own = F.coalesce("words", F.array(F.lit("#")))
    marked = runs.join(split, "run", "left").select("host", "path", "times", "at", F.transform(own, lambda w: F.concat("mark", w)).alias("tokens"))
    tokens = materialize(marked.select("host", "path", "times", "at", F.posexplode("tokens").alias("place", "token")), "url-tokens")
    listed = F.array(*map(F.lit, seeds))
    parts = F.regexp_extract_all("host", F.lit(_RUNS.pattern), F.lit(0))
    bad = F.arrays_overlap(parts, listed)
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("times"))), F.lit(0))
    rows = pairs.agg(amount(bad).alias("bad"), amount(~bad).alias("good")).first()
    odds = materialize(tokens.groupBy("token").agg(amount(bad).alias("bad"), amount(~bad).alias("good")), "token-counts")
    sums = odds.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    totals = {c: max(sums[c] or 0, 1) for c in ("bad", "good")}
    share = {c: n / sum(totals.values()) for c, n in totals.items()}
    of_bad, of_good = (F.log((F.col(c) + F.lit(share[c])) / F.lit(totals[c])) for c in ("bad", "good"))
    value = of_bad - of_good
    prior = NaiveBayes([("", rows["bad"], rows["good"])]).prior
    scored = tokens.join(odds.select("token", value.alias("odds")), "token").groupBy("host", "path").agg(
        F.sum("odds").alias("odds"), F.sort_array(F.collect_list(F.struct("at", "place", "token")))["token"].alias("words")
    )
    return pairs.join(scored, ["host", "path"], "left").select(
        "host", "path", F.coalesce("words", F.array().cast("array<string>")).alias("words"),
        (F.lit(prior) + F.coalesce("odds", F.lit(0.0))).alias("score"),
    )


def _scoring(model: Broadcast, host: str, path: str, names: Sequence[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        words, counts = model.value
        segmenter, bayes = Segmenter(words), NaiveBayes(counts)
        for batch in batches:
            rows = [tokens(h, p, segmenter) for h, p in zip(batch.column(host).to_pylist(), batch.column(path).to_pylist())]
            columns = [pa.array(rows, pa.list_(pa.string())), pa.array([bayes.score(r) for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return run


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    url: str = "url",
    seeds: Sequence[str] = SEEDS,
    model: Model | None = None,
) -> DataFrame:
    """``pages`` with a struct ``judged``: host, path, rule, words, score, verdict (allow or block).

    A column named ``judged`` is replaced. Without a model one is fitted on these pages.
    """
    pages = pages.drop("judged")
    host, path, words, score, rule = (fresh(x, pages.columns) for x in ("_host", "_path", "_words", "_score", "_rule"))
    address = F.col(url).cast("string")
    parted = pages.withColumn(host, host_of(address)).withColumn(path, path_of(address))
    urls = parted.select(F.col(host).alias("host"), F.col(path).alias("path"))
    model = fit(urls, seeds) if model is None else model
    if model is None:
        found = score_by_joins(urls, seeds)
        named = found.select(F.col("host").alias(f"{host}_"), F.col("path").alias(f"{path}_"), F.col("words").alias(words), F.col("score").alias(score))
        same = (F.col(host) == F.col(f"{host}_")) & (F.col(path) == F.col(f"{path}_"))
        scored = parted.join(named, same).drop(f"{host}_", f"{path}_")
    else:
        sent = pages.sparkSession.sparkContext.broadcast((model.words, model.counts))
        schema = T.StructType([
            *parted.schema.fields, T.StructField(words, T.ArrayType(T.StringType())), T.StructField(score, T.DoubleType())
        ])
        scored = parted.mapInArrow(_scoring(sent, host, path, [words, score]), schema)
    scored = scored.withColumn(rule, fitting_rule(F.col(host), F.col(path), rules))
    by_score = F.when(F.col(score) > 0, "block").otherwise("allow")
    judged = F.struct(
        F.col(host).alias("host"), F.col(path).alias("path"), F.col(rule)["text"].alias("rule"),
        F.col(words).alias("words"), F.col(score).alias("score"),
        F.coalesce(F.col(rule)["verdict"], by_score).alias("verdict"),
    )
    return scored.select(*pages.columns, judged.alias("judged"))
