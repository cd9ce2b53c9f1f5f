"""Site-relative line removal: lines that a large share of a site's pages carry are boilerplate.

For every site the pages that contain a line are divided by all pages of the site; a line on
at least ``min_pages`` pages whose share exceeds ``ratio`` goes from each of them. Lines are
compared without white space at their ends, by 128 bits; blank lines stay.

Only hashes are counted: a page adds each distinct line once, sums are taken before the
shuffle, and a site of any size is spread over its lines. Boilerplate lines are few (a site has
at most lines per page / ratio of them), so they are gathered by site and looked up where the
pages lie; where all of them together are too many to send to every task, pages and lists are
joined by site, and adaptive execution splits the sites that hold most pages.

Null texts stay null, pages without a site lose nothing; both count as pages. Repeated rows
are pages of their own. A page of which all lines go keeps an empty text. An empty table gives
an empty table. The columns stay as they are, but for the text.

Where copies are to be removed later (``copies``), they must not count as pages that agree:
lines are then counted by distinct text, and those above the ratio once more with near copies
as one page, in numerator and total alike; a line goes if it is above the ratio both times. A
page that would lose every line keeps its text, so that no group of copies vanishes as a whole.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm import ngram_join
from assayer.llm.common import fresh
from assayer.session import materialize

RATIO = 0.05
MIN_PAGES = 5
#: Boilerplate lines (34 bytes each and the site's name) that may go to every task.
SENT_LINES = 200_000

_BLANK = " \t\x0b\x0c\r"


def _hashes(line: Column) -> Column:
    """128 bits as text: sets of texts are hashed, sets of structs would be searched pair by pair."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.concat_ws(":", F.hex(F.xxhash64(bare)), F.hex(F.xxhash64(F.lit(5), bare)))


def _solid(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.btrim(x, F.lit(_BLANK)) != "")


def _line_hashes(text: str) -> Column:
    return F.array_distinct(F.transform(_solid(F.split(F.col(text), "\n")), _hashes))


def _above(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(site, line, pages, total) from pages as (site, lines)."""
    totals = pages.groupBy("site").agg(F.count("*").alias("total"))
    counts = (
        pages.select("site", F.explode("lines").alias("line"))
        .groupBy("site", "line")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return counts.join(totals, "site").where(F.col("pages") > F.col("total") * F.lit(ratio))


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line, pages, total): the hashes of the lines above the ratio, with their counts."""
    named = pages.where(F.col(site).isNotNull())
    return _above(named.select(F.col(site).alias("site"), _line_hashes(text).alias("lines")), ratio, min_pages)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _places_without(hashes: pd.Series, listed: pd.Series) -> pd.Series:
    """Places of the hashes that are not listed; null (a blank line) never is."""
    out = []
    for own, bad in zip(hashes, listed):
        gone = set() if bad is None else set(bad)
        out.append(None if own is None else [i for i, h in enumerate(own) if h not in gone])
    return pd.Series(out, dtype=object)


def _by_site(found: DataFrame, site: str, listed: str) -> DataFrame:
    """The lines of each site in one list, sent to every task where all of them are few."""
    lists = found.groupBy(F.col("site").alias(site)).agg(F.collect_list("line").alias(listed))
    return F.broadcast(lists) if found.count() <= SENT_LINES else lists


def boilerplate_without_copies(
    pages: DataFrame, site: str, text: str, copies: tuple[int, int], ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """As :func:`boilerplate`, but copies are one page: texts that are equal, or linked as near copies.

    ``copies`` has the words of an n-gram and the similarity in percent, as for
    :func:`assayer.llm.ngram_join.near_duplicates`. Only pages that hold a line above the ratio are compared.
    """
    named = pages.where(F.col(site).isNotNull()).select(F.col(site).alias("site"), F.col(text).alias("text"))
    hashed = named.withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(5), "text"))
    distinct = hashed.select("site", "a", "b", _line_hashes("text").alias("lines")).dropDuplicates(["site", "a", "b"])
    found = materialize(_above(distinct, ratio, min_pages), "distinct-boilerplate")
    if found.isEmpty():
        return found
    holding = hashed.join(_by_site(found, "site", "listed"), "site").where(F.arrays_overlap(_line_hashes("text"), "listed"))
    holding = holding.dropDuplicates(["site", "a", "b"]).select("site", "text", F.monotonically_increasing_id().alias("id"))
    holding = materialize(holding, "shared-pages")
    near = ngram_join.near_duplicates(holding, "id", "text", *copies).select(F.col("key").alias("id"), "component")
    grouped = materialize(holding.select("id", "site", _line_hashes("text").alias("lines")).join(near, "id"), "page-groups")
    spare = grouped.groupBy("site", "component").agg((F.count("*") - 1).alias("more")).groupBy("site").agg(F.sum("more").alias("more"))
    counts = (
        grouped.select("site", F.explode("lines").alias("line"), "component")
        .groupBy("site", "line", "component").agg(F.lit(1).alias("one"))
        .groupBy("site", "line").agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    counts = found.select("site", "line", "total").join(counts, ["site", "line"]).join(spare, "site")
    counts = counts.select("site", "line", "pages", (F.col("total") - F.col("more")).alias("total"))
    return counts.where(F.col("pages") > F.col("total") * F.lit(ratio))


def drop_boilerplate(
    pages: DataFrame,
    site: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    dropped: str | None = None,
    copies: tuple[int, int] | None = None,
) -> DataFrame:
    """``pages`` with the boilerplate lines gone from ``text``.

    ``dropped`` names a column for how many went; a column of that name is replaced. With
    ``copies`` (words of an n-gram, percent) copies are one page and no text loses every line.
    """
    if dropped:
        pages = pages.drop(dropped)
    if copies:
        found = boilerplate_without_copies(pages, site, text, copies, ratio, min_pages)
    else:
        found = boilerplate(pages, site, text, ratio, min_pages)
    found = materialize(found, "boilerplate")
    key, listed, lines, kept = (fresh(x, [*pages.columns, *filter(None, [dropped])]) for x in ("_site", "_lines", "_split", "_kept"))
    by_site = _by_site(found, key, listed)
    rows = pages.join(by_site, F.col(site) == F.col(key), "left").withColumn(lines, F.split(F.col(text), "\n"))
    # What of a page is listed, then its places: both in time that grows with the page, not with its square.
    hashes = F.transform(lines, lambda x: F.when(F.btrim(x, F.lit(_BLANK)) != "", _hashes(x)))
    bad = F.array_intersect(F.array_compact(hashes), F.col(listed))
    rows = rows.withColumn(listed, F.when(F.size(bad) > 0, bad))
    places = _places_without(F.when(F.col(listed).isNotNull(), hashes), F.col(listed))
    stays = F.transform(places, lambda i: F.get(F.col(lines), i))
    rows = rows.withColumn(kept, F.when(F.col(listed).isNull(), F.col(lines)).otherwise(stays))
    if copies:
        rows = rows.withColumn(kept, F.when(F.size(_solid(F.col(kept))) > 0, F.col(kept)).otherwise(F.col(lines)))
    gone = F.coalesce(F.size(lines) - F.size(kept), F.lit(0)).cast("long")
    out = [
        (F.when(F.size(lines) > F.size(kept), F.array_join(kept, "\n")).otherwise(F.col(text)).alias(c) if c == text else F.col(c))
        for c in pages.columns
    ]
    return rows.select(*out, *([F.when(F.col(text).isNull(), 0).otherwise(gone).cast("long").alias(dropped)] if dropped else []))
