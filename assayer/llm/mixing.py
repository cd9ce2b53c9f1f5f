"""Mixtures of overlapping sources to target weights, by min-cost flow over membership patterns.

Documents belong to any number of sources. Those in the same sources form a pattern, and only
patterns, with their total sizes, enter the flow: from each pattern to the quotas of its sources,
where taking a pattern once is free, twice has a price and each further time a higher one
(:func:`min_cost_flow`). So overlaps are used where they spare repetition. A source with a pattern of
its own that shares nothing needs no flow and is settled as a column; only patterns of overlapping
sources come to the driver (``MAX_PATTERNS`` of them at most, more are an error).

What a pattern gives is then filled with documents. They lie on a line in the order of a seeded hash,
the line is as long as their sizes and is passed as often as documents repeat; a document is taken
once for every passage on which all of it lies before the end of what flows. Sizes are summed up by
ranges of the hash first, and only ranges with an end in them are put in order, so a pattern that
holds most rows is never sorted. What then is missing from the flow is filled up, a few times, with
the document whose size comes closest to it.

Null and missing sizes count as 0, and such documents are taken 0 words of. Documents without a
source get nothing; null is a source like the others, last in order. Repeated rows are rows of their
own. Equal hashes are in the order of the named columns, and of the rows where these are equal. An
empty table gives no rows. All columns stay, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import fresh
from assayer.operators.positions import with_position
from assayer.session import broadcast_if_small, materialize

WEIGHTS, LIMIT, SEED = (5, 2, 1), 3, 13

# What the second, third, ... taking of the same words costs; it must not fall.
COSTS = (0, 1, 3)

MAX_PATTERNS = 2_000

# Documents in a range of the hash, about.
RANGE_ROWS = 512

# Times that what is missing is filled up.
FILLS = 4


def min_cost_flow(sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: Sequence[int] = COSTS) -> dict[tuple[int, int], int]:
    """Words from pattern p to source s: as many as can be, at the least cost of repetition.

    Shortest augmenting paths from all patterns that have words left to all quotas that are not full.
    Only the first arc of a path has a price. Each path uses up a taking of a pattern, a quota or a
    former arc, so their number is bounded by the arcs.
    """
    n, m = len(sizes), len(quotas)
    flow: dict[tuple[int, int], int] = {}
    given, got = [0] * n, [0] * m
    in_source: list[list[int]] = [[] for _ in range(m)]
    for p, own in enumerate(members):
        for s in own:
            in_source[s].append(p)
            flow[p, s] = 0

    def price(p: int) -> int | None:
        """What the next words of a pattern cost."""
        times = given[p] // sizes[p] if sizes[p] else len(costs)
        return costs[times] if times < len(costs) else None

    while True:
        # Distances of patterns and sources; a pattern is reached by its own next words, or by giving
        # way to another pattern at a source (its own words then are the ones to place).
        distance: dict[tuple[str, int], int] = {}
        before: dict[tuple[str, int], tuple[str, int]] = {}
        heap = [(c, "p", p, "start", -1) for p in range(n) if (c := price(p)) is not None]
        heapq.heapify(heap)
        end = None
        while heap:
            d, kind, i, from_kind, from_i = heapq.heappop(heap)
            if (kind, i) in distance:
                continue
            distance[kind, i], before[kind, i] = d, (from_kind, from_i)
            if kind == "s" and got[i] < quotas[i]:
                end = i
                break
            if kind == "p":
                for s in members[i]:
                    if ("s", s) not in distance:
                        heapq.heappush(heap, (d, "s", s, "p", i))
            else:
                for p in in_source[i]:
                    if flow[p, i] and ("p", p) not in distance:
                        heapq.heappush(heap, (d, "p", p, "s", i))
        if end is None:
            return {arc: words for arc, words in flow.items() if words}
        path, at = [], ("s", end)
        room = quotas[end] - got[end]
        while at[0] != "start":
            came = before[at]
            path.append((came, at))
            if came[0] == "s":
                room = min(room, flow[at[1], came[1]])
            at = came
        source = path[-1][1][1]
        room = min(room, sizes[source] - given[source] % sizes[source])
        given[source] += room
        got[end] += room
        for came, at in path[:-1]:
            if came[0] == "p":
                flow[came[1], at[1]] += room
            else:
                flow[at[1], came[1]] -= room


def source_targets(sizes: DataFrame, total: int, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) for (source, source_size): shares of ``total`` by weight.

    Sources in order (null last) weigh ``weights`` again and again. A target stops at ``limit`` times the
    source's size; what is above is shared by weight among the others until none is above.
    """
    ordered = sizes.select("source", "source_size", F.col("source").isNull().alias("unnamed"))
    placed = with_position(ordered, ["unnamed", "source"], name="place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    most = F.col("source_size").cast("decimal(38,0)") * limit
    placed = materialize(placed.select("source", "source_size", weight.alias("weight"), most.cast("decimal(38,0)").alias("most")), "sources")
    left, shares, full = total, placed.agg(F.sum("weight")).first()[0] or 0, 0
    while True:
        above = F.col("most") * F.lit(shares) <= F.lit(left).cast("decimal(38,0)") * F.col("weight")
        found = placed.agg(
            F.count(F.when(above, 1)).alias("full"), F.sum(F.when(above, F.col("most"))).alias("most"), F.sum(F.when(~above, F.col("weight"))).alias("shares")
        ).first()
        target = F.when(above, F.col("most").cast("double")).otherwise(F.lit(left).cast("decimal(38,0)").cast("double") * F.col("weight") / F.lit(max(shares, 1)))
        if found["full"] == full:
            return placed.select("source", "source_size", target.alias("target"))
        left, shares, full = total - int(found["most"] or 0), found["shares"] or 0, found["full"]


def _flows(patterns: DataFrame, targets: DataFrame, limit: int, costs: Sequence[int], max_patterns: int) -> DataFrame:
    """(pattern, size, rows, flow, stretches): what each pattern gives, and up to where to which source. A written table."""
    spark = patterns.sparkSession
    arcs = patterns.select("pattern", "size", F.explode("sources").alias("source"), (F.size("sources") > 1).alias("shared"))
    quota = F.round("target").cast("long")
    named = targets.select(F.col("source").alias("named"), quota.alias("quota"))
    arcs = arcs.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    with_others = arcs.groupBy("source").agg(F.max("shared").alias("entangled")).select(F.col("source").alias("named"), "entangled")
    arcs = arcs.join(with_others, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    arcs = materialize(arcs, "arcs")
    # A pattern of one source may still share that source with larger patterns; these go to the flow.
    alone = arcs.where(~F.col("entangled")).select("pattern", F.least(F.col("size") * limit, "quota").alias("words"), "source")
    entangled = arcs.where("entangled")
    found = entangled.select("pattern").distinct().limit(max_patterns + 1).count()
    if found > max_patterns:
        raise ValueError(f"More than {max_patterns} patterns of overlapping sources")
    listed = entangled.orderBy("pattern", "source").collect()
    names = list(dict.fromkeys(r["pattern"] for r in listed))
    sources = list(dict.fromkeys(r["source"] for r in listed))
    pattern_no, source_no = ({x: i for i, x in enumerate(xs)} for xs in (names, sources))
    sizes, quotas, members = [0] * len(names), [0] * len(sources), [[] for _ in names]
    for r in listed:
        p, s = pattern_no[r["pattern"]], source_no[r["source"]]
        sizes[p], quotas[s] = r["size"], r["quota"]
        members[p].append(s)
    routed = [(names[p], words, sources[s]) for (p, s), words in sorted(min_cost_flow(sizes, members, quotas, costs).items())]
    routed = alone.unionByName(spark.createDataFrame(routed, alone.schema))
    stretch = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("unnamed"), "source", "words")))
    given = routed.where("words > 0").groupBy("pattern").agg(stretch.alias("parts"), F.sum("words").alias("flow"))
    ends = F.transform("parts", lambda x, i: F.struct(
        F.aggregate(F.slice("parts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda total, y: total + y["words"]).alias("upto"), x["source"].alias("source")
    ))
    given = given.select("pattern", "flow", ends.alias("stretches"))
    joined = patterns.join(given, "pattern", "left").select("pattern", "size", "rows", F.coalesce("flow", F.lit(0).cast("long")).alias("flow"), "stretches")
    return materialize(joined, "flows")


def _copies(docs: DataFrame, flows: DataFrame, order: Sequence[str], limit: int, seed: int) -> DataFrame:
    """``docs`` (row, pattern, size, hash, ...) with the ``copies`` that lie before the end of the flow, and the offset."""
    bits = min(int((flows.agg(F.max("rows")).first()[0] or 0) // RANGE_ROWS).bit_length(), 24)
    ranged = docs.withColumn("range", F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long"))
    by_range = ranged.groupBy("pattern", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("words").over(before), F.lit(0))
    by_range = by_range.select("pattern", "range", "words", begin.alias("begin")).join(broadcast_if_small(flows), "pattern")
    cuts = F.transform("stretches", lambda x: x["upto"] % F.greatest("size", F.lit(1)))
    cut = F.coalesce(F.exists(cuts, lambda c: (c > F.col("begin")) & (c < F.col("begin") + F.col("words"))), F.lit(False))
    by_range = materialize(by_range.select("pattern", "range", "begin", cut.alias("cut"), F.col("size").alias("line"), "flow", "stretches"), "ranges")
    placed = ranged.join(broadcast_if_small(by_range, 20_000), ["pattern", "range"])
    inside = Window.partitionBy("pattern", "range").orderBy("hash", *order, "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.where(~F.col("cut")).withColumn("offset", F.col("begin"))
    ordered = placed.where("cut").withColumn("offset", F.col("begin") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = whole.unionByName(ordered)
    fits = [F.when((F.col("size") > 0) & (F.col("offset") + F.col("size") + F.col("line") * k <= F.col("flow")), 1).otherwise(0) for k in range(limit)]
    return placed.withColumn("copies", sum(fits, F.lit(0))).drop("range", "begin", "cut")


def _fill(placed: DataFrame, flows: DataFrame, limit: int) -> DataFrame:
    """(row, more): further copies that bring what is taken closer to the flows. ``placed`` is a written table."""
    taken = placed.groupBy("pattern").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    missing = materialize(flows.join(taken, "pattern").select("pattern", (F.col("flow") - F.col("taken")).alias("missing")), "missing")
    picks = None
    for fill in range(FILLS):
        wanted = broadcast_if_small(missing.where("missing > 0"))
        open_rows = placed.select("row", "pattern", "size", "hash", "copies").join(wanted, "pattern")
        if picks is not None:
            had = broadcast_if_small(picks.groupBy("row").agg(F.count("*").cast("int").alias("had")))
            open_rows = open_rows.join(had, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("had", F.lit(0)))
        # The last one may be larger than what is missing, if that comes closer.
        room = F.col("missing") * (2 if fill == FILLS - 1 else 1)
        fits = (F.col("size") < room) | (F.col("size") == F.col("missing"))
        fitting = open_rows.where((F.col("size") > 0) & fits & (F.col("copies") < limit))
        near = F.struct((-F.abs(F.col("missing") - F.col("size"))).alias("near"), "size", "hash", "row")
        best = fitting.groupBy("pattern").agg(F.max(near).alias("best"))
        best = materialize(best.select("pattern", "best.row", F.col("best.size").alias("size")), "fills")
        if best.isEmpty():
            break
        filled = best.select("pattern", F.col("size").alias("filled"))
        missing = materialize(missing.join(filled, "pattern", "left").select("pattern", (F.col("missing") - F.coalesce("filled", F.lit(0))).alias("missing")), "missing")
        picks = best if picks is None else picks.unionByName(best)
    if picks is None:
        return placed.select("row", F.lit(0).alias("more")).limit(0)
    return picks.groupBy("row").agg(F.count("*").cast("int").alias("more"))


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column,
    order: Sequence[str],
    weights: Sequence[int] = WEIGHTS,
    limit: int = LIMIT,
    seed: int = SEED,
    costs: Sequence[int] = COSTS,
    max_patterns: int = MAX_PATTERNS,
) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` with a column (size, taken, credits), its name, and (source, source_size, target).

    ``sources`` is an array, ``size`` a number of words, ``order`` names columns that tell rows apart:
    the same rows get the same result in every run. ``credits`` names the source that each copy is
    taken for. Texts should be left out of ``docs``: rows are written, and some of them put in order.
    """
    if len(costs) != limit or list(costs) != sorted(costs):
        raise ValueError("There is one cost for each time words are taken, and none is below the one before")
    members = F.coalesce(F.sort_array(F.array_distinct(sources)), F.array().cast("array<string>"))
    words = F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    rows = materialize(docs.select(
        F.struct(*docs.columns).alias("doc"), members.alias("sources"), words.alias("size"),
        F.xxhash64(F.lit(seed), *order).alias("hash"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("pattern", F.to_json("sources")), "mixed-rows")
    patterns = rows.groupBy("pattern").agg(F.first("sources").alias("sources"), F.sum("size").alias("size"), F.count("*").alias("rows"))
    patterns = materialize(patterns, "patterns")
    total = patterns.agg(F.sum("size")).first()[0] or 0
    per_source = patterns.select(F.explode("sources").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(per_source, total, weights, limit), "targets")
    flows = _flows(patterns, targets, limit, costs, max_patterns)
    keys = [f"key_{i}" for i in range(len(order))]
    slim = rows.select("row", "doc", "pattern", "size", "hash", *(F.col(f"doc.`{c}`").alias(k) for c, k in zip(order, keys)))
    placed = materialize(_copies(slim, flows, keys, limit, seed), "placed")
    more = broadcast_if_small(_fill(placed, flows, limit))
    position = lambda k: F.col("offset") + F.col("line") * k
    stretch = lambda k: F.coalesce(F.filter("stretches", lambda x: x["upto"] > position(k))[0], F.element_at("stretches", -1))["source"]
    credits = [F.when(F.col("copies") > k, F.struct(stretch(k).alias("source"))) for k in range(limit)]
    filled = F.array_repeat(F.struct(F.element_at("stretches", -1)["source"].alias("source")), F.coalesce("more", F.lit(0)))
    credited = F.transform(F.concat(F.filter(F.array(*credits), lambda x: x.isNotNull()), F.coalesce(filled, F.array())), lambda x: x["source"])
    taken = F.col("size") * (F.col("copies") + F.coalesce("more", F.lit(0)))
    mixed = fresh("mixed", docs.columns)
    chosen = F.struct("size", taken.alias("taken"), credited.alias("credits"))
    return placed.join(more, "row", "left").select("doc.*", chosen.alias(mixed)), mixed, targets
