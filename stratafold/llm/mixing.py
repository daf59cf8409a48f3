"""Mixing of sources to target weights as a minimum-cost flow.

Documents are aggregated by their pattern, the set of sources that they belong to. A pattern can send each of its words once for
nothing, and each further time at a cost that grows by one, so repetition is convex; a source takes as many words as its quota.
Where a pattern is one source that no other pattern holds, the flow through it is the source's quota, and Spark computes it; so any number
of such sources will do. Overlapping patterns, and those that share a source with them, go through the flow on the driver, at most
``MOST_PATTERNS`` of them, else an error. Then a pattern's documents are selected in a seeded order until the pattern's words are met;
the last one gives its first words only, so the mix meets the flow to the word. The order is found from sums over bins of a hash, bins of
bins where one holds more than ``LAST_BIN`` rows, and only the bin in which the selection ends is sorted.

Nulls: a null text has size 0, a null source is a source of its own, last in order; a null or empty array of sources belongs to none, and
nothing of it is taken. Null ids and repeated rows take part like any other, ordered by their texts; only rows that agree in id and text
stay in one bin however many they are. An empty table gives no rows. Sources without words get the target 0.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.functions.ordered import running_totals
from stratafold.llm.common import stored

MOST_PATTERNS = 100_000
LAST_BIN = 100_000
#: Hexadecimal digits of the order that each level of bins adds, and of the order itself.
DIGITS, ORDER = 3, 48
OUT = ("size", "taken", "targets", "source_sizes")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shares(sizes: dict[str | None, int], weights: list[float], share: float, most: float) -> dict[str | None, float]:
    """Targets by weight that sum to ``share`` of all sizes; none above ``most`` times its source's size, the excess reshared.

    Sources are weighed in order of code points, null last, the list of weights repeating.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), float(sum(weight.values())), {}
    for s in sorted(names, key=lambda s: most * sizes[s] / weight[s]):
        out[s] = float(min(most * sizes[s], weight[s] * left / free)) if left > 0 else 0.0
        if out[s] == most * sizes[s]:
            left, free = left - out[s], free - weight[s]
    rest = [s for s in names if out[s] < most * sizes[s]]
    for s in rest:
        out[s] = weight[s] * left / free
    return {s: out[s] for s in names}


def flow(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[dict[int, int]]:
    """Words from each pattern to each of its sources: as many as possible, at the least cost of repetition.

    Successive shortest paths: source node, patterns (an arc per repetition, costs 0, 1, ..), sources, sink.
    """
    n = len(capacity)
    sink, start = n + len(quota), n + len(quota) + 1
    to, room, cost, arcs = [], [], [], [[] for _ in range(sink + 2)]

    def arc(a, b, c, w):
        for x, y, r, z in ((a, b, c, w), (b, a, 0, -w)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(z)

    for p, c in enumerate(capacity):
        for time in range(repeats):
            arc(start, p, c, time)
    routes = {}
    for p, own in enumerate(members):
        for s in own:
            routes[p, s] = len(to)
            arc(p, n + s, capacity[p] * repeats, 0)
    for s, q in enumerate(quota):
        arc(n + s, sink, q, 0)
    while True:
        away, came, waiting, inside = {start: 0}, {}, deque([start]), {start}
        while waiting:
            a = waiting.popleft()
            inside.discard(a)
            for e in arcs[a]:
                if room[e] and away[a] + cost[e] < away.get(to[e], float("inf")):
                    away[to[e]], came[to[e]] = away[a] + cost[e], e
                    if to[e] not in inside:
                        inside.add(to[e])
                        waiting.append(to[e])
        if sink not in away:
            break
        path, at = [], sink
        while at != start:
            path.append(came[at])
            at = to[came[at] ^ 1]
        send = min(room[e] for e in path)
        for e in path:
            room[e] -= send
            room[e ^ 1] += send
    out: list[dict[int, int]] = [{} for _ in capacity]
    for (p, s), e in routes.items():
        if room[e ^ 1]:
            out[p][s] = room[e ^ 1]
    return out


def _name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def targets(sizes: DataFrame, weights: list[float], share: float, most: int) -> DataFrame:
    """``sizes(source, words)`` with ``target``, by the rule of ``shares``, for any number of sources.

    A source is held back if its limit per weight is at most what is left per weight of the sources of larger limits; both come from running
    totals over ranges of sources. Three sums reach the driver.
    """
    named = [F.col("source").isNull(), F.col("source")]
    ranked = running_totals(sizes, [], named, {"_rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumn("_weight", weight).withColumn("_limit", most * F.col("words"))
    whole = rows.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("weight")).first()
    summed = running_totals(rows.withColumn("_ratio", F.col("words") / F.col("_weight")), [], [F.col("_ratio"), *named], {"_limits": F.col("_limit"), "_weights": F.col("_weight")})
    left = share * whole["words"] - (F.col("_limits") - F.col("_limit"))
    held = F.col("_limit") * (whole["weight"] - (F.col("_weights") - F.col("_weight"))) <= F.col("_weight") * left
    judged = stored(summed.select("source", "words", "_weight", "_limit", held.alias("_held")), "judged")
    gone = judged.filter("_held").agg(F.coalesce(F.sum("_limit"), F.lit(0)).alias("words"), F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("weight")).first()
    rest, free = share * whole["words"] - gone["words"], whole["weight"] - gone["weight"]
    shared = F.col("_weight") * F.lit(float(rest)) / F.lit(float(free)) if free > 0 else F.lit(0.0)
    return judged.select("source", "words", F.when(F.col("_held"), F.col("_limit").cast("double")).otherwise(shared).alias("target"))


def _routed(patterns: DataFrame, facts: DataFrame, most: int) -> DataFrame | None:
    """``mix, sent, targets, source_sizes`` of the patterns that overlap, and of those that share a source with them: the flow's part."""
    overlapping = patterns.filter(F.size("mix") > 1)
    if overlapping.isEmpty():
        return None
    touched = overlapping.select(F.explode("mix").alias("source")).distinct()
    reached = patterns.select("mix", "words", F.explode("mix").alias("_s")).join(touched, F.col("_s").eqNullSafe(F.col("source")), "left_semi").select("mix", "words").distinct()
    rows = reached.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of overlapping sources; mix by coarser sources")
    known = {r["source"]: r for r in facts.join(touched.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left_semi").collect()}
    at = {s: i for i, s in enumerate(known)}
    sent = flow([r["words"] for r in rows], [[at[s] for s in r["mix"]] for r in rows], [int(k["target"]) for k in known.values()], most)
    made = [(r["mix"], sum(f.values()), [known[s]["target"] for s in r["mix"]], [known[s]["words"] for s in r["mix"]]) for r, f in zip(rows, sent, strict=True)]
    kind = patterns.schema["mix"].dataType.simpleString()
    return patterns.sparkSession.createDataFrame(made, f"mix {kind}, sent long, targets array<double>, source_sizes array<long>")


def _ends(keyed: DataFrame, plan: DataFrame, last_bin: int) -> DataFrame:
    """``mix, end, before, rows``: per pattern the bin of the order in which its next pass ends, and the words before that bin.

    A bin is a prefix of the order; where one of more than ``last_bin`` rows is met, its rows are binned again by a longer prefix.
    """
    ends, digits = None, 0
    while True:
        digits += DIGITS
        rows = keyed
        if ends is not None:
            found = ends.select(F.col("mix").alias("_m"), F.col("end").alias("_was"), F.col("before").alias("_base"))
            rows = keyed.join(found, F.col("mix").eqNullSafe(F.col("_m")) & F.col("order").startswith(F.col("_was")))
        base = F.lit(0).cast("long") if ends is None else F.first("_base")
        bins = rows.groupBy("mix", F.substring("order", 1, digits).alias("end")).agg(F.sum("size").alias("_words"), F.count("*").alias("rows"), base.alias("_base"))
        running = Window.partitionBy("mix").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** DIGITS bins
        bins = bins.withColumn("before", F.col("_base") + F.coalesce(F.sum("_words").over(running), F.lit(0)))
        met = bins.join(plan.select(F.col("mix").alias("_m"), "rest"), F.col("mix").eqNullSafe(F.col("_m"))).filter(
            (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("_words")))
        ends = stored(met.select("mix", "end", "before", "rows"), "ends")
        if digits >= ORDER or (ends.agg(F.max("rows").alias("m")).first()["m"] or 0) <= last_bin:
            return ends


def _selected(docs: DataFrame, members: Column, size: Column, weights: list[float], share: float, most: int, seed: int, last_bin: int) -> DataFrame:
    """``row`` (a document's columns as they are), ``size``, ``taken``, ``targets``, ``source_sizes``."""
    tie = F.lpad(F.lower(F.hex(F.xxhash64("text"))), 16, "0")
    order = F.concat(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), tie)
    keyed = docs.select(F.struct(*[_name(c) for c in docs.columns]).alias("row"), F.coalesce(F.array_sort(F.array_distinct(members)), F.array()).alias("mix"),
                        F.coalesce(size, F.lit(0)).cast("long").alias("size"), order.alias("order"))
    patterns = stored(keyed.groupBy("mix").agg(F.sum("size").alias("words")), "patterns")
    facts = targets(patterns.select(F.explode("mix").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("words")), weights, share, most)
    routed = _routed(patterns, facts, most)
    own = patterns.filter(F.size("mix") == 1).select("mix", F.col("mix")[0].alias("_s"))
    plan = own.join(facts, F.col("_s").eqNullSafe(F.col("source"))).select(
        "mix", F.floor("target").alias("sent"), F.array("target").alias("targets"), F.array("words").alias("source_sizes"))
    if routed is not None:
        plan = plan.join(routed.select(F.col("mix").alias("_m")), F.col("mix").eqNullSafe(F.col("_m")), "left_anti").unionByName(routed)
    plan = plan.join(patterns.select(F.col("mix").alias("_m"), F.col("words").alias("_words")), F.col("mix").eqNullSafe(F.col("_m")))
    full = F.col("_words") > 0
    plan = stored(plan.select("mix", F.when(full, F.try_divide("sent", "_words").cast("long")).otherwise(0).alias("passes"),
                              F.when(full, F.try_mod("sent", "_words")).otherwise(0).alias("rest"), "targets", "source_sizes"), "plan")
    ends = _ends(keyed.select("mix", "order", "size"), plan, last_bin)
    facts_of = plan.join(ends.select(F.col("mix").alias("_m"), "end", "before"), F.col("mix").eqNullSafe(F.col("_m")), "left").drop("_m").withColumnRenamed("mix", "_m")
    if plan.count() <= MOST_PATTERNS:
        facts_of = F.broadcast(facts_of)
    joined = keyed.join(facts_of, F.col("mix").eqNullSafe(F.col("_m")), "left")
    bin_ = F.substring("order", F.lit(1), F.length("end"))
    at_end = F.coalesce(bin_ == F.col("end"), F.lit(False))
    clear = joined.filter(~at_end).withColumn("_next", F.when(bin_ < F.col("end"), F.col("size")).otherwise(0))
    inside = Window.partitionBy("_m").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    last = joined.filter(at_end).withColumn("_cum", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = last.withColumn("_next", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_cum")))).drop("_cum")
    taken = F.coalesce(F.col("passes") * F.col("size") + F.col("_next"), F.lit(0)).cast("long")
    return clear.unionByName(last).select("row", "size", taken.alias("taken"), F.coalesce("targets", F.array().cast("array<double>")).alias("targets"),
                                          F.coalesce("source_sizes", F.array().cast("array<long>")).alias("source_sizes"))


def mixed(docs: DataFrame, members: Column, size: Column, weights: list[float], share: float, most: int, seed: int = 0, last_bin: int = LAST_BIN) -> DataFrame:
    """``docs`` with ``size``, ``taken`` (words, repeats counted) and, per document, ``targets`` and ``source_sizes`` by source.

    ``members``: array of the document's sources; a source's size is that of all its documents. ``most``: times that a document
    may be taken at most, and how often its size a source's target may be. An input column named like one of the new ones, in any case,
    gives way to it; all others stay, whatever their names.
    """
    names = [c for c in docs.columns if c.lower() not in OUT]
    made = _selected(docs, members, size, weights, share, most, seed, last_bin)
    return made.select(*[F.col("row").getField(c).alias(c) for c in names], *OUT)


def _times() -> Column:
    """How often a document goes in whole: its passes, and the one that the quota cuts where half of it or more is taken."""
    times = F.when(F.col("size") > 0, F.floor(F.try_divide(2 * F.col("taken") + F.col("size"), 2 * F.col("size")))).otherwise(F.lit(0)).cast("int")
    return F.explode(F.array_repeat(F.lit(True), times))


def repeated(mix: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as whole documents, a row per pass; the one that a source's quota cuts goes in where half of it or more is taken."""
    return mix.select(F.struct(*[_name(c) for c in columns]).alias("row"), _times()).select(*[F.col("row").getField(c).alias(c) for c in columns])


def mixed_documents(docs: DataFrame, members: Column, size: Column, weights: list[float], share: float, most: int, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, with all their columns as they are, as often as the mix takes them whole (see ``repeated``)."""
    made = _selected(docs, members, size, weights, share, most, seed, LAST_BIN)
    return made.select("row", _times()).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
