"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayledger.functions.text import source_key
from wayledger.session import broadcast_if_small

#: Ranges of the seeded hash by which a source's fraction is found are made so many that one holds about so many documents
#: of the largest source; only one range of a source is looked at row by row.
RANGE_DOCUMENTS, LEAST_RANGES = 20_000, 1024


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    available: int
    max_repeats: int
    wanted: float  # tokens that the mixture takes from the source
    documents: int = 0

    @property
    def epochs(self) -> float:
        return self.wanted / self.available if self.available else 0.0


def water_fill(targets: dict[str, tuple[float, int, int]], total: float | None = None) -> dict[str, Share]:
    """Tokens to take from each source; targets: source -> (weight, max repeats, tokens available).

    A source gives at most max_repeats times what it has. Sources whose part of the total would be more are clamped there,
    and the excess goes to the others in proportion to their weights, until nothing is clamped anew. Without a total, the
    largest one is taken at which no source that has tokens is clamped, so that all targets are met. Sources without
    tokens, weight or repeats give nothing, and weights needn't add up to 1.
    """
    cap = {s: max(0, m) * a for s, (w, m, a) in targets.items()}
    live = {s for s, (w, m, a) in targets.items() if w and w > 0 and cap[s] > 0}
    weight = {s: float(targets[s][0]) for s in live}
    if total is None:
        total = min((cap[s] / weight[s] for s in live), default=0.0) * sum(weight.values())
    wanted, open_, left = dict.fromkeys(targets, 0.0), set(live), float(total)
    while open_:
        all_weight = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / all_weight > cap[s] * (1 + 1e-12)}
        if not over:
            wanted |= {s: min(float(cap[s]), left * weight[s] / all_weight) for s in open_}
            break
        for s in over:
            wanted[s] = float(cap[s])
        left = max(0.0, left - sum(cap[s] for s in over))
        open_ -= over
    return {s: Share(s, float(w or 0), a, m, wanted[s]) for s, (w, m, a) in targets.items()}


def plan_mix(docs: DataFrame, targets: DataFrame, total: float | str | None = None) -> dict[str, Share]:
    """water_fill over sums made on the executors. The targets are one row a source; sources are equal ignoring case,
    outer blanks and joining signs. total: tokens of the mixture; 'all' for as many as the targets' sources have."""
    want = {r[0]: (r[1] or 0.0, r[2] or 0) for r in targets.select(source_key("source"), "target_share", "max_repeats").collect() if r[0] is not None}
    sums = docs.where(F.col("source").isin(*want)).groupBy("source").agg(F.sum("tokens"), F.count("*")).collect() if want else []  # a row a target
    have = {r[0]: (int(r[1] or 0), int(r[2])) for r in sums}
    if total == "all":
        total = float(sum(tokens for tokens, _ in have.values()))
    plan = water_fill({s: (w, m, have.get(s, (0, 0))[0]) for s, (w, m) in want.items()}, total)
    return {s: replace(p, documents=have.get(s, (0, 0))[1]) for s, p in plan.items()}


def mix(docs: DataFrame, plan: dict[str, Share], key: str = "doc_id", seed: int = 17) -> DataFrame:
    """(key, source, tokens, repeats): the documents of the mixture and how often each is used.

    docs: key, source (as source_key) and tokens. Each document of a source is used as often as the whole part of its
    epochs; the fractional part is drawn in the order of a seeded hash until the tokens are reached, the last document
    being taken if that comes nearer. No document is used more often than its source's max_repeats.
    The order is cut into ranges, whose token sums show in which range the draw ends; only that range is ordered. Sources
    without a target, and documents that aren't used, are left out; null tokens count as 0.
    """
    rows = [(s, int(p.epochs + 1e-9), max(0.0, p.wanted - int(p.epochs + 1e-9) * p.available), p.max_repeats) for s, p in plan.items()]
    spark = docs.sparkSession
    ranges = max(LEAST_RANGES, math.ceil(max((p.documents for p in plan.values()), default=0) / RANGE_DOCUMENTS))
    epochs = F.broadcast(spark.createDataFrame(rows or [("", 0, 0.0, 0)], "source string, whole int, part double, most int"))  # a row a target
    own = docs.select(key, "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    own = own.withColumn("_h", F.xxhash64(F.lit(seed), key)).withColumn("_range", F.pmod("_h", F.lit(ranges))).join(epochs, "source")
    sums = own.groupBy("source", "_range").agg(F.sum("tokens").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    # targets x ranges rows at most, a row for RANGE_DOCUMENTS documents
    before = before.join(sums.withColumnRenamed("_sum", "_in"), ["source", "_range"])
    placed = own.join(broadcast_if_small(before, 500_000), ["source", "_range"])
    whole_range = F.col("_before") + F.col("_in") <= F.col("part")
    at_edge = ~whole_range & (F.col("_before") < F.col("part"))
    running = F.sum("tokens").over(Window.partitionBy("source", "_range").orderBy("_h", key))
    drawn = placed.where(at_edge).withColumn("_drawn", (F.col("_before") + running - F.col("tokens") / 2 <= F.col("part")).cast("int"))
    rest = placed.where(~at_edge).withColumn("_drawn", whole_range.cast("int"))
    used = drawn.unionByName(rest).withColumn("repeats", F.least(F.col("whole") + F.col("_drawn"), F.col("most"))).where("repeats > 0")
    return used.select(key, "source", "tokens", "repeats")


def shares(mixed: DataFrame, plan: dict[str, Share]) -> DataFrame:
    """Per target source: target_share, tokens taken, actual_share, documents, most repeats and epochs."""
    spark = mixed.sparkSession
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    rows = [(s, p.target, p.available, p.max_repeats) for s, p in plan.items()]
    want = spark.createDataFrame(rows, "source string, target_share double, available_tokens long, max_repeats int")
    out = want.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # a row a target
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), all_tokens), F.lit(0.0))).withColumn("epochs", F.coalesce(F.try_divide(F.col("tokens"), F.col("available_tokens")), F.lit(0.0)))
