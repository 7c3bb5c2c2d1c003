"""How many subjects a rule flags, as a step function of a threshold, from one pass over what the rule reads.

The rule itself is asked twice per subject, at the strictest and at the loosest value of the threshold. Who is flagged at the strictest is
flagged at any; who is not flagged at the loosest never is (suppressed, not applicable, failing a second condition). All others turn at the
value that the rule compares with the threshold, so counts of those values, summed up in order, give the number flagged at every threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from lacuna.params import FINDING_STATES, RULES, RuleParams
from lacuna.session import checkpoint_dir


@dataclass(frozen=True)
class Sweep:
    """``rule`` maps parameters to a verdict; ``measure`` is compared with ``parameter``: at least it, or below it, is a hit."""

    rule_id: str
    parameter: str
    rule: Callable[[RuleParams], Column]
    measure: Column
    at_least: bool

    def flagged(self, value: float, params: RuleParams = RULES) -> Column:
        """Does the rule flag the subject at one threshold?"""
        return F.coalesce(self.rule(replace(params, **{self.parameter: value})).getField("status").isin(FINDING_STATES), F.lit(False))

    def turning(self, params: RuleParams = RULES) -> Column:
        """(rule, parameter, position, always): position grows with strictness, so hits at a threshold are those not before it."""
        strict, loose = (float("inf"), float("-inf")) if self.at_least else (float("-inf"), float("inf"))
        value = self.measure.cast("double")
        always = self.flagged(strict, params)
        return F.when(self.flagged(loose, params), F.struct(
            F.lit(self.rule_id).alias("rule_id"), F.lit(self.parameter).alias("parameter"), F.lit(self.at_least).alias("at_least"),
            F.when(~always, value).alias("threshold")))


def _running(rows: DataFrame, group: list[str], order: str, n: str) -> DataFrame:
    """Adds ``upto``, the sum of ``n`` over the rows of the group up to and with this one; (group, order) must be distinct.

    Rows are cut into ranges of (group, order); the sums of the ranges are added up first, so no group is one task."""
    checkpoint_dir(rows.sparkSession)
    cut = rows.repartitionByRange(*group, order).withColumn("part", F.spark_partition_id()).checkpoint()
    sums = cut.groupBy(*group, "part").agg(F.sum(n).alias("in_part"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*group, "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*group, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(ahead, [*group, "part"]).withColumn("upto", F.col("ahead") + F.sum(n).over(inside)).drop("part", "ahead")


def steps(sources: list[tuple[DataFrame, list[Sweep]]], params: RuleParams = RULES) -> DataFrame:
    """(rule_id, parameter, threshold, flagged, always): a row for each value at which some subject turns, with the number flagged by a
    threshold of just that value and the number ``n`` that turn there; :func:`flagged_at` reads off any other value. Subjects flagged at any threshold are counted in ``always`` and in ``flagged``;
    a rule that no subject turns for has no row."""
    turns = None
    for rows, sweeps in sources:
        each = rows.select(F.explode(F.array(*[s.turning(params) for s in sweeps])).alias("t")).where("t IS NOT NULL").select("t.*")
        turns = each if turns is None else turns.unionByName(each)
    counts = turns.groupBy("rule_id", "parameter", "at_least", "threshold").agg(F.count(F.lit(1)).alias("n"))
    group = ["rule_id", "parameter"]
    always = counts.where("threshold IS NULL").select(*group, F.col("n").alias("always"))
    turning = _running(counts.where("threshold IS NOT NULL"), group, "threshold", "n")
    total = turning.groupBy(*group).agg(F.sum("n").alias("total"))
    hits = F.when(F.col("at_least"), F.col("total") - F.col("upto") + F.col("n")).otherwise(F.col("upto") - F.col("n"))
    # One row per rule and parameter on the right of both joins.
    return (turning.join(F.broadcast(total), group).join(F.broadcast(always), group, "left").fillna(0, ["always"])
            .select(*group, "at_least", "threshold", (hits + F.col("always")).alias("flagged"), "n", "always"))


def flagged_at(step_rows: DataFrame, value: float) -> DataFrame:
    """(rule_id, parameter, flagged) at one threshold, read off the steps."""
    hit = F.when(F.col("at_least"), F.col("threshold") >= value).otherwise(F.col("threshold") < value)
    return step_rows.groupBy("rule_id", "parameter").agg((F.max("always") + F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))).alias("flagged"))
