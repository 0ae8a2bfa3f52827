"""Mixing sources to target weights by Poisson replication.

A source with share s of the rows and target share w gets the mean repetition
rate w * total / rows of the source.  Each document's number of copies inverts
the Poisson distribution of that mean at a number in [0, 1) hashed from its id
and the seed, so it is reproducible, needs no state and is not bounded by a
largest number of copies.  Copies are exploded and shuffled globally by a hash
of id, copy and seed.

Defined cases: rows without a source are a source of their own, rows without
an id hash as the empty id; rows that share an id get equally many copies;
sources without a weight count as weight 0 and give no copies; weights of
sources that are absent are left out of the total; a table without rows gives
none; texts, whatever their length, are only carried; a column named like the
copy's number keeps its name and that one gets an underscore.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from tempora.llm.shared import free_name, written

#: Probabilities (8 bytes each) of all sources' distributions that are broadcast at most; more are joined by a shuffle.
BROADCAST_STEPS = 2_000_000


def hashed_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(2**52)


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, total: int | None = None, source: str = "source") -> DataFrame:
    """``(source, n, rate)``; without ``weights`` a source weighs its rows to the ``power``."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        weight = F.lit(None).cast("double")
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
        weight = F.coalesce(weight, F.lit(0.0))
    weighed = sizes.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    rows = F.col("all_n") if total is None else F.lit(total)
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * rows / F.col("n")).otherwise(0.0)
    return weighed.crossJoin(F.broadcast(sums)).select("source", "n", rate.alias("rate"))  # sums is one row


def _last(rate: Column) -> Column:
    """The number of copies beyond which a double cannot tell the rest from 0."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")


def distributions(mixed: DataFrame) -> DataFrame:
    """``(source, distribution)`` of ``mixed(source, rate)``: P(X <= k) for k = 0, 1, ..., by running sums over the source's steps."""
    steps = mixed.withColumn("k", F.explode(F.sequence(F.lit(0), _last(F.col("rate")))))
    so_far = Window.partitionBy("source").orderBy("k")
    log_p = F.sum(F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log(F.col("rate") / F.col("k")))).over(so_far)
    below = steps.withColumn("log_p", log_p).withColumn("below", F.sum(F.exp("log_p")).over(so_far))
    ordered = below.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("k", "below"))).alias("steps"))
    return ordered.select("source", F.col("steps.below").alias("distribution"))


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, total: int | None = None,
    seed: int = 11, doc_id: str = "doc_id", source: str = "source", copy: str = "copy",
) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled, with the number of each ``copy`` (from 1)."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    mixed = rates(docs.select(F.col(f"`{source}`").alias("source")), weights, power, total)
    mixed = written(mixed.filter("rate > 0").select("source", "rate"), "rates")
    steps = distributions(mixed).select(F.col("source").alias("mix_source"), "distribution")
    if (mixed.agg(F.sum(_last(F.col("rate")).cast("long"))).first()[0] or 0) <= BROADCAST_STEPS:
        steps = F.broadcast(steps)
    key = F.coalesce(F.col(names[doc_id]).cast("string"), F.lit(""))
    # bound to a name by a lambda, the hash is computed once a row and not once a step
    unit = F.array(hashed_unit(key, F.lit(str(seed))))
    copies = F.element_at(F.transform(unit, lambda u: F.size(F.filter("distribution", lambda below: below <= u))), 1)
    joined = rows.join(steps, F.col(names[source]).eqNullSafe(F.col("mix_source"))).withColumn("copies", copies).drop("distribution", "mix_source")
    exploded = joined.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    place = F.md5(F.concat_ws(":", key, F.col("copy").cast("string"), F.lit(f"{seed}:place")))
    shuffled = exploded.withColumn("place", place).repartition("place").sortWithinPartitions("place")
    copy = free_name(docs.columns, copy)
    return shuffled.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("copy").alias(copy))
