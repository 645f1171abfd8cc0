"""Mixing sources to target weights: how many words of each source the mix takes, and how often each document is repeated for that.

All in SQL functions. Sources are aggregated before anything is joined; the table of sources then has one row a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Weights by turns, for the sources in code point order, null last.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2

#: Sizes of a text in words; null has none.
_TRIMMED = "trim(BOTH '\\t\\n\\u000b\\f\\r ' FROM coalesce(text, ''))"
SIZE = f"CAST(if({_TRIMMED} = '', 0, size(split({_TRIMMED}, '[\\\\x20\\\\x09-\\\\x0D]+'))) AS bigint)"
#: In [0, 1), from the doc_id and a seed; from the text where there is no doc_id.
DRAW = "CAST(conv(substring(md5(concat('{seed}:', coalesce(CAST(doc_id AS string), md5(coalesce(text, ''))))), 1, 13), 16, 10) AS bigint) / 4503599627370496D"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    The sources share `share` times all sizes by weight; a target stops at `most` times its source's size, and the excess is shared
    again by weight until none is above. In the order of size over weight the capped sources come first, so running sums over the
    sources, one row each, tell the share of a unit of weight at which this ends.
    """
    n = len(weights)
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % n
    weighed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    ranked = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(W.unboundedPreceding, -1)
    rest = ranked.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    level = (F.lit(share) * total - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")) / F.sum("weight").over(rest)
    leveled = weighed.withColumn("level", level).withColumn("turn", F.row_number().over(ranked))
    free = F.expr(f"level * weight <= {float(most)} * source_size")
    chosen = F.min(F.when(free, F.struct("turn", "level"))).over(W.partitionBy())["level"]
    cap = F.lit(float(most)) * F.col("source_size")
    return leveled.select("source", "source_size", F.least(cap, F.coalesce(chosen * F.col("weight"), cap)).alias("target"))


def repetitions(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for every row of docs: copies is floor(rate), and one more with a probability of what the
    rate, target over source_size, is above that. The draw is a hash of seed and doc_id, so reruns agree.

    Null and empty texts have size 0; a source without words has target 0 and no copies; rows that repeat are drawn alike; rows with a
    null source are a source of their own, the last.
    """
    sized = docs.select(F.col("doc_id").cast("long"), "source", F.expr(SIZE).alias("size"), F.expr(DRAW.format(seed=seed)).alias("draw"))
    sized = stored(sized, "sizes")
    targets = source_targets(sized, **shares).withColumnRenamed("source", "of")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["of"]))
    rate = F.expr("if(source_size = 0, 0D, target / source_size)")
    joined = joined.withColumn("rate", rate)
    return joined.select("doc_id", "size", "source_size", "target", F.expr("CAST(floor(rate) AS bigint) + if(draw < rate - floor(rate), 1, 0)").alias("copies"))


def mixed(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """The rows of docs, each as often as repetitions() says. Their texts pass by: only sizes are aggregated and joined."""
    targets = stored(source_targets(docs.select("source", F.expr(SIZE).alias("size")), **shares), "targets")
    rates = targets.select(F.col("source").alias("of"), F.expr("if(source_size = 0, 0D, target / source_size)").alias("rate"))
    found = docs.join(rates, docs["source"].eqNullSafe(rates["of"]))
    copies = F.floor(rates["rate"]).cast("int") + F.when(F.expr(DRAW.format(seed=seed)) < rates["rate"] - F.floor(rates["rate"]), 1).otherwise(0)
    return found.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("row.*")
