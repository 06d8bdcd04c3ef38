"""Mixing sources by temperature.

Each source's share of the tokens is raised to an exponent and normalised. The exponent is bisected: to the largest one whose
weights reach a target entropy, or to the smallest one that repeats no source more than a limit times as often as another.
The weights are then realised within a token budget as block permutations: a hash deals each source's documents into blocks;
every pass over a source visits its blocks in an order of its own, whole passes take all blocks and the last one stops
at the block nearest to the budget. Documents follow their block, so no source is sorted or gathered.

Defined results: null sources are a source of their own; null and blank texts count no token and follow their block;
repeated rows share a block and are mixed as often as they occur; texts of any length are taken whole; an empty table gives no rows. With fewer than two sources
with tokens, the exponent is 1. Sources with equal shares get equal weights; blocks are ordered by a hash, then by number.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_enough, whole_row

BLOCKS, SEED = 1024, 11
#: How many times as often as the least repeated source any source may be repeated.
REPEAT_LIMIT = 2.0
#: Most rows of the plan (sources x blocks x passes) that are broadcast, about 60 bytes each.
MOST_BROADCAST = 300_000
#: Most sources whose shares the driver gathers to bisect the exponent.
MOST_GATHERED = 100_000


def words(text: str = "text") -> Column:
    """Tokens of a text by the word rule; the size that budgets are counted in unless another column is given."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _measures(shares: DataFrame):
    """Of an exponent: the entropy of the weights, and the ratio of the most to the least repeated source.

    Over the gathered shares where these are few; else a small Spark job each time.
    """
    if small_enough(shares, MOST_GATHERED):
        share = np.array([r["share"] for r in shares.select("share").collect()], float)

        def here(exponent: float) -> tuple[float, float]:
            raised = share**exponent
            weights = raised / raised.sum()
            return float(-(weights * np.log(weights)).sum()), float((raised / share).max() / (raised / share).min())

        return here

    def there(exponent: float) -> tuple[float, float]:
        raised = F.pow("share", F.lit(exponent))
        z, zlog, high, low = shares.agg(F.sum(raised), F.sum(raised * F.log(raised)), F.max(raised / F.col("share")), F.min(raised / F.col("share"))).first()
        return math.log(z) - zlog / z, float(high / low)

    return there


def exponent(shares: DataFrame, entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT, steps: int = 40) -> float:
    """The exponent in [0, 1] that meets the target: entropy falls and repetition nears 1 as it grows."""
    if small_enough(shares, 1):
        return 1.0
    measures = _measures(shares)
    if entropy is not None:
        meets = lambda x: measures(x)[0] >= entropy
        grow = True  # the largest exponent that still has the entropy
    else:
        meets = lambda x: measures(x)[1] <= repeat_limit
        grow = False  # the smallest exponent within the limit
    low, high = 0.0, 1.0
    if meets(1.0 if grow else 0.0):
        return 1.0 if grow else 0.0
    for _ in range(steps):
        mid = (low + high) / 2
        if meets(mid) == grow:
            low = mid
        else:
            high = mid
    return low if grow else high


def _order(*columns: str) -> Column:
    return F.xxhash64(*columns, F.lit(SEED))


def plan(sized: DataFrame, entropy: float | None = None, repeat_limit: float | None = REPEAT_LIMIT, budget: float | None = None) -> DataFrame:
    """``s, block, weight, epoch, position``: which passes visit each block, and when on the mixture's scale of 0 to 1.

    ``sized`` has ``s``, ``block`` and ``n_tokens``. Without a budget, it is the least that shows every document once.
    """
    blocks = cut(sized.groupBy("s", "block").agg(F.sum("n_tokens").alias("t")))
    totals = cut(blocks.groupBy("s").agg(F.sum("t").cast("double").alias("t")).where("t > 0"))
    whole = totals.agg(F.sum("t")).first()[0]
    if not whole:
        one = blocks.select("s", "block", F.lit(0.0).alias("weight"), F.lit(0).alias("epoch"), F.lit(0.0).alias("position"))
        return cut(one)
    shares = cut(totals.withColumn("share", F.col("t") / F.lit(whole)))
    power = exponent(shares, entropy, repeat_limit)
    raised = F.pow("share", F.lit(power))
    z, least = shares.agg(F.sum(raised), F.min(raised / F.col("share"))).first()
    tokens = budget if budget is not None else whole * z / least
    weights = shares.select("s", (raised / F.lit(z)).alias("weight"), "t").withColumn("passes", F.col("weight") * F.lit(tokens) / F.col("t"))
    weights = weights.withColumn("passes", F.when(F.abs(F.col("passes") - F.round("passes")) < 1e-9, F.round("passes")).otherwise(F.col("passes")))
    weights = cut(weights.select("s", "weight", "passes", F.col("t").alias("total")))
    each = blocks.join(weights, "s", "left").fillna({"weight": 0.0, "passes": 1.0, "total": 0.0})  # sources without a token stay whole
    each = each.withColumn("epoch", F.explode(F.expr("sequence(0, cast(greatest(ceil(passes), 1) as int) - 1)")))
    before = F.expr("sum(t) OVER (PARTITION BY s, epoch ORDER BY h, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - t")  # BLOCKS rows each
    each = each.withColumn("h", _order("s", "block", "epoch")).withColumn("before", before)
    taken = (F.col("total") == 0) | (F.col("before") + F.col("t") / 2 <= (F.col("passes") - F.col("epoch")) * F.col("total"))
    position = F.when(F.col("total") == 0, F.lit(0.0)).otherwise((F.col("epoch") + F.col("before") / F.col("total")) / F.col("passes"))
    return cut(each.where(taken).select("s", "block", "weight", "epoch", position.alias("position")))


MEASURES = ("_n_tokens", "_weight", "_epoch", "_position")


def mix(docs: DataFrame, source: str = "source", tokens: Column | None = None, **target: float) -> DataFrame:
    """The documents, each as often as its source's weight asks, with ``_n_tokens, _weight, _epoch, _position``.

    Sorting by ``_position`` gives a stream in which every stretch holds the sources close to their weights. A column of the
    documents that is named like one of the four stays, and that measure is left out.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))
    block = F.pmod(F.xxhash64("doc_id", "text", F.lit(SEED)), F.lit(BLOCKS)).cast("int")
    sized = docs.select(key.alias("s"), block.alias("block"), (words() if tokens is None else tokens).alias("n_tokens"), whole_row(docs).alias("row"))
    visits = plan(sized.select("s", "block", "n_tokens"), **target)
    joined = sized.join(F.broadcast(visits) if small_enough(visits, MOST_BROADCAST) else visits, ["s", "block"])
    measures = [F.col(m[1:]).alias(m) for m in MEASURES if m not in docs.columns]
    return joined.select("row.*", *measures)
