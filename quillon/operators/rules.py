"""Ordered rules as a table: the first rule that holds for a host, by suffix, at any number of rules.

A rule names a host (``here``), all hosts below it (``below``), or both. A host is taken apart to its suffixes, so rules are met by an equi-join and the
first one is taken by one grouping: no pattern is tried against every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of rules that are broadcast at most (some 100 bytes each); more meet by an exchange.
MOST_BROADCAST = 100_000
RULES = "position int, suffix string, here boolean, below boolean, value string"


def suffixes(host: Column) -> Column:
    """The host and what is left of it behind each dot: ``a.b.c, b.c, c``."""
    labels = F.split(F.lower(host), r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def first_rule(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """``hosts`` with ``value``: of the rules (``RULES``) for the host or one that it is below, the first one's.

    Each distinct host is looked up once. A null host, and one without a rule, has no value. Rules that share a position are
    ordered by value.
    """
    distinct = hosts.select(F.col(host).alias("_host")).where(F.col("_host").isNotNull()).distinct()
    parts = distinct.select("_host", F.posexplode(suffixes(F.col("_host"))).alias("_cut", "suffix"))
    held = rules.select("position", F.lower("suffix").alias("suffix"), "here", "below", "value")
    if rules.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        held = F.broadcast(held)
    met = parts.join(held, "suffix").where(F.when(F.col("_cut") == 0, F.col("here")).otherwise(F.col("below")))
    best = met.groupBy("_host").agg(F.min_by("value", F.struct("position", "value")).alias("value"))
    return hosts.join(best, hosts[host] == best["_host"], "left").drop("_host")
