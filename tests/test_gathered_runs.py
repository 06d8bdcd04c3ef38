"""Arrays of neighbours, and the plan that gathers a payload's runs once."""

import re

from pyspark.sql import functions as F

from quillon import queries as clipboard
from quillon.functions.arrays import groups, running, total


def test_groups_and_states_of_arrays(spark):
    values = [[], [1], [1, 1, 2, 2, 2, 1], list(range(1000)), [7] * 500 + [8] * 500]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<int>")
    sums = running(F.col("v"), F.lit(0), lambda s, x: s + x, "int")
    found = rows.select("v", groups(F.col("v"), lambda a, b: a == b).alias("g"), sums.alias("s"), total(F.col("v"), lambda x: x).alias("t")).collect()
    for r in found:
        assert [x for g in r["g"] for x in g] == r["v"] and all(len(set(g)) == 1 for g in r["g"]) and all(a[-1] != b[0] for a, b in zip(r["g"], r["g"][1:]))
        assert r["s"] == [sum(r["v"][: k + 1]) for k in range(len(r["v"]))] and r["t"] == sum(r["v"])


def test_runs_of_a_payload_are_gathered_once(spark, sf_dir):
    """A session keeps a hundred generated classes; each sort, window and grouping makes several."""
    plan = clipboard.q_letters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    steps = {name: len(re.findall(rf"(?m)^[ :+|*()0-9-]*{name}\b", plan)) for name in ("Sort", "Window", "ObjectHashAggregate")}
    assert steps["ObjectHashAggregate"] == 2 and steps["Sort"] <= 3 and steps["Window"] <= 6, steps
