"""Quality rules: counting rules and robust multivariate outliers.

Each document becomes a short vector of transformed statistics, rounded to a thousandth. For each group of language and
source a minimum-covariance-determinant (MCD) estimate of centre and scatter is sought from three deterministic starts
(medians with scaled deviations, correlations of bounded values, and of spatial signs, after Hubert, Rousseeuw and Verdonck,
2012). Concentration steps go on until no determinant falls, and the start with the least determinant is taken, then
reweighted. Documents far from their group's centre by Mahalanobis distance are rejected.

The steps run over *all* rows as Spark aggregations: equal vectors of a group are counted once, with their number, before;
a step is one aggregation into bins of distance that carry sums, so that no group is ever gathered in one task.

Scatter in no direction is taken to be less than the data give for all groups: the pooled distance of the statistics from
their groups' medians, or what one symbol, repeated line or window more changes in a text of median size. For most clean texts
share one value of the last three statistics, and their own scatter is nil. Subsets whose scatter is less than
that in all directions have equal determinants.

Defined results: a null text counts as empty and fails the base rule; null languages and sources form groups of their own.
A group with fewer than ``MIN_GROUP`` passing rows is judged by the estimate of its language (all passing rows of it), and
where that is as small, by that of all rows; where even these are fewer, only the base rule decides. A statistic without any
spread decides nothing. Repeated rows count as often as they occur; equal determinants go to the earlier start, and a row
exactly on the limit stays. Empty tables give empty results. Extra columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, arrow_pass, cut, schema_with, slices, small_enough, utf8, whole_row

SYMBOLS = b"#*$%&|<>"
#: Names of the transformed statistics.
FEATURES = ("x_word", "x_symbol", "x_lines", "x_repeat")
P = len(FEATURES)
#: Share of the rows of a group that a concentration step keeps, and most steps.
CORE, MOST_STEPS = 0.75, 40
#: Share of the reweighting step, and that beyond whose chi-square quantile a document is rejected.
REWEIGHT, CONFIDENCE = 0.975, 0.999
#: Least passing rows of an estimate: five a statistic.
MIN_GROUP = 5 * P
#: Most groups whose parameters are broadcast (about 200 bytes each); beyond it the join is left to Spark.
MOST_BROADCAST = 20_000
#: The key of the group of all rows.
ALL_ROWS = "\x03"
_BIN = 100.0
STARTS = 3


def counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows, and lines with a word."""
    words = text.split()
    if not words:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0
    blanks = len(text) - len(text.translate(None, ASCII_SPACE))
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    lines = [line for line in text.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen, last = Counter(windows), 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(last, at)
                last = at + 3
    return len(words), points - blanks, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = np.array([counts(x) for x in part.column("_text").to_pylist()], np.int64).reshape(-1, 6)
        kept = [i for i, name in enumerate(part.schema.names) if name != "_text"]
        arrays = [part.column(i) for i in kept] + [pa.array(found[:, k]) for k in range(6)]
        yield pa.RecordBatch.from_arrays(arrays, names=[part.schema.names[i] for i in kept] + list(_COUNTS))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def with_counts(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of the documents and the counting columns, in one Arrow pass over whole texts."""
    kept = docs.select(*columns, utf8(text).alias("_text"))
    return arrow_pass(kept, _count_batches, schema_with(kept, ", ".join(f"{c} bigint" for c in _COUNTS), "_text"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """Log-transformed ratios; the additive terms keep a single symbol or line in a long text near the centre."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    found = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log(F.col("n_symbols") / n + 0.05),
        F.log(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) + 0.10),
        F.log(F.col("n_repeat_words") / n + 0.10),
    )
    return [F.round(x, 3).alias(name) for x, name in zip(found, FEATURES)]


def group_key(*columns: str) -> Column:
    """One text key of nullable columns."""
    return F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns])


def chi_square_cdf(x: float, degrees: int) -> float:
    """Closed form for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 0.0
    for k in range(degrees // 2):
        total += term
        term *= half / (k + 1)
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return (low + high) / 2


def squared_distance(center: str = "center", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of the feature columns, as plain arithmetic."""
    gap = [F.col(x) - F.col(center)[i] for i, x in enumerate(FEATURES)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + (1 if i == j else 2) * F.col(inverse)[i * P + j] * gap[i] * gap[j]
    return F.greatest(total, F.lit(0.0))


def weighted_quantile(rows: DataFrame, keys: list[str], value: Column, share: float, name: str) -> DataFrame:
    """Upper edge of the bin that reaches ``share`` of each key's rows (``m`` of them a vector): the same on every run."""
    w = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    by = ", ".join(keys)
    binned = rows.groupBy(*keys, F.floor(value * _BIN).alias("_bin")).agg(F.sum("m").alias("_n"))
    run = binned.select(*keys, "_bin", F.expr(f"sum(_n) OVER (PARTITION BY {by} ORDER BY _bin {w})").alias("_run"), F.expr(f"sum(_n) OVER (PARTITION BY {by})").alias("_all"))
    return run.where(F.col("_run") >= share * F.col("_all")).groupBy(*keys).agg(((F.min("_bin") + 1) / _BIN).alias(name))


def _with(rows: DataFrame, params: DataFrame, broadcast: bool) -> DataFrame:
    return rows.join(F.broadcast(params) if broadcast else params, "g")


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in _PAIRS)]


def _sums(values: list[Column]) -> list[Column]:
    """Weighted number, sums and sums of products of the values."""
    m = F.col("m")
    return [F.sum("m").alias("n"), *[F.sum(m * x).alias(f"s{i}") for i, x in enumerate(values)], *[F.sum(m * values[i] * values[j]).alias(f"q{i}{j}") for i, j in _PAIRS]]


def moments(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances from each row's sums."""
    n = frame["n"].to_numpy(float)
    mean = frame[[f"s{i}" for i in range(P)]].to_numpy(float) / n[:, None]
    cov = np.empty((len(frame), P, P))
    for i, j in _PAIRS:
        cov[:, i, j] = cov[:, j, i] = frame[f"q{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j]
    return mean, cov


def raised(cov: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Covariances with no less scatter in any direction than independent statistics of the floors' deviations have."""
    outer = floors[:, None] * floors[None, :]
    size, axes = np.linalg.eigh(cov / outer)
    return (axes * np.maximum(size, 1.0)[..., None, :]) @ np.swapaxes(axes, -1, -2) * outer


def resolution(passing: DataFrame) -> np.ndarray:
    """What one more symbol, repeated line or repeated window changes a statistic by, in a text of median size.

    No scatter is finer than that: in a group where hardly any text has one, the first is not yet an outlier.
    """
    size = passing.select(F.lit(1).alias("m"), F.explode(F.array(F.struct(F.lit(0).alias("i"), F.log("n_words").alias("x")), F.struct(F.lit(1).alias("i"), F.log(F.greatest("n_lines", F.lit(1))).alias("x")))).alias("f")).select("m", "f.i", "f.x")
    found = {r["i"]: math.exp(r["v"]) for r in weighted_quantile(size, ["i"], F.col("x"), 0.5, "v").collect()}  # two rows
    n, lines = found.get(0, 1.0), found.get(1, 1.0)
    return np.array([0.0, math.log(1 + 1 / n / 0.05), math.log(1 + 1 / lines / 0.10), math.log(1 + 6 / n / 0.10)])


def pooled_spread(cells: DataFrame, center: DataFrame, broadcast: bool) -> np.ndarray:
    """Each statistic's mean distance from its group's median over all rows, as a normal deviation."""
    near = _with(cells, center, broadcast)
    total = near.agg(F.sum("m"), *[F.sum(F.col("m") * F.abs(F.col(x) - F.col("center")[i])) for i, x in enumerate(FEATURES)]).first()
    if not total[0]:
        return np.zeros(P)
    return math.sqrt(math.pi / 2) * np.array([float(x) for x in total[1:]]) / float(total[0])


def _starts(floors: np.ndarray):
    """Three starts a group: no correlation, that of bounded values, and that of spatial signs, around the medians."""

    def correlation(cov: np.ndarray) -> np.ndarray:
        sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=-2, axis2=-1), 1e-12))
        found = cov / sd[:, :, None] / sd[:, None, :]
        return 0.9 * np.clip(found, -1, 1) * (1 - np.eye(P)) + np.eye(P)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                scale = np.maximum(np.stack(f["mad"].to_list()).astype(float) * 1.4826, floors)
                found = [np.repeat(np.eye(P)[None], len(f), 0)]
                for k in "tu":
                    own = f[[f"{k}_{x}" for x in _SUMS]].rename(columns={f"{k}_{x}": x for x in _SUMS})
                    found.append(correlation(moments(own)[1]))
                for s, c in enumerate(found):
                    inverse = np.linalg.inv(c * scale[:, :, None] * scale[:, None, :]).reshape(-1, P * P)
                    yield pd.DataFrame({"g": f["g"], "s": s, "center": f["center"], "inverse": list(inverse), "log_det": math.inf, "done": False})

    return run


def _concentrated(floors: np.ndarray, scale: float):
    """Means, an inverted covariance and its log determinant from the core's sums; done once that does not fall."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                mean, cov = moments(f)
                cov = raised(cov * scale, floors)
                log_det, before = np.linalg.slogdet(cov)[1], f["log_det"].to_numpy(float)
                falls = log_det < before - 1e-9
                inverse = np.linalg.inv(cov).reshape(-1, P * P)
                pick = lambda new, old: [a if x else b for a, b, x in zip(new, old, falls)]
                yield pd.DataFrame({"g": f["g"], "s": f["s"], "center": pick(mean, f["center"]), "inverse": pick(inverse, f["inverse"]), "log_det": np.where(falls, log_det, before), "done": ~falls})

    return run


_PARAMS = "g string, s int, center array<double>, inverse array<double>, log_det double, done boolean"


def consistency(share: float) -> float:
    """What the covariance of the closest ``share`` of normal rows is multiplied by."""
    return share / chi_square_cdf(chi_square_quantile(share, P), P + 2)


def _core_sums(near: DataFrame, share: float) -> DataFrame:
    """Sums over the closest ``share`` of each ``g, s``; whole bins of distance, up to the one that reaches it."""
    sums = _sums([F.col(x) for x in FEATURES])
    binned = near.groupBy("g", "s", F.floor(F.log(F.col("d") + 1e-9) * _BIN).alias("_bin")).agg(*sums)
    w = "PARTITION BY g, s ORDER BY _bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    run = binned.select("g", "s", *_SUMS, F.expr(f"sum(n) OVER ({w}) - n").alias("_before"), F.expr("sum(n) OVER (PARTITION BY g, s)").alias("_all"))
    return run.where(F.col("_before") < share * F.col("_all")).groupBy("g", "s").agg(*[F.sum(x).alias(x) for x in _SUMS])


def fit(cells: DataFrame, finest: np.ndarray, groups: int | None = None) -> DataFrame:
    """``g, center, inverse, log_det`` of each group of ``cells`` (``g``, the features and ``m``, how many rows have them).

    ``groups`` is their number, if it is known; each has a row, or one for each start, in the tables on the way.
    """
    long = cells.select("g", "m", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("x")) for i, x in enumerate(FEATURES)])).alias("f")).select("g", "m", "f.i", "f.x")
    pivot = lambda t, v, out: t.groupBy("g").agg(F.expr(f"transform(array_sort(collect_list(struct(i, {v}))), z -> z.{v})").alias(out))  # noqa: E731  P rows a group
    center = cut(pivot(weighted_quantile(long, ["g", "i"], F.col("x"), 0.5, "v"), "v", "center"), groups)
    broadcast = small_enough(center, MOST_BROADCAST)
    starts = None if groups is None else STARTS * groups
    floors = np.maximum(pooled_spread(cells, center, broadcast), finest)
    floors = np.where(floors > 1e-6, floors, 1.0)
    spread = _with(long, center, broadcast).select("g", "m", "i", F.abs(F.col("x") - F.col("center")[F.col("i")]).alias("x"))
    mad = pivot(weighted_quantile(spread, ["g", "i"], F.col("x"), 0.5, "v"), "v", "mad")
    first = cut(center.join(mad, "g"), groups)
    known = _with(cells, first, broadcast)
    z = [(F.col(x) - F.col("center")[i]) / F.greatest(F.col("mad")[i] * 1.4826, F.lit(float(floors[i]))) for i, x in enumerate(FEATURES)]
    norm = F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]))
    signs = [F.when(norm > 0, x / norm).otherwise(0.0) for x in z]
    bounded = [x.alias(f"t_{n}") for x, n in zip(_sums([F.tanh(x) for x in z]), _SUMS)]
    spatial = [x.alias(f"u_{n}") for x, n in zip(_sums(signs), _SUMS)]
    params = cut(_with(known.groupBy("g").agg(*bounded, *spatial), first, broadcast).mapInPandas(_starts(floors), _PARAMS), starts)
    broadcast = small_enough(params, MOST_BROADCAST)
    for _ in range(MOST_STEPS):
        going = params.where(~F.col("done"))
        if small_enough(going, 0):
            break
        near = _with(cells, going, broadcast).withColumn("d", squared_distance())
        sums = _core_sums(near.select("g", "s", "m", "d", *FEATURES), CORE).join(F.broadcast(going) if broadcast else going, ["g", "s"])
        stepped = sums.mapInPandas(_concentrated(floors, consistency(CORE)), _PARAMS)
        params = cut(stepped.unionByName(params.where("done")), starts)
    least = params.groupBy("g").agg(F.min(F.struct("log_det", "s", "center", "inverse")).alias("p")).select("g", "p.center", "p.inverse", "p.log_det")
    least = cut(least, groups)
    limit = chi_square_quantile(REWEIGHT, P)
    inner = _with(cells, least, broadcast).where(squared_distance() <= limit).withColumn("s", F.lit(0))
    last = _with(inner.groupBy("g", "s").agg(*_sums([F.col(x) for x in FEATURES])), least.withColumns({"done": F.lit(False), "log_det": F.lit(math.inf)}), broadcast)
    final = last.mapInPandas(_concentrated(floors, consistency(REWEIGHT)), _PARAMS).select("g", "center", "inverse")
    return cut(final.join(least.select("g", "log_det"), "g"), groups)


def _grouped(stats: DataFrame) -> DataFrame:
    """Rows with the keys of their group, of its language and of all, the features, and the base rule."""
    keys = {"g": group_key("lang", "source"), "g_lang": F.concat(F.lit("\x02"), group_key("lang")), "g_all": F.lit(ALL_ROWS)}
    return stats.withColumns(keys | dict(zip(FEATURES, features())) | {"base_failed": base_failed()})


def learn(stats: DataFrame) -> DataFrame:
    """Parameters of every group, language and of all, large enough for one, from the counts, ``lang`` and ``source`` of all rows."""
    passing = _grouped(stats).where(~F.col("base_failed"))
    fine = cut(passing.groupBy("g", "g_lang", "g_all", *FEATURES).agg(F.count(F.lit(1)).alias("m")))
    levels = fine.select(F.explode(F.array("g", "g_lang", "g_all")).alias("g"), "m", *FEATURES).groupBy("g", *FEATURES).agg(F.sum("m").alias("m"))
    sizes = cut(levels.groupBy("g").agg(F.sum("m").alias("n")).where(F.col("n") >= MIN_GROUP).select("g"))
    groups = sizes.count()
    cells = cut(_with(levels, sizes, groups <= MOST_BROADCAST))
    return fit(cells, resolution(passing), groups)


def verdict(stats: DataFrame, params: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """``stats`` with ``base_failed``, squared ``distance`` (null where no estimate applies) and ``kept``."""
    rows = _grouped(stats)
    broadcast = small_enough(params, MOST_BROADCAST)
    levels = ("g", "g_lang")
    whole = params.where(F.col("g") == ALL_ROWS).select("center", "inverse").collect()  # one row
    params = params.where(F.col("g") != ALL_ROWS).withColumnRenamed("g", "_g")
    for level in levels:
        own = params.select(F.col("_g").alias(level), F.struct("center", "inverse").alias(f"p_{level}"))
        rows = rows.join(F.broadcast(own) if broadcast else own, level, "left")
    best = F.coalesce(*[F.col(f"p_{level}") for level in levels], *[F.struct(F.lit(r["center"]).alias("center"), F.lit(r["inverse"]).alias("inverse")) for r in whole])
    rows = rows.withColumn("center", best["center"]).withColumn("inverse", best["inverse"])
    rows = rows.withColumn("distance", F.when(F.col("center").isNotNull(), squared_distance()))
    limit = chi_square_quantile(confidence, P)
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= limit)
    return rows.withColumn("kept", kept).drop("center", "inverse", "g_all", *levels, *[f"p_{level}" for level in levels], *FEATURES)


def assess(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``lang``, ``source``, the counts, ``base_failed``, ``distance`` and ``kept``."""
    stats = cut(with_counts(docs, ["doc_id", "lang", "source"]))
    return verdict(stats, learn(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns. Texts are not shuffled: the counts are taken again on the way out."""
    params = learn(cut(with_counts(docs, ["lang", "source"])))
    inner = docs.select("lang", "source", whole_row(docs).alias("_row"), "text")
    return verdict(with_counts(inner, ["lang", "source", "_row"]), params).where("kept").select("_row.*")
