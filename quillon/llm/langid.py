"""Language identification as inference of a multilingual mixture.

Training counts hashed letter trigrams per language over a bounded sample of labelled texts. A text's trigrams are then taken
to come from a mixture of languages: the text starts with its best single language, and a further one joins the set when
expectation-maximisation of the proportions raises the log-likelihood by more than a penalty that grows with the logarithm
of the number of trigrams. The prediction is the language with the largest proportion, the score that proportion.

Defined results: ``und`` with score 0 where a text is null or has no letter, or where nothing could be learned; equal
proportions go to the language that sorts first. Empty, short and very long texts are taken whole. Languages are trained
from the text alone; ids and sources take no part in a prediction. Repeated rows each get their row, and count as often in
training. Extra columns may have any name; ``predict`` returns only those asked for. An empty table gives no rows. Any number of
labels is learned; the model grows with their distinct trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, crc_fold, schema_with, slices, small_enough

#: Buckets of the trigram hash.
BUCKETS = 1 << 16
#: Documents expected in each language's training sample, chosen by a hash of id and text.
SAMPLE = 4000
#: Languages whose sizes are broadcast at most, a row each.
MOST_BROADCAST = 100_000
#: Shares of the smoothing distributions: all languages together, and the uniform one.
SMOOTH_ALL, SMOOTH_FLAT = 0.03, 0.02
#: Log-likelihood that a further language must add, in units of half the logarithm of the trigrams; neighbouring trigrams
#: overlap and are far from independent.
PENALTY = 12.0
ROUNDS, LEAST_GAIN = 30, 1e-3
UND = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> np.ndarray | None:
    """Hashed trigrams of the lower-cased letters, words parted by one space; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    before = np.concatenate([[True], letter[:-1]])
    spaced = np.where(letter, points, np.uint32(32))[letter | before]
    if not letter[0]:
        spaced = spaced[1:]
    x = np.concatenate([[32], spaced, [32]]).astype(np.uint64)
    code = (x[:-2] << np.uint64(42)) ^ (x[1:-1] << np.uint64(21)) ^ x[2:]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)  # the golden ratio's multiplier; 16 bits


def sample(labelled: DataFrame, each: int = SAMPLE) -> DataFrame:
    """About ``each`` rows of every language, by a hash of id and text; no window or group is gathered."""
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    sizes = F.broadcast(sizes) if small_enough(sizes, MOST_BROADCAST) else sizes
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(sizes, "lang").where(share * F.col("_n") < each).select("lang", "text")


class Model:
    """Trigram probabilities of any number of languages, by bucket: what all languages have of it, and what those add that were
    seen with it. So it grows with the distinct trigrams of the languages (12 bytes each) and not with their number alone, and
    a text is weighed against the languages that share trigrams with it; all others are alike to it.
    """

    def __init__(self, languages: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.languages = languages
        total = np.bincount(lang, n, len(languages))
        pooled = np.bincount(bucket, n, BUCKETS) / max(n.sum(), 1)
        self.common = SMOOTH_ALL * pooled + SMOOTH_FLAT / BUCKETS
        order = np.lexsort((lang, bucket))
        self.lang, self.own = lang[order].astype(np.int32), (1 - SMOOTH_ALL - SMOOTH_FLAT) * n[order] / total[lang[order]]
        self.starts = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))

    def proportions(self, found: np.ndarray) -> np.ndarray:
        """Shares of the languages in trigrams ``found``; nought outside the chosen set."""
        kinds, times = np.unique(found, return_counts=True)
        times, common = times.astype(np.float64), self.common[kinds]
        n, many = times.sum(), len(self.languages)
        # what the languages add to the text's trigrams: its kind, the language, and how much
        each = self.starts[kinds + 1] - self.starts[kinds]
        kind = np.repeat(np.arange(len(kinds)), each)
        at = np.arange(len(kind)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.starts[kinds], each)
        lang, own = self.lang[at], self.own[at]
        columns: dict[int, np.ndarray] = {}

        def of(chosen: list[int]) -> np.ndarray:
            """The probabilities of the text's trigrams in some languages."""
            for i in chosen:
                if i not in columns:
                    columns[i] = common.copy()
                    hit = lang == i
                    columns[i][kind[hit]] += own[hit]
            return np.stack([columns[i] for i in chosen], 1)

        likelihood = times @ np.log(common) + np.bincount(lang, times[kind] * np.log1p(own / common[kind]), many)
        chosen = [int(np.argmax(likelihood))]
        weights, best = np.ones(1), likelihood[chosen[0]]
        penalty = PENALTY * 0.5 * np.log(n + 1)
        while len(chosen) < many:
            # The likelihood is concave: only a language with a positive slope can raise it, and it by no more than the slope.
            rate = times / (of(chosen) @ weights)
            slope = rate @ common + np.bincount(lang, rate[kind] * own, many) - n
            slope[chosen] = -np.inf
            next_one = int(np.argmax(slope))
            if slope[next_one] <= penalty:
                break
            tried = [*chosen, next_one]
            found_weights, value = self._em(of(tried), times, n, np.append(weights * 0.9, 0.1))
            if value - best <= penalty:
                break
            chosen, best, weights = tried, value, found_weights
        share = np.zeros(many)
        share[chosen] = weights
        return share

    @staticmethod
    def _em(p: np.ndarray, times: np.ndarray, n: float, weights: np.ndarray) -> tuple[np.ndarray, float]:
        value = -np.inf
        for _ in range(ROUNDS):
            mixed = p @ weights
            now = float(times @ np.log(mixed))
            if now - value < LEAST_GAIN:
                break
            value = now
            weights = weights * ((times / mixed) @ p) / n
        return weights, value


def train(labelled: DataFrame, each: int = SAMPLE) -> Model:
    """Learn from ``doc_id, text, lang`` rows whose language is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                if text and (found := trigrams(text)) is not None:
                    totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    totals[lang] += np.bincount(found, minlength=BUCKETS)
        for lang, total in totals.items():
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit), pa.array(total[hit])], names=["lang", "bucket", "n"])

    counted = arrow_pass(sample(labelled, each), run, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    lang = counted["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    return Model(languages, lang, counted["bucket"].to_numpy(np.int64), counted["n"].to_numpy(float))


def predict(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns``, ``lang_pred``, ``score`` and ``mixture`` (every chosen language and its share, largest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            names, scores, mixtures = [], [], []
            for text in part.column("_text").to_pylist():
                found = trigrams(text) if text and model.languages else None
                if found is None:
                    names.append(UND)
                    scores.append(0.0)
                    mixtures.append("")
                    continue
                share = model.proportions(found)
                order = np.argsort(-share, kind="stable")
                names.append(model.languages[order[0]])
                scores.append(min(float(share[order[0]]), 1.0))
                mixtures.append(",".join(f"{model.languages[i]}:{share[i]:.4f}" for i in order if share[i] > 0))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(mixtures, pa.string())], names=[*part.schema.names[:-1], "lang_pred", "score", "mixture"])

    kept = docs.select(*columns, F.col("text").alias("_text"))
    return arrow_pass(kept, run, schema_with(kept, "lang_pred string, score double, mixture string", "_text"))


def held_out_predictions(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Learn from labelled documents outside fold ``held`` and predict all."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(folds) != held)).select("doc_id", "text", "lang")
    found = predict(docs, train(labelled), ["doc_id"])
    return found.select("doc_id", (crc_fold(folds) == held).alias("held_out"), "lang_pred", "score", "mixture")
