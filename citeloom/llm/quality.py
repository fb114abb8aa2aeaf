"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

A text becomes some twenty statistics. They are standardised and mapped to cosines of
random projections, which approximate a Gaussian kernel. Every partition sums its part of the
normal equations, by fold; the sums (a fixed number of fixed-size matrices) are added up on the driver and
solved there. Out-of-fold scores of the training rows, counted in a fixed grid, are then made monotone by
pooling adjacent violators; the steps turn any raw score into a probability.

Training takes at most ``max_rows`` labelled rows (a seeded sample by id beyond that); statistics and scores
cover every row. Statistics are written to the shared folder once, as the model is fitted and applied on them.

Defined results: a null text counts as empty, and empty texts have a score; rows without a
label or a key are not learned from; with no rows to learn from, or labels all alike, every score is the share of label 1 (0.5 for none).
Equal texts have equal scores, and repeated rows each have one; very long texts are read whole; an empty table has an empty result. Other
columns of the input play no part in scoring, whatever their names, and pass through keep_good as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import fresh, slices, write_shared

FEATURES, FOLDS, PARTS, GRID = 256, 4, 8, 2048
#: Bytes of text whose statistics are made at a time.
CHUNK = 1 << 20
#: Raw scores outside of these ends count as at the ends.
LOW, HIGH = -0.5, 1.5

NAMES = (
    "log_chars log_words word_length word_length_sd upper digits ascii_punct bang pipe odd_signs non_ascii newline unique top_word stutter trigrams "
    "lines_unique line_words caps_words title_words ends_sign stop_mark comma hyphen quote short_words long_words"
).split()
_PUNCT = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_UPPER = np.array([65 <= c <= 90 for c in range(256)])
_ALPHA = np.array([65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])
_ODD = [ord(c) for c in "%#$&*"]


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of NAMES."""
    words = text.split()
    if not words:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    c = np.bincount(data, minlength=256)
    size, n = len(data), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(size),
        np.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float(c[_UPPER].sum() / max(1, c[_ALPHA].sum())),
        c[48:58].sum() / size,
        c[_PUNCT].sum() / size,
        c[33] / n,
        c[124] / n,
        c[_ODD].sum() / n,
        c[128:].sum() / size,
        c[10] / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),  # noqa: B905
        len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        c[46] / n,
        c[44] / n,
        c[45] / n,
        (c[34] + c[39]) / n,
        float((lengths <= 2).mean()),
        float((lengths >= 15).mean()),
    ]


def _statistics(texts: pa.Array) -> pa.Array:
    whole = pa.record_batch([texts], names=["text"])
    made = [pa.array([statistics(t or "") for t in part.column(0).to_pylist()], pa.list_(pa.float64())) for part in slices(whole, 0, CHUNK)]
    return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float64()))


def text_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and stats array<double> of every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _statistics(b.column(1))], names=["key", "stats"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(compute, f"key {kind}, stats array<double>")
    return rows.withColumnRenamed("key", key)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def expand(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        k = self.projection.shape[1]
        return np.hstack([np.sqrt(2 / k) * np.cos(z @ self.projection + self.phase), z / 8, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(np.clip(self.raw(stats), LOW, HIGH), *self.steps), 0, 1)


def pool_adjacent(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Isotonic regression: the non-decreasing values nearest to the means, by weighted squares."""
    blocks: list[list[float]] = []
    for w, m in zip(weights, means, strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks]) if blocks else np.zeros(0)


def fit(train: DataFrame, key: str, label: str, max_rows: int = 200_000, ridge: float = 1e-3, width: float = 1.0, seed: int = 7) -> Model:
    """train: key, stats, label (0 or 1). width: the kernel's, in units of the root of the number of statistics."""
    d = len(NAMES)
    rows = train.filter(F.col(label).isin(0, 1)).select(F.xxhash64(F.col(key).cast("string")).alias("h"), "stats", F.col(label).cast("double").alias("y"))
    total = rows.count()
    if total > max_rows:
        rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * max_rows / total))
    rows = write_shared(rows.withColumn("fold", F.pmod(F.shiftright("h", 20), F.lit(FOLDS)).cast("int")).repartition(PARTS, "h"), "train")
    sums = rows.agg(F.count("*").alias("n"), F.sum("y").alias("y"), *(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)), *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d))).first()
    rng = np.random.default_rng(seed)
    mean = np.array([sums[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([max(sums[f"s{i}"] or 0.0, 1e-6) for i in range(d)])
    model = Model(mean, scale, rng.normal(size=(d, FEATURES)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + d + 1), (np.array([LOW, HIGH]), np.zeros(2)))
    share = (sums["y"] or 0.0) / sums["n"] if sums["n"] else 0.5
    if share in (0.0, 1.0) or not sums["n"]:
        model.steps = (np.array([LOW, HIGH]), np.full(2, share))
        return model
    size = len(model.weights)

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((FOLDS, size, size + 1))
        for b in batches:
            x = model.expand(np.stack(b["stats"].to_numpy()))
            y = b["y"].to_numpy()
            for f in range(FOLDS):
                own = (b["fold"] == f).to_numpy()
                g[f] += x[own].T @ np.hstack([x[own], y[own, None]])
        yield pd.DataFrame({"fold": range(FOLDS), "sums": [m.tobytes() for m in g]})

    # PARTS x FOLDS matrices of fixed size, whatever the number of rows.
    g = np.zeros((FOLDS, size, size + 1))
    for r in rows.coalesce(PARTS).mapInPandas(normal, "fold int, sums binary").toLocalIterator():
        g[r["fold"]] += np.frombuffer(r["sums"]).reshape(size, size + 1)

    def solve(m: np.ndarray) -> np.ndarray:
        return np.linalg.solve(m[:, :-1] + ridge * max(1.0, m[-1, -2]) * np.eye(size) / 100, m[:, -1])

    by_fold = [solve(g.sum(axis=0) - g[f]) for f in range(FOLDS)]
    model.weights = solve(g.sum(axis=0))

    def held_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = model.expand(np.stack(b["stats"].to_numpy()))
            raw = np.einsum("ij,ij->i", x, np.stack(by_fold)[b["fold"].to_numpy()])
            cell = ((np.clip(raw, LOW, HIGH) - LOW) / (HIGH - LOW) * (GRID - 1)).round().astype(int)
            yield pd.DataFrame({"cell": cell, "y": b["y"]})

    cells = rows.mapInPandas(held_out, "cell int, y double").groupBy("cell").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("cell").collect()
    at = LOW + np.array([r["cell"] for r in cells]) / (GRID - 1) * (HIGH - LOW)
    model.steps = (at, pool_adjacent(np.array([float(r["n"]) for r in cells]), np.array([r["y"] for r in cells])))
    return model


def apply(model: Model, stats: DataFrame, key: str) -> DataFrame:
    """key and score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["key", "score"])

    kind = stats.schema[key].dataType.simpleString()
    return stats.select(F.col(key).alias("key"), "stats").mapInArrow(score, f"key {kind}, score double").withColumnRenamed("key", key)


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key's text is 0 by the number of folds; false for a null key."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % folds == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[Model, DataFrame]:
    """A model learned from the labels that are not held out, and the statistics of all documents."""
    stats = write_shared(text_statistics(docs, key, text), "stats")
    known = labels.filter(~held_out(F.col(key))).select(key, F.col(label).alias("_label"))
    return fit(stats.join(known, key), key, "_label"), stats


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """key, held_out, score of every document, learned from the labels of those that are not held out."""
    model, stats = learn(docs, labels, key, text, label)
    return apply(model, stats, key).select(key, held_out(F.col(key)).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows, as they are, whose text scores at least so much.

    The statistics are written with the rows, so that they are made once and no row has to be found again by its key.
    """
    (stats,) = fresh(docs, "stats")
    staged = write_shared(docs.withColumn(stats, F.arrow_udf(_statistics, "array<double>")(F.coalesce(text, F.lit("")))), "staged")
    known = labels.filter(~held_out(F.col(key))).select(key, F.col(label).alias("_label"))
    model = fit(staged.select(key, F.col(stats).alias("stats")).join(known, key), key, "_label")

    def good(stats: pa.Array) -> pa.Array:
        x = stats.flatten().to_numpy().reshape(len(stats), -1)
        return pa.array(model.score(x) >= least) if len(x) else pa.array([], pa.bool_())

    return staged.filter(F.arrow_udf(good, "boolean")(stats)).drop(stats)
