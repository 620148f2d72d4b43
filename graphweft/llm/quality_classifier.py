"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics are taken where a text lies, in one pass without a shuffle, and are some 60 bytes a document. Ridge is
fitted by normal equations that each partition sums for its labelled rows; the driver solves a system of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import crc_mod, table, written

FEATURES, FOLDS, RIDGE, WIDTH = 160, 5, 1e-3, 1.6
#: Labelled rows whose normal equations one task sums.
ROWS_A_TASK = 50_000
CLASSES = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "bar": "|", "shout": "!", "symbol": "#*$%&<>@^~={}[]\\", "stop": ".,;:?", "space": " \t", "line": "\n"}
STATISTICS = 16


def byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[128:] = len(CLASSES) + 1
    for k, chars in enumerate(CLASSES.values(), 1):
        out[list(chars.encode())] = k
    return out


def statistics(text: str, classes: np.ndarray) -> list[float]:
    """Sixteen bounded numbers for one text; all 0 but for constants if it is empty."""
    body = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    shares = np.bincount(classes[body], minlength=len(CLASSES) + 2) / max(1, len(body))
    ws, lines = text.split(), text.split("\n")
    n = len(ws)
    mean = sum(map(len, ws)) / max(1, n)
    spread = (sum(len(w) ** 2 for w in ws) / max(1, n) - mean * mean) if n else 0.0
    distinct = len(set(ws)) / max(1, n)
    pairs = len(set(zip(ws, ws[1:], strict=False))) / max(1, n - 1)
    dup = 1 - len(set(lines)) / max(1, len(lines))
    return [*np.sqrt(shares[:10]).tolist(), min(mean, 20) / 5, min(max(spread, 0.0), 100.0) ** 0.5 / 5, np.log1p(n) / 10 * (1 - distinct), 1 - pairs if n > 1 else 0.0, dup**0.5, float(n < 20)]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics x; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = [statistics(t or "", classes) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, x array<double>")


@dataclass(frozen=True)
class Features:
    """Random Fourier features for a Gaussian kernel over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    seed: int = 5

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, 1 / (WIDTH * np.sqrt(STATISTICS)), (STATISTICS, FEATURES))
        z = np.cos(np.clip((x - self.centre) / self.scale, -6, 6) @ w + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(x), 1))])


@dataclass(frozen=True)
class Model:
    features: Features
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.steps)


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing function nearest to the values by weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for a, v, w in zip(at, value, weight, strict=True):
        pools.append([v, w, a * w])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, a2 = pools.pop()
            v1, w1, a1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, a1 + a2])
    return np.array([p[2] / p[1] for p in pools]), np.clip(np.array([p[0] for p in pools]), 0, 1)


def equations(rows: DataFrame, features: Features) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold the sums z z' and z y over labelled rows (x, y, fold); each partition sums its own first."""
    size = FEATURES + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FOLDS, size, size + 1))
        for b in batches:
            x, y, fold = np.stack(b["x"]) if len(b) else np.empty((0, STATISTICS)), b["y"].to_numpy(float), b["fold"].to_numpy()
            z = features(x)
            for f in range(FOLDS):
                total[f] += z[fold == f].T @ np.hstack([z[fold == f], y[fold == f, None]])
        f, i, j = np.nonzero(total)
        yield pd.DataFrame({"f": f, "i": i, "j": j, "v": total[f, i, j]})

    out = {f: (np.zeros((size, size)), np.zeros(size)) for f in range(FOLDS)}
    for r in rows.mapInPandas(sums, "f int, i int, j int, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        if r["j"] < size:
            out[r["f"]][0][r["i"], r["j"]] = r["v"]
        else:
            out[r["f"]][1][r["i"]] = r["v"]
    return out


def fit(rows: DataFrame) -> Model | None:
    """rows: x and y in 0..1. None without any row."""
    n = rows.count()
    if not n:
        return None
    spread = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    features = Features(np.array([r["m"] for r in spread]), np.array([max(r["s"], 0.02) for r in spread]))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int")).repartition(-(-n // ROWS_A_TASK))
    sums = equations(rows, features)
    a, b = sum(s[0] for s in sums.values()), sum(s[1] for s in sums.values())
    solve = lambda a, b: np.linalg.solve(a + np.eye(len(a)) * RIDGE * max(1.0, a[-1, -1]), b)
    apart = np.stack([solve(a - sums[f][0], b - sums[f][1]) for f in range(FOLDS)])

    def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Bins of the score that the model without a row's own fold gives it."""
        for p in batches:
            if len(p):
                raw = (features(np.stack(p["x"])) * apart[p["fold"].to_numpy()]).sum(1)
                yield pd.DataFrame({"bin": np.floor(np.clip(raw, -1, 2) * 200).astype(int), "y": p["y"].to_numpy(float)})

    bins = rows.mapInPandas(unseen, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    steps = isotonic(np.array([(r["bin"] + 0.5) / 200 for r in bins]), np.array([r["y"] for r in bins]), np.array([float(r["n"]) for r in bins]))
    return Model(features, solve(a, b), steps)


def scored(stats: DataFrame, model: Model | None) -> DataFrame:
    """stats with score in 0..1; 0.5 where nothing could be learned."""
    if model is None:
        return stats.withColumn("score", F.lit(0.5))

    def score(x: pa.Array) -> pa.Array:
        flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), STATISTICS)
        return pa.array(model.score(flat), pa.float64())

    return stats.withColumn("score", F.arrow_udf(score, "double")("x"))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score.

    Labels of rows whose crc32(doc_id) mod `held_out` is not 0 teach; several labels of one document are averaged, null
    ones are left out. Null and empty texts are scored by their statistics like any other. A null doc_id has no label.
    """
    stats = written(document_statistics(docs), "quality-features")
    known = labels.where(F.col("quality").isNotNull() & (crc_mod(F.col("doc_id"), held_out) != 0)).groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    model = fit(written(stats.join(known, "doc_id").select("x", "y"), "quality-taught"))
    return scored(stats, model).select("doc_id", (crc_mod(F.col("doc_id"), held_out) == 0).alias("held_out"), "score")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
