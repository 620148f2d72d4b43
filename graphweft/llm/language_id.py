"""Language by a byte convolutional network, trained in numpy on labelled text.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum is kept and a
softmax layer names the language; the windows of a text vote with their log-probabilities. Training sees a bounded
sample of windows; prediction is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.llm.common import crc_mod, table

#: Bytes in a window; numbers in a byte's embedding; filters of each width.
WINDOW, DIM, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
#: At most about so many documents of a language teach, each by so many windows dealt evenly over its whole text.
TEACHERS, TAUGHT = 2500, 4
STEPS, BATCH, RATE = 900, 128, 0.004
#: Windows that go through the network at once.
TOGETHER = 256


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    @staticmethod
    def fresh(labels: list[str], seed: int) -> Network:
        rng, reach, n = np.random.default_rng(seed), max(WIDTHS), FILTERS * len(WIDTHS)
        filters = rng.normal(0, 0.3, (reach * DIM, n)).astype(np.float32)
        return Network(labels, rng.normal(0, 0.5, (256, DIM)).astype(np.float32), filters * mask(), np.zeros(n, np.float32), rng.normal(0, 0.2, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per window the largest response of each filter and its place, and the embedded bytes."""
        reach = max(WIDTHS)
        x = self.embed[np.pad(windows, ((0, 0), (0, reach - 1)))]
        spans = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x.reshape(len(x), -1), reach * DIM, axis=1)[:, ::DIM])
        out = (spans.reshape(-1, reach * DIM) @ self.filters).reshape(len(x), WINDOW, -1)
        return out.max(1), out, spans

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        top, _, _ = self.pooled(windows)
        logits = np.maximum(top + self.bias, 0) @ self.dense + self.shift
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy; only the place of a filter's maximum passes a gradient on."""
        top, out, spans = self.pooled(windows)
        hidden = np.maximum(top + self.bias, 0)
        logits = hidden @ self.dense + self.shift
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), target] -= 1
        p /= len(p)
        back = (p @ self.dense.T) * (hidden > 0)
        place = out.argmax(1)
        rows = np.arange(len(p))[:, None]
        d_filters = np.einsum("bf,bfk->kf", back, spans[rows, place]) * mask()
        d_embed = np.zeros_like(self.embed)
        padded = np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))
        for k in range(max(WIDTHS)):
            step = back[:, :, None] * self.filters[k * DIM : (k + 1) * DIM].T[None]
            np.add.at(d_embed, padded[rows, place + k].ravel(), step.reshape(-1, DIM))
        return [d_embed, d_filters, back.sum(0), hidden.T @ p, p.sum(0)]


def mask() -> np.ndarray:
    """1 where a filter of its width has a weight; all filters lie in one matrix."""
    return np.hstack([np.repeat((np.arange(max(WIDTHS) * DIM) < w * DIM)[:, None], FILTERS, 1) for w in WIDTHS]).astype(np.float32)


def windows_of(body: np.ndarray) -> np.ndarray:
    """All windows of a text's bytes, the last one filled with zeros."""
    n = -(-len(body) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(body)] = body
    return out.reshape(n, WINDOW)


def train(labels: list[str], windows: np.ndarray, target: np.ndarray, seed: int = 3) -> Network:
    """Adam over random batches in which every language is as frequent as any other."""
    net, rng = Network.fresh(labels, seed), np.random.default_rng(seed)
    by_label = [np.flatnonzero(target == k) for k in range(len(labels))]
    parts = ["embed", "filters", "bias", "dense", "shift"]
    first = [np.zeros_like(getattr(net, p)) for p in parts]
    second = [np.zeros_like(getattr(net, p)) for p in parts]
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(rows, -(-BATCH // len(labels))) for rows in by_label])
        for p, g, m, v in zip(parts, net.gradients(windows[pick], target[pick]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            getattr(net, p)[...] -= RATE * min(1, 2 * (1 - step / STEPS)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def taught_windows(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and their languages' indices of a bounded sample of docs (doc_id, text, lang).

    Rows are drawn by a hash of id and text, so reruns draw the same ones; repeated rows bring the same windows, which
    count once.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    labels = sorted(counts)
    if not labels:
        return [], np.empty((0, WINDOW), np.uint8), np.empty(0, int)
    share = F.create_map(*(F.lit(x) for k in labels for x in (k, TEACHERS / counts[k])))[F.col("lang")]
    chosen = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(99)), F.lit(1 << 20)) < share * (1 << 20))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, found = [], []
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                all_ = windows_of(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
                for k in np.unique(np.linspace(0, len(all_) - 1, TAUGHT).astype(int)) if len(all_) else []:
                    langs.append(lang)
                    found.append(all_[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], ["lang", "window"])

    rows = chosen.select("text", "lang").mapInArrow(cut, "lang string, window binary").distinct().orderBy("lang", "window").collect()
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    labels = sorted({r["lang"] for r in rows})  # a language of which no text has a byte teaches nothing
    return labels, windows, np.array([labels.index(r["lang"]) for r in rows], int)


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def votes(texts: list[str | None]) -> list[np.ndarray | None]:
        """Mean log-probabilities over a text's windows, weighted by their bytes."""
        bodies = [None if t is None else np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
        windows = np.concatenate([windows_of(b) for b in bodies if b is not None] or [np.empty((0, WINDOW), np.uint8)])
        logs = np.concatenate([net.log_probabilities(windows[a : a + TOGETHER]) for a in range(0, len(windows), TOGETHER)] or [np.empty((0, len(net.labels)), np.float32)])
        out, at = [], 0
        for b in bodies:
            if b is None:
                out.append(None)
                continue
            n = -(-len(b) // WINDOW)
            weight = np.full(n, WINDOW)
            weight[-1] = len(b) - (n - 1) * WINDOW
            out.append((logs[at : at + n] * weight[:, None]).sum(0) / len(b))
            at += n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                names, scores = [], []
                for v in votes(part.column(1).to_pylist()):
                    if v is None:
                        names.append("und")
                        scores.append(0.0)
                    else:
                        p = np.exp(v - v.max())
                        names.append(net.labels[int(v.argmax())])
                        scores.append(float(p.max() / p.sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def language_id(docs: DataFrame, held_out: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Rows whose crc32(doc_id) mod `held_out` is 1 are held out; of the others, text and non-null lang teach. A text that
    is null or has no letter is `und` with score 0, and so is every text if nothing teaches; a language whose texts are
    all empty is never predicted. Repeated rows are judged
    alike; source and other columns are not read.
    """
    docs = docs.select("doc_id", "text", "lang")
    labels, windows, target = taught_windows(docs.where(crc_mod(F.col("doc_id"), held_out) != 1))
    out = predicted(docs, train(labels, windows, target) if len(windows) else None)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), held_out) == 1).alias("held_out"), "lang_pred", "score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
