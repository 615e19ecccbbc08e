"""Document quality by a byte-level convolutional network written in numpy.

A document's bytes are cut into overlapping chunks that cover the whole of it. Each byte has a learned vector; learned
filters run over every second position of a chunk; each filter's activations are max-pooled and averaged in the chunk, a
hidden layer combines them (and the count of the chunk's places), and its outputs are max-pooled and averaged over the document's chunks. A logistic unit turns
them into one probability.

Training reads a bounded sample of labelled rows (`sample` documents of the label's classes, the least by a hash of the id)
on the driver; scoring runs in Arrow batches on the executors with the weights, whose size is fixed, in the closure.

Cases. Null text counts as empty; an empty text is padded with byte 0 and gets the score of that. Rows whose label is
null or not 0 or 1 train nothing. If the sample lacks one class, every score is the share of label 1 (0.5 without any
labels). Texts of any length are scored whole. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import chunks

CHUNK, OVERLAP, WIDTH, STEP = 160, 8, 8, 2
DIM, FILTERS, HIDDEN = 6, 16, 24
PRIOR = 0.9  # share of label 1 that training weighs for
BLOCK = 1536  # chunks per matrix product


def cut(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping chunks of each document: rows of CHUNK bytes (0 behind the end), each row's document, and the number
    of positions of a row (1 at least): the last one reaches the text's last byte."""
    length = np.diff(off)
    hop = CHUNK - OVERLAP
    per = np.maximum(1, -(-(length - OVERLAP) // hop))
    doc = np.repeat(np.arange(len(length)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = off[doc] + nth * hop
    size = np.minimum(CHUNK, off[doc + 1] - start)
    at = start[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < size[:, None]
    rows = np.zeros(at.shape, np.uint8)
    rows[inside] = data[at[inside]]
    places = np.maximum(1, -(-(size - WIDTH) // STEP) + 1)
    return rows, doc, np.minimum(places, (CHUNK - WIDTH) // STEP + 1)


class ByteCnn:
    """Weights, scoring and training of the network."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = {
            "embed": r.normal(0, 0.5, (256, DIM)).astype("f4"),
            "conv": r.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype("f4"),
            "bias": np.zeros(FILTERS, "f4"),
            "hidden": r.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS + 1, HIDDEN)).astype("f4"),
            "shift": np.zeros(HIDDEN, "f4"),
            "out": r.normal(0, 0.1, 2 * HIDDEN).astype("f4"),
            "base": np.zeros(1, "f4"),
        }
        self.constant: float | None = None

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """im2col: (rows, places, WIDTH * DIM)."""
        e = self.w["embed"][rows]
        v = np.lib.stride_tricks.sliding_window_view(e.reshape(len(rows), -1), WIDTH * DIM, axis=1)
        return v[:, :: STEP * DIM]

    def pooled(self, rows: np.ndarray, places: np.ndarray, keep: bool = False):
        """Maximum and mean of each filter over a chunk's places."""
        x = np.ascontiguousarray(self.windows(rows))
        a = np.maximum(x.reshape(-1, WIDTH * DIM) @ self.w["conv"] + self.w["bias"], 0).reshape(len(rows), -1, FILTERS)
        valid = np.arange(a.shape[1]) < places[:, None]
        a *= valid[:, :, None]
        top, mean = a.max(1), a.sum(1) / places[:, None]
        return (top, mean, x, a) if keep else (top, mean)

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows, doc, places = cut(data, off)
        parts = [self.pooled(rows[i : i + BLOCK], places[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]
        return self.combine(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), places, doc)

    def combine(self, top: np.ndarray, mean: np.ndarray, places: np.ndarray, doc: np.ndarray, keep: bool = False):
        """Hidden units of each chunk, their maximum and mean over each document."""
        v = np.hstack([top, mean, np.log2(places)[:, None] / 3]).astype("f4")
        h = np.maximum(v @ self.w["hidden"] + self.w["shift"], 0)
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        n = np.diff(np.r_[head, len(doc)]).astype("f4")[:, None]
        f = np.hstack([np.maximum.reduceat(h, head), np.add.reduceat(h, head) / n])
        return (f, v, h, n) if keep else f

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if len(off) == 1:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        z = self.features(data, off).astype("f8") @ self.w["out"].astype("f8") + float(self.w["base"][0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, data: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        rows, doc, places = cut(data, off)
        top, mean, x, a = self.pooled(rows, places, keep=True)
        f, v, h, n = self.combine(top, mean, places, doc, keep=True)
        p = 1 / (1 + np.exp(-np.clip(f @ self.w["out"] + self.w["base"][0], -30, 30)))
        dz = ((p - y) * weight / len(y)).astype("f4")
        g = {"out": f.T @ dz, "base": np.array([dz.sum()], "f4")}
        df = dz[:, None] * self.w["out"][None, :]
        dh = df[doc][:, HIDDEN:] / n[doc] + df[doc][:, :HIDDEN] * (h == f[doc][:, :HIDDEN])
        dh *= h > 0
        g["hidden"], g["shift"] = v.T @ dh, dh.sum(0)
        dv = dh @ self.w["hidden"].T
        dtop, dmean = dv[:, :FILTERS], dv[:, FILTERS : 2 * FILTERS]
        da = np.broadcast_to((dmean / places[:, None])[:, None, :], a.shape).copy()
        i, k = np.arange(len(rows))[:, None], np.arange(FILTERS)[None, :]
        da[i, a.argmax(1), k] += dtop
        da *= a > 0
        flat = da.reshape(-1, FILTERS)
        g["conv"], g["bias"] = x.reshape(-1, WIDTH * DIM).T @ flat, flat.sum(0)
        dx = (flat @ self.w["conv"].T).reshape(len(rows), -1, WIDTH, DIM)
        de = np.zeros((len(rows), CHUNK, DIM), "f4")
        for t in range(WIDTH):
            de[:, t : t + STEP * dx.shape[1] : STEP] += dx[:, :, t]
        g["embed"] = np.stack([np.bincount(rows.ravel(), de[:, :, d].ravel(), 256) for d in range(DIM)], 1).astype("f4")
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = 750, batch_bytes: int = 60_000, rate: float = 0.01, seed: int = 3) -> ByteCnn:
        """Adam on logistic loss with the classes weighted to PRIOR; batches hold whole documents of about `batch_bytes`; about `steps` steps, at
        least 5 and at most 40 passes."""
        y = np.asarray(labels, "f4")
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        weight = np.where(y > 0, PRIOR / y.mean(), (1 - PRIOR) / (1 - y.mean())).astype("f4")
        r, t = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        size = np.array([len(x) for x in texts])
        epochs = int(min(40, max(5, -(-steps * batch_bytes // max(1, sum(map(len, texts)))))))
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            group = np.cumsum(size[order]) // batch_bytes
            for ix in np.split(order, np.flatnonzero(np.diff(group)) + 1):
                data = np.frombuffer(b"".join(texts[i] for i in ix), np.uint8)
                g = self.gradients(data, np.r_[0, np.cumsum(size[ix])].astype(np.int64), y[ix], weight[ix])
                t += 1
                for k, w in self.w.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v2[k] += 0.001 * (g[k] ** 2 - v2[k])
                    w -= (rate * 0.1 ** (epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-7)).astype("f4")
        return self


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str, allowed: Column | None, max_bytes: int) -> tuple[list[bytes], np.ndarray]:
    """At most `sample` labelled documents, half of each class where there are as many, the least by a hash of their id.

    Whole texts are taken in that order until the next one would not fit into `max_bytes`, so what the driver holds is bounded
    and the sample does not lean to short texts; only texts of more than a tenth of `max_bytes` are passed over. The ids are found
    first and only their texts are fetched. Rows that share a labelled id are samples of their own.
    """
    lab = labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
    if allowed is not None:
        lab = lab.filter(allowed)
    lab = lab.groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_y").alias("_least")).filter("_y = _least")
    picked = [lab.filter(F.col("_y") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2) for c in (0, 1)]
    ids = [r[0] for p in picked for r in p.select("_id").collect()]
    if not ids:
        return [], np.zeros(0)
    y = {r[0]: r[1] for p in picked for r in p.select("_id", "_y").collect()}
    rows = docs.filter(F.col(f"`{id_col}`").isin(ids)).select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    texts, marks, held = [], [], 0
    for i, t in rows.filter(F.octet_length("_text") <= max_bytes // 10).orderBy(F.xxhash64("_id"), "_id", "_text").toLocalIterator():
        raw = t.encode()
        if held + len(raw) > max_bytes:
            break
        texts.append(raw)
        marks.append(y[i])
        held += len(raw)
    return texts, np.array(marks)


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 2400, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", allowed: Column | None = None, max_bytes: int = 9_000_000) -> ByteCnn:
    """Fit the network on a bounded sample; `allowed` is a condition over the column `_id`."""
    return ByteCnn().fit(*training_rows(docs, labels, sample, id_col, text_col, label_col, allowed, max_bytes))


def score_quality(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, `keep` columns, score) of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in chunks(batches, text_col, 1 << 19):
            yield pa.RecordBatch.from_arrays([c.column(x) for x in (id_col, *keep)] + [pa.array(model.score(c.data, c.off), pa.float64())], names=[id_col, *keep, "score"])

    cols = list(dict.fromkeys((id_col, text_col, *keep)))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return docs.select(*(F.col(f"`{c}`") for c in cols)).mapInArrow(scored, f"{fields}, score double")
