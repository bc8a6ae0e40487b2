"""Quality classifier: a factorisation machine over hashed words and structure statistics (operator 7).

A text's features are its distinct words, hashed into buckets, and statistics of its structure and length,
each cut into bins at quantiles of the training sample. The score is the logistic function of
w0 + sum(w x) + 1/2 sum_f((sum v_f x)^2 - sum(v_f^2 x^2)): all pairwise interactions in linear time.
Labels, language, source and ids are never features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm import tokens
from tidegrid.llm.shared import register_caches

BUCKETS, BINS, FACTORS = 1 << 15, 16, 8
SYMBOLS = frozenset("#$%&*@^~=+<>{}\\")
CACHE_WORDS = 60_000
_buckets: dict[str, int] = {}
CACHES = register_caches("quality", _buckets)


def word_buckets(words: list[str]) -> list[int]:
    out = list(map(_buckets.get, words))
    if None in out:
        if len(_buckets) > CACHE_WORDS:
            _buckets.clear()
        for i, b in enumerate(out):
            if b is None:
                w = words[i]
                out[i] = _buckets[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
    return out


def statistics(text: str, words: list[str], counts: Counter) -> tuple[float, ...]:
    """Structure and length of a text; all zero if it has no words."""
    n, chars = len(words), len(text)
    if not n:
        return (0.0,) * 16
    lines = text.split("\n")
    letters = sum(map(len, words))
    ascii_part = text.encode("ascii", "ignore")
    upper = len(ascii_part) - len(ascii_part.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(ascii_part) - len(ascii_part.translate(None, b"0123456789"))
    marks = len(ascii_part) - len(ascii_part.translate(None, b"!?"))
    symbols = len(ascii_part) - len(ascii_part.translate(None, b"#$%&*@^~=+<>{}\\"))
    pipes = text.count("|")
    stops = text.count(".") + text.count(",")
    top = max(counts.values())
    return (
        np.log1p(chars),
        np.log1p(n),
        letters / n,
        len(counts) / n,
        len(counts) / n**0.8,
        top / n,
        upper / letters,
        digits / letters,
        marks / n,
        symbols / n,
        pipes / n,
        stops / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        max(map(len, words)),
    )


def features(text: str) -> tuple[list[int], tuple[float, ...]]:
    """Sorted distinct word buckets, and statistics, of one whole text."""
    words = text.split()
    counts = Counter(words)
    return sorted(set(word_buckets(list(counts)))), statistics(text, words, counts)


@dataclass(frozen=True)
class Model:
    """edges: bin borders by statistic; w0, w, v: weights by bucket, then by statistic and bin."""

    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, found: list[tuple[list[int], tuple[float, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature ids, their values and the first position of each text."""
        ids, values, first, at = [], [], [], 0
        stats = np.array([s for _, s in found]).reshape(len(found), len(self.edges))
        bins = np.stack([np.searchsorted(e, stats[:, k], side="right") + BUCKETS + k * BINS for k, e in enumerate(self.edges)], 1)
        for (words, _), own in zip(found, bins, strict=True):
            first.append(at)
            ids.append(np.concatenate([np.array(words, "i8"), own]))
            values.append(np.concatenate([np.full(len(words), len(words) ** -0.5 if words else 0.0), np.full(len(own), 0.5)]))
            at += len(ids[-1])
        return np.concatenate(ids), np.concatenate(values).astype("f4"), np.array(first)

    def scores(self, found: list) -> np.ndarray:
        if not found:
            return np.zeros(0)
        ids, values, first = self.rows(found)
        x = self.v[ids] * values[:, None]
        pairs = 0.5 * (np.add.reduceat(x, first) ** 2 - np.add.reduceat(x * x, first)).sum(1)
        z = self.w0 + np.add.reduceat(self.w[ids] * values, first) + pairs
        return 1 / (1 + np.exp(-np.clip(z.astype("f8"), -30, 30)))


def train(found: list, labels: list[int], epochs: int = 8, updates: int = 250, batch: int = 128, rate: float = 0.1, decay: float = 1e-5, seed: int = 5) -> Model:
    """Fit by AdaGrad on the logistic loss: so many epochs, more if these make too few updates.

    Without rows of both labels every text scores the same.
    """
    epochs = max(epochs, -(-updates * batch // max(1, len(found))))
    rng = np.random.default_rng(seed)
    stats = np.array([s for _, s in found]).reshape(len(found), 16)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if found else np.zeros((16, BINS - 1))
    size = BUCKETS + 16 * BINS
    y = np.array(labels, "f4")
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(size, "f4"), rng.normal(0, 0.05, (size, FACTORS)).astype("f4"))
    if not 0 < y.sum() < len(y):
        return Model(edges, model.w0, model.w, np.zeros_like(model.v))
    w0, w, v = model.w0, model.w, model.v
    sum_w, sum_v = np.full(size, 1e-2, "f4"), np.full((size, FACTORS), 1e-2, "f4")
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype("f4") ** 0.5  # half way to balanced classes
    per = [tuple(model.rows([f])[:2]) for f in found]
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            ids, values = np.concatenate([per[i][0] for i in own]), np.concatenate([per[i][1] for i in own])
            n = np.array([len(per[i][0]) for i in own])
            first, row = np.cumsum(n) - n, np.repeat(np.arange(len(own)), n)
            vi = v[ids]
            x = vi * values[:, None]
            total = np.add.reduceat(x, first)
            z = w0 + np.add.reduceat(w[ids] * values, first) + 0.5 * (total**2 - np.add.reduceat(x * x, first)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own] / len(own)
            gw, gv = g[row] * values, (g[row] * values)[:, None] * (total[row] - x)
            u, inverse = np.unique(ids, return_inverse=True)
            dw, dv = np.zeros(len(u), "f4"), np.zeros((len(u), FACTORS), "f4")
            np.add.at(dw, inverse, gw)
            np.add.at(dv, inverse, gv)
            dw, dv = dw + decay * w[u], dv + decay * v[u]
            sum_w[u] += dw**2
            sum_v[u] += dv**2
            w[u] -= rate * dw / np.sqrt(sum_w[u])
            v[u] -= rate * 0.5 * dv / np.sqrt(sum_v[u])
            w0 -= rate * float(g.sum())
    return Model(edges, w0, w, v)


def held_out(id_col: str) -> Column:
    """True for the third of all ids on which nothing is learned; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 8000, **how) -> Model:
    """A model from at most ``sample`` labelled ids that are not held out, chosen by a hash of their id.

    Of documents and labels that repeat an id the least text and the least label count, so at most ``sample``
    rows are learned from. Only features of these reach the driver: some 2 kB for a text of ordinary length.
    """
    wanted = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("_y"))
    wanted = wanted.withColumn("_h", F.xxhash64(id_col)).orderBy("_h", id_col).limit(sample)
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_t")).join(F.broadcast(wanted), id_col).groupBy(id_col, "_h", "_y").agg(F.min("_t").alias("_t")).select("_h", "_y", "_t")

    def extract(batches):
        for batch in batches:
            found = [features(t) for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_h"), batch.column("_y"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([list(map(float, f[1])) for f in found], pa.list_(pa.float64()))], names=["_h", "_y", "words", "stats"])

    got = rows.mapInArrow(extract, "_h bigint, _y int, words array<int>, stats array<double>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["_h"], r["_y"], r["stats"], r["words"]))
    return train([(r["words"], tuple(r["stats"])) for r in got], [r["_y"] for r in got], **how)


def score(df: DataFrame, model: Model, text_col: str = "text", drop_text: bool = False, name: str = "quality_score") -> DataFrame:
    """``df`` with the column ``name`` (0 to 1, higher: more like label 1), from whole texts.

    A null text is empty, and empty texts have a score too. Rows and other columns stay as they are. ``name``
    must not be a column of ``df``. No shuffle.
    """
    if name in df.columns:
        raise ValueError(f"the table has a column {name} already; choose another name for the score")
    keep = [c for c in df.columns if not (drop_text and c == text_col)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    at = df.columns.index(text_col)
    held = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size, 1.2 MB

    def run(batches):
        own = held.value
        for batch in batches:
            for first, texts in tokens.text_slices(batch, at):
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(own.scores([features(t) for t in texts]), pa.float64())], names=schema.names)

    return df.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``, by a model fitted on ``labels``."""
    model = fit(docs, labels, id_col, text_col, **how)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, drop_text=True)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
