"""Quality classifier: a byte-level convolutional network in numpy.

A filter looks at `width` bytes; all filters slide over the whole text by `stride` bytes. Each
half chunk takes the maximum of each filter, each pair of neighbouring halves is one of the
overlapping chunks, and a small dense layer turns a chunk's maxima into hidden values (so it
also sees which filters stay low, as in text that repeats itself, and how full the chunk is). The maxima of the hidden
values over all chunks give one probability. The filters have no embedding in between: they are
tables of weights by (place in the window, byte), so that sliding them is adding table rows.

The network is fitted on the driver with Adam on a bounded sample of labelled texts; scoring
maps over the texts where they lie.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .textcore import batches, flat

PAD = 256


@dataclass(frozen=True)
class Shape:
    width: int = 8
    stride: int = 2
    filters: int = 24
    half: int = 56  # windows in half a chunk
    hidden: int = 16


class ByteNet:
    def __init__(self, shape: Shape = Shape(), seed: int = 1):
        rng, s = np.random.default_rng(seed), shape
        self.shape = s
        self.p = {
            "table": rng.normal(0, 0.15, (s.width, 257, s.filters)).astype(np.float32),
            "mid": rng.normal(0, 1 / np.sqrt(s.filters), (s.filters + 1, s.hidden)).astype(np.float32),
            "mid_b": np.zeros(s.hidden, np.float32),
            "out": rng.normal(0, 0.3, s.hidden).astype(np.float32),
            "out_b": np.zeros(1, np.float32),
        }
        self.p["table"][:, PAD] = 0

    def layout(self, buf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each padded to whole half chunks, and the first half chunk of each (n + 1).

        The last windows of a text's last half chunk, which would see the next text, hold nothing but padding.
        """
        s = self.shape
        span = s.half * s.stride
        halves = -(-(np.diff(rows) + s.width - s.stride) // span)
        first = np.concatenate([[0], np.cumsum(halves)])
        out = np.full(first[-1] * span + s.width, PAD, np.int16)
        for at, i, j in zip((first[:-1] * span).tolist(), rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            out[at : at + j - i] = buf[i:j]
        return out, first

    def maxima(self, symbols: np.ndarray, first: np.ndarray, where: bool = False):
        """Maximum of each filter in each half chunk, and (if where) the window that has it. Windows see across half chunks."""
        s = self.shape
        halves, over = int(first[-1]), -(-(s.width - s.stride) // s.stride)
        last = np.zeros(halves, bool)
        last[first[1:] - 1] = True
        best = np.empty((halves, s.filters), np.float32)
        arg = np.empty((halves, s.filters), np.int64) if where else None
        step = 32
        for i in range(0, halves, step):
            n = min(step, halves - i) * s.half
            at = i * s.half * s.stride
            act = np.zeros((n, s.filters), np.float32)
            for k in range(s.width):
                act += self.p["table"][k].take(symbols[at + k : at + k + n * s.stride : s.stride], axis=0)
            act = act.reshape(-1, s.half, s.filters)
            if over:
                act[last[i : i + step], -over:] = -np.inf
            if where:
                a = act.argmax(1)
                best[i : i + step] = np.take_along_axis(act, a[:, None], 1)[:, 0]
                arg[i : i + step] = a + (np.arange(i, i + len(a)) * s.half)[:, None]
            else:
                best[i : i + step] = act.max(1)
        return best, arg

    def _chunks(self, best: np.ndarray, first: np.ndarray):
        """Index pairs of the halves of every chunk, and the first chunk of each text (n + 1). A text of one half is one chunk."""
        n = np.diff(first)
        chunks = np.maximum(1, n - 1)
        at = np.concatenate([[0], np.cumsum(chunks)])
        a = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], chunks)
        b = a + np.repeat((n > 1).astype(np.int64), chunks)
        return a, b, at

    def _inputs(self, best: np.ndarray, a: np.ndarray, b: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the dense layer sees of each chunk: the positive maxima of its filters and the share of it that is text."""
        span = self.shape.half * self.shape.stride
        n = np.diff(first)
        place = np.arange(first[-1]) - np.repeat(first[:-1], n)
        fill = np.clip(np.repeat(np.diff(rows), n) - place * span, 0, span) / span
        share = (fill[a] + np.where(a == b, 0, fill[b])) / 2
        return np.concatenate([np.maximum(np.maximum(best[a], best[b]), 0), share[:, None].astype(np.float32)], 1)

    def forward(self, buf: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text. Memory is bounded by the batch: a few bytes for each of its bytes."""
        symbols, first = self.layout(buf, rows)
        best, _ = self.maxima(symbols, first)
        a, b, at = self._chunks(best, first)
        z = np.maximum(self._inputs(best, a, b, rows, first) @ self.p["mid"] + self.p["mid_b"], 0)
        top = np.maximum.reduceat(z, at[:-1], axis=0)
        return 1 / (1 + np.exp(-(top @ self.p["out"] + self.p["out_b"]).astype(np.float64)))

    def _gradient(self, buf, rows, y, weight):
        s, p = self.shape, self.p
        symbols, first = self.layout(buf, rows)
        best, arg = self.maxima(symbols, first, where=True)
        a, b, at = self._chunks(best, first)
        second = best[b] > best[a]
        m = self._inputs(best, a, b, rows, first)
        z = m @ p["mid"] + p["mid_b"]
        zr = np.maximum(z, 0)
        doc = np.repeat(np.arange(len(y)), np.diff(at))
        top = np.maximum.reduceat(zr, at[:-1], axis=0)
        prob = 1 / (1 + np.exp(-(top @ p["out"] + p["out_b"])))
        d = ((prob - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": top.T @ d, "out_b": d.sum(keepdims=True)}
        dz = np.where((zr == top[doc]) & (z > 0), d[doc][:, None] * p["out"], 0).astype(np.float32)
        g["mid"], g["mid_b"] = m.T @ dz, dz.sum(0)
        dm = np.where(m[:, :-1] > 0, dz @ p["mid"][:-1].T, 0)
        src = np.where(second, arg[b], arg[a])
        c, f = np.nonzero(dm)
        at_byte, value = src[c, f] * s.stride, dm[c, f]
        table = np.zeros_like(p["table"])
        for k in range(s.width):
            np.add.at(table[k], (symbols[at_byte + k], f), value)
        table[:, PAD] = 0
        g["table"] = table
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 2) -> ByteNet:
        """Adam on mini-batches; both labels weigh the same in sum."""
        rng = np.random.default_rng(seed)
        y = np.asarray(y, np.float32)
        share = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())], np.float32)
        weight = (len(y) / 2 / share)[y.astype(int)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t, steps = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                parts = [texts[j] for j in pick]
                rows = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
                g = self._gradient(np.frombuffer(b"".join(parts), np.uint8), rows, y[pick], weight[pick])
                t += 1
                lr = rate * (1 - t / (steps + 1))
                for k, x in g.items():
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.01 * (x * x - v[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
        return self


def bucket(id_col: str | Column, of: int) -> Column:
    """crc32 of an id as text, modulo `of`; decides which labels may be learned from."""
    return F.crc32((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string").cast("binary")) % of


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int], most_bytes: int, folds: int, held_out: int) -> tuple[list[bytes], np.ndarray]:
    """A bounded sample of labelled texts: at most rows[y] of each label y, none of the held-out fold, each of most_bytes at most.

    Which ones: those of the smallest hashes of their ids, with one text for each id, that of the smallest hash. Null labels,
    ids and texts are left out, and so are ids whose labels contradict each other. Nothing else reaches the driver.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & (bucket("_id", folds) != held_out))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").drop("_z")
    picks = None
    for y, n in rows.items():
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n)
        picks = part if picks is None else picks.unionByName(part)
    own = docs.select("doc_id", "text").where(F.octet_length("text") <= most_bytes).join(F.broadcast(picks), F.col("doc_id") == F.col("_id"))
    first = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t")))
    got = own.groupBy("_id", "_y").agg(first.alias("_t")).select("_id", F.col("_t.t").cast("binary").alias("text"), "_y").toArrow().sort_by("_id")
    return [x.as_py() for x in got["text"].combine_chunks()], got["_y"].to_numpy().astype(int)


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 1200, most_bytes: int = 1 << 15, folds: int = 4, held_out: int = 2, epochs: int = 24, most_epochs: int = 60, texts_seen: int = 12_000
) -> ByteNet:
    """Fit on at most `sample` texts of each label of at most most_bytes each (the bounds of what reaches the driver).

    The network sees every text of the sample `epochs` times, and small samples more often: until it has seen texts_seen
    texts, but none more than most_epochs times. Rows of the held-out fold are never learned from. Without both labels, every text scores one half.
    """
    texts, y = labelled(docs, labels, label, {0: sample, 1: sample}, most_bytes, folds, held_out)
    net = ByteNet()
    if len(set(y.tolist())) < 2:
        net.p["out"][:] = 0
        return net
    return net.fit(texts, y, epochs=max(epochs, min(most_epochs, texts_seen // len(texts))))


def score_texts(df: DataFrame, net: ByteNet, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df and the probability of label 1 of each whole text, as double (out_col is replaced if it exists).

    Null and empty texts score alike. The text is all that the network sees.
    """
    df = df.drop(out_col)
    names = df.columns
    held = df.withColumn("__leakloom_text", text_of(F.col(f"`{text_col}`")))

    def run(it):
        for b in batches(it):
            score = net.forward(*flat(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score)], names=[*names, out_col])

    return held.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType())]))
