"""Toxicity: a linear-chain conditional random field over the words of a text.

States are 0 (outside) and 1 (in a toxic span). A word is a run of letters (bytes from 0x80 on
count as letters), A-Z folded; its features are its hash and the hashes of its first 3 to 6
bytes. Labels exist for documents only, so words get theirs first: a feature that occurs in
toxic training documents far more often than in clean ones (a likelihood-ratio test, corrected
for the number of features) makes words with it toxic in toxic documents. On these words the
chain is trained by gradient steps on its conditional likelihood.

Forward-backward marginals then give, for each text, the expected number of toxic words and
the surest one; a logistic curve fitted on the training documents makes them one score.
Marginals above one half, joined where neighbours, are the offending spans.

The recursions run on blocks of all texts side by side: each block's 2 x 2 transfer matrix
first, then the blocks of each text in order, then all words of all blocks. So one text of a
million words costs no more than as many words in small texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .quality import labelled
from .textcore import LETTER_BYTES, LOWER, U64, batches, flat, mix, word_hashes, words

PREFIXES = (3, 4, 5, 6)
BLOCK = 128
SURE = 0.25


def features(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Feature hashes of each word: the whole, then each prefix (0 for words not longer than it)."""
    out = [word_hashes(buf, start, end, LOWER)]
    for i, n in enumerate(PREFIXES):
        long = end - start > n
        h = np.zeros(len(start), U64)
        h[long] = mix(word_hashes(buf, start[long], start[long] + n, LOWER) + U64(i + 1))
        out.append(h)
    return out


class Table:
    """Weights by feature hash. A bitmap of the top bits answers for nearly all words that have none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> U64(44)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h))
        at = np.flatnonzero(self.seen[(h >> U64(44)).astype(np.int64)])
        if len(at):
            i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[i] == h[at], self.values[i], 0)
        return out


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probability of state 1 for each word, and (if pairs) the sums over all words of the probabilities of each move.

    emission: log weight of state 1 over state 0; first: the first word of each text (n + 1); trans: log
    weights of the moves. A text begins as if from state 0.
    """
    n = np.diff(first)
    blocks = -(-n // BLOCK)
    b_first = np.concatenate([[0], np.cumsum(blocks)])
    total = int(b_first[-1])
    if not total:
        return np.zeros(0), np.zeros((2, 2))
    place = np.arange(len(emission)) + np.repeat(b_first[:-1] * BLOCK - first[:-1], n)
    e = np.ones((total * BLOCK, 2))
    live = np.zeros(total * BLOCK, bool)
    live[place] = True
    # scaled so that the larger of the two is 1
    e[place, 0], e[place, 1] = np.exp(np.minimum(0, -emission)), np.exp(np.minimum(0, emission))
    e, live = e.reshape(total, BLOCK, 2), live.reshape(total, BLOCK)
    m = np.exp(trans - trans.max())
    step = np.where(live[:, :, None, None], m * e[:, :, None, :], np.eye(2))  # blocks x words x from x to

    whole = np.broadcast_to(np.eye(2), (total, 2, 2)).copy()
    for k in range(BLOCK):
        whole = np.einsum("bij,bjk->bik", whole, step[:, k])
        whole /= whole.max((1, 2), keepdims=True)
    left, right = np.tile([1.0, 0.0], (total, 1)), np.ones((total, 2))
    for k in range(1, int(blocks.max())):
        at = b_first[:-1][blocks > k] + k
        v = np.einsum("bi,bij->bj", left[at - 1], whole[at - 1])
        left[at] = v / v.sum(1, keepdims=True)
        at = b_first[1:][blocks > k] - 1 - k
        v = np.einsum("bij,bj->bi", whole[at + 1], right[at + 1])
        right[at] = v / v.sum(1, keepdims=True)
    ahead = np.empty((total, BLOCK + 1, 2))
    ahead[:, 0] = left
    for k in range(BLOCK):
        v = np.einsum("bi,bij->bj", ahead[:, k], step[:, k])
        ahead[:, k + 1] = v / v.sum(1, keepdims=True)
    back, moves = right, np.zeros((2, 2))
    p = np.empty((total, BLOCK))
    for k in range(BLOCK - 1, -1, -1):
        both = ahead[:, k + 1] * back
        p[:, k] = both[:, 1] / both.sum(1)
        if pairs:
            joint = ahead[:, k, :, None] * step[:, k] * back[:, None, :]
            moves += (joint / joint.sum((1, 2), keepdims=True))[live[:, k]].sum(0)
        v = np.einsum("bij,bj->bi", step[:, k], back)
        back = v / v.sum(1, keepdims=True)
    return p.reshape(-1)[place], moves


@dataclass
class Chain:
    table: Table
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def words(self, buf: np.ndarray, rows: np.ndarray):
        start, end, first = words(buf, rows, LETTER_BYTES)
        emission = np.full(len(start), self.bias)
        if len(start):
            for h in features(buf, start, end):
                emission += self.table(h)
        return start, end, first, marginals(emission, first, self.trans)[0]

    def summary(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per text: log of 1 + the expected number of toxic words, and the surest one's probability.

        Words below SURE don't count, or long clean texts would add them up.
        """
        upto = np.concatenate([[0], np.cumsum(np.where(p >= SURE, p, 0))])
        most = np.zeros(len(first) - 1)
        some = first[:-1] < first[1:]
        if some.any():
            most[some] = np.maximum.reduceat(p, first[:-1][some])
        return np.stack([np.log1p(np.maximum(upto[first[1:]] - upto[first[:-1]], 0)), most], 1)

    def score(self, summary: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * summary[:, 0] + c * summary[:, 1])))


def fit_chain(texts: list[bytes], y: np.ndarray, steps: int = 30, rate: float = 0.4) -> Chain:
    """Fit the chain and the score curve on whole labelled texts. Copies among them count once."""
    empty = Chain(Table(np.zeros(1, U64), np.zeros(1)))
    rows = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    start, end, first = words(buf, rows, LETTER_BYTES)
    if not len(start) or len(set(y.tolist())) < 2:
        return empty
    kinds = features(buf, start, end)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    sketch = np.full(len(texts), np.iinfo(np.uint64).max, U64)
    np.minimum.at(sketch, doc, mix(kinds[0] + U64(99)) ^ np.roll(kinds[0], -1))  # near copies mostly share their smallest word pair
    once = np.zeros(len(texts), bool)
    once[np.unique(np.stack([sketch, y.astype(U64)]), axis=1, return_index=True)[1]] = True

    names, ids = np.unique(np.concatenate(kinds), return_inverse=True)
    ids = ids.reshape(len(kinds), -1)
    used = once[doc]
    pairs = np.unique(np.concatenate([(ids[k][used & (kinds[k] != 0)]) * len(texts) + doc[used & (kinds[k] != 0)] for k in range(len(kinds))]))
    f, d = pairs // len(texts), pairs % len(texts)
    toxic = np.bincount(f[y[d] == 1], minlength=len(names)).astype(float)
    clean = np.bincount(f[y[d] == 0], minlength=len(names)).astype(float)
    share = (once & (y == 1)).sum() / once.sum()
    both = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(toxic > 0, toxic * np.log(toxic / (both * share)), 0) + np.where(clean > 0, clean * np.log(clean / (both * (1 - share))), 0)
    telling = (gain > np.log(len(names)) + 3) & (toxic >= 0.9 * both)
    # a prefix that nearly always continues in one way says no more than the longer feature, but about more words
    at, order = np.flatnonzero(telling[ids].any(0) & (y[doc] == 1)), [*range(1, len(kinds)), 0]
    same = np.zeros(len(names), bool)
    for i, k in enumerate(order[:-1]):
        longer = ids[0][at]
        for later in reversed(order[i + 1 : -1]):
            longer = np.where(kinds[later][at] != 0, ids[later][at], longer)
        parent = ids[k][at]
        same[parent[(kinds[k][at] != 0) & (toxic[longer] >= 0.9 * toxic[parent])]] = True
    telling &= ~same
    label = (telling[ids].any(0) & (y[doc] == 1)).astype(float)
    if not label.any():
        return empty

    # features of toxic words carry weights; all other words share the bias
    kept = np.zeros(len(names), bool)
    for k in range(len(kinds)):
        kept[ids[k][(label > 0) & (kinds[k] != 0)]] = True
    kept &= (toxic >= 3) & ~same
    column = np.cumsum(kept) - 1
    # trained on the toxic texts and as many clean ones
    rank = np.cumsum(once & (y == 0))
    chosen = once & ((y == 1) | (rank <= (once & (y == 1)).sum()))
    inside = chosen[doc]
    n_words = np.where(chosen, np.diff(first), 0)
    full_first, full_ids = first, ids
    first, ids, label = np.concatenate([[0], np.cumsum(n_words)]), ids[:, inside], label[inside]
    hit = [np.flatnonzero(kept[ids[k]]) for k in range(len(kinds))]
    col = [column[ids[k][h]] for k, h in enumerate(hit)]
    w, bias, trans = np.zeros(kept.sum()), -4.0, np.zeros((2, 2))
    before = np.concatenate([[0], label[:-1]])
    before[first[:-1][first[:-1] < first[1:]]] = 0
    seen = np.array([[((before == i) & (label == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    sq = {"w": np.full(len(w), 1e-8), "b": 1e-8, "t": np.full((2, 2), 1e-8)}
    for _ in range(steps):
        emission = np.full(len(label), bias)
        for h, c in zip(hit, col, strict=True):
            emission[h] += w[c]
        p, moves = marginals(emission, first, trans, pairs=True)
        off = label - p
        g = sum(np.bincount(c, off[h], len(w)) for h, c in zip(hit, col, strict=True)) - 0.05 * w
        gb, gt = off.sum(), seen - moves - 0.05 * trans
        for key, grad in (("w", g), ("b", gb), ("t", gt)):
            sq[key] = sq[key] * 0.9 + 0.1 * grad**2
        w += rate * g / np.sqrt(sq["w"])
        bias += rate * gb / np.sqrt(sq["b"])
        trans += rate * gt / np.sqrt(sq["t"])
        rate *= 0.95
    chain = Chain(Table(names[kept], w), float(bias), trans)

    emission = np.full(len(start), chain.bias)
    for k in range(len(kinds)):
        at = np.flatnonzero(kept[full_ids[k]])
        emission[at] += w[column[full_ids[k][at]]]
    x = chain.summary(marginals(emission, full_first, trans)[0], full_first)
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    beta, weight = np.zeros(3), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(25):  # Newton steps of a ridge logistic fit
        q = 1 / (1 + np.exp(-(a @ beta)))
        hess = (a * (weight * q * (1 - q))[:, None]).T @ a + 0.5 * np.eye(3)
        beta += np.linalg.solve(hess, a.T @ (weight * (y - q)) - 0.5 * beta)
    chain.curve = tuple(beta.tolist())
    return chain


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", toxic: int = 1500, clean: int = 3000, most_bytes: int = 1 << 13, folds: int = 3, held_out: int = 1) -> Chain:
    """Fit on at most so many toxic and clean texts of at most most_bytes each (the bounds of what reaches the driver).

    One text for each id; ids with contradicting labels and rows of the held-out fold are never learned from. Without both labels, all texts score alike.
    """
    return fit_chain(*labelled(docs, labels, label, {0: clean, 1: toxic}, most_bytes, folds, held_out))


def tag_texts(df: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1), toxic_words (expected number) and spans of toxic words, as an array of
    (start, end) in characters of the text. Columns of these names are replaced.

    Null and empty texts have no words; they score as any text without toxic words.
    """
    df = df.drop("score", "toxic_words", "spans")
    names = [*df.columns, "score", "toxic_words", "spans"]
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    held = df.withColumn("__leakloom_text", text_of(F.col(f"`{text_col}`")))

    def run(it):
        for b in batches(it, 2 << 20):
            buf, rows = flat(b.column(b.num_columns - 1))
            start, end, first, p = chain.words(buf, rows)
            x = chain.summary(p, first)
            spans = [[] for _ in range(b.num_rows)]
            at = np.flatnonzero(p > 0.5)
            for i, r in zip(at.tolist(), (np.searchsorted(first, at, "right") - 1).tolist(), strict=True):
                a, z, text = start[i] - rows[r], end[i] - rows[r], spans[r]
                if text and i - 1 == text[-1][2]:
                    text[-1][1:] = [z, i]
                else:
                    text.append([a, z, i])
            for r, found in enumerate(spans):
                if found:
                    chars = np.concatenate([[0], np.cumsum((buf[rows[r] : rows[r + 1]] & 0xC0) != 0x80)])
                    spans[r] = [{"start": int(chars[a]), "end": int(chars[z])} for a, z, _ in found]
            columns = [pa.array(chain.score(x)), pa.array(np.expm1(x[:, 0])), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=names)

    kind = T._parse_datatype_string("array<struct<start:int,end:int>>")
    return held.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("toxic_words", T.DoubleType()), T.StructField("spans", kind)]))
