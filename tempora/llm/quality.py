"""Quality classifier: a byte-level convolutional network in numpy.

Every whole text is cut into overlapping chunks (by one filter width less one,
so each window of bytes lies in one chunk).  Learned filters run over the
bytes of a chunk, are max-pooled over it, then over the document's chunks, and
a logistic layer combines the pooled filters and the log of the length into one
probability.  The text is the only input of a score.

The network is fitted on the driver on a bounded sample (at most ``rows``
labelled documents and ``total_bytes`` of whole texts, by the hash of their id);
scoring covers all documents.

Defined cases: null text counts as empty, and an empty text as one zero byte,
so it has a score; null labels and ids are not learnt from; of several labels or
texts of one id the smallest counts; with labels of one class only the score is
that class's share, and without any it is one half; equal texts have equal
scores, and repeated rows are scored as often; a very long text is read chunk by
chunk; a table without rows gives none; other columns are kept, and one named
like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType

WIDTH, FILTERS, CHUNK = 6, 16, 4096
BATCH, LEAST_STEPS, EPOCHS, RATE = 32, 500, 6, 0.02


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that is never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _bytes(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return data if len(data) else np.zeros(1, np.uint8)


@dataclass
class Network:
    """filters[k, byte, f]: what byte k of a window adds to filter f."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float

    def pooled(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter over the document, and where its window starts."""
        tables = self.filters
        best, where = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        data = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
        for start in range(0, len(data) - WIDTH + 1, CHUNK):
            chunk = data[start : start + CHUNK + WIDTH - 1]
            n = len(chunk) - WIDTH + 1
            response = tables[0].take(chunk[:n], axis=0)
            for k in range(1, WIDTH):
                response += tables[k].take(chunk[k : k + n], axis=0)
            at = response.argmax(axis=0)
            top = response[at, np.arange(FILTERS)]
            better = top > best
            best[better], where[better] = top[better], start + at[better]
        return best, where

    @cached_property
    def _pairs(self) -> np.ndarray:
        """The filters by two neighbouring bytes at once (13 MB)."""
        pairs = np.empty((WIDTH // 2, 65536, FILTERS), np.float32)
        for k in range(WIDTH // 2):
            pairs[k] = (self.filters[2 * k + 1][:, None, :] + self.filters[2 * k][None, :, :]).reshape(65536, FILTERS)
        return pairs

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One probability for each whole text."""
        pairs = self._pairs
        response, more = np.empty((CHUNK, FILTERS), np.float32), np.empty((CHUNK, FILTERS), np.float32)
        pooled, length = np.empty((len(texts), FILTERS), np.float32), np.empty(len(texts))
        for i, text in enumerate(texts):
            data = _bytes(text)
            length[i] = len(data)
            data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
            two = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << 8)
            best = np.full(FILTERS, -np.inf, np.float32)
            total = len(data) - WIDTH
            for start in range(0, total, CHUNK):
                n = min(CHUNK, total - start)
                r, m = response[:n], more[:n]
                pairs[0].take(two[start : start + n], axis=0, out=r, mode="clip")
                for k in range(1, WIDTH // 2):
                    r += pairs[k].take(two[start + 2 * k : start + 2 * k + n], axis=0, out=m, mode="clip")
                np.maximum(best, r.max(axis=0), out=best)
            pooled[i] = best
        hidden = np.concatenate([np.maximum(pooled + self.bias, 0), _size(length)[:, None]], axis=1)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.out + self.base, -40, 40)))


def _size(length: np.ndarray) -> np.ndarray:
    return np.log1p(length) / 10


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Network:
    """Fit by Adam on the logistic loss; the same rows in the same order give the same network."""
    rng = np.random.default_rng(seed)
    data, y = [_bytes(t) for t in texts], np.asarray(labels, float)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS + 1), 0.0)
    if len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        net.out[:], net.base = 0, float(np.log(share / (1 - share)))
        return net
    share = y.mean()
    net.base = float(np.log(share / (1 - share)))
    names = ("filters", "bias", "out")
    first, second = ({n: np.zeros(getattr(net, n).shape) for n in names} for _ in range(2))
    every, steps_of_epoch = np.arange(FILTERS), -(-len(y) // BATCH)
    steps = max(EPOCHS * steps_of_epoch, LEAST_STEPS)
    order: list[int] = []
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order += list(rng.permutation(len(y)))
        chosen, order = order[:BATCH], order[BATCH:]
        grad = {n: np.zeros(getattr(net, n).shape) for n in names}
        grad_base = 0.0
        for i in chosen:
            best, at = net.pooled(data[i])
            top = best + net.bias
            hidden = np.append(np.maximum(top, 0), _size(np.float64(len(data[i]))))
            error = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.base, -40, 40))) - y[i]
            grad["out"] += error * hidden
            grad_base += error
            back = error * net.out[:FILTERS] * (top > 0)
            grad["bias"] += back
            window = np.concatenate([data[i], np.zeros(WIDTH - 1, np.uint8)])
            for k in range(WIDTH):
                grad["filters"][k][window[at + k], every] += back
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for n in names:
            g = grad[n] / len(chosen)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.99 * second[n] + 0.01 * g * g
            move = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-6)
            getattr(net, n)[...] -= (rate * move).astype(getattr(net, n).dtype)
        net.base -= rate * grad_base / len(chosen)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = 4000, total_bytes: int = 64 << 20) -> Network:
    """Fit on at most ``rows`` labelled documents outside the held-out quarter, in whole texts of ``total_bytes`` together at most.

    Only this sample comes to the driver.  Where the bytes run out, texts that no
    longer fit are passed over, so the sample then leans to shorter ones.
    """
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    label = {r.doc_id: int(r.quality) for r in sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}
    text = F.coalesce(F.col("text"), F.lit(""))
    of_id = docs.filter(F.col("doc_id").isin(list(label))).groupBy("doc_id").agg(F.min(text).alias("text"))
    size = {r.doc_id: r.size for r in of_id.select("doc_id", F.octet_length("text").alias("size")).collect()}
    taken, left = [], total_bytes
    for i in (i for i in label if i in size):  # in the order of the hash
        if size[i] <= left:
            taken.append(i)
            left -= size[i]
    found = sorted((r.doc_id, r.text) for r in of_id.filter(F.col("doc_id").isin(taken)).collect())
    return fit([t for _, t in found], [label[i] for i, _ in found])


def score(docs: DataFrame, network: Network, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability, from 0 to 1, that a document is of label 1."""

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(network.score(list(batch)), dtype=float)

    return docs.withColumn(to, scored(F.col(f"`{text}`")))
