"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. In
a chunk every position gives WIDTH bytes to FILTERS learned filters (one
weight a byte value and place, so bytes need no embedding of their own); each
filter's largest activation over the chunk passes a ReLU. The mean of these
over the chunks goes through one logistic layer. Trained by Adam on a bounded
sample of chunks of labelled rows; the gradient reaches a filter through the
position of its maximum. A text shorter than a chunk has lower maxima; how
much shorter it is goes into the logistic layer too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

FILTERS = 24
WIDTH = 6
CHUNK = 512
#: Chunks overlap by half.
STEP = CHUNK // 2
#: The bound of the sample that the network is fitted on: so many rows, so many chunks of each.
TRAIN_ROWS = 3000
TRAIN_CHUNKS = 5
THRESHOLD = 0.3


@dataclass
class Network:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS + 2,)
    out_bias: float

    def pairs(self) -> np.ndarray:
        """Filter weights by two bytes at once: (WIDTH / 2, 65536, FILTERS)."""
        f = self.filters
        return (f[0::2, :, None, :] + f[1::2, None, :, :]).reshape(WIDTH // 2, 65536, -1).astype(np.float32)


def _activations(data: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """(len(data) - WIDTH + 1, FILTERS), of bytes."""
    two = (data[:-1].astype(np.int64) << 8) | data[1:]
    n = len(data) - WIDTH + 1
    act = pairs[0][two[:n]]
    for i in range(1, WIDTH // 2):
        act += pairs[i][two[2 * i : 2 * i + n]]
    return act


def chunk_starts(n: int) -> np.ndarray:
    """Starts of chunks that cover n bytes: every STEP bytes, the last one ending at the end."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - CHUNK, STEP)
    return np.append(starts, n - CHUNK)


def _padded(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return np.concatenate((data, np.zeros(WIDTH - len(data), np.uint8))) if len(data) < WIDTH else data


def features(text: bytes, pairs: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Mean over the chunks of every filter's largest activation, over the whole text, in pieces of bounded memory."""
    data = _padded(text)
    starts = chunk_starts(len(data))
    total = np.zeros(pairs.shape[2])
    for i in range(0, len(starts), 64):
        some = starts[i : i + 64]
        begin, end = some[0], min(some[-1] + CHUNK, len(data))
        act = _activations(data[begin:end], pairs)
        last = len(act)
        # Maxima between all starts and ends of chunks first; a chunk is a run of these.
        first, end = some - begin, some - begin + CHUNK - WIDTH + 1
        edges = np.unique(np.concatenate((first, end[end < len(act)])))
        part = np.maximum.reduceat(act, edges, axis=0)
        best = np.stack([part[a:b].max(0) for a, b in zip(np.searchsorted(edges, first), np.searchsorted(edges, end))])
        total += np.maximum(best + bias, 0).sum(0)
    return total / len(starts)


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _head(pooled: np.ndarray, n: int) -> np.ndarray:
    """Input of the logistic layer: pooled filters, and how they shift with the shortness of a text of n bytes."""
    short = max(0.0, 1 - np.log(max(n, 1)) / np.log(CHUNK))
    return np.concatenate((pooled, short * pooled, [short, short * short]))


def score_text(text: bytes, net: Network, pairs: np.ndarray) -> float:
    return float(_logistic(_head(features(text, pairs, net.bias), len(text)) @ net.out + net.out_bias))


def fit(chunks: list[np.ndarray], row: np.ndarray, label: np.ndarray, *, epochs: int = 10, batch: int = 128, seed: int = 1) -> Network:
    """chunks: byte arrays of CHUNK at most; row: which row each is of, ascending; label: of rows.

    Without two classes the network is constant, at the share of label 1 (0.5 without rows).
    """
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.25, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), np.concatenate((rng.normal(0, 0.1, FILTERS), np.zeros(FILTERS + 2))), 0.0)
    n = len(label)
    if n == 0 or label.min() == label.max():
        share = (label.sum() + 0.5) / (n + 1)
        net.out[:] = 0
        net.out_bias = float(np.log(share / (1 - share)))
        return net
    of = [np.flatnonzero(row == i) for i in range(n)] if n < 50 else np.split(np.arange(len(row)), np.searchsorted(row, np.arange(1, n)))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.filters, net.bias, net.out, np.zeros(1))]
    lengths = [len(c) for c in chunks]
    step = 0
    for epoch in range(epochs):
        rate = 0.02 * 0.8**epoch
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            pairs = net.pairs()
            grad_f, grad_b = np.zeros_like(net.filters), np.zeros_like(net.bias)
            grad_o, grad_c = np.zeros_like(net.out), 0.0
            for r in rows:
                mine = of[r]
                if not len(mine):
                    continue
                best, places = [], []
                for c in mine:
                    act = _activations(chunks[c], pairs)
                    p = act.argmax(0)
                    best.append(act[p, np.arange(FILTERS)]), places.append(p)
                pre = np.array(best) + net.bias
                short = max(0.0, 1 - np.log(max(lengths[mine[0]], 1)) / np.log(CHUNK))
                x = _head(np.maximum(pre, 0).mean(0), lengths[mine[0]])
                d = (_logistic(x @ net.out + net.out_bias) - label[r]) / len(rows)
                grad_o += d * x
                grad_c += d
                back = d * (net.out[:FILTERS] + short * net.out[FILTERS : 2 * FILTERS]) * (pre > 0) / len(mine)
                grad_b += back.sum(0)
                for g, p, c in zip(back, places, mine):
                    on = np.flatnonzero(g)
                    for w in range(WIDTH):
                        grad_f[w, chunks[c][p[on] + w], on] += g[on]
            step += 1
            out_bias = np.array([net.out_bias])
            for param, grad, (m, v) in zip((net.filters, net.bias, net.out, out_bias), (grad_f, grad_b, grad_o + 1e-4 * net.out, np.array([grad_c])), state):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.out_bias = float(out_bias[0])
    return net


def held_out(id_col: str) -> Column:
    """Rows that no network may learn from: crc32 of the id as text divides by 5. A null id counts as not held out, and isn't learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _spread_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text at most TRAIN_CHUNKS chunks, evenly over the whole text."""
    for batch in batches:
        rows = []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            data = _padded(text or b"")
            starts = chunk_starts(len(data))
            some = starts[np.unique(np.linspace(0, len(starts) - 1, TRAIN_CHUNKS).astype(int))]
            rows.append([data[s : s + CHUNK].tobytes() for s in some])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.binary()))], ["id", "label", "chunks"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Network:
    """Fit on at most `rows` labelled rows, chosen by a hash of the id.

    Held-out and null ids and null labels are left out. An id with several
    labels counts by the smallest; of several texts with one id one counts, so
    the driver gets `rows` rows at most. Null texts count as empty; of long
    ones TRAIN_CHUNKS chunks count. Without rows, or with labels of one kind,
    the network is constant.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.min(label).alias("__label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    found = docs.select(id_col, text).join(F.broadcast(chosen), id_col)  # bounded by `rows`
    sample = found.select(F.col(id_col).cast("string").alias("id"), F.col("__label").cast("double").alias("label"), F.col(text).alias("text")).mapInArrow(_spread_chunks, "id string, label double, chunks array<binary>")
    sample = sample.groupBy("id").agg(F.min("label").alias("label"), F.min("chunks").alias("chunks")).collect()
    sample = sorted(sample, key=lambda r: (zlib.crc32(r["id"].encode()), r["id"]))
    chunks = [np.frombuffer(bytes(c), np.uint8) for r in sample for c in r["chunks"]]
    row = np.repeat(np.arange(len(sample)), [len(r["chunks"]) for r in sample])
    return fit(chunks, row, np.array([r["label"] for r in sample]))


def score(df: DataFrame, net: Network, *, text: str = "text", to: str = "score") -> DataFrame:
    """df with a probability (0 to 1) of label 1, over the whole of every text. Null counts as empty, and an empty text gets the score of no evidence: zero bytes."""
    small_batches(df.sparkSession)
    arrays = (net.filters.astype(np.float32), net.bias, net.out, net.out_bias)
    if to in df.columns:
        df = df.drop(to)
    column = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*arrays)
        pairs = own.pairs()
        for batch in batches:
            texts = batch.column(column).cast(pa.large_binary())
            values = [score_text(t.as_py() or b"", own, pairs) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, to])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(to, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, rows: int = TRAIN_ROWS, to: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with score and predicted (1 if score >= threshold), under the names to and predicted, which replace columns of docs so named. Repeated rows are scored each; equal texts have equal scores; null and empty texts have that of no evidence; an empty table gives an empty result."""
    net = train(docs, labels, id_col=id_col, text=text, label=label, rows=rows)
    return score(docs, net, text=text, to=to).withColumn(predicted, (F.col(to) >= threshold).cast("int"))
