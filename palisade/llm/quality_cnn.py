"""Quality classifier: a byte-level convolutional network in numpy.

Each byte becomes a short vector (its bits and its class); learned filters slide over
overlapping chunks that cover the whole text; a chunk keeps each filter's largest answer.
A document's mean and maximum over its chunks feed one logistic unit.  Because a filter's
answer is a sum over its bytes, scoring adds rows of tables that hold each byte's share.

``train`` learns from at most ``sample`` labelled texts, chosen by a hash of ``doc_id``, on
the driver, each of at most ``LONGEST`` characters: a documented bound.  ``score`` is spread over Spark's tasks.

Defined cases: null and empty texts are one chunk of padding and get its score; very long
texts are cut into chunks of which a bounded number is in memory; repeated rows are scored
alike; without any label the score is 0.5 plus nothing learned; null labels are not learned
from.  Columns other than ``doc_id`` and ``text`` are never read.  A score at the threshold is a 1.  An empty
table gives no row, and nothing is learned from one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import in_arrow

CHUNK, HOP = 256, 224
WIDTH, STRIDE, FILTERS = 8, 2, 24
#: Labelled texts that are learned from at most.
SAMPLE = 1500
THRESHOLD = 0.7
#: Labelled texts longer than this are not learned from, so the sample stays within the driver's memory; all are scored.
LONGEST = 100_000
#: Chunks in memory at a time.
BLOCK = 1024
EPOCHS, RATE = 12, 0.02
#: Texts that are visited in all at least, however few there are to learn from.
VISITS = 12_000


def byte_vectors() -> np.ndarray:
    """256 x 16: eight bits, and whether the byte is padding, space, newline, lower, upper, digit, other ASCII, beyond ASCII."""
    b = np.arange(256)
    bits = (b[:, None] >> np.arange(8)) & 1
    lower, upper, digit = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    space = (b == 32) | ((b >= 9) & (b <= 13) & (b != 10))
    other = (b > 0) & (b < 128) & ~(lower | upper | digit | space | (b == 10))
    kinds = np.stack([b == 0, space, b == 10, lower, upper, digit, other, b >= 128], axis=1)
    out = np.concatenate([bits - 0.5, kinds], axis=1).astype(np.float32)
    out[0, :8] = 0
    return out


VECTORS = byte_vectors()


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts as rows of bytes, and the number of each text's chunks."""
    counts = np.array([max(1, -(-(len(t) - (CHUNK - HOP)) // HOP)) for t in texts], dtype=np.int64)
    rows = np.zeros((int(counts.sum()), CHUNK), dtype=np.uint8)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        flat = np.zeros((n - 1) * HOP + CHUNK, dtype=np.uint8)
        flat[: len(text)] = np.frombuffer(text, dtype=np.uint8)
        rows[at : at + n] = np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::HOP]
        at += n
    return rows, counts


class Network:
    def __init__(self, filters: np.ndarray, bias: np.ndarray, out: np.ndarray, out_bias: float):
        self.filters, self.bias, self.out, self.out_bias = filters, bias, out, float(out_bias)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        filters = rng.normal(0, 0.25, (WIDTH, VECTORS.shape[1], FILTERS)).astype(np.float32)
        return cls(filters, np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Each chunk's largest answer per filter, and its place if asked for."""
        tables = np.einsum("bd,wdf->wbf", VECTORS, self.filters).astype(np.float32)
        best, place = [], []
        span = CHUNK - WIDTH + 1
        for start in range(0, len(rows), BLOCK):
            part = rows[start : start + BLOCK]
            answer = tables[0][part[:, 0:span:STRIDE]]
            for w in range(1, WIDTH):
                answer += tables[w][part[:, w : w + span : STRIDE]]
            if where:
                place.append(answer.argmax(axis=1))
            best.append(answer.max(axis=1))
        top = np.tanh(np.concatenate(best) + self.bias)
        return (top, np.concatenate(place)) if where else top

    def features(self, top: np.ndarray, counts: np.ndarray) -> np.ndarray:
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        return np.concatenate([np.add.reduceat(top, starts) / counts[:, None], np.maximum.reduceat(top, starts)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        rows, counts = chunks(texts)
        z = (self.features(self.pooled(rows), counts).astype(np.float64) * self.out).sum(axis=1) + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def learn(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Adam on the logistic loss, classes weighed alike; gradients pass through the places that won the pooling."""
    net = Network.fresh(seed)
    if not texts:
        return net
    y = np.array(labels, dtype=np.float64)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    rng = np.random.default_rng(seed)
    params = [net.filters, net.bias, net.out, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, -(-VISITS // len(texts)))):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), 32):
            batch = order[start : start + 32]
            rows, counts = chunks([texts[i] for i in batch])
            top, place = net.pooled(rows, where=True)
            x = net.features(top, counts)
            p = 1 / (1 + np.exp(-np.clip(x @ net.out + params[3][0], -50, 50)))
            err = ((p - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            owner = np.repeat(np.arange(len(batch)), counts)
            grad_top = err[owner, None] * net.out[:FILTERS] / counts[owner, None]
            grad_top += err[owner, None] * net.out[FILTERS:] * (top == x[owner, FILTERS:])
            grad_top = (grad_top * (1 - top * top)).astype(np.float32)
            grad_filters = np.zeros_like(net.filters)
            for w in range(WIDTH):
                won = np.take_along_axis(rows, place * STRIDE + w, axis=1)
                grad_filters[w] = np.einsum("cfd,cf->df", VECTORS[won], grad_top)
            grads = [grad_filters, grad_top.sum(axis=0), x.T @ err + 1e-4 * net.out, np.array([err.sum()], np.float32)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.out_bias = float(params[3][0])
    return net


def held_out():
    """Rows that are never learned from: crc32 of ``doc_id`` as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Learn from at most ``sample`` labelled texts outside the held-out quarter."""
    wanted = (
        labels.select("doc_id", "quality").filter(~held_out() & F.col("quality").isin(0, 1))
        .orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id", "quality").limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").filter(F.length("text") <= LONGEST).select("doc_id", "quality", "text")
    seen = sorted(map(tuple, rows.collect()))
    return learn([t.encode() for _, _, t in seen], [q for _, q, _ in seen])


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``(doc_id, score)`` of every row: the whole text's probability of good quality."""

    def run(rows):
        got = network.score([(r["text"] or "").encode() for r in rows])
        for row, value in zip(rows, got.tolist(), strict=True):
            yield {"doc_id": row["doc_id"], "score": value}

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, score double", max_rows=64)


def classify(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    return score(docs, network).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accept(docs: DataFrame, network: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the network does not reject."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("double")
    def scored(texts):
        import pandas as pd

        out = []
        for start in range(0, len(texts), 64):
            out.append(network.score([(t or "").encode() for t in texts[start : start + 64]]))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.filter(scored("text") >= threshold)
