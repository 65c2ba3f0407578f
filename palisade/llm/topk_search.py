"""Exact top-k by inner product with the no-random-access algorithm.

Components become whole numbers, ``floor(256 * x)``, so scores are exact.  Queries and
candidates are dealt to blocks; each block of candidates has one list per dimension, sorted
by that component.  A query reads all lists of a block from the end that suits the sign of
its own component, deeper each round.  What a list has shown counts as it is; what it has
not shown lies between the list's last value and the value at the present depth, which gives
every candidate a lower and an upper bound.  Candidates whose upper bound is under the k-th
lower bound are out; a round with none but k left, or with all lists read, ends the search,
and the scores of those left are resolved.  The best of all blocks are merged per query.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
do rows without ``vec_id``; a vector meets those of its own length only; rows alike in id and
vector count once, and rows of the query's own id are no candidates; ties go to the smaller
``vec_id``; queries with fewer candidates give all.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import stash

K, EVERY = 5, 50
#: Candidates and queries of a block, on average.
CANDIDATES, QUERIES = 4096, 512
#: A search reads one part in so many of each list first, and as many times deeper each round.
FIRST = 4


def whole(vectors: DataFrame) -> DataFrame:
    """``(vec_id, dim, body)``: whole components as little-endian 64-bit integers, once per id and vector."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # One arithmetic for all kinds of components: 256 * x as double, rounded down.
    taken = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    taken = taken.select(F.col("vec_id").cast("bigint"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256.0).cast("bigint")).alias("whole"))

    def pack(stream):
        import pyarrow as pa

        for batch in stream:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.flatten(), dtype="<i8"), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            bodies = [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(bodies, pa.binary())], names=["vec_id", "dim", "body"])

    return taken.mapInArrow(pack, "vec_id bigint, dim bigint, body binary").dropDuplicates(["vec_id", "body"])


class Lists:
    """A block of candidates with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        # Four bytes do while no score of any two vectors like these can pass them.
        widest = int(np.abs(vectors).max(initial=0))
        small = widest * widest * max(1, vectors.shape[1]) < 1 << 31
        self.ids, self.vectors = ids[order], vectors[order].astype(np.int32 if small else np.int64)
        self.widest = widest
        self.sorted = np.sort(self.vectors, axis=0)  # rising

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` best ``(vec_id, score)``, read from the lists only as deep as need be."""
        n = len(self.ids)
        fits = int(np.abs(query).max(initial=0)) <= self.widest
        query = query.astype(self.vectors.dtype if fits else np.int64)
        alive = np.flatnonzero(self.ids != own)
        shown = self.vectors[alive] * query
        up, depth = query > 0, max(k, n // FIRST)
        while len(alive) > k and depth < n:
            edge = np.where(up, self.sorted[n - depth], self.sorted[depth - 1]) * query
            ends = np.minimum(self.sorted[0] * query, self.sorted[-1] * query)  # what each list ends in
            # Unseen values are replaced by what their list ends in, and by its value at this depth.
            lower = np.where(shown >= edge, shown, ends).sum(axis=1)
            upper = np.maximum(shown, edge).sum(axis=1)
            stay = upper >= np.partition(lower, len(lower) - k)[len(lower) - k]
            alive, shown = alive[stay], shown[stay]
            depth *= FIRST
        scores = shown.sum(axis=1, dtype=np.int64)
        best = np.lexsort((self.ids[alive], -scores))[:k]
        return list(zip(self.ids[alive][best].tolist(), scores[best].tolist(), strict=True))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best of every query, a row whose id is divisible by ``every``."""
    held = stash(whole(vectors), "vectors")
    sizes = held.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"))
    share = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("int")
    # Lengths of vectors: few; the table of counts is broadcast only if it has been seen to be small.
    sizes = stash(sizes.select("dim", share("n", CANDIDATES).alias("c_blocks"), share("q", QUERIES).alias("q_blocks")), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= 10_000 else sizes
    dealt = held.join(sizes, "dim")
    block = lambda c, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "body"), F.col(c)).cast("int")
    turns = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    candidates = dealt.withColumn("c", block("c_blocks", 1)).withColumn("q", turns("q_blocks"))
    candidates = candidates.select(*[F.col(c).alias(f"{c}_of") for c in ("dim", "c", "q")], F.col("vec_id").alias("id"), F.col("body").alias("vector"))
    queries = dealt.filter(F.col("vec_id") % every == 0).withColumn("q", block("q_blocks", 2)).withColumn("c", turns("c_blocks")).select("dim", "c", "q", "vec_id", "body")

    def stack(ids, bodies):
        return ids.to_numpy(dtype="int64"), np.frombuffer(b"".join(bodies), dtype="<i8").reshape(len(ids), -1)

    def search(asked, offered):
        import pandas as pd

        columns = [[], [], [], []]
        if len(asked) and len(offered):
            lists = Lists(*stack(offered["id"], offered["vector"]))
            for place, (own, query) in enumerate(zip(*stack(asked["vec_id"], asked["body"]), strict=True)):
                for vec_id, score in lists.search(own, query, k):
                    for held, x in zip(columns, (int(own), asked["body"].iloc[place], vec_id, score), strict=True):
                        held.append(x)
        return pd.DataFrame(dict(zip(("query_id", "body", "vec_id", "score"), columns, strict=True))).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    found = queries.groupBy("dim", "c", "q").cogroup(candidates.groupBy("dim_of", "c_of", "q_of")).applyInPandas(search, "query_id bigint, body binary, vec_id bigint, score bigint")
    # k rows of each block: a handful per query.
    best = found.groupBy("query_id", "body").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k).alias("best"))
    ranked = best.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
