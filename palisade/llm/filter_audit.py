"""What filters take from one another in every order they could run in, by contractions of count tensors.

A document fails each of five filters or passes it, so a part of the corpus is a tensor of
2 x 2 x 2 x 2 x 2 counts.  Spark judges documents in one pass, looks up which texts an
earlier document has, and adds the counts up by part and pattern of failures.  Then a part
is at most 32 rows, and every figure of every order is a contraction of its tensor: along
each axis a step takes those that pass, those that fail, or all.

Filters, each naming what fails: A under 50 words; B distinct words under 65 % of the words;
C capital letters A to Z above 5 % of the code points; D one of ``#$%&*|``; E a text that a
document with a smaller ``doc_id`` has too.

Defined cases: a null text is empty, fails A alone and E like any other text; a null source is
the part ``''``.  A null ``doc_id`` has no smaller one, is smaller than none and has no label.
Rows with the same ``doc_id`` are documents of their own and never fail E by one another.  A
document is good or toxic if any of its label rows says so.  Texts of any length are judged
whole, as one row of a batch.  No documents, no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import stash

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = b"#$%&*|"

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that continue a code point.
_CONTINUING = bytes(range(0x80, 0xC0))
_PASS, _FAIL, _ALL = np.eye(2, dtype=np.int64)[0], np.eye(2, dtype=np.int64)[1], np.ones(2, dtype=np.int64)
#: Rows of a batch that are turned into Python bytes at a time.
SLICE = 256
_JUDGED = "doc_id bigint, part string, fails int, text_id binary"
_STEPS = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def _fails(text: bytes) -> int:
    """Bits of the filters A to D that a text fails, A the lowest."""
    words = text.split()  # bytes split at blanks and U+0009 to U+000D, nothing else
    points = len(text) - _count(text, _CONTINUING)
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1
        | (100 * _count(text, _CAPITALS) > MAX_CAPITALS_PERCENT * points) << 2
        | (_count(text, SYMBOLS) > 0) << 3
    )


def _count(text: bytes, those: bytes) -> int:
    return len(text) - len(text.translate(None, those))


def judged(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, fails, text_id)``: failures of A to D as bits, and the SHA-256 of the text."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    def judge(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                texts = some.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"), some.column("part"),
                        pa.array([_fails(t) for t in texts], pa.int32()),
                        pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    ],
                    ["doc_id", "part", "fails", "text_id"],
                )

    return rows.mapInArrow(judge, _JUDGED)


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, fails, n, good, toxic)``: documents of each part by the filters they fail, E the highest bit."""
    one = stash(judged(docs), "judged")
    # only texts of several documents are looked up; the least id is found before rows move
    shared = one.groupBy("text_id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    shared = stash(shared.select(F.col("text_id").alias("shared_id"), "first"), "shared")
    said = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("bigint").alias("said_of")).agg(
        F.max((F.col("quality") == 1).cast("bigint")).alias("good"), F.max((F.col("toxic") == 1).cast("bigint")).alias("toxic")
    )
    rows = one.join(shared, F.col("text_id") == F.col("shared_id"), "left").select(
        "doc_id", "part", F.col("fails").bitwiseOR(F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0)) * 16).alias("fails")
    )
    return rows.join(said, F.col("doc_id") == F.col("said_of"), "left").groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def _selectors() -> dict[str, np.ndarray]:
    """For each figure, what each of the 120 x 5 steps takes along each of the five axes."""
    steps = {name: np.empty((len(ORDERS), len(FILTERS), len(FILTERS), 2), np.int64) for name in ("kept", "removed", "failing", "unique")}
    for o, order in enumerate(ORDERS):
        for step, own in enumerate(order):
            for axis, name in enumerate(FILTERS):
                before = order.index(name) < step
                steps["kept"][o, step, axis] = _PASS if before or name == own else _ALL
                steps["removed"][o, step, axis] = _FAIL if name == own else _PASS if before else _ALL
                steps["failing"][o, step, axis] = _FAIL if name == own else _ALL
                steps["unique"][o, step, axis] = _FAIL if name == own else _PASS
    return {name: s.reshape(-1, len(FILTERS), 2) for name, s in steps.items()}


def _contract(tensors: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Contractions of ``(parts, 2, 2, 2, 2, 2)`` with each step's five vectors: ``(parts, steps)``."""
    return np.einsum("pabcde,sa,sb,sc,sd,se->ps", tensors, *(of[:, axis] for axis in range(len(FILTERS))), optimize="greedy")


def figures(counts: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of all steps, ``(parts, 600)`` each, from three tensors of ``(parts, 2, 2, 2, 2, 2)`` whole numbers."""
    of = _selectors()
    removed = _contract(counts, of["removed"])
    own = np.array([FILTERS.index(name) for order in ORDERS for name in order])
    each = np.stack([removed[:, own == axis].sum(axis=1) for axis in range(len(FILTERS))], axis=1)
    return {
        "kept": _contract(counts, of["kept"]),
        "removed": removed,
        "redundant": _contract(counts, of["failing"]) - removed,
        "unique_fails": _contract(counts, of["unique"]),
        "good_lost": _contract(good, of["removed"]),
        "toxic_lost": _contract(toxic, of["removed"]),
        "shapley": each[:, own],
    }


def _tensor(parts: list[list[dict]], of: str) -> np.ndarray:
    out = np.zeros((len(parts), 32), np.int64)
    for p, cells in enumerate(parts):
        for cell in cells:
            out[p, cell["fails"]] += cell[of]
    # the lowest bit is A, the last axis of the plain reshape
    return out.reshape(-1, *[2] * len(FILTERS)).transpose(0, 5, 4, 3, 2, 1)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, filter order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley`` (what its filter removes, over all orders)."""
    cells = patterns(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    orders = pa.array([order for order in ORDERS for _ in order])
    steps = pa.array([step for _ in ORDERS for step in range(1, len(FILTERS) + 1)], pa.int32())

    def contract(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                parts = some.column("cells").to_pylist()
                out = figures(*(_tensor(parts, of) for of in ("n", "good", "toxic")))
                for p, part in enumerate(some.column("part").to_pylist()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * len(orders), pa.string()), orders, steps, *(pa.array(x[p], pa.int64()) for x in out.values())],
                        ["part", "filter_order", "step", *out],
                    )

    return cells.mapInArrow(contract, _STEPS)
