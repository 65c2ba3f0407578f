"""Removal of byte strings that repeat, by prefix doubling over sampled positions.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier, in a
smaller document or before in the same one.  As in building a suffix array by prefix
doubling, positions get names for ever longer strings, a position whose name is unique
drops out, and naming stops past the threshold; names are hashes that Spark groups and
joins instead of places in a sorted order.

* First names: every window of ``length`` bytes picks its least 32-byte string by hash.
  Neighbouring windows that pick the same one form a block; the block is named by that
  string (its anchor) and by its own bytes.  Equal windows pick equal anchors, so a block
  whose anchor no other document has is done with: most are.
* Blocks of equal bytes are settled at once: all but the first document's go.
* Blocks that share an anchor but differ get longer names: their windows in groups by
  offset from the anchor, each group named by the bytes common to its windows; then, where
  that still repeats in another block, each window by all its bytes.  The least document
  of a name keeps it.

Repeats within a document are found in its own task from its repeated anchors.

Defined cases: null text counts as empty; texts shorter than ``length`` stay whole; a null
``doc_id`` comes after all ids; what rows of one ``doc_id`` (or without one) share with each
other only stays; other columns are not read.  Very long texts are sampled a segment at a
time.  Names are 64-bit hashes.  An empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import release, stash

LENGTH, ANCHOR = 100, 32
#: Offsets from the anchor that share one name before each window gets its own.
GROUP = 17
SEGMENT = 1 << 20
LAST = (1 << 63) - 1

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2 to the 64 for i below n at least."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 14), base, dtype=np.uint64)
        held[0] = 1
        with np.errstate(over="ignore"):
            held = np.multiply.accumulate(held)
        _POWERS[base] = held
    return held


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(29))


class Names:
    """Names of any substring of some bytes, each in constant time from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, n)[:n], out=self.sums[1:])
        self.down = _powers(_INVERSE, n + 1)

    def every(self, length: int) -> np.ndarray:
        """Names of all substrings of one length."""
        return _mix((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])

    def of(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        salt = np.asarray(salt).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + salt)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def blocks(text: bytes, length: int = LENGTH) -> np.ndarray:
    """Rows ``(first window, last window, anchor's place, anchor's name, block's name)`` as an array of uint64."""
    data = np.frombuffer(text, dtype=np.uint8)
    out = []
    bits = np.uint64(SEGMENT.bit_length() + 1)
    with np.errstate(over="ignore"):
        for base in range(0, len(data) - length + 1, SEGMENT):
            part = data[base : base + SEGMENT + length - 1]
            names = Names(part)
            short = names.every(ANCHOR)
            picked = _least((short >> bits << bits) | np.arange(len(short), dtype=np.uint64), length - ANCHOR + 1) & ((np.uint64(1) << bits) - np.uint64(1))
            picked = picked.astype(np.int64)
            turns = np.flatnonzero(picked[1:] != picked[:-1]) + 1
            first = np.concatenate([[0], turns])
            last = np.concatenate([turns, [len(picked)]]) - 1
            anchor = picked[first]
            own = names.of(first, last + length, (anchor - first) * 256 + (last - first) + 1)
            out.append(np.stack([(first + base).astype(np.uint64), (last + base).astype(np.uint64), (anchor + base).astype(np.uint64), short[anchor], own]))
    return np.concatenate(out, axis=1) if out else np.zeros((5, 0), dtype=np.uint64)


def _windows(text: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Names of whole windows."""
    out = np.zeros(len(starts), dtype=np.uint64)
    data = np.frombuffer(text, dtype=np.uint8)
    with np.errstate(over="ignore"):
        for base in range(0, max(1, len(data) - length + 1), SEGMENT):
            here = (starts >= base) & (starts < base + SEGMENT)
            if here.any():
                at = starts[here] - base
                out[here] = Names(data[base : base + SEGMENT + length - 1]).of(at, at + length)
    return out


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one after the other."""
    sizes = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def own_repeats(text: bytes, length: int = LENGTH) -> np.ndarray:
    """Windows of a text that start earlier in it too."""
    first, last, _, anchor, _ = blocks(text, length)
    rising = np.sort(anchor)
    if (rising[1:] != rising[:-1]).all():
        return np.zeros(0, dtype=np.int64)
    _, back, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    starts = _spread(first[again].astype(np.int64), last[again].astype(np.int64))
    _, once = np.unique(_windows(text, starts, length), return_index=True)
    return np.delete(starts, once)


def removed(text: bytes, first: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which bytes go, given the ranges of windows that start in earlier documents."""
    edge = np.zeros(len(text) + 1, dtype=np.int32)
    own = own_repeats(text, length)
    if not len(own) and not len(first):
        return np.zeros(len(text), dtype=bool)
    np.add.at(edge, own, 1)
    np.add.at(edge, own + length, -1)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + length, -1)
    return np.cumsum(edge[:-1]) > 0


# --- over Spark ---------------------------------------------------------------------


def _emit(df: DataFrame, make, columns: list[str]) -> DataFrame:
    """Map each row to a batch of long columns; ``make`` gets a row as a dict and returns int64 arrays."""

    def run(stream):
        import pyarrow as pa

        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                parts = [make(row) for row in batch.slice(start, 256).to_pylist()]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(len(columns))], names=columns)

    return df.mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, ord, tag, body)``: the place in the order, 31 bits of hash to tell rows of one id apart, the bytes."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64(body).bitwiseAND((1 << 31) - 1).alias("tag"), body.cast("binary").alias("body"))


def _fresh(text: bytes, length: int) -> np.ndarray:
    """A text's blocks, of equal ones the first."""
    own = blocks(text, length)
    _, once = np.unique(own[4], return_index=True)
    return own[:, np.sort(once)]


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(ord, tag, first, last)``: ranges of windows that also start in an earlier document."""
    spark = docs.sparkSession
    rows = _rows(docs).filter(F.length("body") >= length).select("ord", "tag", "body")

    def named(row):
        own = _fresh(row["body"], length)
        return [_signed(own[3]), np.full(own.shape[1], row["ord"], dtype=np.int64)]

    def placed(row):
        own = _fresh(row["body"], length)
        n = own.shape[1]
        # First window, and how far the last one and the anchor lie from it, in one number.
        place = own[0] << np.uint64(24) | (own[1] - own[0]) << np.uint64(12) | own[2] - own[0]
        return [_signed(own[3]), _signed(own[4]), np.full(n, row["ord"], dtype=np.int64), np.full(n, row["tag"], dtype=np.int64), _signed(place)]

    anchors = _emit(rows.select("ord", "body"), named, ["anchor", "ord"])
    shared = stash(anchors.groupBy("anchor").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).filter("a < b").select("anchor"), "anchors")
    release(spark)
    found = _emit(rows, placed, ["anchor", "block", "ord", "tag", "packed"]).join(shared, "anchor", "left_semi")
    first, off = F.shiftright("packed", 24), lambda shift: F.shiftright("packed", shift).bitwiseAND(4095)
    found = stash(found.select("anchor", "block", "ord", "tag", first.alias("first"), (first + off(12)).alias("last"), (first + off(0)).alias("place")), "blocks")
    release(spark)
    least = stash(found.groupBy("block").agg(F.min("ord").alias("least"), F.min("anchor").alias("anchor")), "firsts")
    equal = found.join(least.select("block", "least"), "block").filter("ord > least").select("ord", "tag", "first", "last")
    mixed = stash(least.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "mixed")
    open_ = found.join(least.select("block", "least"), "block").filter("ord = least").join(mixed, "anchor", "left_semi")
    # Rows of one doc_id may hold one block twice; one of them stands for it.
    open_ = open_.groupBy("ord", "tag").agg(F.collect_list(F.struct("block", "first", "last", "place")).alias("open"))
    open_ = stash(open_, "open")
    release(spark)

    def longer(row):
        text, parts = row["body"], [(b["block"], b["first"], b["last"], b["place"]) for b in row["open"]]
        block, first, last, place = (np.array(x, dtype=np.int64) for x in zip(*parts, strict=True))
        groups = [[], [], [], [], []]
        for j in range(-(-(length - ANCHOR + 1) // GROUP)):
            # Windows that start GROUP * j to GROUP * (j + 1) - 1 bytes before the anchor.
            lo, hi = np.maximum(first, place - GROUP * (j + 1) + 1), np.minimum(last, place - GROUP * j)
            some = lo <= hi
            for held, x in zip(groups, (block[some], lo[some], hi[some], np.full(int(some.sum()), j), place[some]), strict=True):
                held.append(x)
        block, lo, hi, j, at = map(np.concatenate, groups)
        # The bytes that all windows of the group share, were the group whole.
        begin, end = at - GROUP * j, np.minimum(at - GROUP * (j + 1) + 1 + length, len(text))
        name = _substrings(text, begin, end, j)
        return [block, name, lo, hi]

    bodies = rows.join(open_, ["ord", "tag"])

    def send(row):
        got = longer(row)
        n = len(got[0])
        return [*map(lambda x: x.astype(np.int64), (got[0], got[1].view(np.int64), got[2], got[3])), np.full(n, row["ord"], dtype=np.int64), np.full(n, row["tag"], dtype=np.int64)]

    wide = stash(_emit(bodies, send, ["block", "name", "lo", "hi", "ord", "tag"]), "longer")
    release(spark)
    twice = stash(wide.groupBy("name").agg(F.min("ord").alias("a"), F.max("ord").alias("b")).filter("a < b").select("name"), "twice")
    ranges = wide.join(twice, "name", "left_semi").groupBy("ord", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def whole(row):
        starts = np.unique(_spread(*(np.array(x, dtype=np.int64) for x in zip(*[(r["lo"], r["hi"]) for r in row["ranges"]], strict=True))))
        n = len(starts)
        return [_windows(row["body"], starts, length).view(np.int64), starts, np.full(n, row["ord"], dtype=np.int64), np.full(n, row["tag"], dtype=np.int64)]

    single = stash(_emit(rows.join(stash(ranges, "ranges"), ["ord", "tag"]), whole, ["name", "at", "ord", "tag"]), "windows")
    release(spark)
    first = stash(single.groupBy("name").agg(F.min("ord").alias("least"), F.max("ord").alias("b")).filter("least < b").select("name", "least"), "least")
    later = single.join(first, "name").filter("ord > least").select("ord", "tag", F.col("at").alias("first"), F.col("at").alias("last"))
    return equal.unionAll(later)


def _substrings(text: bytes, begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Names of substrings shorter than a segment, wherever they start."""
    out = np.zeros(len(begin), dtype=np.uint64)
    data = np.frombuffer(text, dtype=np.uint8)
    with np.errstate(over="ignore"):
        for base in range(0, len(data), SEGMENT):
            here = (begin >= base) & (begin < base + SEGMENT)
            if here.any():
                names = Names(data[base : base + SEGMENT + 2 * LENGTH + ANCHOR])
                out[here] = names.of(begin[here] - base, end[here] - base, salt[here] + 1)
    return out


def _cut(docs: DataFrame, length: int, kept: str, keep) -> DataFrame:
    """Counts of every row and ``kept``: what ``keep`` makes of the bytes that stay."""
    gone = stash(repeats(docs, length).groupBy("ord", "tag").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "gone")
    release(docs.sparkSession)
    gone = gone.select(F.col("ord").alias("g_ord"), F.col("tag").alias("g_tag"), "ranges")
    rows = _rows(docs)
    joined = rows.join(gone, (F.col("ord") == F.col("g_ord")) & (F.col("tag") == F.col("g_tag")), "left").select("doc_id", "body", "ranges")
    name, kind = kept.split(" ")

    def run(stream):
        import pyarrow as pa

        kinds = [pa.int64(), pa.binary() if kind == "binary" else pa.string(), pa.int64(), pa.int64(), pa.int64()]
        for batch in stream:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                ranges = part.column(2)
                ends = np.cumsum(ranges.value_lengths().fill_null(0).to_numpy())
                first, last = (f.to_numpy(zero_copy_only=False) for f in ranges.flatten().flatten())
                out, at = [], 0
                for doc_id, text, end in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ends.tolist(), strict=True):
                    mask = removed(text, first[at:end], last[at:end], length)
                    at, n = end, int(mask.sum())
                    left = np.frombuffer(text, dtype=np.uint8)[~mask].tobytes() if n else text
                    spans = int((mask[1:] > mask[:-1]).sum() + mask[:1].sum()) if n else 0
                    out.append((doc_id, keep(left), len(text), n, spans))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", name, "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, f"doc_id bigint, {kept}, n_bytes bigint, n_removed bigint, n_spans bigint")


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, kept, n_bytes, n_removed, n_spans)`` of every row; ``kept``: the bytes that stay."""
    return _cut(docs, length, "kept binary", bytes)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``deduplicate`` with the kept bytes' SHA-256 instead of the bytes."""
    cut = _cut(docs, length, "kept_sha256 string", lambda left: hashlib.sha256(left).hexdigest())
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
