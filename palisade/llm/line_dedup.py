"""Line dedup by a deletion-neighbourhood join.

A line goes if an earlier line - in a smaller document, or further up in the same one -
lies within one edit of it: one character replaced, left out or put in.  Lines under
``SHORT`` characters go only for equal lines; lines without a word stay.

Variants of a line leave characters out.  Lines within one edit agree outside some part of
them, wherever it is cut: so variants without a half are hashed first, then, of lines that
share one with another line, variants without a sixteenth, and last, inside such a part,
without a single character.  What is left out is placed from both ends, so lengths may
differ by one.  Equal hashes are joined: an equal variant lacking the same place means one
replacement, and a variant equal to a whole line means one insertion.  Each line keeps its
earliest partner only, and the edit distance of the two is verified on their characters.

Defined cases: null texts have no lines and stay null; the place of a line is ``doc_id``
(null last), then a hash of the text, then its number; rows that are alike in both are one
document and are treated alike; ``n_chars``, if there, is counted anew by ``apply``; other
columns are kept, whatever their names.  Lines are told apart by 64-bit hashes.  A line of any length is
one row.  Of lines that are equally early, as in rows alike in ``doc_id``, the hash of the text decides.  An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import release, stash, unused

SHORT = 20
PARTS = 16
#: Characters that are hashed together.
TOGETHER = 200_000
LAST = (1 << 63) - 1
#: Documents up to which their ids are broadcast: 16 bytes each.
BROADCAST_IDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
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
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


class Line:
    """A line's characters, with hashes of any two outer parts of it in constant time."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        self.n = n = len(points)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_mix(points + np.uint64(1)) * _powers(_BASE, n + 1)[:n], out=self.sums[1:])

    def outside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of what is left without ``[start, end)``; by content alone, wherever the gap was."""
        shift = _powers(_INVERSE, self.n + 1)[end - start]
        return self.sums[start] + (self.sums[self.n] - self.sums[end]) * shift

    def whole(self) -> int:
        return int(_mix(self.sums[self.n :] + np.uint64(self.n) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)[0])

    def gaps(self, m: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the parts of a length ``m`` lie in this line, whose length is ``m`` or one more."""
        cut = np.arange(parts + 1) * m // parts
        return cut[:-1], self.n - (m - cut[1:])

    def coarse(self, m: int, parts: int) -> np.ndarray:
        """Names of the line without each part."""
        start, end = self.gaps(m, parts)
        return _mix(self.outside(start, end) + np.uint64(m * 64 + parts) * np.uint64(0xD6E8FEB86659FD93) + np.arange(parts, dtype=np.uint64)).view(np.int64)


def _keys(text: str, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of a line without each part, the length that was cut, and the part, for partners of its length or longer and for shorter ones."""
    with np.errstate(over="ignore"):
        line = Line(text)
        both = [line.coarse(m, parts) for m in (line.n, line.n - 1)]
    return np.concatenate(both), np.repeat([line.n, line.n - 1], parts), np.tile(np.arange(parts), 2)


def _fine(text: str, found: list[tuple[int, int]], parts: int) -> list[tuple[int, str]]:
    """Variants lacking one character inside the given ``(length, part)``: replaced (``s``) or left out (``d``); the whole line is ``w``."""
    out = []
    with np.errstate(over="ignore"):
        line = Line(text)
        for m, part in found:
            start, end = line.gaps(m, parts)
            at = np.arange(start[part], end[part])
            gone = line.outside(at, at + 1)
            if m == line.n:
                named = _mix(gone + np.uint64(m) * np.uint64(0xD6E8FEB86659FD93) + _mix(at.astype(np.uint64) + np.uint64(7)))
                out += [(x, "s") for x in named.view(np.int64).tolist()]
            else:
                named = _mix(gone + np.uint64(m) * np.uint64(0xD6E8FEB86659FD93))
                out += [(x, "d") for x in set(named.view(np.int64).tolist())]
        if any(m == line.n for m, _ in found):
            out.append((line.whole(), "w"))
    return out


def within_one(a: str, b: str) -> bool:
    """Whether one edit at most turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def _lines(text: str) -> list[tuple[int, str]]:
    """Numbered lines that hold a word."""
    return [(k, x) for k, x in enumerate(text.split("\n")) if x.strip()]


def _rows(docs: DataFrame) -> DataFrame:
    body = F.col("text")
    return docs.filter("text is not null").select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64(body).alias("tag"), body.alias("body"))


def _stream(df: DataFrame, make, schema: str) -> DataFrame:
    """Map lists of rows to columns: ``make`` gets dicts and returns one list per column."""

    def run(stream):
        import pyarrow as pa

        names, kinds = zip(*[f.split(" ") for f in schema.split(", ")], strict=True)
        kinds = [pa.int64() if k == "bigint" else pa.int32() if k == "int" else pa.string() for k in kinds]
        for batch in stream:
            for start in range(0, batch.num_rows, 256):
                columns = make(batch.slice(start, 256).to_pylist())
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return df.mapInArrow(run, schema)


def _hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line.encode()) - (1 << 63)


def _numbered(rows):
    columns = [[], [], [], []]
    for row in rows:
        for k, line in _lines(row["body"]):
            for held, x in zip(columns, (_hash(line), row["ord"], row["tag"], k), strict=True):
                held.append(x)
    return columns


def _half_keys(lines: list[str]) -> np.ndarray:
    """``coarse(m, 2)`` of many lines at once, four keys a line: without either half, for partners as long or longer, and for shorter ones."""
    with np.errstate(over="ignore"):
        points = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        n = np.array([len(x) for x in lines])
        begin = np.cumsum(n) - n
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(_mix(points + np.uint64(1)) * _powers(_BASE, len(points))[: len(points)], out=sums[1:])
        down = _powers(_INVERSE, len(points) + 1)
        since = lambda at: (sums[begin + at] - sums[begin]) * down[begin]
        whole, out = since(n), []
        for m in (n, n - 1):
            cut = m // 2
            tag = (m * 64 + 2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for part, (start, end) in enumerate(((np.zeros_like(n), n - m + cut), (cut, n))):
                out.append(_mix(since(start) + (whole - since(end)) * down[end - start] + tag + np.uint64(part)))
    return np.stack(out, axis=1).view(np.int64).ravel()


def _halves(rows):
    """``(key, line)`` of long lines, each line of a batch once."""
    seen: dict[int, str] = {}
    for row in rows:
        for _, line in _lines(row["body"]):
            if len(line) >= SHORT:
                seen[_hash(line)] = line
    keys, part, held = [np.zeros(0, dtype=np.int64)], [], 0
    for line in seen.values():
        part.append(line)
        held += len(line)
        if held > TOGETHER:
            keys.append(_half_keys(part))
            part, held = [], 0
    if part:
        keys.append(_half_keys(part))
    return [np.concatenate(keys), np.repeat(np.array(list(seen), dtype=np.int64), 4)]


def _shared(pairs: DataFrame, label: str) -> DataFrame:
    """Keys that two different lines have."""
    return stash(pairs.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a < b").select("key"), label)


def _neighbours(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``(line, other)``: of each line with a partner within one edit that comes first, the first such partner."""
    spark = rows.sparkSession
    halves = _stream(rows.select("body"), _halves, "key bigint, line bigint")
    open_ = stash(halves.join(_shared(halves, "halves"), "key", "left_semi").select("line").distinct(), "open")
    release(spark)
    # Text of the lines that are left, from their first places.
    where = stash(first.join(open_, "line", "left_semi").groupBy("ord", "tag").agg(F.collect_list("no").alias("nos")), "where")
    near = F.broadcast(where) if where.count() <= BROADCAST_IDS // 8 else where

    def fetch(rows):
        columns = [[], []]
        for row in rows:
            lines = row["body"].split("\n")
            for k in row["nos"]:
                columns[0].append(_hash(lines[k]))
                columns[1].append(lines[k])
        return columns

    # Rows alike in id and text give a line twice.
    texts = stash(_stream(rows.join(near, ["ord", "tag"]), fetch, "line bigint, body string").dropDuplicates(["line"]), "texts")
    release(spark)

    def sixteenths(rows):
        keys = [_keys(r["body"], PARTS) for r in rows]
        return [np.concatenate([k[i] for k in keys]) for i in range(3)] + [np.repeat([r["line"] for r in rows], 2 * PARTS)]

    parts = _stream(texts, sixteenths, "key bigint, m bigint, part bigint, line bigint")
    found = parts.join(_shared(parts, "parts"), "key", "left_semi").groupBy("line").agg(F.collect_set(F.struct("m", "part")).alias("found"))
    found = stash(texts.join(found, "line"), "found")
    release(spark)

    def variants(rows):
        columns = [[], [], []]
        for r in rows:
            for key, kind in _fine(r["body"], [(x["m"], x["part"]) for x in r["found"]], PARTS):
                columns[0].append(key)
                columns[1].append(kind)
                columns[2].append(r["line"])
        return columns

    placed = first.select("line", F.struct("ord", "tag", "no").alias("at"))
    fine = stash(_stream(found, variants, "key bigint, kind string, line bigint").join(placed, "line"), "variants")
    release(spark)
    # One place replaced: all lines of a key are partners. One left out: those that leave it out and the whole line are, not those among themselves.
    least = fine.groupBy(F.col("key").alias("k_key"), F.col("kind").alias("k_kind")).agg(F.min(F.struct("at", "line")).alias("best"), F.count("*").alias("n"))
    turned = F.when(F.col("k_kind") == "d", "w").when(F.col("k_kind") == "w", "d").otherwise("s")
    least = stash(least.withColumn("for", turned).filter("for <> 's' or n > 1"), "least")
    met = fine.join(least, (F.col("key") == F.col("k_key")) & (F.col("kind") == F.col("for"))).filter("best.at < at")
    best = met.groupBy("line").agg(F.min("best").alias("best")).select("line", F.col("best.line").alias("other"))
    other = texts.select(F.col("line").alias("other"), F.col("body").alias("other_body"))
    pairs = best.join(texts, "line").join(other, "other").select("line", "other", "body", "other_body")

    def verified(rows):
        kept = [r for r in rows if within_one(r["body"], r["other_body"])]
        return [[r["line"] for r in kept], [r["other"] for r in kept]]

    return _stream(pairs, verified, "line bigint, other bigint")


def removed(docs: DataFrame) -> DataFrame:
    """``(ord, tag, gone)``: of each document that loses lines, their numbers."""
    rows = _rows(docs)
    places = _stream(rows, _numbered, "line bigint, ord bigint, tag bigint, no int")
    first = places.groupBy("line").agg(F.min(F.struct("ord", "tag", "no")).alias("at")).select("line", "at.*")
    first = stash(first, "first")
    release(docs.sparkSession)
    late = stash(_neighbours(rows, first).select("line", F.lit(True).alias("late")), "late")
    release(docs.sparkSession)
    named = first.select("line", F.struct("ord", "tag", "no").alias("at")).join(late, "line", "left")
    named = stash(named, "named")
    gone = places.join(named, "line").filter(F.coalesce("late", F.lit(False)) | (F.struct("ord", "tag", "no") != F.col("at")))
    return gone.groupBy("ord", "tag").agg(F.collect_set("no").alias("gone"))


def _cut(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with what is left of each text and the numbers of the lines that went, and the names of these two columns."""
    x_ord, x_tag, x_gone, x_text = unused(docs.columns, "x_ord", "x_tag", "x_gone", "x_text")
    gone = stash(removed(docs), "gone").select(F.col("ord").alias(x_ord), F.col("tag").alias(x_tag), F.sort_array("gone").alias(x_gone))
    release(docs.sparkSession)
    place = (F.coalesce(docs["doc_id"], F.lit(LAST)) == F.col(x_ord)) & (F.xxhash64(docs["text"]) == F.col(x_tag))
    lines, lost = F.split(docs["text"], "\n"), F.col(x_gone)
    # Runs of lines between those that go.
    runs = F.transform(F.concat(F.array(F.lit(-1)), lost), lambda k, i: F.slice(lines, k + 2, F.coalesce(F.get(lost, i), F.size(lines)) - k - 1))
    text = F.when(lost.isNull(), docs["text"]).otherwise(F.array_join(F.flatten(runs), "\n"))
    return docs.join(gone, place, "left").withColumn(x_text, text), x_text, x_gone


def apply(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, each text without the lines that go."""
    cut, text, _ = _cut(docs)
    new = {"text": F.col(text).alias("text"), "n_chars": F.length(text).cast("bigint").alias("n_chars")}
    return cut.select(*[new.get(c, docs[c]) for c in docs.columns])


def summary(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_removed, kept_sha256)`` of every row; null texts: no lines, hash of nothing."""
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    cut, text, gone = _cut(docs.select("doc_id", "text"))
    return cut.select(
        "doc_id", lines.cast("bigint").alias("n_lines"), F.coalesce(F.array_size(gone), F.lit(0)).cast("bigint").alias("n_removed"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256"),
    )
