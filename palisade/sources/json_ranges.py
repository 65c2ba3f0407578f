"""The elements of a JSON document of any size and layout, read in parallel by byte ranges.

Where a range starts inside a document, a quote may open or close a string, and a bracket in a
string is none.  So ranges are read twice.  First each counts its quotes, and sums its brackets both for the
case that it starts outside of a string and for the case that it starts inside: what is outside in one
case is inside in the other.  Sums over the ranges before then tell the state in which each starts.
Second, each range gives the elements that start in it, reading on to the end of its last one.  Who wants one list
reads the ranges of it, as often as needed: no copy of the elements is kept.

No task holds more than a few ranges and one element; the driver holds nothing.  Ranges may span the files of a
folder, which count as one document in the order of their names if no element is torn between two.

A file may be compressed, which its name tells.  Its ranges are those of its text, which is read from the front only, so one
task reads all of a file, range after range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.sources.files import open_file

RANGE = 8 << 20
#: Codecs of compressed files by the end of their name.
PACKED = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}
_QUOTE, _BACKSLASH = 34, 92
#: Depths of brackets: the document, its lists, their elements.
_LISTS, _ELEMENTS = 2, 3


def _read(file, start: int, n: int) -> bytes:
    file.seek(start)
    return file.read(n)


class Unpacked:
    """The text of a compressed file.  What was read last is held for steps back; one that goes further reads the file anew."""

    def __init__(self, path: str, codec: str, back: int = RANGE):
        self.path, self.codec, self.back = path, codec, back
        self.file, self.place = None, 0
        self._open()

    def _open(self) -> None:
        self.close()
        self.file = open_file(self.path)
        self.stream, self.held, self.first = pa.CompressedInputStream(self.file, self.codec), bytearray(), 0

    def seek(self, place: int) -> None:
        self.place = place

    def read(self, n: int) -> bytes:
        if self.place < self.first:
            self._open()
        while self.first + len(self.held) < self.place + n and (more := self.stream.read(1 << 20)):
            self.held += more
            gone = min(len(self.held), self.place - self.back - self.first)
            if gone > 0:
                del self.held[:gone]
                self.first += gone
        start = self.place - self.first
        self.place += n
        return bytes(self.held[start : start + n])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()

    def __enter__(self) -> Unpacked:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _codec(path: str) -> str | None:
    return next((codec for end, codec in PACKED.items() if path.endswith(end)), None)


def _text_of(path: str):
    """A file to seek and read in, as it is or unpacked."""
    codec = _codec(path)
    return Unpacked(path, codec) if codec else open_file(path)


def _carried(file, start: int) -> int:
    """How many backslashes stand right before a place."""
    n, step = 0, 4096
    while start - n > 0:
        before = _read(file, max(0, start - n - step), min(step, start - n))
        own = len(before) - len(before.rstrip(b"\\"))
        n += own
        if own < len(before):
            break
    return n


def _marks(data: bytes, carried: int, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of quotes that bound strings, and places and signs (1 opens, -1 closes) of brackets that are outside of strings."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == _QUOTE)
    if carried or (b == _BACKSLASH).any():
        # a quote after an odd run of backslashes is a letter
        last = np.maximum.accumulate(np.where(b != _BACKSLASH, np.arange(len(b), dtype=np.int32), np.int32(-1)))
        before = np.where(quotes > 0, last[quotes - 1], -1)
        run = quotes - 1 - before + np.where(before < 0, carried, 0)
        quotes = quotes[run % 2 == 0]
    brackets = np.flatnonzero((b == 123) | (b == 125) | (b == 91) | (b == 93))
    outside = (np.searchsorted(quotes, brackets) + inside) % 2 == 0
    brackets = brackets[outside]
    return quotes, brackets, np.where((b[brackets] == 123) | (b[brackets] == 91), 1, -1)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range; a compressed file comes as its first one."""
    for batch in batches:
        for r in batch.to_pylist():
            with _text_of(r["path"]) as file:
                rows = list(_summed(file, r))
            yield pa.RecordBatch.from_pylist(rows, schema=_SUMMARY_ARROW)


def _summed(file, r: dict) -> Iterator[dict]:
    start = r["start"]
    while data := _read(file, start, r["n"]):
        carried = _carried(file, start)
        quotes, _, signs = _marks(data, carried, False)
        yield {"path": r["path"], "start": start, "n": len(data), "quotes": len(quotes), "outside": int(signs.sum()), "inside": int(_marks(data, carried, True)[2].sum())}
        start += len(data)
        if _codec(r["path"]) is None:
            break


_SUMMARY = "path string, start bigint, n bigint, quotes bigint, outside bigint, inside bigint"
_SUMMARY_ARROW = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("start", "n", "quotes", "outside", "inside"))])
_ELEMENT = "place bigint, kind string, text string"


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(place, kind, text)``: keys of the document's lists (``list``) and the elements of lists (``element``)."""
    return _rows(batches, _found)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _rows(batches, _found_lists)


def _rows(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    path, file = None, None
    try:
        for batch in batches:
            for r in batch.to_pylist():
                if path != r["path"]:
                    if file is not None:
                        file.close()
                    path, file = r["path"], _text_of(r["path"])
                found = list(of(file, r))
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["place", "kind", "text"])
    finally:
        if file is not None:
            file.close()


def _found_lists(file, r: dict) -> Iterator[tuple[int, str, str]]:
    start = r["start"]
    _, places, signs = _marks(_read(file, start, r["n"]), _carried(file, start), bool(r["in_string"]))
    for at in np.flatnonzero((signs > 0) & (r["depth"] + np.cumsum(signs) == _LISTS)):
        yield r["base"] + start + int(places[at]), "list", _key_before(file, start + int(places[at]))


def _found(file, r: dict) -> Iterator[tuple[int, str, str]]:
    start, n, n_more = r["start"], r["n"], 1 << 16
    carried, data = _carried(file, start), _read(file, start, n)
    while True:
        _, places, signs = _marks(data, carried, bool(r["in_string"]))
        depth = r["depth"] + np.cumsum(signs)
        opens = np.flatnonzero((signs > 0) & (places < n))
        starts = opens[depth[opens] == _ELEMENTS]
        # the end of each element that starts here: the next bracket that leads back to its list
        ends = np.flatnonzero((signs < 0) & (depth == _LISTS))
        end = np.searchsorted(ends, starts)
        if not len(starts) or end[-1] < len(ends):
            break
        more = _read(file, start + len(data), n_more)
        if not more:
            break
        data, n_more = data + more, n_more * 2
    for at in opens[depth[opens] == _LISTS]:
        yield r["base"] + start + int(places[at]), "list", _key_before(file, start + int(places[at]))
    for at, to in zip(starts, end):
        if to < len(ends):
            yield r["base"] + start + int(places[at]), "element", data[places[at] : places[ends[to]] + 1].decode("utf-8", "replace")


def _key_before(file, place: int) -> str:
    """The text of the last string before a list."""
    before = _read(file, max(0, place - 4096), min(4096, place)).decode("utf-8", "replace").rstrip().removesuffix(":").rstrip()
    return before[:-1].rsplit('"', 1)[-1] if before.endswith('"') else ""


def ranges(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The ranges of a document, a row for each, with the state in which it starts."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    # a row for each compressed file or range, then for each range
    last = F.when(_packed(), F.lit(0).cast("bigint")).otherwise(F.col("size") - 1)
    starts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(range_bytes).cast("bigint"))).alias("start"))
    n = F.when(_packed(), F.lit(range_bytes)).otherwise(F.least(F.lit(range_bytes), F.col("size") - F.col("start"))).cast("bigint")
    summed = _dealt(starts.select("path", "start", n.alias("n"))).mapInArrow(_summary, _SUMMARY)
    earlier = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    own = F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside"))
    states = summed.withColumn("in_string", before("quotes") % 2).withColumn("depth", before(own)).withColumn("base", before("n") - F.col("start"))
    return states.select("path", "start", "n", "base", "in_string", "depth")


def _packed() -> Column:
    return reduce(Column.__or__, [F.col("path").endswith(end) for end in PACKED])


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of ranges over all tasks, those of a compressed file in one: they are small, but stand for much, so their number is not left to their size."""
    deal = F.when(_packed(), F.lit(0).cast("bigint")).otherwise(F.col("start"))
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("path"), deal).sortWithinPartitions("path", "start")


def elements_of(cut: DataFrame) -> DataFrame:
    """``(place, kind, text)`` of :func:`ranges`, or of some of them: what starts in them, as :func:`elements` gives it."""
    return _dealt(cut).mapInArrow(_elements, _ELEMENT)


def lists_of(cut: DataFrame) -> DataFrame:
    """The rows ``list`` of :func:`elements_of` alone; no text of an element is made."""
    return _dealt(cut).mapInArrow(_lists, _ELEMENT)


def elements(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``(place, kind, text)``: of the document's top object, a row ``list`` with the key of each value that is a list
    (or an object), and a row ``element`` with the text of each object in them, in the order of ``place``."""
    return elements_of(ranges(spark, path, range_bytes))


__all__ = ["RANGE", "elements", "elements_of", "lists_of", "ranges"]
