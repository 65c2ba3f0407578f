"""Files of a tree: listed without what is not wanted, then read once, in parallel.

Spark's file sources leave out names that start with a dot or an underscore, which source trees are
full of (``__init__.py``), and list what is pruned later.  So a tree is walked through ``pyarrow.fs``, in a
task: folders that are skipped are not entered.  Only the files that are kept are opened, each by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "path string, file_path string, size_bytes bigint"
CONTENT = f"{LISTED}, content binary"
#: Bytes of content in a batch of files, about.
_BATCH = 16 << 20


def store_of(path: str):
    """File system of ``pyarrow.fs`` and place, of a path as Spark writes it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def open_file(path: str):
    store, place = store_of(path)
    return store.open_input_file(place)


def read_small(path: str) -> str | None:
    """The text of a small file, None if there is none."""
    try:
        with open_file(path) as file:
            return file.read().decode("utf-8", "replace")
    except (FileNotFoundError, NotADirectoryError, IsADirectoryError, OSError):
        return None


def _walk(root: str, skipped: frozenset[str]) -> Iterator[tuple[str, str, int]]:
    from pyarrow import fs

    store, top = store_of(root)
    top = top.rstrip("/")
    base = root.rstrip("/")
    open_ = [top]
    while open_:
        for entry in sorted(store.get_file_info(fs.FileSelector(open_.pop())), key=lambda e: e.path):
            if entry.type == fs.FileType.Directory and entry.base_name not in skipped:
                open_.append(entry.path)
            elif entry.type == fs.FileType.File:
                rel = entry.path[len(top) + 1 :]
                yield f"{base}/{rel}", rel, entry.size


def list_tree(spark: SparkSession, folder: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """``(path, file_path, size_bytes)`` of all files below a folder but those in folders named in ``skipped``."""
    pruned = frozenset(skipped)

    def walk(batches):
        for batch in batches:
            for root in batch.column("root").to_pylist():
                rows = []
                for row in _walk(root, pruned):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _listed(rows)
                        rows = []
                if rows:
                    yield _listed(rows)

    return spark.range(1).select(F.lit(folder).alias("root")).mapInArrow(walk, LISTED)


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    paths, rels, sizes = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(rels), pa.array(sizes, pa.int64())], ["path", "file_path", "size_bytes"])


def read_contents(listed: DataFrame) -> DataFrame:
    """``listed`` with the ``content`` of each file."""

    def read(batches):
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                with open_file(row["path"]) as file:
                    row["content"] = file.read()
                rows.append(row)
                held += len(row["content"])
                if held > _BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("path", pa.string()), ("file_path", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary())])
    # by path, so that a lost task opens the same files again
    return listed.select("path", "file_path", "size_bytes").repartition("path").mapInArrow(read, CONTENT)


def write_files(files: DataFrame, folder: str) -> None:
    """Write ``(file_path, source)`` as files below a folder, each by one task; writing one twice leaves it as it is."""

    def write(batches):
        for batch in batches:
            store, top = store_of(folder)
            for row in batch.to_pylist():
                place = f"{top}/{row['file_path']}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(place, compression=None) as out:
                    out.write(row["source"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.select("file_path", "source").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
