"""Token ids in raw binary shards, with a minimal perfect hash index.

``write`` orders documents by ``doc_id``, encodes them and cuts each task's ids into shards
of bounded size.  Shards and index buckets are raw files that Spark's writer puts in the
folder, so any store that Spark reaches will do, and a lost task is written again.

A shard file: magic, id width, numbers of documents and ids, then per document its key,
whether the key is null, its number of ids, then all ids, little-endian.  Ids take two bytes
if the vocabulary has at most 65,536 of them, else four.

Keys are hashed to buckets; a bucket's file holds a minimal perfect hash - levels of bits, a
key's slot being the number of bits set before its own - and by slot a fingerprint, the
shard, the place in it and the number of ids.  A lookup hashes the key, finds the slot and
compares the fingerprint: constant time, one bucket and one shard read.

Defined cases: null texts count as empty (the end id alone); rows that share a ``doc_id`` lie
side by side, ordered by text, and the index leads to the first; a null ``doc_id`` comes
last and is not in the index; an empty table gives no shard.  Other columns are not read.
"""

from __future__ import annotations

import zlib
from unicodedata import is_normalized

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import in_arrow, public_vocabulary

MAGIC, INDEX_MAGIC = b"IDSHARD1", b"IDINDEX1"
#: Bytes of ids from which a shard is closed.
SHARD_BYTES = 8 << 20
#: Documents of an index bucket, on average.
BUCKET_KEYS = 50_000
#: Bytes of texts that are encoded together.
PART_BYTES = 4 << 20
#: Stems of words a worker remembers, and tails or words without a plain stem; a full memory keeps what the last part holds.
REMEMBERED, REMEMBERED_WHOLE = 450_000, 150_000
END = 1
_TAIL = ".,!?;:*#$%&)"


def _spans(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``flat[start : start + size]`` one after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - ends + sizes, sizes)
    at += np.arange(len(at))
    return flat[at]


def _plain(stem: str) -> bool:
    """Whether the normalizer does nothing but lower-case these letters, one by one."""
    return stem.isalpha() and "Σ" not in stem and "İ" not in stem and is_normalized("NFC", stem)


class Encoder:
    """The tokenizers library word by word: a word's ids don't depend on what white space sets off.

    Words are counted off in Arrow; the library sees each distinct stem, tail or odd word of a part that is not remembered.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        # The same model without the passes that leave a lower-case word of composed letters as it is.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        #: Ids of stems, None for one that is not plain, of tails, and of whole words whose stem is not plain.
        self.known: dict[str, bytes | None] = {"": b""}
        self.tails: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}

    def _one_by_one(self, parts: list[str]) -> list[bytes]:
        # Not as a batch, whose threads wait for each other at a processor's cost.
        return [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, dtype=self.dtype).tobytes() for x in parts]

    def _letters(self, parts: list[str]) -> list[bytes]:
        """Words of letters only, which have one closing token each, as one text."""
        ids = np.array(self.letters.encode(" ".join(parts), add_special_tokens=False).ids, dtype=self.dtype)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(parts) or stops[-1] != len(ids):
            return self._one_by_one(parts)
        raw, ends = ids.tobytes(), (stops * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _stems(self, stems: list[str]) -> list[bytes | None]:
        known = self.known
        lower = {stem: stem.lower() if _plain(stem) else None for stem in stems if stem not in known}
        letters = list({low for low in lower.values() if low and known.get(low) is None})
        learned: dict[str, bytes] = {}
        for start in range(0, len(letters), 1000):
            part = letters[start : start + 1000]
            learned.update(zip(part, self._letters(part), strict=True))
        for stem, low in lower.items():
            known[stem] = low and (learned.get(low) or known[low])
        got = list(map(known.__getitem__, stems))
        if len(known) > REMEMBERED:
            self.known = {"": b""} | dict(zip(stems, got, strict=True))
        return got

    def _once(self, memory: dict[str, bytes], parts: list[str]) -> list[bytes]:
        """Ids of distinct parts."""
        new = [x for x in parts if x not in memory]
        memory.update(zip(new, self._one_by_one(new), strict=True))
        got = {x: memory[x] for x in parts}
        if len(memory) > REMEMBERED_WHOLE:
            memory.clear()
            memory.update(got)
        return list(got.values())

    def _distinct(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each has: those of its stem and its tail, or of the whole."""
        import pyarrow.compute as pc

        trimmed = pc.ascii_rtrim(words, _TAIL)
        coded = trimmed.dictionary_encode()
        pieces = self._stems(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        first, second = coded.indices.to_numpy().astype(np.int64), np.zeros(len(words), dtype=np.int64)
        odd = np.array([x is None for x in pieces], dtype=bool)[first]
        tail = np.where(odd, 0, pc.subtract(pc.binary_length(words), pc.binary_length(trimmed)).to_numpy())
        tailed, odd = np.flatnonzero(tail), np.flatnonzero(odd)
        tails = [word[-n:] for word, n in zip(words.take(tailed).to_numpy(zero_copy_only=False).tolist(), tail[tailed].tolist(), strict=True)]
        place = {x: len(pieces) + i for i, x in enumerate(dict.fromkeys(tails))}
        second[tailed] = [place[x] for x in tails]
        pieces += self._once(self.tails, list(place))
        first[odd] = len(pieces) + np.arange(len(odd))
        pieces += self._once(self.whole, words.take(odd).to_numpy(zero_copy_only=False).tolist())
        pieces = [x or b"" for x in pieces]
        sizes = np.array([len(x) for x in pieces], dtype=np.int64) // self.width
        starts = np.cumsum(sizes) - sizes
        lengths = np.column_stack([sizes[first], np.where(tail > 0, sizes[second], 0)])
        flat = np.frombuffer(b"".join(pieces), dtype=self.dtype)
        return _spans(flat, np.column_stack([starts[first], starts[second]]).ravel(), lengths.ravel()), lengths.sum(axis=1)

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow array with the end id, in ``width`` bytes each; a null has the end id alone."""
        import pyarrow.compute as pc

        rows = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = rows.flatten().dictionary_encode()
        flat, sizes = self._distinct(words.dictionary)
        # The end id is one word more, which follows each text.
        flat, sizes = np.append(flat, np.array([END], dtype=self.dtype)), np.append(sizes, 1)
        starts, stops = np.cumsum(sizes) - sizes, rows.offsets.to_numpy()[1:]
        at = np.insert(words.indices.to_numpy(), stops, len(sizes) - 1)
        sizes = sizes[at]
        raw = _spans(flat, starts[at], sizes).tobytes()
        ends = (np.cumsum(sizes)[stops + np.arange(len(stops))] * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    if (path, added_tokens) not in _ENCODERS:
        _ENCODERS[path, added_tokens] = Encoder(path, added_tokens)
    return _ENCODERS[path, added_tokens]


def _parts(batch):
    """A batch in slices of some ``PART_BYTES`` of texts."""
    import pyarrow.compute as pc

    number = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64) // PART_BYTES
    stops = [*(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for start, stop in zip([0, *stops], stops, strict=False):
        yield batch.slice(start, stop - start)


# --- shards ----------------------------------------------------------------------


def pack(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    sizes = np.array([len(x) // width for x in ids], dtype="<u4")
    head = np.array([width, len(ids), int(sizes.sum(dtype=np.int64))], dtype="<u8")
    names = np.array([0 if k is None else k for k in keys], dtype="<i8")
    missing = np.array([k is None for k in keys], dtype=np.uint8)
    return b"".join([MAGIC, head.tobytes(), names.tobytes(), missing.tobytes(), sizes.tobytes(), *ids])


class Shard:
    """A shard file's parts, as views of its bytes."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a shard")
        width, n, total = np.frombuffer(content, "<u8", 3, 8).tolist()
        at = 32
        self.keys = np.frombuffer(content, "<i8", n, at)
        self.missing = np.frombuffer(content, np.uint8, n, at + 8 * n).astype(bool)
        self.sizes = np.frombuffer(content, "<u4", n, at + 9 * n).astype(np.int64)
        self.ids = np.frombuffer(content, f"<u{width}", total, at + 13 * n)
        self.offsets = np.cumsum(self.sizes) - self.sizes


def _raw(df: DataFrame, path: str, by: str) -> None:
    """Write one file per row of ``(by, content)``; each ends in one newline more."""
    df.select(by, F.col("content").cast("string").alias("value")).write.partitionBy(by).option("compression", "none").text(path)


def _files(spark: SparkSession, path: str, by: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.regexp_extract("path", rf"/{by}=(\d+)/", 1).cast("long").alias(by), "content")


def write(docs: DataFrame, folder: str, path: str | None = None, shard_bytes: int = SHARD_BYTES, added_tokens: bool = False) -> None:
    """Encode ``docs`` and write ``folder/shards`` and ``folder/index``.

    With ``added_tokens``, the library's default, a text's ``<|endoftext|>`` is that token; else it is plain text.
    """
    spark = docs.sparkSession
    path = path or public_vocabulary("word_bpe_49k.json")
    ordered = docs.select("doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ordered = ordered.repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)

    def cut(stream):
        import pyarrow as pa

        own, number = encoder(path, added_tokens), TaskContext.get().partitionId() << 24
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def row():
            return pa.RecordBatch.from_pydict({"shard": [number], "content": [pack(keys, ids, own.width)]}, schema=pa.schema([("shard", pa.int64()), ("content", pa.binary())]))

        for batch in stream:
            for part in _parts(batch):
                for key, one in zip(part.column(0).to_pylist(), own.encode(part.column(1)), strict=True):
                    keys.append(key)
                    ids.append(one)
                    held += len(one)
                    if held >= shard_bytes:
                        yield row()
                        keys, ids, held, number = [], [], 0, number + 1
        if keys:
            yield row()

    _raw(ordered.mapInArrow(cut, "shard bigint, content binary"), f"{folder}/shards", "shard")
    placed = scan(spark, folder).filter("doc_id is not null")
    first = placed.groupBy("doc_id").agg(F.min(F.struct("shard", "offset", "n_tokens")).alias("at"))
    buckets = max(1, -(-placed.count() // BUCKET_KEYS))
    rows = first.select("doc_id", "at.*", _bucket("doc_id", buckets).alias("bucket"))

    def build(key, frame):
        import pandas as pd

        return pd.DataFrame({"bucket": [key[0]], "content": [build_index(*(frame[c].to_numpy() for c in ("doc_id", "shard", "offset", "n_tokens")))]})

    _raw(rows.groupBy("bucket").applyInPandas(build, "bucket bigint, content binary"), f"{folder}/index", "bucket")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards: ``(doc_id, shard, offset, n_tokens, ids_crc32)``; ``offset`` counts ids within the shard."""

    def run(rows):
        for row in rows:
            own = Shard(row["content"])
            wide = own.ids.astype("<u4")
            for key, missing, at, n in zip(own.keys.tolist(), own.missing.tolist(), own.offsets.tolist(), own.sizes.tolist(), strict=True):
                yield {"doc_id": None if missing else key, "shard": row["shard"], "offset": at, "n_tokens": n, "ids_crc32": zlib.crc32(wide[at : at + n])}

    schema = "doc_id bigint, shard bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    return in_arrow(_shard_files(spark, folder), run, schema, max_rows=1)


def _shard_files(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return _files(spark, f"{folder}/shards", "shard")
    except Exception as error:  # an empty table leaves a folder without files
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        return spark.createDataFrame([], "shard bigint, content binary")


def starts(placed: DataFrame) -> DataFrame:
    """``scan``'s rows with ``start``, the ids of all documents before; one small row per shard is added up in order."""
    totals = placed.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = totals.select(F.col("shard").alias("b_shard"), before.alias("before"))
    return placed.join(first, F.col("shard") == F.col("b_shard")).withColumn("start", F.col("before") + F.col("offset")).drop("b_shard", "before")


# --- the index ---------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def build_index(keys: np.ndarray, shards: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> bytes:
    """One bucket's file from distinct keys and what they lead to."""
    levels, left = [], keys
    while len(left):
        words = max(1, len(left) * 2 // 64 + 1)
        at = (_mix(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
        alone = np.bincount(at, minlength=words * 64) == 1
        levels.append(np.packbits(alone, bitorder="little").view("<u8"))
        left = left[~alone[at]]
    body = [INDEX_MAGIC, np.array([len(keys), len(levels)] + [len(x) for x in levels], dtype="<u8").tobytes()]
    bits = np.concatenate(levels) if levels else np.zeros(0, "<u8")
    ranks = np.cumsum(np.bitwise_count(bits), dtype=np.uint64) - np.bitwise_count(bits)
    body += [bits.tobytes(), ranks.astype("<u4").tobytes()]
    slots = _slots(keys, [len(x) for x in levels], bits, ranks)
    order = np.argsort(slots)
    fingerprints = (_mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")
    body += [fingerprints[order].tobytes(), shards[order].astype("<i8").tobytes(), offsets[order].astype("<i8").tobytes(), sizes[order].astype("<u4").tobytes()]
    return b"".join(body)


def _slots(keys: np.ndarray, words: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Each key's slot; -1 for keys that no level holds."""
    out, base, open_ = np.full(len(keys), -1, dtype=np.int64), 0, np.arange(len(keys))
    for level, n in enumerate(words):
        at = (_mix(keys[open_], level) % np.uint64(n * 64)).astype(np.int64)
        word, bit = base + at // 64, (at % 64).astype(np.uint64)
        held = (bits[word] >> bit) & np.uint64(1) == 1
        below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
        out[open_[held]] = (ranks[word].astype(np.int64) + np.bitwise_count(below))[held]
        open_, base = open_[~held], base + n
    return out


class Index:
    """A bucket's file, ready for lookups."""

    def __init__(self, content: bytes):
        if content[:8] != INDEX_MAGIC:
            raise ValueError("not an index")
        self.n, n_levels = np.frombuffer(content, "<u8", 2, 8).tolist()
        self.words = np.frombuffer(content, "<u8", n_levels, 24).tolist()
        at, total = 24 + 8 * n_levels, sum(self.words)
        self.bits, self.ranks = np.frombuffer(content, "<u8", total, at), np.frombuffer(content, "<u4", total, at + 8 * total)
        at += 12 * total
        self.fingerprints = np.frombuffer(content, "<u4", self.n, at)
        self.shards, self.offsets = np.frombuffer(content, "<i8", self.n, at + 4 * self.n), np.frombuffer(content, "<i8", self.n, at + 12 * self.n)
        self.sizes = np.frombuffer(content, "<u4", self.n, at + 20 * self.n)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each key: whether it is known, its shard, offset and number of ids."""
        slots = _slots(keys, self.words, self.bits, self.ranks)
        known = slots >= 0
        slots = np.where(known, slots, 0)
        if self.n:
            known &= self.fingerprints[slots] == (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)
        return known, self.shards[slots], self.offsets[slots], self.sizes[slots]


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.lit(3), key), F.lit(buckets)).cast("long")


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, shard, offset, n_tokens)`` of those of the distinct ``doc_id`` that the index knows."""
    spark = keys.sparkSession
    try:
        index = _files(spark, f"{folder}/index", "bucket")
        buckets = (index.agg(F.max("bucket")).first()[0] or 0) + 1
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        return spark.createDataFrame([], "doc_id bigint, shard bigint, offset bigint, n_tokens bigint")
    own = keys.select("doc_id").filter("doc_id is not null").distinct().withColumn("bucket", _bucket("doc_id", buckets))

    def find(wanted, held):
        import pandas as pd

        if not len(held) or not len(wanted):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("doc_id", "shard", "offset", "n_tokens")})
        names = wanted["doc_id"].to_numpy()
        known, shards, offsets, sizes = Index(bytes(held["content"].iloc[0])).find(names)
        return pd.DataFrame({"doc_id": names, "shard": shards, "offset": offsets, "n_tokens": sizes.astype("int64")})[known]

    return own.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, "doc_id bigint, shard bigint, offset bigint, n_tokens bigint")


def read_back(docs: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, indexed)`` from the files; ``indexed``: the index leads from the key to this place."""
    placed = starts(scan(docs.sparkSession, folder))
    found = lookup(docs, folder).select(F.col("doc_id").alias("l_id"), F.col("shard").alias("l_shard"), F.col("offset").alias("l_offset"), F.col("n_tokens").alias("l_n"))
    joined = placed.join(found, F.col("doc_id") == F.col("l_id"), "left")
    indexed = (F.col("shard") == F.col("l_shard")) & (F.col("offset") == F.col("l_offset")) & (F.col("n_tokens") == F.col("l_n"))
    return joined.select("doc_id", "start", "n_tokens", "ids_crc32", F.coalesce(indexed, F.lit(False)).alias("indexed"))
