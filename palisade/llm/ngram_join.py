"""Near-duplicate documents by a prefix-tree join over word n-grams.

Two documents link when the Jaccard similarity of their n-gram sets reaches a threshold;
linked documents form components.

1. Documents with equal sets are one class, so copies are never paired.
2. A linked document misses at most ``floor((1 - threshold) * size)`` of its n-grams.  N-grams
   of one class only are sure misses; classes with too many can link with nothing and go.
   First a quarter of the hash range is counted, which clears most documents, then all
   n-grams of those that are left.
3. N-grams are ordered from rare to frequent.  Linked sets share one of their first n-grams,
   as many as misses are left plus one.  Classes that share such an n-gram get one cluster.
4. Clusters are cut into blocks of bounded size by set size and hash; only blocks of
   neighbouring set sizes meet.  Of two blocks, one's sets are stored in a trie; the
   other's walk it together, their partial overlaps shared by all sets below a node, and
   leave where even all that remains would not do.  A task returns a spanning forest of
   the links it found, never all pairs.

Defined cases: null texts and texts without words have an empty set and link with nothing;
rows with a null ``doc_id`` get the component of documents with an equal set, else null, and
link nothing; rows that repeat a ``doc_id`` are documents of their own with that id; other
columns are not read, and ``keep_one`` keeps them, whatever their names.  Sets are compared by 64-bit hashes of n-grams.
A text of any length is one set.  An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from palisade.llm.common import in_arrow, stash, unused
from palisade.operators.traverse import components

N, THRESHOLD = 4, 85
#: Share of the hash range that is counted first.
FIRST_SHARE = 0.25
#: Classes and n-grams of a block at most, on average.
BLOCK_SETS, BLOCK_GRAMS = 512, 250_000
#: Ids up to which they are broadcast: 8 bytes each.
BROADCAST_IDS = 1_000_000
REMEMBERED = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Hashes()


def grams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams; A-Z lower-cased, words parted by ASCII white space."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64)
    one = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    last = len(words) - n + 1
    with np.errstate(over="ignore"):
        mixed = one[:last].copy()
        for k in range(1, n):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + one[k : k + last]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _signed(hashes: np.ndarray) -> list[int]:
    return hashes.view(np.int64).tolist()


def _described(docs: DataFrame, n: int) -> DataFrame:
    """``(doc_id, size, key, low)`` of every row: the set's size, a 128-bit hash of it, and its n-grams of the first share of hashes."""
    bound = np.uint64(int(FIRST_SHARE * 2**64))

    def run(rows):
        import xxhash

        for row in rows:
            own = grams(row["text"], n)
            key = xxhash.xxh3_128_digest(own.tobytes())
            low = _signed(own[: np.searchsorted(own, bound)]) if row["doc_id"] is not None else []
            yield {"doc_id": row["doc_id"], "size": len(own), "key": key, "low": low}

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, size bigint, key binary, low array<bigint>")


def _misses(threshold: int):
    """Of a linked set, the most n-grams that its partner may lack."""
    return F.col("size") - F.ceil(F.col("size") * threshold / F.lit(100) - 1e-9)


def _by_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is a ``rep`` of ``ids``; broadcast only when counted to be few."""
    few = F.broadcast(ids.select("rep")) if ids.count() <= BROADCAST_IDS else ids.select("rep")
    return docs.join(few, F.col("doc_id") == F.col("rep"), "left_semi")


def classes(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """All rows with their class, and the classes that may still link: ``(key, rep, size)``."""
    described = stash(_described(docs, n), "grams")
    own = described.filter("size > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"))
    own = stash(own, "classes")
    low = described.filter("doc_id is not null").select(F.xxhash64("key").alias("k"), F.explode("low").alias("gram"))
    alone = low.groupBy("gram").agg(F.min("k").alias("k"), F.max("k").alias("other")).filter("k = other").groupBy("k").agg(F.count("*").alias("sure"))
    left = own.join(alone, F.xxhash64("key") == F.col("k"), "left").filter(F.coalesce("sure", F.lit(0)) <= _misses(threshold))
    return described.drop("low"), stash(left.select(own["key"], "rep", "size"), "open")


def _members(docs: DataFrame, left: DataFrame, n: int, threshold: int) -> DataFrame:
    """``(key, size, grams, prefix)`` of classes that may link: shared n-grams from rare to frequent, and those to meet by."""

    def run(rows):
        import xxhash

        for row in rows:
            own = grams(row["text"], n)
            if len(own):
                yield {"key": xxhash.xxh3_128_digest(own.tobytes()), "all": _signed(own)}

    held = in_arrow(_by_ids(docs, left).select("doc_id", "text"), run, "key binary, all array<bigint>")
    # A doc_id that comes twice may bring sets of other classes along.
    held = held.join(left.select("key"), "key", "left_semi").dropDuplicates(["key"]).withColumn("size", F.size("all").cast("long"))
    posted = stash(held.select("key", "size", F.explode("all").alias("gram")), "postings")
    shared = stash(posted.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    met = posted.join(shared, "gram").groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("ordered"))
    spare = _misses(threshold) - (F.col("size") - F.size("ordered"))
    met = met.withColumn("spare", spare).filter("spare >= 0").withColumn("grams", F.col("ordered.gram"))
    return met.select("key", "size", "grams", F.slice("grams", F.lit(1), (F.col("spare") + 1).cast("int")).alias("prefix"))


def links(members: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``(src, dst)``: links between classes that span each component."""
    posted = members.select("key", F.explode("prefix").alias("gram"))
    least = stash(posted.groupBy("gram").agg(F.min("key").alias("dst"), F.count("*").alias("n")).filter("n > 1").drop("n"), "least")
    star = posted.join(least, "gram").filter("key <> dst").select(F.col("key").alias("src"), "dst").distinct()
    cluster = components(star).select(F.col("urn").alias("key"), F.col("component").alias("cluster"))
    # A step of the logarithm of the threshold: linked sets lie in the same or in neighbouring bands.
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(-np.log(threshold / 100 - 1e-6))).cast("int")
    held = stash(members.join(cluster, "key").select("cluster", "key", "size", "grams", band.alias("band")), "clustered")
    dealt = held.groupBy("cluster", "band").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.size("grams")) / BLOCK_GRAMS)).cast("int").alias("blocks"), F.count("*").alias("n")
    )
    dealt = stash(dealt, "dealt")
    up = dealt.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    down = dealt.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    plan = dealt.join(up, ["cluster", "band"], "left").join(down, ["cluster", "band"], "left")
    placed = held.join(plan, ["cluster", "band"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    count = lambda c: F.sequence(F.lit(1), F.coalesce(c, F.lit(0)))
    none = F.array().cast("array<struct<lo:int,i:int,hi:int,j:int>>")
    pair = lambda lo, i, hi, j: F.struct(lo.cast("int").alias("lo"), i.cast("int").alias("i"), hi.cast("int").alias("hi"), j.cast("int").alias("j"))
    b, own = F.col("band"), F.col("own")
    meets = F.concat(
        F.when((F.col("n") > 1), F.transform(count(F.col("blocks")), lambda k: pair(b, F.least(own, k - 1), b, F.greatest(own, k - 1)))).otherwise(none),
        F.when(F.col("above") > 0, F.transform(count(F.col("above")), lambda k: pair(b, own, b + 1, k - 1))).otherwise(none),
        F.when(F.col("below") > 0, F.transform(count(F.col("below")), lambda k: pair(b - 1, k - 1, b, own))).otherwise(none),
    )
    sent = placed.withColumn("meet", F.explode(meets))
    first = (F.col("meet.lo") == b) & (F.col("meet.i") == own)
    second = (F.col("meet.hi") == b) & (F.col("meet.j") == own)
    sent = sent.select("cluster", "meet", "key", "size", "grams", first.alias("first"), second.alias("second"))
    parts = sent.repartition("cluster", "meet").sortWithinPartitions("cluster", "meet")

    def run(stream):
        import pyarrow as pa

        schema = pa.schema([("src", pa.binary()), ("dst", pa.binary())])
        now, held = None, []
        for batch in stream:
            for row in batch.to_pylist():
                meet = (row["cluster"], *row["meet"].values())
                if meet != now and held:
                    yield pa.RecordBatch.from_pylist(join_blocks(held, threshold), schema=schema)
                    held = []
                now = meet
                held.append((row["key"], row["size"], np.array(row["grams"], dtype=np.int64), row["first"], row["second"]))
        if held:
            yield pa.RecordBatch.from_pylist(join_blocks(held, threshold), schema=schema)

    return parts.mapInArrow(run, "src binary, dst binary")


def join_blocks(rows: list[tuple], threshold: int) -> list[dict]:
    """Links between the sets of one block and those of another, as a spanning forest; rows are ``(id, size, grams, first, second)``."""
    stored, walking = [r for r in rows if r[3]], [r for r in rows if r[4]]
    if len(rows) < 2 or not stored or not walking:
        return []
    every, counts = np.unique(np.concatenate([r[2] for r in rows]), return_counts=True)
    order = np.argsort(-counts, kind="stable")  # frequent first: sets share long paths
    rank = np.empty(len(every), dtype=np.int64)
    rank[order] = np.arange(len(every))
    kept = int((counts > 1).sum())  # what a single set holds never overlaps
    own = lambda r: np.sort((p := rank[np.searchsorted(every, r[2])])[p < kept])
    paths = sorted((tuple(own(r).tolist()), r[0], r[1]) for r in stored)
    has = np.zeros((len(walking), kept), dtype=bool)
    for k, r in enumerate(walking):
        has[k, own(r)] = True
    sizes = np.array([r[1] for r in walking], dtype=np.int64)
    ids = [r[0] for r in walking]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    walk = [(0, len(paths), 0, np.arange(len(walking)), np.zeros(len(walking), dtype=np.int64))]
    while walk:
        low, high, depth, alive, overlap = walk.pop()
        first, last = paths[low][0], paths[high - 1][0]
        deep, limit = depth, min(len(first), len(last))
        while deep < limit and first[deep] == last[deep]:
            deep += 1
        if deep > depth:
            overlap = overlap + has[np.ix_(alive, first[depth:deep])].sum(axis=1)
        below = paths[low:high]
        rest = max(len(p[0]) for p in below) - deep
        least = min(p[2] for p in below)
        able = (100 + threshold) * (overlap + rest) >= threshold * (sizes[alive] + least)
        alive, overlap = alive[able], overlap[able]
        if not len(alive):
            continue
        at = low
        while at < high and len(paths[at][0]) == deep:
            _, name, size = paths[at]
            for k in alive[(100 + threshold) * overlap >= threshold * (sizes[alive] + size)].tolist():
                if ids[k] != name and (a := root(ids[k])) != (b := root(name)):
                    parent[max(a, b)] = min(a, b)
            at += 1
        while at < high:
            step, end = paths[at][0][deep], at + 1
            while end < high and paths[end][0][deep] == step:
                end += 1
            walk.append((at, end, deep, alive, overlap))
            at = end
    return [{"src": x, "dst": top} for x in parent if (top := root(x)) != x]


def near_duplicates(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    return _grouped(docs, n, threshold).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, n: int, threshold: int) -> DataFrame:
    """``near_duplicates`` with ``key``, the row's set, and ``group``, a key that its component shares."""
    described, left = classes(docs, n, threshold)
    members = stash(_members(docs, left, n, threshold), "members")
    joined = components(stash(links(members, threshold), "links")).select(F.col("urn").alias("c_key"), F.col("component").alias("label"))
    joined = stash(joined, "joined")
    reps = described.filter("size > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    named = stash(reps.join(joined, F.col("key") == F.col("c_key"), "left").select("key", "rep", "label"), "named")
    # sets without links have no label to meet under; the least ids are written, so a large component can be split
    linked = named.filter("label is not null")
    least = stash(linked.groupBy(F.col("label").alias("l_label")).agg(F.min("rep").alias("least")), "least")
    least_of = linked.join(least, F.col("label") == F.col("l_label")).select(F.col("key").alias("r_key"), F.col("least").alias("component"), "label")
    named = least_of.unionAll(named.filter("label is null").select("key", "rep", "label"))
    return described.join(named, F.col("key") == F.col("r_key"), "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        "key", F.coalesce("label", "key").alias("group"),
    )


def _keyed(docs: DataFrame, n: int, name: str) -> DataFrame:
    """``docs`` with the key of each row's set as column ``name``; null without words."""
    schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])

    def run(stream):
        import pyarrow as pa
        import xxhash

        for batch in stream:
            sets = (grams(t, n) for t in batch.column("text").to_pylist())
            keys = pa.array([xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None for own in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_one(docs: DataFrame, n: int = N, threshold: int = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, but of each component only one, of its least ``doc_id``; without words they stay.

    A row is told by its id, where that is repeated or null by its set too.  Sets that
    only rows without an id have are alike when equal, and one row of each stays.
    """
    r_id, set_key, g_key, g_group, g_least, kept = unused(docs.columns, "r_id", "set_key", "g_key", "g_group", "g_least", "row")
    found = stash(_grouped(docs, n, threshold), "grouped")
    repeated = stash(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias(r_id)).count().filter("count > 1").select(r_id), "repeated")
    gone = found.filter("component_id <> doc_id and n_shingles > 0").select(F.col("doc_id").alias(r_id)).unionByName(repeated).distinct()
    plain = docs.filter("doc_id is not null").join(gone, F.col("doc_id") == F.col(r_id), "left_anti")
    if repeated.isEmpty() and found.filter("doc_id is null").isEmpty():
        return plain
    odd = docs.filter("doc_id is null").unionByName(docs.join(repeated, F.col("doc_id") == F.col(r_id), "left_semi"))
    odd = stash(_keyed(odd, n, set_key), "odd")
    sets = found.filter("n_shingles > 0").groupBy(F.col("key").alias(g_key)).agg(F.min("group").alias(g_group), F.min("component_id").alias(g_least))
    own = odd.join(sets, F.col(set_key) == F.col(g_key)).filter(F.col(g_least).isNull() | (F.col("doc_id") == F.col(g_least)))
    first = own.groupBy(g_group).agg(F.min_by(F.struct(*docs.columns), F.struct(set_key, "text")).alias(kept)).select(f"{kept}.*")
    return plain.unionByName(odd.filter(F.col(set_key).isNull()).select(docs.columns)).unionByName(first)
