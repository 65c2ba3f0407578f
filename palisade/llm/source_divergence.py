"""How far the sources of a language differ in their words, in exact whole numbers.

A term is a run of ASCII letters and code points from U+0080 on, A to Z lower-cased.  Each
language keeps the terms that ``MIN_DOCS`` of its documents or more hold.  A group (language and source)
gives each kept term the share ``p = 1 + floor(10^9 (count + 1) / (N + V))``, with ``V`` kept terms and ``N``
of their occurrences in the group; a pair of shares costs ``floor((p - q)^2 / q)``.

Tasks count terms of their documents before anything is shuffled.  Kept terms are dealt to blocks of some
``BLOCK`` terms and numbered; in a block a group is one sorted array of term numbers and counts.  Groups of a
language stand in tiles of ``TILE``.  A task co-groups the arrays of two tiles in one block and
merges each pair of groups once: a galloping intersection prices terms of both, what is left
is one-sided, and both directions are priced at once.  Terms that neither has cost the same one
by one, so they are counted, and priced when the blocks of a pair are added up.  No task holds
more than two tiles of one block, however large a group or a language is.

Defined cases: null text, language and source are ``''``.  A text without terms adds a document
and no counts; a group without terms still has its pairs.  With no kept terms every pair has value 0.
Repeated rows are documents each.  Ties rank by the item's bytes in UTF-8.  A text of any length is
counted whole.  No documents, no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stash

MIN_DOCS = 3
TOP_TERMS = 200
#: Kept terms of a block and groups of a tile, about: two tiles of a block are some 16 MB.
BLOCK = 16_384
TILE = 32
#: Different terms, of all groups, that a task holds before it passes them on.
HELD = 300_000

#: Letters stay (A to Z lower-cased), what is no part of a term becomes a blank.
_FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


# --- counting --------------------------------------------------------------------------------


def counted(docs: DataFrame) -> DataFrame:
    """Partial counts ``(lang, source, term, n, docs)`` of tasks; a null term with the documents of a group, so every group is there."""
    rows = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    def batches(stream):
        occurrences: dict[tuple, Counter] = {}
        holding: dict[tuple, Counter] = {}
        number: Counter = Counter()
        held = 0
        for batch in stream:
            langs, sources, texts = (batch.column(c) for c in ("lang", "source", "text"))
            for i in range(batch.num_rows):
                group = langs[i].as_py(), sources[i].as_py()
                words = texts[i].as_py().translate(_FOLD).split()
                own = occurrences.setdefault(group, Counter())
                before = len(own)
                own.update(words)
                holding.setdefault(group, Counter()).update(set(words))
                number[group] += 1
                held += len(own) - before
                if held > HELD:
                    yield from _passed_on(occurrences, holding, number)
                    occurrences, holding, number, held = {}, {}, Counter(), 0
        yield from _passed_on(occurrences, holding, number)

    return rows.mapInArrow(batches, _COUNTS)


def _passed_on(occurrences, holding, number) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in occurrences.items():
        terms, docs = list(own), holding[lang, source]
        n = len(terms) + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                pa.array([*terms, None], pa.binary()).cast(pa.string()),
                pa.array([*own.values(), 0], pa.int64()), pa.array([*(docs[t] for t in terms), number[lang, source]], pa.int64()),
            ],
            ["lang", "source", "term", "n", "docs"],
        )


# --- exact shares ----------------------------------------------------------------------------


def share_of(count: Column, size: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / (size + terms))``, three digits of the quotient at a time, so nothing overflows."""
    whole = size + terms
    first = _div((count + 1) * 1000, whole)
    rest = (count + 1) * 1000 - first * whole
    second = _div(rest * 1000, whole)
    rest = rest * 1000 - second * whole
    return 1 + first * 1_000_000 + second * 1000 + _div(rest * 1000, whole)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def cost_of(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """As ``share_of``, with ``whole`` = size + terms."""
    first, rest = np.divmod((counts + 1) * 1000, whole)
    second, rest = np.divmod(rest * 1000, whole)
    return 1 + first * 1_000_000 + second * 1000 + rest * 1000 // whole


def cost(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) ** 2 // q).sum())


# --- pairs -----------------------------------------------------------------------------------


def gallop(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in two sorted arrays of what both hold: the shorter one's numbers are looked up by
    bisection in that stretch of the longer one that its ends leave."""
    if len(a) > len(b):
        there, here = gallop(b, a)
        return here, there
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = np.searchsorted(b, a[0]), np.searchsorted(b, a[-1], "right")
    first, last = (np.searchsorted(a, b[low]), np.searchsorted(a, b[high - 1], "right")) if low < high else (0, 0)
    at = low + np.searchsorted(b[low:high], a[first:last])
    hit = at < high
    hit[hit] = b[at[hit]] == a[first:last][hit]
    return first + np.flatnonzero(hit), at[hit]


class Group:
    """One group's share of a block: sorted term numbers, their shares, and the share of a term it lacks."""

    def __init__(self, size: int, terms: int, ids=(), counts=()):
        self.ids = np.asarray(ids, np.int64)
        self.shares = shares(np.asarray(counts, np.int64), size + terms)
        self.absent = shares(np.zeros(1, np.int64), size + terms)


def merge(g: Group, h: Group) -> tuple[int, int, int]:
    """Cost from ``g`` to ``h`` and back over the terms that one of them has, and how many those are."""
    in_g, in_h = gallop(g.ids, h.ids)
    both_g, both_h = g.shares[in_g], h.shares[in_h]
    only_g, only_h = np.delete(g.shares, in_g), np.delete(h.shares, in_h)
    return (
        cost(both_g, both_h) + cost(only_g, h.absent) + cost(g.absent, only_h),
        cost(both_h, both_g) + cost(h.absent, only_g) + cost(only_h, g.absent),
        len(both_g) + len(only_g) + len(only_h),
    )


_PRICED = "lang string, g int, h int, there bigint, back bigint, held bigint"


def _pair_task(key, tasks: pa.Table, arrays: pa.Table) -> pa.Table:
    """All pairs of groups ``g < h`` of two tiles in one block."""
    lang = key[0].as_py()
    out: list[tuple] = []
    held = {n: (ids.values.to_numpy(), counts.values.to_numpy()) for n, ids, counts in zip(
        arrays.column("number").to_pylist(), _lists(arrays, "ids"), _lists(arrays, "counts"))}
    for task in tasks.to_pylist():
        groups = [
            {m["number"]: Group(m["size"], task["terms"], *held.get(m["number"], ())) for m in task[side]} for side in ("left", "right")
        ]
        for g, one in groups[0].items():
            for h, other in groups[1].items():
                if g < h and (len(one.ids) or len(other.ids)):
                    out.append((lang, g, h, *merge(one, other)))
    columns = list(zip(*out)) or [()] * 6
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "g", "h", "there", "back", "held"])


def _lists(table: pa.Table, name: str) -> list:
    return list(table.column(name))


class Vocabulary:
    """Frames, written once: ``groups (lang, source, number, size, terms)``, ``counts (lang, source, term, id, n, total)`` of
    kept terms, and per language the occurrences and number of kept terms in ``langs (lang, size, terms)``."""

    def __init__(self, docs: DataFrame):
        raw = stash(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
        kept = raw.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= MIN_DOCS)
        kept = stash(kept.select("lang", "term", "total"), "kept")
        blocks = max(1, -(-kept.count() // BLOCK))
        # hashed, so no block is much larger than another; the number of a term tells its block
        numbered = stash(kept.repartition(blocks, "lang", "term").withColumn("id", F.monotonically_increasing_id()), "numbered")
        langs = stash(numbered.groupBy("lang").agg(F.sum("total").alias("size"), F.count("*").alias("terms")), "langs")
        self.langs = langs
        own = raw.filter("term is not null").select(F.col("lang").alias("o_lang"), "source", F.col("term").alias("o_term"), "n")
        same = (F.col("lang") == F.col("o_lang")) & (F.col("term") == F.col("o_term"))
        self.counts = stash(own.join(numbered, same).select("lang", "source", "term", "id", "n", "total"), "counts")
        sizes = self.counts.groupBy(F.col("lang").alias("s_lang"), F.col("source").alias("s_source")).agg(F.sum("n").alias("size"))
        every = raw.filter("term is null").select("lang", "source")
        order = Window.partitionBy("lang").orderBy("source")
        groups = every.join(sizes, (F.col("lang") == F.col("s_lang")) & (F.col("source") == F.col("s_source")), "left")
        groups = groups.join(langs.select(F.col("lang").alias("l_lang"), "terms"), F.col("lang") == F.col("l_lang"), "left")
        self.groups = stash(groups.select(
            "lang", "source", (F.row_number().over(order) - 1).alias("number"),
            F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("terms", F.lit(0)).alias("terms"),
        ), "groups")


def pair_costs(v: Vocabulary) -> DataFrame:
    """``(lang, g, h, there, back, held)`` of pairs ``g < h`` that have terms: costs over the ``held`` terms that one of them has."""
    members = v.groups.filter("terms > 0").withColumn("tile", F.floor(F.col("number") / TILE).cast("int"))
    tiles = members.groupBy("lang", "tile").agg(F.first("terms").alias("terms"), F.sort_array(F.collect_list(F.struct("number", "size"))).alias("members"))
    left = tiles.select("lang", F.col("tile").alias("i"), "terms", F.col("members").alias("left"))
    right = tiles.select(F.col("lang").alias("r_lang"), F.col("tile").alias("j"), F.col("members").alias("right"))
    pairs = left.join(right, (F.col("lang") == F.col("r_lang")) & (F.col("i") <= F.col("j"))).drop("r_lang")
    block = F.shiftright("id", 33).alias("block")
    arrays = v.counts.join(
        v.groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "number"),
        (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")),
    ).groupBy("lang", block, "number").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("items"))
    arrays = stash(arrays.select(
        "lang", "block", "number", F.floor(F.col("number") / TILE).cast("int").alias("tile"), F.col("items.id").alias("ids"), F.col("items.n").alias("counts"),
    ), "arrays")
    blocks = arrays.select(F.col("lang").alias("b_lang"), "block").distinct()
    tasks = stash(pairs.join(blocks, F.col("lang") == F.col("b_lang")).select("lang", "block", "i", "j", "terms", "left", "right"), "tasks")
    # an array goes to the tasks of its tile, not to each partner
    met = pairs.select(F.col("lang").alias("p_lang"), "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("p_tile"))
    dealt = arrays.join(met, (F.col("lang") == F.col("p_lang")) & (F.col("tile") == F.col("p_tile"))).select("lang", "block", "i", "j", "number", "ids", "counts")
    by = ("lang", "block", "i", "j")
    priced = tasks.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(_pair_task, _PRICED)
    return priced.groupBy("lang", "g", "h").agg(*(F.sum(c).alias(c) for c in ("there", "back", "held")))


def pairs_part(v: Vocabulary) -> DataFrame:
    """Every source against each other of its language."""
    one = v.groups.select("lang", F.col("source").alias("g_source"), F.col("number").alias("g"), F.col("size").alias("g_size"), "terms")
    two = v.groups.select(F.col("lang").alias("h_lang"), F.col("source").alias("h_source"), F.col("number").alias("h"), F.col("size").alias("h_size"))
    priced = pair_costs(v).select(F.col("lang").alias("c_lang"), F.col("g").alias("c_g"), F.col("h").alias("c_h"), "there", "back", "held")
    met = one.join(two, (F.col("lang") == F.col("h_lang")) & (F.col("g") < F.col("h")))
    met = met.join(priced, (F.col("lang") == F.col("c_lang")) & (F.col("g") == F.col("c_g")) & (F.col("h") == F.col("c_h")), "left")
    lacking = F.col("terms") - F.coalesce("held", F.lit(0))
    p, q = (share_of(F.lit(0).cast("bigint"), F.col(size), F.col("terms")) for size in ("g_size", "h_size"))

    def value(priced: str, p: Column, q: Column) -> Column:
        return F.when(F.col("terms") > 0, F.coalesce(priced, F.lit(0)) + lacking * cost_of(p, q)).otherwise(F.lit(0)).alias("value")

    both = F.array(
        F.struct(F.col("g_source").alias("source"), F.col("h_source").alias("item"), value("there", p, q)),
        F.struct(F.col("h_source").alias("source"), F.col("g_source").alias("item"), value("back", q, p)),
    )
    return met.select("lang", F.inline(both)).select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def terms_part(v: Vocabulary) -> DataFrame:
    """The terms that a source uses more than its language does."""
    groups = v.groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "size", "terms")
    langs = v.langs.select(F.col("lang").alias("l_lang"), F.col("size").alias("l_size"))
    rows = v.counts.join(groups, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source"))).join(langs, F.col("lang") == F.col("l_lang"))
    rows = rows.select(
        "lang", "source", "term", share_of(F.col("n"), F.col("size"), F.col("terms")).alias("p"), share_of(F.col("total"), F.col("l_size"), F.col("terms")).alias("q")
    )
    return rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), cost_of(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` of all other sources, ``term`` of the first ``TOP_TERMS`` terms."""
    v = Vocabulary(docs)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs_part(v)).unionAll(ranked(terms_part(v)).filter(F.col("rank") <= TOP_TERMS))
