"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is its share: the number of copies each of its documents should get,
a whole part and a fraction that is rounded.  Two open fractions meet at a time and one passes mass,
counted in words, to the other until one of them is whole; a source's words stay as they are, but for
what its last open document is rounded by.  A long document meets a short one in vain: the short one is whole at
once, and the long one stays open to the end.  So each source is rounded in three steps.

1. Documents above ``1 / LONG`` of the source's words, the longest first, meet all that is left of the source: each takes its
   copies by a draw, and the words that it took too few or too many change the share of the rest.
2. The rest is dealt to leaves of some ``FAN``; in a leaf documents meet one after the other, the one that
   stays open meets those of other leaves in the next level, up to one per source, which is rounded by a draw.
3. The ``FILL`` shortest documents were kept out of this.  They take up the words of that draw and meet
   what is left of themselves, the longest first.  The source misses its target by its shortest document
   at most, unless its documents are too few to make up for one that is longer than the others together.

A draw that no copies of the rest (none to ``CAP`` each) could make up for is not left to chance.  Chance comes
from hashes of ids and a seed: reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, the last;
rows alike in ``doc_id``, source and size are one unit with the words of all, and share its decision;
null ``doc_id`` is an id like any other.  Ties in length meet in the order of a hash of their ids.  With no
words at all, and in documents without words, nothing is taken.  A text of any length is counted whole.  No documents,
no rows.  Columns besides these are ignored or, in ``mix``, kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stash, unused, words

#: Documents of a leaf, and leaves below a node, on average.
FAN = 256
#: A long document has this part of its source's words, so a source has no more of them than this.
LONG = 512
#: Short documents of a source that even it out.
FILL = 256
#: Sources up to which their table is broadcast: some 100 bytes each.
BROADCAST_SOURCES = 10_000
CAP = 3
#: Fractions this near 0 or 1 are whole.
EPS = 1e-9
_KEY = "struct<doc_id:bigint,source:string,size:bigint,mass:bigint>"
_DEALT = f"array<struct<key:{_KEY},copies:bigint>>"


def sized(docs: DataFrame) -> DataFrame:
    """Documents with ``size``, their number of words."""
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, n_docs, source_size, target)``: shares by weight, none above ``CAP`` times its size.

    Sources in the order of cap over weight reach their cap one after the other; the first
    that keeps below it fixes the words per weight of all the rest.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = per_source.select(
        "source", "source_size", "n_docs",
        (1 + (F.row_number().over(by_name) - 1) % 3).cast("decimal(38,0)").alias("weight"),
        (F.col("source_size") * CAP).cast("decimal(38,0)").alias("cap"),
    )
    fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_first())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = weighed.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double").alias("left"),
        (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double").alias("weights"),
    )
    level = F.col("left") / F.col("weights")
    below = F.when(level * F.col("weight").cast("double") <= F.col("cap").cast("double"), F.struct(F.col("cap") / F.col("weight"), level.alias("level")))
    return rest.select("source", "n_docs", "source_size", "weight", "cap", F.min(below).over(Window.partitionBy())["level"].alias("level")).select(
        "source", "n_docs", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight").cast("double"), F.col("cap").cast("double"))).alias("target"),
    )


def _chance(seed: int, *of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11).cast("double") / F.lit(float(1 << 53))


def _pivot(items: Column, seed: int) -> Column:
    """Fold the fractions of one node: ``(open, p, won)``, the key still open, its mass, and keys rounded up."""
    start = F.struct(F.lit(None).cast(_KEY).alias("open"), F.lit(0.0).alias("p"), F.array().cast(f"array<{_KEY}>").alias("won"))

    def meet(a: Column, x: Column) -> Column:
        """Words pass from one to the other, either way with the chance that leaves both expectations as they are."""
        size_a, size_x = a["open"]["mass"], x["key"]["mass"]
        up = F.least((1.0 - a["p"]) * size_a, x["p"] * size_x)
        down = F.least(a["p"] * size_a, (1.0 - x["p"]) * size_x)
        u = _chance(seed, a["open"]["doc_id"], a["open"]["source"], x["key"]["doc_id"], x["key"]["source"], x["key"]["size"])
        moved = F.when(u * (up + down) < down, up).otherwise(-down)
        return F.struct(a["won"].alias("won"), a["open"].alias("a"), (a["p"] + moved / size_a).alias("pa"),
                        x["key"].alias("x"), (x["p"] - moved / size_x).alias("px"))

    def settle(m: Column) -> Column:
        """One of the two is whole now; the other stays open."""
        first = (m["pa"] < EPS) | (m["pa"] > 1.0 - EPS)
        up = F.when(first, m["pa"]).otherwise(m["px"]) > 0.5
        whole = F.when(first, m["a"]).otherwise(m["x"])
        return F.struct(
            F.when(first, m["x"]).otherwise(m["a"]).alias("open"), F.when(first, m["px"]).otherwise(m["pa"]).alias("p"),
            F.when(up, F.concat(m["won"], F.array(whole))).otherwise(m["won"]).alias("won"),
        )

    def fold(a: Column, x: Column) -> Column:
        met = F.transform(F.array(meet(a, x)), settle)[0]
        fresh = F.struct(x["key"].alias("open"), x["p"].alias("p"), a["won"].alias("won"))
        return F.when(a["open"].isNull(), fresh).otherwise(met)

    return F.aggregate(items, start, fold)


def _deal(items: Column, words: Column, left: Column, seed: int) -> Column:
    """Fold documents, each against what follows: ``(left, words, dealt)``, the words still to be taken,
    those of documents that are still open, and copies by key.

    ``words`` and ``left`` are those of the source before any of ``items`` is decided.
    """
    start = F.struct(left.cast("double").alias("left"), words.cast("double").alias("words"), F.array().cast(_DEALT).alias("dealt"))

    def meet(a: Column, x: Column) -> Column:
        share = F.greatest(F.lit(0.0), F.least(F.lit(float(CAP)), a["left"] / a["words"]))
        low = F.floor(share + EPS)
        return F.struct(a.alias("a"), x.alias("x"), low.alias("low"), (share - low).alias("part"), (a["words"] - x["mass"]).alias("rest"))

    def missed(m: Column, copies: Column) -> Column:
        """Words that the rest could not make up for."""
        then = m["a"]["left"] - copies * m["x"]["mass"]
        return F.greatest(F.lit(0.0), -then, then - CAP * m["rest"])

    def settle(m: Column) -> Column:
        high = m["low"] + 1
        too_few, too_many = missed(m, m["low"]), missed(m, high)
        u = _chance(seed, m["x"]["doc_id"], m["x"]["source"], m["x"]["size"])
        copies = (
            F.when((m["part"] <= EPS) | (m["low"] >= CAP) | (too_few + EPS < too_many), m["low"])
            .when(too_many + EPS < too_few, high)
            .when(u < m["part"], high).otherwise(m["low"])
        ).cast("long")
        return F.struct(m["a"].alias("a"), m["x"].alias("x"), m["rest"].alias("rest"), copies.alias("copies"))

    def done(m: Column) -> Column:
        return F.struct(
            (m["a"]["left"] - m["copies"] * m["x"]["mass"]).alias("left"), m["rest"].alias("words"),
            F.concat(m["a"]["dealt"], F.array(F.struct(m["x"].alias("key"), m["copies"].alias("copies")))).alias("dealt"),
        )

    return F.aggregate(items, start, lambda a, x: F.transform(F.transform(F.transform(F.array(meet(a, x)), lambda m: m), settle), done)[0])


def _in_order(seed: int) -> Column:
    """A group's units ``key``, the longest first."""
    ranked = F.struct((-F.col("key.mass")).alias("mass"), F.xxhash64(F.lit(seed), "key.doc_id", "key.size").alias("mix"), "key")
    return F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["key"])


def _of_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Rows with the columns of their source, ``s_source`` being its name."""
    return rows.join(F.broadcast(per_source) if few else per_source, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")


def _tree(units: DataFrame, few: bool, seed: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Keys ``(key)`` that are rounded up, of units ``(source, key, part)``, and what stays open per source ``(source, item)``."""
    per = units.groupBy("source").agg(F.ceil(F.count("*") / FAN).cast("long").alias("leaves")).select(F.col("source").alias("s_source"), "leaves")
    node = F.pmod(F.xxhash64(F.lit(7), "key.doc_id", "key.size"), F.col("leaves"))
    level = stash(_of_source(units, per, few).select("source", node.alias("node"), F.struct("key", F.col("part").alias("p")).alias("item")), "units")
    most = level.agg(F.max("node")).first()[0]
    won: list[DataFrame] = []
    nodes = 0 if most is None else most + 1
    number = 0
    while nodes:
        up = F.pmod(F.col("node"), F.lit(nodes)) if number else F.col("node")
        items = level.groupBy("source", up.alias("node")).agg(F.array_sort(F.collect_list(F.struct(
            F.xxhash64(F.lit(seed), "item.key.doc_id", "item.key.size").alias("mix"), "item",
        ))).alias("items"))
        folded = stash(items.select("source", "node", _pivot(F.transform("items", lambda x: x["item"]), seed + number).alias("out")), "pivot")
        won.append(folded.select(F.explode("out.won").alias("key")))
        level = folded.filter(f"out.p > {EPS}").select("source", "node", F.struct(F.col("out.open").alias("key"), F.col("out.p").alias("p")).alias("item"))
        if nodes == 1 and number:
            return won, level.select("source", "item")
        number += 1
        nodes = -(-nodes // FAN)
    return won, None


def copies(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``(doc_id, size, source, source_size, target, copies)`` for every row of ``(doc_id, source, size)``."""
    targets = stash(source_targets(docs), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    named = targets.select(F.col("source").alias("s_source"), "source_size", "target")
    units = docs.filter("size > 0").groupBy("source", "doc_id", "size").agg((F.count("*") * F.col("size")).alias("mass"))
    units = _of_source(units.select("source", F.struct("doc_id", "source", "size", "mass").alias("key")), named, few)
    units = stash(units.select("source", "key", (F.col("key.mass") * LONG > F.col("source_size")).alias("is_long")), "units")

    # 1. long documents against all of their source
    long_ones = _of_source(units.filter("is_long"), named, few)
    long_ones = long_ones.groupBy("source").agg(_deal(_in_order(seed), F.first("source_size"), F.first("target"), seed).alias("out"))
    long_ones = stash(long_ones, "long")
    after = targets.select("source", "source_size", "target").join(
        long_ones.select(F.col("source").alias("l_source"), "out.left", "out.words"), F.col("source").eqNullSafe(F.col("l_source")), "left"
    )
    left, open_words = F.coalesce("left", "target"), F.coalesce("words", F.col("source_size").cast("double"))
    share = F.when(open_words > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(CAP)), left / open_words))).otherwise(F.lit(0.0))
    shares = stash(after.select(F.col("source").alias("s_source"), share.alias("share"), F.floor(share + EPS).cast("long").alias("whole")), "shares")

    # 2. the rest among themselves, but for the shortest
    by_size = Window.partitionBy("source").orderBy(F.col("key.mass"), F.xxhash64(F.lit(seed), "key.doc_id", "key.size"), "key.doc_id")
    short = units.filter("not is_long").withColumn("n", F.row_number().over(by_size)).filter(F.col("n") <= FILL)
    fillers = stash(short.select("source", "key"), "fill")
    longest = fillers.groupBy("source").agg(F.max(F.struct(
        F.col("key.mass").alias("m"), F.xxhash64(F.lit(seed), "key.doc_id", "key.size").alias("h"), F.coalesce("key.doc_id", F.lit(-(1 << 63))).alias("d"),
    )).alias("last"))
    place = F.struct(F.col("key.mass").alias("m"), F.xxhash64(F.lit(seed), "key.doc_id", "key.size").alias("h"), F.coalesce("key.doc_id", F.lit(-(1 << 63))).alias("d"))
    rest = _of_source(units.filter("not is_long"), longest.select(F.col("source").alias("s_source"), "last"), few).filter(place > F.col("last"))
    rest = _of_source(rest.select("source", "key"), shares, few).withColumn("part", F.col("share") - F.col("whole")).filter(F.col("part") > EPS)
    won, still_open = _tree(rest.select("source", "key", "part"), few, seed)

    # 3. the last open one, and the shortest to make up for it
    fills = _of_source(fillers, shares, few)
    if still_open is not None:
        up = _chance(seed, F.col("item.key.doc_id"), F.col("item.key.source"), F.col("item.key.size")) < F.col("item.p")
        drawn = stash(still_open.select(F.col("source").alias("s_source"), "item", up.alias("up")), "drawn")
        won.append(drawn.filter("up").select(F.col("item.key").alias("key")))
        owed = drawn.select("s_source", ((F.col("item.p") - F.col("up").cast("double")) * F.col("item.key.mass")).alias("owed"))
        fills = fills.join(F.broadcast(owed) if few else owed, F.col("source").eqNullSafe(F.col("s_source")), "left").drop("s_source")
    else:
        fills = fills.withColumn("owed", F.lit(0.0))
    words = F.sum("key.mass")
    filled = fills.groupBy("source").agg(_deal(_in_order(seed), words, words * F.first("share") + F.coalesce(F.first("owed"), F.lit(0.0)), seed + 1).alias("out"))

    key = lambda k: [F.col(f"{k}.doc_id").alias("w_id"), F.col(f"{k}.source").alias("w_source"), F.col(f"{k}.size").alias("w_size")]
    none = F.lit(None).cast("long")
    decided = long_ones.select(F.explode("out.dealt").alias("d")).unionAll(filled.select(F.explode("out.dealt").alias("d")))
    decided = decided.select(*key("d.key"), F.col("d.copies").alias("fixed"), none.alias("one"))
    for some in won:
        decided = decided.unionAll(some.select(*key("key"), none.alias("fixed"), F.lit(1).cast("long").alias("one")))
    rows = _of_source(_of_source(docs.select("doc_id", "source", "size"), named, few), shares.select("s_source", "whole"), few)
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & F.col("source").eqNullSafe(F.col("w_source")) & (F.col("size") == F.col("w_size"))
    number = F.coalesce("fixed", F.col("whole") + F.coalesce("one", F.lit(0)))
    return rows.join(decided, same, "left").select(
        "doc_id", "size", "source", "source_size", "target", F.when(F.col("size") > 0, number).otherwise(F.lit(0)).cast("long").alias("copies")
    )


def taken(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: the words that the mix takes of each document."""
    sizes = stash(sized(docs).select("doc_id", "source", "size"), "sizes")
    return copies(sizes, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mixed corpus: each row of ``docs``, all columns, as often as it is taken; without words it isn't."""
    sizes = stash(sized(docs).select("doc_id", "source", "size"), "sizes")
    plan = copies(sizes, seed).filter("copies > 0 and size > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("n"))
    own = docs.columns
    of_id, of_source, of_size, times, copy = unused(own, "id", "source", "size", "n", "copy")
    plan = plan.toDF(of_id, of_source, of_size, times)
    size = F.size(words(F.col("text"))).cast("long")
    same = docs["doc_id"].eqNullSafe(F.col(of_id)) & docs["source"].eqNullSafe(F.col(of_source)) & (size == F.col(of_size))
    chosen = docs.join(plan, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return chosen.select(*own)
