"""Weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

DataFrame functions only.  Each rule votes good (1), bad (0) or abstains (null).  Rows are
counted by their pattern of votes - at most 3 to the number of rules, whatever the corpus -
and the rounds of expectation-maximisation fold over that one array.  They estimate how
often each rule votes good on good and on bad documents and the share of good ones; a
pattern's posterior follows.

Defined cases: a null or empty text has no words and fails the base; rows that repeat are
judged alike, each on its own; other columns, of any name, are not read.  An empty table
gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import WORD_BREAK, stash

ROUNDS = 40
#: Posterior from which a document is kept.
KEEP = 0.5
WINDOW = 8
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def base(docs: DataFrame) -> DataFrame:
    """Statistics of every row: the six of the base, and those that the other rules read."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        "doc_id", F.array_remove(F.split(text, WORD_BREAK), "").alias("words"), lines.alias("lines"), F.length(text).alias("n_all"),
        (F.length(text) - _without(text, _SYMBOLS)).alias("n_symbols"),
        (F.length(text) - _without(text, _CAPITALS)).alias("n_capitals"),
        (F.length(text) - _without(text, "!")).alias("n_shouts"),
    )
    counted = split.select(
        "doc_id", "n_symbols", "n_capitals", "n_shouts", "n_all",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(F.instr(F.lit(".!?…"), F.right(F.rtrim(x), F.lit(1))) > 0, 1).otherwise(0)).alias("n_ended"),
        F.size(F.filter("words", lambda w: F.instr(F.lit(_SYMBOLS), F.right(w, F.lit(1))) > 0)).cast("long").alias("n_symbol_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windowed = counted.withColumn(
        "windows",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[F.col("hashes")[i + k] for k in range(WINDOW)])),
        ),
    ).drop("hashes")
    placed = windowed.withColumn(
        "sorted",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("windows")
    at = placed.withColumn(
        "at",
        F.sort_array(
            F.transform(
                F.filter(
                    "sorted",
                    lambda x, k: F.coalesce(x["h"] == F.get("sorted", k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("sorted", k + 1)["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            )
        ),
    ).drop("sorted")
    covered = F.aggregate(
        F.col("at"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")),
    )["n"]
    return at.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 1)


def votes() -> dict[str, Column]:
    """The rules over the statistics of ``base``: 1 good, 0 bad, null abstains."""
    n = F.col("n_words")
    never = F.lit(False)
    return {
        "length": _vote(n >= 100, n < 20),
        "word_length": _vote(F.col("word_chars") <= 8 * n, 2 * F.col("word_chars") > 19 * n),
        "symbols": _vote(F.col("n_symbols") == 0, 5 * F.col("n_symbols") > n),
        "symbol_words": _vote(F.col("n_symbol_words") == 0, 5 * F.col("n_symbol_words") > n),
        "dup_lines": _vote(never, 5 * F.col("n_dup_lines") > F.col("n_lines")),
        "repeats": _vote(F.col("n_repeat_words") == 0, 5 * F.col("n_repeat_words") > n),
        "capitals": _vote(20 * F.col("n_capitals") < F.col("n_all"), 4 * F.col("n_capitals") > F.col("n_all")),
        "shouts": _vote(F.col("n_shouts") == 0, 10 * F.col("n_shouts") > n),
        "ended_lines": _vote(never, 4 * F.col("n_ended") < 3 * F.col("n_lines")),
    }


def _posterior(pattern: Column, model: Column) -> Column:
    """Probability of good given the votes under ``(prior, good, bad)``."""
    ratio = F.aggregate(
        F.arrays_zip(pattern.alias("v"), model["good"].alias("g"), model["bad"].alias("b")),
        F.log(model["prior"] / (1.0 - model["prior"])),
        lambda a, x: a + F.log(F.get(x["g"], F.coalesce(x["v"], F.lit(2))) / F.get(x["b"], F.coalesce(x["v"], F.lit(2)))),
    )
    return 1.0 / (1.0 + F.exp(-ratio))


def weigh(voted: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row ``model: (prior, good, bad)`` from rows with a ``pattern`` of votes and their number ``n``.

    ``good[k]`` and ``bad[k]`` are the chances that rule ``k`` votes bad, votes good or
    abstains on a good and on a bad document.  Each count starts at one.
    """
    kind = "struct<prior:double,good:array<array<double>>,bad:array<array<double>>>"
    start = F.struct(
        F.lit(0.85).alias("prior"),
        F.array_repeat(F.array(F.lit(0.05), F.lit(0.8), F.lit(0.15)), rules).alias("good"),
        F.array_repeat(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)), rules).alias("bad"),
    ).cast(kind)
    state = voted.groupBy().agg(F.array_sort(F.collect_list(F.struct("pattern", "n"))).alias("seen")).select("seen", start.alias("model"))

    def step(model: Column, _: Column) -> Column:
        scored = F.transform(
            "seen",
            lambda s: F.struct(
                F.transform(s["pattern"], lambda v: F.coalesce(v, F.lit(2))).alias("pattern"),
                s["n"].cast("double").alias("n"), (s["n"] * _posterior(s["pattern"], model)).alias("good"),
            ),
        )

        def refit(s: Column) -> Column:
            total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x["n"])
            good = F.aggregate(s, F.lit(0.0), lambda a, x: a + x["good"])
            chances = lambda mass, whole: F.transform(
                F.sequence(F.lit(0), F.lit(rules - 1)),
                lambda k: F.transform(
                    F.sequence(F.lit(0), F.lit(2)),
                    lambda v: (1.0 + F.aggregate(s, F.lit(0.0), lambda a, x: a + F.when(F.get(x["pattern"], k) == v, mass(x)).otherwise(0.0))) / (3.0 + whole),
                ),
            )
            return F.struct(
                ((good + 1.0) / (total + 2.0)).alias("prior"),
                chances(lambda x: x["good"], good).alias("good"), chances(lambda x: x["n"] - x["good"], total - good).alias("bad"),
            )

        return F.transform(F.array(scored), refit)[0]

    return state.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("model"), step).alias("model"))


def judge(docs: DataFrame, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """Every row's statistics with ``base_failed``, ``quality`` (the posterior) and ``kept``."""
    rules = votes()
    stats = stash(base(docs).withColumn("pattern", F.array(*[v.cast("int") for v in rules.values()])).withColumn("base_failed", failed()), "rules")
    patterns = stats.groupBy("pattern").agg(F.count("*").alias("n"))
    model = stash(weigh(patterns, len(rules), rounds), "model")
    # The model is one row: the product with it adds a column only.
    known = patterns.crossJoin(F.broadcast(model)).select(F.col("pattern").alias("p_pattern"), _posterior(F.col("pattern"), F.col("model")).alias("quality"))
    # At most 3 to the number of rules.
    judged = stats.join(F.broadcast(known), F.col("pattern").eqNullSafe(F.col("p_pattern")))
    return judged.drop("p_pattern", "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))
