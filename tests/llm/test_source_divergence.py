"""Divergences against whole-number arithmetic over every kept term of every group."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from palisade.llm import source_divergence
from palisade.llm.common import table
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, top=200):
    counts, holding, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for d in docs:
        lang, source = d.lang or "", d.source or ""
        terms = TERM.findall((d.text or "").translate(LOWER))
        counts[lang, source].update(terms)
        holding[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in holding[lang].items() if n >= 3]
        v = len(kept)

        def share(count, v=v, kept=kept):
            size = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (size + v) for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(rows, 1) if part == "pair" or rank <= top]
    return sorted(out)


def got(docs):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in source_divergence.audit(docs).collect())


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert got(docs) == brute(docs.collect())


@pytest.fixture
def small(monkeypatch):
    """Many blocks and tiles, and tasks that pass their counts on early."""
    for name, value in (("BLOCK", 7), ("TILE", 2), ("HELD", 20)):
        monkeypatch.setattr(source_divergence, name, value)


def test_nulls_repeats_long_texts_and_clashing_columns(spark, small):
    chance = random.Random(2)
    words = ["a", "B", "Ab", "éa", "É", "x1y", "İ", "🙂", "\x7f", "_", "z" * 50, "ßẞ"]
    rows = []
    for i in range(200):
        text = chance.choice([None, "", " 1 ", " ".join(chance.choice(words) + "abcdefgh"[: chance.randrange(8)] for _ in range(chance.randrange(60)))])
        rows.append((text, chance.choice([None, "", "en", "de"]), chance.choice([None, "", *"stuvw"]), "x", 1, 2))
    rows += [("one two one", "solo", "s", "x", 1, 2)] * 3 + [("never kept", "few", "s", "x", 1, 2), (None, "few", "t", "x", 1, 2)]
    rows += [("long Word " * 100_000, "en", "s", "x", 1, 2)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string, term string, n int, number int")
    want = brute(docs.collect())
    assert got(docs) == want
    assert [r for r in want if r[0] == "few"] == [("few", "s", "pair", "t", 0, 1), ("few", "t", "pair", "s", 0, 1)]
    assert got(docs.repartition(11)) == want


def test_no_documents(spark):
    assert got(spark.createDataFrame([], "text string, lang string, source string")) == []


@given(st.lists(st.integers(0, 60), unique=True).map(sorted), st.lists(st.integers(0, 60), unique=True).map(sorted))
def test_galloping_intersection(a, b):
    here, there = source_divergence.gallop(np.array(a, np.int64), np.array(b, np.int64))
    both = sorted(set(a) & set(b))
    assert [a[i] for i in here] == both == [b[i] for i in there]


def test_shares_of_very_large_counts(spark):
    rows = [(c, s, v) for c in (0, 1, 10**12, 9 * 10**14) for s in (10**12, 9 * 10**14, 10**15) for v in (1, 10**9) if c <= s]
    want = [1 + 10**9 * (c + 1) // (s + v) for c, s, v in rows]
    frame = spark.createDataFrame(rows, "c long, s long, v long").coalesce(1)
    assert [r[0] for r in frame.select(source_divergence.share_of(F.col("c"), F.col("s"), F.col("v"))).collect()] == want
    assert [int(source_divergence.shares(np.array([c]), s + v)[0]) for c, s, v in rows] == want
