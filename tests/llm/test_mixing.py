from collections import defaultdict

import pytest
from palisade.llm import mixing
from palisade.llm.common import table


def targets(sizes):
    """Shares by weight; what is above three times a source's size is shared again, until none is."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        shares = {s: left * weight[s] / w for s in free}
        over = {s: 3 * sizes[s] for s in free if shares[s] > 3 * sizes[s]}
        if not over:
            return capped | shares
        capped |= over


def check(rows, docs, slack):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len((r.text or "").split())
    want, got = targets(sizes), defaultdict(int)
    source = {r.doc_id: r.source for r in docs}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        got[s] += r.taken
    for s in want:
        assert abs(got[s] - want[s]) <= slack(s, want[s]), (s, got[s], want[s])


def test_small_sources(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), f"s{i % 5}") for i in range(600)]
    rows += [(1000, None, None), (1001, "", "empty"), (1002, "a b", None), (1003, "tiny", "zz"), (1004, "word " * 1200, "s1")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, copies string")
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows)
    check(got, docs.collect(), lambda s, want: 0.05 * want + 10)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(docs.repartition(7)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r.taken // r["size"] for r in got if r.taken}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == copies


@pytest.mark.parametrize("sf, slack", [("sf0.001", 0.03), ("sf0.01", 0.01), ("sf0.1", 0.01)])
def test_given_documents(spark, sf, slack):
    """Each source comes within 1 % of its target; of ten documents, within 3 % or its shortest one."""
    docs = table(spark, f"/root/testdata/{sf}", "documents").select("doc_id", "text", "source")
    rows = docs.collect()
    short = defaultdict(lambda: 1 << 60)
    for r in rows:
        if n := len((r.text or "").split()):
            short[r.source] = min(short[r.source], n)
    check(mixing.taken(docs).collect(), rows, lambda s, want: max(slack * want, short[s]))


def test_one_long_document_in_each_source(spark):
    """A document longer than half of its source is made up for by the others."""
    rows = [(s * 1000 + i, "w " * (1 + (i * 37 + s) % 60), f"s{s}") for s in range(6) for i in range(400)]
    rows += [(s * 1000 + 900, "w " * n, f"s{s}") for s, n in enumerate((20_000, 9_000, 12_000, 3_000, 700, 15_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.taken(docs).collect(), docs.collect(), lambda s, want: 0.01 * want)
    for seed in range(3):
        check(mixing.taken(docs, seed).collect(), docs.collect(), lambda s, want: 0.01 * want)


def test_repeats_count_with_their_number(spark):
    rows = [(i, "w " * (5 + i % 40), f"s{i % 3}") for i in range(200)] + [(7, "w " * 12, "s1")] * 300 + [(8, "w " * 13, "s2")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(mixing.taken(docs).collect(), docs.collect(), lambda s, want: 0.01 * want + 5)


def test_copies_are_as_often_as_the_share(spark):
    """Over many seeds a document is taken about as often as its source's share says."""
    docs = spark.createDataFrame([(i, "w " * (3 + i % 20), "ab"[i % 4 == 0]) for i in range(160)], "doc_id long, text string, source string")
    got = [r for seed in range(12) for r in mixing.taken(docs, seed).collect()]
    for source_size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == source_size]
        mean = sum(r.taken / r["size"] for r in own) / len(own)
        assert abs(mean - own[0].target / source_size) < 0.05


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "w " * 9, "s", 1, 2, 3, 4) for i in range(9)], "doc_id long, text string, source string, m_id int, id int, n int, _copy int")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == 9


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b", "x")] * 3 + [(None, "a b c", "x"), (2, "d", "y"), (3, "d e f g h", "y")], "doc_id long, text string, source string")
    got = mixing.taken(docs).collect()
    assert len(got) == 6 and len({r.taken for r in got if r.doc_id == 1}) == 1


def test_nothing(spark):
    assert mixing.taken(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    blank = mixing.taken(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert all(r.taken == 0 and r.target == 0 for r in blank)
