"""The audit against filters that are run one after the other, document by document."""

import random
import re
from itertools import permutations

import numpy as np
from palisade.llm import filter_audit
from palisade.llm.common import table

DDL = "doc_id long, text string, source string, part string, fails int, first long"


def brute(docs, labels):
    good = {r.doc_id for r in labels if r.quality == 1}
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    least = {}
    for r in docs:
        text = r.text or ""
        if r.doc_id is not None:
            least[text] = min(least.get(text, r.doc_id), r.doc_id)
    parts = {}
    for r in docs:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = ""
        failed += "A" * (len(words) < 50)
        failed += "B" * (100 * len(set(words)) < 65 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        failed += "D" * bool(re.search(r"[#$%&*|]", text))
        failed += "E" * (r.doc_id is not None and text in least and least[text] < r.doc_id)
        parts.setdefault(r.source or "", []).append((failed, r.doc_id in good and r.doc_id is not None, r.doc_id in toxic and r.doc_id is not None))
    out, share = {}, {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                out[part, order, step] = [
                    len(left), len(removed), sum(f in r[0] for r in rows) - len(removed), sum(r[0] == f for r in rows),
                    sum(r[1] for r in removed), sum(r[2] for r in removed),
                ]
                share[part, f] = share.get((part, f), 0) + len(removed)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def compare(docs, labels):
    rows = filter_audit.audit(docs, labels).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    assert got == brute(docs.collect(), labels.collect())


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    compare(table(spark, folder, "documents"), table(spark, folder, "labels"))


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    chance = random.Random(3)
    some = ["word", "Caps", "ÄÖ", "ALL", "pi|pe", " ", "x\x1cy", "🙂"]
    texts = [" ".join(chance.choice(some) + str(chance.randrange(k)) for _ in range(n)) for n in (3, 49, 50, 60, 400) for k in (1, 1000)]
    texts += [None, "", " \n\t", "long " * 200_000, "one\x0btwo\x0cthree"]
    rows = [(chance.choice([None, *range(60)]), chance.choice(texts), chance.choice([None, "", "a", "b"])) for _ in range(300)]
    rows += [(7, "same", "a")] * 3 + [(8, "same", "b"), (None, "same", "b")]
    docs = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], DDL)
    labels = spark.createDataFrame(
        [(chance.choice([None, *range(40)]), chance.choice([None, 0, 1]), chance.choice([None, 0, 1]), 5) for _ in range(90)],
        "doc_id long, quality int, toxic int, n int",
    )
    compare(docs, labels)
    compare(docs.repartition(9), labels.limit(0))


def test_no_documents(spark):
    docs = spark.createDataFrame([], DDL)
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_contractions_stay_whole_numbers():
    counts = np.full((1, 2, 2, 2, 2, 2), 10**16 + 1, np.int64)
    out = filter_audit.figures(counts, counts, counts)
    assert out["kept"].dtype == np.int64
    assert out["kept"][0, 4] == 10**16 + 1 and out["removed"][0, 0] == 16 * (10**16 + 1)
