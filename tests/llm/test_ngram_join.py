import random
import re

from palisade.llm import ngram_join as nj
from palisade.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n, threshold):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= threshold * max(len(a), len(b)) and 100 * len(a & b) >= threshold * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups, size, words, edits):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(2, words))]
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(50)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out, 100))


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, size int, key binary")
    return sorted(map(tuple, nj.near_duplicates(docs, **more).collect()), key=str)


def test_near_copies_equal_brute_force(spark):
    rows = near_copies(1, 25, 14, 120, 3)
    assert run(spark, rows) == sorted(brute(rows, 4, 85), key=str)


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_SETS", 5)
    rows = near_copies(2, 6, 40, 90, 3)
    assert run(spark, rows, n=3, threshold=80) == sorted(brute(rows, 3, 80), key=str)


def test_trie_join_equals_all_pairs():
    rng = random.Random(7)
    for _ in range(60):
        base = rng.sample(range(60), 30)
        rows = []
        for i in range(rng.randint(2, 14)):
            own = sorted(set(base) ^ set(rng.sample(range(60), rng.randint(0, 5))))
            rows.append((i, len(own), nj.np.array(own, dtype=nj.np.int64), True, True))
        got = {i: i for i in range(len(rows))}
        got.update({e["src"]: e["dst"] for e in nj.join_blocks(rows, 80)})
        want = list(range(len(rows)))
        for i, a in enumerate(rows):
            for j, b in enumerate(rows[:i]):
                if 100 * len(set(a[2]) & set(b[2])) >= 80 * len(set(a[2]) | set(b[2])):
                    x, y = want[i], want[j]
                    want = [min(x, y) if w in (x, y) else w for w in want]
        assert list(got.values()) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (6, "a b c"), (8, "x " * 30_000), (7, "X\tx " * 20_000), (9, "a b"), (9, "other words are here now"), (20, "p q r s t u"), (20, "k l m n o i"), (21, "k l m n o i"), (None, "a b"), (None, "zz")]
    got = run(spark, rows)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7), (9, 1, 4), (9, 2, 9), (20, 3, 20), (20, 3, 20), (21, 3, 20), (None, 1, 4), (None, 1, None)]
    assert got == sorted(want, key=str)
    assert run(spark, []) == []


def test_given_documents_and_keep_one(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, 4, 85)
    assert sorted(map(tuple, nj.near_duplicates(docs).collect())) == want
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_keep_one_with_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (9, "a b c d e f"), (9, "other words are here now"), (9, "unlike all of the rest"), (9, "unlike all of the rest"), (9, ""), (9, ""), (12, "other words are here now"),
            (3, "same set"), (3, "same  set"), (None, "a b c d e f"), (None, "lonely words"), (None, "Lonely words"), (None, None), (None, "further words"), (15, "alone"), (16, None)]
    docs = spark.createDataFrame([(*r, b"x", {"k": 1}) for r in rows], "doc_id long, text string, key binary, more map<string,int>")
    got = nj.keep_one(docs.withColumnRenamed("key", "raw"))
    assert got.columns == ["doc_id", "text", "raw", "more"]
    want = [(1, "a b c d e f"), (9, "other words are here now"), (9, "unlike all of the rest"), (9, ""), (9, ""), (3, "same  set"), (None, "Lonely words"), (None, None), (None, "further words"), (15, "alone"), (16, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sorted(((r.doc_id, r.text) for r in nj.keep_one(docs).collect()), key=str) == sorted(want, key=str)
