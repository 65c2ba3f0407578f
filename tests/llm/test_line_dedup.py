import hashlib
import random

from palisade.llm import line_dedup as ld
from palisade.llm.common import table


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    return a == b or (min(len(a), len(b)) >= ld.SHORT and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1)


def brute(rows):
    earlier, out = [], []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out.append((doc_id, 0, 0, hashlib.sha256(b"").hexdigest()))
            continue
        kept, lines = [], text.split("\n")
        for line in lines:
            if line.strip() and any(near(line, x) for x in earlier):
                pass
            else:
                kept.append(line)
            if line.strip():
                earlier.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars long, gone string").repartition(3)
    return sorted(map(tuple, ld.summary(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_edits_equal_brute_force(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("ab é ") for _ in range(rng.choice([5, 12, 19, 20, 21, 35, 60]))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(bases)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(line) + 1)
                line = rng.choice([line[:k] + line[k + 1 :], line[:k] + rng.choice("abé") + line[k:], line[:k] + "c" + line[k + 1 :]])
            lines += [line] + [""] * (rng.random() < 0.2)
        rows.append((7 * i % 61, "\n".join(lines)))
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "x" * 500
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "short"), (5, "shirt\nshort"), (6, "a line of text that is long enough"), (7, "a line of text that is lung enough\na line of text that is long enoug"),
            (8, long + "a"), (9, long + "b"), (10, "b" + long), (None, "a line of text that is long enough!\nnew words in the last document"), (11, "one\n\ntwo\n\none"), (12, " \n\t")]
    assert run(spark, rows) == brute(rows)
    twice = [(1, "the very same line of some text\nother")] * 2
    assert [r[2] for r in run(spark, twice)] == [0, 0]
    assert run(spark, []) == []


def test_apply_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", 3, "s"), (2, "b\nc", 3, None), (3, "b", 1, "t")], "doc_id long, text string, n_chars long, source string")
    out = ld.apply(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a\nb", 3, "s"), (2, "c", 1, None), (3, "", 0, "t")]


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    assert run(spark, rows) == brute(rows)


def test_within_one():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert ld.within_one(a, b) == (distance(a, b) <= 1)


def test_halves_of_many_lines_equal_those_of_one():
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab é🙂") for _ in range(rng.randint(20, 70))) for _ in range(200)]
    assert ld._half_keys(lines).reshape(-1, 4).tolist() == [ld._keys(x, 2)[0].tolist() for x in lines]
