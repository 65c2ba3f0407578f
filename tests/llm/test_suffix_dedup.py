import hashlib
import random

import pytest

from palisade.llm import suffix_dedup as sd
from palisade.llm.common import table


def brute(rows, length):
    """By definition: every window of every document in order, remembered with its first document and start."""
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen[w] = None
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length=100, parts=5):
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, n_bytes int, kept string").repartition(parts)
    got = sorted(map(tuple, sd.digest(docs, length).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert got == brute(rows, length)


def pieces(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aehtné") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 90))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 6))]
        text = "".join(parts) if rng.random() < 0.5 else "\n".join(parts)
        rows.append((i * 3 - 20, text[rng.randint(0, 30) :]))
    return rows + [(1000 + k, rows[5][1]) for k in range(4)] + [(2000, "ab" * 300), (2001, "a" * 400), (2002, "ab" * 90 + "c" + "a" * 150), (2003, None), (2004, ""), (None, rows[7][1] + "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_passages_equal_brute_force(spark, seed):
    check(spark, pieces(seed))


def test_segments_and_shorter_length(spark, monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 256)
    for text in (r[1] or "" for r in pieces(3)):
        data = text.encode()
        windows = [data[i : i + 60] for i in range(len(data) - 59)]
        assert sorted(sd.own_repeats(data, 60).tolist()) == [i for i, w in enumerate(windows) if w in windows[:i]]
        first, last, *_ = sd.blocks(data, 60).astype(int)
        assert sd._spread(first, last).tolist() == list(range(len(windows)))
    monkeypatch.undo()
    check(spark, pieces(4), 60)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    check(spark, rows)


def test_shared_ids_and_nothing(spark):
    long = "some words that fill up a line of text until it is over one hundred bytes long, which takes a while to say " * 2
    docs = spark.createDataFrame([(1, long), (1, long + "z"), (2, long), (2, long)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in sd.digest(docs).collect())
    assert got[2:] == [(2, len(long)), (2, len(long))] and all(r[1] < len(long) for r in got[:2])
    assert sd.digest(docs.filter("doc_id > 7")).count() == 0
