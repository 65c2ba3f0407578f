import math
import re
from collections import Counter

from palisade.llm import quality_rules as qr
from palisade.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n)


def fit(patterns, rules, rounds):
    prior, good, bad = 0.85, [[0.05, 0.8, 0.15]] * rules, [[0.4, 0.4, 0.2]] * rules
    for _ in range(rounds):
        p = {x: post(x, prior, good, bad) for x in patterns}
        n, g = sum(patterns.values()), sum(c * p[x] for x, c in patterns.items())
        share = lambda of, whole: [[(1 + sum(of(x, c) for x, c in patterns.items() if x[k] == v)) / (3 + whole) for v in range(3)] for k in range(rules)]
        prior, good, bad = (g + 1) / (n + 2), share(lambda x, c: c * p[x], g), share(lambda x, c: c * (1 - p[x]), n - g)
    return prior, good, bad


def post(x, prior, good, bad):
    return 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(math.log(good[k][v] / bad[k][v]) for k, v in enumerate(x))))


def test_statistics_equal_plain_python(spark):
    eight = "a b c d e f g h "
    texts = [None, "", " \t\x0b", "a\nb\na\n\n \na", eight * 3, eight * 2 + "x " + eight, "é ü |#* " * 40, "w " * 30, " x y z\x1c", "a" * 50_000 + " " + "b c " * 9_000]
    rows = [(i, t, 1, True) for i, t in enumerate(texts)] + [(None, "null id", 2, None), (3, "a\nb\na\n\n \na", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in qr.judge(docs, rounds=3).collect()]
    assert sorted(got, key=str) == sorted([(i, *plain(t)) for i, t, *_ in rows], key=str)


def test_corpus_and_model(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    judged = {r.doc_id: r for r in qr.judge(docs).collect()}
    for r in docs.collect():
        g = judged[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == plain(r.text)
    voted = qr.base(docs).select(*[v.alias(k) for k, v in qr.votes().items()], "doc_id").collect()
    pattern = {r.doc_id: tuple(2 if v is None else v for v in r[:-1]) for r in voted}
    model = fit(Counter(pattern.values()), len(qr.votes()), qr.ROUNDS)
    for i, g in judged.items():
        p = post(pattern[i], *model)
        assert abs(p - g.quality) < 1e-6 and (abs(p - 0.5) < 1e-6 or g.kept == (not g.base_failed and p >= 0.5))


def test_verdicts_follow_hidden_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = qr.judge(table(spark, sf, "documents")).select("doc_id", "base_failed", "kept")
    rows = [r for r in judged.join(table(spark, sf, "labels"), "doc_id").collect() if not r.base_failed]
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.97 * len(rows)


def test_empty_table(spark):
    assert qr.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
