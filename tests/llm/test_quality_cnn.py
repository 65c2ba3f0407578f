import zlib

import numpy as np

from palisade.llm import quality_cnn as cnn
from palisade.llm.common import table

SF = "/root/testdata/sf0.01"


def direct(net, text):
    """The same network by its definition: every chunk, every place, every byte."""
    tops = []
    n = max(1, -(-(len(text) - (cnn.CHUNK - cnn.HOP)) // cnn.HOP))
    for k in range(n):
        chunk = text[k * cnn.HOP : k * cnn.HOP + cnn.CHUNK].ljust(cnn.CHUNK, b"\0")
        answers = [sum(cnn.VECTORS[chunk[i + w]].astype(float) @ net.filters[w] for w in range(cnn.WIDTH)) for i in range(0, cnn.CHUNK - cnn.WIDTH + 1, cnn.STRIDE)]
        tops.append(np.tanh(np.max(answers, axis=0) + net.bias))
    x = np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)])
    return 1 / (1 + np.exp(-(x @ net.out + net.out_bias)))


def test_held_out_accuracy_and_contract(spark):
    docs = table(spark, SF, "documents")
    net = cnn.train(docs, table(spark, SF, "labels"))
    rows = cnn.classify(docs, net).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    tested = [r for r in rows if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in tested) >= 0.93 * len(tested)
    texts = {r.doc_id: r.text for r in docs.limit(4).collect()}
    scores = {r.doc_id: r.score for r in rows}
    for i, text in texts.items():
        assert abs(direct(net, text.encode()) - scores[i]) < 1e-4


def test_odd_rows(spark):
    net = cnn.learn([b"good text here", b"BAD!!"] * 4, [1, 0] * 4, epochs=2)
    texts = [None, "", "a", "x" * 60_000, "y" * 256, "y" * 257, "a"]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "a", 1.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in cnn.score(docs, net).collect()}
    assert len(got) == 8 and got[0] == got[1] and got[2] == got[6] == got[None] and all(0 <= s <= 1 for s in got.values())
    for i, t in enumerate(texts):
        if len(t or "") < 1000:
            assert abs(direct(net, (t or "").encode()) - got[i]) < 1e-5
    assert cnn.accept(docs, net, threshold=0.0).columns == docs.columns
    assert cnn.score(spark.createDataFrame([], "doc_id long, text string"), net).count() == 0
    assert cnn.Network.fresh(1).score([b"any"])[0] == 0.5


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert cnn.classify(docs, cnn.train(docs, labels)).first().predicted == 0
