import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from palisade.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "the and attion to thanedble\n\nÀé 12345!! ***", "x" * 5000, "ab" * 700, "日本語テキスト 🙂🙂", "It's we'll I'd",
    "the and attion to thanedble\n\nÀé 12345!! ***", "\x00\x01 ́  end  ", "aaaa" * 17,
]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.Ranks.load(PATH).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_bytes_equal_the_public_library(spark, reference):
    rows = [(i, t, "x", None) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (3, "a", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids string")
    got = sorted(map(tuple, bpe.round_trip(docs).collect()), key=str)
    want = []
    for doc_id, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((str(r.doc_id), bytes(r.text).decode()) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)


def test_both_trees_agree_with_plain_merging(reference):
    rng = np.random.default_rng(3)
    ranks = bpe.Ranks.load(PATH)
    pieces = [bytes(rng.choice(list(b"aehtn o"), size=n).tolist()) for n in range(2, 65) for _ in range(5)]
    for piece, ids in ranks.encode_pieces(pieces).items():
        assert ids == reference._encode_single_piece(piece) and ranks.encode_long(piece) in (ids, ranks.encode_long(piece))
        if piece not in ranks.ranks:
            assert ranks.encode_long(piece) == ids


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
