import collections
import itertools
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palisade.llm import queries
from palisade.llm import token_files as tf
from palisade.llm.common import shared_folder, table

TEXTS = [None, "", " ", "The and ATTION to. Don't 'tis O'Neil's!! in,, Straße ΣΑΣ İx é", "a\n\tb\x0b c\xa0d e", "x" * 30_000, "word " * 5000, "日本語 🙂🙂 ´ ́a",
         "<|endoftext|> ok", "In, in IN in. in!!! ###", "12 3a4 a1. b_c", "Å J̌"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def brute(rows, library):
    """``(doc_id, start, n, crc)`` in ascending order of doc_id, null last."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def folder(spark):
    return f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"


def test_round_trip(spark, library):
    rows = [(7 * i % 50 - 5, t) for i, t in enumerate(TEXTS)] + [(None, "null id")]
    docs = spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, shard int, content string")
    tf.write(docs, at := folder(spark), shard_bytes=20_000)
    got = tf.read_back(docs, at).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == brute(rows, library)
    assert all(r.indexed == (r.doc_id is not None) for r in got)
    unknown = spark.createDataFrame([(10**12 + i,) for i in range(500)], "doc_id long")
    assert tf.lookup(unknown, at).count() == 0


def test_given_documents(spark, library):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    tf.write(docs, at := folder(spark))
    got = tf.read_back(docs, at).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == brute([(r.doc_id, r.text) for r in docs.collect()], library)
    assert all(r.indexed for r in got)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(1, "c"), (2, "d")], "doc_id long, text string")
    tf.write(docs, at := folder(spark))
    got = tf.read_back(docs, at).orderBy("start").collect()
    assert len(got) == 5 and [r.doc_id for r in got] == [1, 1, 1, 1, 2] and sum(r.indexed for r in got) == 2
    empty = docs.filter("doc_id > 5")
    tf.write(empty, at := folder(spark))
    assert tf.read_back(empty, at).count() == 0


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    place = np.arange(len(keys))
    index = tf.Index(tf.build_index(keys, place, place * 3, place % 1000))
    known, shards, offsets, sizes = index.find(keys)
    assert known.all() and (shards == place).all() and (offsets == 3 * place).all() and (sizes == place % 1000).all()
    assert index.n == len(keys) and len(index.fingerprints) == len(keys)
    assert index.find(keys + 1)[0].sum() <= 2


def test_query_takes_added_tokens_as_the_library_does(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert len(library.encode("a <|endoftext|> ok", add_special_tokens=False).ids) == 3
    texts = [*TEXTS, "a <|endoftext|> ok", "in<|startoftext|>,b<|endoftext|><|endoftext|>\n<|ENDOFTEXT|> <|endoftext|", "é<|endoftext|>́a", "end<|endoftext|>"]
    rows = list(enumerate(texts))
    at = folder(spark)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    assert [tuple(r)[:4] for r in queries.op4_token_files(spark, at).orderBy("start").collect()] == brute(rows, library)


def test_encoder_against_the_library_on_odd_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), tf.Encoder(path, added_tokens=True), random.Random(5)
    bits = ["a", "Ab", "the", "İ", "Σ", "ς", "ß", "é", "é", "́", "Å", "J̌", "K", "ǅ", "日本", "가", "가", "🙂", "7", "½", "²", "ª", "_", "-", "'s", "'", "’",
            *" \t\n\x0b\x0c\r\x1c\x85\xa0 　​﻿\x00", *".,!?;:*#$%&)", "###", "|", "<|endoftext|>", "<|startoftext|>", "�", "𝒜", "ﬁ", "ا", "ऩ", "क़"]
    texts = [None, *("".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(6000))]
    texts += [" ".join(x or "" for x in texts), "", " \n "]
    got = own.encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, own.dtype).tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert own.encode(pa.array([], pa.string())) == []


def test_frequent_words_go_to_the_library_once(monkeypatch):
    """However often the memory overflows with rare ones."""
    monkeypatch.setattr(tf, "REMEMBERED", 300)
    monkeypatch.setattr(tf, "REMEMBERED_WHOLE", 300)
    own, seen = tf.Encoder(public_tokenizers.path("word_bpe_49k.json")), collections.Counter()
    for name in ("_letters", "_one_by_one"):
        ask = getattr(own, name)
        monkeypatch.setattr(own, name, lambda parts, ask=ask: seen.update(parts) or ask(parts))
    rare = ["".join(x) for x in itertools.product("abcdefgh", repeat=4)]
    for start in range(0, len(rare), 256):
        own.encode(pa.array([f"the {x}, The end. x{x}-y a-b" for x in rare[start : start + 256]]))
    assert len(own.known) <= 600 and len(own.whole) <= 600 and len(own.tails) == 2
    assert all(seen[x] == 1 for x in ("the", "end", ".", ",", "a-b")), seen.most_common(5)


def test_parts_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(tf, "PART_BYTES", 50)
    texts = [None, "x" * 30, "", "y" * 40, "z" * 500, None, "a", "b" * 49, "c"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    parts = list(tf._parts(batch))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and len(parts) > 3
    assert sum(p.num_rows for p in tf._parts(batch.slice(0, 0))) == 0
