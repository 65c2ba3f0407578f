"""Byte-level BPE by a segment tree.

Each match of the splitting pattern is encoded alone.  Leaf ``i`` of its tree
holds the rank of the pair that the token starting at byte ``i`` forms with the
next one, together with ``i``; inner nodes hold the least of their children, so
the root names the leftmost pair of least rank.  A merge kills one leaf and
updates its two live neighbours: three walks to the root.  Pieces of up to 64
bytes are encoded many at a time, their trees side by side in one array.

Null texts count as empty and give no ids.  Lone surrogates cannot occur in Spark
strings.  Rows that repeat, and rows with a null ``doc_id``, are encoded like any other.
Of pairs with one rank the leftmost is merged first.  A text of any length is encoded whole; a piece of
it that the pattern matches is one tree.  An empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame

from palisade.llm.common import in_arrow, public_vocabulary

#: Pieces whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 300_000
NONE = np.int64(1) << 40


class Ranks:
    """A vocabulary of byte strings with ranks, as published in ``.tiktoken`` files."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.width = len(self.bytes_of) + 1
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.width + right] = rank
        order = sorted(self.pairs.items())
        self.pair_keys = np.array([k for k, _ in order] or [-1], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in order] or [NONE], dtype=np.int64)

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece of any length, in O(n log n)."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        dead = int(NONE) * size
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, width = self.pairs, self.width
        none = int(NONE)
        tree = [dead] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = pairs.get(ids[i] * width + ids[i + 1], none) * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            k >>= 1
            while k:
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while tree[1] < dead:
            rank, i = divmod(tree[1], size)
            j = after[i]
            ids[i] = rank
            ids[j] = -1
            after[i] = nxt = after[j]
            put(j, dead)
            if nxt < n:
                before[nxt] = i
                put(i, pairs.get(rank * width + ids[nxt], none) * size + i)
            else:
                put(i, dead)
            if (p := before[i]) >= 0:
                put(p, pairs.get(ids[p] * width + rank, none) * size + p)
        return [x for x in ids if x >= 0]

    def encode_short(self, pieces: list[bytes]) -> list[list[int]]:
        """Pieces of at most 64 bytes: one tree per row of an array, all merged in step."""
        if not pieces:
            return []
        lengths = np.array([len(p) for p in pieces])
        size = 1 << max(1, int(lengths.max() - 1).bit_length())
        m, dead = len(pieces), NONE * size
        ids = np.full((m, size + 1), -1, dtype=np.int64)
        inside = np.arange(size)[None, :] < lengths[:, None]
        ids[:, :size][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        after = np.tile(np.arange(1, size + 1), (m, 1))
        before = np.tile(np.arange(-1, size - 1), (m, 1))
        tree = np.full((m, 2 * size), dead, dtype=np.int64)
        place = np.arange(size)
        paired = np.arange(size)[None, :] < (lengths - 1)[:, None]
        found = self.ranks_of(ids[:, :size], ids[:, 1:])
        tree[:, size:] = np.where(paired & (found < NONE), found * size + place, dead)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

        def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
            k = size + at
            tree[rows, k] = values
            k = k >> 1
            while k[0]:
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                k = k >> 1

        rows = np.flatnonzero(tree[:, 1] < dead)
        while len(rows):
            rank, i = tree[rows, 1] // size, tree[rows, 1] % size
            j = after[rows, i]
            nxt = after[rows, j]
            ids[rows, i] = rank
            ids[rows, j] = -1
            after[rows, i] = nxt
            put(rows, j, np.full(len(rows), dead))
            has = nxt < lengths[rows]
            before[rows[has], nxt[has]] = i[has]
            right = np.where(has, ids[rows, np.minimum(nxt, size)], 0)
            found = np.where(has, self.ranks_of(rank, right), NONE)
            put(rows, i, np.where(found < NONE, found * size + i, dead))
            p = before[rows, i]
            has = p >= 0
            if has.any():
                r, q = rows[has], p[has]
                found = self.ranks_of(ids[r, q], rank[has])
                put(r, q, np.where(found < NONE, found * size + q, dead))
            rows = rows[tree[rows, 1] < dead]
        return [[x for x in row if x >= 0] for row in ids.tolist()]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        short: dict[int, list[bytes]] = {}
        for piece in pieces:
            if (whole := self.ranks.get(piece)) is not None:
                out[piece] = [whole]
            elif len(piece) > 64:
                out[piece] = self.encode_long(piece)
            else:
                short.setdefault((len(piece) - 1).bit_length(), []).append(piece)
        for alike in short.values():
            for start in range(0, len(alike), 4096):
                part = alike[start : start + 4096]
                out.update(zip(part, self.encode_short(part), strict=True))
        return out


class Codec:
    """Encoder and decoder of one worker, remembering the pieces it met lately."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = Ranks.load(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = {piece for pieces in split for piece in pieces if piece not in known}
        if new:
            names = {piece.encode(): piece for piece in new}
            for piece, ids in self.ranks.encode_pieces(list(names)).items():
                known[names[piece]] = np.array(ids, dtype="<u4").tobytes()
        return [b"".join(map(known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _settings(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_vocabulary("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row; ``ids`` as little-endian unsigned 32-bit integers."""
    path, pattern = _settings(path, pattern)

    def run(rows):
        for row, ids in zip(rows, codec(path, pattern).encode([r["text"] or "" for r in rows]), strict=True):
            yield {"doc_id": row["doc_id"], "n_tokens": len(ids) // 4, "ids": ids}

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of rows that ``encode`` gave; ``text`` as bytes, since any ids may be given. Null ids: empty."""
    path, pattern = _settings(path, pattern)

    def run(rows):
        for row in rows:
            yield {"doc_id": row["doc_id"], "text": codec(path, pattern).decode(row["ids"] or b"")}

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id bigint, text binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode in one pass: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``."""
    path, pattern = _settings(path, pattern)

    def run(rows):
        own = codec(path, pattern)
        for row, ids in zip(rows, own.encode([r["text"] or "" for r in rows]), strict=True):
            yield {
                "doc_id": row["doc_id"], "n_tokens": len(ids) // 4, "ids_sha256": hashlib.sha256(ids).hexdigest(),
                "decoded_sha256": hashlib.sha256(own.decode(ids)).hexdigest(),
            }

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return in_arrow(docs.select("doc_id", "text"), run, schema)
