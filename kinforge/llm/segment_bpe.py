"""BPE encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A piece starts as one token a byte. The leaves of a tree hold the rank of the merge that each token and the
next one would make, its inner nodes the least of their two children. So the root has the lowest rank, and
the way down that prefers the left child ends at its leftmost place. A merge changes one token, takes one
out, and sets at most three leaves, each in a logarithm of the piece; when the root has no rank, nothing can
be merged any more. A piece of a million equal letters costs no more a byte than a short word, but for that
logarithm.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.chunks import binary, bytes_of, encoded, gathered, slices
from kinforge.llm.common import Batches, batch, mapped, texts
from kinforge.llm.tokens import Remembered, packed

NO_MERGE = 1 << 62
_LOADED: dict[tuple[str, str], Codec] = {}


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be seen, else
    one of those from U+0100 on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class PairTree:
    """The least rank of any adjacent pair, and where it stands first."""

    def __init__(self, ranks: list[int]):
        self.leaves = 1 << max(0, (len(ranks) - 1).bit_length())
        self.least = [NO_MERGE] * self.leaves + ranks + [NO_MERGE] * (self.leaves - len(ranks))
        for i in range(self.leaves - 1, 0, -1):
            left, right = self.least[2 * i], self.least[2 * i + 1]
            self.least[i] = left if left <= right else right

    def first(self) -> int:
        """The leftmost place of the lowest rank, -1 if no pair has one."""
        least, at = self.least, 1
        wanted = least[1]
        if wanted == NO_MERGE:
            return -1
        while at < self.leaves:
            at *= 2
            if least[at] != wanted:
                at += 1
        return at - self.leaves

    def set(self, place: int, rank: int) -> None:
        least, at = self.least, place + self.leaves
        least[at] = rank
        while at > 1:
            at >>= 1
            left, right = least[2 * at], least[2 * at + 1]
            value = left if left <= right else right
            if least[at] == value:
                return
            least[at] = value


class Merges:
    """The merges of a vocabulary: (left id, right id) to (rank, merged id)."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.pairs = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.byte_ids = [vocabulary[c] for c in byte_letters()]

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        get = self.pairs.get
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        none = (NO_MERGE, -1)
        tree = PairTree([get(pair, none)[0] for pair in zip(ids, ids[1:], strict=False)])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (at := tree.first()) >= 0:
            gone = after[at]
            ids[at] = get((ids[at], ids[gone]))[1]
            ids[gone] = -1
            follows = after[gone]
            after[at] = follows
            if gone < n - 1:
                tree.set(gone, NO_MERGE)
            if follows < n:
                before[follows] = at
                tree.set(at, get((ids[at], ids[follows]), none)[0])
            else:
                tree.set(at, NO_MERGE)
            prior = before[at]
            if prior >= 0:
                tree.set(prior, get((ids[prior], ids[at]), none)[0])
        return [i for i in ids if i >= 0]


class Codec(Remembered):
    """chunk -> ids as bytes, for a tokenizer file of byte-level BPE; special tokens stand for their own strings."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        self.merges = Merges(vocabulary, [tuple(m.split(" ") if isinstance(m, str) else m) for m in file["model"]["merges"]])
        self.pattern = regex.compile(pattern)
        self.special = {t["content"].encode(): t["id"] for t in file["added_tokens"]}
        tokens = {i: t for t, i in vocabulary.items()} | {i: t.decode() for t, i in self.special.items()}
        letters = {c: b for b, c in enumerate(byte_letters())}
        raw = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (tokens.get(i, "") for i in range(max(tokens) + 1))]
        self.token_sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def make(self, chunk: bytes) -> bytes:
        if chunk in self.special:
            return packed([self.special[chunk]])
        return b"".join(packed(self.merges.encode(piece.encode())) for piece in self.pattern.findall(chunk.decode()))

    def encode(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text's ids); a text is cut at special tokens first."""
        spans = [borders]
        raw = data.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                if borders[np.searchsorted(borders, at, "right") :][:1] >= at + len(mark):  # not across two texts
                    spans.append(np.array([at, at + len(mark)]))
                    at = raw.find(mark, at + len(mark))
                else:
                    at = raw.find(mark, at + 1)
        parts = np.unique(np.concatenate(spans)) if len(spans) > 1 else borders
        ids, bounds = encoded(data, parts, self)
        return ids, bounds[np.searchsorted(parts, borders)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all id sequences in a row, bounds of each one's)."""
        data, ends = gathered(self.token_bytes, self.token_starts, self.token_sizes, ids)
        return data, np.r_[0, ends][bounds]


def loaded(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = Codec(path, pattern)
    _LOADED[key].trim()
    return _LOADED[key]


def encode(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """doc_id, ids: the ids of every whole text as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a tokenizer file on every executor; each match of ``pattern`` is merged by
    itself. The string of a special token in a text is that token, as the tokenizers library has it. Null and
    empty texts have no ids; repeated rows each get theirs; an empty table gives an empty result.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Batches) -> Batches:
        for part in (p for b in batches for p in slices(b)):
            yield batch(out, part.column("doc_id"), binary(*loaded(tokenizer, pattern).encode(*bytes_of(part.column("text")))))

    return mapped(texts(docs), run, "doc_id long, ids binary")


def decode(ids: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """doc_id, ids, text: what the ids stand for, special tokens included. Null ids count as none; bytes that are
    no UTF-8 become U+FFFD."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Batches) -> Batches:
        for part in (p for b in batches for p in slices(b, "ids")):
            raw, borders = bytes_of(pc.fill_null(part.column("ids"), b""))
            data = binary(*loaded(tokenizer, pattern).decode(raw.view("<u4"), borders // 4))
            try:
                text = data.cast(pa.string())
            except pa.ArrowInvalid:
                text = pa.array([x.decode("utf-8", "replace") for x in data.to_pylist()], pa.string())
            yield batch(out, part.column("doc_id"), part.column("ids"), text)

    return mapped(ids.select("doc_id", "ids"), run, "doc_id long, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again."""
    both = decode(encode(docs, tokenizer, pattern), tokenizer, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
