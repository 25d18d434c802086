"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is what the merges make of its bytes exactly when every two neighbours are what
the merges make of those two alone. So each prefix of a piece has one valid last token: the token that
ends there and is compatible with the last token of what stands before it. Storing that token for every
prefix gives the encoding of every prefix, appends bytes without looking back further than the longest
token, and encodes again from an edit on only.
"""

from __future__ import annotations

import base64
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.chunks import binary, bytes_of, gathered, slices
from kinforge.llm.common import Batches, batch, mapped, texts
from kinforge.llm.tokens import Remembered, column_ids, packed

_LOADED: dict[tuple[str, str], Encoder] = {}


class Vocabulary:
    """Ranks of byte strings; the lower rank merges first, of equal ones the left."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits = _Fits(self)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)})

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``."""
        if token not in self._halves:
            whole = self.tokens[token]
            cuts = ((self.ranks.get(whole[:i]), self.ranks.get(whole[i:])) for i in range(1, len(whole)))
            self._halves[token] = next(c for c in cuts if None not in c and self._stay_apart(*c, token))
        return self._halves[token]

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at one end of ``token`` while it is built, the byte first."""
        edge = [token]
        while len(self.tokens[edge[-1]]) > 1:
            edge.append(self.halves(edge[-1])[side])
        return edge[::-1]

    def _stay_apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of rank under ``before`` joins the end of ``left`` to the start of ``right``."""
        ends, starts = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            grows_left = ends[i + 1] if i + 1 < len(ends) else before
            grows_right = starts[j + 1] if j + 1 < len(starts) else before
            joined = self.ranks.get(self.tokens[ends[i]] + self.tokens[starts[j]])
            if joined is not None and joined < before and joined < grows_left and joined <= grows_right:
                return False
            if i + 1 < len(ends) and (grows_left <= grows_right or j + 1 == len(starts)):
                i += 1
            elif j + 1 < len(starts):
                j += 1
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding."""
        return self._fits[left << 32 | right]

    def trim(self) -> None:
        self._fits.trim()


class _Fits(Remembered):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def make(self, pair: int) -> bool:
        return self.vocabulary._stay_apart(pair >> 32, pair & 0xFFFFFFFF, 1 << 62)


class PrefixTable:
    """The last token of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: the tokens of the earlier prefixes stay as they are."""
        v, get, fits, last = self.vocabulary, self.vocabulary.ranks.get, self.vocabulary.fits, self.last
        data, self.data = self.data + more, self.data + more
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - v.longest), end):
                token = get(data[start:end])
                if token is not None and (not start or fits(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")

    def truncate(self, size: int) -> None:
        self.data = self.data[:size]
        del self.last[size:]

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Change bytes; prefixes that end before ``start`` are not computed again."""
        tail = self.data[end:]
        self.truncate(start)
        self.append(new + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder(Remembered):
    """chunk -> ids as bytes."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)

    def piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        return packed(PrefixTable(self.vocabulary, data).ids() if whole is None else [whole])

    def make(self, chunk: bytes) -> bytes:
        return b"".join(map(self.piece, self.pattern.findall(chunk.decode())))

    def trim(self) -> None:
        super().trim()
        self.vocabulary.trim()

    def encode(self, text: str) -> bytes:
        self.trim()
        return column_ids(pa.array([text]), self)[0].tobytes()

    @cached_property
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens in a row, and by id where they start and how many they are."""
        tokens = [self.vocabulary.tokens.get(i, b"") for i in range(max(self.vocabulary.tokens, default=-1) + 1)]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


class EditableText:
    """A text and its tokens, kept right under appends and edits."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.pieces = encoder, encoder.pattern.findall(text)

    @property
    def text(self) -> str:
        return "".join(self.pieces)

    def ids(self) -> bytes:
        return b"".join(map(self.encoder.piece, self.pieces))

    def append(self, more: str) -> None:
        self.replace(None, None, more)

    def replace(self, start: int | None, end: int | None, new: str) -> None:
        """Pieces from three before the edit on are split again, until a border after it is an old one."""
        size = sum(map(len, self.pieces))
        start, end = size if start is None else start, size if end is None else end
        first = at = 0
        while first < len(self.pieces) and at + len(self.pieces[first]) <= start:
            at += len(self.pieces[first])
            first += 1
        back = self.pieces[max(0, first - 3) : first]
        first, at = first - len(back), at - sum(map(len, back))
        rest = self.pieces[first:]
        tail = "".join(rest)
        text = tail[: start - at] + new + tail[end - at :]
        shift, old, borders = len(text) - len(tail), 0, {}
        for i, p in enumerate(rest):
            borders[old + shift] = first + i
            old += len(p)
        fresh, place = [], 0
        for m in self.encoder.pattern.finditer(text):
            if place >= start - at + len(new) and place in borders:
                self.pieces[first:] = fresh + self.pieces[borders[place] :]
                return
            fresh.append(m[0])
            place = m.end()
        self.pieces[first:] = fresh


def loaded(path: str, pattern: str) -> Encoder:
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = Encoder(Vocabulary.read(path), pattern)
    return _LOADED[key]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids: the ids of every whole text as little-endian unsigned 32-bit integers.

    ``ranks`` is the path of a rank file on every executor; each match of ``pattern`` is encoded by
    itself, without special tokens. Null and empty texts have no ids; repeated rows each get theirs;
    an empty table gives an empty result.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Batches) -> Batches:
        encoder = loaded(ranks, pattern)
        for part in (p for b in batches for p in slices(b)):
            encoder.trim()
            yield batch(out, part.column("doc_id"), binary(*column_ids(part.column("text"), encoder)))

    return mapped(texts(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids, data: the bytes that the ids stand for. Null ids count as none."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches: Batches) -> Batches:
        flat, starts, sizes = loaded(ranks, pattern).token_bytes
        for part in (p for b in batches for p in slices(b, "ids")):
            raw, borders = bytes_of(pa.compute.fill_null(part.column("ids"), b""))
            data, ends = gathered(flat, starts, sizes, raw.view("<u4"))
            yield batch(out, part.column("doc_id"), part.column("ids"), binary(data, np.r_[0, ends][borders // 4]))

    return mapped(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, data binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again."""
    both = decode(encode(docs, ranks, pattern), ranks, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
