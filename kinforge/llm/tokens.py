"""Token ids of whole texts by a public tokenizer file, with the ids of frequent chunks remembered.

Texts are cut into chunks that the tokenizers never join (``chunks``). The ids of each distinct chunk, once
given by the library, are kept for the worker's life. Ids are little-endian unsigned 32-bit integers
throughout.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from kinforge.llm.chunks import bytes_of, encoded

#: Entries of each of a memory's two generations; what is forgotten is worked out again.
REMEMBERED = 300_000

_LOADED: dict[str, ChunkIds] = {}


def packed(ids) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Remembered(dict):
    """Values by key, worked out by ``make`` when missing. When it is full the older half goes; what is
    asked for again moves to the newer."""

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        value = self.older.get(key)
        self[key] = value = self.make(key) if value is None else value
        return value

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


class ChunkIds(Remembered):
    """chunk -> ids, by the library."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # the strings of special tokens are ordinary text

    def make(self, key: bytes) -> bytes:
        return packed(self.library.encode(key.decode(), add_special_tokens=False).ids)


def chunk_ids(path: str) -> ChunkIds:
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    _LOADED[path].trim()
    return _LOADED[path]


def column_ids(column: pa.Array, memory: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of a column in a row, bounds of each text's ids)."""
    return encoded(*bytes_of(column), memory)


def text_ids(path: str):
    """Encoder of one text."""
    return lambda text: column_ids(pa.array([text]), chunk_ids(path))[0].tobytes()
