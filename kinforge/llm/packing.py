"""Packing: first-fit decreasing in randomised groups, with a tournament tree over bin capacities.

Documents are tokenised, closed with an end id and cut into pieces of at most one sequence. Pieces are
dealt at random into groups of bounded size; each group is packed by itself, longest piece first, into
the first sequence with room. A tree whose inner nodes hold the greater capacity of their two children
finds that sequence in a logarithm of the bins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.chunks import binary, closed, slices
from kinforge.llm.common import Batches, batch, mapped, ship_package, texts
from kinforge.llm.tokens import chunk_ids, column_ids

LENGTH = 2048
END_ID = 1
#: Pieces a group holds at most on average; a group is one task's work.
GROUP_PIECES = 16_384

_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
_PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; ``sizes`` must come in descending order."""
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            at += room[at] < size
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= size
        while at > 1:
            at //= 2
            top = max(room[2 * at], room[2 * at + 1])
            if room[at] == top:
                break
            room[at] = top
    return bins, offsets


def _mixed(seed: int, count: int) -> np.ndarray:
    """Well spread numbers, the same whenever the same rows come again."""
    with np.errstate(over="ignore"):
        x = np.arange(count, dtype=np.uint64) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _pieces(path: str, length: int, groups: int, id_type: str | None):
    schema = pa.schema([*_PIECE, ("pack_group", pa.int32()), *([("ids", pa.binary())] if id_type else [])])

    def run(batches: Batches) -> Batches:
        seen = TaskContext.get().partitionId() << 40
        for part in (p for b in batches for p in slices(b)):
            ids, bounds = closed(*column_ids(part.column("text"), chunk_ids(path)), END_ID)
            sizes = np.diff(bounds)
            pieces = -(-sizes // length)
            row = np.repeat(np.arange(len(sizes)), pieces)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
            size = np.minimum(sizes[row] - start, length)
            cut = np.r_[bounds[:-1][row] + start, len(ids)]
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            group = (_mixed(seen, len(row)) % np.uint64(groups)).astype(np.int32)
            seen += len(row)
            yield batch(schema, part.column("doc_id").take(pa.array(row)), start, size, crc, sizes[row], group, *([binary(ids.astype(id_type), cut)] if id_type else []))

    return run


def _dealt(docs: DataFrame, tokenizer: str, length: int, group_pieces: int, id_type: str | None):
    ship_package(docs.sparkSession)
    source = texts(docs)
    # A token has at least one byte, so this is at least the number of pieces.
    most = source.agg(F.sum(F.ceil((F.octet_length("text") + 1) / F.lit(length)))).first()[0] or 0
    groups = max(1, -(-int(most) // group_pieces))
    ddl = _PIECE_DDL + ", pack_group int" + (", ids binary" if id_type else "")
    return mapped(source, _pieces(tokenizer, length, groups, id_type), ddl).groupBy("pack_group")


def _placed(group: int, table: pa.Table, length: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The group's pieces by descending length with their sequences and offsets."""
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), length)
    return table, (group << 32) + bins, offsets


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file on every executor. A document has its ids and the end
    id, so null and empty texts give one piece of one id. Documents longer than a sequence are cut at
    multiples of it. Each piece stands in one sequence, at an offset that follows the piece before it;
    repeated rows and ids are packed like any others. Sequences of different groups never mix. Empty
    table: empty result.
    """

    def run(key, table):
        table, sequence, offset = _placed(key[0].as_py(), table, length)
        return pa.table({**{n: table.column(n) for n, _ in _PIECE}, "sequence_id": sequence, "offset": offset})

    return _dealt(docs, tokenizer, length, group_pieces, None).applyInArrow(run, _PIECE_DDL + ", sequence_id long, offset long")


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids, pieces (offset, length, doc_id, start).

    ``ids`` are gapless and little-endian, two bytes each where the vocabulary allows it and four else;
    ``pieces`` tell a loader where documents begin, for masks. Edge cases as for ``pack``.
    """
    from tokenizers import Tokenizer

    id_type = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    piece = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64())])

    def run(key, table):
        table, sequence, offset = _placed(key[0].as_py(), table, length)
        order = np.lexsort((offset, sequence))
        table, sequence, offset = table.take(pa.array(order)), sequence[order], offset[order]
        cuts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1], True])
        ids, sizes = table.column("ids").to_pylist(), table.column("length").to_pylist()
        rows = list(zip(offset.tolist(), sizes, table.column("doc_id").to_pylist(), table.column("start").to_pylist(), strict=True))
        runs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        pieces = [[dict(zip(("offset", "length", "doc_id", "start"), r, strict=True)) for r in rows[a:b]] for a, b in runs]
        return pa.table({
            "sequence_id": sequence[cuts[:-1]], "n_tokens": [sum(sizes[a:b]) for a, b in runs],
            "ids": pa.array([b"".join(ids[a:b]) for a, b in runs], pa.binary()), "pieces": pa.array(pieces, pa.list_(piece)),
        })

    ddl = "sequence_id long, n_tokens long, ids binary, pieces array<struct<offset:long,length:long,doc_id:long,start:long>>"
    return _dealt(docs, tokenizer, length, group_pieces, id_type).applyInArrow(run, ddl)
