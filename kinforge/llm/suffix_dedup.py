"""Suffix-array dedup: repeated byte strings by distributed prefix doubling.

The ranks of prefix doubling decide which positions start an equal string of a given length; ranks of
equal strings at two positions half a length apart, taken as a pair, are the ranks at the full length.
Here a rank is a 64-bit hash of the string, Spark sorts (rank, position) rows, and a position whose rank
is its own alone is out.

Doubling from single bytes would sort every byte of the corpus eight times. Two facts save that without
losing a match. Every window of ``size`` bytes holds strings of half the size; the window's least rank
among those (its anchor) is the same wherever the window occurs, so the first sort takes anchors only,
about one byte in fifty. And where the whole stretch around an anchor, every window it stands for,
occurs again, all its windows repeat. Only anchors whose half repeats and whose stretch does not (at
the borders of repeats) go to the second round: their windows are sorted by the pair of ranks at the
window's start and half a size on.

Sorted rows are compared with their neighbours as they stream by, so a string that stands in a third of
all documents never has to be held anywhere. Nor do all its rows meet in one task: a slice of documents
settles what it sees twice (``_dealt``) and sends on one row a stretch, and two stretches a rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import Batches, batch, mapped, shuffle_partitions, stored, texts

SIZE = 200
LEAST = -(1 << 63)

#: A random value for each byte and an odd multiplier with its inverse modulo 2 ** 64, for rolling ranks.
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, count: int) -> np.ndarray:
    if len(_POWERS[kind]) < count:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[kind] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(count, 1 << 16) - 1, np.uint64(base))])
    return _POWERS[kind][:count]


def ranks(data: bytes, half: int) -> np.ndarray:
    """The rank of the ``half`` bytes at every position that has as many."""
    b = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * _powers("up", len(b)), out=sums[1:])
        h = (sums[half:] - sums[:-half]) * _powers("down", len(b) - half + 1)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def anchors(h: np.ndarray, half: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, first, last): each anchor and the first and last window it stands for.

    The anchor of the window at p is the leftmost least rank at p .. p + size - half.
    """
    width = size - half + 1
    windows = len(h) - width + 1
    padded = np.concatenate([h, np.full(-len(h) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    # Positions in order of rank are few a window; the leftmost one at or after p that has p's least.
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    ends = np.r_[starts[1:], windows] - 1
    hits = np.flatnonzero(h == _spread(least, len(h), width))
    at, first, last = [], [], []
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        i = int(np.searchsorted(hits, lo))
        while lo <= hi:
            while h[hits[i]] != least[lo]:
                i += 1
            p = int(hits[i])
            stop = min(hi, p)
            at.append(p)
            first.append(lo)
            last.append(stop)
            lo, i = stop + 1, i + 1
    return np.array(at), np.array(first), np.array(last)


def _spread(least: np.ndarray, count: int, width: int) -> np.ndarray:
    """For every position the greatest of the leasts of the windows that hold it: its own rank if it is
    the least of any of them, since no window that holds it has a greater one."""
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    n = len(padded)
    blocks = np.concatenate([padded, np.zeros(-n % width, np.uint64)]).reshape(-1, width)
    ahead = np.maximum.accumulate(blocks, 1).ravel()
    behind = np.maximum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.maximum(behind[:count], ahead[width - 1 : width - 1 + count])


_ANCHOR_DDL = "deal long, stretch long, doc long, h long, spot long"
_ANCHOR = pa.schema([(n, pa.int64()) for n in ("deal", "stretch", "doc", "h", "spot")])
_SPOT_DDL = "doc long, h long, spot long"
_SPOT = pa.schema([(n, pa.int64()) for n in ("doc", "h", "spot")])
_WINDOW_DDL = "rank long, doc long, h long, p long"
_WINDOW = pa.schema([(n, pa.int64()) for n in ("rank", "doc", "h", "p")])


def _pack(at, first, last):
    """Anchor, windows before and after in one number: 46, 8 and 8 bits."""
    return (at << 16) | ((at - first) << 8) | (at - last)


def _unpack(spot):
    at = spot >> 16
    return at, at - ((spot >> 8) & 255), at - (spot & 255)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        m = (a.view(np.uint64) ^ (b.view(np.uint64) >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + b.view(np.uint64)
        return ((m ^ (m >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _dealt(rank, stretch, doc, h, spot):
    """The anchors of a slice as rows (deal, stretch, doc, h, spot): those of equal deal meet in one task.

    Two bits are added to a spot: 1 where the slice has the stretch twice, 2 where it has the rank with
    several stretches. Of equal (rank, stretch) one row goes on; the others repeat for certain, need
    nobody and are dealt at random. Of a rank with several stretches two go on, so that the rank's other
    rows see that theirs is not the only one. The rest know it, and are dealt by rank and stretch: equal
    stretches elsewhere that are dealt by rank alone then count as borders too, and the windows of both meet.
    """
    order = np.lexsort((stretch, rank))
    r, s = rank[order], stretch[order]
    new_rank = np.r_[True, r[1:] != r[:-1]]
    new = new_rank | np.r_[True, s[1:] != s[:-1]]
    # How many rows the stretch has, and how many stretches the rank, and the stretch's place among them.
    nth = np.cumsum(new) - 1
    twice = np.bincount(nth)[nth] > 1
    of_rank = np.cumsum(new_rank) - 1
    stretches = np.bincount(of_rank[new])[of_rank]
    place = nth - nth[np.flatnonzero(new_rank)][of_rank]
    several = stretches > 1
    deal = np.where(several & (place > 1), _mixed(r, s), r)
    deal = np.where(new, deal, _mixed(_mixed(doc[order], h[order]), spot[order]))
    flags = twice.astype(np.int64) + 2 * (several & new)
    # Back in order of document, in which the columns compress best.
    back = np.argsort(order)
    return deal[back], np.where(new, s, 0)[back], doc, h, (spot << 2) | flags[back]


def _anchor_rows(size: int):
    half = size // 2

    def run(batches: Batches) -> Batches:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, cols = b.slice(lo, 256), [[], [], [], [], []]
                for doc, own, text in zip(*(part.column(c).to_pylist() for c in ("doc", "h", "text")), strict=True):
                    data = text.encode()
                    if len(data) < size:
                        continue
                    h = ranks(data, half)
                    at, first, last = anchors(h, half, size)
                    shape = ((at - first) << 8) | (at - last)
                    digest = xxhash.xxh3_64_intdigest
                    stretch = [digest(data[f : e + size], s) for f, e, s in zip(first.tolist(), last.tolist(), shape.tolist(), strict=True)]
                    for c, v in zip(cols, (h[at].view(np.int64), np.array(stretch, np.uint64).view(np.int64), np.full(len(at), doc), np.full(len(at), own), _pack(at, first, last)), strict=True):
                        c.append(v)
                if cols[0]:
                    yield batch(_ANCHOR, *_dealt(*map(np.concatenate, cols)))

    return run


def _with_neighbours(batches: Batches, names: list[str]):
    """Batches of sorted rows as arrays, with the row before and, by holding one back, the row after:
    yields (columns, previous row or None, next row or None)."""
    before = held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = [b.column(n).to_numpy() for n in names]
        if held is not None:
            yield held, before, [c[0] for c in now]
            before = [c[-1] for c in held]
        held = now
    if held is not None:
        yield held, before, None


def _same(cols, before, after) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row equals the one before, and the one after, in all of ``cols``."""
    step = np.logical_and.reduce([c[1:] == c[:-1] for c in cols]) if len(cols[0]) > 1 else np.empty(0, bool)
    first = before is not None and all(c[0] == x for c, x in zip(cols, before, strict=True))
    last = after is not None and all(c[-1] == x for c, x in zip(cols, after, strict=True))
    return np.r_[first, step], np.r_[step, last]


def _judge_anchors(batches: Batches) -> Batches:
    """The lowest bits of a spot's last field tell what to do: 1 the stretch repeats, 2 look at the windows."""
    names = ["deal", "stretch", "doc", "h", "spot"]
    for cols, before, after in _with_neighbours(batches, names):
        cut = lambda x, n: None if x is None else x[:n]
        a, b = _same(cols[:1], cut(before, 1), cut(after, 1))
        c, d = _same(cols[:2], cut(before, 2), cut(after, 2))
        # One row a stretch answers for its windows: the rows at the ends of equal ones, the first of those dealt by both.
        whole, border = c | d | (cols[4] & 1 == 1), (a & ~c) | (b & ~d) | (~c & (cols[4] & 2 == 2))
        kind = whole.astype(np.int64) + 2 * border
        keep = kind > 0
        yield batch(_SPOT, cols[2][keep], cols[3][keep], (cols[4][keep] & ~3) | kind[keep])


def _window_rows(size: int):
    half = size // 2

    def run(batches: Batches) -> Batches:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part, out = b.slice(lo, 64), [[], [], [], []]
                for doc, own, text, spots in zip(*(part.column(c).to_pylist() for c in ("doc", "h", "text", "spots")), strict=True):
                    h = ranks(text.encode(), half)
                    _, first, last = _unpack(np.array(spots) >> 2)
                    # Bit 0 of a window's place: it is known already, and here for the others' sake.
                    known = np.repeat(np.array(spots) & 1, last - first + 1)
                    p = np.repeat(first - np.r_[0, np.cumsum(last - first + 1)[:-1]], last - first + 1) + np.arange(len(known))
                    with np.errstate(over="ignore"):
                        pair = (h[p] * np.uint64(0xD6E8FEB86659FD93)) ^ h[p + half]
                    for c, v in zip(out, (pair.view(np.int64), np.full(len(p), doc), np.full(len(p), own), (p << 1) | known), strict=True):
                        c.append(v)
                if out[0]:
                    yield batch(_WINDOW, *map(np.concatenate, out))

    return run


def _judge_windows(batches: Batches) -> Batches:
    for cols, before, after in _with_neighbours(batches, ["rank", "doc", "h", "p"]):
        a, b = _same(cols[:1], None if before is None else before[:1], None if after is None else after[:1])
        keep = (a | b) & (cols[3] & 1 == 0)
        yield batch(_SPOT, cols[1][keep], cols[2][keep], cols[3][keep] >> 1)


def spans(size: int, whole: list[int], windows: list[int]) -> list[tuple[int, int]]:
    """Maximal removed runs from anchors whose stretch repeats and from single windows that repeat."""
    w = np.array(whole, np.int64) >> 2
    _, first, last = _unpack(w)
    p = np.array(windows, np.int64)
    lo, hi = np.r_[first, p], np.r_[last, p] + size
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    if not len(lo):
        return []
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return list(zip(lo[new].tolist(), hi[np.r_[new[1:] - 1, len(hi) - 1]].tolist(), strict=True))


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text, spans: (start, end) byte runs covered by ``size``-byte strings that start elsewhere too.

    Texts are UTF-8 bytes, null as empty, and strings never cross documents. Another start in the same
    document counts. Every string is judged on the input. Texts under ``size`` bytes have no span. Rows
    of equal id and text are copies of one another and get the same spans. Empty table: empty result.
    ``size`` is even, and 510 at most.
    """
    if size % 2 or not 2 <= size <= 510:
        raise ValueError("size must be even and at most 510")
    n = shuffle_partitions(docs.sparkSession)
    source = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(LEAST)).alias("doc"), F.xxhash64("text").alias("h"), "text")
    rows = mapped(source.select("doc", "h", "text"), _anchor_rows(size), _ANCHOR_DDL)
    sorted_rows = rows.repartition(n, "deal").sortWithinPartitions("deal", "stretch")
    found = stored(mapped(sorted_rows, _judge_anchors, _SPOT_DDL), "anchors")
    of_doc = ["doc", "h"]
    # Rows of equal id and text give equal spots; a set keeps one of each.
    border = found.where("spot & 2 = 2").groupBy(*of_doc).agg(F.collect_set("spot").alias("spots"))
    windows = mapped(source.join(border, of_doc).select("doc", "h", "text", "spots"), _window_rows(size), _WINDOW_DDL)
    single = mapped(windows.repartition(n, "rank").sortWithinPartitions("rank"), _judge_windows, _SPOT_DDL)
    whole = found.where("spot & 1 = 1").select(*of_doc, "spot", F.lit(True).alias("stretch")).union(single.select(*of_doc, "spot", F.lit(False)))
    marks = whole.groupBy(*of_doc).agg(F.collect_set(F.when(F.col("stretch"), F.col("spot"))).alias("whole"), F.collect_set(F.when(~F.col("stretch"), F.col("spot"))).alias("windows"))
    joined = source.join(marks, of_doc, "left").select("doc_id", "text", "whole", "windows")
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Batches) -> Batches:
        for b in batches:
            made = [
                [{"start": s, "end": e} for s, e in spans(size, w or [], p or [])]
                for w, p in zip(b.column("whole").to_pylist(), b.column("windows").to_pylist(), strict=True)
            ]
            yield batch(out, b.column("doc_id"), b.column("text"), made)

    return mapped(joined, run, "doc_id long, text string, spans array<struct<start:long,end:long>>")


def without_spans(spanned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            rows = []
            for text, gone in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data, kept, at = text.encode(), [], 0
                for s in gone:
                    kept.append(data[at : s["start"]])
                    at = s["end"]
                rows.append((len(data), sum(s["end"] - s["start"] for s in gone), len(gone), b"".join([*kept, data[at:]])))
            yield batch(out, b.column("doc_id"), *(zip(*rows, strict=True) if rows else [[]] * 4))

    return mapped(spanned, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

