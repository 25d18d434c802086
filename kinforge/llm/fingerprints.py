"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, whatever the document's
length. So the sketch of a union is the union of sketches, and the overlap of two sketches estimates
containment and resemblance without bias even where one document is far longer than the other.

A fingerprint is the number of distinct shingles, a hash of the whole text, and the kept hashes. Only equal
texts are alike by 1; two texts that share no kept hash are alike by 0, also where they are too short to keep any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import Batches, batch, mapped, shuffle_partitions, texts

#: Words of a shingle, and one shingle hash in so many is kept: a text of ten words keeps two on average.
WIDTH, SCALE = 3, 4
#: Bucket bounds that are searched at a time.
STRIDE = 64
LEAST = -(1 << 63)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sketch(text: str, width: int = WIDTH, scale: int = SCALE) -> tuple[int, int, np.ndarray]:
    """(number of distinct shingles, hash of the text, sorted hashes kept). Fewer words than ``width``: one shingle; none: none."""
    raw = text.encode()
    words, whole = raw.translate(LOWER).split(), xxhash.xxh3_64_intdigest(raw)
    if not words:
        return 0, whole, np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    with np.errstate(over="ignore"):
        n = max(1, len(h) - width + 1)
        mixed = np.full(n, len(words) if len(words) < width else width, np.uint64)
        for i in range(min(width, len(h))):
            mixed = (mixed ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    distinct = np.unique(mixed)
    return len(distinct), whole, distinct[: np.searchsorted(distinct, np.uint64((1 << 64) // scale))]


def as_string(n: int, whole: int, hashes: np.ndarray) -> str:
    return f"{n}:{whole:016x}:{hashes.astype('>u8').tobytes().hex()}"


def overlap(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> tuple[float, float | None]:
    """(estimated resemblance, estimated share of the shingles of ``a`` that ``b`` has; None where ``a`` keeps no hash).

    Resemblance is 1 for equal texts alone: sketches that agree in all k hashes of different texts give
    k / (k + 1), and 0 where there are none.
    """
    both = len(np.intersect1d(a[2], b[2], assume_unique=True))
    either = len(a[2]) + len(b[2]) - both
    share = both / len(a[2]) if len(a[2]) else None
    if a[:2] == b[:2]:
        return 1.0, share
    return both / (either + (both == either)), share


def sketches(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """doc_id, n_shingles, hashes (array of long, the kept hashes as signed numbers in unsigned order). Equal
    documents each have a row; null and empty texts have no hash."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        for b in batches:
            made = [sketch(t, width, scale) for t in b.column("text").to_pylist()]
            yield batch(out, b.column("doc_id"), [n for n, _, _ in made], [h.view(np.int64) for _, _, h in made])

    return mapped(texts(docs), run, "doc_id long, n_shingles long, hashes array<long>")


def merged(a, b) -> Column:
    """The sketch of two documents together."""
    return F.array_union(a, b)


def containment(a, b) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; null for an empty sketch."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many (or all) from the start of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _order_bounds(keyed: DataFrame) -> list[tuple[int, int]]:
    """The first key of each range partition: one a partition, from ids and hashes alone."""
    dealt = keyed.select("key", "h").repartitionByRange(shuffle_partitions(keyed.sparkSession), "key", "h")
    firsts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", "h")).alias("first"))
    return sorted((r["first"]["key"], r["first"]["h"]) for r in firsts.collect())


def _places(bounds: list[tuple[int, int]]) -> Column:
    """Where a document (key, h) goes: to its own bucket, and as its tail to the bucket before if it is a first one.

    The bounds are literals, searched in two steps of at most STRIDE, or as many strides as there are.
    """
    here = F.struct(F.col("key").alias("key"), F.col("h").alias("h"))
    flat = lambda some: F.array(*(F.struct(F.lit(k).alias("key"), F.lit(h).alias("h")) for k, h in some))
    reached = lambda firsts: F.size(F.filter(firsts, lambda b: b <= here))
    stride = F.greatest(reached(flat(bounds[::STRIDE])), F.lit(1)) - 1
    near = F.get(F.array(*(flat(bounds[lo : lo + STRIDE]) for lo in range(0, len(bounds), STRIDE))), stride)
    at = F.greatest(stride * STRIDE + reached(near) - 1, F.lit(0)).cast("int")
    is_first = F.exists(near, lambda b: b == here)
    own, before = F.struct(at.alias("bucket"), F.lit(False).alias("tail")), F.struct(F.pmod(at - 1, F.lit(len(bounds))).alias("bucket"), F.lit(True).alias("tail"))
    return F.when(is_first, F.array(own, before)).otherwise(F.array(own))


def with_next(docs: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_has, next_has.

    The last two are containments: the share of this document's shingles that the edited text, and the next
    document, have (null where it keeps none). Next is the document after this one in ascending (doc_id, text hash), nulls first; after the last
    comes the first, and a single document follows itself. Null text: empty; texts without words keep no
    hash. Rows that repeat follow one another. Empty table: empty result. A text is moved once, to the
    bucket of its key range, which is one task; the first document of a range also goes to the range before.
    """
    import hashlib

    keyed = texts(docs).select(F.coalesce("doc_id", F.lit(LEAST)).alias("key"), F.xxhash64("text").alias("h"), "text")
    bounds = _order_bounds(keyed)
    shares = [(n, pa.float64()) for n in ("near_edited", "near_next", "edited_has", "next_has")]
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), *shares])
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_has double, next_has double"

    def run(batches: Batches) -> Batches:
        bucket = before = None  # before: key, text and sketch of the row that waits for its next
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, rows = b.slice(lo, 256), []
                for key, own, tail, text in zip(*(part.column(c).to_pylist() for c in ("key", "bucket", "tail", "text")), strict=True):
                    if own != bucket:
                        bucket, before = own, None
                    if tail and before is None:
                        continue
                    made = sketch(text, width, scale)
                    if before is not None:
                        k, t, s = before
                        new = edited(t, text)
                        new_s = sketch(new, width, scale)
                        (near_edited, edited_has), (near_next, next_has) = overlap(s, new_s), overlap(s, made)
                        rows.append((None if k == LEAST else k, len(t), hashlib.sha256(new.encode()).hexdigest(), as_string(*s), as_string(*new_s), near_edited, near_next, edited_has, next_has))
                    before = None if tail else (key, text, made)
                yield batch(out, *zip(*rows, strict=True)) if rows else batch(out, *[[]] * len(out))

    if not bounds:
        return docs.sparkSession.createDataFrame([], ddl)
    moved = keyed.withColumn("place", F.explode(_places(bounds))).select("key", "h", "text", "place.bucket", "place.tail")
    dealt = moved.repartitionById(len(bounds), "bucket").sortWithinPartitions("bucket", "tail", "key", "h")
    return mapped(dealt, run, ddl)
