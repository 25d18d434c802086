"""Token-id files with keyed access through minimal perfect hash indexes.

Payload: documents in ascending ``doc_id`` order, range-partitioned into shards; a shard file is the raw
ids of its documents one after the other, little-endian, two bytes an id where the vocabulary allows it
and four else. Index: the keys (doc_id and a number among equal ids) fall into buckets by hash; a bucket
file holds a minimal perfect hash function, and at each key's place a fingerprint, the shard, the offset
and the length. A lookup hashes the key, probes a few bit sets, compares the fingerprint and has the
place: the keys themselves are not stored.

Executors write below a folder that all of them share, each file under a name of its own attempt first,
so a task that is run again leaves one whole file.
"""

from __future__ import annotations

import json
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinforge.llm.chunks import closed, slices
from kinforge.llm.common import Batches, batch, forget_at_exit, mapped, ship_package, shuffle_partitions, stored, texts
from kinforge.llm.tokens import chunk_ids, column_ids
from kinforge.session import shared_dir

END_ID = 0
#: Keys an index bucket holds on average.
BUCKET_KEYS = 500_000
GAMMA = 2
LEAST = -(1 << 63)
MAGIC = b"KFMPHF01"

_ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("length", "<u8")])


def hashed(keys: np.ndarray, numbers: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of (key, number)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + numbers.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 0xA0761D6478BD642F & (2**64 - 1))
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Distinct keys to 0 .. n-1 by levels of bit sets: a key belongs to the first level where it alone
    hits its bit, and its number is the count of bits before that one."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def build(cls, keys: np.ndarray, numbers: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(keys):
            size = -(-GAMMA * len(keys) // 64) * 64
            at = hashed(keys, numbers, len(sizes) + 1) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = ~alone[at.astype(np.int64)]
            keys, numbers = keys[left], numbers[left]
            if len(sizes) > 200:
                raise ValueError("keys repeat")
        return cls(sizes, np.concatenate(words) if words else np.empty(0, "<u8"))

    def __len__(self) -> int:
        return int(self.before[-1])

    def find(self, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """The place of each key, or -1 where no bit is set for it."""
        out, base, open_ = np.full(len(keys), -1), 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = base + (hashed(keys[open_], numbers[open_], level + 1) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = (self.before[at >> 6] + low)[hit]
            open_, base = open_[~hit], base + size
        return out


def _prints(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (hashed(keys, numbers, 0) >> np.uint64(32)).astype(np.uint32)


def _opened(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _write(uri: str, name: str, parts) -> None:
    fs, root = _opened(uri)
    draft = f"{root}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as f:
        for p in parts:
            f.write(p)
    fs.move(draft, f"{root}/{name}")


def write_index(uri: str, bucket: int, keys, numbers, shards, offsets, lengths) -> None:
    function = PerfectHash.build(keys, numbers)
    entries = np.zeros(len(keys), _ENTRY)
    at = function.find(keys, numbers)
    for name, values in (("print", _prints(keys, numbers)), ("shard", shards), ("offset", offsets), ("length", lengths)):
        entries[name][at] = values
    head = json.dumps({"sizes": function.sizes, "keys": len(keys)}).encode()
    _write(uri, f"index-{bucket}", (MAGIC, struct.pack("<Q", len(head)), head, function.words.tobytes(), entries.tobytes()))


def look_up(uri: str, bucket: int, keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, entries): whether each key is in the index, and its entry."""
    fs, root = _opened(uri)
    with fs.open_input_stream(f"{root}/index-{bucket}") as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError("not an index file")
    (size,) = struct.unpack_from("<Q", data, 8)
    head = json.loads(data[16 : 16 + size])
    words = np.frombuffer(data, "<u8", sum(head["sizes"]) // 64, 16 + size)
    entries = np.frombuffer(data, _ENTRY, head["keys"], 16 + size + words.nbytes)
    at = PerfectHash(head["sizes"], words).find(keys, numbers)
    known = at >= 0
    found = np.zeros(len(keys), _ENTRY)
    found[known] = entries[at[known]]
    return known & (found["print"] == _prints(keys, numbers)), found


def _payload(uri: str, tokenizer: str, narrow: bool):
    out = pa.schema([("key", pa.int64()), ("number", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Batches) -> Batches:
        shard = TaskContext.get().partitionId()
        fs, root = _opened(uri)
        draft, offset, last, number = f"{root}/shard-{shard}.{uuid.uuid4().hex}", 0, None, 0
        with fs.open_output_stream(draft) as f:
            for part in (p for b in batches for p in slices(b)):
                ids, bounds = closed(*column_ids(part.column("text"), chunk_ids(tokenizer)), END_ID)
                f.write((ids.astype("<u2") if narrow else ids).tobytes())
                keys, numbers = part.column("key").to_pylist(), []
                for key in keys:
                    number = number + 1 if key == last else 0
                    numbers.append(number)
                    last = key
                yield batch(out, keys, numbers, np.full(len(keys), shard, np.int32), offset + bounds[:-1], np.diff(bounds))
                offset += len(ids)
        fs.move(draft, f"{root}/shard-{shard}")

    return run


def write_store(docs: DataFrame, tokenizer: str, uri: str) -> DataFrame:
    """Write payload and index below ``uri``; the layout, one row a document: key, number, shard, offset, length.

    Null ids have the least key; null and empty texts are the end id alone. Documents of equal id follow
    one another in order of their text's hash and are numbered. An empty table writes no document.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    narrow = Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16
    keyed = texts(docs).select(F.coalesce("doc_id", F.lit(LEAST)).alias("key"), "text")
    dealt = keyed.repartitionByRange(shuffle_partitions(spark), "key").sortWithinPartitions("key", F.xxhash64("text"))
    layout = stored(mapped(dealt, _payload(uri, tokenizer, narrow), "key long, number long, shard int, offset long, length long"), "layout")
    buckets = bucket_count(layout)

    def index(key, table):
        write_index(uri, key[0].as_py(), *(table.column(n).to_numpy() for n in ("key", "number", "shard", "offset", "length")))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([table.num_rows], pa.int64())})

    layout.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(index, "bucket int, keys long").agg(F.sum("keys")).collect()
    meta = json.dumps({"buckets": buckets, "bytes": 2 if narrow else 4}).encode()
    _write(uri, "meta", (meta,))
    return layout


def bucket_count(layout: DataFrame) -> int:
    return max(1, -(-layout.count() // BUCKET_KEYS))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("key", "number"), F.lit(buckets)).cast("int").alias("bucket")


def _meta(uri: str) -> dict:
    fs, root = _opened(uri)
    with fs.open_input_stream(f"{root}/meta") as f:
        return json.loads(f.read())


def read_store(keys: DataFrame, uri: str) -> DataFrame:
    """Keyed access: key, number, shard, offset, length, ids (little-endian unsigned 32-bit) of the documents
    asked for in ``keys(key, number)``. Keys that the store does not have give no row (but for one
    in four billion, which a fingerprint lets through)."""
    ship_package(keys.sparkSession)
    meta = _meta(uri)
    width = meta["bytes"]
    place = "key long, number long, shard int, offset long, length long"
    fields = [("key", pa.int64()), ("number", pa.int64()), ("shard", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]

    def find(bucket, table):
        k, n = (table.column(c).to_numpy() for c in ("key", "number"))
        known, found = look_up(uri, bucket[0].as_py(), k, n)
        cols = (k[known], n[known], *(found[c][known] for c in ("shard", "offset", "length")))
        return pa.Table.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, (_, t) in zip(cols, fields, strict=True)], schema=pa.schema(fields))

    def fetch(batches: Batches) -> Batches:
        opened, f = None, None
        fs, root = _opened(uri)
        out = pa.schema([*fields, ("ids", pa.binary())])
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, ids = b.slice(lo, 256), []
                for shard, offset, length in zip(*(part.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                    if shard != opened:
                        if f is not None:
                            f.close()
                        f, opened = fs.open_input_file(f"{root}/shard-{shard}"), shard
                    raw = f.read_at(length * width, offset * width)
                    ids.append(np.frombuffer(raw, "<u2").astype("<u4").tobytes() if width == 2 else raw)
                yield batch(out, *(part.column(c) for c, _ in fields), ids)

    placed = keys.withColumn("bucket", _bucket(meta["buckets"])).groupBy("bucket").applyInArrow(find, place)
    near = placed.repartitionByRange(shuffle_partitions(keys.sparkSession), "shard", "offset").sortWithinPartitions("shard", "offset")
    return mapped(near, fetch, place + ", ids binary")


def document_keys(docs: DataFrame) -> DataFrame:
    """key and number of every document, as the store has them."""
    counted = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("number"))


def with_starts(read: DataFrame, layout: DataFrame) -> DataFrame:
    """``start``: the ids of all documents before, from the shards' totals (one row a shard)."""
    totals = layout.groupBy("shard").agg(F.sum("length").alias("ids"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("base"))
    return read.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("offset"))


def new_store(spark: SparkSession) -> str:
    """A folder for one store below the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    fs, root = _opened(path)
    fs.create_dir(root)
    forget_at_exit(spark, path)
    return path


def stored_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back by key from a store just written."""
    uri = new_store(docs.sparkSession)
    layout = write_store(docs, tokenizer, uri)
    crc = F.crc32("ids").alias("ids_crc32")
    read = read_store(document_keys(docs), uri).select("key", "shard", "offset", "length", crc)
    return with_starts(read, layout).select(F.when(F.col("key") != LEAST, F.col("key")).alias("doc_id"), "start", F.col("length").alias("n_tokens"), "ids_crc32")
