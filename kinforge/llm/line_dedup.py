"""Line dedup: a deletion-neighbourhood join over the words of lines.

Two lines are near when one word inserted, deleted or replaced turns one into the other. For one edit
the deletion neighbourhood of a line is the line itself and the line without each of its words. A line
without its i-th word has key (hash of the rest); lines of equal length that share a key at the same i
differ in one word at most, and a line that equals a longer one without a word is one insertion away.
Keys carry length and position, so the edit distance is verified by the key and no two texts are met.

Only lines that can have a partner emit variants: a line within one edit shares either the first or the
last half of its words, so lines whose halves nobody else has are out before. All joins are on hashes,
all choices are ``min`` aggregates, and no pair of lines is ever emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import Batches, batch, fresh, mapped, stored, texts
from kinforge.llm.quality import recount

#: The least words of a judged line by default of ``line_verdicts``, as in the DuckDB text.
MIN_WORDS = 8
#: op6 and the pipeline judge every line with a word; one edit counts from this many words on, as in
#: shorter lines one word is too large a part.
EVERY_LINE = 1
NEAR_WORDS = 5
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: An odd multiplier and its inverse modulo 2 ** 64, for hashes of word sequences.
BASE = 0x9E3779B97F4A7C15
_BASE = np.uint64(BASE)
_BACK = np.uint64(pow(BASE, -1, 1 << 64))

_LINES_DDL = "doc_id long, text_hash long, n_lines long, lines array<struct<no:int,h:long,halves:array<long>>>"
_LINE = pa.struct([("no", pa.int32()), ("h", pa.int64()), ("halves", pa.list_(pa.int64()))])
_LINES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_lines", pa.int64()), ("lines", pa.list_(_LINE))])
_VARIANTS_DDL = "key long, slot long, h long, doc long, text_hash long, no int"
_VARIANTS = pa.schema([("key", pa.int64()), ("slot", pa.int64()), ("h", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("no", pa.int32())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _digest(words: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def halves(words: list[bytes]) -> list[int]:
    """Hashes of the first and the last half, once as the shorter and once as the longer of a pair."""
    out = []
    for n in {(len(words) - 1) // 2, (len(words) - 2) // 2}:
        out += [_signed(xxhash.xxh3_64_intdigest(b" ".join(words[:n]), 2 * n)), _signed(xxhash.xxh3_64_intdigest(b" ".join(words[-n:]), 2 * n + 1))]
    return out


def _line_words(line: bytes) -> list[bytes]:
    return line.translate(LOWER).split()


def _lines_of(min_words: int, near_words: int):
    def run(batches: Batches) -> Batches:
        for b in batches:
            counts, lines = [], []
            for text in b.column("text").to_pylist():
                raw = text.encode().split(b"\n")
                counts.append(len(raw))
                lines.append([{"no": i, "h": _digest(w), "halves": halves(w) if len(w) >= near_words else []} for i, x in enumerate(raw) if len(w := _line_words(x)) >= min_words])
            yield batch(_LINES, b.column("doc_id"), b.column("text_hash"), counts, lines)

    return run


def variants(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and slots of a line's deletion neighbourhood: first the line itself (slot -1), then the line
    without each word (slot: length and position)."""
    m = len(words)
    with np.errstate(over="ignore"):
        steps = np.multiply.accumulate(np.r_[np.uint64(1), np.full(m - 1, _BASE)])
        sums = np.r_[np.uint64(0), np.cumsum(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) * steps)]
        rest = sums[:-1] + (sums[-1] - sums[1:]) * _BACK
    return np.r_[sums[-1], rest].view(np.int64), np.r_[np.int64(-1), (np.int64(m) << 32) + np.arange(m, dtype=np.int64)]


def _variants_of(batches: Batches) -> Batches:
    for b in batches:
        for doc, text_hash, text, nos in zip(*(b.column(n).to_pylist() for n in ("doc", "text_hash", "text", "nos")), strict=True):
            raw, cols = text.encode().split(b"\n"), ([], [], [], [])
            for no in nos:
                words = _line_words(raw[no])
                key, slot = variants(words)
                for c, v in zip(cols, (key, slot, np.full(len(key), _digest(words)), np.full(len(key), no, np.int32)), strict=True):
                    c.append(v)
            if nos:
                key, slot, h, no = map(np.concatenate, cols)
                yield batch(_VARIANTS, key, slot, h, np.full(len(key), doc), np.full(len(key), text_hash), no)


def _order(doc="doc", text_hash="text_hash", no="no"):
    return F.struct(F.col(doc).alias("doc"), F.col(text_hash).alias("text_hash"), F.col(no).alias("no"))


def line_table(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = MIN_WORDS) -> DataFrame:
    """One stored row a document with its lines of at least ``min_words`` words; those under ``near_words`` have no halves."""
    source = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    return stored(mapped(source, _lines_of(min_words, near_words), _LINES_DDL), "lines")


def _flat(table: DataFrame) -> DataFrame:
    # A null id sorts before all others.
    return table.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "text_hash", F.explode("lines").alias("line")).select("doc", "text_hash", "line.*")


def kept_lines(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc, text_hash, nos: for each document the numbers of its judged lines that stay."""
    flat = _flat(table)
    firsts = stored(flat.groupBy("h").agg(F.min(_order()).alias("first"), F.first("halves").alias("halves")), "first-lines")
    by_half = firsts.select("h", F.explode("halves").alias("half"))
    shared = by_half.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
    alive = by_half.join(shared, "half", "left_semi").select("h").distinct()
    at = firsts.join(alive, "h", "left_semi").groupBy(F.col("first.doc").alias("doc"), F.col("first.text_hash").alias("text_hash")).agg(F.collect_list("first.no").alias("nos"))
    source = texts(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    pool = stored(mapped(source.join(at, ["doc", "text_hash"]), _variants_of, _VARIANTS_DDL).distinct().withColumn("at", _order()).drop("doc", "text_hash", "no"), "variants")
    cut, whole = pool.where("slot >= 0"), pool.where("slot = -1")
    swap = cut.groupBy("key", "slot").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "slot", "least")
    longer = cut.groupBy("key").agg(F.min("at").alias("least"))
    late = (
        cut.join(swap, ["key", "slot"]).where("least < at").select("h")
        .union(cut.join(whole.select("key", F.col("at").alias("least")), "key").where("least < at").select("h"))
        .union(whole.join(longer, "key").where("least < at").select("h"))
    ).distinct()
    stay = firsts.join(late, "h", "left_anti")
    return stay.groupBy(F.col("first.doc").alias("doc"), F.col("first.text_hash").alias("text_hash")).agg(F.collect_list("first.no").alias("nos"))


def line_verdicts(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int | None = None) -> DataFrame:
    """doc_id, text_hash, n_lines, n_long (lines that were judged), removed (sorted line numbers from 0).

    A line of at least ``min_words`` words is removed when an earlier line of the table, in order of
    (doc_id, text hash, line number), is equal to it or one word away; case (ASCII) and white space do
    not count. Two lines are met for one word only if both have ``near_words`` (without it: ``min_words``)
    or more. Lines under ``min_words`` stay. Null ids come first; null or empty text is one short line. Rows of
    equal id and text count as one document and get equal verdicts. Empty table: empty result.
    """
    table = line_table(docs, min_words, min_words if near_words is None else near_words)
    stay = kept_lines(docs, table)
    keyed = table.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(stay, ["doc", "text_hash"], "left")
    nos = F.coalesce("nos", F.array().cast("array<int>"))
    return keyed.select("doc_id", "text_hash", "n_lines", F.size("lines").cast("long").alias("n_long"), F.array_sort(F.array_except("lines.no", nos)).alias("removed"))


def _cut(names: list[str], text_at: int, gone_in: str):
    def run(batches: Batches) -> Batches:
        for b in batches:
            out, keep = [], []
            for text, gone in zip(b.column(text_at).to_pylist(), b.column(gone_in).to_pylist(), strict=True):
                if gone:
                    gone = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
                keep.append(not gone or bool(text.encode().split()))
                out.append(text)
            cols = [pa.array(out, pa.string()) if i == text_at else b.column(n) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return run


def drop_repeated_lines(docs: DataFrame, min_words: int = EVERY_LINE, near_words: int = NEAR_WORDS) -> DataFrame:
    """The documents without their removed lines; all columns of ``docs``.

    A document that is left without a word by this goes; one that had no words before stays.
    ``n_chars``, where there is one, is counted anew.
    """
    at_doc, at_hash, gone = fresh(docs, "_doc", "_hash", "_removed")
    verdict = line_verdicts(docs, min_words, near_words).where(F.size("removed") > 0)
    verdict = verdict.groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(at_doc), F.col("text_hash").alias(at_hash)).agg(F.first("removed").alias(gone))
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.coalesce("text", F.lit(""))
    joined = docs.select("*", doc.alias(at_doc), F.xxhash64(text).alias(at_hash)).join(verdict, [at_doc, at_hash], "left").select(*docs.columns, gone)
    return recount(mapped(joined, _cut(docs.columns, docs.columns.index("text"), gone), docs.schema))
