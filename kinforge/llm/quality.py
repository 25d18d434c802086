"""Quality rules: per-document word rules, and cross-document line frequency within a host.

Lines are normalised (ASCII lower case, white space collapsed) and hashed. A line is
boilerplate on a host when it stands in at least ``min_docs`` distinct documents, however many the host
has; a least share of the host's documents can be asked for besides (``min_share``). Such lines are removed from every document but the first that
has them, so no text leaves the corpus altogether; a document that loses more than ``max_removed`` of
its words that way is depleted and rejected. Documents of equal text on a host count as one, so copies
do not make their own lines frequent.

Counts are two aggregates with map-side combining. The few frequent lines meet the lines of all
documents on a salted key, since one of them may stand in a third of all documents.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import Batches, batch, fresh, mapped, stored, texts

MIN_DOCS = 10
#: The share that the DuckDB text of op7 asks for besides; the operator asks for none by default.
MIN_SHARE = 0.1
MAX_REMOVED = 0.5
SALTS = 16
SPACES = " \t\n\r\v\f"
SYMBOLS = "#*$%&|<>"
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_LINE = pa.struct([("h", pa.int64()), ("words", pa.int64())])
_MARKED = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("lines", pa.list_(_LINE))]
)
_MARKED_DDL = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,words:long>>"


def line_hash(words: list[bytes]) -> int:
    """Hash of a normalised line as a signed long."""
    h = xxhash.xxh3_64_intdigest(b" ".join(words).translate(NORMAL))
    return h - (1 << 64) if h >> 63 else h


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = until = 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def measure(text: str) -> tuple[int, int, int, int, int, list[dict]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the distinct normalised lines."""
    words, found, dups, raw_seen = [], {}, 0, set()
    for line in text.encode().split(b"\n"):
        own = line.split()
        if not own:
            continue
        dups += line in raw_seen
        raw_seen.add(line)
        words += own
        h = line_hash(own)
        found[h] = found.get(h, 0) + len(own)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dups, repeated_words(words), [{"h": h, "words": n} for h, n in found.items()]


def _measured(batches: Batches) -> Batches:
    for b in batches:
        cols = list(zip(*map(measure, b.column("text").to_pylist()), strict=True)) or [()] * 6
        yield batch(_MARKED, b.column("doc_id"), b.column("host"), b.column("text_hash"), *cols)


def with_host(docs: DataFrame, host: str) -> DataFrame:
    """Null hosts are a host of their own; the text's hash stands for the text within a host."""
    return texts(docs, F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host")).withColumn("text_hash", F.xxhash64("text"))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    return mapped(with_host(docs, host), _measured, _MARKED_DDL)


def frequent_lines(marked: DataFrame, min_docs: int = MIN_DOCS, min_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(host, text_hash, h, words) of every distinct document's lines, and (host, h, holder) of the
    frequent ones, where holder is the document that keeps the line."""
    each = marked.select("doc_id", "host", "text_hash", F.explode("lines").alias("line")).groupBy("host", F.col("line.h").alias("h"), "text_hash").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first"), F.max("line.words").alias("words")
    )
    hosts = marked.groupBy("host", "text_hash").agg(F.lit(1)).groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    counted = each.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("first", "text_hash")).alias("holder")).where(F.col("docs") >= min_docs)
    frequent = counted.join(hosts, "host").where(F.col("docs") >= min_share * F.col("host_docs")).select("host", "h", F.col("holder.text_hash").alias("holder"))
    return each.select("host", "text_hash", "h", "words"), frequent


def removed_lines(marked: DataFrame, min_docs: int = MIN_DOCS, min_share: float = 0.0) -> DataFrame:
    """host, text_hash, removed_words, removed (line hashes) of every distinct document that loses lines."""
    each, frequent = frequent_lines(marked, min_docs, min_share)
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = each.withColumn("salt", F.pmod("text_hash", F.lit(SALTS)).cast("int")).join(salted, ["host", "h", "salt"]).where("text_hash <> holder")
    return lost.groupBy("host", "text_hash").agg(F.sum("words").alias("removed_words"), F.collect_list("h").alias("removed"))


def judged(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, min_share: float = 0.0, max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row a document: host, text_hash, the counts of ``measure``, removed_words, removed, base_failed, kept.

    Words are runs of anything but ASCII white space. base_failed: under 50 words, or over half of the
    words in repeated three-word windows. kept: not base_failed and not depleted. Null or empty text:
    no words, base_failed. Repeated rows each get their row. Lines without words are no lines. Equal
    ids with different texts are different documents.
    """
    marked = stored(measured(docs, host), "quality")
    lost = removed_lines(marked, min_docs, min_share)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = marked.drop("lines").join(lost, ["host", "text_hash"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    return out.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words")))


def _cut(names: list[str], text_at: int, gone_in: str):
    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows == 0:
                continue
            out = []
            for text, gone in zip(b.column(text_at).to_pylist(), b.column(gone_in).to_pylist(), strict=True):
                if gone:
                    gone = set(gone)
                    text = "\n".join(x for x in text.split("\n") if not (w := x.encode().split()) or line_hash(w) not in gone)
                out.append(text)
            cols = [pa.array(out, pa.string()) if i == text_at else b.column(n) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents kept, without the lines removed from them; all columns of ``docs``.

    ``n_chars``, where there is one, is counted anew for texts that changed.
    """
    at_host, at_hash, gone = fresh(docs, "_host", "_hash", "_removed")
    verdict = judged(docs, host, **limits).where("kept").groupBy(F.col("host").alias(at_host), F.col("text_hash").alias(at_hash)).agg(F.first("removed").alias(gone))
    of_host, of_text = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")), F.coalesce("text", F.lit(""))
    wanted = docs.select("*", of_host.alias(at_host), F.xxhash64(of_text).alias(at_hash)).join(verdict, [at_host, at_hash]).select(*docs.columns, gone)
    return recount(mapped(wanted, _cut(docs.columns, docs.columns.index("text"), gone), docs.schema))


def recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs
