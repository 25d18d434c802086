"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for assigned values, access keys and long hexadecimal runs (the base kinds) and
for further candidates: long mixed tokens, private key blocks, tokens with a known prefix. A candidate's
value is hashed and counted over the corpus by distinct repositories (texts, copies once), by the owners
(sources) those texts come from, and by all owners that show it. A value in texts of several owners is a
widely copied example, and so is one whose texts come from one owner but were copied under several more.
One that stays with its owner is taken for live, in however many of that owner's documents it stands.
Candidates that are live are added to a text's spans; base spans stay in any case, and are marked.

Positions: Spark's ``split`` gives what stands between the matches and ``regexp_extract_all`` the
matches, so the running length of both in turn is each match's place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import fresh, stored, texts

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST = 8

#: Further candidates: a token of 20 or more letters and digits that has both cases and a digit; the
#: head line of a private key with all up to its END line; tokens that carry their issuer's prefix.
MIXED = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[0-9a-z_-]*[A-Z])(?=[0-9A-Z_-]*[a-z])[A-Za-z0-9_-]{20,}"
#: Any characters up to the END line, but for another BEGIN or END line. A key without its END line reaches
#: to the end of what looks like one: header lines, base64 text, and long or padded base64 lines behind line
#: ends (escaped ones too), quotes and indents. Possessive, so that long texts need no stack.
_HEADER = r"[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*:\x20[^\r\n\\]*+"
_KEY_LINE = r"(?:[A-Za-z0-9+/=]{20,}+|[A-Za-z0-9+/]{2,19}={1,2}(?![A-Za-z0-9+/=]))"
_CLOSED = r"[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
_UNCLOSED = rf"(?:(?:\\+[nrt]|[\s\"'])*+(?:{_HEADER}|{_KEY_LINE})|[A-Za-z0-9+/=]++|[\r\n]++)*+"
PRIVATE = rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_CLOSED}|{_UNCLOSED})"
#: What is no part of a key's value: head and END line, escapes, white space, quotes.
NOT_KEY = r"-----(?:BEGIN|END) [A-Z ]*PRIVATE KEY-----|\\+[nrt]|[\s\"'\\]"
PREFIXED = r"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}"

KINDS = ("assign", "access", "hex", "mixed", "private", "prefixed")
#: A value is live while its distinct texts come from no more owners than the first, and with their exact
#: copies stand under no more than the second.
MAX_OWNERS = 1
MAX_COPIED_OWNERS = 2

_NONE = "CAST(array() AS array<struct<kind:int,start:long,end:long,value:long>>)"


def _matches(text: str, kind: int, pattern: str, value_group: int = 0, least: int = 0, beside: str | None = None) -> Column:
    """array<struct<kind, start, end, value>> of the pattern's matches; texts without one skip the work.

    What matches ``beside`` is no part of a value."""
    p, t = F.lit(pattern), F.col(text)
    found = F.regexp_extract_all(t, p, F.lit(0))
    values = F.regexp_extract_all(t, p, F.lit(value_group)) if value_group else found
    lengths = F.transform(F.split(t, pattern), lambda x: F.length(x).cast("long"))
    # The gaps' and matches' lengths in turn; a fold keeps the place and collects (start, end).
    pairs = F.arrays_zip(F.slice(lengths, 1, F.size(found)).alias("gap"), F.transform(found, lambda x: F.length(x).cast("long")).alias("size"), values.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(_NONE).alias("spans"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        value = x["value"] if beside is None else F.regexp_replace(x["value"], beside, "")
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), (begin + x["size"]).alias("end"), F.xxhash64(value).alias("value"))
        spans = F.when(F.length(x["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((begin + x["size"]).alias("at"), spans.alias("spans"))

    return F.when(t.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(F.expr(_NONE))


def _by_place(spans: Column) -> Column:
    """Sorted by start, then kind as listed."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))


def as_string(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, text_hash, owner, base and more: the spans of the base kinds and the further candidates."""
    source = texts(docs, F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("")).alias("owner"))
    base = F.concat(_matches("text", 0, ASSIGN, 2, ASSIGN_LEAST), _matches("text", 1, ACCESS), _matches("text", 2, HEX))
    more = F.concat(_matches("text", 3, MIXED), _matches("text", 4, PRIVATE, beside=NOT_KEY), _matches("text", 5, PREFIXED))
    return source.select("doc_id", F.xxhash64("text").alias("text_hash"), "owner", base.alias("base"), more.alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """value, repositories, origins, owners: in how many distinct texts each value stands, from how many
    owners these come (a text comes from the owner of its least document), and how many owners show it."""
    seen = found.select("doc_id", "text_hash", "owner", F.explode(F.array_distinct(F.concat(F.transform("base", lambda s: s["value"]), F.transform("more", lambda s: s["value"])))).alias("value"))
    # First one row a (value, text) and a (value, owner), map-side first, then counts; nothing is gathered.
    origin = seen.groupBy("value", "text_hash").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "owner")).alias("least")).select("value", F.col("least.owner").alias("owner"), F.lit(1).alias("texts"))
    each = origin.unionByName(seen.select("value", "owner", F.lit(0).alias("texts"))).groupBy("value", "owner").agg(F.sum("texts").alias("texts"))
    return each.groupBy("value").agg(F.sum("texts").alias("repositories"), F.count_if(F.col("texts") > 0).alias("origins"), F.count(F.lit(1)).alias("owners"))


def scanned(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_copied_owners: int = MAX_COPIED_OWNERS) -> DataFrame:
    """doc_id, text_hash, base, added (sorted spans), n_live, n_examples (base spans by their value's ownership).

    Null or empty text: no spans. A null owner is an owner of its own. Rows of equal text are one
    repository and each get their row. An empty table gives an empty result.
    """
    found = stored(candidates(docs, owner), "candidates")
    live = F.expr(f"origins <= {int(max_owners)} AND owners <= {max(int(max_owners), int(max_copied_owners))}")
    values = ownership(found).select("value", live.alias("live"))
    spread = found.where("size(base) + size(more) > 0").select("doc_id", "text_hash", F.explode(F.concat("base", "more")).alias("span")).withColumn("value", F.col("span.value"))
    judged = spread.join(values, "value").groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "text_hash").agg(
        F.collect_set(F.when(F.col("live") & (F.col("span.kind") > 2), F.col("span"))).alias("added"),
        F.collect_set(F.when(F.col("live") & (F.col("span.kind") <= 2), F.col("span"))).alias("live_base"),
    )
    out = found.withColumn("doc", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(judged, ["doc", "text_hash"], "left")
    added, alive = F.coalesce("added", F.expr(_NONE)), F.coalesce(F.size("live_base"), F.lit(0)).cast("long")
    alive = F.when(F.col("live_base").isNull(), F.lit(0).cast("long")).otherwise(alive)
    return out.select("doc_id", "text_hash", _by_place(F.col("base")).alias("base"), _by_place(added).alias("added"), alive.alias("n_live"), (F.size("base") - alive).alias("n_examples"))


def report(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_live, n_examples."""
    found = scanned(docs, **limits)
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(as_string(F.col("base")), 256).alias("base_sha256"),
        as_string(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), "n_live", "n_examples",
    )


def masked(docs: DataFrame, mask: str = "[secret]", **limits) -> DataFrame:
    """All rows and columns of ``docs``, every span (base and added) in ``text`` replaced by ``mask``.

    Overlapping spans get one mask. ``n_chars``, where there is one, is counted anew; a null text stays.
    """
    at_doc, at_hash, gone = fresh(docs, "_doc", "_hash", "_spans")
    spans = F.array_sort(F.concat("base", "added"))
    found = scanned(docs, **limits).where("size(base) + size(added) > 0").groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(at_doc), F.col("text_hash").alias(at_hash)).agg(F.first(spans).alias(gone))
    doc, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.coalesce("text", F.lit(""))
    joined = docs.select("*", doc.alias(at_doc), F.xxhash64(text).alias(at_hash)).join(found, [at_doc, at_hash], "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        piece = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(piece, F.lit(mask))).alias("parts"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))
        # A span that starts inside the one before only moves its end; touching spans are two.
        return F.when((s["start"] < acc["at"]), inside).otherwise(new)

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.aggregate(gone, start, step, rest))
    changed = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)
