"""SimHash near-dedup: fingerprints of word shingles, linked by tiled exact comparison.

A fingerprint bit is set when more than half of the shingle hashes have it. Distinct fingerprints are
cut into tiles by the population counts of their four 16-bit quarters. The Hamming distance of two
fingerprints is at least the sum of the differences of those counts, so only tiles whose counts differ
by the radius at most are compared, every fingerprint of one against every one of the other, with numpy
exclusive-or and bit counts. Tiles with many fingerprints are cut further, so a task holds one bounded
tile at a time and streams the others past it.

Equal fingerprints are one node, so copies are never paired. Inside a block only one link from each
fingerprint to the smallest one it hangs together with is emitted, which keeps components whole and the
links linear in the fingerprints. ``components`` joins the links.

Texts that share four fifths of their five-word shingles lie about ten bits apart, where all tiles meet all
others. ``keep_representatives`` therefore takes texts that agree in a band of least shingle hashes.
``similar_links`` holds each against two members of the band, which settles groups of copies at linear cost.
Bands that still hold several components go on to ``open_links``, which counts the shingles that texts of
different components share, all of them, tile by tile.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import Batches, batch, fresh, mapped, shuffle_partitions, stored, texts
from kinforge.llm.components import components

SEED = 42
QUARTERS = 4
TILE_ROWS = 16_384
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Bands of least hashes: texts alike by 0.8 share one of 16 bands of 5 in 998 of 1000 cases.
BANDS, BAND_ROWS = 16, 5
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits that texts alike by 0.8 stay within (mean 10, deviation 3); what lies beyond is left to ``open_links``.
REACH = 22
#: Shingles that a tile of ``open_links`` holds on average.
TILE_SHINGLES = 1 << 19

#: BITS[v, j] is bit j of byte v.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included. Fewer words than ``width``: one shingle; none: empty."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.array([], "<u8")
    digest = xxhash.xxh64_intdigest
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.array([digest(s, SEED) for s in shingles], "<u8")


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 for none."""
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for place in range(8):
        ones = np.bincount(octets[:, place], minlength=256) @ BITS
        out |= int(np.packbits(ones * 2 > len(octets), bitorder="little")[0]) << (8 * place)
    return out


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of a text's word shingles (repeats count). No words: 0. Fewer than ``width``: one shingle."""
    return majority_bits(shingle_hashes(text, width))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: a hash of the least values of its shingle orders. No shingles: no keys."""
    if not len(hashes):
        return np.array([], np.int64)
    least = np.full(len(MULTIPLIERS), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * MULTIPLIERS).min(0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, width: int = 3, *keep: str) -> DataFrame:
    """The rows of ``docs`` (doc_id and the columns to ``keep``) with ``fp``, the fingerprint as a signed long."""
    source = texts(docs, *keep)
    fields = [f for f in source.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fp long"
    names = [f.name for f in fields]

    def run(batches: Batches) -> Batches:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(fps)], names=[*names, "fp"])

    return mapped(source, run, schema)


def _near_moves(radius: int) -> list[int]:
    """Packed steps from a tile to the tiles that come later and lie within the radius (itself first)."""
    moves = [m for m in itertools.product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, m)) <= radius]
    packed = (sum(d << (8 * q) for q, d in enumerate(m)) for m in moves)
    return sorted(p for p in packed if p >= 0)


def _block_links(home: np.ndarray, seen: np.ndarray, radius: int, rows: int = 256):
    """Links (a, b) that join whatever hangs together between ``home`` and ``seen``: one a member."""
    for at in range(0, len(seen), rows):
        part = seen[at : at + rows]
        near = np.bitwise_count(part[:, None] ^ home[None, :]) <= radius
        near &= part[:, None] != home[None, :]
        r, c = near.any(1), near.any(0)
        if not r.any():
            continue
        left, right, near = part[r], home[c], near[np.ix_(r, c)]
        top = np.uint64(2**64 - 1)
        a, b = left.copy(), right.copy()
        while True:
            new_a = np.minimum(a, np.where(near, b[None, :], top).min(1))
            new_b = np.minimum(b, np.where(near, new_a[:, None], top).min(0))
            if (new_a == a).all() and (new_b == b).all():
                break
            a, b = new_a, new_b
        yield np.concatenate([left, right]), np.concatenate([a, b])


def _compare(radius: int):
    """Rows come sorted by (tile, role): a tile's own fingerprints (role 0), then those that visit it."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def emit(home, seen):
        for u, v in _block_links(home, seen, radius):
            keep = u != v
            yield batch(out, u[keep].view(np.int64), v[keep].view(np.int64))

    def run(batches: Batches) -> Batches:
        tile, own = None, []
        for b in batches:
            tiles, role, fp = (b.column(n).to_numpy() for n in ("tile", "role", "fp"))
            fp = fp.view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1], True]) if len(tiles) else []
            for lo, hi in itertools.pairwise(cuts):
                if tiles[lo] != tile:
                    tile, own = tiles[lo], []
                mid = lo + int(np.searchsorted(role[lo:hi], 1))
                if mid > lo:
                    home = fp[lo:mid]
                    for before in own:
                        yield from emit(before, home)
                    yield from emit(home, home)
                    own.append(home)
                if hi > mid and own:
                    yield from emit(np.concatenate(own) if len(own) > 1 else own[0], fp[mid:hi])

    return run


def links(nodes: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints of ``nodes(fp)``: enough of those within the radius to
    leave components whole. ``nodes`` holds each fingerprint once."""
    quarter = lambda q: F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))).cast("long")
    # Eight bits a quarter, counts offset by the radius, so steps never carry into the next quarter.
    packed = sum((quarter(q) + F.lit(radius)) * F.lit(1 << (8 * q)) for q in range(QUARTERS))
    keyed = nodes.select("fp", packed.cast("long").alias("cell"))
    # At most 17 ** 4 cells whatever the data, so a broadcast of their sizes is bounded.
    cells = keyed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias("cuts"))
    own = keyed.join(F.broadcast(cells), "cell").select("fp", "cell", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int").alias("cut"))
    steps = F.array(*[F.lit(s).cast("long") for s in _near_moves(radius)])
    visits = own.select("fp", "cell", "cut", F.explode(F.transform(steps, lambda s: F.col("cell") + s)).alias("there"))
    there = F.broadcast(cells.select(F.col("cell").alias("there"), F.col("cuts").alias("there_cuts")))
    visits = visits.join(there, "there").select("fp", "cell", "cut", "there", F.explode(F.sequence(F.lit(0), F.col("there_cuts") - 1)).alias("there_cut"))
    visits = visits.where("there <> cell OR there_cut > cut")
    place = lambda cell, cut: (F.col(cell) * F.lit(1 << 24) + F.col(cut)).alias("tile")
    rows = own.select(place("cell", "cut"), F.lit(0).cast("short").alias("role"), "fp").union(visits.select(place("there", "there_cut"), F.lit(1).cast("short").alias("role"), "fp"))
    n = shuffle_partitions(nodes.sparkSession)
    return mapped(rows.repartition(n, "tile").sortWithinPartitions("tile", "role"), _compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest ``doc_id`` reachable over links of at most ``radius`` bits.

    Texts without words have fingerprint 0 and link like any other. Null ids never name a component
    unless all of its ids are null. Rows that repeat each stay. Empty table: empty result.
    """
    marked = stored(fingerprints(docs, width), "simhash")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    # Components work on unsigned order or signed alike: any total order will do.
    roots = components(links(nodes.select("fp"), radius))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def _marked(docs: DataFrame, row: str, width: int) -> DataFrame:
    """row, doc_id, n (length), fp, shape (hash of the shingle set) and bands of every document; ``row`` numbers the rows of ``docs``."""
    source = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Batches) -> Batches:
        for b in batches:
            found = [shingle_hashes(t, width) for t in b.column("text").to_pylist()]
            fps = np.array([majority_bits(h) for h in found], np.uint64).view(np.int64)
            bands = pa.array([band_keys(h) for h in found], pa.list_(pa.int64()))
            shapes = np.array([xxhash.xxh64_intdigest(np.unique(h).tobytes(), SEED) for h in found], np.uint64).view(np.int64)
            size = pa.compute.utf8_length(b.column("text")).cast(pa.int64())
            columns = [b.column("row"), b.column("doc_id"), size, pa.array(fps), pa.array(shapes), bands]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n", "fp", "shape", "bands"])

    return mapped(source, run, "row long, doc_id long, n long, fp long, shape long, bands array<long>")


def _alike(width: int, similarity: float):
    """Pairs (u, v) of texts whose shingle sets are alike by ``similarity`` at least."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Batches) -> Batches:
        at, left = None, None
        for b in batches:
            u, v, a, t = (b.column(n) for n in ("u", "v", "u_text", "v_text"))
            keep = []
            for i in range(b.num_rows):
                # A member met by many comes in successive rows: its shingles are worked out once.
                if u[i].as_py() != at:
                    at, left = u[i].as_py(), np.unique(shingle_hashes(a[i].as_py(), width))
                right = np.unique(shingle_hashes(t[i].as_py(), width))
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(shared >= similarity * (len(left) + len(right) - shared))
            yield batch(out, u.filter(pa.array(keep)), v.filter(pa.array(keep)))

    return run


def similar_links(marked: DataFrame, texts_of: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (u, v) between fingerprints of texts alike by ``similarity`` at least.

    ``marked(row, fp, bands)``; ``texts_of(row, text)``. Every text of a band is held against two of the band's
    members, which differ from band to band, so links stay linear in the texts however large a group of copies is.
    """
    members = marked.select("fp", F.explode("bands").alias("band")).distinct()
    order = F.xxhash64("fp", "band")
    hubs = members.groupBy("band").agg(F.min_by("fp", order).alias("one"), F.max_by("fp", order).alias("two")).where("one <> two")
    met = members.join(hubs, "band").select("fp", F.explode(F.array("one", "two")).alias("hub")).where("fp <> hub")
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= REACH).select(F.greatest("fp", "hub").alias("u"), F.least("fp", "hub").alias("v")).distinct()
    near = stored(near, "simhash-near")
    asked = near.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    rows = marked.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("row").alias("row"))
    shown = stored(texts_of.join(rows, "row").select("fp", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "simhash-texts")
    pairs = near.join(shown.select(F.col("fp").alias("v"), F.col("text").alias("v_text")), "v").join(shown.select(F.col("fp").alias("u"), F.col("text").alias("u_text")), "u")
    return mapped(pairs.select("u", "v", "u_text", "v_text"), _alike(width, similarity), "u long, v long")


def _shingled(width: int, rows: int = 256):
    """Replaces the text of each row by its distinct shingle hashes."""

    def run(batches: Batches) -> Batches:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                found = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in b.column("text").to_pylist()]
                columns = [b.column(n) for n in ("grp", "root", "fp")] + [pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["grp", "root", "fp", "shingles"])

    return run


def _shared_counts(keys: np.ndarray, owner: np.ndarray, n: int, shingles: np.ndarray) -> np.ndarray:
    """How many of ``shingles`` (distinct) each of ``n`` texts has; ``keys`` are all their shingles in order."""
    lo = np.searchsorted(keys, shingles, "left")
    many = np.searchsorted(keys, shingles, "right") - lo
    starts = np.cumsum(many) - many
    at = np.repeat(lo - starts, many) + np.arange(many.sum())
    return np.bincount(owner[at], minlength=n)


class _Tile:
    """The texts at home in one tile, an index of their shingles, and which roots hang together so far."""

    def __init__(self):
        self.roots, self.texts, self.keys, self.above = [], [], None, {}

    def add(self, root: int, shingles: np.ndarray) -> None:
        self.roots.append(root)
        self.texts.append(shingles)

    def index(self) -> None:
        sizes = np.array([len(t) for t in self.texts], np.int64)
        keys, owner = np.concatenate(self.texts), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.sizes = keys[order], owner[order], sizes
        self.names = np.array(self.roots, np.int64)

    def top(self, root: int) -> int:
        while (up := self.above.get(root, root)) != root:
            self.above[root] = root = self.above.get(up, up)
        return root

    def links(self, root: int, shingles: np.ndarray, similarity: float):
        """New links between ``root`` and the roots of alike texts: those not joined within the tile yet."""
        shared = _shared_counts(self.keys, self.owner, len(self.sizes), shingles)
        alike = shared >= similarity * (self.sizes + len(shingles) - shared)
        for other in np.unique(self.names[alike]).tolist():
            a, b = self.top(root), self.top(other)
            if a != b:
                self.above[max(a, b)] = min(a, b)
                yield max(a, b), min(a, b)


def _count_tiles(similarity: float):
    """Rows come sorted by (grp, cut, salt, role): the texts at home in a tile, then those that visit it."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def settle(tile: _Tile, salt: int):
        tile.index()
        # Every salt has the tile at home; one of them holds its texts against one another.
        if salt == 0:
            for root, shingles in zip(tile.roots, tile.texts, strict=True):
                yield from tile.links(root, shingles, similarity)

    def run(batches: Batches) -> Batches:
        place, tile = None, _Tile()
        for b in batches:
            found = []
            roles, roots = b.column("role").to_pylist(), b.column("root").to_pylist()
            places = list(zip(*(b.column(n).to_pylist() for n in ("grp", "cut", "salt")), strict=True))
            for i, here in enumerate(places):
                if here != place:
                    if tile.texts and tile.keys is None:
                        found += settle(tile, place[2])
                    place, tile = here, _Tile()
                shingles = b.column("shingles")[i].values.to_numpy()
                if roles[i] == 0:
                    tile.add(roots[i], shingles)
                elif tile.texts:
                    if tile.keys is None:
                        found += settle(tile, here[2])
                    found += tile.links(roots[i], shingles, similarity)
            yield batch(out, [u for u, _ in found], [v for _, v in found])
        if tile.texts and tile.keys is None:
            found = list(settle(tile, place[2]))
            yield batch(out, [u for u, _ in found], [v for _, v in found])

    return run


def open_links(marked: DataFrame, rooted: DataFrame, texts_of: DataFrame, width: int, similarity: float, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """Links (u, v) between components whose texts share a band and are alike by ``similarity`` at least.

    ``rooted(fp, root)`` has the components so far. Components that meet in a band form a group, of which every
    two texts of different components are compared: none is skipped, whatever the size of the group. The texts of
    its largest component only visit, so a large group of copies with a few that hang apart costs its size times
    those few. Tiles are cut by shingles and visitors dealt over salts, so a task holds a bounded part of a group;
    a tile gives at most one link a root.
    """
    members = marked.select("fp", F.explode("bands").alias("band")).distinct().join(rooted, "fp").select("band", "root").distinct()
    open_bands = members.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band", "least")
    groups = components(members.join(open_bands, "band").select(F.col("root").alias("u"), F.col("least").alias("v")))
    asked = rooted.join(groups.select(F.col("node").alias("root"), F.col("root").alias("grp")), "root")
    # One row for each distinct set of shingles: texts of one fingerprint may differ.
    rows = marked.join(asked, "fp").groupBy("grp", "root", "fp", "shape").agg(F.min("row").alias("row"))
    source = texts_of.join(rows, "row").select("grp", "root", "fp", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shown = stored(mapped(source, _shingled(width), "grp long, root long, fp long, shingles array<long>"), "simhash-open")

    by_root = shown.groupBy("grp", "root").agg(F.sum(F.size("shingles")).alias("w"))
    sizes = by_root.groupBy("grp").agg(F.max_by("root", F.struct("w", "root")).alias("core"), F.max("w").alias("core_w"), F.sum("w").alias("w"))
    tiles = lambda amount, each: F.greatest(F.lit(1), F.ceil(amount / F.lit(each))).cast("int")
    cuts = sizes.select("grp", "core", tiles(F.col("w") - F.col("core_w"), tile_shingles).alias("cuts"), tiles(F.col("w"), 4 * tile_shingles).alias("salts"))
    pick = lambda seed, count: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(count)).cast("int")
    placed = shown.join(cuts, "grp").withColumn("cut", F.when(F.col("root") == F.col("core"), -1).otherwise(pick(1, "cuts"))).withColumn("salt", pick(2, "salts"))
    homes = placed.where("cut >= 0").select("grp", "cut", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "root", "shingles")
    later = F.explode(F.sequence(F.col("cut") + 1, F.col("cuts") - 1)).alias("cut")
    visits = placed.where("cut < cuts - 1").select("grp", later, "salt", F.lit(1).alias("role"), "root", "shingles")
    place = ["grp", "cut", "salt"]
    dealt = homes.union(visits).repartition(shuffle_partitions(marked.sparkSession), *place).sortWithinPartitions(*place, "role")
    return mapped(dealt, _count_tiles(similarity), "u long, v long")


def keep_representatives(docs: DataFrame, width: int = 5, radius: int = 3, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest id (then longest text).

    Texts link within ``radius`` bits, or when four fifths of their five-word shingles agree (``similarity``) and
    they share one of the bands, as 998 of 1000 pairs at 0.8 and nearly all above do.
    A row of equal id and text twice leaves one of the two. All columns are kept as they are. Texts without
    words count as copies of one another. Rows get numbers that are written once with them and read from there
    ever after: a number worked out anew could be another one after a lost executor, or with other cores.
    """
    (key,) = fresh(docs, "_row")
    numbered = stored(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-rows")
    marked = stored(_marked(numbered, key, width), "simhash")
    nodes = stored(marked.select("fp").distinct(), "simhash-nodes")
    texts_of = numbered.select(F.col(key).alias("row"), "text")
    alike = similar_links(marked, texts_of, width, similarity)
    near = components(stored(links(nodes, radius).union(alike), "simhash-links"))
    rooted = nodes.join(near.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-roots")
    more = components(open_links(marked, rooted, texts_of, width, similarity))
    ends = rooted.join(more.select(F.col("node").alias("root"), F.col("root").alias("end")), "root", "left").select("fp", F.coalesce("end", "root").alias("root"))
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), -F.col("n"), F.col("row")))
    by_fp = marked.groupBy("fp").agg(best.alias("best"))
    root_of = by_fp.join(ends, "fp").groupBy("root").agg(F.min("best").alias("best"))
    chosen = root_of.select(F.col("best.row").alias(key))
    return numbered.join(chosen, key, "left_semi").select(*docs.columns)
