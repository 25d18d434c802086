"""Places as a dictionary-coded dimension.

A gazetteer is a table (name, county) of any size. Every distinct place text is read once against it, by a
join, and its county comes back to the rows with a code and the set of counties that border on it as bits.
Nearness of two counties is then one bit test a row, and no row searches a list of names. ``places.resolve_county``
does the same inside an expression for the short list that ships with the package.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions import places
from kinforge.functions import values as V
from kinforge.functions.literals import first_true, quoted
from kinforge.session import materialized, maybe_broadcast

#: Session setting: the path of a Parquet table (town, county) that is added to the names shipped.
TOWNS_SETTING = "kinforge.gazetteer.towns"
#: Fields of a resolved place: its county, the county's number and the numbers of its neighbours as bits.
SEAT = "struct<county: string, code: int, borders: bigint>"

_TABLES: dict[tuple[str, str], DataFrame] = {}


def _rows(spark: SparkSession, rows, names: str) -> DataFrame:
    shown = ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {shown} AS t({names})")


def border_table(spark: SparkSession) -> DataFrame:
    return _rows(spark, V.border_pairs(), "county_a, county_b")


def county_codes() -> list[tuple[str, int, int]]:
    """County, number, neighbours as bits. A bigint has room for 63; there are fewer counties with borders."""
    numbers = {c: i for i, c in enumerate(V.counties())}
    bits = dict.fromkeys(numbers, 0)
    for a, b in V.border_pairs():
        bits[a] |= 1 << numbers[b]
    return [(c, i, bits[c]) for c, i in numbers.items()]


def gazetteer_table(spark: SparkSession, towns: DataFrame | None = None) -> DataFrame:
    """name, seat for every known name: counties first, then towns, short names, historic names.

    ``towns(town, county)`` is added to what ships with the package and wins over it. Names and counties are
    compared in lower case without outer blanks; a town named twice keeps its first county by name.
    """
    shipped = [(n, c, rank) for rank, names in ((0, {c: c for c in V.counties()}), (2, V.TOWNS), (3, V.COUNTY_ALIASES), (4, V.HISTORIC_COUNTIES)) for n, c in names.items()]
    known = _rows(spark, shipped, "name, county, rank")
    if towns is not None:
        tidy = lambda c: F.lower(F.trim(c))
        known = known.unionByName(towns.select(tidy("town").alias("name"), tidy("county").alias("county"), F.lit(1).alias("rank")).where("name <> '' and county <> ''"))
    one = known.groupBy("name").agg(F.min_by("county", F.struct("rank", "county")).alias("county"))
    codes = _rows(spark, county_codes(), "county, code, borders").select("county", F.col("code").cast("int").alias("code"), F.col("borders").cast("bigint").alias("borders"))
    return one.join(F.broadcast(codes), "county", "left").select("name", F.struct("county", "code", "borders").alias("seat"))  # codes: one row a county with borders


def default_gazetteer(spark: SparkSession) -> DataFrame:
    """The session's gazetteer, written once: the shipped names and, where set, the towns of TOWNS_SETTING."""
    path = spark.conf.get(TOWNS_SETTING, "")
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        _TABLES[key] = materialized(gazetteer_table(spark, spark.read.parquet(path) if path else None), for_all=True)
    return _TABLES[key]


def _tried(text: Column) -> Column:
    """Names to look up for a place, in order: the whole text, then its parts."""
    whole = F.lower(F.trim(text))
    return F.filter(F.concat(F.array(whole), F.transform(F.split(whole, r"[,;]+"), lambda p: F.trim(p))), lambda n: n != "")


def place_dimension(asked: DataFrame, gazetteer: DataFrame | None = None) -> DataFrame:
    """One row for each distinct text of ``asked(place)``, written once.

    seat: where the text lies. clean: the text sanitised; clean_seat: where that lies; foreign: clearly
    abroad; home: in the country and nowhere else by name. town, stated_county: as the text itself has
    them; stated_seat: the stated county, else seat. Null and blank texts have no row.
    """
    gazetteer = default_gazetteer(asked.sparkSession) if gazetteer is None else gazetteer
    texts = asked.select("place").where(F.trim("place") != "").distinct()
    stated = places.parse_place(F.col("place"))
    read = texts.select("place", places.sanitize_place(F.col("place")).alias("clean"), F.inline(F.array(stated)))
    read = read.select("place", "clean", "town", F.col("county").alias("stated_county"))
    names = F.array(*(F.struct(F.lit(k).alias("kind"), n.alias("names")) for k, n in (("seat", _tried(F.col("place"))), ("clean_seat", _tried(F.col("clean"))), ("stated", F.array_compact(F.array("stated_county"))))))
    parts = read.select("place", F.inline(names)).select("place", "kind", F.posexplode("names").alias("pos", "name"))
    found = parts.join(maybe_broadcast(gazetteer), "name").groupBy("place").agg(*(F.min_by("seat", F.when(F.col("kind") == k, F.col("pos"))).alias(k) for k in ("seat", "clean_seat", "stated")))
    told = F.when(F.col("stated_county").isNotNull(), F.coalesce("stated", F.struct(F.col("stated_county").alias("county"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("bigint").alias("borders"))))
    clean = F.col("clean")
    out = read.join(found, "place", "left").select(
        "place", "seat", "clean", "clean_seat", places.clearly_foreign(clean).alias("foreign"), (~places.looks_foreign(clean) & places.looks_uk(clean)).alias("home"),
        "town", "stated_county", F.coalesce(told, F.col("seat")).alias("stated_seat"))
    return materialized(out)


def all_places(*columns: tuple[DataFrame, str]) -> DataFrame:
    """The distinct place texts of several columns as ``place``."""
    parts = [df.select(F.col(name).alias("place")).distinct() for df, name in columns]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every


def with_place(df: DataFrame, dimension: DataFrame, place: str, **fields: str) -> DataFrame:
    """``df`` with fields of its place, named as asked: ``with_place(df, d, "birth_place", own_seat="seat")``."""
    named = dimension.select(F.col("place").alias("_place"), *(F.col(f).alias(out) for out, f in fields.items()))
    return df.join(named, df[place] == named["_place"], "left").drop("_place")


def read_once(df: DataFrame, text: str, **worked: Callable[[Column], Column]) -> DataFrame:
    """``df`` with columns worked out of one of its texts, once for each distinct text (null is one of them)."""
    known = materialized(df.select(F.col(text).alias("_text")).distinct().select("_text", *(use(F.col("_text")).alias(out) for out, use in worked.items())))
    return df.join(maybe_broadcast(known), df[text].eqNullSafe(known["_text"]), "left").drop("_text")


def proximity(a: Column, b: Column) -> Column:
    """same, adjacent, distant of two seats; null when either is unknown or has no borders on record."""
    return first_true([
        (a["county"] == b["county"], "same"),
        (F.getbit(a["borders"], b["code"]) == 1, "adjacent"),
        (a["borders"].isNotNull() & b["borders"].isNotNull(), "distant"),
    ])


def lookup_counties(df: DataFrame, place: str, gazetteer: DataFrame | None = None, out: str = "county") -> DataFrame:
    """The county of each row's place: the whole text first, then its parts in order."""
    dimension = place_dimension(df.select(F.col(place).alias("place")), gazetteer)
    return with_place(df, dimension, place, _seat="seat").withColumn(out, F.col("_seat.county")).drop("_seat")


def lookup_proximity(df: DataFrame, a: str, b: str, borders: DataFrame, out: str = "proximity") -> DataFrame:
    """same, adjacent or distant for two county columns; null when either has no borders on record."""
    hit = maybe_broadcast(borders.withColumn("_adjacent", F.lit(True)))
    known = [borders.select(F.col("county_a").alias(c), F.lit(True).alias(f"_known_{c}")).distinct() for c in (a, b)]
    j = df.join(hit, (F.col(a) == F.col("county_a")) & (F.col(b) == F.col("county_b")), "left").drop("county_a", "county_b")
    for k in known:
        j = j.join(maybe_broadcast(k), k.columns[0], "left")
    value = F.when(F.col(a) == F.col(b), "same").when(F.col("_adjacent"), "adjacent").when(F.col(f"_known_{a}") & F.col(f"_known_{b}"), "distant")
    return j.withColumn(out, value).drop("_adjacent", f"_known_{a}", f"_known_{b}")
