"""Which address records name the same place.

1. Each row's four fields are read into ordered tokens (:mod:`address_parse`);
   rows with the same tokens form one spelling, and only spellings go on.
2. Which signs are taken for each other in typing is learned from the rows
   (:func:`confusions`): where street, number, building, unit and room are the
   same, the estates written are one estate, and the reverse, so a rare
   variant that differs from the common one in a single sign counts for that
   pair of signs.
3. MinHash banding: the shingles are a name's signs (q-grams of one, with
   confused signs and abbreviated endings as one) and its number tokens.
   Numbers must agree, so they stand in every band's key; the signs are hashed
   in :data:`BANDS` bands of :data:`ROWS` values.  No pair that 4 accepts is
   without a common band (see :func:`shingles`), so nothing is lost.
   Spellings sharing a band whose areas don't contradict each other are
   candidates; a bucket of more than :data:`SPLIT` spellings is split.
4. A candidate pair is verified by affine-gap alignment of its tokens
   (:func:`alignment_cost`): numbers must agree, a missing part opens or
   extends a gap, names pay for each differing sign, less where the signs are
   known to be confused and where the abbreviation dictionary has the endings.
5. Verified links make classes (connected components).

Defined results: rows that name no street or estate, are empty, or are
fetched at the shop denote no place; copies of a row are one record; null
ids are left out; where no confusions can be learned, names that share
nothing else must agree but for swapped and doubled signs and endings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fedsql.llm.address_parse import ESTATE_ENDS, STREET_ENDS, parse
from fedsql.operators.components import components
from fedsql.session import written

# ---- fixed values -------------------------------------------------------
#: Abbreviation dictionary: endings of names that stand for one another.
ABBREVIATIONS = {"大路": "大道"}
# -------------------------------------------------------------------------
KINDS = ("province", "city", "district", "street", "number", "estate", "building", "unit", "room")
INF = float("inf")
#: (opening, extending) a gap for each kind of token: areas are often left out, numbers of a flat never.
GAPS = {"province": (0.05, 0.05), "city": (0.1, 0.1), "district": (0.2, 0.2), "street": (0.1, 0.1), "number": (INF, 0.0), "estate": (0.1, 0.1), "building": (INF, INF), "unit": (INF, INF), "room": (INF, INF)}
ABBREVIATED, VARIANT, OTHER = 0.05, 0.3, 0.8
#: Where only one of street and estate is on both sides, less else speaks for the pair.
ONE_NAME = 0.6
ACCEPT = 1.35
BANDS, ROWS = 2, 3
#: Spellings of one bucket that one task compares with each other at most, about.
SPLIT = 2_000
#: Places at which a pair of signs must have been confused to be known for it.
SUPPORT = 2
#: Pairs of signs that the model has at most: those confused at the most places.
MOST_CONFUSIONS = 20_000

Pairs = Collection[tuple[str, str]]


def ending(name: str) -> tuple[str, str]:
    """A name without its ending, and the ending."""
    end = next((e for e in (*STREET_ENDS, *ESTATE_ENDS) if name.endswith(e)), "")
    return name[: len(name) - len(end)], end


def name_cost(a: str, b: str, variants: Pairs = ()) -> float:
    """Edit cost of two names: confused signs, neighbours in the wrong order and doubled signs cost less than others, abbreviated endings least."""
    if a == b:
        return 0.0
    (x, e), (y, f) = ending(a), ending(b)
    if e != f and ABBREVIATIONS.get(e, e) == ABBREVIATIONS.get(f, f):
        return ABBREVIATED + name_cost(x + ABBREVIATIONS.get(e, e), y + ABBREVIATIONS.get(f, f), variants)
    n, m = len(a), len(b)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                d[i][j] = OTHER * (i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            drop = VARIANT if i > 1 and a[i - 2] == x else OTHER
            grow = VARIANT if j > 1 and b[j - 2] == y else OTHER
            best = min(d[i - 1][j - 1] + (0.0 if x == y else VARIANT if (x, y) in variants else OTHER), d[i - 1][j] + drop, d[i][j - 1] + grow)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, d[i - 2][j - 2] + VARIANT)
            d[i][j] = best
    return d[n][m]


def token_cost(kind: str, a: str, b: str, variants: Pairs = ()) -> float:
    """Of putting b for a; tokens of unlike kinds are never put for each other."""
    if a == b:
        return 0.0
    if kind in ("street", "estate"):
        return name_cost(a, b, variants)
    if kind in ("province", "city", "district"):
        return 0.1 if a.endswith(b) or b.endswith(a) else INF
    return INF


def alignment_cost(a: list[tuple[str, str]], b: list[tuple[str, str]], variants: Pairs = ()) -> float:
    """Least cost of aligning two token sequences with affine gaps (three states: matched, gap in b, gap in a).

    Only a kind of token that the other side lacks can stand in a gap; what both have must agree.
    """
    n, m = len(a), len(b)
    shared = {k for k, _ in a} & {k for k, _ in b}
    gap = lambda kind: (INF, INF) if kind in shared else GAPS[kind]
    match = [[INF] * (m + 1) for _ in range(n + 1)]
    less = [[INF] * (m + 1) for _ in range(n + 1)]
    more = [[INF] * (m + 1) for _ in range(n + 1)]
    match[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j and a[i - 1][0] == b[j - 1][0] and (c := token_cost(*a[i - 1], b[j - 1][1], variants)) < INF:
                match[i][j] = min(match[i - 1][j - 1], less[i - 1][j - 1], more[i - 1][j - 1]) + c
            if i:
                opening, extending = gap(a[i - 1][0])
                less[i][j] = min(min(match[i - 1][j], more[i - 1][j]) + opening, less[i - 1][j] + extending)
            if j:
                opening, extending = gap(b[j - 1][0])
                more[i][j] = min(min(match[i][j - 1], less[i][j - 1]) + opening, more[i][j - 1] + extending)
    return min(match[n][m], less[n][m], more[n][m])


def tokens(spelling: str) -> list[tuple[str, str]]:
    return [(k, v) for k, v in zip(KINDS, spelling.split("|")) if v]


def same_place(a: str, b: str, variants: Pairs = ()) -> bool:
    """Whether two spellings denote one place."""
    x, y = tokens(a), tokens(b)
    names = {k for k, _ in x} & {k for k, _ in y} & {"street", "estate"}
    if not names:
        return False
    return alignment_cost(x, y, variants) + (ONE_NAME if len(names) == 1 else 0.0) <= ACCEPT


def both_ways(pairs: Pairs) -> frozenset[tuple[str, str]]:
    return frozenset((a, b) for x, y in pairs for a, b in ((x, y), (y, x)))


def folded(pairs: Pairs) -> dict[str, str]:
    """Each confused sign and the least sign it is, over others or not, confused with."""
    of: dict[str, str] = {}

    def least(x: str) -> str:
        while of.get(x, x) != x:
            x = of[x]
        return x

    for a, b in pairs:
        x, y = sorted((least(a), least(b)))
        of[y] = x
    return {x: least(x) for x in {s for p in pairs for s in p} if least(x) != x}


def _ended(name: Column) -> Column:
    """A name with its abbreviated ending written out."""
    for short, full in ABBREVIATIONS.items():
        name = F.regexp_replace(name, f"{short}$", full)
    return name


def confusions(members: DataFrame) -> frozenset[tuple[str, str]]:
    """Pairs of signs that are taken for each other, learned from all rows of members(id, spelling).

    A key holds everything of an address but one of its two names; it has room and number, so its rows are of one
    place.  The name most rows have is taken to be right; another of the same length that differs in one sign is a
    place where two signs were confused.
    """
    part = F.split("spelling", r"\|")
    both = members.groupBy("spelling").agg(F.count(F.lit(1)).alias("n")).select(part.alias("t"), "n").filter("t[3] <> '' and t[4] <> '' and t[5] <> '' and t[8] <> ''")
    rest = [F.col("t")[k] for k in (4, 6, 7, 8)]
    side = lambda kind, other: F.struct(F.concat_ws("|", F.lit(KINDS[kind]), F.col("t")[kind], *rest).alias("key"), _ended(F.col("t")[other]).alias("name"))
    named = both.select("n", F.inline(F.array(side(3, 5), side(5, 3)))).groupBy("key", "name").agg(F.sum("n").alias("n"))
    most = W.partitionBy("key").orderBy(F.desc("n"), "name")
    typed = named.withColumn("right", F.first("name").over(most)).filter((F.col("name") != F.col("right")) & (F.length("name") == F.length("right")))
    differ = F.filter(F.arrays_zip(F.split("name", "").alias("a"), F.split("right", "").alias("b")), lambda z: z["a"] != z["b"])
    signs = typed.select(differ.alias("all")).filter("size(all) = 1").select(F.col("all")[0].alias("d")).select(F.least("d.a", "d.b").alias("a"), F.greatest("d.a", "d.b").alias("b"))
    best = signs.groupBy("a", "b").count().filter(F.col("count") >= SUPPORT).orderBy(F.desc("count"), "a", "b").limit(MOST_CONFUSIONS)
    return both_ways([(r.a, r.b) for r in best.collect()])  # the model


def shingles(name: Column, fold: dict[str, str]) -> Column:
    """The signs of a name, confused ones as one, and its ending written out.

    Two names that :func:`same_place` accepts as the cheaper of its shared names have the same set: such a name costs
    at most ACCEPT / 2 or ACCEPT - ONE_NAME, so less than OTHER, and so every differing sign is a confused, doubled
    or swapped one or stands in an abbreviated ending.
    """
    name = _ended(name)
    if fold:
        name = F.translate(name, "".join(fold), "".join(fold.values()))
    return F.array_distinct(F.filter(F.split(name, ""), lambda s: s != ""))


def bands(spelling: Column, fold: dict[str, str], n: int = BANDS, rows: int = ROWS) -> Column:
    """The MinHash bands of a spelling's names, each keyed with the number tokens that must agree.

    A sign is hashed once; the orders that the least hashes are taken in are those of the hashes with some bits turned.
    """
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    turn = [int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "big", signed=True) for k in range(n * rows)]

    def turned(mask: int) -> Callable[[Column], Column]:
        return lambda h: h.bitwiseXOR(F.lit(mask).cast("bigint"))

    def of_name(kind: int, part: Column, numbers: list[Column]) -> Column:
        def keys(hashes: Column) -> Column:
            return F.array(*(F.xxhash64(F.lit(f"{KINDS[kind]}{b}"), *(F.array_min(F.transform(hashes, turned(turn[b * rows + r]))) for r in range(rows)), *numbers) for b in range(n)))

        signs = F.transform(shingles(part[kind], fold), lambda s: F.xxhash64(s))
        return F.when(part[kind] == "", F.array().cast("array<bigint>")).otherwise(let(signs, keys))

    def read(part: Column) -> Column:
        flat = [part[k] for k in (6, 7, 8)]
        # a street always has its house number beside it, an estate may be given with or without
        return F.concat(of_name(3, part, [part[4], *flat]), of_name(5, part, flat))

    return let(F.split(spelling, r"\|"), read)


def spellings(df: DataFrame, ident: Column, province: Column, city: Column, region: Column, detail: Column) -> DataFrame:
    """(id, spelling): the tokens of each record that names a place, joined by ``|``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            read = [parse(*x) for x in zip(f["p"], f["c"], f["r"], f["d"])]
            yield pd.DataFrame({"id": f["id"], "spelling": [a and "|".join(x or "" for x in a) for a in read]}).dropna()

    text = lambda c, n: c.cast("string").alias(n)
    rows = df.select(ident.cast("bigint").alias("id"), text(province, "p"), text(city, "c"), text(region, "r"), text(detail, "d")).filter("id is not null and coalesce(d, r, c, p) is not null")
    return rows.mapInPandas(run, "id bigint, spelling string").distinct()


def split(keyed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join of keyed(band, ...) with itself by (band, part): a bucket of n rows, more than ``most``, is cut into n / most parts.

    The left side has each row in its part, the right one in all parts of its bucket, so every pair meets once.
    """
    large = keyed.groupBy("band").count().filter(F.col("count") > most).select("band", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    none = F.lit(0)
    if large.limit(1).count() == 0:
        return keyed.withColumn("part", none), keyed.withColumn("part", none)
    cut = keyed.join(large, "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return cut.withColumn("part", F.pmod("h", F.col("parts")).cast("int")).drop("parts"), cut.withColumn("part", F.explode(F.sequence(none, F.col("parts") - 1))).drop("parts")


def classes(members: DataFrame, most: int = SPLIT) -> DataFrame:
    """(spelling, place) of each spelling of members(id, spelling); place is the class's least spelling number."""
    variants = confusions(members)
    part = F.split("spelling", r"\|")
    code = lambda k: F.when(part[k] != "", F.hash(part[k]))
    area = lambda k: F.when(part[k] != "", F.hash(F.right(part[k], F.lit(1))))  # noqa: E731  # one area may be the end of the other
    own = written(members.select("spelling").distinct().select(F.xxhash64("spelling").alias("h"), "spelling", bands(F.col("spelling"), folded(variants)).alias("bands")), "spellings")
    keyed = own.select("h", "spelling", "bands", area(0).alias("p"), area(1).alias("c"), area(2).alias("d"), code(4).alias("n"), F.explode("bands").alias("band"))
    left, right = split(keyed, most)
    a, b = left.alias("a"), right.alias("b")
    agree = (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.h") < F.col("b.h"))
    for k in "pcdn":
        agree &= F.coalesce(F.col(f"a.{k}") == F.col(f"b.{k}"), F.lit(True))
    # a pair is looked at in the first band it shares
    once = F.element_at(F.array_intersect("a.bands", "b.bands"), 1) == F.col("a.band")
    pairs = a.join(b, agree).filter(once).select(F.col("a.h").alias("a"), F.col("b.h").alias("b"), F.col("a.spelling").alias("sa"), F.col("b.spelling").alias("sb"))

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [same_place(x, y, variants) for x, y in zip(f["sa"], f["sb"])]
            yield f.loc[keep, ["a", "b"]]

    links = written(pairs.mapInPandas(verified, "a bigint, b bigint"), "links")
    labels = components(links)
    return own.join(labels, own["h"] == labels["node"], "left").select("spelling", F.coalesce("component", "h").alias("place"))


def places(df: DataFrame, ident: Column, province: Column, city: Column, region: Column, detail: Column) -> DataFrame:
    """(id, place): the class of each record that names a place."""
    members = written(spellings(df, ident, province, city, region, detail), "members")
    return members.join(classes(members), "spelling").select("id", "place").distinct()


def same_pairs(placed: DataFrame) -> DataFrame:
    """(id_a, id_b) of records with one place, id_a < id_b.  The result itself grows with the square of a class."""
    a, b = placed.alias("a"), placed.alias("b")
    return a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
