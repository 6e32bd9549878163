"""Times written in many manners, brought to one UTC instant each.

Every text gets the array of all its valid readings (:func:`readings`, plain
Spark expressions).  Where more than one reading is left, Viterbi over the
source's record order picks one (:func:`resolve`): a path pays for a reading's
own improbability, for each switch of format and for each backward jump.

Every path goes through a record with one reading, so such records part the
problem: only records with several readings, their neighbours and the ends of
range partitions are looked at, and where no record of any source has several,
nothing is put in order at all.  A partition reports, for each state it may be
entered in and left in, the cheapest way through (one small row); the driver
runs Viterbi over these rows, as many as there are partitions, and a second
pass fixes the readings inside.  The result is that of one pass over the whole
source.  Both passes stream: a task holds the records since the last one at
which all ways meet, not its partition.

Rules that say which reading is meant, such as day before month, are costs
(:data:`AGAINST`) that no order of records outweighs.

Defined results: null, empty and meaningless texts and impossible dates have
no reading and give null; rows repeated in all columns are one record; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zoneinfo
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fedsql.session import written

# ---- fixed values: zone abbreviations of Europe, the eastern United States and eastern Australia
ZONES = {
    "UTC": "+00:00", "UT": "+00:00", "GMT": "+00:00", "Z": "+00:00",
    "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00", "IST": "+01:00",
    "CET": "+01:00", "CEST": "+02:00", "MEZ": "+01:00", "MESZ": "+02:00",
    "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00",
    "EST": "-05:00", "EDT": "-04:00",
    "AEST": "+10:00", "AEDT": "+11:00",
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
WIDE, NARROW = "０１２３４５６７８９：－／．，＋　ＴＺ", "0123456789:-/.,+ TZ"
# ----------------------------------------------------------------------------------------------

_CLOCK = r"(?:[T ] ?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"
#: name -> (pattern, its year|month|day|hour|minute|second|fraction|rest of the text)
FORMATS = {
    "ymd": (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_CLOCK}\s*(.*)$", "$1|$3|$4|$5|$6|$7|$8|$9"),
    "dmy": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}){_CLOCK}\s*(.*)$", "$4|$3|$1|$5|$6|$7|$8|$9"),
    "mdy": (rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}){_CLOCK}\s*(.*)$", "$4|$1|$3|$5|$6|$7|$8|$9"),
    "d_mon_y": (r"^(?:[A-Za-z]{3,9}\.?,? )?(\d{1,2})[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})(?:,? (\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?\s*(.*)$", "$3|$2|$1|$4|$5|$6|$7|$8"),
    "mon_d_y": (r"^(?:[A-Za-z]{3,9}\.?,? )?([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})(?:,? (\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?\s*(.*)$", "$3|$1|$2|$4|$5|$6|$7|$8"),
    "han": (r"^(\d{4})年(\d{1,2})月(\d{1,2})[日号](?: ?(\d{1,2})[时点:](\d{1,2})[分:]?(?:(\d{1,2})(?:[.,](\d{1,9}))?秒?)?)?\s*(.*)$", "$1|$2|$3|$4|$5|$6|$7|$8"),
    "digits": (r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?)?(Z|[+-]\d{2}:?\d{2})?$", "$1|$2|$3|$4|$5|$6|$7|$8"),
}
#: Cost of a reading that a rule puts last.  A step costs at most 2 + log1p(days of 10,000 years) = 17.2 and another reading
#: of one record changes two steps, so no path gains by such a reading where the one the rule asks for is at hand.
AGAINST = 40.0
CODES = {name: k for k, name in enumerate([*FORMATS, "epoch_s", "epoch_ms"])}
STATES = "array<struct<us: bigint, fmt: int, cost: double>>"
STRICT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$"


#: How the texts of each format begin, so that each text meets the patterns of one or two formats.
SHAPES = (
    (r"^\d{4}[-/.]", ("ymd",)), (r"^\d{1,2}[-/.]\d", ("dmy", "mdy")), (r"^\d{4}年", ("han",)), (r"^\d{8}", ("digits",)),
    (r"^\d{1,2}[ -][A-Za-z]", ("d_mon_y",)), (r"^[A-Za-z]", ("d_mon_y", "mon_d_y")),
)
_REGIONS = sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("posix", "right", "System")))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _zone(text: Column) -> Column:
    """The zone that a text which is not empty names, null if none."""
    named = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))
    offset = r"^(?:UTC|GMT|utc|gmt)? ?([+-])(\d{1,2})(?::?([0-5]\d))?$"

    def read(t: Column) -> Column:
        hours = F.regexp_extract(t, offset, 2)
        return (
            F.when(t.rlike("^[A-Za-z]+$"), F.try_element_at(named, F.upper(t)))
            .when(t.rlike(offset) & (hours.try_cast("int") <= 18), F.concat(F.regexp_extract(t, offset, 1), F.lpad(hours, 2, "0"), F.lit(":"), F.rpad(F.regexp_extract(t, offset, 3), 2, "0")))
            .when(t.isin(_REGIONS), t)
        )

    return _let(F.regexp_replace(F.regexp_replace(text, r"^\[(.*)\]$", "$1"), r"^(Z|[+-]\d{2}:?\d{2})\[[^\]]+\]$", "$1"), read)


def _later(us: Column, zone: Column) -> Column:
    """The second instant of a wall time that occurs twice in ``zone``, of which ``us`` is the first; else null."""
    ahead = lambda t: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(t), zone)) - t
    turned = _let(ahead(us) - ahead(us + 25 * 3_600_000_000), lambda back: F.when(back > 0, us + back))  # no clock was put back by more than a day
    return F.when(~zone.rlike("^([+-]|UTC$)"), _let(turned, lambda t: F.when(ahead(t) + t == ahead(us) + us, t)))


def _instants(parts: Column, default: Column, twice: bool) -> Column:
    """Array of microseconds of format|year|month|day|hour|minute|second|fraction|rest, null if impossible.

    A skipped wall time is read with the offset before the change, and one that occurs twice is the earlier
    instant: what java.time, and so make_timestamp, does.  With ``twice`` the later instant follows it.
    """
    number = lambda c: F.when(c == "", F.lit(0)).otherwise(c.try_cast("int"))

    def at(p: Column, half: Column, zone: Column) -> Column:
        place = F.instr(F.lit(MONTHS), F.lower(F.substring(p[2], 1, 3)))
        month = F.coalesce(p[2].try_cast("int"), F.when((place > 0) & (place % 3 == 1), ((place + 2) / 3).cast("int")))
        hour = number(p[4])
        hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
        exact = F.concat(F.lpad(p[6], 2, "0"), F.lit("."), F.rpad(F.substring(p[7], 1, 6), 6, "0")).try_cast("decimal(16,6)")
        year = p[1].try_cast("int")
        ok = (year >= 1) & (number(p[6]) < 60) & ((half == "") | (p[4] != ""))
        first = F.when(ok, F.unix_micros(F.try_make_timestamp(year, month, p[3].try_cast("int"), hour, number(p[5]), exact, zone)))
        return _let(first, lambda us: F.array(us, _later(us, zone))) if twice else F.array(first)

    def read(p: Column) -> Column:
        def rest(t: Column) -> Column:
            half = F.upper(F.regexp_extract(t, r"^([AaPp][Mm])\b", 1))
            return _let(F.trim(F.regexp_replace(t, r"^[AaPp][Mm]\b", "")), lambda z: _let(F.when(z == "", default).otherwise(_zone(z)), lambda named: at(p, half, named)))

        return F.when(p[8] == "", at(p, F.lit(""), default)).otherwise(rest(F.trim(p[8])))

    return _let(F.split(parts, r"\|", 9), read)


def readings(text: Column, zone: Column, day_first: bool | None = True, against: float | None = None) -> Column:
    """All valid readings of ``text`` as ``array<struct<us, fmt, cost>>``, without a zone in ``zone``.

    ``day_first``: whether the day comes first in numeric dates whose year is last; ``None`` gives both readings.
    ``against``: the cost of the readings that the rules put last, which are the other order of day and month and the
    later instant of a wall time that occurs twice; ``None`` leaves them out.  A date that is possible only in
    the other order is by the rule an impossible one, and has no reading.
    Twelve digits may be a minute or milliseconds; other counts of digits have one meaning.
    """
    default = F.coalesce(F.when(zone.isin(sorted(zoneinfo.available_timezones())), zone), F.lit("UTC"))
    last = {True: ("mdy",), False: ("dmy",), None: ()}[day_first]
    state = lambda us, fmt, cost: F.struct(us.alias("us"), fmt.cast("int").alias("fmt"), cost.alias("cost"))
    extra = F.lit(against or 0.0)

    def dated(v: Column, forms: Column, cost: Column, home: Column) -> Column:
        each = lambda w: F.transform(_instants(w, home, against is not None), lambda us, k: state(us, F.substring_index(w, "|", 1), cost + F.when(k > 0, extra).otherwise(0.0)))
        return F.filter(F.flatten(F.transform(F.filter(forms, lambda w: w != v), each)), lambda s: s["us"].isNotNull())

    def read(v: Column, home: Column) -> Column:
        form = lambda n: F.regexp_replace(v, FORMATS[n][0], f"{CODES[n]}|{FORMATS[n][1]}")
        forms = F.array().cast("array<string>")
        for shape, names in reversed(SHAPES):
            forms = F.when(v.rlike(shape), F.array(*(form(n) for n in names if n not in last))).otherwise(forms)
        ruled = dated(v, forms, F.lit(0.0), home)
        if against is not None and last:
            shape = next(p for p, names in SHAPES if last[0] in names)
            ruled = _let(ruled, lambda r: F.when((F.size(r) > 0) & v.rlike(shape), F.concat(r, dated(v, F.array(form(last[0])), extra, home))).otherwise(r))
        epoch = F.array(
            F.when(v.rlike(r"^\d{9,10}$"), state(v.try_cast("bigint") * 1_000_000, F.lit(CODES["epoch_s"]), F.lit(0.0)))
            .when(v.rlike(r"^\d{12,13}$"), state(v.try_cast("bigint") * 1_000, F.lit(CODES["epoch_ms"]), F.when(F.length(v) == 12, 0.5).otherwise(0.0)))
        )
        return F.when(v.rlike(r"^\d{9,13}$"), F.filter(F.concat(ruled, epoch), lambda s: s["us"].isNotNull())).otherwise(ruled)

    return _let(default, lambda home: _let(F.trim(F.regexp_replace(F.translate(text, WIDE, NARROW), r"\s+", " ")), lambda v: read(v, home)))


def instant(text: Column, zone: Column) -> Column:
    """The likeliest reading by itself, in microseconds: for callers that have no record order."""
    r = F.array_sort(readings(text, zone), lambda a, b: F.when(a["cost"] < b["cost"], -1).when(a["cost"] > b["cost"], 1).otherwise(0))
    return F.get(r, 0)["us"]


def step_cost(before: tuple[int, int], after: tuple[int, int]) -> float:
    """Of going from one (us, fmt) to the next: 1 for a switch of format, 1 and more for a jump back."""
    cost = float(before[1] != after[1])
    if after[0] < before[0]:
        cost += 1 + math.log1p((before[0] - after[0]) / 86_400e6)
    return cost


State = tuple[int, int, float]
Record = tuple[tuple[str, int], int, int, list[State]]


def advance(costs: list[float], a: list[State], b: list[State], near: bool) -> tuple[list[float], list[int]]:
    """Viterbi's step from the states ``a`` to ``b``: the cost of each of ``b``, and the one of ``a`` it comes from.

    Between two that are not neighbours only records with one reading were left out, which cost every path the same.
    """
    ways = [[c + (step_cost(p[:2], s[:2]) if near else 0.0) for c, p in zip(costs, a)] for s in b]
    back = [min(range(len(a)), key=w.__getitem__) for w in ways]
    return [w[k] + s[2] for w, k, s in zip(ways, back, b)], back


def _entered(states: list[State], k: int) -> list[float]:
    return [s[2] if x == k else math.inf for x, s in enumerate(states)]


def _records(frames: Iterator[pd.DataFrame]) -> Iterator[Record]:
    """((source, pid), place, rid, states) of the records looked at, in order."""
    for f in frames:
        for source, pid, i, rid, states in zip(f["source"], f["pid"], f["i"], f["rid"], f["states"]):
            yield (source, int(pid)), int(i), int(rid), [(int(x["us"]), int(x["fmt"]), float(x["cost"])) for x in states]


def _ways(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The cheapest way through each partition of a source, for each state it is entered in and left in."""
    for (source, pid), rows in groupby(_records(frames), key=lambda r: r[0]):
        _, before, _, first = next(rows)
        costs, a = [_entered(first, k) for k in range(len(first))], first
        for _, i, _, b in rows:
            costs = [advance(c, a, b, i == before + 1)[0] for c in costs]
            before, a = i, b
        yield pd.DataFrame({"source": [source], "pid": [pid], "through": [[x for c in costs for x in c]], "first": [[list(map(float, s)) for s in first]], "last": [[list(map(float, s)) for s in a]]})


def _picks(frames: Iterator[pd.DataFrame], ends: dict[tuple[str, int], tuple[int, int]]) -> Iterator[pd.DataFrame]:
    """(rid, us) of the records with several readings; held are those since the last one at which all ways meet."""
    for key, rows in groupby(_records(frames), key=lambda r: r[0]):
        held: list[tuple[int, list[State], list[int]]] = []
        done: list[tuple[int, int]] = []

        def settle(k: int) -> None:
            while held:
                rid, states, back = held.pop()
                if len(states) > 1:
                    done.append((rid, states[k][0]))
                k = back[k]

        costs: list[float] = []
        for _, i, rid, states in rows:
            if not costs:
                costs, back = _entered(states, ends[key][0]), [-1] * len(states)
            else:
                costs, back = advance(costs, a, states, i == before + 1)
                if len(set(back)) == 1:
                    settle(back[0])
            held.append((rid, states, back))
            before, a = i, states
            if len(done) >= 10_000:
                yield pd.DataFrame(done, columns=["rid", "us"])
                done.clear()
        settle(ends[key][1])
        yield pd.DataFrame(done, columns=["rid", "us"]).astype("int64")


def choose_ends(rows: list[tuple[int, list[float], list[list[float]], list[list[float]]]]) -> dict[int, tuple[int, int]]:
    """Viterbi over partitions: rows of (pid, through, first states, last states) -> pid: (state entered in, state left in)."""
    rows = sorted(rows)
    best: list[dict[int, tuple[float, int, int]]] = []
    for k, (_, through, first, last) in enumerate(rows):
        here: dict[int, tuple[float, int, int]] = {}
        for b in range(len(last)):
            for a in range(len(first)):
                cost, back = through[a * len(last) + b], -1
                if k:
                    before = rows[k - 1][3]
                    come = {x: best[-1][x][0] + step_cost((int(before[x][0]), int(before[x][1])), (int(first[a][0]), int(first[a][1]))) for x in range(len(before))}
                    back = min(come, key=lambda x: (come[x], x))
                    cost += come[back]
                if b not in here or cost < here[b][0]:
                    here[b] = (cost, a, back)
        best.append(here)
    out: dict[int, tuple[int, int]] = {}
    b = min(best[-1], key=lambda x: (best[-1][x][0], x)) if best else -1
    for k in range(len(rows) - 1, -1, -1):
        _, a, back = best[k][b]
        out[rows[k][0]] = (a, b)
        b = back
    return out


def resolve(df: DataFrame, order: str = "ord", states: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source, key, ``keep``, us) of ``df``(source, key, ``order``, more): Viterbi's choice among ``states``.

    ``states`` (:data:`STATES`) is worked out once for each record; the column of that name is taken if not given.
    Rows equal in all columns are one record.  ``order`` gives the record order within a source, ties by key.
    """
    extra = list(dict.fromkeys(keep))
    rows = df.distinct().withColumn("states", F.coalesce(states if states is not None else F.col("states"), F.array().cast(STATES)))
    n = F.size("states")
    stated = written(
        rows.select("source", "key", *([] if order in ("source", "key", *extra) else [order]), *extra, "states").select(
            "*", n.alias("n"), F.monotonically_increasing_id().alias("rid"), F.get("states", F.lit(0))["us"].alias("us0")
        ).withColumn("states", F.when(F.col("n") > 0, F.col("states"))), "readings",
    )
    plain = lambda x: x.select("source", "key", *extra, F.col("us0").alias("us"))
    if stated.filter("n > 1").limit(1).count() == 0:
        return plain(stated)
    # the place of each record in its range partition, and whether a neighbour leaves a choice
    ranged = stated.filter("n > 0").repartitionByRange("source", order, "key").withColumn("pid", F.spark_partition_id())
    within = W.partitionBy("source", "pid").orderBy(order, "key", "rid")
    around = (
        ranged.withColumn("i", F.row_number().over(within)).withColumn("before", F.lag("n").over(within)).withColumn("after", F.lead("n").over(within))
        .filter("n > 1 or before is null or after is null or before > 1 or after > 1")
    )
    looked = written(around.select("source", "pid", "i", "rid", "states"), "choices")  # ranges are drawn anew if asked again
    inside = looked.repartition("source", "pid").sortWithinPartitions("source", "pid", "i")
    ways = inside.mapInPandas(_ways, "source string, pid int, through array<double>, first array<array<double>>, last array<array<double>>").collect()  # one row for each source and partition
    ends: dict[tuple[str, int], tuple[int, int]] = {}
    for source in {r.source for r in ways}:
        ends |= {(source, pid): e for pid, e in choose_ends([(r.pid, r.through, r.first, r.last) for r in ways if r.source == source]).items()}
    chosen = inside.mapInPandas(lambda frames: _picks(frames, ends), "rid bigint, us bigint").withColumnRenamed("us", "chosen")
    several = stated.filter("n > 1").join(chosen, "rid").select("source", "key", *extra, F.col("chosen").alias("us"))
    return plain(stated.filter("n <= 1")).unionByName(several)


def strict(text: Column) -> Column:
    """Whether a text is already ``YYYY-MM-DDThh:mm:ss`` with ``Z`` or ``±hh:mm``."""
    return F.coalesce(text.rlike(STRICT), F.lit(False))


assert re.compile(STRICT)
