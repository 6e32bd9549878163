"""The general training-data operators against brute force, and their edge cases."""

import json
import random
import re
import unicodedata
from collections import defaultdict
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from fedsql.operators import components, instants, nested, references, rolling, versions
from fedsql.plans import training_queries as q

UTC = timezone.utc
OFFSETS = {"CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "AEST": 600, "AEDT": 660, "UTC": 0, "GMT": 0}


def wall(dt, zone):
    """The instant of a wall time: the earlier of two; a skipped one with the offset before."""
    return dt.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(UTC)


def brute_instant(text, zone):
    if text is None:
        return None
    t = " ".join(unicodedata.normalize("NFKC", text).split())
    for pattern, kind in (
        (r"(\d{4})[-/](\d\d)[-/](\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)?(.*)", "ymd"), (r"(\d{4})年(\d+)月(\d+)日(?: (\d+)时(\d+)分(\d+)秒)?()()", "ymd"),
        (r"(\d{4})(\d\d)(\d\d)(?:T?(\d\d)(\d\d)(\d\d))?()(Z?)", "ymd"), (r"(\d\d?)[./](\d\d?)[./](\d{4})(?: (\d\d):(\d\d)(?::(\d\d))?)?()()", "dmy"),
        (r"(?:\w{3}, )?(\d\d?) ([A-Z][a-z]{2}) (\d{4})(?: (\d\d):(\d\d):(\d\d))?()(.*)", "dmy"), (r"([A-Z][a-z]{2}) (\d\d?), (\d{4}) (\d\d?):(\d\d):(\d\d)() ([AP]M)", "mdy"),
    ):
        if m := re.fullmatch(pattern, t):
            break
    else:
        if re.fullmatch(r"\d{10}", t):
            return datetime.fromtimestamp(int(t), UTC)
        if re.fullmatch(r"\d{13}", t):
            return datetime.fromtimestamp(0, UTC) + timedelta(milliseconds=int(t))
        return None
    g = m.groups()
    y, mo, d = {"ymd": g[:3], "dmy": (g[2], g[1], g[0]), "mdy": (g[2], g[0], g[1])}[kind]
    if mo.isalpha():
        mo = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split().index(mo) + 1
    h, mi, s = (int(x or 0) for x in g[3:6])
    rest = (g[7] or "").strip()
    if rest in ("AM", "PM"):
        h, rest = h % 12 + 12 * (rest == "PM"), ""
    try:
        dt = datetime(int(y), int(mo), int(d), h, mi, s, int((g[6] or "0").ljust(6, "0")[:6]))
    except ValueError:
        return None
    if rest in ("", "Z"):
        return wall(dt, zone) if not rest else dt.replace(tzinfo=UTC)
    if m := re.fullmatch(r"(?:UTC|GMT)?([+-])(\d\d?):?(\d\d)?", rest):
        return dt.replace(tzinfo=UTC) - timedelta(minutes=(60 * int(m[2]) + int(m[3] or 0)) * (1 if m[1] == "+" else -1))
    if rest in OFFSETS:
        return dt.replace(tzinfo=UTC) - timedelta(minutes=OFFSETS[rest])
    return wall(dt, rest.strip("[]"))


def micros(dt):
    return (dt - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def test_instants_of_the_tables_as_brute_force(spark, data):
    got = {(r.table_name, r.row_key, r.field_name): r.utc_us for r in q.p2_found(spark, data).collect()}
    want = {}
    for r in q._texts(spark, data).distinct().collect():
        if r.text is not None and not re.fullmatch(instants.STRICT, r.text) and (dt := brute_instant(r.text, r.zone)):
            want[r.table_name, r.row_key, r.field_name] = micros(dt)
    assert got == want


@pytest.mark.parametrize(("text", "zone", "want"), [
    ("2023-11-05 01:30:00", "America/New_York", "2023-11-05T05:30:00"),  # twice: the earlier
    ("2023-03-12 02:30:00", "America/New_York", "2023-03-12T07:30:00"),  # skipped: the offset before
    ("2024-02-30 10:00:00", "UTC", None), ("0000-00-00 00:00:00", "UTC", None), ("2023-11-05 25:61:00", "UTC", None), ("2023-11-05 10:00:60", "UTC", None),
    ("", "UTC", None), (None, "UTC", None), ("soon", "UTC", None), ("x" * 100_000, "UTC", None), ("2023-01-01 10:00:00 Nowhere/Land", "UTC", None),
    ("3/4/2023", "UTC", "2023-04-03T00:00:00"), ("2023-08-01 10:00 GMT-3", "UTC", "2023-08-01T13:00:00"), ("Jan 10, 2023 12:37:49 AM", "UTC", "2023-01-10T00:37:49"),
    ("２０２３-０９-２３ ２１：５３：５８", "Asia/Shanghai", "2023-09-23T13:53:58"), ("1691739819", "UTC", "2023-08-11T07:43:39"), ("2023-09-20 10:00:00", None, "2023-09-20T10:00:00"),
    ("2023-09-20 10:00:00", "Not/AZone", "2023-09-20T10:00:00"), ("13/13/2023", "UTC", None),
])
def test_one_reading(spark, text, zone, want):
    df = spark.createDataFrame([(text, zone)], "t string, z string")
    us = df.select(instants.instant(F.col("t"), F.col("z")).alias("us")).first().us
    assert us == (want and micros(datetime.fromisoformat(want).replace(tzinfo=UTC)))


def brute_viterbi(states):
    best = {(): 0.0}
    for s in states:
        after = {}
        for path, c in best.items():
            for x in s:
                cost = c + x[2] + (instants.step_cost(path[-1][:2], x[:2]) if path else 0)
                after[(*path, x)] = min(cost, after.get((*path, x), 1e9))
        best = after
    low = min(best.values())
    return low


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_over_partitions_is_viterbi_over_the_source(spark, seed):
    rng = random.Random(seed)
    rows, states = [], []
    for i in range(14):
        s = [(rng.randrange(10) * 86_400_000_000, rng.randrange(3), rng.random()) for _ in range(rng.choice([0, 1, 1, 2, 3] if seed else [2]))]
        rows.append(("a", f"k{i:03}", i, s))
        states += [s] if s else []
    df = spark.createDataFrame(rows + rows[:3], f"source string, key string, ord bigint, states {instants.STATES}")
    got = {r.key: r.us for r in instants.resolve(df.repartition(3)).collect()}
    assert len(got) == 14
    chosen = [[x for x in s if x[0] == got[k]] for _, k, _, s in rows if s]
    assert all(chosen) and brute_viterbi(chosen) == pytest.approx(brute_viterbi(states))


def test_viterbi_prefers_the_order_of_records(spark):
    texts = ["25.03.2023", "4.5.2023", "5.5.2023", "6.5.2023", "27.05.2023"]
    df = spark.createDataFrame([("s", f"{i}", i, t) for i, t in enumerate(texts)], "source string, key string, ord bigint, t string")
    df = df.withColumn("states", instants.readings(F.col("t"), F.lit("UTC"), day_first=None)).drop("t")
    got = [r.us for r in instants.resolve(df).orderBy("key").collect()]
    assert got == sorted(got) and datetime.fromtimestamp(got[1] / 1e6, UTC).month == 5
    assert instants.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("spread", [1, 6])
def test_month_first_where_the_order_of_records_says_so(spark, spread):
    texts = ["03/14/2023", "04/05/2023", "04/06/2023", "04/20/2023", "05/06/2023", "06/05/2023", "06/30/2023"]
    df = spark.createDataFrame([(s, f"{i:03d}", t if s == "us" or int(t[:2]) < 13 and int(t[3:5]) < 13 else t[3:6] + t[:3] + t[6:]) for s in ("us", "eu") for i, t in enumerate(texts * spread if s == "eu" else texts)], "source string, key string, t string").repartition(4)
    got = {}
    for r in instants.resolve(df, "key", instants.readings(F.col("t"), F.lit("UTC"), day_first=None), keep=("t",)).collect():
        got.setdefault(r.source, {})[r.key] = datetime.fromtimestamp(r.us / 1e6, UTC)
    assert [d.strftime("%m/%d/%Y") for _, d in sorted(got["us"].items())] == texts
    assert len(got["eu"]) == len(texts) * spread
    by_rule = instants.readings(F.col("t"), F.lit("UTC"))
    assert df.select(F.size(by_rule).alias("n")).filter("n > 1").count() == 0


@pytest.mark.parametrize(("text", "zone", "want"), [
    ("04/03/2023 10:00", "UTC", {"2023-03-04T10:00:00": False, "2023-04-03T10:00:00": True}), ("03/25/2023", "UTC", {}), ("25/03/2023", "UTC", {"2023-03-25T00:00:00": False}),
    ("2023-11-05 01:30:00", "America/New_York", {"2023-11-05T05:30:00": False, "2023-11-05T06:30:00": True}), ("2023-11-05 02:00:00", "America/New_York", {"2023-11-05T07:00:00": False}),
    ("2023-03-12 02:30:00", "America/New_York", {"2023-03-12T07:30:00": False}), ("2023-04-02 01:45:00", "Australia/Lord_Howe", {"2023-04-01T14:45:00": False, "2023-04-01T15:15:00": True}),
    ("2023-11-05 01:30:00 EST", "America/New_York", {"2023-11-05T06:30:00": False}), ("2023-11-05 01:30:00", "EST5EDT", {"2023-11-05T05:30:00": False, "2023-11-05T06:30:00": True}), ("soon", "UTC", {}), ("2023-11-04 01:30:00", "America/New_York", {"2023-11-04T05:30:00": False}),
])
def test_every_reading_with_the_rules_as_costs(spark, text, zone, want):
    df = spark.createDataFrame([(text, zone)], "t string, z string")
    got = df.select(instants.readings(F.col("t"), F.col("z"), against=instants.AGAINST).alias("r")).first().r
    assert {x.us: x.cost >= instants.AGAINST for x in got} == {micros(datetime.fromisoformat(t).replace(tzinfo=UTC)): c for t, c in want.items()}


def test_p2_lets_viterbi_choose_among_every_reading(spark, tmp_path, monkeypatch):
    import duckdb

    month_first = ["03/14/2023", "04/05/2023", "04/06/2023", "04/07/2023 10:00", "2023-11-05 01:30:00", "06/06/2023", None, "07/08/2023", "07/30/2023", "2023-08-01T00:00:00Z", "08/09/2023", "soon"]
    tables = {
        "demo": ([(f"d{i:02}", t, t) for i, t in enumerate(month_first)], "_id string, start_date string, created_at string"),
        "site_orders": ([(i, t, "America/New_York" if i % 2 == 0 else None) for i, t in enumerate(month_first)], "order_id bigint, order_at string, time_zone string"),
        "member_orders": ([(i, t) for i, t in enumerate(month_first * 3)], "id bigint, create_time string"),
    }
    c = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    several, choose = [], instants.choose_ends
    monkeypatch.setattr(instants, "choose_ends", lambda rows: several.append(rows) or choose(rows))
    got = sorted(tuple(r) for r in q.p2_found(spark, str(tmp_path)).select("table_name", "row_key", "field_name", "utc_us").collect())
    assert len(several) == 4  # one call for each source
    assert got == sorted(c.execute(f"select table_name, row_key, field_name, utc_us from ({q.SQL['p2_found']})").fetchall())


@pytest.mark.parametrize("seed", range(2))
def test_viterbi_over_long_runs(spark, seed):
    rng = random.Random(seed)
    rows = [("a", f"k{i:04}", i, [(rng.randrange(1000) * 3_600_000_000, rng.randrange(3), rng.random()) for _ in range(rng.choice([1, 2, 3] if seed else [2, 3]))]) for i in range(3000)]
    got = {r.key: r.us for r in instants.resolve(spark.createDataFrame(rows, f"source string, key string, ord bigint, states {instants.STATES}").repartition(3)).collect()}

    def least(seq):
        costs = [x[2] for x in seq[0]]
        for a, b in zip(seq, seq[1:]):
            costs = [x[2] + min(c + instants.step_cost(p[:2], x[:2]) for c, p in zip(costs, a)) for x in b]
        return min(costs)

    assert len(got) == len(rows)
    assert least([[x for x in s if x[0] == got[k]] for _, k, _, s in rows]) == pytest.approx(least([s for *_, s in rows]))


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_as_duckdb(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in ("demo", "site_orders", "member_orders", "user_data", "raw_records", "sites", "devices", "services", "order_feed", "run_log"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    columns = sorted(d[0] for d in c.execute(q.SQL[name]).description)
    df = q.QUERIES[name](spark, data)
    assert sorted(df.columns) == columns
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(tuple(r) for r in c.execute(f"select {', '.join(columns)} from ({q.SQL[name]})").fetchall())


def test_tables_kept_on_the_way_can_be_removed(spark):
    import os

    from fedsql import session

    path = os.path.dirname(session.shared_path(spark, "x").removeprefix("file://"))
    kept = session.written(spark.range(3), "y")
    assert kept.count() == 3 and len(os.listdir(path)) >= 1
    session.remove(spark)
    assert not os.path.exists(path) and session.written(spark.range(3), "y").count() == 3
    with pytest.raises(Exception, match=r"FileNotFound|PATH_NOT_FOUND|not exist"):
        kept.collect()


def test_rolling_as_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), date(2023, 1, 1) + timedelta(days=rng.randrange(90)), rng.choice([None, float("nan"), 0.1, 12.34, -5.0])) for _ in range(300)] + [(4, None, 1.0)]
    df = spark.createDataFrame(rows, "entity bigint, day date, amount double").withColumn("cents", rolling.cents(F.col("amount")))
    got = {(r.entity, r.day): (r.active, r.sum_7, r.sum_30) for r in rolling.trailing(rolling.daily_totals(df)).collect()}
    sums = defaultdict(int)
    for e, d, a in rows:
        if e is not None and d is not None:
            sums[e, d] += 0 if a is None or a != a else round(a * 100)
    want = {}
    for e in {k[0] for k in sums}:
        days = [d for x, d in sums if x == e]
        d = min(days)
        while d <= max(days):
            want[e, d] = ((e, d) in sums, *(sum(v for (x, y), v in sums.items() if x == e and d - timedelta(days=p) < y <= d) for p in (7, 30)))
            d += timedelta(days=1)
    assert got == want
    assert rolling.trailing(rolling.daily_totals(df.limit(0))).count() == 0


def test_rolling_query_as_brute_force(spark, data):
    rows = {r.id: r for r in spark.read.parquet(f"{data}/member_orders.parquet").collect()}
    sums = defaultdict(int)
    for r in rows.values():
        if r.member_id is not None and (dt := brute_instant(r.create_time, "Asia/Shanghai")):
            sums[r.member_id, dt.astimezone(ZoneInfo("Asia/Shanghai")).date()] += round((r.pay_amount or 0) * 100)
    want = set()
    for m in {k[0] for k in sums}:
        mine = {d: v for (x, d), v in sums.items() if x == m}
        d = min(mine)
        while d <= max(mine):
            total = lambda p: sum(v for y, v in mine.items() if d - timedelta(days=p) < y <= d)  # noqa: B023, E731
            if d not in mine and total(7) * 30 > total(30) * 7:
                want.add((m, d.isoformat()))
            d += timedelta(days=1)
    assert {tuple(r) for r in q.p3_found(spark, data).collect()} == want


def meant(x):
    if isinstance(x, str):
        try:
            y = json.loads(x)
            return meant(y) if not isinstance(y, (int, float)) or isinstance(y, bool) else x
        except ValueError:
            return x
    return x


def children(doc):
    get = lambda x, k: meant(meant(x).get(k)) if isinstance(meant(x), dict) else None
    aslist = lambda x: [] if x is None else x if isinstance(x, list) else [x]
    order = get(doc, "order")
    for name, found in (("goodsId", [get(g, "goodsId") for g in aslist(get(order, "goodses"))]), ("payTypes", aslist(get(get(order, "payInfo"), "payTypes"))),
                        ("timeout_time", [get(r, "timeout_time") for r in aslist(get(doc, "rules"))]), ("sites", aslist(get(doc, "sites")))):
        yield from ((name, i, str(meant(v))) for i, v in enumerate(found) if meant(v) is not None)


def test_nested_query_as_brute_force(spark, data):
    want = set()
    for t, key in (("user_data", lambda r: r.order and r.order.orderId), ("demo", lambda r: r["_id"]), ("raw_records", lambda r: r.record_no)):
        for r in spark.read.parquet(f"{data}/{t}.parquet").collect():
            try:
                doc = json.loads(r.payload) if t == "raw_records" and r.payload is not None else r.asDict(True) if t != "raw_records" else None
            except ValueError:
                continue
            if doc is not None and key(r) is not None:
                want |= {(t, str(key(r)), *c) for c in children(doc)}
    rows = [tuple(r) for r in q.p4_found(spark, data).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_json_of_every_shape(spark):
    texts = ['{"sites": 5}', '{"sites": "[1, null, 2]"}', '{"sites": [1, "null", [3]]}', '{"sites": NaN}', '{"sites": [1', None, "", "[]", "null", '"{\\"sites\\": [7]}"', '{"sites": [1e3, 12345678901234567890123]}', "[" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = sorted((int(r.parent_key), r.dewey[-1], r.value) for r in nested.shred_json(df, F.col("k"), F.col("text"), [("sites",)], [("sites", "[]")]).collect())
    assert got == [(0, 0, "5"), (1, 0, "1"), (1, 2, "2"), (2, 0, "1"), (9, 0, "7"), (10, 0, "1e3"), (10, 1, "12345678901234567890123")]
    up = nested.parents(nested.shred_json(df.limit(1), F.col("k"), F.col("text"), [("sites",)])).first()
    assert up.parent_dewey == up.dewey[:-1]


def test_schema_paths_with_dots(spark):
    df = spark.createDataFrame([(1, [(("x",),)])], "k int, `a.b` array<struct<`c.d`: struct<e: string>>>")
    assert nested.schema_paths(df.schema)["a.b/[]/c.d/e"] == ("a.b", "[]", "c.d", "e")
    assert nested.shred(df, F.col("k"), [("a.b", "[]", "c.d", "e")]).first().value == "x"


def test_labels_lead_from_a_value_to_its_element_and_owner(spark):
    df = spark.createDataFrame([(1, [([(7, "a"), None, (8, None)], [[1, None], [], None, [2]]), None])] * 2 + [(2, None), (3, [])], "k int, xs array<struct<ys: array<struct<n: int, t: string>>, grid: array<array<int>>>>")
    paths = [("xs", "[]", "ys", "[]", "t"), ("xs", "[]", "grid", "[]", "[]"), ("xs", "[]", "ys", "[]", "n")]
    nodes = nested.shred(df, F.col("k"), paths)
    got = {(r.path, *r.dewey): (r.value, r.element, r.pos, r.owner) for r in nested.elements(nodes).collect()}
    assert got == {
        ("xs/[]/ys/[]/t", 1, 0, 0, 0, 1): ("a", [1, 0, 0, 0], 0, [1, 0]), ("xs/[]/ys/[]/n", 1, 0, 0, 0, 0): ("7", [1, 0, 0, 0], 0, [1, 0]), ("xs/[]/ys/[]/n", 1, 0, 0, 2, 0): ("8", [1, 0, 0, 2], 2, [1, 0]),
        ("xs/[]/grid/[]/[]", 1, 0, 1, 0, 0): ("1", [1, 0, 1, 0, 0], 0, [1, 0, 1]), ("xs/[]/grid/[]/[]", 1, 0, 1, 3, 0): ("2", [1, 0, 1, 3, 0], 0, [1, 0, 1]),
    }
    assert nodes.count() == len(got)
    up = nested.parents(nodes).filter("path = 'xs/[]/ys/[]/t'").first()
    assert up.parent_dewey == [1, 0, 0, 0] and up.parent_path == "xs/[]/ys/[]"


SCHEMA = "id bigint, v string"


def tables(spark, tmp_path):
    from pyspark.sql.types import StructType

    s = StructType.fromDDL(SCHEMA)
    return versions.VersionedTable(spark, f"file://{tmp_path}/src", s), versions.VersionedTable(spark, f"file://{tmp_path}/out", s)


def test_runs_take_each_change_once_whatever_fails(spark, tmp_path):
    src, out = tables(spark, tmp_path)
    make = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], SCHEMA)
    step = lambda d: d.filter("sign = 1").drop("sign")
    src.append(make(1, 2))
    assert versions.run_once(src, out, step) == (0, 1)
    assert versions.run_once(src, out, step) is None
    src.append(make(3))

    def breaks(d):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        versions.run_once(src, out, breaks)
    out.write_files(make(99))  # a run that died before its commit leaves files that count for nothing
    src.append(make(4))
    assert versions.run_once(src, out, step) == (1, 3)
    assert sorted(r.id for r in out.read().collect()) == [1, 2, 3, 4]
    with pytest.raises(versions.Conflict):
        out.commit({}, {}, 0)


def test_deletion_vectors_and_removed_files(spark, tmp_path):
    src, _ = tables(spark, tmp_path)
    src.append(spark.createDataFrame([(i, "x") for i in range(10)], SCHEMA).coalesce(1))
    src.append(spark.createDataFrame([(i, "y") for i in range(10, 12)], SCHEMA).coalesce(1))
    src.delete("id in (3, 5)")
    src.delete("id >= 10 or id = 4")
    assert sorted(r.id for r in src.read().collect()) == [0, 1, 2, 6, 7, 8, 9]
    assert sorted((r.id, r.sign) for r in src.delta(2, 4).collect()) == [(3, -1), (4, -1), (5, -1), (10, -1), (11, -1)]
    assert sorted((r.id, r.sign) for r in src.delta(4, 3).collect()) == [(4, 1), (10, 1), (11, 1)]
    assert src.delta(2, 2).count() == 0 and src.read(0).count() == 0


def test_runs_take_in_removed_files_and_deletion_vectors(spark, tmp_path):
    src, out = tables(spark, tmp_path)
    src.append(spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], SCHEMA).coalesce(1))
    signed = lambda d: d.select("id", F.col("sign").cast("string").alias("v"))
    assert versions.run_once(src, out, signed) == (0, 1)
    src.delete("id = 2")
    src.append(spark.createDataFrame([(4, "a")], SCHEMA).coalesce(1))
    src.append(spark.createDataFrame([(5, "a")], SCHEMA).coalesce(1))
    src.delete("id = 4")  # a whole file, added and removed between two runs
    assert versions.run_once(src, out, signed) == (1, 5) and versions.processed(out) == 5
    src.delete("id in (1, 3)")  # the rest of the first file
    assert versions.run_once(src, out, signed, to=6) == (5, 6)
    assert sorted((r.id, r.v) for r in out.read().collect()) == [(1, "-1"), (1, "1"), (2, "-1"), (2, "1"), (3, "-1"), (3, "1"), (5, "1")]
    assert [r.id for r in versions.net(out.read().select("id", F.col("v").cast("int").alias("sign"))).collect()] == [5]


def test_of_two_writers_of_a_version_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    src, _ = tables(spark, tmp_path)

    def write(k):
        try:
            return src.commit({f"f{k}": ()}, {}, 0)
        except versions.Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(write, range(8)), key=str).count(1) == 1
    assert src.latest() == 1 and len(src.manifest(1).files) == 1


def test_replay_of_no_runs_and_no_rows(spark, tmp_path):
    feed = spark.createDataFrame([(1, 5, None), (1, 6, 3), (None, 6, 3)], "id bigint, at bigint, m bigint")
    got = lambda f, runs, n: sorted(map(tuple, versions.replay(f, runs, "at", "id", "m", f"file://{tmp_path}/{n}").read().select("run_no", "id").collect()))
    assert got(feed, [], "a") == [] and got(feed.limit(0), [(1, 9, True)], "b") == []
    assert got(feed, [(1, 6, True), (2, 7, False), (3, 8, True)], "c") == [(1, 1), (3, 1)]


def test_ledger(spark):
    day = lambda m, d=1: datetime(2024, m, d)
    refs = lambda *r: spark.createDataFrame(r, "table_name string, key string, ts timestamp, sign int")
    exist = lambda *r: spark.createDataFrame(r, "table_name string, key string, ts timestamp, sign int, targets int")
    a = references.Ledger().apply(refs(("t", "a", day(1), 1), ("t", "b", day(1), 1), ("t", "b", day(2), 1), ("t", "b", day(2, 3), 1)), exist(("t", "a", day(1), 1, 1)))
    assert {(r.period, r.key, r.refs) for r in a.orphans().collect()} == {("2024-01", "b", 1), ("2024-02", "b", 2)}
    b = a.apply(refs(("t", "b", day(2), -1), ("t", "b", day(2, 3), -1)), exist(("t", "a", day(3), -1, 0)))
    assert {(r.period, r.key) for r in b.orphans().collect()} == {("2024-01", "a"), ("2024-01", "b")}
    c = b.apply(existence=exist(("t", "b", day(1), 1, 1)))
    assert {(r.period, r.key) for r in c.orphans().collect()} == {("2024-01", "a")}
    assert references.Ledger().apply().state is None


def test_orphans_at_edges(spark):
    ts = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    lives = spark.createDataFrame([("a", ts(1), ts(5)), ("a", ts(1), ts(5)), ("a", ts(40), None), ("b", ts(9), None), ("c", None, None), ("d", ts(3), ts(3)), (None, ts(0), None)], "key string, b timestamp, e timestamp")
    refs = spark.createDataFrame([("t", i, k, ts(h) if h is not None else None) for i, (k, h) in enumerate([("a", 1), ("a", 5), ("a", 0), ("a", 39), ("a", 40), ("b", 8), ("b", 9), ("x", 1), ("c", 1), ("d", 3), (None, 1), ("a", None)])], "table_name string, row_id int, key string, ts timestamp")
    run = lambda r, l: references.orphans_at(r, references.deltas_of_lives(l, "t", F.col("key"), F.col("b"), F.col("e")))  # noqa: E731, E741
    got = {r.row_id: r.reason for r in run(refs, lives).collect()}
    assert got == {1: "deleted", 2: "late", 3: "deleted", 5: "late", 7: "missing", 8: "late", 9: "late"}
    assert run(refs.limit(0), lives).count() == 0 and {r.reason for r in run(refs, lives.limit(0)).collect()} == {"missing"}
    other = refs.withColumn("table_name", F.lit("u"))
    assert {r.reason for r in run(other, lives).collect()} == {"missing"}


def test_signed_references_at_their_time(spark):
    ts = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    lives = spark.createDataFrame([("a", ts(1), ts(5)), ("a", ts(7), ts(30)), ("b", ts(1), None), ("e", ts(1), ts(2)), ("e", ts(2), ts(3))], "key string, b timestamp, e timestamp")
    rows = [(1, "a", 6, 1), (2, "a", 6, 1), (2, "a", 6, -1), (3, "x", 1, 1), (3, "x", 1, -1), (4, "x", 26, 1), (5, "b", 3, 1), (6, "a", 40, 1), (7, "a", 6, 1), (8, "a", 8, 1), (9, "e", 2, 1), (10, "e", 3, 1)]
    refs = spark.createDataFrame([("t", i, k, ts(h), n) for i, k, h, n in rows], "table_name string, row_id int, key string, ts timestamp, sign int")
    existence = references.deltas_of_lives(lives, "t", F.col("key"), F.col("b"), F.col("e"))
    counts = {(r.key, r.day.day): r.refs for r in references.Ledger().apply(refs, existence).state.collect() if r.refs}
    assert counts == {("a", 1): 3, ("x", 2): 1, ("b", 1): 1, ("a", 2): 1, ("e", 1): 2}
    found = references.orphans_at(refs, existence)
    assert {r.row_id: r.reason for r in found.collect()} == {1: "deleted", 4: "missing", 6: "deleted", 7: "deleted", 10: "deleted"}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 9), (7, 7), (None, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_extra_columns_with_clashing_names_do_no_harm(spark, data, tmp_path):
    for t in ("member_orders", "order_feed", "site_orders", "services", "demo", "user_data", "raw_records", "sites", "devices", "run_log"):
        df = spark.read.parquet(f"{data}/{t}.parquet")
        for c in ("entity", "day", "key", "ts", "us", "source", "version", "node"):
            df = df.withColumn(c, F.lit("x"))
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("p2_found", "p3_found", "p4_found", "p5_found", "p6_found"):
        same = lambda d: sorted(map(tuple, q.QUERIES[name](spark, str(d)).collect()))  # noqa: B023, E731
        assert same(tmp_path) == same(data), name


def test_empty_tables(spark, data, tmp_path):
    for t in ("member_orders", "order_feed", "site_orders", "services", "demo", "user_data", "raw_records", "sites", "devices", "run_log"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in q.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


