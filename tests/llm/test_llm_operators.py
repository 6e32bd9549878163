"""The corpus operators against brute force, and their edge cases."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedsql.llm import address_parse, addresses, leaks, mixing, pieces, queries, topn
from fedsql.llm.tokens import counter
from fedsql.llm.words import words

FIELDS = ("receiver_province", "receiver_city", "receiver_region", "receiver_detail_address")


# ---- addresses -----------------------------------------------------------------------------------

@pytest.mark.parametrize(("a", "b", "same"), [
    (("珠明省", "宁信市", "昌义县", "星晨南大道593号安阳花园24栋3单元2201室"), (None, "珠明省宁信市", "昌义县", "安阳花园(星晨南大道五九三號)24#3单元22楼1号房"), True),
    (("珠明省", "宁信市", "昌义县", "星晨南大道593号安阳花园24栋3单元2201室"), ("珠明", "", None, "昌义县安阳花园24-3-2201【勿放快递柜】"), True),
    (("珠明省", "宁信市", "昌义县", "星晨南大道593号安阳花园24栋3单元2201室"), ("珠明省", "宁信市", "昌义县", "星晨南大道593号安阳花园24栋3单元2202室"), False),
    (("珠明省", "宁信市", "昌义县", "星晨南大道593号"), ("珠明省", "宁信市", "昌义县", "星晨南大道598号"), False),
    (("珠明省", "宁信市", "昌义县", "星晨南大道593号"), ("珠明省", "宁信市", "昌义县", "晨星南大道593#"), True),
    (("珠明省", "宁信市", "昌义县", "兴晨南大道593号"), ("珠明省", "宁信市", "昌义县", "新晨南大路593號"), True),
    (("珠明省", "宁信市", "昌义县", "兴晨南大道593号"), ("珠明省", "宁信市", "昌义县", "桐晨南大道593号"), False),
    (("珠明省", "宁信市", "昌义县", "星晨南大道593号"), ("珠明省", "江福市", "昌义县", "星晨南大道593号"), False),
    (("仁川省", "兴朗区", "岚松市", "桐川中大道458号"), ("仁川省", "岚松市", "兴朗区", "桐川中大道458号"), True),
    (("", "", None, "仁川 岚松 兴朗区桐川中大道458号 412房"), ("仁川省", "岚松市", "兴朗区", "桐川中大道458号412室"), True),
])
def test_two_addresses(spark, a, b, same):
    x, y = ("|".join(p or "" for p in address_parse.parse(*f)) for f in (a, b))
    known = addresses.both_ways([("兴", "新")])
    assert addresses.same_place(x, y, known) == same == addresses.same_place(y, x, known)
    if same and x != y:
        p, q = (r.b for r in spark.createDataFrame([(x,), (y,)], "s string").select(addresses.bands(F.col("s"), addresses.folded(known)).alias("b")).collect())
        assert set(p) & set(q)


@pytest.mark.parametrize("f", [(None,) * 4, ("", "", "", ""), ("自提", None, None, "门店自提"), ("珠明省", "宁信市", "昌义县", ""), (None, None, None, "，，")])
def test_no_place(f):
    assert address_parse.parse(*f) is None


def test_a_street_may_begin_like_its_province():
    a = address_parse.parse("海鹭省", "川珠市", "珠光区", "海鹭路793号201室")
    assert (a.street, a.number, a.room) == ("海鹭路", "793", "201")


def test_number_words():
    assert [address_parse.number_word(x) for x in ("四八八", "四百八十八", "十二", "二十", "一百零五", "六五二")] == ["488", "488", "12", "20", "105", "652"]


def brute_confusions(spelled):
    """As the model is defined: variants of one name where all the rest of an address is the same."""
    names, found = defaultdict(Counter), Counter()
    full = lambda n: n[:-2] + "大道" if n.endswith("大路") else n
    for s in spelled.values():
        p = s.split("|")
        if p[3] and p[4] and p[5] and p[8]:
            names["street", p[3], p[4], *p[6:]][full(p[5])] += 1
            names["estate", p[5], p[4], *p[6:]][full(p[3])] += 1
    for v in names.values():
        right = min(v, key=lambda x: (-v[x], x))
        for x in v:
            d = [(i, j) for i, j in zip(x, right) if i != j]
            if len(x) == len(right) and len(d) == 1:
                found[tuple(sorted(d[0]))] += 1
    return addresses.both_ways([p for p, n in found.items() if n >= addresses.SUPPORT])


def brute_places(rows):
    spelled = {i: "|".join(p or "" for p in a) for i, *f in rows if (a := address_parse.parse(*f))}
    variants = brute_confusions(spelled)
    by = defaultdict(list)
    for s in set(spelled.values()):
        p = s.split("|")
        by["|".join(p[6:]) if any(p[6:]) else p[4]].append(s)
    root = {s: s for s in spelled.values()}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for group in by.values():
        for a, b in itertools.combinations(sorted(group), 2):
            if addresses.same_place(a, b, variants):
                root[find(a)] = find(b)
    classes = defaultdict(list)
    for i, s in spelled.items():
        classes[find(s)].append(i)
    return {tuple(sorted(p)) for ids in classes.values() for p in itertools.combinations(ids, 2)}


@pytest.mark.parametrize("most", [addresses.SPLIT, 2])
def test_pairs_are_those_of_comparing_all(spark, data, most, monkeypatch):
    monkeypatch.setattr(addresses, "SUPPORT", 1)  # so that the smallest tables teach something
    rows = {r.id: r for r in spark.read.parquet(f"{data}/member_orders.parquet").select("id", *FIELDS).collect()}
    df = spark.createDataFrame(list(rows.values()))
    members = addresses.spellings(df, *(F.col(c) for c in ("id", *FIELDS)))
    placed = members.join(addresses.classes(members, most), "spelling").select("id", "place")
    got = [tuple(r) for r in addresses.same_pairs(placed).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_places(rows.values())


def test_confused_signs_are_learned_where_the_rest_is_the_same(spark):
    flat = lambda street, estate, n, room="201": f"珠明|宁信|昌义|{street}|{n}|{estate}|3|1|{room}"
    rows = [flat("星晨路", "安阳花园", n) for n in "123" for _ in range(2)] + [flat("星辰路", "安阳花园", "1"), flat("星辰路", "安阳花园", "2"), flat("星川路", "安阳花园", "3"), flat("星晨大路", "x花园", "5"), flat("星晨大道", "x花园", "5")]
    rows += [flat("兴晨路", "安阳花园", "1", ""), flat("兴晨路", "安阳花园", "2", "")]  # without a room another street may have the number
    members = spark.createDataFrame(list(enumerate(rows)), "id bigint, spelling string")
    assert addresses.confusions(members) == {("晨", "辰"), ("辰", "晨")}
    assert addresses.confusions(members.limit(0)) == frozenset()
    assert addresses.folded(addresses.both_ways([("a", "b"), ("b", "c"), ("x", "y")])) == {"b": "a", "c": "a", "y": "x"}


def test_every_accepted_pair_shares_a_band(spark):
    rng = random.Random(5)
    pairs = [("兴", "新"), ("晨", "辰"), ("辰", "宸"), ("福", "富"), ("阳", "杨"), ("隆", "龙")]
    variants = addresses.both_ways(pairs)
    signs = "".join(map("".join, pairs)) + "川海中山"

    def typed(name):
        x, k = list(name), rng.randrange(len(name) - 2)
        how = rng.randrange(4)
        if how == 0:
            x[k] = next((b for a, b in sorted(variants) if a == x[k]), x[k])
        elif how == 1:
            x.insert(k, x[k])
        elif how == 2:
            x[k], x[k + 1] = x[k + 1], x[k]
        elif name.endswith("大道"):
            x[-1] = "路"
        return "".join(x)

    accepted = []
    for _ in range(4000):
        street, estate = "".join(rng.choices(signs, k=rng.choice([2, 3]))) + rng.choice(["路", "大道"]), "".join(rng.choices(signs, k=2)) + "花园"
        other = [(typed(typed(street)), estate), (typed(street), None), (street, typed(typed(estate))), (None, typed(estate)), (typed(street), typed(estate))][rng.randrange(5)]
        flat = rng.choice(["3|1|201", "||"])
        a = f"|||{street}|7|{rng.choice([estate, ''])}|{flat}"
        b = f"|||{other[0] or ''}|{'7' if other[0] else ''}|{other[1] or ''}|{flat}"
        if addresses.same_place(a, b, variants):
            accepted.append((a, b))
    assert len(accepted) > 1000
    both = lambda c: addresses.bands(F.col(c), addresses.folded(variants))
    assert spark.createDataFrame(accepted, "a string, b string").filter(~F.arrays_overlap(both("a"), both("b"))).count() == 0


def test_places_with_one_area_the_end_of_the_other_and_an_estate_without_its_street(spark):
    rows = [(1, "大珠明省", "宁信市", "昌义县", "星晨路1号"), (2, "珠明省", "宁信市", "昌义县", "星晨路1号"), (3, "珠明省", "宁信市", "昌义县", "兴晨路8号安阳花园"), (4, "珠明省", "宁信市", "昌义县", "安阳花园")]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string, d string")
    assert sorted(map(tuple, addresses.same_pairs(addresses.places(df, *(F.col(c) for c in ("id", "a", "b", "c", "d")))).collect())) == [(1, 2), (3, 4)]


def test_addresses_of_every_kind(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", ""), (3, "自提", None, None, "门店自提"), (None, "珠明省", None, None, "星晨路1号"), (4, None, None, None, "路" * 5000), (5, "珠明省", "宁信市", "昌义县", "星晨路1号"), (5, "珠明省", "宁信市", "昌义县", "星晨路1号"), (6, "珠明省", "宁信市", "昌义县", "星晨路１號"), (7, None, None, None, "12" * 5000)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, c string, d string").withColumn("spelling", F.lit("x")).withColumn("place", F.lit(0))
    run = lambda x: addresses.same_pairs(addresses.places(x, *(F.col(c) for c in ("id", "a", "b", "c", "d"))))
    assert [tuple(r) for r in run(df).collect()] == [(5, 6)]
    assert run(df.limit(0)).count() == 0


# ---- top n ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_n_as_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, float("nan"), float("inf"), -0.0, 0.0, *range(9)]), rng.choice([None, *range(400)])) for _ in range(1000)]
    score = {(r[0], r[2]): r[1] for r in rows}
    rows = [(g, score[g, i], i) for g, _, i in rows]
    df = spark.createDataFrame([(g, None if s is None else float(s), i, "x") for g, s, i in rows], "group_id bigint, score double, id bigint, rank string").repartition(5)
    got = [(r.group_id, r.rank_no, r.row_id) for r in topn.top_n(df, F.col("group_id"), F.col("score"), F.col("id"), n).collect()]
    by = defaultdict(set)
    for g, s, i in rows:
        if g is not None and i is not None and s is not None and s == s:
            by[g].add((-s, i))
    assert sorted(got) == sorted((g, k + 1, i) for g, v in by.items() for k, (_, i) in enumerate(sorted(v)[:n]))
    assert topn.top_n(df.limit(0), F.col("group_id"), F.col("score"), F.col("id"), n).count() == 0


def test_top_n_bounds_take_rows_away_and_keep_the_order_of_large_numbers(spark):
    rows = spark.range(4000).select(F.lit(7).alias("g"), (F.lit(2**62) + F.col("id")).alias("score"), F.col("id")).repartition(8)
    kept = topn.local_best(rows.select(F.col("g").cast("bigint").alias("g"), "id", "score"), 3).cache()
    least = topn.bounds(kept, 3).collect()
    assert kept.count() == 24 and len(least) == 1 and topn.widest(topn.bounds(kept, 3), 1).count() == 1 and topn.widest(topn.bounds(kept, 3), 0) is None
    assert kept.filter(F.struct("score") >= F.struct(F.lit(least[0].bound.score))).count() < 24
    got = topn.top_n(rows, F.col("g"), F.col("score"), F.col("id"), 3).orderBy("rank_no").collect()
    assert [(r.row_id, r.score) for r in got] == [(3999 - k, 2**62 + 3999 - k) for k in range(3)]
    money = rows.select("g", (F.col("id").cast("decimal(30,2)") + F.lit("12345678901234567890").cast("decimal(30,2)")).alias("score"), "id")
    assert [r.row_id for r in topn.top_n(money, F.col("g"), F.col("score"), F.col("id"), 2).orderBy("rank_no").collect()] == [3999, 3998]


@pytest.mark.parametrize("limit", [0, topn.MOST_BROADCAST])
def test_top_n_over_small_batches_with_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(topn, "MOST_BROADCAST", limit)
    rng = random.Random(limit)
    rows = [(g, rng.randrange(4), rng.randrange(12)) for g in range(40) for _ in range(rng.choice([1, 3, 60]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = topn.top_n(spark.createDataFrame(rows, "g bigint, s bigint, id bigint").repartition(3), F.col("g"), F.col("s"), F.col("id"), 4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    best = defaultdict(dict)
    for g, s, i in rows:
        best[g][i] = max(s, best[g].get(i, -1))
    want = [(g, k + 1, i) for g, v in best.items() for k, (i, _) in enumerate(sorted(v.items(), key=lambda x: (-x[1], x[0]))[:4])]
    assert sorted((r.group_id, r.rank_no, r.row_id) for r in got) == sorted(want)


# ---- leaks ---------------------------------------------------------------------------------------

def brute_passage(item, doc, least=16, one_in=8):
    """Every start, plain dynamic programming: a passage begins and ends with a shared word."""
    for s in range(len(item) - least + 1):
        row = [0] * (len(doc) + 1)
        for i in range(s, len(item)):
            new = [10**6] * (len(doc) + 1)
            for j in range(1, len(doc) + 1):
                same = item[i] == doc[j - 1]
                new[j] = (0 if same else new[j - 1] + 1) if i == s else min(row[j - 1] + (not same), row[j] + 1, new[j - 1] + 1)
                if same and i > s and i - s + 1 >= least and row[j - 1] * one_in <= i - s + 1:
                    return True
            row = new
    return False


def edited(rng, ws, n):
    ws = list(ws)
    for _ in range(n if len(ws) > 8 else 0):
        k = rng.randrange(1, len(ws) - 1)
        how = rng.randrange(3)
        if how == 0:
            ws[k] = rng.randrange(100, 200)
        elif how == 1:
            del ws[k]
        else:
            ws.insert(k, rng.randrange(100, 200))
    return ws


@pytest.mark.parametrize("seed", range(60))
def test_passages_as_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.randrange(rng.choice([8, 60])) for _ in range(rng.randrange(16, 50))]
    a = rng.randrange(len(item))
    doc = [rng.randrange(100, 120) for _ in range(rng.randrange(10))] + edited(rng, item[a : a + rng.randrange(12, 40)] or [1, 2, 3], rng.randrange(5)) + [rng.randrange(60) for _ in range(rng.randrange(20))] if a < len(item) - 3 else item
    assert leaks.passages(np.array(item), np.array(doc)) == brute_passage(item, doc)


@pytest.mark.parametrize("seed", range(8))
def test_search_as_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(i, [rng.choice(vocabulary).encode() for _ in range(rng.randrange(10, 45))]) for i in range(12)]
    block = leaks._Block()
    docs = []
    for d in range(60):
        _, ws = rng.choice(items)
        a = rng.randrange(len(ws))
        piece = ws[a : a + rng.randrange(10, 40)]
        if len(piece) > 3:
            piece = [x if isinstance(x, bytes) else f"w{x % 40}".encode() for x in edited(rng, piece, rng.randrange(5))]
        ws = [rng.choice(vocabulary).encode() for _ in range(rng.randrange(30))] + piece + [rng.choice(vocabulary).encode() for _ in range(rng.randrange(30))]
        docs.append(ws)
        block.add(d, ws)
    ids, starts, terms, ends, raw = block.row()
    got = leaks.search_block(leaks.Pack(items), np.array(ids), np.array(starts), terms, ends, np.cumsum(np.frombuffer(raw, np.int32), dtype=np.int32), 16, 8)
    assert sorted(got) == sorted((d, i) for d, ws in enumerate(docs) for i, item in items if brute_passage(item, ws))


def brute_free_passage(item, doc, least=16, one_in=8):
    """Every start, plain dynamic programming: edits count anywhere, at the ends too."""
    for s in range(len(item) - least + 1):
        row = [0] * (len(doc) + 1)
        for i in range(s, len(item)):
            new = [row[0] + 1]
            for j in range(1, len(doc) + 1):
                new.append(min(row[j - 1] + (item[i] != doc[j - 1]), row[j] + 1, new[j - 1] + 1))
            if i - s + 1 >= least and min(new) * one_in <= i - s + 1:
                return True
            row = new
    return False


@pytest.mark.parametrize("seed", range(40))
def test_passages_edited_at_their_ends(seed):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(60)]
    items = [(i, [rng.choice(names).encode() for _ in range(rng.randrange(14, 40))]) for i in range(6)]
    block, docs = leaks._Block(), []
    for d in range(12):
        _, ws = rng.choice(items)
        a = rng.randrange(max(1, len(ws) - 14))
        piece = edited(rng, ws[a : a + rng.randrange(13, 30)], rng.randrange(4))
        piece = [x if isinstance(x, bytes) else f"x{x}".encode() for x in piece]
        docs.append([rng.choice(names).encode() for _ in range(rng.randrange(8))] + piece + [rng.choice(names).encode() for _ in range(rng.randrange(8))])
        block.add(d, docs[-1])
    ids, starts, terms, ends, raw = block.row()
    got = leaks.search_block(leaks.Pack(items), np.array(ids), np.array(starts), terms, ends, np.cumsum(np.frombuffer(raw, np.int32), dtype=np.int32), 16, 8, False)
    assert sorted(got) == sorted((d, i) for d, ws in enumerate(docs) for i, item in items if brute_free_passage(item, ws))


def test_a_passage_with_its_last_word_left_out_is_found():
    item = np.arange(40)
    doc = np.concatenate([[90], np.arange(9), [91], np.arange(10, 15)])  # 16 words, one replaced, the last left out
    assert leaks.passages(item, doc, shared_ends=False) and not leaks.passages(item, doc)
    assert not leaks.passages(item, np.arange(13), shared_ends=False)


def test_words_of_every_kind():
    assert words("Heat-\nexchanger, the ＦＵＬＬ Width　x (E-4)") == [w.encode() for w in ["heatexchanger", "the", "full", "width", "x", "e", "4"]]
    assert words("所述 阀\n组Abc") == [w.encode() for w in ["所", "述", "阀", "组", "abc"]]
    assert words("STRASSE Straße") == [b"strasse", b"strasse"] and words(None) == words("") == words(" ,; ") == []


def test_leaks_with_every_kind_of_row(spark):
    passage = " ".join(f"term{k}" for k in range(20))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, passage), (3, passage), (4, "x " * 100_000 + passage.upper().replace(" ", ", ")), (5, " ".join(passage.split()[:12])), (6, " ".join(reversed(passage.split()))), (None, passage)], "doc_id bigint, text string").withColumn("terms", F.lit(1))
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "too short")], "item_id bigint, text string")
    got = lambda d, i: sorted(map(tuple, leaks.search(leaks.build_index(d), i).collect()))
    assert got(docs, items) == [(3, 1), (4, 1)]
    assert got(docs.limit(0), items) == [] and got(docs, items.limit(0)) == []


# ---- tokens and pieces ---------------------------------------------------------------------------

def test_counts_are_the_encoders(spark, data):
    c = counter(queries.VOCABULARY)
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() + [[" a  b\n\n c  d "], ["don't 'tis"], ["　全角 空格"], [" "], ["\n"]]:
        if r[0]:
            assert c.count(r[0]) == len(c.encode(r[0]))


def check_pieces(text, limit, overlap):
    c, ids = counter(queries.VOCABULARY), counter(queries.VOCABULARY).encode(text)
    parts = pieces.split_text(text, queries.VOCABULARY, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(n <= limit for *_, n, _ in parts) and all(b[0] < a[1] or overlap == 0 for a, b in zip(parts, parts[1:]))
    assert sum(n for *_, n, _ in parts) - sum(o for *_, o in parts) == len(ids)
    for k, (a, b, n, o) in enumerate(parts):
        assert (o == 0) if k == 0 else overlap <= o <= overlap + 8
    at = 0
    for k, (a, b, n, o) in enumerate(parts):  # each piece is just its tokens, and repeats the last of the one before
        first = at - o
        assert c.encoding.decode(ids[first : first + n]) == text[a:b]
        at = first + n
    return parts


@pytest.mark.parametrize("text", [
    "A sentence here. Another, with a clause; and more.\n\nA paragraph. " * 60, "阀组与壳体焊接。所述弹簧，由不锈钢制成；" * 60, "x" * 3000, "漢" * 900, "🙂𠀀" * 400, " \n" * 900, "ab c " * 700, "龘" * 700 + "a b",
])
@pytest.mark.parametrize(("limit", "overlap"), [(200, 24), (97, 0), (64, 32)])
def test_pieces_cover_the_text(text, limit, overlap):
    assert len(check_pieces(text, limit, overlap)) > 1


def test_pieces_cut_at_natural_places():
    text = ("word " * 20 + "end.\n\n") * 30
    assert all(text[b - 2 : b] == "\n\n" for _, b, *_ in check_pieces(text, 200, 10)[:-1])


@pytest.mark.parametrize("seed", range(6))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    n, room, overlap = 60, 22, 4
    places = np.array(sorted(rng.sample(range(5, 58), 12)))
    fees = np.array([rng.choice([0.0, 0.2, 1.2]) for _ in places])
    begins = np.maximum(places - overlap, 0)
    least = -(-(n - overlap) // (room - overlap))
    aim = (n + (least - 1) * (places - begins).max()) / least
    best = np.inf
    for k in range(len(places) + 1):
        for cut in itertools.combinations(range(len(places)), k):
            marks = [(0, 0), *((places[c], begins[c]) for c in cut), (n, n)]
            sizes = [e[0] - s[1] for s, e in zip(marks, marks[1:])]
            if max(sizes) <= room:
                best = min(best, sum(fees[list(cut)]) + sum(pieces.IMBALANCE * ((s - aim) / room) ** 2 for s in sizes))
    got, cost = pieces.cuts(n, places, fees, room, begins, least)
    assert cost == pytest.approx(best) if np.isfinite(best) else got is None


def test_pieces_of_every_kind_of_row(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "long text. " * 4000), (None, "x")], "doc_id bigint, text string").withColumn("piece_no", F.lit("x"))
    got = Counter(r.doc_id for r in pieces.split_documents(df, queries.VOCABULARY).collect())
    assert got[3] == 1 and got[4] > 2 and set(got) == {3, 4}
    assert pieces.split_documents(df.limit(0), queries.VOCABULARY).count() == 0


# ---- mixing --------------------------------------------------------------------------------------

def test_permutation_is_one(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(5).cast("bigint"))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 64 or got != list(range(n))


def test_mix_keeps_shares_caps_and_tokens(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["A", " a ", "B"]), "word " * rng.randrange(1, 300)) for i in range(300)] + [(900, "a", None), (901, None, "x"), (902, "other", "y " * 50), (903, "c", "rare words " * 20)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("block", F.lit("x"))
    weights = spark.createDataFrame([("a", 0.5, 2), ("B", 0.3, 3), ("C", 0.1, 2), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, weights, queries.VOCABULARY, length=64, shards=4, tokens=True)
    report = {r.source: r for r in m.report().collect()}
    assert {s for s, r in report.items() if r.short} == {"c", "none"}
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert report["a"].n_rounds <= 2 and report["b"].n_rounds <= 3 and report["c"].n_rounds == 2
    assert abs(report["a"].actual_share / report["b"].actual_share - 5 / 3) < 0.5
    parts = defaultdict(int)
    for r in m.parts.collect():
        parts[r.doc_id] += r.n_tokens
    want = {i: counter(queries.VOCABULARY).count(t) for i, s, t in docs if t and s in ("A", "a", " a ", "B", "c")}
    assert parts == want
    use = Counter((r.source, r.slot) for r in m.slots.collect())
    assert max(use.values()) == 1
    cut = mixing.materialise(m).collect()
    assert len(cut) == len(use) and max(len(r.tokens) for r in cut) == 64
    assert sum(len(r.tokens) for r in cut) == sum(r.n_tokens for r in report.values())


@pytest.mark.parametrize("seed", range(30))
def test_draws_keep_caps_and_sizes(seed):
    rng = random.Random(seed)
    length = 10
    sources = [mixing.Source(f"s{k}", rng.choice([0.0, rng.random(), rng.random() * 5]), rng.choice([0, 1, 3]), rng.choice([0, 5, rng.randrange(4000)])) for k in range(rng.randrange(1, 7))]
    total = sum(s.share for s in sources) or 1.0
    sources = [mixing.Source(s.name, s.share / total, s.cap, s.tokens) for s in sources]
    size, shards = rng.choice([1, 37, 5000, 100_000]), rng.choice([1, 3, 16])
    slots = -(-size // length)
    drawn = mixing.draw(sources, slots, shards, size, seed, length)
    most = [s.cap * s.blocks(length) if s.share > 0 else 0 for s in sources]
    got = drawn.sum(axis=0)
    assert (drawn >= 0).all() and all(g <= m for g, m in zip(got, most))
    assert drawn.sum() == min(slots, sum(most)) or all(g == m for g, m, s in zip(got, most, sources) if s.tokens * s.cap >= s.share * size)
    assert np.ptp(drawn.sum(axis=1)) <= 1
    for s, g, m in zip(sources, got, most):  # short by its tokens if and only if all of it is used and too little
        if s.share > 0:
            assert (s.tokens * s.cap < s.share * size) == (g >= m and s.tokens * s.cap < s.share * size)


def test_slots_of_a_long_run_are_unrolled_by_pages(spark):
    s = mixing.Source("a", 1.0, 1, 200_000 * 8)
    slots = mixing.slots_of(spark, [s], np.array([[150_000], [50_000]]), length=8)
    r = slots.groupBy().agg(F.count("*").alias("n"), F.countDistinct("slot").alias("s"), F.countDistinct("block").alias("b"), F.max("block").alias("m")).first()
    assert (r.n, r.s, r.b, r.m) == (200_000, 200_000, 200_000, 199_999)
    assert slots.filter("slot = 149999").first().shard == 0 and slots.filter("slot = 150000").first().shard == 1


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, text string")
    weights = spark.createDataFrame([("a", 0.5, 2), ("b", None, None)], "source string, target_share double, max_repeats int")
    assert mixing.mix(docs, weights, queries.VOCABULARY).report().filter("n_tokens > 0").count() == 0
    assert mixing.mix(docs, weights.limit(0), queries.VOCABULARY).report().count() == 0


def test_queries_on_empty_tables(spark, data, tmp_path):
    for t in ("member_orders", "order_historys", "documents", "eval_items", "source_weights"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in queries.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_as_duckdb(spark, data, name):
    import duckdb

    c = duckdb.connect()
    for t in ("member_orders", "order_historys", "documents", "source_weights"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = c.execute(queries.SQL[name])
    columns = sorted(d[0] for d in want.description)
    df = queries.QUERIES[name](spark, data)
    assert sorted(df.columns) == columns
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(tuple(r) for r in c.execute(f"select {', '.join(columns)} from ({queries.SQL[name]})").fetchall())


def test_the_mix_is_a_query_over_whole_tables(spark, data):
    mixed = queries.QUERIES["p9_mixed"](spark, data).selectExpr("shard", "source", "slot", "size(tokens) AS n").collect()
    m = mixing.mix(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/source_weights.parquet"), queries.VOCABULARY)
    got = Counter()
    for r in mixed:
        got[r.source] += r.n
    assert len({(r.source, r.slot) for r in mixed}) == len(mixed)
    assert dict(got) == {r.source: r.n_tokens for r in m.report().collect() if r.n_tokens}
