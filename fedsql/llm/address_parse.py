"""Reading one typed postal address into ordered tokens.

A row names a place in four free-text fields.  :func:`parse` brings the text
to one form (width, traditional signs, number words), tells
the area from the street, the street from the estate, and the estate from
building, unit and room, whatever their order, and returns them as an
:class:`Address`.  ``None`` stands for a part the text does not give.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# ---- fixed values -------------------------------------------------------
# Abbreviation and variant dictionaries of Chinese postal usage.
PROVINCE_ENDS = ("省", "自治区")
CITY_ENDS = ("市", "自治州", "盟")
DISTRICT_ENDS = ("区", "县", "旗")
STREET_ENDS = ("大道", "大路", "大街", "胡同", "路", "街", "巷", "弄")
ESTATE_ENDS = ("小区", "花园", "新村", "公寓", "家园", "广场", "大厦", "苑")
SIGN_VARIANTS = {"號": "号", "樓": "楼", "單": "单", "區": "区", "縣": "县", "門": "门", "棟": "栋", "層": "层", "東": "东", "園": "园", "道": "道"}
PICK_UP = ("自提", "自取")
NO_AREA = ("其他", "其它", "无", "不详", "未知")
DIGIT_WORDS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
# -------------------------------------------------------------------------

_SIGNS = str.maketrans(SIGN_VARIANTS)
_DROP = re.compile("[​-‍⁠﻿­]")
_BRACKETS = re.compile(r"【[^】]*】|\[[^\]]*\]")
_NUMBER_WORD = re.compile(r"[零〇一二两三四五六七八九十百]+(?=\s*(?:号|#|栋|幢|座|单元|门|室|房|楼|层|铺|院|-))")
_PART = r"[^\d,()\s#\-]"
_AREA_P = re.compile(r"^(%s{2,8}?)(?:省|自治区)" % _PART)
_AREA_C = re.compile(r"^(%s{2,8}?)(?:市|自治州|盟)" % _PART)
_AREA_D = re.compile(r"^(%s{2,6}?)(?<!小)(?:区|县|旗)(?!域)" % _PART)
_BARE_PAIR = re.compile(r"^([^\d,()\s#\-省市区县旗]{2})([^\d,()\s#\-省市区县旗]{2})[\s\-]+(?=[^\d,()\s#\-]{2}[区县旗])")
_BARE_AREA = re.compile(r"^([^\d,()\s#\-省市区县旗]{2})[\s\-]+(?=[^\d,()\s#\-]{2})")
_STREET = re.compile(r"(%s+?(?:%s))\s*(\d+)\s*(?:号院|号(?!楼|房)|#|院)?\s*院?(?!\d)" % (_PART, "|".join(STREET_ENDS)))
_ESTATE = re.compile(r"(%s+?(?:%s))" % (_PART, "|".join(ESTATE_ENDS)))
_SHOP = re.compile(r"(\d+)\s*号?铺")
_FLOOR_ROOM = re.compile(r"(\d+)\s*(?:楼|层)\s*(\d+)\s*号?\s*(?:房|室)?")
_BUILDING = re.compile(r"(\d+)\s*(?:号楼|栋|幢|座|号(?=\s*\d)|#楼?)")
_UNIT = re.compile(r"(\d+)\s*(?:单元|门)")
_DASHED = re.compile(r"(\d+)-(\d+)-(\d+)")
_DASHED2 = re.compile(r"(\d+)-(\d+)")
_ROOM = re.compile(r"(\d+)\s*(?:室|房|号房)?")


class Address(NamedTuple):
    province: str | None
    city: str | None
    district: str | None
    street: str | None
    number: str | None
    estate: str | None
    building: str | None
    unit: str | None
    room: str | None


def number_word(word: str) -> str:
    """``四八八`` and ``四百八十八`` both give ``488``."""
    if not any(c in "十百" for c in word):
        return "".join(str(DIGIT_WORDS[c]) for c in word)
    total, digit = 0, None
    for c in word:
        if c in "十百":
            total += (1 if digit is None else digit) * (10 if c == "十" else 100)
            digit = None
        else:
            digit = DIGIT_WORDS[c] if digit is None else digit * 10 + DIGIT_WORDS[c]
    return str(total + (digit or 0))


def clean(text: str | None) -> str:
    if not text:
        return ""
    text = _DROP.sub("", unicodedata.normalize("NFKC", text)).translate(_SIGNS)
    text = _BRACKETS.sub(" ", text).replace("。", ",").replace("、", ",").replace(";", ",")
    return text.strip(" ,")


def _stem(name: str, ends: tuple[str, ...]) -> str:
    for e in ends:
        if name.endswith(e) and len(name) > len(e) + 1:
            return name[: -len(e)]
    return name


def _take_bare(text: str, area: dict[str, str | None]) -> str:
    """Moves names without an ending that a separator sets off before more names."""
    if not (area["p"] or area["c"]) and (m := _BARE_PAIR.match(text)):
        area["p"], area["c"] = m[1], m[2]
        return text[m.end():]
    while (m := _BARE_AREA.match(text)) and (level := next((x for x in "pc" if not area[x]), None)):
        area[level] = m[1]
        text = text[m.end():]
    return text


def _take_area(text: str, area: dict[str, str | None]) -> str:
    """Moves a leading province, city and district of text into area."""
    text = text.lstrip(" ,-")
    text = _take_bare(text, area)
    for level, pattern in (("p", _AREA_P), ("c", _AREA_C), ("d", _AREA_D)):
        known = area[level]
        ends = {"p": PROVINCE_ENDS, "c": CITY_ENDS, "d": DISTRICT_ENDS}[level]
        if known and text.startswith(known):
            rest = text[len(known):]
            end = next((e for e in ends if rest.startswith(e)), None)
            if end:
                text = rest[len(end):].lstrip(" ,-")
                continue
            # a street may begin like its city: without an ending, a name is an area only before a separator or another area
            after = rest.lstrip(" ,-")
            if level != "d" and (after != rest or _AREA_C.match(after) or _AREA_D.match(after)):
                text = after
                continue
        m = pattern.match(text)
        if not m:
            continue
        stem = m[1]
        if level == "c" and area["p"] and stem.startswith(area["p"]) and len(stem) > len(area["p"]) + 1:
            stem = stem[len(area["p"]):]
        elif level == "c" and not area["p"] and len(stem) == 4:
            area["p"], stem = stem[:2], stem[2:]
        if level == "d" and len(stem) >= 4 and area["c"] and stem.startswith(area["c"]):
            stem = stem[len(area["c"]):]
        elif level == "d" and len(stem) == 4 and not area["c"]:
            area["c"], stem = stem[:2], stem[2:]
        elif level == "d" and len(stem) == 6 and not area["c"] and not area["p"]:
            area["p"], area["c"], stem = stem[:2], stem[2:4], stem[4:]
        area[level] = area[level] or stem
        text = _take_bare(text[m.end():].lstrip(" ,-"), area) if level != "d" else text[m.end():].lstrip(" ,-")
    return text


def _area_field(text: str, level: str, area: dict[str, str | None]) -> None:
    """Files the parts of one area field under their levels, by their endings where they have them."""
    if not text or text in NO_AREA:
        return
    rest = _take_area(text, area)
    if not rest:
        return
    if level == "c" and len(rest) == 4 and not area["p"]:
        area["p"], rest = rest[:2], rest[2:]
    elif level == "c" and area["p"] and len(rest) > len(area["p"]) + 1 and rest.startswith(area["p"]):
        rest = rest[len(area["p"]):]
    for at in (level, "d" if level == "c" else "c"):  # a city may stand in the district's field and the reverse
        if not area[at]:
            area[at] = rest
            return


@lru_cache(maxsize=200_000)
def _areas(province: str | None, city: str | None, region: str | None) -> tuple[str | None, str | None, str | None] | None:
    """Province, city and district of the three area fields, which repeat from row to row; ``None`` if fetched at the shop."""
    fields = [clean(x) for x in (province, city, region)]
    if any(p in x for x in fields for p in PICK_UP):
        return None
    area: dict[str, str | None] = {"p": None, "c": None, "d": None}
    # fields whose ending names another level go first, so that a swapped pair lands right
    order = sorted(zip(fields, "pcd"), key=lambda x: not x[0].endswith((*PROVINCE_ENDS, *CITY_ENDS, *DISTRICT_ENDS)))
    for text, level in order:
        _area_field(text, level, area)
    return area["p"], area["c"], area["d"]


def parse(province: str | None, city: str | None, region: str | None, detail: str | None) -> Address | None:
    """The address's tokens, or ``None`` where no place is named (empty, or fetched at the shop)."""
    areas = _areas(province, city, region)
    rest = clean(detail)
    if areas is None or any(p in rest for p in PICK_UP):
        return None
    area: dict[str, str | None] = dict(zip("pcd", areas))
    rest = _take_area(rest, area)
    rest = _NUMBER_WORD.sub(lambda m: number_word(m[0]), rest)
    street = number = estate = building = unit = room = None
    if m := _STREET.search(rest):
        street, number = m[1].strip(), m[2].lstrip("0") or "0"
        tail = rest[m.end():]
        rest = rest[: m.start()] + "," + tail.lstrip("-")
    rest = rest.replace("(", ",").replace(")", ",")
    if m := _ESTATE.search(rest):
        estate = m[1].strip()
        rest = rest[: m.start()] + "," + rest[m.end():]
    rest = re.sub(r"\s+", "", rest)
    if m := _DASHED.search(rest):
        building, unit, room = m.groups()
    elif m := _SHOP.search(rest):
        room = m[1]
    else:
        if m := _UNIT.search(rest):
            unit = m[1]
            if b := _BUILDING.search(rest[: m.start()]):
                building = b[1]
            rest = rest[m.end():]
        elif m := _BUILDING.search(rest):
            building = m[1]
            rest = rest[m.end():]
        elif m := _DASHED2.search(rest):
            building, room = m.groups()
            rest = ""
        if room is None:
            if m := _FLOOR_ROOM.search(rest):
                room = m[1] + m[2].zfill(2)
            elif m := _ROOM.search(rest):
                room = m[1]
    if not (street or estate):
        return None
    strip = lambda x: x and (x.lstrip("0") or "0")
    return Address(*(area[k] and _stem(area[k], e) for k, e in (("p", PROVINCE_ENDS), ("c", CITY_ENDS), ("d", DISTRICT_ENDS))),
                   street, number, estate, strip(building), strip(unit), strip(room))
