"""The few functions Spark has no expression for, as Arrow-batched Python functions."""

from __future__ import annotations

import ipaddress
import json
import re
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_STEP = re.compile(r"""\.?"([^"]*)"|\.([^.\[\]]+)|\[\s*"([^"]*)"\s*\]|\[\s*(\d+|\*)\s*\]""")


def steps(path: str) -> list[str | int] | None:
    """``$.a[0]."b"`` as its steps."""
    if not path or path[0] != "$":
        return None
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            return None
        word = next(g for g in m.groups() if g is not None)
        out.append(int(word) if m[4] and word != "*" else word)
        at = m.end()
    return out


def _load(text: str | None) -> Any:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _dump(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False)


def _walk(doc: Any, path: list) -> Any:
    for s in path:
        if isinstance(doc, dict) and str(s) in doc:
            doc = doc[str(s)]
        elif isinstance(doc, list) and isinstance(s, int) and s < len(doc):
            doc = doc[s]
        else:
            return None
    return doc


def json_set(text: str | None, paths: list[str], values: list[str]) -> str | None:
    doc = _load(text)
    if doc is None:
        return None
    for p, v in zip(paths, values):
        way, v = steps(p), _load(v)
        if way is None:
            return None
        if not way:
            doc = v
            continue
        at, last = _walk(doc, way[:-1]), way[-1]
        if isinstance(at, dict):
            at[str(last)] = v
        elif isinstance(at, list) and isinstance(last, int):
            if last < len(at):
                at[last] = v
            else:
                at.append(v)
    return _dump(doc)


def json_append(text: str | None, paths: list[str], values: list[str]) -> str | None:
    doc = _load(text)
    if doc is None:
        return None
    for p, v in zip(paths, values):
        way = steps(p)
        at = _walk(doc, way) if way is not None else None
        if isinstance(at, list):
            at.append(_load(v))
    return _dump(doc)


def json_remove(text: str | None, paths: list[str]) -> str | None:
    doc = _load(text)
    if doc is None:
        return None
    for p in paths:
        way = steps(p)
        if not way:
            continue
        at = _walk(doc, way[:-1])
        if isinstance(at, dict):
            at.pop(str(way[-1]), None)
        elif isinstance(at, list) and isinstance(way[-1], int) and way[-1] < len(at):
            del at[way[-1]]
    return _dump(doc)


def json_depth(text: str | None) -> int | None:
    def depth(x: Any) -> int:
        inside = x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
        return 1 + max(map(depth, inside), default=0)

    if text is None:
        return None
    doc = _load(text)
    return depth(doc)


def json_encode(value: Any) -> str | None:
    return None if value is None else _dump(value if not hasattr(value, "asDict") else value.asDict(True))


def _compiled(pattern: str, flags: str) -> re.Pattern | None:
    mode = 0 if "c" in flags else re.I
    for f, m in (("m", re.M), ("n", re.S), ("u", 0)):
        mode |= m if f in flags else 0
    try:
        return re.compile(pattern, mode)
    except re.error:
        return None


def _matches(s: str | None, r: str | None, pos: int, flags: str) -> list[re.Match] | None:
    if s is None or r is None or (p := _compiled(r, flags or "")) is None:
        return None
    return list(p.finditer(s, max(pos - 1, 0)))


def regexp_instr(s: str | None, r: str | None, pos: int, occurrence: int, after: int, flags: str) -> int | None:
    m = _matches(s, r, pos, flags)
    if m is None:
        return None
    return 0 if not 0 < occurrence <= len(m) else (m[occurrence - 1].end() if after else m[occurrence - 1].start()) + 1


def regexp_replace(s: str | None, r: str | None, by: str | None, pos: int, occurrence: int, flags: str) -> str | None:
    m = _matches(s, r, pos, flags)
    if m is None or by is None:
        return None
    if occurrence == 0:
        try:
            return _compiled(r, flags or "").sub(by, s[max(pos - 1, 0) :])
        except (re.error, IndexError):  # a group that the pattern hasn't
            return None
    if occurrence > len(m):
        return s
    x = m[occurrence - 1]
    try:
        return s[: x.start()] + x.expand(by) + s[x.end() :]
    except (re.error, IndexError):
        return None


def regexp_substr(s: str | None, r: str | None, pos: int, occurrence: int, flags: str) -> str | None:
    m = _matches(s, r, pos, flags)
    return m[occurrence - 1][0] if m and 0 < occurrence <= len(m) else None


def inet6_aton(s: str | None) -> str | None:
    try:
        return ipaddress.IPv6Address(s).packed.hex() if s is not None else None
    except ValueError:
        return None


def inet6_ntoa(s: str | None) -> str | None:
    try:
        return str(ipaddress.IPv6Address(bytes.fromhex(s))) if s is not None else None
    except ValueError:
        return None


def is_ipv6(s: str | None) -> int | None:
    return None if s is None else int(inet6_aton(s) is not None)


ALL = {
    "json_set": (json_set, "string"), "json_append": (json_append, "string"), "json_remove": (json_remove, "string"), "json_depth": (json_depth, "int"), "json_encode": (json_encode, "string"),
    "regexp_instr": (regexp_instr, "int"), "regexp_replace": (regexp_replace, "string"), "regexp_substr": (regexp_substr, "string"),
    "inet6_aton": (inet6_aton, "string"), "inet6_ntoa": (inet6_ntoa, "string"), "is_ipv6": (is_ipv6, "int"),
}


def register(spark: SparkSession) -> None:
    for name, (f, kind) in ALL.items():
        spark.udf.register(f"fedsql_{name}", F.udf(f, kind, useArrow=True))
