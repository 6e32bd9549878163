"""Scalar functions of the dialect as Spark SQL text.

A template takes the arguments' SQL.  Functions never raise: what can't be
computed is null, so ``try_`` forms are used throughout.  Names that are not
here are looked up among the session's own functions and then Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# ---- fixed values -------------------------------------------------------
SECONDS = {"MICROSECOND": 1, "SECOND": 1, "MINUTE": 60, "HOUR": 3600, "DAY": 86400, "WEEK": 604800, "MONTH": 2592000, "QUARTER": 7776000, "YEAR": 31536000}
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "j": "DDD", "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm"}
WINDOW_UNITS = {"S": 1, "M": 60, "H": 3600, "d": 86400, "D": 86400}
TYPES = {
    "int": "bigint", "bigint": "bigint", "integer": "bigint", "signed": "bigint", "unsigned": "bigint", "mediumint": "bigint", "smallint": "bigint", "tinyint": "bigint",
    "float": "double", "double": "double", "real": "double", "decimal": "decimal(38,18)", "numeric": "decimal(38,18)", "number": "double",
    "str": "string", "string": "string", "char": "string", "varchar": "string", "nchar": "string", "text": "string", "mediumtext": "string", "tinytext": "string",
    "bytes": "binary", "binary": "binary", "varbinary": "binary", "blob": "binary", "bool": "boolean", "boolean": "boolean",
    "datetime": "timestamp", "timestamp": "timestamp", "date": "date", "uuid": "string", "objectid": "string",
}
# -------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_text(sql: str) -> str | None:
    """The value of a string literal's SQL."""
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", sql, re.S)
    return re.sub(r"\\(.)", r"\1", m[1], flags=re.S) if m else None


def number(x: str) -> str:
    """The number that a text begins with, 0 without one, null for null."""
    return f"(CASE WHEN {x} IS NOT NULL THEN coalesce(try_cast(regexp_extract(cast({x} AS string), '^\\\\s*([+-]?(\\\\d+\\\\.?\\\\d*|\\\\.\\\\d+)([eE][+-]?\\\\d+)?)', 1) AS double), 0D) END)"


def time(x: str) -> str:
    """As a timestamp, null where it is none."""
    return f"try_cast({x} AS timestamp)"


def java_pattern(sql: str) -> str:
    """A strftime format as a date_format pattern."""
    text = literal_text(sql)
    if text is None:
        return sql
    out, plain = "", ""
    for part in re.findall(r"%.|[^%]+|%$", text, re.S):
        if part[0] == "%" and part[1:] in STRFTIME:
            if plain:
                out += "'" + plain.replace("'", "''") + "'"
                plain = ""
            out += STRFTIME[part[1:]]
        else:
            plain += part[1:] if part == "%%" else part
    if plain:
        out += "'" + plain.replace("'", "''") + "'"
    return quoted(out)


def cast(x: str, kind: str) -> str:
    """CAST of the dialect; what can't be converted is null.  ``kind`` may hold a format after a space."""
    name, _, form = kind.strip().partition(" ")
    base, _, args = name.lower().partition("(")
    if base in ("str", "string", "char", "varchar", "text") and form:
        to = "double" if re.search("%[^%]*[feg]", form) else "bigint" if re.search("%[^%]*d", form) else "string"
        return f"format_string({quoted(form)}, try_cast({x} AS {to}))" if "%" in form and not re.search("%[YmHMS]|%d[-/%]", form) else f"date_format({time(x)}, {java_pattern(quoted(form))})"
    if base == "time":
        return f"date_format({time(x)}, 'HH:mm:ss')"
    if base in ("array", "set"):
        return f"array({x})"
    if base == "datetime" and form:
        return f"try_to_timestamp(cast({x} AS string), {java_pattern(quoted(form))})"
    if base in ("decimal", "numeric") and args:
        return f"try_cast({x} AS decimal({args})"
    if base in ("int", "bigint", "signed", "unsigned", "integer"):
        return f"coalesce(try_cast({x} AS bigint), cast(try_cast({x} AS double) AS bigint))" if not re.fullmatch(r"\d+", x) else x
    return f"try_cast({x} AS {TYPES.get(base, base)})"


def shifted(args: list[str], sign: str) -> str:
    """A time moved by days (a number) or by ``n|UNIT`` of an INTERVAL."""
    amount = args[1]
    if m := re.fullmatch(r"interval\|(.*)\|(\w+)", amount, re.S):
        return f"timestampadd({m[2].upper()}, cast({sign}({m[1]}) AS int), {time(args[0])})"
    text = literal_text(amount)
    if text is not None and ":" in text:
        m = re.fullmatch(r"(?:(?:(?:(\d+)-)?(\d+)-)?(\d+) )?(\d+):(\d+)(?::(\d+))?", text)
        if not m:
            return "cast(null AS timestamp)"
        y, mo, d, h, mi, s = (int(x or 0) for x in m.groups())
        return f"({time(args[0])} {sign or '+'} make_interval({y}, {mo}, 0, {d}, {h}, {mi}, {s}))"
    return f"timestampadd(DAY, cast({sign}({amount}) AS int), {time(args[0])})"


def week(x: str, monday: bool) -> str:
    return f"cast(floor((dayofyear({x}) + 6 - {f'weekday({x})' if monday else f'(dayofweek({x}) - 1)'}) / 7) AS int)"


def not_null(args: list[str], expr: str) -> str:
    return f"(CASE WHEN {' AND '.join(f'{a} IS NOT NULL' for a in args)} THEN {expr} END)"


def regexp(args: list[str]) -> str:
    flags = (literal_text(args[2]) or "") if len(args) > 2 else ""
    mode = ("" if "c" in flags else "i") + ("m" if "m" in flags else "") + ("s" if "n" in flags else "")
    return f"cast(cast({args[0]} AS string) rlike concat({quoted(f'^(?{mode})(?:' if mode else '^(?:')}, {args[1]}, ')') AS int)"


def _plain_pattern(args: list[str]) -> str | None:
    """Java's form of a literal pattern that means the same there; None if there may be a difference."""
    text = literal_text(args[1])
    if text is None or re.search(r"\(\?[P(<]|\\[ZNuUxgk]|\[\^?\]|&&|\[[^\]]*\[", text):
        return None
    try:
        re.compile(text)
    except re.error:
        return None
    return quoted("(?i)" + text)


def regexp_call(name: str, args: list[str]) -> str:
    """Spark's own function where the pattern is a literal and all else as it is by default, a Python one else."""
    plain = {"instr": 2, "replace": 3, "substr": 2}[name]
    if len(args) == plain and (pattern := _plain_pattern(args)) is not None:
        if name != "replace":
            return f"regexp_{name}(cast({args[0]} AS string), {pattern})"
        by = literal_text(args[2])
        if by is not None and not re.search(r"\\(?!\d(?!\d))", by) and all(int(k) <= re.compile(literal_text(args[1])).groups for k in re.findall(r"\\(\d)", by)) and "\\0" not in by:
            return f"regexp_replace(cast({args[0]} AS string), {pattern}, {quoted(re.sub(r'\\(\d)', r'$\1', by.replace('$', chr(92) + '$')))})"
    more = {"instr": ["1", "1", "0"], "replace": ["1", "0"], "substr": ["1", "1"]}[name]
    rest = args[plain : plain + len(more)]
    flags = args[plain + len(more)] if len(args) > plain + len(more) else quoted("")
    return f"fedsql_regexp_{name}({', '.join([*args[:plain], *rest, *more[len(rest):], flags])})"


def hexs(args: list[str]) -> str:
    n = args[0] if args else "8"
    pieces = -(-int(n) // 64) if n.isdigit() else 0
    if pieces:
        return f"substr(concat({', '.join(['sha2(uuid(), 256)'] * pieces)}), 1, {n})"
    return f"transform(array(uuid()), u -> substr(aggregate(sequence(1, greatest(1, cast(ceil(({n}) / 64) AS int))), '', (t, i) -> concat(t, sha2(concat(u, i), 256))), 1, {n}))[0]"


def time_window(args: list[str]) -> str:
    m = re.fullmatch(r"(\d+)\s*([SMHdD])", literal_text(args[0]) or "")
    if not m or not int(m[1]):
        return "cast(null AS timestamp)"
    size = int(m[1]) * WINDOW_UNITS[m[2]]
    at = time(args[1]) if len(args) > 1 else "current_timestamp()"
    return f"timestamp_seconds(floor(unix_timestamp({at}) / {size}) * {size} + {args[2] if len(args) > 2 else 0} * {size})"


def now(args: list[str]) -> str:
    at = "current_timestamp()"
    rest = list(args)
    if rest and (m := re.fullmatch(r"([+-]?\d+)([yMmwdHhSs])", literal_text(rest[0]) or "")):
        unit = {"y": "YEAR", "M": "MINUTE", "m": "MONTH", "w": "WEEK", "d": "DAY", "H": "HOUR", "h": "HOUR", "S": "SECOND", "s": "SECOND"}[m[2]]
        at = f"timestampadd({unit}, {m[1]}, {at})"
        rest = rest[1:]
    if rest:
        h, mi, s = ([*rest, "0", "0", "0"])[:3]
        at = f"(date_trunc('DAY', {at}) + make_dt_interval(0, {h}, {mi}, {s}))"
    return at


def json_contains_path(args: list[str]) -> str:
    word = " OR " if (literal_text(args[1]) or "").lower() == "one" else " AND "
    return f"cast({word.join(f'get_json_object({args[0]}, {p}) IS NOT NULL' for p in args[2:])} AS int)"


F = Callable[[list[str]], str]
#: Templates with {0}, {1} ... take just so many arguments; others take any.
FUNCTIONS: dict[str, str | F] = {
    # numbers
    "add": "({0} + {1})", "sub": "({0} - {1})", "mul": "({0} * {1})", "div": "try_divide({0}, {1})", "mod": "(CASE WHEN {1} <> 0 THEN {0} - {1} * floor(try_divide({0}, {1})) END)",
    "bitwiseand": "(cast({0} AS bigint) & cast({1} AS bigint))", "bitwiseor": "(cast({0} AS bigint) | cast({1} AS bigint))", "bitwisexor": "(cast({0} AS bigint) ^ cast({1} AS bigint))",
    "bitwisenot": "(~cast({0} AS bigint))", "bitwiserightshift": "shiftright(cast({0} AS bigint), cast({1} AS int))", "bitwiseleftshift": "shiftleft(cast({0} AS bigint), cast({1} AS int))",
    "bit_and": "(cast({0} AS bigint) & cast({1} AS bigint))", "bit_or": "(cast({0} AS bigint) | cast({1} AS bigint))", "bit_xor": "(cast({0} AS bigint) ^ cast({1} AS bigint))",
    "abs": "abs({0})", "sqrt": "(CASE WHEN {0} >= 0 THEN sqrt({0}) END)", "exp": "exp({0})", "pi": lambda a: "pi()", "ln": "ln({0})",
    "log": lambda a: f"(CASE WHEN {a[0]} > 0 THEN {f'ln({a[0]}) / ln({a[1]})' if len(a) > 1 else f'log10({a[0]})'} END)",
    "ceil": "cast(ceil({0}) AS bigint)", "ceiling": "cast(ceil({0}) AS bigint)", "floor": "cast(floor({0}) AS bigint)", "rand": lambda a: "rand()",
    "round": lambda a: f"bround({a[0]}, {a[1] if len(a) > 1 else 2})", "sign": "cast(sign({0}) AS int)", "pow": "power({0}, {1})", "power": "power({0}, {1})",
    "sin": "sin({0})", "cos": "cos({0})", "tan": "tan({0})", "atan": "atan({0})", "asin": "nullif(asin({0}), double('NaN'))", "acos": "nullif(acos({0}), double('NaN'))",
    "greatest": lambda a: not_null(a, f"greatest({', '.join(a)})"), "least": lambda a: not_null(a, f"least({', '.join(a)})"),
    # texts
    "bin": "concat('0b', bin(cast({0} AS bigint)))", "oct": "conv({0}, 10, 8)", "unhex": "try_cast(unhex({0}) AS string)",
    "ord": "(CASE WHEN char_length({0}) = 1 THEN ascii({0}) END)",
    "ascii": "aggregate(transform(filter(split({0}, ''), c -> c <> ''), c -> ascii(c)), 0, (a, b) -> a + b)",
    "char": lambda a: "concat(" + ", ".join(f"decode(unhex(lpad(hex(cast({x} AS bigint)), 8, '0')), 'UTF-32')" for x in a) + ")",
    "bit_length": "bit_length({0})", "length": "octet_length({0})", "char_length": "char_length({0})", "character_length": "char_length({0})",
    "concat": lambda a: f"concat({', '.join(f'cast({x} AS string)' for x in a)})",
    "concat_ws": lambda a: not_null(a, f"concat_ws({', '.join(f'cast({x} AS string)' for x in a)})"),
    "insert": "overlay({0} PLACING {3} FROM {1} FOR {2})", "lower": "lower({0})", "lcase": "lower({0})", "upper": "upper({0})", "ucase": "upper({0})",
    "left": "substring({0}, 1, {1})", "right": "(CASE WHEN {1} = 0 THEN {0} ELSE right({0}, {1}) END)", "trim": "regexp_replace({0}, '^\\\\s+|\\\\s+$', '')",
    "elt": lambda a: f"get(array({', '.join(a[1:])}), cast({a[0]} AS int) - 1)", "field": lambda a: f"cast(coalesce(array_position(array({', '.join(a[1:])}), {a[0]}), 0) AS int)",
    "find_in_set": "find_in_set({0}, {1})", "replace": "replace({0}, {1}, {2})", "substring": lambda a: f"substring({', '.join(a)})", "substr": lambda a: f"substring({', '.join(a)})", "mid": lambda a: f"substring({', '.join(a)})",
    "substring_index": "substring_index({0}, {1}, {2})", "repeat": "repeat({0}, {1})", "reverse": "reverse({0})", "strcmp": "(CASE WHEN {0} = {1} THEN 0 WHEN {0} < {1} THEN -1 WHEN {0} > {1} THEN 1 END)",
    "startswith": "cast(startswith({0}, {1}) AS int)", "endswith": "cast(endswith({0}, {1}) AS int)", "crc32": "crc32({0})", "from_base64": "try_cast(try_to_binary({0}, 'base64') AS string)", "to_base64": "base64({0})",
    "inet4_aton": "(CASE WHEN {0} rlike '^((25[0-5]|2[0-4]\\\\d|1?\\\\d?\\\\d)(\\\\.|$)){{4}}$' AND size(split({0}, '\\\\.')) = 4 THEN lower(array_join(transform(split({0}, '\\\\.'), x -> lpad(hex(cast(x AS int)), 2, '0')), '')) END)",
    "inet4_ntoa": "(CASE WHEN {0} rlike '^[0-9a-fA-F]{{8}}$' THEN array_join(transform(sequence(0, 3), i -> conv(substr({0}, 2 * i + 1, 2), 16, 10)), '.') END)",
    "is_ipv4": "cast({0} rlike '^((25[0-5]|2[0-4]\\\\d|1?\\\\d?\\\\d)\\\\.){{3}}(25[0-5]|2[0-4]\\\\d|1?\\\\d?\\\\d)$' AS int)",
    "inet6_aton": "fedsql_inet6_aton({0})", "inet6_ntoa": "fedsql_inet6_ntoa({0})", "is_ipv6": "fedsql_is_ipv6({0})",
    # times
    "currenttimestamp": lambda a: "current_timestamp()", "current_timestamp": lambda a: "current_timestamp()", "sysdate": lambda a: "current_timestamp()", "utc_timestamp": lambda a: "current_timestamp()",
    "curdate": lambda a: "current_date()", "currentdate": lambda a: "current_date()", "current_date": lambda a: "current_date()", "utc_date": lambda a: "to_date(to_utc_timestamp(current_timestamp(), current_timezone()))",
    "curtime": lambda a: "date_format(current_timestamp(), 'HH:mm:ss')", "currenttime": lambda a: "date_format(current_timestamp(), 'HH:mm:ss')", "current_time": lambda a: "date_format(current_timestamp(), 'HH:mm:ss')",
    "utc_time": lambda a: "date_format(to_utc_timestamp(current_timestamp(), current_timezone()), 'HH:mm:ss')",
    "date": lambda a: f"cast({time(a[0])} AS date)", "datetime": lambda a: time(a[0]), "time": lambda a: f"date_format({time(a[0])}, 'HH:mm:ss')", "now": now,
    "unix_timestamp": lambda a: f"unix_timestamp({time(a[0])})" if a else "unix_timestamp(current_timestamp())", "from_unixtime": "timestamp_seconds({0})",
    **{n: (lambda n: lambda a: f"{n}({time(a[0])})")(n) for n in ("month", "dayofyear", "dayofmonth", "year", "weekday", "hour", "minute", "second", "quarter", "last_day")},
    "day": lambda a: f"dayofmonth({time(a[0])})", "monthname": lambda a: f"date_format({time(a[0])}, 'MMM')", "dayname": lambda a: f"date_format({time(a[0])}, 'EEEE')", "dayofweek": lambda a: f"weekday({time(a[0])}) + 1",
    "week": lambda a: week(time(a[0]), len(a) > 1 and a[1] == "1"), "yearweek": lambda a: f"(year({time(a[0])}) * 100 + {week(time(a[0]), len(a) > 1 and a[1] == '1')})",
    "time_to_sec": "(CASE WHEN {0} rlike '^\\\\d+:\\\\d+:\\\\d+$' THEN cast(split({0}, ':')[0] AS bigint) * 3600 + cast(split({0}, ':')[1] AS bigint) * 60 + cast(split({0}, ':')[2] AS bigint) END)",
    "sec_to_time": "concat_ws(':', lpad(cast(pmod(cast({0} AS bigint), 86400) div 3600 AS string), 2, '0'), lpad(cast(pmod(cast({0} AS bigint), 3600) div 60 AS string), 2, '0'), lpad(cast(pmod(cast({0} AS bigint), 60) AS string), 2, '0'))",
    **{n: (lambda a: shifted(a, "")) for n in ("dateadd", "adddate", "date_add", "addtime")}, **{n: (lambda a: shifted(a, "-")) for n in ("datesub", "subdate", "date_sub", "subtime")},
    "datediff": lambda a: f"cast((unix_timestamp({time(a[1])}) - unix_timestamp({time(a[0])})) div 86400 AS int)",
    "timestampdiff": lambda a: f"cast((unix_timestamp({time(a[2])}) - unix_timestamp({time(a[1])})) / {SECONDS.get(literal_text(a[0]) or '', 'NULL')} AS bigint)",
    "date_format": lambda a: f"date_format({time(a[0])}, {java_pattern(a[1])})", "time_format": lambda a: f"date_format({time(a[0])}, {java_pattern(a[1])})", "time_window": time_window,
    # logic
    "if": lambda a: f"if({a[0]}, {a[1] if len(a) > 1 else 1}, {a[2] if len(a) > 2 else 0})", "ifnull": "coalesce({0}, {1})", "nullif": "nullif({0}, {1})", "coalesce": lambda a: f"coalesce({', '.join(a)})", "isnull": "cast({0} IS NULL AS int)",
    "eq": "cast({0} = {1} AS int)", "neq": "cast({0} <> {1} AS int)", "gt": "cast({0} > {1} AS int)", "gte": "cast({0} >= {1} AS int)", "lt": "cast({0} < {1} AS int)", "lte": "cast({0} <= {1} AS int)",
    "in": "cast(array_contains({1}, {0}) AS int)", "not": "cast(NOT cast({0} AS boolean) AS int)", "is": "cast({0} <=> {1} AS int)", "is_not": "cast(NOT ({0} <=> {1}) AS int)",
    # JSON
    "json_encode": lambda a: f"fedsql_json_encode({a[0]})", "json_decode": "try_parse_json({0})", "json_array": lambda a: "to_json(array(" + ", ".join(f"cast({x} AS variant)" for x in a) + "))",
    "json_object": lambda a: "to_json(map(" + ", ".join(f"cast({x} AS string)" if k % 2 == 0 else f"cast({x} AS variant)" for k, x in enumerate(a)) + "))",
    "json_contains": "cast(coalesce(to_json(try_variant_get(try_parse_json({0}), {2}, 'variant')) = to_json(try_parse_json({1})), false) AS int)", "json_contains_path": json_contains_path,
    "json_extract": lambda a: f"get_json_object({a[0]}, {a[1]})" if len(a) == 2 else f"array({', '.join(f'get_json_object({a[0]}, {p})' for p in a[1:])})",
    "json_set": lambda a: f"fedsql_json_set({a[0]}, array({', '.join(a[1::2])}), array({', '.join(f'to_json(cast({v} AS variant))' for v in a[2::2])}))",
    "json_array_append": lambda a: f"fedsql_json_append({a[0]}, array({', '.join(a[1::2])}), array({', '.join(f'to_json(cast({v} AS variant))' for v in a[2::2])}))",
    "json_remove": lambda a: f"fedsql_json_remove({a[0]}, array({', '.join(a[1:])}))", "json_depth": "fedsql_json_depth({0})",
    "json_keys": lambda a: f"coalesce(json_object_keys({a[0] if len(a) < 2 else f'get_json_object({a[0]}, {a[1]})'}), array())",
    "json_length": lambda a: (lambda d: f"coalesce(json_array_length({d}), size(json_object_keys({d})), 0)")(a[0] if len(a) < 2 else f"get_json_object({a[0]}, {a[1]})"),
    "json_valid": "cast(try_parse_json(cast({0} AS string)) IS NOT NULL AS int)",
    # regular expressions
    "regexp": regexp, "regexplike": regexp, "regexp_like": regexp,
    "regexp_instr": lambda a: regexp_call("instr", a), "regexp_replace": lambda a: regexp_call("replace", a), "regexp_substr": lambda a: regexp_call("substr", a),
    # others
    "type": "typeof({0})", "is_null": "cast({0} IS NULL AS int)", **{f"is_{n}": f"cast(typeof({{0}}) rlike '{t}' AS int)" for n, t in (("int", "^(tinyint|smallint|int|bigint)$"), ("float", "^(float|double)$"), ("decimal", "^decimal"), ("number", "^(tinyint|smallint|int|bigint|float|double|decimal.*)$"), ("string", "^string"), ("bytes", "^binary$"), ("bool", "^boolean$"), ("array", "^array"), ("set", "^array"), ("map", "^(map|struct)"), ("datetime", "^timestamp"), ("date", "^date$"))},
    "is_objectid": "cast(coalesce(cast({0} AS string) rlike '^[0-9a-f]{{24}}$', false) AS int)", "is_uuid": "cast(coalesce(cast({0} AS string) rlike '^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$', false) AS int)", "is_time": "cast(coalesce(cast({0} AS string) rlike '^\\\\d\\\\d:\\\\d\\\\d:\\\\d\\\\d$', false) AS int)",
    **{f"convert_{n}": (lambda n: lambda a: cast(a[0], n + (" " + (literal_text(a[1]) or "") if len(a) > 1 else "")))(n) for n in ("int", "float", "decimal", "string", "bytes", "bool", "array", "set", "objectid", "uuid", "datetime", "date", "time")},
    "convert_map": "try_parse_json({0})", "range": lambda a: f"(CASE WHEN {a[1] if len(a) > 1 else a[0]} > {a[0] if len(a) > 1 else 0} THEN sequence({a[0] if len(a) > 1 else 0}, {a[1] if len(a) > 1 else a[0]} - 1{', ' + a[2] if len(a) > 2 else ''}) ELSE array() END)",
    "split": lambda a: f"split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))", "join": lambda a: f"array_join({a[0]}, {a[1] if len(a) > 1 else quoted(',')})",
    "objectid": lambda a: a[0] if a else "lower(concat(lpad(hex(unix_timestamp(current_timestamp())), 8, '0'), substr(replace(uuid(), '-', ''), 1, 16)))", "uuid": lambda a: a[0] if a else "uuid()", "uuid$uuid4": lambda a: "uuid()",
    "snowflakeid": lambda a: "(shiftleft(unix_millis(current_timestamp()) - 1420070400000, 22) + monotonically_increasing_id())",
    "random": lambda a: "rand()", "random$int": lambda a: f"cast({a[0]} + floor(rand() * ({a[1]} - {a[0]} + 1)) AS bigint)" if len(a) > 1 else "cast(floor(rand() * 2147483647) AS bigint)",
    "random$string": lambda a: f"randstr({a[0] if a else 8})", "random$letters": lambda a: f"translate(randstr({a[0] if a else 8}), '0123456789', 'abcdefghij')", "random$digits": lambda a: f"lpad(cast(floor(rand() * power(10, {a[0] if a else 8})) AS bigint), {a[0] if a else 8}, '0')",
    "random$hexs": hexs, "random$prints": lambda a: f"randstr({a[0] if a else 8})", "random$bytes": lambda a: f"cast(randstr({a[0] if a else 8}) AS binary)", "random$choice": lambda a: f"get({a[0]}, cast(floor(rand() * size({a[0]})) AS int))",
    "math$pow": "power({0}, {1})", "math$sqrt": "(CASE WHEN {0} >= 0 THEN sqrt({0}) END)", "math$floor": "cast(floor({0}) AS bigint)", "math$ceil": "cast(ceil({0}) AS bigint)", "json$decode": "try_parse_json({0})", "neg": "(-{0})", "current_env_variable": lambda a: a[0],
}


def call(name: str, args: list[str]) -> str | None:
    """The SQL of a built-in function, or None if there is none of that name."""
    f = FUNCTIONS.get(name.lower())
    if f is None:
        return None
    return f.format(*args) if isinstance(f, str) else f(args)
