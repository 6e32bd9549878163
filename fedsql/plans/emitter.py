"""The dialect's tree as Spark SQL text.

Only meaning is decided here; plans are Catalyst's.  What differs from
Spark's SQL: a bare JOIN is a left join; a column that is neither grouped
nor aggregated takes its group's first row; SUM and AVG of nothing are 0 and
GROUP_CONCAT of nothing is empty; a searched CASE without ELSE gives 0;
comparisons give 1 or 0; a text compared or computed with a number counts as
the number it begins with; FIRST_VALUE, LAST_VALUE and NTH_VALUE see the whole
partition; several generators in one SELECT advance together; aliases can be
used in WHERE.  Where rows' input order matters, the first source gets an
ordinal.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import types as T

from fedsql.functions import builtins
from fedsql.functions.builtins import quoted
from fedsql.plans.lexer import SqlError
from fedsql.plans.parser import COMPARE, Node
from fedsql.sources.files import view_arguments

ORD = "__ord"
PART = "__part"
#: Pairs of rows of an average key that are made as one lot. Small, so that what is shuffled shows Spark that there is work for more than a few tasks.
PAIRS = 80_000
AGGREGATES = {
    "count", "sum", "max", "min", "avg", "group_concat", "group_array", "grouparray", "group_uniq_array", "groupuniqarray", "group_bit_and", "group_bit_or", "group_bit_xor", "groupbitand", "groupbitor", "groupbitxor",
    "json_arrayagg", "json_objectagg", "any_value", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "approx_count_distinct", "percentile", "percentile_approx", "median", "mode", "corr", "count_if", "max_by", "min_by", "skewness", "kurtosis", "bool_and", "bool_or", "grouping", "grouping_id",
}
ARRAYS = {"split", "range", "json_keys", "group_array", "grouparray", "group_uniq_array", "groupuniqarray", "convert_array", "convert_set", "sort", "slice", "sequence", "array"}
RANKS = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"}
ORDERED = {"group_concat", "group_array", "grouparray", "json_arrayagg", "json_objectagg", "any_value"}
BOOLEAN = {"not", "in", "like", "regexp", "isnull", "is", "between", "exists"}
SIGNS = {"^": "bitwisexor", "&": "bitwiseand", "|": "bitwiseor", "<<": "bitwiseleftshift", ">>": "bitwiserightshift", "%": "mod", "/": "div"}
FULL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def annotated(text: str) -> tuple[str, list[str], str | None, bool]:
    """A back-ticked name's own name, type filters, option and whether it is optional."""
    m = re.fullmatch(r"(.*?)(?:\[([^\]]+)\])?(?:<(\w+)>)?(\?)?(?:\[([^\]]+)\])?", text, re.S)
    kinds = [k.strip() for g in (m[2], m[5]) if g for k in g.split(";") if k.strip()]
    return m[1] or text, kinds, m[3], bool(m[4])


def database_text(n: Node, session: Any) -> str:
    """A constant as any database's SQL has it."""
    if n.kind == "negative":
        return "-" + database_text(n.of, session)
    v = session.value(n.name) if n.kind == "variable" else n.text
    if n.kind == "number" or isinstance(v, (int, float)):
        return str(v)
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def conjuncts(n: Node) -> list[Node]:
    return conjuncts(n.left) + conjuncts(n.right) if n.kind == "binary" and n.op == "and" else [n]


class Scope:
    """What a SELECT's names can refer to."""

    def __init__(self) -> None:
        self.sources: list[tuple[str, T.StructType | None]] = []
        self.named: dict[str, Node] = {}
        self.windows: dict[str, Node] = {}
        self.generators: dict[int, str] = {}
        self.ranked: dict[int, str] = {}  # COUNT(DISTINCT) OVER by the column of its values' dense ranks
        self.fill: set[str] | None = None
        self.ordered = False
        self.inside = False  # an aggregate

    def column(self, name: str, of: str | None = None) -> tuple[str | None, T.DataType | None, bool]:
        """(source, type, whether all sources are known)."""
        known = True
        for alias, schema in self.sources:
            if of is not None and alias.lower() != of.lower():
                continue
            if schema is None:
                known = False
            else:
                for f in schema.fields:
                    if f.name.lower() == name.lower():
                        return alias, f.dataType, True
        return None, None, known


class Emitter:
    def __init__(self, session: Any) -> None:
        self.session = session
        self.ctes: list[set[str]] = []

    # -- queries ------------------------------------------------------------------------------

    def query(self, n: Node, outer: Scope | None = None) -> str:
        if n.kind == "with":
            self.ctes.append({name.lower() for name, *_ in n.ctes})
            parts = [f"{tick(name)}{'(' + ', '.join(map(tick, columns)) + ')' if columns else self._names(q)} AS ({self.query(q)})" for name, columns, q in n.ctes]
            body = self.query(n.query, outer)
            self.ctes.pop()
            return f"WITH {'RECURSIVE ' if n.recursive else ''}{', '.join(parts)} {body}"
        if n.kind == "setop":
            # UNION keeps the first term's names; terms are in brackets, so that their own ORDER and LIMIT stay theirs
            left, right = (f"({self.query(x, outer)})" if not (x.kind == "setop" and x is n.left and x.op == n.op == "union" and x.all == n.all and not x.order and x.limit is None) else self.query(x, outer) for x in (n.left, n.right))
            text = f"{left} {n.op.upper()}{' ALL' if n.all else ''} {right}"
            scope = Scope()
            return text + self.trailing(n, scope)
        if n.kind == "values":
            scope = Scope()
            return "VALUES " + ", ".join("(" + ", ".join(self.value(e, scope) for e in row) + ")" for row in n.rows)
        return self.select(n, outer)

    def _names(self, q: Node) -> str:
        """Column names of a recursive CTE come from its first term."""
        first = q
        while first.kind == "setop":
            first = first.left
        if q.kind != "setop" or first.kind != "select" or any(e.kind == "star" for e, _ in first.items):
            return ""
        return "(" + ", ".join(tick(a or self.auto_name(e)) for e, a in first.items) + ")"

    def given(self, name: str, where: Node, scope: Scope) -> dict[tuple[str, str], str] | None:
        """Values that a WHERE gives to the arguments of a virtual view: its comparisons with constants joined by AND."""
        text = self.session.view_text(name)
        if text is None:
            return None
        wanted, out = set(view_arguments(text)), {}

        def look(n: Node) -> None:
            if n.kind == "binary" and n.op == "and":
                look(n.left)
                look(n.right)
            elif n.kind == "binary" and n.left.kind == "column" and n.right.kind in ("string", "number", "variable", "negative"):
                key = (n.left.parts[-1], {"==": "=", "!=": "<>"}.get(n.op, n.op))
                if key in wanted:
                    out[key] = database_text(n.right, self.session)
            elif n.kind == "in" and n.of.kind == "column" and n.values and not n.negated and (n.of.parts[-1], "in") in wanted and all(v.kind in ("string", "number") for v in n.values):
                out[n.of.parts[-1], "in"] = "(" + ", ".join(database_text(v, self.session) for v in n.values) + ")"

        look(where)
        return out

    def relation(self, s: Node, where: Node | None = None, scope: Scope | None = None, before: Scope | None = None) -> tuple[str, str, T.StructType | None]:
        """(text, alias, schema) of a source."""
        if s.kind == "derived":
            alias = s.alias or self.session.fresh("d")
            text = self.query(s.query, before)
            return f"({text})", alias, self.session.schema_of(text) if not self.ctes else None
        name = annotated(s.name)[0] if s.quoted or "<" in s.name else s.name
        if any(name.lower() in c for c in self.ctes):
            return tick(name), s.alias or name, None
        view, schema = self.session.relation(s.name, self.given(s.name, where, scope)) if where is not None else self.session.relation(s.name)
        alias = s.alias or re.sub(r"\W+", "_", re.split(r"[./?]", name)[-1] if "/" not in name else name.split("/")[-1].split(".")[0])
        return tick(view), alias, schema

    def select(self, n: Node, outer: Scope | None = None) -> str:
        if (made := self.session.pipeline(n, self)) is not None:
            return made
        scope = Scope()
        everything = [e for e, _ in n.items] + ([n.having] if n.having else []) + [o[0] for o in n.order]
        grouped = bool(n.group) or any(self.aggregates(e) for e, _ in n.items) or (n.having is not None and self.aggregates(n.having))
        scope.windows = dict(n.windows)
        relations: list[tuple[str, str, T.StructType | None]] = []
        for s in n.sources:  # a lateral source sees those before it
            before = Scope()
            before.sources = [(alias, schema) for _, alias, schema in relations]
            relations.append(self.relation(s, n.where, scope, before if getattr(s, "lateral", False) else None))
        scope.sources = [(alias, schema) for _, alias, schema in relations]
        if outer is not None:
            scope.sources = scope.sources + [(a, s) for a, s in outer.sources if a.lower() not in {x.lower() for x, _ in scope.sources}]
        scope.named = {a: e for e, a in n.items if a}
        if grouped:
            keys = [k for g in n.group for k in (g if isinstance(g, list) else [g])]
            scope.fill = {self.text(k) for k in keys} | {self.text(scope.named[k.parts[0]]) for k in keys if k.kind == "column" and len(k.parts) == 1 and k.parts[0] in scope.named and scope.column(k.parts[0])[0] is None} | {self.text(e) for k in keys if k.kind == "number" and k.text.isdigit() and 0 < int(k.text) <= len(n.items) for e in [n.items[int(k.text) - 1][0]]}
        scope.ordered = bool(relations) and any(self.wants_order(e, scope, grouped) for e in everything)

        scope.inside = True  # FROM and WHERE see rows, not groups
        first = True
        text = ""
        generators: list[Node] = []
        for e in everything:
            self.find_generators(e, generators)
        parts = self.spread(n, relations, scope) if outer is None and not scope.ordered else []
        relations = [(rel, alias, schema) for rel, (_, alias, schema) in zip(parts, relations)] if parts else relations
        for s, (rel, alias, _) in zip(n.sources, relations):
            if first and scope.ordered:
                rel = f"(SELECT *, monotonically_increasing_id() AS {ORD} FROM {rel})"
            if first and not grouped and len(n.sources) == 1 and not generators:
                rel = self.with_ranks(everything, rel, alias, scope, n.where)
            if first:
                text = f" FROM {rel} AS {tick(alias)}"
            else:
                text += self.join(s, rel, alias, scope)
                if parts:
                    text += f" AND {tick(relations[0][1])}.{PART} = {tick(alias)}.{PART}"
            first = False
        if generators:
            cells = []
            for k, g in enumerate(generators):
                scope.generators[id(g)] = f"__gen.c{k}"
                cells.append(self.session.generator(g, self, scope))
            names = ", ".join(f"c{k}" for k in range(len(cells)))
            text = (text or " FROM (SELECT 1) AS __one") + f" LATERAL VIEW inline(arrays_zip({', '.join(cells)})) __gen AS {names}"
        if n.where is not None and not scope.ranked:  # else it stands inside already
            text += f" WHERE {self.truth(self.unaliased(n.where, scope), scope)}"
        scope.inside = False
        columns = []
        for e, a in n.items:
            if e.kind == "star":
                columns.append((f"{tick(e.of)}." if e.of else "") + "*" + self.hidden(scope, e.of is None or e.of.lower() == relations[0][1].lower()))
            else:
                name, _, _, _ = annotated(a) if a else (self.auto_name(e), [], None, False)
                columns.append(f"{self.value(e, scope)} AS {tick(name)}")
        hint = f"/*+ MERGE({tick(relations[1][1])}) */ " if parts else ""  # the parts of a table are too many for a broadcast
        head = f"SELECT {hint}{'DISTINCT ' if n.distinct else ''}{', '.join(columns)}"
        if n.group:
            if n.how == "sets":
                text += " GROUP BY GROUPING SETS (" + ", ".join("(" + ", ".join(self.group_key(k, scope, n) for k in g) + ")" for g in n.group) + ")"
            else:
                keys = ", ".join(self.group_key(k, scope, n) for k in n.group)
                text += f" GROUP BY {n.how.upper()}({keys})" if n.how else f" GROUP BY {keys}"
        if n.having is not None:
            text += f" HAVING {self.truth(n.having, scope)}" if grouped else f"{' AND' if n.where is not None else ' WHERE'} {self.truth(self.unaliased(n.having, scope), scope)}"
        return head + text + self.trailing(n, scope)

    def spread(self, n: Node, relations: list[tuple[str, str, T.StructType | None]], scope: Scope) -> list[str]:
        """Both sources of an inner join of stored tables, in parts, where a key's pairs are too many for one task; else nothing.

        Few keys with many rows on both sides leave most cores idle, and what is shuffled is too small for Spark to see it.
        Each row of the longer table goes to one part by its content, those of the shorter one go to all.
        """
        if len(relations) != 2 or n.sources[1].join != "inner" or n.sources[1].on is None or any(s.kind == "derived" or getattr(s, "lateral", False) or schema is None for s, (_, _, schema) in zip(n.sources, relations)):
            return []
        if any(e.kind == "star" for e, _ in n.items) or (n.limit is not None and not n.order):
            return []
        aliases = [alias for _, alias, _ in relations]
        own: list[list[Node]] = [[], []]
        keys: list[list[str]] = [[], []]
        for c in [*conjuncts(n.sources[1].on), *(conjuncts(self.unaliased(n.where, scope)) if n.where is not None else [])]:
            if len(of := self.sides(c, aliases, scope)) == 1 and of <= {0, 1}:
                own[min(of)].append(c)
            elif c.kind == "binary" and c.op in ("=", "==") and [self.sides(x, aliases, scope) for x in (c.left, c.right)] in ([{0}, {1}], [{1}, {0}]):
                for x in (c.left, c.right):
                    keys[min(self.sides(x, aliases, scope))].append(self.value(x, scope))
        sizes = [self.session.stored(rel) for rel, _, _ in relations]
        if not keys[0] or sizes[0] * sizes[1] < 64 * PAIRS:
            return []
        asked = []
        for at, ((rel, alias, _), k, conditions) in enumerate(zip(relations, keys, own)):
            where = "".join(f" {'AND' if i else 'WHERE'} {self.truth(c, scope)}" for i, c in enumerate(conditions))
            asked.append(f"SELECT {at} AS at, count(*) AS n, approx_count_distinct(xxhash64({', '.join(k)})) AS d FROM {rel} AS {tick(alias)}{where}")
        counts = [(r.n, r.d) for r in sorted(self.session.spark.sql(" UNION ALL ".join(asked)).collect())]
        each = [n / max(1, *(d for _, d in counts)) for n, _ in counts]
        long, short = (0, 1) if each[0] >= each[1] else (1, 0)
        # parts of fewer than 16 rows of a key would cost more in copies than they share out
        parts = int(min(each[0] * each[1] / PAIRS + 1, each[long] / 16, 10_000))
        content = [tick(f.name) for f in relations[long][2].fields if not re.search(r"\b(map|variant)\b", f.dataType.simpleString())]
        if parts < 2 or not content:
            return []
        out = ["", ""]
        out[long] = f"(SELECT *, pmod(xxhash64({', '.join(content)}), {parts}L) AS {PART} FROM {relations[long][0]})"
        out[short] = f"(SELECT *, explode(sequence(0L, {parts - 1}L)) AS {PART} FROM (SELECT /*+ REPARTITION({min(parts, 64)}) */ * FROM {relations[short][0]}))"
        return out

    def sides(self, n: Node, aliases: list[str], scope: Scope) -> set[int]:
        """The sources, by place, that an expression's columns are of; -1 for what can't be told."""
        if n.kind in ("subquery", "exists", "select", "with", "setop", "star"):
            return {-1}
        if n.kind != "column":
            return {k for c in n.children() for k in self.sides(c, aliases, scope)}
        found = [a for a in aliases if a.lower() == n.parts[0].lower()] if len(n.parts) > 1 else []
        alias = found[0] if found else scope.column(n.parts[0])[0]
        return {aliases.index(alias) if alias in aliases else -1}

    def hidden(self, scope: Scope, first: bool) -> str:
        """Keeps the columns that were added to the first source out of ``*``."""
        own = [*([ORD] if scope.ordered else []), *dict.fromkeys(scope.ranked.values())]
        return f" EXCEPT ({', '.join(own)})" if own and first else ""

    def with_ranks(self, everything: list[Node], rel: str, alias: str, scope: Scope, where: Node | None) -> str:
        """The source with dense ranks of the values that COUNT(DISTINCT x) OVER (PARTITION BY ...) counts: their greatest is the count."""
        found: list[Node] = []

        def look(n: Node) -> None:
            if n.kind in ("subquery", "exists", "select", "with", "setop"):
                return
            if n.kind == "call" and n.name.lower() == "count" and n.distinct and n.over is not None and len(n.args) == 1:
                w = self.window(n.over, scope)
                if not w.order and not w.frame:
                    found.append(n)
                return
            for c in n.children():
                look(c)

        for e in everything:
            look(e)
        if not found:
            return rel
        columns = []
        for k, n in enumerate(found):
            x = self.value(n.args[0], scope)
            part = "".join(f"{self.value(p, scope)}, " for p in self.window(n.over, scope).part)
            columns.append(f"CASE WHEN {x} IS NOT NULL THEN dense_rank() OVER (PARTITION BY {part}{x} IS NULL ORDER BY {x}) END AS __rank{k}")
            scope.ranked[id(n)] = f"__rank{k}"
        inner = "" if where is None else f" WHERE {self.truth(self.unaliased(where, scope), scope)}"
        return f"(SELECT *, {', '.join(columns)} FROM {rel} AS {tick(alias)}{inner})"

    def group_key(self, k: Node, scope: Scope, n: Node) -> str:
        inner = scope.inside
        scope.inside = True
        if k.kind == "column" and len(k.parts) == 1 and k.parts[0] in scope.named and scope.column(k.parts[0])[0] is None:
            out = self.value(scope.named[k.parts[0]], scope)
        else:
            out = k.text if k.kind == "number" else self.value(k, scope)
        scope.inside = inner
        return out

    def trailing(self, n: Node, scope: Scope) -> str:
        out = ""
        if n.order:
            out += " ORDER BY " + ", ".join(self.order_key(e, d, x, scope) for e, d, x in n.order)
        if n.limit is not None:
            limit = self.value(n.limit, scope)
            if not limit.startswith("-"):  # a negative limit trims from the end; the session does that
                out += f" LIMIT {limit}"
        if n.offset is not None:
            out += f" OFFSET {self.value(n.offset, scope)}"
        return out

    def order_key(self, e: Node, down: bool, nulls: str | None, scope: Scope) -> str:
        if e.kind == "column" and len(e.parts) == 1 and e.parts[0] in scope.named:
            text = tick(annotated(e.parts[0])[0])
        elif e.kind == "number":
            text = e.text
        else:
            same = next((a or self.auto_name(i) for a, i in scope.named.items() if self.text(i) == self.text(e)), None)
            text = tick(same) if same else self.value(e, scope)
        return text + (" DESC" if down else " ASC") + (f" NULLS {nulls.upper()}" if nulls else " NULLS LAST" if down else " NULLS FIRST")

    def join(self, s: Node, rel: str, alias: str, scope: Scope) -> str:
        kinds = {"bare": "LEFT JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "inner": "JOIN", "cross": "CROSS JOIN", "full": "FULL JOIN", "natural": "NATURAL JOIN", "left semi": "LEFT SEMI JOIN", "left anti": "LEFT ANTI JOIN", "natural left": "NATURAL LEFT JOIN", "straight_join": "JOIN"}
        if s.join == "comma":
            return f", {'LATERAL ' if s.lateral else ''}{rel} AS {tick(alias)}"
        if s.join not in kinds:
            raise SqlError(f"unknown join {s.join}")
        out = f" {kinds[s.join]} {'LATERAL ' if s.lateral else ''}{rel} AS {tick(alias)}"
        if s.on is not None:
            out += f" ON {self.truth(s.on, scope)}"
        if s.using:
            out += f" USING ({', '.join(map(tick, s.using))})"
        return out

    # -- looking into expressions --------------------------------------------------------------

    def is_aggregate(self, n: Node) -> bool:
        return n.kind == "call" and n.over is None and (n.name.lower() in AGGREGATES or n.name.lower() in self.session.aggregates or (n.name.lower() in ("bit_and", "bit_or", "bit_xor") and len(n.args) == 1))

    def aggregates(self, n: Node) -> bool:
        if n.kind in ("subquery", "exists") or (n.kind == "in" and n.query is not None and not n.of.children()):
            return False
        if self.is_aggregate(n):
            return True
        inside = [c for c in n.children() if c.kind not in ("select", "with", "setop", "values")]
        return any(self.aggregates(c) for c in inside)

    def wants_order(self, n: Node, scope: Scope, grouped: bool) -> bool:
        if n.kind in ("subquery", "exists", "select", "with", "setop"):
            return False
        if n.kind == "call":
            name = n.name.lower()
            if name in ("row_index", "row_last") or (name in ORDERED and not n.over) or (n.over is not None and not self.window(n.over, scope).order and name in RANKS | ORDERED):
                return True
        if n.kind == "binary" and n.op == ":=":
            return True
        if grouped and n.kind == "column" and scope.fill is not None and self.text(n) not in scope.fill and scope.column(n.parts[-1])[0] is not None:
            return True
        if n.kind == "call" and self.is_aggregate(n) and n.name.lower() not in ORDERED:
            return False
        return any(self.wants_order(c, scope, grouped) for c in n.children())

    def find_generators(self, n: Node, out: list[Node]) -> None:
        if n.kind in ("subquery", "exists", "select", "with", "setop"):
            return
        if n.kind == "call" and self.session.is_generator(n.name):
            same = next((g for g in out if self.text(g) == self.text(n)), None)
            out.append(n) if same is None or same is n else out.append(n)
            return
        for c in n.children():
            self.find_generators(c, out)

    def unaliased(self, n: Node, scope: Scope) -> Node:
        """Aliases in WHERE stand for their expressions where no column has that name."""
        if n.kind == "column" and len(n.parts) == 1 and n.parts[0] in scope.named:
            source, _, known = scope.column(n.parts[0])
            if source is None and (known or not scope.sources):
                return scope.named[n.parts[0]]
        if n.kind in ("subquery", "select", "exists", "with", "setop"):
            return n
        return n.mapped(lambda c: self.unaliased(c, scope))

    def kind_of(self, n: Node, scope: Scope) -> str:
        """string, number, time or unknown, from literals, columns and operators alone."""
        if n.kind == "string":
            return "string"
        if n.kind in ("number", "negative", "invert") or n.kind in BOOLEAN:
            return "number"
        if n.kind == "constant":
            return "unknown" if n.text == "null" else "number"
        if n.kind == "variable":
            v = self.session.value(n.name)
            return "string" if isinstance(v, str) else "number" if isinstance(v, (int, float)) else "unknown"
        if n.kind == "cast":
            t = builtins.TYPES.get(n.type.partition("(")[0])
            return "string" if t == "string" else "number" if t in ("bigint", "double", "decimal(38,18)", "boolean") else "time" if t in ("timestamp", "date") else "unknown"
        if n.kind == "binary":
            return "number" if n.op not in (":=",) else self.kind_of(n.right, scope)
        if n.kind == "column":
            name, kinds, _, _ = annotated(n.parts[-1])
            if kinds:
                return self.kind_of(Node("cast", type=kinds[-1].split()[0], of=n), scope)
            _, t, _ = scope.column(name, n.parts[0] if len(n.parts) > 1 else None)
            return "string" if isinstance(t, T.StringType) else "number" if isinstance(t, (T.NumericType, T.BooleanType)) else "time" if isinstance(t, (T.TimestampType, T.DateType, T.TimestampNTZType)) else "unknown"
        if n.kind == "case":
            return next((k for _, e in n.whens if (k := self.kind_of(e, scope)) != "unknown"), "unknown")
        if n.kind == "call":
            low = n.name.lower()
            if low in ("concat", "concat_ws", "lower", "upper", "substring", "substr", "left", "right", "trim", "replace", "date_format", "reverse", "repeat", "hex", "bin", "json_extract", "group_concat", "dayname", "monthname", "substring_index"):
                return "string"
            if low in ("count", "sum", "avg", "length", "char_length", "abs", "round", "floor", "ceil", "mod", "year", "month", "datediff", "unix_timestamp"):
                return "number"
            if low in ("if", "ifnull", "coalesce", "max", "min", "any_value") and n.args:
                return self.kind_of(n.args[-1 if low == "if" else 0], scope)
        return "unknown"

    # -- names -----------------------------------------------------------------------------------

    def auto_name(self, e: Node) -> str:
        if e.kind == "column":
            name = annotated(e.parts[-1])[0]
            return name if e.quoted or len(e.parts) < 3 else "_".join(e.parts[1:])
        return self.text(e)

    def text(self, n: Node) -> str:
        """The dialect's text of an expression, function names in upper case: the name of a column without alias."""
        t = self.text
        k = n.kind
        if k == "column":
            return ".".join(n.parts)
        if k == "number":
            return n.text
        if k == "string":
            return "'" + n.text + "'"
        if k == "constant":
            return n.text.upper()
        if k == "variable":
            return "@" + n.name
        if k == "star":
            return (f"{n.of}." if n.of else "") + "*"
        if k == "call":
            over = "" if n.over is None else " OVER (" + " ".join(x for x in ("PARTITION BY " + ", ".join(map(t, n.over.part)) if n.over.part else n.over.base or "", "ORDER BY " + ", ".join(t(e) + (" DESC" if d else "") for e, d, _ in n.over.order) if n.over.order else "") if x) + ")"
            return f"{n.name.upper()}({'DISTINCT ' if n.distinct else ''}{', '.join(map(t, n.args))}){over}"
        if k == "binary":
            return f"{t(n.left)} {n.op.upper()} {t(n.right)}"
        if k == "negative":
            return f"-{t(n.of)}"
        if k == "invert":
            return f"~{t(n.of)}"
        if k == "not":
            return f"NOT {t(n.of)}"
        if k == "cast":
            return f"CAST({t(n.of)} AS {n.type.upper()})"
        if k == "tuple":
            return f"({', '.join(map(t, n.items))})"
        if k == "isnull":
            return f"{t(n.of)} IS {'NOT ' if n.negated else ''}NULL"
        if k == "in" and n.values is not None:
            return f"{t(n.of)} {'NOT ' if n.negated else ''}IN ({', '.join(map(t, n.values))})"
        if k in ("like", "regexp"):
            return f"{t(n.of)} {'NOT ' if n.negated else ''}{k.upper()} {t(n.pattern)}"
        if k == "between":
            return f"{t(n.of)} BETWEEN {t(n.low)} AND {t(n.high)}"
        if k == "case":
            return "CASE " + (t(n.of) + " " if n.of else "") + " ".join(f"WHEN {t(a)} THEN {t(b)}" for a, b in n.whens) + (f" ELSE {t(n.other)}" if n.other else "") + " END"
        if k == "interval":
            return f"INTERVAL {t(n.value)} {n.unit.upper()}"
        return k.upper()

    # -- expressions -----------------------------------------------------------------------------

    def truth(self, n: Node, scope: Scope) -> str:
        """As a condition."""
        k = n.kind
        if k == "binary" and n.op in ("and", "or"):
            return f"({self.truth(n.left, scope)} {n.op.upper()} {self.truth(n.right, scope)})"
        if k == "binary" and n.op == "xor":
            return f"(({self.truth(n.left, scope)}) <> ({self.truth(n.right, scope)}))"
        if k == "not":
            return f"(NOT {self.truth(n.of, scope)})"
        if k == "binary" and n.op in COMPARE:
            return self.compared(n, scope)
        if k == "isnull":
            return f"({self.value(n.of, scope)} IS {'NOT ' if n.negated else ''}NULL)"
        if k == "is":
            return f"({'NOT ' if n.negated else ''}({self.value(n.of, scope)} <=> {self.value(n.value, scope)}))"
        if k == "between":
            low, high = (self.compared(Node("binary", op=o, left=n.of, right=x), scope) for o, x in ((">=", n.low), ("<=", n.high)))
            return f"({'NOT ' if n.negated else ''}({low} AND {high}))"
        if k == "in":
            return self.contained(n, scope)
        if k == "like":
            return f"(cast({self.value(n.of, scope)} AS string) {'NOT ' if n.negated else ''}LIKE {self.value(n.pattern, scope)}{' ESCAPE ' + quoted(n.escape) if n.escape else ''})"
        if k == "regexp":
            inner = builtins.regexp([self.value(n.of, scope), self.value(n.pattern, scope)])
            return f"({inner} = {0 if n.negated else 1})"
        if k == "exists":
            return f"EXISTS ({self.query(self.plain_exists(n.query), scope)})"
        if k == "constant" and n.text in ("true", "false"):
            return n.text
        v = self.value(n, scope)
        return f"({v} <> '')" if self.kind_of(n, scope) == "string" and k == "string" else f"cast({v} AS boolean)"

    def plain_exists(self, q: Node) -> Node:
        """EXISTS asks for rows: aggregates of an ungrouped query don't make one."""
        if q.kind == "select" and not q.group and any(self.aggregates(e) for e, _ in q.items) and q.having is None:
            q = q.mapped(lambda c: c)
            q.items = [(Node("number", text="1"), "x")]
        return q

    def compared(self, n: Node, scope: Scope) -> str:
        if n.left.kind == "tuple" and n.right.kind == "tuple":
            parts = [self.compared(Node("binary", op=n.op, left=a, right=b), scope) for a, b in zip(n.left.items, n.right.items)]
            return "(" + (" AND " if n.op in ("=", "<=>") else " OR ").join(parts) + ")"
        a, b = self.kind_of(n.left, scope), self.kind_of(n.right, scope)
        x, y = self.value(n.left, scope), self.value(n.right, scope)
        if a == "number" and b == "string":
            y = self.as_number(n.right, y)
        elif a == "string" and b == "number":
            x, y = (self.as_number(n.left, x), y) if n.left.kind != "string" else (x, f"cast({y} AS string)")
        return f"({x} {n.op} {y})"

    def as_number(self, n: Node, sql: str) -> str:
        if n.kind == "string":
            m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", n.text)
            return (m[1] if "e" not in m[1].lower() else repr(float(m[1]))) if m else "0"
        return builtins.number(sql)

    def contained(self, n: Node, scope: Scope) -> str:
        no = "NOT " if n.negated else ""
        left = f"({', '.join(self.value(i, scope) for i in n.of.items)})" if n.of.kind == "tuple" else self.value(n.of, scope)
        if n.query is not None:
            return f"({left} {no}IN ({self.query(n.query, scope)}))"
        if len(n.values) == 1 and n.values[0].kind == "variable" and isinstance(v := self.session.value(n.values[0].name), (list, tuple, set)):
            if not v:
                return "true" if n.negated else "false"
            return f"({left} {no}IN ({', '.join(self.session.literal(x) for x in v)}))"
        kind = self.kind_of(n.of, scope)
        values = []
        for v in n.values:
            sql = f"({', '.join(self.value(i, scope) for i in v.items)})" if v.kind == "tuple" else self.value(v, scope)
            other = self.kind_of(v, scope)
            values.append(self.as_number(v, sql) if kind == "number" and other == "string" else f"cast({sql} AS string)" if kind == "string" and other == "number" else sql)
        return f"({left} {no}IN ({', '.join(values)}))"

    def is_array(self, n: Node, scope: Scope) -> bool:
        """Whether an expression's value is known to be an array."""
        if n.kind == "column":
            return isinstance(scope.column(annotated(n.parts[-1])[0], n.parts[0] if len(n.parts) > 1 else None)[1], T.ArrayType)
        if n.kind == "variable":
            return isinstance(self.session.value(n.name), (list, tuple, set))
        return n.kind == "tuple" or (n.kind == "call" and n.name.lower() in ARRAYS)

    def value(self, n: Node, scope: Scope) -> str:
        k = n.kind
        if k in BOOLEAN or (k == "binary" and (n.op in COMPARE or n.op in ("and", "or", "xor"))):
            return f"cast({self.truth(n, scope)} AS int)"
        if k == "number":
            return n.text if n.text.lstrip("-").isdigit() else n.text + "D"  # a fraction is a double
        if k == "string":
            return quoted(n.text)
        if k == "constant":
            return n.text
        if k == "variable":
            return self.session.literal(self.session.value(n.name))
        if k == "column":
            return self.column(n, scope)
        if k == "tuple":
            return f"array({', '.join(self.value(i, scope) for i in n.items)})"
        if k == "negative":
            return f"(-{self.number_of(n.of, scope)})"
        if k == "invert":
            return builtins.call("bitwisenot", [self.value(n.of, scope)])
        if k == "cast":
            return builtins.cast(self.value(n.of, scope), n.type)
        if k == "interval":
            return f"interval|{self.value(n.value, scope)}|{n.unit}"
        if k == "subquery":
            return f"({self.query(n.query, scope)})"
        if k == "case":
            return self.case(n, scope)
        if k == "binary":
            return self.arithmetic(n, scope)
        if k == "call":
            return self.call(n, scope)
        if k == "star":
            return "*"
        raise SqlError(f"can't use {k} here")

    def number_of(self, n: Node, scope: Scope) -> str:
        v = self.value(n, scope)
        return self.as_number(n, v) if self.kind_of(n, scope) == "string" else v

    def arithmetic(self, n: Node, scope: Scope) -> str:
        if n.op == ":=":
            return self.session.assignment(n, self, scope)
        for a, b in ((n.left, n.right), (n.right, n.left)):
            if b.kind == "interval":
                return builtins.call("dateadd" if n.op == "+" else "datesub", [self.value(a, scope), self.value(b, scope)])
        x, y = self.number_of(n.left, scope), self.number_of(n.right, scope)
        if n.op in SIGNS:
            return builtins.call(SIGNS[n.op], [x, y])
        return f"cast(floor(try_divide({x}, {y})) AS bigint)" if n.op == "div" else f"({x} {n.op} {y})"

    def case(self, n: Node, scope: Scope) -> str:
        branches = [e for _, e in n.whens] + ([n.other] if n.other else [])
        if n.of is None:
            other = self.value(n.other, scope) if n.other else ("'0'" if any(self.kind_of(e, scope) == "string" for e in branches) else "0")
            whens = " ".join(f"WHEN {self.truth(c, scope)} THEN {self.value(e, scope)}" for c, e in n.whens)
        else:
            other = self.value(n.other, scope) if n.other else "NULL"
            whens = " ".join(f"WHEN {self.compared(Node('binary', op='=', left=n.of, right=c), scope)} THEN {self.value(e, scope)}" for c, e in n.whens)
        return f"(CASE {whens} ELSE {other} END)"

    def column(self, n: Node, scope: Scope) -> str:
        parts = list(n.parts)
        if len(parts) == 1 and parts[0].startswith("__gen"):
            return parts[0]
        name, kinds, _, optional = annotated(parts[-1]) if n.quoted else (parts[-1], [], None, False)
        parts[-1] = name
        sql = self.path(parts, scope, optional)
        for kind in kinds:
            sql = builtins.cast(sql, kind)
        if scope.fill is not None and not scope.inside and self.text(n) not in scope.fill:
            if not (len(n.parts) == 1 and n.parts[0] in scope.named and scope.column(name)[0] is None):
                sql = f"min_by({sql}, {ORD})" if scope.ordered else f"first({sql})"
        return sql

    def path(self, parts: list[str], scope: Scope, optional: bool) -> str:
        """A column, a field inside one, or ``a.b.:0`` and slices as one name; a column of just that name comes first."""
        aliases = {a.lower(): a for a, _ in scope.sources}
        of = parts[0] if len(parts) > 1 and parts[0].lower() in aliases else None
        rest = parts[1:] if of else parts
        words = [w for p in rest for w in p.split(".")] if any("." in p or ":" in p for p in rest) else rest
        whole = ".".join(rest)
        prefix = f"{tick(of)}." if of else ""
        if len(rest) == 1 and ("." in rest[0] or ":" in rest[0] or optional) or (len(words) > 1):
            source, kind, known = scope.column(whole, of)
            if source is not None:
                return f"{tick(source)}.{tick(whole)}"
            for k in range(len(words), 0, -1):
                source, kind, _ = scope.column(".".join(words[:k]), of)
                if source is not None:
                    return self.fields(f"{tick(source)}.{tick('.'.join(words[:k]))}", kind, words[k:])
            if optional:
                return "NULL"
            if not known or not scope.sources:
                return prefix + ".".join(map(tick, words))
            return "NULL" if ":" in whole or len(words) > 1 else prefix + tick(whole)
        if rest[0] == ORD:
            return ORD
        source, _, _ = scope.column(rest[0], of)
        return prefix + tick(rest[0])

    def fields(self, sql: str, kind: T.DataType | None, words: list[str]) -> str:
        k = 0
        while k < len(words):
            if isinstance(kind, T.StructType):
                for end in range(len(words), k, -1):  # a field's own name may hold dots
                    if (name := ".".join(words[k:end])) in kind.fieldNames():
                        sql, kind, k = f"{sql}.{tick(name)}", kind[name].dataType, end
                        break
                else:
                    return "NULL"
            elif isinstance(kind, T.ArrayType) and words[k].startswith(":"):
                at = words[k][1:].split(":")
                if len(at) == 1:
                    sql, kind = f"try_element_at({sql}, {int(at[0]) + (int(at[0]) >= 0)})", kind.elementType
                else:
                    sql = self.sliced(sql, *at)
                k += 1
            elif isinstance(kind, T.ArrayType):
                inner = self.fields("x", kind.elementType, words[k:])
                return f"transform({sql}, x -> {inner})"
            elif isinstance(kind, T.StringType):
                path = "$" + "".join(f"[{w[1:]}]" if w.startswith(":") else f"['{w}']" for w in words[k:])
                return f"get_json_object({sql}, {quoted(path)})"
            else:
                return "NULL"
        return sql

    @staticmethod
    def sliced(sql: str, start: str = "", stop: str = "", step: str = "") -> str:
        """Python's slice of an array."""
        n, s = f"size({sql})", int(step or 1)
        clip = lambda x, lo, hi: f"least(greatest({x} + CASE WHEN {x} < 0 THEN {n} ELSE 0 END, {lo}), {hi})"
        if s > 0:
            a, b = clip(start or "0", "0", n), clip(stop, "0", n) if stop else n
            return f"(CASE WHEN {sql} IS NULL THEN NULL WHEN {a} < {b} THEN transform(sequence({a}, {b} - 1, {s}), i -> get({sql}, i)) ELSE slice({sql}, 1, 0) END)"
        a, b = clip(start, "-1", f"{n} - 1") if start else f"{n} - 1", clip(stop, "-1", f"{n} - 1") if stop else "-1"
        return f"(CASE WHEN {sql} IS NULL THEN NULL WHEN {a} > {b} THEN transform(sequence({a}, {b} + 1, {s}), i -> get({sql}, i)) ELSE slice({sql}, 1, 0) END)"

    # -- calls -----------------------------------------------------------------------------------

    def window(self, w: Node, scope: Scope) -> Node:
        if w.base is None:
            return w
        named = scope.windows.get(w.base)
        if named is None:
            raise SqlError(f"no window {w.base}")
        named = self.window(named, scope)
        return Node("window", base=None, part=w.part or named.part, order=w.order or named.order, frame=w.frame or named.frame)

    def over(self, w: Node, scope: Scope, frame: str | None = None, need_order: bool = False, reverse: bool = False) -> str:
        parts = []
        if w.part:
            parts.append("PARTITION BY " + ", ".join(self.value(p, scope) for p in w.part))
        if w.order:
            parts.append("ORDER BY " + ", ".join(self.value(e, scope) + (" DESC NULLS LAST" if bool(d) != reverse else " ASC NULLS FIRST") for e, d, _ in w.order))
        elif need_order:
            parts.append(f"ORDER BY {ORD if scope.ordered and scope.fill is None else f'min({ORD})' if scope.ordered else '1'}{' DESC' if reverse else ''}")
        if f := (frame if frame is not None else w.frame):
            parts.append(f)
        return f"OVER ({' '.join(parts)})"

    def call(self, n: Node, scope: Scope) -> str:
        low = n.name.lower()
        if id(n) in scope.generators:
            return scope.generators[id(n)]
        if self.is_aggregate(n) or (n.over is not None and low not in RANKS):
            inner = scope.inside
            scope.inside = n.over is None or scope.fill is None
            try:
                return self.aggregate(n, scope)
            finally:
                scope.inside = inner
        if low in RANKS:
            return self.ranked(n, scope)
        if low == "row_index":
            return f"row_number() OVER (ORDER BY {ORD})"
        if low == "row_last":
            return f"lag({self.value(n.args[0], scope)}) OVER (ORDER BY {ORD})"
        if low == "get_value":
            return self.get_value(n, scope)
        if low in ("add", "sub", "mul", "div", "mod") and len(n.args) == 2 and n.args[0].kind == "tuple":
            if n.args[1].kind == "tuple":
                pairs = ", ".join(builtins.call(low, [self.number_of(a, scope), self.number_of(b, scope)]) for a, b in zip(n.args[0].items, n.args[1].items))
                return f"array({pairs})"
            return f"transform({self.value(n.args[0], scope)}, x -> {builtins.call(low, ['x', self.number_of(n.args[1], scope)])})"
        if low == "if":
            a = [self.truth(n.args[0], scope), *(self.value(x, scope) for x in n.args[1:])]
            return builtins.call("if", a)
        if low == "not":
            return f"cast((NOT {self.truth(n.args[0], scope)}) AS int)"
        if low == "contains":
            a, b = (self.value(x, scope) for x in n.args)
            return f"cast({'array_contains' if self.is_array(n.args[0], scope) else 'contains'}({a}, {b}) AS int)"
        if low in ("convert_array", "convert_set"):
            v = self.value(n.args[0], scope)
            v = v if self.is_array(n.args[0], scope) else f"(CASE WHEN {v} IS NULL THEN NULL ELSE array({v}) END)"
            return f"array_distinct({v})" if low == "convert_set" else v
        if low == "exists" and len(n.args) == 1:
            v = self.value(n.args[0], scope)
            if self.is_array(n.args[0], scope):
                return f"cast(coalesce(size({v}) > 0, false) AS int)"
            return f"cast(coalesce({v} <> {quoted('') if self.kind_of(n.args[0], scope) == 'string' else '0' if self.kind_of(n.args[0], scope) == 'number' else 'NULL'}, {v} IS NOT NULL) AS int)"
        if low == "hex":
            v = self.value(n.args[0], scope)
            return f"concat('0x', lower(hex(cast({v} AS bigint))))" if self.kind_of(n.args[0], scope) == "number" else f"lower(hex({v}))"
        if low in ("pyeval", "pyevalt", "call_define", "jit"):
            return self.session.special(low, n, self, scope)
        args = [self.value(a, scope) for a in n.args]
        if low in ("add", "sub", "mul", "div", "mod"):
            args = [self.number_of(a, scope) for a in n.args]
        own = self.session.function(n.name, args)
        if own is not None:
            return own
        try:
            made = builtins.call(low, args)
        except IndexError:
            raise SqlError(f"{n.name} needs more arguments") from None
        return made if made is not None else f"{n.name}({', '.join(args)})"

    def get_value(self, n: Node, scope: Scope) -> str:
        words: list[str] = []
        for a in n.args[1:]:
            if a.kind == "string":
                words += a.text.split(".")
            elif a.kind == "number":
                words.append(":" + a.text)
            elif a.kind == "tuple":
                words.append(":" + ":".join("" if i.kind == "constant" else i.text for i in a.items))
        base = n.args[0]
        if base.kind == "column":
            return self.path([*base.parts[:-1], ".".join([base.parts[-1], *words])], scope, True)
        path = "$" + "".join(f"[{w[1:]}]" if w.startswith(":") else f"['{w}']" for w in words)
        return f"get_json_object({self.value(base, scope)}, {quoted(path)})"

    def aggregate(self, n: Node, scope: Scope) -> str:
        low = {"grouparray": "group_array", "groupuniqarray": "group_uniq_array", "groupbitand": "group_bit_and", "groupbitor": "group_bit_or", "groupbitxor": "group_bit_xor", "bit_and": "group_bit_and", "bit_or": "group_bit_or", "bit_xor": "group_bit_xor"}.get(n.name.lower(), n.name.lower())
        w = "" if n.over is None else " " + self.over(self.window(n.over, scope), scope, need_order=False)
        args = [self.value(a, scope) for a in n.args]
        x = args[0] if args else ""
        number = self.number_of(n.args[0], scope) if n.args and n.args[0].kind != "star" else x
        d = "DISTINCT " if n.distinct else ""
        at = ORD if scope.ordered else "0"
        if n.over is not None and scope.fill is not None and scope.ordered:
            at = f"min({ORD})"
        if low == "count":
            if id(n) in scope.ranked:
                return f"coalesce(max({scope.ranked[id(n)]}){w}, 0)"
            if n.over is not None and n.distinct:
                return f"cast(size(collect_set({x if len(args) == 1 else 'struct(' + ', '.join(args) + ')'}){w}) AS bigint)"
            return f"count({d}{', '.join(args)}){w}"
        if low in ("sum", "avg"):
            return f"coalesce({low}({d}{number}){w}, 0)"
        if low == "group_concat":
            if n.order and not n.over:
                keys = ", ".join(self.value(e, scope) + (" DESC" if down else "") for e, down, _ in n.order)
                return f"coalesce(listagg({d}cast({x} AS string), {quoted(n.separator if n.separator is not None else ',')}) WITHIN GROUP (ORDER BY {keys}), '')"
            items = f"array_sort(collect_set(cast({x} AS string)){w})" if n.distinct else f"transform(array_sort(collect_list(CASE WHEN {x} IS NOT NULL THEN struct({at} AS o, cast({x} AS string) AS v) END){w}), e -> e.v)"
            return f"array_join({items}, {quoted(n.separator if n.separator is not None else ',')})"
        listed = f"transform(array_sort(collect_list(CASE WHEN {x} IS NOT NULL THEN struct({at} AS o, {x} AS v) END){w}), e -> e.v)"
        if low == "group_array":
            return f"array_distinct({listed})" if n.distinct else listed
        if low == "group_uniq_array":
            return f"array_sort(collect_set({x}){w})"
        if low.startswith("group_bit_"):
            return f"{low[6:]}(cast({x} AS bigint)){w}"
        if low == "json_arrayagg":
            return f"to_json({listed})"
        if low == "json_objectagg":
            pairs = f"array_sort(collect_list(CASE WHEN {x} IS NOT NULL THEN struct(cast({x} AS string) AS k, {at} AS o, {args[1]} AS v) END){w})"
            # sorted by key, a key's first entry gives its place and its last the value
            heads = "filter(s, (e, i) -> i = 0 OR s[greatest(i - 1, 0)].k <> e.k)"
            tails = "filter(s, (e, i) -> i = size(s) - 1 OR s[least(i + 1, size(s) - 1)].k <> e.k)"
            entries = f"transform(array({pairs}), s -> array_sort(transform(arrays_zip({heads}, {tails}), z -> struct(z['0'].o AS o, z['0'].k AS k, z['1'].v AS v))))[0]"
            return f"to_json(map_from_entries(transform({entries}, e -> struct(e.k AS k, e.v AS v))))"
        if low == "any_value":
            return f"min_by({x}, {at}){w}" if scope.ordered else f"first({x}){w}"
        own = self.session.function(n.name, args)
        return f"{own or f'{n.name}({d}{", ".join(args)})'}{w}"

    def ranked(self, n: Node, scope: Scope) -> str:
        low = n.name.lower()
        if n.over is None:
            raise SqlError(f"{n.name} needs OVER")
        w = self.window(n.over, scope)
        args = [self.value(a, scope) for a in n.args]
        if low in ("first_value", "last_value", "nth_value"):
            over = self.over(w, scope, w.frame or FULL, need_order=True)
            if low != "nth_value":
                return f"{low}({args[0]}) {over}"
            at = args[1] if len(args) > 1 else "1"
            place = re.fullmatch(r"\(?(-?)(\d+)\)?", at.replace(" ", ""))
            if place and int(place[2]) and not w.frame:  # places from the end are places of the reversed order
                turned = self.over(w, scope, FULL, need_order=True, reverse=bool(place[1]))
                value = f"nth_value({args[0]}, {int(place[2])}) {turned}"
                return f"(CASE WHEN {int(place[2])} <= count(1) {over} THEN {value} ELSE {args[2]} END)" if len(args) > 2 else value
            rows = f"collect_list(struct({args[0]} AS v)) {over}"
            value = f"try_element_at({rows}, {at}).v"
            return f"(CASE WHEN abs({at}) <= size({rows}) THEN {value} ELSE {args[2]} END)" if len(args) > 2 else value
        over = self.over(w, scope, "", need_order=True)
        if low == "ntile":
            return f"CASE WHEN {args[0]} > 0 THEN ntile({args[0]}) {over} END" if not args[0].startswith("-") and args[0] != "0" else "cast(null AS int)"
        return f"{low}({', '.join(args)}) {over}"
