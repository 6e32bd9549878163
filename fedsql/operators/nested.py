"""Nested records taken apart into flat child tables.

Every node of a record gets a Dewey label: the ordinals on the way to it,
from the record's root.  Cutting a label's last part gives its parent
(:func:`parents`), cutting it behind its last array gives the element a value
belongs to and so its place and its owner (:func:`elements`), and nodes with
one schema path form one table.  Typed columns are taken apart by expressions
built from the schema, all paths in one pass that reads only their leaves
(:func:`shred`); JSON text, whose shape may differ from row to row, by a walk
over each document (:func:`shred_json`).

Defined results: a null struct, array or element has no node, but elements
after it keep their ordinal; an empty array has no children; text that is no
valid JSON has no nodes; NaN and Infinity are no valid JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = "parent_key string, path string, dewey array<int>, value string"


def schema_paths(kind: T.DataType, at: tuple[str, ...] = ()) -> dict[str, tuple[str, ...]]:
    """Each leaf's schema path; ``[]`` stands for an array's elements.  Field names may hold dots, so paths are joined by ``/``."""
    if isinstance(kind, T.StructType):
        return {k: v for f in kind.fields for k, v in schema_paths(f.dataType, (*at, f.name)).items()}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, (*at, "[]"))
    return {"/".join(at): at}


def _leaves(at: Column, kind: T.DataType, path: tuple[str, ...]) -> Column:
    """The values of a path, in arrays nested as those on the path; a field of an array's structs is read by itself."""
    if not path:
        return at
    if path[0] != "[]":
        return _leaves(at.getField(path[0]), kind[path[0]].dataType, path[1:])
    if path[1:] and path[1] != "[]":
        rest = path[2:]
        field = at.getField(path[1])
        return F.transform(field, lambda x: _leaves(x, kind.elementType[path[1]].dataType, rest)) if rest else field
    return F.transform(at, lambda x: _leaves(x, kind.elementType, path[1:])) if path[1:] else at


def _labelled(at: Column, kind: T.DataType, path: tuple[str, ...], whole: str, label: tuple[Column, ...] = ()) -> Column:
    """The nodes of a path's :func:`_leaves`, as an array: a label's parts are a field's place in its struct and an element's in its array."""
    if not path:
        return F.array(F.struct(F.lit(whole).alias("path"), F.array(*label).alias("dewey"), at.cast("string").alias("value")))
    if path[0] == "[]":
        return F.flatten(F.transform(F.coalesce(at, F.array()), lambda x, i: _labelled(x, kind.elementType, path[1:], whole, (*label, i))))
    return _labelled(at, kind[path[0]].dataType, path[1:], whole, (*label, F.lit(kind.fieldNames().index(path[0]))))


def shred(df: DataFrame, key: Column, paths: Sequence[tuple[str, ...]]) -> DataFrame:
    """:data:`NODES` of every value at the paths that is not null, in one pass.  Records equal in key and leaves are one."""
    leaves = {f"__{k}": _leaves(F.col(f"`{p[0]}`"), df.schema[p[0]].dataType, p[1:]) for k, p in enumerate(paths)}
    rows = df.select(key.cast("string").alias("parent_key"), *(c.alias(n) for n, c in leaves.items())).distinct()
    nodes = F.concat(*(_labelled(F.col(n), df.schema, p, "/".join(p)) for n, p in zip(leaves, paths)))
    return rows.select("parent_key", F.inline(nodes)).filter("value is not null")


class _Raw(str):
    """A number as it is written."""


def _refuse(_: str) -> None:
    raise ValueError


def _loads(text: str) -> object:
    return json.loads(text, parse_int=_Raw, parse_float=_Raw, parse_constant=_refuse)


def _meant(x: object) -> object:
    """Text that is itself JSON stands for what it says; other text, and numbers, for themselves."""
    while isinstance(x, str) and not isinstance(x, _Raw) and (s := x.strip()) and (s[0] in '[{"' or s == "null"):
        try:
            x = _loads(s)
        except (ValueError, RecursionError):
            break
    return x


def walk(doc: object, arrays: frozenset[tuple[str, ...]]) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], str]]:
    """(path, Dewey label, text) of each leaf; arrays: the paths at which a single value is its array's only element."""
    stack: list[tuple[object, tuple[str, ...], tuple[int, ...]]] = [(doc, (), ())]
    while stack:
        x, path, label = stack.pop()
        x = _meant(x)
        if x is None:
            continue
        if path in arrays and not isinstance(x, list):
            x = [x]
        if isinstance(x, dict):
            stack += [(v, (*path, k), (*label, i)) for i, (k, v) in enumerate(x.items())]
        elif isinstance(x, list):
            stack += [(v, (*path, "[]"), (*label, i)) for i, v in enumerate(x)]
        else:
            yield path, label, ("true" if x else "false") if isinstance(x, bool) else str(x).encode("utf-8", "replace").decode()


def shred_json(df: DataFrame, key: Column, text: Column, arrays: list[tuple[str, ...]], wanted: list[tuple[str, ...]] | None = None) -> DataFrame:
    """:data:`NODES` of JSON texts, of all paths or the wanted ones."""
    at = frozenset(arrays)
    keep = None if wanted is None else set(wanted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f["parent_key"], f["text"]):
                try:
                    doc = _loads(t) if t is not None else None
                except (ValueError, RecursionError):
                    continue
                out += [(k, "/".join(p).encode("utf-8", "replace").decode(), list(label), v) for p, label, v in walk(doc, at) if keep is None or p in keep]
            yield pd.DataFrame(out, columns=["parent_key", "path", "dewey", "value"])

    return df.select(key.cast("string").alias("parent_key"), text.alias("text")).mapInPandas(run, NODES)


def parents(nodes: DataFrame) -> DataFrame:
    """Nodes with their parent's label and path: the own ones without the last part."""
    cut = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    return nodes.withColumn("parent_dewey", cut(F.col("dewey"))).withColumn("parent_path", F.array_join(cut(F.split("path", "/")), "/"))


def elements(nodes: DataFrame) -> DataFrame:
    """Nodes inside arrays with their element, place and owner, from labels alone.

    ``element``: the label cut behind the path's last ``[]``; ``pos``: its last part, the place in the array;
    ``owner``: the label of what holds the array, that is the element's without its place and the array's own part
    (empty for the record).  Nodes in no array are left out.
    """
    steps = F.reverse(F.split("path", "/"))
    below = F.array_position(steps, "[]").cast("int")  # parts from the element on down, one for the element itself
    depth = F.size("dewey") - below + 1
    return (
        nodes.withColumn("below", below).filter("below > 0").withColumn("element", F.slice("dewey", 1, depth))
        .withColumn("pos", F.element_at("element", -1)).withColumn("owner", F.slice("element", 1, F.greatest(F.size("element") - 2, F.lit(0)))).drop("below")
    )
