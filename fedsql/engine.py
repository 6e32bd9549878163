"""Running scripts: sessions, variables, temporary tables, functions.

``Engine.execute`` runs a script statement by statement and returns the last
query's DataFrame.  Tables are lazy DataFrames; what a statement does is one
Spark plan.  ``context()`` opens a scope whose variables, functions and
tables end with it and are looked up outwards.
"""

from __future__ import annotations

import ast
import importlib
import json
import os
import re
from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fedsql.functions import custom, udfs
from fedsql.functions.builtins import quoted
from fedsql.operators.merge import MODES, NAMES, delete, merge
from fedsql.operators.transforms import TRANSFORMS
from fedsql.plans.emitter import ORD, Emitter, Scope, annotated, tick
from fedsql.plans.lexer import SqlError, Statement, statements, substituted
from fedsql.plans.parser import Node, parse
from fedsql.session import checkpointed
from fedsql.sources import files

_counter = iter(range(10**12))
#: Rows that SELECT ... INTO @v may give at most; more is an error, as they become a value on the driver.
MOST_INTO = 100_000
#: Modules that pyeval's code can use; ``register_pyeval_module`` adds to them.
PYEVAL_MODULES = {m: importlib.import_module(m) for m in ("sys", "os", "math", "json", "re", "datetime", "time", "random", "string", "uuid", "base64", "hashlib", "pickle")}
#: Ending of a settings file -> how its text is read; ``register_parser`` adds to them.
PARSERS: dict[str, Callable[[str], dict]] = {}
#: Scheme of a settings file's address -> how its text is got; ``register_reader`` adds to them.
READERS: dict[str, Callable[[str], str]] = {}


class Session:
    """One scope; ``parent`` is looked at for what it doesn't have."""

    def __init__(self, spark: SparkSession, parent: Session | None = None, base: str = "") -> None:
        self.spark, self.parent, self.base = spark, parent, base or (parent.base if parent else "")
        self.tables: dict[str, DataFrame] = {}
        self.keys: dict[str, list[str]] = {}
        self.variables: dict[str, Any] = {}
        self.functions: dict[str, tuple[str, Any]] = {}
        self.modules: dict[str, Any] = {}
        self.databases: dict[str, dict] = {}
        self.views: dict[int, tuple[str, DataFrame]] = {}
        self.defines: dict[str, str] = {}
        self.settings: dict[str, dict] = {}
        self.folder = parent.folder if parent else ""  # Parquet tables by name
        self.pyeval_allowed = parent.pyeval_allowed if parent else False
        if parent is None:
            udfs.register(spark)

    # -- names -------------------------------------------------------------------------------------

    def fresh(self, kind: str) -> str:
        return f"fedsql_{kind}_{next(_counter)}"

    def _find(self, attribute: str, name: str) -> Any:
        s: Session | None = self
        while s is not None:
            d = getattr(s, attribute)
            if name in d:
                return d[name]
            s = s.parent
        return None

    @property
    def aggregates(self) -> set[str]:
        s, out = self, set()
        while s is not None:
            out |= {n for n, (k, _) in s.functions.items() if k == "aggregate"}
            s = s.parent
        return out

    def value(self, name: str) -> Any:
        s: Session | None = self
        while s is not None:
            if name in s.variables:
                return s.variables[name]
            s = s.parent
        return os.environ.get(name)

    def literal(self, v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return f"double('{v!r}')"
        if isinstance(v, (int, Decimal)):
            return str(v)
        if isinstance(v, datetime):
            return f"timestamp {quoted(v.isoformat(' '))}"
        if isinstance(v, date):
            return f"date {quoted(v.isoformat())}"
        if isinstance(v, (list, tuple, set)) and not any(isinstance(x, (list, dict)) for x in v):
            return f"array({', '.join(self.literal(x) for x in v)})"
        if isinstance(v, (list, dict)):
            return quoted(json.dumps(v, ensure_ascii=False, default=str))
        return quoted(str(v))

    # -- tables ------------------------------------------------------------------------------------

    def table(self, name: str, given: dict[tuple[str, str], str] | None = None) -> DataFrame:
        """The table of a name: temporary, of a file, a database or a virtual view; ``given`` are values for a view's arguments."""
        if name.startswith("raw:"):
            _, db, text = name.split(":", 2)
            return files.read_database(self.spark, self.database(db.split(".")[0]), query=files.bound_view(bytes.fromhex(text).decode(), given or {}))
        if name.startswith("@"):
            v = self.value(name.lstrip("@"))
            if not isinstance(v, str):
                raise SqlError(f"{name} names no table")
            return self.table(v)
        df = self._find("tables", name) if not files.is_path(name) else None
        if df is None:
            df = self._find("tables", name.removeprefix("--."))
        if df is not None:
            return df
        if name in ("_", "."):
            return files.read_stdin(self.spark, " ")
        if files.is_path(name):
            return files.read_file(self.spark, name, self.base)
        db, _, rest = name.partition(".")
        if rest and self._find("databases", db) is not None:
            config = self.database(db)
            view = self.view_text(name)
            if view is not None:
                return files.read_database(self.spark, config, query=files.bound_view(view, given or {}))
            return files.read_database(self.spark, config, table=rest)
        if self.folder and re.fullmatch(r"\w+", name):
            self.tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return self.tables[name]
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise SqlError(f"no table {name}")

    def view_text(self, name: str) -> str | None:
        """The query of a virtual view or raw query with its arguments; None if the name is none's."""
        if name.startswith("raw:"):
            return bytes.fromhex(name.split(":", 2)[2]).decode()
        db, _, rest = name.partition(".")
        config = self._find("databases", db) if rest else None
        views = (config or {}).get("virtual_views") or {}
        if isinstance(views, dict):
            own = views.get(rest)
        else:
            own = next((v for v in views if v.get("name") == rest), None)
        if isinstance(own, dict):
            text, ops = own.get("query", ""), {v: k for k, v in files.VIEW_OPS.items()} | {"==": "eq", "!=": "neq"}
            for arg in own.get("args") or []:  # a %s for each argument
                column, op, default = (*([arg] if isinstance(arg, str) else arg), "==", None)[:3] if isinstance(arg, str) else (*arg, None)[:3]
                column, op = (column, op) if isinstance(arg, list) else (column.rpartition("__")[0] or column, column.rpartition("__")[2] if "__" in column else "eq")
                text = text.replace("%s", "#{" + f"{column}__{ops.get(op, op)}" + (":" + json.dumps(default) if default is not None else "") + "}", 1)
            return text
        return own

    def database(self, name: str) -> dict:
        config = self._find("databases", name)
        if config is None:
            raise SqlError(f"no database {name}")
        sizes = {option: self.value(v) for option, v in (("fetchsize", "batch"), ("batchsize", "insert_batch")) if self.value(v)}  # @batch, @insert_batch
        return {**sizes, **config}

    def is_database_table(self, name: str) -> bool:
        db, _, rest = name.partition(".")
        return bool(rest) and not files.is_path(name) and self._find("tables", name) is None and self._find("databases", db) is not None

    def relation(self, name: str, given: dict[tuple[str, str], str] | None = None) -> tuple[str, T.StructType]:
        """A view's name and schema for a table's name."""
        name = annotated(name)[0] if ("<" in name or "[" in name) and not files.is_path(name) else name
        df = self.table(name, given)
        if id(df) not in self.views or self.views[id(df)][1] is not df:
            view = self.fresh("t")
            df.createOrReplaceTempView(view)
            self.views[id(df)] = (view, df)
        return self.views[id(df)][0], df.schema

    def view_of(self, df: DataFrame) -> str:
        view = self.fresh("t")
        df.createOrReplaceTempView(view)
        self.views[id(df)] = (view, df)
        return view

    def stored(self, view: str) -> int:
        """Bytes of the files that a view reads; 0 where it computes more than columns and filters, or reads no files."""
        df = self.spark.table(view)
        plan = df._jdf.queryExecution().optimizedPlan()

        def plain(p: Any) -> bool:
            return p.nodeName() in ("LogicalRelation", "Project", "Filter", "Union") and all(plain(p.children().apply(k)) for k in range(p.children().size()))

        return int(plan.stats().sizeInBytes()) if plain(plan) and not df.isStreaming and df.inputFiles() else 0

    def schema_of(self, sql: str) -> T.StructType | None:
        try:
            return self.spark.sql(sql).schema
        except Exception:  # noqa: BLE001  correlated text has no schema of its own
            return None

    # -- functions ---------------------------------------------------------------------------------

    def is_generator(self, name: str) -> bool:
        low = name.lower()
        f = self._find("functions", low)
        return low == "yield_array" or (f is not None and f[0] == "generator")

    def generator(self, n: Node, emitter: Emitter, scope: Scope) -> str:
        """The array a generator yields from; a single value yields itself."""
        f = self._find("functions", n.name.lower())
        if f is not None and f[0] == "generator":
            return f"{f[1]}({', '.join(emitter.value(a, scope) for a in n.args)})"
        a = n.args[0]
        if a.kind == "subquery":
            q = a.query
            name = q.items[0][1] or emitter.auto_name(q.items[0][0])
            return f"(SELECT collect_list({tick(name)}) FROM ({emitter.query(q, None)}))"
        v = emitter.value(a, scope)
        if a.kind in ("number", "string") or (a.kind == "column" and emitter.kind_of(a, scope) != "unknown"):
            return f"array({v})"
        return v

    def function(self, name: str, args: list[str]) -> str | None:
        """The SQL of a call to a session's function or an imported Python one; None if there is none."""
        f = self._find("functions", name.lower())
        if f is not None:
            return f"{f[1]}({', '.join(args)})"
        head, _, path = name.partition("$")
        module = self._find("modules", head)
        if module is None or not path:
            return None
        target = module
        for part in path.split("$"):
            target = getattr(target, part, None)
        if target is None:
            raise SqlError(f"no {path} in {head}")
        if not args:
            return self.literal(target() if callable(target) else target)
        self.register(name.lower(), target, ("float" if getattr(target, "__module__", "") == "math" else None))
        return f"{self.functions[name.lower()][1]}({', '.join(args)})"

    def register(self, name: str, f: Callable, kind: str | T.DataType | None = None) -> None:
        """A Python function by its annotations' type, text if it has none."""
        back = kind or getattr(f, "__annotations__", {}).get("return")
        back = None if back in (Any, "Any", object, "object") else back
        sql = {int: "bigint", float: "double", bool: "boolean", str: "string", bytes: "binary", "int": "bigint", "float": "double"}.get(back, back if isinstance(back, (str, T.DataType)) else "string")
        own = self.fresh("f")

        def safe(*args: Any) -> Any:
            try:
                out = f(*args)
            except Exception:  # noqa: BLE001  scalar functions never raise
                return None
            return str(out) if sql == "string" and out is not None and not isinstance(out, str) else out

        self.spark.udf.register(own, F.udf(safe, sql, useArrow=True))
        self.functions[name.lower()] = ("scalar", own)

    def register_aggregate(self, name: str, fold: Callable[[list], Any], kind: str = "double") -> None:
        """``fold`` gets a group's values, or is a class of :mod:`custom`; it runs as a grouped-aggregate function over Arrow batches."""
        own, fold = self.fresh("a"), custom.fold_of(fold, name)
        import pandas as pd

        def over(values: pd.Series) -> Any:
            return fold([v for v in values if v is not None and v == v])

        over.__annotations__ = {"values": pd.Series, "return": {"double": float, "bigint": int, "string": str}.get(kind, float)}
        self.spark.udf.register(own, F.pandas_udf(over, kind))
        self.functions[name.lower()] = ("aggregate", own)

    def register_window(self, name: str, fold: Callable[[list], Any], kind: str = "double") -> None:
        """``fold`` gets the values of the rows in the window's frame, or is a class of :mod:`custom`."""
        self.register_aggregate(name, custom.window_fold_of(fold, name), kind)

    def register_generator(self, name: str, f: Callable, kind: str = "string") -> None:
        own = self.fresh("g")
        self.spark.udf.register(own, F.udf(lambda *a: list(f(*a)), f"array<{kind}>", useArrow=True))
        self.functions[name.lower()] = ("generator", own)

    def register_transform(self, name: str, f: Callable[..., DataFrame]) -> None:
        """A function from a DataFrame, and constants, to a DataFrame."""
        self.functions[name.lower()] = ("transform", f)

    def special(self, name: str, n: Node, emitter: Emitter, scope: Scope) -> str:
        if name == "jit":
            return emitter.value(n.args[0], scope)
        if name == "call_define":
            define = self._find("defines", n.args[0].text)
            if define is None:
                raise SqlError(f"no define {n.args[0].text}")
            args = [emitter.value(a, scope) for a in n.args[1:]]
            return "(" + re.sub(r"\$(\d+)", lambda m: args[int(m[1]) - 1], define) + ")"
        if not self.pyeval_allowed:
            raise SqlError("pyeval is off; Engine(pyeval=True) allows it")
        this = name == "pyevalt"  # pyevalt(this, code, ...)
        code = n.args[1 if this else 0].text
        key = f"{name}:{code}"
        if self._find("functions", key.lower()) is None:
            modules, parts = dict(PYEVAL_MODULES), [m for m, x in PYEVAL_MODULES.items() if custom.is_module(x)]
            for m in parts:
                modules.pop(m)  # a module is found again by its name where the code runs
            named = {m: PYEVAL_MODULES[m].__name__ for m in parts}

            def run(*a):  # noqa: ANN002, ANN202
                names = {**modules, **{m: importlib.import_module(x) for m, x in named.items()}}
                return eval(code, names, {"this": a[0], "args": a[1:]} if this else {"args": a, **{f"a{i}": x for i, x in enumerate(a)}})  # noqa: S307

            self.register(key, run)
        own = self._find("functions", key.lower())[1]
        rest = [emitter.value(a, scope) for k, a in enumerate(n.args) if k != (1 if this else 0)]
        return f"{own}({', '.join(rest)})" if rest else self.literal(eval(code, dict(PYEVAL_MODULES)))  # noqa: S307

    def assignment(self, n: Node, emitter: Emitter, scope: Scope) -> str:
        """``@a := expr`` once for a query without rows, and the counter ``@a := @a + x`` over its rows' order."""
        name, e = n.left.name, n.right
        if not scope.sources:
            row = self.spark.sql(f"SELECT {emitter.value(e, scope)} AS v").first()
            self.variables[name] = row.v
            return self.literal(row.v)
        if e.kind == "binary" and e.op in ("+", "-") and e.left.kind == "variable" and e.left.name == name:
            start = self.literal(self.value(name) or 0)
            return f"({start} {e.op} sum({emitter.value(e.right, scope)}) OVER (ORDER BY {ORD}))"
        if e.kind == "call" and e.name.lower() == "if" and e.args[1].kind == "variable" and e.args[1].name == name and e.args[2].kind == "binary":
            step = e.args[2].right if e.args[2].op != ":=" else e.args[2].right.right
            start = self.literal(self.value(name) or 0)
            return f"({start} + sum(CASE WHEN {emitter.truth(e.args[0], scope)} THEN 0 ELSE {emitter.value(step, scope)} END) OVER (ORDER BY {ORD}))"
        if not reads(e, name):  # nothing goes from row to row
            return emitter.value(e, scope)
        raise SqlError("an assignment over rows that reads itself must be a counter: @a := @a + x")

    def pipeline(self, n: Node, emitter: Emitter) -> str | None:
        """``SELECT f(constants) FROM (query)`` with a table function gives that function's table."""
        if len(n.items) != 1 or n.items[0][0].kind != "call" or len(n.sources) != 1:
            return None
        e = n.items[0][0]
        low = e.name.lower()
        own = self._find("functions", low)
        f = own[1] if own is not None and own[0] == "transform" else TRANSFORMS.get(low.removeprefix("transform$")) if low.startswith("transform$") else None
        if f is None:
            return None
        args = [a.text if a.kind in ("string", "number") else a.parts[-1] for a in e.args if a.kind in ("string", "number", "column")]
        rel, _, _ = emitter.relation(n.sources[0])
        return f"SELECT * FROM {tick(self.view_of(f(self.spark.sql(f'SELECT * FROM {rel}'), *args)))}"


def reads(n: Node, name: str) -> bool:
    return (n.kind == "variable" and n.name == name) or any(reads(c, name) for c in n.children())


class Engine:
    """Scripts over Spark."""

    def __init__(self, spark: SparkSession | None = None, base: str = "", pyeval: bool = False, config: dict | None = None) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.session = Session(self.spark, base=base)
        self.session.pyeval_allowed = pyeval
        self.running = True
        if config:
            self.configure(config)

    @classmethod
    def _scoped(cls, session: Session) -> Engine:
        e = cls.__new__(cls)
        e.spark, e.session, e.running = session.spark, session, True
        return e

    # -- settings ----------------------------------------------------------------------------------

    def configure(self, config: dict) -> None:
        """databases, imports, variables, defines, extensions, executes; later settings win."""
        for d in config.get("databases") or []:
            self.session.databases[d["name"]] = d
        for name, module in (config.get("imports") or {}).items():
            self.session.modules[name] = importlib.import_module(module)
        self.session.variables.update(config.get("variables") or {})
        self.session.defines.update(config.get("defines") or {})
        for m in config.get("extensions") or []:
            importlib.import_module(m)
        for path in config.get("executes") or []:
            self.execute_file(path)

    @staticmethod
    def load_config(*paths: str) -> dict:
        """Settings of YAML or JSON files, each over those before it and over what it extends."""
        import yaml

        out: dict = {}
        for p in paths:
            scheme = p.partition("://")[0] if "://" in p else ""
            if scheme in READERS:
                text = READERS[scheme](p)
            elif Path(p).exists():
                text = Path(p).read_text()
            else:
                continue
            own = PARSERS.get(Path(p).suffix.lower(), yaml.safe_load)(text) or {}
            for x in own.pop("extends", []) or []:
                own = Engine.load_config(str(Path(p).parent / x)) | own
            for k, v in own.items():
                out[k] = {**out[k], **v} if isinstance(v, dict) and isinstance(out.get(k), dict) else v
        return out

    def use(self, name: str, f: Any) -> None:
        """A function, a class with ``calculate``, or a module to call functions of."""
        if custom.is_module(f):
            self.session.modules[name] = f
        else:
            self.session.register(name, custom.scalar_of(f, name))

    register_calculater = use

    def register_mysql_func(self, name: str, f: Callable) -> None:
        """A function in place of the built-in one of its name, for all scopes."""
        if not callable(f) or isinstance(f, type):
            raise TypeError("a function is needed")
        root = self.session
        while root.parent is not None:
            root = root.parent
        root.register(name, f)

    @staticmethod
    def register_pyeval_module(name: str, module: Any) -> None:
        PYEVAL_MODULES[name] = module

    def register_database(self, source: type) -> None:
        """A ``pyspark.sql.datasource.DataSource``: databases whose driver has its name are read and written through it."""
        self.spark.dataSource.register(source)

    register_loader = register_outputer = register_database

    @staticmethod
    def register_parser(ending: str, f: Callable[[str], dict]) -> None:
        PARSERS[ending.lower()] = f

    @staticmethod
    def register_reader(scheme: str, f: Callable[[str], str]) -> None:
        READERS[scheme] = f

    register_aggregate = property(lambda self: self.session.register_aggregate)
    register_window = property(lambda self: self.session.register_window)
    register_generator = property(lambda self: self.session.register_generator)
    register_transform = property(lambda self: self.session.register_transform)

    def get_database(self, name: str) -> Database:
        """A configured database, to read tables and queries of and write rows into."""
        return Database(self.session, self.session.database(name))

    def context(self) -> Engine:
        return Engine._scoped(Session(self.spark, self.session))

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for view, _ in self.session.views.values():
            self.spark.catalog.dropTempView(view)
        self.session.views.clear()
        self.session.tables.clear()

    def terminate(self) -> None:
        self.running = False

    def get_variable(self, name: str, default: Any = None) -> Any:
        v = self.session.value(name)
        return default if v is None else v

    def set_variable(self, name: str, value: Any) -> None:
        self.session.variables[name] = value

    def register_table(self, name: str, df: DataFrame) -> None:
        self.session.tables[name] = df

    def push_memory_datas(self, name: str, rows: list[dict]) -> None:
        keys = list(dict.fromkeys(k for r in rows for k in r))
        self.session.tables[name] = self.spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], keys)

    def get_memory_datas(self, name: str) -> list[dict]:
        df = self.session._find("tables", name)
        return [] if df is None else [r.asDict(True) for r in df.collect()]

    def pop_memory_datas(self, name: str) -> list[dict]:
        rows = self.get_memory_datas(name)
        self.session.tables.pop(name, None)
        return rows

    # -- running -----------------------------------------------------------------------------------

    def execute(self, script: str) -> DataFrame | None:
        out = None
        for s in statements(substituted(script, lambda name, default: str(self.get_variable(name, default)))):
            if not self.running:
                break
            out = self.run(s)
        return out

    def execute_file(self, path: str) -> DataFrame | None:
        p = path if path.startswith("/") or not self.session.base else f"{self.session.base}/{path}"
        if not p.endswith((".sql", ".sqlx")):
            raise SqlError(f"only SQL scripts can be executed, not {path}")
        return self.execute(Path(p).read_text())

    def run(self, s: Statement | str) -> DataFrame | None:
        sql = s.sql if isinstance(s, Statement) else s
        try:
            return self._run(parse(sql))
        except (AnalysisException, ParseException) as e:
            raise SqlError(f"line {s.line if isinstance(s, Statement) else 1}: {str(e).splitlines()[0]}") from e
        except SqlError as e:
            raise SqlError(f"line {s.line if isinstance(s, Statement) else 1}: {e}") from None

    def sql_of(self, script: str) -> str:
        """The Spark SQL of one query."""
        return Emitter(self.session).query(parse(script))

    def frame(self, n: Node) -> DataFrame:
        emitter = Emitter(self.session)
        df = self.spark.sql(emitter.query(n))
        limit = getattr(n, "limit", None)
        if limit is not None and limit.kind == "number" and limit.text.startswith("-"):
            df = checkpointed(df)  # worked out once, counted and cut
            df = df.limit(max(df.count() + int(limit.text), 0))
        most = self.session.value("limit")
        if isinstance(most, (int, float)) and most > 0:  # SET @limit
            df = df.limit(int(most))
        if self.session.value("verbose") in (1, True, "1", "true"):
            df.explain("formatted")
        return df

    def _run(self, n: Node) -> DataFrame | None:
        k = n.kind
        if k in ("select", "setop", "with", "values"):
            into = getattr(n, "into", None)
            df = self.frame(n)
            if into:
                self.session.variables[into[0].lstrip("@")] = shaped(df)
                return None
            return df
        if k == "insert":
            return self._insert(n)
        if k == "update":
            return self._update(n)
        if k == "delete":
            name, _ = self._target(n.table)
            cond = "true" if n.where is None else Emitter(self.session).truth(n.where, self._scope(name))
            self._store(name, delete(self.session.table(name), cond))
            return None
        if k == "set":
            return self._set(n)
        if k == "use":
            module, _, alias = n.text.partition(" as ")
            self.session.modules[(alias or module).strip()] = importlib.import_module(module.strip())
            return None
        if k == "execute":
            return Engine._scoped(Session(self.spark, self.session)).execute_file(n.path)
        if k == "explain":
            df = self._run(n.query)
            if df is not None:
                df.explain("formatted")
            return df
        if k == "show":
            return self._show(n.what)
        raise SqlError(f"can't run {k}")

    def _scope(self, name: str) -> Scope:
        scope = Scope()
        scope.sources = []
        _, schema = self.session.relation(name)
        scope.sources = [("", schema)]
        return scope

    def _target(self, t: Node) -> tuple[str, str]:
        name, _, option, _ = annotated(t.name)
        if files.is_path(t.name) and option and option.upper() not in (*MODES, *NAMES):
            name, option = t.name, None  # the format of a file
        mode = (t.mode or option or self.session.value("use_output_type") or self.session.value("use_output") or "I").upper()
        return name.removeprefix("--."), NAMES.get(mode, mode)

    def _store(self, name: str, df: DataFrame) -> None:
        """The table's new content.  A table derived from itself is checkpointed, so that plans don't grow with each write."""
        if files.is_path(name):
            files.write_file(checkpointed(df), name, self.session.base)
            return
        if self.session.is_database_table(name):
            db, _, rest = name.partition(".")
            files.write_database(checkpointed(df), self.session.database(db), rest, "overwrite")
            return
        s: Session | None = self.session
        while s is not None and name not in s.tables:
            s = s.parent
        (s or self.session).tables[name] = checkpointed(df)

    def _insert(self, n: Node) -> None:
        name, mode = self._target(n.table)
        q = n.query
        df = self.frame(q)
        first = q.query if q.kind == "with" else q
        while first.kind == "setop":
            first = first.left
        names = n.columns
        if names is None and first.kind == "values" and (old := self.session._find("tables", name)) is not None:
            names = old.columns[: len(df.columns)]
        keys: list[str] = []
        if first.kind == "select":
            for e, a in first.items:
                label, _, option, _ = annotated(a if a else e.parts[-1] if e.kind == "column" else "")
                if option == "pk":
                    keys.append(label)
            if not keys and (plain := next((a or e.parts[-1] for e, a in first.items if e.kind == "column"), None)):
                keys = [annotated(plain)[0]]
        if names:
            plain = [annotated(c) for c in names]
            keys = [c for c, _, o, _ in plain if o == "pk"] or keys or [plain[0][0]]
            df = df.toDF(*(c for c, *_ in plain))
        if name in ("_", "-.&1"):
            df.show(truncate=False)
            return
        keys = keys or self.session.keys.get(name) or df.columns[:1]
        self.session.keys[name] = keys
        inside = self._key_scope(first, keys) if mode in ("UDI", "DI") else None
        if files.is_path(name):
            if mode == "I":
                whole = files.append_file(self.spark, df, name, self.session.base)
                if whole is not None:
                    self._store(name, whole)
                return
            old = files.read_file(self.spark, name, self.session.base) if files.exists(self.spark, name, self.session.base) else None
            self._store(name, merge(old, df, keys, mode, inside))
            return
        if self.session.is_database_table(name):
            db, _, rest = name.partition(".")
            if mode == "I":
                files.write_database(df, self.session.database(db), rest)
                return
            self._store(name, merge(self.session.table(name), df, keys, mode, inside))
            return
        self._store(name, merge(self.session._find("tables", name), df, keys, mode, inside))

    def _key_scope(self, q: Node, keys: list[str]) -> str | None:
        """The conditions of a query that are on its key alone, in the target's names: what a write may delete."""
        if q.kind != "select" or q.where is None:
            return None
        named = {e.parts[-1]: a or e.parts[-1] for e, a in q.items if e.kind == "column"}
        parts: list[Node] = []

        def gather(n: Node) -> None:
            if n.kind == "binary" and n.op == "and":
                gather(n.left)
                gather(n.right)
            else:
                parts.append(n)

        def columns(n: Node) -> list[Node]:
            return [n] if n.kind == "column" else [c for x in n.children() for c in columns(x)]

        def renamed(n: Node) -> Node:
            return Node("column", parts=[annotated(named.get(n.parts[-1], n.parts[-1]))[0]], quoted=True) if n.kind == "column" else n.mapped(renamed)

        gather(q.where)
        own = [renamed(p) for p in parts if columns(p) and all(annotated(named.get(c.parts[-1], c.parts[-1]))[0] in keys for c in columns(p))]
        if not own:
            return None
        emitter, scope = Emitter(self.session), Scope()
        return " AND ".join(emitter.truth(p, scope) for p in own)

    def _update(self, n: Node) -> None:
        """Rewritten to a select of the key and the new values, merged in mode U."""
        name = annotated(n.tables[0].name)[0]
        alias = n.tables[0].alias or name
        same = lambda a, b: a.kind == "column" and b.kind == "column" and a.parts[-1] == b.parts[-1]
        keys = [a.parts[-1] for a, b in n.pairs if same(a, b)]
        items = [(b, annotated(a.parts[-1])[0]) for a, b in n.pairs]
        if not keys:  # without a declared key, rows are rewritten where the condition holds
            if len(n.tables) > 1:
                raise SqlError("an UPDATE of several tables needs its key set to itself")
            df, scope, emitter = self.session.table(name), self._scope(name), Emitter(self.session)
            scope.sources = [(alias, df.schema)]
            cond = emitter.truth(n.where, scope) if n.where is not None else "true"
            new = {c: emitter.value(e, scope) for e, c in items}
            view = self.session.view_of(df)
            self._store(name, self.spark.sql("SELECT " + ", ".join(f"CASE WHEN {cond} THEN {new[c]} ELSE {tick(alias)}.{tick(c)} END AS {tick(c)}" if c in new else f"{tick(alias)}.{tick(c)}" for c in df.columns) + f" FROM {tick(view)} AS {tick(alias)}"))
            return
        q = Node("select", distinct=False, items=items, into=None, sources=n.tables, where=n.where, group=[], how=None, having=None, windows=[], order=[], limit=None, offset=None)
        self._store(name, merge(self.session.table(name), self.frame(q), keys, "U"))

    def _set(self, n: Node) -> None:
        name = n.name
        target = self.session
        if n.scope == "global":
            while target.parent is not None:
                target = target.parent
        if name.startswith("config.databases.") or name.startswith("databases."):
            path = name.split("databases.", 1)[1].split(".")
            at = target.databases.setdefault(path[0], {"name": path[0]})
            for p in path[1:-1]:
                at = at.setdefault(p, {})
            value = self._constant(n)
            if len(path) > 1:
                if value is None:
                    at.pop(path[-1], None)
                else:
                    at[path[-1]] = value
            elif isinstance(value, dict):
                at.update(value)
            return
        if name.startswith(("defines.", "config.defines.")):
            target.defines[name.split("defines.", 1)[1]] = str(self._constant(n))
            return
        if name.startswith(("imports.", "config.imports.")):
            target.modules[name.split("imports.", 1)[1]] = importlib.import_module(str(self._constant(n)))
            return
        if m := re.match(r"config\.(options|caches|sources|variables)\.(.+)", name):
            value = self._constant(n)
            if m[1] == "variables":
                target.variables[m[2]] = value
            elif value is None:
                target.settings.get(m[1], {}).pop(m[2], None)
            else:
                target.settings.setdefault(m[1], {})[m[2]] = value
                if m[1] == "options" and m[2].startswith("spark."):
                    self.spark.conf.set(m[2], str(value))
            return
        target.variables[name] = self._constant(n)

    def _constant(self, n: Node) -> Any:
        v = n.value
        if v.kind == "string":
            return v.text
        if v.kind == "number":
            return ast.literal_eval(v.text)
        if v.kind == "constant":
            return {"null": None, "true": True, "false": False}[v.text]
        if v.kind == "tuple" and all(i.kind in ("number", "string") for i in v.items):
            return [i.text if i.kind == "string" else ast.literal_eval(i.text) for i in v.items]
        if v.kind == "subquery":
            return shaped(self.frame(v.query))
        emitter = Emitter(self.session)
        return self.spark.sql(f"SELECT {emitter.value(v, Scope())} AS v").first().v

    def _show(self, what: str) -> DataFrame:
        s: Session | None = self.session
        rows: dict[str, str] = {}
        while s is not None:
            for name, x in (s.databases if what == "databases" else s.modules if what == "imports" else s.tables if what == "tables" else {}).items():
                rows.setdefault(name, x.get("driver", "") if isinstance(x, dict) else getattr(x, "__name__", type(x).__name__))
            s = s.parent
        return self.spark.createDataFrame(sorted(rows.items()), "name string, value string")


def shaped(df: DataFrame) -> Any:
    """A small result as a value: one cell, a list of a column, a dict of a row, a list of dicts, or None."""
    rows = [r.asDict(True) for r in df.limit(MOST_INTO + 1).collect()]
    if len(rows) > MOST_INTO:
        raise SqlError(f"more than {MOST_INTO} rows can't become a value")
    if not rows:
        return None
    if len(df.columns) == 1:
        column = [next(iter(r.values())) for r in rows]
        return column[0] if len(column) == 1 else column
    return rows[0] if len(rows) == 1 else rows


class Database:
    """What a script's database is to Python code."""

    def __init__(self, session: Session, config: dict) -> None:
        self.session, self.config = session, config

    def table(self, name: str) -> DataFrame:
        return files.read_database(self.session.spark, self.config, table=name)

    def query(self, sql: str) -> DataFrame:
        return files.read_database(self.session.spark, self.config, query=sql)

    def insert(self, name: str, df: DataFrame) -> None:
        files.write_database(df, self.config, name)


_default: list[Engine] = []


def instance() -> Engine:
    """The engine that the functions of this module use."""
    if not _default:
        _default.append(Engine())
    return _default[0]


def execute(script: str) -> DataFrame | None:
    return instance().execute(script)


def get_variable(name: str, default: Any = None) -> Any:
    return instance().get_variable(name, default)


def set_variable(name: str, value: Any) -> None:
    instance().set_variable(name, value)


def use(name: str, f: Any) -> None:
    instance().use(name, f)


def get_database(name: str) -> Database:
    return instance().get_database(name)


def get_memory_datas(name: str) -> list[dict]:
    return instance().get_memory_datas(name)


def pop_memory_datas(name: str) -> list[dict]:
    return instance().pop_memory_datas(name)


def push_memory_datas(name: str, rows: list[dict] | dict) -> None:
    instance().push_memory_datas(name, rows if isinstance(rows, list) else [rows])


def terminal() -> None:
    instance().terminate()


def close() -> None:
    if _default:
        _default.pop().close()
