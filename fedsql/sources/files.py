"""Tables in files and databases."""

from __future__ import annotations

import json
import re
import sys
from pathlib import Path
from urllib.parse import parse_qs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fedsql.plans.lexer import SqlError

FORMATS = {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".parquet": "parquet", ".orc": "orc", ".txt": "text", ".log": "text", ".xls": "excel", ".xlsx": "excel"}
#: JDBC address of each database kind; others name a Spark format in ``driver``.
JDBC = {"mysql": "jdbc:mysql://{host}:{port}/{db}", "postgresql": "jdbc:postgresql://{host}:{port}/{db}", "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={db}", "oracle": "jdbc:oracle:thin:@{host}:{port}/{db}", "clickhouse": "jdbc:clickhouse://{host}:{port}/{db}", "sqlite": "jdbc:sqlite:{db}", "derby": "jdbc:derby:{db}"}
PORTS = {"mysql": 3306, "postgresql": 5432, "sqlserver": 1433, "oracle": 1521, "clickhouse": 8123}
VENDOR = {"mongo": "mongodb", "elasticsearch": "org.elasticsearch.spark.sql", "redis": "org.apache.spark.sql.redis", "influxdb": "influxdb"}


def is_path(name: str) -> bool:
    bare = re.sub(r"<\w+>$", "", name.split("?")[0])
    return name.startswith("file://") or Path(bare).suffix.lower() in FORMATS


def split_path(name: str, base: str = "") -> tuple[str, str, dict[str, str]]:
    """(path, format, parameters) of ``dir/x.csv?sep=;``."""
    if m := re.search(r"<(csv|json|richtable|print)>$", name):  # the format said beside the name
        name = name[: m.start()] + ("&" if "?" in name else "?") + f"format={m[1]}"
    bare, _, query = name.partition("?")
    params = {k: v[-1] for k, v in parse_qs(query, keep_blank_values=True).items()}
    path = bare.removeprefix("file://")
    kind = params.pop("format", None) or ("text" if "sep" in params and Path(path).suffix.lower() not in (".csv",) else FORMATS.get(Path(path).suffix.lower(), "text"))
    if base and "://" not in bare and not path.startswith("/"):
        path = f"{base.rstrip('/')}/{path}"
    return path, kind, params


def _status(spark: SparkSession, path: str):  # noqa: ANN202
    """Hadoop's status of a path, None if there is nothing."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(at) if fs.exists(at) else None


def exists(spark: SparkSession, name: str, base: str = "") -> bool:
    return _status(spark, split_path(name, base)[0]) is not None


def _one_document(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file is one document over several lines; a folder of part files has one in each line."""
    status = _status(spark, path)
    if status is None or status.isDirectory():
        return False
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    try:
        return not isinstance(json.loads(first[0].value), dict) if first else False
    except ValueError:
        return True


def read_file(spark: SparkSession, name: str, base: str = "") -> DataFrame:
    path, kind, params = split_path(name, base)
    if kind in ("json", "richtable") and "*" not in path:
        return spark.read.option("multiLine", _one_document(spark, path)).json(path)
    if kind in ("json", "jsonl", "richtable"):
        return spark.read.option("multiLine", kind == "json").json(path)
    if kind == "csv":
        return spark.read.options(header=True, inferSchema=True, multiLine=params.get("multiline", "false"), sep=params.get("sep", ","), escape='"').csv(path)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    if kind == "excel":
        import pandas as pd  # one workbook is one small file

        return spark.createDataFrame(pd.read_excel(path))
    if kind == "print":
        return spark.read.text(path).withColumnRenamed("value", "line")
    return text_lines(spark, path, params.get("sep", " "), int(params["columns"]) if "columns" in params else None)


def text_lines(spark: SparkSession, path: str, sep: str = " ", columns: int | None = None) -> DataFrame:
    """``seg0`` ... ``segN``: each line cut at ``sep``; as many columns as said (``?columns=8``), or, found by a pass of its own, as the longest line has parts."""
    parts = spark.read.text(path).select(F.split("value", "\\Q" + sep + "\\E").alias("p"))
    width = columns or parts.agg(F.max(F.size("p"))).first()[0] or 1
    return parts.select(*(F.get("p", F.lit(i)).alias(f"seg{i}") for i in range(width)))


def append_file(spark: SparkSession, df: DataFrame, name: str, base: str = "") -> DataFrame | None:
    """Adds rows to a table of files.  Where its format or columns allow no more part files, the whole table to be written instead is given back."""
    path, kind, params = split_path(name, base)
    status = _status(spark, path)
    if status is None:
        write_file(df, name, base)
        return None
    old = read_file(spark, name, base)
    if kind == "text":
        old = spark.read.text(path)
        df = df.select(F.concat_ws(params.get("sep", " "), *(F.col(f"`{c}`").cast("string") for c in df.columns)).alias("value"))
    if not status.isDirectory() or kind == "excel" or not set(df.columns) <= set(old.columns):
        return old.unionByName(df.select(*(F.col(f"`{c}`").cast(old.schema[c].dataType).alias(c) if c in old.columns and kind in ("csv", "text") else F.col(f"`{c}`") for c in df.columns)), allowMissingColumns=True)
    kept = df.select(*(F.col(f"`{c}`").cast(old.schema[c].dataType).alias(c) if c in df.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns))
    if kind == "text":
        kept.write.mode("append").text(path)
    else:
        write_file(kept, name, base, "append")
    return None


def write_file(df: DataFrame, name: str, base: str = "", mode: str = "overwrite") -> None:
    """A folder of part files in the format of the name's ending; a text table is written as lines."""
    path, kind, params = split_path(name, base)
    w = df.write.mode(mode)
    if kind == "csv":
        w.options(header=True, sep=params.get("sep", ","), escape='"').csv(path)
    elif kind in ("json", "jsonl", "richtable"):
        w.json(path)
    elif kind == "excel":
        rows = df.limit(1_048_576).toPandas()  # a sheet's own limit
        if len(rows) >= 1_048_576:
            raise SqlError("more rows than a sheet can hold")
        rows.to_excel(path, index=False)
    elif kind in ("text", "print"):
        (df if df.columns == ["value"] else df.select(F.concat_ws(params.get("sep", " "), *(F.col(f"`{c}`").cast("string") for c in df.columns)))).write.mode(mode).text(path)
    else:
        w.format(kind).save(path)


def read_stdin(spark: SparkSession, sep: str | None = None) -> DataFrame:
    lines = [x.rstrip("\n") for x in sys.stdin]
    if not sep:
        return spark.createDataFrame([(x,) for x in lines], "line string")
    rows = [x.split(sep) for x in lines]
    n = max(map(len, rows), default=1)
    return spark.createDataFrame([tuple([*r, *[None] * (n - len(r))]) for r in rows], ", ".join(f"seg{i} string" for i in range(n)))


def _address(config: dict) -> tuple[str, dict[str, str]]:
    """(Spark's format, options) of a configured database."""
    driver = config.get("driver", "")
    if driver not in JDBC:
        return VENDOR.get(driver, driver), {k: str(v) for k, v in config.items() if k not in ("name", "driver", "virtual_views")}
    url = config.get("url") or JDBC[driver].format(host=config.get("host", "127.0.0.1"), port=config.get("port", PORTS.get(driver, 0)), db=config.get("db") or config.get("database") or config.get("path", ""))
    return "jdbc", {"url": url, **{k: str(v) for k, v in config.items() if k in ("user", "password", "fetchsize", "batchsize", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}}


def read_database(spark: SparkSession, config: dict, table: str | None = None, query: str | None = None) -> DataFrame:
    """A table, or a query sent as it is, of a configured database."""
    kind, options = _address(config)
    reader = spark.read.format(kind).options(**options)
    if kind == "jdbc":
        return (reader.option("query", query) if query is not None else reader.option("dbtable", table)).load()
    if query is not None:
        reader = reader.option("query", query)
    return reader.load(table) if table and config.get("driver", "") not in VENDOR else reader.option("dbtable", table or "").load()


def write_database(df: DataFrame, config: dict, table: str, mode: str = "append") -> None:
    """Rows into a database's table; ``overwrite`` empties the table first and keeps its definition."""
    kind, options = _address(config)
    w = df.write.format(kind).options(**options).mode(mode)
    if kind == "jdbc":
        w.option("dbtable", table).option("truncate", mode == "overwrite").save()
    else:
        w.option("dbtable", table).save()


VIEW_ARGUMENT = re.compile(r"\#\{(\w+?)(?::(.*?))?\}", re.S)
VIEW_OPS = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "in"}


def view_arguments(query: str) -> list[tuple[str, str]]:
    """(column, operator) of each ``#{column__op:default}`` of a virtual view's query."""
    out = []
    for m in VIEW_ARGUMENT.finditer(query):
        name, _, op = m[1].rpartition("__")
        out.append((name, VIEW_OPS[op]) if name and op in VIEW_OPS else (m[1], "="))
    return out


def bound_view(query: str, given: dict[tuple[str, str], str]) -> str:
    """The query with its arguments' values, as SQL; the default, or NULL, where none is given."""
    keys = iter(view_arguments(query))

    def put(m: re.Match) -> str:
        value = given.get(next(keys))
        if value is not None:
            return value
        if m[2] is None:
            return "NULL"
        try:
            default = json.loads(m[2])
        except ValueError:
            default = m[2]
        many = default if isinstance(default, list) else [default]
        text = ", ".join("NULL" if x is None else str(int(x)) if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'" for x in many)
        return f"({text})" if isinstance(default, list) else text

    return VIEW_ARGUMENT.sub(put, query)
