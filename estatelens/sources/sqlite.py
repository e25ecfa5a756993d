"""SQLite as a Spark data source, read-only, and its catalog.

    spark.dataSource.register(SQLiteSource)
    spark.read.format("sqlite_ro").option("path", file).option("table", name).load()

The file must be on a path all machines see. Partitions are rowid ranges, so that large tables are read in parallel.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def connect(path: str) -> sqlite3.Connection:
    """A connection that cannot write."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, timeout=5)
    con.execute("pragma query_only = on")
    return con


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(native: str):
    """Spark's type for a declared SQLite type, by SQLite's own affinity rules."""
    n = (native or "BLOB").upper()
    if "INT" in n:
        return LongType()
    if any(x in n for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in n:
        return BinaryType()
    return DoubleType() if any(x in n for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else StringType()


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.parts, self.types = options["path"], options["table"], int(options.get("partitions", 4)), schema

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as con:
            try:
                low, high = con.execute(f"select min(rowid), max(rowid) from {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # a view or a table without rowid
                return [_Range(0, -1)]
        if low is None or not isinstance(low, int):
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        names = ", ".join(quoted(f.name) for f in self.types.fields)
        where = f" where rowid between {part.low} and {part.high}" if part.high >= part.low else ""
        casts = {"bigint": int, "double": float, "string": str, "binary": lambda v: v if isinstance(v, bytes) else str(v).encode()}
        kinds = [casts[f.dataType.simpleString()] for f in self.types.fields]
        with connect(self.path) as con:
            for row in con.execute(f"select {names} from {quoted(self.table)}{where}"):
                yield tuple(None if v is None else k(v) for k, v in zip(kinds, row, strict=True))


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_ro"

    def schema(self) -> StructType:
        with connect(self.options["path"]) as con:
            info = con.execute(f"pragma table_info({quoted(self.options['table'])})").fetchall()
        if not info:
            raise ValueError(f"no such table: {self.options['table']}")
        return StructType([StructField(r[1], spark_type(r[2]), True) for r in info])

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(self.options, schema)


def harvest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, fields, relationships) of a SQLite file: one row per table or view, field and foreign key."""
    objects, fields, rels = [], [], []
    with connect(path) as con:
        for name, kind in con.execute("select name, type from sqlite_schema where type in ('table', 'view') and name not like 'sqlite_%' order by name, type").fetchall():
            info = con.execute(f"pragma table_info({quoted(name)})").fetchall()
            keys = [r[1] for r in sorted(info, key=lambda r: r[5]) if r[5]]
            objects.append(("main", name, kind, ",".join(keys), None))
            fields += [("main", name, r[1], r[0] + 1, r[2] or "BLOB", not r[3] and not r[5], bool(r[5]), None) for r in info]
            by: dict[tuple, list] = {}
            for r in con.execute(f"pragma foreign_key_list({quoted(name)})").fetchall():
                by.setdefault((r[0], r[2]), []).append((r[1], r[3], r[4]))
            for (i, target), cols in sorted(by.items()):
                cols.sort()
                rels.append(("main", name, f"fk_{name}_{i}_{target}", [c[1] for c in cols], "main", target, [c[2] for c in cols]))
    return (
        spark.createDataFrame(objects, "namespace string, object string, kind string, primary_key string, description string"),
        spark.createDataFrame(fields, "namespace string, object string, field string, position int, data_type string, nullable boolean, is_primary_key boolean, description string"),
        spark.createDataFrame(rels, "namespace string, object string, name string, from_fields array<string>, to_namespace string, to_object string, to_fields array<string>"),
    )
