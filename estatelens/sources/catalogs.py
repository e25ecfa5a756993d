"""Catalogs from Spark tables and from strict JSON documents, and JDBC reading with quoted names."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "namespace string, object string, field string, position int, data_type string, nullable boolean, is_primary_key boolean, description string"
OBJECTS = "namespace string, object string, kind string, primary_key string, description string"


def strict_json(text: str) -> object:
    """Parsed JSON; a repeated key is an error."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key is repeated")
        return out

    return json.loads(text, object_pairs_hook=unique)


def from_spark(spark: SparkSession, database: str, keys: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, fields) of a database's tables and views; Spark knows no keys, so they are given."""
    keys, objects, fields = keys or {}, [], []
    for t in spark.catalog.listTables(database):
        own = keys.get(t.name, [])
        objects.append((database, t.name, "view" if "VIEW" in t.tableType else "table", ",".join(own), t.description))
        where = t.name if t.isTemporary else f"{database}.{t.name}"
        fields += [(database, t.name, c.name, i + 1, c.dataType, c.nullable, c.name in own, c.description) for i, c in enumerate(spark.catalog.listColumns(where))]
    return spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(fields, FIELDS)


def from_files(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, namespace: str = "main") -> tuple[DataFrame, DataFrame]:
    """(objects, fields) of named DataFrames."""
    keys = keys or {}
    objects = [(namespace, n, "table", ",".join(keys.get(n, [])), None) for n in tables]
    fields = [(namespace, n, f.name, i + 1, f.dataType.simpleString(), f.nullable, f.name in keys.get(n, []), None) for n, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(fields, FIELDS)


def server_catalog(spark: SparkSession, url: str, namespace: str | None = None, **options: str) -> DataFrame:
    """Objects and columns of a database server through its information schema; needs the server's JDBC driver."""
    query = "select table_schema, table_name, column_name, ordinal_position, data_type, is_nullable from information_schema.columns"
    df = spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    return df if namespace is None else df.where(F.lower("table_schema") == namespace.lower())
