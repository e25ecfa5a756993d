"""SQL Server as a source: its catalog, samples, profiles and overlaps through read-only queries.

Queries go through a reader, a function from a SELECT to a DataFrame, so that any driver fits: `jdbc` makes one from a URL. The
server sees bounded SELECTs with quoted names only; what it returns is shaped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Reader = Callable[[str], DataFrame]
#: Native types that are neither sampled nor profiled, and bounds.
UNSAFE = "binary geography geometry hierarchyid image ntext rowversion sql_variant text timestamp varbinary xml".split()
FIELDS, VALUE_CHARS, TOTAL_CHARS, ROWS, DOMAIN, PAIRS = 32, 256, 20_000, 100_000, 100, 50
LOGIN_SECONDS, QUERY_SECONDS, PORT = 5, 30, 1433

_OBJECTS = "sys.objects o inner join sys.schemas s on o.schema_id = s.schema_id"
_VISIBLE = "o.is_ms_shipped = 0 and o.type in ('U', 'V')"
_KEY = "sys.key_constraints k inner join sys.index_columns i on i.object_id = k.parent_object_id and i.index_id = k.unique_index_id"
_TOLD = "(select cast(e.value as nvarchar(max)) from sys.extended_properties e where e.name = 'MS_Description' and e.class = 1 and e.major_id = o.object_id and e.minor_id = {0})"
PROBE = "select cast(serverproperty('ProductVersion') as nvarchar(128)) version, cast(serverproperty('ProductLevel') as nvarchar(128)) level, cast(serverproperty('Edition') as nvarchar(256)) edition"
COLUMNS = f"""select s.name namespace, o.name object, rtrim(o.type) object_type, c.name field, c.column_id position, t.name type_name, c.max_length, c.precision, c.scale, c.is_nullable nullable,
 {_TOLD.format('0')} object_description, {_TOLD.format('c.column_id')} field_description
 from {_OBJECTS} inner join sys.columns c on c.object_id = o.object_id inner join sys.types t on t.user_type_id = c.user_type_id where {_VISIBLE}"""
FOREIGN_KEYS = """select f.name, object_schema_name(f.parent_object_id) namespace, object_name(f.parent_object_id) object, col_name(p.parent_object_id, p.parent_column_id) from_field,
 object_schema_name(f.referenced_object_id) to_namespace, object_name(f.referenced_object_id) to_object, col_name(p.referenced_object_id, p.referenced_column_id) to_field, p.constraint_column_id place
 from sys.foreign_keys f inner join sys.foreign_key_columns p on p.constraint_object_id = f.object_id where f.is_ms_shipped = 0"""
PRIMARY_KEYS = f"select s.name namespace, o.name object, col_name(o.object_id, i.column_id) field, i.key_ordinal place from {_KEY} inner join sys.objects o on o.object_id = k.parent_object_id inner join sys.schemas s on s.schema_id = o.schema_id where k.type = 'PK'"


def quoted(name: str) -> str:
    return "[" + name.replace("]", "]]") + "]"


def parse_target(url: str, database: str | None = None, any_certificate: bool = False) -> dict[str, str]:
    """JDBC options of mssql+pymssql://user:password@host[:port]/database; a given database comes first.

    The server's certificate must be sound unless any_certificate is set.
    """
    parts = urlsplit(url)
    if parts.scheme != "mssql+pymssql":
        raise ValueError("the URL must be mssql+pymssql://")
    if not parts.hostname or parts.username is None or parts.password is None:
        raise ValueError("the URL needs host, user and password")
    name = database or unquote(parts.path.lstrip("/"))
    if not name:
        raise ValueError("a database is needed")
    return {
        "url": f"jdbc:sqlserver://{parts.hostname}:{parts.port or PORT};databaseName={name};applicationIntent=ReadOnly;loginTimeout={LOGIN_SECONDS};encrypt=true;trustServerCertificate={str(any_certificate).lower()}",
        "user": unquote(parts.username), "password": unquote(parts.password), "queryTimeout": str(QUERY_SECONDS),
    }


def jdbc(spark: SparkSession, url: str, database: str | None = None, any_certificate: bool = False) -> Reader:
    options = parse_target(url, database, any_certificate)
    return lambda query: spark.read.format("jdbc").options(**options).option("query", query).load()


def data_type() -> Column:
    """The native type as written, of type_name, max_length, precision and scale."""
    name = F.lower("type_name")
    length = lambda by: F.when(F.col("max_length") == -1, "max").otherwise(F.floor(F.col("max_length") / by).cast("string"))
    return (
        F.when(name.isin("varchar", "char", "varbinary", "binary"), F.concat("type_name", F.lit("("), length(1), F.lit(")"))).when(name.isin("nvarchar", "nchar"), F.concat("type_name", F.lit("("), length(2), F.lit(")")))
        .when(name.isin("decimal", "numeric"), F.concat("type_name", F.lit("("), "precision", F.lit(","), "scale", F.lit(")"))).when(name.isin("datetime2", "datetimeoffset", "time"), F.concat("type_name", F.lit("("), "scale", F.lit(")"))).otherwise(F.col("type_name"))
    )


def safe() -> Column:
    """Whether a column may be sampled and profiled."""
    return ~F.lower("type_name").isin(*UNSAFE) & (F.col("max_length") != -1) & (F.col("max_length") <= 1024)


def probe(read: Reader) -> dict[str, str]:
    return read(PROBE).first().asDict()


def catalog(read: Reader, namespace: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, fields, relationships) of a database, or of one schema; keys and foreign keys in the order of their columns."""
    here = lambda df: df if namespace is None else df.where(F.col("namespace") == namespace)
    columns, keys, fks = here(read(COLUMNS)), here(read(PRIMARY_KEYS)), here(read(FOREIGN_KEYS))
    own = keys.groupBy("namespace", "object").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "field"))), lambda x: x["field"]), ",").alias("primary_key"))
    objects = columns.groupBy("namespace", "object").agg(F.max(F.when(F.trim("object_type") == "U", "table").otherwise("view")).alias("kind"), F.max("object_description").alias("description"))
    objects = objects.join(own, ["namespace", "object"], "left").select("namespace", "object", "kind", F.coalesce("primary_key", F.lit("")).alias("primary_key"), "description")
    flagged = keys.select("namespace", "object", "field", F.lit(True).alias("key"))
    fields = columns.join(flagged, ["namespace", "object", "field"], "left")
    fields = fields.select("namespace", "object", "field", F.col("position").cast("int").alias("position"), data_type().alias("data_type"), F.col("nullable").cast("boolean").alias("nullable"), F.coalesce("key", F.lit(False)).alias("is_primary_key"), F.col("field_description").alias("description"))
    pairs = F.sort_array(F.collect_list(F.struct("place", "from_field", "to_field")))
    rels = fks.groupBy("namespace", "object", "name", "to_namespace", "to_object").agg(pairs.alias("p"))
    rels = rels.select("namespace", "object", "name", F.transform("p", lambda x: x["from_field"]).alias("from_fields"), "to_namespace", "to_object", F.transform("p", lambda x: x["to_field"]).alias("to_fields"))
    return objects, fields, rels


def sample_fields(read: Reader, namespace: str, name: str) -> tuple[list[str], list[str], list[str], dict[str, str]]:
    """Fields that are sampled (32 at most), those left out, those of the key, and all native types."""
    rows = read(COLUMNS).where((F.col("namespace") == namespace) & (F.col("object") == name)).select("field", "position", "type_name", safe().alias("safe")).orderBy("position").collect()
    if not rows:
        raise ValueError(f"object_not_found: {namespace}.{name}")
    keys = {r.field for r in read(PRIMARY_KEYS).where((F.col("namespace") == namespace) & (F.col("object") == name)).collect()}
    chosen = [r.field for r in rows if r.safe][:FIELDS]
    return chosen, [r.field for r in rows if r.field not in chosen], [f for f in chosen if f in keys], {r.field: r.type_name.lower() for r in rows}


def _ordered(keys: list[str], chosen: list[str]) -> str:
    return ", ".join(quoted(c) for c in (keys or chosen[:1]))


def rendered(df: DataFrame) -> DataFrame:
    """Values as they are shown: numbers and booleans as they are, dates in ISO form, texts cut at 256 characters with an ellipsis."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif kind == "date" or kind.startswith("decimal"):
            c = c.cast("string")
        elif kind == "string":
            c = F.when(F.length(c) > VALUE_CHARS, F.concat(F.substring(c, 1, VALUE_CHARS), F.lit("…"))).otherwise(c)
        out.append(c.alias(name))
    return df.select(*out)


def sample_rows(read: Reader, namespace: str, name: str, limit: int = 10) -> DataFrame:
    """At most 10 rows of the safe columns by key, while their values have 20,000 characters at most."""
    if not 1 <= limit <= 10:
        raise ValueError("a sample has 1 to 10 rows")
    chosen, _, keys, _ = sample_fields(read, namespace, name)
    query = f"select top ({int(limit)}) {', '.join(map(quoted, chosen))} from {quoted(namespace)}.{quoted(name)} order by {_ordered(keys, chosen)}"
    shown = rendered(read(query)).collect()  # ten rows
    used, kept = 0, []
    for r in shown:
        used += sum(len(str(v)) for v in r)
        if used > TOTAL_CHARS:
            break
        kept.append(r)
    schema = rendered(read(query)).schema
    return read(query).sparkSession.createDataFrame(kept, schema)


def profile_query(namespace: str, name: str, field: str, type_name: str, order: str, limit: int) -> str:
    """One column's counts, distinct values, bounds and lengths over the first rows."""
    value = {"bit": "convert(int, {0})", "uniqueidentifier": "convert(nvarchar(36), {0})"}.get(type_name, "{0}").format(quoted(field))
    sizes = "min(len(v)) min_length, max(len(v)) max_length" if type_name in ("char", "nchar", "varchar", "nvarchar") else "cast(null as int) min_length, cast(null as int) max_length"
    return f"select count_big(v) non_null, count_big(*) - count_big(v) null_count, count_big(distinct v) distinct_count, cast(min(v) as nvarchar(256)) min_value, cast(max(v) as nvarchar(256)) max_value, {sizes} from (select top ({int(limit)}) {value} v from {quoted(namespace)}.{quoted(name)} order by {order}) p"


def row_count_query(namespace: str, name: str, order: str, limit: int) -> str:
    return f"select count_big(*) n from (select top ({int(limit)}) 1 x from {quoted(namespace)}.{quoted(name)} order by {order}) p"


def profile_object(read: Reader, namespace: str, name: str, limit: int = 10_000, domain: int = 20) -> DataFrame:
    """(column_name, status, rows_profiled, complete, ...) of every column over the first rows by key; unsafe ones are named only."""
    if not 1 <= limit <= ROWS or not 1 <= domain <= DOMAIN:
        raise ValueError(f"a profile reads 1 to {ROWS} rows and shows 1 to {DOMAIN} values")
    chosen, left_out, keys, types = sample_fields(read, namespace, name)
    order = _ordered(keys, chosen)
    seen = int(read(row_count_query(namespace, name, order, limit + 1)).first().n)
    out = None
    for c in chosen:
        one = read(profile_query(namespace, name, c, types[c], order, limit)).select(F.lit(c).alias("column_name"), F.lit("profiled").alias("status"), "*")
        out = one if out is None else out.unionByName(one)
    if left_out:
        gone = out.sparkSession.createDataFrame([(c, "omitted") for c in left_out], "column_name string, status string")
        out = out.unionByName(gone, allowMissingColumns=True)
    return out.withColumn("rows_profiled", F.lit(min(seen, limit))).withColumn("complete", F.lit(seen <= limit))


def overlap_query(a: tuple[str, str, str], b: tuple[str, str, str], limit: int) -> str:
    """Counts of two columns' first values and of the distinct ones that both have."""
    rows = lambda t: f"select top ({int(limit)}) {quoted(t[2])} v from {quoted(t[0])}.{quoted(t[1])} where {quoted(t[2])} is not null"
    return f"""select (select count_big(*) from ({rows(a)}) x) source_non_null, (select count_big(distinct v) from ({rows(a)}) x) source_distinct, (select count_big(*) from ({rows(b)}) x) target_non_null,
 (select count_big(distinct v) from ({rows(b)}) x) target_distinct, (select count_big(*) from (select v from ({rows(a)}) x intersect select v from ({rows(b)}) y) z) overlap"""


def probe_relationships(read: Reader, pairs: list[tuple[tuple[str, str, str], tuple[str, str, str]]], limit: int = 10_000) -> DataFrame:
    """(position, overlap, ratios) of up to 50 pairs of columns (schema, object, column)."""
    if not 1 <= len(pairs) <= PAIRS or not 1 <= limit <= ROWS:
        raise ValueError(f"1 to {PAIRS} pairs over 1 to {ROWS} rows")
    out = None
    for i, (a, b) in enumerate(pairs):
        one = read(overlap_query(a, b, limit)).select(F.lit(i).alias("position"), F.lit(".".join(a)).alias("source"), F.lit(".".join(b)).alias("target"), "*")
        out = one if out is None else out.union(one)
    over = lambda x, y: F.col(x) / F.greatest(F.lit(1), y)
    return out.select("*", over("overlap", "source_distinct").alias("source_coverage"), over("overlap", "target_distinct").alias("target_coverage"), over("target_distinct", "target_non_null").alias("target_uniqueness"))
