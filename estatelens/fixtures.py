"""Small metadata tables used by queries and tests, as DataFrames and as SQL values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_DUCK = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE", "array<string>": "VARCHAR[]"}


@dataclass(frozen=True)
class Rows:
    """A literal table: a schema in DDL form and its rows."""

    schema: str
    rows: tuple

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), ", ".join(f"{c} {t}" for c, t in self.columns()))

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.strip().split(" ", 1)) for c in self.schema.split(",")]

    def sql(self, name: str) -> str:
        """name as a common table expression."""
        cols = self.columns()
        body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in self.rows)
        casts = ", ".join(f"cast({c} as {_DUCK[t]}) as {c}" for c, t in cols)
        return f"{name} as (select {casts} from (values {body}) as v({', '.join(c for c, _ in cols)}))"


def _literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    return str(v)


#: Tables of the star schema the queries run on: object, fields with types as the catalog names them, key, references.
_TABLES = """
region: r_regionkey int, r_name string | r_regionkey |
nation: n_nationkey int, n_name string, n_regionkey int | n_nationkey | n_regionkey>region.r_regionkey
customer: c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string | c_custkey | c_nationkey>nation.n_nationkey
supplier: s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double | s_suppkey | s_nationkey>nation.n_nationkey
part: p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double | p_partkey |
orders: o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string | o_orderkey |
lineitem: l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz, l_returnflag string | | l_partkey>part.p_partkey
events: event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string | event_id |
documents: doc_id bigint, text string, lang string, source string, n_chars bigint | doc_id |
labels: doc_id bigint, quality int, toxic int | | doc_id>documents.doc_id
"""


def _catalog(text: str, namespace: str = "main") -> tuple[Rows, Rows, Rows]:
    objects, fields, rels = [], [], []
    for line in filter(None, map(str.strip, text.splitlines())):
        name, rest = line.split(":", 1)
        cols, key, refs = (x.strip() for x in rest.split("|"))
        keys = key.split()
        kind = "view" if name.startswith("V_") else "table"
        objects.append((namespace, name, kind, ",".join(keys), f"{name.replace('_', ' ').lower()} rows"))
        for i, c in enumerate(cols.split(",")):
            c, t = c.split()
            fields.append((namespace, name, c, i + 1, t, c not in keys, c in keys, None))
        for r in refs.split():
            a, b = r.split(">")
            obj, col = b.split(".")
            rels.append((namespace, name, f"fk_{name}_{a}", [a], namespace, obj, [col]))
    return (
        Rows("namespace string, object string, kind string, primary_key string, description string", tuple(objects)),
        Rows("namespace string, object string, field string, position int, data_type string, nullable boolean, is_primary_key boolean, description string", tuple(fields)),
        Rows("namespace string, object string, name string, from_fields array<string>, to_namespace string, to_object string, to_fields array<string>", tuple(rels)),
    )


OBJECTS, FIELDS, RELATIONSHIPS = _catalog(_TABLES)

#: A sales estate in two versions, for schema changes.
RETAIL_1 = _catalog("""
D_DATE: DATE_KEY INTEGER, CAL_YEAR INTEGER, CAL_MONTH INTEGER, MONTH_NAME TEXT | DATE_KEY |
D_PRD: PRD_KEY INTEGER, CAT_CD TEXT, CAT_NAME TEXT, PRD_NAME TEXT, ACTIVE_FLG INTEGER | PRD_KEY |
D_CUST: CUST_KEY INTEGER, COUNTRY_CD TEXT, SEG_CD TEXT | CUST_KEY |
D_GEO: TERR_ID INTEGER, TERR_CD TEXT, COUNTRY_CD TEXT, REGION_NAME TEXT | TERR_ID |
D_RSLR: RSLR_KEY INTEGER, TERR_CD TEXT, RSLR_TYPE TEXT | RSLR_KEY |
D_CURR: CURR_CD TEXT, CURR_NAME TEXT | CURR_CD |
D_CHNL: CHNL_CD TEXT, CHNL_NAME TEXT | CHNL_CD |
MAP_TERR_CH: TERR_CD TEXT, CHNL_CD TEXT, SALES_ORG TEXT | TERR_CD CHNL_CD | CHNL_CD>D_CHNL.CHNL_CD
F_SLS_01: DOC_ID INTEGER, DOC_DT_KEY INTEGER, PRD_KEY INTEGER, CUST_KEY INTEGER, CURR_CD TEXT, CHNL_CD TEXT, QTY INTEGER, NET_AMT NUMERIC | DOC_ID | DOC_DT_KEY>D_DATE.DATE_KEY PRD_KEY>D_PRD.PRD_KEY CUST_KEY>D_CUST.CUST_KEY CURR_CD>D_CURR.CURR_CD CHNL_CD>D_CHNL.CHNL_CD
F_SLS_02: DOC_ID INTEGER, DOC_DT_KEY INTEGER, PRD_KEY INTEGER, RSLR_KEY INTEGER, CURR_CD TEXT, CHNL_CD TEXT, QTY INTEGER, NET_AMT NUMERIC | DOC_ID | DOC_DT_KEY>D_DATE.DATE_KEY PRD_KEY>D_PRD.PRD_KEY CHNL_CD>D_CHNL.CHNL_CD CURR_CD>D_CURR.CURR_CD
F_RET_01: RET_ID INTEGER, DOC_ID INTEGER, RET_DT_KEY INTEGER, PRD_KEY INTEGER, RETURN_QTY INTEGER, RETURN_AMT NUMERIC, SRC_CHNL TEXT | RET_ID | RET_DT_KEY>D_DATE.DATE_KEY PRD_KEY>D_PRD.PRD_KEY SRC_CHNL>D_CHNL.CHNL_CD
V_SLS_ALL: DOC_ID INTEGER, DOC_DT_KEY INTEGER, PRD_KEY INTEGER, CURR_CD TEXT, QTY INTEGER, NET_AMT NUMERIC, SRC_CHNL TEXT | |
""")
RETAIL_2 = _catalog("""
D_DATE: DATE_KEY INTEGER, CAL_YEAR INTEGER, CAL_MONTH INTEGER, MONTH_NAME TEXT | DATE_KEY |
D_PRD: PRD_KEY INTEGER, CAT_CD TEXT, CAT_NAME TEXT, PRD_NAME TEXT, ACTIVE_FLG INTEGER | PRD_KEY |
D_CUST: CUST_KEY INTEGER, COUNTRY_CD TEXT, SEG_CD TEXT | CUST_KEY |
D_GEO: TERR_ID INTEGER, TERR_CD TEXT, COUNTRY_CD TEXT, REGION_NAME TEXT | TERR_ID |
D_RSLR: RSLR_KEY INTEGER, TERRITORY_ID TEXT, RSLR_TYPE TEXT | RSLR_KEY |
D_CURR: CURR_CD TEXT, CURR_NAME TEXT | CURR_CD |
D_CHNL: CHNL_CD TEXT, CHNL_NAME TEXT | CHNL_CD |
MAP_TERR_CH: TERR_CD TEXT, CHNL_CD TEXT, SALES_ORG TEXT | TERR_CD CHNL_CD SALES_ORG | CHNL_CD>D_CHNL.CHNL_CD
F_SLS_01: DOC_ID INTEGER, DOC_DT_KEY INTEGER, PRD_KEY INTEGER, CUST_KEY INTEGER, CURR_CD TEXT, CHNL_CD TEXT, QTY INTEGER, NET_AMT DECIMAL(18.2), DISC_AMT NUMERIC | DOC_ID | DOC_DT_KEY>D_DATE.DATE_KEY PRD_KEY>D_PRD.PRD_KEY CUST_KEY>D_CUST.CUST_KEY CURR_CD>D_CURR.CURR_CD CHNL_CD>D_CHNL.CHNL_CD
F_SLS_02: DOC_ID INTEGER, DOC_DT_KEY INTEGER, PRD_KEY INTEGER, RSLR_KEY INTEGER, CURR_CD TEXT, CHNL_CD TEXT, QTY INTEGER, NET_AMT DECIMAL(18.2) | DOC_ID | DOC_DT_KEY>D_DATE.DATE_KEY PRD_KEY>D_PRD.PRD_KEY CHNL_CD>D_CHNL.CHNL_CD
F_RET_01: RET_ID INTEGER, DOC_ID INTEGER, RET_DT_KEY INTEGER, PRD_KEY INTEGER, RETURN_QTY INTEGER, SRC_CHNL TEXT | RET_ID | RET_DT_KEY>D_DATE.DATE_KEY PRD_KEY>D_PRD.PRD_KEY SRC_CHNL>D_CHNL.CHNL_CD
V_SLS_ALL: DOC_ID INTEGER, DOC_DT_KEY INTEGER, PRD_KEY INTEGER, CURR_CD TEXT, QTY INTEGER, NET_AMT NUMERIC, SRC_CHNL TEXT | |
""")
RETAIL_2 = (RETAIL_2[0], Rows(RETAIL_2[1].schema, tuple((*r[:-1], "product category") if r[2] == "CAT_CD" else r for r in RETAIL_2[1].rows)), RETAIL_2[2])
#: Reviewed descriptions of the first version's nodes: (reference, state).
ANNOTATIONS = Rows("reference string, state string", (("main.F_SLS_01.NET_AMT", "validated"), ("main.D_RSLR.TERR_CD", "validated"), ("main.MAP_TERR_CH", "validated"), ("main.D_PRD", "validated"), ("main.F_RET_01.RETURN_AMT", "draft")))

#: Static lineage of one nightly job: definitions, steps, claims, write sources, materializations.
DEFINITIONS = Rows("definition string, name string, kind string, analysis string", (("d1", "etl.load_stage", "procedure", "complete"), ("d2", "etl.build_sales", "procedure", "complete"), ("d3", "rep.monthly", "query", "failed"), ("d4", "rep.top", "script", "pending")))
STEPS = Rows("step string, definition string, position int, depends_on array<string>", (("s4", "d4", 1, ["s3"]), ("s1", "d1", 2, []), ("s2", "d2", 3, ["s1"]), ("s3", "d3", 4, ["s1", "s2"])))
CLAIMS = Rows("claim string, definition string, operation string, target string, state string", (("c1", "d1", "read", "raw.orders", "validated"), ("c2", "d3", "read", "dw.sales", "draft"), ("c3", "d3", "read", "dw.dates", "validated"), ("c4", "d2", "call", "etl.load_stage", "validated"), ("c5", "d4", "read", "rep.monthly", "rejected"), ("c6", "d4", "read", "rep.months", "validated")))
WRITES = Rows("unit string, definition string, target string, state string, source string, role string", (("u1", "d1", "stage.orders", "validated", "raw.orders", "input"), ("u2", "d2", "dw.sales", "validated", "stage.orders", "input"), ("u2", "d2", "dw.sales", "validated", "[dw].[dates]", "lookup"), ("u3", "d2", "dw.sales", "draft", "dw.sales", "self"), ("u4", "d2", "dw.old", "rejected", "stage.orders", "input")))
MATERIALIZATIONS = Rows("materialization string, definition string, target string, mode string, state string", (("m1", "d3", "rep.months", "table", "validated"), ("m2", "d4", "rep.best", "view", "review_required")))

#: Runtime events: an ordered log with what each call consumes and reads.
RUNTIME = Rows("sequence int, call_id string, kind string, status string, inputs array<string>, consumes array<string>", ((1, "q1", "sql", "succeeded", ["raw.orders"], []), (2, "q2", "mongo", "succeeded", ["raw.users"], []), (3, "q3", "sql", "failed", ["raw.items"], []), (4, "f1", "federated", "succeeded", [], ["q1", "q2"]), (5, "p1", "python", "succeeded", [], ["f1", "q1"])))
BROKEN = Rows("sequence int, call_id string, kind string, status string, inputs array<string>, consumes array<string>", ((1, "q1", "sql", "failed", ["raw.orders"], []), (2, "q2", "sql", "succeeded", ["raw.orders"], ["q3"]), (4, "q3", "sql", "succeeded", ["raw.users"], ["q1", "zz"]), (5, "q3", "sql", "succeeded", [], [])))

#: A workspace: systems own graphs, areas own schemas, zones hold objects.
SCOPE_OBJECTS = Rows("system string, graph string, area string, schema_name string, object string", (("erp", "g1", "sales", "dbo", "orders"), ("erp", "g1", "sales", "dbo", "customer"), ("erp", "g1", "parts", "inv", "part"), ("crm", "g2", "people", "crm", "contact"), ("crm", "g2", None, "tmp", "scratch")))
ZONES = Rows("zone string, graph string, object string", (("revenue", "g1", "orders"), ("revenue", "g2", "contact"), ("private", "g2", "contact"), ("private", "g1", "customer")))
CHANGED = Rows("graph string, schema_name string, object string, kind string", (("g1", "dbo", "orders", "field_removed"), ("g2", "tmp", "scratch", "object_added"), ("g2", "crm", "contact", "field_type_changed")))
#: Entity resolution candidates.
CANDIDATES = Rows("candidate string, left_field string, right_field string, status string, revision string, evaluated long, matched long, collisions long, counterexamples long", (("e1", "a.name", "b.title", "reviewed", "r2", 1000, 720, 18, 4), ("e2", "a.name", "b.title", "candidate", "r2", 500, 100, 1, 0), ("e3", "a.mail", "b.mail", "candidate", "r2", 400, 390, 0, 1), ("e4", "a.zip", "b.zip", "rejected", "r2", 10, 1, 0, 0), ("e5", "a.tel", "b.tel", "candidate", "r1", 10, 5, 0, 0), ("e6", "a.x", "b.x", "candidate", "r2", 5, 9, 10, 7)))
#: Two versions of a compiled context: (side, section, id, payload).
PACKETS = Rows("side string, section string, id string, payload string", (("left", "object", "o1", "a"), ("left", "object", "o2", "b"), ("left", "join", "j1", "x"), ("right", "object", "o1", "a2"), ("right", "object", "o3", "c"), ("right", "join", "j1", "x"), ("right", "join", "j2", "y")))
#: An imported semantic model's datasets and fields.
DATASETS = Rows("dataset string, source string", (("Orders", "hive.main.orders"), ("Clients", "MAIN.customer"), ("Goods", "part"), ("Ghost", "nowhere.thing")))
MODEL_FIELDS = Rows("dataset string, field string, expression string", (("Orders", "key", "o_orderkey"), ("Orders", "price", "o_totalprice * 2"), ("Clients", "name", "C_NAME"), ("Goods", "brand", '"p_brand"'), ("Ghost", "x", "x")))
