"""Declared schemas of the landed files. Readers use these; nothing is inferred."""

from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType


def _schema(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


CITIES = _schema(
    ("ciudad", StringType()),
    ("region_7", IntegerType()),
    ("d_region_7", StringType()),
    ("region_4", IntegerType()),
    ("d_region_4", StringType()),
    ("ent", StringType()),
    ("entidad", StringType()),
)

EVENT_STATES = _schema(
    ("disno", StringType()),
    ("disaster_subgroup", StringType()),
    ("location", StringType()),
    ("states", StringType()),
)

EVENTS_MAIN = _schema(
    ("disno", StringType()),
    ("location", StringType()),
    ("disaster_subgroup", StringType()),
    ("start_year", IntegerType()),
    ("start_month", IntegerType()),
    ("total_affected", DoubleType()),
)

PRICE_LONG = _schema(
    ("date", DateType()),
    ("region", StringType()),
    ("apertura", StringType()),
    ("index", DoubleType()),
)

# A monthly long panel, the form every series source is turned into.
LONG_PANEL = _schema(("entity", StringType()), ("period_idx", IntegerType()), ("value", DoubleType()))

# The given tables. A declared schema spares each scan the job that reads footers.
GIVEN_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
}
