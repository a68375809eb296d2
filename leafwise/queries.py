"""Registered queries over the test tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafwise.functions import documents as D, encodings, names, protos, schemas, sql, uris, variants as V
from leafwise.kernel.wire import Pool
from leafwise.operators import documents as O
from leafwise.plans import messages, paths
from leafwise.sources import files
from leafwise.sources.shared import shared_path
from leafwise.streaming import flows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, doc): each order with its lines as one JSON text."""
    lines = table(spark, sf_dir, "lineitem")
    fields = [F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("qty"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), F.col("l_returnflag").alias("flag")]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    # ties of line numbers are ordered by all that is shown
    order = ["l_linenumber", "l_partkey", F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"), "l_returnflag"]
    both = O.nested(orders, lines, F.col("o_orderkey") == F.col("l_orderkey"), "o_orderkey", "l_orderkey", "lines", fields, order)
    doc = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "O").alias("open"), F.col("lines")))
    return both.select("o_orderkey", doc.alias("doc"))


LINES = """lines AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, l_linenumber AS n, l_partkey AS part, l_quantity::bigint AS qty, round(l_extendedprice * 100)::bigint AS cents, l_returnflag AS flag,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_quantity::bigint, round(l_extendedprice * 100)::bigint, l_returnflag) - 1 AS i
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
), heads AS (SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus FROM lines)"""
LEAVES = f"""{LINES}, leaves AS (
  SELECT o_orderkey, 'key' AS path, 'int32' AS vtype, o_orderkey::varchar AS value FROM heads
  UNION ALL SELECT o_orderkey, 'cust', 'int32', o_custkey::varchar FROM heads
  UNION ALL SELECT o_orderkey, 'status', 'string', o_orderstatus FROM heads
  UNION ALL SELECT o_orderkey, 'open', 'bool', (o_orderstatus = 'O')::varchar FROM heads
  UNION ALL SELECT o_orderkey, 'lines.[' || i || '].n', 'int32', n::varchar FROM lines
  UNION ALL SELECT o_orderkey, 'lines.[' || i || '].part', 'int32', part::varchar FROM lines
  UNION ALL SELECT o_orderkey, 'lines.[' || i || '].qty', 'int32', qty::varchar FROM lines
  UNION ALL SELECT o_orderkey, 'lines.[' || i || '].cents', 'int32', cents::varchar FROM lines
  UNION ALL SELECT o_orderkey, 'lines.[' || i || '].flag', 'string', flag FROM lines
)"""
LINE_JSON = """'{"n":' || n || ',"part":' || part || ',"qty":' || qty || ',"cents":' || cents || ',"flag":"' || flag || '"}'"""
DOC = f"""{LINES}, docs AS (
  SELECT o_orderkey, '{{"key":' || o_orderkey || ',"cust":' || any_value(o_custkey) || ',"status":"' || any_value(o_orderstatus) || '","open":' || (any_value(o_orderstatus) = 'O')::varchar || ',"lines":[' || string_agg({LINE_JSON}, ',' ORDER BY i) || ']}}' AS doc
  FROM lines GROUP BY o_orderkey
)"""


# Pointers and values


@query("SELECT event_type, count(*) AS n, sum(json_extract(props, '/k')::bigint)::bigint AS total FROM events GROUP BY event_type")
def ptr_get_sum(spark, sf_dir):
    """One parse a row, one pointer, a partial aggregate: the flagship query."""
    rows = paths.extract(table(spark, sf_dir, "events").select("event_type", "props"), "props", {"k": ("/k", "bigint")})
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("SELECT event_id, coalesce(json_extract(props, '/k')::bigint, -1) AS k, 7::bigint AS missing FROM events")
def ptr_default(spark, sf_dir):
    return paths.extract(table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": ("/k", "bigint"), "missing": ("/nothing/0", "bigint")}, {"k": -1, "missing": 7}).drop("props")


@query("SELECT event_type, sum((json_extract(props, '/k')::bigint > 50)::int)::bigint AS n FROM events GROUP BY event_type")
def ptr_minimal_struct(spark, sf_dir):
    rows = paths.extract_struct(table(spark, sf_dir, "events").select("event_type", "props"), "props", {"k": ("/k", "bigint")})
    return rows.groupBy("event_type").agg(F.sum((F.col("k") > 50).cast("bigint")).alias("n"))


@query("SELECT event_id, json_exists(props, '/k') AS has_k, json_exists(props, '/zz') AS has_zz, len(json_keys(props))::bigint AS members FROM events")
def ptr_has_member(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", V.has_member(v, "k").alias("has_k"), paths.has(v, "/zz").alias("has_zz"), V.member_count(v).cast("bigint").alias("members"))


@query(f"WITH {LINES} SELECT o_orderkey, any_value(part) FILTER (i = 0) AS part, 'int32' AS kind, 1::bigint AS unresolved FROM lines GROUP BY o_orderkey")
def ptr_get_exact(spark, sf_dir):
    docs = orders_doc(spark, sf_dir).withColumn("a", D.pointer_get("doc", "/lines/0/part")).withColumn("b", D.pointer_get("doc", "/lines/01"))
    return docs.select("o_orderkey", F.col("a.value").cast("bigint").alias("part"), F.col("a.kind").alias("kind"), F.col("b.unresolved").cast("bigint").alias("unresolved"))


@query(f"""WITH {LINES} SELECT o_orderkey, p AS pointer FROM heads, (VALUES (''), ('/key'), ('/cust'), ('/status'), ('/open'), ('/lines')) v(p)
UNION ALL SELECT o_orderkey, '/lines/' || i || p FROM lines, (VALUES (''), ('/n'), ('/part'), ('/qty'), ('/cents'), ('/flag')) v(p)""")
def ptr_traverse(spark, sf_dir):
    return O.traverse_rows(orders_doc(spark, sf_dir), "doc", ["o_orderkey"]).select("o_orderkey", "pointer")


@query(f"""WITH {DOC} SELECT o_orderkey, regexp_replace(doc, '"status":"[^"]*"', '"status":{{"code":5}}') AS set_doc, regexp_replace(doc, '"status":"[^"]*",', '') AS erased_doc,
'"' || regexp_extract(doc, '"status":"([^"]*)"', 1) || '"' AS swapped, regexp_replace(doc, '\\}}$', ',"note":null}}') AS created, regexp_replace(doc, '\\}}$', ',"note":[1]}}') AS defaulted FROM docs""")
def ptr_edit(spark, sf_dir):
    docs = orders_doc(spark, sf_dir)
    return docs.select(
        "o_orderkey", D.pointer_set("doc", "/status", F.lit('{"code":5}')).alias("set_doc"), D.pointer_erase("doc", "/status")["text"].alias("erased_doc"), D.pointer_swap("doc", "/status", F.lit("1"))["value"].alias("swapped"),
        D.pointer_create("doc", "/note").alias("created"), D.pointer_default("doc", "/note", "[1]")["text"].alias("defaulted"),
    )


@query(f"WITH {DOC} SELECT o_orderkey, array_to_string(list_sort(json_keys(doc)), ',') AS names, len(json_keys(doc))::bigint AS members, json_array_length(doc, '/lines')::bigint AS lines FROM docs")
def obj_keys(spark, sf_dir):
    of = lambda v: F.struct(F.array_join(F.array_sort(F.map_keys(V.members(v))), ",").alias("names"), V.member_count(v).cast("bigint").alias("members"), V.array_length(V.get(v, "$.lines")).cast("bigint").alias("lines"))
    return orders_doc(spark, sf_dir).select("o_orderkey", F.inline(F.transform(F.array(F.try_parse_json("doc")), of)))


@query(f"WITH {LINES} SELECT 'integer' AS kind, 'cust' AS name, count(*) AS n FROM heads UNION ALL SELECT 'integer', 'key', count(*) FROM heads UNION ALL SELECT 'string', 'status', count(*) FROM heads UNION ALL SELECT 'boolean', 'open', count(*) FROM heads UNION ALL SELECT 'array', 'lines', count(*) FROM heads")
def type_profile(spark, sf_dir):
    rows = orders_doc(spark, sf_dir).select(F.explode(V.members(F.try_parse_json("doc"))).alias("name", "v"))
    return rows.groupBy(V.kind(F.col("v")).alias("kind"), "name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract(props, '/k')::bigint BETWEEN -2147483648 AND 2147483647 AS i32, true AS u64, false AS dbl, true AS lossless, 'int32' AS exact_kind FROM events")
def type_tests(spark, sf_dir):
    v = V.get(F.try_parse_json("props"), "$.k")
    return table(spark, sf_dir, "events").select("event_id", V.is_int32(v).alias("i32"), V.is_uint64(v).alias("u64"), (V.kind(v) == "double").alias("dbl"), V.is_lossless_double(v).alias("lossless"), D.pointer_get("props", "/k")["kind"].alias("exact_kind"))


@query("SELECT event_id, true AS same, false AS other FROM events")
def json_equality(spark, sf_dir):
    a, k = F.concat(F.lit('{"a":[1,2.0],"p":'), F.col("props"), F.lit("}")), F.get_json_object("props", "$.k")
    b = F.concat(F.lit('{"p":{"k":'), k, F.lit('.0},"a":[1.0,2]}'))
    return table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"), "props").select("event_id", D.json_equal("a", "b").alias("same"), D.json_equal("a", "props").alias("other"))


@query("SELECT event_id, '{\"k\":' || json_extract(props, '/k') || ',\"z\":[1,2]}' AS added, '{}' AS removed, '[1,3]' AS edited FROM events")
def container_edits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", D.add_member("props", "z", F.lit("[1,2]")).alias("added"), D.remove_member("props", "k").alias("removed"), D.array_edit(F.concat(F.lit("[1,2]"), F.substring("props", 1, 0)), erase=(1, 2), push="3").alias("edited"))


# Flat form


@query(f"WITH {LEAVES} SELECT o_orderkey, path, value FROM leaves")
def flatten_static(spark, sf_dir):
    schema = "key bigint, cust bigint, status string, open boolean, lines array<struct<n:bigint,part:bigint,qty:bigint,cents:bigint,flag:string>>"
    from pyspark.sql.types import _parse_datatype_string

    return O.flatten_rows(orders_doc(spark, sf_dir), "doc", ["o_orderkey"], "static", schema=_parse_datatype_string(schema))


@query(f"WITH {LEAVES} SELECT o_orderkey, path, value FROM leaves")
def flatten_recursive(spark, sf_dir):
    return O.flatten_rows(orders_doc(spark, sf_dir), "doc", ["o_orderkey"], "recursive")


@query(f"WITH {LEAVES} SELECT o_orderkey, path, vtype, value FROM leaves")
def flatten_rows(spark, sf_dir):
    return O.flatten_rows(orders_doc(spark, sf_dir), "doc", ["o_orderkey"]).drop("ord")


@query(f"WITH {LEAVES} SELECT o_orderkey, path, vtype, CASE WHEN vtype = 'int32' THEN value::bigint END AS i, CASE WHEN vtype = 'string' THEN value END AS s, CASE WHEN vtype = 'bool' THEN value = 'true' END AS b FROM leaves")
def flatten_rows_typed(spark, sf_dir):
    rows = orders_doc(spark, sf_dir).select("o_orderkey", F.explode(D.flatten_typed("doc")).alias("e"))
    return rows.select("o_orderkey", "e.path", "e.value.vtype", "e.value.i", "e.value.s", "e.value.b")


@query(f"WITH {LEAVES} SELECT o_orderkey, count(*) AS n, any_value(value) FILTER (path = 'lines.[0].qty') AS first_qty FROM leaves GROUP BY o_orderkey")
def flatten_map(spark, sf_dir):
    docs = orders_doc(spark, sf_dir).withColumn("kv", D.flatten_map("doc"))
    return docs.select("o_orderkey", F.size("kv").cast("bigint").alias("n"), protos.kv_get("kv", "lines.[0].qty").alias("first_qty"))


@query("SELECT event_id, '{' || chr(10) || '    \"k\": ' || json_extract(props, '/k') || chr(10) || '}' AS flat FROM events")
def flatten_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", D.flatten_json("props").alias("flat"))


@query(f"WITH {LEAVES} SELECT regexp_replace(path, '\\[[0-9]+\\]', '[]') AS path, count(*) AS n, min(value) AS least, max(value) AS greatest FROM leaves GROUP BY 1")
def flatten_path_stats(spark, sf_dir):
    return O.path_stats(flatten_rows(spark, sf_dir)).drop("about_distinct")


@query("SELECT event_id, 'k' AS path, json_extract(props, '/k')::varchar AS value FROM events")
def flatten_first_dup(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.substring_index("props", "}", 1), F.lit(',"k":-1,"k":"again"}')).alias("doc"))
    return O.first_of_path(O.flatten_rows(events, "doc", ["event_id"]), ["event_id"]).select("event_id", "path", "value")


@query(f"WITH {DOC} SELECT o_orderkey, doc FROM docs")
def unflatten_round_trip(spark, sf_dir):
    return O.unflatten_rows(O.flatten_rows(orders_doc(spark, sf_dir), "doc", ["o_orderkey"]), ["o_orderkey"])


@query("SELECT event_id, 'k=' || json_extract(props, '/k') || chr(10) AS kv FROM events")
def flat_kv_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", D.kv_text(D.flatten_map("props")).alias("kv"))


@query(f"WITH {LEAVES} SELECT DISTINCT path, len(string_split(path, '.'))::bigint AS n, string_split(path, '.')[1] AS head, starts_with(path, 'lines') AS has_array, CASE WHEN starts_with(path, 'lines') THEN regexp_extract(path, '[0-9]+')::bigint END AS idx FROM leaves")
def flat_key_parse(spark, sf_dir):
    rows = flatten_rows(spark, sf_dir).select("path").distinct().withColumn("k", D.parse_flat_key("path"))
    return rows.select("path", F.size("k").cast("bigint").alias("n"), F.col("k")[0]["key"].alias("head"), F.col("k")[0]["has_array"].alias("has_array"), F.get(F.col("k"), F.lit(1))["index"].alias("idx"))


@query(f"WITH {LEAVES} SELECT o_orderkey, path, value, 'left' AS side FROM leaves WHERE path = 'status' UNION ALL SELECT o_orderkey, path, lower(value), 'right' FROM leaves WHERE path = 'status'")
def doc_diff(spark, sf_dir):
    docs = orders_doc(spark, sf_dir)
    changed = docs.withColumn("doc", F.regexp_replace("doc", '"status":"O"', '"status":"o"')).withColumn("doc", F.regexp_replace("doc", '"status":"F"', '"status":"f"')).withColumn("doc", F.regexp_replace("doc", '"status":"P"', '"status":"p"'))
    return O.doc_diff(docs, changed, "doc", ["o_orderkey"])


# Writing and transforms


@query(f"WITH {DOC} SELECT o_orderkey, doc AS condensed, length(doc) AS size FROM docs")
def condense(spark, sf_dir):
    docs = orders_doc(spark, sf_dir).withColumn("spaced", D.pretty("doc"))
    return docs.select("o_orderkey", D.condense("spaced").alias("condensed"), F.length("doc").cast("bigint").alias("size"))


@query(f"WITH {LINES} SELECT o_orderkey, (8 + count(*) * 7)::bigint AS n_lines, 5 + count(*) AS n_inline FROM lines GROUP BY o_orderkey".replace("5 + count(*)", "7::bigint"))
def pretty(spark, sf_dir):
    docs = orders_doc(spark, sf_dir).withColumn("p", D.pretty("doc")).withColumn("q", D.pretty(D.pointer_set("doc", "/lines", F.lit("[1,2]")), single_line_arrays=True))
    return docs.select("o_orderkey", F.size(F.split("p", "\n")).cast("bigint").alias("n_lines"), F.size(F.split("q", "\n")).cast("bigint").alias("n_inline"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}' AS doc, true AS same FROM part""")
def sort_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))).alias("doc"))
    return docs.select("p_partkey", D.sort_keys("doc").alias("doc"), (D.sort_keys("doc") == D.sort_keys("doc", exact=False)).alias("same"))


@query(f"WITH {DOC} SELECT o_orderkey, regexp_replace(doc, '\"flag\":\"[^\"]*\"', '', 'g').replace(',}}', '}}') AS doc FROM docs")
def drop_key(spark, sf_dir):
    return orders_doc(spark, sf_dir).select("o_orderkey", D.drop_key("doc", "flag").alias("doc"))


@query("""SELECT p_partkey, '{"name":"' || upper(p_name) || '","size":' || p_size || '}' AS doc FROM part""")
def capitalize_strings(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))).alias("doc"))
    return docs.select("p_partkey", D.capitalize("doc", names=False).alias("doc"))


@query("SELECT event_id, '<json:number name=\"k\">' || json_extract(props, '/k') || '</json:number></json:object>' AS tail FROM events")
def jsonx(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract(D.jsonx("props"), "(<json:number.*)$", 1).alias("tail"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, length(text) AS size FROM documents")
def json_escape_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", D.pointer_get(D.escape("text"), "")["value"].alias("again"))
    back = F.from_json(F.concat(F.lit('{"v":'), F.col("again"), F.lit("}")), "v string")["v"]
    return docs.select("doc_id", F.sha2(F.coalesce(back, F.lit("")), 256).alias("digest"), F.length(back).cast("bigint").alias("size"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, (round(l_extendedprice * 100)::bigint // 100)::varchar || '.' || CASE WHEN round(l_extendedprice * 100)::bigint % 10 = 0 THEN (round(l_extendedprice * 100)::bigint // 10 % 10)::varchar ELSE lpad((round(l_extendedprice * 100)::bigint % 100)::varchar, 2, '0') END AS shown FROM lineitem")
def double_format(spark, sf_dir):
    price = F.round(F.col("l_extendedprice") * 100) / 100
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", D.format_double(price).alias("shown"))


@query("SELECT conv_id, '[' || string_agg('{\"turn\":' || turn || ',\"role\":' || CASE WHEN role IS NULL THEN 'null' ELSE '\"' || role || '\"' END || ',\"size\":' || coalesce(length(text), 0) || '}', ',' ORDER BY turn, role, coalesce(length(text), 0)) || ']' AS doc FROM conversations GROUP BY conv_id")
def conversation_doc(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce(F.length("text"), F.lit(0)).alias("size")).alias("t"))
    return turns.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list("t")), {"ignoreNullFields": "false"}).alias("doc"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_custkey::varchar AS cust FROM orders")
def message_reader(spark, sf_dir):
    """Flat objects of strings as maps."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("cust"))).alias("doc"))
    m = F.from_json("doc", "map<string,string>")
    return docs.select("o_orderkey", m["status"].alias("status"), m["cust"].alias("cust"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_custkey AS cust, 2::bigint AS n FROM orders")
def archive_round_trip(spark, sf_dir):
    """Structs to JSON and back by their type."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"), F.array(F.lit(1), F.lit(2)).alias("xs")).alias("s"))
    back = rows.select("o_orderkey", F.from_json(F.to_json("s"), rows.schema["s"].dataType).alias("s"))
    return back.select("o_orderkey", "s.status", "s.cust", F.size("s.xs").cast("bigint").alias("n"))


@query("SELECT event_id, 'k' AS path, json_extract(props, '/k')::varchar AS value, '{\"k\":' || json_extract(props, '/k') || '}' AS doc, true AS valid FROM events")
def sql_functions(spark, sf_dir):
    """The registered SQL functions and table functions."""
    sql.register(spark)
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return spark.sql("SELECT e.event_id, f.path, f.value, lw_condense(e.props) AS doc, lw_is_json(e.props) AS valid FROM {events} e, LATERAL lw_flatten(e.props) f", events=events)


# Parsing


CORPUS = [
    "", " ", "1 2", "nulL", "[1,]", '{"a":1,}', "{1:2}", '{"a" 1}', '{"a":1', "[1 2]", '"\\u12G4"', '"\\uD800"', '"\\x"', '"abc', '"a\x01"', "1e400", "1.", "1e+", "NaN", "01", "'a'", "[1}", '{"a":1,"a":2}', "[[[[]]]]", '"\\ud83d\\ude00"', "-0", "1E5",
]


#: Of each text of the corpus: number and name of its error, and the byte offset.
ERRORS = [
    (1, "DocumentEmpty", 0), (1, "DocumentEmpty", 1), (2, "DocumentRootNotSingular", 2), (3, "ValueInvalid", 3), (3, "ValueInvalid", 3), (4, "ObjectMissName", 7), (4, "ObjectMissName", 1), (5, "ObjectMissColon", 5),
    (6, "ObjectMissCommaOrCurlyBracket", 6), (7, "ArrayMissCommaOrSquareBracket", 3), (8, "StringUnicodeEscapeInvalidHex", 1), (9, "StringUnicodeSurrogateInvalid", 1), (10, "StringEscapeInvalid", 1),
    (11, "StringMissQuotationMark", 4), (12, "StringInvalidEncoding", 2), (13, "NumberTooBig", 0), (14, "NumberMissFraction", 2), (15, "NumberMissExponent", 3), (3, "ValueInvalid", 0), (2, "DocumentRootNotSingular", 1),
    (3, "ValueInvalid", 0), (7, "ArrayMissCommaOrSquareBracket", 2), (0, "None", 13), (0, "None", 8), (0, "None", 14), (0, "None", 2), (0, "None", 3),
]
_ERROR_ROWS = ", ".join("({}, {}, '{}', {}, {})".format(k, " || chr(1) || ".join("'" + part.replace("'", "''") + "'" for part in doc.split(chr(1))), code, number, at) for k, (doc, (number, code, at)) in enumerate(zip(CORPUS, ERRORS, strict=True)))


@query(f'SELECT id::int AS id, doc, code, number::int AS number, place::bigint AS "offset", 1::bigint AS line, (place + 1)::bigint AS "column", number = 0 AS valid FROM (VALUES {_ERROR_ROWS}) v(id, doc, code, number, place)')
def parse_error_codes(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(CORPUS)), "id int, doc string").withColumn("s", D.parse_status("doc"))
    return rows.select("id", "doc", "s.code", "s.number", "s.offset", "s.line", "s.column", D.is_json("doc").alias("valid"))


@query("SELECT event_id, 3::bigint AS n_docs, json_extract(props, '/k')::varchar AS last FROM events")
def split_docs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.col("props"), F.lit(' ["x"]\n'), F.get_json_object("props", "$.k")).alias("doc"))
    rows = O.split_rows(events, "doc", ["event_id"])
    return rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max_by("text", "doc_idx").alias("last"))


@query(f"WITH {LINES} SELECT o_orderkey, 15 + 12 * count(*) - 2 AS n, (5 + 5 * count(*))::bigint AS n_keys, 4::bigint AS max_depth FROM lines GROUP BY o_orderkey".replace("15 + 12 * count(*) - 2", "(2 + 5 + 4 + 2 + 12 * count(*))::bigint").replace("4::bigint", "3::bigint"))
def token_rows(spark, sf_dir):
    rows = O.token_rows(orders_doc(spark, sf_dir), "doc", ["o_orderkey"])
    return rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("kind") == "key").cast("bigint")).alias("n_keys"), F.max("depth").cast("bigint").alias("max_depth"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, CASE WHEN text IS NULL THEN NULL ELSE true END AS same FROM documents")
def encodings_round_trip(spark, sf_dir):
    """Text through UTF-16 with a mark, and back by detection."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", encodings.decode_text(encodings.encode_text(F.col("text"), "UTF-16LE", mark=True)).alias("back"))
    return docs.select("doc_id", F.sha2(F.coalesce("back", F.lit("")), 256).alias("digest"), (F.col("back") == F.col("text")).alias("same"))


@query("SELECT doc_id, sha256(base64(encode(text))) AS digest, length(text) AS size FROM documents WHERE text IS NOT NULL")
def base64_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("b", encodings.to_base64(F.encode("text", "UTF-8")))
    return docs.select("doc_id", F.sha2("b", 256).alias("digest"), F.length(F.decode(encodings.from_base64(F.col("b")), "UTF-8")).cast("bigint").alias("size"))


# Names and URIs


@query("""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_brand, '#', '_Z035_', 'g'), ' ', '_Z032_', 'g'), '^([0-9])', '_Z0\\1_') AS encoded, p_brand AS decoded FROM part""")
def name_encode(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.encode_name("p_brand").alias("encoded"), names.decode_name(names.encode_name("p_brand")).alias("decoded"))


@query("SELECT p_partkey, 'aBc_' || upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2) AS camel, p_name || '*_Z999_' AS decoded FROM part".replace("'aBc_' ||", "'aBc' ||"))
def name_camel(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.camel(F.concat(F.lit("a_bc_"), F.lower("p_type"))).alias("camel"), names.decode_name(F.concat("p_name", F.lit("_Z042__Z999_"))).alias("decoded"))


URI_SQL = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$', {})"


@query("SELECT page_id, " + ", ".join(f"{URI_SQL.format(k)} AS {n}" for k, n in enumerate(uris.PARTS, 1)) + ", regexp_replace(url, '#.*$', '') AS base FROM pages")
def uri_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", uris.parse_uri("url").alias("u")).select("page_id", *[f"u.{n}" for n in (*uris.PARTS, "base")])


@query("SELECT page_id, regexp_replace(url, '#.*$', '') || '#x' = url AS same, true AS same_base FROM pages")
def uri_base_match(spark, sf_dir):
    u, w = uris.parse_uri("url"), uris.parse_uri(F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#x")))
    return table(spark, sf_dir, "pages").select("page_id", uris.match_uri(u, w).alias("same"), uris.match_uri(u, w, full=False).alias("same_base"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/a/c?q' AS up, regexp_replace(url, '#.*$', '') || '#f' AS frag, regexp_extract(url, '^[a-z]+:') || '//other/x' AS net FROM pages")
def uri_resolve(spark, sf_dir):
    base = uris.parse_uri("url")
    against = lambda r: uris.resolve_uri(uris.parse_uri(F.lit(r)), base)
    return table(spark, sf_dir, "pages").select("page_id", against("/a/b/../c?q").alias("up"), against("#f").alias("frag"), against("//other/./x").alias("net"))


# Schemas


def _line_docs(spark, sf_dir) -> DataFrame:
    doc = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("bigint").alias("qty"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_linestatus") == "F", F.col("l_partkey")).alias("part"), F.array(F.col("l_linenumber").cast("bigint"), F.col("l_suppkey")).alias("pair"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.to_json(doc).alias("doc"))


#: Keyword: (schema, SQL of the predicate).
RULES: dict[str, tuple[dict, str]] = {
    "type": ({"properties": {"part": {"type": "integer"}, "flag": {"type": ["string", "null"]}, "n": {"type": "number"}}}, "true"),
    "range": ({"properties": {"qty": {"minimum": 10, "maximum": 40, "exclusiveMaximum": True}}}, "qty >= 10 AND qty < 40"),
    "multiple_of": ({"properties": {"qty": {"multipleOf": 3}}}, "qty % 3 = 0"),
    "length": ({"properties": {"flag": {"minLength": 1, "maxLength": 1}}}, "length(flag) = 1"),
    "pattern": ({"properties": {"flag": {"pattern": "^[AN]$"}}}, "flag IN ('A', 'N')"),
    "enum": ({"properties": {"flag": {"enum": ["R", "N", None, 3]}}}, "flag IN ('R', 'N')"),
    "required": ({"required": ["part", "n"]}, "part IS NOT NULL"),
    "unique_items": ({"properties": {"pair": {"uniqueItems": True}}}, "n <> supp"),
    "items": ({"properties": {"pair": {"items": {"maximum": 5}, "minItems": 2, "maxItems": 2}}}, "n <= 5 AND supp <= 5"),
    "tuple_items": ({"properties": {"pair": {"items": [{"minimum": 3}], "additionalItems": {"minimum": 2}}}}, "n >= 3 AND supp >= 2"),
    "additional": ({"properties": {"n": {}, "qty": {}, "flag": {}}, "patternProperties": {"^pai": {}}, "additionalProperties": False}, "part IS NULL"),
    "properties_count": ({"minProperties": 5}, "part IS NOT NULL"),
    "dependencies": ({"dependencies": {"part": {"properties": {"qty": {"minimum": 20}}}, "n": ["flag"]}}, "part IS NULL OR qty >= 20"),
    "all_of": ({"allOf": [{"required": ["n"]}, {"properties": {"n": {"maximum": 3}}}]}, "n <= 3"),
    "any_of": ({"anyOf": [{"properties": {"n": {"minimum": 4}}}, {"required": ["part"]}]}, "n >= 4 OR part IS NOT NULL"),
    "one_of": ({"oneOf": [{"properties": {"n": {"minimum": 4}}}, {"required": ["part"]}]}, "(n >= 4) <> (part IS NOT NULL)"),
    "not": ({"not": {"properties": {"flag": {"enum": ["R"]}}}}, "flag <> 'R'"),
    "ref": ({"definitions": {"small": {"maximum": 25}}, "properties": {"qty": {"$ref": "#/definitions/small"}}}, "qty <= 25"),
}


def _rule_query(name: str, rule: dict, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _line_docs(spark, sf_dir)
        schema = schemas.compile_schema(json.dumps(rule))
        return docs.select("l_orderkey", "l_linenumber", "l_partkey", schemas.is_valid("doc", schema, "native").alias("valid"))

    QUERIES[f"schema_{name}"] = run
    ORACLE_SQL[f"schema_{name}"] = f"""SELECT l_orderkey, l_linenumber, l_partkey, ({sql}) AS valid FROM (
SELECT *, l_linenumber AS n, l_quantity::bigint AS qty, l_returnflag AS flag, CASE WHEN l_linestatus = 'F' THEN l_partkey END AS part, l_suppkey AS supp FROM lineitem)"""


for _name, (_rule, _sql) in RULES.items():
    _rule_query(_name, _rule, _sql)


@query(f"WITH {LINES} SELECT o_orderkey, max(qty) <= 45 AS valid, CASE WHEN max(qty) > 45 THEN 'maximum' END AS keyword, CASE WHEN max(qty) > 45 THEN '#/lines/' || min(i) FILTER (qty > 45) || '/qty' END AS instance_ref, (count(*) FILTER (qty > 45))::bigint AS n_errors FROM lines GROUP BY o_orderkey")
def schema_report(spark, sf_dir):
    schema = schemas.compile_schema('{"properties":{"lines":{"items":{"properties":{"qty":{"maximum":45}}}}}}')
    docs = orders_doc(spark, sf_dir).withColumn("r", schemas.validate("doc", schema, True))
    errors = F.when(F.col("r.valid"), 0).otherwise(F.size(F.split("r.message", "\n")))
    return docs.select("o_orderkey", "r.valid", "r.keyword", "r.instance_ref", errors.cast("bigint").alias("n_errors"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::bigint > 30 AS bad, CASE WHEN l_quantity::bigint > 30 THEN '#/qty: Number ''' || l_quantity::bigint || ''' is greater than the ''maximum'' value ''30''.' END AS message FROM lineitem")
def schema_route(spark, sf_dir):
    """Only rows that fail the native predicate reach the error kernel."""
    good, bad = O.validated(_line_docs(spark, sf_dir), "doc", schemas.compile_schema('{"properties":{"qty":{"maximum":30}}}'))
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return good.select(*keys, F.lit(False).alias("bad"), F.lit(None).cast("string").alias("message")).unionByName(bad.select(*keys, F.lit(True).alias("bad"), F.col("report.message").alias("message")))


# Protobuf


POOL = Pool.declare(
    {
        "Flag": {"NONE": 0, "A": 1, "N": 2, "R": 3},
        "Attribute": {"key": (1, "string"), "value": (2, "int64")},
        "Line": {"order": (1, "int64", "required"), "number": (2, "sint32"), "part": (3, "uint64"), "quantity": (4, "double"), "flag": (5, "Flag"), "tags": (6, "string", "repeated"), "extra": (7, "Attribute", "repeated"), "raw": (8, "bytes")},
    }
)
LINE_SQL = "l_orderkey, l_linenumber, l_partkey"


def _lines(spark, sf_dir) -> DataFrame:
    """(keys, doc, pb): line items as messages."""
    doc = F.to_json(F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("number"), F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.array("l_returnflag", "l_linestatus").alias("tags"), F.struct(F.col("l_suppkey").alias("supp")).alias("extra"), F.base64(F.encode("l_linestatus", "UTF-8")).alias("raw")))
    rows = files.widened(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", doc.alias("doc")))
    return rows.withColumn("pb", protos.json_to_pb("doc", POOL, "Line"))


@query(f"SELECT {LINE_SQL}, 'ok' AS code, '{{\"order\":' || l_orderkey || ',\"number\":' || l_linenumber || ',\"part\":' || l_partkey || ',\"flag\":\"' || l_returnflag || '\",\"tags\":[\"' || l_returnflag || '\",\"' || l_linestatus || '\"],\"raw\":\"' || base64(encode(l_linestatus)) || '\",\"extra\":{{\"supp\":' || l_suppkey || '}}}}' AS doc FROM lineitem")
def pb_roundtrip(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("j", protos.pb_to_json(F.col("pb.msg"), POOL, "Line"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "pb.code", D.drop_key(F.col("j.text"), "quantity").alias("doc"))


@query(f"SELECT {LINE_SQL}, l_quantity AS quantity, l_returnflag AS flag, l_suppkey AS supp FROM lineitem")
def pb_decode(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("m", messages.pb_decode(F.col("pb.msg"), POOL, "Line"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "m.quantity", "m.flag", F.col("m.extra")["supp"].alias("supp"))


@query(f"SELECT {LINE_SQL}, p AS path, CASE p WHEN 'order' THEN l_orderkey::varchar WHEN 'number' THEN l_linenumber::varchar WHEN 'part' THEN l_partkey::varchar WHEN 'flag' THEN l_returnflag WHEN 'tags.[0]' THEN l_returnflag WHEN 'tags.[1]' THEN l_linestatus WHEN 'extra.supp' THEN l_suppkey::varchar ELSE base64(encode(l_linestatus)) END AS value FROM lineitem, (VALUES ('order'), ('number'), ('part'), ('flag'), ('tags.[0]'), ('tags.[1]'), ('extra.supp'), ('raw')) v(p)")
def pb_flatten(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.explode(protos.pb_flatten(F.col("pb.msg"), POOL, "Line")).alias("e"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "e.path", F.col("e.value.text").alias("value")).where("path <> 'quantity'")


@query(f"SELECT {LINE_SQL}, l_returnflag || '/x/' || (l_suppkey + 1) AS after, CASE WHEN l_linenumber % 2 = 0 THEN 'tags: repeated field requires index in flat key' END AS message FROM lineitem")
def flatproto_set(spark, sf_dir):
    """Flat entries written back into messages; an entry that is refused ends the list."""
    entry = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"))
    supp = (F.get_json_object("doc", "$.extra.supp").cast("bigint") + 1).cast("string")
    entries = F.array(entry("extra.supp", supp), entry("tags.[1]", F.lit("x")), F.when(F.col("l_linenumber") % 2 == 0, entry("tags", F.lit("y"))).otherwise(entry("tags.[3]", F.lit("z"))))
    rows = _lines(spark, sf_dir).withColumn("w", protos.pb_set(F.col("pb.msg"), entries, POOL, "Line")).withColumn("m", messages.pb_decode(F.col("w.msg"), POOL, "Line"))
    after = F.concat_ws("/", F.col("m.tags")[0], F.col("m.tags")[1], F.col("m.extra")["supp"].cast("string"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", after.alias("after"), "w.message")


@query(f"SELECT {LINE_SQL}, 'invalid_argument' AS code, 'Missing required field: Line.order' AS message FROM lineitem")
def json_to_pb_errors(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("bad", protos.json_to_pb(D.drop_key("doc", "order"), POOL, "Line"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "bad.code", "bad.message")


# Streams


@query("SELECT date_trunc('hour', ts) AS start, event_type, 'k' AS path, count(*) AS n, sum(json_extract(props, '/k')::double) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Documents of an event stream flattened and summed by hour, with a watermark; run to the end of what is there."""
    events = table(spark, sf_dir, "events")
    # a pattern, since a plain path of a stream has to be a folder
    stream = flows.read_table(spark, f"{sf_dir}/events.parque[t]", events)
    path = shared_path(spark)
    return flows.run_to_table(flows.windowed_values(stream, "props", "ts", ["event_type"], late="36500 days"), f"{path}/out", f"{path}/checkpoint", "complete")


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return ptr_get_sum(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "entry", "orders_doc"]

from leafwise import parity  # noqa: E402, F401  registers more queries
