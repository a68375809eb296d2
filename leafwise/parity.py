"""Further registered queries: options of parser, writer and codecs, pointer forms, schema dialects, streams and sources,
each over a whole table with its DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from leafwise.functions import documents as D, encodings, protos, schemas
from leafwise.kernel.wire import Pool
from leafwise.options import JsonToPb, ParseFlags, PbToJson, WriteFlags
from leafwise.queries import LEAVES, flatten_rows, query, table
from leafwise.sources import files
from leafwise.sources.shared import shared_path
from leafwise.streaming import flows

K = "json_extract(props, '/k')::varchar"


def events(spark, sf_dir) -> DataFrame:
    """(event_id, props, k as text, event_type, value, ts)"""
    return table(spark, sf_dir, "events").select("event_id", "props", F.get_json_object("props", "$.k").alias("k"), "event_type", "value", "ts")


# Parser


@query(f"""SELECT event_id, '{{"k":' || {K} || ',"a":[' || {K} || ']}}' AS loose, 'ObjectMissName' AS strict, '[NaN,-Infinity,Infinity,' || {K} || ']' AS odd, '[null,null,null,' || {K} || ']' AS nulls,
'"it''s ' || {K} || '"' AS quoted, 'StringEscapeInvalid' AS unquoted, '"' || {K} || '.50"' AS digits FROM events""")
def parse_flags(spark, sf_dir):
    """Comments, commas before an end, NaN and infinities, escaped apostrophes, numbers as strings; and without the flags."""
    k, lit = F.col("k"), F.lit
    loose = F.concat(lit('{/*c*/"k":'), k, lit(', // x\n"a":['), k, lit(",],}"))
    odd = F.concat(lit("[NaN,-Inf,Infinity,"), k, lit("]"))
    quoted = F.concat(lit("\"it\\'s "), k, lit('"'))
    flags = ParseFlags(comments=True, trailing_commas=True)
    rows = events(spark, sf_dir).select("event_id", "k", loose.alias("a"), odd.alias("b"), quoted.alias("c"), F.concat(lit('{"x":'), k, lit(".50}")).alias("d"))
    return rows.select(
        "event_id", D.condense("a", flags).alias("loose"), D.parse_status("a")["code"].alias("strict"), D.condense("b", ParseFlags(nan_and_inf=True), WriteFlags(nan_and_inf="literal")).alias("odd"),
        D.condense("b", ParseFlags(nan_and_inf=True), WriteFlags(nan_and_inf="null")).alias("nulls"), D.condense("c", ParseFlags(escaped_apostrophe=True)).alias("quoted"), D.parse_status("c")["code"].alias("unquoted"),
        D.pointer_get("d", "/x", ParseFlags(numbers_as_strings=True))["value"].alias("digits"),
    )


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ObjectMissCommaOrCurlyBracket' WHEN 1 THEN 'DocumentRootNotSingular' WHEN 2 THEN 'ObjectMissColon' WHEN 3 THEN 'StringMissQuotationMark' ELSE 'None' END AS code,
(CASE event_id % 5 WHEN 0 THEN length(props) - 1 WHEN 1 THEN length(props) WHEN 2 THEN 4 WHEN 3 THEN 3 ELSE length(props) END)::bigint AS "offset" FROM events""")
def parse_broken(spark, sf_dir):
    """Documents that are cut off or changed, by kind of fault."""
    broken = F.when(F.col("event_id") % 5 == 0, F.expr("left(props, length(props) - 1)")).when(F.col("event_id") % 5 == 1, F.concat("props", F.lit("x"))).when(F.col("event_id") % 5 == 2, F.replace("props", F.lit(":"), F.lit("="))).when(F.col("event_id") % 5 == 3, F.expr("left(props, 3)")).otherwise(F.col("props"))
    rows = events(spark, sf_dir).select("event_id", broken.alias("doc")).withColumn("s", D.parse_status("doc"))
    return rows.select("event_id", "s.code", "s.offset")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'StringInvalidEncoding' ELSE 'None' END AS code, (CASE WHEN event_id % 3 = 0 THEN 6 + strlen(event_type) ELSE 8 + strlen(event_type) END)::bigint AS "offset", 'None' AS unchecked FROM events""")
def parse_encoding(spark, sf_dir):
    """Bytes that are no UTF-8, with the encoding validated and not."""
    bad = F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("C328"))).otherwise(F.unhex(F.lit("")))
    data = F.concat(F.encode(F.concat(F.lit('{"t":"'), "event_type"), "UTF-8"), bad, F.encode(F.lit('"}'), "UTF-8"))
    rows = events(spark, sf_dir).select("event_id", data.alias("b")).withColumn("s", D.bytes_status("b", ParseFlags(validate_encoding=True)))
    return rows.select("event_id", "s.code", "s.offset", D.bytes_status("b")["code"].alias("unchecked"))


@query(f"""SELECT event_id, '{{"k":' || {K} || '}}' AS text, length(props)::bigint AS "offset" FROM events""")
def parse_first_doc(spark, sf_dir):
    """The first of documents laid end to end, and where it ends."""
    rows = events(spark, sf_dir).select("event_id", D.first_doc(F.concat("props", F.lit(" [1"))).alias("d"))
    return rows.select("event_id", "d.text", "d.offset")


# Writer


@query(f"""SELECT event_id, '{{"\\u00E9":"' || event_type || '\\u2603\\uD83D\\uDE00"}}' AS ascii, '[' || {K} || '.45,-' || {K} || '.4]' AS decimals, '{{"k":' || {K} || ',"r":{{"x" : ' || {K} || ' }}}}' AS raw FROM events""")
def write_flags(spark, sf_dir):
    """ASCII only, decimals cut without rounding, a text spliced in as it stands."""
    k, lit = F.col("k"), F.lit
    rows = events(spark, sf_dir)
    ascii_ = D.condense(F.concat(lit('{"é":"'), "event_type", lit('☃😀"}')), write=WriteFlags(ascii_only=True))
    decimals = D.condense(F.concat(lit("["), k, lit(".456789,-"), k, lit(".40001]")), write=WriteFlags(max_decimals=2))
    return rows.select("event_id", ascii_.alias("ascii"), decimals.alias("decimals"), D.add_raw(D.condense("props"), "r", F.concat(lit('{"x" : '), k, lit(" }"))).alias("raw"))


@query("SELECT p_partkey, '<json:string name=\"n\">' || p_name || '</json:string><json:number name=\"s\">' || p_size || '</json:number><json:null name=\"z\"/><json:array name=\"b\"><json:boolean>' || (p_size > 20)::varchar || '</json:boolean></json:array></json:object>' AS inner FROM part")
def jsonx_kinds(spark, sf_dir):
    doc = F.concat(F.lit('{"n":"'), "p_name", F.lit('","s":'), F.col("p_size").cast("string"), F.lit(',"z":null,"b":['), (F.col("p_size") > 20).cast("string"), F.lit("]}"))
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract(D.jsonx(doc), r"^.*?<json:object[^>]*>(.*)$", 1).alias("inner"))


@query("""SELECT p_partkey, '{' || chr(10) || '  "n": "' || p_name || '",' || chr(10) || '  "a": [' || chr(10) || '    ' || p_size || ',' || chr(10) || '    {}' || chr(10) || '  ]' || chr(10) || '}' AS text FROM part""")
def pretty_text(spark, sf_dir):
    doc = F.concat(F.lit('{"n":"'), "p_name", F.lit('","a":['), F.col("p_size").cast("string"), F.lit(",{}]}"))
    return table(spark, sf_dir, "part").select("p_partkey", D.pretty(doc, indent=2).alias("text"))


# Pointers and edits


@query(f"""SELECT event_id, {K} AS fragment, '{{"a":[' || {K} || ',9]}}' AS appended, '{{"a":[' || {K} || ',null,null,null]}}' AS padded, CASE WHEN {K}::bigint % 2 = 0 THEN 'int32' ELSE 'string' END AS kind FROM events""")
def ptr_forms(spark, sf_dir):
    """The fragment form, - as the place behind the last element, arrays filled up, kinds that differ."""
    doc = F.concat(F.lit('{"a":['), "k", F.lit("]}"))
    mixed = F.when(F.col("k").cast("bigint") % 2 == 0, F.col("k")).otherwise(F.concat(F.lit('"'), "k", F.lit('"')))
    rows = events(spark, sf_dir).select("event_id", doc.alias("doc"), F.concat(F.lit('{"m":'), mixed, F.lit("}")).alias("mixed"))
    return rows.select("event_id", D.pointer_get("doc", "#/a/0")["value"].alias("fragment"), D.pointer_set("doc", "/a/-", F.lit("9")).alias("appended"), D.pointer_create("doc", "/a/3").alias("padded"), D.pointer_get("mixed", "/m")["kind"].alias("kind"))


@query(f"""SELECT event_id, '[' || event_id || ',3,7]' AS edited, '[' || {K} || ',' || event_id || ']' AS popped, '[]' AS emptied, CASE WHEN {K}::bigint > 50 THEN '{{"b":1,"c":2}}' ELSE '{{"c":2,"b":1}}' END AS removed FROM events""")
def array_edits(spark, sf_dir):
    array = F.concat(F.lit("["), "k", F.lit(","), F.col("event_id").cast("string"), F.lit(",3]"))
    big = F.col("k").cast("bigint") > 50
    doc = F.lit('{"a":0,"b":1,"c":2}')
    rows = events(spark, sf_dir)
    return rows.select("event_id", D.array_edit(array, erase=(0, 1), push="7").alias("edited"), D.array_edit(array, pop=True).alias("popped"), D.array_edit(array, erase=(0, 3)).alias("emptied"), F.when(big, D.remove_member(doc, "a")).otherwise(D.remove_member(doc, "a", keep_order=False)).alias("removed"))


@query(f"""SELECT event_id, {K}::bigint % 2 = 0 AS same, CASE {K}::bigint % 3 WHEN 0 THEN 'uint64' WHEN 1 THEN 'double' ELSE 'int64' END AS kind FROM events""")
def value_kinds(spark, sf_dir):
    """Equality in any order of members; kinds of numbers by size and form."""
    k = F.col("k").cast("bigint")
    a, b = F.concat(F.lit('{"x":1,"y":['), "k", F.lit("]}")), F.concat(F.lit('{"y":['), F.when(k % 2 == 0, F.concat("k", F.lit(".0"))).otherwise(F.lit("-1")), F.lit('],"x":1}'))
    number = F.when(k % 3 == 0, F.lit("18446744073709551615")).when(k % 3 == 1, F.lit("18446744073709551616")).otherwise(F.lit("-9223372036854775808"))
    return events(spark, sf_dir).select("event_id", D.json_equal(a, b).alias("same"), D.value_kind(number).alias("kind"))


# Schemas


@query("SELECT p_partkey, length(p_name) BETWEEN 12 AND 16 AS length_ok, p_size % 4 BETWEEN 1 AND 2 AS items_ok, p_size % 3 <> 2 AS type_ok, p_size % 5 = 0 AS multiple_ok FROM part")
def schema_bounds(spark, sf_dir):
    """Keywords whose outcome varies: lengths, numbers of items, types, multiples of a fraction."""
    size = F.col("p_size")
    text = lambda x: x.cast("string")
    array = F.concat(F.lit("["), F.array_join(F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, size % 4), text), ","), F.lit("]"))
    kinds = F.when(size % 3 == 0, text(size)).when(size % 3 == 1, F.lit("null")).otherwise(F.lit('"s"'))
    rows = table(spark, sf_dir, "part")
    check = lambda rule, doc: schemas.is_valid(doc, schemas.compile_schema(json.dumps(rule)), "exact")
    return rows.select(
        "p_partkey", check({"minLength": 12, "maxLength": 16}, F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("length_ok"), check({"minItems": 1, "maxItems": 2}, array).alias("items_ok"),
        check({"type": ["integer", "null"]}, kinds).alias("type_ok"), check({"multipleOf": 0.5}, text(size / F.lit(10.0))).alias("multiple_ok"),
    )


OPEN_API = {"openapi": "3.0.1", "components": {"schemas": {"Part": {"type": "object", "properties": {"name": {"type": "string", "nullable": True}, "id": {"type": "integer", "readOnly": True}, "key": {"type": "string", "writeOnly": True}}}}}}


@query("SELECT p_partkey, p_size % 3 <> 0 AS writing, p_size % 3 <> 1 AS reading FROM part")
def schema_open_api(spark, sf_dir):
    """OpenAPI 3: nullable, and properties that are only read or only written."""
    size = F.col("p_size")
    doc = F.when(size % 3 == 0, F.lit('{"name":null,"id":5}')).when(size % 3 == 1, F.lit('{"name":null,"key":"x"}')).otherwise(F.concat(F.lit('{"name":"'), "p_name", F.lit('"}')))
    of = lambda mode: schemas.is_valid(doc, schemas.compile_schema(json.dumps(OPEN_API), start="/components/schemas/Part", mode=mode), "exact")
    return table(spark, sf_dir, "part").select("p_partkey", of("write").alias("writing"), of("read").alias("reading"))


@query("SELECT p_partkey, p_size <= 25 AS valid, CASE WHEN p_size > 25 THEN 'maximum' END AS keyword, 7 AS missing FROM part")
def schema_remote(spark, sf_dir):
    """A schema that refers to another document, and the error of one that refers to nothing."""
    held = {"http://example.org/small": json.dumps({"definitions": {"small": {"maximum": 25}}})}
    schema = schemas.compile_schema(json.dumps({"properties": {"size": {"$ref": "http://example.org/small#/definitions/small"}}}), remotes=held)
    missing = schemas.compile_schema('{"$ref":"http://example.org/none"}').errors[0][0]
    rows = table(spark, sf_dir, "part").select("p_partkey", schemas.validate(F.concat(F.lit('{"size":'), F.col("p_size").cast("string"), F.lit("}")), schema).alias("r"))
    return rows.select("p_partkey", "r.valid", "r.keyword", F.lit(missing).alias("missing"))


@query("SELECT p_partkey, p_size > 10 AS valid FROM part")
def schema_default(spark, sf_dir):
    """A required member that has a default may be missing."""
    rule = {"properties": {"size": {"minimum": 11}, "name": {"type": "string", "default": "none"}}, "required": ["size", "name"]}
    return table(spark, sf_dir, "part").select("p_partkey", schemas.is_valid(F.concat(F.lit('{"size":'), F.col("p_size").cast("string"), F.lit("}")), schemas.compile_schema(json.dumps(rule)), "exact").alias("valid"))


# Messages


MORE = Pool.declare(
    {
        "google.protobuf.Any": {"type_url": (1, "string"), "value": (2, "bytes")},
        "List": {"ids": (1, "int64", "repeated")},
        "Wide": {"the_key": (1, "int64"), "detail": (2, "google.protobuf.Any"), "big_list": (3, "uint64", "repeated"), "ratio": (4, "double")},
    }
)


@query(f"""SELECT event_id, '[' || event_id || ',' || {K} || ']' AS list, '{{"ids":[' || event_id || ',' || {K} || ']}}' AS object, 'invalid_argument' AS refused FROM events""")
def pb_single_repeated(spark, sf_dir):
    """A message of one repeated field as an array, both ways."""
    array = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(","), "k", F.lit("]"))
    rows = events(spark, sf_dir).select("event_id", array.alias("a")).withColumn("m", protos.json_to_pb("a", MORE, "List", JsonToPb(array_to_single_repeated=True))["msg"])
    return rows.select("event_id", protos.pb_to_json("m", MORE, "List", PbToJson(single_repeated_to_array=True))["text"].alias("list"), protos.pb_to_json("m", MORE, "List")["text"].alias("object"), protos.json_to_pb("a", MORE, "List")["code"].alias("refused"))


@query(f"""SELECT event_id, '{{"the_key":' || event_id || ',"detail":{{"type_url":"type.googleapis.com/List","value":"' || base64(encode(event_type)) || '"}},"big_list":[' || {K} || ',18446744073709551615]}}' AS plain,
'{{"theKey":"' || event_id || '","bigList":["' || {K} || '","18446744073709551615"]}}' AS standard FROM events""")
def pb_any_and_standard(spark, sf_dir):
    """Any both ways, camel-case names read, and the public mapping (64-bit integers as strings)."""
    head = F.concat(F.lit('{"theKey":'), F.col("event_id").cast("string"))
    tail = F.concat(F.lit(',"bigList":['), "k", F.lit(",18446744073709551615]}"))
    detail = F.concat(F.lit(',"detail":{"type_url":"List","value":"'), F.base64(F.encode("event_type", "UTF-8")), F.lit('"}'))
    camel = JsonToPb(camel_names=True)
    rows = events(spark, sf_dir).select("event_id", protos.json_to_pb(F.concat(head, detail, tail), MORE, "Wide", camel)["msg"].alias("a"), protos.json_to_pb(F.concat(head, tail), MORE, "Wide", camel)["msg"].alias("b"))
    return rows.select("event_id", protos.pb_to_json("a", MORE, "Wide")["text"].alias("plain"), protos.pb_to_json("b", MORE, "Wide", PbToJson(standard=True))["text"].alias("standard"))


@query(f"""SELECT event_id, '{{"the_key":' || {K} || '}}' AS doc, (12 + length({K}))::bigint AS "offset", 'not_found' AS nothing FROM events""")
def pb_first_of_many(spark, sf_dir):
    """A message from the first of documents laid end to end, and the offset behind it."""
    many = F.concat(F.lit('{"the_key":'), "k", F.lit('} {"the_key":1}'))
    rows = events(spark, sf_dir).select("event_id", protos.json_to_pb(many, MORE, "Wide", JsonToPb(allow_remaining=True)).alias("m"), protos.json_to_pb(F.lit(" "), MORE, "Wide", JsonToPb(allow_remaining=True))["code"].alias("nothing"))
    return rows.select("event_id", protos.pb_to_json(F.col("m.msg"), MORE, "Wide")["text"].alias("doc"), "m.offset", "nothing")


@query(f"""SELECT event_id, '{{"ids.[0]":' || event_id || ',"ids.[1]":' || {K} || '}}' AS flat, {K} AS second FROM events""")
def pb_flat_json(spark, sf_dir):
    """The flat JSON form of a message, and one path of its cached map."""
    array = F.concat(F.lit('{"ids":['), F.col("event_id").cast("string"), F.lit(","), "k", F.lit("]}"))
    rows = events(spark, sf_dir).select("event_id", protos.json_to_pb(array, MORE, "List")["msg"].alias("m"))
    return rows.select("event_id", protos.pb_flatten_json("m", MORE, "List").alias("flat"), protos.kv_get(protos.pb_flatten_map("m", MORE, "List"), "ids.[1]").alias("second"))


@query(f"""SELECT event_id, '{{"the_key":' || {K} || ',"ratio":' || {K} || '.5}}' AS doc, CASE WHEN event_id % 2 = 0 THEN 'invalid_argument' ELSE 'ok' END AS code FROM events""")
def pb_set_typed(spark, sf_dir):
    """Typed entries written into an empty message; a kind that does not fit ends the list."""
    of = lambda path, vtype, i=None, d=None, s=None: F.struct(F.lit(path).alias("path"), F.struct(F.lit(vtype).alias("vtype"), (F.lit(None).cast("string") if s is None else s).alias("s"), F.lit(None).cast("boolean").alias("b"), (F.lit(None).cast("bigint") if i is None else i).alias("i"), F.lit(None).cast("decimal(20,0)").alias("u"), (F.lit(None).cast("double") if d is None else d).alias("d"), F.lit(None).cast("string").alias("text")).alias("value"))
    k = F.col("k").cast("bigint")
    entries = F.array(of("the_key", "int64", i=k), of("ratio", "double", d=k + F.lit(0.5)), of("the_key", "string", s=F.lit("x")))
    entries = F.when(F.col("event_id") % 2 == 0, entries).otherwise(F.slice(entries, 1, 2))
    rows = events(spark, sf_dir).select("event_id", protos.pb_set_typed(F.lit(None).cast("binary"), entries, MORE, "Wide").alias("w"))
    return rows.select("event_id", protos.pb_to_json(F.col("w.msg"), MORE, "Wide")["text"].alias("doc"), "w.code")


# Around documents


@query(f"WITH {LEAVES} SELECT CASE WHEN starts_with(path, 'lines') THEN 'lines' ELSE path END AS head, vtype, count(*) AS n, grouping(head, vtype)::bigint AS level FROM leaves GROUP BY ROLLUP (head, vtype)")
def flat_rollup(spark, sf_dir):
    rows = flatten_rows(spark, sf_dir).select(F.split("path", r"\.")[0].alias("head"), "vtype")
    return rows.rollup("head", "vtype").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("SELECT event_id, event_type, k, place FROM (SELECT event_id, event_type, json_extract(props, '/k')::bigint AS k, row_number() OVER (PARTITION BY event_type ORDER BY json_extract(props, '/k')::bigint DESC, event_id) AS place FROM events) WHERE place <= 3")
def top_by_type(spark, sf_dir):
    """The three greatest values of a pointer for each type: the limit is the feature."""
    from pyspark.sql import Window as W

    rows = events(spark, sf_dir).select("event_id", "event_type", F.col("k").cast("bigint").alias("k"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("k"), "event_id")).cast("bigint")).where("place <= 3")


@query("SELECT o_orderkey, (o_orderdate + INTERVAL 30 DAY)::date::varchar AS due, date_diff('day', o_orderdate::date, DATE '1998-12-31')::bigint AS days, year(o_orderdate)::bigint AS y FROM orders")
def dates_in_documents(spark, sf_dir):
    """Dates read from documents; intervals and differences."""
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))).alias("doc"))
    day = F.to_date(F.get_json_object("doc", "$.d"))
    return docs.select("o_orderkey", F.date_add(day, 30).cast("string").alias("due"), F.datediff(F.lit("1998-12-31").cast("date"), day).cast("bigint").alias("days"), F.year(day).cast("bigint").alias("y"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS digest, length(text)::bigint AS size, 'UTF-16BE' AS form FROM documents UNION ALL SELECT doc_id, sha256(coalesce(text, '')), length(text)::bigint, 'UTF-8' FROM documents")
def encodings_more(spark, sf_dir):
    """UTF-16 of the other byte order with a mark, found by it, and UTF-8 with a mark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = []
    for form in ("UTF-16BE", "UTF-8"):
        back = docs.select("doc_id", encodings.decode_text(encodings.encode_text(F.col("text"), form, mark=True)).alias("back"))
        parts.append(back.select("doc_id", F.sha2(F.coalesce("back", F.lit("")), 256).alias("digest"), F.length("back").cast("bigint").alias("size"), F.lit(form).alias("form")))
    return parts[0].unionByName(parts[1])


# Sources


@query(f"SELECT event_id, {K}::bigint AS k, 'lines' AS form FROM events UNION ALL SELECT event_id, {K}::bigint, 'end to end' FROM events")
def file_sources(spark, sf_dir):
    """Documents written one a line and read again: by lines, and as files of documents laid end to end."""
    path = f"{shared_path(spark)}/docs"
    files.write_lines(events(spark, sf_dir).select(F.to_json(F.struct("event_id", "k")).alias("doc")).repartition(4, "doc"), path)
    lines, whole = files.read_lines(spark, path), files.read_concatenated(spark, path + "/*.txt")
    of = lambda df, form: df.select(F.get_json_object("doc", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("doc", "$.k").cast("bigint").alias("k"), F.lit(form).alias("form")).where("event_id is not null")
    return of(lines, "lines").unionByName(of(whole, "end to end"))


# Streams


def _stream(spark, sf_dir):
    held = table(spark, sf_dir, "events")
    return flows.read_table(spark, f"{sf_dir}/events.parque[t]", held), shared_path(spark)


@query("""WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS start, event_type, json_extract(props, '/k')::double AS k FROM events, (VALUES (0), (1)) v(i))
SELECT start, event_type, 'k' AS path, count(*) AS n, sum(k) AS total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY start, event_type""")
def stream_sliding(spark, sf_dir):
    """Sliding windows in append mode: a window comes out when the watermark, two hours behind, has passed it."""
    stream, path = _stream(spark, sf_dir)
    return flows.run_to_table(flows.windowed_values(stream, "props", "ts", ["event_type"], late="2 hours", window="1 hour", slide="30 minutes"), f"{path}/out", f"{path}/checkpoint")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER p + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, id HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark, sf_dir):
    """Sessions of each user in append mode, one hour behind."""
    stream, path = _stream(spark, sf_dir)
    return flows.run_to_table(flows.session_counts(stream, "ts", ["user_id"]), f"{path}/out", f"{path}/checkpoint")

