"""Columns and operators on small frames: nulls, bad rows, empty tables, agreement of built-in and exact forms."""

import json

import pytest
from pyspark.sql import functions as F

from leafwise.functions import documents as D, encodings, names, protos, schemas, uris, variants as V
from leafwise.kernel import transcode
from leafwise.kernel.lexer import parse
from leafwise.kernel.schema import Schema
from leafwise.kernel.uri import Uri
from leafwise.kernel.wire import Pool
from leafwise.operators import documents as O
from leafwise.options import FlattenOptions, PbToJson
from leafwise.plans import flat as flat_plans, messages, paths, predicates
from leafwise.sources import files
from leafwise.streaming import flows
from tests.kernel.test_schema import CASES, REMOTES

TEXTS = [None, "", '{"a":{"b":[1,{"c":true}]},"x":1.5,"s":"t","n":null}', '{"a":1,"a":2}', "[1,2", '{"0":"zero","k":[7]}', '[{"a":1}]', '{"s":"é\\u0001"} ']


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, doc string")


def column(df, c):
    return [r[0] for r in df.orderBy("id").select(c).collect()]


def test_bad_rows_give_null_and_a_status(docs):
    assert column(docs, D.parse_status("doc")["code"]) == [None, "DocumentEmpty", "None", "None", "ArrayMissCommaOrSquareBracket", "None", "None", "None"]
    assert column(docs, D.condense("doc")) == [None, None, TEXTS[2], TEXTS[3], None, TEXTS[5], TEXTS[6], '{"s":"é\\u0001"}']
    assert column(docs, D.flatten_status("doc")["message"])[4:7] == ["Invalid json: Missing a comma or ']' after an array element.", None, "Root json must be an object"]
    assert column(docs, D.flatten_status("doc", FlattenOptions(allow_remaining=True))["code"])[1] == "not_found"
    assert docs.limit(0).select(D.condense("doc"), D.flatten("doc"), D.parse_status("doc")).count() == 0


def test_flat_forms_agree(spark, docs):
    kernel = {(r.id, r.path): r.value for r in O.flatten_rows(docs, "doc", ["id"]).collect()}
    assert kernel[2, "a.b.[1].c"] == "true" and (2, "n") not in kernel and kernel[3, "a"] == "2"
    builtin = {(r.id, r.path): r.value for r in O.flatten_rows(docs.where("id <> 3"), "doc", ["id"], "recursive").collect()}
    assert builtin == {k: v for k, v in kernel.items() if k[0] != 3}
    one = docs.where("id = 2")
    static = {(r.id, r.path): r.value for r in O.flatten_rows(one, "doc", ["id"], "static", schema=_ddl("a struct<b:array<string>>, x double, s string")).collect()}
    assert static[2, "x"] == "1.5" and static[2, "a.b.[0]"] == "1"
    with pytest.raises(ValueError):
        O.flatten_rows(docs, "doc", ["id"], "static")
    firsts = O.first_of_path(O.flatten_rows(docs, "doc", ["id"]), ["id"])
    assert {(r.id, r.path): r.value for r in firsts.collect()}[3, "a"] == "1"
    maps = column(docs, D.flatten_map("doc"))
    assert maps[2]["x"] == "1.500000" and maps[3] == {"a": "1"} and maps[6] is None
    assert column(docs, D.kv_text(D.flatten_map("doc")))[5] == "0=zero\nk.[0]=7\n"
    back = {r.id: r.doc for r in O.unflatten_rows(O.flatten_rows(docs, "doc", ["id"]), ["id"]).collect()}
    assert json.loads(back[2]) == {"a": {"b": [1, {"c": True}]}, "x": 1.5, "s": "t"}
    typed = column(docs, D.flatten_typed("doc", FlattenOptions(exact=True)))
    assert [(e.path, e.value.vtype, e.value.d) for e in typed[2] if e.path == "x"] == [("x", "float", 1.5)]


def _ddl(text):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


def test_closed_schema(spark):
    same = spark.createDataFrame([('{"a":1,"b":[{"c":"x"}]}',), ('{"a":2,"b":[]}',)], "doc string")
    assert flat_plans.closed_schema(same, "doc") is not None
    assert flat_plans.closed_schema(same.unionByName(spark.createDataFrame([('{"a":"x"}',)], "doc string")), "doc") is None


def test_pointers(docs):
    got = paths.extract(docs, "doc", {"c": ("/a/b/1/c", "boolean"), "k": ("/k/0", "int"), "z": ("/0", "string")}, {"k": -1}).orderBy("id").collect()
    assert [(r.c, r.k, r.z) for r in got][2:6:3] == [(True, -1, None), (None, 7, "zero")]
    assert column(docs, D.pointer_get("doc", "/a")["value"])[3] == "1"
    assert column(docs, D.pointer_erase("doc", "/a")["text"])[3] == '{"a":2}'
    assert column(docs, paths.has(F.try_parse_json("doc"), "/n"))[2] is True and column(docs, paths.get(F.try_parse_json("doc"), "/n", "string"))[2] is None
    minimal = paths.extract_struct(docs, "doc", {"x": ("/x", "double"), "s": ("/s", "string")}).where("id = 2").first()
    assert (minimal.x, minimal.s) == (1.5, "t")
    plan = paths.extract(docs, "doc", {"x": ("/x", "double"), "s": ("/s", "string")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 2


def test_one_parse_and_pruned_columns_over_parquet(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "props")
    plan = paths.extract(events, "props", {"a": ("/k", "bigint"), "b": ("/z", "bigint")}).groupBy("event_type").agg(F.sum("a"), F.sum("b"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_type:string,props:string>" in plan


def test_variants(spark):
    texts = ["null", "true", "1", "-3000000000", "9223372036854775808", "1.5", "44.0", "1e40", '"é"', "[1,2]", '{"a":1,"b":null}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string").withColumn("v", F.try_parse_json("doc"))
    v = F.col("v")
    assert column(df, V.kind(v)) == ["null", "boolean", "integer", "integer", "integer", "double", "double", "double", "string", "array", "object"]
    assert column(df, V.is_int32(v))[2:5] == [True, False, False] and column(df, V.is_uint64(v))[2:5] == [True, False, True] and column(df, V.is_int64(v))[4] is False
    assert column(df, V.has_member(v, "b"))[-1] is True and column(df, V.member_count(v))[-1] == 2 and column(df, V.array_length(v))[-2] == 2
    assert column(df, V.string_length(v))[8] == 2 and column(df, V.is_float(v))[5:8] == [True, True, False]
    assert column(df, V.is_true(v))[1] is True and column(df, V.is_false(v))[1] is False and column(df, V.is_null(v))[0] is True
    assert column(df, V.is_lossless_float(v))[5] is True


def test_predicates_agree_with_the_kernel(spark):
    compiled = 0
    for rule, good, bad in CASES:
        schema = Schema(json.dumps(rule), REMOTES)
        texts = [*good, *bad]
        df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string")
        try:
            native = column(df, predicates.predicate("doc", schema))
        except predicates.Unsupported:
            continue
        compiled += 1
        exact = [schema.validate(parse(t)[0]).valid for t in texts]
        assert [(t, x) for t, x in zip(texts, native, strict=True)] == [(t, x) for t, x in zip(texts, exact, strict=True)], rule
    assert compiled > len(CASES) * 0.8


def test_validation_routes(docs):
    good, bad = O.validated(docs, "doc", Schema('{"required":["s"]}'))
    assert {r.id for r in good.collect()} == {2, 6, 7}
    reports = {r.id: r.report for r in bad.collect()}
    assert set(reports) == {0, 1, 3, 4, 5} and reports[5].keyword == "required" and reports[0] is None and reports[1].message == "The document is empty."


def test_recursive_schemas_take_the_kernel(docs):
    schema = Schema('{"properties":{"a":{"$ref":"#"}},"additionalProperties":{"type":["array","null","string","number"]}}')
    with pytest.raises(predicates.Unsupported):
        schemas.is_valid("doc", schema, "native")
    assert column(docs, schemas.is_valid("doc", schema))[5] is True


def test_names_and_uris_agree_with_the_kernels(spark):
    words = ["_Afledk2e*_+%leGi___hE_Z278_t#", "9lives", "", "plain_1", "a b_c_dE", "é_x", "_Z042_", "__a", None]
    df = spark.createDataFrame(list(enumerate(words)), "id int, w string")
    for c, f in ((names.encode_name("w"), transcode.encode_name), (names.decode_name("w"), transcode.decode_name), (names.camel("w"), transcode.camel)):
        assert column(df, c) == [None if w is None else f(w) for w in words]
    bases = ["http://a/b/c/d;p?q", "http://a", "mailto:x", "/p/q", "http://a/b/../c/"]
    refs = ["g:h", "g", "./g", "/g", "//g", "?y", "g?y", "#s", "", ".", "./", "..", "../..", "../../../g", "/./g", "/../g", "g.", "./g/.", "g/../h", "a//b/..", "..g"]
    pairs = [(i, r, b) for i, (r, b) in enumerate((r, b) for r in refs for b in bases)]
    df = spark.createDataFrame(pairs, "id int, r string, b string")
    got = column(df, uris.resolve_uri(uris.parse_uri("r"), uris.parse_uri("b")))
    assert [(r, b, g) for (_, r, b), g in zip(pairs, got, strict=True)] == [(r, b, str(Uri.parse(r).resolve(Uri.parse(b)))) for _, r, b in pairs]


POOL = Pool.declare({"Kv": {"key": (1, "string"), "value": (2, "int32")}, "M": {"id": (1, "int32", "required"), "m": (2, "Kv", "repeated"), "sub": (3, "M"), "xs": (4, "sint64", "repeated")}})


def test_messages(spark):
    texts = ['{"id":1,"m":{"a":2},"sub":{"id":3},"xs":[-1,5]}', "{}", None, "[", '{"id":4}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string").withColumn("pb", protos.json_to_pb("doc", POOL, "M"))
    assert column(df, F.col("pb.code")) == ["ok", "invalid_argument", None, "invalid_argument", "ok"]
    held = df.select("id", F.col("pb.msg").alias("msg"))
    assert column(held, protos.pb_to_json("msg", POOL, "M")["text"]) == ['{"id":1,"sub":{"id":3,"m":{}},"xs":[-1,5],"m":{"a":2}}', None, None, None, '{"id":4,"m":{}}']
    assert column(held, protos.pb_to_json("msg", POOL, "M", PbToJson(maps=False))["text"])[0] == '{"id":1,"m":[{"key":"a","value":2}],"sub":{"id":3},"xs":[-1,5]}'
    assert column(held, protos.pb_flatten_map("msg", POOL, "M"))[0] == {"id": "1", "sub.id": "3", "xs.[0]": "-1", "xs.[1]": "5", "m.a": "2"}
    assert column(held, protos.pb_flatten_json("msg", POOL, "M"))[4] == '{"id":4}'
    entries = F.array(F.struct(F.lit("xs.[1]").alias("path"), F.lit("9").alias("value")), F.struct(F.lit("nope").alias("path"), F.lit("1").alias("value")))
    written = held.withColumn("w", protos.pb_set("msg", entries, POOL, "M"))
    assert column(written, F.col("w.message"))[4] == "nope: field not found: nope"
    assert column(written, messages.pb_decode(F.col("w.msg"), POOL, "M")["xs"])[4] == [0, 9]
    again = held.where("msg is not null").withColumn("w", protos.pb_set_typed(F.lit(None).cast("binary"), protos.pb_flatten("msg", POOL, "M"), POOL, "M"))
    assert column(again, F.col("w.code")) == ["ok", "ok"] and column(again, protos.pb_to_json(F.col("w.msg"), POOL, "M")["text"]) == column(held.where("msg is not null"), protos.pb_to_json("msg", POOL, "M")["text"])
    assert column(held, messages.pb_decode("msg", POOL, "M"))[0].m == {"a": 2}
    assert column(held.withColumn("kv", protos.pb_flatten_map("msg", POOL, "M")), protos.kv_get("kv", "m.a"))[0] == "2"


def test_files(spark, tmp_path):
    text = '{"a":"é😀"}'
    for k, (name, mark) in enumerate([("utf-8", b""), ("utf-8-sig", b""), ("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\0\0"), ("utf-32-be", b"\0\0\xfe\xff"), ("utf-16-le", b""), ("utf-16-be", b""), ("utf-32-le", b""), ("utf-32-be", b"")]):
        (tmp_path / f"{k}.json").write_bytes(mark + text.encode(name))
    assert [r.doc for r in files.read_files(spark, str(tmp_path / "*.json")).collect()] == [text] * 10
    (tmp_path / "many.txt").write_text('{"a":1} [2]\n3 [')
    many = files.read_concatenated(spark, str(tmp_path / "many.txt")).orderBy("doc_idx").collect()
    assert [(r.doc, r.error) for r in many] == [('{"a":1}', None), ("[2]", None), ("3", None), (None, "ValueInvalid")]
    files.write_lines(spark.createDataFrame([('{"a":\n1}',)], "doc string"), str(tmp_path / "lines"))
    assert [r.doc for r in files.read_lines(spark, str(tmp_path / "lines")).collect()] == ['{"a":1}']
    framed = spark.createDataFrame([(bytearray(b"x" * 300),), (bytearray(b""),), (bytearray(b"ab"),)], "m binary").select(files.framed("m").alias("m"))
    (tmp_path / "msgs.bin").write_bytes(b"".join(bytes(r.m) for r in framed.collect()) + b"\x05ab")
    assert [bytes(r.msg) for r in files.read_messages(spark, str(tmp_path / "msgs.bin")).collect()] == [b"x" * 300, b"", b"ab"]
    at = spark.createDataFrame([("é\nab", 4)], "t string, o int").select(files.cursor(F.col("t"), F.col("o")).alias("c")).first().c
    assert (at.line, at.column) == (2, 2)


def test_base64(spark):
    df = spark.createDataFrame([(0, bytearray(b"\0\xff" * 60)), (1, None)], "id int, b binary")
    assert column(df, encodings.from_base64(encodings.to_base64(F.col("b")))) == [b"\0\xff" * 60, None]
    assert spark.range(1).select(encodings.from_base64(F.lit("@@@"))).first()[0] is None


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"k":1}\n{"k":"x"}\n[\n')
    (tmp_path / "in/b.txt").write_text('{"k":5}\n')
    stream = flows.read_lines(spark, str(tmp_path / "in"), max_files=1)
    flows.route(stream, "doc", Schema('{"properties":{"k":{"type":"integer"}}}'), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "c1")).awaitTermination()
    assert {r.doc for r in spark.read.parquet(str(tmp_path / "good")).collect()} == {'{"k":1}', '{"k":5}'}
    assert {r.doc for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {'{"k":"x"}', "["}
    counts = flows.run_to_table(flows.status_counts(flows.read_lines(spark, str(tmp_path / "in")), "doc"), str(tmp_path / "out"), str(tmp_path / "c2"), "complete")
    assert {(r.code, r.n) for r in counts.collect()} == {("None", 3), ("ValueInvalid", 1)}
    flat = flows.run_to_table(flows.flatten_stream(flows.read_lines(spark, str(tmp_path / "in")), "doc", ["doc"]), str(tmp_path / "flat"), str(tmp_path / "c3"))
    assert {r.value for r in flat.collect()} == {"1", "x", "5"}


def test_sql_functions(spark, docs):
    from leafwise.functions import sql

    sql.register(spark)
    docs.createOrReplaceTempView("sql_docs")
    one = spark.sql("SELECT lw_pointer(doc, '/a/b/0') p, lw_kind(doc) k, lw_parse_error(doc) e, lw_sort_keys(doc) s FROM sql_docs ORDER BY id").collect()
    assert [r.p for r in one][2] == "1" and one[6].k == "array" and one[4].e == "ArrayMissCommaOrSquareBracket" and one[0].s is None
    assert spark.sql("SELECT count(*) FROM sql_docs, LATERAL lw_tokens(doc) t WHERE id = 5").first()[0] == 8
    assert [r.doc for r in spark.sql("SELECT t.doc FROM lw_split_docs('1 [2]') t ORDER BY doc_idx").collect()] == ["1", "[2]"]
    assert spark.sql("SELECT count(*) FROM sql_docs, LATERAL lw_traverse(doc) t WHERE id IN (0, 1, 6)").first()[0] == 3


def test_own_functions_of_documents(docs):
    from leafwise.kernel.emit import dumps

    assert column(docs, D.map_document("doc", lambda v: len(v), "int"))[2] == 4
    assert column(docs, D.map_document("doc", lambda v: dumps(v[0]) if type(v) is list else None))[6] == '{"a":1}'


def test_kernels_of_one_batch_share_its_parse(spark):
    """Edits leave the value as it is, since a batch is parsed once for all kernels; columns are built without rows."""
    texts = ['{"a":{"b":[1,2]},"s":"x"}', '[{"a":1},7]', "[1,", None, "12345678901234567890"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, doc string")
    got = df.orderBy("id").select(
        D.pointer_set("doc", "/a/b/0", F.lit("9")).alias("set"), D.pointer_erase("doc", "/a/b/1")["text"].alias("erased"), D.pointer_create("doc", "/a/b/3").alias("created"), D.remove_member("doc", "s").alias("removed"),
        D.array_edit("doc", erase=(0, 1)).alias("edited"), D.condense("doc").alias("same"), D.traverse("doc").alias("nodes"), D.tokens("doc").alias("events"),
    ).collect()
    assert list(got[0][:4]) == ['{"a":{"b":[9,2]},"s":"x"}', '{"a":{"b":[1]},"s":"x"}', '{"a":{"b":[1,2,null,null]},"s":"x"}', '{"a":{"b":[1,2]}}']
    assert [r.same for r in got] == [texts[0], texts[1], None, None, texts[4]] and got[1].edited == "[7]"
    assert [n.pointer for n in got[0].nodes] == ["", "/a", "/a/b", "/a/b/0", "/a/b/1", "/s"] and got[2].nodes is None
    assert [(e.ord, e.kind) for e in got[1].events] == [(0, "start_array"), (1, "start_object"), (2, "key"), (3, "int32"), (4, "end_object"), (5, "int32"), (6, "end_array")]


def test_a_batch_is_parsed_once():
    import pyarrow as pa

    texts = pa.array(['{"a":[1]}', None, "["])
    first = D.parsed(texts)
    assert D.parsed(texts.slice(0)) is first and D.parsed(texts.slice(1)) is not first


def test_values_are_worked_out_once(spark, docs):
    """The predicate named the parse of its document again and again, and each was run; a flat form took a pass for each level."""
    plan = docs.where(schemas.is_valid("doc", Schema('{"properties":{"a":{"maximum":3,"minimum":1},"b":{"maximum":3}}}'), "native"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    flat = O.flatten_rows(docs, "doc", ["id"], "recursive")
    assert "UnionLoop" not in flat._jdf.queryExecution().executedPlan().toString()
    deep = spark.createDataFrame([(0, '{"a":' + "[" * 7 + "1" + "]" * 7 + "}"), (1, '{"n":null,"e":{},"f":[],"":2}')], "id int, doc string")
    assert {(r.id, r.path, r.value) for r in flat_plans.flatten_recursive(deep, "doc", ["id"]).collect()} == {(0, "a" + ".[0]" * 7, "1"), (1, "", "2")}
    with pytest.raises(Exception, match="nested deeper"):
        flat_plans.flatten_recursive(deep, "doc", ["id"], levels=4).collect()


def test_documents_are_flattened_once_for_their_difference(spark):
    """Leaves that repeat count as often as they are left over; each side was flattened twice."""
    a = spark.createDataFrame([(0, '{"a":1,"a":1,"b":2}'), (None, '{"x":1}'), (2, '{"same":[1]}')], "id int, doc string")
    b = spark.createDataFrame([(0, '{"a":1,"b":3,"b":3}'), (None, '{"x":1}'), (2, '{"same":[1]}')], "id int, doc string")
    diff = O.doc_diff(a, b, "doc", ["id"])
    assert diff._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    assert sorted(tuple(r) for r in diff.collect()) == [(0, "a", "1", "left"), (0, "b", "2", "left"), (0, "b", "3", "right"), (0, "b", "3", "right")]
