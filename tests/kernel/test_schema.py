"""Each keyword with values that meet it and values that do not."""

import json

import pytest

from leafwise.kernel.dom import to_python
from leafwise.kernel.lexer import parse
from leafwise.kernel.schema import Schema

REMOTES = {"http://x.org/int.json": '{"type":"integer"}', "http://x.org/defs.json": '{"definitions":{"s":{"type":"string"},"alias":{"$ref":"#/definitions/s"}}}', "http://x.org/folder/pos.json": '{"minimum":0}'}
CASES = [
    ({"type": "integer"}, ["1", "-5", "18446744073709551615"], ["1.0", '"1"', "null", "true", "[]"]),
    ({"type": "number"}, ["1", "1.5"], ['"1"']), ({"type": ["string", "null"]}, ['"a"', "null"], ["1", "{}"]), ({"type": "banana"}, [], ["1", "null"]), ({}, ["1", "{}", "null"], []),
    ({"enum": [1, {"a": [1, 2.0], "b": None}]}, ["1", "1.0", '{"b":null,"a":[1,2]}'], ["2", "true", '{"a":[2,1],"b":null}']),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, ["2", '"x"'], ["0", "4"]), ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ['"a"', "3"], ["2"]), ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, ["1", "2.5"], ["3", "1.5"]), ({"not": {"type": "string"}}, ["1"], ['"a"']),
    ({"properties": {"a": {"type": "integer"}, "b": {"type": "string"}}}, ['{"a":1}', '{"c":2}', "[1]"], ['{"a":null}', '{"a":1,"b":2}']),
    ({"required": ["a", "b"]}, ['{"a":null,"b":1}', "1"], ['{"a":1}', "{}"]), ({"properties": {"a": {"type": "string", "default": "x"}}, "required": ["a"]}, ["{}"], ['{"a":1}']),
    ({"dependencies": {"a": ["b"], "c": {"required": ["d"]}}}, ["{}", '{"a":1,"b":2}', '{"c":1,"d":2}'], ['{"a":1}', '{"c":1}']),
    ({"patternProperties": {"^s": {"type": "string"}}, "additionalProperties": False}, ['{"sx":"a"}', "{}"], ['{"sx":1}', '{"x":1}']), ({"patternProperties": {"^s": {"type": "string"}}, "additionalProperties": {"type": "integer"}}, ['{"s":"a","x":1}', '{"s":1}'], ['{"s":true}', '{"x":"a"}']),
    ({"properties": {"s": {"minLength": 2}}, "patternProperties": {"^s": {"type": "string"}}}, ['{"s":"ab"}'], ['{"s":"a"}', '{"s":1}']), ({"additionalProperties": {"type": "boolean"}}, ['{"a":true}'], ['{"a":1}']),
    ({"minProperties": 1, "maxProperties": 2}, ['{"a":1}', "1"], ["{}", '{"a":1,"b":2,"c":3}']),
    ({"items": {"type": "integer"}}, ["[]", "[1,2]", '"a"'], ['[1,"a"]']), ({"items": [{"type": "integer"}, {"type": "string"}], "additionalItems": False}, ["[1]", '[1,"a"]'], ['["a"]', '[1,"a",3]']), ({"items": [{}], "additionalItems": {"type": "null"}}, ["[1]", "[1,null]"], ["[1,2]"]),
    ({"minItems": 1, "maxItems": 2}, ["[1]", "{}"], ["[]", "[1,2,3]"]), ({"uniqueItems": True}, ["[1,2]", '[1,true,"1"]', "[[1],[2]]"], ["[1,1.0]", '[{"a":1,"b":2},{"b":2,"a":1}]']),
    ({"minLength": 2, "maxLength": 3}, ['"ab"', '"é😀"', "1"], ['"a"', '"abcd"']), ({"pattern": "^a+$"}, ['"aa"', "1"], ['"ab"', '""']), ({"pattern": "\\d"}, ['"x"'], []),
    ({"minimum": 1, "maximum": 3}, ["1", "3", "2.5"], ["0", "3.5"]), ({"minimum": 1, "exclusiveMinimum": True, "maximum": 3, "exclusiveMaximum": True}, ["2"], ["1", "3", "1.0"]), ({"minimum": 9223372036854775808}, ["9223372036854775808"], ["9223372036854775807"]),
    ({"multipleOf": 3}, ["9", "0", "-3", "4.5e0" if False else '"x"'], ["4"]), ({"multipleOf": 0.01}, ["19.99", "0.07", "3"], ["0.075"]), ({"multipleOf": 0}, ["7"], []),
    ({"definitions": {"n": {"properties": {"next": {"$ref": "#/definitions/n"}, "v": {"type": "integer"}}}}, "$ref": "#/definitions/n"}, ['{"v":1,"next":{"v":2}}'], ['{"next":{"next":{"v":"x"}}}']), ({"properties": {"a": {"$ref": "#"}}, "additionalProperties": False}, ['{"a":{"a":{}}}'], ['{"a":{"b":1}}']),
    ({"definitions": {"a/b": {"type": "integer"}, "c%d": {"type": "string"}}, "properties": {"x": {"$ref": "#/definitions/a~1b"}, "y": {"$ref": "#/definitions/c%25d"}}}, ['{"x":1,"y":"s"}'], ['{"x":"s"}', '{"y":1}']),
    ({"items": {"$ref": "http://x.org/int.json"}}, ["[1]"], ['["a"]']), ({"$ref": "http://x.org/defs.json#/definitions/alias"}, ['"a"'], ["1"]), ({"id": "http://x.org/", "items": {"id": "folder/", "items": {"$ref": "pos.json"}}}, ["[[1]]"], ["[[-1]]"]),
    ({"definitions": {"named": {"id": "#foo", "type": "integer"}}, "$ref": "#foo"}, ["1"], ['"a"']), ({"definitions": {"a": {"$ref": "#/definitions/b"}, "b": {"$ref": "#/definitions/a"}}, "$ref": "#/definitions/a"}, ["1"], []), ({"format": "ipv4", "const": 3}, ['"zz"'], []), ({"openapi": "3.0.1", "type": "string", "nullable": True}, ["null", '"a"'], ["1"]), ({"type": "string", "nullable": True}, ['"a"'], ["null"]),
]


@pytest.mark.parametrize(("schema", "good", "bad"), CASES, ids=lambda x: json.dumps(x)[:40])
def test_keywords(schema, good, bad):
    compiled = Schema(json.dumps(schema), REMOTES)
    for text in good:
        assert compiled.validate(parse(text)[0]).valid, text
    for text in bad:
        report = compiled.validate(parse(text)[0])
        assert not report.valid and not compiled.validate(parse(text)[0], True).valid, text
        row = report.to_row()
        assert row["keyword"] and row["code"] > 0 and row["instance_ref"].startswith("#") and "#" in row["schema_ref"] and row["message"]


def test_error_objects():
    s = Schema('{"properties":{"n":{"maximum":5,"exclusiveMaximum":true},"t":{"type":["string","null"]},"a/b":{"items":{"uniqueItems":true}}},"required":["q"]}')
    r = s.validate(parse('{"n":5,"t":1,"a/b":[[1,1]]}')[0], True)
    assert to_python(r.errors) == {
        "maximum": {"actual": 5, "expected": 5, "exclusiveMaximum": True, "errorCode": 3, "instanceRef": "#/n", "schemaRef": "#/properties/n"},
        "type": {"expected": ["null", "string"], "actual": "integer", "errorCode": 20, "instanceRef": "#/t", "schemaRef": "#/properties/t"},
        "uniqueItems": {"duplicates": [0, 1], "errorCode": 11, "instanceRef": "#/a~1b/0", "schemaRef": "#/properties/a~1b/items"},
        "required": {"missing": ["q"], "errorCode": 15, "instanceRef": "#", "schemaRef": "#"},
    }
    assert r.to_row()["code"] == -1 and len(s.validate(parse('{"n":5,"t":1}')[0]).errors) == 1
    nested = Schema('{"anyOf":[{"type":"string"},{"minimum":3}]}').validate(1)
    assert to_python(nested.errors)["anyOf"]["errors"][1]["minimum"]["schemaRef"] == "#/anyOf/1"
    many = Schema('{"items":{"type":"string"}}').validate(parse("[1,2]")[0], True)
    assert [e["instanceRef"] for e in to_python(many.errors)["type"]] == ["#/0", "#/1"]


@pytest.mark.parametrize(("text", "code"), [('{"$ref":""}', 3), ('{"$ref":"#nope"}', 2), ('{"$ref":"#/~2"}', 4), ('{"$ref":"#/a"}', 5), ('{"$ref":"#"}', 6), ('{"$ref":"http://y.org/"}', 8), ('{"pattern":"("}', 9), ('{"$schema":"http://nowhere/"}', 10), ('{"$schema":"http://json-schema.org/draft-07/schema#"}', 11), ('{"$schema":"http://json-schema.org/draft-04/schema#","swagger":"2.0"}', 12), ('{"swagger":"2.0","readOnly":true,"writeOnly":true}', 13)])
def test_schema_errors(text, code):
    assert [c for c, _ in Schema(text, {}).errors] == [code]


def test_start_and_modes():
    assert [c for c, _ in Schema("{}", start="/x").errors] == [1] and [c for c, _ in Schema('{"$ref":"http://y.org/"}').errors] == [7]
    assert not Schema('{"definitions":{"i":{"type":"integer"}}}', start="/definitions/i").validate("a").valid
    text = '{"openapi":"3.0.0","properties":{"r":{"readOnly":true},"w":{"writeOnly":true}}}'
    value = parse('{"r":1,"w":2}')[0]
    assert Schema(text).validate(value).valid and Schema(text, mode="write").validate(value).first[1] == 26 and Schema(text, mode="read").validate(value).first[1] == 27
