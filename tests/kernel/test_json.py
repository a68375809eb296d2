"""Parser, writer, edits, pointers, flat form and URIs on their own."""

import json
import math

import pytest
from hypothesis import given, settings, strategies as st

from leafwise.kernel import dom, flat, lexer, regexes
from leafwise.kernel.emit import WriteError, dumps, format_double, jsonx
from leafwise.kernel.lexer import Obj, ParseError, parse, split, status, tokens
from leafwise.kernel.pointer import Pointer, PointerError, traverse
from leafwise.kernel.uri import Uri
from leafwise.options import ParseFlags, WriteFlags

scalars = st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=8)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("abc.~/é", max_size=3), x, max_size=4), max_leaves=12)

ERRORS = [
    ("", "DocumentEmpty", 0), (" \n ", "DocumentEmpty", 3), ("1 2", "DocumentRootNotSingular", 2), ("[1]x", "DocumentRootNotSingular", 3), ("01", "DocumentRootNotSingular", 1),
    ("nulL", "ValueInvalid", 3), ("tRue", "ValueInvalid", 1), ("[1,]", "ValueInvalid", 3), ("-", "ValueInvalid", 1), ("+1", "ValueInvalid", 0), (".5", "ValueInvalid", 0), ("NaN", "ValueInvalid", 0), ("'a'", "ValueInvalid", 0), ("[", "ValueInvalid", 1),
    ("{1:2}", "ObjectMissName", 1), ('{"a":1,}', "ObjectMissName", 7), ("{", "ObjectMissName", 1), ('{"a"}', "ObjectMissColon", 4), ('{"a" 1}', "ObjectMissColon", 5), ('{"a":1', "ObjectMissCommaOrCurlyBracket", 6), ('{"a":1]', "ObjectMissCommaOrCurlyBracket", 6),
    ("[1 2]", "ArrayMissCommaOrSquareBracket", 3), ("[1}", "ArrayMissCommaOrSquareBracket", 2), ("[1", "ArrayMissCommaOrSquareBracket", 2), ('["\\u12G4"]', "StringUnicodeEscapeInvalidHex", 2), ('"\\uD800"', "StringUnicodeSurrogateInvalid", 1), ('"\\uDC00"', "StringUnicodeSurrogateInvalid", 1), ('"\\uD800\\u0041"', "StringUnicodeSurrogateInvalid", 1),
    ('"é\\x"', "StringEscapeInvalid", 3), ('"abc', "StringMissQuotationMark", 4), ('"a\x01"', "StringInvalidEncoding", 2), ("1e400", "NumberTooBig", 0), ("[1.]", "NumberMissFraction", 3), ("1e", "NumberMissExponent", 2), ("1e+", "NumberMissExponent", 3), ("/**/1", "ValueInvalid", 0),
]


@pytest.mark.parametrize(("text", "code", "offset"), ERRORS)
def test_errors(text, code, offset):
    got = status(text)
    assert (got["code"], got["offset"]) == (code, offset)
    assert got["message"] == lexer.MESSAGES[code] and got["number"] == lexer.CODES[code]


def test_line_and_column():
    got = status('{\n  "a": 1,\n  b}')
    assert (got["code"], got["line"], got["column"]) == ("ObjectMissName", 3, 3)


def test_flags():
    def value(text, **flags):
        return parse(text, ParseFlags(**flags))[0]

    assert parse('{"a":1} x', ParseFlags(stop_when_done=True)) == (Obj([("a", 1)]), 7)
    assert value("/*c*/[1,//x\n2]", comments=True) == [1, 2]
    assert value('{"a":[1,],}', trailing_commas=True) == Obj([("a", [1])])
    assert value("[Inf,-Infinity]", nan_and_inf=True) == [math.inf, -math.inf] and math.isnan(value("NaN", nan_and_inf=True))
    assert value(r'"\'"', escaped_apostrophe=True) == "'"
    assert value("[1.50,-0]", numbers_as_strings=True) == ["1.50", "-0"]
    with pytest.raises(ParseError, match="Unspecific"):
        value("/x 1", comments=True)


def test_number_kinds():
    for text, want in [("0", "int32"), ("2147483648", "int64"), ("9223372036854775808", "uint64"), ("18446744073709551616", "double"), ("-9223372036854775808", "int64"), ("-9223372036854775809", "double"), ("1.0", "double"), ("1e2", "double"), ("-0", "int32")]:
        assert lexer.kind(parse(text)[0]) == want, text


def test_depth_is_unlimited():
    deep = "[" * 50_000 + "]" * 50_000
    assert dumps(parse(deep)[0]) == deep


@settings(max_examples=300, deadline=None)
@given(values, st.booleans())
def test_round_trip(value, pretty):
    tree = dom.from_python(value)
    text = dumps(tree, "    " if pretty else None)
    again, end = parse(text)
    assert end == len(text) and dumps(again) == dumps(tree) and json.loads(text) == value
    slow, _ = parse(text, ParseFlags(comments=True))
    assert dumps(slow) == dumps(tree)


@settings(max_examples=200, deadline=None)
@given(st.text('{}[]",:0123e.-\\utrnl a', max_size=12))
def test_both_parsers_agree_with_the_standard_library(text):
    try:
        want = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError):
        want = None
        with pytest.raises(ParseError):
            parse(text)
    else:
        assert dom.to_python(parse(text, ParseFlags(comments=True))[0]) == want


def test_doubles():
    for value, text in [(1e30, "1e30"), (1.5e-7, "1.5e-7"), (1e21, "1e21"), (1e20, "100000000000000000000.0"), (1.2345678901234567e20, "123456789012345670000.0"), (0.1, "0.1"), (1e-6, "0.000001"), (1e-7, "1e-7"), (5e-324, "5e-324"), (-0.0, "-0.0"), (100.0, "100.0"), (1.7976931348623157e308, "1.7976931348623157e308")]:
        assert format_double(value) == text and float(text) == value
    assert [format_double(x, 2) for x in (1.999, 0.001, 3.14159, 1e-10, 2.0)] == ["1.99", "0.0", "3.14", "0.0", "2.0"]
    assert dumps([math.nan, -math.inf], flags=WriteFlags("literal")) == "[NaN,-Infinity]" and dumps([math.nan], flags=WriteFlags("null")) == "[null]"
    with pytest.raises(WriteError):
        dumps(math.nan)


def test_pretty_and_escapes():
    tree = parse('{"a":[1,[]],"b":{},"c":"\\u0001\\u00e9\\/\\ud83d\\ude00"}')[0]
    assert dumps(tree, "    ") == '{\n    "a": [\n        1,\n        []\n    ],\n    "b": {},\n    "c": "\\u0001é/😀"\n}'
    assert dumps(tree, "  ", True) == '{\n  "a": [1, []],\n  "b": {},\n  "c": "\\u0001é/😀"\n}'
    assert dumps("é😀\x1f", flags=WriteFlags(ascii_only=True)) == '"\\u00E9\\uD83D\\uDE00\\u001F"'


def test_documents_laid_end_to_end():
    text = ' {"a":1}[2] "x" 7'
    assert [text[a:b] for a, b, _, _ in split(text)] == ['{"a":1}', "[2]", '"x"', "7"]
    assert [e.code if e else v for _, _, v, e in split("1 [2,")] == [1, "ValueInvalid"]
    assert list(split("  ")) == []


def test_tokens():
    assert [(k, v) for k, _, v, _ in tokens('{"a":[1,null]}')] == [("start_object", None), ("key", "a"), ("start_array", None), ("int32", 1), ("null", None), ("end_array", None), ("end_object", None)]


def test_edits_and_equality():
    tree = parse('{"b":1,"a":{"b":"x","c":[{"b":2}]},"b":3}')[0]
    assert dumps(dom.rebuilt(tree, keep=lambda k: k != "b")) == '{"a":{"c":[{}]}}'
    assert dumps(dom.rebuilt(tree, order=lambda k: k)) == '{"a":{"b":"x","c":[{"b":2}]},"b":1,"b":3}'
    assert dumps(dom.capitalized(tree)) == '{"B":1,"A":{"B":"X","C":[{"B":2}]},"B":3}'
    one = lambda t: parse(t)[0]
    assert dom.equal(one('{"a":1,"b":[2]}'), one('{"b":[2.0],"a":1}')) and not dom.equal(one('{"a":1,"a":1}'), one('{"a":1,"a":1}'))
    assert not dom.equal(one("1"), one("true")) and not dom.equal(one("[]"), one("{}"))
    assert jsonx(one('{"a":[true,null,1,"<"]}')).endswith('<json:array name="a"><json:boolean>true</json:boolean><json:null/><json:number>1</json:number><json:string>&lt;</json:string></json:array></json:object>')


RFC = '{"foo":["bar","baz"],"":0,"a/b":1,"c%d":2,"e^f":3,"g|h":4,"i\\\\j":5,"k\\"l":6," ":7,"m~n":8}'


def test_pointer_table():
    root = parse(RFC)[0]
    for text, fragment, want in [("", "#", root), ("/foo", "#/foo", ["bar", "baz"]), ("/foo/0", "#/foo/0", "bar"), ("/", "#/", 0), ("/a~1b", "#/a~1b", 1), ("/c%d", "#/c%25d", 2), ("/e^f", "#/e%5Ef", 3), ("/g|h", "#/g%7Ch", 4), ("/i\\j", "#/i%5Cj", 5), ('/k"l', "#/k%22l", 6), ("/ ", "#/%20", 7), ("/m~0n", "#/m~0n", 8)]:
        p = Pointer.parse(text)
        assert p.get(root)[:2] == (True, want) and p.fragment() == fragment and Pointer.parse(fragment) == p and str(p) == text
    for text, code, offset in [("a", "TokenMustBeginWithSolidus", 0), ("/a~", "InvalidEscape", 2), ("/~2", "InvalidEscape", 1), ("#/%", "InvalidPercentEncoding", 2), ("#/%zz", "InvalidPercentEncoding", 2), ("#/ ", "CharacterMustPercentEncode", 2), ("#a", "TokenMustBeginWithSolidus", 1)]:
        with pytest.raises(PointerError) as e:
            Pointer.parse(text)
        assert (e.value.code, e.value.offset) == (code, offset)
    assert Pointer.parse("/foo/2").get(root) == (False, None, 1) and Pointer.parse("/foo/x/y").get(root) == (False, None, 1)
    assert Pointer.parse("/foo/-").get(root)[0] is False and Pointer.parse("/foo/00").get(root)[0] is False
    assert sorted([Pointer.parse(x) for x in ("/b", "/a/0", "/a", "/10", "/9")]) == [Pointer.parse(x) for x in ("/9", "/10", "/a", "/b", "/a/0")]


def test_pointer_edits():
    def after(text, pointer, value):
        return dumps(Pointer.parse(pointer).set(parse(text)[0], value)[0])

    assert after("{}", "/a/0/b", 1) == '{"a":[{"b":1}]}' and after('{"a":1}', "/a/b", 2) == '{"a":{"b":2}}'
    assert after("[1]", "/-", 2) == "[1,2]" and after("[1]", "/3", 2) == "[1,null,null,2]" and after("[1]", "/x", 2) == '{"x":2}' and after("[1]", "", 2) == "2"
    root = parse('{"a":[1,2],"b":3}')[0]
    assert Pointer.parse("/a/0").erase(root) and Pointer.parse("/b").erase(root) and not Pointer.parse("/z").erase(root) and not Pointer.parse("").erase(root)
    assert dumps(root) == '{"a":[2]}'
    assert Pointer.parse("/a").get_with_default(root, 5)[1] == [2] and Pointer.parse("/n").get_with_default(root, 5)[1] == 5
    assert Pointer.parse("/q").create(root)[1:] == (None, False)
    assert [str(p) for p, _ in traverse(parse('{"a":[1,{"b":2}]}')[0])] == ["", "/a", "/a/0", "/a/1", "/a/1/b"]


def test_flat():
    root = parse('{"a":{"b":[1,{"c":true}]},"n":null,"e":{},"f":[],"x":123.456,"s":"t","u":18446744073709551615}')[0]
    assert [(p, t) for p, t, _ in flat.leaves(root)] == [("a.b.[0]", "int32"), ("a.b.[1].c", "bool"), ("x", "double"), ("s", "string"), ("u", "uint64")]
    assert dict((p, v) for p, _, v in flat.leaves(root, True))["x"] == 123.45600128173828
    assert flat.text_of("double", 123.456) == "123.456000"
    for bad in ("[1]", "1", '{"":[1]}'):
        with pytest.raises(flat.FlatError):
            list(flat.leaves(parse(bad)[0]))
    assert [(s["key"], s["index"], s["has_array"]) for s in flat.parse_key("a..b.[2].[]")] == [("a", None, False), ("b", None, True), ("[2]", 2, False), ("[]", None, False)]
    for bad, text in (("", "empty"), ("[1].a", "root"), ("a.[x]", "bad index")):
        with pytest.raises(flat.FlatError, match=text):
            flat.parse_key(bad)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=2), st.recursive(st.integers(0, 9) | st.booleans() | st.text("xy", max_size=2), lambda x: st.lists(x, min_size=1, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), x, min_size=1, max_size=3), max_leaves=8), max_size=4))
def test_unflatten_inverts_flatten(value):
    root = dom.from_python(value)
    assert dumps(flat.unflatten((p, v) for p, _, v in flat.leaves(root))) == dumps(root)


def test_uri_resolution_of_rfc_3986():
    base = Uri.parse("http://a/b/c/d;p?q")
    for ref, want in [("g:h", "g:h"), ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"), ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./g/.", "http://a/b/c/g/"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("g;x=1/../y", "http://a/b/c/y")]:
        assert str(Uri.parse(ref).resolve(base)) == want, ref


@pytest.mark.parametrize(("pattern", "text", "want"), [("a*", "b", False), ("a*", "", True), ("a*", "ba", True), ("^a|b$", "ab", False), ("^a.c$", "a\nc", True), ("a+?x", "x", True), ("[a-z]{2,3}", "abcd", True), ("^[a-z]{2,3}$", "abcd", False), ("[^a]", "a", False), ("a$", "a\n", False), ("[]x]", "]", True), ("\\.\\t", ".\t", True), ("(ab|c)+d", "xabcd", True), ("é{2}", "éé", True), ("^$", "", True), ("^a?$", "b", False)])
def test_patterns(pattern, text, want):
    assert regexes.search(pattern, text) is want


@pytest.mark.parametrize("pattern", ["\\d", "(?:a)", "a{2,1}", "[a", "(a", "a)", "*a", "\\u0041"])
def test_bad_patterns(pattern):
    with pytest.raises(regexes.PatternError):
        regexes.translate(pattern)


def test_documents_end_to_end_take_time_in_proportion():
    """Byte offsets were counted from the start of the text for each document, which grew with the square of the text."""
    from time import perf_counter

    from leafwise.kernel.lexer import byte_offset, spans, split

    for text in ('{"a":1} [2]\n3 [', '1.5 2. 3', "1e5 1e", "12.5e1x", '"é" {"a":"😀"} 7', " ", "1 -", '{"a":1,"a":2}{"b":12345678901234567890}', '"\\ud83d\\ude00" "\\uD800"', "true false nulL", "NaN", "[1}", "01", '"a\x01"'):
        want = [(a, b, byte_offset(text, a), byte_offset(text, b), e and e.code) for a, b, _, e in _slow_split(text)]
        assert [(a, b, s, t, e and e.code) for a, b, s, t, e in spans(text)] == want, text
        assert [(a, b, e and e.code) for a, b, _, e in split(text)] == [(a, b, e) for a, b, _, _, e in want]
    for letter in ("e", "é"):
        text = f'{{"event_id":12345,"k":"{letter}"}}\n' * 60_000
        began = perf_counter()
        assert sum(1 for _ in spans(text)) == 60_000
        assert perf_counter() - began < 6


def _slow_split(text):
    from leafwise.kernel.lexer import ParseError, _Parser
    from leafwise.options import ParseFlags

    at = 0
    while True:
        p = _Parser(text, ParseFlags(stop_when_done=True))
        p.at = at
        try:
            if not p.space():
                return
            start = p.at
            value = p.document()
        except ParseError as e:
            yield at, e.position, None, e
            return
        at = p.at
        yield start, at, value, None


def test_paths_that_come_again_are_read_once():
    from leafwise.kernel import flat

    flat._key.cache_clear()
    for _ in range(3):
        assert flat.unflatten([("a.[1].b", 1), ("c", "x")]) == [("a", [None, [("b", 1)]]), ("c", "x")]
    assert flat._key.cache_info().misses == 2


def test_parts_without_rows():
    import pyarrow as pa

    from leafwise.functions import documents as D, kernels

    kind = pa.list_(pa.struct([("ord", pa.int32()), ("path", pa.string())]))
    assert kernels.lists([], [], [kernels.ordinals([]), []], kind).to_pylist() == [] and D.parsed(pa.array([], pa.string())) == []
    assert kernels.lists([2, 2], [True, False], [kernels.ordinals([2, 2]), ["x", "y"]], kind).to_pylist() == [[{"ord": 0, "path": "x"}, {"ord": 1, "path": "y"}], None]
