"""Protobuf: wire round trips, JSON and flat form, write-back."""

import base64

import pytest

from leafwise.kernel import transcode
from leafwise.kernel.emit import dumps
from leafwise.kernel.flat import FlatError
from leafwise.kernel.lexer import parse
from leafwise.kernel.transcode import TranscodeError, from_json, leaves, set_flat, to_json
from leafwise.kernel.wire import _BOOT, Msg, Pool, WireError, decode, encode, is_any, is_map
from leafwise.options import JsonToPb, PbToJson

POOL = Pool.declare(
    {
        "Color": {"RED": 0, "BLUE": 2},
        "Any": {"type_url": (1, "string"), "value": (2, "bytes")},
        "Entry": {"key": (1, "string"), "value": (2, "int32")},
        "Inner": {"a": (1, "int64"), "deep": (2, "Inner")},
        "Whole": {
            "id": (1, "int32", "required"), "u": (2, "uint64"), "s": (3, "sint32"), "f": (4, "float"), "d": (5, "double"), "b": (6, "bool"), "t": (7, "string"), "raw": (8, "bytes"), "c": (9, "Color"), "inner": (10, "Inner"),
            "nums": (11, "int64", "repeated"), "inners": (12, "Inner", "repeated"), "map": (13, "Entry", "repeated"), "any": (14, "Any"), "x_Z042_": (15, "fixed32"), "sf": (16, "sfixed64"), "person_name": (17, "string", "optional", "nobody"),
        },
        "(Whole)": {"hobby": (100, "string")},
        "List": {"ints": (1, "sint64", "repeated")},
    }
)
TEXT = '{"hobby":"chess","id":-5,"u":18446744073709551615,"s":-7,"f":1.5,"d":0.1,"b":true,"t":"é","raw":"AP8=","c":"BLUE","inner":{"a":-1,"deep":{"a":2}},"nums":[1,-2],"inners":[{"a":3},{}],"any":{"type_url":"type.googleapis.com/Inner","value":"CAc="},"x*":9,"sf":-3,"person_name":"p","map":{"k":1,"l":2}}'


def whole(text=TEXT, **options):
    return from_json(parse(text)[0], POOL.message("Whole"), POOL, JsonToPb(**options))


def test_json_and_wire_round_trip():
    message, skipped = whole()
    assert not skipped and dumps(to_json(message)) == TEXT
    again = decode(encode(message), POOL.message("Whole"), POOL)
    assert dumps(to_json(again)) == TEXT and encode(again) == encode(message)


def test_the_public_library_reads_the_same_bytes():
    pb = pytest.importorskip("google.protobuf.descriptor_pb2")
    from google.protobuf import descriptor_pool, json_format, message_factory

    types = {"int64": 3, "double": 1, "string": 9, "sint32": 17, "bytes": 12, "bool": 8, "fixed32": 7}
    proto = pb.FileDescriptorProto(name="t.proto", package="p", syntax="proto3")
    m = proto.message_type.add(name="M")
    for i, (k, n) in enumerate(types.items(), 1):
        m.field.add(name=f"f_{k}", number=i, type=n, label=1)
    m.field.add(name="many", number=20, type=3, label=3)
    m.field.add(name="sub", number=21, type=11, label=1, type_name=".p.M")
    desc = descriptor_pool.DescriptorPool()
    desc.Add(proto)
    made = message_factory.GetMessageClass(desc.FindMessageTypeByName("p.M"))(f_int64=-9, f_double=2.5, f_string="é", f_sint32=-3, f_bytes=b"\0\xff", f_bool=True, f_fixed32=7, many=[1, -1, 300], sub={"f_string": "in"})
    pool = Pool.from_descriptor_set(pb.FileDescriptorSet(file=[proto]).SerializeToString())
    own = decode(made.SerializeToString(), pool.message("p.M"), pool)
    assert encode(own) == made.SerializeToString()
    assert json_format.Parse(dumps(to_json(own)), type(made)()) == made


def test_standard_mapping():
    message, _ = whole('{"id":1,"u":"7","person_name":"p","d":"NaN"}')
    assert dumps(to_json(message, PbToJson(standard=True))) == '{"id":1,"u":"7","d":"NaN","personName":"p"}'


def test_descriptor_set_of_the_descriptor_set():
    out = Msg(_BOOT.messages["FileDescriptorSet"], _BOOT)
    assert Pool.from_descriptor_set(encode(out)).messages == {}


def test_options():
    message, _ = whole('{"id":1,"c":"BLUE"}')
    assert dumps(to_json(message)) == '{"id":1,"c":"BLUE","map":{}}'
    assert dumps(to_json(message, PbToJson(enum_by_name=False, maps=False, empty_arrays=True))) == '{"id":1,"c":2,"nums":[],"inners":[],"map":[]}'
    assert '"person_name":"nobody"' in dumps(to_json(message, PbToJson(always_print=True)))
    ints, _ = from_json(parse("[1,-2]")[0], POOL.message("List"), POOL, JsonToPb(array_to_single_repeated=True))
    assert dumps(to_json(ints, PbToJson(single_repeated_to_array=True))) == "[1,-2]"
    assert whole('{"id":1,"personName":"z"}', camel_names=True)[0]["person_name"] == "z"
    assert whole('{"id":1,"raw":"zz"}', base64_to_bytes=False)[0]["raw"] == b"zz"
    with pytest.raises(TranscodeError, match="Missing required field: Whole.id"):
        to_json(Msg(POOL.message("Whole"), POOL))


@pytest.mark.parametrize(
    ("text", "error"),
    [("[]", "the input json can't be array here [Whole]"), ("{}", "Missing required field: Whole.id"), ('{"id":null}', "Missing required field: Whole.id"), ('{"id":"1"}', "Invalid value `\"1\"' for field `Whole.id' which SHOULD be INT32"), ('{"id":1,"nums":3}', "Invalid value for repeated field: Whole.nums"), ('{"id":1,"nums":[true]}', "Invalid value `true' for field `Whole.nums' which SHOULD be INT64"), ('{"id":1,"inner":3}', "The input is not a json object [Inner]"), ('{"id":1,"any":null}', "Non-object value for Any field: Whole.any"), ('{"id":1,"any":{"type_url":"x","value":"@"}}', "google.protobuf.Any value must be valid base64"), ('{"id":1,"raw":"@@@"}', "Fail to decode base64 string=@@@ [Whole]"), ('{"t":23}', "Missing required field: Whole.id")],
)
def test_errors(text, error):
    with pytest.raises(TranscodeError) as e:
        whole(text)
    assert str(e.value) == error


def test_mismatch_of_optional_fields_is_told_and_skipped():
    message, skipped = whole('{"id":1,"t":23,"u":"7","d":"-Infinity","s":2147483648,"c":"GREEN","zzz":1}')
    assert skipped == "Invalid value `2147483648' for optional field `Whole.s' which SHOULD be INT32, Invalid value `23' for optional field `Whole.t' which SHOULD be string, Invalid value `\"GREEN\"' for optional field `Whole.c' which SHOULD be enum"
    assert message["u"] == 7 and message["d"] == float("-inf")


def test_flat():
    message, _ = whole()
    flat = {p: (t, v) for p, t, v in leaves(message)}
    assert list(flat)[:3] == ["hobby", "id", "u"] and flat["inner.deep.a"] == ("int64", 2) and flat["nums.[1]"] == ("int64", -2) and flat["map.l"] == ("int32", 2) and flat["any.value"] == ("string", "CAc=") and flat["x*"] == ("uint32", 9)
    copy = Msg(POOL.message("Whole"), POOL)
    for p, t, v in leaves(message):
        set_flat(copy, p, None if t == "string" else t, v) if t != "float" else set_flat(copy, p, t, v)
    copy.values["inners"].append(copy.new(copy.desc.by_name["inners"]))
    assert dumps(to_json(copy)) == TEXT


def test_write_back():
    m = Msg(POOL.message("Whole"), POOL)
    set_flat(m, "nums.[2]", "int64", 5)
    assert m["nums"] == [0, 0, 5]
    set_flat(m, "inners.[1].deep.a", None, "12")
    set_flat(m, "map.q", "int32", 4)
    set_flat(m, "raw", None, "AP8=")
    set_flat(m, "b", None, "TRUE")
    assert m["inners"][1]["deep"]["a"] == 12 and m["map"][0]["value"] == 4 and m["raw"] == b"\0\xff" and m["b"] is True
    set_flat(m, "b", "null", None)
    assert not m.has("b")
    m.values["any"] = Msg(POOL.message("Any"), POOL)
    m["any"].values.update(type_url="type.googleapis.com/Inner", value=base64.b64decode("CAc="))
    set_flat(m, "any.deep.a", "int64", 3)
    assert encode(decode(m["any"]["value"], POOL.message("Inner"), POOL)) == m["any"]["value"] and decode(m["any"]["value"], POOL.message("Inner"), POOL)["deep"]["a"] == 3
    for path, tag, value, text in [("nums", "int64", 1, "requires index"), ("id.[0]", "int32", 1, "non-repeated"), ("nums.[-1]", "int64", 1, "negative"), ("zz", "int32", 1, "not found"), ("u", "int64", 1, "type mismatch: field is uint64"), ("id", "int64", 1 << 40, "int32 overflow"), ("inner", "int32", 1, "message field"), ("map", "int32", 1, "key segment"), ("map.k.z", "int32", 1, "extra path"), ("c", "int32", 9, "enum value number"), ("b", None, "maybe", "invalid bool"), ("", None, "", "empty")]:
        with pytest.raises(FlatError, match=text):
            set_flat(m, path, tag, value)


def test_names_and_kinds():
    for name in ("_Afledk2e*_+%leGi___hE_Z278_t#", "9lives", "plain_1"):
        assert transcode.decode_name(transcode.encode_name(name)) == name
    assert transcode.encode_name("a+b") == "a_Z043_b" and transcode.camel("a_bc_D_e") == "aBc_DE"
    assert is_map(POOL.message("Whole").by_name["map"], POOL) and not is_map(POOL.message("Whole").by_name["inners"], POOL) and is_any(POOL.message("Any"))


def test_unknown_fields_survive_and_bad_bytes_fail():
    data = encode(whole()[0])
    assert len(encode(decode(data, POOL.message("Inner"), POOL))) > 0
    for bad in (b"\x08", b"\x0a\x05ab", b"\xff" * 11):
        with pytest.raises(WireError):
            decode(bad, POOL.message("Whole"), POOL)


def test_made_codecs_agree_with_the_general_code():
    """Functions made for a message type take what is usual; they did not exist, and each message was read by descriptors."""
    from leafwise.kernel import transcode as T, wire
    from leafwise.kernel.lexer import parse
    from leafwise.options import JsonToPb

    for proto3 in (False, True):
        pool = wire.Pool.declare(
            {
                "E": {"NO": 0, "YES": 5}, "Kv": {"key": (1, "string"), "value": (2, "sint32")}, "Sub": {"id": (1, "int32"), "more": (2, "Sub"), "names": (3, "string", "repeated")},
                "M": {"a": (3, "int64"), "b": (1, "uint64"), "c": (2, "double"), "d": (4, "E"), "e": (5, "bytes"), "f": (6, "Sub"), "g": (7, "Sub", "repeated"), "h": (8, "Kv", "repeated"), "i": (9, "sint64", "repeated"), "j": (10, "fixed32", "repeated"), "k": (11, "bool"), "l": (12, "float"), "m": (13, "int32")},
            }, proto3,
        )
        desc = pool.message("M")
        assert pool.codec(desc).decode and pool.codec(desc).read
        texts = [
            '{"a":-1,"b":18446744073709551615,"c":2,"d":"YES","e":"Rg==","f":{"id":-7,"more":{"names":["é",""]}},"g":[{},{"id":300}],"h":{"x":-3,"y":0},"i":[-1,70000],"j":[1,4294967295],"k":true,"l":0.5,"m":-2}',
            "{}", '{"a":0,"k":false,"e":"","d":"NO","c":0}', '{"a":"12","b":"-1"}', '{"a":1,"a":2}', '{"d":5}', '{"d":"MAYBE"}', '{"e":"*"}', '{"h":[{"key":"q","value":1}]}', '{"h":{"x":null}}', '{"l":1e39}', '{"g":[null]}', '{"a":true,"m":1.5}', '{"f":[]}', '{"i":5}', '{"a":99999999999999999999}',
        ]
        outcome = lambda f: _outcome(f)
        for text in texts:
            value = parse(text)[0]
            made, general = outcome(lambda: T.from_json(value, desc, pool)), outcome(lambda: T._from_json(value, desc, pool, JsonToPb()))
            if isinstance(general, str):
                assert made == general, text
                continue
            data = wire._encode(general[0])
            assert (wire.encode(made[0]), made[1]) == (data, general[1]), text
            for cut in range(len(data) + 1):
                one, other = outcome(lambda: T.to_json(wire.decode(data[:cut], desc, pool))), outcome(lambda: T.to_json(wire._decode(data[:cut], desc, pool)))
                assert one == other, (text, cut)
            assert wire.encode(wire.decode(data + data + b"\xa8\x06\x01", desc, pool)) == wire._encode(wire._decode(data + data + b"\xa8\x06\x01", desc, pool))


def _outcome(f):
    try:
        return f()
    except ValueError as e:
        return f"{type(e).__name__}: {e}"
