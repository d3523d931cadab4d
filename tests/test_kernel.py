"""Whole texts through the kernel: candidates, repairs and coercion."""

import pytest
from pyspark.sql import types as T

from gristmill import schema as S
from gristmill.kernel import candidates as C
from gristmill.kernel import jsontext, names, repair
from gristmill.kernel.coerce import Misfit, basic, choose_alternative, from_text, lenient, only_number, strict, fraction, Log

LONG, TEXT, FLAG, REAL = T.LongType(), T.StringType(), T.BooleanType(), T.DoubleType()


def struct(*fields):
    return S.of(T.StructType(list(fields)))


def req(name, kind):
    return S.required(name, kind)


def opt(name, kind):
    return S.optional(name, kind)


USER2 = struct(req("name", TEXT), req("age", T.IntegerType()))
USER3 = struct(req("name", TEXT), req("age", T.IntegerType()), opt("email", TEXT))
ALICE = {"name": "Alice", "age": 30}


def got(text, shape, mode="basic"):
    value, _, _, error = from_text(text, shape, mode)
    assert error is None, error
    return value


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"name": "Alice", "age": 30,}', ALICE),
        ("{'name': 'Alice', 'age': 30}", ALICE),
        ("{\"name\": 'Bob', \"age\": 25}", {"name": "Bob", "age": 25}),
        ('{name: "Alice", age: 30}', ALICE),
        ('{"name": "Alice" "age": 30}', ALICE),
        ('{"name": "Alice", "age": 30', ALICE),
        ('{"name": "Alice" /* this is her name */, "age": 30}', ALICE),
        ('{"name": "Alice", "age": 30} // the user', ALICE),
        ('`{"name": "Alice", "age": 30}`', ALICE),
        ("{`name`: `Bob`, `age`: 25}", {"name": "Bob", "age": 25}),
        ('"{\\"name\\": \\"Alice\\", \\"age\\": 30}"', ALICE),
        ('{\\"name\\": \\"Alice\\", \\"age\\": 30}', ALICE),
        ('﻿{"name​": "Dave‌", "age‍": 40}', {"name": "Dave", "age": 40}),
        ('{"name": "Alice",,,, "age": 30}', ALICE),
        ("Here you are: {name: 'Alice', age: 30} and so on", ALICE),
        ('The user is {"name": "Charlie", "age": 35,} as asked', {"name": "Charlie", "age": 35}),
        ("name: Alice\nage: 30", ALICE),
        ('{"name": "Alice", "age": 0x1E}', ALICE),
        ("“ignored” {“name”: “Alice”, “age”: 30}", ALICE),
        ('```json\n{"name": "Alice", "age": 30}\n```', ALICE),
        ("{" * 60 + '"name": "Alice", "age": 30' + "}" * 60, ALICE),
        ('{\n"name": "Alice",\n"go": function() { return 1 },\n"age": 30\n}', ALICE),
    ],
)
def test_basic_user(text, want):
    assert got(text, USER2) == want


def test_first_of_two_objects():
    assert got('{"name": "Alice", "age": 30} {"name": "Bob", "age": 25}', USER3) == {"name": "Alice", "age": 30, "email": None}


def test_objects_on_lines():
    shape = S.of(T.ArrayType(T.StructType([req("name", TEXT), req("age", T.IntegerType())])))
    assert [u["name"] for u in got('{"name": "Alice", "age": 30}\n{"name": "Bob", "age": 25}', shape)] == ["Alice", "Bob"]


def test_apostrophe_is_kept():
    assert got('{"text": "It\'s working", "sender": "Alice"}', struct(req("text", TEXT), req("sender", TEXT)))["text"] == "It's working"


@pytest.mark.parametrize(
    "text,kind,mode,want",
    [
        ("7,204,318", LONG, "fuzzy", 7204318),
        ("6.75.", REAL, "fuzzy", 6.75),
        ("1/5", REAL, "fuzzy", 0.2),
        ("4 crates of quinces, still green", REAL, "fuzzy", 4.0),
        ("I would call that true", T.ArrayType(FLAG), "fuzzy", [True]),
        ("False.\n\nBecause of it.", FLAG, "fuzzy", False),
        ("[1, 2, 3", T.ArrayType(LONG), "fuzzy", [1, 2, 3]),
        ("[1, 2, 3,]", T.ArrayType(LONG), "fuzzy", [1, 2, 3]),
        ('"hello', TEXT, "fuzzy", '"hello'),
        ("hello", TEXT, "fuzzy", "hello"),
        ('{"count": 1e6}', T.StructType([req("count", LONG)]), "basic", {"count": 1000000}),
        ('{"count": 42.7}', T.StructType([req("count", T.IntegerType())]), "basic", {"count": 42}),
        ('{"done": "85%"}', T.StructType([req("done", LONG)]), "basic", {"done": 85}),
        ('{"a": "50%", "b": "3.15%"}', T.StructType([req("a", REAL), req("b", REAL)]), "basic", {"a": 50.0, "b": 3.15}),
        ('{"key": "value', T.StructType([req("key", TEXT)]), "fuzzy", {"key": "value"}),
        ('{"hi": "a"}', T.ArrayType(T.StructType([req("hi", T.ArrayType(TEXT))])), "fuzzy", [{"hi": ["a"]}]),
        ('{"foo": "[\\"bar\\"]"}', T.StructType([req("foo", TEXT)]), "fuzzy", {"foo": '["bar"]'}),
        ('{" answer ": {" content ": 78.54}}', T.StructType([req("answer", T.StructType([req("content", REAL)]))]), "fuzzy", {"answer": {"content": 78.54}}),
        ('first {"stop": "Oslo"} and then, later on, {"stop": "Bergen"} at last', T.ArrayType(T.StructType([req("stop", TEXT)])), "fuzzy", [{"stop": "Oslo"}, {"stop": "Bergen"}]),
        ("{\n town: port of call,\n tides: [4, 16, 28],\n ferry: {\n  line: coastal\n }\n}", T.StructType([req("town", TEXT), req("tides", T.ArrayType(LONG)), req("ferry", T.StructType([req("line", TEXT)]))]), "fuzzy", {"town": "port of call", "tides": [4, 16, 28], "ferry": {"line": "coastal"}}),
    ],
)
def test_texts(text, kind, mode, want):
    assert got(text, S.of(kind), mode) == want


@pytest.mark.parametrize("keys", ["userName maxCount", "UserName MaxCount", "user-name max-count", "user.name max.count", "user_name max_count"])
def test_key_styles(keys):
    a, b = keys.split()
    shape = struct(req("user_name", TEXT), req("max_count", LONG))
    assert got(f'{{"{a}": "x", "{b}": 3}}', shape, "fuzzy") == {"user_name": "x", "max_count": 3}


def test_key_case():
    assert got('{"NAME": "Alice", "AGE": 30}', USER2, "fuzzy") == ALICE
    assert names.find_key(["username"], "user_name") is None


def test_fixed_numbers():
    long = S.of(LONG)
    for text, want in (("1/2", 1), ("3/4", 1), ("5/2", 3), ("$1,234.56", 1235), ("$1,234.49", 1234)):
        assert lenient(text, long, Log()) == want
    assert lenient(42.7, long, Log()) == 43
    assert only_number("€1.234,56") is None and fraction("1/0") is None
    assert basic("42.5", S.of(LONG)) == 43
    with pytest.raises(Misfit):
        basic("1/2", S.of(LONG))


def test_enum():
    status = [("Active", None), ("Inactive", None), ("Pending", None)]
    for text in ("Activ", "Currently Active", "Active!", "act", "active"):
        assert names.find_variant(text, status) == "Active", text
    assert names.find_variant("Unknown", status) is None
    assert names.find_variant("", status) == "Active"


def test_union():
    both = S.of(T.StructType([S.union("v", req("s", TEXT), req("n", LONG))])).fields[0][1]
    assert lenient("42", both, Log()) == {"tag": "s", "s": "42", "n": None}
    assert lenient(42, both, Log())["tag"] == "n"
    lists = S.of(T.StructType([S.union("v", req("many", T.ArrayType(LONG)), req("one", LONG))])).fields[0][1]
    assert lenient([1, 2], lists, Log())["many"] == [1, 2]
    assert lenient(42, lists, Log())["one"] == 42
    i, value, notes = choose_alternative("7", [S.of(T.ArrayType(LONG)), S.of(LONG)])
    assert (i, value, notes[0]["type"], notes[0]["index"]) == (1, 7, "union_match", 0)


def test_map_skips_what_does_not_fit():
    shape = S.of(T.MapType(TEXT, LONG))
    assert lenient({"one": 1, "two": "not a number", "three": 3}, shape, Log()) == [("one", 1), ("three", 3)]


def test_implied_key_and_positions():
    value, winner, _, _ = from_text('["Alice", 30]', struct(req("name", TEXT), req("age", LONG)))
    assert value == ALICE and [t["type"] for t in winner.transformations] == ["first_match", "first_match"]
    value, winner, _, _ = from_text("42", struct(req("value", LONG)))
    assert value == {"value": 42} and winner.transformations[0]["type"] == "implied_key"
    value, winner, _, _ = from_text('["test", "not-a-number"]', struct(req("name", TEXT), opt("count", LONG)))
    assert value == {"name": "test", "count": None}
    assert winner.transformations[-1]["type"] == "default_but_had_unparseable_value"


def test_payload_enum():
    shape = struct(S.required("s", T.StructType([opt("Active", FLAG), opt("Completed", T.StructType([req("message", TEXT)]))]), payload=True))
    assert got('{"s": "Active"}', shape)["s"]["Active"] is True
    assert got('{"s": {"Completed": {"message": "ok"}}}', shape)["s"]["Completed"] == {"message": "ok"}


def test_errors():
    assert from_text("This is not JSON at all", USER2, "basic")[3].code == "DeserializeFailed"
    assert from_text('{"name": "Alice", "age": "not_a_number"}', USER3, "basic")[3] is not None
    assert from_text("zzz", USER2, "fuzzy")[3].code == "NoCandidates"


def sources(text):
    return [(c.source, C.score(c)) for c in C.parse(text)]


def test_traces():
    assert sources('{"name":"Alice","age":30}') == [("Direct", 0)]
    assert sources('{"a":1,}')[:5] == [("Fixed", 31)] * 5
    assert sources("{'a': 1}")[:4] == [("Fixed", 32)] * 4
    assert ("Direct", 0) in sources('{"a": 1')
    assert sources('Data: {"a": 1} ok') == [("Heuristic", 50), ("Direct", 0)]
    assert sources('see\n```json\n{"a": 1}\n```\nend') == [("Markdown", 10), ("Heuristic", 50), ("Direct", 0)]
    assert sources('{"k":"v1"} {"k":"v2"}') == [("MultiJsonArray", 25), ("Heuristic", 50), ("Heuristic", 50), ("MultiJson", 30), ("MultiJson", 30)]
    assert sources("name: Alice\nage: 30") == [("Yaml", 15), ("Heuristic", 50)]
    assert [c.value for c in C.parse("40,002")] == [40002.0, "40,002"]
    assert [c.value for c in C.parse('"42"')] == [42]
    assert [c.value for c in C.parse("")] == [""]
    assert [c.fixes for c in C.parse("see {name: 'Alice', age: 30} there")] == [["UnquotedKeys", "UnquotedValues"], ["UnquotedKeys", "SingleQuotes"]]


def test_markdown_prefers_real_block():
    text = 'For example:\n```json\n{"a": 1}\n```\nThe actual result:\n```json\n{"a": 2}\n```\n'
    ranked = C.rank(C.parse(text))
    assert ranked[0].value == {"a": 2}


def test_scores():
    assert C.score(C.fixed({}, ["TrailingCommas", "SingleQuotes"])) == 33
    c = C.Candidate(1, "Direct")
    C.transform(c, {"type": "string_to_number", "penalty": 2})
    assert C.score(c) == 7
    assert C.explain(c)["transformation_count"] == 1


@pytest.mark.parametrize(
    "code,text,want",
    [
        ("UnclosedBraces", '{"a": [1, 2', '{"a": [1, 2]}'),
        ("MissingCommas", '{"a": "x" "b": ["y" "z"] "c": {}}', '{"a": "x" ,"b": ["y" ,"z"] ,"c": {}}'),
        ("TripleQuotedStrings", '{"a": """x\n"y" """}', '{"a": "x\\n\\"y\\" "}'),
        ("UnescapedNewlines", '{"a": "x\ny"}', '{"a": "x\\ny"}'),
        ("UnquotedValues", "{a: some text, b: -5, c: true}", '{a: "some text", b: "-5", c: true}'),
        ("HexNumbers", "[0xFF, 10xA]", "[255, 110]"),
        ("Comments", '{"a": "//x" // y\n}', '{"a": "//x" \n}'),
        ("DoubleEscaped", '"[{\\"a\\": 1}]"', '[{"a": 1}]'),
        ("SmartQuotes", "{“a”: ‘b’}", "{\"a\": 'b'}"),
        ("FieldNormalization", '{"userName": 1}', None),
    ],
)
def test_repairs(code, text, want):
    assert repair.FIXES[code][0](text) == want


def test_valid_json_needs_no_repair():
    assert C.json_fixer('{"name": "Alice", "age": 30}') == []


def test_strict_json():
    for bad in ("NaN", "[1,]", "{'a':1}", '"\\ud800"', "1e999", "01", '{"a":1} x', "[" * 200 + "]" * 200, '"a\nb"'):
        assert not jsontext.readable(bad), bad
    assert jsontext.write(jsontext.read('{"b":1e6,"a":[1.5,1e-7,1e16,"é"]}')) == '{"a":[1.5,1e-7,1e16,"é"],"b":1000000.0}'
    assert strict([1], S.of(T.ArrayType(LONG))) == [1]


# --- scopes, unions by score, users' own parts


@pytest.mark.parametrize(
    "text,mode,code,path",
    [
        ('{"user": {"name": "A", "age": "old"}}', "fuzzy", "NoCandidates", "<root>.user.age"),
        ('{"user": {"name": "A", "age": "old"}}', "basic", "DeserializeFailed", "<root>.user.age"),
        ('{"user": {"name": "A"}}', "basic", "DeserializeFailed", "<root>.user"),
        ('{"user": 5}', "basic", "DeserializeFailed", "<root>.user"),
        ("[]", "basic", "DeserializeFailed", "<root>"),
    ],
)
def test_errors_tell_where(text, mode, code, path):
    shape = struct(req("user", T.StructType([req("name", TEXT), req("age", LONG)])))
    _, _, _, error = from_text(text, shape, mode)
    assert (error.code, error.scope) == (code, path)


def test_errors_in_lists_and_maps():
    for kind, text, path in ((T.ArrayType(LONG), "[1, {}, 3]", "<root>.1"), (T.MapType(TEXT, LONG), '{"a": 1, "b": []}', "<root>.b")):
        assert from_text(text, S.of(kind), "basic")[3].scope == path


def union_of(*alternatives, scored=True):
    return struct(S.union("v", *alternatives, scored=scored)).fields[0][1]


def test_union_by_score():
    # one string for a list of strings costs less than for a struct of which it is the only field
    both = union_of(req("one", T.StructType([req("word", TEXT)])), req("many", T.ArrayType(TEXT)))
    assert lenient("x", both, Log())["tag"] == "many"
    assert lenient("x", union_of(*reversed_fields(both), scored=False), Log())["tag"] == "many"
    # defaults cost more than a changed name
    named = union_of(req("a", T.StructType([req("first_name", TEXT), opt("age", LONG)])), req("b", T.StructType([req("firstName", TEXT)])))
    assert lenient({"FirstName": "A"}, named, Log(True))["tag"] == "b"
    # a strict fit costs nothing, whatever comes first
    log = Log()
    assert lenient([1], union_of(req("t", TEXT), req("n", T.ArrayType(LONG))), log) == {"tag": "n", "t": None, "n": [1]}
    assert [(n["type"], n["index"], n["candidates"]) for n in log.items] == [("union_match", 0, ["t", "n"])]
    with pytest.raises(Misfit):
        lenient("x", union_of(req("n", LONG), req("f", FLAG)), Log())


def reversed_fields(shape):
    kinds = {"many": req("many", T.ArrayType(TEXT)), "one": req("one", T.StructType([req("word", TEXT)]))}
    return [kinds[name] for name, _, _ in shape.fields][::-1]


@pytest.mark.parametrize(
    "a,b,want",
    [
        (["single_to_array", "array_item_parse_error"], ["array_item_parse_error"], 1),
        (["single_to_array"], ["implied_key"], -1),
        (["array_item_parse_error"], ["array_item_parse_error"] * 2, -1),
        (["default_value_inserted"], ["default_value_inserted", "string_to_number"], 1),
        (["json_to_string"], ["extra_key"], 1),
        (["extra_key"], ["extra_key"], 0),
    ],
)
def test_ties_between_alternatives(a, b, want):
    from gristmill.kernel.coerce import worse

    assert worse(a, b) == want == -worse(b, a)


def test_derived_union_notes_its_choice():
    shape = S.of(T.StructType([S.union("v", req("s", TEXT), req("n", LONG))])).fields[0][1]
    _, winner, _, _ = from_text('"hello"', shape)
    assert [(t["type"], t["index"]) for t in winner.transformations] == [("union_match", 0)]
    _, winner, _, _ = from_text("[42]", union_of(req("n", LONG), req("f", FLAG), scored=False))
    assert [t["type"] for t in winner.transformations][:1] == ["union_match"]


def test_own_coercion():
    from datetime import date

    days = S.Coercer("iso_day", lambda v: date.fromisoformat(v).toordinal(), strict=lambda v: date.fromisoformat(v).toordinal() if v[4] == "-" else 1 / 0)
    shape = S.of(T.StructType([req("name", TEXT), S.optional("day", LONG, coerce="iso_day"), S.required("days", T.ArrayType(LONG), items={"coerce": "iso_day"})]), None, [days])
    value, _, _, error = from_text("{name: 'x', day: '2024-02-30', days: ['20240101', '2024-01-02']}", shape)
    first = date(2024, 1, 1).toordinal()
    assert error is None and value == {"name": "x", "day": None, "days": [first, first + 1]}
    _, _, _, error = from_text('{"name": "x", "days": ["2024-01-01", "soon"]}', shape, "basic")
    assert error.scope == "<root>.days.1" and "iso_day" in str(error)
    with pytest.raises(KeyError):
        S.of(T.StructType([S.required("day", LONG, coerce="iso_day")]))


def test_substring_keys():
    kind = T.StructType([req("customer_name", TEXT), req("total", LONG)])
    text = '{"customer_name_shown": "A", "total": 3}'
    assert from_text(text, S.of(kind))[3].code == "NoCandidates"
    assert from_text(text, S.of(kind, None, (), True))[0] == {"customer_name": "A", "total": 3}


def test_own_cleaners_and_extractors():
    text = "<<a=1;b=2>>"
    find = (lambda t: [C.Candidate(t[2:-2], "Heuristic", pattern="angles")], 1)
    to_json = [lambda t: t.replace("=", '":').replace(";", ',"'), lambda t: '{"' + t + "}"]
    found = C.parse(text, strategies=["direct_json"], cleaners=to_json, extractors=[find])
    assert [(c.value, c.pattern) for c in found] == [({"a": 1, "b": 2}, "angles")]
    assert C.parse(text, strategies=["direct_json"], extractors=[]) == []


def test_yaml_can_be_left_out(monkeypatch):
    text = "id: 1\nname: x"
    assert "Yaml" in {c.source for c in C.parse(text)} and "Yaml" not in {c.source for c in C.parse(text, yaml=False)}
    monkeypatch.setattr(C, "_load", None)
    monkeypatch.setattr(C, "_yaml_loader", lambda: None)
    with pytest.raises(ModuleNotFoundError):
        C.parse(text)
    assert C.parse("plain words", yaml=True)


def test_the_winner_is_the_same_without_late_strategies():
    """Texts of every kind, with all candidates and with the better ones first."""
    texts = [
        '{"name": "A", "age": 3}', '{"name": "A", "age": "3"}', "{'name': 'A', 'age': 3}", 'so {"name": "A", "age": 3} it is', '{"name": "A", "age": 3} {"name": "B", "age": 4}',
        '```json\n{"name": "A", "age": 3,}\n```', "name: A\nage: 3", '{"name": "A", "age": 3', '"{\\"name\\": \\"A\\", \\"age\\": 3}"', '["A", 3]', "nothing", "", "true 3", '{"name": "A"} {"age": 3',
        'x {"name": "A", "age": 3, } y {"name"', "{name: A, age: 3}", '[{"name": "A", "age": 3}]', "{" * 60 + '"name": "A", "age": 3' + "}" * 60, "- name: A\n  age: 3\n- b: c",
    ]
    shapes = [USER2, S.of(T.ArrayType(T.StructType([req("name", TEXT), req("age", LONG)]))), S.of(TEXT), S.of(T.MapType(TEXT, TEXT)), S.of(LONG), S.of(FLAG)]
    for text in texts:
        for shape in shapes:
            for mode in ("fuzzy", "basic"):
                value, winner, _, error = from_text(text, shape, mode)
                again, chosen, _, other = from_text(text, shape, mode, every=False)
                assert (value, winner, str(error), error and error.code) == (again, chosen, str(other), other and other.code), (text, shape, mode)
