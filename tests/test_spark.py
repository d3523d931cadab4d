"""Column functions, operators and queries in a session."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill import schema as S
from gristmill import sources, streaming
from gristmill.functions import text as X
from gristmill.kernel import candidates as C
from gristmill.kernel import jsontext, names
from gristmill.operators import constraints as K
from gristmill.operators import ranking as R
from gristmill.operators.parse import explanation, from_messy_json, parse_candidates, parse_column, register, register_parser
from gristmill.plans import queries as P

DATA = "/root/testdata/sf0.001"
USER = T.StructType([S.required("name", T.StringType()), S.required("age", T.LongType())])
COUNT = T.StructType([S.required("k", T.LongType()), S.required("on", T.BooleanType())])


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_is_json_agrees_with_the_reader(spark):
    texts = ['{"a":1}', '{"a":1} x', "{'a':1}", "[1,2]", "[1,]", "NaN", "", " 7 ", '"x"', '{"a":1}{"b":2}', "tru", "null", "01", '{"a":NaN}']
    assert column(frame(spark, texts), X.is_json("text")) == [jsontext.readable(t) for t in texts]


def test_numbers_agree_with_the_kernel(spark):
    texts = ["42", " 1,234 ", "$1,234.56", "85%", "1/2", "5/2", "1e3", "x", "1 and 2", "-7.5", "1.", ".5", "1d", "+3", "1/0", "\t12", "\n 3/4 \u00a0", "\u20037\r\n,"]
    want = []
    from gristmill.kernel.coerce import Misfit, text_number

    for t in texts:
        try:
            want.append(text_number(t, True))
        except Misfit:
            want.append(None)
    assert column(frame(spark, texts), X.to_bigint("text")) == want


def test_raw_readings_agree_with_the_kernel(spark):
    texts = ["true", "So that is False.", "true or false", "40,002", "3.5,", "hello", '{"a":1}', '"quoted"', "x" * 1001, "", "\t12", "\n{", "\u2003 7,\n", " \t true\n", "\x1f5"]
    want = []
    for t in texts:
        found = C.raw_primitive(t)
        want.append({"raw_bool": "bool", "raw_string": "string"}.get(found[0].pattern, "number") if found else None)
    assert column(frame(spark, texts), X.raw_kind("text")) == want


def test_native_repairs(spark):
    texts = ["{a: 1,}", '{"x": [1, ],}']
    df = frame(spark, texts)
    assert column(df, X.trailing_commas(X.quoted_keys("text"))) == ['{"a": 1}', '{"x": [1 ]}']
    assert column(frame(spark, ["“a” ‘b’"]), X.smart_quotes("text")) == ["\"a\" 'b'"]
    text = '{\n"a": 1,\n"f": function() {}\n}'
    from gristmill.kernel.repair import functions

    assert column(frame(spark, [text]), X.js_functions("text")) == [functions(text)]


def test_native_names_and_variants(spark):
    assert column(frame(spark, ["userName", "UserName", "user-name", "a.b"]), X.snake_case("text")) == [names.snake(t) for t in ("userName", "UserName", "user-name", "a.b")]
    status = ["Active", "Inactive", "Pending"]
    texts = ["Activ", "Currently Active", "Active!", "act", "Unknown", "pending", "in-active"]
    assert column(frame(spark, texts), X.enum_match("text", status)) == [names.find_variant(t, [(s, None) for s in status]) for t in texts]


def test_nulls_and_empty(spark):
    df = frame(spark, [None, "", "   "])
    rows = df.orderBy("i").select(from_messy_json("text", USER).alias("m")).collect()
    assert rows[0].m is None and rows[1].m.error is not None and rows[2].m.error is not None
    assert frame(spark, []).select(from_messy_json("text", USER)).count() == 0


def test_fast_path_gives_the_same(spark):
    texts = ['{"k": 5, "on": true}', '{"k": "5", "on": true}', "{k: 6, on: false}", '{"k": 7.6, "on": true}', '{"k": 1, "on": true, "more": 2}', "none", None, '{"K": 3, "ON": false}', '{"k": 18446744073709551615, "on": true}']
    df = frame(spark, texts)
    for mode in ("basic", "fuzzy"):
        fast = parse_column(df, "text", COUNT, mode=mode).orderBy("i").select("parsed.*").collect()
        slow = parse_column(df, "text", COUNT, mode=mode, fast=False).orderBy("i").select("parsed.*").collect()
        assert fast == slow


ODD = [1, -3, 2.5, -0.5, 1e3, 1e300, 2**53 + 1, 2**63, 2**64 + 5, -(2**63), True, False, None, "", " 12 ", "12", "1,234", "$5.50", "85%", "1/3", "no", "yes", "True", "\\", 'say "k": 1', "é\u200b", "\t7\n", "9" * 25, "nan", "1e5", [], {}, [7], "x{y"]


@pytest.mark.parametrize("mode", ["fuzzy", "basic"])
def test_column_functions_read_what_the_kernel_reads(spark, mode):
    """Flat rows of four types with odd values, in all pairs of a value and a type, and keys that repeat, miss or differ in case."""
    kinds = {"n": T.LongType(), "r": T.DoubleType(), "b": T.BooleanType(), "s": T.StringType()}
    schema = T.StructType([T.StructField(k, t) for k, t in kinds.items()] + [T.StructField('a.b', T.LongType())])
    fine = {"n": 1, "r": 0.5, "b": True, "s": "t", "a.b": 9}
    texts = [json.dumps(fine | {k: v}) for k in kinds for v in ODD] + [json.dumps(fine | {k: v}, indent=1, ensure_ascii=False) for k in kinds for v in ODD]
    texts += ['{"n":1,"n":2,"r":1,"b":true,"s":"x","a.b":1}', '{"N":1,"r":1,"b":true,"s":"x","a.b":1}', '{"n":1,"r":1,"b":true,"s":"x","a.b":1,"more":{}}', '{"n":1,"r":1,"b":true,"s":"\\"n\\":","a.b":1}', '{"n" : 1 , "r":1,"b":true,"s" :\t"x","aXb":1}', "{}"]
    df = frame(spark, texts)
    fast = parse_column(df, "text", schema, mode=mode).orderBy("i").select("parsed", "parsed_error").collect()
    slow = parse_column(df, "text", schema, mode=mode, fast=False).orderBy("i").select("parsed", "parsed_error").collect()
    assert [(t, repr(r)) for t, r in zip(texts, fast)] == [(t, repr(r)) for t, r in zip(texts, slow)]


def test_clean_rows_stay_out_of_python(spark):
    """What the kernel gets of clean rows is null."""
    schema = T.StructType([S.required("name", T.StringType()), S.required("price", T.DoubleType()), S.required("n", T.LongType())])
    df = parse_column(frame(spark, ['{"name": "a", "price": "$1,234.50", "n": 2.5}', "{name: 'b', price: 1, n: 2}"]), "text", schema)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_plain" in plan and [tuple(r.parsed) for r in df.orderBy("i").collect()] == [("a", 1234.5, 3), ("b", 1.0, 2)]


def test_own_column_names_survive(spark):
    df = frame(spark, ['{"k": 1, "on": true}']).selectExpr("i", "text", "1 _messy", "2 _clean", "3 _plain")
    row = parse_column(df, "text", COUNT).first()
    assert (row["_messy"], row["_clean"], row["_plain"], row.parsed.k) == (1, 2, 3, 1)


def test_variants_without_accents(spark):
    variants = ["e", "Öl", "straße", "naive", "Wasser"]
    texts = ["é", "ol", "OL", "strasse", "naïve", "\tWasser\n", "wässer", "Ｗasser", "ŒUVRE", "e\u0301"]
    want = [names.find_variant(t, [(v, None) for v in variants]) for t in texts]
    assert column(frame(spark, texts), X.enum_match("text", variants)) == want
    letters = ["é", "ß", "Å", "ǅ", "ﬁ", "a\u0308", "Ａ", "½"]
    assert [a for a in column(frame(spark, letters), X.unaccented("text"))][:3] == ["e", "ss", "A"]


def test_constraints_within_a_parse(spark):
    own = [K.Constraint.hard("positive", lambda v: v["age"] > 0), K.Constraint.soft("short", lambda v: F.length(v["name"]) < 5, "a short name")]
    texts = ['{"name": "Al", "age": 3}', '{"name": "Alberta", "age": -1}', "nothing", None]
    df = frame(spark, texts).select("i", from_messy_json("text", USER, constraints=own).alias("m"))
    rows = [r.m for r in df.orderBy("i").collect()]
    assert [[c.passed for c in r.constraints] if r and r.constraints else None for r in rows] == [[True, True], [False, False], None, None]
    notes = [[(t.type, t.penalty, json.loads(t.payload)) for t in r.winner.transformations] for r in rows[:2]]
    assert notes[0] == [("constraint_checked", 0, {"is_assert": True, "name": "positive", "passed": True}), ("constraint_checked", 0, {"is_assert": False, "name": "short", "passed": True})]
    assert [n[1] for n in notes[1]] == [100, 10]
    # two notes leave 0.95 squared of the confidence: 9 hundredths lost
    assert [r.winner.score for r in rows[:2]] == [9, 119] and rows[2].error.code == "NoCandidates"
    typed = parse_column(frame(spark, texts), "text", USER, constraints=own)
    assert [r.parsed_constraints and K_passed(r.parsed_constraints) for r in typed.orderBy("i").collect()] == [True, False, None, None]


def K_passed(found):
    return all(c.passed or c.level != "assert" for c in found)


def test_options_reach_the_kernel(spark):
    kind = T.StructType([S.required("customer_name", T.StringType()), S.required("n", T.LongType(), coerce="twice")])
    twice = S.Coercer("twice", lambda v: 2 * int(v))
    df = frame(spark, ['{"customer_name_shown": "A", "n": 4}', '{"customer_name": "B", "n": []}'])
    rows = [r[0] for r in df.orderBy("i").select(from_messy_json("text", kind, coercers=[twice], substrings=True)).collect()]
    assert tuple(rows[0].value) == ("A", 8) and rows[1].error.path == "<root>.n"
    yaml = frame(spark, ["id: 1\nname: x"]).select(from_messy_json("text", "id bigint, name string", yaml=False)["error"]["code"])
    assert yaml.first()[0] == "NoCandidates"


def test_kernel_runs_once_below_a_filter(spark):
    df = parse_column(frame(spark, ["{name: 'A', age: 1}"]), "text", USER).where("parsed.age > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and df.count() == 1


def test_candidates_ranked_and_explained(spark):
    df = frame(spark, ['{"a": 1,}', 'see {"a": 1} and {"a": 2}']).select("i", parse_candidates("text").alias("c"))
    for r in df.select("i", R.rank("c").alias("ranked"), F.transform("c", lambda c: R.score(c)).alias("scores"), "c").collect():
        assert [x.score for x in r.ranked] == sorted(x.score for x in r.c)
        assert r.scores == [x.score for x in r.c]
    for text, told in zip(['{"a": 1,}', "hello"], column(frame(spark, ['{"a": 1,}', "hello"]).select("i", explanation(F.element_at(parse_candidates("text"), 1)).alias("e")), "e")):
        want = C.explain(C.parse(text)[0])
        got = json.loads(told)
        assert got["source"] == want["source"] and got["score"] == want["score"] and got["transformation_count"] == 0


def test_custom_strategy_and_names(spark):
    upper = (lambda text: [C.Candidate(text.upper(), "Direct")], 0)
    assert frame(spark, ["abc"]).select(parse_candidates("text", [upper])[0]["value"]).first()[0] == '"ABC"'
    # with no reading from the given strategies, the text is extracted and repaired
    assert frame(spark, ["[1,2"]).select(parse_candidates("text", ["direct_json"])[0]["source"]).first()[0] == "Fixed"
    assert len(C.STRATEGIES) == 8


def test_sql_surface(spark):
    register(spark)
    frame(spark, ["{name: 'Alice', age: 30}"]).createOrReplaceTempView("messy")
    register_parser(spark, "parse_user", "name string, age bigint")
    row = spark.sql("select parse_user(text).value v, clean_json(text) c from messy").first()
    assert row.v.asDict() == {"name": "Alice", "age": 30} and json.loads(row.c) == {"age": 30, "name": "Alice"}
    assert spark.sql("select m.i, c.source from messy m, lateral messy_candidates(m.text) c").count() > 0


def test_constraints(spark):
    df = spark.createDataFrame([("Bob", -5), ("", 25), ("Eve", 30), (None, 1)], "name string, age int")
    own = [K.Constraint.hard("age_positive", F.col("age") > 0), K.Constraint.soft("named", F.col("name") != "")]
    good, bad = K.split(df, own)
    assert good.count() == 3 and [r.name for r in bad.collect()] == ["Bob"]
    assert sorted(r[0] for r in good.select(K.penalty("constraints")).collect()) == [0, 10, 10]
    assert bad.select(K.describe("constraints")).first()[0].startswith("assert 'age_positive': failed")
    assert {r.name: (r.rows, r.passed) for r in K.rates(df, own).collect()} == {"age_positive": (4, 3), "named": (4, 2)}


def test_sources_and_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("{name: 'Alice', age: 30}")
    (tmp_path / "in" / "b.txt").write_text("nothing")
    df = parse_column(sources.texts(spark, str(tmp_path / "in")), "text", USER)
    sources.write_split(df, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out"))[-2:] == ["outcome=good", "outcome=quarantine"]
    stream = spark.readStream.text(str(tmp_path / "in"), wholetext=True)
    out = streaming.parsed(stream, "value", USER, [K.Constraint.hard("adult", F.col("parsed.age") >= 18)])
    streaming.once(out, str(tmp_path / "stream"), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert sorted(str(r.ok).lower() for r in spark.read.parquet(str(tmp_path / "stream")).collect()) == ["false", "true"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(P.QUERIES))
def test_query_against_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")

    def rows(df):
        plain = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) else str(v)
        return sorted(tuple(repr(plain(v)) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist())

    got, want = P.QUERIES[name](spark, DATA).toPandas(), con.execute(P.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
