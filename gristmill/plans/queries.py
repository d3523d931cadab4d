"""Round-trip queries and their SQL.

Each query spoils columns of a table into messy text, parses it, and returns
what was read; its SQL selects the columns themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import text as X
from ..kernel import candidates as C
from ..operators import constraints as K
from ..operators import ranking as R
from ..operators.parse import explanation, from_messy_json, parse_candidates, parse_column, repaired, text_udf

LONG, TEXT, REAL, FLAG = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fmt(pattern: str, *columns: str) -> Column:
    """pattern with each {} replaced by a column, braces doubled."""
    own = iter(columns)
    parts = re.findall(r"\{\{|\}\}|\{\}|[^{}]+", pattern)
    return F.concat(*(F.col(next(own)).cast("string") if p == "{}" else F.lit(p[0] if p in ("{{", "}}") else p) for p in parts))


def struct(*fields: T.StructField) -> T.StructType:
    return T.StructType(list(fields))


ID_NAME = struct(S.required("id", LONG), S.required("name", TEXT))


def read_back(df: DataFrame, messy: Column, schema: T.StructType = ID_NAME, mode: str = "basic", **options) -> DataFrame:
    return parse_column(df.select(messy.alias("messy")), "messy", schema, mode=mode, **options).select("parsed.*")


CUSTOMER = "SELECT c_custkey AS id, c_name AS name FROM customer"
SUPPLIER = "SELECT s_suppkey AS id, s_name AS name FROM supplier"
PART = "SELECT p_partkey AS id, p_name AS name FROM part"
NATION = "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation"


@query("SELECT event_type, count(*) AS rows, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def direct_props(spark, sf_dir):
    parsed = parse_column(load(spark, sf_dir, "events"), "props", struct(S.required("k", LONG)))
    return parsed.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("parsed.k").alias("total"))


@query("SELECT event_id, true AS clean FROM events")
def strict_json_check(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", X.is_clean("props").alias("clean"))


def _simple(name: str, table: str, pattern: str, columns: tuple[str, str], sql: str, mode: str = "basic", schema: T.StructType = ID_NAME):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read_back(load(spark, sf_dir, table), fmt(pattern, *columns), schema, mode)

    QUERIES[name], SQL[name] = run, sql


C_COLUMNS, S_COLUMNS, P_COLUMNS, N_COLUMNS = ("c_custkey", "c_name"), ("s_suppkey", "s_name"), ("p_partkey", "p_name"), ("n_nationkey", "n_name")
_simple("trailing_commas", "customer", '{{"id": {}, "name": "{}",}}', C_COLUMNS, CUSTOMER)
_simple("single_quotes", "customer", "{{'id': {}, 'name': '{}'}}", C_COLUMNS, CUSTOMER)
_simple("unquoted_keys", "customer", '{{id: {}, name: "{}"}}', C_COLUMNS, CUSTOMER)
_simple("keys_and_quotes", "customer", "{{id: {}, name: '{}'}}", C_COLUMNS, CUSTOMER)
_simple("smart_quotes", "supplier", "{{“id”: {}, “name”: “{}”}}", S_COLUMNS, SUPPLIER)
_simple("backticks", "supplier", "{{`id`: {}, `name`: `{}`}}", S_COLUMNS, SUPPLIER)
_simple("comments", "supplier", '{{"id": {}, // the key\n "name": /* shown */ "{}"}}', S_COLUMNS, SUPPLIER)
_simple("newlines_in_strings", "part", '{{"id": {}, "note": "one\ntwo", "name": "{}"}}', P_COLUMNS, PART)
_simple("triple_quotes", "supplier", '{{"id": {}, "name": """{}"""}}', S_COLUMNS, SUPPLIER)
_simple("js_functions", "nation", '{{\n"id": {},\n"go": function(x) {{ return x }},\n"name": "{}"\n}}', N_COLUMNS, NATION)
_simple("double_escaped", "nation", '"{{\\"id\\": {}, \\"name\\": \\"{}\\"}}"', N_COLUMNS, NATION)
_simple("stray_backslashes", "nation", '{{\\"id\\": {}, \\"name\\": \\"{}\\"}}', N_COLUMNS, NATION)
_simple("unclosed", "customer", '{{"id": {}, "name": "{}"', C_COLUMNS, CUSTOMER)
_simple("missing_commas", "customer", '{{"id": "{}" "name": "{}"}}', C_COLUMNS, CUSTOMER)
_simple("many_commas", "supplier", '{{"id": {},,,, "name": "{}"}}', S_COLUMNS, SUPPLIER)
_simple("prose_embedded", "nation", 'Of course! The record is {{"id": {}, "name": "{}"}} as you asked.', N_COLUMNS, NATION)
_simple("prose_broken", "nation", "Of course! The record is {{id: {}, name: '{}'}} as you asked.", N_COLUMNS, NATION)
_simple("markdown_one", "nation", 'Here is the result:\n```json\n{{"id": {}, "name": "{}"}}\n```\nDone.', N_COLUMNS, NATION)
_simple("markdown_many", "nation", 'For example:\n```json\n{{"id": -1, "name": "x"}}\n```\nThe actual answer:\n```json\n{{"id": {}, "name": "{}"}}\n```', N_COLUMNS, NATION)
_simple("yaml_rows", "customer", "id: {}\nname: {}", C_COLUMNS, CUSTOMER.replace("c_name", "split_part(c_name, '#', 1) || '#' || split_part(c_name, '#', 2)"))
_simple("invisible", "nation", '﻿{{"i​d": {}, "na‍me": "{}"}}', N_COLUMNS, NATION)
_simple("deep_nesting", "nation", "{{" * 60 + '"id": {}, "name": "{}"' + "}}" * 60, N_COLUMNS, NATION)


@query("SELECT p_partkey AS id, CASE WHEN left(p_name, 1) IN ('t', 'f', 'n') THEN NULL ELSE p_name END AS name FROM part")
def unquoted_values(spark, sf_dir):
    schema = struct(S.optional("id", LONG), S.optional("name", TEXT))
    df = load(spark, sf_dir, "part").select("p_partkey", fmt("{{id: {}, name: {}}}", "p_partkey", "p_name").alias("messy"))
    # the repair leaves values that begin like true, false and null alone
    return parse_column(df, "messy", schema, mode="basic").select(F.col("p_partkey").alias("id"), "parsed.name")


@query("SELECT s_suppkey AS id, s_suppkey AS code FROM supplier")
def hex_numbers(spark, sf_dir):
    df = load(spark, sf_dir, "supplier").withColumn("hex", F.lower(F.hex("s_suppkey")))
    return read_back(df, fmt('{{"id": {}, "code": 0x{}}}', "s_suppkey", "hex"), struct(S.required("id", LONG), S.required("code", LONG)))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem")
def multi_objects(spark, sf_dir):
    """All line items of an order in one text, one object after another; back to rows."""
    one = fmt('{{"l": {}, "q": {}}}', "l_linenumber", "l_quantity")
    texts = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(one), " then ").alias("messy"))
    schema = T.ArrayType(struct(S.required("l", LONG), S.required("q", REAL)), False)
    parsed = texts.select("l_orderkey", F.explode(from_messy_json("messy", schema)["value"]).alias("x"))
    return parsed.select("l_orderkey", F.col("x.l").alias("l_linenumber"), F.col("x.q").alias("l_quantity"))


@query("SELECT o_orderkey, o_totalprice AS price, floor(o_totalprice + 0.5)::BIGINT AS rounded FROM orders")
def num_currency(spark, sf_dir):
    df = load(spark, sf_dir, "orders").withColumn("shown", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    df = df.select(fmt('{{"o_orderkey": {}, "price": "{}", "rounded": "{}"}}', "o_orderkey", "shown", "shown").alias("messy"))
    schema = struct(S.required("o_orderkey", LONG), S.required("price", REAL), S.required("rounded", LONG))
    return parse_column(df, "messy", schema).select("parsed.*")


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 100, 0) AS shown FROM lineitem")
def num_percent(spark, sf_dir):
    """Native: the number of a text, percent sign dropped."""
    shown = F.concat(F.round(F.col("l_discount") * 100, 0).cast("string"), F.lit("% off"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.only_number(shown).alias("shown"))


@query("SELECT p_partkey, p_size::DOUBLE / 7 AS part, floor(p_size::DOUBLE / 7 + 0.5)::BIGINT AS nearest FROM part")
def num_fraction(spark, sf_dir):
    text = fmt("{} / 7", "p_size")
    return load(spark, sf_dir, "part").select("p_partkey", X.to_double(text).alias("part"), X.to_bigint(text).alias("nearest"))


@query("SELECT c_custkey, trunc(c_acctbal)::BIGINT AS basic, (sign(c_acctbal) * floor(abs(c_acctbal) + 0.5))::BIGINT AS fuzzy, trunc(c_acctbal)::BIGINT AS native_basic, (sign(c_acctbal) * floor(abs(c_acctbal) + 0.5))::BIGINT AS native_fuzzy FROM customer")
def int_round_vs_cut(spark, sf_dir):
    df = load(spark, sf_dir, "customer").withColumn("messy", fmt('{{"n": {}}}', "c_acctbal"))
    schema = struct(S.required("n", LONG))
    both = parse_column(parse_column(df, "messy", schema, "b", mode="basic"), "messy", schema, "f")
    return both.select("c_custkey", F.col("b.n").alias("basic"), F.col("f.n").alias("fuzzy"), X.double_to_bigint("c_acctbal", "basic").alias("native_basic"), X.double_to_bigint("c_acctbal").alias("native_fuzzy"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS basic, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 END AS fuzzy FROM customer")
def bool_words(spark, sf_dir):
    even = F.col("c_custkey") % 2 == 0
    word = F.element_at(F.array(F.when(even, "True").otherwise("FALSE"), F.when(even, "yes").otherwise("No"), F.when(even, "1").otherwise("0")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", X.to_bool(word).alias("basic"), X.to_bool(word, "fuzzy").alias("fuzzy"))


@query("SELECT c_custkey AS customer_key, c_name AS customer_name FROM customer")
def fuzzy_fields(spark, sf_dir):
    styles = [("customerKey", "customerName"), ("CustomerKey", "CustomerName"), ("customer-key", "customer-name"), ("customer.key", "customer.name"), ("CUSTOMER_KEY", "CUSTOMER_NAME"), ("cüstomer_key", "customér_name")]
    texts = [fmt(f'{{{{"{a}": {{}}, "{b}": "{{}}"}}}}', *C_COLUMNS) for a, b in styles]
    text = F.element_at(F.array(*texts), (F.col("c_custkey") % len(styles) + 1).cast("int"))
    return read_back(load(spark, sf_dir, "customer"), text, struct(S.required("customer_key", LONG), S.required("customer_name", TEXT)), "fuzzy")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _mangled() -> Column:
    segment = F.col("c_mktsegment")
    return F.element_at(F.array(F.lower(segment), F.concat(F.initcap(segment), F.lit("!")), F.concat(F.lit("the "), segment, F.lit(" one")), F.substring(segment, 1, 5), F.translate(segment, "I", "Y")), (F.col("c_custkey") % 5 + 1).cast("int"))


@query("SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def enum_fuzzy(spark, sf_dir):
    df = load(spark, sf_dir, "customer").withColumn("mangled", _mangled())
    return read_back(df, fmt('{{"id": {}, "segment": "{}"}}', "c_custkey", "mangled"), struct(S.required("id", LONG), S.enum("segment", *SEGMENTS)), "fuzzy")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def enum_native(spark, sf_dir):
    """The same match as a column expression."""
    return load(spark, sf_dir, "customer").select("c_custkey", X.enum_match(_mangled(), SEGMENTS).alias("segment"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'number' ELSE 'words' END AS tag, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT END AS number, CASE WHEN p_partkey % 2 = 1 THEN p_name END AS words FROM part")
def union_number_text(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit('"'), "p_name", F.lit('"')))
    df = load(spark, sf_dir, "part").withColumn("v", value)
    schema = struct(S.required("id", LONG), S.union("value", S.required("number", LONG), S.required("words", TEXT)))
    parsed = parse_column(df.select(fmt('{{"id": {}, "value": {}}}', "p_partkey", "v").alias("messy")), "messy", schema)
    return parsed.select("parsed.id", "parsed.value.tag", "parsed.value.number", "parsed.value.words")


@query("SELECT c_custkey AS id, c_name AS name, 2 AS matched FROM customer")
def positional(spark, sf_dir):
    df = load(spark, sf_dir, "customer").select(fmt('[{}, "{}"]', *C_COLUMNS).alias("messy"))
    df = df.select(from_messy_json("messy", ID_NAME).alias("m"))
    notes = F.size(F.filter("m.winner.transformations", lambda t: t["type"] == "first_match"))
    return df.select("m.value.id", "m.value.name", notes.alias("matched"))


@query("SELECT n_nationkey::BIGINT AS value FROM nation")
def implied_key(spark, sf_dir):
    return read_back(load(spark, sf_dir, "nation"), fmt("{}", "n_nationkey"), struct(S.required("value", LONG)), "fuzzy", fast=False)


@query("SELECT s_suppkey, 'nation' AS key, s_nationkey::BIGINT AS value FROM supplier UNION ALL SELECT s_suppkey, 'supp', s_suppkey FROM supplier")
def map_skips_bad(spark, sf_dir):
    df = load(spark, sf_dir, "supplier").select("s_suppkey", fmt('{{"supp": {}, "name": "{}", "nation": "{}"}}', "s_suppkey", "s_name", "s_nationkey").alias("messy"))
    schema = T.MapType(TEXT, LONG)
    bad = F.regexp_replace("messy", "#[0-9]+", "")
    return df.select("s_suppkey", F.explode(from_messy_json(bad, schema)["value"]))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS item FROM nation")
def single_to_list(spark, sf_dir):
    schema = struct(S.required("id", LONG), S.required("items", T.ArrayType(TEXT)))
    df = load(spark, sf_dir, "nation").select(fmt('{{"id": {}, "items": "{}"}}', *N_COLUMNS).alias("messy"))
    return parse_column(df, "messy", schema).select("parsed.id", F.explode("parsed.items").alias("item"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, r.r_name AS region FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def nested_struct(spark, sf_dir):
    df = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    schema = struct(S.required("id", LONG), S.required("name", TEXT), S.required("region", struct(S.required("region_name", TEXT))), S.optional("note", TEXT))
    text = fmt("{{id: {}, Name: '{}', region: {{'RegionName': '{}'}}}}", "n_nationkey", "n_name", "r_name")
    return parse_column(df.select(text.alias("messy")), "messy", schema).select("parsed.id", "parsed.name", "parsed.region.region_name").withColumnRenamed("region_name", "region")


@query("SELECT conv_id, turn, 'string' AS kind FROM conversations WHERE strlen(trim(text)) <= 1000")
def raw_text_kind(spark, sf_dir):
    df = load(spark, sf_dir, "conversations").withColumn("kind", X.raw_kind("text"))
    return df.where("kind is not null").select("conv_id", "turn", "kind")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 10 WHEN o_orderkey % 4 = 2 THEN 33 ELSE 50 END AS score, CASE WHEN o_orderkey % 4 = 0 THEN 'Direct' WHEN o_orderkey % 4 = 1 THEN 'Markdown' WHEN o_orderkey % 4 = 2 THEN 'Fixed' ELSE 'Heuristic' END AS source FROM orders")
def rank_scores(spark, sf_dir):
    """Scores and the best of an inline list of candidates, native."""
    kinds = [("Direct", [], 1.0), ("Markdown", [], 1.0), ("Fixed", ["TrailingCommas", "SingleQuotes"], 0.9), ("Heuristic", [], 1.0)]
    none = F.array().cast("array<struct<type:string,penalty:int>>")
    every = [F.struct(F.lit(s).alias("source"), F.array(*map(F.lit, f)).cast("array<string>").alias("fixes"), F.lit(c).cast("float").alias("confidence"), none.alias("transformations"), F.lit(0).alias("max_depth")) for s, f, c in kinds]
    worst_first = F.slice(F.array(*every[::-1]), 1, (F.lit(4) - F.col("o_orderkey") % 4).cast("int"))
    best = load(spark, sf_dir, "orders").select("o_orderkey", R.best(worst_first).alias("c"))
    return best.select("o_orderkey", R.score("c").alias("score"), "c.source")


@query("SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (o_totalprice > 100000) AS kept, count(*) FILTER (o_totalprice > 100000 AND o_orderpriority <> '5-LOW') AS checked FROM orders GROUP BY o_orderstatus")
def constraints_split(spark, sf_dir):
    own = [K.Constraint.hard("price", F.col("o_totalprice") > 100000), K.Constraint.soft("urgent", F.col("o_orderpriority") != "5-LOW")]
    df = load(spark, sf_dir, "orders").withColumn("r", K.results(own))
    ok = K.asserts_passed("r")
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.count_if(ok).alias("kept"), F.count_if(ok & (K.penalty("r") == 0)).alias("checked"))


@query("SELECT 'price' AS name, 'assert' AS level, count(*) AS rows, count(*) FILTER (o_totalprice > 100000) AS passed FROM orders UNION ALL SELECT 'urgent', 'check', count(*), count(*) FILTER (o_orderpriority <> '5-LOW') FROM orders")
def constraint_rates(spark, sf_dir):
    own = [K.Constraint.hard("price", F.col("o_totalprice") > 100000), K.Constraint.soft("urgent", F.col("o_orderpriority") != "5-LOW")]
    return K.rates(load(spark, sf_dir, "orders"), own)


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Direct' ELSE 'Fixed' END AS source, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'TrailingCommas' ELSE 'SingleQuotes' END AS fixes, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 31 ELSE 32 END AS score, count(*) AS rows FROM customer GROUP BY ALL")
def repair_report(spark, sf_dir):
    texts = [fmt('{{"id": {}}}', "c_custkey"), fmt('{{"id": {},}}', "c_custkey"), fmt("{{'id': {}}}", "c_custkey")]
    df = load(spark, sf_dir, "customer").select(F.element_at(F.array(*texts), (F.col("c_custkey") % 3 + 1).cast("int")).alias("messy"))
    won = df.select(from_messy_json("messy", struct(S.required("id", LONG))).alias("m")).select("m.winner.*")
    return won.groupBy("source", F.array_join("fixes", ",").alias("fixes"), "score").agg(F.count("*").alias("rows"))


@query("SELECT n_nationkey, s AS source, n AS candidates FROM nation, (VALUES ('Heuristic', 2), ('MultiJson', 2), ('MultiJsonArray', 1)) v(s, n)")
def candidate_rows(spark, sf_dir):
    """All readings of a text, as rows."""
    df = load(spark, sf_dir, "nation").select("n_nationkey", parse_candidates(fmt('{{"id": {}}} and {{"name": "{}"}}', *N_COLUMNS)).alias("c"))
    rows = df.select("n_nationkey", F.explode("c.source").alias("source"))
    return rows.groupBy("n_nationkey", "source").agg(F.count("*").cast("int").alias("candidates"))


@query("SELECT n_nationkey, '{\"source\":{\"type\":\"direct\"},\"confidence\":1.0,\"score\":0,\"transformations\":[],\"transformation_count\":0,\"max_transformation_depth\":0}' AS explanation FROM nation")
def explanations(spark, sf_dir):
    df = load(spark, sf_dir, "nation").select("n_nationkey", parse_candidates(fmt('{{"id": {}}}', "n_nationkey")).alias("c"))
    return df.select("n_nationkey", explanation(F.element_at("c", 1)).alias("explanation"))


@query("SELECT n_nationkey, '{\"id\":' || n_nationkey || '}' AS value, 'TrailingCommas' AS fixes FROM nation")
def repairs_listed(spark, sf_dir):
    df = load(spark, sf_dir, "nation").select("n_nationkey", repaired(fmt('{{"id": {},}}', "n_nationkey")).alias("r"))
    return df.select("n_nationkey", F.element_at("r", 1)["value"].alias("value"), F.array_join(F.element_at("r", 1)["fixes"], ",").alias("fixes"))


@query("SELECT c_custkey, 'customer_' || c_custkey || '_name' AS snake, 'customer' || c_custkey || 'Name' AS camel, c_name AS plain FROM customer")
def name_functions(spark, sf_dir):
    df = load(spark, sf_dir, "customer")
    snake = X.snake_case(fmt("customer-{}Name", "c_custkey"))
    camel = X.camel_case(fmt("customer_{}_name", "c_custkey"))
    return df.select("c_custkey", snake.alias("snake"), camel.alias("camel"), X.strip_invisible(F.concat(F.lit("​"), "c_name", F.lit("﻿"))).alias("plain"))


@query("SELECT p_partkey, p_name || ', {\"a\": 1}' AS commas, 'x: ' || p_name AS spaces FROM part")
def cleaners(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    commas = text_udf(lambda t: C.spaces(C.multiple_commas(t)))(fmt('{},,, {{"a": 1}}', "p_name"))
    return df.select("p_partkey", commas.alias("commas"), text_udf(C.clean)(fmt("  x:   {}  ", "p_name")).alias("spaces"))


@query("SELECT p_partkey AS id, p_name AS name, false AS failed FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT NULL, NULL, true FROM part WHERE p_partkey % 2 = 1")
def errors_as_columns(spark, sf_dir):
    text = F.when(F.col("p_partkey") % 2 == 0, fmt('{{"id": {}, "name": "{}"}}', *P_COLUMNS)).otherwise(fmt("nothing in {}", "p_name"))
    df = parse_column(load(spark, sf_dir, "part").select(text.alias("messy")), "messy", ID_NAME)
    return df.select("parsed.id", "parsed.name", F.col("parsed_error").isNotNull().alias("failed"))


# --- the reading that wins, told with what was read


def winner(df: DataFrame, messy: Column, schema: T.DataType = ID_NAME, mode: str = "basic", **options) -> DataFrame:
    """id, name, and the source and repairs of the winning candidate."""
    df = df.select(from_messy_json(messy, schema, mode, **options).alias("m"))
    return df.select("m.value.*", "m.winner.source", F.array_join("m.winner.fixes", ",").alias("fixes"))


def _won(name: str, table: str, pattern: str, columns: tuple[str, str], sql: str, source: str, fixes: str = "", mode: str = "basic", **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return winner(load(spark, sf_dir, table), fmt(pattern, *columns), mode=mode, **options)

    QUERIES[name], SQL[name] = run, f"SELECT *, '{source}' AS source, '{fixes}' AS fixes FROM ({sql})"


# a repair wins where no other strategy reads the text, or where only it is asked for
_won("won_unclosed", "supplier", '{{"id": {}, "name": "{}"', S_COLUMNS, SUPPLIER, "Fixed", "UnclosedBraces", strategies=["json_fixer"])
_won("won_double_escaped", "nation", '{{\\"id\\": {}, \\"name\\": \\"{}\\"}}', N_COLUMNS, NATION, "Direct")
_won("won_markdown", "nation", 'Here is the result:\n```json\n{{"id": {}, "name": "{}"}}\n```\nDone.', N_COLUMNS, NATION, "Markdown", strategies=["markdown"])
_won("won_markdown_commas", "nation", '```json\n{{"id": {}, "name": "{}",}}\n```', N_COLUMNS, NATION, "Markdown", strategies=["markdown"])
_won("won_heuristic", "nation", 'The record is {{"id": {}, "name": "{}"}}, as asked.', N_COLUMNS, NATION, "Heuristic", strategies=["heuristic"])
_won("won_yaml", "nation", "id: {}\nname: {}", N_COLUMNS, NATION, "Yaml")
_won("won_extracted_fence", "nation", 'So:\n```\n{{"id": {},, "name": "{}"}}\n```', N_COLUMNS, NATION, "Markdown", strategies=["direct_json"], extractors=[(lambda t: [c for c in C.extract(t) if c.source == "Markdown"], 0)])
_won("won_state_machine", "nation", 'Well {{"id": {}, "name": "{}"', N_COLUMNS, NATION, "Direct", strategies=["state_machine"])
_won("own_cleaner", "nation", "<{}|{}>", N_COLUMNS, NATION, "Direct", strategies=["direct_json"], cleaners=[lambda t: '{"id": ' + t[1:-1].replace("|", ', "name": "') + '"}'])


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_nationkey::DOUBLE / 4 AS ratio, left(n_name, 1) AS initial, n_nationkey % 2 = 1 AS odd, NULL::VARCHAR AS missing FROM nation")
def basic_scalars(spark, sf_dir):
    """Exact names, scalars from text: float, char, bool, and an optional field that is absent."""
    df = load(spark, sf_dir, "nation").select("*", (F.col("n_nationkey") / 4).alias("ratio"), F.substring("n_name", 1, 1).alias("initial"), F.when(F.col("n_nationkey") % 2 == 1, "yes").otherwise("No").alias("odd"))
    text = fmt('{{"id": "{}", "name": "{}", "ratio": "{}", "initial": "{}", "odd": "{}"}}', "n_nationkey", "n_name", "ratio", "initial", "odd")
    schema = struct(S.required("id", LONG), S.required("name", TEXT), S.required("ratio", REAL), S.required("initial", TEXT, char=True), S.required("odd", FLAG), S.optional("missing", TEXT))
    return read_back(df, text, schema, fast=False)


@query("SELECT n_nationkey::BIGINT AS id, n_name AS item, n_nationkey % 3 AS at FROM nation")
def basic_lists(spark, sf_dir):
    """A list, of which one element may stand alone, in basic mode."""
    df = load(spark, sf_dir, "nation").withColumn("at", F.col("n_nationkey") % 3)
    several = F.concat(F.lit('["-", '), F.when(F.col("at") == 2, F.lit('"-", ')).otherwise(""), F.lit('"'), "n_name", F.lit('"]'))
    df = df.withColumn("items", F.when(F.col("at") == 0, F.concat(F.lit('"'), "n_name", F.lit('"'))).otherwise(several))
    parsed = parse_column(df.select(fmt('{{"id": {}, "items": {}}}', "n_nationkey", "items").alias("messy")), "messy", struct(S.required("id", LONG), S.required("items", T.ArrayType(TEXT))), mode="basic")
    rows = parsed.select("parsed.id", F.posexplode("parsed.items").alias("at", "item")).where("item <> '-'")
    return rows.select("id", "item", F.col("at").cast("bigint").alias("at"))


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::BIGINT END AS number, CASE WHEN n_nationkey % 2 = 1 THEN n_name END AS words, n_nationkey % 2 = 2 AS none FROM nation")
def enum_payload(spark, sf_dir):
    """Enum variants that carry values, as one-key objects."""
    value = F.when(F.col("n_nationkey") % 2 == 0, fmt('{{"number": {}}}', "n_nationkey")).otherwise(fmt('{{"words": "{}"}}', "n_name"))
    kind = T.StructType([T.StructField("number", LONG), T.StructField("words", TEXT), T.StructField("none", FLAG)])
    df = load(spark, sf_dir, "nation").withColumn("v", value)
    parsed = parse_column(df.select(fmt('{{"id": {}, "v": {}}}', "n_nationkey", "v").alias("messy")), "messy", struct(S.required("id", LONG), S.required("v", kind, payload=True)), mode="basic")
    return parsed.select("parsed.id", "parsed.v.number", "parsed.v.words", F.coalesce("parsed.v.none", F.lit(False)).alias("none"))


@query("SELECT n_nationkey::BIGINT AS id, '{\"name\":\"' || n_name || '\"}' AS anything, '[' || n_nationkey || ',\"' || n_name || '\"]' AS shown FROM nation")
def any_value(spark, sf_dir):
    """A field that takes any value, as JSON, and a text field of a list."""
    text = fmt('{{"id": {}, "anything": {{"name": "{}"}}, "shown": [{}, "{}"]}}', "n_nationkey", "n_name", "n_nationkey", "n_name")
    schema = struct(S.required("id", LONG), S.required("anything", TEXT, json=True), S.required("shown", TEXT))
    return read_back(load(spark, sf_dir, "nation"), text, schema, "fuzzy")


@query("SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 3 WHEN 0 THEN 'one' WHEN 1 THEN 'many' ELSE 'named' END AS tag, n_name AS name FROM nation")
def union_scored(spark, sf_dir):
    """The cheapest of three alternatives: a number, a list of texts, a struct."""
    value = F.element_at(F.array(fmt('"{}"', "n_nationkey"), fmt('["{}"]', "n_name"), fmt('{{"Name": "{}"}}', "n_name")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    alternatives = S.required("one", LONG), S.required("many", T.ArrayType(TEXT)), S.required("named", struct(S.required("name", TEXT)))
    df = load(spark, sf_dir, "nation").withColumn("v", value)
    df = df.select("n_name", parse_input(fmt('{{"id": {}, "v": {}}}', "n_nationkey", "v")))
    parsed = parse_column(df, "messy", struct(S.required("id", LONG), S.union("v", *alternatives, scored=True)))
    v = F.col("parsed.v")
    return parsed.select("parsed.id", v["tag"].alias("tag"), F.coalesce(v["many"][0], v["named"]["name"], F.when(v["one"] == F.col("parsed.id"), F.col("n_name"))).alias("name"))


def parse_input(text: Column) -> Column:
    return text.alias("messy")


@query("SELECT o_orderkey AS id, o_totalprice > 100000 AS dear, o_orderstatus = 'F' AS done, CASE WHEN o_totalprice > 100000 THEN 0 ELSE 100 END + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 10 END + 9 AS score FROM orders WHERE o_orderkey % 16 = 0")
def parse_constraints(spark, sf_dir):
    """Constraints on what was parsed, and what they add to the winner's score (two notes cost 9 hundredths of confidence)."""
    own = [K.Constraint.hard("dear", lambda v: v["price"] > 100000), K.Constraint.soft("done", lambda v: v["status"] == "F")]
    schema = struct(S.required("id", LONG), S.required("price", REAL), S.required("status", TEXT))
    df = load(spark, sf_dir, "orders").where("o_orderkey % 16 = 0")
    m = df.select(from_messy_json(fmt('{{"id": {}, "price": {}, "status": "{}"}}', "o_orderkey", "o_totalprice", "o_orderstatus"), schema, constraints=own).alias("m"))
    return m.select("m.value.id", F.col("m.constraints")[0]["passed"].alias("dear"), F.col("m.constraints")[1]["passed"].alias("done"), F.col("m.winner.score").alias("score"))


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '<root>.region.size' WHEN 1 THEN '<root>.codes.1' ELSE '<root>' END AS path FROM nation")
def error_paths(spark, sf_dir):
    """Where in the target a text fails."""
    texts = ['{"name": "{}", "region": {"size": "wide"}, "codes": [1]}', '{"name": "{}", "region": {"size": 1}, "codes": [1, {}]}', '{"region": {"size": 1}, "codes": [1]}']
    text = F.element_at(F.array(*(F.replace(F.lit(t), F.lit('"{}"'), F.concat(F.lit('"'), "n_name", F.lit('"'))) for t in texts)), (F.col("n_nationkey") % 3 + 1).cast("int"))
    schema = struct(S.required("name", TEXT), S.required("region", struct(S.required("size", LONG))), S.required("codes", T.ArrayType(LONG)))
    df = load(spark, sf_dir, "nation").withColumn("messy", text)
    return parse_column(df, "messy", schema, mode="basic").select("n_nationkey", F.col("parsed_error.path").alias("path"))


@query("SELECT n_nationkey, n_name AS nation FROM nation")
def enum_accents(spark, sf_dir):
    """Names of nations with accents put on, matched without them, natively and by the kernel."""
    names = [r.n_name for r in load(spark, sf_dir, "nation").select("n_name").collect()]
    df = load(spark, sf_dir, "nation").withColumn("shown", F.translate("n_name", "AEIOU", "ÀÉÎÖÜ"))
    parsed = parse_column(df.withColumn("messy", fmt('{{"nation": "{}"}}', "shown")), "messy", struct(S.enum("nation", *names)))
    native = X.enum_match("shown", names)
    return parsed.select("n_nationkey", F.when(native == F.col("parsed.nation"), native).alias("nation"))


@query("SELECT n_nationkey, round(pow(0.95, n_nationkey % 5), 4)::DOUBLE AS confidence, 3 * CAST(pow(10, n_nationkey % 3) AS INT) + floor(100 * (1 - pow(0.95, n_nationkey % 5)))::INT AS by_depth FROM nation")
def scores_by_depth(spark, sf_dir):
    """Confidence after transformations, and scores in which deeper ones cost more, native."""
    notes = F.array(F.struct(F.lit("float_to_int").alias("type"), F.lit(3).alias("penalty")))
    df = load(spark, sf_dir, "nation").withColumn("n", (F.col("n_nationkey") % 5).cast("int"))
    confidence = F.when(F.col("n") > 0, R.decayed(F.greatest("n", F.lit(1)))).otherwise(F.lit(1.0).cast("float"))
    one = F.struct(F.lit("Direct").alias("source"), F.array().cast("array<string>").alias("fixes"), confidence.alias("confidence"), notes.alias("transformations"), (F.col("n_nationkey") % 3).cast("int").alias("max_depth"))
    return df.select("n_nationkey", F.round(confidence.cast("double"), 4).alias("confidence"), R.score(one, by_depth=True).alias("by_depth"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def stripped_names(spark, sf_dir):
    """Keys with punctuation, and in another case."""
    text = F.when(F.col("n_nationkey") % 2 == 0, fmt('{{"[id]": {}, "name?": "{}"}}', *N_COLUMNS)).otherwise(fmt('{{"ID!": {}, "(NAME)": "{}"}}', *N_COLUMNS))
    return read_back(load(spark, sf_dir, "nation"), text, ID_NAME, "fuzzy")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def substring_names(spark, sf_dir):
    """Keys that hold a field's name, where that is asked for."""
    return read_back(load(spark, sf_dir, "nation"), fmt('{{"the_id": {}, "shown_name_here": "{}"}}', *N_COLUMNS), ID_NAME, "fuzzy", substrings=True)


@query("SELECT n_nationkey::BIGINT AS id, strlen(n_name)::BIGINT AS size FROM nation")
def own_coercion(spark, sf_dir):
    """A user's reading of a field: the length of a text."""
    size = S.Coercer("size", lambda v: len(v))
    schema = struct(S.required("id", LONG), S.required("size", LONG, coerce="size"))
    return read_back(load(spark, sf_dir, "nation"), fmt("{{id: {}, size: '{}'}}", *N_COLUMNS), schema, "fuzzy", coercers=[size])


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def clean_and_dirty(spark, sf_dir):
    """Nine rows of ten are clean JSON, which column functions read; the tenth needs repairs."""
    clean, dirty = fmt('{{"id": {}, "name": "{}", "balance": {}}}', "c_custkey", "c_name", "c_acctbal"), fmt("{{'id': {}, 'name': '{}', 'balance': {},}}", "c_custkey", "c_name", "c_acctbal")
    text = F.when(F.col("c_custkey") % 10 == 0, dirty).otherwise(clean)
    schema = struct(S.required("id", LONG), S.required("name", TEXT), S.required("balance", REAL))
    return read_back(load(spark, sf_dir, "customer"), text, schema, "fuzzy")


@query("SELECT n_nationkey, '{\"source\":{\"type\":\"direct\"},\"confidence\":0.9025,\"score\":11,\"transformations\":[{\"type\":\"first_match\",\"penalty\":1,\"index\":0,\"total\":2},{\"type\":\"first_match\",\"penalty\":1,\"index\":1,\"total\":2}],\"transformation_count\":2,\"max_transformation_depth\":0}' AS explanation FROM nation")
def explanations_of_changes(spark, sf_dir):
    """The account of a value that was read by position."""
    df = load(spark, sf_dir, "nation").select("n_nationkey", from_messy_json(fmt('[{}, "{}"]', *N_COLUMNS), ID_NAME).alias("m"))
    return df.select("n_nationkey", explanation(F.col("m.winner")).alias("explanation"))


@query("SELECT n_nationkey::BIGINT AS id, (n_nationkey % 3)::VARCHAR AS grade, CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS open FROM nation")
def enum_of_numbers(spark, sf_dir):
    """Variants that are matched by numbers and booleans."""
    df = load(spark, sf_dir, "nation").withColumn("grade", F.col("n_nationkey") % 3).withColumn("open", F.col("n_nationkey") % 2 == 0)
    schema = struct(S.required("id", LONG), S.enum("grade", "0", "1", "2"), S.enum("open", "true", "false"))
    return read_back(df, fmt('{{"id": {}, "grade": {}, "open": {}}}', "n_nationkey", "grade", "open"), schema, "fuzzy")
