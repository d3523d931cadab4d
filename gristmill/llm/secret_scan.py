"""Secret scans, with DataFrame functions only.

Three fixed patterns find assignments, access keys and long hexadecimal runs;
their spans are kept.  Beside them, every other word-like run of eight or more
characters is scored by two character Markov models, one of random strings and
one of ordinary identifiers: the log-likelihood ratio of its character pairs,
summed, so that a short run must be as clear a case as a long one.  Runs whose
ratio beats THRESHOLD, the log odds against a secret, are spans of kind `markov`.

The models are trained from labelled samples (value, random): by default
digests in several alphabets against identifiers and numbers of common forms
and the runs that several texts of about SAMPLE documents share.  They are two
tables of SYMBOLS**2 smoothed pair counts, so one array of their log ratios
reaches the plan, whatever the input's size.

Defined results: a null text is empty; an empty text has no spans, and its
base_sha256 is the digest of the empty string; offsets are code points;
repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text

# The patterns and least lengths of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # AKIA[A-Z0-9]+ of 16 or more characters: a run is taken whole
HEX = r"[0-9a-f]{32,}"
VALUE_LENGTH = 8
KINDS = ["assign", "access", "hex"]

RUN = r"[A-Za-z0-9_+/=-]{8,}"
#: Documents whose shared runs train the model of ordinary strings, about, and different texts that must share one.
SAMPLE, SHARED = 20_000, 3
#: Words that ordinary identifiers of the default sample are made of.
ORDINARY = (
    "get set user name index value config path file data list table column query result handler "
    "service client server request response error message version update delete create default "
    "license public private static return number count length buffer string object array account "
    "window button layout action event listener manager factory builder context session thread "
    "the and for with that this from have which when where their there about would other under "
    "apache licensed general terms copyright reserved warranty distribution software source"
).split()
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/=-"
SYMBOLS = len(ALPHABET) + 1
THRESHOLD = 10.0


def default_samples(spark: SparkSession, n: int = 8192, first: int = 0) -> DataFrame:
    """value, random: n random strings (digests in several alphabets) and n ordinary strings, by ids from `first` on."""
    ids = spark.range(first, first + n)
    form = lambda *of: F.element_at(F.array(*of), (F.col("id") % len(of) + 1).cast("int"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    base36 = F.concat(*(F.conv(F.substring(digest, k, 12), 16, 36) for k in (1, 13, 25, 37)))
    letters = F.translate(F.lower(base36), "0123456789", "qwertzuiop")
    random = ids.select(form(base64, F.translate(base64, "+/", "-_"), F.translate(base64, "+/", "aB"), F.lower(base36), base36, letters).alias("value"), F.lit(True).alias("random"))
    words = F.array(*map(F.lit, ORDINARY))
    draw = lambda k, n: F.pmod(F.hash(F.col("id"), F.lit(k)), F.lit(n))
    pick = lambda k: F.element_at(words, (draw(k, len(ORDINARY)) + 1).cast("int"))
    few = [pick(k) for k in range(4)]
    camel = F.concat(few[0], *(F.initcap(w) for w in few[1:]))
    date = F.date_add(F.lit("1990-01-01"), draw(5, 20_000)).cast("string")
    number = draw(6, 2_000_000_000).cast("string")
    joined = [F.concat_ws(c, *few) for c in "_-/"]
    ordinary = form(*joined, camel, F.upper(joined[0]), F.concat(few[0], draw(7, 3000).cast("string")), date, number, F.concat_ws("-", F.initcap(few[0]), few[1]))
    return random.unionByName(ids.select(ordinary.alias("value"), F.lit(False).alias("random")))


def shared_runs(docs: DataFrame, n: int = SAMPLE) -> DataFrame:
    """value, random (false): the runs that SHARED different texts or more of about n documents have; no secret is in several by chance."""
    rows = id_and_text(docs).where("text is not null").withColumn("hash", F.xxhash64("doc_id", "text"))
    share = min(1.0, n / max(1, rows.count()))
    rows = rows.where(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30)))
    runs = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))).alias("value")
    seen = rows.select(F.xxhash64("text").alias("text"), runs).groupBy("value").agg(F.countDistinct("text").alias("n"))
    return seen.where(F.col("n") >= SHARED).select("value", F.lit(False).alias("random"))


def code(c: Column) -> Column:
    """The symbol number of a character: its place in ALPHABET, else 0."""
    return F.instr(F.lit(ALPHABET), c)


def train(samples: DataFrame) -> list[float]:
    """Log ratios of the pair probabilities, random over ordinary; SYMBOLS**2 of them."""
    pair = F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> struct(substring(value, i, 1) a, substring(value, i + 1, 1) b))")).alias("p")
    pairs = samples.where("length(value) > 1").select("random", pair)
    counts = pairs.groupBy("random", code(F.col("p.a")).alias("a"), code(F.col("p.b")).alias("b")).count().collect()
    table = {True: [1.0] * SYMBOLS**2, False: [0.2] * SYMBOLS**2}
    for r in counts:
        table[r["random"]][r["a"] * SYMBOLS + r["b"]] += r["count"]
    out = []
    for a in range(SYMBOLS):
        row = slice(a * SYMBOLS, (a + 1) * SYMBOLS)
        t, f = table[True][row], table[False][row]
        st, sf = sum(t), sum(f)
        out += [math.log(x / st) - math.log(y / sf) for x, y in zip(t, f)]
    return out


def spans(text: Column, pattern: str, kind: str, keep=None, group: int = 0) -> Column:
    """Matches whose value `keep` holds for, as structs (start, end, kind, value), by the lengths of matches and of the gaps between them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,value:string>>")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("got"))

    def step(acc, one):
        start = acc["at"] + F.length(one["gap"])
        end = start + F.length(one["whole"])
        got = F.concat(acc["got"], F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), one["value"].alias("value"))))
        if keep is not None:
            got = F.when(keep(one["value"]), got).otherwise(acc["got"])
        return F.struct(end.alias("at"), got.alias("got"))

    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    return F.when(text.rlike(pattern), F.aggregate(zipped, begin, step, lambda acc: acc["got"])).otherwise(empty)


def log_ratio(value: Column, table: Column) -> Column:
    """The log-likelihood ratio of the character pairs of value, summed."""
    codes = F.transform(F.split(value, ""), code)
    begin = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.element_at(table, acc["last"] * SYMBOLS + c + 1))).alias("sum"))
    return F.aggregate(codes, begin, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base, found: arrays of spans (start, end, kind, value), base ones and those the models add."""
    if samples is None:
        samples = default_samples(docs.sparkSession).unionByName(shared_runs(docs))
    ratios = F.lit(train(samples))
    text = F.col("text")
    rows = id_and_text(docs).withColumn("text", F.coalesce(text, F.lit("")))
    is_random = lambda value: log_ratio(value, ratios) > threshold
    rows = rows.select(
        "doc_id",
        "text",
        spans(text, ASSIGN, "assign", lambda value: F.length(value) >= VALUE_LENGTH, 2).alias("assign"),
        spans(text, ACCESS, "access").alias("access"),
        spans(text, HEX, "hex").alias("hex"),
        F.exists(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), is_random).alias("any"),
    )
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    # places are worked out only where some run is random
    run = F.when(F.col("any"), spans(text, RUN, "markov", is_random)).otherwise(F.slice("base", 1, 0))
    free = F.filter(run, lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.select("doc_id", "assign", "access", "hex", "base", free.alias("found"))


def joined(all_spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.array(*map(F.lit, [*KINDS, "markov"]))
    keyed = F.transform(all_spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s["kind"], s["end"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov: one row per row of docs."""
    found = scan(docs, **options)
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("bigint").alias("n_markov"),
    )
