"""Secrets in texts: known forms by pattern, other random strings by two character Markov models.

One model knows random strings, the other ordinary words and identifiers, both from labelled samples.
A candidate is a secret if its characters, each after the one before it, are likelier under the first
by a clear margin. Everything is a column expression; a text is scanned whole and never leaves its row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

# The forms of known secrets. Runs of hex digits are entered at their first digit only.
ASSIGN = """(?i:password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
MIN_VALUE = 8

KINDS = ("assign", "access", "hex", "random")
#: Parts that the models judge, each by itself: 16 characters or more with a letter and a digit, not
#: divided by anything else. So a key behind a path, or after a prefix with _ or -, is judged alone.
LEAST = 16
PART = "A-Za-z0-9+"
CANDIDATE = f"(?<![{PART}])(?=[A-Za-z+]*+[0-9])(?=[0-9+]*+[A-Za-z])[{PART}]{{{LEAST},}}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+"
N = len(SYMBOLS) + 1
#: Nats by which a candidate has to be likelier as a random string, in all and per character.
MARGIN, MARGIN_PER_CHARACTER = 12.0, 0.7
#: Labelled strings of each class, and distinct documents they are taken from, about, that the models
#: are fitted on.
SAMPLE, SAMPLE_DOCUMENTS = 20_000, 4000
BACKOFF = 20.0
CHUNK = 512
MARK = "[SECRET]"


def _running(steps: Column, chunk: int = CHUNK) -> Column:
    """Running sums of an array, by chunks so that a long one takes no quadratic time."""

    def sums(values: Column) -> Column:
        return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / chunk).cast("int")), lambda c: sums(F.slice(steps, c * chunk + 1, F.lit(chunk))))
    ends = lambda inner: sums(F.transform(inner, lambda p: F.element_at(p, -1)))
    # `transform` over a one-element array names the chunks, so that they are made once.
    joined = F.transform(F.array(chunks), lambda inner: F.transform(F.array(ends(inner)), lambda bases: F.flatten(F.transform(inner, lambda p, c: F.transform(F.slice(p, 2, chunk), lambda x: x + bases[c])))))
    return F.flatten(F.flatten(joined))


def _found(docs: DataFrame, kind: str, pattern: str, value_group: int = 0, least: int = 1) -> DataFrame:
    """Adds `_<kind>`: start, end (code points) and value of all leftmost matches, without overlaps."""
    p, empty = F.lit(pattern), F.array().cast("array<struct<start:int,end:int,value:string>>")
    hit = F.col("__text").rlike(pattern)
    docs = docs.withColumn("__m", F.when(hit, F.struct(
        F.transform(F.split("__text", pattern, -1), F.length).alias("gaps"),
        F.transform(F.regexp_extract_all("__text", p, F.lit(0)), F.length).alias("lengths"),
        F.regexp_extract_all("__text", p, F.lit(value_group)).alias("values"),
    )))
    docs = docs.withColumn("__steps", F.when(F.col("__m").isNotNull(), F.transform("__m.lengths", lambda x, i: F.col("__m.gaps")[i] + F.when(i > 0, F.get("__m.lengths", i - 1)).otherwise(0))))
    docs = docs.withColumn("__starts", F.when(F.col("__m").isNotNull(), _running(F.col("__steps"))))
    spans = F.transform("__starts", lambda s, i: F.struct(s.alias("start"), (s + F.col("__m.lengths")[i]).alias("end"), F.col("__m.values")[i].alias("value")))
    spans = F.filter(spans, lambda x: F.length(x["value"]) >= least)
    return docs.withColumn(f"__{kind}", F.coalesce(F.when(F.col("__m").isNotNull(), spans), empty)).drop("__m", "__steps", "__starts")


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of (class, pair of neighbouring symbols); a string begins after symbol 0."""
    at = lambda i: F.position(F.substring("string", i, F.lit(1)), F.lit(SYMBOLS))
    pair = F.transform(F.sequence(F.lit(1), F.length("string")), lambda i: F.when(i > 1, at(i - 1)).otherwise(0) * N + at(i))
    return strings.where("string <> ''").select("random", F.explode(pair).alias("pair")).groupBy("random", "pair").count()


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all symbol pairs, from `samples` of (string, random boolean).

    A symbol pair's frequency is mixed with BACKOFF times that of its second symbol, which itself is
    smoothed by one. Without samples all ratios are 0 and nothing is found; null strings are
    ignored. The table has N * N entries whatever the samples are.
    """
    counts = [[0] * (N * N) for _ in range(2)]
    for r in _pairs(samples.where("string is not null and random is not null")).collect():
        counts[r.random][r.pair] += r["count"]
    logs = []
    for c in counts:
        single = [1 + sum(c[b::N]) for b in range(N)]
        total = [sum(c[a * N : (a + 1) * N]) for a in range(N)]
        logs.append([math.log((c[i] + BACKOFF * single[i % N] / sum(single)) / (total[i // N] + BACKOFF)) for i in range(N * N)])
    return [r - o for o, r in zip(*logs)]


def _identifiers(words: DataFrame) -> DataFrame:
    """Ordinary parts with digits, made of words of the corpus as names in code and addresses are.

    Two words in camel case, in small letters or in capitals, with a number behind or between them, and
    numbers and dates by themselves.
    """
    numbered = words.select("string", F.xxhash64("string").alias("h"))
    other = numbered.select(F.col("string").alias("second"), F.pmod("h", F.lit(1 << 20)).alias("at"), F.row_number().over(Window.partitionBy(F.pmod("h", F.lit(64))).orderBy("h")).alias("nth"), F.pmod("h", F.lit(64)).alias("part"))
    first = other.select(F.col("second").alias("first"), "at", "nth", "part")
    pairs = first.join(other.select("second", "part", (F.col("nth") - 1).alias("nth")), ["part", "nth"])
    year, low, high = (1990 + F.col("at") % 45).cast("string"), (F.col("at") % 10).cast("string"), (F.col("at") % 1000).cast("string")
    day = F.concat(year, F.lpad((1 + F.col("at") % 12).cast("string"), 2, "0"), F.lpad((1 + F.col("at") % 28).cast("string"), 2, "0"))
    a, b = F.col("first"), F.col("second")
    made = F.array(
        F.concat(F.initcap(a), F.initcap(b), low), F.concat(a, b, high), F.concat(a, low, b), F.concat(F.upper(a), high), F.concat(F.lower(a), F.initcap(b), year),
        day, F.concat(a, day), F.concat(day, F.lit("T"), high), F.concat(F.lit("v"), low, high), F.concat(a, F.initcap(b)), F.concat(F.initcap(b), F.initcap(a), F.initcap(b), high),
    )
    return pairs.select(F.explode(made).alias("string"))


def samples(docs: DataFrame, text: str = "text") -> DataFrame:
    """Labelled strings: values of known secrets and digests against words and identifiers.

    Taken from about SAMPLE_DOCUMENTS distinct texts, those with the smallest hashes, and SAMPLE strings
    of each class at most. A text is taken or left by its hash, so nothing is sorted, and its copies
    count once.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__h", F.xxhash64("__text"))
    distinct = texts.agg(F.approx_count_distinct("__h")).first()[0]
    share = SAMPLE_DOCUMENTS / max(SAMPLE_DOCUMENTS, distinct)
    some = texts.where(F.pmod("__h", F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("__h").agg(F.first("__text").alias("__text"))
    some = materialize(some.select("__text"))
    scanned = known(some)
    values = F.flatten(F.array(*[F.transform(f"__{k}", lambda x: x["value"]) for k in KINDS[:3]]))
    parts = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(f"[{PART}]{{8,}}"), F.lit(0))))
    secret = scanned.select(F.explode(parts).alias("string")).where("string rlike '[0-9]'")
    digest = lambda *c: F.sha2(F.concat(*c), 256)
    long = F.base64(F.unhex(digest(F.lit("b"), F.col("id").cast("string"))))
    made = spark.range(SAMPLE // 4).select(F.explode(F.array(digest(F.col("id").cast("string")), F.regexp_replace(long, "[/=]", ""))).alias("string"))
    words = some.select(F.explode(F.array_distinct(F.regexp_extract_all("__text", F.lit("[A-Za-z]{3,}"), F.lit(0)))).alias("string")).distinct()
    few = lambda df, n: df.orderBy(F.xxhash64("string"), "string").limit(n)
    words = materialize(few(words, SAMPLE // 2))
    ordinary = words.unionByName(few(_identifiers(words).distinct(), SAMPLE // 2))
    randoms = few(secret.distinct(), SAMPLE // 2).unionByName(made)
    return randoms.withColumn("random", F.lit(True)).unionByName(ordinary.withColumn("random", F.lit(False)))


def known(docs: DataFrame) -> DataFrame:
    """Adds the spans of the known forms in `__text`."""
    docs = _found(docs, "assign", ASSIGN, 1, MIN_VALUE)
    docs = _found(docs, "access", ACCESS)
    return _found(docs, "hex", HEX)


def ratio(string: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string, random against ordinary."""
    table = F.split(F.lit(" ".join(f"{x:.5f}" for x in model)), " ").cast("array<double>")
    at = lambda i: F.position(F.substring(string, i, F.lit(1)), F.lit(SYMBOLS))
    return F.aggregate(F.sequence(F.lit(1), F.length(string)), F.lit(0.0), lambda acc, i: acc + table[F.when(i > 1, at(i - 1)).otherwise(0) * N + at(i)])


def scan(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """All columns of `docs` and `spans`: array of (start, kind number in KINDS, end), sorted.

    Spans of one kind do not overlap; a random string that overlaps a known form is not listed again.
    Null and empty texts have no spans; repeated rows each have theirs; an empty table gives an empty
    table. A column `spans` of the input is replaced.
    """
    out = known(docs.drop("spans").withColumn("__text", F.coalesce(F.col(text), F.lit(""))))
    out = _found(out, "random", CANDIDATE, 0, LEAST)
    base = F.concat("__assign", "__access", "__hex")
    apart = lambda x: ~F.exists("__base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    likely = lambda x: ratio(x["value"], model) >= F.greatest(F.lit(MARGIN), MARGIN_PER_CHARACTER * F.length(x["value"]))
    out = out.withColumn("__base", base)
    out = out.withColumn("__random", F.when(F.size("__random") > 0, F.filter("__random", lambda x: apart(x) & likely(x))).otherwise(F.col("__random")))
    number = lambda n: lambda x: F.struct(x["start"].alias("start"), F.lit(n).alias("kind"), x["end"].alias("end"))
    listed = [F.transform(f"__{k}", number(n)) for n, k in enumerate(KINDS)]
    return out.withColumn("spans", F.sort_array(F.concat(*listed))).drop("__text", "__base", *[f"__{k}" for k in KINDS])


def listing(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def redact(docs: DataFrame, model: list[float], text: str = "text") -> DataFrame:
    """`docs` with every span of its texts replaced by MARK; null texts stay null, repeated rows stay."""
    step = lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(F.struct(
        x["end"].alias("at"),
        F.concat(acc["out"], F.when(x["start"] >= acc["at"], F.concat(F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"]), F.lit(MARK))).otherwise("")).alias("out"),
    ))
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text)))))
    return scan(docs, model, text).withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(F.col(text))).select(*docs.columns)
