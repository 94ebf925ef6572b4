"""Quality rules with risk-controlled cutoffs.

Each rule is a number per document, larger meaning worse. Half of the labelled documents proposes
cutoffs; the held-out half decides which of them may be used: the number of good documents that a
cutoff rejects there has to be so small that a true rejection rate above the allowed one is ruled
out by the exact binomial distribution, at a level divided by the number of all tests made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

BLANK = "[\\x20\\x09-\\x0D]+"
RULES = ("symbols", "repeats", "lines", "capitals", "length")
#: Share of the good documents of a stratum that all rules together may reject, and the chance of error.
RISK = 0.05
DELTA = 0.05
CUTOFFS = 12
#: How many wrongly rejected good documents outweigh a rightly rejected bad one when a cutoff is chosen.
COST = 10.0
MIN_WORDS = 20
MIN_GAIN = 0.02
WINDOW = 8


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs`, the counts of every whole text and the value of every rule.

    Null, empty and blank texts have no words and fail the base rules. Columns of the same names in
    the input are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.size("__words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW))))
    pairs = F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, j: F.coalesce(F.get("__pairs", j)["h"] == x["h"], F.lit(False))
    twice = F.array_sort(F.transform(F.filter("__pairs", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        "__twice",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    left = lambda pattern: (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))).cast("long")
    words = F.greatest(F.col("n_words"), F.lit(1))
    return (
        docs.withColumn("__words", F.array_remove(F.split(body, BLANK), ""))
        .withColumn("__lines", F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
        .withColumn("__windows", windows)
        .withColumn("__pairs", pairs)
        .withColumn("__twice", twice)
        .withColumns(
            {
                "n_words": n.cast("long"),
                "word_chars": F.length(F.array_join("__words", "")).cast("long"),
                "n_symbols": left("[#*$%&|<>]"),
                "n_capitals": left("\\p{Lu}"),
                "n_lines": F.size("__lines").cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            }
        )
        .drop("__words", "__lines", "__windows", "__pairs", "__twice")
        .withColumns(
            {
                "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
                "symbols": F.col("n_symbols") / words,
                "repeats": F.col("n_repeat_words") / words,
                "lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
                "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
                "length": F.col("word_chars") / words,
            }
        )
    )


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1, by Stirling's series at x + 7."""
    y = x + 7
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    product = x
    for i in range(1, 7):
        product = product * (x + i)
    return series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), for k < n p. Terms below e^-70 of the largest are left out."""
    size = n.cast("double")
    low = F.greatest(F.lit(0), F.floor(k - 50 - 12 * F.sqrt(size * p * (1 - p)))).cast("long")

    def term(i: Column) -> Column:
        x = i.cast("double")
        return F.exp(_log_gamma(size + 1) - _log_gamma(x + 1) - _log_gamma(size - x + 1) + x * math.log(p) + (size - x) * math.log1p(-p))

    return F.aggregate(F.sequence(low, k), F.lit(0.0), lambda acc, i: acc + term(i))


def fit(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", quality: str = "quality") -> DataFrame:
    """One row per stratum: the cutoff of every rule, null where none is certified.

    `labels` has an id and a quality of 1 (good) or 0 (bad); of several labels of an id the largest
    counts, null ids and labels none. Documents that fail the base rules take no part. Without
    labels there are no cutoffs and nothing is rejected.
    """
    known = labels.where(F.col(quality).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.max(quality) > 0).alias("__good"))
    rows = measured.where("not base_failed").join(known, F.col(id_col) == F.col("__id")).select(
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        (F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0).alias("held_out"),
        "__good",
        F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "value"),
    )
    levels = [i / CUTOFFS for i in range(CUTOFFS)]
    tuned = rows.where("not held_out and not __good and value > 0").groupBy("stratum", "rule").agg(F.percentile_approx("value", levels, 1000).alias("cutoffs"))
    over = lambda i, good: F.count(F.when((F.col("value") >= F.col("cutoffs")[i]) & (F.col("__good") == good), 1))
    counts = rows.where("held_out").join(tuned, ["stratum", "rule"]).groupBy("stratum", "rule", "cutoffs").agg(
        F.count(F.when(F.col("__good"), 1)).alias("n_good"),
        F.count(F.when(~F.col("__good"), 1)).alias("n_bad"),
        F.array(*[F.struct(F.col("cutoffs")[i].alias("cutoff"), over(i, True).alias("good"), over(i, False).alias("bad")) for i in range(CUTOFFS)]).alias("tried"),
    )
    share = risk / len(RULES)
    tests = max(1, counts.select("stratum").distinct().count()) * len(RULES) * CUTOFFS
    tried = counts.select("stratum", "rule", "n_good", "n_bad", F.explode("tried").alias("t")).select("stratum", "rule", "n_good", "n_bad", "t.*")
    certified = tried.where(F.col("good") < share * F.col("n_good")).where(binomial_tail(F.col("good"), F.col("n_good"), share) <= delta / tests)
    gain = F.col("bad") / F.greatest(F.col("n_bad"), F.lit(1)) - COST * F.col("good") / F.col("n_good")
    best = certified.withColumn("gain", gain).where(F.col("gain") > MIN_GAIN).groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """`measured` and `kept`: false where the base rules fail or a rule reaches the cutoff of its stratum.

    A stratum without cutoffs, as one that has too few labels, is judged by the base rules alone.
    """
    limits = cutoffs.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__cut_{r}") for r in RULES])
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(F.col(r) >= F.col(f"__cut_{r}"), F.lit(False))
    # Only strata with a certified cutoff have a row, and none is certified on less than some 900 labels.
    joined = measured.join(F.broadcast(limits), F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("__stratum"), "left")
    return joined.withColumn("kept", ~(F.col("base_failed") | rejected)).drop("__stratum", *[f"__cut_{r}" for r in RULES])


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with their own columns.

    Texts are measured once: the measures are written with them, and only the measures are read to
    fit the cutoffs.
    """
    own = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col).alias("__key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("__group"), F.col(text).alias("__body"))
    measured = materialize(measure(own, "__body").select("__row", "__key", "__group", "base_failed", *RULES))
    cutoffs = fit(measured, labels.withColumnRenamed(id_col, "__key"), "__group", id_col="__key")
    return judge(measured, cutoffs, "__group").where("kept").select("__row.*")
