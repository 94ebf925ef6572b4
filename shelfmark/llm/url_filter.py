"""URL verdicts: rules on host and path, and for all other URLs gradient-boosted trees.

The trees see lexical features only. They learn from distinct labelled URLs, by default those that a
rule decides. Suffix statistics come from the same URLs, but each URL the trees are fitted on sees
those of the other folds, so its own label is not in its features. A suffix without labelled URLs gets
the share of all of them.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Distinct labelled URLs of each class, about, that the trees are fitted on, those with the smallest
#: hashes, weighted so that both classes keep their part; all distinct ones count for the suffixes.
SAMPLE = 25_000
#: Parts of the labelled URLs whose suffix statistics are taken from the other parts.
FOLDS = 5
#: Most frequent suffixes, whose shares are broadcast; those of all others are joined.
SUFFIXES = 200_000
TREES, DEPTH = 10, 4
#: Pseudo-counts that draw the share of a rare suffix towards the share of all.
PRIOR = 10.0
FEATURES = ("length", "host_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "secure", "fragment", "suffix", "domain", "section")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds `host` (A-Z lower-cased) and `path`; both empty without `://` or for a null URL."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.regexp_extract(F.col(url), "(?s)^.*?://(.*)$", 1)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*(/[^?#]*)", 1)
    return urls.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def with_rule(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds `rule` and `rule_verdict` of the longest of the (verdict, host/path) rules that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, pattern in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = pattern.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return urls.withColumns({"rule": rule, "rule_verdict": verdict})


def _entropy(text: Column) -> Column:
    """Bits per character of the characters' frequencies, from runs of equal characters in sorted order."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = lambda s: F.size(s)
    starts = lambda s: F.filter(F.sequence(F.lit(0), n(s) - 1), lambda i: (i == 0) | (s[i] != F.get(s, i - 1)))
    parts = lambda s: F.transform(F.array(starts(s)), lambda at: F.transform(at, lambda p, j: (F.coalesce(F.get(at, j + 1), n(s)) - p) / n(s)))[0]
    # `transform` over a one-element array names the sorted characters, so that they are made once.
    bits = F.transform(F.array(chars), lambda s: F.when(n(s) > 0, F.aggregate(parts(s), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(0.0))
    return bits[0]


def with_features(urls: DataFrame, shares: DataFrame, url: str = "url", fold: Column | None = None) -> DataFrame:
    """Adds `__<feature>` columns; `shares` as of `suffix_shares`, of which a row sees those of its fold."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, "(?s)\\?([^#]*)", 1)
    count = lambda s, pattern: F.regexp_count(s, F.lit(pattern)).cast("double")
    out = urls.withColumns(
        {
            "__length": F.length(text).cast("double"),
            "__host_length": F.length("host").cast("double"),
            "__labels": count(F.col("host"), "[^.]+"),
            "__depth": count(F.col("path"), "/[^/]+"),
            "__digits": count(text, "[0-9]") / F.greatest(F.length(text), F.lit(1)),
            "__entropy": _entropy(F.concat("host", "path")),
            "__parameters": count(query, "[^&]+"),
            "__hyphens": count(F.col("host"), "-"),
            "__secure": text.startswith("https://").cast("double"),
            "__fragment": text.contains("#").cast("double"),
            "__top": F.substring_index("host", ".", -1),
            "__two": F.substring_index("host", ".", -2),
            "__first": _section(F.col("path")),
        }
    )
    out = out.withColumn("__fold", F.lit(-1) if fold is None else fold)
    # The row without suffix holds the share of all labelled URLs.
    base = F.broadcast(shares.where("suffix is null").select(F.col("fold").alias("__fold"), F.col("share").alias("__base")))
    known = shares.where("suffix is not null")
    many = not known.where("rare").isEmpty()
    out = out.join(base, "__fold", "left")
    for c in ("__top", "__two", "__first"):
        out = _with_share(out, known, c, url, many)
    suffix = F.coalesce("__top_share", "__base", F.lit(0.5))
    shares_of = {"__suffix": suffix, "__domain": F.coalesce("__two_share", suffix), "__section": F.coalesce("__first_share", "__base", F.lit(0.5))}
    return out.withColumns(shares_of).drop("__top", "__two", "__first", "__top_share", "__two_share", "__first_share", "__base", "__fold")


def _with_share(urls: DataFrame, known: DataFrame, column: str, url: str, many: bool) -> DataFrame:
    """Adds `<column>_share`: of frequent suffixes from the broadcast ones, of rare ones by a join."""
    named = lambda rows, c, share: rows.select(F.col("fold").alias("__fold"), F.col("suffix").alias(c), F.col("share").alias(share))
    share = f"{column}_share"
    out = urls.join(F.broadcast(named(known.where("not rare"), column, share)), ["__fold", column], "left")
    if not many:
        return out
    # URLs whose share is found get a key that matches nothing and spreads them.
    key = F.when(F.col(share).isNull(), F.col(column)).otherwise(F.concat(F.lit("://"), F.coalesce(F.col(url), F.lit(""))))
    out = out.withColumn("__key", key).join(named(known.where("rare"), "__key", "__rare").hint("merge"), ["__fold", "__key"], "left")
    return out.withColumn(share, F.coalesce(share, "__rare")).drop("__key", "__rare")


def _section(path: Column) -> Column:
    """First part of a path with its slash, which no suffix of a host has."""
    return F.regexp_extract(path, "(?s)^(/[^/]*)", 1)


def _fold(url: str) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def distinct_labels(labelled: DataFrame, url: str = "url") -> DataFrame:
    """Each labelled URL once, with host, path and `blocked`: 1 if any of its rows says so."""
    return labelled.where(F.col(url).isNotNull()).groupBy(url, "host", "path").agg(F.max("blocked").alias("blocked"))


def suffix_shares(labelled: DataFrame, url: str = "url") -> DataFrame:
    """(fold, suffix, share, rare): smoothed block shares of the last and the last two labels of hosts, and of
    the first parts of paths.

    Fold -1 is of all distinct labelled URLs, the others are of all but those of the fold. The share of
    a suffix is drawn towards that of all URLs, which is the row whose suffix is null. `rare` says
    that a suffix is none of the SUFFIXES most frequent ones, which alone are small enough to broadcast.
    """
    keys = F.array_distinct(F.array(F.lit(None).cast("string"), F.substring_index("host", ".", -1), F.substring_index("host", ".", -2), _section(F.col("path"))))
    counts = labelled.select(F.explode(keys).alias("suffix"), _fold(url).alias("fold"), "blocked").groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("blocked").alias("bad"))
    counts = materialize(counts)
    totals = counts.groupBy("suffix").agg(F.sum("n").alias("n_all"), F.sum("bad").alias("bad_all"))
    totals = materialize(totals)
    often = totals.where("suffix is not null").orderBy(F.col("n_all").desc(), "suffix").limit(SUFFIXES).select("suffix", F.lit(False).alias("often"))
    totals = materialize(totals.join(often, "suffix", "left").withColumn("rare", F.coalesce("often", F.col("suffix").isNotNull())).drop("often"))
    folds = totals.select("*", F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))).alias("fold"))
    own = counts.withColumnRenamed("suffix", "s").withColumnRenamed("fold", "f")
    rest = folds.join(own, (F.col("f") == F.col("fold")) & F.col("s").eqNullSafe(F.col("suffix")), "left")
    rest = rest.select("suffix", "fold", "rare", (F.col("n_all") - F.coalesce("n", F.lit(0))).alias("n"), (F.col("bad_all") - F.coalesce("bad", F.lit(0.0))).alias("bad"))
    prior = rest.where("suffix is null").select("fold", ((F.col("bad") + 1) / (F.col("n") + 2)).alias("prior"))
    smoothed = F.when(F.col("suffix").isNull(), F.col("prior")).otherwise((F.col("bad") + PRIOR * F.col("prior")) / (F.col("n") + PRIOR))
    return materialize(rest.join(F.broadcast(prior), "fold").select("fold", "suffix", smoothed.alias("share"), "rare"))


def train(labelled: DataFrame, shares: DataFrame, url: str = "url") -> GBTClassificationModel | None:
    """Trees fitted on distinct rows with a URL, host, path and `blocked` (0 or 1); None without both classes."""
    sizes = {r.blocked: r["count"] for r in labelled.groupBy("blocked").count().collect()}
    if len(sizes) < 2:
        return None
    taken, weight = F.lit(False), F.lit(1.0)
    for blocked, n in sizes.items():
        share = min(1.0, SAMPLE / n)
        own = F.col("blocked") == blocked
        taken = taken | (own & (F.pmod(F.xxhash64(url), F.lit(1 << 30)) < int(share * (1 << 30))))
        weight = F.when(own, 1 / share).otherwise(weight)
    some = labelled.where(taken).withColumn("__weight", weight)
    ready = VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="__vector").transform(with_features(some, shares, url, _fold(url)))
    trees = GBTClassifier(featuresCol="__vector", labelCol="blocked", predictionCol="__block", weightCol="__weight", maxIter=TREES, maxDepth=DEPTH, seed=1)
    return trees.setRawPredictionCol("__raw").setProbabilityCol("__probability").fit(ready.select("__vector", "blocked", "__weight"))


def judge(urls: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """All columns of `urls` with host, path, rule and verdict (allow or block).

    `labelled` holds URLs and `blocked`; by default the URLs of `urls` that a rule decides are it. A
    rule's verdict stands; all other URLs, null ones included, get that of the trees, or "allow" where
    the labelled rows have no two classes. Repeated URLs count once as labels, blocked if any of their
    rows is. A long URL costs time in proportion to its length. Columns of the same names are replaced.
    """
    ruled = with_rule(with_parts(urls, url), rules)
    if labelled is None:
        labelled = ruled.where("rule is not null").select(url, "host", "path", (F.col("rule_verdict") == "block").cast("double").alias("blocked"))
    else:
        labelled = with_parts(labelled, url).select(url, "host", "path", F.col("blocked").cast("double").alias("blocked"))
    labelled = materialize(distinct_labels(labelled, url))
    shares = suffix_shares(labelled, url)
    model = train(labelled, shares, url)
    if model is None:
        return ruled.withColumn("verdict", F.coalesce("rule_verdict", F.lit("allow"))).drop("rule_verdict")
    ready = VectorAssembler(inputCols=[f"__{f}" for f in FEATURES], outputCol="__vector").transform(with_features(ruled, shares, url))
    found = model.transform(ready)
    verdict = F.coalesce("rule_verdict", F.when(F.col("__block") > 0.5, "block").otherwise("allow"))
    return found.withColumn("verdict", verdict).drop("rule_verdict", "__vector", "__raw", "__probability", "__block", *[f"__{f}" for f in FEATURES])
