import math
import random
import re

from pyspark.sql import functions as F

from shelfmark.llm import quality_rules as q


def slow(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words))


def test_counts_like_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["a", "bb", "É", "c#", "|", "\U0001f600x", " ", "d\x00"]
    texts = [None, "", " \t\n", "one", "\n\na b\n a b\na b\n", "x " * 7, "x " * 8, "x " * 9, "a\x0bb\x0cc\rd"]
    texts += ["".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(60))) for _ in range(120)]
    texts += [t + " " + t for t in texts[20:60]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.measure(df).collect()}
    assert got == {i: slow(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    cases = [(0, 10), (3, 400), (9, 1000), (40, 5000), (450, 50_000)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", q.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert math.isclose(r.p, want, rel_tol=1e-8)


def documents(spark):
    """Good prose, symbols in bad texts, and a stratum with too few labels."""
    prose = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), (F.hash(x, i) % 500).cast("string"))), " ")
    df = spark.range(6000).withColumn("quality", F.when(F.col("id") % 5 == 0, 0).otherwise(1))
    text = F.when(F.col("quality") == 0, F.regexp_replace(prose(F.col("id")), " ", "### ")).otherwise(prose(F.col("id")))
    return df.select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 100 == 1, "rare").otherwise("en").alias("lang"), "quality", F.lit(7).alias("n_words"))


def test_cutoffs_reject_bad_and_keep_good(spark):
    docs = documents(spark)
    measured = q.measure(docs.drop("quality")).cache()
    cutoffs = q.fit(measured, docs.select("doc_id", "quality"))
    got = q.judge(measured, cutoffs).join(docs.select("doc_id", "quality"), "doc_id")
    rows = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert rows[0, False] == 1200 and rows.get((1, False), 0) <= 0.05 * 4800
    assert [r.stratum for r in cutoffs.collect()] == ["en"]


def test_few_or_no_labels_reject_nothing(spark):
    docs = documents(spark).limit(50)
    measured = q.measure(docs.drop("quality"))
    for labels in (docs.select("doc_id", "quality"), docs.select("doc_id", "quality").where("false"), docs.select("doc_id", F.lit(None).cast("int").alias("quality"))):
        cutoffs = q.fit(measured, labels)
        assert cutoffs.count() == 0 and q.judge(measured, cutoffs).where("kept").count() == 50
    assert q.judge(q.measure(docs.where("false")), cutoffs).count() == 0
