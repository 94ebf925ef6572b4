from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import language_id as li
from shelfmark.llm.queries import QUERIES


def slow_word(word, words, grams, languages):
    """Score of one word from plain counters."""
    logs = lambda c, item, same: np.array([np.log((c[x][item] + li.SMOOTH) / sum(c[x][i] + li.SMOOTH for i in same)) for x in languages])
    known = {w for x in languages for w in words[x]}
    if word in known:
        v = logs(words, word, known)
        return v - v.mean()
    every = {g for x in languages for g in grams[x]}
    padded, score, i = f" {word} ", np.zeros(len(languages)), 0
    while i < len(padded):
        n = next((n for n in range(min(li.MAX_N, len(padded) - i), 0, -1) if padded[i : i + n] in every), 0)
        if n:
            g = padded[i : i + n]
            v = logs(grams, g, {e for e in every if len(e) == n})
            score += li.BACKOFF * (v - v.mean())
        i += n or 1
    return score


def test_scores_like_brute_force(spark):
    texts = [("en", "the house and the tree, the end"), ("de", "das Haus und der Baum und das Ende"), ("en", "The house the END"), ("de", "und das Haus"), (None, "le le"), ("fr", None)]
    found = li.train(spark.createDataFrame(texts, "lang string, text string"))
    languages = ["de", "en"]
    words = {x: Counter(w for l, t in texts if l == x for w in li._WORD.findall(t.lower())) for x in languages}
    grams = {x: Counter() for x in languages}
    for x in languages:
        for w, n in words[x].items():
            for g in li.grams(w):
                grams[x][g] += n
    words, grams = ({x: Counter({k: v for k, v in c[x].items() if v >= li.SEEN}) for x in languages} for c in (words, grams))
    model = li.Model(found)
    assert model.languages == languages
    for word in ["the", "house", "houses", "baumhaus", "zzz", "é", "undthe"]:
        at = model.row.get(word)
        at = model.learn(word) if at is None else at
        got = model.table[at]
        assert np.allclose(got, slow_word(word, words, grams, languages)), word
    rows = [(1, "The houses"), (2, "Das Baumhaus und"), (3, None), (4, ""), (5, "123 ²!"), (6, "the " * 200_000), (6, "the " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score")
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(df, found).collect()}
    assert [got[i][0] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"] and all(0 <= s <= 1 for _, s in got.values())
    assert li.predict(df.where("false"), found).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    found = li.train(li.sample(df))
    assert li.predict(df, found).first().lang_pred == "und"


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_DOCUMENTS", 200)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("lang"))
    n = {r.lang: r["count"] for r in li.sample(df).groupBy("lang").count().collect()}
    assert 120 < n["de"] < 280 and 120 < n["en"] < 280
    assert li.sample(df).join(df, ["text", "lang"]).count() == sum(n.values())


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test data")
    got = QUERIES["op4_language_id"](spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, every = got.where("lang = lang_pred").count(), got.count()
    assert every > 30 and right >= 0.95 * every


def test_long_texts_leave_a_small_language_its_documents(spark):
    long = spark.range(400).selectExpr("id AS doc_id", "repeat('long words ', 9000) AS text", "'a' AS lang")
    few = spark.range(1000, 1020).selectExpr("id AS doc_id", "concat('kurze worte ', id) AS text", "'b' AS lang")
    taken = {r.lang: (r.n, r.chars) for r in li.sample(long.unionByName(few)).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    assert taken["b"][0] == 20
    assert 0.5 * li.SAMPLE_CHARS < taken["a"][1] < 1.5 * li.SAMPLE_CHARS
