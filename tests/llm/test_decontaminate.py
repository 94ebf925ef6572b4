import random
import re

import pytest

from shelfmark.llm import decontaminate


def slow(docs, bench, window=13):
    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)

    wins = set()
    for i, t in bench:
        w = words(t)
        m = min(window, len(w))
        wins |= {(tuple(w[k : k + m]), str(i)) for k in range(len(w) - m + 1) if m}
    out = []
    for d, t in docs:
        w, hit, items = words(t), set(), set()
        for s, i in wins:
            for k in range(len(w) - len(s) + 1):
                if tuple(w[k : k + len(s)]) == s:
                    hit |= set(range(k, k + len(s)))
                    items.add(i)
        out.append((d, len(w), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def spark_rows(spark, docs, bench, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.scan(d, b, keep=["doc_id"], **kw).collect()
    assert all(sum(e - s for s, e in zip(r.spans[::2], r.spans[1::2])) == r.n_hit for r in got)
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 300])
def test_like_brute_force(spark, pass_bytes):
    rng = random.Random(pass_bytes)
    vocabulary = ["the", "of", "And", "été", "x1", "ß", "a"]
    text = lambda n: rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, text(rng.choice([0, 1, 2, 5, 12, 13, 14, 30, 60]) if i else 3)) for i in range(14)] + [(2, "one two"), (2, "one two"), (99, None), (7, "  "), (8, "Ünder sun")]
    docs = [(i, text(rng.randrange(80)) + " " + (rng.choice(bench)[1] or "") + " " + text(rng.randrange(60))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "ONE, two!"), (103, "one"), (103, "one"), (None, "ünder sun Ünder.SUN")]
    assert spark_rows(spark, docs, bench, pass_bytes=pass_bytes) == slow(docs, bench)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "kept", 5)], "doc_id long, text string, source string, items int")
    bench = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.scan(docs, bench).first()
    assert (row.source, row.n_words, row.n_hit, row["items"], row.contaminated) == ("kept", 3, 0, [], False)
    assert decontaminate.scan(docs.where("false"), bench).count() == 0


def test_very_long_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "filler words here " * 100_000 + item)]
    assert spark_rows(spark, docs, [(5, item)]) == [(1, 300_020, 20, ["5"], False)]
