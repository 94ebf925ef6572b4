import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import substring_dedup as sd
from shelfmark.llm import suffix_sort


def slow(rows, length):
    first: dict[bytes, int] = {}
    bodies = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    for d, b in bodies:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for (i, *_), (d, b) in zip(rows, bodies):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < d:
                gone[s : s + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int))).tolist()
        out.append((str(i), len(b), int(gone.sum()), edges, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def check(spark, rows, length=50, gram=16, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(parts)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.spans, bytes(r.kept)) for r in sd.remove_repeats(df, length, gram).collect())
    assert got == slow(rows, length)
    return sum(r[2] for r in got)


def corpus(rng, n, alphabet, size):
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, size))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(9)))
        rows.append((rng.randrange(10**6) * n + i, text, "x"))
    return rows


@pytest.mark.parametrize(("alphabet", "size", "length", "gram"), [("abcdefgh é", 120, 50, 16), ("ab", 60, 20, 8), ("a", 90, 20, 8), ("abc\U0001f600", 70, 30, 12)])
def test_like_brute_force(spark, alphabet, size, length, gram):
    assert check(spark, corpus(random.Random(size), 70, alphabet, size), length, gram) > 500


def test_crowds_steps_and_small_sorts(spark, monkeypatch):
    rows = corpus(random.Random(8), 60, "abcd", 80)
    monkeypatch.setattr(sd, "SORTED", 7)
    monkeypatch.setattr(sd, "CROWD", 5)
    monkeypatch.setattr(sd, "STEP", 64)
    monkeypatch.setattr(sd, "HOT", 2)
    check(spark, rows, 20, 8)


def test_nulls_repeated_rows_and_long_texts(spark):
    line = "this line of more than fifty bytes stands in many documents, copied word by word. "
    rows = [(1, None, None), (2, "", None), (3, "short", None), (4, line * 3, None), (4, line * 3, None), (4, "z" + line, None), (None, line + "tail", None), (None, "a" * 60, None), (9, "a" * 70, None), (5, "né" * 2000 + line, None), (6, "né" * 1500, None)]
    assert check(spark, rows) > 3000
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mergesort_and_common_beginnings():
    rng = random.Random(1)
    for _ in range(60):
        data = bytes(rng.choice(b"aab") for _ in range(300))
        n = rng.randrange(60)
        at, length, group = (np.array(x, np.int64) for x in ([rng.randrange(250) for _ in range(n)], [rng.randrange(1, 50) for _ in range(n)], sorted(rng.randrange(5) for _ in range(n))))
        hashes = suffix_sort.Hashes(data)
        want = sorted(range(n), key=lambda i: (group[i], data[at[i] : at[i] + length[i]]))
        assert suffix_sort.mergesort(hashes, at, length, group).tolist() == want


def test_equal_hashes_are_not_proof(monkeypatch):
    parts = [bytes([65 + i]) * 60 for i in range(3)]
    monkeypatch.setattr(suffix_sort.Hashes, "of", lambda self, start, end: np.zeros(np.broadcast(start, end).shape, np.uint64))
    hit = sd.covered(np.zeros(3, np.int64), np.arange(3), np.full(3, 20), parts, 50, 16)
    assert not hit.any()


def test_only_the_spans_stay_on_disk(spark):
    """Anchors and crowded keys are removed once the spans are written."""
    from shelfmark import storage

    docs = spark.createDataFrame([(i, f"{i} " + "the same passage again and again, long enough to be found " * 2) for i in range(20)], "doc_id bigint, text string")
    frame = docs.select(F.col("doc_id").alias("doc"), F.lit(0).alias("tag"), F.col("text").cast("binary").alias("text"))
    with storage.tables_removed(spark) as outer:
        found = sd.spans(frame, 50, 16)
        path = spark._jvm.org.apache.hadoop.fs.Path
        left = [p for p in outer if path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))]
        assert len(left) == 1 and found.count() > 0


def test_shuffle_files_are_dropped_while_it_runs(spark):
    """The setting takes hold in a session that never set it, and is put back."""
    before = spark.conf.get(sd._CLEANUP)
    with sd._dropping_shuffles(spark):
        assert spark.conf.get(sd._CLEANUP) == "true"
    assert spark.conf.get(sd._CLEANUP) == before == "false"
