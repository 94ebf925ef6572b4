import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import simhash
from shelfmark.llm.components import components


def slow_print(text, k=3):
    import re

    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    at = {n: n for n in nodes}

    def root(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in linked:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    return {n: root(n) for n in nodes}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()}
    prints = {i: slow_print(t) for i, t, _ in rows}
    linked = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = slow_components(sorted(prints), linked)
    assert got == {i: (prints[i], roots[i]) for i in prints}


def test_edges_of_texts(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, "A b c d", "x"), (2, "a B  c\nd", None), (3, None, None), (4, "", None), (5, " \t\n", None), (6, "one", None), (7, "é É two", None), (9, long, None), (8, long, None)]
    check(spark, rows)


def test_near_copies(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(60)}" for _ in range(400)] for _ in range(6)]
    rows = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(words), None))
    check(spark, rows)


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(3)
    at = rng.getrandbits(64)
    prints = {at} | {at ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a, 64) if rng.random() < 0.4} | {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fingerprint long")
    got = {(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()}
    want = {frozenset(p) for p in combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= 2}
    assert {frozenset(p) for p in got} == want and len(got) == len(want) > 1000


def test_every_difference_is_covered():
    for radius in (1, 2, 3):
        cover = simhash.masks(radius)
        assert all(any(all(not m >> i & 1 for i in diff) for m in cover) for diff in combinations(range(20), radius))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(400, x) for x in range(401, 700)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(90)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    want = slow_components(sorted({x for e in edges for x in e}), edges)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: r for n, r in want.items() if n not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d e", 1), (2, "A b c d e", 2), (2, "A b c d e", 2), (None, "z y x w", 3), (5, "q r s t", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, count int")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(kept.collect(), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
    assert simhash.keep_first(df.where("false")).count() == 0
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0
