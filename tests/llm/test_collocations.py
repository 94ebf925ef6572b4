import random
import re
from collections import Counter

import numpy as np
import pytest

from shelfmark.llm import collocations, hat_trie
from shelfmark.llm.hat_trie import HatTrie, packed


def slow(rows, least, top, cover):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, 5):
                counts.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    out = []
    for lang in totals:
        found = {p: a for (x, p), a in counts.items() if x == lang and len(p) > 1 and a >= least}
        inside = {}
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(a, inside.get(p[i : i + m], 0))
        rows = []
        for p, a in found.items():
            if 100 * inside.get(p, 0) >= cover * a and p in inside:
                continue
            cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def check(spark, rows, least=3, top=40, cover=80, files=3):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n long, phrase string").repartition(files)
    got = collocations.collocations(docs, least, top, cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == slow(rows, least, top, cover)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Ä", "ä", "ß", "\x00", "\x1f", "a b", "W1", "日本"]
    fixed = ["w1 w2 w3 w4", "w5 W6", "Ä ß ä", "w7\tw8  w9"]
    texts = []
    for _ in range(n):
        parts = [r.choice(fixed) if r.random() < 0.4 else r.choice(words) for _ in range(r.randrange(25))]
        texts.append("".join(p + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", ";!"]) for p in parts))
    return [(i, t, r.choice(["en", "de", None, "und"])) for i, t in enumerate(texts)]


def test_by_brute_force(spark):
    rows = corpus(0) + [(500, None, "en"), (501, "", None), (502, " . ,", "fr"), (503, "one two", "fr"), (0, corpus(0)[0][1], "en")]
    check(spark, rows)
    check(spark, rows, least=1, top=5, cover=100)
    check(spark, [])


@pytest.mark.parametrize("seed", range(3))
def test_bursts_spills_portions_and_a_full_filter(spark, monkeypatch, seed):
    """The smallest containers, portions and vocabularies, and a filter that lets nearly all through, change nothing."""
    r = random.Random(seed)
    monkeypatch.setattr(hat_trie, "BURST", r.choice([1, 2, 5]))
    monkeypatch.setattr(hat_trie, "ENTRIES", r.choice([2, 20, 200]))
    monkeypatch.setattr(collocations, "CHUNK", r.choice([5, 40, 1000]))
    monkeypatch.setattr(collocations, "VOCABULARY", r.choice([3, 8, 1000]))
    monkeypatch.setattr(collocations, "FILTER", 2)
    monkeypatch.setattr(collocations, "ROWS", r.choice([1, 7]))
    run_here(corpus(seed, 60), monkeypatch, spark)


def run_here(rows, monkeypatch, spark):
    """Counting happens in this process, where the patched numbers hold."""
    import pyarrow as pa

    class Bits:
        value = np.full(2, 2**64 - 1, np.uint64)

    texts = [(lang or "und", (t or "").encode()) for _, t, lang in rows]
    batches = [pa.RecordBatch.from_arrays([pa.array([x for x, _ in part]), pa.array([y for _, y in part], pa.binary())], names=["lang", "text"]) for part in (texts[:25], texts[25:])]
    for lengths, frequent in (((1, 2), None), ((3, 4), Bits), ((1, 2, 3, 4), None)):
        found = Counter()
        for b in collocations._counted(lengths, frequent)(iter(batches)):
            for lang, phrase, n in zip(*(b.column(i).to_pylist() for i in (0, 2, 3))):
                found[lang, phrase] += n
        want = Counter()
        for lang, t in texts:
            low = t.decode().translate({c: c + 32 for c in range(65, 91)})
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
                w = re.findall("[^ \t]+", piece)
                for m in lengths:
                    want.update((lang, " ".join(w[i : i + m])) for i in range(len(w) - m + 1))
        assert found == want


def test_very_long_text_and_one_hot_pair(spark):
    r = random.Random(9)
    long = " ".join(r.choice(["hot pair", "w1", "w2", "w3", "x" * 50]) for _ in range(300_000))
    check(spark, [(1, long, "en"), (2, "x" * 3_000_000, "en"), (3, "hot pair " * 1000, None)], least=30)


def test_pair_hash_equals_that_of_columns(spark):
    from pyspark.sql import functions as F

    got = spark.sql("select 'en' l, 'ä' a, 'w1' b").select(collocations._pair_hash_column(F.col("l"), F.col("a"), F.col("b"))).first()[0]
    hashes = np.array([collocations.xxhash.xxh64_intdigest(w, 42) for w in ("ä", "w1")], np.uint64)
    assert collocations._pair_hash("en", hashes, np.array([0]), np.array([1])).view(np.int64)[0] == got


def test_trie_keeps_counts_through_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(hat_trie, "BURST", 3)
    r = np.random.default_rng(1)
    trie, want, got = HatTrie(), Counter(), Counter()

    def taken(keep):
        for _, first, rest, counts in trie.spill(keep):
            for ids, n in zip(zip(*(i.tolist() for i in hat_trie.unpacked(first, rest))), counts.tolist()):
                got[tuple(i for i in ids if i)] += n

    for n in range(50):
        ids = [r.integers(1, 6, 40) for _ in range(1 + n % 4)]
        trie.add("en", ids[0], packed(ids))
        want.update(zip(*(c.tolist() for c in ids)))
        assert trie.entries == sum(hat_trie._size(b) for b in trie.groups["en"].values())
        if n == 40:
            boxes = trie.groups["en"].values()
            assert any(type(b) is hat_trie.Node and any(type(x) is hat_trie.Node for x in b.values()) for b in boxes)
        if n % 10 == 9:
            taken(150)
            assert trie.entries <= 150
    taken(-1)
    assert got == want and trie.entries == 0 and not any(trie.groups.values())
