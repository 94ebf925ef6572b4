import random
import re
from itertools import permutations

import pytest

from shelfmark.llm import filter_audit
from shelfmark.llm.radix_trie import RadixTrie

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def slow(rows, labels):
    """Every order applied to every row, by the words of the contract."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    seen = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }
        seen.append((i, lang or "", {k for k, v in fails.items() if v}))
    out = {}
    for part in {p for _, p, _ in seen}:
        mine = [(i, f) for i, p, f in seen if p == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                before = set(order[: step - 1])
                left = [(i, f) for i, f in left if name not in f]
                share[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(1 for _, f in mine if name in f and f & before),
                    sum(1 for _, f in mine if f == {name}),
                    sum(1 for i, _ in gone if i in good),
                    sum(1 for i, _ in gone if i in toxic),
                ]
        for key in out:
            if key[0] == part:
                out[key].append(share[key[1][key[2] - 1]])
    return out


def check(spark, rows, labels, files=3):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, lang string, mask string, rows long, part string").repartition(files)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks)
    assert sorted(got.columns) == sorted(COLUMNS)
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS[3:]] for r in got.collect()}
    assert found == slow(rows, labels)


def texts():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    plain = [" ".join(r.choices(words, k=n)) for n in (1, 5, 199, 200, 260, 900)]
    head = "license " * 80
    made = [head + p for p in plain] + [head, head[:-1], "", " \t\n", "A B # c", "Ä É Ö " + plain[4], "ABC" * 90 + plain[3], plain[3] + "|", plain[4].upper()]
    return plain + made


def test_all_orders_by_brute_force(spark):
    r, all_texts = random.Random(1), texts()
    rows = [(i if i % 23 else None, r.choice(all_texts), r.choice(["en", "de", None, "x|y"])) for i in range(160)]
    rows += [(500, None, "en"), (500, None, "en"), (501, None, None), (502, None, "en"), (7, all_texts[0], "de"), (7, all_texts[0], "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 170, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    check(spark, rows, labels)


@pytest.mark.parametrize(("limit", "prefix"), [(1, 1), (700, 2), (3000, 16)])
def test_small_tries_and_growing_prefixes(spark, monkeypatch, limit, prefix):
    """Tries are cut at prefixes, common heads make prefixes grow, and nothing changes."""
    monkeypatch.setattr(filter_audit, "LIMIT", limit)
    monkeypatch.setattr(filter_audit, "PREFIX", prefix)
    monkeypatch.setattr(filter_audit, "STEP", 3)
    monkeypatch.setattr(filter_audit, "RANGES", 3)
    r, all_texts = random.Random(2), texts()
    rows = [(r.randrange(200), r.choice(all_texts), "en") for _ in range(150)]
    check(spark, rows, [], files=5)


def test_very_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    check(spark, [(2, long, "en"), (1, long, "de"), (3, long + " x", "en"), (4, None, None)], [(2, 1, 0)])
    check(spark, [], [])


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(filter_audit, "PART", 7)
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choices("ab \n\t", k=r.randrange(60))).encode()
        assert filter_audit._words(t) == (len(t.split()), len(set(t.split())))


def test_trie_holds_the_least_id_of_each_text():
    r, least = random.Random(4), {}
    trie, ends = RadixTrie(), {}
    for _ in range(4000):
        t, i = bytes(r.choices(b"ab\x00", k=r.randrange(12))), r.randrange(1000)
        least[t] = min(i, least.get(t, i))
        ends.setdefault(t, trie.insert(t, i))
        assert trie.insert(t, i) is ends[t]
    assert {t: n.least for t, n in ends.items()} == least
    assert len({id(n) for n in ends.values()}) == len(ends)
