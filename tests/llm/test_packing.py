import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_those_of_the_library(name, blanks):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", " \n", "a", "É", "'s", "12", "!?", "\t", " ", "　", "é", "́", "ß", "İ", "ΑΣ", "​", "\x1c", "\x85", "\x00", "日本", "<|endoftext|>", "<|endof", "\U0001f600", "don't", "I'LL", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(4000)]
    texts += ["".join(rng.choice(["word", "Été", "ñ", " ", " ", ",", ".", "\n", "7", "×"]) for _ in range(rng.randrange(12))) for _ in range(4000)]
    texts += ["".join(chr(rng.randrange(65, 0x250)) for _ in range(rng.randrange(1, 9))) + rng.choice(["", " word", ", x"]) for _ in range(6000)]
    texts += [f"{a}a{b}B{c}" for a, b, c in ((chr(x), chr(x + 1), chr(x + 7)) for x in range(0xC0, 0x250))]
    encoder = tokens.Encoder(public_tokenizers.path(name), blanks)
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts[:100]) + encoder.encode(texts[100:]) == want


def check(spark, rows, capacity):
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack(df, PATH, capacity=capacity).collect()
    ids = [[*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 0] for _, t, _ in rows]
    want = sorted((str(r[0]), k, s, n, zlib.crc32(np.array(i[s : s + n], "<u4").tobytes())) for r, i in zip(rows, ids) for k, (s, n) in enumerate(packing.cut(len(i), capacity)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= capacity
    return len(sequences), sum(map(len, ids))


def test_pieces_and_places(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "of", "été", "x1"]) for _ in range(rng.randrange(90))), None) for i in range(400)]
    rows += [(None, None, "x"), (7, "", None), (8, "same", None), (8, "same", None), (9, "word " * 30_000, None)]
    made, total = check(spark, rows, 64)
    assert made <= 1.05 * total / 64 + 3


def test_several_groups_and_an_empty_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    check(spark, [(i % 3, "a b c d " * (i % 9), None) for i in range(90)], 32)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_only_the_first_piece_is_shorter():
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)] and packing.cut(1, 2048) == [(0, 1)]


def test_places_minimise_the_sum_of_squares():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 17, 300)
    sequence, offset = packing.sum_of_squares(lengths, 16)
    gaps: dict[int, int] = {}
    for s, q, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        assert o == 16 - gaps.get(q, 16)
        count = lambda g: sum(v == g for v in gaps.values())
        total = lambda state: sum(n * n for g, n in ((g, sum(v == g for v in state.values())) for g in range(1, 16)))
        options = [{**gaps, "new": 16 - s}, *({**gaps, k: v - s} for k, v in gaps.items() if v >= s)]
        gaps[q] = gaps.get(q, 16) - s
        assert total(gaps) == min(map(total, options)) and count(16) == 0


def test_worker_holds_few_texts_and_pieces(monkeypatch):
    import pyarrow as pa

    texts = pa.array([None if i % 7 == 0 else "x" * (i % 50) for i in range(1801)])
    parts = list(packing.parts_of(texts.fill_null("")))
    assert max(map(len, parts)) <= packing.TEXTS and sum(parts, []) == texts.fill_null("").to_pylist()
    small = tokens.Encoder(PATH, True, 50)
    lines = [" ".join(f"word{i + j}" for j in range(30)) for i in range(0, 600, 30)]
    assert [ids for t in lines for ids in small.encode([t])] == tokens.Encoder(PATH, True).encode(lines)
    assert small.table.used <= 50 + 30 and packing.CACHE < tokens.CACHE
