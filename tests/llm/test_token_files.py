import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import range_coder as rc
from shelfmark.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 9999, 70_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 500, n), rng.zipf(1.3, n) % 500, np.full(n, 499), np.arange(n) % 7):
        words, counts = rc.encode(ids, 500)
        assert (rc.decode(words, counts, n, 500) == ids).all()


def test_frequencies_are_halved(monkeypatch):
    monkeypatch.setattr(rc, "LIMIT", 3000)
    ids = np.random.default_rng(0).integers(0, 40, 20_000)
    assert (rc.decode(*rc.encode(ids, 40), len(ids), 40) == ids).all()


def test_repetition_is_learned_and_blocks_are_independent(monkeypatch):
    monkeypatch.setattr(rc, "LANES", 64)
    ids = np.tile(np.random.default_rng(0).integers(0, 5000, 400), 200).astype(np.uint32)
    a, b = rc.pack_block(ids, b"index", 5000), rc.pack_block(ids, b"index", 5000)
    assert a == b and len(a) < 0.25 * 2 * len(ids)
    got, index = rc.unpack_block(a)
    assert (got == ids).all() and index == b"index"


def test_damage_is_found():
    block = rc.pack_block(np.arange(300, dtype=np.uint32), b"", 500)
    for at in (0, 5, 40, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError, match="damaged"):
            rc.unpack_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1 :])


def test_files_like_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 300)
    rng = random.Random(1)
    rows = [(rng.randrange(10_000), " ".join(rng.choice(["the", "Été", "x1", "of\n"]) for _ in range(rng.randrange(120))), "x") for _ in range(200)]
    rows = list({r[0]: r for r in rows}.values()) + [(20_000, "long " * 5000, None), (20_001, None, None), (20_002, "", None), (20_002, "", None), (None, "null id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string")
    token_files.write(df.repartition(5), str(tmp_path / "a"), PATH, 49_408, 1)
    got = token_files.read(spark, str(tmp_path / "a"), with_ids=True).collect()
    library, start, want = Tokenizer.from_file(PATH), 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert spark.read.parquet(str(tmp_path / "a")).count() > 20


def test_empty(spark, tmp_path):
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "a"), PATH, 49_408, 1)
    assert token_files.read(spark, str(tmp_path / "a")).count() == 0
