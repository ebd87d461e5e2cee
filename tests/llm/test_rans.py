import struct
import zlib

import numpy as np
import pytest
import public_tokenizers

from sparkloom.llm import rans

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_segments_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 5000, 70_000):
        tokens = np.minimum(rng.geometric(0.01, n), 3000).astype(np.int64)
        table = rans.Table(np.bincount(tokens, minlength=4000))
        data = rans.pack_segment([7, 9], [n // 2, n - n // 2], 5, tokens, table)
        ids, lengths, first, back = rans.unpack_segment(data, table)
        assert (ids.tolist(), lengths.tolist(), first) == ([7, 9], [n // 2, n - n // 2], 5)
        assert (back == tokens).all()
        if n > 5000:
            p = np.bincount(tokens) / n
            entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * n / 8
            assert len(data) < 1.25 * entropy
            bad = bytearray(data)
            bad[-3] ^= 1
            with pytest.raises(ValueError):
                rans.unpack_segment(bytes(bad), table)


def test_files_give_what_the_library_gives(spark):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(PATH)
    odd = [None, "", " ", "\n\n", "Don't  STOP's <|endoftext|> x<|startoftext|>", "é é Σας ΣΑΣ", "a b c\x1cd\t\x0be", "日本語 # 12345 !!!", "x" * 5000, "ab " * 9000]
    rows = [(i, t) for i, t in enumerate(odd)] + [(3, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tool.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((-(1 << 63) if i is None else i, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = rans.packed_documents(df, PATH).orderBy("start").collect()
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted(want)
    assert [r[0] for r in got] == [w[0] for w in want]
    assert [r[1] for r in got] == [sum(r[2] for r in got[:n]) for n in range(len(got))]
    assert rans.packed_documents(df.limit(0), PATH).collect() == []


def test_what_a_worker_holds_does_not_follow_its_batch():
    """Hashing and encoding take a text apart in small pieces; ids do not depend on how many words are asked for at a time."""
    import tracemalloc

    import pyarrow as pa

    from sparkloom.llm import shared

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x} {'abcdefghij'[x % 10] * (x % 7 + 1)}" for x in rng.integers(0, 4000, 2000).tolist()) for _ in range(200)]
    column = pa.array(texts)
    data, at = shared.string_bytes(column)
    starts, ends, _ = shared.word_bounds(data, at)
    assert len(data) > 3_500_000
    tracemalloc.start()
    hashes = shared.word_hashes(data, starts, ends)
    hashing = tracemalloc.get_traced_memory()[1]
    tool = rans.WordEncoder(PATH)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    ids, n = tool.encode(column)
    encoding = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert hashing < 40_000_000 and encoding < 60_000_000
    some = [0, 7, len(starts) - 1]
    assert (hashes[some] == [shared.word_hashes(data[starts[i] : ends[i]], np.array([0]), ends[i : i + 1] - starts[i])[0] for i in some]).all()
    words = ["alpha", "x1", "don't", "Beta", "42"] * 30
    want = [tool.tool.encode(w, add_special_tokens=False).ids for w in words]
    held, rans.ASKED_WORDS = rans.ASKED_WORDS, 500
    try:
        got, begin, sizes = tool.ask(words)
    finally:
        rans.ASKED_WORDS = held
    assert [got[b : b + k].tolist() for b, k in zip(begin.tolist(), sizes.tolist(), strict=True)] == want
    assert tool.ask([])[0].tolist() == [] and len(n) == 200 and n.sum() == len(ids)
