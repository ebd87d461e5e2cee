"""Repeated word windows on small tables, against plain Python."""

import random
import re

import numpy as np
import pytest

from sparkloom.llm import countmin, substring_dedup

SCHEMA = "doc_id long, text string"


def plain(rows, size=13):
    """(id, kept text, words, removed) of each row; rows of one id are one document."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - size + 1) if i is not None else []:
            k = tuple(w[a : a + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for a in range(len(w) - size + 1) if i is not None else []:
            if first[tuple(w[a : a + size])] < i:
                gone.update(range(a, a + size))
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, " ".join(kept), len(w), len(gone)))
    return sorted(out, key=str)


def got(spark, rows, **more):
    return sorted((tuple(r) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()), key=str)


def made(n, seed):
    """Texts with copies, near copies, passages that several share, and words that repeat."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passages = [[word() for _ in range(rng.randint(5, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and rows:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.6:
            w = [word() for _ in range(rng.randint(0, 40))] + rng.choice(passages) + [word() for _ in range(rng.randint(0, 40))]
        elif kind < 0.7:
            w = ["same"] * rng.randint(1, 60)
        else:
            w = [word() for _ in range(rng.randint(0, 120))]
        rows.append((i * 7 % n, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_plain_python(spark, seed):
    rows = made(150, seed)
    assert got(spark, rows) == plain(rows)


def test_a_full_sketch_changes_nothing(spark):
    rows = made(80, 3)
    assert got(spark, rows, bits=4) == got(spark, rows, bits=20) == plain(rows)


def test_without_broadcast_segments(spark, monkeypatch):
    rows = made(80, 4)
    monkeypatch.setattr(substring_dedup, "SEGMENTS", 0)
    assert got(spark, rows) == plain(rows)


def test_some_segments_only(spark, monkeypatch):
    rows = made(120, 5) + [(1000 + i, "one passage that stands in very many documents of this table and is copied once more " * 3) for i in range(40)]
    monkeypatch.setattr(substring_dedup, "SEGMENTS", 6)
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [
        (None, line), (None, None), (5, line), (5, line), (3, f"\t{line}\n\n{line}\x0b"), (4, None), (6, ""), (7, " \n "), (8, "w1 w2"), (9, line.upper()), (10, " ".join(["x"] * 20)), (11, " ".join(["x"] * 20)),
        (12, " ".join(["y"] * 13)), (13, " ".join(["y"] * 14)), (14, " ".join(["y"] * 12)), (15, "long " * 30000), (16, "long " * 20000 + "end"), (17, " ".join(f"v{i}" for i in range(13))), (18, " ".join(f"v{i}" for i in range(12))),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, size=2) == plain(rows, 2)


def test_empty_tables_and_other_columns(spark):
    assert got(spark, []) == []
    rows = [(1, "a " * 20, 3, "x"), (2, "a " * 20, 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, drops string").selectExpr("*", "1 AS low", "2 AS high", "3 AS n_words")
    assert [tuple(r) for r in substring_dedup.substring_dedup(df).orderBy("doc_id").collect()] == [(1, " ".join("a" * 20), 20, 0), (2, "", 20, 20)]


def test_sketch_never_counts_too_low(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2)
    docs = [np.unique(rng.choice(keys, 50)) for _ in range(200)]
    n = {}
    for d in docs:
        for k in d.tolist():
            n[k] = n.get(k, 0) + 1
    for bits in (8, 23):
        parts = spark.sparkContext.parallelize(range(200), 7).map(lambda i: (i,)).toDF("i long")

        def send(batches, bits=bits):
            yield from countmin.parts((docs[i] for b in batches for i in b.column(0).to_pylist()), bits)

        seen = countmin.merged(parts.mapInArrow(send, countmin.PART), bits)
        hit = dict(zip(keys.tolist(), countmin.repeated(seen, keys, bits).tolist(), strict=True))
        assert all(hit[k] for k, c in n.items() if c > 1)
        if bits == 23:
            assert sum(hit[k] for k, c in n.items() if c == 1) < 0.01 * len(n)


def test_packed_slots_come_back():
    for slots in ([], [0], [0, 0, 5], [3, 70000, 70000, 4194303]):
        assert countmin.unpacked(countmin.packed(np.array(slots, np.uint64))).tolist() == slots
