import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute

from sparkloom.llm import bloom
from sparkloom.llm.ngram_join import ngram_join, one_of_each_group


def brute(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and len(x & y) * den >= num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((i, len(s), root(i)) for i in sets for s in sets[i])


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    shared = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(3)]
    rows, texts = [], []
    for i in range(120):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts[:5] if rng.random() < 0.5 else texts).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 150])))
            if rng.random() < 0.4:
                text += " " + rng.choice(shared)
        texts.append(text)
        rows.append((i, text))
    return rows + [(200, None), (201, ""), (202, " \n "), (203, "A b"), (204, "a B"), (5, rows[5][1])]


def test_links_match_brute_force(spark):
    for seed, k, num in ((1, 3, 90), (2, 5, 80)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, ngram_join(df, k, num, 100).collect())) == brute(rows, k, num, 100)


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (2, "A b  c\td")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join(df, 3, 90, 100).collect()), key=str) == [(1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert ngram_join(df.limit(0), 3, 90, 100).collect() == []


def test_large_groups_of_near_copies(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for g, size in ((0, 150), (1, 60)):
        base = [rng.choice(vocab) for _ in range(110 if g else 60)]
        half = list(base)
        for _ in range(3):
            half[rng.randrange(len(half))] = rng.choice(vocab)
        for _ in range(size):
            w = list(base if rng.random() < 0.6 else half)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.2:
                w = w[: rng.randrange(20, len(w))]
            if rng.random() < 0.1:
                w += [rng.choice(vocab) for _ in range(rng.randrange(1, 30))]
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num in ((3, 90), (5, 80)):
        assert sorted(map(tuple, ngram_join(df, k, num, 100).collect())) == brute(rows, k, num, 100)


def test_key_shared_by_documents_far_apart(spark, monkeypatch):
    """Documents made of common phrases in other orders: keys stay large although hardly any pair links."""
    monkeypatch.setattr("sparkloom.llm.ngram_join.FEW", 6)
    monkeypatch.setattr("sparkloom.llm.ngram_join.BLOCK", 16)
    monkeypatch.setattr("sparkloom.llm.ngram_join.COMPONENT_TOKENS", 50)
    monkeypatch.setattr("sparkloom.llm.ngram_join.PARTNERS", 3)
    rng = random.Random(4)
    phrases = [" ".join(f"p{i}x{j}" for j in range(7)) for i in range(30)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(rng.randrange(3, 9)))) for i in range(220)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num in ((3, 90), (5, 80)):
        assert sorted(map(tuple, ngram_join(df, k, num, 100).collect())) == brute(rows, k, num, 100)


def test_repeated_rows_and_ids_with_two_texts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(60)]
    rows = [(i % 40, " ".join(base[: 60 - i % 7])) for i in range(80)] + [(3, "other words of the same id stand here")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(set(map(tuple, ngram_join(df, 3, 90, 100).collect())))
    assert got == sorted(set(brute(rows, 3, 90, 100)))


def test_one_of_each_group_keeps_columns(spark):
    rows = [(1, "a b c d e f g", 5), (2, "a b c d e f g", 6), (None, "a b c d e f g", 7), (4, None, 8), (5, "", 9), (1, "a b c d e f g", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(map(tuple, one_of_each_group(df).collect()), key=str)
    assert got == [(1, "a b c d e f g", 5), (4, None, 8), (5, "", 9), (None, "a b c d e f g", 7)]
    assert one_of_each_group(df.limit(0)).columns == df.columns


def test_filter_of_kinds_holds_what_occurs_twice_and_once_in_each():
    rng = np.random.default_rng(7)
    bits = 21
    documents = [(x := np.unique(rng.integers(0, 3000, 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), x[:20], x[10:30]) for _ in range(100)]
    batches = [pa.Table.from_batches([b]) for part in (documents[:50], documents[50:], []) for b in bloom.marks(part, bits)]
    sent = pa.concat_tables(batches)
    merged = [bloom._merge(sent.filter(pa.compute.equal(sent["seg"], s))) for s in set(sent["seg"].to_pylist())]
    found = bloom.bitmap({t["seg"][0].as_py(): t["twice"][0].as_py() for t in merged}, bits)
    times, kinds = Counter(x for d in documents for x in d[0]), [{x for d in documents for x in d[i]} for i in (1, 2)]
    want = {x for x, n in times.items() if n > 1 and x in kinds[0] and x in kinds[1]}
    asked = np.array(sorted(times), np.uint64)
    held = set(asked[bloom.held(found, asked, bits)])
    assert want <= held and len(held - want) < 20 < len(times) - len(want)
