"""Personal data, leaks and toxicity against plain versions written here: spans, distances, blocks, long texts."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from sparkloom.llm import decontam, pii_crf, toxicity

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits[::-1])]
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (list(PLAIN).index(x[0]), x[1]))


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(11)
    parts = ["a@b.c", "_d@e.f", "4111 1111 1111 1111", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "+1 (312) 555-0100", "+", "@", ".", "é", " ", "-", "99", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)] + [None, "", "a@b.c" * 3]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "y")], "doc_id long, text string, spans string")
    rows = pii_crf.pii_documents(df).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = plain_spans(texts[r["doc_id"]] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(k == x for x, _, _ in want) for k in PLAIN]
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))
    assert pii_crf.pii_documents(df.limit(0)).collect() == []


def test_a_million_digits_take_seconds():
    for text in ("1" * 1_000_000, "a" * 1_000_000, "1." * 500_000, "a@" * 500_000, "1" * 500_000 + "@x.y"):
        start = time.monotonic()
        spans = pii_crf.base_spans(text)
        assert time.monotonic() - start < 10
        assert spans == ([(0, 0, 500_004)] if text.endswith("y") else spans)


def test_added_spans_find_what_patterns_miss():
    """Recall and precision of the field on lines made like, but not from, its labelled table."""
    rng = random.Random(12)
    near, after = ["call", "tel", "phone", "mobile", "fax"], ["today", "please", "now", "thanks"]
    phones = ["({}) 555-{}", "{}-555-{}", "{}.555.{}"]
    good = [(f"{rng.choice(near)} ", rng.choice(phones).format(rng.randint(200, 989), f"{rng.randint(100, 199):04d}"), f" {rng.choice(after)}") for _ in range(200)]
    bad = [f"{rng.choice(['invoice', 'chapter', 'room', 'size'])} {rng.randint(1, 99)} {rng.randint(1, 2030)} of {rng.randint(1, 500)}" for _ in range(200)]
    texts = [a + b + c for a, b, c in good] + bad
    got = pii_crf.added_spans(texts, [[] for _ in texts], pii_crf.trained())
    hits = sum((3, len(a), len(a + b)) in x for (a, b, _), x in zip(good, got, strict=False))
    assert hits >= 0.95 * len(good) and not any(got[len(good) :])


def plain_best(pattern, text):
    """The least edit distance of pattern to any part of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


def whole_distance(x, y):
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return row[-1]


def leak_tables(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 25)))) for i in range(8)] + [(20, "Tiny item"), (21, "ab"), (3, "another text of item three stands here"), (30, None), (31, " . ")]
    docs = []
    for n in range(60):
        text = " ".join(word() for _ in range(30))
        for _, item in rng.sample(items[:8], rng.randint(0, 2)):
            chars = list(item)
            for _ in range(rng.randint(0, len(chars) // 8)):
                chars[rng.randrange(len(chars))] = rng.choice(["", "x", "zq"])
            text += "; " + "".join(chars).upper() + " - " + word()
        docs.append((n, text))
    docs += [(60, "a TINY, item!"), (61, "tiny items"), (62, "untiny item"), (63, "x ab"), (64, docs[0][1]), (64, docs[0][1]), (65, None), (66, ""), (67, "another text of item three stands here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    return items, docs, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 AS item_ids"), bench


def test_leaks_have_their_distances_and_spans_in_any_number_of_blocks(spark, monkeypatch):
    items, docs, df, bench = leak_tables(spark)
    key = lambda r: (r["doc_id"], str(r["item_ids"]))
    got = sorted(decontam.find_leaks(df, bench).collect(), key=key)
    want = {}
    for n, text in docs:
        t = decontam.normal(text or "")
        for i, item in items:
            x = decontam.normal(item or "")
            d = plain_best(x, t) if len(x) >= 20 else 0 if x and f" {x} " in f" {t} " else 99
            if x and d <= (int(0.1 * len(x) + 1e-9) if len(x) >= 20 else 0):
                want.setdefault((n, text), {})
                want[n, text][i] = min(d, want[n, text].get(i, 99))
    assert len(got) == sum(x in want for x in docs)
    texts = {}
    for n, t in docs:
        texts[n] = t
    for r in got:
        found = want[r["doc_id"], texts[r["doc_id"]]]
        assert r["item_ids"] == sorted(found) and r["distances"] == [found[i] for i in sorted(found)]
        for m, i in enumerate(r["item_ids"]):
            part = decontam.normal(texts[r["doc_id"]][r["spans"][2 * m] : r["spans"][2 * m + 1]])
            slack = max(len(w) for w in part.split()) * 2  # a span goes from whole word to whole word
            assert min(whole_distance(decontam.normal(x or ""), part) for j, x in items if j == i) <= r["distances"][m] + slack
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 150)
    assert sorted(decontam.find_leaks(df, bench).collect(), key=key) == got
    kept = {r["doc_id"] for r in decontam.drop_leaks(df, bench).collect()}
    assert kept == {n for n, _ in docs} - {r["doc_id"] for r in got}
    for docs_, bench_ in ((df.limit(0), bench), (df, bench.limit(0))):
        assert decontam.find_leaks(docs_, bench_).collect() == []
        assert decontam.drop_leaks(docs_, bench_).count() == docs_.count()


def plain_segments(s):
    """Maximal scoring segments by their definition: the best one (shortest of equals, then first), then both sides."""
    total, out = np.concatenate(([0.0], np.cumsum(s))), []

    def split(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                v = total[j] - total[i]
                if v > 1e-9 and (best is None or v > best[0] + 1e-9 or (abs(v - best[0]) <= 1e-9 and (j - i, i) < (best[2] - best[1], best[1]))):
                    best = (v, i, j)
        if best:
            out.append((best[1], best[2]))
            split(a, best[1])
            split(best[2], b)

    split(0, len(s))
    return sorted(out)


def test_segments_stand_where_the_definition_puts_them():
    rng = np.random.default_rng(14)
    for _ in range(150):
        s = rng.normal(-0.3, 1, rng.integers(0, 25))
        assert [(a, b) for a, b, _ in toxicity.segments(s)] == plain_segments(s)


def toxic_tables(spark, n=700):
    rng = random.Random(15)
    calm, bad = [f"calm{i}" for i in range(150)], ["vileword", "badterm", "nasty"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(calm) for _ in range(30)]
        if i % 5 == 0:
            at = rng.randrange(25)
            words[at:at] = rng.sample(bad, 3)
        elif rng.random() < 0.1:
            words.insert(rng.randrange(25), rng.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return docs, labels, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_scores_follow_the_formulas(spark):
    """The null model and the score of each text, computed once more word by word."""
    docs, labels, df, lab = toxic_tables(spark)
    model = toxicity.fit(df, lab)

    def token(w):
        word = w.strip(toxicity.MARKS).lower()
        share = model.base
        for f in [word[:n] for n in (3, 4, 5, 6) if len(word) >= n] + ["=" + word]:
            share = model.shares.get(f, share)
        return math.log(share / (1 - share)) - math.log(model.base / (1 - model.base)) - toxicity.DRIFT

    def counted(text):
        s, seen = [], set()
        for w in text.split():
            v = token(w)
            s.append(-toxicity.DRIFT if v > 0 and w in seen else v)
            if v > 0:
                seen.add(w)
        return np.array(s)

    calm = [t for (i, t), (_, y) in zip(docs, labels, strict=True) if not y and zlib.crc32(str(i).encode()) % 5 == 4]
    scores = np.round(np.concatenate([counted(t) for t in calm]), 2)
    assert np.exp(model.rate * scores).mean() == pytest.approx(1.0, abs=1e-6)
    best = [(len(t.split()), max([0.0] + [counted(t)[a:b].sum() for a, b in plain_segments(counted(t))])) for t in calm]
    assert model.k == pytest.approx(1 / np.mean([n * math.exp(-model.rate * b) for n, b in best]), rel=1e-6)
    out = {r["doc_id"]: r for r in toxicity.toxicity(df, lab).collect()}
    for i, text in docs[:120]:
        s = counted(text)
        bar = math.log(model.k * len(s))
        evidence = sum(max(0.0, model.rate * s[a:b].sum() - bar) for a, b in plain_segments(s))
        assert out[i]["score"] == pytest.approx(1 / (1 + math.exp(-model.slope * (math.log1p(evidence) - model.at))), rel=1e-6)
        raw = np.array([token(w) for w in text.split()])
        want = [x for a, b in plain_segments(raw) if model.raw_rate * raw[a:b].sum() > math.log(model.raw_k * len(raw)) for x in (a, b)]
        assert out[i]["passages"] == want


def test_toxicity_of_odd_tables(spark):
    docs, labels, df, lab = toxic_tables(spark, 300)
    long = "calm1 " * 300_000 + "vileword badterm nasty"
    more = spark.createDataFrame([(0, docs[0][1]), (0, docs[0][1]), (None, docs[5][1]), (900, None), (901, ""), (902, long), (903, " \n")], "doc_id long, text string")
    model = toxicity.fit(df, lab)
    rows = toxicity.score_texts(more.selectExpr("*", "1 AS score"), model).collect()
    assert len(rows) == 7 and len({r["score"] for r in rows if r["doc_id"] == 0}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (900, 901, 903)}) == 1
    assert [r["predicted"] for r in rows if r["doc_id"] == 902 or r["doc_id"] is None].count(1) >= 1
    kept = toxicity.drop_toxic(more.selectExpr("*", "1 AS score"), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"] for r in kept.collect()} >= {900, 901, 903}
    assert toxicity.scored_documents(df.limit(0), lab).collect() == []
    for some in (lab.limit(0), lab.filter("toxic = 1"), lab.filter("toxic = 0")):
        assert {r["predicted"] for r in toxicity.scored_documents(df, some).collect()} == {0}
