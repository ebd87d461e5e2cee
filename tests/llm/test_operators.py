"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns, against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ann_forest, decontam, line_dedup, mixing, pii_crf, sharding, token_count, toxicity

LONG = "lorem ipsum dolor " * 4000


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_line_dedup_matches_plain_python(spark):
    shared = "This line is Shared by many"
    rows = [(3, f"{shared}\nown line number three\nshort\n{shared}"), (1, f"  {shared.upper()}\t\nown"), (2, f"own line number three\nshort\r\n{shared}"), (4, None), (5, ""), (6, LONG), (7, LONG), (7, shared), (None, shared)]
    first = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        for x in (t or "").split("\n") if i is not None else []:
            if len(key(x)) >= 10:
                first.setdefault(key(x), set()).add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if i is None or len(first.get(key(x), ())) < 2 or i <= min(first[key(x)])]
        want.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    got = [tuple(r) for r in line_dedup.line_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert line_dedup.line_dedup(frame(spark, []).limit(0)).collect() == []


def test_line_dedup_with_a_full_filter(spark):
    rows = [(i, f"line number {i % 40:05d}\nunique line {i:07d}") for i in range(200)]
    got = {r[0]: r[3] for r in line_dedup.line_dedup(frame(spark, rows), bits=8).collect()}
    assert got == {i: int(i >= 40) for i in range(200)}


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None]), " ".join("w" * rng.randint(0, 30))) for i in range(900)] + [(9000, "tiny", "one two"), (9001, "a", None), (9002, "void", "")]
    df = frame(spark, rows, "doc_id long, source string, text string").repartition(5)
    out = mixing.mixed_documents(df).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mixed_documents(df.repartition(2)).collect()))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    of, totals = {i: s for i, s, _ in rows}, {}
    for i, s, _ in rows:
        totals[s] = totals.get(s, 0) + size[i]
    order = sorted([s for s in totals if s is not None]) + [None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target, free, rest = {}, set(order), sum(totals.values())
    while True:  # share, stop those above their limit, share again
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * totals[s] + 1e-9}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * totals[s]
            rest -= target[s]
        free -= over
    assert sorted(r["doc_id"] for r in out) == sorted(size)
    taken = {}
    for r in out:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[of[r["doc_id"]]]
        assert abs(r["target"] - target[of[r["doc_id"]]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[of[r["doc_id"]]] = taken.get(of[r["doc_id"]], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 30 for s in totals)
    assert mixing.mixed_documents(df.limit(0)).collect() == []


def test_shards_are_level_and_slots_gapless(spark):
    rows = [(i, "x" * (i % 7)) for i in range(1003)] + [(5, "again"), (None, None)]
    out = sharding.sharded_documents(frame(spark, rows)).collect()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(slots) == 40
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in out} == {(i, len(t or "") + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(sharding.permute(np.arange(n), n, 7)) == list(range(n))
    assert sharding.sharded_documents(frame(spark, []).limit(0)).collect() == []


def test_token_counts_are_the_librarys(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(2)
    texts = [None, "", " ", "  a  b ", "\n\n", "=" * 700, "ab" * 400, "<s> </s> <unk>", "日本 ▁x é \U0001f600", LONG] + ["".join(rng.choice("abcde .-_\n\té日") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(texts)) + [(1, "twice")]
    got = token_count.count_tokens(frame(spark, rows).withColumn("n_tokens", F.lit(1)), path).collect()
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_base_spans_of_pii_and_added_ones(spark):
    texts = [None, "", "mail a.b@c.example.org, or 4111 1111 1111 1111", "ip 300.1.1.1 and 10.0.0.300 and 10.0.0.3.4", "call +1 (312) 555-0100 or (312) 555-0187 now", "no 2021-03-04 10:30 v1.2.3 here", "é a@b.co é 1.2.3.4", LONG]
    got = {r["doc_id"]: r for r in pii_crf.pii_documents(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        *counts, sha = pii_crf.digest(t or "")
        assert [got[i][f"n_{k}"] for k in pii_crf.KINDS] == counts and got[i]["base_sha256"] == sha
        base = pii_crf.told(sorted(pii_crf.base_spans(t or "")))
        assert set(filter(None, base.split(","))) <= set(got[i]["spans"].split(","))
    assert got[2]["spans"] == "email:5:22,card:27:46" and got[4]["spans"] == "phone:5:22,phone:26:40" and got[5]["spans"] == ""
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_viterbi_is_the_best_of_all_labellings():
    import itertools

    crf = pii_crf.trained()
    feats, gold = max(pii_crf.labelled_rows(), key=lambda r: len(r[1]) if len(r[1]) <= 4 else 0)
    e = crf.emissions(feats)
    score = lambda y: e[range(len(y)), y].sum() + crf.first[y[0]] + sum((crf.steps + crf.follow)[a, b] for a, b in zip(y, y[1:]))
    best = max(itertools.product(range(len(pii_crf.LABELS)), repeat=len(gold)), key=lambda y: score(list(y)))
    assert crf.viterbi(e[None])[0].tolist() == list(best) == gold


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prev, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (p != c))
    return min(row)


def test_leaks_within_the_error_budget(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(10, 40))) for _ in range(12)]
    docs = []
    for n in range(150):
        body = " ".join(word() for _ in range(60))
        if n % 2:
            t = list(items[n % 12])
            for _ in range(rng.randint(0, len(t) // 6)):
                t[rng.randrange(len(t))] = rng.choice(["", "x", "ab"])
            body += " " + "".join(t).upper() + ". " + body
        docs.append((n, body))
    docs += [(900, None), (901, ""), (902, LONG)]
    bench = frame(spark, list(enumerate(items)) + [(50, None), (51, "short")], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontam.find_leaks(frame(spark, docs), bench).collect()}
    for n, body in docs[:150]:
        t = decontam.normal(body)
        want = [i for i, x in enumerate(items) if plain_distance(decontam.normal(x), t) <= int(0.1 * len(decontam.normal(x)) + 1e-9)]
        assert got.get(n, []) == want, n
    assert not {900, 901, 902} & set(got)
    kept = decontam.drop_leaks(frame(spark, docs), bench)
    assert {r[0] for r in kept.collect()} == {n for n, _ in docs} - set(got)


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = np.round(rng.normal(-0.3, 1, rng.integers(0, 30)), 2)
        total = np.concatenate(([0], np.cumsum(s)))
        want = []

        def split(a, b):
            best = max(((total[j] - total[i], -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 1e-12:
                i, j = best[3], best[4]
                want.append((i, j, best[0]))
                split(a, i)
                split(j, b)

        split(0, len(s))
        got = toxicity.segments(s)
        assert sum(x for *_, x in got) == pytest.approx(sum(x for *_, x in want))


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(8)
    calm, bad = [f"calm{i}" for i in range(200)], ["badword", "vileterm", "nastyone"]
    docs, labels = [], []
    for i in range(900):
        words = [rng.choice(calm) for _ in range(40)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", "ing"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(5000, None), (5001, ""), (5002, LONG)]
    df, lab = frame(spark, docs), frame(spark, labels + [(None, 1), (7000, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.scored_documents(df, lab).collect()}
    for i, toxic in labels:
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert out[i]["predicted"] == toxic
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out.values())
    assert toxicity.scored_documents(df, lab.limit(0)).count() == len(docs)


def test_toxicity_finds_later_passages_of_words_already_seen():
    model = toxicity.Model({"=bad": 0.9, "=vile": 0.9, "=calm": 0.02}, 0.1, raw_rate=1.0, raw_k=0.5)
    text = " ".join(["calm"] * 30 + ["bad", "vile"] * 3 + ["calm"] * 30 + ["vile", "bad"] * 3 + ["calm"] * 30)
    ((raw, counted),) = toxicity.Scanner(model).both([text])
    assert model.passages(toxicity.segments(raw), len(raw)) == [(30, 36), (66, 72)]
    assert (counted > 0).sum() == 2 and (toxicity.Scanner(model).scores([text])[0] == counted).all()


def test_toxicity_reports_repeats_of_a_passage(spark):
    rng = random.Random(8)
    calm, bad = [f"calm{i}" for i in range(200)], ["badword", "vileterm", "nastyone"]
    filler = lambda n: [rng.choice(calm) for _ in range(n)]
    docs = [(i, " ".join(filler(20) + bad * (i % 6 == 0) + filler(20))) for i in range(600)]
    again = filler(40) + bad + filler(150) + bad + filler(40)
    df = frame(spark, docs + [(5000, " ".join(again))])
    labels = frame(spark, [(i, int(i % 6 == 0)) for i in range(600)], "doc_id long, toxic int")
    (row,) = toxicity.toxicity(df, labels).filter("doc_id = 5000").collect()
    assert row["predicted"] == 1 and row["passages"] == [40, 43, 193, 196] and row["n_passages"] == 2


def test_search_reaches_its_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0] * 15 + [None]), (9020, [])]
    df = frame(spark, rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann_forest.search(df, every=500).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 6000, 500))
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(len(y)), -s)) if i != q][:20]
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 20 and all(abs(v - s[i]) < 1e-9 for i, v in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hits >= 0.9 * 20 * len(got)
    few = frame(spark, [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r[0], r[1], r[2], r[3]) for r in ann_forest.search(few, 20).orderBy("query_id", "rank").collect()] == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert ann_forest.search(few.limit(0), 20).collect() == []
