"""Source divergence on small tables, against plain Python."""

import random
import re

from sparkloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, source string, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, TERM.findall(t.translate(LOWER))) for x, s, t in rows if x == lang]
        docs = {}
        for _, terms in mine:
            for w in set(terms):
                docs[w] = docs.get(w, 0) + 1
        kept = sorted(w for w, n in docs.items() if n >= least)
        sources = sorted({s for s, _ in mine})
        count = {g: dict.fromkeys(kept, 0) for g in [*sources, None]}
        for s, terms in mine:
            for w in terms:
                if w in count[s]:
                    count[s][w] += 1
                    count[None][w] += 1
        p = {g: {w: 1 + 10**9 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for w, n in c.items()} for g, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][w], p[None][w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > p[None][w]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, _, w) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def got(spark, rows, **more):
    return sorted(tuple(r) for r in divergence.source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect())


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "THE", "über", "ÜBER", "don't", "x1y", "naïve", "日本", "a-b", "é", "\U0001f600ok", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for _ in range(n):
        s = rng.randrange(5)
        text = " ".join(rng.choice(vocabulary[s:] if rng.random() < 0.8 else vocabulary) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None, ""]), f"src{s}" if s else rng.choice([None, "é", "~"]), text))
    return rows


def test_matches_plain_python(spark):
    rows = made(200, 1) + [("en", None, None), ("en", "silent", ""), ("fr", "alone", "bon " * 12), ("xx", "a", None), ("xx", "b", "12 34"), ("en", "src1", "long word " * 20000)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, least=3, top=2) == plain(rows, 3, 2)


def test_ties_repeated_rows_and_no_terms(spark):
    rows = [("en", s, "one two") for s in "abc" for _ in range(4)] * 2
    assert got(spark, rows) == plain(rows)
    assert {r[4] for r in got(spark, rows, least=1000)} == {0}
    assert got(spark, []) == []


def test_counts_beyond_nine_billion_stay_exact(spark):
    c, n, v = 8 * 10**11, 16 * 10**12, 10**6
    row = spark.createDataFrame([(c, n, v)], "c long, n long, v long").selectExpr(divergence.share("c", "n"), f"{divergence.apart('1000000001L', '1L')}").first()
    assert tuple(row) == (1 + 10**9 * (c + 2) // (n + 2 * v), 10**18 // 1000000002)


def test_other_columns(spark):
    rows = made(60, 2)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS term", "2 AS n", "3 AS counts", "4 AS item", "5 AS rank")
    assert sorted(tuple(r) for r in divergence.source_divergence(df).collect()) == plain(rows)
