"""Each stage of the pipeline against plain Python, on what the stage before kept."""

import collections
import struct
import zlib

import corpus_pipeline as pipeline
from sparkloom.llm import toxicity
from sparkloom.llm.decontam import normal
from sparkloom.llm.shared import prepare, stored

from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        kept.append(docs.collect())
        if name != "token_files":
            assert docs.columns == columns and set(kept[-1]) <= set(kept[-2])
    start, calm, single, clean, mixed, tokens = kept
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    (scores,) = [toxicity.Scanner(model).scores([r["text"] or "" for r in start])]
    toxic = {r["doc_id"] for r, s in zip(start, scores, strict=True) if model.score(model.evidence(toxicity.segments(s), len(s))[0]) >= 0.5}
    assert {r["doc_id"] for r in calm} == {r["doc_id"] for r in start} - toxic
    parts = brute([(r["doc_id"], r["text"]) for r in calm], 5, 80, 100)
    assert {r["doc_id"] for r in single} == {i for i, _, c in parts if i == c}
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r["doc_id"] for r in clean if any(x in normal(r["text"] or "") for x in items)]
    assert all(any(x[:9] in normal(r["text"]) or x[-9:] in normal(r["text"]) for x in items) for r in set(single) - set(clean))
    copies = collections.Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 3
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in mixed:
        ids = tool.encode(r["text"] or "", add_special_tokens=False).ids + [pipeline.END_ID]
        want.append((r["doc_id"], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens) == sorted(want)
    assert pipeline.run(spark, SF).count() == len(mixed)
