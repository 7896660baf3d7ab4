"""The pipeline's rows against the stages' rules done by hand on the smallest data set."""

import os
import re
from collections import defaultdict

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pipeline(spark):
    import corpus_pipeline
    from quire.llm import mixing, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    kept = sorted(min(g)[1] for g in groups.values())
    sets = {}
    for i in kept:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    single = [i for i in kept if root[i] == i]
    taken = mixing.mixed_documents(docs.filter(docs["doc_id"].isin(single)))
    want = defaultdict(int)
    for r in taken.select("doc_id").collect():
        want[r["doc_id"]] += 1
    got, tokens = defaultdict(int), {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
        tokens[r["doc_id"]] = r["doc_tokens"]
    assert {i: n // tokens[i] for i, n in got.items()} == dict(want) and all(got[i] % tokens[i] == 0 for i in got)


def test_pipeline_on_nulls_repeats_and_other_columns(spark, tmp_path):
    import corpus_pipeline

    words = [f"w{k}" for k in range(90)]
    texts = [None, "", " ", "a", *(" ".join(words[k : k + 60]) for k in range(0, 30, 6)), " ".join(words[:60]), "x" * 5000]
    data = [(i, t, None if i == 3 else f"s{(i or 0) % 2}", 1, 2, "z") for i, t in [*enumerate(texts), (1, ""), (None, "b")]]
    ddl = "doc_id long, text string, source string, row int, place long, set_id string"
    spark.createDataFrame(data, ddl).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(11)] + [(None, 1), (4, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r["doc_id"] for r in got} <= {i for i, *_ in data}
    empty = tmp_path / "none"
    spark.createDataFrame([], ddl).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(empty / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
