"""The pipeline's stages, each against a brute-force version of itself on its own input."""

import re

import corpus_pipeline
from lakelineage.llm import decontaminate


def words(t):
    return re.findall(r"\w+", t.lower())


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {"input": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    toxic = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert len(toxic & kept) <= 0.2 * len(toxic) and len(kept) >= 0.9 * (len(seen["input"]) - len(toxic))
    assert {r.doc_id for r in seen["line_dedup"]} == kept
    lines = [x.strip(" \t\r") for r in seen["line_dedup"] for x in r.text.split("\n")]
    long_ = [x for x in lines if len(x) >= 20]
    assert len(long_) == len(set(long_))
    texts = {r.doc_id: r.text for r in seen["minhash_dedup"]}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in texts.items() if (w := t.lower().split())}
    ids = sorted(sets)
    assert not any(sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in seen["decontamination"]}
    for k, t in texts.items():
        text = " ".join(words(t or ""))
        if k in clean:
            assert not any(x in text for x in items)
        else:
            assert any(decontaminate.fitting_distance(x, text)[0] <= 0.2 * len(x) for x in items)
    assert {r.doc_id for r in seen["mixing"]} <= clean and all(r.taken > 0 for r in seen["mixing"])


def test_no_stage_breaks_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three", "en", "s", 13), (3, "one two three", "en", "s", 13), (None, "one two three", None, "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() <= 2 * len(rows)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
