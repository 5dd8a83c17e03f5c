"""The pipeline's rows against its stages, one by one."""

import corpus_pipeline
import __spark_entry__ as entry
from cvebeacon.llm import lines, minhash, mixing, packing, quality
from cvebeacon.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, labels).collect()}
    good = docs.where(docs.doc_id.isin([i for i, p in scored.items() if p])).toPandas()
    assert 0 < len(good) < len(scored)
    good = spark.createDataFrame(good, docs.schema)
    cleaned = {r["doc_id"]: r["text"] for r in lines.dedup_lines(good).collect()}
    emptied = {r["doc_id"] for r in good.collect() if r["text"].strip() and not cleaned[r["doc_id"]].strip()}
    cleaned = spark.createDataFrame(
        [(*r[:1], cleaned[r["doc_id"]], *r[2:]) for r in good.collect() if r["doc_id"] not in emptied],
        docs.schema,
    )
    kept = {r["doc_id"] for r in minhash.near_duplicates(cleaned).collect() if r["kept"]}
    single = cleaned.where(cleaned.doc_id.isin(list(kept)))
    drawn = mixing.mix_sources(single).toPandas()
    times = drawn.groupby("doc_id").size()
    assert set(times.index) == kept
    again = spark.createDataFrame(
        [tuple(r) for r in single.collect() for _ in range(times[r["doc_id"]])], docs.schema
    )
    expected = packing.pack(again, packing.Packing(tokenizer_path())).collect()
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(expected)


def test_entry_names():
    numbers = [int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()
