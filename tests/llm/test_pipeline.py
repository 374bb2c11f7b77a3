import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from driftline.llm.common import Written
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {}
    for name, stage in P.STAGES:
        before[name] = docs
        docs = Written(stage(spark, docs, DATA), name).df
        if name != "mixing":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    after = dict(zip(before, [*list(before.values())[1:], docs], strict=True))
    assert all(ids(after[n]) <= ids(before[n]) for n in before)
    texts = {r.doc_id: r.text for r in before["simhash_near_dedup"].collect()}
    kept = {r.doc_id: r.text for r in after["simhash_near_dedup"].collect()}
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(t, i)
    assert len(set(kept.values())) == len(kept) and all(first[t] == i for i, t in kept.items())
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r.doc_id for r in before["decontamination"].collect() if brute.leaks(r.text, items)[4]}
    assert ids(before["decontamination"]) - ids(after["decontamination"]) == bad
    assert not any(brute.leaks(r.text, items)[1] for r in after["decontamination"].collect())
    assert not any(sum(brute.personal(r.text)[:2]) for r in after["pii"].collect())
    got = docs.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.1 * r.target for r in got)


@pytest.mark.parametrize("empty", [True, False])
def test_odd_tables(spark, empty, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x " * 4000, None, "s", 8000), (3, "a@b.co", "en", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").limit(0 if empty else 9)
    for t, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = P.run(spark, str(tmp_path)).collect()
    assert (out == []) == empty
