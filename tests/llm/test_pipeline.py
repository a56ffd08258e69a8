"""The pipeline's stages on a small corpus: each decision takes effect, and clean documents stay."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import queries

from .test_models import made_texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    passage = "this passage of the test set has more than ten words in it and must not stay anywhere"
    rows = [(i, t, "en", f"s{i % 4}", len(t), y) for i, (t, y) in enumerate(made_texts(400, 6))]
    rows += [(1000 + i, rows[1][1] if i < 3 else rows[2][1] + " extra", "en", "s0", None, 0) for i in range(6)]
    fresh = [t for t, y in made_texts(30, 50) if not y]
    rows += [(2000, f"{fresh[0]} and then {passage} {fresh[1]}", "en", "s1", None, 0), (2001, passage, "en", "s1", None, 0), (2002, None, None, None, None, 0), (2003, "", "en", "s2", 0, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic int")
    frame.drop("toxic").write.parquet(str(out / "documents.parquet"))
    frame.select("doc_id", F.lit(1).alias("quality"), "toxic").filter("doc_id < 1000").write.parquet(str(out / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(out / "benchmark.parquet"))
    return str(out)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == corpus_pipeline.COLUMNS
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    toxic = {i for i in range(400) if i % 3 == 0}
    gone = ids[0] - ids[1]
    assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) < 10 and {2002, 2003} <= ids[1]
    assert not ids[2] & {1000, 1001, 1002} and len(ids[2] & {2, 1003, 1004, 1005}) == 1 and {1, 2002, 2003} <= ids[2]
    assert ids[2] - ids[3] == {2001}
    cleaned = seen[3].filter("doc_id = 2000").first()
    assert "passage of the test" not in cleaned.text and cleaned.text.startswith(docs.filter("doc_id = 2000").first().text[:40]) and cleaned.n_chars == len(cleaned.text)
    changed = seen[2].select("doc_id", "text").exceptAll(seen[3].select("doc_id", "text"))
    assert {r.doc_id for r in changed.collect()} == {2000, 2001}
    assert seen[4].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert seen[5].count() == seen[4].count() and {"shard", "slot"} <= set(seen[5].columns)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and out.select("shard").distinct().count() > 20
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"]


def test_stages_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registered_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
