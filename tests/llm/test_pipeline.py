"""The pipeline's stages and the registered queries with their SQL."""

import duckdb
import pytest

import corpus_pipeline
from cairn.llm import queries as llm

from .test_operators import brute_links, key

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, duck, name):
    df = llm.queries()[name](spark, SF)
    got = sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    rel = duck.sql(llm.oracle_sql()[name])
    assert got == sorted(map(str, rel.select(*sorted(rel.columns)).fetchall()))


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))


def test_stages(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    good = duck.sql(llm.oracle_sql()["op8_quality_rules"]).df()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and ids == set(good[good.kept].doc_id)
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    _, _, root = brute_links([(r.doc_id, r.text) for r in kept.collect()])
    one = stages["ngram_jaccard_join"](spark, kept, SF)
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted({root[k] for k in root})
    one = spark.createDataFrame(one.collect(), docs.schema)
    leaks = duck.sql(llm.oracle_sql()["op10_benchmark_decontamination"]).df()
    clean = stages["benchmark_decontamination"](spark, one, SF)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - set(leaks[leaks.n_items > 0].doc_id)
    safe = stages["secret_scans"](spark, clean, SF)
    assert safe.columns == columns and safe.count() == clean.count() and safe.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    last = stages["sentencepiece"](spark, safe, SF)
    assert last.where("not lossless").count() == 0 and last.count() == clean.count()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, tuple(r.ids)) for r in whole.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in last.collect())
    docs.unpersist()


def test_one_verbatim_window_is_enough(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(20).collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").limit(5).collect()]
    rows = [{**r.asDict(), "text": f"{r.text} {' '.join(items[k].split()[:12])} and on" if k < 5 else r.text} for k, r in enumerate(docs)]
    table = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    left = {r.doc_id for r in dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, table, SF).collect()}
    plain = {r.doc_id for r in dict(corpus_pipeline.STAGES)["benchmark_decontamination"](spark, spark.createDataFrame(docs), SF).collect()}
    assert left == plain - {r.doc_id for r in docs[:5]} and len(plain) > 15


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    assert key(None) < 0
