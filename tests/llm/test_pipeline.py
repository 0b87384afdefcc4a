"""The pipeline: stages on the documents and on awkward rows, and what each of them must do."""

import re

import pytest

import corpus_pipeline
from codestrata.llm import exact_dedup, simhash, toxicity
from codestrata.llm.common import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        out.append(docs)
    return out


def test_columns_stay(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == before.columns and after.count() <= before.count()


def test_decisions_take_effect(spark, stages):
    raw, clean, unique, near, private, packed = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    lost = raw.join(clean, "doc_id", "left_anti").join(labels, "doc_id").groupBy("toxic").count().collect()
    assert {r.toxic: r["count"] for r in lost}.get(1, 0) > 10 * {r.toxic: r["count"] for r in lost}.get(0, 0)
    assert unique.count() == unique.select("text").distinct().count() == clean.select("text").distinct().count()
    assert unique.count() > near.count() >= 0.9 * unique.count()
    assert private.count() == near.count()
    mail = re.compile(r"[\w.]+@[\w.]+")
    before = {m for r in near.collect() for m in mail.findall(r.text)}
    after = {m for r in private.collect() for m in mail.findall(r.text)}
    assert before and not before & after and len(before) == len(after)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in private.collect()}


def test_whole_run(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))


def test_awkward_rows(spark, awkward, empty):
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() <= (docs.count() if name != "best-fit packing" else 1 << 20)
            docs = stored(out) if name != "best-fit packing" else out


def test_hot_groups(spark):
    """A third of all rows are copies of one text, another third near copies of another."""
    base = [f"w{i}" for i in range(400)]
    rows = [(i, "the same words again and again until the end of it") for i in range(300)]
    rows += [(1000 + i, " ".join([*base[:i], "changed", *base[i + 1:]])) for i in range(300)]
    rows += [(5000 + i, " ".join(f"t{i}x{j}" for j in range(50))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    kept = {r.doc_id for r in simhash.one_of_each(exact_dedup.distinct_documents(docs)).collect()}
    assert kept == {299, 1000} | {5000 + i for i in range(300)}


def test_names_and_methods():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "pii surrogates", "best-fit packing"]
    assert toxicity.MODULUS == 3 and corpus_pipeline.ORACLE_SQL is None
