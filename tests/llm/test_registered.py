"""Registered queries against their SQL, and their columns."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from check import digest
from codestrata.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "text", "n_entities", "kinds"], "op2": ["doc_id", "held_out", "score", "predicted"],
    "op3": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], "op4": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op5": ["query_id", "rank", "vec_id", "score"], "op6": ["doc_id", "fingerprint", "component_id"],
    "op7": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"], "op8": ["doc_id", "held_out", "lang_pred", "score"],
    "op9": ["doc_id", "held_out", "score", "predicted"], "op10": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op11": ["item_id", "rank", "doc_id", "score"], "op12": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op13": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    mine = digest(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(queries.SQL[name])
    assert mine == digest([d[0] for d in result.description], result.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name.split("_")[0]]
    if name.startswith(("op5_", "op7_", "op11_", "op13_")):
        assert df.count() > 0
    else:
        ids = sorted(r.doc_id for r in df.select("doc_id").collect())
        assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
