"""The pipeline stage by stage, and the registered queries."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pyrocline.llm import decontamination, queries, tokens, toxicity
from pyrocline.storage import settle

from test_near_copies import brute_kept

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = (docs, settle(stage(spark, docs, SMALL), name))
        docs = steps[name][1]
    for _, after in list(steps.values())[:-1]:
        assert after.columns == columns
    before, after = steps["toxicity"]
    found = toxicity.score(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in found.where("predicted = 0").collect()}
    before, after = steps["simhash_near_dedup"]
    assert sorted(r.doc_id for r in after.collect()) == brute_kept([(r.doc_id, r.text or "") for r in before.collect()])
    before, after = steps["benchmark_decontamination"]
    bad = {r.doc_id for r in decontamination.contaminated(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad
    before, after = steps["source_mixing"]
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 3
    before, after = steps["token_output"]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    sure = lambda t: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in after.collect()) == Counter((r.doc_id, sure(r.text)) for r in before.collect())
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after.collect()))


ODD = "doc_id long, text string, source string, lang string, n_chars long, row string, text_hash long, hits string, score double, nth int, copies int, salt int, label int"


@pytest.mark.parametrize("rows", [[], [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "the cat sat", None), (3, "word " * 40_000, "b"), (None, "the cat sat", "b"), (4, "the cat sat on a mat", "b")]])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame([(*r, "en", 0, "r", 1, "h", 0.5, 7, 8, 9, 1) for r in rows], ODD)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        found = settle(stage(spark, docs, SMALL), name)
        kept[name] = found.collect()
        if name != "token_output":
            assert found.columns == docs.columns and all(r.row == "r" and r.copies == 8 and r.score == 0.5 for r in kept[name])
            docs = found
    assert len(kept["toxicity"]) == len(rows)
    # Of rows without words one stays, of the three cats the one with an id.
    assert {r.doc_id for r in kept["simhash_near_dedup"]} == ({1, 2, 3, 4} if rows else set())
    assert len(kept["token_output"]) == len(kept["source_mixing"])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "embeddings"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    found, wanted = entry.queries()[name](spark, SMALL), base.sql(entry.oracle_sql()[name])
    columns = sorted(found.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(str(r[i]) for i in at) for r in wanted.fetchall())


def test_all_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op3_kneser_ney_toxicity", "op4_fourier_quality", "op5_consensus_paths", "op6_token_files", "op7_sampled_splitters", "op9_simhash_dedup", "op10_water_filling"])
def test_whole_tables(spark, name):
    table = "pages" if name.startswith("op5") else "documents"
    found = entry.queries()[name](spark, SMALL)
    assert found.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
