"""Every operator on odd tables: nulls in any column, repeated rows, clashing names, no rows at all."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keyloom.llm import decontamination, exact_dedup, html_extraction, line_dedup, lm_scoring, packing, quality_resampling, simhash_dedup, token_counts, toxicity

NAMES = "id row at words length size content window starts place part tie r a b line lines runs depth removed new fp node keys bucket bundle held ids pieces counts h i noise toxic quality good quality_score votes whole keep group path sequence offset start html_text runs_of url _row _at _id _new _own".split()
RANKS, VOCABULARY = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))


@pytest.fixture(scope="module")
def docs(spark):
    line = "some words of a line that comes more than once in here"
    text = "\n".join([line, "and another one that is long enough to be counted", line])
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (None, text), (None, None), (5, "x"), (6, " \n\t"), (7, "word " * 30_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *[F.lit(None).cast("string").alias(c) for c in NAMES]).repartition(3)


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (2, None, None), (4, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int").withColumn("id", F.lit("own"))
    items = spark.createDataFrame([(1, "and another one that is long enough to be counted"), (1, "x"), (None, "some words of a line that comes more"), (2, None)], "item_id long, text string").withColumn("length", F.lit("own"))
    return labels, items


CASES = {
    "scores": lambda d, t: lm_scoring.score(d.withColumn("held_out", F.coalesce(F.col("doc_id") == 5, F.lit(False))), RANKS),
    "exact": lambda d, t: exact_dedup.exact_duplicates(d),
    "lines": lambda d, t: line_dedup.dedup_lines(d),
    "counts": lambda d, t: token_counts.token_counts(d, VOCABULARY),
    "toxicity": lambda d, t: toxicity.toxicity(d, t[0]),
    "simhash": lambda d, t: simhash_dedup.near_duplicates(d),
    "html": lambda d, t: html_extraction.main_text(d.withColumnRenamed("text", "html")),
    "quality": lambda d, t: quality_resampling.resample(d, t[0], share=1.0),
}


@pytest.mark.parametrize("name", CASES)
def test_one_row_for_each_document(docs, tables, name):
    got = CASES[name](docs, tables)
    if "doc_id" in got.columns:
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["1", "2", "2", "3", "4", "5", "6", "7", "None", "None"])
    kept = [c for c in NAMES if c in got.columns]
    assert not kept or got.where(F.coalesce(*kept).isNotNull()).count() == 0
    assert CASES[name](docs.limit(0), tables).count() == 0
    assert CASES[name](docs, tuple(t.limit(0) for t in tables)).count() == 10


def test_stages_and_searches(docs, tables):
    labels, items = tables
    pieces = packing.pack(docs, VOCABULARY, window=100).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces}[3] == 1 and len(pieces) == 8
    assert sorted(str(r.doc_id) for r in simhash_dedup.near_copies(docs).collect()) == ["2", "4", "6"]
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert found == {(d, i) for d in (1, 2, None) for i in (1, None)} | {(5, 1)}
    for empty in (docs.limit(0), docs.where("text IS NULL")):
        assert simhash_dedup.near_copies(empty).count() == 0 and decontamination.contaminated(empty, items).count() == 0
    assert packing.pack(docs.limit(0), VOCABULARY).count() == 0 and decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_hidden_columns_do_not_break_stages(spark, docs, tables, tmp_path):
    for name, t in zip(("labels", "benchmark"), tables):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    for stage in (quality_resampling.quality_stage, line_dedup.line_stage, simhash_dedup.simhash_stage, decontamination.decontamination_stage):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        assert 0 < stage(spark, docs, str(tmp_path)).count() <= 10
