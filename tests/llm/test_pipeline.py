from pathlib import Path

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from waypoint.llm import decontaminate, lines, pieces, quality, simhash
from waypoint.session import shared_folder

SF = "/root/testdata/sf0.001"


def test_stages_compose_and_clean_up(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {x.name for x in folder.iterdir()}
    out = corpus_pipeline.run(spark, SF)
    left = {x.name.split("-")[0] for x in folder.iterdir() if x.name not in before}
    assert left <= {"stage"} | {x for x in left if x.startswith("rdd")}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.keep_good(docs)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    dropped = lines.drop_shared_lines(good).select("doc_id", "text")
    one = {r.doc_id for r in simhash.near_duplicates(dropped).where("doc_id = component_id").collect()}
    hit = {r.doc_id for r in decontaminate.contaminated(dropped, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    want = pieces.report(dropped, public_tokenizers.path("piece_bpe_32k.model")).where(F.col("doc_id").isin(sorted(one - hit)))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect())) and 0 < out.count() < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
