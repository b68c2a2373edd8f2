from pyspark.sql import functions as F

import corpus_pipeline as cp


def test_stages_pass_documents_on(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = docs.select("doc_id").collect()
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf_dir).cache()
        if i + 1 < len(cp.STAGES):
            assert out.columns == columns, name
            ids = out.select("doc_id").collect()
            assert {r[0] for r in ids} <= {r[0] for r in kept} and len(ids) <= len(kept) and ids
            kept, docs = ids, out
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in kept}
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_odd_documents(spark, sf_dir):
    good = "The and of thing in there is a thought of the other and on it was with are for by " * 8
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "12 34", None, None, 5), (4, good, "en", "s", 9), (5, good, "en", "s", 9), (None, good + " a@b.org", "en", None, 9), (4, good, "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.language_id(spark, docs, sf_dir).collect()} == {4, 5, None}
    assert sorted(str(r.doc_id) for r in cp.near_dedup(spark, docs.where("text is not null"), sf_dir).collect()) == ["2", "3", "4", "None"]
    masked = {r.doc_id: r for r in cp.mask_personal_data(spark, docs, sf_dir).collect()}
    assert masked[None].text.endswith(" <email>") and masked[None].n_chars == len(masked[None].text) and masked[1].text is None
    assert cp.pack(spark, docs.where("false"), sf_dir).count() == 0


def test_quality_stage_keeps_rows_whole(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("extra"))
    odd = spark.createDataFrame([(None, None, None, None, None, "x"), (10**9, "", "en", "s", 0, "x"), (10**9, "word " * 5000, "en", "s", 0, "x")], own.schema)
    docs = own.unionByName(odd)
    out = cp.quality_filter(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert out.exceptAll(docs).count() == 0 and 0 < out.count() < docs.count()


def test_every_stage_takes_empty_tables_and_other_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("row", F.lit(1)).withColumn("component_id", F.lit("x"))
    for name, stage in cp.STAGES:
        out = stage(spark, docs.where("false"), sf_dir)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns, name


def test_run_applies_all_stages(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = out.collect()
    assert rows and {r.doc_id for r in rows} < docs
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
