"""Sources, sinks and streams."""

from pyspark.sql import functions as F

from corpusloom.functions import scores
from corpusloom.operators import methods
from corpusloom.sources import texts
from corpusloom.streaming import scores as stream


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("First file.\nTwo lines.")
    (tmp_path / "in/b.txt").write_text("Second.")
    (tmp_path / "in/c.md").write_text("no")
    rows = texts.directory(spark, str(tmp_path / "in"))
    assert sorted(r["file_name"] for r in rows.collect()) == ["a.txt", "b.txt"]
    assert texts.literal_or_path(spark, str(tmp_path / "in/a.txt")).first()["text"] == "First file.\nTwo lines."
    assert texts.literal_or_path(spark, "Just a text.").first()["text"] == "Just a text."
    done = methods.run_method(rows, "translation_chain")
    texts.write_named(done, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("file_name=*")) == ["file_name=processed_a.txt", "file_name=processed_b.txt"]
    texts.write_text(done, str(tmp_path / "plain"))
    assert spark.read.text(str(tmp_path / "plain")).count() >= 2
    body = done.select(texts.response_json(F.col("result"), F.col("method_used"), F.lit(1.2345)).alias("j")).first()["j"]
    assert '"processing_time_ms":1234' in body
    assert texts.trace(methods.standard_chain(rows), "file_name").count() == 8


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    made = stream.score_stream(stream.read_documents(spark, str(tmp_path / "in"), 1))
    stream.write_available(made, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = docs.select("doc_id", scores.stylometry(F.col("text"))["stat_score"].alias("w"))
    assert got.count() == docs.count() and got.join(want, "doc_id").where("stat_score <> w").count() == 0
