import pytest
from paperloom.config import email, settings, verbose
from paperloom.operators.search import search_text
from paperloom.schemas import text_table
from paperloom.streaming.files import run_available, stream_counts, stream_matches, text_stream


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"p = .0{k} and p < .05") for k in range(6)] + [(9, None), (10, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = text_stream(spark, f"{tmp_path}/in")
    assert stream.isStreaming and stream_counts(stream, "p").columns == ["id", "matches"]
    found = stream_matches(stream, r"p\s*[<=]\s*\.\d+")
    run_available(found, f"{tmp_path}/out", f"{tmp_path}/state")
    batch = search_text(text_table(docs.selectExpr("CAST(doc_id AS STRING) AS id", "text")), r"p\s*[<=]\s*\.\d+", return_="match").select("id", "text")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 12 and out.exceptAll(batch).count() == 0
    docs.limit(1).write.mode("append").parquet(f"{tmp_path}/in")
    run_available(stream_matches(text_stream(spark, f"{tmp_path}/in"), r"p\s*[<=]\s*\.\d+"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out").count() in (12, 14)  # only what is new is read


def test_settings():
    assert verbose(False) is False and settings.verbose is False and verbose(True)
    assert email("a@b.org") == email() == "a@b.org"
    for call in (lambda: verbose("x"), lambda: email("nobody")):
        with pytest.raises(ValueError):
            call()
