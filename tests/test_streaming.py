from churnloom.sources import files
from churnloom.streaming import enrich_stream


def test_stream_rows_equal_batch_rows(spark, mart, tmp_path):
    """Rows that need no duplicate removal get the same values from a stream."""
    source = str(tmp_path / "in")
    files.write_table(mart.raw.where("src_seq = 0"), source)
    stream = spark.readStream.schema(mart.raw.schema).parquet(source)
    enriched = enrich_stream(stream, mart.cleaned.imputation, mart.cleaned.clipping, mart.cuts)
    query = (enriched.writeStream.format("memory").queryName("enriched").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(str, spark.table("enriched").select(*mart.table.columns).collect()))
    assert got == sorted(map(str, mart.table.collect()))
