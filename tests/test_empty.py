import duckdb

import __spark_entry__ as entry
from lectern.operators import chunking as C


def test_documents_without_an_id_have_something_to_say_if_they_have_chunks(spark, tmp_path):
    rows = [(None, "Text."), (None, "More."), (7, "Other."), (20, "Blanked."), (-10, "Blanked.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["c11_empty"](spark, str(tmp_path)).collect()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(duck.execute(entry.oracle_sql()["c11_empty"]).fetchall()) == [(-10, "nothing to say"), (20, "nothing to say")]


def test_documents_without_text_or_chunks_are_reported(spark):
    docs = spark.createDataFrame([(1,), (2,), (2,), (None,)], "doc_id long")
    chunks = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, chunk_idx int")
    assert sorted(map(str, (r.doc_id for r in C.without_chunks(docs, chunks).collect()))) == ["2", "2", "None"]
    assert [r.doc_id for r in C.without_chunks(docs, chunks.union(spark.createDataFrame([(None, 0), (2, 0)], chunks.schema))).collect()] == []
