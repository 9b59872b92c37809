import math
import zlib

import duckdb
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lectern.llm import catalog
from tests.llm import plain
from tests.llm.test_near_copies import brute

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").toPandas()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    _, good, _ = plain.quality(list(zip(docs["text"], docs["lang"], docs["source"])))
    docs = docs[good]
    assert 0 < len(docs) < len(good)
    first = brute(list(zip(docs["doc_id"], docs["text"])))
    docs = docs[docs["doc_id"].isin([i for i, least in first if i == least])]
    docs = docs[[not any(plain.share_found(r.text, t) for r in items) for t in docs["text"]]]
    con = duckdb.connect()
    con.register("documents", docs)
    mix = con.sql(catalog.ORACLES["op2_mixing"]).df()
    times = {}
    for r in mix.itertuples():
        whole = math.floor(r.target / r.source_size)
        extra = r.taken - whole * r.size
        times[r.doc_id] = whole + (extra > 0 and 2 * extra >= r.size)
    tk, at, want = Tokenizer.from_file(catalog.tokenizer_path()), 0, []
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 2], "<u4")
        for _ in range(times[i]):
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    out = corpus_pipeline.run(spark, SF).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out] == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_take_nulls_and_clashing_names(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
