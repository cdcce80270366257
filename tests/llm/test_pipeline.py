"""The pipeline on a small corpus with planted cases, against what each stage has to do."""

import corpus_pipeline
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from creatorlake.llm import byte_bpe

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    own = docs.filter(F.length("text") > 2000).limit(1).first()
    planted = [
        (900001, "Это другой язык, которого здесь нет. " * 30, "en", "src0", 1),
        (900002, own.text, own.lang, own.source, own.n_chars),
        (900003, "Thon reand the of. " * 3 + item + " Ofer than the erea.", "en", "src0", 1),
        (900004, "Thore than the on, erand in 10.20.30.40 the of eare thing of erandly.", "en", "src1", 1),
    ]
    sf = str(tmp_path / "sf")
    docs.union(spark.createDataFrame(planted, docs.schema)).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    now, left = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        left[name] = {r.doc_id: r for r in now.collect()}
    assert 900001 not in left["language_id"] and 900002 in left["language_id"]
    assert 900002 not in left["near_dedup"] and 900003 in left["near_dedup"]
    assert 900003 not in left["decontaminate"] and 900004 in left["decontaminate"]
    text = left["pseudonymise"][900004].text
    assert "10.20.30.40" not in text and text.startswith("Thore than the on")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for i, r in left["byte_bpe"].items():
        assert r.round_trip and r.ids == enc.encode_ordinary(left["pseudonymise"][i].text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(left["byte_bpe"])
