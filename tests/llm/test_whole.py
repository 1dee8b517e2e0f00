"""The order of the packed corpus, text of unclosed elements and ids of the added token."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docsafe.llm import _shared, html_extract, mixing, packing

SF = "/root/testdata/sf0.001"


def test_sequences_follow_the_curriculum_over_files(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ordered = [r["doc_id"] for r in mixing.curriculum(docs).collect()]
    # range files of falling and rising size: the largest is neither first nor last
    mixed = spark.createDataFrame([(d, f"{d} " * (400 if 3 * n > k > n else 2)) for n in [len(ordered) // 4] for k, d in enumerate(ordered)], "doc_id long, text string").coalesce(1)
    mixed = mixed.withColumn("k", F.monotonically_increasing_id()).repartitionByRange(8, "k").sortWithinPartitions("k").drop("k")
    mixed.write.parquet(f"{tmp_path}/mixed")
    pieces = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/mixed"), SF)
    assert [r["doc_id"] for r in pieces.where("start = 0").orderBy("sequence_id", "offset").collect()] == ordered


def test_pipeline_packs_in_order_of_position(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed = _shared.written(corpus_pipeline.mix(spark, spark.read.parquet(f"{SF}/documents.parquet").repartition(3), SF), "mixed")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(mixed.inputFiles()) > 1
    pieces = corpus_pipeline.pack(spark, mixed, SF).where("start = 0").orderBy("sequence_id", "offset").collect()
    ordered = [r["doc_id"] for r in mixing.curriculum(spark.read.parquet(f"{SF}/documents.parquet")).collect()]
    assert [r["doc_id"] for r in pieces] == ordered


@pytest.mark.parametrize("tag", ["noscript", "svg", "math", "iframe", "object", "canvas", "audio", "video", "template"])
def test_unclosed_elements_keep_the_page(tag):
    texts = lambda page: [b[0] for b in html_extract.blocks(page)]
    assert texts(f"<div><p>one</p><{tag}>two</div><p>three</p>") == ["one", "two", "three"]
    closed = ["one"] if tag == "template" else ["one", "x y" if tag != "math" else "xy"]
    assert texts(f"<p>one</p><{tag}>x</{tag}>" + ("" if tag == "template" else "y")) == closed


def test_quotes_open_values_only_after_an_equals_sign():
    texts = lambda page: [b[0] for b in html_extract.blocks(page)]
    assert texts("<img alt='Bob's house'><p>Lost text here.</p><p>It's more</p>") == ["Lost text here.", "It's more"]
    assert texts("<p title=\"a > b\" class = 'c>d'>text</p><a href='x") == ["text"]
    assert texts("<script>var a = '<p>no</p>'") == []


def test_packing_has_the_ids_of_the_json_form(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one  <|endoftext|> two", "<|endoftext|>", "a <|endoftext|><|endoftext|>\n\n b", "<|endoftext|", "plain  text "]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), with_ids=True).collect()
    want = {i: [*t.encode(x, add_special_tokens=False).ids, packing.SEPARATOR] for i, x in enumerate(texts)}
    assert {r["doc_id"]: r["ids"] for r in got} == want and 50256 in want[0]
