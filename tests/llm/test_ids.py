"""Ids beyond the whole numbers of a double, beside rows without one."""

import public_tokenizers
import pytest

from sheetstorm.llm import bpe, katz, packing, quality, simhash, warc

LARGE = [2**62 + 1, 2**62 + 2, None]


@pytest.mark.parametrize("operator", ["encode", "score", "pack", "quality", "simhash", "warc"])
def test_large_ids(spark, operator):
    docs = spark.createDataFrame([(i, f"text number {k}") for k, i in enumerate(LARGE)], "doc_id long, text string")
    labels = spark.createDataFrame([(LARGE[0], 1), (LARGE[1], 0)], "doc_id long, quality int")
    if operator == "warc":
        pages = spark.createDataFrame([(i, "u", "same") for i in LARGE], "page_id long, url string, html string")
        rows = warc.archive_pages(pages).collect()
        assert {(r.page_id, r.refers_to) for r in rows} == {(LARGE[0], None), (LARGE[1], LARGE[0]), (None, LARGE[0])}
        return
    run = {
        "encode": lambda: bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")),
        "score": lambda: katz.score_documents(docs),
        "pack": lambda: packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")),
        "quality": lambda: quality.score_quality(docs, labels),
        "simhash": lambda: simhash.simhash_components(docs),
    }[operator]
    assert {r.doc_id for r in run().collect()} == set(LARGE)
