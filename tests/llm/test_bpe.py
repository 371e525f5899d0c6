import base64
import hashlib
import random
import re

import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.errors import PythonException

from sheetstorm.llm.bpe import ASCII_PATTERN, decode_bpe, encode_and_decode, encode_bpe, token_table

from .helpers import SF, odd_documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(spark, docs, library, **options):
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(r.text or "")
        assert library.decode(ids) == (r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r) for r in encode_and_decode(docs, RANKS, **options).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_table_against_the_library(spark, library):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"), library, block_bytes=50_000)


def test_odd_rows(spark, library):
    check(spark, odd_documents(spark), library)
    check(spark, odd_documents(spark, [(1, "don't <|endoftext|>   ١٢٣ 漢字かな 🙂🙂  \r\n\r\n x"), (2, ""), (3, " "), (3, " ")]), library)
    assert encode_and_decode(odd_documents(spark, []), RANKS).count() == 0
    check(spark, odd_documents(spark, [(1, None), (2, "")]), library)


def test_decoding_alone(spark):
    tokens = token_table(spark, RANKS)
    rows = spark.createDataFrame([(1, [31373, 995]), (2, []), (3, None), (4, [31373] * 25_000), (None, [995]), (4, [995])], "doc_id long, ids array<int>").coalesce(1)
    got = [(r.doc_id, len(r.ids), bytes(r.decoded)) for r in decode_bpe(rows, tokens).collect()]
    assert got == [(1, 2, b"hello world"), (2, 0, b""), (3, 0, b""), (4, 25_000, b"hello" * 25_000), (None, 1, b" world"), (4, 1, b" world")]
    with pytest.raises(PythonException, match="not in the token-byte table"):
        decode_bpe(spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>"), tokens).collect()
    assert encode_bpe(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), RANKS).first().ids == [31373, 995]


def test_patterns_agree():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices("aZs'dtrevml09 \t\n\r\x0b\x1c\x1f\x00.,<|>", k=rng.randint(0, 30)))
        assert re.findall(ASCII_PATTERN, text) == regex.findall(public_tokenizers.PATTERN, text)


def test_a_task_has_few_python_workers(spark):
    """All workers of an executor count against its memory: what puts ids together also lists them for decoding."""
    plan = encode_and_decode(odd_documents(spark), RANKS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 5
