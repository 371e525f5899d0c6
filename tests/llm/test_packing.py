import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sheetstorm.llm.packing import BestFit, cut, pack_documents, token_pieces

from .helpers import SF, odd_documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, docs, length=1024):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % length or length
        bounds = [0, *range(first, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want.append((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    got = pack_documents(docs, VOCABULARY, length=length).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences), sum(r.length for r in got)


def test_table_against_the_tokenizer(spark):
    sequences, tokens = check(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert sequences <= 1.02 * tokens / 1024 + 4


def test_odd_rows(spark):
    check(spark, odd_documents(spark), length=64)
    assert pack_documents(odd_documents(spark, []), VOCABULARY).count() == 0


def test_special_strings_are_taken_as_the_library_takes_them(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a  <|endoftext|><|endoftext|>  \n", "<|endoftext", " <|endoftext|>|>x"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    check(spark, docs)
    assert [50256 in r.ids for r in token_pieces(docs, VOCABULARY, with_ids=True).orderBy("doc_id").collect()] == [True, True, True, False, True]


def test_bounded_best_fit():
    bins = BestFit(10, 2)
    assert bins.put(6) == (0, 0) and bins.put(7) == (1, 0)
    assert bins.put(3) == (1, 7)  # the tightest
    assert bins.put(9) == (2, 0) and bins.put(5) == (3, 0)  # the fullest, with 9 of 10, has closed
    assert bins.put(1) == (0, 6) and bins.open == 2
    assert cut(10, 10) == [(0, 10)] and cut(25, 10) == [(0, 5), (5, 10), (15, 10)]
