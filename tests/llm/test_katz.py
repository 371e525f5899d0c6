import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sheetstorm.llm import katz
from sheetstorm.llm.katz import DISCOUNTED, LEAST_LOSS, discounts, score_documents

from .helpers import SF, odd_documents


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b"</s>"]


class Brute:
    """The same model by plain dictionaries."""

    def __init__(self, rows):
        self.one, self.two = Counter(), Counter()
        for doc_id, text in rows:
            if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10:
                t = tokens(text)
                self.one.update(t)
                self.two.update(zip([b"<s>", *t[:-1]], t, strict=True))
        self.total, self.distinct = sum(self.one.values()), len(self.one)
        self.d1, self.d2 = (discounts([sum(c == r for c in n.values()) for r in range(1, DISCOUNTED + 2)]) for n in (self.one, self.two))
        self.unknown = 1 - sum(self.kept(c, self.d1) for c in self.one.values()) / self.total
        self.after = defaultdict(dict)
        for (v, w), c in self.two.items():
            self.after[v][w] = c

    @staticmethod
    def kept(c, d):
        return c - LEAST_LOSS if c > DISCOUNTED else c * d[c]

    def word(self, w):
        return self.kept(self.one[w], self.d1) / self.total if w in self.one else self.unknown

    def backoff(self, v):
        own = self.after[v]
        n = sum(own.values())
        return (1 - sum(self.kept(c, self.d2) for c in own.values()) / n) / (1 - sum(self.word(w) for w in own))

    def probability(self, w, v):
        if v not in self.after:
            return self.word(w)
        own = self.after[v]
        return self.kept(own[w], self.d2) / sum(own.values()) if w in own else self.backoff(v) * self.word(w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.probability(w, v)) for v, w in zip([b"<s>", *t[:-1]], t, strict=True))

    def base(self, text):
        return sum(math.log10((self.one[w] + 0.1) / (self.total + 0.1 * (self.distinct + 1))) for w in tokens(text))


def check(spark, docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    model = Brute(rows)
    for v in [b"<s>", *list(model.after)[:20]]:
        assert sum(model.probability(w, v) for w in model.one) + model.probability(None, v) == pytest.approx(1)
    key = lambda r: (str(r[0]), r[2])
    got = sorted((tuple(r) for r in score_documents(docs, **options).collect()), key=key)
    want = sorted(
        (
            (i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(tokens(t)), sum(w in model.one for w in tokens(t)), model.total, model.base(t), model.score(t))
            for i, t in rows
        ),
        key=key,
    )
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    return got


def test_table_against_brute_force(spark):
    rows = check(spark, spark.read.parquet(f"{SF}/documents.parquet"), block_bytes=100_000)
    held = [r for r in rows if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)  # closer to unseen text than the base


def test_more_buckets_send_no_more_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    sent = []
    for buckets in (16, 128):
        block = katz._Block()
        for r in docs.collect():
            block.add(str(r.doc_id), True, r.text or "")
        tokens_sent = sum(map(len, block.stream))
        parts = [katz._unpack(x) for frame in block.rows_for_buckets(frozenset(), buckets) for x in frame["payload"]]
        sent.append(sum(len(x["numbers"]) for x in parts if "numbers" in x))
        assert sent[-1] <= min(tokens_sent, 40 * buckets)
    monkeypatch.setattr(katz, "BUCKETS", 300)
    check(spark, docs)


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("a b", "one two"), (None, "two"), ("c\n", "")], "doc_id string, text string")
    assert {r.doc_id: r.n_tokens for r in score_documents(docs).collect()} == {"a b": 3, None: 2, "c\n": 1}


def test_odd_rows(spark):
    check(spark, odd_documents(spark))
    assert score_documents(odd_documents(spark, [])).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = score_documents(odd_documents(spark, [(alone, " a b")])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_discounts_stay_between_nought_and_one():
    for counts in ([100, 40, 20, 12, 8, 6], [0] * 6, [1, 1, 1, 1, 1, 1], [5, 0, 3, 0, 0, 9]):
        d = discounts(counts)
        assert all(0 < x < 1 for x in d[1:])
