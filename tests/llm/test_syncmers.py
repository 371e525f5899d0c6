import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from sheetstorm.llm.syncmers import PIECE, RUN, _next_of_buckets, compare_with_edits, fingerprint, with_anchors, with_joined_anchors, with_likeness

from .helpers import SF, odd_documents, texts


def murmur_of_longs(values, seed=42):
    """Murmur3 (32 bits) of longs one after another, as a signed number."""
    h = seed
    for v in values:
        for word in (v & 0xFFFFFFFF, v >> 32 & 0xFFFFFFFF):
            k = word * 0xCC9E2D51 & 0xFFFFFFFF
            k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
            h ^= k
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def syncmers(text, run=RUN):
    """(position, hash) of the closed syncmers, by their definition."""
    marks = re.findall(r"(?a:\S\s*)", text)
    pieces = []
    for i in range(len(marks) - PIECE + 1):
        h = 42
        for part in (*marks[i : i + PIECE - 1], marks[i + PIECE - 1][0]):
            h = xxhash.xxh64_intdigest(part.encode(), h)
        pieces.append(h - (1 << 64) if h >> 63 else h)
    if marks and not pieces:
        h = xxhash.xxh64_intdigest(text[len(text) - len(text.lstrip(" \t\n\r\f\v")) :].encode(), 42)
        pieces = [h - (1 << 64) if h >> 63 else h]
    if pieces and len(pieces) < run:
        return [(0, murmur_of_longs(pieces))]
    windows = [pieces[i : i + run] for i in range(len(pieces) - run + 1)]
    return [(i, murmur_of_longs(w)) for i, w in enumerate(windows) if min(w) in (w[0], w[-1])]


def likeness(a, b):
    x, y = {h for _, h in a}, {h for _, h in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_edits_and_likeness_against_brute_force(spark):
    known = texts(spark)
    ids = sorted(known)
    rows = {r.doc_id: r for r in compare_with_edits(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert sorted(rows) == ids
    closer = checked = 0
    for i, doc_id in enumerate(ids):
        text, after = known[doc_id], known[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        closer += r.near_edited > r.near_next
        if len(text) + len(after) > 12_000:
            continue
        checked += 1
        a, b, c = map(syncmers, (text, edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == tuple("".join(f"{h & 0xFFFFFFFF:08x}" for _, h in x) for x in (a, b))
        assert abs(r.near_edited - likeness(a, b)) < 1e-9 and abs(r.near_next - likeness(a, c)) < 1e-9
    assert closer > 0.95 * len(ids) and checked > 100


def test_fingerprint_against_brute_force(spark):
    got = {r.doc_id: [tuple(a) for a in r.anchors] for r in fingerprint(odd_documents(spark, [(1, "ab"), (2, "  a b\tcde f"), (3, "漢字かな🙂 naïve café " * 9), (4, "abc " * 40), (5, None), (6, " \n")])).collect()}
    assert got == {1: syncmers("ab"), 2: syncmers("  a b\tcde f"), 3: syncmers("漢字かな🙂 naïve café " * 9), 4: syncmers("abc " * 40), 5: [], 6: []}


def test_matching_by_position(spark):
    words = [f"word{i * 7919 % 1000}" for i in range(120)]
    whole, moved = " ".join(words), "something first. " + " ".join(words)
    rows = spark.createDataFrame([(1, whole, whole), (2, whole, moved), (3, whole, " ".join(reversed(words))), (4, "", ""), (5, whole, ""), (6, "a", "a"), (7, "a", "b")], "id long, a string, b string")
    both = with_anchors(with_anchors(rows, "a", "x"), "b", "y")
    got = {r.id: r.near for r in with_likeness(both, "x", "y", "near").collect()}
    assert got[1] == got[4] == got[6] == 1.0 and got[2] > 0.9 and got[3] < 0.3 and got[5] == got[7] == 0.0


def test_anchors_do_not_depend_on_context(spark):
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(60))
    docs = spark.createDataFrame([(1, passage), (2, "something else before. " + passage + " and after it")], "doc_id long, text string")
    one, two = (r.anchors for r in fingerprint(docs).orderBy("doc_id").collect())
    assert {a.hash for a in one} <= {a.hash for a in two} and len(one) > 5
    shift = {b.position - a.position for a in one for b in two if a.hash == b.hash}
    assert len(shift) == 1


def test_shifted_passages_without_spaces(spark):
    rng = random.Random(6)
    for letters in ([chr(0x4E00 + i) for i in range(2000)], [chr(0x0E01 + i) for i in range(40)], list("abcdefghij0123456789"), [chr(0x20000 + i) for i in range(500)]):
        passage = "".join(rng.choices(letters, k=120))
        docs = spark.createDataFrame([(i, letters[i] * i + passage) for i in range(4)] + [(4, passage[:60] + letters[0] + passage[60:])], "doc_id long, text string")
        first, *shifted, inserted = ({a.hash for a in r.anchors} for r in fingerprint(docs).orderBy("doc_id").collect())
        assert len(first) > 10 and all(first <= other for other in shifted)
        assert len(first & inserted) > 0.6 * len(first)


def test_odd_rows(spark):
    rows = compare_with_edits(odd_documents(spark)).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].fingerprint == by_id[3].fingerprint == by_id[5].fingerprint == "" and by_id[3].near_edited == 1.0
    assert len(by_id[6].fingerprint) == 8  # fewer than RUN pieces: one anchor
    assert by_id[None].near_next == 0.0 and RUN == 16
    assert compare_with_edits(odd_documents(spark, [])).count() == 0


def test_successors_over_wide_ids(spark):
    ids = [-(2**62), -5000, -1, 0, 1, 2047, 2048, 10**9, 10**15, 2**62]
    docs = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string")
    rows = {r.doc_id: r for r in compare_with_edits(docs).collect()}
    for i, doc_id in enumerate(ids):
        text, after = f"text of {doc_id}", f"text of {ids[(i + 1) % len(ids)]}"
        half = len(text) // 2
        assert rows[doc_id].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    spans = spark.createDataFrame([(i, i) for i in range(5)], "bucket long, first long")
    assert _next_of_buckets(spans, 0, 4).agg(F.count("next_first")).first()[0] == 5


def test_joined_anchors_at_every_cut(spark):
    """Anchors put together from those of both texts are those of the joined text, also around few pieces and much white space."""
    rng = random.Random(3)
    whole = ["", "  \n ", "ab", " a b\tc  ", "a" * 18, "b" * 19, "  x y " * 12, "漢字🙂 \x0b naïve\u00a0café " * 5, "".join(rng.choices("abc  \n🙂", k=90))]
    cuts = [(x[:i], x, y[:j], y) for x in whole for y in whole for i in {0, 1, 3, 17, 18, 19, 20, 38, len(x)} for j in {0, 2, 17, 18, 19, 37, len(y)} if i <= len(x) and j <= len(y)]
    rows = spark.createDataFrame(cuts, "first string, x string, second string, y string").withColumn("joined", F.concat("first", "second")).repartition(4)
    known = with_anchors(with_anchors(with_anchors(rows, "x", "of_x"), "y", "of_y"), "joined", "want")
    found = with_joined_anchors(known, "first", "of_x", "second", "of_y", "got").select("first", "second", "want", "got").collect()
    assert len(found) == len(cuts) > 1500
    assert [r for r in found if r.want != r.got] == []
