import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sheetstorm.llm.filter_audit import audit_filters, copies, failures

from .helpers import SF

LETTERS = "ABCDE"


def brute_masks(docs):
    """docs: (doc_id, text, source). The failures of each row."""
    holders = defaultdict(set)
    for i, t, _ in docs:
        if i is not None:
            holders[t or ""].add(i)
    for i, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and any(j < i for j in holders[t]),
        )


def brute(docs, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for (i, _, source), failed in zip(docs, brute_masks(docs), strict=True):
        parts[source or ""].append((i, failed))
    out, shapley = {}, Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations(LETTERS)):
            left, gone = rows, []
            for step, x in enumerate(order, 1):
                k = LETTERS.index(x)
                removed, redundant = [r for r in left if r[1][k]], [r for r in gone if r[1][k]]
                left, gone = [r for r in left if not r[1][k]], gone + removed
                alone = [r for r in rows if r[1][k] and sum(r[1]) == 1]
                out[part, order, step] = [len(left), len(removed), len(redundant), len(alone), sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)]
                shapley[part, x] += len(removed)
    return {(*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def answers(docs, labels, **kw):
    rows = audit_filters(docs, labels, **kw).collect()
    return {(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}, len(rows)


LONG = " ".join(f"w{i}" for i in range(300))
ODD = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (3, None, None), (4, "", ""), (5, "   \n", None), (None, LONG, "a"), (None, "x", "a"), (6, "x", "a"), (7, LONG + " #", "b"), (8, LONG.upper(), "b"),
    (9, "same " * 300, "b"), (10, "same " * 300, "a"), (11, LONG[:-1] + "!", "a"), (12, "é \x1cA" * 400, "c"), (13, "long word " * 20_000, "c"), (14, LONG.replace("w299", "w298"), "a"), (15, LONG.replace("w0", "v0"), "a"),
]
ODD_LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (None, 1, 1), (6, 1, 0), (9, 0, 1), (99, 1, 1)]


def odd(spark, docs=ODD, labels=ODD_LABELS):
    d = spark.createDataFrame([(*x, 1, 2, "n") for x in docs], "doc_id long, text string, source string, mask int, n int, part string")
    return d, spark.createDataFrame([(*x, "q") for x in labels], "doc_id long, quality int, toxic int, part string")


def test_odd_rows(spark):
    want = brute(ODD, ODD_LABELS)
    assert answers(*odd(spark)) == (want, len(want))


def test_empty_tables(spark):
    assert answers(*odd(spark, [], ODD_LABELS)) == (set(), 0)
    want = brute(ODD, [])
    assert answers(*odd(spark, ODD, [])) == (want, len(want))


def test_colliding_hashes_join_no_texts(spark):
    masks = failures(odd(spark)[0], block_hash=lambda block: F.lit(1)).collect()
    want = [sum(f << i for i, f in enumerate(map(int, x))) for x in brute_masks(ODD)]
    assert Counter((r.doc_id, r.mask) for r in masks) == Counter((d[0], m) for d, m in zip(ODD, want, strict=True))


def test_copies_of_later_blocks_only(spark):
    """Texts that differ in their last character, in the second block or in the first are no copies."""
    base = "".join(chr(97 + i % 26) for i in range(3000))
    rows = [(1, base), (2, base[:-1] + "?"), (3, base[:500] + "?" + base[501:]), (4, "?" + base[1:]), (5, base), (6, base + "x"), (7, base)]
    found = copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.first_id for r in found] == [1]


@pytest.mark.parametrize("parts", [1, 7])
def test_real_documents(spark, parts):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").repartition(parts), spark.read.parquet(f"{SF}/labels.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert answers(docs, labels) == (want, len(want))
