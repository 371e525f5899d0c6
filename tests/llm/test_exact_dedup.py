import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sheetstorm.llm.exact_dedup import exact_dedup

from .helpers import odd_documents


def test_odd_rows(spark):
    rows = exact_dedup(odd_documents(spark), keep="largest").collect()
    assert len(rows) == 12
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert (by_id[1][0].keep_id, by_id[1][0].group_size, by_id[1][0].kept) == (2, 2, False)
    assert by_id[2][0].kept
    assert (by_id[3][0].keep_id, by_id[4][0].kept) == (4, True)
    assert sorted(r.kept for r in by_id[7]) == [False, True] and by_id[7][0].group_size == 2
    assert by_id[None][0].keep_id is None and by_id[None][0].kept
    assert by_id[3][0].text_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("keep,expected", [("smallest", 1), ("largest", 2)])
def test_colliding_hashes_do_not_join_texts(spark, keep, expected):
    rows = exact_dedup(odd_documents(spark), keep=keep, content_hash=lambda text: F.lit("same")).collect()
    assert len(rows) == 12 and sum(r.kept for r in rows) == 8 + 1
    assert {r.keep_id for r in rows if r.doc_id in (1, 2)} == {expected}


def test_empty_table(spark):
    assert exact_dedup(odd_documents(spark, [])).count() == 0
