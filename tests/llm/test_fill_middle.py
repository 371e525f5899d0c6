import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetstorm.llm import fill_middle
from sheetstorm.llm.fill_middle import fill_in_middle, restored

from .helpers import ODD_TEXTS, SF, odd_documents, texts

WORD = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    words = WORD.findall(text)
    digits = hashlib.sha256(f"42:{doc_id if doc_id is not None else ''}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(words)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def found(df):
    made = fill_in_middle(df)
    rows = made.withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    return Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows)


def expected(rows):
    return Counter((i, *brute(i, t or ""), t or "") for i, t in rows)


MARKED = ["<P>", "a <M> b", "< S> fine", "<", "<<S", "end <P", "> <", "tab\tand\vvt\fff\rcr\nlf", "\x1c\x85 not space", "wide   space", "é\U0001f600 é", " lead", "trail ", " ", "a"]


def test_odd_rows_and_every_form(spark):
    rows = [(i, t) for i, t in enumerate(MARKED * 20)]
    assert found(odd_documents(spark, rows)) == expected(rows)
    assert {brute(i, t)[1] for i, t in rows} == {"plain", "psm", "spm"}


def test_odd_documents(spark):
    assert found(odd_documents(spark)) == expected(ODD_TEXTS)


def test_small_kernels_cut_between_rows(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "KERNEL_BYTES", 64)
    words = ["one two  three", "", "x" * 200, "<P>", "four\n"] * 5
    digits = np.arange(len(words), dtype=np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(digits), pa.array(words), *(pa.array(digits * k) for k in (1, 2, 0, 3))], ["doc_id", "text", "h1", "h2", "h3", "h4"])
    parts = list(fill_middle._parts(whole))
    assert sum(p.num_rows for p in parts) == len(words) and len(parts) > 5
    joined = pa.Table.from_batches([fill_middle._transform(p, 50, 80, fill_middle.MARKS) for p in parts]).to_pylist()
    assert joined == pa.Table.from_batches([fill_middle._transform(whole, 50, 80, fill_middle.MARKS)]).to_pylist()


def test_real_documents(spark):
    given = texts(spark)
    assert found(spark.read.parquet(f"{SF}/documents.parquet")) == expected(given.items())


def test_ids_of_text_and_empty_table(spark):
    df = spark.createDataFrame([("a", "some words here"), (None, None)], "doc_id string, text string")
    assert found(df) == expected([("a", "some words here"), (None, None)])
    assert fill_in_middle(odd_documents(spark, [])).count() == 0


def test_marks_must_be_findable(spark):
    with pytest.raises(ValueError):
        fill_in_middle(odd_documents(spark), marks=("<<", "<S>", "<M>"))
    other = fill_in_middle(odd_documents(spark), marks=("‹p", "›s", "«m"), percent=100)
    back = other.select("doc_id", restored(F.col("form"), F.col("output"), ("‹p", "›s", "«m")).alias("t")).collect()
    assert Counter((r.doc_id, r.t) for r in back) == Counter((i, t or "") for i, t in ODD_TEXTS)
