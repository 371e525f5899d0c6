"""Fill-in-the-middle: texts cut at word borders into prefix, middle and suffix, and put in another order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that the kernel takes at once; a longer text is taken alone.
KERNEL_BYTES = 8 << 20
#: The class of a byte: white space or not. Bytes of longer code points are none.
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def fill_in_middle(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", seed: int = 42, percent: int = 50, suffix_first: int = 80, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """One row per row of docs: doc_id, n (its words), form, prefix_chars, middle_chars, output.

    A word is white space and what follows up to the next white space; white space at the end is one of its
    own. The SHA-256 of `seed:doc_id` gives four numbers: two choose the cuts among the n + 1 places, the
    third whether a text changes (`percent`), the fourth whether its suffix comes first (`suffix_first`).
    Texts that are empty or hold a mark stay plain: the output is the text, prefix and middle are null.
    Texts go once through Python, batch by batch and KERNEL_BYTES at a time; nothing is shuffled.

    Null counts as the empty text, a missing id as an empty one. Repeated rows give repeated rows, an empty
    table gives none; other columns of docs are ignored. Marks must begin with a character that no mark
    holds further on, so that restored() finds them.
    """
    if not all(marks) or any(mark[0] in other[1:] for mark in marks for other in marks) or any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < 3:
        raise ValueError("Marks must differ and begin with a character that no mark holds further on")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_column].cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(key, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs, text_column).alias("text"), *numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield _transform(part, percent, suffix_first, marks)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output came from. Marks are found from the left, as no text that was changed holds one."""
    before, suffix_mark, middle_mark = marks
    between = lambda a, b: F.substring_index(F.substring(output, F.locate(a, output) + len(a), F.length(output)), b, 1)
    rest = F.substring(output, F.locate(middle_mark, output) + len(middle_mark), F.length(output))
    psm = F.concat(between(before, suffix_mark), rest, between(suffix_mark, middle_mark))
    spm = F.concat(between(before, middle_mark), rest, between(suffix_mark, before))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most KERNEL_BYTES of text, one row at least."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(ends, before + KERNEL_BYTES, side="right")))
        yield batch.slice(at, until - at)
        at = until


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bytes and offsets (from 0) of texts, and the texts with those buffers."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    if texts.offset:
        texts = pa.array(texts.to_pylist(), pa.string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[: len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0], texts


def _holds(data: np.ndarray, offsets: np.ndarray, mark: bytes) -> np.ndarray:
    """Whether each text holds the mark, whole."""
    found = np.ones(max(0, len(data) - len(mark) + 1), dtype=bool)
    for i, byte in enumerate(mark):
        found &= data[i : i + len(found)] == byte
    at = np.flatnonzero(found)
    text = np.searchsorted(offsets, at, side="right") - 1
    return np.bincount(text[at + len(mark) <= offsets[text + 1]], minlength=len(offsets) - 1) > 0


def _transform(batch: pa.RecordBatch, percent: int, suffix_first: int, marks: tuple[str, str, str]) -> pa.RecordBatch:
    data, offsets, texts = _buffers(batch.column("text"))
    starts, ends = offsets[:-1], offsets[1:]
    h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5))

    # A word ends where other bytes meet white space, and where a text ends.
    space = IS_SPACE[data]
    word_end = np.zeros(len(data), dtype=bool)
    word_end[:-1] = ~space[:-1] & space[1:]
    word_end[ends[ends > starts] - 1] = True
    running = np.cumsum(word_end, dtype=np.int64)
    counted = np.concatenate([[0], running])
    before = counted[starts]
    n = counted[ends] - before

    cut = lambda k: np.where(k == 0, starts, np.searchsorted(running, before + k, side="left") + 1)
    a, b = h1 % (n + 1), h2 % (n + 1)
    first, second = cut(np.minimum(a, b)), cut(np.maximum(a, b))

    plain = (starts == ends) | (h3 % 100 >= percent)
    for mark in marks:
        plain |= _holds(data, offsets, mark.encode())
    form = np.where(plain, PLAIN, np.where(h4 % 100 < suffix_first, SPM, PSM))
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])

    # The three parts of every text lie one after another, so that new offsets over the same bytes are all that they need.
    borders = np.append(np.column_stack([starts, first, second]).ravel(), offsets[-1]).astype(np.int32)
    thirds = pa.StringArray.from_buffers(3 * len(n), pa.py_buffer(borders.tobytes()), pa.py_buffer(data))
    prefix, middle, suffix = (thirds.take(pa.array(np.arange(i, 3 * len(n), 3))) for i in range(3))
    p, s, m = marks
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(form == SPM), spm, psm))
    counts = [pa.array(letters[y] - letters[x], mask=plain) for x, y in ((starts, first), (first, second))]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), *counts, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
