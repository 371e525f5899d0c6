"""Audit of filters that act together: what each removes in every order of application, and what copies do to it."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

WORDS, SPACES = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
#: Code points that the block hashes of copies end at, one after another; the last block is what is left of a text.
BLOCK_ENDS = (64, 1024, None)
#: Bits of the map of classes that are left in a round: 1,024 rows of 4,096 bytes, however many classes there are.
MAP_BITS, ROW_BITS = 1 << 25, 1 << 15


def too_short(text: Column, fewest: int = 200) -> Column:
    return F.regexp_count(text, F.lit(WORDS)) < fewest


def too_repetitive(text: Column, percent: int = 50) -> Column:
    """Fewer distinct words than that share of all."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def too_many_capitals(text: Column, percent: int = 2) -> Column:
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return 100 * capitals.cast("long") > percent * F.length(text)


def odd_signs(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[#$%&*|]"))


#: The filters of a text alone, in the order of their letters from A on; the last letter is for copies.
FILTERS = (too_short, too_repetitive, too_many_capitals, odd_signs)


def _with_class(rows: DataFrame, blocks: int, block_hash: Callable[[Column], Column]) -> DataFrame:
    """Adds class_id: the length in code points and the hashes of so many blocks, in one number."""
    parts, start = [F.length("text")], 1
    for end in BLOCK_ENDS[:blocks]:
        parts.append(block_hash(F.substring("text", start, (end or (1 << 31) - 1) - start + 1)))
        start = (end or 0) + 1
    return rows.withColumn("class_id", F.xxhash64(*parts))


def _left(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows whose class is in a table of classes, and few others: the map has a fixed size, so that it is broadcast."""
    place = lambda: F.pmod(F.col("class_id"), F.lit(MAP_BITS))
    row, bit = F.floor(place() / ROW_BITS).cast("int"), place() % ROW_BITS
    maps = classes.select(row.alias("__row"), bit.alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__map"))
    byte = F.conv(F.hex(F.substring("__map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(class_id, 8) as int))")) != 0
    return rows.join(F.broadcast(maps), F.floor(place() / ROW_BITS).cast("int") == F.col("__row")).where(is_set).drop("__row", "__map")


def copies(rows: DataFrame, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """class_id, text_key, first_id of every text (doc_id, text) that rows of different ids hold, by partition refinement.

    Texts are split by their length in code points, and again by the hash of each block in turn. Every round
    counts classes where the texts are read, so that copies leave a task once, and drops those of a single
    id; what is left filters the next reading. At last the whole texts of what survives are compared, byte by
    byte. A class that hashes join by chance is parted there, by the texts and by their SHA-256 (text_key).
    """
    span = (F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    left = rows
    for blocks in range(len(BLOCK_ENDS) + 1):
        classes = _with_class(left, blocks, block_hash).groupBy("class_id").agg(*span).where("first_id < last_id")
        left = _left(_with_class(rows, blocks, block_hash), classes).drop("class_id")
    whole = _with_class(left, len(BLOCK_ENDS), block_hash).groupBy("class_id", "text").agg(*span).where("first_id < last_id")
    return whole.select("class_id", F.unhex(F.sha2("text", 256)).alias("text_key"), "first_id")


def failures(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source", filters: tuple[Callable[[Column], Column], ...] = FILTERS, block_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """doc_id, part and mask of every row of docs: bit i for the i-th filter, the last bit for a copy of a row with a smaller id.

    Null texts and parts count as empty. A row without an id is no copy and makes none; rows that repeat an
    id and its text are copies only if another id below theirs has the text. Other columns are ignored.
    """
    rows = docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs, text_column).alias("text"), F.coalesce(docs[part_column].cast("string"), F.lit("")).alias("part"))
    texts = rows.select("doc_id", "text").where("doc_id is not null")
    found = copies(texts, block_hash)
    mask = sum((f(F.col("text")).cast("int") * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    judged = _with_class(rows, len(BLOCK_ENDS), block_hash).select("doc_id", "part", mask.alias("mask"), "class_id", F.unhex(F.sha2("text", 256)).alias("text_key"))
    both = judged.join(found, ["class_id", "text_key"], "left")
    is_copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return both.select("doc_id", "part", (F.col("mask") + is_copy.cast("int") * (1 << len(filters))).alias("mask"))


def count_masks(failed: DataFrame, labels: DataFrame, label_columns: dict[str, str], id_column: str = "doc_id") -> DataFrame:
    """part, mask, n and a count for each label (name -> column of labels that is 1): a row for each mask that occurs.

    A row of labels that repeats an id adds to what is known of it; rows without a label count in n alone.
    """
    marks = labels.where(labels[id_column].isNotNull()).groupBy(labels[id_column].alias("doc_id")).agg(*(F.max((labels[c] == 1).cast("int")).alias(name) for name, c in label_columns.items()))
    counts = [F.sum(F.coalesce(F.col(name), F.lit(0)).cast("long")).alias(name) for name in label_columns]
    return failed.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *counts)


def audit(masks: DataFrame, letters: str = "ABCDE", label_columns: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost of each label, shapley.

    A row for every part, order and step. Of each part one array is made, passing[s]: the documents that pass
    all filters of the set s. What a filter removes after those before it is the difference of two entries,
    so that no order looks at masks again; `shapley` sums that over all orders by the sets before it.
    """
    size = 1 << len(letters)
    passing = lambda c: F.array(*(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == 0, F.col(c)).otherwise(0)) for s in range(size)))
    alone = F.array(*(F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(len(letters))))
    tables = masks.groupBy("part").agg(passing("n").alias("n"), alone.alias("alone"), *(passing(c).alias(c) for c in label_columns))

    others = lambda i: [s for s in range(size) if not s >> i & 1]
    before_it = lambda s: factorial(s.bit_count()) * factorial(len(letters) - 1 - s.bit_count())  # noqa: E731  orders with that set before a filter
    shares = F.array(*(sum((F.lit(before_it(s)) * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | 1 << i))) for s in others(i)), F.lit(0)) for i in range(len(letters))))
    tables = tables.withColumn("shares", shares)

    steps = [(order, k + 1, letters.index(x), sum(1 << letters.index(y) for y in order[:k])) for order in map("".join, permutations(letters)) for k, x in enumerate(order)]
    listed = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "place", "before"), x, strict=True)) for x in steps])), "array<struct<filter_order: string, step: int, place: int, before: int>>")
    rows = tables.select("*", F.inline(listed))
    this = F.expr("shiftleft(1, place)")
    at = lambda c, s: F.get(c, s)
    after = F.col("before").bitwiseOR(this)
    lost = lambda c: at(c, F.col("before")) - at(c, after)
    return rows.select(
        "part", "filter_order", "step", at("n", after).alias("kept"), lost("n").alias("removed"), (at("n", F.lit(0)) - at("n", this) - lost("n")).alias("redundant"), at("alone", F.col("place")).alias("unique_fails"),
        *(lost(c).alias(f"{c}_lost") for c in label_columns), at("shares", F.col("place")).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """What the filters A to D (FILTERS) and E (copies of a smaller id) do to each part of docs in every order: see audit.

    Counts are of whole tables. An empty table of documents gives no row, an empty one of labels zeros.
    """
    return audit(count_masks(failures(docs, **columns), labels, {"good": "quality", "toxic": "toxic"}))
