"""Exact top-k by integer inner product on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components become floor(SCALE * x). Vectors with an integer of MOST or more in size take no part: scores are longs.
SCALE, MOST = 1024, 1 << 26
#: Integers of vectors in a block of the index, and rows at most (both bound what a task holds).
BLOCK_VALUES, BLOCK_ROWS = 1 << 20, 1 << 14
#: Queries that are asked together, blocks that a lane holds on average.
QUERY_ROWS, LANE_BLOCKS = 256, 16
#: Bits that are kept of an attribute and of a query's weight; what is cut off widens the boundary that is resolved exactly.
SLICES, WEIGHT_BITS = 8, 9


def usable_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id (long) and vector (array of int) of the rows that take part."""
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST // SCALE))
    return rows.where(F.col("vec_id").isNotNull() & sound).withColumn("vector", F.transform("vector", lambda x: F.floor(x * SCALE).cast("int")))


def _blocks(rows: DataFrame, most_rows: int, most_values: int) -> DataFrame:
    """Rows packed into blocks of equal length of vectors: rows, width, ids (sorted) and values, as bytes of integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(width: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_pydict({"rows": [len(ids)], "width": [width], "ids": [ids[order].tobytes()], "values": [values[order].tobytes()]})

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = pa.concat_arrays([batch.column("vector")])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            whole = lists.flatten().to_numpy(zero_copy_only=False)
            widths = np.diff(ends)
            for width in np.unique(widths).tolist():
                most = max(1, min(most_rows, most_values // max(1, width)))
                own = np.flatnonzero(widths == width)
                while len(own):
                    room = most - sum(len(x) for x, _ in held.get(width, ()))
                    now, own = own[:room], own[room:]
                    held.setdefault(width, []).append((ids[now].astype(np.int64), whole[(ends[now][:, None] + np.arange(width))]))
                    if len(now) == room:
                        yield block(width)
        for width in list(held):
            yield block(width)

    return rows.mapInArrow(pack, "rows long, width long, ids binary, values binary")


@dataclass
class Sliced:
    """A block: sorted ids, integers, and of each attribute the lowest integer and the top bits of what is above it, as bitmaps."""

    ids: np.ndarray
    values: np.ndarray
    low: np.ndarray
    cut: int
    slices: np.ndarray  # attribute, bit (least significant first), words of 64 rows
    valid: np.ndarray


def _bitmap(flags: np.ndarray) -> np.ndarray:
    """Words of 64 rows each of a table of booleans; rows beyond the last are 0."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    fill = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, fill)])).view(np.uint64)


def slice_block(ids: np.ndarray, values: np.ndarray, bits: int = SLICES) -> Sliced:
    low = values.min(axis=0).astype(np.int64) if len(values) else np.zeros(values.shape[1], np.int64)
    above = values - low
    cut = max(0, int(above.max(initial=0)).bit_length() - bits)
    kept = (above >> cut).T
    slices = np.stack([_bitmap((kept >> bit) & 1 == 1) for bit in range(bits)], axis=1) if kept.size else np.zeros((len(low), bits, (len(ids) + 63) // 64), np.uint64)
    return Sliced(ids, values, low, cut, slices, _bitmap(np.ones(len(ids), dtype=bool)))


def _digits(weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(power, sign for each weight) of the signed binary digits of whole numbers, no two neighbours other than 0."""
    left, power = weights.copy(), 0
    while left.any():
        digit = np.where(left & 1, 2 - (left & 3), 0)
        yield power, digit
        left, power = (left - digit) >> 1, power + 1


def _add(columns: dict[int, list[np.ndarray]], words: int) -> np.ndarray:
    """The sum of bitmaps by power of two, as slices: three bitmaps of a power become one of it and one of the next."""
    found, power = [], 0
    while columns:
        stack = columns.pop(power, [])
        rows = np.concatenate(stack) if stack else np.zeros((0, words), np.uint64)
        while len(rows) > 1:
            third = len(rows) // 3
            if third:
                a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
                half = a ^ b
                total, carry = half ^ c, (a & b) | (half & c)
                rows = np.concatenate([total, rows[3 * third :]])
            else:
                total, carry = rows[:1] ^ rows[1:], rows[:1] & rows[1:]
                rows = total
            columns.setdefault(power + 1, []).append(carry)
        found.append(rows[0] if len(rows) else np.zeros(words, np.uint64))
        power += 1
    return np.array(found) if found else np.zeros((0, words), np.uint64)


def _kth_largest(sums: np.ndarray, among: np.ndarray, k: int) -> int:
    """The k-th largest of the sums of the rows in `among` (0 if they are fewer), from the most significant slice down."""
    value, sure, open_ = 0, 0, among
    for bit in range(len(sums) - 1, -1, -1):
        higher = open_ & sums[bit]
        count = int(np.bitwise_count(higher).sum())
        if sure + count >= k:
            open_, value = higher, value | 1 << bit
        else:
            sure, open_ = sure + count, open_ & ~sums[bit]
    return value


def _at_least(sums: np.ndarray, among: np.ndarray, bound: int) -> np.ndarray:
    """The rows of `among` whose sum is at least the bound."""
    if bound <= 0:
        return among
    if bound >> len(sums):
        return np.zeros_like(among)
    greater, equal = np.zeros_like(among), among
    for bit in range(len(sums) - 1, -1, -1):
        if bound >> bit & 1:
            equal = equal & sums[bit]
        else:
            greater = greater | (equal & sums[bit])
            equal = equal & ~sums[bit]
    return greater | equal


def search_block(block: Sliced, query_id: int, query: np.ndarray, k: int, floor: int | None = None, weight_bits: int = WEIGHT_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids): the k best rows of the block that score at least `floor`, but those with the query's own id.

    Sums of slices stand for scores up to an error of known size. The k-th largest sum and the floor tell
    which rows may be among the best: their scores are computed from the integers.
    """
    among = block.valid
    left, right = np.searchsorted(block.ids, [query_id, query_id + 1])
    if left < right:
        own = np.zeros(len(block.ids), dtype=bool)
        own[left:right] = True
        among = among & ~_bitmap(own)
    width = min(len(query), block.values.shape[1])  # a component that one of both lacks counts as 0
    weights = query[:width].astype(np.int64)
    cut = max(0, int(np.abs(weights).max(initial=0)).bit_length() - weight_bits)
    coarse = (weights + ((1 << cut) >> 1)) >> cut
    rest = weights - (coarse << cut)

    # score = 2**(cut + block.cut) * sum(coarse * kept) + sum(weights * low) + error, kept being 0 to top
    top, bits = (1 << block.slices.shape[1]) - 1, block.slices.shape[1]
    lowest = int((weights * block.low[:width]).sum())
    swing = (rest * top) << block.cut
    tail = weights * ((1 << block.cut) - 1)
    error_low = int(np.minimum(swing, 0).sum() + np.minimum(tail, 0).sum())
    error_high = int(np.maximum(swing, 0).sum() + np.maximum(tail, 0).sum())
    scale = cut + block.cut

    columns: dict[int, list[np.ndarray]] = {}
    offset = 0  # a negative digit adds the complement, top - kept
    for power, digits in _digits(coarse):
        plus, minus = block.slices[:width][digits > 0], ~block.slices[:width][digits < 0]
        offset += len(minus) * (top << power)
        both = np.concatenate([plus, minus])
        for bit in range(bits if len(both) else 0):
            columns.setdefault(power + bit, []).append(both[:, bit])
    sums = _add(columns, len(among))

    bound = _kth_largest(sums, among, k) - ((error_high - error_low) >> scale)
    if floor is not None:  # score <= 2**scale * (sum - offset) + lowest + error_high
        bound = max(bound, -(-(floor - lowest - error_high) >> scale) + offset)
    rows = np.flatnonzero(np.unpackbits(_at_least(sums, among, bound).view(np.uint8), bitorder="little"))
    scores = block.values[rows, :width].astype(np.int64) @ weights
    best = np.lexsort((block.ids[rows], -scores))[:k]
    return scores[best], block.ids[rows][best]


def build_index(vectors: DataFrame) -> tuple[DataFrame, str]:
    """Blocks of all vectors as a table in the shared folder, and its path. The rows are those of usable_vectors."""
    return written(_blocks(vectors, BLOCK_ROWS, BLOCK_VALUES), "bit-sliced-index")


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each row of queries (vec_id, vector) in an index of build_index.

    Blocks of the index are dealt to lanes by their hash, about LANE_BLOCKS to one; blocks of queries go to
    every lane, one after another, so that each block of the index travels once. A lane keeps the scores of
    the queries at hand only, and gives k rows for each; those of all lanes are ranked in the end.
    """
    spark = index.sparkSession
    count = index.count()
    lanes = max(1, min(count, max(spark.sparkContext.defaultParallelism, count // LANE_BLOCKS)))
    own = index.select("*", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"), F.lit(0).alias("asks"))
    asked = _blocks(queries.hint("rebalance"), QUERY_ROWS, BLOCK_VALUES).select("*", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(1).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, blocks = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["lane"] != lane:
                    lane, blocks = r["lane"], []
                ids, values = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["values"], np.int32).reshape(r["rows"], r["width"])
                if not r["asks"]:
                    blocks.append(slice_block(ids, values))
                elif blocks:
                    yield from (found for found in (_ask(blocks, i, x, k) for i, x in zip(ids.tolist(), values, strict=True)) if found)

    # A hash of the lane alone deals whole lanes to tasks; blocks of the index come before the queries.
    dealt = own.unionByName(asked).repartition(lanes, "lane").sortWithinPartitions("lane", "asks")
    found = dealt.mapInArrow(run, "query_id long, query binary, vec_id long, score long")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ask(blocks: list[Sliced], query_id: int, query: np.ndarray, k: int) -> pa.RecordBatch | None:
    """The k best rows of all blocks; what is found in one is the floor of the next."""
    scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block in blocks:
        more = search_block(block, query_id, query, k, int(scores[-1]) if len(scores) == k else None)
        scores, ids = np.concatenate([scores, more[0]]), np.concatenate([ids, more[1]])
        best = np.lexsort((ids, -scores))[:k]
        scores, ids = scores[best], ids[best]
    if len(ids):
        return pa.RecordBatch.from_arrays([pa.array([query_id] * len(ids)), pa.array([query.tobytes()] * len(ids)), pa.array(ids), pa.array(scores)], ["query_id", "query", "vec_id", "score"])


def top_k(vectors: DataFrame, *, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", asks: Column | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all rows for every row that `asks` (by vec_id: every hundredth).

    The score is the inner product of integers, floor(SCALE * component); ties go to the smaller id. The
    query's own id is no candidate. A vector that is null, or holds a null, a component that is not finite
    or one of 65,536 or more, takes no part, nor does a row without an id. A component that only one of two
    vectors has counts as 0. A row that is repeated is a candidate as often as it occurs; as a query it
    counts once. An empty table gives no row, other columns are ignored.
    """
    rows = usable_vectors(vectors, id_column, vector_column)
    asks = F.col("vec_id") % 100 == 0 if asks is None else asks
    index, _ = build_index(rows)
    return search(index, rows.where(asks).distinct(), k)
