"""Packing documents into training sequences: bounded-space best-fit over a bitset of free spaces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, with_text_ids
from .tokens import encoder

#: Open bins of one packer. With longer pieces first, a packer of up to this many bins closes none early.
OPEN_BINS = 65_536


class BestFit:
    """A fixed number of open bins in a bitset keyed by free space; when all are in use, the fullest closes."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.most = length, open_bins
        self.free = 0  # bit f is set while an open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.open = self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of this size."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            space, found = self.length, self.made
            self.made += 1
        if space > size:
            self.bins[space - size].append(found)
            self.free |= 1 << (space - size)
            self.open += 1
        return found, self.length - space

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return found


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of a document's pieces: only longer ones are cut, and what is over comes first."""
    first = total % length or length
    return [(0, first), *((at, length) for at in range(first, total, length))]


def token_pieces(
    docs: DataFrame, vocabulary: str, *, length: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece (and its ids, if asked for).

    A document is the ids of its text and end_id. The vocabulary's special tokens are taken as such where
    a text spells them out, as its library does without being told otherwise. Texts are tokenised where they are read, a batch at a
    time, and leave the task as pieces only. Null counts as empty: such a document is end_id alone.
    """
    kind = docs.schema[id_column].dataType
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_to_numpy
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text, allowed_special="all"), end_id).astype("<u4")
                for k, (start, size) in enumerate(cut(len(ids), length)):
                    own = ids[start : start + size]
                    rows.append((doc_id, k, start, size, zlib.crc32(own.tobytes()), *([own.astype("int32")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    rows = with_text_ids(docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs, text_column).alias("text")))
    return rows.mapInPandas(pieces, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def pack_pieces(pieces: DataFrame, *, length: int = 1024, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces (their column `length` is at most length).

    Pieces are dealt out evenly by hash; every packer takes its pieces from long to short, which leaves
    the short ones to fill the gaps. A packer holds at most open_bins bins, whatever it reads, and the
    same pieces in the same partition are packed alike when a task is run again.
    """
    key = ["doc_id", "piece", "ids_crc32"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = BestFit(length, open_bins)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.put(size) for size in batch["length"].tolist()]
            batch["sequence_id"] = np.array([base + b for b, _ in placed], dtype="int64")
            batch["offset"] = np.array([at for _, at in placed], dtype="int64")
            yield batch

    dealt = with_text_ids(pieces.repartition(*key).sortWithinPartitions(F.desc("length"), *key))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    packed = dealt.mapInPandas(pack, f"{fields}, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(pieces.schema["doc_id"].dataType))


def pack_documents(docs: DataFrame, vocabulary: str, *, length: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS, **columns: str) -> DataFrame:
    """Packs all documents into sequences of at most `length` tokens; one row per piece.

    doc_id, piece (from 0), start (the document's ids before it), length, ids_crc32 (of the piece's ids
    as little-endian unsigned 32-bit numbers), sequence_id and offset (gapless from 0 in its sequence).
    Repeated rows are packed as often as they occur, rows without an id like any other; an empty table
    gives no piece. Other columns of docs are ignored.
    """
    return pack_pieces(token_pieces(docs, vocabulary, length=length, end_id=end_id, **columns), length=length, open_bins=open_bins)
