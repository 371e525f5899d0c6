"""Byte-level BPE through a global shuffle of distinct words.

Texts are cut into pre-tokens. Blocks of documents list each word once, with its place in the block's
list, and their documents as rows of places. The lists are shuffled by word, so that equal words of all
blocks meet and are encoded once; the ids go back to their blocks, where every row of places turns into
ids by position. Decoding lists each id of a run of documents once, joins the token-byte table, and puts
the bytes together by position.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back_memory, text_or_empty, with_text_ids
from .tokens import PATTERN, encoder, read_ranks

#: Bytes of text after which a block ends. Its list of words is all that a task holds of it.
BLOCK_BYTES = 1 << 25
#: Rows whose texts are Python strings at once.
TAKEN_ROWS = 256
#: Pre-tokens of a block's documents that travel, and are turned into ids, at a time.
ROW_PLACES = 200_000
#: Words whose ids a task packs for their blocks at a time.
PACKED_WORDS = 300_000
#: Ids of the documents that are decoded together.
DECODED_IDS = 250_000
#: PATTERN for texts of ASCII characters alone, for the faster module `re`.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Rows that blocks send: packed words of one home, or documents.
SENT = pa.schema([("home", pa.int32()), ("block", pa.int64()), ("words", pa.int32()), ("payload", pa.binary())])
SENT_SQL = "home int, block long, words int, payload binary"
#: The same rows where they arrive: words with their place in the block, and documents with a payload instead of a word.
ROWS = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("word", pa.string()), ("payload", pa.binary())])
ROWS_SQL = "block long, place int, word string, payload binary"
#: What comes together in a block again: first the ids of its words, then its documents.
IDS, DOCUMENTS = 0, 1
PARTS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
PARTS_SQL = "block long, kind int, payload binary"

#: Ids of a run of documents, each with its place in their list, and the documents.
LISTED = pa.schema([("place", pa.int32()), ("token", pa.int32()), ("payload", pa.binary())])
LISTED_SQL = "place int, token int, payload binary"

OTHER_ROWS = "the input gave other rows when a lost part was read again: write it to a table first"


class Block:
    """The words of a run of documents, each once, and the documents as places in that list."""

    def __init__(self):
        import xxhash

        self.places: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.digest = xxhash.xxh64()
        self.bytes = 0
        self.ids: list = []
        self.stream: list[np.ndarray] = []

    def add(self, doc_id, text: str, words: list[str]) -> None:
        data = text.encode("utf-8", "replace")
        self.digest.update(f"{doc_id}:{len(data)}:".encode() + data)
        self.bytes += len(data)
        self.ids.append(doc_id)
        self.stream.append(np.fromiter(map(self.places.__getitem__, words), dtype="<u4", count=len(words)))

    def rows(self, homes: int) -> Iterator[pa.RecordBatch]:
        """A row for each home of words, and one per ROW_PLACES places of documents. The block is named by its content."""
        name = int(np.uint64(self.digest.intdigest()).view(np.int64))
        data = [w.encode("utf-8", "replace") for w in self.places]
        home = np.fromiter((zlib.crc32(w) % homes for w in data), dtype=np.int64, count=len(data))
        order = np.argsort(home, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else ():
            payload = _pack_words([data[i] for i in own.tolist()], own)
            yield pa.RecordBatch.from_arrays([pa.array([int(home[own[0]])], pa.int32()), pa.array([name]), pa.array([len(own)], pa.int32()), pa.array([payload])], schema=SENT)
        first = held = 0
        for last, own in enumerate(self.stream, 1):
            held += len(own)
            if held >= ROW_PLACES or last == len(self.stream):
                payload = _pack_documents(self.ids[first:last], self.stream[first:last])
                yield pa.RecordBatch.from_arrays([pa.array([(name + first) % homes], pa.int32()), pa.array([name]), pa.array([0], pa.int32()), pa.array([payload])], schema=SENT)
                first, held = last, 0


def _pack_words(words: list[bytes], places: np.ndarray) -> bytes:
    import zstandard

    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    numbers = _planes(np.concatenate([np.diff(places, prepend=0), sizes]))
    return len(numbers).to_bytes(4, "little") + numbers + zstandard.ZstdCompressor(level=6).compress(b"".join(words))


def _unpack_words(payload: bytes, count: int) -> tuple[np.ndarray, list[str]]:
    import zstandard

    at = 4 + int.from_bytes(payload[:4], "little")
    numbers = _from_planes(payload[4:at]).astype(np.int64)
    data = zstandard.ZstdDecompressor().decompress(payload[at:])
    ends = np.cumsum(numbers[count:]).tolist()
    return np.cumsum(numbers[:count]), [data[a:b].decode("utf-8") for a, b in zip([0, *ends], ends, strict=False)]


def _arrived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, count, payload in zip(batch["block"].to_pylist(), batch["words"].to_pylist(), batch["payload"], strict=True):
            if count:
                places, words = _unpack_words(payload.as_py(), count)
                yield _rows(np.full(count, block), places.astype("int32"), words, pa.nulls(count, pa.binary()))
            else:
                yield _rows([block], [0], pa.nulls(1, pa.string()), [payload.as_py()])


def _rows(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROWS, strict=True)], schema=ROWS)


def _pack_documents(ids: list, parts: list[np.ndarray]) -> bytes:
    """Ids and numbers of places as text, and the places after it."""
    head = json.dumps([ids, [*map(len, parts)]]).encode()
    return len(head).to_bytes(4, "little") + head + _planes(np.concatenate(parts))


def _unpack_documents(payload: bytes) -> tuple[list, list[int], np.ndarray]:
    size = 4 + int.from_bytes(payload[:4], "little")
    return *json.loads(payload[4:size]), _from_planes(payload[size:])


def _cut(batches: Iterator[pa.RecordBatch], block_bytes: int, homes: int) -> Iterator[pa.RecordBatch]:
    import regex

    plain, find = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
    block = Block()
    for part in (batch.slice(at, TAKEN_ROWS) for batch in batches for at in range(0, batch.num_rows, TAKEN_ROWS)):
        for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
            block.add(doc_id, text, plain(text) if text.isascii() else find(text))
            if block.bytes >= block_bytes:
                yield from block.rows(homes)
                block = Block()
                give_back_memory()
    if block.ids:
        yield from block.rows(homes)
    del block
    give_back_memory()


def encode_bpe(docs: DataFrame, ranks: str, *, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and ids (array<int>) of every row; null counts as empty, an empty text has no ids.

    Texts are read once and are not shuffled themselves: only each block's distinct words, their ids on
    the way back, and the compressed places. Blocks are named by their content, so that a task that runs
    again after a loss makes the same blocks as long as docs gives its rows in a fixed order, as files
    do; otherwise the missing words are an error, never a wrong result. Repeated rows are returned as
    often as they occur; rows without an id like any other. Other columns of docs are ignored.
    """
    kind = docs.schema[id_column].dataType
    parts = _encoded_parts(docs, ranks, id_column, text_column, block_bytes)
    return parts.mapInArrow(_assemble, "doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast(kind))


def _encoded_parts(docs: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Ids of words and rows of places, those of a block in one partition and in the order that _assemble takes."""
    rows = with_text_ids(docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs, text_column).alias("text")))
    homes = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # words of one home travel packed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(batches, block_bytes, homes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(ranks).encode_ordinary
        last, ids = None, []
        blocks, places, found, held = [], [], [], 0
        for batch in batches:
            is_word = batch["word"].is_valid()
            documents, words = batch.filter(pc.invert(is_word)), batch.filter(is_word)
            if documents.num_rows:
                yield pa.RecordBatch.from_arrays([documents["block"], pa.array([DOCUMENTS] * documents.num_rows, pa.int32()), documents["payload"]], schema=PARTS)
            for word in words["word"].to_pylist():
                if word != last:  # sorted: equal words follow each other
                    last, ids = word, of(word)
                found.append(ids)
            blocks.append(words["block"].to_numpy())
            places.append(words["place"].to_numpy())
            held += words.num_rows
            if held >= PACKED_WORDS:
                yield from _pack_ids(np.concatenate(blocks), np.concatenate(places), found)
                blocks, places, found, held = [], [], [], 0
        if held:
            yield from _pack_ids(np.concatenate(blocks), np.concatenate(places), found)
        blocks, places, found = [], [], []
        give_back_memory()

    arrived = rows.mapInArrow(cut, SENT_SQL).repartition("home").mapInArrow(_arrived, ROWS_SQL)
    encoded = arrived.sortWithinPartitions("word").mapInArrow(encode, PARTS_SQL)
    return encoded.repartition("block").sortWithinPartitions("block", "kind")


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: small numbers compress well so."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(packed: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_ids(blocks: np.ndarray, places: np.ndarray, found: list[list[int]]) -> Iterator[pa.RecordBatch]:
    """A row per block: its number of words, their places (as steps), numbers of ids, and ids in one packed array."""
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int64, count=int(sizes.sum()))
    order = np.lexsort((places, blocks))
    blocks, places = blocks[order], places[order]
    flat, sizes = _gather(flat, np.cumsum(sizes) - sizes, sizes, order), sizes[order]
    bounds = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]]))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in itertools.pairwise(bounds.tolist()):
        payload = _planes(np.concatenate([[b - a], np.diff(places[a:b], prepend=0), sizes[a:b], flat[ends[a] : ends[b]]]))
        yield pa.RecordBatch.from_arrays([pa.array([int(blocks[a])]), pa.array([IDS], pa.int32()), pa.array([payload])], schema=PARTS)


def _gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The entries of the chosen words, one word after the other."""
    length = sizes[chosen]
    ends = np.cumsum(length)
    return flat[np.repeat(begins[chosen] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, its words before its documents: one block's words are held at a time."""
    block, parts, ready = None, [], None
    for batch in batches:
        for name, kind, payload in zip(batch["block"].to_pylist(), batch["kind"].to_pylist(), batch["payload"], strict=True):
            if name != block:
                block, parts, ready = name, [], None
            if kind == IDS:
                whole = _from_planes(payload.as_py())
                n, whole = int(whole[0]), whole[1:]
                parts.append((np.cumsum(whole[:n]), whole[n : 2 * n], whole[2 * n :].astype("int32")))
                continue
            if ready is None:
                ready = _lookup(parts)
            flat, begins, sizes = ready
            doc_ids, counts, places = _unpack_documents(payload.as_py())
            if len(places) and (places.max() >= len(begins) or (begins[places] < 0).any()):
                raise ValueError(OTHER_ROWS)
            ids = _gather(flat, begins, sizes, places)
            ends = np.cumsum([0, *counts])
            offsets = np.concatenate([[0], np.cumsum(sizes[places])])[ends].astype("int32")
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])


def _lookup(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a block's words, and by place where they begin (-1: no such word) and how many there are."""
    if not parts:
        return np.zeros(0, dtype="int32"), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    places, found, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
    sizes, begins = np.zeros(int(places.max()) + 1, dtype=np.int64), np.full(int(places.max()) + 1, -1, dtype=np.int64)
    sizes[places], begins[places] = found, np.cumsum(found, dtype=np.int64) - found  # blocks of equal content list their words twice, alike
    return flat, begins, sizes


def token_table(spark: SparkSession, ranks: str) -> DataFrame:
    """token (int) and token_bytes (binary): a row per id of a vocabulary, a fixed size."""
    return spark.createDataFrame([(rank, bytearray(token)) for token, rank in read_ranks(ranks).items()], "token int, token_bytes binary")


def decode_bpe(encoded: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, ids and decoded (binary: the ids' bytes) of rows with doc_id and ids (array<int>).

    Runs of documents explode each of their ids once, and these join the token-byte table, which is
    broadcast: a vocabulary has a fixed size. The join keeps the order of the exploded side, so that no
    shuffle is needed before the documents, which follow their ids, are put together by position. Ids
    that come out of their turn are an error, and so is one that the table doesn't have. Null ids count
    as none. Other columns are ignored.
    """
    kind = encoded.schema["doc_id"].dataType
    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return _decoded_lists(rows.mapInArrow(_list_ids, LISTED_SQL), tokens).withColumn("doc_id", F.col("doc_id").cast(kind))


def _decoded_lists(listed: DataFrame, tokens: DataFrame) -> DataFrame:
    joined = listed.join(F.broadcast(tokens.select("token", "token_bytes")), "token", "left").select("place", "token", "token_bytes", "payload")
    return joined.mapInArrow(_reassemble, "doc_id string, ids array<int>, decoded binary")


def _list_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per id of a run of documents, and then one with the documents as places in that list."""
    names, parts, held = [], [], 0

    def run() -> Iterator[pa.RecordBatch]:
        listed, places = np.unique(np.concatenate(parts), return_inverse=True)
        n = len(listed)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype="int32")), pa.array(listed.astype("int32")), pa.nulls(n, pa.binary())], schema=LISTED)
        ends = np.cumsum([len(x) for x in parts])[:-1]
        payload = _pack_documents(names, np.split(places, ends))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.nulls(1, pa.int32()), pa.array([payload])], schema=LISTED)

    for batch in batches:
        for name, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
            names.append(name)
            parts.append(ids.values.to_numpy())
            held += len(parts[-1])
            if held >= DECODED_IDS:
                yield from run()
                names, parts, held = [], [], 0
    if names:
        yield from run()
    names, parts = [], []
    give_back_memory()


def _assemble_and_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _list_ids(_assemble(batches))


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: list[np.ndarray] = []
    found: list[bytes] = []
    for batch in batches:
        for part in _at_payloads(batch):
            documents = part["payload"].is_valid().to_numpy(zero_copy_only=False)
            listed = part.slice(0, len(part) - int(documents.sum()))
            if listed["token_bytes"].null_count:
                raise ValueError("an id is not in the token-byte table")
            places = np.concatenate([[len(found) - 1], part["place"].to_numpy()])
            if (np.diff(places) != 1).any():
                raise ValueError("the exploded ids are out of order")
            tokens.append(listed["token"].to_numpy())
            found += listed["token_bytes"].to_pylist()
            if documents.any():
                yield _decoded(part["payload"][-1].as_py(), np.concatenate(tokens), found)
                tokens, found = [], []
    give_back_memory()


def _at_payloads(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, each up to a row with a payload."""
    ends = np.flatnonzero(batch["payload"].is_valid().to_numpy(zero_copy_only=False)) + 1
    for a, b in itertools.pairwise(sorted({0, *ends.tolist(), batch.num_rows})):
        yield batch.slice(a, b - a)


def _decoded(payload: bytes, tokens: np.ndarray, found: list[bytes]) -> pa.RecordBatch:
    names, counts, places = _unpack_documents(payload)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    data = _gather(np.frombuffer(b"".join(found), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes, places)
    ends = np.cumsum([0, *counts])
    offsets = np.concatenate([[0], np.cumsum(sizes[places])])[ends].astype("int32")
    texts = pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    ids = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(tokens[places]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), ids, texts], ["doc_id", "ids", "decoded"])


def encode_and_decode(docs: DataFrame, ranks: str, *, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256; see encode_bpe and decode_bpe.

    Ids are listed for decoding by the Python worker that puts them together: a task has two workers instead of
    three, and ids don't travel between them.
    """
    kind, spark = docs.schema[id_column].dataType, docs.sparkSession
    listed = _encoded_parts(docs, ranks, id_column, text_column, block_bytes).mapInArrow(_assemble_and_list, LISTED_SQL)
    decoded = _decoded_lists(listed, token_table(spark, ranks))
    return decoded.select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
