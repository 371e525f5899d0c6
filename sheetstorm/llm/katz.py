"""Katz backoff language model: Good-Turing discounted bigrams over discounted words, scored document by document.

Documents are read in blocks. A block sends each bucket its bigrams whose last word belongs there, each
once, with the documents they occur in. A bucket so sees every count of its words and bigrams, and adds up
for each document what depends on them. What must be known of other buckets is kept apart until the end:
how many bigrams have each count (for the discounts) and what a context keeps for unseen words.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, short_lived_shuffles, text_or_empty, with_text_ids

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: The end of a text as a word; no word is empty.
END = b""
#: The context of a text's first word.
START = np.uint64(0)
#: Counts up to DISCOUNTED are discounted by Good-Turing; greater ones lose LEAST_LOSS, so that every
#: context keeps something for words that never followed it.
DISCOUNTED, LEAST_LOSS = 5, 0.01
#: Buckets of last words at least, tokens of a bucket beyond which there are more, and bytes of text in a block.
BUCKETS, BUCKET_TOKENS, BLOCK_BYTES = 128, 4_000_000, 1 << 24
#: A word with more than this share of a bucket's tokens is spread over all buckets by its context; HOT_WORDS bounds
#: how many such words the driver hands to the tasks.
HOT_SHARE, HOT_WORDS = 0.25, 1_000_000
ROW = "kind string, bucket int, block long, number long, context long, payload binary, n1 long, n2 long, n3 long, n4 long, n5 long, n6 long, value double"


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d[r] for r = 0 ... DISCOUNTED + 1 (the last: what a greater count keeps, less its LEAST_LOSS).

    Good-Turing with Katz's cutoff: d[r] = (r*/r - m) / (1 - m), r* = (r + 1) n[r+1] / n[r] and
    m = (k + 1) n[k+1] / n[1]. Where the counts of counts are too thin for 0 < d[r] < 1, a count loses
    LEAST_LOSS, as greater counts do.
    """
    n = [0, *counts_of_counts]
    k = DISCOUNTED
    out = np.ones(k + 1)
    m = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - m) / (1 - m) if n[r] and m < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - LEAST_LOSS / r
    return out


def kept(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discounted counts; nought stays nought."""
    counts = np.asarray(counts, dtype=float)
    return np.where(counts > DISCOUNTED, counts - LEAST_LOSS, counts * d[np.minimum(counts, DISCOUNTED).astype(int)])


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased words and the end."""
    return [*WORD.findall(text.encode("utf-8", "replace").lower()), END]


def _hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, 1) or 1 for w in words), dtype=np.uint64, count=len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pack(arrays: dict[str, np.ndarray | bytes]) -> bytes:
    import zstandard

    parts, table = [], {}
    for name, a in arrays.items():
        if isinstance(a, bytes):
            data, kind = a, "bytes"
        else:  # byte planes compress better
            data, kind = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), a.dtype.str
        parts.append(data)
        table[name] = [kind, len(data)]
    head = json.dumps(table).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + b"".join(parts))


def _unpack(payload: bytes) -> dict[str, np.ndarray | bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(payload)
    size = int.from_bytes(data[:4], "little")
    at, out = 4 + size, {}
    for name, (kind, n) in json.loads(data[4:at]).items():
        raw = data[at : at + n]
        at += n
        if kind == "bytes":
            out[name] = raw
        else:
            dtype = np.dtype(kind)
            out[name] = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype("<u2" if len(a) == 0 or a.max() < 1 << 16 else "<u4")


class _Block:
    def __init__(self):
        self.places: dict[bytes, int] = {}
        self.bytes = 0
        self.trains: list[bool] = []
        self.ids: list[str | None] = []
        self.keys: list[int] = []
        self.stream: list[np.ndarray] = []

    def add(self, doc_id: str | None, train: bool, text: str) -> None:
        import xxhash

        words = words_of(text)
        places = self.places
        self.bytes += len(text)
        self.ids.append(doc_id)
        self.keys.append(xxhash.xxh64_intdigest(f"{doc_id}:{text}".encode("utf-8", "replace")))
        self.trains.append(train)
        self.stream.append(np.fromiter((places.setdefault(w, len(places)) for w in words), dtype=np.int32, count=len(words)))

    def rows_for_buckets(self, hot: frozenset[bytes], buckets: int) -> Iterator[pd.DataFrame]:
        """A row with the block's documents, and one per bucket with what it needs of the bigrams that belong there.

        A bucket is told the numbers of the documents that it sees something of, and nothing of others,
        so that what is sent grows with the tokens and not with documents times buckets.
        """
        import xxhash

        name = xxhash.xxh64(np.array(self.keys, dtype="<u8").tobytes()).intdigest()
        yield pd.DataFrame({"bucket": [name % buckets], "payload": [_pack({"name": np.array([name], dtype="<u8"), "ids": json.dumps(self.ids).encode(), "trains": np.array(self.trains, dtype=np.uint8)})]})
        words = list(self.places)
        hashes = _hash(words)
        is_hot = np.fromiter((w in hot for w in words), dtype=bool, count=len(words))
        last = np.concatenate(self.stream)
        lengths = np.fromiter(map(len, self.stream), dtype=np.int64, count=len(self.stream))
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.stream, self.places = [], {}
        context = np.empty(len(last), dtype=np.uint64)
        context[1:] = hashes[last[:-1]]
        context[first] = START
        document = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        home = _mix(np.where(is_hot[last], context, hashes[last])) % np.uint64(buckets)
        order = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[order], np.arange(buckets + 1, dtype=np.uint64))
        trains = np.array(self.trains, dtype=np.uint8)
        for bucket in range(buckets):
            own = order[bounds[bucket] : bounds[bucket + 1]]
            if not len(own):
                continue
            local, place = np.unique(last[own], return_inverse=True)
            contexts, at = np.unique(context[own], return_inverse=True)
            pair, which, times = np.unique(at * len(local) + place, return_inverse=True, return_counts=True)
            by_pair = np.argsort(which, kind="stable")
            numbers, seen = np.unique(document[own][by_pair], return_inverse=True)
            arrays = {
                "name": np.array([name], dtype="<u8"),
                "words": b"\n".join(words[i] for i in local.tolist()),
                "contexts": contexts.astype("<u8"),
                "followers": np.bincount(pair // len(local), minlength=len(contexts)).astype("<u4"),
                "pair_word": (pair % len(local)).astype("<u4"),
                "times": _narrow(times),
                "documents": _narrow(seen),
                "numbers": _narrow(numbers),
                "trains": trains[numbers],
            }
            yield pd.DataFrame({"bucket": [bucket], "payload": [_pack(arrays)]})


def _bucket_results(payloads: list[bytes], bucket: int, model: dict) -> Iterator[pd.DataFrame]:
    """What a bucket finds: sums of documents (kind d), contexts (c), unseen bigrams (u), counts of counts (n). Documents (t) pass through."""
    words: dict[bytes, int] = {}
    pair_word, pair_context, times, documents = [], [], [], []
    of_rows: dict[str, list[np.ndarray]] = {"trains": [], "numbers": [], "names": []}
    size = 0
    for payload in payloads:
        x = _unpack(payload)
        if "ids" in x:
            yield _row(kind="t", bucket=bucket, payload=payload)
            continue
        x["names"] = np.full(len(x["numbers"]), x["name"][0], dtype="<u8")
        x["numbers"] = x["numbers"].astype("<i8")
        listed = x["words"].split(b"\n")
        number = np.fromiter((words.setdefault(w, len(words)) for w in listed), dtype=np.int64, count=len(listed))
        pair_word.append(number[x["pair_word"]])
        pair_context.append(np.repeat(x["contexts"], x["followers"]))
        times.append(x["times"].astype(np.int64))
        documents.append((x["documents"].astype(np.int64) + size).astype(np.int32))
        size += len(x["numbers"])
        for name, found in of_rows.items():
            found.append(x[name])
    if not size:
        return
    pair_word, pair_context, times, documents = map(np.concatenate, (pair_word, pair_context, times, documents))
    rows = {name: np.concatenate(found) for name, found in of_rows.items()}
    trains = rows["trains"].astype(bool)
    pair_of = np.repeat(np.arange(len(times), dtype=np.int32), times)
    order = np.lexsort((pair_context, pair_word))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (pair_word[order][1:] != pair_word[order][:-1]) | (pair_context[order][1:] != pair_context[order][:-1])
    group = np.empty(len(order), dtype=np.int32)
    group[order] = np.cumsum(new) - 1
    token_group = group[pair_of]
    trained = trains[documents]
    count = np.bincount(token_group[trained], minlength=int(new.sum()))
    word_count = np.bincount(pair_word[pair_of[trained]], minlength=len(words))
    for w, c in model["hot"].items():
        if w in words:
            word_count[words[w]] = c
    group_word, group_context = pair_word[order][new], pair_context[order][new]
    del pair_context
    total, distinct, d1 = model["total"], model["distinct"], model["d1"]
    base = np.log10((word_count + 0.1) / (total + 0.1 * (distinct + 1)))
    p1 = np.where(word_count > 0, kept(word_count, d1) / total, model["unknown"])
    log_p1 = np.log10(p1)

    del order, new
    seen = count[token_group] > 0
    value = np.where(seen, np.log10(np.maximum(np.where(count > DISCOUNTED, count - LEAST_LOSS, count), 1))[token_group], log_p1[pair_word[pair_of]])
    # As the context of what follows, a word divides by its count; of the unseen that is taken back in the context's own sum.
    ends = np.zeros(len(words), dtype=bool)
    ends[words.get(END, 0)] = END in words
    divide = np.where((word_count > 0) & ~ends, np.log10(np.maximum(word_count, 1)), 0.0)
    token_word = pair_word[pair_of]
    of_document = {
        "tokens": np.bincount(documents, minlength=size),
        "ends": np.bincount(documents[ends[token_word]], minlength=size),
        "known": np.bincount(documents[word_count[token_word] > 0], minlength=size),
        "base": np.bincount(documents, weights=base[token_word], minlength=size),
        "model": np.bincount(documents, weights=value - divide[token_word], minlength=size),
    }
    for r in range(1, DISCOUNTED + 1):
        of_document[f"r{r}"] = np.bincount(documents[count[token_group] == r], minlength=size)
    touched = of_document["tokens"] > 0
    block = {k: (v[touched] if v.dtype.kind == "f" else _narrow(v[touched])) for k, v in of_document.items()}
    yield _row(kind="d", bucket=bucket, payload=_pack(block | {name: v[touched] for name, v in rows.items()}))

    trained_group = count > 0
    names = ["n1", "n2", "n3", "n4", "n5", "n6"]
    capped = np.minimum(count[trained_group], DISCOUNTED + 1)
    exact = [int((count == r).sum()) for r in range(1, DISCOUNTED + 2)]
    yield _row(kind="n", bucket=bucket, **dict(zip(names, exact, strict=True)))
    contexts, at = np.unique(group_context[trained_group], return_inverse=True)
    frame = {"kind": "c", "context": contexts.view(np.int64), "value": np.bincount(at, weights=p1[group_word[trained_group]], minlength=len(contexts))}
    frame |= {name: np.bincount(at[capped == r + 1], minlength=len(contexts)) for r, name in enumerate(names)}
    yield _shaped(pd.DataFrame(frame))

    unseen = ~seen
    own, at = documents[unseen], group_context[token_group[unseen]]
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), dtype=bool), (own[1:] != own[:-1]) | (at[1:] != at[:-1])]))
    n = np.diff(np.append(starts, len(own)))
    yield _shaped(pd.DataFrame({"kind": "u", "block": rows["names"][own[starts]].view(np.int64), "number": rows["numbers"][own[starts]], "context": at[starts].view(np.int64), "n1": n}))


COLUMNS = [x.split()[0] for x in ROW.split(", ")]


def _row(**fields) -> pd.DataFrame:
    return _shaped(pd.DataFrame({k: [v] for k, v in fields.items()}))


def _shaped(frame: pd.DataFrame) -> pd.DataFrame:
    out = frame.reindex(columns=COLUMNS)
    whole = {c: "Int64" for c in ("block", "number", "context", "n1", "n2", "n3", "n4", "n5", "n6")} | {"bucket": "Int32"}
    return out.astype(whole).astype({"payload": object, "kind": object})


def score_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", folds: int = 10, held_out: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability) of every row.

    Tokens are the text's words with A-Z lower-cased and one end. Rows whose crc32 of the id's text
    leaves the remainder `held_out` are scored only, the others (and rows without an id) also teach.

    P(w | v) is the discounted count of v w over the count of v, or backoff(v) P(w) for bigrams that no
    taught text has; a text's first word has a context of its own. P(w) is the discounted count over all
    tokens, and what the discounts leave belongs to the unknown word; an unknown context gives P(w).
    backoff(v) makes the probabilities after v, the unknown word among them, add up to one exactly.
    Contexts are told apart by 64-bit hashes, last words by their text.

    Null and empty texts are an end alone. If no row teaches, all probabilities are one (scores 0) and
    train_tokens is 0. Rows that repeat an id are scored each by itself. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs, text_column).alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out
    rows = rows.withColumn("held_out", F.coalesce(fold, F.lit(False)))

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for text in batch["text"]:
                for w in words_of(text):
                    counts[w] = counts.get(w, 0) + 1
            if len(counts) > 1_000_000:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts = {}
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    words = rows.where(~F.col("held_out")).select("text").mapInPandas(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    exact = [F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)]
    folder = scratch(spark, "katz")
    with short_lived_shuffles(spark):
        words.write.option("compression", "zstd").parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    stats = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("n").alias("distinct"), *exact, F.count_if(F.col("n") > DISCOUNTED).alias("more")).first()
    total, distinct, counts = stats["total"], stats["distinct"], [stats[f"n{r}"] for r in range(1, DISCOUNTED + 2)]
    if not total:
        return rows.select("doc_id", "held_out", *_untaught())
    buckets = max(BUCKETS, -(-total // BUCKET_TOKENS))
    hot = {bytes(r["word"]): r["n"] for r in words.where((F.col("n") > max(int(HOT_SHARE * total / buckets), total // HOT_WORDS)) | (F.col("word") == F.lit(bytearray(END)))).collect()}
    d1 = discounts(counts)
    left = sum((1 - d1[r]) * r * counts[r - 1] for r in range(1, DISCOUNTED + 1)) + LEAST_LOSS * stats["more"]
    model = {"total": total, "distinct": distinct, "d1": d1, "unknown": left / total, "hot": hot}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, spread = _Block(), frozenset(hot)
        for batch in batches:
            for doc_id, test, text in zip(batch["doc_id"], batch["held_out"], batch["text"], strict=True):
                block.add(doc_id, not test, text)
                if block.bytes >= block_bytes:
                    yield from block.rows_for_buckets(spread, buckets)
                    block = _Block()
        if block.keys:
            yield from block.rows_for_buckets(spread, buckets)

    def gather(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(_bucket_results(parts["payload"].tolist(), int(key[0]), model)), ignore_index=True)

    dealt = with_text_ids(rows).mapInPandas(deal, "bucket int, payload binary")
    with short_lived_shuffles(spark):
        dealt.groupBy("bucket").applyInPandas(gather, ROW).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/bigrams")
    tables = spark.read.schema(ROW).parquet(f"{folder}/bigrams")

    names = [f"n{r}" for r in range(1, DISCOUNTED + 2)]
    found = tables.where("kind = 'n'").agg(*(F.sum(n).alias(n) for n in names)).first()
    d2 = discounts([found[n] or 0 for n in names])
    loss = sum((F.col(n) * float((1 - d2[r]) * r) for r, n in enumerate(names[:-1], 1)), F.col(names[-1]) * LEAST_LOSS)
    contexts = tables.where("kind = 'c'").groupBy("context").agg(*(F.sum(n).alias(n) for n in names), F.sum("value").alias("seen"))
    with short_lived_shuffles(spark):
        contexts.select("context", F.log10(loss / (1 - F.col("seen"))).alias("backoff")).write.option("compression", "zstd").parquet(f"{folder}/contexts")
    backoff = spark.read.parquet(f"{folder}/contexts")
    unseen = tables.where("kind = 'u'").select("block", "number", "context", "n1")
    unseen = unseen.join(backoff, "context").groupBy("block", "number").agg(F.sum(F.col("n1") * F.col("backoff")).alias("unseen"))

    sums = ["tokens", "ends", "known", "base", "model", *(f"r{r}" for r in range(1, DISCOUNTED + 1))]

    def spell_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                x = _unpack(payload)
                yield pd.DataFrame({"block": x["names"].view(np.int64), "number": x["numbers"]} | {n: x[n].astype(float) for n in sums})

    def name_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload in batch["payload"]:
                x = _unpack(payload)
                ids = json.loads(x["ids"])
                yield pd.DataFrame({"block": np.repeat(x["name"].view(np.int64), len(ids)), "number": np.arange(len(ids), dtype="int64"), "doc_id": pd.Series(ids, dtype=object), "held_out": x["trains"] == 0})

    parts = tables.where("kind = 'd'").select("payload").mapInPandas(spell_out, "block long, number long, " + ", ".join(f"{n} double" for n in sums))
    documents = tables.where("kind = 't'").select("payload").mapInPandas(name_documents, "block long, number long, doc_id string, held_out boolean")
    whole = parts.groupBy("block", "number").agg(*(F.sum(n).alias(n) for n in sums)).join(unseen, ["block", "number"], "left").join(documents, ["block", "number"])
    # Blocks of equal content share a name, and so do their documents: each has one end, so that the ends count the copies.
    log_d = [float(np.log10(d2[r])) for r in range(1, DISCOUNTED + 1)]
    seen = sum((F.col(f"r{r}") * log_d[r - 1] for r in range(1, DISCOUNTED + 1)), F.col("model"))
    start = float(np.log10(hot[END]))
    return whole.select(
        F.col("doc_id").cast(docs.schema[id_column].dataType).alias("doc_id"),
        "held_out",
        (F.col("tokens") / F.col("ends")).cast("long").alias("n_tokens"),
        (F.col("known") / F.col("ends")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("ends")).alias("base_score"),
        ((seen + F.coalesce("unseen", F.lit(0.0))) / F.col("ends") - start).alias("score"),
    )


def _untaught() -> list:
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return [(words + 1).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")]
