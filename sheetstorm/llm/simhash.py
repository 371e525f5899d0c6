"""Near-duplicates: SimHash fingerprints, meet-in-the-middle ball hashing, components; verified groups by prefix filter."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, forget, short_lived_shuffles, text_or_empty, with_text_ids, written
from .components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Variants are dealt to 2 ** BUCKET_BITS buckets or more.
BUCKET_BITS = 7
#: Fingerprints that one bucket takes at most; a task holds about 30 bytes of each.
BUCKET_ROWS = 16_000_000
#: Rows of ids (16 bytes each) that are broadcast; more are joined by shuffling.
BROADCAST_NODES = 200_000
#: Variants that a task holds at once (about 20 bytes each).
HELD_VARIANTS = 3_000_000
#: Documents by which common shingles are found, and how many of these; neither changes a result.
SAMPLED_DOCS = 10_000
COMMON_SHINGLES = 20_000
#: Parts of the hash space in which a text's shingles are counted.
COUNTS = 256
#: Sharers of a shingle that are compared in one task at a time.
SHARERS = 2048


def shingles(text: str, words: int) -> list[bytes]:
    """The word shingles of a text with A-Z lower-cased, repeats included; a shorter text is one shingle."""
    found = WORD.findall(text.encode("utf-8", "replace").lower())
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(words, len(found)) - 1
    return [joined[a:b] for a, b in zip(starts[: len(found) - last].tolist(), ends[last:].tolist(), strict=True)]


def simhash(features: list[bytes], seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the features' XXH64; no feature gives zero."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(x, seed) for x in features), dtype="<u8", count=len(features)))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 100_000):
        counts += np.unpackbits(hashes[at : at + 100_000].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, words: int = 4, seeds: tuple[int, ...] = (42,), distinct: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and one 64-bit fingerprint for each seed: f0, f1, ... (long, the bits of the unsigned number)."""
    names = [f"f{i}" for i in range(len(seeds))]
    kind = docs.schema[id_column].dataType

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                features = shingles(text, words)
                if distinct:
                    features = list(dict.fromkeys(features))
                rows.append([simhash(features, seed) for seed in seeds])
            out = pd.DataFrame(np.array(rows, dtype=np.uint64).reshape(-1, len(seeds)).view(np.int64), columns=names)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    rows = docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs, text_column).alias("text"))
    found = with_text_ids(rows).mapInPandas(compute, "doc_id string, " + ", ".join(f"{n} long" for n in names))
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks of at most `radius` bits."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(64), r)], dtype=np.uint64)


def _parity_rows(bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, size=bits, dtype=np.uint64)


def _class_of(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """A linear hash: bit i is the parity of the value's bits under mask i, so that hash(x ^ y) is hash(x) ^ hash(y)."""
    out = np.zeros(len(values), dtype=np.int64)
    for i, row in enumerate(rows):
        out |= (np.bitwise_count(values & row).astype(np.int64) & 1) << i
    return out


def _class_column(value: Column, rows: np.ndarray) -> Column:
    out = F.lit(0).cast("long")
    for i, row in enumerate(rows.view(np.int64).tolist()):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(row))).cast("long").bitwiseAND(F.lit(1)), i))
    return out


def _collisions(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of owners that share a value with another: each paired with the smallest position there."""
    order = np.argsort(values)
    ordered = values[order]
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    if not len(same):
        return same, same
    in_run = np.unique(np.concatenate([same, same + 1]))
    begins = np.flatnonzero(np.concatenate([[True], ordered[in_run[1:]] != ordered[in_run[:-1]]]))
    members = owners[order[in_run]]
    return np.repeat(np.minimum.reduceat(members, begins), np.diff(np.append(begins, len(members)))), members


def linked_fingerprints(values: DataFrame, *, radius: int = 4) -> DataFrame:
    """Pairs a < b of fingerprints that link everything within `radius` bits: verified, and enough for components.

    values has one long column, fingerprint, without repeats. Two fingerprints within the radius share a
    variant within half of it. Variants are shuffled on a linear hash of theirs: as the hash of a variant
    is the hash of the fingerprint xor the hash of the flipped bits, a fingerprint goes to a bucket once,
    together with the class of flips that lead there, and the bucket makes just these variants. That
    ships all 2,081 variants of a fingerprint as 128 rows. A bucket works through its variants by further
    bits of the hash, at most about HELD_VARIANTS at a time. It gets its fingerprints sorted and as a
    stream, and holds about 30 bytes of each: up to BUCKET_ROWS fingerprints every bucket sees all of
    them; above there are more buckets, which then see only part, and a fingerprint travels up to 2,081
    times, as the method has it.

    All fingerprints that share a variant are within the radius of each other, so that each is paired
    with the smallest of them only: a group of n copies gives about n pairs a variant, not n squared.
    """
    flips = ball((radius + 1) // 2)
    count = values.count()
    bits = BUCKET_BITS
    while count > BUCKET_ROWS and (1 << bits) * BUCKET_ROWS < count * len(flips):
        bits += 1
    rows = _parity_rows(bits, 1)
    flip_class = _class_of(flips, rows)
    classes = sorted(set(flip_class.tolist()))
    by_class = {c: flips[flip_class == c] for c in classes}

    dealt = values.select("fingerprint", F.explode(F.array(*(F.lit(c).cast("long") for c in classes))).alias("flips")).withColumn(
        "bucket", _class_column(F.col("fingerprint"), rows).bitwiseXOR(F.col("flips"))
    )

    def collide(own: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
        parts = 0
        while len(own) * len(flips) / len(classes) / (1 << parts) > HELD_VARIANTS:
            parts += 1
        finer = _parity_rows(parts, 2)
        own_part = _class_of(own, finer)
        found = []
        groups = {(k, p): np.flatnonzero((kinds == k) & (own_part == p)) for k in np.unique(kinds).tolist() for p in np.unique(own_part[kinds == k]).tolist()}
        masks = {k: by_class[k] for k in np.unique(kinds).tolist()}
        mask_part = {k: _class_of(m, finer) for k, m in masks.items()}
        for part in range(1 << parts):
            made, owners = [], []
            for (k, p), at in groups.items():
                flip = masks[k][mask_part[k] == (part ^ p)]
                if len(flip):
                    made.append((own[at][:, None] ^ flip[None, :]).ravel())
                    owners.append(np.repeat(at, len(flip)))
            if made:
                least, members = _collisions(np.concatenate(made), np.concatenate(owners))
                keep = least != members
                found.append(np.unique(least[keep] * len(own) + members[keep]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        signed = own.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[pairs // max(1, len(own))]), pa.array(signed[pairs % max(1, len(own))])], ["a", "b"])

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            numbers, own, kinds = (batch[c].to_numpy() for c in ("bucket", "fingerprint", "flips"))
            bounds = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1], [True]]))
            for x, y in itertools.pairwise(bounds.tolist()):
                if numbers[x] != bucket and held:
                    yield collide(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                bucket = numbers[x]
                held.append((own[x:y].view(np.uint64), kinds[x:y].astype(np.uint16)))
        if held:
            yield collide(*map(np.concatenate, zip(*held, strict=True)))

    pairs = dealt.repartition("bucket").sortWithinPartitions("bucket", "fingerprint").mapInArrow(by_bucket, "a long, b long")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(docs: DataFrame, *, words: int = 4, radius: int = 4, seed: int = 42, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Texts have A-Z lower-cased and are cut at ASCII white space into shingles of `words` words, repeats
    included; a bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64. Documents
    link at `radius` or fewer differing bits, and component_id is the smallest doc_id that links reach.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows without an id take
    part and get the smallest id of their component, null if it has none. Copies meet in one fingerprint
    before any comparison. Repeated rows are returned as often as they occur; other columns are ignored.
    """
    rows = durable(fingerprints(docs, words=words, seeds=(seed,), id_column=id_column, text_column=text_column))
    least = durable(rows.groupBy(F.col("f0").alias("fingerprint")).agg(F.min("doc_id").alias("least_id")))
    links = connected_components(linked_fingerprints(least.select("fingerprint"), radius=radius))
    labelled = least.join(links.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ids = durable(durable(labelled.select("fingerprint", "component")).join(durable(smallest), "component").select(F.col("fingerprint").alias("f0"), "component_id"))
    return rows.join(ids, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _hashes(text: str, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    import xxhash

    found = shingles(text, words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found)))


def _shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """node and the distinct hashes of the text's word shingles."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[at : at + 500] for at in range(0, len(batch), 500)):
                yield pd.DataFrame({"node": part["node"], "shingles": [_hashes(t, words).view(np.int64) for t in part["text"]]})

    return docs.mapInPandas(compute, "node long, shingles array<long>")


def _common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of the commonest shingles of about SAMPLED_DOCS documents, the commonest last.

    They only order what `_sketches` takes: any list gives the same groups, a good one fewer candidates.
    """
    every = max(1, docs.count() // SAMPLED_DOCS)
    sets = _shingle_sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select(F.col("doc_id").alias("node"), "text"), words)
    counts = sets.select(F.explode("shingles").alias("token")).groupBy("token").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "token").limit(COMMON_SHINGLES).collect()
    return np.array([r["token"] for r in reversed(rows)], dtype=np.int64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Half a byte for each count, or one, or four, by the largest."""
    most = counts.max()
    if most < 16:
        small = counts.astype(np.uint8)
        return (small[::2] << 4 | small[1::2]).tobytes()
    return counts.astype("<u1" if most < 256 else "<u4").tobytes()


def _unpack_counts(packed: bytes) -> np.ndarray:
    if len(packed) > COUNTS // 2:
        return np.frombuffer(packed, dtype="<u1" if len(packed) == COUNTS else "<u4")
    halves = np.frombuffer(packed, dtype=np.uint8)
    return np.stack([halves >> 4, halves & 15], axis=1).ravel()


def _sketches(docs: DataFrame, words: int, similarity: float, common: np.ndarray) -> DataFrame:
    """What is kept of each text: node (a number), n (its distinct shingles), fingerprint, counts and prefix.

    counts has the number of its shingle hashes in each of COUNTS parts: what two texts have in common is
    at most the sum of the lesser counts. prefix has so many of its rarest shingles that similar texts
    share one: sets of n and m shingles at the similarity share that part of both n and m; whatever the
    order, one of these is then among the first n - ceil(similarity * n) + 1 of the one set and the like
    of the other. Texts without words have the prefix 0.
    """
    order = np.argsort(common)
    ordered = common[order]

    def sketch(text: str) -> tuple[int, int, bytes, np.ndarray]:
        found = _hashes(text, words)
        n = len(found)
        counts = np.bincount((found % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS)
        packed = _pack_counts(counts)
        signed = found.view(np.int64)
        rank = np.zeros(n, dtype=np.int64)
        if len(ordered):
            place = np.minimum(np.searchsorted(ordered, signed), len(ordered) - 1)
            rank = np.where(ordered[place] == signed, order[place] + 1, 0)
        prefix = signed[np.lexsort((signed, rank))][: n - math.ceil(similarity * n - 1e-6) + 1] if n else np.zeros(1, dtype=np.int64)
        return n, majority(found), packed, prefix

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[at : at + 500] for at in range(0, len(batch), 500)):
                n, fingerprint, counts, prefix = zip(*map(sketch, part["text"]), strict=True)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "version": part["version"], "n": np.array(n, dtype="int32"), "fingerprint": np.array(fingerprint, dtype=np.uint64).view(np.int64), "counts": counts, "prefix": prefix,
                })

    made = docs.mapInPandas(compute, "doc_id long, version long, n int, fingerprint long, counts binary, prefix array<long>")
    return made.withColumn("node", F.monotonically_increasing_id())


def _groups_of(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by it; one key's rows are held at a time."""
    last, held = None, []
    for batch in batches:
        columns = [batch[k].to_numpy() for k in keys]
        changes = np.any([c[1:] != c[:-1] for c in columns], axis=0) if batch.num_rows > 1 else np.zeros(0, dtype=bool)
        for x, y in itertools.pairwise([0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]):
            key = tuple(c[x] for c in columns) if y > x else last
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _counts_of(group: pa.Table, sizes: np.ndarray) -> np.ndarray:
    """A column of counts for each text: sums over them then run along the memory."""
    kind = np.uint16 if sizes.max() < 1 << 16 else np.uint32
    rows = [_unpack_counts(x) for x in group["counts"].to_pylist()]
    return np.ascontiguousarray(np.stack(rows, axis=1).astype(kind))


def _likely(counts: np.ndarray, sizes: np.ndarray, at: int, similarity: float) -> np.ndarray:
    """The similarity that each text can have with the one at this place at most; -1 where that is too little."""
    common = np.minimum(counts, counts[:, at, None]).sum(axis=0, dtype=counts.dtype).astype(np.int64)
    either = sizes + sizes[at] - common
    return np.where(common >= similarity * either - 1e-6, common / np.maximum(either, 1), -1.0)


def _likely_forest(group: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Pairs that connect all sharers which can be similar, the likeliest first."""
    nodes, sizes = group["node"].to_numpy(), group["n"].to_numpy().astype(np.int64)
    counts = _counts_of(group, sizes)
    left = np.ones(len(nodes), dtype=bool)
    best, to, at, pairs = np.full(len(nodes), -1.0), np.zeros(len(nodes), dtype=np.int64), 0, []
    left[0] = False
    for _ in range(len(nodes) - 1):
        near = _likely(counts, sizes, at, similarity)
        better = left & (near > best)
        best[better], to[better] = near[better], at
        at = int(np.where(left, best, -2.0).argmax())
        left[at] = False
        if best[at] >= 0:
            pairs.append((int(nodes[to[at]]), int(nodes[at])))
    return pairs


def _likely_pairs(group: pa.Table, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of different components that can be similar, each at the smallest token that its two texts share."""
    token, low, high = (group[c][0].as_py() for c in ("token", "low", "high"))
    tokens = [frozenset(x) for x in group["tokens"].to_pylist()]
    nodes, sizes = group["node"].to_numpy(), group["n"].to_numpy().astype(np.int64)
    components, parts = group["component"].to_numpy(), group["part"].to_numpy()
    counts = _counts_of(group, sizes)
    for at in np.flatnonzero(parts == low).tolist():
        met = (components != components[at]) & (np.minimum(sizes, sizes[at]) >= similarity * np.maximum(sizes, sizes[at]) - 1e-6)
        met &= (np.arange(len(nodes)) > at) if low == high else parts == high
        others = np.flatnonzero(met)
        if not len(others):
            continue
        if 4 * len(others) > len(nodes):
            near = others[_likely(counts, sizes, at, similarity)[others] >= 0]
        else:
            few = np.append(others, at)
            near = others[_likely(counts[:, few], sizes[few], len(others), similarity)[:-1] >= 0]
        for other in near.tolist():
            if min(tokens[at] & tokens[other]) == token:
                yield int(nodes[at]), int(nodes[other])


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def near_duplicate_groups(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, radius: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, version (a hash of the text), group and group_version of every document that is a near-duplicate of another.

    Documents are near-duplicates if their sets of `words`-word shingles have a Jaccard similarity of
    `similarity` or more, and groups are what such links connect; group and group_version name the
    smallest document. Every link that counts is verified on the whole sets.

    Candidates first come from SimHash: equal fingerprints, and those within `radius` bits by ball
    hashing. At a similarity of 0.8 fingerprints differ in about ten bits, which no ball of that kind
    reaches; what it misses comes from a prefix filter, which makes the result exact: similar texts share
    a shingle of their prefixes (`_sketches`). Sharers of a shingle meet in tasks, at most SHARERS of a
    kind at a time, and are compared by their counts, a bound that no similar pair falls below. First only a
    forest of the pairs that can be similar is verified, which joins dense groups; then every such pair
    that is still apart, given at one of the shingles that it shares. Shingles with the same sharers meet once.

    Documents without an id are never grouped. A repeated id counts once for each of its texts, a row
    that repeats both once. Texts without words have equal, empty sets and are near-duplicates.
    """
    spark = docs.sparkSession
    text = text_or_empty(docs, text_column)
    known = docs.select(docs[id_column].cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text")).where("doc_id is not null")
    sketches, sketched = written(_sketches(known, words, similarity, _common_shingles(known, words)), "sketches")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_NODES else df

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array([*map(_unpack_counts, batch[c].to_pylist())], dtype=np.uint32).reshape(-1, COUNTS) for c in ("counts_a", "counts_b"))
            common = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            either = batch["n_a"].to_numpy().astype(np.int64) + batch["n_b"].to_numpy() - common
            yield batch.select(["a", "b"]).filter(pa.array(common >= similarity * either - 1e-6))

    def verified(pairs: DataFrame) -> DataFrame:
        nodes = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        wanted = durable(sketches.select("node", "doc_id", "version").join(small(nodes), "node", "left_semi"))
        with short_lived_shuffles(spark):
            sets, path = written(_shingle_sets(known.join(small(wanted), ["doc_id", "version"]).select("node", "text"), words).dropDuplicates(["node"]), "sets")
        of_a, of_b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        common = F.size(F.array_intersect("set_a", "set_b"))
        either = F.size("set_a") + F.size("set_b") - common
        close = (either == 0) | (common >= similarity * either)
        with short_lived_shuffles(spark):
            found = durable(pairs.join(of_a, "a").join(of_b, "b").where(close).select("a", "b"))
        forget(spark, path)
        return found

    with short_lived_shuffles(spark):
        heads = durable(sketches.groupBy("fingerprint").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("copies")))
        same = sketches.select("fingerprint", "node").join(heads.where("copies > 1"), "fingerprint").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
        linked = linked_fingerprints(heads.select("fingerprint"), radius=radius)
        of_a, of_b = (heads.select(F.col("fingerprint").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab")
        balls = linked.join(of_a, "a").join(of_b, "b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).unionByName(same)
        of_a, of_b = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"counts_{x}")) for x in "ab")
        sized = balls.join(of_a, "a").join(of_b, "b").where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6)
        balls = durable(sized.mapInArrow(likely, "a long, b long"))

        tokens = sketches.select("node", F.explode("prefix").alias("token"))
        sharers = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sharers"), F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("who")).where("sharers > 1")
        kept = durable(sharers.groupBy("sharers", "least", "who").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("sharers") / SHARERS).alias("parts")))
        met = tokens.join(small(kept), "token").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
        rows, dealt = written(met.join(sketches.select("node", "n", "counts"), "node"), "sharers")

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups_of(batches, "token", "part"):
            if pairs := _likely_forest(group, similarity):
                yield _pairs_batch(pairs)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups_of(batches, "token", "low", "high"):
            pairs = _likely_pairs(group, similarity)
            while chunk := list(itertools.islice(pairs, 100_000)):
                yield _pairs_batch(chunk)

    with short_lived_shuffles(spark):
        trees = rows.select("token", "part", "node", "n", "counts").repartition("token", "part").sortWithinPartitions("token", "part").mapInArrow(forest, "a long, b long")
        first = durable(trees.unionByName(balls).distinct())
    components = connected_components(verified(first)).select("node", "component")
    with short_lived_shuffles(spark):
        known_component = F.coalesce("component", "node")
        placed = rows.select("token", "node").join(components, "node", "left").groupBy("token").agg(F.min(known_component).alias("one"), F.max(known_component).alias("other"))
        live = durable(placed.where("one <> other").select("token"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        still = rows.join(small(live), "token", "left_semi")
        lists = rows.select("token", "node").join(small(live), "token", "left_semi").groupBy("node").agg(F.collect_list("token").alias("tokens"))  # at most a prefix
        blocks = still.join(components, "node", "left").withColumn("component", known_component).join(lists, "node")
        blocks = blocks.withColumn("with", other).withColumns({"low": F.least("part", "with"), "high": F.greatest("part", "with")}).drop("with", "parts")
        rest = durable(blocks.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high").mapInArrow(apart, "a long, b long"))
    forget(spark, dealt)
    more = rest if rest.isEmpty() else verified(rest)
    if not more.isEmpty():  # the links between components, which are few
        of_a, of_b = (components.select(F.col("node").alias(x), F.col("component").alias(f"to_{x}")) for x in "ab")
        ends = more.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        above = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("higher"))
        every = components.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(components, "node", "left_anti").withColumn("component", F.col("node")))
        components = every.join(above, "component", "left").select("node", F.coalesce("higher", "component").alias("component"))
    named = durable(components.join(sketches.select("node", "doc_id", "version"), "node").select("component", F.struct("doc_id", "version").alias("name")).distinct())
    forget(spark, sketched)
    smallest = named.groupBy("component").agg(F.min("name").alias("group"))
    return named.join(smallest, "component").select("name.doc_id", "name.version", F.col("group.doc_id").alias("group"), F.col("group.version").alias("group_version"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near_duplicate_groups, the one with the smallest id.

    All columns stay. A document goes by its id and its text, so that another text of the same id is
    judged by itself; rows that repeat both stay or go together. What is to be dropped is broadcast up
    to BROADCAST_NODES rows, and joined by shuffling beyond. Other documents are untouched, those
    without an id too.
    """
    name, text = options.get("id_column", "doc_id"), text_or_empty(docs, options.get("text_column", "text"))
    found = near_duplicate_groups(docs, **options).where("doc_id <> group or version <> group_version")
    gone = durable(found.select(F.col("doc_id").alias("dropped_id"), F.col("version").alias("dropped_version")))
    few = gone.count() <= BROADCAST_NODES
    return docs.join(F.broadcast(gone) if few else gone, (docs[name] == F.col("dropped_id")) & (F.xxhash64(text) == F.col("dropped_version")), "left_anti")
