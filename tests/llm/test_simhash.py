import random
import re

import xxhash

from sheetstorm.llm.components import connected_components
from sheetstorm.llm.simhash import linked_fingerprints, simhash_components

from .helpers import SF, odd_documents, texts


def fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    found = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in found]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def smallest_linked(values, ids, radius=4):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(values))]


def check(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    values = [fingerprint(r.text) for r in rows]
    linked = smallest_linked(values, [r.doc_id for r in rows])
    got = sorted(map(str, (tuple(r) for r in simhash_components(docs).collect())))
    assert got == sorted(str((r.doc_id, f"{v:016x}", c)) for r, v, c in zip(rows, values, linked, strict=True))


def test_odd_rows(spark):
    check(spark, odd_documents(spark))
    assert simhash_components(odd_documents(spark, [])).count() == 0


def test_table_against_brute_force(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(texts(spark)) == 200


def test_links_and_components_of_close_fingerprints(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            values.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6])):
                x ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = linked_fingerprints(spark.createDataFrame([(v,) for v in signed], "fingerprint long"))
    pairs = {(r.a, r.b) for r in edges.collect()}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and a < b for a, b in pairs)
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert [found.get(v, v) for v in signed] == smallest_linked(values, signed)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000 - i, 5001 - i) for i in range(20)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[1000 + i] for i in range(60)} == {1000} and got[5001] == got[4985] == 4981
