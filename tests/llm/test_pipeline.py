import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sheetstorm.llm import simhash
from sheetstorm.llm.exact_dedup import drop_copies
from sheetstorm.llm.simhash import drop_near_duplicates, near_duplicate_groups

from .helpers import odd_documents
from .test_simhash import smallest_linked


def shingle_set(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_copies(rng, n_texts=30):
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(n_texts):
        words = rng.choices(vocabulary, k=rng.randint(80, 300))
        rows.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            edited = list(words)
            for _ in range(rng.randint(1, 4)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append(" ".join(edited))
    return list(enumerate(rows))


def test_near_duplicates_against_brute_force(spark):
    rows = near_copies(random.Random(5))
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[max(find(i), find(j))] = min(find(i), find(j))
    docs = odd_documents(spark, rows)
    got = {r.doc_id: r.group for r in near_duplicate_groups(docs).collect()}
    wrong = [i for i in range(len(rows)) if got.get(i, i) != find(i)]
    assert not wrong and len(got) > 20
    assert all(find(i) == find(g) for i, g in got.items())  # never a group without a link
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(len(rows)) if got.get(i, i) == i}
    assert smallest_linked([1, 1], [5, 3]) == [3, 3]


def grouped(rows):
    """The smallest id that links by brute force reach, for each row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_appended_cut_and_replaced_passages(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for at in range(45):
        words = rng.choices(vocabulary, k=rng.randint(100, 300))
        n = int(len(words) * rng.uniform(0.05, 0.16))
        fresh = rng.choices(vocabulary, k=n)
        texts += [words, [words + fresh, words[:-n], words[:40] + fresh[: n // 2] + words[40 + n // 2 :]][at % 3]]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    wanted = grouped(rows)
    assert sum(i != g for i, g in wanted.items()) > 35
    got = {r.doc_id: r.group for r in near_duplicate_groups(odd_documents(spark, rows)).collect()}
    assert {i: got.get(i, i) for i in wanted} == wanted


def test_outsiders_with_the_smallest_id_hide_nothing(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(3):
        words = [f"w{x}" for x in rng.sample(range(10**6), 120)]
        texts = [rng.sample(words, len(words)), words]
        for at in (20, 60, 90):
            texts.append([*words[:at], words[at + 1], words[at], *words[at + 2 :]])
        texts.append(words[:5] + [f"x{x}" for x in rng.sample(range(10**6), 100)])
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.group for r in near_duplicate_groups(odd_documents(spark, rows)).collect()}
    wanted = grouped(rows)
    assert {i: got.get(i, i) for i, _ in rows} == wanted and wanted[0] == 0 and wanted[2] == wanted[4] == 1


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(10)
    one, other = (" ".join(rng.choices([f"w{i}" for i in range(3000)], k=90)) for _ in range(2))
    docs = odd_documents(spark, [(1, one), (7, one + " more"), (7, other), (8, other), (8, other), (9, other + " end"), (9, one + " end"), (None, one)])
    kept = [(r.doc_id, r.text) for r in drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (7, other), (None, one)], key=str)


def test_dense_groups_and_their_outsiders(spark, monkeypatch):
    """A large group of copies with edits of any size, more sharers than are compared at a time."""
    monkeypatch.setattr(simhash, "SHARERS", 40)
    rng = random.Random(12)
    words = rng.choices([f"w{i}" for i in range(3000)], k=140)
    texts = [words]
    for _ in range(200):
        edited = list(words)
        for _ in range(rng.randint(0, 9)):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
        texts.append(edited)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    wanted = grouped(rows)
    got = {r.doc_id: r.group for r in near_duplicate_groups(odd_documents(spark, rows)).collect()}
    assert {i: got.get(i, i) for i in wanted} == wanted and 50 < sum(g == 0 for g in wanted.values()) < 200


def test_recall_by_similarity(spark):
    """Every pair at 0.8 or more is caught, in each band."""
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, bands = [], {}
    for at in range(120):
        words = rng.choices(vocabulary, k=rng.randint(40, 400))
        edited, n = list(words), rng.randint(1, max(1, len(words) // 40))
        for _ in range(n):
            edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
        rows += [(2 * at, " ".join(words)), (2 * at + 1, " ".join(edited))]
        a, b = map(shingle_set, (rows[-2][1], rows[-1][1]))
        bands.setdefault(int(20 * len(a & b) / len(a | b)) / 20, []).append(2 * at + 1)
    got = {r.doc_id: r.group for r in near_duplicate_groups(odd_documents(spark, rows)).collect()}
    assert {0.8, 0.85, 0.9} <= bands.keys()
    for band, ids in bands.items():
        assert [i in got for i in ids] == [band >= 0.8] * len(ids), band


def test_odd_rows(spark):
    docs = odd_documents(spark)
    once = drop_copies(docs, keep="largest").collect()
    assert sorted(str(r.doc_id) for r in once) == sorted(map(str, [2, 4, 5, 6, 7, None, 9, 10, 11]))
    assert docs.columns == drop_copies(docs).columns and {r.doc_id for r in drop_copies(docs).collect()} >= {1, 3}
    assert drop_near_duplicates(docs).where(F.col("doc_id").isNull()).count() == 1
    assert drop_near_duplicates(odd_documents(spark, [])).count() == 0 and drop_copies(odd_documents(spark, [])).count() == 0


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, seen, sf).collect(), docs.schema)
        assert after.columns == docs.columns and after.exceptAll(docs).isEmpty(), name
        assert 0 < after.count() <= seen.count()
        seen = after
    packed = corpus_pipeline.pack(spark, seen, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in seen.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    good = [i for i, q in labels.items() if q]
    assert sum(i in kept for i in good) / len(good) == pytest.approx(1, abs=0.1)
