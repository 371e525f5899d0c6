"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty, with_text_ids

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "longest_word", "short_words", "distinct_words", "top_word",
    "spaces", "newlines", "digits", "upper", "lower", "high_bytes", "sentence_marks", "other_marks", "exclaims",
    "pipes", "quotes", "mark_runs", "byte_entropy", "lines", "short_lines", "repeated_lines", "unended_lines",
]
#: Raw scores are counted in this many bins before the isotonic fit, between RAW_LOW and RAW_HIGH; those
#: outside count in the first or last bin. A knot so lies within 0.001 of the raw scores that it stands for.
BINS, RAW_LOW, RAW_HIGH = 1000, -0.5, 1.5
#: Standard deviations at which a statistic is cut off before it enters the kernel.
FURTHEST = 6.0
#: Labelled rows that the fit takes at most; a hash of the id chooses them.
TRAIN_ROWS = 400_000


def _share(histogram: np.ndarray, letters: bytes) -> float:
    return float(histogram[np.frombuffer(letters, dtype=np.uint8)].sum())


def document_statistics(text: str) -> list[float]:
    """The whole text in len(STATISTICS) numbers; an empty text gives zeros."""
    data = text.encode("utf-8", "replace")
    if not data:
        return [0.0] * len(STATISTICS)
    values = np.frombuffer(data, dtype=np.uint8)
    shares = np.bincount(values, minlength=256) / len(data)
    words = text.split()
    counts = Counter(words)
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    mark = np.isin(values, np.frombuffer(b"!#$%&*@^~=<>_", dtype=np.uint8))
    seen = shares[shares > 0]
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        min(sum(map(len, words)) / n, 50.0),
        min(float(np.log1p(max(map(len, words), default=0))), 8.0),
        sum(len(w) <= 3 for w in words) / n,
        len(counts) / n**0.8,
        max(counts.values(), default=0) / n,
        _share(shares, b" "),
        _share(shares, b"\n"),
        _share(shares, b"0123456789"),
        float(shares[65:91].sum()),
        float(shares[97:123].sum()),
        float(shares[128:].sum()),
        _share(shares, b".,;:?"),
        _share(shares, b"#$%&*@^~=<>_+\\/{}[]()"),
        _share(shares, b"!"),
        _share(shares, b"|"),
        _share(shares, b"\"'"),
        float((mark[1:] & mark[:-1]).sum()) / len(data),
        float(-(seen * np.log2(seen)).sum()),
        np.log1p(len(lines)),
        sum(len(x) < 30 for x in lines) / m,
        1 - len(set(lines)) / m if lines else 0.0,
        sum(x.rstrip()[-1] not in ".!?" for x in lines) / m,
    ]


def statistics(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and one double column for each of STATISTICS, computed where the texts are read."""
    names = ", ".join(f"{x} double" for x in STATISTICS)
    kind = docs.schema[id_column].dataType

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(np.array([document_statistics(t) for t in batch["text"]]).reshape(-1, len(STATISTICS)), columns=STATISTICS)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    rows = docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs, text_column).alias("text"))
    return with_text_ids(rows).mapInPandas(compute, f"doc_id string, {names}").withColumn("doc_id", F.col("doc_id").cast(kind))


@dataclass(frozen=True)
class QualityModel:
    """A Gaussian kernel of the given width, approximated by cosines of random projections.

    Statistics are centred and scaled by the labelled rows, and cut off at FURTHEST deviations, so that
    an odd text lies at the edge of what was learnt and not where no kernel reaches.
    """

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, rows: pd.DataFrame) -> np.ndarray:
        x = np.clip((rows[STATISTICS].to_numpy(dtype=float) - self.mean) / self.scale, -FURTHEST, FURTHEST)
        z = np.cos(x @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([z, np.ones(len(z))])

    def raw(self, rows: pd.DataFrame) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: pd.DataFrame) -> np.ndarray:
        return np.interp(self.raw(rows), self.knots, self.values)


def isotonic(centres: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; knots and values of a non-decreasing curve inside (0, 1).

    A block's value is its share of ones. Shares of 0 and 1 are moved inward by half a row of all rows,
    the same for every block, so that the order of the values stays as pooling has left it.
    """
    blocks: list[list[float]] = []
    for x, n, s in zip(centres, counts, sums, strict=True):
        blocks.append([x * n, n, s])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    inward = 0.5 / (sum(b[1] for b in blocks) + 1)
    return np.array([b[0] / b[1] for b in blocks]), np.clip([b[2] / b[1] for b in blocks], inward, 1 - inward)


def fit(train: DataFrame, *, features: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 7, train_rows: int = TRAIN_ROWS) -> QualityModel | None:
    """Fits on rows with doc_id, STATISTICS and label (0 to 1); None where there is no labelled row.

    Each partition sums its part of the normal equations, for two halves of the rows. The halves' raw
    scores of each other are what the isotonic curve is fitted to; the model itself has both. The driver
    sees (features + 1) rows of sums a half, and at most BINS bins. At most about train_rows labelled
    rows are taken, chosen by a hash of their id; this bound is all that limits the fit.
    """
    mean_sd = [f(c).alias(f"{k}_{c}") for c in STATISTICS for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    first = train.agg(F.count("label").alias("n"), *mean_sd).first()
    if not first["n"]:
        return None
    if first["n"] > train_rows:
        part = int(1_000_000 * train_rows / first["n"])
        train = train.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < part)
    mean = np.array([first[f"mean_{c}"] for c in STATISTICS])
    scale = np.array([first[f"sd_{c}"] or 1.0 for c in STATISTICS])
    rng = np.random.default_rng(seed)
    projection = rng.normal(size=(len(STATISTICS), features)) / width
    phase = rng.uniform(0, 2 * np.pi, features)
    size = features + 1
    empty = QualityModel(mean, scale, projection, phase, np.zeros(size), np.zeros(1), np.zeros(1))
    halved = train.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, size, size + 1))
        for batch in batches:
            z = empty.features(batch)
            both = np.column_stack([z, batch["label"].to_numpy(dtype=float)])
            for half in (0, 1):
                own = (batch["half"] == half).to_numpy()
                total[half] += z[own].T @ both[own]
        yield pd.DataFrame({"half": np.repeat([0, 1], size), "line": np.tile(np.arange(size), 2), "sums": [*total.reshape(2 * size, size + 1)]})

    parts = halved.mapInPandas(sums, "half int, line int, sums array<double>")
    added = parts.groupBy("half", "line").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size + 1))).collect()
    total = np.zeros((2, size, size + 1))
    for row in added:
        total[row["half"], row["line"]] = row[2:]

    def solve(equations: np.ndarray) -> np.ndarray:
        a = equations[:, :-1]
        return np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) / size * np.eye(size), equations[:, -1])

    by_other = [QualityModel(mean, scale, projection, phase, solve(total[1 - half]), np.zeros(1), np.zeros(1)) for half in (0, 1)]

    def raw_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = np.where(batch["half"] == 0, by_other[0].raw(batch), by_other[1].raw(batch))
            at = np.clip((raw - RAW_LOW) / (RAW_HIGH - RAW_LOW) * BINS, 0, BINS - 1).astype("int32")
            yield pd.DataFrame({"bin": at, "label": batch["label"].to_numpy(dtype=float)})

    bins = halved.mapInPandas(raw_scores, "bin int, label double").groupBy("bin").agg(F.count("label").alias("n"), F.sum("label").alias("s")).orderBy("bin").toPandas()
    centres = RAW_LOW + (bins["bin"].to_numpy() + 0.5) * (RAW_HIGH - RAW_LOW) / BINS
    knots, values = isotonic(centres, bins["n"].to_numpy(dtype=float), bins["s"].to_numpy(dtype=float))
    return QualityModel(mean, scale, projection, phase, solve(total[0] + total[1]), knots, values)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)) == fold


def train_quality(docs: DataFrame, labels: DataFrame, *, label_column: str = "quality", folds: int = 3, held_out: int = 1, train_rows: int = TRAIN_ROWS) -> QualityModel | None:
    """The model that score_quality uses, for callers that score rows elsewhere."""
    return fit(durable(statistics(docs).where(~in_fold(F.col("doc_id"), folds, held_out)).join(_known(labels, label_column), "doc_id")), train_rows=train_rows)


def _known(labels: DataFrame, label_column: str) -> DataFrame:
    known = labels.select(labels["doc_id"].alias("doc_id"), labels[label_column].cast("double").alias("label")).where("label is not null and doc_id is not null")
    return known.groupBy("doc_id").agg(F.avg("label").alias("label"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that the classifier predicts to be bad, with all their columns.

    The rows are scored where they are read, so that no text moves. Null counts as empty; an empty text
    has all statistics 0 and is judged like any other. Without any label all rows stay, and of an empty
    table nothing.
    """
    model = train_quality(docs, labels, **options)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def is_good(text: pd.Series) -> pd.Series:
        rows = pd.DataFrame(np.array([document_statistics(t or "") for t in text]).reshape(-1, len(STATISTICS)), columns=STATISTICS)
        return pd.Series(model.score(rows) >= 0.5)

    return docs.where(is_good(text_or_empty(docs, "text")))


def score_quality(
    docs: DataFrame, labels: DataFrame, *, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", folds: int = 3, held_out: int = 1, train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Learns label_column of `labels` from the rows outside the held-out fold. Scores rest on the text
    alone. Several labels of one id count as their mean, null labels not at all. Null and empty texts
    have all statistics 0 and are scored like any other. Without any labelled row every score is 0.5.
    Other columns of either table are ignored.
    """
    stats = durable(statistics(docs, id_column=id_column, text_column=text_column).withColumn("held_out", in_fold(F.col("doc_id"), folds, held_out)))
    model = fit(durable(stats.where(~F.col("held_out")).join(_known(labels, label_column), "doc_id")), train_rows=train_rows)
    if model is None:
        return stats.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    kind = docs.schema[id_column].dataType

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = model.score(batch)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": (scores >= 0.5).astype("int32")})

    scored = with_text_ids(stats).mapInPandas(score, "doc_id string, held_out boolean, score double, predicted int")
    return scored.withColumn("doc_id", F.col("doc_id").cast(kind))
