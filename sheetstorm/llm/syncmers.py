"""Document fingerprints from closed syncmers.

A piece is four characters with the white space between them, and one begins at every character that
is no white space. A run of k pieces is a closed syncmer if the smallest of its pieces' hashes stands at
one of its two ends. Whether a run is chosen depends on nothing but the run, so that equal passages give
equal anchors wherever they stand, in scripts without spaces and long tokens too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty

#: Characters in a piece.
PIECE = 4
#: Pieces in a run. About 2 / RUN of all runs are anchors.
RUN = 16
#: A group of neighbouring ids spans 2 ** ID_BITS ids.
ID_BITS = 8
#: Successor rows (two longs each) that are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 200_000
#: An anchor is one long: its hash in the upper half, below it one bit for the side of a comparison, and its place.
PLACE = (1 << 31) - 1


def _hashes(marks: str) -> Column:
    """Hashes of the pieces; marks are the characters, each with the white space after it. Fewer than PIECE are one piece."""
    found, n = F.col(marks), F.size(marks)

    def piece(i: Column) -> Column:
        return F.xxhash64(*(F.get(found, i + j) for j in range(PIECE - 1)), F.left(F.get(found, i + PIECE - 1), F.lit(1)))

    pieces = F.transform(F.sequence(F.lit(0), n - PIECE), piece)
    return F.when(n >= PIECE, pieces).when(n > 0, F.array(F.xxhash64(F.array_join(found, "")))).otherwise(F.array().cast("array<bigint>"))


def _packed(hashed: Column, place: Column) -> Column:
    return F.shiftleft(hashed.cast("long"), 32).bitwiseOR(place.cast("long"))


def _pairwise(minima: str, step: int) -> Column:
    """The least of each entry and the one so many places on; beyond the end there is nothing, and the entry stays."""
    return F.transform(minima, lambda v, i: F.least(v, F.get(F.col(minima), i + step)))


def _with_minima(docs: DataFrame, hashes: str, to: str, run: int) -> DataFrame:
    """Adds the smallest hash of the run that begins at each place: minima of 2, 4, 8, ... places, the last two overlapping."""
    width, at = 1, hashes
    while width < run:
        step = min(width, run - width)
        docs = docs.withColumn(f"{to}_{width + step}", _pairwise(at, step))
        width, at = width + step, f"{to}_{width + step}"
    return docs.withColumn(to, F.col(at))


def _anchors(hashes: str, minima: str, run: int) -> Column:
    pieces, least = F.col(hashes), F.col(minima)
    is_end = lambda i: (F.get(least, i) == F.get(pieces, i)) | (F.get(least, i) == F.get(pieces, i + run - 1))
    starts = F.filter(F.sequence(F.lit(0), F.size(pieces) - run), is_end)
    return (
        F.when(F.size(pieces) >= run, F.transform(starts, lambda i: _packed(F.hash(F.slice(pieces, i + 1, run)), i)))
        .when(F.size(pieces) > 0, F.array(_packed(F.hash(pieces), F.lit(0))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def with_anchors(docs: DataFrame, text: str, to: str, *, run: int = RUN) -> DataFrame:
    """Adds the anchors of the column `text`, in text order: longs of hash and place (the number of pieces before it).

    A text of fewer than `run` pieces has one anchor, the whole text; one without any piece (null, empty
    or white space) has none.
    """
    marks, hashes, minima, kept = f"{to}_marks", f"{to}_hashes", f"{to}_minima", docs.columns
    pieces = docs.withColumn(marks, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S\s*"), F.lit(0))).withColumn(hashes, _hashes(marks))
    found = _with_minima(pieces, hashes, minima, run).withColumn(to, _anchors(hashes, minima, run))
    return found.select(*(F.col(f"`{c}`") for c in kept if c != to), to)


def with_joined_anchors(docs: DataFrame, first: str, first_anchors: str, second: str, second_anchors: str, to: str, *, run: int = RUN) -> DataFrame:
    """Adds the anchors of `first` followed by `second`, each the beginning of a text whose anchors are known (or all of it).

    The same anchors as with_anchors finds in the joined text: whether a run is one depends on its pieces alone,
    so that only runs that cross the joint, `span` characters to each side of it, are looked at anew.
    """
    span, kept, made = run + PIECE - 2, docs.columns, lambda name: f"{to}_{name}"
    end, beginning = rf"^(?:\s*+\S){{0,{span}}}", rf"^\s*+(?:\S\s*+){{0,{span}}}"
    joint = F.concat(F.reverse(F.regexp_extract(F.reverse(first), end, 0)), F.regexp_extract(second, beginning, 0))
    pieces = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    rows = docs.withColumns({made("n1"): pieces(first), made("n2"): pieces(second), made("joint"): joint})
    rows = with_anchors(rows, made("joint"), made("across"), run=run)
    n1, n2 = F.col(made("n1")), F.col(made("n2"))
    a, b = F.least(n1, F.lit(span)), F.least(n2, F.lit(span))
    within = lambda anchors, n: F.filter(anchors, lambda v: v.bitwiseAND(F.lit(PLACE)) < n - span)
    # Fewer pieces than a run has are an anchor only if there is nothing else.
    across = F.when((a + b > span) | (n1 + n2 == a + b), F.transform(made("across"), lambda v: v + (n1 - a))).otherwise(F.array().cast("array<bigint>"))
    found = F.concat(within(first_anchors, n1), across, F.transform(within(second_anchors, n2), lambda v: v + n1))
    return rows.withColumn(to, found).select(*(F.col(f"`{c}`") for c in kept if c != to), to)


def with_likeness(docs: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """Adds the likeness (0 to 1) of the fingerprints in the columns a and b, from anchors that match by position.

    Sorted together, equal hashes of both sides meet; each gives the distance between its places. An
    anchor matches if another one has the same distance: equal passages do wherever they stand, equal
    hashes by chance don't. Fingerprints of a single anchor match by it alone. Likeness is the share of
    matching anchors among the distinct ones of both; two fingerprints without any are alike (1).
    """
    ordered, distances = f"{to}_ordered", f"{to}_distances"
    side = F.lit(1 << 31)
    x, d = F.col(ordered), F.col(distances)
    place = lambda v: v.bitwiseAND(F.lit(PLACE))
    # Two neighbours differ by 1 above their places where an equal hash of both sides meets, by 0 where it repeats on one.
    change = lambda v, i: F.shiftright(v.bitwiseXOR(F.get(x, i + 1)), 31)
    found = F.sort_array(F.array_compact(F.transform(x, lambda v, i: F.when(change(v, i) == 1, place(F.get(x, i + 1)) - place(v)))))
    company = F.filter(d, lambda v, i: (v == F.coalesce(F.get(d, i - 1), v + 1)) | (v == F.coalesce(F.get(d, i + 1), v + 1)))
    distinct = F.size(F.filter(x, lambda v, i: change(v, i) != 0)) + 1
    matched = F.when(F.least(F.size(a), F.size(b)) < 2, F.size(d)).otherwise(F.size(company))
    return (
        docs.withColumn(ordered, F.sort_array(F.concat(a, F.transform(b, lambda v: v.bitwiseOR(side)))))
        .withColumn(distances, F.when(F.size(x) > 1, found).otherwise(F.array().cast("array<bigint>")))
        .withColumn(f"{to}_matched", matched)
        .withColumn(f"{to}_distinct", distinct)
        .withColumn(to, F.when(F.size(x) == 0, 1.0).otherwise(F.col(f"{to}_matched") / (F.col(f"{to}_distinct") - F.col(f"{to}_matched"))))
        .drop(ordered, distances, f"{to}_matched", f"{to}_distinct")
    )


def likeness(a: str, b: str) -> Column:
    """Share of distinct anchors that two fingerprints have in common, wherever they stand; 1 for two without any."""
    x, y = (F.transform(c, lambda v: F.shiftright(v, 32)) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def hex_digits(anchors: str) -> Column:
    """The hashes in text order, eight hexadecimal digits each."""
    return F.lower(F.array_join(F.transform(anchors, lambda v: F.lpad(F.hex(F.shiftrightunsigned(v, 32)), 8, "0")), ""))


def _next_of_buckets(spans: DataFrame, low: int, high: int) -> DataFrame:
    """spans: bucket, first (its smallest id). Returns bucket and next_first: the smallest id of the next bucket.

    Buckets are joined 2 ** ID_BITS at a time, level by level, so that no task ever orders more than one
    parent's children (at the top two parents', where ids lie on both sides of zero). The last bucket of
    all is followed by the first.
    """
    top = low >> 2 * ID_BITS == high >> 2 * ID_BITS or (low >> 2 * ID_BITS, high >> 2 * ID_BITS) == (-1, 0)
    parent = F.lit(0).cast("long") if top else F.shiftright("bucket", ID_BITS)
    w = Window.partitionBy("parent").orderBy("bucket")
    here = spans.withColumn("parent", parent).withColumn("next_first", F.lead("first").over(w))
    if top:
        return here.select("bucket", F.coalesce("next_first", F.lit(low)).alias("next_first"))
    above = _next_of_buckets(spans.groupBy(parent.alias("bucket")).agg(F.min("first").alias("first")), low >> ID_BITS, high >> ID_BITS)
    above = above.select(F.col("bucket").alias("parent"), F.col("next_first").alias("after"))
    return here.join(above, "parent").select("bucket", F.coalesce("next_first", "after").alias("next_first"))


def with_next(docs: DataFrame, *, run: int = RUN) -> DataFrame:
    """doc_id, text and anchors of each row, with next_text and next_anchors: those of the row with the next id.

    Texts travel once, to buckets of neighbouring ids; a copy of the first row of the next bucket closes
    each bucket. The last row is followed by the first. Rows that share an id are ordered by their text.
    Rows without an id have no order: the text after them is empty.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn("bucket", F.shiftright("doc_id", ID_BITS))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    ends = rows.where(F.lit(False)).withColumn("closing", F.lit(True))
    if low is not None:
        spans = rows.groupBy("bucket").agg(F.min("doc_id").alias("first"))
        follow = durable(_wrapped(spans, low, high)).select(F.col("bucket").alias("closed"), F.col("next_first").alias("doc_id"))
        few = follow.count() <= BROADCAST_ROWS
        ends = rows.join(F.broadcast(follow) if few else follow, "doc_id").select("doc_id", "text", F.col("closed").alias("bucket"), F.lit(True).alias("closing"))
    both = rows.withColumn("closing", F.lit(False)).unionByName(ends)
    w = Window.partitionBy("bucket").orderBy("closing", "doc_id", "text")
    ordered = (
        with_anchors(both.repartition("bucket"), "text", "anchors", run=run)
        .withColumn("next_text", F.lead("text").over(w))
        .withColumn("next_anchors", F.lead("anchors").over(w))
        .where(~F.col("closing"))
        .select("doc_id", "text", "anchors", "next_text", "next_anchors")
    )
    alone = with_anchors(docs.where(F.col("doc_id").isNull()), "text", "anchors", run=run).select(
        "doc_id", "text", "anchors", F.lit("").alias("next_text"), F.array().cast("array<bigint>").alias("next_anchors")
    )
    return ordered.unionByName(alone)


def _wrapped(spans: DataFrame, low: int, high: int) -> DataFrame:
    found = _next_of_buckets(spans, low >> ID_BITS << ID_BITS, high)
    last = high >> ID_BITS
    return found.withColumn("next_first", F.when(F.col("bucket") == last, F.lit(low)).otherwise(F.col("next_first")))


def fingerprint(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", run: int = RUN) -> DataFrame:
    """doc_id, n_chars and anchors (structs of position, the pieces before it, and hash) of every row; see with_anchors for odd texts."""
    rows = docs.select(docs[id_column].alias("doc_id"), text_or_empty(docs, text_column).alias("text"))
    spread = F.transform("anchors", lambda v: F.struct(v.bitwiseAND(F.lit(PLACE)).cast("int").alias("position"), F.shiftright(v, 32).cast("int").alias("hash")))
    return with_anchors(rows, "text", "anchors", run=run).select("doc_id", F.length("text").cast("long").alias("n_chars"), spread.alias("anchors"))


def compare_with_edits(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", run: int = RUN) -> DataFrame:
    """Fingerprints of every text and of its edited text: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next
    document, or all of it. Null counts as empty; an empty text stays empty when edited. Repeated rows
    are returned as often as they occur. Other columns of docs are ignored. A text's anchors are found once: those of
    edited texts are put together (with_joined_anchors). See likeness for the two
    likenesses; with_likeness, which matches positions, costs too much for whole tables.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), text_or_empty(docs, text_column).alias("text"))
    half = F.shiftright("n_chars", 1)
    parts = (
        with_next(rows, run=run)
        .withColumn("n_chars", F.length("text"))
        .withColumns({"stays": F.left("text", F.col("n_chars") - half), "comes": F.left(F.coalesce("next_text", F.lit("")), half)})
    )
    anchored = with_joined_anchors(parts, "stays", "anchors", "comes", "next_anchors", "edited_anchors", run=run)
    return anchored.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.concat("stays", "comes"), 256).alias("edited_sha256"),
        hex_digits("anchors").alias("fingerprint"),
        hex_digits("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )
