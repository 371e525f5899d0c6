"""Dependencies of a cell table: references as edges, cycles, levels of computation, and what rests on a draw, by joins.

The tables have a row per cell or reference, and rounds are cut by stored tables. The rounds of levels grow
with the longest chain of references, those of cycles with the longest way inside one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import MOST_CELLS
from .storage import kept

#: Fixed values of the language: a reference with its sheet and the end of its range, and the calls that draw.
REFERENCE = r"(?<![A-Za-z0-9_.!$])(?:([A-Za-z_][A-Za-z0-9_]*)!)?\$?([A-Za-z]{1,3})\$?([0-9]+)(?::\$?([A-Za-z]{1,3})\$?([0-9]+))?(?![A-Za-z0-9_(.!])"
DRAWS = r"(?i)\b(UNIFORM|RAND|NORMAL|LOGNORMAL|TRIANGULAR)\("


def _column_number(letters):
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def _letters(number):
    """1 is A, 27 is AA; up to three letters."""
    n = number - 1
    small = F.char(65 + n % 26)
    two = F.concat(F.char(65 + F.floor((n - 26) / 26) % 26), small)
    three = F.concat(F.char(65 + F.floor((n - 702) / 676)), F.char(65 + F.floor((n - 26) / 26) % 26), small)
    return F.when(n < 26, small).when(n < 702, two).otherwise(three)


def references(cells: DataFrame) -> DataFrame:
    """node and needs (both `Sheet!A1`): each cell that a formula of a cell table (sheet, address, input_text) refers to, once.

    Ranges refer to every cell in them, up to MOST_CELLS; a larger one is an error of its formula and refers to none.
    """
    formulas = cells.where(F.col("input_text").startswith("=")).select("sheet", F.concat_ws("!", "sheet", "address").alias("node"), F.col("input_text").alias("text"))
    found = formulas.select("sheet", "node", F.explode(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(0))).alias("reference"))
    part = lambda i: F.regexp_extract("reference", REFERENCE, i)
    parts = found.select("node", F.when(part(1) == "", F.col("sheet")).otherwise(part(1)).alias("sheet"), _column_number(part(2)).alias("c1"), part(3).cast("int").alias("r1"), F.when(part(4) == "", _column_number(part(2))).otherwise(_column_number(part(4))).alias("c2"), F.when(part(5) == "", part(3)).otherwise(part(5)).cast("int").alias("r2"))
    sized = parts.where((F.abs(F.col("c2") - F.col("c1")) + 1).cast("long") * (F.abs(F.col("r2") - F.col("r1")) + 1) <= MOST_CELLS)
    rows = sized.withColumn("row", F.explode(F.sequence(F.least("r1", "r2"), F.greatest("r1", "r2")))).withColumn("column", F.explode(F.sequence(F.least("c1", "c2"), F.greatest("c1", "c2"))))
    return rows.select("node", F.concat(F.col("sheet"), F.lit("!"), _letters(F.col("column")), F.col("row")).alias("needs")).distinct()


def draws(cells: DataFrame) -> DataFrame:
    """node: the cells whose formula draws."""
    return cells.where(F.col("input_text").startswith("=") & F.col("input_text").rlike(DRAWS)).select(F.concat_ws("!", "sheet", "address").alias("node"))


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by sorting both sides: tables of every round are small enough to be broadcast, and together would send the driver more than the input."""
    return left.join(right.hint("merge"), on, how)


def _peel(nodes: DataFrame, edges: DataFrame, side: str, other: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(levels, nodes left, edges left): takes off nodes without an edge on `side`, round by round."""
    levels, at = None, 0
    while True:
        free = kept(_joined(nodes, edges.select(F.col(side).alias("node")).distinct(), "node", "left_anti").select("node"))
        if free.isEmpty():
            return levels, nodes, edges
        found = free.withColumn("level", F.lit(at))
        levels = found if levels is None else levels.unionByName(found)
        nodes = kept(_joined(nodes, free, "node", "left_anti"))
        edges = kept(_joined(edges, free.select(F.col("node").alias(other)), other, "left_anti"))
        at += 1


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and cycle (the smallest node of its group) of the nodes that need themselves, by way of others or at once.

    Each round gives every node the smallest name among those that it can be reached from; a group is what
    also reaches back to the node of that name. Groups go, and the rest is looked at again.
    """
    found = None
    while not nodes.isEmpty():
        colour = kept(nodes.select("node", F.col("node").alias("colour")))
        while True:
            coming = _joined(edges, colour.withColumnRenamed("node", "needs"), "needs").groupBy("node").agg(F.min("colour").alias("lower"))
            following = kept(_joined(colour, coming, "node", "left").select("node", F.least("colour", F.coalesce("lower", "colour")).alias("colour"), (F.col("lower") < F.col("colour")).alias("moved")))
            colour = following.select("node", "colour")
            if following.where("moved").isEmpty():
                break
        # Inside one colour, from the node of that name against the references.
        inside = kept(_joined(_joined(edges, colour, "node"), colour.select(F.col("node").alias("needs"), F.col("colour").alias("of_needs")), "needs").where("colour = of_needs").select("node", "needs"))
        reached = frontier = kept(colour.where("node = colour").select("node"))
        while not frontier.isEmpty():
            frontier = kept(_joined(_joined(inside, frontier, "node").select(F.col("needs").alias("node")).distinct(), reached, "node", "left_anti"))
            reached = kept(reached.unionByName(frontier))
        own = _joined(colour, reached, "node")
        size = own.groupBy("colour").agg(F.count(F.lit(1)).alias("size"))
        loops = edges.where("node = needs").select("node").distinct().withColumn("loop", F.lit(True))
        groups = _joined(_joined(own, size, "colour"), loops, "node", "left").where("size > 1 or loop").select("node", F.col("colour").alias("cycle"))
        found = groups if found is None else found.unionByName(groups)
        nodes = kept(_joined(nodes, reached, "node", "left_anti"))
        edges = kept(_joined(_joined(edges, nodes, "node", "left_semi"), nodes.select(F.col("node").alias("needs")), "needs", "left_semi"))
    return found if found is not None else nodes.withColumn("cycle", F.col("node"))


def reach(start: DataFrame, edges: DataFrame) -> DataFrame:
    """node: the starting nodes and all that need one of them, directly or by way of others."""
    reached = frontier = kept(start.select("node").distinct())
    while not frontier.isEmpty():
        frontier = kept(_joined(_joined(edges, frontier.select(F.col("node").alias("needs")), "needs", "left_semi").select("node").distinct(), reached, "node", "left_anti"))
        reached = kept(reached.unionByName(frontier))
    return reached


def analyse(cells: DataFrame) -> DataFrame:
    """node, level, cycle, blocked, uncertain for every cell with a number or a formula.

    level counts the longest chain of references below a cell, 0 for a root; it is null in a cycle and above
    one. cycle names a circular group, blocked cells need one, uncertain cells rest on a draw. References to
    cells that are empty or hold a text count for nothing here.
    """
    nodes = kept(cells.where("input_num is not null or startswith(input_text, '=')").select(F.concat_ws("!", "sheet", "address").alias("node")).distinct())
    edges = kept(_joined(references(cells), nodes.select(F.col("node").alias("needs")), "needs", "left_semi"))
    levels, left, inner = _peel(nodes, edges, "node", "needs")
    _, tangled, knots = _peel(left, inner, "needs", "node")
    circular = kept(cycles(tangled, knots))
    uncertain = reach(_joined(draws(cells), nodes, "node", "left_semi"), edges).withColumn("uncertain", F.lit(True))
    stuck = _joined(left, circular, "node", "left_anti").withColumn("blocked", F.lit(True))
    levels = levels if levels is not None else nodes.limit(0).withColumn("level", F.lit(0))
    found = reduce(lambda a, b: _joined(a, b, "node", "left"), (levels, circular, stuck, uncertain), nodes)
    return found.select("node", "level", "cycle", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"))
