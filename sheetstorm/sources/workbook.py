"""The workbook file: JSON with format, version, sheets and scenarios; checked when it is read."""

from __future__ import annotations

import json
import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scenarios import Dimension, Scenario, Sensitivity
from ..plans.compiler import Series, Sheet, parse_number
from ..plans.formulas import is_valid_name, rename, split_address
from ..plans.periods import GRANULARITIES

FORMAT, VERSION = "sheetstorm-workbook", 1
TYPES = ("flow", "level", "rate")
ADDRESS = re.compile(r"[A-Z]{1,3}[1-9][0-9]*")


class WorkbookError(ValueError):
    """The text is no workbook that can be read."""


def loads(text: str, formats: tuple[str, ...] = (FORMAT,)) -> tuple[list[Sheet], list[Scenario | Sensitivity]]:
    """Sheets and scenarios of a file's text. Files of other programs are read if their format is listed."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise WorkbookError("The file is no JSON") from e
    if not isinstance(data, dict) or data.get("format") not in formats:
        raise WorkbookError("The file is no workbook")
    if data.get("version") != VERSION:
        raise WorkbookError(f"Version {data.get('version')} is not known")
    if not isinstance(data.get("sheets"), list) or not data["sheets"]:
        raise WorkbookError("A workbook has at least one sheet")
    sheets = [_sheet(x) for x in data["sheets"]]
    if len({s.name for s in sheets}) < len(sheets):
        raise WorkbookError("Sheet names are unique")
    names = [name.lower() for s in sheets for name in s.names]
    if len(set(names)) < len(names):
        raise WorkbookError("Names are unique in a workbook")
    return sheets, [_scenario(x) for x in data.get("scenarios") or []]


def _sheet(x: object) -> Sheet:
    if not isinstance(x, dict):
        raise WorkbookError("A sheet has a name and cells")
    name, cells = x.get("name"), x.get("cells")
    if not isinstance(name, str) or not name.strip() or not isinstance(cells, dict):
        raise WorkbookError("A sheet has a name and cells")
    for address, content in cells.items():
        if not ADDRESS.fullmatch(address) or isinstance(content, bool) or not isinstance(content, (int, float, str)):
            raise WorkbookError(f"{name}!{address} is no cell")
    series = None
    if x.get("series") is not None:
        s = x["series"]
        if s.get("granularity") not in GRANULARITIES or s.get("type", "level") not in TYPES:
            raise WorkbookError(f"The series of {name} is not known")
        series = Series(s["granularity"], s.get("type", "level"), tuple(s.get("columns") or ["Value"]))
    names = x.get("names") or {}
    if not all(is_valid_name(n) and ADDRESS.fullmatch(str(a)) for n, a in names.items()):
        raise WorkbookError(f"A name of {name} is not valid")
    return Sheet(name, dict(cells), series, dict(names))


def _cell(x: dict) -> str:
    return f"{x['sheet']}!{x['address']}"


def _scenario(x: dict) -> Scenario | Sensitivity:
    samples = x.get("samples")
    samples = int(samples) if isinstance(samples, (int, float)) and samples > 0 else 10_000
    outputs = tuple(map(_cell, x.get("outputs", [])))
    if x.get("kind") == "sensitivity":
        steps = tuple(float(h) for h in x.get("steps", []))
        if not all(0 < h < 1 for h in steps):
            raise WorkbookError("A step lies between 0 and 1")
        return Sensitivity(x.get("name", ""), outputs, tuple(map(_cell, x.get("inputs", []))), steps, samples)
    dimensions = []
    for d in x.get("dimensions", []):
        if d.get("kind") == "group":
            dimensions.append(Dimension(d.get("name", ""), tuple(map(_cell, d["cells"])), tuple((v["label"], tuple(v["inputs"])) for v in d["variants"])))
        else:
            cell = _cell(d["cell"])
            dimensions.append(Dimension(d.get("name", cell), (cell,), tuple((a["label"], (a["input"],)) for a in d["alternatives"])))
    return Scenario(x.get("name", ""), outputs, tuple(dimensions), samples)


def dumps(sheets: list[Sheet], scenarios: list[Scenario | Sensitivity] | None = None) -> str:
    """The file's text: two spaces of indent and a line end at the end."""
    of = lambda cell: dict(zip(("sheet", "address"), cell.rsplit("!", 1), strict=True))
    out: dict = {"format": FORMAT, "version": VERSION, "sheets": []}
    for s in sheets:
        x: dict = {"name": s.name, "cells": s.cells}
        if s.series:
            x["series"] = {"granularity": s.series.granularity, "type": s.series.type, "columns": list(s.series.columns)}
        if s.names:
            x["names"] = s.names
        out["sheets"].append(x)
    if scenarios:
        out["scenarios"] = []
        for c in scenarios:
            x = {"name": c.name, "outputs": [of(o) for o in c.outputs], "samples": c.samples}
            if isinstance(c, Sensitivity):
                x |= {"kind": "sensitivity", "inputs": [of(i) for i in c.inputs], "steps": list(c.steps)}
            else:
                x["dimensions"] = [
                    {"kind": "group", "name": d.name, "cells": [of(k) for k in d.cells], "variants": [{"label": label, "inputs": list(v)} for label, v in d.alternatives]} for d in c.dimensions
                ]
            out["scenarios"].append(x)
    return json.dumps(out, indent=2, ensure_ascii=False) + "\n"


def load(path: str, **options) -> tuple[list[Sheet], list[Scenario | Sensitivity]]:
    with open(path, encoding="utf-8") as file:
        return loads(file.read(), **options)


def save(path: str, sheets: list[Sheet], scenarios: list[Scenario | Sensitivity] | None = None) -> None:
    with open(path, "w", encoding="utf-8") as file:
        file.write(dumps(sheets, scenarios))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """sheet, address, row, column, input_num, input_text of workbook files, many at once: one row per cell."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "struct<sheets array<struct<name string, cells map<string, string>>>>").alias("w"))
    cells = raw.select("file", F.explode("w.sheets").alias("s")).select("file", F.col("s.name").alias("sheet"), F.explode("s.cells").alias("address", "input"))
    return _cell_columns(cells)


def _cell_columns(cells: DataFrame) -> DataFrame:
    letters = F.regexp_extract("address", "^([A-Z]+)", 1)
    column = F.aggregate(F.split(letters, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))
    number = F.when(~F.col("input").startswith("="), F.expr("try_cast(input AS double)"))
    return cells.select(
        *[c for c in cells.columns if c != "input"], F.regexp_extract("address", "([0-9]+)$", 1).cast("int").alias("row"), column.alias("column"), number.alias("input_num"), F.when(number.isNull(), F.col("input")).alias("input_text")
    )


def cells_from(df: DataFrame, sheet: str, address: Column, content: Column) -> DataFrame:
    """The same columns for the rows of a table: each is a cell of a sheet, with an address and what is typed in it."""
    return _cell_columns(df.select(F.lit(sheet).alias("sheet"), F.upper(address).alias("address"), content.cast("string").alias("input")).where("input is not null and trim(input) <> ''"))


def cells_table(spark: SparkSession, sheets: list[Sheet]) -> DataFrame:
    """The same columns for sheets in memory."""
    rows = [(s.name, a.upper(), repr(float(x)) if isinstance(x, (int, float)) else x) for s in sheets for a, x in s.cells.items()]
    return _cell_columns(spark.createDataFrame(rows, "sheet string, address string, input string"))


def last_row(sheet: Sheet) -> int:
    return max((split_address(a.upper())[0] for a, x in sheet.cells.items() if x != ""), default=0)


def set_cell(sheets: list[Sheet], sheet: str, address: str, content) -> list[Sheet]:
    """New sheets with one cell set, as typed: numbers and formulas are trimmed, texts kept, a blank clears."""
    if isinstance(content, str):
        stripped = content.strip()
        number = None if stripped.startswith("=") else parse_number(stripped) if stripped else None
        content = stripped if stripped.startswith("=") or not stripped else content if number is None else number
    changed = lambda s: {k: v for k, v in s.cells.items() if k != address} | ({} if content in ("", None) else {address: content})
    return [replace(s, cells=changed(s)) if s.name == sheet else s for s in sheets]


def add_sheet(sheets: list[Sheet], name: str) -> list[Sheet]:
    if any(s.name == name for s in sheets) or not name.strip():
        raise WorkbookError(f"There is a sheet {name} already")
    return [*sheets, Sheet(name)]


def list_names(sheets: list[Sheet]) -> list[tuple[str, str, str]]:
    """(name, sheet, address), A to Z whatever the case."""
    return sorted(((n, s.name, a) for s in sheets for n, a in s.names.items()), key=lambda x: x[0].lower())


def set_name(sheets: list[Sheet], name: str, sheet: str, address: str) -> list[Sheet]:
    if not is_valid_name(name) or any(n.lower() == name.lower() for n, *_ in list_names(sheets)):
        raise WorkbookError(f"{name} can't be a name")
    return [replace(s, names=s.names | {name: address}) if s.name == sheet else s for s in sheets]


def rename_name(sheets: list[Sheet], old: str, new: str) -> list[Sheet]:
    """The name and every formula that uses it."""
    if not is_valid_name(new) or (old.lower() != new.lower() and any(n.lower() == new.lower() for n, *_ in list_names(sheets))):
        raise WorkbookError(f"{new} can't be a name")
    return [
        replace(s, names={new if n.lower() == old.lower() else n: a for n, a in s.names.items()}, cells={a: rename(x, old, new) if isinstance(x, str) else x for a, x in s.cells.items()})
        for s in sheets
    ]


def add_series_column(sheets: list[Sheet], sheet: str, column: str) -> list[Sheet]:
    return [replace(s, series=replace(s.series, columns=(*s.series.columns, column))) if s.name == sheet and s.series else s for s in sheets]


def rename_series_column(sheets: list[Sheet], sheet: str, old: str, new: str) -> list[Sheet]:
    return [replace(s, series=replace(s.series, columns=tuple(new if c == old else c for c in s.series.columns))) if s.name == sheet and s.series else s for s in sheets]
