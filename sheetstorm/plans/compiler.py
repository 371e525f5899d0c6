"""From a workbook's cells to a Program: references, order, types, folding; an error stops its cell only."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.random import stream_of
from . import periods as P
from .formulas import FormulaError, Node, join_address, parse, split_address
from .programs import NAN, Program

Key = tuple[str, str]
MOST_CELLS = 10_000


class CellError(Exception):
    def __init__(self, code: str, message: str, inherited: bool = False):
        super().__init__(message)
        self.code, self.message, self.inherited = code, message, inherited


@dataclass(frozen=True)
class Series:
    granularity: str
    type: str = "level"
    columns: tuple[str, ...] = ("Value",)


@dataclass
class Sheet:
    name: str
    cells: dict[str, float | int | str] = field(default_factory=dict)
    series: Series | None = None
    names: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Value:
    reg: int
    granularity: str | None = None


@dataclass
class Compiled:
    program: Program
    cells: dict[Key, Value]
    errors: dict[Key, CellError]
    roots: set[Key]
    texts: dict[Key, str]

    def find(self, cell: str) -> Value:
        """`Sheet!A1` or, with one sheet, `A1`."""
        sheet, _, address = cell.rpartition("!")
        for key, value in self.cells.items():
            if key[1] == address.upper() and (not sheet or key[0].lower() == sheet.lower()):
                return value
        for key, error in self.errors.items():
            if key[1] == address.upper() and (not sheet or key[0].lower() == sheet.lower()):
                raise error
        raise KeyError(f"no such output: {cell}")


def parse_number(text: str) -> float | None:
    """What counts as a number when typed as text: decimal, exponent, hexadecimal, Infinity; space around is fine."""
    text = text.strip()
    if re.fullmatch(r"[+-]?Infinity", text):
        return -math.inf if text[0] == "-" else math.inf
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", text):
        return float(int(text, 16))
    return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else None


def parse_cell(value: float | int | str) -> Node | str:
    """A tree, or the label itself."""
    if not isinstance(value, str):
        return Node("number", float(value))
    if value.startswith("="):
        return parse(value)
    number = parse_number(value)
    if number is not None:
        return Node("number", number)
    period = P.parse_period(value)
    return Node("period", period) if period and period[0] != "year" else value


class _Compiler:
    def __init__(self, sheets: list[Sheet], inputs: dict[str, str | None], program: Program | None = None):
        self.program = Program() if program is None else program
        self.sheets = {s.name.lower(): s for s in sheets}
        self.inputs = {k.lower(): (k, g) for k, g in inputs.items()}
        self.names = {n.lower(): (s.name, a.upper()) for s in sheets for n, a in s.names.items()}
        self.nodes: dict[Key, Node] = {}
        self.texts: dict[Key, str] = {}
        self.values: dict[Key, Value] = {}
        self.errors: dict[Key, CellError] = {}
        for sheet in sheets:
            for address, content in sheet.cells.items():
                key = (sheet.name, address.upper())
                try:
                    node = parse_cell(content)
                    if isinstance(node, str):
                        self.texts[key] = node
                    else:
                        self.nodes[key] = node
                except FormulaError as e:
                    self.errors[key] = CellError("#ERROR!", str(e))
        self.rows = {s.name: self._series_rows(s) for s in sheets if s.series}
        self.here: Key = ("", "")
        self.draws = 0

    # Cells and their order

    def _series_rows(self, sheet: Sheet) -> list[tuple[int, int]]:
        """(period, row) of column A, in period order; of repeated periods the first row."""
        found: dict[int, int] = {}
        for address, content in sheet.cells.items():
            row, column = split_address(address.upper())
            if column == 1:
                period = P.parse_period(str(int(content)) if isinstance(content, float) and content.is_integer() else str(content))
                if period and period[0] == sheet.series.granularity:
                    found[period[1]] = min(row, found.get(period[1], row))
        return sorted(found.items())

    def key(self, sheet: str | None, address: str) -> Key:
        found = self.sheets.get((sheet if sheet is not None else self.here[0]).lower())
        if found is None:
            raise CellError("#REF!", f"There is no sheet {sheet}")
        return found.name, address

    def range_keys(self, node: Node) -> list[list[Key]]:
        sheet, first, last = node.value
        (r1, c1), (r2, c2) = split_address(first), split_address(last)
        rows, columns = range(min(r1, r2), max(r1, r2) + 1), range(min(c1, c2), max(c1, c2) + 1)
        if len(rows) * len(columns) > MOST_CELLS:
            raise CellError("#VALUE!", f"A range has at most {MOST_CELLS} cells")
        return [[self.key(sheet, join_address(r, c)) for c in columns] for r in rows]

    def series_keys(self, node: Node) -> tuple[Sheet, list[tuple[int, Key]]]:
        name, column = node.value
        sheet = self.sheets.get(name.lower())
        if sheet is None or sheet.series is None:
            raise CellError("#REF!", f"There is no series {name}")
        names = [c.lower() for c in sheet.series.columns]
        if column is not None and column.lower() not in names:
            raise CellError("#REF!", f"{name} has no column {column}")
        number = 2 + (names.index(column.lower()) if column is not None else 0)
        return sheet, [(period, (sheet.name, join_address(row, number))) for period, row in self.rows[sheet.name]]

    def depends(self, key: Key) -> list[Key]:
        self.here = key
        found, todo = [], [self.nodes[key]]
        while todo:
            node = todo.pop()
            todo += node.parts
            try:
                if node.kind == "ref":
                    found.append(self.key(*node.value))
                elif node.kind == "range":
                    found += [k for row in self.range_keys(node) for k in row]
                elif node.kind == "name" and node.value.lower() in self.names:
                    found.append(self.names[node.value.lower()])
                elif node.kind == "series":
                    found += [k for _, k in self.series_keys(node)[1]]
            except (CellError, FormulaError):
                pass
        return [k for k in dict.fromkeys(found) if k in self.nodes]

    def order(self) -> list[list[Key]]:
        """Strongly connected groups of cells, dependencies first (Tarjan, without recursion)."""
        edges = {k: self.depends(k) for k in self.nodes}
        number: dict[Key, int] = {}
        low: dict[Key, int] = {}
        stack: list[Key] = []
        on_stack: set[Key] = set()
        groups: list[list[Key]] = []
        for start in self.nodes:
            if start in number:
                continue
            walk = [(start, iter(edges[start]))]
            number[start] = low[start] = len(number)
            stack.append(start)
            on_stack.add(start)
            while walk:
                key, rest = walk[-1]
                for other in rest:
                    if other not in number:
                        number[other] = low[other] = len(number)
                        stack.append(other)
                        on_stack.add(other)
                        walk.append((other, iter(edges[other])))
                        break
                    if other in on_stack:
                        low[key] = min(low[key], number[other])
                else:
                    walk.pop()
                    if walk:
                        low[walk[-1][0]] = min(low[walk[-1][0]], low[key])
                    if low[key] == number[key]:
                        group = []
                        while not group or group[-1] != key:
                            group.append(stack.pop())
                            on_stack.discard(group[-1])
                        groups.append(group)
        self.edges = edges
        return groups

    def run(self) -> Compiled:
        for group in self.order():
            if len(group) > 1 or group[0] in self.edges[group[0]]:
                self.errors |= {k: CellError("#CIRC!", "The cell depends on itself") for k in group}
                continue
            key = self.here = group[0]
            self.draws = 0
            try:
                self.values[key] = self.emit(self.nodes[key])
            except CellError as e:
                self.errors[key] = e
        roots = {k for k, edges in self.edges.items() if not edges and not any(n.kind in ("ref", "range", "name", "series") for n in _walk(self.nodes[k]))}
        return Compiled(self.program, self.values, self.errors, roots, self.texts)

    # Values

    def cell(self, key: Key) -> Value:
        if key in self.values:
            return self.values[key]
        if key in self.errors:
            raise CellError(self.errors[key].code, f"Depends on {key[0]}!{key[1]}", inherited=True)
        if key in self.texts:
            raise CellError("#VALUE!", f"{key[0]}!{key[1]} is a text")
        if key in self.nodes:
            raise CellError("#CIRC!", f"{key[0]}!{key[1]} is not known yet", inherited=True)
        return Value(self.program.const(0))

    def number(self, value: Value) -> int:
        if value.granularity:
            raise CellError("#VALUE!", "A number is needed, not a period")
        return value.reg

    def emit(self, node: Node) -> Value:
        p = self.program
        if node.kind == "number":
            return Value(p.const(node.value))
        if node.kind == "period":
            return Value(p.const(node.value[1]), node.value[0])
        if node.kind == "broken":
            raise CellError("#REF!", "The reference is lost")
        if node.kind == "ref":
            return self.cell(self.key(*node.value))
        if node.kind == "name":
            return self.named(node.value)
        if node.kind == "sign":
            return Value(p.un("neg", self.number(self.emit(node.parts[0]))))
        if node.kind == "percent":
            return Value(p.bin("div", self.number(self.emit(node.parts[0])), p.const(100)))
        if node.kind == "binary":
            return self.binary(node.value, *map(self.emit, node.parts))
        if node.kind == "call":
            return self.call(node.value, node.parts)
        if node.kind == "series":
            if len(node.parts) > 1:
                raise CellError("#VALUE!", "A range of periods belongs inside a function such as SUM")
            sheet, keys = self.series_keys(node)
            return self.lookup(sheet, keys, self.emit(node.parts[0]))
        raise CellError("#VALUE!", "A range belongs inside a function")

    def named(self, name: str) -> Value:
        if name.lower() in self.names:
            return self.cell(self.names[name.lower()])
        if name.lower() in self.inputs:
            column, granularity = self.inputs[name.lower()]
            return Value(self.program.emit("input", column), granularity)
        if name.upper() in ("TRUE", "FALSE"):
            return Value(self.program.const(name.upper() == "TRUE"))
        raise CellError("#NAME?", f"Unknown name {name}")

    def binary(self, op: str, a: Value, b: Value) -> Value:
        p = self.program
        fn = {"+": "add", "-": "sub", "*": "mul", "/": "div", "^": "pow", "=": "eq", "<>": "ne", "<": "lt", ">": "gt", "<=": "le", ">=": "ge"}[op]
        x, y = a.granularity, b.granularity
        if not (x or y):
            return Value(p.bin(fn, a.reg, b.reg))
        if op in BINARY_COMPARISONS:
            if x == y:
                return Value(p.bin(fn, a.reg, b.reg))
            raise CellError("#VALUE!", "Only periods of one granularity compare")
        if op == "+" and not (x and y):
            return Value(p.bin("add", a.reg, b.reg), x or y)
        if op == "-" and x and not y:
            return Value(p.bin("sub", a.reg, b.reg), x)
        if op == "-" and x == y:
            return Value(p.bin("sub", a.reg, b.reg))
        raise CellError("#VALUE!", f"{op} does not fit these periods")

    def common(self, values: list[Value]) -> str | None:
        kinds = {v.granularity for v in values}
        if len(kinds) > 1:
            raise CellError("#VALUE!", "Numbers and periods of other granularities don't mix")
        return kinds.pop() if kinds else None

    # Ranges

    def items(self, node: Node) -> list[Value | None]:
        """The values of an argument; in a range, None for empty cells and texts."""
        if node.kind == "range":
            return [self.item(k) for row in self.range_keys(node) for k in row]
        if node.kind == "series" and len(node.parts) > 1:
            first, last = map(self.emit, node.parts)
            a, b = self.program.value(first.reg), self.program.value(last.reg)
            if a is None or b is None or first.granularity != last.granularity or b < a or b - a >= MOST_CELLS:
                raise CellError("#VALUE!", "A range of periods has two written ends of one granularity, in order")
            sheet, keys = self.series_keys(node)
            return [self.lookup(sheet, keys, Value(self.program.const(t), first.granularity)) for t in range(int(a), int(b) + 1)]
        return [self.emit(node)]

    def item(self, key: Key) -> Value | None:
        return None if key in self.texts or (key not in self.values and key not in self.errors and key not in self.nodes) else self.cell(key)

    def table(self, node: Node) -> list[list[Key]]:
        if node.kind == "ref":
            return [[self.key(*node.value)]]
        if node.kind != "range":
            raise CellError("#VALUE!", "A range is needed")
        return self.range_keys(node)

    def list_of(self, node: Node) -> list[Key]:
        rows = self.table(node)
        if len(rows) > 1 and len(rows[0]) > 1:
            raise CellError("#VALUE!", "One row or one column is needed")
        return [k for row in rows for k in row]

    def fold(self, fn: str, regs: list[int], none: float = 0.0) -> int:
        if not regs:
            return self.program.const(none)
        out = regs[0]
        for reg in regs[1:]:
            out = self.program.bin(fn, out, reg)
        return out

    def pick(self, position: int, keys: list[Key]) -> Value:
        """The cell at a whole position from 1: an empty one is 0, a text or another position NaN."""
        p = self.program
        cells = [Value(p.const(NAN)) if k in self.texts else self.cell(k) for k in keys]
        kind = self.common([c for k, c in zip(keys, cells, strict=True) if k in self.values or k in self.errors] or cells)
        fixed = p.value(position)
        if fixed is not None:
            whole = math.floor(fixed) if math.isfinite(fixed) else 0
            return Value(cells[whole - 1].reg if 1 <= whole <= len(cells) else p.const(NAN), kind)
        whole, out = p.un("floor", position), p.const(NAN)
        for i, c in reversed([*enumerate(cells, 1)]):
            out = p.select(p.bin("eq", whole, p.const(i)), c.reg, out)
        return Value(out, kind)

    def position(self, wanted: Value, keys: list[Key], kind: float) -> int:
        p = self.program
        cells = [(i, v) for i, v in enumerate(map(self.item, keys), 1) if v is not None]
        self.common([wanted, *(v for _, v in cells)])
        out = p.const(NAN)
        if kind == 0:
            for i, v in reversed(cells):
                out = p.select(p.bin("eq", v.reg, wanted.reg), p.const(i), out)
        else:
            for i, v in cells:
                out = p.select(p.bin("le" if kind > 0 else "ge", v.reg, wanted.reg), p.const(i), out)
        return out

    # Periods

    def floor_div(self, a: int, b: float) -> int:
        return self.program.un("floor", self.program.bin("div", a, self.program.const(b)))

    def sum_of(self, *terms: int | float) -> int:
        p = self.program
        return self.fold("add", [t if isinstance(t, int) and not isinstance(t, bool) else p.const(t) for t in terms])

    def serial(self, year: int, month: int, day: int) -> int:
        """Registers of year, month and day to the serial, carrying over; years begin in March here."""
        p = self.program
        months = p.bin("add", p.bin("mul", year, p.const(12)), p.bin("sub", month, p.const(3)))
        y = self.floor_div(months, 12)
        m = p.bin("sub", months, p.bin("mul", y, p.const(12)))
        of_year = self.floor_div(p.bin("add", p.bin("mul", m, p.const(153)), p.const(2)), 5)
        leap = p.bin("add", p.bin("sub", self.floor_div(y, 4), self.floor_div(y, 100)), self.floor_div(y, 400))
        return self.sum_of(p.bin("mul", y, p.const(365)), leap, of_year, day, p.const(-719469 + P.EPOCH_SERIAL))

    def date(self, serial: int) -> tuple[int, int, int]:
        p = self.program
        days = p.bin("add", serial, p.const(719468 - P.EPOCH_SERIAL))
        cycle = self.floor_div(days, 146097)
        day = p.bin("sub", days, p.bin("mul", cycle, p.const(146097)))
        gone = p.bin("sub", p.bin("add", p.bin("sub", day, self.floor_div(day, 1460)), self.floor_div(day, 36524)), self.floor_div(day, 146096))
        y = self.floor_div(gone, 365)
        leap = p.bin("sub", self.floor_div(y, 4), self.floor_div(y, 100))
        of_year = p.bin("sub", day, p.bin("add", p.bin("mul", y, p.const(365)), leap))
        m = self.floor_div(p.bin("add", p.bin("mul", of_year, p.const(5)), p.const(2)), 153)
        start = self.floor_div(p.bin("add", p.bin("mul", m, p.const(153)), p.const(2)), 5)
        late = p.bin("ge", m, p.const(10))
        month = p.bin("add", m, p.select(late, p.const(-9), p.const(3)))
        year = self.sum_of(y, p.bin("mul", cycle, p.const(400)), late)
        return year, month, p.bin("add", p.bin("sub", of_year, start), p.const(1))

    def first_day(self, reg: int, kind: str) -> int:
        p = self.program
        if kind == "day":
            return reg
        if kind == "hour":
            return self.floor_div(reg, 24)
        if kind == "week":
            return p.bin("add", p.bin("mul", reg, p.const(7)), p.const(P.FIRST_MONDAY))
        month = self.month(reg, kind)
        year = self.floor_div(month, 12)
        return self.serial(year, p.bin("add", p.bin("sub", month, p.bin("mul", year, p.const(12))), p.const(1)), p.const(1))

    def month(self, reg: int, kind: str) -> int:
        p = self.program
        if kind in ("month", "quarter", "year"):
            return p.bin("mul", reg, p.const({"month": 1, "quarter": 3, "year": 12}[kind])) if kind != "month" else reg
        year, month, _ = self.date(self.first_day(reg, kind))
        return p.bin("add", p.bin("mul", year, p.const(12)), p.bin("sub", month, p.const(1)))

    def convert(self, reg: int, source: str, target: str) -> int:
        p = self.program
        if source == target:
            return reg
        if target in ("month", "quarter", "year"):
            month = self.month(reg, source)
            return month if target == "month" else self.floor_div(month, 3 if target == "quarter" else 12)
        day = self.first_day(reg, source)
        if target == "day":
            return day
        return p.bin("mul", day, p.const(24)) if target == "hour" else self.floor_div(p.bin("sub", day, p.const(P.FIRST_MONDAY)), 7)

    # Series

    def filled(self, sheet: Sheet, keys: list[tuple[int, Key]]) -> list[tuple[int, int]]:
        """(period, register) of each row, with empty entries filled as the type says."""
        p, kind, last, out = self.program, sheet.series.type, None, []
        for period, key in keys:
            empty = key not in self.values and key not in self.errors and key not in self.texts and key not in self.nodes
            if not empty:
                last = self.number(self.cell(key))
                out.append((period, last))
            elif kind == "flow":
                out.append((period, p.const(0)))
            else:
                out.append((period, last if kind == "level" and last is not None else p.const(NAN)))
        return out

    def lookup(self, sheet: Sheet, keys: list[tuple[int, Key]], time: Value) -> Value:
        p, own, kind = self.program, sheet.series.granularity, sheet.series.type
        asked = time.granularity or ("year" if own == "year" else None)
        if asked is None:
            raise CellError("#VALUE!", "A series is looked up by a period")
        rows = self.filled(sheet, keys)
        rank = P.GRANULARITIES.index
        if asked == own:
            return self.at(rows, time.reg)
        if rank(asked) > rank(own):
            groups: dict[int, list[int]] = {}
            for period, reg in rows:
                groups.setdefault(P.convert(period, own, asked), []).append(reg)
            value = {"flow": lambda g: self.fold("add", g), "level": lambda g: g[-1], "rate": lambda g: p.bin("div", self.fold("add", g), p.const(len(g)))}[kind]
            return self.at([(k, value(g)) for k, g in sorted(groups.items())], time.reg)
        following = dict(rows)
        out = []
        for period, reg in rows:
            start = P.convert(period, own, asked)
            length = P.convert(period + 1, own, asked) - start
            if kind == "flow":
                reg = p.bin("div", reg, p.const(length))
            elif kind == "level" and period + 1 in following:
                after = following[period + 1]
                part = p.bin("div", p.bin("sub", time.reg, p.const(start)), p.const(length))
                moved = p.bin("add", reg, p.bin("mul", part, p.bin("sub", after, reg)))
                finite = p.un("finite", after)
                reg = (moved if p.value(finite) else reg) if p.value(finite) is not None else p.select(finite, moved, reg)
            out.append((period, reg))
        fixed = p.value(time.reg)
        inside = p.const(P.convert(int(fixed), asked, own)) if fixed is not None and float(fixed).is_integer() else self.convert(time.reg, asked, own)
        return self.at(out, inside)

    def at(self, rows: list[tuple[int, int]], time: int) -> Value:
        """A literal time finds its row or is #N/A; a computed one that finds none is NaN."""
        p = self.program
        fixed = p.value(time)
        if fixed is not None:
            for period, reg in rows:
                if period == fixed:
                    return Value(reg)
            raise CellError("#N/A", "The series has no such period")
        out = p.const(NAN)
        for period, reg in reversed(rows):
            out = p.select(p.bin("eq", time, p.const(period)), reg, out)
        return Value(out)

    # Functions

    def call(self, name: str, parts: tuple[Node, ...]) -> Value:
        found = FUNCTIONS.get(name)
        if found is None:
            raise CellError("#NAME?", f"Unknown function {name}")
        least, most, how = found
        if not least <= len(parts) <= most:
            raise CellError("#NAME?", f"{name} does not take {len(parts)} arguments")
        return how(self, parts)

    def draw(self, kind: str, regs: list[int]) -> Value:
        stream = stream_of(self.here[0], self.here[1], self.draws)
        self.draws += 1
        return Value(self.program.emit("draw", kind, stream, tuple(regs)))

    def rounded(self, parts: tuple[Node, ...], mode: str) -> Value:
        p = self.program
        x = self.number(self.emit(parts[0]))
        written = written_number(parts[1]) if len(parts) > 1 else 0.0
        scale = p.const(10.0**written) if written is not None and abs(written) < 300 else p.bin("pow", p.const(10), self.number(self.emit(parts[1])))
        size = p.bin("mul", p.un("abs", x), scale)
        whole = {"half": lambda: p.un("floor", p.bin("add", size, p.const(0.5))), "down": lambda: p.un("floor", size), "up": lambda: p.un("neg", p.un("floor", p.un("neg", size)))}[mode]()
        sign = p.select(p.bin("lt", x, p.const(0)), p.const(-1), p.const(1))
        return Value(p.bin("div", p.bin("mul", sign, whole), scale))


BINARY_COMPARISONS = frozenset(["=", "<>", "<", ">", "<=", ">="])


def written_number(node: Node) -> float | None:
    """The number that a formula spells out, with or without a minus; None for anything that is calculated."""
    if node.kind == "sign" and node.parts[0].kind == "number":
        return -float(node.parts[0].value)
    return float(node.value) if node.kind == "number" else None


def _walk(node: Node):
    yield node
    for part in node.parts:
        yield from _walk(part)


def _unary(fn: str) -> Callable:
    return lambda c, parts: Value(c.program.un(fn, c.number(c.emit(parts[0]))))


def _present(c: _Compiler, parts: tuple[Node, ...]) -> list[Value]:
    return [v for part in parts for v in c.items(part) if v is not None]


def _extreme(fn: str) -> Callable:
    def how(c: _Compiler, parts: tuple[Node, ...]) -> Value:
        found = _present(c, parts)
        return Value(c.fold(fn, [v.reg for v in found]), c.common(found))

    return how


def _total(fn: str) -> Callable:
    return lambda c, parts: Value(c.fold(fn, [c.number(v) for v in _present(c, parts)]))


def _average(c: _Compiler, parts: tuple[Node, ...]) -> Value:
    found = [c.number(v) for v in _present(c, parts)]
    if not found:
        raise CellError("#DIV/0!", "There is nothing to average")
    return Value(c.program.bin("div", c.fold("add", found), c.program.const(len(found))))


def _truths(fn: str) -> Callable:
    def how(c: _Compiler, parts: tuple[Node, ...]) -> Value:
        p = c.program
        found = [p.bin("ne", c.number(v), p.const(0)) for v in _present(c, parts)]
        if not found:
            raise CellError("#VALUE!", "There is nothing to test")
        return Value(c.fold(fn, found))

    return how


def _if(c: _Compiler, parts: tuple[Node, ...]) -> Value:
    cond = c.number(c.emit(parts[0]))
    then = c.emit(parts[1])
    other = c.emit(parts[2]) if len(parts) > 2 else Value(c.program.const(0), then.granularity)
    return Value(c.program.select(cond, then.reg, other.reg), c.common([then, other]))


def _iferror(c: _Compiler, parts: tuple[Node, ...]) -> Value:
    try:
        first = c.emit(parts[0])
    except CellError as e:
        if e.inherited:
            raise
        return c.emit(parts[1])
    second = c.emit(parts[1])
    return Value(c.program.select(c.program.un("finite", first.reg), first.reg, second.reg), c.common([first, second]))


def _sumproduct(c: _Compiler, parts: tuple[Node, ...]) -> Value:
    tables = [c.table(part) for part in parts]
    if len({(len(t), len(t[0])) for t in tables}) > 1:
        raise CellError("#VALUE!", "The ranges differ in shape")
    zero = Value(c.program.const(0))
    columns = [[c.number(c.item(k) or zero) for row in t for k in row] for t in tables]
    return Value(c.fold("add", [c.fold("mul", list(x)) for x in zip(*columns, strict=True)]))


def _index(c: _Compiler, parts: tuple[Node, ...]) -> Value:
    p, first = c.program, c.number(c.emit(parts[1]))
    if len(parts) == 2:
        return c.pick(first, c.list_of(parts[0]))
    rows, second = c.table(parts[0]), c.number(c.emit(parts[2]))
    width = len(rows[0])
    r, k = p.un("floor", first), p.un("floor", second)
    inside = [p.bin("ge", r, p.const(1)), p.bin("le", r, p.const(len(rows))), p.bin("ge", k, p.const(1)), p.bin("le", k, p.const(width))]
    place = p.bin("add", p.bin("mul", p.bin("sub", r, p.const(1)), p.const(width)), k)
    ok = c.fold("mul", inside)
    place = (place if p.value(ok) else p.const(NAN)) if p.value(ok) is not None else p.select(ok, place, p.const(NAN))
    return c.pick(place, [x for row in rows for x in row])


def _match(c: _Compiler, parts: tuple[Node, ...]) -> Value:
    kind = written_number(parts[2]) if len(parts) > 2 else 1.0
    if kind is None:
        raise CellError("#VALUE!", "The kind of match is written as a number")
    return Value(c.position(c.emit(parts[0]), c.list_of(parts[1]), kind))


def _table_lookup(across: bool) -> Callable:
    def how(c: _Compiler, parts: tuple[Node, ...]) -> Value:
        p, rows = c.program, c.table(parts[1])
        if across:
            rows = [list(x) for x in zip(*rows, strict=True)]
        kind = p.value(c.number(c.emit(parts[3]))) if len(parts) > 3 else 1.0
        place = c.position(c.emit(parts[0]), [row[0] for row in rows], 0 if kind == 0 else 1)
        column = c.number(c.emit(parts[2]))
        fixed = p.value(column)
        if fixed is not None:
            if not 1 <= math.floor(fixed) <= len(rows[0]):
                raise CellError("#REF!", "The table has no such column")
            return c.pick(place, [row[math.floor(fixed) - 1] for row in rows])
        found = [c.pick(place, [row[i] for row in rows]) for i in range(len(rows[0]))]
        out, whole = p.const(NAN), p.un("floor", column)
        for i, v in enumerate(found, 1):
            out = p.select(p.bin("eq", whole, p.const(i)), v.reg, out)
        return Value(out, c.common(found))

    return how


def _mod(c: _Compiler, parts: tuple[Node, ...]) -> Value:
    p = c.program
    a, b = (c.number(c.emit(x)) for x in parts)
    return Value(p.bin("sub", a, p.bin("mul", b, p.un("floor", p.bin("div", a, b)))))


def _rri(c: _Compiler, parts: tuple[Node, ...]) -> Value:
    p = c.program
    n, pv, fv = (c.number(c.emit(x)) for x in parts)
    return Value(p.bin("sub", p.bin("pow", p.bin("div", fv, pv), p.bin("div", p.const(1), n)), p.const(1)))


def _normal_dist(c: _Compiler, parts: tuple[Node, ...]) -> Value:
    p, z = c.program, c.number(c.emit(parts[0]))
    if len(parts) == 1:
        return Value(p.un("phi", z))
    return Value(p.select(p.bin("ne", c.number(c.emit(parts[1])), p.const(0)), p.un("phi", z), p.un("density", z)))


def _normal_inverse(lognormal: bool) -> Callable:
    def how(c: _Compiler, parts: tuple[Node, ...]) -> Value:
        p = c.program
        x, mean, sd = (c.number(c.emit(a)) for a in parts)
        value = p.bin("add", mean, p.bin("mul", sd, p.un("phi_inverse", x)))
        value = p.select(p.bin("gt", sd, p.const(0)), value, p.const(NAN))
        return Value(p.un("exp", value) if lognormal else value)

    return how


def _draw(kind: str) -> Callable:
    def how(c: _Compiler, parts: tuple[Node, ...]) -> Value:
        place, c.draws = c.draws, c.draws + 1
        regs = [c.number(c.emit(x)) for x in parts] or [c.program.const(0), c.program.const(1)]
        stream = stream_of(c.here[0], c.here[1], place)
        return Value(c.program.emit("draw", kind, stream, tuple(regs)))

    return how


def _to_period(target: str) -> Callable:
    def how(c: _Compiler, parts: tuple[Node, ...]) -> Value:
        p, values = c.program, [c.emit(x) for x in parts]
        if len(values) == 1 and values[0].granularity:
            return Value(c.convert(values[0].reg, values[0].granularity, target), target)
        regs = [c.number(v) for v in values]
        wanted = {"year": 1, "quarter": 2, "month": 2, "day": 3}.get(target)
        if wanted is None or len(regs) != wanted:
            raise CellError("#VALUE!", f"A {target} is made of a period or of its parts")
        if target == "day":
            return Value(c.serial(*regs), "day")
        if target == "year":
            return Value(regs[0], "year")
        return Value(p.bin("add", p.bin("mul", regs[0], p.const(4 if target == "quarter" else 12)), p.bin("sub", regs[1], p.const(1))), target)

    return how


def _edge(last: bool) -> Callable:
    def how(c: _Compiler, parts: tuple[Node, ...]) -> Value:
        p, v = c.program, c.emit(parts[0])
        if not v.granularity:
            raise CellError("#VALUE!", "A period is needed")
        if not last or v.granularity == "hour":
            return Value(c.first_day(v.reg, v.granularity), "day")
        return Value(p.bin("sub", c.first_day(p.bin("add", v.reg, p.const(1)), v.granularity), p.const(1)), "day")

    return how


def _part(name: str) -> Callable:
    def how(c: _Compiler, parts: tuple[Node, ...]) -> Value:
        p, v = c.program, c.emit(parts[0])
        kind = v.granularity or "day"
        if name == "hour":
            return Value(p.bin("sub", v.reg, p.bin("mul", p.const(24), c.floor_div(v.reg, 24))) if kind == "hour" else p.const(0))
        if name in ("year", "quarter", "month"):
            month = c.month(v.reg, kind)
            year = c.floor_div(month, 12)
            rest = p.bin("sub", month, p.bin("mul", year, p.const(12)))
            return Value({"year": lambda: year, "quarter": lambda: p.bin("add", c.floor_div(rest, 3), p.const(1)), "month": lambda: p.bin("add", rest, p.const(1))}[name]())
        day = c.first_day(v.reg, kind)
        if name == "day":
            return Value(c.date(day)[2])
        before = p.bin("sub", day, p.const(1))
        return Value(p.bin("add", p.bin("sub", before, p.bin("mul", p.const(7), c.floor_div(before, 7))), p.const(1)))

    return how


MANY = 255
FUNCTIONS: dict[str, tuple[int, int, Callable]] = {
    "SQRT": (1, 1, _unary("sqrt")), "EXP": (1, 1, _unary("exp")), "LN": (1, 1, _unary("ln")), "ABS": (1, 1, _unary("abs")), "INT": (1, 1, _unary("floor")),
    "POWER": (2, 2, lambda c, x: Value(c.program.bin("pow", c.number(c.emit(x[0])), c.number(c.emit(x[1]))))),
    "MIN": (1, MANY, _extreme("min")), "MAX": (1, MANY, _extreme("max")), "SUM": (1, MANY, _total("add")), "PRODUCT": (1, MANY, _total("mul")),
    "COUNT": (1, MANY, lambda c, x: Value(c.program.const(len(_present(c, x))))), "AVERAGE": (1, MANY, _average), "SUMPRODUCT": (1, MANY, _sumproduct),
    "AND": (1, MANY, _truths("min")), "OR": (1, MANY, _truths("max")), "NOT": (1, 1, lambda c, x: Value(c.program.bin("eq", c.number(c.emit(x[0])), c.program.const(0)))),
    "IF": (2, 3, _if), "IFERROR": (2, 2, _iferror), "TRUE": (0, 0, lambda c, x: Value(c.program.const(1))), "FALSE": (0, 0, lambda c, x: Value(c.program.const(0))),
    "INDEX": (2, 3, _index), "MATCH": (2, 3, _match), "VLOOKUP": (3, 4, _table_lookup(False)), "HLOOKUP": (3, 4, _table_lookup(True)),
    "ROUND": (2, 2, lambda c, x: c.rounded(x, "half")), "ROUNDUP": (2, 2, lambda c, x: c.rounded(x, "up")), "ROUNDDOWN": (2, 2, lambda c, x: c.rounded(x, "down")),
    "TRUNC": (1, 2, lambda c, x: c.rounded(x, "down")), "MOD": (2, 2, _mod), "RRI": (3, 3, _rri),
    "NORM.S.DIST": (2, 2, _normal_dist), "NORMSDIST": (1, 1, _normal_dist), "NORM.S.INV": (1, 1, _unary("phi_inverse")), "NORMSINV": (1, 1, _unary("phi_inverse")),
    "NORM.INV": (3, 3, _normal_inverse(False)), "NORMINV": (3, 3, _normal_inverse(False)), "LOGNORM.INV": (3, 3, _normal_inverse(True)), "LOGINV": (3, 3, _normal_inverse(True)),
    "UNIFORM": (2, 2, _draw("uniform")), "RAND": (0, 0, _draw("uniform")), "NORMAL": (2, 2, _draw("normal")), "LOGNORMAL": (2, 2, _draw("lognormal")), "TRIANGULAR": (3, 3, _draw("triangular")),
    "PERIOD.YEAR": (1, 1, _to_period("year")), "PERIOD.QUARTER": (1, 2, _to_period("quarter")), "PERIOD.MONTH": (1, 2, _to_period("month")), "PERIOD.WEEK": (1, 1, _to_period("week")),
    "PERIOD.DAY": (1, 3, _to_period("day")), "PERIOD.HOUR": (1, 1, _to_period("hour")), "DATE": (3, 3, _to_period("day")), "PERIOD.START": (1, 1, _edge(False)), "PERIOD.END": (1, 1, _edge(True)),
    "YEAR": (1, 1, _part("year")), "QUARTER": (1, 1, _part("quarter")), "MONTH": (1, 1, _part("month")), "DAY": (1, 1, _part("day")), "WEEKDAY": (1, 1, _part("weekday")), "HOUR": (1, 1, _part("hour")),
}


def compile_sheets(sheets: list[Sheet], inputs: dict[str, str | None] | None = None, program: Program | None = None) -> Compiled:
    """Compiles every cell. inputs names columns of a table that formulas may use, with their granularity or None.

    Models that are compiled into one program share what they have in common, draws above all.
    """
    return _Compiler(sheets, inputs or {}, program).run()
