"""Copying and filling cells, run settings, and how results are written."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal, localcontext

from ..plans.compiler import Sheet
from ..plans.formulas import join_address, shift, split_address
from ..plans.periods import format_period

MOST_ITERATIONS = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    """Iterations of the interpreted and of the compiled engine, between 0 and MOST_ITERATIONS."""

    interpreted: int = 10_000
    compiled: int = 100_000

    def __post_init__(self):
        for name in ("interpreted", "compiled"):
            object.__setattr__(self, name, max(0, min(MOST_ITERATIONS, int(getattr(self, name)))))


def copy_block(sheet: Sheet, first: str, last: str) -> list[list]:
    (r1, c1), (r2, c2) = split_address(first), split_address(last)
    return [[sheet.cells.get(join_address(r, c)) for c in range(min(c1, c2), max(c1, c2) + 1)] for r in range(min(r1, r2), max(r1, r2) + 1)]


def paste_block(sheet: Sheet, block: list[list], source: str, first: str, last: str | None = None) -> Sheet:
    """The block at `first`, repeated over the target if that is a multiple of it; formulas move with their cells."""
    (r0, c0), (r1, c1) = split_address(source), split_address(first)
    r2, c2 = split_address(last or first)
    height, width = len(block), len(block[0])
    rows, columns = r2 - r1 + 1, c2 - c1 + 1
    if rows % height or columns % width:
        rows, columns = height, width
    cells = dict(sheet.cells)
    for i in range(rows):
        for j in range(columns):
            content, address = block[i % height][j % width], join_address(r1 + i, c1 + j)
            if content is None:
                cells.pop(address, None)
            else:
                cells[address] = shift(content, r1 + i - r0 - i % height, c1 + j - c0 - j % width) if isinstance(content, str) else content
    return replace(sheet, cells=cells)


def fill(sheet: Sheet, first: str, last: str, to: str) -> Sheet:
    """A block continued down or to the right, up to `to`."""
    return paste_block(sheet, copy_block(sheet, first, last), first, first, to)


def _places(value: float, places: int) -> str:
    """With so many decimals; halves go away from zero, and there is no negative nought."""
    with localcontext(prec=400):
        text = f"{Decimal(value).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP):f}"
    return text.removeprefix("-") if not float(text) else text


def format_number(value: float, digits: int = 10) -> str:
    """Whole numbers in full, others up to so many significant digits without trailing zeros; a power of ten where very large or small."""
    if not math.isfinite(value):
        return str(value)
    if value == int(value) and abs(value) < 1e15:
        return str(int(value))
    usual = 1e-9 <= abs(value) < 1e15
    mantissa, _, power = f"{value:.{digits - 1 if usual else 5}e}".partition("e")
    written = usual and -7 < int(power) < digits
    if written:
        mantissa = _places(value, digits - 1 - int(power))
    if "." in mantissa:
        mantissa = mantissa.rstrip("0").rstrip(".")
    return mantissa if written else f"{mantissa}e{int(power):+d}"


def format_uncertain(mean: float, sd: float) -> str:
    """mean ± deviation: to the place of the deviation's second significant digit, and to whole numbers at least."""
    if not sd > 0 or not math.isfinite(sd) or not math.isfinite(mean):
        return format_number(mean)
    places = min(10, max(0, 1 - math.floor(math.log10(sd))))
    return f"{_places(mean, places)} ± {_places(sd, places)}"


def format_result(kind: str, mean: float, sd: float = 0.0, code: str | None = None, granularity: str | None = None) -> str:
    """An uncertain period is its mean period and the deviation in periods."""
    if kind == "error":
        return code or "#ERROR!"
    if granularity:
        return format_period(mean, granularity) + ("" if kind == "number" else f" ± {format_number(float(f'{sd:.2g}'))}")
    return format_number(mean) if kind == "number" else format_uncertain(mean, sd)
