"""Compiled models: a flat list of single-assignment operations, shared where equal and folded where constant."""

from __future__ import annotations

import math
from collections.abc import Callable, Collection
from dataclasses import dataclass, field

import numpy as np

NAN = float("nan")


def _float(f: Callable[..., float]) -> Callable[..., float]:
    def guarded(*args: float) -> float:
        with np.errstate(all="ignore"):
            return float(f(*map(np.float64, args)))

    return guarded


def _phi(z: float) -> float:
    from ..functions.normal import cdf_numpy

    return cdf_numpy(z)


def _phi_inverse(p: float) -> float:
    from ..functions.normal import inverse_numpy

    return inverse_numpy(p)


#: Operations of one argument and of two, on IEEE doubles; comparisons give 1 or 0.
UNARY: dict[str, Callable] = {
    "neg": lambda a: -a,
    "sqrt": np.sqrt,
    "exp": np.exp,
    "ln": np.log,
    "abs": np.abs,
    "floor": np.floor,
    "finite": lambda a: np.isfinite(a) * 1.0,
    "density": lambda z: np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi),
    "phi": _phi,
    "phi_inverse": _phi_inverse,
}
BINARY: dict[str, Callable] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: np.divide(a, b),
    "pow": lambda a, b: np.where(np.isnan(b) | ((np.abs(a) == 1) & np.isinf(b)), np.nan, np.power(a, b)),
    "min": np.minimum,
    "max": np.maximum,
    "eq": lambda a, b: (a == b) * 1.0,
    "ne": lambda a, b: (a != b) * 1.0,
    "lt": lambda a, b: (a < b) * 1.0,
    "gt": lambda a, b: (a > b) * 1.0,
    "le": lambda a, b: (a <= b) * 1.0,
    "ge": lambda a, b: (a >= b) * 1.0,
}


@dataclass
class Program:
    """ops[i] is (kind, ...): const value; input name; un fn a; bin fn a b; sel cond then else; draw kind stream args."""

    ops: list[tuple] = field(default_factory=list)
    _known: dict[tuple, int] = field(default_factory=dict)

    def emit(self, *op: object) -> int:
        key = tuple("nan" if isinstance(x, float) and math.isnan(x) else (x, math.copysign(1, x)) if x == 0 and isinstance(x, float) else x for x in op)
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.ops)
            self.ops.append(op)
        return found

    def const(self, value: float) -> int:
        return self.emit("const", float(value))

    def value(self, reg: int) -> float | None:
        """The value of a register that is a literal; what rests on a selection is none, even if it could be known."""
        return self.ops[reg][1] if self.ops[reg][0] == "const" else None

    def un(self, fn: str, a: int) -> int:
        x = self.value(a)
        return self.emit("un", fn, a) if x is None else self.const(_float(UNARY[fn])(x))

    def bin(self, fn: str, a: int, b: int) -> int:
        x, y = self.value(a), self.value(b)
        return self.emit("bin", fn, a, b) if x is None or y is None else self.const(_float(BINARY[fn])(x, y))

    def select(self, cond: int, then: int, other: int) -> int:
        return then if then == other else self.emit("sel", cond, then, other)

    def needs(self, regs: list[int]) -> list[int]:
        """The registers that these rest on, in order."""
        keep, todo = set(), list(regs)
        while todo:
            reg = todo.pop()
            if reg not in keep:
                keep.add(reg)
                todo += self.arguments(reg)
        return sorted(keep)

    def arguments(self, reg: int) -> list[int]:
        op = self.ops[reg]
        return {"const": list, "input": list, "un": lambda: [op[2]], "bin": lambda: [op[2], op[3]], "sel": lambda: list(op[1:4]), "draw": lambda: list(op[3])}[op[0]]()

    def resting_on(self, root: Callable[[tuple], bool]) -> set[int]:
        """Registers that rest on an operation for which root is true, or are one."""
        found: set[int] = set()
        for reg, op in enumerate(self.ops):
            if root(op) or any(a in found for a in self.arguments(reg)):
                found.add(reg)
        return found

    def uncertain(self, columns: Collection[str] = ()) -> set[int]:
        """Registers that rest on a draw, or on one of these inputs, which differ from row to row."""
        return self.resting_on(lambda op: op[0] == "draw" or (op[0] == "input" and op[1] in columns))
