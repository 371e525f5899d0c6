"""Formulas: text to a syntax tree, and edits of formula text that keep everything else as written.

Binary operators bind, from loose to tight: comparisons, + -, * /, ^; all are left-associative. A sign
binds tighter than ^ (so -2^2 is 4) and % tighter still.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from .periods import parse_period

BINDING = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "+": 2, "-": 2, "*": 3, "/": 3, "^": 4}
# Fixed values of the grammar: the forms of references, periods, numbers and names in a formula.
_SHEET = r"(?:'(?:[^']|'')+'|[A-Za-z_][A-Za-z0-9_.]*)"
_LEXEMES = re.compile(
    rf"""
    (?P<space>\s+)
  | (?P<ref>(?:(?P<sheet>{_SHEET})!)?(?P<ca>\$?)(?P<col>[A-Za-z]{{1,3}})(?P<ra>\$?)(?P<row>[0-9]+)(?![A-Za-z0-9_.(]))
  | (?P<quoted>'(?:[^']|'')+')
  | (?P<column>\[[^\]]*\])
  | (?P<at>@(?:(?P<atperiod>\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{4}}-W\d{{2}}|\d{{4}}-Q[1-4]|\d{{4}}-\d{{2}}|\d{{4}})(?![\w.]))?)
  | (?P<period>\d{{4}}-(?:[qQ][1-4]|[wW]\d{{1,2}}|\d{{1,2}}(?:-\d{{1,2}}(?:[tT]\d{{1,2}})?)?)(?![\w.$]))
  | (?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
  | (?P<name>[A-Za-z_][A-Za-z0-9_.]*)
  | (?P<broken>\#REF!)
  | (?P<op><>|<=|>=|[-+*/^%=<>(),:])
    """,
    re.VERBOSE | re.IGNORECASE,
)


class FormulaError(ValueError):
    """The text is no formula."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    sheet: str | None = None


@dataclass(frozen=True)
class Node:
    """kind: number, period, ref, range, name, call, sign, percent, binary, series or broken."""

    kind: str
    value: object = None
    parts: tuple[Node, ...] = ()


def unquote(sheet: str | None) -> str | None:
    return sheet[1:-1].replace("''", "'") if sheet and sheet[0] == "'" else sheet


def tokens_of(text: str, lenient: bool = False) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        m = _LEXEMES.match(text, at)
        if m and m.lastgroup == "period" or (m and m["period"]):
            if parse_period(m["period"]) is None:  # 2027-13 is a subtraction
                m = re.compile(r"(?P<number>[0-9]+)").match(text, at)
                found.append(Token("number", m[0], at))
                at = m.end()
                continue
        if not m:
            if lenient:
                break
            raise FormulaError(f"Unexpected character {text[at]!r} at position {at}")
        kind = next(k for k in ("space", "ref", "quoted", "column", "at", "period", "number", "name", "broken", "op") if m[k] is not None)
        if kind != "space":
            found.append(Token(kind, m[0], at, unquote(m["sheet"]) if kind == "ref" else None))
        at = m.end()
    return found


def address_of(text: str) -> str:
    return text.rpartition("!")[2].replace("$", "").upper()


class _Parser:
    def __init__(self, text: str):
        self.tokens = [*tokens_of(text), Token("end", "", len(text))]
        self.at = 0

    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def take(self, *texts: str) -> Token | None:
        if self.next.kind == "op" and self.next.text in texts:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise FormulaError(f"Expected {text!r} at position {self.next.start}")

    def expression(self, least: int = 1) -> Node:
        left = self.signed()
        while self.next.kind == "op" and BINDING.get(self.next.text, 0) >= least:
            op = self.next.text
            self.at += 1
            left = Node("binary", op, (left, self.expression(BINDING[op] + 1)))
        return left

    def signed(self) -> Node:
        if sign := self.take("-", "+"):
            inner = self.signed()
            return Node("sign", "-", (inner,)) if sign.text == "-" else inner
        node = self.primary()
        while self.take("%"):
            node = Node("percent", None, (node,))
        return node

    def primary(self) -> Node:
        token = self.next
        self.at += 1
        if token.kind == "number":
            return Node("number", float(token.text))
        if token.kind == "period":
            return Node("period", parse_period(token.text))
        if token.kind == "broken":
            return Node("broken")
        if token.kind == "ref":
            first = (token.sheet, address_of(token.text))
            if self.next.kind == "op" and self.next.text == ":" and self.tokens[self.at + 1].kind == "ref":
                last = self.tokens[self.at + 1]
                self.at += 2
                if last.sheet is not None and last.sheet != token.sheet:
                    raise FormulaError("A range lies on one sheet")
                return Node("range", (*first, address_of(last.text)))
            return Node("ref", first)
        if token.kind in ("quoted", "name"):
            if token.kind == "name" and self.take("("):
                return Node("call", token.text.upper(), tuple(self.arguments()))
            if self.next.kind in ("column", "at"):
                return self.series(unquote(token.text))
            if token.kind == "name":
                return Node("name", token.text)
        if token.kind == "op" and token.text == "(":
            inner = self.expression()
            self.need(")")
            return inner
        raise FormulaError(f"Unexpected {token.text or 'end'!r} at position {token.start}")

    def arguments(self) -> list[Node]:
        if self.take(")"):
            return []
        found = [self.expression()]
        while self.take(","):
            found.append(self.expression())
        self.need(")")
        return found

    def series(self, name: str) -> Node:
        column = None
        if self.next.kind == "column":
            column = self.next.text[1:-1].strip()
            self.at += 1
        if self.next.kind != "at":
            raise FormulaError(f"A series needs a time at position {self.next.start}")
        times = [self.time(self.next.text[1:])]
        if self.next.kind == "op" and self.next.text == ":":
            self.at += 1
            if self.next.kind == "at":
                self.at += 1
            times.append(self.time("" if self.tokens[self.at - 1].text in (":", "@") else self.tokens[self.at - 1].text[1:], moved=True))
        return Node("series", (name, column), tuple(times))

    def time(self, literal: str, moved: bool = False) -> Node:
        if not moved:
            self.at += 1
        if literal:
            return Node("period", parse_period(literal))
        return self.primary()


def parse(text: str) -> Node:
    """The tree of a formula, written with or without its leading =."""
    parser = _Parser(text[1:] if text.startswith("=") else text)
    node = parser.expression()
    if parser.next.kind != "end":
        raise FormulaError(f"Unexpected {parser.next.text!r} at position {parser.next.start}")
    return node


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def split_address(address: str) -> tuple[int, int]:
    """(row, column), from 1."""
    m = re.fullmatch(r"([A-Za-z]{1,3})([1-9][0-9]*)", address)
    if not m:
        raise FormulaError(f"{address!r} is no address")
    return int(m[2]), column_number(m[1])


def join_address(row: int, column: int) -> str:
    return f"{column_letters(column)}{row}"


def _rewrite(text: str, change: Callable[[Token, re.Match], str | None]) -> str:
    out, at = [], 0
    for token in tokens_of(text, lenient=True):
        new = change(token, _LEXEMES.match(text, token.start))
        if new is not None:
            out += [text[at : token.start], new]
            at = token.start + len(token.text)
    return "".join(out) + text[at:]


def shift(formula: str, rows: int, columns: int) -> str:
    """The formula as copied elsewhere: relative references move, $ parts stay, off the grid is #REF!."""

    def move(token: Token, m: re.Match) -> str | None:
        if token.kind != "ref":
            return None
        row = int(m["row"]) + (0 if m["ra"] else rows)
        column = column_number(m["col"]) + (0 if m["ca"] else columns)
        if row < 1 or column < 1:
            return "#REF!"
        return f"{m['sheet'] + '!' if m['sheet'] else ''}{m['ca']}{column_letters(column)}{m['ra']}{row}"

    return "=" + _rewrite(formula[1:], move) if formula.startswith("=") else formula


def rename(formula: str, old: str, new: str) -> str:
    """The formula with a name replaced, whatever its case; calls of that name stay."""
    if not formula.startswith("="):
        return formula
    body = formula[1:]

    def swap(token: Token, m: re.Match) -> str | None:
        called = body[token.start + len(token.text) :].lstrip().startswith(("(", "[", "@"))
        return new if token.kind == "name" and token.text.lower() == old.lower() and not called else None

    return "=" + _rewrite(body, swap)


def references(formula: str) -> list[tuple[int, int, str | None, str]]:
    """(start, end, sheet, address) of every reference, in formulas that may be unfinished too."""
    skip = formula.startswith("=")
    return [(t.start + skip, t.start + skip + len(t.text), t.sheet, address_of(t.text)) for t in tokens_of(formula[skip:], lenient=True) if t.kind == "ref"]


def is_valid_name(name: str) -> bool:
    """Names of up to 255 characters start with a letter or _, and look like no cell and no truth value."""
    return len(name) <= 255 and bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.]*", name)) and not re.fullmatch(r"[A-Za-z]{1,3}[0-9]+|TRUE|FALSE", name, re.IGNORECASE)
