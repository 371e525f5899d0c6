import math

import pytest

from sheetstorm.plans import periods as P
from sheetstorm.plans.compiler import CellError, Series, Sheet, compile_sheets
from sheetstorm.plans.formulas import FormulaError, is_valid_name, parse, references, rename, shift
from sheetstorm.plans.lowering import evaluate

import numpy as np


def value(cells, cell="Z1", sheets=()):
    compiled = compile_sheets([Sheet("Sheet1", cells), *sheets])
    v = compiled.find(f"Sheet1!{cell}")
    out = evaluate(compiled.program, {"x": v.reg}, {}, np.arange(1))["x"][0]
    return P.format_period(out, v.granularity) if v.granularity else float(out)


def code(cells, cell="Z1", sheets=()):
    with pytest.raises(CellError) as e:
        compile_sheets([Sheet("Sheet1", cells), *sheets]).find(f"Sheet1!{cell}")
    return e.value.code


BASE = {"A1": 1, "A2": 2, "A3": "label", "A5": 6}


@pytest.mark.parametrize(
    "formula,expected",
    [
        ("=1+2*3", 7), ("=-2^2", 4), ("=2^3^2", 64), ("=50%", 0.5), ("=200%%", 0.02), ("=1<2", 1), ("=2<>2", 0), ("=10/4", 2.5), ("=(1+2)*3", 9), ("=1e3+.5", 1000.5),
        ("=IF(0,1)", 0), ("=IF(1,5,6)", 5), ("=AND(1,2,0)", 0), ("=OR(0,0,3)", 1), ("=NOT(0)", 1), ("=IFERROR(1/0,7)", 7), ("=IFERROR(NOSUCH(1),7)", 7), ("=TRUE+FALSE", 1),
        ("=SUM(A1:A5)", 9), ("=AVERAGE(A1:A5)", 3), ("=COUNT(A1:A5)", 3), ("=PRODUCT(A1:A5)", 12), ("=MIN(A1:A5)", 1), ("=MAX(A5:A1, 9)", 9), ("=SUM(B1:B9)", 0), ("=A4+1", 1),
        ("=SUMPRODUCT(A1:A2,A1:A2)", 5), ("=ROUND(2.675,2)", 2.68), ("=ROUND(1.005,2)", 1.0), ("=ROUND(-2.5,0)", -3), ("=ROUND(1234,-2)", 1200), ("=ROUNDUP(1.21,1)", 1.3),
        ("=ROUNDDOWN(-1.29,1)", -1.2), ("=TRUNC(-1.9)", -1), ("=INT(-1.5)", -2), ("=MOD(-3,2)", 1), ("=MOD(3,-2)", -1), ("=RRI(2,100,121)", 0.1), ("=SQRT(16)", 4), ("=EXP(LN(3))", 3),
        ("=POWER(2,10)", 1024), ("=ABS(-3)", 3), ("=NORMSDIST(1.96)", 0.9750021048517795), ("=NORM.S.DIST(0,0)", 0.3989422804014327), ("=NORMSINV(0.975)", 1.959963984540054),
        ("=NORM.INV(0.5,10,2)", 10), ("=LOGINV(0.5,0,1)", 1), ("=INDEX(A1:A5,2.9)", 2), ("=INDEX(A1:A5,4)", 0), ("=MATCH(2,A1:A5)", 2), ("=MATCH(6,A1:A5,0)", 5), ("=MATCH(3,A1:A5,-1)", 5),
        ("=INDEX(A1:B2,2,1)", 2), ("=2027 - 01", 2026), ("=2027-13", 2014), ("=2026-03 - 2026-01", 2), ("=YEAR(2027-Q2)", 2027), ("=QUARTER(2027-05)", 2), ("=MONTH(46402)", 1),
        ("=DAY(DATE(2024,2,30))", 1), ("=WEEKDAY(2026-11-27)", 6), ("=HOUR(2027-01-15T09)", 9), ("=PERIOD.END(2024-02)-PERIOD.START(2024-02)", 28), ("=2026-W01<2026-W02", 1),
        ("=2027-01+1", "2027-02"), ("=PERIOD.QUARTER(2027-05)", "2027-Q2"), ("=PERIOD.MONTH(2026,14)", "2027-02"), ("=PERIOD.DAY(2027-W01)", "2027-01-04"), ("=PERIOD.WEEK(2027-01-10)", "2027-W01"),
        ("=PERIOD.HOUR(2027-01-15)", "2027-01-15T00"), ("=DATE(2023,14,0)", "2024-01-31"), ("=MAX(2026-01,2026-03)", "2026-03"), ("=PERIOD.YEAR(2026-12)", "2026"),
    ],
)
def test_values(formula, expected):
    found = value(BASE | {"Z1": formula})
    assert found == expected if isinstance(expected, str) else found == pytest.approx(expected, rel=1e-12, abs=1e-12)


@pytest.mark.parametrize(
    "formula,expected",
    [
        ("=NOSUCH(1)", "#NAME?"), ("=SQRT(1,2)", "#NAME?"), ("=unknown", "#NAME?"), ("=A3", "#VALUE!"), ("=AVERAGE(B1:B2)", "#DIV/0!"), ("=AND(B1:B2)", "#VALUE!"), ("=Z1", "#CIRC!"), ("=1+", "#ERROR!"),
        ("=No!A1", "#REF!"), ("=#REF!+1", "#REF!"), ("=SUMPRODUCT(A1:A2,A1:A3)", "#VALUE!"), ("=2026-01*2", "#VALUE!"), ("=2026-01+2026-02", "#VALUE!"), ("=1-2026-01", "#VALUE!"), ("=-2026-01", "#VALUE!"),
        ("=2026-01<2026-Q1", "#VALUE!"), ("=SQRT(2026-01)", "#VALUE!"), ("=IF(1,2026-01,3)", "#VALUE!"), ("=VLOOKUP(1,A1:B2,3)", "#REF!"), ("=A1:A2", "#VALUE!"), ("=PERIOD.START(5)", "#VALUE!"),
    ],
)
def test_errors(formula, expected):
    assert code(BASE | {"Z1": formula}) == expected


def test_nan_and_infinity():
    assert math.isnan(value(BASE | {"Z1": "=SQRT(-1)"})) and value(BASE | {"Z1": "=1/0"}) == math.inf and value(BASE | {"Z1": "=LN(0)"}) == -math.inf
    assert math.isnan(value(BASE | {"Z1": "=INDEX(A1:A5,9)"})) and math.isnan(value(BASE | {"Z1": "=MATCH(9,A1:A5,0)"})) and math.isnan(value(BASE | {"Z1": "=INDEX(A1:A5,3)"}))
    assert math.isnan(value(BASE | {"Z1": "=MOD(1,0)"})) and math.isnan(value(BASE | {"Z1": "=NORMSINV(1)"})) and value(BASE | {"Z1": "=SQRT(-1)<>1"}) == 1


def test_cells_depend_on_each_other():
    cells = {"A1": "=B1*2", "B1": "=C1+1", "C1": 4, "D1": "=E1", "E1": "=D1", "F1": "=D1+1", "G1": "=IFERROR(D1,1)"}
    assert value(cells, "A1") == 10
    assert [code(cells, c) for c in ("D1", "E1", "F1", "G1")] == ["#CIRC!"] * 4
    other = Sheet("My Sheet", {"A1": 5}, names={"Spot": "A1"})
    assert value({"Z1": "='My Sheet'!A1+spot+'my sheet'!$A$1"}, sheets=[other]) == 15


TABLE = {"A1": 0, "B1": 50, "A2": 100, "B2": 40, "A3": 1000, "B3": 30, "A4": 10000, "B4": 20}


@pytest.mark.parametrize("formula,expected", [("=VLOOKUP(150,A1:B4,2)", 40), ("=VLOOKUP(1000,A1:B4,2,0)", 30), ("=VLOOKUP(20000,A1:B4,C1+2)", 20), ("=INDEX(B1:B4,MATCH(99,A1:A4))", 50)])
def test_tables(formula, expected):
    assert value(TABLE | {"Z1": formula}) == expected
    assert math.isnan(value(TABLE | {"Z1": "=VLOOKUP(-1,A1:B4,2)"})) and math.isnan(value(TABLE | {"Z1": "=VLOOKUP(5,A1:B4,2,0)"}))
    assert value({"A1": 1, "B1": 2, "A2": 10, "B2": 20, "Z1": "=HLOOKUP(2,A1:B2,2)"}) == 20


def series(kind, values=(310, 280, None, 300), granularity="month", start=24312):
    cells = {f"A{i}": P.format_period(start + i - 1, granularity) for i in range(1, len(values) + 1)} | {f"B{i}": v for i, v in enumerate(values, 1) if v is not None}
    return Sheet("S", cells, Series(granularity, kind))


@pytest.mark.parametrize(
    "kind,formula,expected",
    [
        ("flow", "=S@2026-Q1", 590), ("flow", "=S@(PERIOD.YEAR(2026-01))", 890), ("flow", "=S@2026-01-15", 10), ("level", "=S@2026-03", 280), ("level", "=S@2026-01-16", 310 + 15 / 31 * (280 - 310)),
        ("level", "=S@2026-04-20", 300), ("flow", "=SUM(S@2026-01:2026-04)", 890), ("flow", "=S[Value]@2026-02", 280), ("rate", "=S@2026-01-05", 310), ("level", "=S@2026-Q1", 280),
    ],
)
def test_series(kind, formula, expected):
    assert value({"Z1": formula}, sheets=[series(kind)]) == pytest.approx(expected)


def test_series_that_miss():
    assert math.isnan(value({"Z1": "=S@2026-03"}, sheets=[series("rate")]))
    assert code({"Z1": "=S@2030-03"}, sheets=[series("flow")]) == "#N/A"
    assert math.isnan(value({"A1": 1, "Z1": "=S@(PERIOD.MONTH(DATE(2030,A1,1)))"}, sheets=[series("flow")]))
    assert value({"Z1": "=S@(PERIOD.MONTH(DATE(2026,2,3)))"}, sheets=[series("flow")]) == 280
    assert code({"Z1": "=S@5"}, sheets=[series("flow")]) == "#VALUE!" and code({"Z1": "=S[No]@2026-01"}, sheets=[series("flow")]) == "#REF!"
    yearly = series("level", (1, 2, 4), "year", 2026)
    assert value({"A1": 2027, "Z1": "=S@A1"}, sheets=[yearly]) == 2


@pytest.mark.parametrize("text,granularity,number", [("2027-Q1", "quarter", 8108), ("2027-01", "month", 24324), ("2027-01-15", "day", 46402), ("2027", "year", 2027), ("2026-W53", "week", None), ("2027-01-15T09", "hour", 46402 * 24 + 9)])
def test_periods(text, granularity, number):
    found = P.parse_period(text)
    assert found[0] == granularity and (number is None or found[1] == number) and P.format_period(found[1], granularity) == text


def test_loose_and_invalid_periods():
    assert [P.normalise(x) for x in ("2026-7", "2026-q1", "2026-w5", "2026-7-4t9", "2026-13", "2025-W53", "2026-02-30")] == ["2026-07", "2026-Q1", "2026-W05", "2026-07-04T09", "2026-13", "2025-W53", "2026-02-30"]


def test_edits_of_formulas():
    assert shift("=A1+$A1+A$1+$A$1+S!B2", 1, 1) == "=B2+$A2+B$1+$A$1+S!C3" and shift("=A1*2", -1, 0) == "=#REF!*2" and shift("text A1", 1, 1) == "text A1"
    assert rename("=Spot*spot+SPOT(1)+spots", "spot", "Price") == "=Price*Price+SPOT(1)+spots"
    assert references("=A1+'My Sheet'!$B$2+") == [(1, 3, None, "A1"), (4, 19, "My Sheet", "B2")] and parse("1").value == 1
    assert is_valid_name("Spot_1.x") and not is_valid_name("A1") and not is_valid_name("1x") and not is_valid_name("true")
    with pytest.raises(FormulaError):
        parse("=1 ? 2")
