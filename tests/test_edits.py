from sheetstorm.plans.compiler import Sheet
from sheetstorm.sources import edits as E


def test_copies_and_fills():
    sheet = Sheet("S", {"A1": 1, "A2": "=A1+$A$1", "B1": "text"})
    assert E.fill(sheet, "A2", "A2", "A4").cells["A4"] == "=A3+$A$1"
    assert E.paste_block(sheet, E.copy_block(sheet, "A1", "B2"), "A1", "C3").cells["C4"] == "=C3+$A$1"
    assert E.paste_block(sheet, [[None]], "D9", "A1").cells == {"A2": "=A1+$A$1", "B1": "text"}
    tiled = E.paste_block(sheet, [["=A1"], [2]], "B1", "C1", "D4").cells
    assert tiled["C1"] == "=B1" and tiled["D3"] == "=C3" and tiled["D4"] == 2


def test_settings_and_text():
    assert E.Settings(-5, 10**12) == E.Settings(0, 10**9)
    assert [E.format_number(x) for x in (1 / 3, 1e9, 2.50, 1e21, float("nan"))] == ["0.3333333333", "1000000000", "2.5", "1e+21", "nan"]
    assert E.format_uncertain(12.3456, 0.0234) == "12.346 ± 0.023" and E.format_uncertain(1234.5, 120) == "1235 ± 120" and E.format_uncertain(5, 0) == "5"
    assert [E.format_number(x) for x in (12345678901, 0.00001, 0.0000001234, 12345678901.5, -0.0, 1e-12, 123456.789)] == ["12345678901", "0.00001", "1.234e-7", "1.23456789e+10", "0", "1e-12", "123456.789"]
    assert E.format_uncertain(1000, 123) == "1000 ± 123" and E.format_uncertain(-0.0001, 0.5) == "0.00 ± 0.50"
    assert E.format_result("uncertain", 24324, 1.234, granularity="month") == "2027-01 ± 1.2"
    assert E.format_result("error", 0, code="#NUM!") == "#NUM!" and E.format_result("number", 24324, granularity="month") == "2027-01"
