"""Queries over the driver's tables that use every operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import calendar, ieee, normal
from .functions.random import FACTORS, SHIFTS, hash32, stream_of
from .operators import dependencies, lookups, scenarios, summary
from .operators.simulate import apply_formulas, cross_check, simulation
from .operators.storage import fresh_path, kept
from .plans.compiler import Series, Sheet
from .sources.series import complete_periods, series_from
from .sources.workbook import cells_from
from .streaming.accumulated import accumulate, accumulated
from .streaming.progressive import compare_progressively, histogram_progressively, run_in_phases, run_progressively

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of what DuckDB lacks


def sql_hash(cte: str, source: str, expression: str, to: str) -> str:
    """CTEs that add `to`, the 32-bit hash of an expression, to the rows of `source`; the last is named `cte`."""
    parts = [f"{cte}_0 AS (SELECT *, CAST({expression} AS UBIGINT) AS {to}_0 FROM {source})"]
    for i, (shift, factor) in enumerate(zip(SHIFTS, (*FACTORS, 1), strict=True)):
        last = i == len(SHIFTS) - 1
        name, column = (cte, to) if last else (f"{cte}_{i + 1}", f"{to}_{i + 1}")
        parts.append(f"{name} AS (SELECT *, (xor({to}_{i}, {to}_{i} >> {shift}) * {factor}::UBIGINT) & 4294967295::UBIGINT AS {column} FROM {cte}_{i})")
    return ", ".join(parts)


def sql_uniform(cte: str, source: str, key: str, stream: int | str, place: int, to: str, seed: int = 1) -> str:
    """CTEs that add the uniform `to` of a key, a stream and a place."""
    steps = [
        sql_hash(f"{cte}a", source, f"xor({key}::UBIGINT & 4294967295::UBIGINT, {hash32(seed)}::UBIGINT)", f"{to}_a"),
        sql_hash(f"{cte}b", f"{cte}a", f"xor({to}_a, {stream}::UBIGINT)", f"{to}_b"),
        sql_hash(f"{cte}c", f"{cte}b", f"xor({to}_b, {place}::UBIGINT)", f"{to}_c"),
        f"{cte} AS (SELECT *, ((({to}_c >> 9)::DOUBLE) + 0.5) / 8388608.0 AS {to} FROM {cte}c)",
    ]
    return ", ".join(steps)


def sql_horner(coefficients: tuple[float, ...], x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


SQL_SERIAL = "(datediff('day', DATE '1970-01-01', CAST({} AS DATE)) + 25569)"
SQL_MONTH = "(year({0}) * 12 + month({0}) - 1)"


def sql_bins(values: str) -> str:
    """CTEs from values(cell, iteration, value) to bins(cell, bin, low, high, n)."""
    log_bins, linear = summary.LOG, summary.LINEAR
    return f"""
        opening AS (SELECT * FROM {values} QUALIFY row_number() OVER (PARTITION BY cell ORDER BY iteration, value) <= {summary.FIRST_BATCH}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY cell) AS total FROM opening),
        places AS (SELECT cell, max(value) FILTER (place = least(total - 1, floor(0.5 * total))) AS centre,
                          max(value) FILTER (place = least(total - 1, floor(0.75 * total))) - max(value) FILTER (place = least(total - 1, floor(0.25 * total))) AS scale FROM ranked GROUP BY cell),
        binned AS (SELECT v.cell, centre, scale,
                          CAST(CASE WHEN abs(value - centre) < scale THEN {log_bins} + least({linear - 1}, greatest(0, floor((value - centre + scale) / (2 * scale) * {linear})))
                                    WHEN value > centre THEN {log_bins + linear} + least({log_bins - 1}, floor(ln(abs(value - centre) / scale) / ln({summary.RATIO})))
                                    ELSE {log_bins - 1} - least({log_bins - 1}, floor(ln(abs(value - centre) / scale) / ln({summary.RATIO}))) END AS INTEGER) AS bin
                   FROM {values} v JOIN places p ON v.cell = p.cell),
        counted AS (SELECT cell, centre, scale, bin, CAST(count(*) AS DOUBLE) AS n FROM binned GROUP BY ALL),
        bins AS (SELECT cell, bin, n,
                        CASE WHEN bin < {log_bins} THEN centre - scale * pow({summary.RATIO}, {log_bins} - bin) WHEN bin < {log_bins + linear} THEN centre - scale + (bin - {log_bins}) * (2 * scale / {linear})
                             ELSE centre + scale * pow({summary.RATIO}, bin - {log_bins + linear}) END AS low,
                        CASE WHEN bin < {log_bins} THEN centre - scale * pow({summary.RATIO}, {log_bins - 1} - bin) WHEN bin < {log_bins + linear} THEN centre - scale + (bin - {log_bins} + 1) * (2 * scale / {linear})
                             ELSE centre + scale * pow({summary.RATIO}, bin - {log_bins + linear} + 1) END AS high FROM counted)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many places: sums of floating numbers depend on their order in the last bits."""
    return df.select(*(F.round(f"`{f.name}`", digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema))


# Formulas over rows


@query("""SELECT p_partkey, p_retailprice * (1 - 10 / 100.0e0) * (1 + p_size / 100.0e0) AS gross, -p_retailprice + p_size * 2 AS signed_, p_retailprice / p_size / 4 AS share, p_size * p_size * 1.0e0 AS square,
                 (p_retailprice - p_size) / (p_retailprice + p_size) AS spread FROM part""")
def formula_arithmetic(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    made = apply_formulas(
        rows,
        {"gross": "=p_retailprice*(1-10%)*(1+p_size%)", "signed_": "=-p_retailprice+p_size*2", "share": "=p_retailprice/p_size/4", "square": "=p_size^2", "spread": "=(p_retailprice-p_size)/(p_retailprice+p_size)"},
        iteration="p_partkey",
    )
    return made.drop("p_retailprice", "p_size")


@query("""WITH x AS (SELECT p_partkey, p_retailprice AS v, CASE WHEN p_retailprice < 0 THEN -1.0 ELSE 1.0 END AS s, p_size AS z FROM part)
          SELECT p_partkey, s * floor(abs(v) * 10 + 0.5) / 10 AS nearest, s * floor(abs(v) * 0.01 + 0.5) / 0.01 AS hundreds, s * -floor(-(abs(v) * 10)) / 10 AS up, s * floor(abs(v) * 10) / 10 AS down,
                 s * floor(abs(v)) AS whole, floor(-v) AS lower_, v - z * floor(v / z) AS rest, v + z * floor(v / -z) AS negative_rest FROM x""")
def formula_rounding(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("v"), F.col("p_size").alias("z"))
    made = apply_formulas(
        rows,
        {"nearest": "=ROUND(v,1)", "hundreds": "=ROUND(v,-2)", "up": "=ROUNDUP(v,1)", "down": "=ROUNDDOWN(v,1)", "whole": "=TRUNC(v)", "lower_": "=INT(-v)", "rest": "=MOD(v,z)", "negative_rest": "=MOD(v,-z)"},
        iteration="p_partkey",
    )
    return made.drop("v", "z")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 THEN 2.0e0 ELSE 1.0e0 END AS class, CASE WHEN o_totalprice > 100000 AND o_custkey % 2 <> 0 THEN 1.0e0 ELSE 0.0e0 END AS both_,
                 CASE WHEN o_totalprice > 400000 OR o_custkey % 2 = 0 THEN 1.0e0 ELSE 0.0e0 END AS either, CASE WHEN o_custkey % 2 = 0 THEN 1.0e0 ELSE 0.0e0 END AS even,
                 CASE WHEN o_custkey % 2 = 0 THEN -1.0e0 ELSE o_totalprice / (o_custkey % 2) END AS guarded, CASE WHEN o_totalprice < 50000 THEN 0.0e0 ELSE o_totalprice END AS floored FROM orders""")
def formula_logic(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    made = apply_formulas(
        rows,
        {"odd": "=MOD(o_custkey,2)", "class": "=IF(o_totalprice>=150000,2,1)", "both_": "=AND(o_totalprice>100000,odd)", "either": "=OR(o_totalprice>400000,NOT(odd))", "even": "=NOT(odd)", "guarded": "=IFERROR(o_totalprice/odd,-1)", "floored": "=IF(o_totalprice>=50000,o_totalprice)"},
        iteration="o_orderkey",
    )
    return made.drop("o_totalprice", "o_custkey", "odd")


@query("""SELECT l_returnflag, round(sum(l_quantity + l_discount + l_tax), 4) AS total, round(sum(l_quantity * l_discount * l_tax), 4) AS product_, round(sum((l_quantity + l_discount + l_tax) / 3), 4) AS mean_,
                 round(sum(least(l_quantity, l_discount, l_tax)), 4) AS low, round(sum(greatest(l_quantity, l_discount, l_tax)), 4) AS high FROM lineitem GROUP BY l_returnflag""")
def formula_aggregates(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity", "l_discount", "l_tax")
    names = "l_quantity,l_discount,l_tax"
    made = apply_formulas(rows, {"total": f"=SUM({names})", "product_": f"=PRODUCT({names})", "mean_": f"=AVERAGE({names})", "low": f"=MIN({names})", "high": f"=MAX({names})"}, iteration="l_orderkey")
    return made.groupBy("l_returnflag").agg(*(F.round(F.sum(c), 4).alias(c) for c in ("total", "product_", "mean_", "low", "high")))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'NaN' WHEN s_acctbal = 0 THEN '-Infinity' ELSE 'finite' END AS log_kind, CASE WHEN s_nationkey % 3 = 0 THEN (CASE WHEN s_acctbal < 0 THEN '-Infinity' ELSE 'Infinity' END) ELSE 'finite' END AS quotient_kind,
                 CASE WHEN s_acctbal < 0 THEN 1.0e0 ELSE 0.0e0 END AS differs FROM supplier""")
def formula_ieee(spark, sf_dir):
    """NaN and infinities flow through formulas; a NaN differs from everything."""
    made = apply_formulas(
        read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), {"l": "=LN(s_acctbal)", "q": "=s_acctbal/MOD(s_nationkey,3)", "differs": "=l<>l"}, iteration="s_suppkey"
    )
    kind = lambda c: F.when(F.isnan(c), "NaN").when(F.col(c) == ieee.INF, "Infinity").when(F.col(c) == -ieee.INF, "-Infinity").otherwise("finite")
    return made.select("s_suppkey", kind("l").alias("log_kind"), kind("q").alias("quotient_kind"), "differs")


_TAIL = f"""CASE WHEN x > {normal.CDF_END} THEN 0 WHEN x < {normal.CDF_SPLIT} THEN exp(-x * x / 2) * {sql_horner(normal.CDF_ABOVE, "x")} / {sql_horner(normal.CDF_BELOW, "x")}
            ELSE exp(-x * x / 2) / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / {normal.ROOT_TWO_PI} END"""


@query(f"""WITH z AS (SELECT p_partkey, (p_retailprice - 1200) / 90 AS z, abs((p_retailprice - 1200) / 90) AS x, p_size FROM part),
               c AS (SELECT *, CASE WHEN z > 0 THEN 1 - ({_TAIL}) ELSE {_TAIL} END AS cdf FROM z)
          SELECT p_partkey, round(cdf, 9) AS cdf, round(exp(-0.5 * z * z) / sqrt(2 * pi()), 9) AS density, round(sqrt(p_size) + exp(p_size / 50.0), 9) AS mixed, round(ln(p_size), 9) AS log_,
                 round(pow(p_size, 1.5), 6) AS power_, round(pow(2.0, 1.0 / p_size) - 1, 9) AS growth FROM c""")
def formula_functions(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    made = apply_formulas(
        rows,
        {"z": "=(p_retailprice-1200)/90", "cdf": "=NORMSDIST(z)", "density": "=NORM.S.DIST(z,FALSE)", "mixed": "=SQRT(p_size)+EXP(p_size/50)", "log_": "=LN(p_size)", "power_": "=POWER(p_size,1.5)", "growth": "=RRI(p_size,1,2)"},
        iteration="p_partkey",
    )
    return made.select("p_partkey", *(F.round(c, 6 if c == "power_" else 9).alias(c) for c in ("cdf", "density", "mixed", "log_", "power_", "growth")))


@query("SELECT p_partkey, round((p_size - 0.5) / 50, 8) AS p, round(10 + 3 * ((p_size - 0.5) / 50), 8) AS moved FROM part")
def formula_inverse_normal(spark, sf_dir):
    """The inverse undoes the cumulative."""
    made = apply_formulas(
        read(spark, sf_dir, "part").select("p_partkey", "p_size"), {"q": "=(p_size-0.5)/50", "p": "=NORMSDIST(NORMSINV(q))", "moved": "=10+3*NORM.S.DIST((NORM.INV(q,10,2)-10)/2,1)"}, iteration="p_partkey"
    )
    return made.select("p_partkey", F.round("p", 8).alias("p"), F.round("moved", 8).alias("moved"))


# Lookups

TIERS = {"A1": 0, "B1": 50, "A2": 10, "B2": 40, "A3": 25, "B3": 30, "A4": 40, "B4": 20}


@query("""WITH t(low, price) AS (VALUES (0, 50), (10, 40), (25, 30), (40, 20))
          SELECT l_orderkey, l_linenumber, CAST((SELECT max_by(price, low) FROM t WHERE low <= l_quantity) AS DOUBLE) AS tier, CAST(coalesce((SELECT price FROM t WHERE low = l_quantity), -1) AS DOUBLE) AS exact,
                 CAST((SELECT count(*) FROM t WHERE low <= l_quantity) AS DOUBLE) AS place FROM lineitem""")
def lookup_formulas(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    made = apply_formulas(
        rows, {"tier": "=VLOOKUP(l_quantity,Tiers!A1:B4,2)", "exact": "=IFERROR(VLOOKUP(l_quantity,Tiers!A1:B4,2,0),-1)", "place": "=MATCH(l_quantity,Tiers!A1:A4)"}, model=Sheet("Tiers", TIERS), iteration="l_orderkey"
    )
    return made.drop("l_quantity")


@query("SELECT c_custkey, CAST(coalesce(n_regionkey, -1) AS DOUBLE) AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) ON c_nationkey = n_nationkey")
def lookup_exact(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").withColumn("position", F.col("n_nationkey"))
    found = lookups.exact_lookup(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, "c_nationkey", "n_nationkey", "n_regionkey", "region")
    return found.select("c_custkey", F.when(F.isnan("region"), -1.0).otherwise(F.col("region")).alias("region"))


@query("""WITH t AS (SELECT n_nationkey AS position, n_nationkey * 400.0 - 1000 AS low, n_regionkey AS v FROM nation)
          SELECT c_custkey, CAST(coalesce((SELECT max_by(v, position) FROM t WHERE low <= c_acctbal), -1) AS DOUBLE) AS at_most, CAST(coalesce((SELECT max_by(v, position) FROM t WHERE low >= c_acctbal), -1) AS DOUBLE) AS at_least FROM customer""")
def lookup_nearest(spark, sf_dir):
    table = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), (F.col("n_nationkey") * 400.0 - 1000).alias("low"), F.col("n_regionkey").alias("v"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    found = lookups.nearest_lookup(lookups.nearest_lookup(rows, table, "c_acctbal", "low", "v", "at_most"), table, "c_acctbal", "low", "v", "at_least", descending=True)
    return found.select("c_custkey", *(F.when(F.isnan(c), -1.0).otherwise(F.col(c)).alias(c) for c in ("at_most", "at_least")))


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN 5.0e0 WHEN 2 THEN 7.0e0 WHEN 3 THEN 0.0e0 WHEN 4 THEN 11.0e0 ELSE -1.0e0 END AS entry, CASE p_size % 6 WHEN 1 THEN 5.0e0 WHEN 2 THEN 7.0e0 WHEN 4 THEN 11.0e0 WHEN 3 THEN 0.0e0 ELSE -1.0e0 END AS listed,
                 CASE WHEN p_size % 6 IN (1, 2) THEN 100.0e0 + p_size % 6 ELSE -1.0e0 END AS across FROM part""")
def lookup_index(spark, sf_dir):
    cells = {"A1": 5, "A2": 7, "A4": 11, "B1": 1, "C1": 2, "B2": 101, "C2": 102}
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 6).alias("k"))
    made = apply_formulas(rows, {"entry": "=IFERROR(INDEX(T!A1:A4,k),-1)", "across": "=IFERROR(HLOOKUP(k,T!B1:C2,2,0),-1)"}, model=Sheet("T", cells), iteration="p_partkey")
    listed = lookups.at_position([5, 7, None, 11], F.col("k"))
    return made.withColumn("listed", F.when(F.isnan(listed), -1.0).otherwise(listed)).drop("k")


# Periods and series


@query(f"""SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS q, CAST({SQL_MONTH.format("o_orderdate")} AS BIGINT) AS m,
                  CAST((({SQL_SERIAL.format("o_orderdate")}) - 2) // 7 AS BIGINT) AS w, CAST({SQL_SERIAL.format("o_orderdate")} AS BIGINT) AS d, CAST({SQL_SERIAL.format("o_orderdate")} * 24 + hour(o_orderdate) AS BIGINT) AS h,
                  strftime(o_orderdate, '%G-W%V') AS week_text, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter_text, strftime(o_orderdate, '%Y-%m') AS month_text, strftime(o_orderdate, '%Y-%m-%dT%H') AS hour_text FROM orders""")
def period_numbers(spark, sf_dir):
    rows = read(spark, sf_dir, "orders")
    numbers = {k[0]: calendar.period_of(F.col("o_orderdate"), k).cast("long") for k in ("year", "quarter", "month", "week", "day", "hour")}
    made = rows.select("o_orderkey", *(c.alias(n) for n, c in numbers.items()))
    text = {"week_text": ("w", "week"), "quarter_text": ("q", "quarter"), "month_text": ("m", "month"), "hour_text": ("h", "hour")}
    return made.select("*", *(calendar.format_period(F.col(c), kind).alias(n) for n, (c, kind) in text.items()))


@query(f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
          SELECT o_orderkey, CAST(year(d) AS DOUBLE) AS y, CAST(quarter(d) AS DOUBLE) AS q, CAST(month(d) AS DOUBLE) AS m, CAST(day(d) AS DOUBLE) AS day_, CAST(dayofweek(d) + 1 AS DOUBLE) AS weekday_,
                 CAST({SQL_MONTH.format("d")} AS DOUBLE) AS month_, CAST({SQL_SERIAL.format("date_trunc('month', d)")} AS DOUBLE) AS first_, CAST({SQL_SERIAL.format("last_day(d)")} AS DOUBLE) AS last_,
                 CAST({SQL_SERIAL.format("date_trunc('month', d) + INTERVAL 15 MONTH")} + 39 AS DOUBLE) AS built FROM d""")
def period_formulas(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", calendar.period_of(F.col("o_orderdate"), "day").alias("d"))
    made = apply_formulas(
        rows,
        {"y": "=YEAR(d)", "q": "=QUARTER(d)", "m": "=MONTH(d)", "day_": "=DAY(d)", "weekday_": "=WEEKDAY(d)", "month_": "=PERIOD.MONTH(d)", "first_": "=PERIOD.START(PERIOD.MONTH(d))", "last_": "=PERIOD.END(PERIOD.MONTH(d))", "built": "=DATE(y,m+15,40)"},
        inputs={"d": "day"},
        iteration="o_orderkey",
    )
    return made.drop("d")


@query(f"""WITH d AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_orderdate AS t, year(o_orderdate) AS y, {SQL_SERIAL.format("o_orderdate")} AS serial FROM orders)
          SELECT o_orderkey, ['year', 'quarter', 'month', 'day', 'hour', 'week', NULL, NULL][k + 1] AS granularity,
                 CAST(CASE k WHEN 0 THEN y WHEN 1 THEN y * 4 + quarter(t) - 1 WHEN 2 THEN {SQL_MONTH.format("t")} WHEN 3 THEN serial WHEN 4 THEN serial * 24 + hour(t) WHEN 5 THEN (serial - 2) // 7 END AS BIGINT) AS number,
                 CASE k WHEN 0 THEN CAST(y AS VARCHAR) WHEN 1 THEN y || '-Q' || quarter(t) WHEN 2 THEN strftime(t, '%Y-%m') WHEN 3 THEN strftime(t, '%Y-%m-%d') WHEN 4 THEN strftime(t, '%Y-%m-%dT%H') WHEN 5 THEN strftime(t, '%G-W%V')
                        WHEN 6 THEN y || '-13' ELSE y || '-W54' END AS normal FROM d""")
def period_texts(spark, sf_dir):
    """Texts of periods, loose ones and some that are none, to granularity, number and their one form."""
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 8
    forms = [
        F.year(t).cast("string"), F.concat(F.year(t), F.lit("-q"), F.quarter(t)), F.concat(F.year(t), F.lit("-"), F.month(t)), F.concat(F.year(t), F.lit("-"), F.month(t), F.lit("-"), F.dayofmonth(t)),
        F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("t"), F.hour(t)), F.concat(F.lit(" "), calendar.format_period(calendar.period_of(t, "week"), "week")), F.concat(F.year(t), F.lit("-13")), F.concat(F.year(t), F.lit("-W54")),
    ]
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*forms), k.cast("int")).alias("text"))
    found = rows.withColumn("found", calendar.parse_period(F.col("text")))
    return found.select("o_orderkey", "found.granularity", "found.number", calendar.normalise_period(F.col("text")).alias("normal"))


def _months(spark, sf_dir) -> DataFrame:
    """Monthly revenue by priority; the months divisible by 5 are empty entries."""
    rows = read(spark, sf_dir, "orders").where("month(o_orderdate) % 5 <> 0")
    return complete_periods(series_from(rows, "o_orderdate", F.round(F.sum("o_totalprice"), 2), "month", name=F.col("o_orderpriority")))


_SQL_MONTHS = f"""given AS (SELECT o_orderpriority AS series, {SQL_MONTH.format("o_orderdate")} AS period, round(sum(o_totalprice), 2) AS value FROM orders WHERE month(o_orderdate) % 5 <> 0 GROUP BY ALL),
    spans AS (SELECT series, unnest(generate_series(min(period), max(period))) AS period FROM given GROUP BY series), months AS (SELECT s.series, s.period, g.value FROM spans s LEFT JOIN given g ON s.series = g.series AND s.period = g.period)"""


@query(f"WITH {_SQL_MONTHS} SELECT series, CAST(period // 3 AS BIGINT) AS period, round(sum(coalesce(value, 0)), 2) AS value FROM months GROUP BY ALL")
def series_flow_coarser(spark, sf_dir):
    return rounded(lookups.coarser_series(lookups.fill_series(_months(spark, sf_dir), "flow"), "flow", "month", "quarter"), 2)


@query(f"""WITH {_SQL_MONTHS}, filled AS (SELECT series, period, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY period) AS value FROM months)
          SELECT series, CAST(period // 12 AS BIGINT) AS period, max_by(value, period) AS value FROM filled GROUP BY ALL""")
def series_level_coarser(spark, sf_dir):
    return lookups.coarser_series(lookups.fill_series(_months(spark, sf_dir), "level"), "level", "month", "year")


@query(f"WITH {_SQL_MONTHS} SELECT series, CAST(period // 3 AS BIGINT) AS period, CASE WHEN count(*) = count(value) THEN round(avg(value), 4) ELSE -1.0 END AS value FROM months GROUP BY ALL")
def series_rate_coarser(spark, sf_dir):
    """One empty rate makes its quarter NaN."""
    found = lookups.coarser_series(lookups.fill_series(_months(spark, sf_dir), "rate"), "rate", "month", "quarter")
    return found.select("series", "period", F.when(F.isnan("value"), -1.0).otherwise(F.round("value", 4)).alias("value"))


def _finer(spark, sf_dir, kind: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series"), calendar.period_of(F.col("o_orderdate"), "day").alias("d"))
    found = lookups.series_lookup(rows, _months(spark, sf_dir), kind=kind, source="month", asked="day", time="d", to="v")
    return found.select("o_orderkey", F.when(F.isnan("v"), -1.0).otherwise(F.round("v", 4)).alias("v"))


def _sql_finer(fill: str, value: str) -> str:
    return f"""WITH {_SQL_MONTHS}, filled AS (SELECT series, period, {fill} AS value FROM months), nexts AS (SELECT *, lead(value) OVER (PARTITION BY series ORDER BY period) AS after FROM filled),
        dated AS (SELECT *, make_date(period // 12, period % 12 + 1, 1) AS first FROM nexts), sized AS (SELECT *, day(last_day(first)) AS days FROM dated)
        SELECT o_orderkey, coalesce(round({value}, 4), -1) AS v FROM orders LEFT JOIN sized ON series = o_orderpriority AND period = {SQL_MONTH.format("o_orderdate")}"""


@query(_sql_finer("coalesce(value, 0)", "value / days"))
def series_flow_finer(spark, sf_dir):
    return _finer(spark, sf_dir, "flow")


@query(_sql_finer("last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY period)", "value + (CASE WHEN after IS NULL THEN 0 ELSE datediff('day', first, CAST(o_orderdate AS DATE)) / days * (after - value) END)"))
def series_level_finer(spark, sf_dir):
    return _finer(spark, sf_dir, "level")


@query(_sql_finer("value", "value"))
def series_rate_finer(spark, sf_dir):
    return _finer(spark, sf_dir, "rate")


@query(f"""WITH {_SQL_MONTHS} SELECT n_nationkey, CAST(n_nationkey % 5 + 1 AS INTEGER) AS length_, round(sum(coalesce(value, 0)), 2) AS total
          FROM nation JOIN months ON series = '1-URGENT' AND period BETWEEN 1993 * 12 + n_nationkey AND 1993 * 12 + n_nationkey + n_nationkey % 5 GROUP BY ALL""")
def series_period_range(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 1993 * 12).alias("a"), (F.col("n_nationkey") + F.col("n_nationkey") % 5 + 1993 * 12).alias("b"), F.lit("1-URGENT").alias("series"))
    each = lookups.series_lookup(lookups.period_range(rows, "a", "b"), _months(spark, sf_dir), kind="flow", source="month", asked="month", time="period", to="v").where(~F.isnan("v"))
    return each.groupBy("n_nationkey", (F.col("b") - F.col("a") + 1).cast("int").alias("length_")).agg(F.round(F.sum("v"), 2).alias("total"))


@query(f"""WITH {_SQL_MONTHS}, asked AS (SELECT o_orderkey, o_orderpriority AS series, {SQL_MONTH.format("o_orderdate")} AS a, {SQL_MONTH.format("o_orderdate")} + o_custkey % 24 AS b FROM orders)
          SELECT o_orderkey, round(coalesce(sum(value), 0), 2) AS total, count(m.period) AS periods FROM asked LEFT JOIN months m ON m.series = asked.series AND m.period BETWEEN a AND b GROUP BY o_orderkey""")
def series_range_totals(spark, sf_dir):
    """The revenue of each order's priority over up to two years from its month, by running totals."""
    month = calendar.period_of(F.col("o_orderdate"), "month")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series"), month.alias("a"), (month + F.col("o_custkey") % 24).alias("b"))
    return lookups.range_totals(rows, _months(spark, sf_dir), "a", "b").select("o_orderkey", F.round("total", 2).alias("total"), "periods")


@query("""WITH t AS (SELECT o_custkey AS k, o_orderkey AS position, epoch(o_orderdate) AS low, o_totalprice AS v FROM orders), e AS (SELECT event_id, user_id, 694224000 + (event_id * 7919) % 200000000 AS moment FROM events)
          SELECT event_id, round(coalesce((SELECT max_by(v, position) FROM t WHERE k = user_id AND low <= moment), -1), 2) AS at_most, round(coalesce((SELECT max_by(v, position) FROM t WHERE k = user_id AND low >= moment), -1), 2) AS at_least FROM e""")
def lookup_nearest_by_key(spark, sf_dir):
    """Events to the orders of the customer with the user's number, at or before a time and at or after it."""
    table = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("position"), F.col("o_orderdate").cast("timestamp").cast("double").alias("low"), F.col("o_totalprice").alias("v"))
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", (F.lit(694224000) + (F.col("event_id") * 7919) % 200000000).alias("at"))
    for name, descending in (("at_most", False), ("at_least", True)):
        rows = lookups.nearest_lookup(rows, table, "at", "low", "v", name, descending=descending, by=("user_id",))
    return rows.select("event_id", *(F.when(F.isnan(c), -1.0).otherwise(F.round(c, 2)).alias(c) for c in ("at_most", "at_least")))


@query("""WITH r AS (SELECT user_id AS series, CAST(event_id AS INTEGER) AS row, CAST(year(ts) * 12 + month(ts) - 1 + event_id % 3 AS BIGINT) AS period FROM events),
          o AS (SELECT *, lag(period) OVER (PARTITION BY series ORDER BY row) AS before, row_number() OVER (PARTITION BY series ORDER BY period, row) AS place FROM r)
          SELECT series, count(*) FILTER (before > period) AS falls, sum(place * row) AS order_, (SELECT count(*) FROM (SELECT 1 FROM r x WHERE x.series = o.series GROUP BY period HAVING count(*) > 1)) AS repeated,
                 coalesce((SELECT max(period) + 1 FROM r x WHERE x.series = o.series AND x.row < 500), -1) AS next_ FROM o GROUP BY series""")
def series_upkeep(spark, sf_dir):
    """Rows out of order, sorted rows, repeated periods and the next period of a sheet's rows."""
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), F.col("event_id").cast("int").alias("row"), (F.year("ts") * 12 + F.month("ts") - 1 + F.col("event_id") % 3).cast("long").alias("period"), F.col("value")
    )
    falls = lookups.out_of_order(rows).groupBy("series").agg(F.count(F.lit(1)).alias("falls"))
    order = lookups.sorted_series(rows).groupBy("series").agg(F.sum(F.col("place") * F.col("row")).alias("order_"))
    repeated = lookups.repeated_periods(rows).groupBy("series").agg(F.count(F.lit(1)).alias("repeated"))
    following = lookups.next_period(rows, 500).select("series", F.col("period").alias("next_"))
    both = order.join(falls, "series", "left").join(repeated, "series", "left").join(following, "series", "left")
    return both.select("series", F.coalesce("falls", F.lit(0)).alias("falls"), "order_", F.coalesce("repeated", F.lit(0)).alias("repeated"), F.coalesce("next_", F.lit(-1)).alias("next_"))


# The other functions of formulas


@query("""SELECT l_orderkey, l_linenumber, l_quantity * l_discount + l_extendedprice * l_tax AS product_, 3.0e0 AS counted, CASE CAST(l_linenumber AS INTEGER) WHEN 1 THEN 5.0e0 WHEN 2 THEN 7.0e0 WHEN 3 THEN 9.0e0 ELSE -1.0e0 END AS at_row,
                 CASE WHEN l_linenumber BETWEEN 1 AND 3 THEN 10.0e0 * l_linenumber ELSE -1.0e0 END AS at_both FROM lineitem""")
def formula_tables(spark, sf_dir):
    """SUMPRODUCT, COUNT (texts and empty cells don't count) and INDEX by row and by row and column."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    cells = {"A1": 5, "A2": 7, "A3": 9, "B1": 10, "B2": 20, "B3": 30, "C1": "text", "D1": 1, "D3": 2, "D5": 3}
    made = apply_formulas(
        rows.withColumn("k", F.col("l_linenumber").cast("double")),
        {"a": "=l_quantity", "b": "=l_extendedprice", "c": "=l_discount", "d": "=l_tax", "product_": "=SUMPRODUCT(Formulas!A1:A2,Formulas!A3:A4)", "counted": "=COUNT(T!C1:D6)", "at_row": "=IFERROR(INDEX(T!A1:B3,k,1),-1)", "at_both": "=IFERROR(INDEX(T!A1:B3,k,2),-1)"},
        model=Sheet("T", cells), iteration="l_orderkey",
    )
    return made.select("l_orderkey", "l_linenumber", "product_", "counted", "at_row", "at_both")


@query("SELECT p_partkey, round((p_size - 0.5) / 50, 8) AS p, round(ln(exp(0.5 * p_size / 50)), 8) AS log_ FROM part")
def formula_lognormal_inverse(spark, sf_dir):
    """The logarithm of LOGNORM.INV is NORM.INV, which NORMSDIST undoes."""
    made = apply_formulas(
        read(spark, sf_dir, "part").select("p_partkey", "p_size"), {"q": "=(p_size-0.5)/50", "x": "=LOGNORM.INV(q,1,0.5)", "p": "=NORMSDIST((LN(x)-1)/0.5)", "log_": "=LN(LOGINV(0.5,0.5*p_size/50,2))"}, iteration="p_partkey"
    )
    return made.select("p_partkey", F.round("p", 8).alias("p"), F.round("log_", 8).alias("log_"))


@query(f"""WITH d AS (SELECT o_orderkey, o_orderdate AS t, CAST(o_orderdate AS DATE) AS d, {SQL_SERIAL.format("o_orderdate")} AS serial FROM orders)
          SELECT o_orderkey, CAST({SQL_MONTH.format("d")} - (1995 * 12 + 5) AS DOUBLE) AS months, CASE WHEN {SQL_MONTH.format("d")} >= 1995 * 12 + 5 THEN 1.0e0 ELSE 0.0e0 END AS later, CASE WHEN year(d) = 1995 THEN 1.0e0 ELSE 0.0e0 END AS same_,
                 CAST(hour(t) AS DOUBLE) AS hour_, CAST(year(d) * 4 + quarter(d) - 1 AS DOUBLE) AS quarter_, CAST({SQL_MONTH.format("d")} + 2 AS DOUBLE) AS built_month, CAST(serial + 30 AS DOUBLE) AS moved FROM d""")
def period_differences(spark, sf_dir):
    """Periods less periods, compared, moved by numbers, made of parts, and written as literals."""
    day, hour = (calendar.period_of(F.col("o_orderdate"), kind) for kind in ("day", "hour"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", day.alias("d"), hour.alias("h"))
    made = apply_formulas(
        rows,
        {"m": "=PERIOD.MONTH(d)", "months": "=m-1995-06", "later": "=m>=1995-06", "same_": "=PERIOD.YEAR(d)=PERIOD.YEAR(1995-01)", "hour_": "=HOUR(h)", "quarter_": "=PERIOD.QUARTER(YEAR(d),QUARTER(d))", "built_month": "=PERIOD.MONTH(YEAR(d),MONTH(d)+2)", "moved": "=d+30"},
        inputs={"d": "day", "h": "hour"}, iteration="o_orderkey",
    )
    return made.select("o_orderkey", "months", "later", "same_", "hour_", "quarter_", "built_month", "moved")


# Draws


@query(f"""WITH {sql_uniform("u", "orders", "o_orderkey", stream_of("Formulas", "A1", 0), 0, "u")}, {sql_uniform("t", "u", "o_orderkey", stream_of("Formulas", "A2", 0), 0, "t")},
               {sql_uniform("s", "t", "o_orderkey", stream_of("Formulas", "A3", 1), 0, "s")}
          SELECT o_orderkey, 10 + (20.0 - 10) * u AS uniform_, round(CASE WHEN t * 10 < 2 THEN sqrt(t * 10 * 2) ELSE 10 - sqrt((1 - t) * 10 * 8) END, 9) AS triangular_, s AS second_ FROM s""")
def draw_uniform(spark, sf_dir):
    made = apply_formulas(read(spark, sf_dir, "orders").select("o_orderkey"), {"uniform_": "=UNIFORM(10,20)", "triangular_": "=TRIANGULAR(0,2,10)", "second_": "=RAND()*0+RAND()"}, iteration="o_orderkey")
    return made.withColumn("triangular_", F.round("triangular_", 9))


@query(f"""WITH {sql_uniform("u", "orders", "o_orderkey", stream_of("Formulas", "A1", 0), 0, "u")}, {sql_uniform("v", "u", "o_orderkey", stream_of("Formulas", "A1", 0), 1, "v")},
               {sql_uniform("x", "v", "o_orderkey", stream_of("Formulas", "A2", 0), 0, "x")}, {sql_uniform("y", "x", "o_orderkey", stream_of("Formulas", "A2", 0), 1, "y")}
          SELECT o_orderkey, round(100 + 15 * (sqrt(-2 * ln(u)) * cos(pi() * (2 * v - 1))), 8) AS normal_, round(exp(0.5 * (sqrt(-2 * ln(x)) * cos(pi() * (2 * y - 1)))), 8) AS lognormal_ FROM y""")
def draw_normal(spark, sf_dir):
    made = apply_formulas(read(spark, sf_dir, "orders").select("o_orderkey"), {"normal_": "=NORMAL(100,15)", "lognormal_": "=LOGNORMAL(0,0.5)"}, iteration="o_orderkey")
    return rounded(made, 8)


# Simulation and summaries

COSTS = {"A1": "=UNIFORM(8,12)", "B1": "=TRIANGULAR(100,150,300)", "C1": "=A1*B1", "D1": 3, "E1": "=D1*2"}
#: The same with every order as an iteration: its price is a name in the formulas.
COSTS_OF_ORDERS = COSTS | {"C1": "=A1*B1*o_totalprice/100000"}
_SQL_COSTS = f"""{sql_uniform("u", "orders", "o_orderkey", stream_of("Sheet1", "A1", 0), 0, "u", 7)}, {sql_uniform("t", "u", "o_orderkey", stream_of("Sheet1", "B1", 0), 0, "t", 7)},
    made AS (SELECT o_orderkey AS iteration, o_totalprice, 8 + 4 * u AS price, CASE WHEN t * 200 < 50 THEN 100 + sqrt(t * 200 * 50) ELSE 300 - sqrt((1 - t) * 200 * 150) END AS amount FROM t),
    samples AS (SELECT iteration, 'C1' AS cell, price * amount * o_totalprice / 100000 AS value FROM made UNION ALL SELECT iteration, 'A1', price FROM made UNION ALL SELECT iteration, 'E1', 6.0 FROM made UNION ALL SELECT iteration, 'B1', amount FROM made)"""


def _costs(spark, sf_dir, outputs: list[str]):
    return simulation(read(spark, sf_dir, "orders"), COSTS_OF_ORDERS, outputs, seed=7, iteration="o_orderkey")


def _samples(made) -> DataFrame:
    return made.samples(*made.span())


@query(f"WITH {_SQL_COSTS} SELECT cell, count(*) AS count, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(min_by(value, iteration), 6) AS first FROM samples WHERE cell <> 'B1' GROUP BY cell")
def simulate_summary(spark, sf_dir):
    outputs = ["C1", "A1", "E1"]
    return rounded(summary.summarize(_samples(_costs(spark, sf_dir, outputs)), outputs).select("cell", "count", "mean", "sd", "first"))


@query(ORACLES["simulate_summary"])
def simulate_progressively(spark, sf_dir):
    """Batches of 1,000, 2,000, ... ids, one queued while one runs, give the summaries of one run."""
    found = run_progressively(read(spark, sf_dir, "orders"), COSTS_OF_ORDERS, ["C1", "A1", "E1"], seed=7, first=1000, iteration="o_orderkey")
    return rounded(found.select("cell", "count", "mean", "sd", "first"))


_SQL_CHECKED = f"WITH {_SQL_COSTS} SELECT cell AS output, least(count(*), {{most}}) AS compared, 0::BIGINT AS mismatches, CAST(floor(least(count(*), {{most}}) * 0.001) AS BIGINT) AS allowed, true AS agrees FROM samples WHERE cell IN ('B1', 'C1') GROUP BY cell"


@query(f"SELECT c.*, m.mean FROM ({_SQL_CHECKED.format(most=10**9)}) c JOIN (WITH {_SQL_COSTS} SELECT cell, round(avg(value), 6) AS mean FROM samples GROUP BY cell) m ON m.cell = c.output")
def simulate_cross_check(spark, sf_dir):
    """Columns against Arrow batches, joined by iteration, and the means of the batches."""
    made = _costs(spark, sf_dir, ["C1", "B1"])
    batches = made.samples(*made.span(), engine="batches")
    means = summary.summarize(batches, ["C1", "B1"]).select(F.col("cell").alias("output"), F.round("mean", 6).alias("mean"))
    return cross_check(made.rows, COSTS_OF_ORDERS, ["C1", "B1"], seed=7, iteration="o_orderkey").drop("worst").join(means, "output")


OPTION = {
    "A1": 100, "A2": 105, "A3": "=5%", "A4": "=20%", "A5": 1, "B1": "=A1*LOGNORMAL((A3-A4^2/2)*A5,A4*SQRT(A5))", "B2": "=MAX(B1-A2,0)*EXP(-A3*A5)", "B3": "=B1*EXP(-A3*A5)",
    "C1": "=(LN(A1/A2)+(A3+A4^2/2)*A5)/(A4*SQRT(A5))", "C2": "=A1*NORMSDIST(C1)-A2*EXP(-A3*A5)*NORMSDIST(C1-A4*SQRT(A5))",
}
_SQL_CDF = "CASE WHEN {0} > 0 THEN 1 - ({1}) ELSE {1} END"


@query(f"""WITH {sql_uniform("u", "orders", "o_orderkey", stream_of("Sheet1", "B1", 0), 0, "u", 314)}, {sql_uniform("v", "u", "o_orderkey", stream_of("Sheet1", "B1", 0), 1, "v", 314)},
          b AS (SELECT o_orderkey, o_totalprice / 1500 AS s, o_totalprice / 1500 * exp((0.05 - 0.2 * 0.2 / 2) + 0.2 * (sqrt(-2 * ln(u)) * cos(pi() * (2 * v - 1)))) AS b1, (ln(o_totalprice / 1500 / 105) + (0.05 + 0.2 * 0.2 / 2)) / 0.2 AS c1 FROM v),
          d AS (SELECT *, abs(c1) AS x FROM b), e AS (SELECT *, {_SQL_CDF.format("c1", _TAIL)} AS n1, c1 - 0.2 AS c2 FROM d), f AS (SELECT * EXCLUDE (x), abs(c2) AS x FROM e), g AS (SELECT *, {_SQL_CDF.format("c2", _TAIL)} AS n2 FROM f),
          samples AS (SELECT unnest(['B2', 'B3', 'C2']) AS cell, unnest([greatest(b1 - 105, 0) * exp(-0.05), b1 * exp(-0.05), s * n1 - 105 * exp(-0.05) * n2]) AS value FROM g)
          SELECT cell, count(*) AS count, round(avg(value), 5) AS mean, round(stddev_samp(value), 4) AS sd FROM samples GROUP BY cell""")
def simulate_option(spark, sf_dir):
    """A call on what each order costs: its discounted pay-off by simulation, its closed form, and the discounted share."""
    made = simulation(read(spark, sf_dir, "orders"), OPTION | {"A1": "=o_totalprice/1500"}, ["B2", "B3", "C2"], seed=314, iteration="o_orderkey")
    found = summary.summarize(_samples(made), ["B2", "B3", "C2"])
    return found.select("cell", "count", F.round("mean", 5).alias("mean"), F.round("sd", 4).alias("sd"))


@query("SELECT c_mktsegment AS segment, count(*) AS count, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round(min_by(c_acctbal, c_custkey), 6) AS first FROM customer GROUP BY c_mktsegment")
def summary_by_group(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("iteration"), "c_acctbal")
    return rounded(summary.summarize(rows, ["c_acctbal"], ["segment"]).select("segment", "count", "mean", "sd", "first"))


@query("SELECT n_regionkey, count(*) AS count, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def summary_merged(spark, sf_dir):
    """Summaries per nation merged to those of regions."""
    rows = read(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("iteration"), "c_acctbal")
    parts = summary.summarize(rows, ["c_acctbal"], ["c_nationkey"]).join(read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return rounded(summary.merge_summaries(parts, ["n_regionkey"]).select("n_regionkey", "count", "mean", "sd"))


@query("""SELECT l_returnflag AS flag, count(*) FILTER (l_discount = 0 AND l_tax > 0) AS infinities, count(*) FILTER (l_discount = 0 AND l_tax = 0) AS nans,
                 CASE WHEN count(*) FILTER (l_discount = 0 AND l_tax = 0) > 0 THEN '#NUM!' WHEN count(*) FILTER (l_discount = 0 AND l_tax > 0) > 0 THEN '#DIV/0!' END AS code,
                 round(avg(l_tax / l_discount) FILTER (l_discount > 0), 6) AS mean FROM lineitem GROUP BY l_returnflag""")
def summary_of_errors(spark, sf_dir):
    rows = apply_formulas(read(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_tax", "l_discount"), {"ratio": "=l_tax/l_discount"}, iteration="l_orderkey")
    found = summary.with_kind(summary.summarize(rows.select(F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("iteration"), "ratio"), ["ratio"], ["flag"]))
    return found.select("flag", "infinities", "nans", "code", F.round("mean", 6).alias("mean"))


_VALUES = "values_ AS (SELECT o_orderpriority AS cell, o_orderkey AS iteration, o_totalprice AS value FROM orders)"


def _order_bins(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cell"), F.col("o_orderkey").alias("iteration"), F.col("o_totalprice").alias("value"))
    return summary.histogram(rows, ["cell"])


@query(f"WITH {_VALUES}, {sql_bins('values_')} SELECT cell, bin, n, round(low, 1) AS low, round(high, 1) AS high FROM bins")
def histogram_bins(spark, sf_dir):
    return rounded(_order_bins(spark, sf_dir), 1)


_SQL_QUANTILES = """running AS (SELECT *, sum(n) OVER (PARTITION BY cell ORDER BY low) - n AS before, sum(n) OVER (PARTITION BY cell) AS total FROM bins),
    asked AS (SELECT *, unnest([0.005, 0.1, 0.5, 0.9, 0.995]) AS share FROM running),
    quantiles AS (SELECT cell, share, min_by(low + greatest(0, share * total - before) / n * (high - low), low) AS value FROM asked WHERE before + n >= share * total GROUP BY cell, share)"""


@query(f"WITH {_VALUES}, {sql_bins('values_')}, {_SQL_QUANTILES} SELECT cell, CAST(share AS DOUBLE) AS share, round(value, 4) AS value FROM quantiles")
def histogram_quantiles(spark, sf_dir):
    return rounded(summary.quantiles(_order_bins(spark, sf_dir), ["cell"], [0.005, 0.1, 0.5, 0.9, 0.995]), 4)


_SQL_WINDOWS = f"""occupied AS (SELECT cell, min(low) AS a, max(high) AS b FROM bins GROUP BY cell), ends AS (SELECT cell, min(value) AS q1, max(value) AS q2 FROM quantiles WHERE share IN (0.005, 0.995) GROUP BY cell),
    cut AS (SELECT o.cell, a, b, greatest(a, q1 - (q2 - q1) * 0.25) AS lo, least(b, q2 + (q2 - q1) * 0.25) AS hi FROM occupied o JOIN ends e ON o.cell = e.cell),
    shown AS (SELECT cell, CASE WHEN hi - lo >= (b - a) * 2 / 3 THEN a - (b - a) * 0.05 ELSE lo END AS lo, CASE WHEN hi - lo >= (b - a) * 2 / 3 THEN b + (b - a) * 0.05 ELSE hi END AS hi FROM cut),
    placed AS (SELECT s.*, low, high, n, unnest(range({summary.BARS})) AS bar FROM bins JOIN shown s ON bins.cell = s.cell),
    spread AS (SELECT cell, bar, sum(n * greatest(0, least(high, lo + (bar + 1) * (hi - lo) / {summary.BARS}) - greatest(low, lo + bar * (hi - lo) / {summary.BARS})) / (high - low)) AS n FROM placed GROUP BY cell, bar)"""


@query(f"WITH {_VALUES}, {sql_bins('values_')}, {_SQL_QUANTILES}, {_SQL_WINDOWS} SELECT o.cell, CAST(bar AS INTEGER) AS bar, round(n, 4) AS n, round(lo, 3) AS lo, round(hi, 3) AS hi, round(n / (SELECT max(n) FROM spread m WHERE m.cell = o.cell), 6) AS height FROM spread o JOIN shown s ON o.cell = s.cell WHERE n > 0.00005")
def histogram_display(spark, sf_dir):
    shown = summary.display(_order_bins(spark, sf_dir), ["cell"]).where("n > 0.00005")
    return shown.select("cell", "bar", F.round("n", 4).alias("n"), F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), F.round("height", 6).alias("height"))


@query("""WITH s AS (SELECT c_mktsegment AS cell, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1),
               e AS (SELECT cell, low, high, unnest(range(-20, 40)) AS e FROM s), w AS (SELECT cell, min(pow(2.0, e)) AS width FROM e WHERE floor(high / pow(2.0, e)) - floor(low / pow(2.0, e)) < 128 GROUP BY cell)
          SELECT w.cell, width * 2 AS width, CAST(floor(floor(c_acctbal / width) / 2) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM customer JOIN w ON c_mktsegment = cell GROUP BY ALL""")
def histogram_doubling(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cell"), F.col("c_acctbal").alias("value"))
    return summary.halve_bins(summary.doubling_bins(rows, ["cell"]), ["cell"])


# Wide models, progressive histograms


WALK = {"A1": "=UNIFORM(-1,1)"} | {f"A{i}": f"=A{i - 1}+UNIFORM(-1,1)" for i in range(2, 61)}


@query(f"""WITH streams(place, stream) AS (VALUES {", ".join(f"({i}, {stream_of('Sheet1', f'A{i}', 0)})" for i in range(1, 61))}), both_ AS (SELECT c_custkey AS iteration, place, stream FROM customer, streams),
          {sql_uniform("u", "both_", "iteration", "stream", 0, "u", 11)}, sums AS (SELECT 'A' || place AS cell, iteration, sum(-1 + 2 * u) OVER (PARTITION BY iteration ORDER BY place) AS value FROM u)
          SELECT cell, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min_by(value, iteration), 6) AS first FROM sums GROUP BY cell""")
def simulate_walk(spark, sf_dir):
    """Sixty draws and sixty outputs of each customer, each resting on the one before."""
    made = simulation(read(spark, sf_dir, "customer"), WALK, list(WALK), seed=11, iteration="c_custkey")
    return rounded(summary.summarize(_samples(made), list(WALK)).select("cell", "count", "mean", "sd", "first"))


@query(f"""WITH streams(place, stream) AS (VALUES {", ".join(f"({i}, {stream_of('Formulas', f'A{i}', 0)})" for i in range(1, 21))}), both_ AS (SELECT o_orderkey, o_orderpriority, o_totalprice, stream FROM orders, streams),
          {sql_uniform("u", "both_", "o_orderkey", "stream", 0, "u")}, each AS (SELECT o_orderkey, any_value(o_orderpriority) AS o_orderpriority, any_value(o_totalprice) * (1 + sum(0.01 * u)) AS raised FROM u GROUP BY o_orderkey)
          SELECT o_orderpriority, count(*) AS orders_, round(avg(raised), 4) AS raised FROM each GROUP BY o_orderpriority""")
def formula_many_draws(spark, sf_dir):
    """Twenty draws beside the columns of the orders, which stay."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    steps = {f"step_{i}": "=UNIFORM(0,0.01)" for i in range(1, 21)}
    made = apply_formulas(rows, steps | {"raised": f"=o_totalprice*(1+SUM({','.join(steps)}))"}, iteration="o_orderkey")
    return made.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders_"), F.round(F.avg("raised"), 4).alias("raised"))


@query(f"WITH {_SQL_COSTS}, drawn AS (SELECT * FROM samples WHERE cell IN ('A1', 'C1')), {sql_bins('drawn')} SELECT cell, bin, n, round(low, 6) AS low, round(high, 6) AS high FROM bins")
def progressive_histogram(spark, sf_dir):
    """Counts per bin from batches of 5,000, 10,000 and the other ids."""
    return rounded(histogram_progressively(read(spark, sf_dir, "orders"), COSTS_OF_ORDERS, ["C1", "A1"], seed=7, first=5000, iteration="o_orderkey"))


@query(f"""WITH {_SQL_COSTS}, drawn AS (SELECT * FROM samples WHERE cell IN ('A1', 'C1')), ends AS (SELECT min(iteration) + 9000 AS end_ FROM drawn), early AS (SELECT drawn.* FROM drawn, ends WHERE iteration < end_), {sql_bins('early')}
          SELECT s.cell, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, (SELECT sum(n) FROM bins b WHERE b.cell = s.cell) AS binned, (SELECT CAST(count(*) AS BIGINT) FROM bins b WHERE b.cell = s.cell) AS bins FROM drawn s GROUP BY s.cell""")
def progressive_phases(spark, sf_dir):
    """Histogram and moments of one run: ids up to 9,000 count in both, later ones in the moments."""
    state = run_in_phases(_costs(spark, sf_dir, ["C1", "A1"]), first=1000, binned_until=9000)
    bins = state.bins().groupBy("cell").agg(F.sum("n").alias("binned"), F.count(F.lit(1)).alias("bins"))
    return rounded(state.summaries().select("cell", "count", "mean", "sd").join(bins, "cell"))


@query(_SQL_CHECKED.format(most=8000))
def progressive_comparison(spark, sf_dir):
    """Columns and Arrow batches at once, 3,000 and the other ids at a time, held against each other over the first 8,000."""
    return compare_progressively(read(spark, sf_dir, "orders"), COSTS_OF_ORDERS, ["C1", "B1"], seed=7, first=3000, compared=8000, iteration="o_orderkey").drop("worst")


@query("""SELECT event_type AS cell, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min_by(value, event_id), 6) AS first, CAST(count(*) AS DOUBLE) AS binned FROM events GROUP BY event_type""")
def stream_accumulated(spark, sf_dir):
    """Events as a stream, one half after the other: a query that starts again from its checkpoint adds to what is stored."""
    events, folder = read(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), F.col("event_id").alias("iteration"), "value"), fresh_path(spark, "stream")
    for half in (0, 1):
        events.where(F.col("iteration") % 2 == half).write.mode("append").parquet(f"{folder}/source")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source")
        accumulate(stream, ["cell"], f"{folder}/state", merged_every=2).awaitTermination()
    table = kept(accumulated(spark, f"{folder}/state", ["cell"]))
    binned = summary.bins_of(table, ["cell"]).groupBy("cell").agg(F.sum("n").alias("binned"))
    return rounded(summary.summaries_of(table, ["cell"]).select("cell", "count", "mean", "sd", "first").join(binned, "cell"))


# Scenarios: every order is an iteration

SHOP = [
    Sheet("Inputs", {"A1": 10, "A2": 0.2, "A3": 4, "A4": "label", "A5": "=UNIFORM(50,150)"}, names={"Price": "A1", "Rate": "A2", "Cost": "A3", "Demand": "A5"}),
    Sheet("Results", {"A1": "=Price*Demand*(1-Rate)", "A2": "=A1-Cost*Demand", "A3": "=Price/Cost"}),
]
SHOP_OF_ORDERS = [Sheet("Inputs", SHOP[0].cells | {"A5": "=o_totalprice/2000*UNIFORM(0.5,1.5)"}, names=SHOP[0].names), SHOP[1]]
PLANS = scenarios.Scenario(
    "Plans",
    ("Results!A1", "Results!A2", "Results!A3"),
    (scenarios.Dimension("price", ("Inputs!A1",), (("low", (8,)), ("high", (12,)))), scenarios.Dimension("terms", ("Inputs!A2", "Inputs!A3"), (("same", (None, None)), ("better", (0.1, 3)), ("worse", (0.3, 5))))),
    samples=5000,
)
_SQL_DEMAND = f"{sql_uniform('u', 'orders', 'o_orderkey', stream_of('Inputs', 'A5', 0), 0, 'u')}, demand AS (SELECT o_orderkey AS iteration, o_totalprice / 2000 * (0.5 + u) AS d FROM u)"
_SQL_PLANS = f"""{_SQL_DEMAND}, plans(combination, plan_price, terms, price, rate, cost) AS (VALUES (0, NULL, NULL, 10, 0.2, 4), (1, 'low', 'same', 8, 0.2, 4), (2, 'low', 'better', 8, 0.1, 3), (3, 'low', 'worse', 8, 0.3, 5),
    (4, 'high', 'same', 12, 0.2, 4), (5, 'high', 'better', 12, 0.1, 3), (6, 'high', 'worse', 12, 0.3, 5)),
    runs AS (SELECT *, unnest(['Results_A1', 'Results_A2', 'Results_A3']) AS cell, unnest([price * d * (1 - rate), price * d * (1 - rate) - cost * d, price * 1.0 / cost]) AS v FROM plans, demand)"""


def _plans(spark, sf_dir) -> DataFrame:
    return scenarios.run_scenario(read(spark, sf_dir, "orders"), SHOP_OF_ORDERS, PLANS, iteration="o_orderkey")


@query(f"WITH {_SQL_PLANS} SELECT combination, cell, CASE WHEN cell = 'Results_A3' THEN 'number' ELSE 'uncertain' END AS kind, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 4) AS sd FROM runs GROUP BY combination, cell")
def scenario_run(spark, sf_dir):
    return _plans(spark, sf_dir).select("combination", "cell", "kind", "count", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"))


@query(f"""WITH {_SQL_PLANS} SELECT plan_price AS price, cell, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 4) AS sd FROM runs WHERE terms <> 'worse' AND cell <> 'Results_A3' GROUP BY plan_price, cell""")
def scenario_pivot(spark, sf_dir):
    """Mixtures over the terms that are not the worse ones, by price."""
    choices = scenarios.choices_table(spark, PLANS).where("terms <> 'worse'")
    pooled = scenarios.pivot(_plans(spark, sf_dir).where("cell <> 'Results_A3'"), choices, ["price"])
    return pooled.select("price", "cell", "count", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"))


_SQL_POOLED = f"""values_ AS (SELECT combination || ' ' || cell AS cell, iteration, v AS value FROM runs WHERE combination > 0 AND cell <> 'Results_A3'), {sql_bins('values_')}, {_SQL_QUANTILES}, {_SQL_WINDOWS},
    parts AS (SELECT DISTINCT plan_price AS price, cell AS output, combination || ' ' || cell AS cell FROM runs WHERE combination > 0 AND cell <> 'Results_A3'),
    ranges AS (SELECT price, output, min(lo) AS lo, max(hi) AS hi FROM shown JOIN parts USING (cell) GROUP BY ALL),
    bars AS (SELECT price, output, lo + bar * (hi - lo) / 64 AS low, lo + (bar + 1) * (hi - lo) / 64 AS high, n FROM spread JOIN shown USING (cell) JOIN parts USING (cell)),
    met AS (SELECT r.*, low, high, n, unnest(range(64)) AS bar FROM bars JOIN ranges r USING (price, output)),
    pooled AS (SELECT price, output, lo, hi, bar, sum(n * greatest(0, least(high, lo + (bar + 1) * (hi - lo) / 64) - greatest(low, lo + bar * (hi - lo) / 64)) / (high - low)) AS n FROM met GROUP BY ALL),
    counted_ AS (SELECT *, (hi - lo) / 64 AS width, sum(n) OVER (PARTITION BY price, output ORDER BY bar) - n AS before, sum(n) OVER (PARTITION BY price, output) AS total FROM pooled WHERE n > 0)"""


@query(f"""WITH {_SQL_PLANS}, {_SQL_POOLED} SELECT price, output AS cell,
          {", ".join(f"round(min_by(lo + bar * width + ({p} * total - before) / n * width, bar) FILTER (before + n >= {p} * total), 3) AS p{int(100 * p)}" for p in (0.1, 0.5, 0.9))} FROM counted_ GROUP BY price, output""")
def scenario_quantiles(spark, sf_dir):
    """P10, P50 and P90 of the mixtures over all terms, from windows pooled on a common range."""
    binned = scenarios.bin_scenario(read(spark, sf_dir, "orders"), SHOP_OF_ORDERS, PLANS, baseline=False, iteration="o_orderkey")
    profiles = binned.profiles().where("cell <> 'Results_A3'").join(F.broadcast(scenarios.choices_table(spark, PLANS)), "combination")
    return rounded(scenarios.window_quantiles(scenarios.pool_windows(profiles, ["price", "cell"]), ["price", "cell"], {"p10": 0.1, "p50": 0.5, "p90": 0.9}), 3)


@query(f"""WITH {_SQL_PLANS}, m AS (SELECT terms, avg(v) FILTER (plan_price = 'low') AS low, avg(v) FILTER (plan_price = 'high') AS high FROM runs WHERE combination > 0 AND cell = 'Results_A2' GROUP BY terms)
          SELECT terms, round(low, 6) AS low, round(high, 6) AS high, CAST(row_number() OVER (ORDER BY high DESC) AS INTEGER) AS place FROM m""")
def scenario_pivot_table(spark, sf_dir):
    """Terms down, prices across, in order of the mean at the high price."""
    pooled = scenarios.pivot(_plans(spark, sf_dir).where("cell = 'Results_A2'"), scenarios.choices_table(spark, PLANS), ["terms"], ["price"])
    return rounded(scenarios.pivot_table(pooled, ["terms"], "price", ["low", "high"], by="high"))


@query(f"""WITH {_SQL_PLANS} SELECT plan_price AS price, terms, cell, count(*) AS count, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 4) AS sd,
          CASE WHEN min(v) = max(v) THEN 'number' ELSE 'uncertain' END AS kind FROM runs WHERE combination > 0 GROUP BY GROUPING SETS ((plan_price, terms, cell), (plan_price, cell), (terms, cell), (cell))""")
def scenario_lattice(spark, sf_dir):
    """Every choice of shown and pooled dimensions in one aggregation of summaries; a pooled dimension is null."""
    found = scenarios.lattice(_plans(spark, sf_dir), scenarios.choices_table(spark, PLANS), ["price", "terms"])
    return found.select("price", "terms", "cell", "count", F.round("mean", 6).alias("mean"), F.round("sd", 4).alias("sd"), "kind")


@query(f"""WITH {_SQL_PLANS}, m AS (SELECT combination, cell, avg(v) AS mean FROM runs GROUP BY combination, cell)
          SELECT a.combination, a.cell, round(a.mean - b.mean, 6) AS delta, round((a.mean - b.mean) / abs(b.mean), 6) AS percent FROM m a JOIN m b ON a.cell = b.cell AND b.combination = 0 WHERE a.combination > 0""")
def scenario_deltas(spark, sf_dir):
    return rounded(scenarios.against_baseline(_plans(spark, sf_dir)).select("combination", "cell", "delta", "percent"))


MIXED = scenarios.Scenario(
    "Mixed", ("Results!A2", "Inputs!A4", "Results!A9"), (scenarios.Dimension("demand", ("Inputs!A5", "Results!A2"), (("fixed", ("=o_totalprice/2000", None)), ("wide", ("=o_totalprice/2000*UNIFORM(0,2)", None)), ("gone", (None, "=NOTHING(1)")))),)
)


@query(f"""WITH {_SQL_DEMAND}, w AS (SELECT o_totalprice / 2000 AS fixed, o_totalprice / 2000 * (0.5 + u) AS d, o_totalprice / 2000 * (2 * u) AS wide FROM u),
          runs AS (SELECT unnest([0, 1, 2]) AS combination, unnest([d, fixed, wide]) * (10 * (1 - 0.2) - 4) AS v FROM w)
          SELECT combination, 'Results_A2' AS cell, CAST(NULL AS VARCHAR) AS code, 'uncertain' AS kind, count(*) AS count, round(avg(v), 5) AS mean, round(stddev_samp(v), 4) AS sd FROM runs GROUP BY combination
          UNION ALL SELECT c, 'Results_A9', NULL, 'number', (SELECT count(*) FROM orders), 0.0, 0.0 FROM range(4) t(c) UNION ALL SELECT c, 'Inputs_A4', '#VALUE!', 'error', 0, 0.0, 0.0 FROM range(4) t(c) UNION ALL SELECT 3, 'Results_A2', '#NAME?', 'error', 0, 0.0, 0.0""")
def scenario_formulas(spark, sf_dir):
    """Alternatives that are formulas, an output that is a text, an empty one, and one that fails in a combination: one reading of the orders."""
    found = scenarios.run_scenario(read(spark, sf_dir, "orders"), SHOP_OF_ORDERS, MIXED, iteration="o_orderkey")
    return found.select("combination", "cell", "code", "kind", "count", F.round("mean", 5).alias("mean"), F.round("sd", 4).alias("sd"))


STEPS = scenarios.Sensitivity("Steps", ("Results!A1", "Results!A2"), ("Inputs!A1", "Inputs!A2", "Inputs!A5"), (0.1,), 5000)
_SQL_MOVES = f"""{_SQL_DEMAND}, moves(input, p, r, f) AS (VALUES ('Inputs!A1', 1, 0, 0), ('Inputs!A2', 0, 1, 0), ('Inputs!A5', 0, 0, 1)),
    runs AS (SELECT iteration, input, s, 10 * (1 + 0.1 * s * p) AS price, 0.2 * (1 + 0.1 * s * r) AS rate, d * (1 + 0.1 * s * f) AS d FROM moves, (VALUES (-1), (0), (1)) t(s), demand)"""
_SQL_STEPS = f"""{_SQL_MOVES}, means AS (SELECT input, s, unnest(['Results_A1', 'Results_A2']) AS cell, unnest([avg(price * d * (1 - rate)), avg(price * d * (1 - rate) - 4 * d)]) AS v FROM runs GROUP BY input, s),
    effects AS (SELECT input, cell, max(v) FILTER (s = 0) AS base, max(v) FILTER (s = -1) AS down, max(v) FILTER (s = 1) AS up FROM means GROUP BY input, cell)"""


def _effects(spark, sf_dir) -> DataFrame:
    return scenarios.effects(scenarios.run_scenario(read(spark, sf_dir, "orders"), SHOP_OF_ORDERS, STEPS, iteration="o_orderkey"), scenarios.choices_table(spark, STEPS))


@query(f"WITH {_SQL_STEPS} SELECT input, cell, round((up - down) / 2, 6) AS delta, round((up - down) / 2 / abs(base), 6) AS percent, round((up - down) / 2 / 0.1 / base, 6) AS elasticity, abs((up - base) - (base - down)) > 0.1 * greatest(abs(up - base), abs(base - down)) AS lopsided, CAST(row_number() OVER (PARTITION BY cell ORDER BY round(abs((up - down) / 2 / 0.1 / base), 9) DESC, input) AS INTEGER) AS rank FROM effects")
def sensitivity_matrix(spark, sf_dir):
    found = scenarios.measures(_effects(spark, sf_dir)).withColumn("elasticity", F.round("elasticity", 9))
    return rounded(scenarios.matrix_order(found).select("input", "cell", "delta", "percent", "elasticity", "lopsided", "rank"))


@query(f"""WITH {_SQL_STEPS}, m AS (SELECT input, cell, round((up - down) / 2 / abs(base), 9) AS percent FROM effects)
          SELECT input, cell, round(percent, 6) AS percent, CAST(row_number() OVER (PARTITION BY input ORDER BY abs(percent) NULLS LAST, cell) AS INTEGER) AS rank FROM m""")
def sensitivity_order(spark, sf_dir):
    """The outputs of each input, the least effect first."""
    found = scenarios.measures(_effects(spark, sf_dir)).withColumn("percent", F.round("percent", 9))
    return rounded(scenarios.matrix_order(found, "percent", by="input", descending=False).select("input", "cell", "percent", "rank"))


@query(f"WITH {_SQL_STEPS} SELECT input, cell, round(down - base, 6) AS low, round(up - base, 6) AS high FROM effects")
def sensitivity_tornado(spark, sf_dir):
    return rounded(scenarios.tornado(_effects(spark, sf_dir)).select("input", "cell", "low", "high"))


@query(f"WITH {_SQL_STEPS}, points AS (SELECT input, cell, unnest([-0.1, 0, 0.1]) AS x, unnest([(down - base) / abs(base), 0, (up - base) / abs(base)]) AS y FROM effects) SELECT input, cell, CAST(x AS DOUBLE) AS x, round(y, 6) AS y FROM points")
def sensitivity_spider(spark, sf_dir):
    return rounded(scenarios.spider(_effects(spark, sf_dir)))


_SQL_SPREAD = f"""{_SQL_MOVES}, values_ AS (SELECT input || s AS cell, iteration, price * d * (1 - rate) - 4 * d AS value FROM runs), {sql_bins('values_')}, {_SQL_QUANTILES},
    each AS (SELECT input, s, round(max(value) FILTER (share = 0.1), 4) AS p10, round(max(value) FILTER (share = 0.9), 4) AS p90 FROM quantiles JOIN (SELECT DISTINCT input, s, input || s AS cell FROM runs) USING (cell) GROUP BY input, s)"""


@query(f"""WITH {_SQL_SPREAD} SELECT input, statistic, max(v) FILTER (s = 0) AS base, max(v) FILTER (s = -1) AS down, max(v) FILTER (s = 1) AS up, true AS near
          FROM (SELECT input, s, unnest(['p10', 'p90']) AS statistic, unnest([p10, p90]) AS v FROM each) GROUP BY input, statistic""")
def sensitivity_spread(spark, sf_dir):
    """P10 and P90 as statistics of effects, from bins; sketches that merge over the combinations hold them to two hundredths of rank."""
    plan, orders = scenarios.Sensitivity("Spread", ("Results!A2",), STEPS.inputs, STEPS.steps), read(spark, sf_dir, "orders")
    binned = scenarios.bin_scenario(orders, SHOP_OF_ORDERS, plan, iteration="o_orderkey")
    results = binned.results({"p10": 0.1, "p90": 0.9})
    sketches = summary.sketch(summary.long_samples(binned.prepared.samples, binned.prepared.outputs, ["combination"]), scenarios.RESULT)
    bounds = summary.sketch_quantiles(sketches, scenarios.RESULT, {"a": 0.08, "b": 0.12, "c": 0.88, "d": 0.92})
    near = results.join(bounds, scenarios.RESULT).agg(F.every(F.col("p10").between(F.col("a"), F.col("b")) & F.col("p90").between(F.col("c"), F.col("d"))).alias("near"))
    results = kept(results.select("combination", "cell", "kind", *(F.round(c, 4).alias(c) for c in ("p10", "p90"))))
    each = [scenarios.effects(results, scenarios.choices_table(spark, plan), c).select("input", F.lit(c).alias("statistic"), "base", "down", "up") for c in ("p10", "p90")]
    return each[0].unionByName(each[1]).withColumn("near", F.lit(near.first().near))


# Workbooks

_SQL_CELLS = """cells AS (SELECT p_partkey AS k, chr(CAST(65 + p_partkey % 3 AS INTEGER)) || p_partkey AS address, CASE WHEN p_partkey % 50 = 10 THEN '=' || n1 || '*2' WHEN p_partkey % 50 = 11 THEN '=' || b1 || '+1' WHEN p_partkey % 50 = 20 THEN '=' || own || '/2'
        WHEN p_partkey % 7 = 0 THEN '=UNIFORM(0,1)' WHEN p_partkey < 4 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 13 = 0 THEN p_brand ELSE '=' || half || '+SUM(' || third || ')' END AS input
    FROM (SELECT *, chr(CAST(65 + p_partkey % 3 AS INTEGER)) || p_partkey AS own, chr(CAST(65 + (p_partkey + 1) % 3 AS INTEGER)) || (p_partkey + 1) AS n1, chr(CAST(65 + (p_partkey - 1) % 3 AS INTEGER)) || (p_partkey - 1) AS b1,
                 chr(CAST(65 + (p_partkey // 2) % 3 AS INTEGER)) || (p_partkey // 2) AS half, chr(CAST(65 + (p_partkey // 3) % 3 AS INTEGER)) || (p_partkey // 3) AS third FROM part))"""


def _part_cells(spark, sf_dir) -> DataFrame:
    """A sheet with a cell for every part: numbers, texts, draws, circles, and formulas over other cells."""
    k = F.col("p_partkey")
    at = lambda x: F.concat(F.char(65 + x % 3), x.cast("string"))
    text = (
        F.when(k % 50 == 10, F.concat(F.lit("="), at(k + 1), F.lit("*2"))).when(k % 50 == 11, F.concat(F.lit("="), at(k - 1), F.lit("+1"))).when(k % 50 == 20, F.concat(F.lit("="), at(k), F.lit("/2")))
        .when(k % 7 == 0, "=UNIFORM(0,1)").when(k < 4, F.col("p_size").cast("string")).when(k % 13 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("="), at(F.floor(k / 2)), F.lit("+SUM("), at(F.floor(k / 3)), F.lit(")")))
    )
    return cells_from(read(spark, sf_dir, "part"), "Parts", at(k), text)


@query(f"""WITH {_SQL_CELLS} SELECT 'Parts' AS sheet, address, CAST(k AS INTEGER) AS row, CAST(1 + k % 3 AS INTEGER) AS "column", TRY_CAST(input AS DOUBLE) AS input_num, CASE WHEN TRY_CAST(input AS DOUBLE) IS NULL THEN input END AS input_text FROM cells""")
def workbook_cells(spark, sf_dir):
    return _part_cells(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SQL_CELLS}, n AS (SELECT k, 'Parts!' || address AS node, input FROM cells WHERE TRY_CAST(input AS DOUBLE) IS NOT NULL OR input LIKE '=%'),
          e AS (SELECT a.k, b.k AS needs FROM (SELECT k, CASE WHEN k % 50 = 10 THEN [k + 1] WHEN k % 50 = 11 THEN [k - 1] WHEN k % 50 = 20 THEN [k] WHEN input LIKE '=%SUM%' THEN [k // 2, k // 3] ELSE [] END AS l FROM n) a, n b WHERE list_contains(a.l, b.k)),
          reach(k, needs) AS (SELECT k, needs FROM e UNION SELECT r.k, e.needs FROM reach r JOIN e ON r.needs = e.k), circular AS (SELECT k FROM reach WHERE k = needs),
          groups AS (SELECT c.k, least(min(n.node), min(own.node)) AS cycle FROM circular c JOIN reach r ON r.k = c.k JOIN reach back ON back.k = r.needs AND back.needs = c.k JOIN n ON n.k = r.needs JOIN n own ON own.k = c.k GROUP BY c.k),
          blocked AS (SELECT DISTINCT k FROM reach WHERE needs IN (SELECT k FROM circular) AND k NOT IN (SELECT k FROM circular)),
          steps(k, level) AS (SELECT k, 0 FROM n WHERE k NOT IN (SELECT k FROM e) UNION SELECT e.k, s.level + 1 FROM steps s JOIN e ON e.needs = s.k WHERE e.k NOT IN (SELECT k FROM circular) AND e.k NOT IN (SELECT k FROM blocked)),
          drawn AS (SELECT k FROM n WHERE input LIKE '=UNIFORM%')
          SELECT node, (SELECT CAST(max(level) AS INTEGER) FROM steps s WHERE s.k = n.k) AS level, (SELECT cycle FROM groups g WHERE g.k = n.k) AS cycle, n.k IN (SELECT k FROM blocked) AS blocked,
                 n.k IN (SELECT k FROM drawn) OR n.k IN (SELECT k FROM reach WHERE needs IN (SELECT k FROM drawn)) AS uncertain FROM n""")
def workbook_dependencies(spark, sf_dir):
    """Order of computation, circles and what rests on draws, of a cell table with a cell for every part."""
    return dependencies.analyse(_part_cells(spark, sf_dir))


_SQL_OUTLOOK = f"""months AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1),
    quarters AS (SELECT period // 3 AS period, sum(value) AS value FROM months GROUP BY 1), spans AS (SELECT unnest(generate_series(min(period), max(period))) AS period FROM quarters),
    given AS (SELECT s.period, coalesce(q.value, 0) AS value FROM spans s LEFT JOIN quarters q ON s.period = q.period), drawn AS (SELECT period, value, unnest(range(2000)) AS draw FROM given), keyed AS (SELECT *, period * 2000 + draw AS iteration FROM drawn),
    {sql_uniform("u", "keyed", "iteration", stream_of("Formulas", "A1", 0), 0, "u")}, {sql_uniform("v", "u", "iteration", stream_of("Formulas", "A1", 0), 1, "v")},
    values_ AS (SELECT CAST(period // 4 AS VARCHAR) || '-Q' || CAST(period % 4 + 1 AS VARCHAR) AS cell, draw AS iteration, value * (1 + 0.03 + 0.02 * (sqrt(-2 * ln(u)) * cos(pi() * (2 * v - 1)))) AS value FROM v)"""


@query(f"""WITH {_SQL_OUTLOOK}, {sql_bins('values_')}, {_SQL_QUANTILES}, stats AS (SELECT cell, avg(value) AS mean, stddev_samp(value) AS sd FROM values_ GROUP BY cell)
          SELECT s.cell AS quarter, round(mean, 2) AS mean, round(sd, 2) AS sd, round(max(value) FILTER (share = 0.1), 2) AS p10, round(max(value) FILTER (share = 0.5), 2) AS p50, round(max(value) FILTER (share = 0.9), 2) AS p90
          FROM stats s JOIN quantiles q ON s.cell = q.cell GROUP BY s.cell, mean, sd""")
def revenue_outlook(spark, sf_dir):
    """Quarterly revenue of the orders with uncertain growth: mean, deviation and quantiles per quarter."""
    quarters = lookups.coarser_series(lookups.fill_series(complete_periods(series_from(read(spark, sf_dir, "orders"), "o_orderdate", F.sum("o_totalprice"), "month")), "flow"), "flow", "month", "quarter")
    rows = quarters.select("period", "value", F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("draw")).withColumn("iteration", F.col("period") * 2000 + F.col("draw"))
    made = apply_formulas(rows, {"growth": "=NORMAL(3%,2%)", "outlook": "=value*(1+growth)"})
    samples = made.select(calendar.format_period(F.col("period"), "quarter").alias("quarter"), F.col("draw").alias("iteration"), F.lit("outlook").alias("cell"), F.col("outlook").alias("value"))
    bins = summary.histogram(samples, ["quarter"])
    q = summary.quantiles(bins, ["quarter"], [0.1, 0.5, 0.9]).groupBy("quarter").pivot("share", [0.1, 0.5, 0.9]).agg(F.first("value")).toDF("quarter", "p10", "p50", "p90")
    stats = samples.groupBy("quarter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return rounded(stats.join(q, "quarter"), 2).orderBy("quarter")
