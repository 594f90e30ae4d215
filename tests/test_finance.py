"""Worked examples of variances, statements and ledgers."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions.money import STRICT, Materiality, dollars, parse_amount
from plumbline.operators import ledger as gl, statement, utilities, variance

LINES = "entity string, account string, period string, amount decimal(18,2)"
LEDGER = "entity string, account string, period string, gl_date date, ref_no string, amount decimal(18,2)"


def amounts(spark, rows):
    return spark.createDataFrame([("P4", a, "2026-03", Decimal(v)) for a, v in rows], LINES)


@pytest.fixture(scope="module")
def lines(spark):
    budget = amounts(spark, [("HVAC", 4200), ("Janitorial", 8500), ("Dropped", 100)])
    actual = amounts(spark, [("HVAC", 11000), ("HVAC", 850), ("Janitorial", 6100), ("New", 40)])
    return variance.variance_lines(budget, actual, Materiality("or", 5000, 0.25)).cache()


def test_worked_example(lines):
    got = {r["account"]: (float(r["variance"]), r["variance_pct"], r["material"]) for r in lines.collect()}
    assert got["HVAC"][0] == 7650 and round(got["HVAC"][1] * 100) == 182
    assert got["Janitorial"][0] == -2400 and round(got["Janitorial"][1] * 100) == -28
    assert got["Dropped"] == (-100.0, -1.0, True)
    assert got["New"][:2] == (40.0, None)


@pytest.mark.parametrize("rule, flagged", [
    (Materiality("or", 5000, 0.10), {"big_small_pct", "small_big_pct", "both"}),
    (Materiality("and", 5000, 0.10), {"both"}),
    (Materiality("or", 5000, 0.10, 100), {"big_small_pct", "both"}),
    (STRICT, set()),
])
def test_materiality_modes(spark, rule, flagged):
    budget = amounts(spark, [("big_small_pct", 100_000), ("small_big_pct", 10), ("both", 10_000), ("neither", 1000)])
    actual = amounts(spark, [("big_small_pct", 106_000), ("small_big_pct", 20), ("both", 16_000), ("neither", 1010)])
    rows = variance.variance_lines(budget, actual, rule).where("material").collect()
    assert {r["account"] for r in rows} == flagged


def test_narratives_are_traceable_and_stable(spark, lines):
    entries = [("P4", "HVAC", "2026-03", date(2026, 3, 14), "INV-88213", Decimal("7650.00")),
               ("P4", "HVAC", "2026-03", date(2026, 3, 2), "INV-1", Decimal("4200.50")),
               ("P4", "HVAC", "2026-03", date(2026, 3, 3), "INV-2", Decimal("-0.50")),
               ("P4", "HVAC", "2026-02", date(2026, 2, 3), "INV-0", Decimal("99999"))]
    drivers = variance.variance_drivers(lines, spark.createDataFrame(entries, LEDGER), 2)
    texts = {r["account"]: r["text"] for r in variance.narratives(lines, drivers).collect()}
    assert texts["HVAC"] == ("HVAC came in $7,650 over budget (182%); largest entries: "
                             "INV-88213 ($7,650 on 2026-03-14), INV-1 ($4,200.50 on 2026-03-02).")
    assert texts["Janitorial"] == "Janitorial came in $2,400 under budget (28%)."
    assert texts["New"] == "New came in $40 over budget."


def test_markdown_file(spark, lines, tmp_path):
    empty = variance.variance_drivers(lines, spark.createDataFrame([], LEDGER))
    variance.write_markdown(variance.narratives(lines, empty), str(tmp_path / "md"))
    text = "".join(p.read_text() for p in (tmp_path / "md").glob("*.txt"))
    assert "- **P4 · 2026-03** Janitorial came in $2,400 under budget (28%).\n" in text


def test_favourable_sign(lines):
    rows = variance.with_favour(lines, F.lit(False)).collect()
    assert {r["account"]: r["favourable"] for r in rows} == {"HVAC": False, "Janitorial": True, "Dropped": True, "New": False}


@pytest.mark.parametrize("text, value", [
    ("7,650.00", "7650.00"), ("-2,400.00", "-2400.00"), ("(1,234.50)", "-1234.50"), ("$5", "5.00"), ("7.650,25", "7650.25"),
    ("-12,50", "-12.50"), ("12.50-", "-12.50"), ("abc", None), ("", None),
])
def test_amounts(spark, text, value):
    row = spark.range(1).select(parse_amount(F.lit(text)).alias("v")).first()
    assert row["v"] == (None if value is None else Decimal(value))


def test_readable_sums(spark):
    row = spark.range(1).select(dollars(F.lit("-1234567.50").cast("decimal(18,2)")).alias("v")).first()
    assert row["v"] == "$1,234,567.50"


def test_statement(spark):
    prior = spark.createDataFrame([("P", 1, "revenue", "Rent"), ("P", 2, "expense", "Utilities"), ("P", 3, "expense", "Old")],
                                  "entity string, line_no int, section string, account string")
    current = spark.createDataFrame(
        [("P", "revenue", "Rent", Decimal(412300), Decimal(405000)), ("P", "expense", "Utilities", Decimal(148900), Decimal(151200)),
         ("P", "revenue", "Parking", Decimal(1), Decimal(1))],
        "entity string, section string, account string, actual decimal(28,2), budget decimal(28,2)")
    compiled = statement.compile_statement(prior, current)
    assert [r["missing"] for r in compiled.orderBy("line_no").collect()] == [False, False, True]
    assert [r["account"] for r in statement.new_lines(prior, current).collect()] == ["Parking"]
    totals = {r["line"]: (int(r["actual"]), int(r["budget"]), int(r["variance"])) for r in statement.statement_totals(compiled).collect()}
    assert totals == {"Total Revenue": (412300, 405000, 7300), "Total Operating Expenses": (148900, 151200, -2300),
                      "Net Operating Income": (263400, 253800, 9600)}
    assert statement.sections_present(compiled).first()["complete"] is True
    assert statement.sections_present(compiled.where("section = 'revenue'")).first()["complete"] is False


def test_ytd_restarts_each_year(spark):
    rows = [("P", "A", "", date(2025, 12, 1), "r", Decimal(5)), ("P", "A", "", date(2026, 1, 1), "r", Decimal(7)), ("P", "A", "", date(2026, 3, 1), "r", Decimal(2))]
    got = gl.ytd(spark.createDataFrame(rows, LEDGER)).orderBy("period").collect()
    assert [int(r["ytd"]) for r in got] == [5, 7, 9]


def test_drill_filters(spark):
    rows = [("P", "A", "", date(2026, 1, d), f"r{d}", Decimal(d)) for d in range(1, 11)]
    df = spark.createDataFrame(rows, LEDGER)
    assert gl.drill(df, account="A", entity="P", first=date(2026, 1, 3), last=date(2026, 1, 5)).count() == 3
    assert gl.drill(df, ref_no="r7").first()["amount"] == 7 and gl.drill(df, account="B").count() == 0


def test_utility_cost(spark):
    tenants = spark.createDataFrame([("B", "office", Decimal(1000)), ("B", "retail", Decimal(500)), ("B", "odd", Decimal(10))],
                                    "building string, tenant_type string, rsf decimal(18,2)")
    rates = spark.createDataFrame([("office", Decimal("2.40")), ("retail", Decimal("3.60"))], "tenant_type string, rate decimal(9,4)")
    row = utilities.utility_cost(tenants, rates).first()
    assert (row["annual_cost"], row["monthly_cost"], row["unpriced_rsf"]) == (4200.0, 350.0, 10.0)


def ledger_files(spark, files):
    rows = [(name, i, line) for name, text in files.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file_id string, line_no long, line string")


def test_whole_amounts_balances_day_first_dates_and_unread_files(spark):
    lines = ledger_files(spark, {
        "balance": "Date,Account,Ent,Amount,Balance\n01/31/2024,4000,A,1500,9000.25\n02/28/2024,4000,A,2500,11500.25",
        "quantity": "Date,Account,Ent,Amount,Net\n01/31/2024,4000,A,3,10.50\n02/28/2024,4000,A,4,20.75",
        "day_first": "Date,Account,Ent,Amount\n05/06/2024,4000,A,1.00\n25/12/2024,4000,A,2.00",
        "either": "Date,Account,Ent,Amount\n05/06/2024,4000,A,1.00",
        "unread": "Fecha;Cuenta;Importe\n1/1/2024;4000;1,00",
        "gaps": "Date,Account,Ent,Amount\nsoon,4000,A,1.00\n2024-01-02,4000,A,n/a\n2024-01-03,4000,A,2.00\n2024-01-04,4000,A,2.00\n2024-01-05,4000,A,2.00\n2024-01-06,4000,A,2.00",
    })
    rows = gl.normalise_ledger(lines).orderBy("file_id", "line_no").collect()
    got = {name: [(str(r["gl_date"]), None if r["amount"] is None else float(r["amount"])) for r in rows if r["file_id"] == name]
           for name in ("balance", "quantity", "day_first", "either", "unread")}
    assert got == {
        "balance": [("2024-01-31", 1500.0), ("2024-02-28", 2500.0)], "quantity": [("2024-01-31", 10.5), ("2024-02-28", 20.75)],
        "day_first": [("2024-06-05", 1.0), ("2024-12-25", 2.0)], "either": [("2024-05-06", 1.0)], "unread": []}
    found = {(r["file_id"], r["code"]): r["n"] for r in gl.ledger_findings(lines).collect()}
    assert found == {
        ("quantity", "amount_replaced"): 1, ("either", "ambiguous_dates"): 1, ("unread", "no_header"): 1,
        ("gaps", "unread_dates"): 1, ("gaps", "unread_amounts"): 1}
