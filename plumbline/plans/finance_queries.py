"""Queries over budgets, ledgers, statements and utility costs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from plumbline.functions.money import STRICT, Materiality
from plumbline.operators import ledger as gl, statement, utilities, variance
from plumbline.plans.registry import SQL_DAY, register
from plumbline.sources.given_files import broken_ledgers
from plumbline.sources import given_ledger as g

RULE = Materiality("or", 15_000.0, 0.05)

FACTS = f"WITH facts AS ({g.facts_sql()})\n"
VARIANCE = FACTS + """, t AS (SELECT entity, account, period, CAST(sum(budget_cents) AS BIGINT) AS b, CAST(sum(cents) AS BIGINT) AS a
  FROM facts GROUP BY 1, 2, 3),
m AS (SELECT entity, account, period, b / 100::DOUBLE AS budget, a / 100::DOUBLE AS actual, (a - b) / 100::DOUBLE AS variance,
  CASE WHEN b <> 0 THEN ((a - b) / 100::DOUBLE) / (abs(b) / 100::DOUBLE) END AS variance_pct, a, b FROM t),
l AS (SELECT *, {material} AS material FROM m)
"""
OR_SQL = VARIANCE.format(material="(abs(a - b) >= 1500000 OR coalesce(abs(variance_pct) >= 0.05, a <> b))")
AND_SQL = VARIANCE.format(
    material="(abs(a - b) >= 1500000 AND coalesce(abs(variance_pct) >= 0.15, a <> b) AND abs(a - b) >= 500000)")
COLUMNS = "SELECT entity, account, period, budget, actual, variance, variance_pct, material FROM l"


def _lines(spark, folder, rule=RULE):
    return variance.variance_lines(g.budget(spark, folder), g.ledger(spark, folder), rule)


def _report(spark, folder):
    return variance.variance_report(g.budget(spark, folder), g.ledger(spark, folder), RULE)


register("variance_lines", _lines, OR_SQL + COLUMNS)
register("variance_material_or", lambda s, f: _lines(s, f).where("material"), OR_SQL + COLUMNS + " WHERE material")
register("variance_material_and", lambda s, f: _lines(s, f, STRICT).where("material"), AND_SQL + COLUMNS + " WHERE material")
register(
    "variance_favourable",
    lambda s, f: variance.with_favour(_lines(s, f), F.col("account").isin("ECONOMY", "STANDARD", "MEDIUM"))
    .select("entity", "account", "period", "favourable"),
    OR_SQL + """SELECT entity, account, period, CASE WHEN a <> b THEN
  CASE WHEN account IN ('ECONOMY', 'STANDARD', 'MEDIUM') THEN a > b ELSE a < b END END AS favourable FROM l""",
)
register(
    "variance_largest", lambda s, f: variance.largest_variances(_lines(s, f), 50),
    OR_SQL + COLUMNS + " WHERE material ORDER BY abs(a - b) DESC, entity, account, period LIMIT 50",
)
register(
    "variance_year_to_date",
    lambda s, f: variance.with_year_to_date(_lines(s, f)).drop("budget", "actual", "variance_pct", "material"),
    OR_SQL + """, y AS (SELECT entity, account, period, variance, CAST(sum(b) OVER w AS BIGINT) AS yb, CAST(sum(a) OVER w AS BIGINT) AS ya FROM l
  WINDOW w AS (PARTITION BY entity, account, substr(period, 1, 4) ORDER BY period))
SELECT entity, account, period, variance, yb / 100::DOUBLE AS ytd_budget, ya / 100::DOUBLE AS ytd_actual, (ya - yb) / 100::DOUBLE AS ytd_variance FROM y""",
)
DRIVERS = OR_SQL + """, d AS (SELECT * FROM (SELECT f.entity, f.account, f.period, l.variance, f.gl_date, f.ref_no, f.cents,
    row_number() OVER (PARTITION BY f.entity, f.account, f.period ORDER BY abs(f.cents) DESC, f.gl_date, f.ref_no, f.cents) AS rank
  FROM facts f JOIN l USING (entity, account, period) WHERE l.material) WHERE rank <= 3)
"""
DRIVERS = DRIVERS.replace("SELECT f.entity, f.account, f.period, l.variance", "SELECT entity, account, period, l.variance").replace(
    "PARTITION BY f.entity, f.account, f.period", "PARTITION BY entity, account, period")
register("variance_gl_drivers", lambda s, f: _report(s, f)[1], DRIVERS + f"""
SELECT entity, account, period, variance, strftime(gl_date, {SQL_DAY}) AS gl_date, ref_no, cents / 100::DOUBLE AS amount, rank FROM d""")

NARRATIVE = DRIVERS + f""", x AS (SELECT entity, account, period, string_agg(ref_no || ' (' || CASE WHEN cents < 0 THEN '-' ELSE '' END || '$'
    || regexp_replace(format('{{:,.2f}}', abs(cents) / 100::DOUBLE), '\\.00$', '') || ' on ' || strftime(gl_date, {SQL_DAY}) || ')', ', ' ORDER BY rank) AS entries
  FROM d GROUP BY 1, 2, 3),
n AS (SELECT l.entity, l.account, l.period, l.account || ' came in $' || regexp_replace(format('{{:,.2f}}', abs(l.variance)), '\\.00$', '')
  || CASE WHEN l.variance > 0 THEN ' over budget' ELSE ' under budget' END
  || coalesce(' (' || format('{{:,}}', CAST(round_even(abs(l.variance_pct) * 100, 0) AS BIGINT)) || '%)', '')
  || coalesce('; largest entries: ' || x.entries, '') || '.' AS text
FROM l LEFT JOIN x ON x.entity = l.entity AND x.account = l.account AND x.period = l.period WHERE l.material)
"""
register(
    "variance_narrative", lambda s, f: _report(s, f)[2],
    NARRATIVE + "SELECT entity, account, period, text FROM n",
)
register(
    "variance_markdown", lambda s, f: variance.markdown_lines(_report(s, f)[2]),
    NARRATIVE + "SELECT '- **' || entity || ' · ' || period || '** ' || text AS value FROM n",
)

STATEMENT = FACTS + f""", p AS (SELECT DISTINCT entity, {g.SECTION} AS section, account, CAST(ascii(account) AS BIGINT) AS line_no FROM facts WHERE period = '1996-03'),
c AS (SELECT entity, {g.SECTION} AS section, account, CAST(sum(cents) AS BIGINT) AS a, CAST(sum(budget_cents) AS BIGINT) AS b
  FROM facts WHERE period = '1996-04' GROUP BY ALL),
st AS (SELECT p.*, c.a, c.b FROM p LEFT JOIN c ON c.entity = p.entity AND c.account = p.account)
"""


def _statement(spark, folder):
    prior, current = g.statements(spark, folder, "1996-03", "1996-04")
    return statement.compile_statement(prior, current)


register("statement_lines", _statement, STATEMENT + """SELECT entity, line_no, section, account, a / 100::DOUBLE AS actual,
  b / 100::DOUBLE AS budget, (a - b) / 100::DOUBLE AS variance, a IS NULL AND b IS NULL AS missing FROM st""")
register(
    "statement_new_lines",
    lambda s, f: statement.new_lines(*g.statements(s, f, "1996-03", "1996-04")),
    STATEMENT + """SELECT entity, section, account, a / 100::DOUBLE AS actual, b / 100::DOUBLE AS budget FROM c
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.entity = c.entity AND p.account = c.account)""",
)
register("statement_noi", lambda s, f: statement.statement_totals(_statement(s, f)), STATEMENT + """
, w AS (SELECT entity, CAST(coalesce(sum(a) FILTER (WHERE section = 'revenue'), 0) AS BIGINT) AS ra, CAST(coalesce(sum(a) FILTER (WHERE section = 'expense'), 0) AS BIGINT) AS ea,
  CAST(coalesce(sum(b) FILTER (WHERE section = 'revenue'), 0) AS BIGINT) AS rb, CAST(coalesce(sum(b) FILTER (WHERE section = 'expense'), 0) AS BIGINT) AS eb FROM st GROUP BY 1),
u AS (SELECT entity, 'Total Revenue' AS line, ra AS a, rb AS b FROM w UNION ALL SELECT entity, 'Total Operating Expenses', ea, eb FROM w
  UNION ALL SELECT entity, 'Net Operating Income', ra - ea, rb - eb FROM w)
SELECT entity, line, a / 100::DOUBLE AS actual, b / 100::DOUBLE AS budget, (a - b) / 100::DOUBLE AS variance FROM u""")
register("statement_sections_present", lambda s, f: statement.sections_present(_statement(s, f)), STATEMENT + """
SELECT entity, coalesce(bool_or(section = 'revenue' AND a IS NOT NULL) AND bool_or(section = 'expense' AND a IS NOT NULL), false) AS complete
FROM st GROUP BY 1""")

register(
    "gl_normalised", lambda s, f: gl.normalise_ledger(g.ledger_lines(s, f)).drop("line_no"),
    FACTS + f"""SELECT entity AS file_id, strftime(gl_date, {SQL_DAY}) AS gl_date, account, account || ' goods' AS account_name, entity,
  cents / 100::DOUBLE AS amount, ref_no FROM facts""",
)
register(
    "gl_quoted_breaks", lambda s, f: gl.normalise_ledger(broken_ledgers(s, f)).drop("line_no"),
    FACTS + f"""SELECT entity AS file_id, strftime(gl_date, {SQL_DAY}) AS gl_date, account,
  account || CASE WHEN layout < 2 THEN chr(10) ELSE ' ' END || 'goods' AS account_name, entity, cents / 100::DOUBLE AS amount, ref_no FROM facts""",
)
register(
    "gl_extract_profile", lambda s, f: gl.profile_extract(gl.normalise_ledger(g.ledger_lines(s, f))),
    FACTS + f"""SELECT entity AS file_id, count(*) AS rows, count(DISTINCT account) AS accounts, strftime(min(gl_date), {SQL_DAY}) AS first_date,
  strftime(max(gl_date), {SQL_DAY}) AS last_date, CAST(sum(cents) AS BIGINT) / 100::DOUBLE AS amount, 1.0::DOUBLE AS confidence FROM facts GROUP BY 1""",
)
register(
    "gl_drill",
    lambda s, f: gl.drill(g.ledger(s, f), account="PROMO", entity="NATION_3", first=date(1996, 1, 1), last=date(1997, 12, 31)),
    FACTS + f"""SELECT entity, account, period, strftime(gl_date, {SQL_DAY}) AS gl_date, ref_no, cents / 100::DOUBLE AS amount FROM facts
WHERE account = 'PROMO' AND entity = 'NATION_3' AND gl_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
)
LEVELS = FACTS + """SELECT entity, account, CASE grouping(entity) * 2 + grouping(account) WHEN 0 THEN 'account' WHEN 1 THEN 'entity'
  WHEN 2 THEN 'account_all_entities' ELSE 'total' END AS level, CAST(sum(cents) AS BIGINT) / 100::DOUBLE AS amount, count(*) AS n
FROM facts GROUP BY {how}(entity, account)"""
register("gl_rollup", lambda s, f: gl.gl_rollup(g.ledger(s, f)), LEVELS.format(how="ROLLUP"))
register("gl_cube", lambda s, f: gl.gl_cube(g.ledger(s, f)), LEVELS.format(how="CUBE"))
register("ytd_running", lambda s, f: gl.ytd(g.ledger(s, f)), FACTS + """
, t AS (SELECT entity, account, period, CAST(sum(cents) AS BIGINT) AS c FROM facts GROUP BY 1, 2, 3)
SELECT entity, account, period, c / 100::DOUBLE AS amount,
  CAST(sum(c) OVER (PARTITION BY entity, account, substr(period, 1, 4) ORDER BY period) AS BIGINT) / 100::DOUBLE AS ytd FROM t""")

register("utility_cost", lambda s, f: utilities.utility_cost(*g.utility_inputs(s, f)), """
WITH t AS (SELECT p_brand AS building, CAST(p_retailprice AS DECIMAL(18,2)) AS rsf,
  CASE WHEN p_type <> 'PROMO' THEN CAST(1 + length(p_type) * 0.25 AS DECIMAL(9,4)) END AS rate FROM part)
SELECT building, CAST(sum(rsf * rate) AS DOUBLE) AS annual_cost, CAST(sum(rsf * rate) AS DOUBLE) / 12 AS monthly_cost,
  CAST(sum(rsf) FILTER (WHERE rate IS NULL) AS DOUBLE) AS unpriced_rsf FROM t GROUP BY 1""")
