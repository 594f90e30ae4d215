"""Queries over documents and retention."""

from __future__ import annotations

from datetime import datetime


from plumbline.operators import documents, retention
from plumbline.plans.event_queries import base_sql
from plumbline.plans.referral_queries import TABLES
from plumbline.plans.registry import SQL_TIME, register
from plumbline.sources import given_documents as d, given_tables as g

BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8232) || chr(8233) || chr(65279)"
DOCS = f"""WITH docs AS ({d.markdown_sql()}),
src AS (SELECT doc_id, replace(markdown, chr(13) || chr(10), chr(10)) AS s FROM docs),
cut AS (SELECT doc_id, s, regexp_extract(s, '\\n-{{3,}}\\n') AS rule FROM src),
parts AS (SELECT doc_id, s, CASE WHEN rule = '' THEN s ELSE substr(s, 1, instr(s, rule) - 1) END AS head,
  CASE WHEN rule = '' THEN s ELSE substr(s, instr(s, rule) + length(rule)) END AS rest FROM cut),
pre AS (SELECT doc_id, regexp_extract(head, '(?m)^#\\s+(.+)$', 1) AS title,
  trim(regexp_extract(head, '(?m)^\\*\\*(.+?)\\*\\*\\s*(\\(.*\\))\\s*$', 1) || ' ' || regexp_extract(head, '(?m)^\\*\\*(.+?)\\*\\*\\s*(\\(.*\\))\\s*$', 2)) AS entity,
  regexp_extract(head, '(?m)\\*\\*Effective Date:\\*\\*\\s*(.+?)\\s*$', 1) AS effective_date,
  regexp_extract(head, '(?m)\\*\\*Last Updated:\\*\\*\\s*(.+?)\\s*$', 1) AS last_updated, s, rest FROM parts),
doc AS (SELECT doc_id, title, entity, effective_date, last_updated,
  CASE WHEN title <> '' THEN ltrim(rest, {BLANKS}) ELSE s END AS body FROM pre),
lines AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM doc),
l AS (SELECT doc_id, pos, trim(raw, {BLANKS}) AS line FROM lines)
"""
ENTRIES = DOCS + """, t AS (SELECT doc_id, pos, line, CASE WHEN regexp_matches(line, '^(#{2,3})\\s+(.+?)\\s*$') THEN regexp_extract(line, '^(#{2,3})\\s+(.+?)\\s*$', 2)
    WHEN regexp_matches(line, '^\\*\\*(\\d+(?:\\.\\d+)+[^*]*?)\\*\\*$') THEN regexp_extract(line, '^\\*\\*(\\d+(?:\\.\\d+)+[^*]*?)\\*\\*$', 1) END AS label FROM l),
n AS (SELECT *, replace(regexp_extract(trim(label), '^(\\d+(?:\\.\\d+)*)[.)]?(?:[\\s\\x{00A0}]|$)', 1), '.', '-') AS id FROM t WHERE label IS NOT NULL)
"""
register("doc_preamble", lambda s, f: documents.doc_preamble(d.markdown(s, f)), DOCS + "SELECT doc_id, title, entity, effective_date, last_updated, body FROM doc")
register("section_index", lambda s, f: documents.section_index(d.markdown(s, f)), ENTRIES + """
SELECT doc_id, pos, id, label, CASE WHEN contains(id, '-') THEN 1 ELSE length(regexp_extract(line, '^#+')) - 2 END AS depth FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS k FROM n WHERE id <> '') WHERE k = 1""")
register("heading_anchors", lambda s, f: documents.heading_anchors(d.markdown(s, f)), DOCS + """
, h AS (SELECT doc_id, pos, regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*#*$', 2) AS label, length(regexp_extract(line, '^(#{1,6})\\s+(.+?)\\s*#*$', 1)) AS depth
  FROM l WHERE regexp_matches(line, '^(#{1,6})\\s+(.+?)\\s*#*$')),
i AS (SELECT *, coalesce(nullif(replace(regexp_extract(trim(label), '^(\\d+(?:\\.\\d+)*)[.)]?(?:[\\s\\x{00A0}]|$)', 1), '.', '-'), ''),
  nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-'), '')) AS id FROM h)
SELECT doc_id, pos, id, label, depth FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS k FROM i WHERE id IS NOT NULL) WHERE k = 1""")

LATER = datetime(2024, 2, 15)
register(
    "retention_accounts", lambda s, f: retention.kept_accounts(g.profiles(s, f), g.AS_OF).select("user_id", "deleted_at"),
    TABLES + f"""SELECT user_id, strftime(deleted_at, {SQL_TIME}) AS deleted_at FROM prof
WHERE deleted_at IS NULL OR deleted_at > TIMESTAMP '{g.AS_OF}' - INTERVAL 30 DAY""",
)


def _audit(spark, folder):
    return g.given(spark, folder, "orders").selectExpr("o_orderkey AS id", "CAST(o_custkey AS STRING) AS user_id")


AUDIT_AS_OF = datetime(2024, 12, 10)
register(
    "retention_audit", lambda s, f: retention.kept_audit_rows(_audit(s, f), g.profiles(s, f), AUDIT_AS_OF).select("id", "user_id"),
    TABLES + """SELECT o_orderkey AS id, user_id FROM orders JOIN prof ON user_id = CAST(o_custkey AS STRING)
WHERE deleted_at IS NULL OR CAST(deleted_at AS DATE) > DATE '2023-12-10'""",
)
register(
    "retention_feedback_due",
    lambda s, f: retention.feedback_due(g.events(s, f), LATER),
    base_sql(None) + f"""SELECT id, strftime(created_at, {SQL_TIME}) AS created_at, device FROM e
WHERE event = 'feedback' AND created_at <= TIMESTAMP '{LATER}' - INTERVAL 30 DAY""",
)
register(
    "retention_report",
    lambda s, f: retention.purge_report(g.profiles(s, f), retention.kept_accounts(g.profiles(s, f), g.AS_OF), "accounts"),
    TABLES + f"""SELECT 'accounts' AS what, count(*) AS rows, count(*) FILTER (WHERE k) AS kept, count(*) FILTER (WHERE NOT k) AS purged FROM (
  SELECT deleted_at IS NULL OR deleted_at > TIMESTAMP '{g.AS_OF}' - INTERVAL 30 DAY AS k FROM prof)""",
)
