"""Queries over rent rolls."""

from __future__ import annotations


from plumbline.operators import rent_roll, stacking
from plumbline.plans.registry import SQL_DAY, register
from plumbline.sources import given_rolls as rolls
from plumbline.sources.given_files import broken_rolls
from plumbline.sources.given_tables import AS_OF

# What the rolls say, straight from the facts behind them.
TRUTH = f"""WITH facts AS (SELECT * FROM ({rolls.facts_sql()}) WHERE file_id <> '{rolls.NO_HEADER}'),
ending AS (SELECT *, CASE WHEN ends <> 'date' THEN NULL WHEN file_id = '{rolls.AMBIGUOUS}' THEN make_date(2024, days + 1, 1)
  ELSE CAST(DATE '{rolls.FIRST_DAY}' + days AS DATE) END AS lease_end FROM facts),
suites AS (
  SELECT file_id, n + 10 AS line_no, CASE WHEN layout = 0 AND file_id <> '{rolls.ROW_CODES}' THEN tower ELSE '' END AS building, suite,
    CASE WHEN file_id = '{rolls.NO_TENANT}' THEN '' WHEN layout = 4 AND NOT vacant THEN tenant || ', The' ELSE tenant END AS tenant,
    CASE WHEN layout <> 4 THEN level WHEN suite LIKE '1200-%' THEN '12'
      WHEN suite NOT LIKE '% %' THEN CAST(CAST(floor(CAST(suite AS INT) / 100) AS INT) AS STRING) END AS floor,
    CASE WHEN area > 0 THEN CAST(area AS DOUBLE) END AS sf,
    lease_end,
    CASE WHEN vacant OR file_id = '{rolls.NO_TENANT}' THEN 'vacant' WHEN ends = 'mtm' THEN 'mtm'
      WHEN lease_end < CASE WHEN layout IN (1, 4) THEN DATE '2026-06-30' ELSE DATE '{AS_OF.date()}' END
      THEN 'mtm' ELSE 'occupied' END AS status, n, area, ends
  FROM ending)
"""


def _parsed(spark, folder):
    return rent_roll.parse_rent_roll(rolls.roll_lines(spark, folder), AS_OF.date())


def _suites(build):
    return lambda spark, folder: build(rent_roll.suites(_parsed(spark, folder)))


register(
    "rent_roll_headers",
    lambda s, f: rent_roll.map_columns(rent_roll.file_headers(rolls.roll_lines(s, f)))
    .select("file_id", "canonical", "position"),
    TRUTH + """, file AS (SELECT DISTINCT file_id, layout FROM facts),
cols AS (SELECT * FROM (VALUES (0, 'building', 0), (0, 'suite', 1), (0, 'tenant', 2), (0, 'floor', 3), (0, 'sf', 4), (0, 'end', 5),
  (1, 'suite', 0), (1, 'tenant', 1), (1, 'floor', 2), (1, 'sf', 3), (1, 'start', 4), (1, 'end', 5),
  (2, 'suite', 0), (2, 'tenant', 1), (2, 'floor', 2), (2, 'sf', 3), (2, 'end', 4),
  (3, 'suite', 0), (3, 'tenant', 1), (3, 'sf', 2), (3, 'floor', 4), (3, 'end', 5),
  (4, 'suite', 0), (4, 'tenant', 1), (4, 'sf', 2), (4, 'end', 3)) t(layout, canonical, position))
SELECT file_id, canonical, position FROM file JOIN cols USING (layout)
WHERE NOT (file_id = '""" + rolls.NO_TENANT + """' AND canonical = 'tenant')""",
)
register("rent_roll_normalised", _suites(lambda s: s), TRUTH + f"""
SELECT file_id, line_no, building, suite, tenant, floor, sf, strftime(lease_end, {SQL_DAY}) AS lease_end, status FROM suites""")
register(
    "rent_roll_quoted_breaks",
    lambda s, f: rent_roll.suites(rent_roll.parse_rent_roll(broken_rolls(s, f), AS_OF.date())).drop("line_no"), TRUTH + f"""
SELECT file_id, building, suite, floor, sf, strftime(lease_end, {SQL_DAY}) AS lease_end, status,
  CASE WHEN CAST(substr(file_id, 7) AS INT) % 5 IN (0, 2, 4) THEN replace(tenant, ' Co ', ' ' || chr(10) || 'Co ') ELSE tenant END AS tenant
FROM suites""")
register("rent_roll_summary", _suites(stacking.stack_summary), TRUTH + """
SELECT file_id, building, count(*) AS suites, coalesce(sum(sf), 0) AS total_sf,
  coalesce(sum(sf) FILTER (WHERE status <> 'vacant'), 0) AS occupied_sf,
  coalesce(sum(sf) FILTER (WHERE status <> 'vacant'), 0) / nullif(sum(sf), 0) AS occupancy FROM suites GROUP BY 1, 2""")
register("floor_order", _suites(stacking.floors), TRUTH + """
SELECT file_id, building, floor, count(*) AS suites, coalesce(sum(sf), 0) AS sf, CAST(CASE floor WHEN 'B1' THEN -101
  WHEN 'P2' THEN -1002 WHEN 'LL' THEN -1 WHEN 'G' THEN 0 ELSE coalesce(TRY_CAST(floor AS INT), -10000) END AS BIGINT) AS sort_key
FROM suites GROUP BY 1, 2, 3""")
register("floors_per_building", _suites(stacking.floors_per_building), TRUTH + """
SELECT file_id, building, count(DISTINCT coalesce(floor, '?')) AS floors FROM suites GROUP BY 1, 2""")
register("expiry_buckets", _suites(stacking.expiry_buckets), TRUTH + """
SELECT file_id, building, CASE WHEN status IN ('vacant', 'mtm') THEN status
  ELSE coalesce(CAST(year(lease_end) AS STRING), 'nodate') END AS bucket, count(*) AS suites, coalesce(sum(sf), 0) AS sf
FROM suites GROUP BY 1, 2, 3""")
register("roll_tenants", _suites(stacking.tenants), TRUTH + """
SELECT file_id, CASE WHEN status = 'vacant' THEN 'vacant' ELSE tenant END AS tenant, status = 'vacant' AS is_vacancy,
  count(*) AS suites, coalesce(sum(sf), 0) AS sf FROM suites GROUP BY 1, 2, 3""")
register("roll_unique_tenants", _suites(stacking.unique_tenants), TRUTH + """
SELECT file_id, count(DISTINCT tenant) FILTER (WHERE status <> 'vacant') AS tenants FROM suites GROUP BY 1""")
register("roll_summary_sheet", _suites(stacking.summary_sheet), TRUTH + """
, t AS (SELECT file_id, CAST(count(DISTINCT building) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS n, coalesce(sum(sf), 0) AS total,
  coalesce(sum(sf) FILTER (WHERE status <> 'vacant'), 0) AS occ FROM suites GROUP BY 1)
SELECT file_id, CAST(1 AS BIGINT) AS row_no, 'Buildings' AS label, b AS value FROM t UNION ALL SELECT file_id, 2, 'Suites', n FROM t
UNION ALL SELECT file_id, 3, 'Total SF', total FROM t UNION ALL SELECT file_id, 4, 'Occupied SF', occ FROM t
UNION ALL SELECT file_id, 5, 'Occupancy %', occ / nullif(total, 0) FROM t""")
register("roll_sheet_by_building", _suites(lambda s: stacking.roll_sheets(s)[1]), TRUTH + f"""
SELECT file_id, building, suite, tenant, floor, sf, strftime(lease_end, {SQL_DAY}) AS lease_end, status FROM suites
WHERE file_id IN (SELECT file_id FROM suites GROUP BY 1 HAVING count(DISTINCT building) > 1)""")
register("roll_sheet_single_building", _suites(lambda s: stacking.roll_sheets(s)[0]), TRUTH + f"""
SELECT file_id, suite, tenant, floor, sf, strftime(lease_end, {SQL_DAY}) AS lease_end, status FROM suites
WHERE file_id IN (SELECT file_id FROM suites GROUP BY 1 HAVING count(DISTINCT building) = 1)""")
register("roll_warnings", lambda s, f: rent_roll.roll_warnings(_parsed(s, f)), TRUTH + """
, w AS (SELECT file_id, 'summary_rows' AS code, count(*) FILTER (WHERE n % 29 = 0) AS n FROM facts GROUP BY 1
  UNION ALL SELECT file_id, 'non_suite_rows', count(*) FILTER (WHERE n % 37 = 0)
    -- an option line without an area repeats an id, but says too little to name a suite
    + count(*) FILTER (WHERE n % 31 = 0 AND suite LIKE '% %') FROM facts GROUP BY 1
  UNION ALL SELECT file_id, 'duplicate_rows', count(*) FILTER (WHERE n % 31 = 0 AND suite NOT LIKE '% %') FROM facts GROUP BY 1
  UNION ALL SELECT file_id, 'negative_sf', count(*) FILTER (WHERE area < 0) FROM facts GROUP BY 1
  UNION ALL SELECT file_id, 'zero_sf', count(*) FILTER (WHERE area = 0) FROM facts GROUP BY 1
  UNION ALL SELECT file_id, 'unreadable_dates', count(*) FILTER (WHERE ends = 'tbd') FROM facts GROUP BY 1
  UNION ALL SELECT file_id, 'unknown_floors', count(*) FILTER (WHERE floor IS NULL) FROM suites GROUP BY 1
  UNION ALL SELECT file_id, 'ambiguous_dates', CAST(max(CASE WHEN lease_end IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) FROM suites
    WHERE file_id = '""" + rolls.AMBIGUOUS + """' GROUP BY 1
  UNION ALL SELECT DISTINCT file_id, 'no_tenant_column', 1 FROM suites WHERE file_id = '""" + rolls.NO_TENANT + """'
  UNION ALL SELECT file_id, 'all_vacant', 1 FROM suites WHERE file_id <> '""" + rolls.NO_TENANT + """'
    GROUP BY 1 HAVING count(*) FILTER (WHERE status <> 'vacant') = 0
  UNION ALL SELECT file_id, 'building_unmapped', 1 FROM facts WHERE file_id = '""" + rolls.ROW_CODES + """' GROUP BY 1
    HAVING count(DISTINCT suite) > 1
  UNION ALL SELECT DISTINCT p_brand, 'no_header', 1 FROM part WHERE p_brand = '""" + rolls.NO_HEADER + """')
SELECT * FROM w WHERE n > 0""")
