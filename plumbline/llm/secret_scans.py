"""Secret scans through an incremental ledger of content-addressed blobs.

A version of a file is a row (path, version, text). Its blob is the SHA-256 of the text, so equal
contents under any path and version are one blob. The ledger holds one row for each pair of blob and
rule version that has been scanned, with all findings. A run scans only pairs the ledger lacks, one text
per blob, adds them to the ledger, and joins the findings back to every path.

Defined cases: a null text is an empty blob and has no findings; rows that repeat a path and version are
reported as often as they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.spans import count_kind, guarded_spans, kind_spans, spelled
from plumbline.session import fresh_folder

# The base rules.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_VALUE = 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
# Own rule beside the base ones: the head line of a private key.
PEM = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
BASE_KINDS = ("assign", "access", "hex")
RULES_VERSION = "base-3-pem-1"

FINDINGS = "array<struct<start:int,number:int,end:int,kind:string,value:string>>"
LEDGER = f"blob string, rules string, findings {FINDINGS}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def find_secrets(text: Column) -> Column:
    """All findings of one text, by start and then by kind."""
    whole = F.coalesce(text, F.lit(""))
    lower = F.lower(whole)
    named = F.lit(False)
    for word in ASSIGN_WORDS:
        named = named | F.contains(lower, F.lit(word))
    assign = F.filter(guarded_spans(whole, named, ASSIGN, 2), lambda s: F.length(s["part"]) >= ASSIGN_VALUE)
    access = guarded_spans(whole, F.contains(whole, F.lit("AKIA")), ACCESS)
    # No shorter run can match and no match can start inside a longer run, so one pass finds the long ones.
    runs = guarded_spans(whole, whole.rlike(HEX), HEX)
    pem = guarded_spans(whole, F.contains(whole, F.lit("PRIVATE KEY")), PEM)
    found = [kind_spans(spans, kind, n) for n, (kind, spans) in enumerate(
        [("assign", assign), ("access", access), ("hex", runs), ("pem", pem)])]
    return F.array_sort(F.concat(*found)).cast(FINDINGS)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES_VERSION) -> DataFrame:
    """Ledger rows for the blobs that this rule version has not seen.

    `versions` has path, version, text. The shuffle for finding one text per blob carries only digests and
    row keys; the texts move once, to meet the chosen keys.
    """
    rows = versions.select("path", "version", "text").withColumn("blob", blob_of("text"))
    chosen = rows.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    if ledger is not None:
        seen = ledger.where(F.col("rules") == rules).select("blob").distinct()
        chosen = chosen.join(seen, "blob", "left_anti")
    chosen = chosen.select(
        F.col("at.path").alias("_path"), F.col("at.version").alias("_version"), F.col("blob").alias("_blob"))
    texts = versions.select("path", "version", "text").join(
        chosen, F.col("path").eqNullSafe(F.col("_path")) & F.col("version").eqNullSafe(F.col("_version")))
    # A repeated (path, version) with another text must not answer for this blob.
    texts = texts.where(blob_of("text") == F.col("_blob"))
    found = texts.select(F.col("_blob").alias("blob"), find_secrets(F.col("text")).alias("findings"))
    return found.dropDuplicates(["blob"]).select("blob", F.lit(rules).alias("rules"), "findings")


def update_ledger(spark: SparkSession, versions: DataFrame, path: str, rules: str = RULES_VERSION) -> DataFrame:
    """Scan what the ledger table at `path` lacks, append it, and return the whole ledger."""
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        ledger = None
    scan_unseen(versions, ledger, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: str = RULES_VERSION) -> DataFrame:
    """Every row of `versions` with its blob and the findings; `findings` is empty where nothing was found.

    Only blobs with findings are joined, and their rows are few; a blob that many paths share is one row of
    the right side, so a skewed blob is split by adaptive execution.
    """
    known = ledger.where((F.col("rules") == rules) & (F.size("findings") > 0)).select("blob", "findings")
    rows = versions.select("path", "version", blob_of("text").alias("blob"))
    return rows.join(known, "blob", "left").select(
        "path", "version", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def scan_versions(spark: SparkSession, versions: DataFrame, ledger_path: str, rules: str = RULES_VERSION) -> DataFrame:
    ledger = update_ledger(spark, versions, ledger_path, rules)
    return findings_by_path(versions, ledger, rules)


def op8_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document; each document is one path with one version."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    versions = documents.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    found = scan_versions(spark, versions, fresh_folder(spark, "blob-ledger"))
    base = F.filter("findings", lambda s: s["number"] < len(BASE_KINDS))
    counts = [count_kind(F.col("findings"), kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        F.col("path").alias("doc_id"), *counts,
        F.sha2(F.encode(spelled(base), "UTF-8"), 256).alias("base_sha256"),
        spelled(F.col("findings")).alias("spans"),
    )


def _sql_spans(kind: str, number: int, pattern: str, part: int = 0, least: int = 0) -> str:
    """DuckDB rows (doc_id, start, number, end, kind) of one pattern."""
    regex = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, s AS start, {number} AS number, e AS "end", '{kind}' AS kind FROM (
        SELECT doc_id, k, part, sum(length(gap) + length(value)) OVER w - length(value) AS s,
               sum(length(gap) + length(value)) OVER w AS e
        FROM (SELECT doc_id, unnest(range(len(value))) AS k, unnest(gap[:len(value)]) AS gap,
                     unnest(value) AS value, unnest(part) AS part
              FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '{regex}') AS gap,
                           regexp_extract_all(coalesce(text, ''), '{regex}', 0) AS value,
                           regexp_extract_all(coalesce(text, ''), '{regex}', {part}) AS part FROM documents))
        WINDOW w AS (PARTITION BY doc_id ORDER BY k))
      WHERE length(part) >= {least}"""


OP8_SQL = f"""
WITH found AS (
  {_sql_spans("assign", 0, ASSIGN, 2, ASSIGN_VALUE)}
  UNION ALL {_sql_spans("access", 1, "AKIA[A-Z0-9]+", 0, 16)}
  UNION ALL {_sql_spans("hex", 2, "[0-9a-f]+", 0, 32)}
  UNION ALL {_sql_spans("pem", 3, PEM)}),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, number)
      FILTER (number < 3), '') AS base,
    string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, number) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)"""
