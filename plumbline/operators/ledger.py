"""General-ledger exports: column detection, drill-down and running totals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window as W, functions as F

from plumbline.functions.delimited import cells_of, usual_delimiter, without_bom
from plumbline.functions.money import parse_amount
from plumbline.functions.outcomes import mentions
from plumbline.functions.rent import parse_date, slashed_parts
from plumbline.operators.joins import lookup_join
from plumbline.session import settle, shuffles_freed

# Header names per column, letters, digits and # only (our own beyond the documented ones).
HEADER_NAMES = {
    "gl_date": ["gldate", "date", "postdate", "postingdate", "trandate", "transactiondate"],
    "account": ["acct#", "acct", "acctno", "account", "account#", "accountno", "accountnumber", "glaccount"],
    "account_name": ["acctdesc", "acctname", "accountname", "accountdescription", "description"],
    "entity": ["ent", "entity", "property", "propertycode", "prop"],
    "amount": ["amt", "amount", "netamount", "netamt"],
    "ref_no": ["refno", "ref", "ref#", "reference", "invoice", "invoiceno"],
}
# Every known header contains one of these.
HEADER_HINTS = ("date", "acc", "am", "ent", "prop", "ref", "invo", "desc")
# Names of amounts that are not the line's own; such a column never takes the place of the amount.
OTHER_AMOUNTS = ["balance", "runningbalance", "endingbalance", "beginningbalance", "debit", "credit", "budget", "ytd", "total", "tax", "quantity", "qty"]
# Share of filled cells that must read as the expected type.
TYPE_SHARE = 0.8
DATE_LIKE = r"^(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[/.-]\d{1,2}[/.-](\d{4}|\d{2}))$"
# An amount with cents, and one without; a column is taken for an amount by its cells only if they have cents.
AMOUNT_LIKE = r"^[(-]?[$€£]?-?(\d{1,3}([.,]\d{3})*|\d+)[.,]\d{2}[)-]?$"
WHOLE_AMOUNT = r"^[(-]?[$€£]?-?(\d{1,3}([.,]\d{3})*|\d+)[)-]?$"


def _canonical_headers(cells):
    names = F.transform(cells, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9#]", ""))

    def canonical(name):
        out = F.when(name.isin(OTHER_AMOUNTS), "other")
        for column, known in HEADER_NAMES.items():
            out = out.when(name.isin(known), column)
        return out

    return F.transform(names, canonical)


def header_guess(lines: DataFrame) -> DataFrame:
    """First pass: per file the first line with three or more known headers."""
    line = without_bom(F.col("line"))
    delimiter = usual_delimiter(line)
    header = _canonical_headers(cells_of(line, delimiter))
    known = F.size(F.array_distinct(F.filter(header, lambda h: h.isNotNull() & (h != "other"))))
    return (
        lines.where(mentions(F.lower("line"), HEADER_HINTS))
        .select("file_id", "line_no", delimiter.alias("delimiter"), header.alias("header"), known.alias("known"))
        .where("known >= 3").groupBy("file_id")
        .agg(F.min(F.struct("line_no", "delimiter", "header")).alias("head"))
        .select("file_id", F.col("head.line_no").alias("header_line"), "head.delimiter", "head.header")
    )


def split_body(lines: DataFrame, guess: DataFrame) -> DataFrame:
    """file_id, line_no and cells of every filled line below a header; stored, so that each line is split once."""
    rows = lookup_join(lines, guess.select("file_id", "header_line", "delimiter"), "file_id", "line_no")
    rows = rows.where((F.col("line_no") > F.col("header_line")) & (F.trim("line") != ""))
    return settle(rows.select("file_id", "line_no", cells_of(F.col("line"), F.col("delimiter")).alias("cells")))


def _named(body: DataFrame, headers: DataFrame, *more: str) -> DataFrame:
    return lookup_join(body, headers.select("file_id", "header", *more), "file_id", "line_no").where("header is not null")


def _share(filled, fitting):
    return F.when(filled > 0, fitting / filled).otherwise(0.0)


def _cell(column: str):
    position = F.nullif(F.array_position("header", column), F.lit(0)).cast("int")
    return F.try_element_at("cells", position)


def doubtful_files(rows: DataFrame) -> DataFrame:
    """Files whose date or amount column, as named by the header, does not read as one.

    An amount column without any cents is looked at too: it stays unless an unnamed column has them.
    """
    date_cell, amount = (F.coalesce(_cell(column), F.lit("")) for column in ("gl_date", "amount"))
    told = rows.groupBy("file_id").agg(
        _share(F.count_if(date_cell != ""), F.count_if(date_cell.rlike(DATE_LIKE))).alias("gl_date"),
        _share(F.count_if(amount != ""), F.count_if(amount.rlike(AMOUNT_LIKE) | amount.rlike(WHOLE_AMOUNT))).alias("amount"),
        F.count_if(amount.rlike(AMOUNT_LIKE)).alias("cents"),
    )
    return told.where(f"gl_date < {TYPE_SHARE} or amount < {TYPE_SHARE} or cents = 0").select("file_id")


def column_profile(rows: DataFrame) -> DataFrame:
    """Share of filled cells per file and position that read as a date or as an amount."""
    cell = F.col("cell")
    return (
        rows.select("file_id", F.posexplode("cells").alias("position", "cell")).where(cell != "")
        .groupBy("file_id", "position").agg(
            F.count("*").alias("filled"),
            F.count_if(cell.rlike(DATE_LIKE)).alias("dates"),
            F.count_if(cell.rlike(AMOUNT_LIKE)).alias("amounts"),
            F.count_if(cell.rlike(AMOUNT_LIKE) | cell.rlike(WHOLE_AMOUNT)).alias("numbers"),
        )
        .select(
            "file_id", "position", _share(F.col("filled"), F.col("dates")).alias("date_share"),
            _share(F.col("filled"), F.col("amounts")).alias("amount_share"),
            _share(F.col("filled"), F.col("numbers")).alias("number_share"),
        )
    )


def verified_columns(headers: DataFrame, profile: DataFrame) -> DataFrame:
    """Second pass: a date or amount column that does not read as one gives way to one that does.

    Only columns whose header means nothing else are candidates. A named amount with at least some cents, or whole
    numbers where no candidate has cents, stays.
    """
    named = headers.select("file_id", F.posexplode("header").alias("position", "canonical"))
    seen = profile.join(named, ["file_id", "position"], "left")
    own = lambda column: F.coalesce(F.col("canonical") == column, F.lit(False))

    def best(column, share):
        fits = (F.col(share) >= TYPE_SHARE) & (F.col("canonical").isNull() | own(column))
        if column == "amount":
            fits = fits | (own(column) & (F.col("number_share") >= TYPE_SHARE) & (F.col(share) > 0))
        order = F.struct(~own(column), -F.col(share), F.col("position"))
        return F.min(F.when(fits, F.struct(order.alias("order"), F.col("position").alias("position")))).alias(column)

    picks = seen.groupBy("file_id").agg(best("gl_date", "date_share"), best("amount", "amount_share"))
    mapped = headers.join(picks, "file_id", "left")
    date_at, amount_at = F.col("gl_date.position"), F.col("amount.position")
    header = F.transform("header", lambda h, i: (
        F.when(F.coalesce(i == date_at, F.lit(False)), "gl_date")
        .when(F.coalesce(i == amount_at, F.lit(False)), "amount")
        .when(h.isin("gl_date") & date_at.isNotNull(), F.lit(None))
        .when(h.isin("amount") & amount_at.isNotNull(), F.lit(None))
        .otherwise(h)
    ))
    moved = lambda column, at: (at != F.array_position(mapped["header"], column) - 1)
    return mapped.select(
        "file_id", "header_line", "delimiter", header.alias("header"),
        F.coalesce(moved("gl_date", date_at), F.lit(False)).alias("date_replaced"),
        F.coalesce(moved("amount", amount_at), F.lit(False)).alias("amount_replaced"))


def date_orders(rows: DataFrame) -> DataFrame:
    """Per file: day first if a first number exceeds 12 and no second one does; ambiguous if neither does."""
    first, second = slashed_parts(F.coalesce(_cell("gl_date"), F.lit("")))
    told = rows.groupBy("file_id").agg(F.max(first).alias("first"), F.max(second).alias("second"))
    return told.select(
        "file_id", F.coalesce((F.col("first") > 12) & (F.col("second") <= 12), F.lit(False)).alias("day_first"),
        F.coalesce((F.col("first") <= 12) & (F.col("second") <= 12), F.lit(False)).alias("ambiguous"))


def ledger_headers(guess: DataFrame, body: DataFrame) -> DataFrame:
    """Stored header of every file that has one, with the columns verified and what was replaced.

    Only files whose named columns fail the check are profiled column by column.
    """
    doubtful = settle(guess.join(doubtful_files(_named(body, guess)), "file_id", "left_semi"))
    corrected = settle(verified_columns(doubtful, column_profile(_named(body, doubtful))))
    kept = guess.join(corrected, "file_id", "left_anti").withColumns(
        {"date_replaced": F.lit(False), "amount_replaced": F.lit(False)})
    headers = kept.unionByName(corrected)
    orders = date_orders(_named(body, headers))
    return settle(headers.join(orders, "file_id", "left"))


def normalise_ledger(lines: DataFrame) -> DataFrame:
    """Export lines of any known layout to ledger rows; dates are read in the order each file shows."""
    with shuffles_freed(lines.sparkSession):
        guess = settle(header_guess(lines))
        body = split_body(lines, guess)
        return ledger_rows(body, ledger_headers(guess, body))


def ledger_rows(body: DataFrame, headers: DataFrame) -> DataFrame:
    # Cells are columns first, so that what reads one several times does not look it up each time.
    rows = _named(body, headers, "day_first").select(
        "file_id", "line_no", F.coalesce("day_first", F.lit(False)).alias("day_first"), *[_cell(c).alias(c) for c in HEADER_NAMES])
    return rows.select(
        "file_id", "line_no", parse_date(F.col("gl_date"), F.col("day_first")).alias("gl_date"),
        "account", "account_name", "entity", parse_amount(F.col("amount")).alias("amount"), "ref_no",
    )


def ledger_findings(lines: DataFrame) -> DataFrame:
    """What was odd about each file, long form: no_header, replaced columns, ambiguous and unread dates, unread amounts."""
    guess = settle(header_guess(lines))
    body = split_body(lines, guess)
    headers = ledger_headers(guess, body)
    per_line = ledger_rows(body, headers).groupBy("file_id").agg(
        F.count_if(F.col("gl_date").isNull()).alias("unread_dates"), F.count_if(F.col("amount").isNull()).alias("unread_amounts"))
    files = lines.select("file_id").distinct().join(headers, "file_id", "left").join(per_line, "file_id", "left")
    once = lambda flag: F.coalesce(flag.cast("long"), F.lit(0))
    found = {
        "no_header": F.col("header_line").isNull().cast("long"), "date_replaced": once(F.col("date_replaced")),
        "amount_replaced": once(F.col("amount_replaced")), "ambiguous_dates": once(F.col("ambiguous")),
        "unread_dates": F.coalesce("unread_dates", F.lit(0)), "unread_amounts": F.coalesce("unread_amounts", F.lit(0)),
    }
    long = F.array(*[F.struct(F.lit(code).alias("code"), n.alias("n")) for code, n in found.items()])
    return files.select("file_id", F.inline(long)).where("n > 0")


def drill(
    ledger: DataFrame, account: str | None = None, entity: str | None = None,
    first: date | None = None, last: date | None = None, ref_no: str | None = None,
) -> DataFrame:
    """Ledger rows by any of account, entity, date range and transaction."""
    for column, value in (("account", account), ("entity", entity), ("ref_no", ref_no)):
        if value is not None:
            ledger = ledger.where(F.col(column) == value)
    if first is not None:
        ledger = ledger.where(F.col("gl_date") >= F.lit(first))
    if last is not None:
        ledger = ledger.where(F.col("gl_date") <= F.lit(last))
    return ledger


def _finest(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("entity", "account").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


def _levels(grouped) -> DataFrame:
    totals = grouped.agg(
        F.grouping_id().alias("gid"), F.sum("amount").cast("decimal(28,2)").alias("amount"), F.sum("n").alias("n")
    )
    level = (
        F.when(F.col("gid") == 0, "account").when(F.col("gid") == 1, "entity")
        .when(F.col("gid") == 2, "account_all_entities").otherwise("total")
    )
    return totals.select("entity", "account", level.alias("level"), "amount", "n")


def gl_rollup(ledger: DataFrame) -> DataFrame:
    """Total, per entity, and per entity and account; rolled up from the finest sums."""
    return _levels(_finest(ledger).rollup("entity", "account"))


def gl_cube(ledger: DataFrame) -> DataFrame:
    """As the roll-up, plus accounts over all entities."""
    return _levels(_finest(ledger).cube("entity", "account"))


def monthly(ledger: DataFrame) -> DataFrame:
    period = F.date_format("gl_date", "yyyy-MM").alias("period")
    return ledger.groupBy("entity", "account", period).agg(F.sum("amount").cast("decimal(28,2)").alias("amount"))


def ytd(ledger: DataFrame) -> DataFrame:
    """Monthly amounts with the running total of the calendar year."""
    year = F.substring("period", 1, 4)
    order = W.partitionBy("entity", "account", year).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    return monthly(ledger).withColumn("ytd", F.sum("amount").over(order).cast("decimal(28,2)"))


def profile_extract(ledger: DataFrame) -> DataFrame:
    """Rows, accounts, entities, dates and totals of a normalised extract, per file."""
    per_account = ledger.groupBy("file_id", "account").agg(
        F.count("*").alias("rows"), F.min("gl_date").alias("first_date"), F.max("gl_date").alias("last_date"),
        F.count_if(F.col("amount").isNull() | F.col("gl_date").isNull()).alias("unread"), F.sum("amount").alias("amount"),
    )
    return per_account.groupBy("file_id").agg(
        F.sum("rows").alias("rows"), F.count("account").alias("accounts"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
        F.sum("amount").cast("decimal(28,2)").alias("amount"),
        (1 - F.sum("unread") / F.sum("rows")).alias("confidence"),
    )
