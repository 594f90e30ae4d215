"""Cells of rent rolls: headers, suites, areas, dates, status and floors.

Only the cases named in the tests are known to be required; where a rule goes
further than those, it is our own and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.delimited import cells_of
from plumbline.functions.text import filled

# Header names per column, letters and digits only (our own beyond the tested ones).
HEADER_NAMES = {
    "suite": ["suite", "suiteno", "suitenumber", "unit", "unitno", "space", "ste"],
    "tenant": ["tenant", "tenantname", "lessee", "occupant"],
    "floor": ["floor", "fl", "level"],
    "sf": ["rsf", "sf", "sqft", "squarefeet", "rentablesf", "rentablesqft", "leasedsf", "area"],
    "start": ["leasestart", "start", "startdate", "commencement", "leasecommencement", "leasefrom"],
    "end": ["leaseexpiration", "leaseexp", "leaseend", "expiration", "expirationdate", "expires", "enddate", "leaseto"],
    "building": ["building", "buildingname", "bldg"],
    "rent": ["monthlybaserent", "monthlyrent", "baserent", "rent"],
}
# Names that probably mean the building (our own); such a column is judged by its cells.
PROBABLY_BUILDING = "^(bldg|building)(no|nr|number|code|id|key|ref)$"
# Every header line contains one of the first, every as-of line the last.
TITLE_HINTS = ("suite", "unit", "space", "ste", "as of")
AS_OF_DATE = r"(?i)\bas of:?\s+([A-Z][a-z]+ \d{1,2}, \d{4})"
SUMMARY_ROW = r"(?i)\b(sub-?\s?totals?|grand\s+totals?|totals?)\b"
# An id without blanks that has a digit, or one or two letters (the latter is our own).
SUITE_ID = r"(?i)^(?:(?:suite|ste\.?|unit|space)\s*)?#?(?=[a-z0-9])(?:[a-z0-9./&-]*\d[a-z0-9./&-]*|[a-z]{1,2})$"
# Print codes of spreadsheet headers and footers, and prose; neither names a suite (the latter is our own).
PAGE_CODE = r"^&"
PROSE = r"[.!?;]\s+\p{L}|[.!?;:]$|(?:\S+\s+){7}"
# A value that numbers rows: up to three letters and digits (our own).
ROW_CODE = r"^\p{L}{0,3}[-\s]?\d+$"
NO_DATE = r"^[-–—]*$"
MONTHLY = r"(?i)^(mtm|m-t-m|month[- ]?to[- ]?month)$"
ISO_DATE = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
SLASHED_DATE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})$"
SERIAL_DATE = r"^\d{5}$"
SERIAL_EPOCH = "1899-12-30"


def is_tabbed(line: Column) -> Column:
    return line.contains("\t")


def split_cells(line: Column, tabbed: Column) -> Column:
    """Trimmed cells of a line."""
    return cells_of(line, F.when(tabbed, "\t").otherwise(","), marks=(",", "\t"))


def with_guess(cells: Column, header: Column) -> Column:
    """`header`, with columns that probably mean the building taken for it where none is called so."""
    names = F.transform(cells, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9%]", ""))
    guessed = F.zip_with(header, names, lambda h, n: F.coalesce(h, F.when(n.rlike(PROBABLY_BUILDING), "building")))
    return F.when(F.array_contains(F.array_compact(header), "building"), header).otherwise(guessed)


def canonical_headers(cells: Column) -> Column:
    """Columns meant by header cells, null for any other text."""
    names = F.transform(cells, lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9%]", ""))

    def canonical(name):
        out = None
        for column, known in HEADER_NAMES.items():
            out = F.when(name.isin(known), column) if out is None else out.when(name.isin(known), column)
        return out

    return F.transform(names, canonical)


def cell_of(cells: Column, header: Column, column: str) -> Column:
    """Text of the named column, empty where the roll or the line lacks it."""
    position = F.nullif(F.array_position(header, column), F.lit(0)).cast("int")
    return F.coalesce(F.try_element_at(cells, position), F.lit(""))


def parse_number(text: Column, lowest: float | None = None) -> Column:
    """Number in a cell, thousands separators and units dropped; null below the bound."""
    value = F.regexp_replace(text, r"[,$\s]|(?i:sf|sq\.?\s?ft\.?)$", "").try_cast("double")
    return value if lowest is None else F.when(value >= lowest, value)


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, day).try_cast("date")


def slashed_parts(text: Column) -> tuple[Column, Column]:
    """First and second number of a slashed date, null for other text."""
    hit = text.rlike(SLASHED_DATE)
    return tuple(F.when(hit, F.regexp_extract(text, SLASHED_DATE, i).cast("int")) for i in (1, 2))


def parse_date(text: Column, day_first: Column) -> Column:
    """ISO, slashed in the given order, or spreadsheet serial; null for anything else."""
    part = lambda pattern, i: F.regexp_extract(text, pattern, i)
    year = part(SLASHED_DATE, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    first, second = part(SLASHED_DATE, 1), part(SLASHED_DATE, 2)
    return (
        F.when(text.rlike(ISO_DATE), _ymd(part(ISO_DATE, 1), part(ISO_DATE, 2), part(ISO_DATE, 3)))
        .when(text.rlike(SLASHED_DATE) & day_first, _ymd(year, second, first))
        .when(text.rlike(SLASHED_DATE), _ymd(year, first, second))
        .when(text.rlike(SERIAL_DATE), serial_date(text.try_cast("int")))
    )


def serial_date(serial: Column) -> Column:
    """Date of a spreadsheet day number."""
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), serial)


def has_date_text(text: Column) -> Column:
    return ~text.rlike(NO_DATE) & ~text.rlike(MONTHLY)


def title_as_of(line: Column) -> Column:
    """Date stated in a title line."""
    found = filled(F.regexp_extract(line, AS_OF_DATE, 1))
    return F.try_to_timestamp(found, F.lit("MMMM d, yyyy")).cast("date")


def is_vacant(tenant: Column, start: Column, end: Column) -> Column:
    """Blank tenant or a vacancy label, decorated or not; a lease date speaks against a decorated one."""
    bare = F.regexp_replace(tenant, r"^[\p{P}\p{S}\p{Z}\s]+|[\p{P}\p{S}\p{Z}\s]+$", "")
    undated = ~start.rlike(r"\d") & ~end.rlike(r"\d")
    label = bare.rlike(r"(?i)^vacant\b") | bare.rlike(r"(?i)^available(\s*[-–—(].*)?$")
    return (bare == "") | (F.lower(bare) == "vacant") | (label & undated)


def names_suite(suite: Column, tenant: Column, sf: Column, start: Column, end: Column) -> Column:
    """Does the line describe a suite?

    An id does. Any other name does if the line says enough beside it: two of a tenant's name, an area and a lease
    date, or one of them where the name has a digit. Lines that say nothing are banners and labels.
    """
    dated = start.rlike(r"\d") | end.rlike(r"\d") | end.rlike(MONTHLY)
    said = tenant.rlike(r"\p{L}").cast("int") + parse_number(sf).isNotNull().cast("int") + dated.cast("int")
    named = (suite != "") & ~suite.rlike(PAGE_CODE) & ~suite.rlike(PROSE)
    return suite.rlike(SUITE_ID) | (named & ((said >= 2) | ((said == 1) & suite.rlike(r"\d") & tenant.rlike(r"^\D*$"))))


def lease_status(vacant: Column, end_text: Column, lease_end: Column, as_of: Column) -> Column:
    return (
        F.when(vacant, "vacant")
        .when(end_text.rlike(MONTHLY) | (lease_end < as_of), "mtm")
        .otherwise("occupied")
    )


def floor_of(floor: Column, suite: Column) -> Column:
    """Floor cell, else derived from the suite: 110 is on 1, B101 on B1 (letters are our own); null if neither tells."""
    stated = F.regexp_replace(floor, r"(?i)^(floor|fl\.?|level)\s*|(st|nd|rd|th)?(\s+floor)?$|\.0+$", "")
    bare = F.regexp_replace(suite, r"(?i)^(suite|ste\.?|unit|space)\s*|#", "")
    derived = (
        F.when(bare.rlike(r"^\d{3,}"), F.regexp_extract(bare, r"^(\d+)\d{2}", 1))
        .when(bare.rlike(r"(?i)^[BP]\d{3}"), F.upper(F.regexp_extract(bare, r"(?i)^([BP]\d+)\d{2}", 1)))
        .when(bare.rlike(r"(?i)^(LL|G)\d*$"), F.upper(F.regexp_extract(bare, r"(?i)^(LL|G)", 1)))
    )
    return F.when(stated != "", stated).otherwise(derived)


def floor_order(floor: Column) -> Column:
    """Sort key, highest floor first: numbers, then ground, lower level, basement, parking."""
    name = F.upper(floor)
    depth = F.coalesce(F.regexp_extract(name, r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return (
        F.when(name.rlike(r"^\d+$"), name.try_cast("int"))
        .when(name.rlike("^G"), F.lit(0))
        .when(name.rlike("^LL"), -1 - depth)
        .when(name.rlike("^B"), -100 - depth)
        .when(name.rlike("^P"), -1000 - depth)
        .otherwise(F.lit(-10000))
    )
