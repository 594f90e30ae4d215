"""Cells of delimited text lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.text import trimmed

BOM = "\ufeff"


def without_bom(line: Column) -> Column:
    return F.replace(line, F.lit(BOM), F.lit(""))


# A quoted cell with what follows its closing quote, and what is inside it.
QUOTED, INSIDE = '"(?:[^"]++|"")*+"', '^"((?:[^"]++|"")*+)'


def leaves_open(line: Column, is_open: bool, marks: str = ",;") -> Column:
    """Is a quoted cell open at the end of a line, at whose beginning one is open or not?

    A quote opens a cell only at its beginning, after a mark; in the middle of a cell it is a character like others.
    """
    cell = f'(?:{QUOTED}[^{marks}]*+|[^"{marks}][^{marks}]*+|)'
    pattern = f'^(?:{cell}[{marks}])*+"(?:[^"]++|"")*+$'
    whole = F.concat(F.lit('"'), line) if is_open else line
    # Lines without quotes, nearly all of them, need no pattern matching.
    return F.when(line.contains('"'), whole.rlike(pattern)).otherwise(F.lit(is_open))


def _unquoted(cell: Column) -> Column:
    """What a cell that begins with a quote stands for; what follows a closing quote belongs to it as it is."""
    inner = cell.substr(F.lit(2), F.length(cell) - 2)
    # Nearly all end with their closing quote.
    usual = cell.endswith('"') & ~F.replace(inner, F.lit('""'), F.lit("")).contains('"')
    inside = F.replace(F.regexp_extract(cell, INSIDE, 1), F.lit('""'), F.lit('"'))
    other = F.concat(inside, F.regexp_extract(cell, f"(?s)^{QUOTED}(.*)$", 1))
    return F.when(usual, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(other)


def _split(line: Column, mark: str) -> Column:
    """Cells between marks; a mark or line break inside quotes does not separate, doubled quotes stand for one."""
    found = F.regexp_extract_all(
        F.concat(line, F.lit(mark)), F.lit(f"({QUOTED}[^{mark}]*+|[^{mark}]*+){mark}"), F.lit(1)
    )
    unquoted = F.transform(found, lambda c: F.when(c.startswith('"'), _unquoted(c)).otherwise(c))
    # Lines without quotes, nearly all of them, need no pattern matching.
    return F.when(line.contains('"'), unquoted).otherwise(F.split(line, mark))


def cells_of(line: Column, delimiter: Column, marks=(",", ";", "\t")) -> Column:
    """Trimmed cells of a line for a delimiter given per row."""
    out = None
    for mark in marks:
        cells = F.split(line, mark) if mark == "\t" else _split(line, mark)
        hit = delimiter == mark
        out = F.when(hit, cells) if out is None else out.when(hit, cells)
    return F.transform(out, trimmed)


def usual_delimiter(line: Column) -> Column:
    """The most frequent of tab, semicolon and comma."""
    count = lambda mark: F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))
    tabs, semis, commas = count("\t"), count(";"), count(",")
    return F.when((tabs >= semis) & (tabs >= commas), "\t").when(semis >= commas, ";").otherwise(",")
