"""Main text of web pages by structure and by differencing with the page of the nearest URL.

A page becomes lines, one per block. Markup settles most of them: what lies in menus, forms, adverts and the like is dropped,
what lies in an article or main element stays. Every other line is open and is decided by differencing: the page is paired
with that neighbour in the order of its host's URL paths which shares more leading path segments, the two pages' lines
are aligned by a longest common subsequence, and open lines that both share are deleted.

Lines inside an article are never deleted by differencing, since copies of one article under two URLs would delete each
other.

Neighbours come from one range-partitioned sort of (host, path, page_id): keys only, so a host with a third of all pages
is spread like any other. Where two partitions meet, the neighbours are tied through the first and last row of each,
two rows per partition.

Defined cases: a null or empty html gives an empty text; a null url has no host and so no partner; the only page
of a host has none either, and all its open lines stay; pages of a host with equal lines, repeated rows among them, share
one partner, which differs from them; a partner with nine tenths of the lines is taken for a copy and deletes nothing; an
unclosed element ends with its parent; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BooleanType

from plumbline.llm.batches import small_batches
from plumbline.session import fresh_folder, settle

TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"<>]*"|'[^'<>]*'|["'])*+)>""")
# Elements whose content is no text of the page.
RAW = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "object", "canvas"))
DROPPED = frozenset(("head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button"))
KEPT = frozenset(("article", "main"))
# Words of class, id and role values that mark furniture, and main text.
FURNITURE = frozenset((
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "consent",
    "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related",
    "reply", "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar",
))
MAIN = frozenset(("main", "article", "post", "entry", "story"))
INLINE = frozenset((
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
))
EMPTY = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
# Compound values that describe the layout around an element, not the element.
LAYOUT = re.compile(r"(?:has|no|with|without|is|not|show|hide)[-_]")
# Furniture that may lie around a whole page; an article in it is none.
AROUND = frozenset(("form",))
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true)|display\s*:\s*none""", re.I)
URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)([^#]*)", re.S)
# What became of a line.
OPEN, STAYS, GONE = 0, 1, 2
# Rows of the alignment kept at a time; others are computed again.
STEP = 256

PARSED = "page_id string, url string, uid bigint, host string, path string, lines array<string>, open array<boolean>, hashes array<bigint>, places array<int>"


def _words(attributes: str) -> tuple[set[str], set[str]]:
    """Whole class, id and role values, and these with the parts of compound ones; a layout's `has-sidebar` names no sidebar."""
    whole: set[str] = set()
    for value in NAMES.findall(attributes):
        whole.update(v.strip("\"'") for v in value.lower().split())
    parts = {part for v in whole if not LAYOUT.match(v) for part in re.split(r"[^a-z0-9]+", v)}
    return whole, parts


def element_kind(name: str, attributes: str, inside_main: bool) -> int | None:
    """GONE, STAYS, or None where the element decides nothing."""
    # The classes of a whole page say nothing about its parts.
    if name in ("html", "body") or (name == "header" and inside_main):
        return None
    if name in DROPPED:
        return GONE
    whole, parts = _words(attributes) if attributes else (set(), set())
    if attributes and HIDDEN.search(attributes):
        return GONE
    if name in KEPT:
        # An article is furniture only where it says so itself, as a reader comment does.
        return GONE if whole & FURNITURE or any(v.startswith("comment") for v in whole) else STAYS
    if parts & FURNITURE:
        return GONE
    return STAYS if parts & MAIN else None


def page_lines(html: str | None) -> list[tuple[int, str]]:
    """(what becomes of it, text) of every block with text, in page order."""
    html = html or ""
    lines: list[tuple[int, str]] = []
    # Open elements with the state inside them, and whether an article inside is gone as well.
    stack: list[tuple[str, int, bool]] = []
    state, held, at = OPEN, [], 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            lines.append((state, text))
        held.clear()

    while True:
        tag = TAG.search(html, at)
        data = html[at:tag.start()] if tag else html[at:]
        if data:
            held.append(unescape(data))
        if not tag:
            break
        at = tag.end()
        closing, name, attributes = tag[1], tag[2], tag[3]
        if name is None:
            if tag[0] == "<!--":
                end = html.find("-->", at)
                at = len(html) if end < 0 else end + 3
            continue
        name = name.lower()
        if name in RAW and not closing:
            if not attributes.endswith("/"):
                end = re.compile(f"</{name}\\b[^>]*>", re.I).search(html, at)
                at = len(html) if end is None else end.end()
            continue
        if name not in INLINE:
            flush()
            # A paragraph ends where another block begins; only furniture among them is kept on the stack.
            if stack and stack[-1][0] == "p" and name not in EMPTY:
                stack.pop()
                state = stack[-1][1] if stack else OPEN
        if name in EMPTY:
            continue
        if name == "p":
            if not closing and attributes and state != GONE and element_kind(name, attributes, state == STAYS) == GONE:
                stack.append((name, GONE, True))
                state = GONE
            continue
        if closing:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
            if depth is not None:
                # What closes with its parent had text of its own state.
                if name in INLINE and stack[depth][1] != (stack[depth - 1][1] if depth else OPEN):
                    flush()
                del stack[depth:]
        elif not attributes.endswith("/"):
            if name == "body":
                stack.clear()  # also ends an unclosed head
            inside = stack[-1][1] if stack else OPEN
            kind = element_kind(name, attributes, inside == STAYS)
            if name in INLINE and (kind is None or inside == GONE):
                continue
            if name in INLINE:
                flush()
            hard = bool(stack) and stack[-1][2]
            if inside == GONE and not hard and kind == STAYS and name in KEPT:
                stack.append((name, STAYS, False))
            elif inside == GONE:
                stack.append((name, GONE, hard or (kind == GONE and name not in AROUND)))
            else:
                # Furniture within an article is furniture; an article within furniture is too, but for `AROUND`.
                stack.append((name, inside if kind is None else kind, kind == GONE and (name not in AROUND or inside == STAYS)))
        state = stack[-1][1] if stack else OPEN
    flush()
    return lines


def shared_places(own: list[int], other: list[int]) -> set[int]:
    """Places of `own` in a longest common subsequence, by bit-parallel rows; memory follows the root of the pages' lines."""
    low = 0
    while low < min(len(own), len(other)) and own[low] == other[low]:
        low += 1
    high = 0
    while high < min(len(own), len(other)) - low and own[-1 - high] == other[-1 - high]:
        high += 1
    shared = set(range(low)) | set(range(len(own) - high, len(own)))
    a, b = own[low:len(own) - high], other[low:len(other) - high]
    if not a or not b:
        return shared
    where: dict[int, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1

    def following(row: int, line: int) -> int:
        hit = row & where.get(line, 0)
        return ((row + hit) | (row - hit)) & full

    # A zero bit at j in row i: the subsequence of a[:i] and b[:j + 1] is one longer than with b[:j].
    kept, row = [full], full
    for i, line in enumerate(a, 1):
        row = following(row, line)
        if i % STEP == 0:
            kept.append(row)
    i, j, rows, base = len(a), len(b), [], -1
    while i > 0 and j > 0:
        block = (i - 1) // STEP
        if block != base:
            base, rows = block, [kept[block]]
            for line in a[block * STEP:(block + 1) * STEP]:
                rows.append(following(rows[-1], line))
        bit = 1 << (j - 1)
        if rows[i - base * STEP] & bit:
            j -= 1
        elif not rows[i - 1 - base * STEP] & bit:
            i -= 1
        else:
            i, j = i - 1, j - 1
            shared.add(low + i)
    return shared


def host_and_path(url: str | None) -> tuple[str | None, str]:
    found = URL.match(url or "")
    return (None, "") if url is None else (found[1].lower(), found[2] + found[3]) if found else ("", url)


def parse_pages(pages: DataFrame) -> DataFrame:
    """The lines of every page with a row number, stored; hashes of all lines serve a partner, texts of gone lines go."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, url, html, uid in batch.itertuples(index=False, name=None):
                lines = page_lines(html)
                hashes = [xxhash.xxh64_intdigest(text) - (1 << 63) for _, text in lines]
                left = [(kind == OPEN, text, k) for k, (kind, text) in enumerate(lines) if kind != GONE]
                url = None if pd.isna(url) else url
                out.append((page, url, uid, *host_and_path(url), [t for _, t, _ in left], [o for o, _, _ in left], hashes, [k for _, _, k in left]))
            yield pd.DataFrame(out, columns=[part.split()[0] for part in PARSED.split(", ")])

    small_batches(pages.sparkSession)
    # The page_id travels as text: pandas would turn whole numbers into floats where some are null.
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.monotonically_increasing_id().alias("uid"))
    path = fresh_folder(pages.sparkSession, "page-lines")
    rows.mapInPandas(parse, PARSED).write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(PARSED).parquet(path)


def segments_shared(one: str, two: str) -> int:
    n = 0
    for a, b in zip(one.split("/"), two.split("/")):
        if a != b:
            break
        n += 1
    return n


def partners(parsed: DataFrame) -> DataFrame:
    """uid, partner: the neighbour in URL order within the host that shares more leading path segments, else the earlier."""
    schema = "uid bigint, host string, path string, task int, edge int, before bigint, n_before int, after bigint, n_after int"

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, waiting = None, None
        for batch in batches:
            out = []
            for uid, host, path, task in batch.itertuples(index=False, name=None):
                row = [uid, host, path, task, 0, None, 0, None, 0]
                if last is None:
                    row[4] = 1
                elif last[1] == host:
                    n = segments_shared(last[2], path)
                    row[5:7], last[7:9] = [last[0], n], [uid, n]
                if last is not None:
                    out.append(last)
                last = row
            yield frame(out)
        if last is not None:
            last[4] += 2  # 1: first of the task, 2: last, 3: both
            yield frame([last])

    def frame(rows: list) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")])
        return made.astype({"before": "Int64", "after": "Int64"})

    keys = parsed.where("host IS NOT NULL").select("uid", "host", "path", F.expr("try_cast(page_id AS decimal(38))").alias("page_id"))
    ordered = keys.repartitionByRange("host", "path", "page_id", "uid").sortWithinPartitions("host", "path", "page_id", "uid")
    found = settle(ordered.select("uid", "host", "path", F.spark_partition_id().alias("task")).mapInPandas(neighbours, schema))
    # At most two rows per partition of the sort.
    edges = sorted(found.where("edge > 0").select("uid", "host", "path", "task", "edge").collect(), key=lambda r: (r["task"], r["edge"] == 2))
    ties = []
    for one, two in zip(edges, edges[1:]):
        if one["task"] != two["task"] and one["host"] == two["host"]:
            n = segments_shared(one["path"], two["path"])
            ties += [(two["uid"], one["uid"], n, None, 0), (one["uid"], None, 0, two["uid"], n)]
    spark = parsed.sparkSession
    mended = spark.createDataFrame(ties, "uid bigint, b bigint, nb int, a bigint, na int").groupBy("uid").agg(
        F.max("b").alias("b"), F.max("nb").alias("nb"), F.max("a").alias("a"), F.max("na").alias("na"))
    whole = found.join(F.broadcast(mended), "uid", "left").select(
        "uid", F.coalesce("before", "b").alias("before"), F.greatest("n_before", F.coalesce("nb", F.lit(0))).alias("n_before"),
        F.coalesce("after", "a").alias("after"), F.greatest("n_after", F.coalesce("na", F.lit(0))).alias("n_after"))
    nearer_after = F.col("before").isNull() | (F.col("after").isNotNull() & (F.col("n_after") > F.col("n_before")))
    return whole.select("uid", F.when(nearer_after, F.col("after")).otherwise(F.col("before")).alias("partner"))


@F.pandas_udf(ArrayType(BooleanType()))
def not_shared(hashes: pd.Series, places: pd.Series, other: pd.Series) -> pd.Series:
    """For every line left of a page: is it outside the longest common subsequence with the partner's lines?"""
    out = []
    for own, at, theirs in zip(hashes, places, other):
        shared = set() if theirs is None else shared_places(list(own), list(theirs))
        # A partner that shares nearly all lines is a copy with some change; it does not tell furniture from text.
        if len(shared) * 10 >= len(own) * 9:
            shared = set()
        out.append([int(k) not in shared for k in at])
    return pd.Series(out, dtype=object)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of `pages`. Only pages with open lines meet their partners' line hashes."""
    parsed = parse_pages(pages)
    undecided = F.exists("open", lambda o: o)
    settled = parsed.where(~undecided).select("page_id", "url", F.array_join("lines", " ").alias("text"))
    waiting = parsed.where(undecided)
    # Equal pages of a host are one in the pairing, so that a partner always differs.
    sequence = F.xxhash64("hashes").alias("sequence")
    known = parsed.where("host IS NOT NULL")
    distinct = settle(known.groupBy("host", sequence).agg(F.min(F.struct("path", "uid", "page_id")).alias("first")).select(
        "host", "sequence", "first.path", "first.page_id", "first.uid"))
    of_page = waiting.select("uid", "host", sequence).join(distinct.select("host", "sequence", F.col("uid").alias("like")), ["host", "sequence"])
    paired = of_page.select("uid", "like").join(partners(distinct).withColumnRenamed("uid", "like"), "like").select("uid", "partner")
    theirs = paired.join(parsed.select(F.col("uid").alias("partner"), F.col("hashes").alias("other")), "partner").select("uid", "other")
    judged = waiting.join(theirs, "uid", "left").withColumn("own", not_shared("hashes", "places", "other"))
    stay = F.filter(F.arrays_zip("lines", "open", "own"), lambda z: ~z["open"] | z["own"])
    made = settled.unionAll(judged.select("page_id", "url", F.array_join(F.transform(stay, lambda z: z["lines"]), " ").alias("text")))
    return made.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    text = main_text(spark.read.parquet(f"{folder}/pages.parquet"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
