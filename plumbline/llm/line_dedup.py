"""Line dedup across a corpus, within one edit, by a deletion-neighbourhood join.

A line (trimmed, not empty) is dropped where an earlier line equals it, whatever its length, or is one edit away: one code
point inserted, deleted or replaced. Earlier is by (doc_id, line number), and a line counts as earlier whether it is kept itself
or not. One edit makes two short lines differ in meaning, as a digit does, so lines under `NEAR_CHARS` code points are
compared for equality alone. Blank lines always stay.

Equal lines are one class, reduced to its first place before anything else. Two different lines within one edit
have a common variant: the line without one code point, or the shorter line itself. A variant is keyed by hash;
lines over `BLOCK` code points vary block by block between hashes of what comes before and after, so keys cost the
length of a block and not of the line. Blocks around which no other line reads the same get no variants. Replacements share (variant, position) and are tied to the earliest line
of that key, so a group of n similar lines gives n rows, not n squared. Every tie is verified by edit distance.

Before variants are written, a pigeonhole rules out lines that cannot have a partner: one edit leaves either the
beginning or the end of a line alone, so a partner shares one of these. That loses nothing.

Digests of whole lines have 128 bits. A fixed-size bitmap (its bound is `BITMAP_BITS` / 8 bytes) keeps the texts of lines
that cannot match out of the shuffle; false positives of the bitmap are removed by the join behind it.

Defined cases: a null text stays null and has no lines; an empty text has none; documents with a null doc_id are
last in order, and their lines are dropped like others, all rows with null doc_id being one document; repeated rows with
one doc_id are one document as well: a line number is compared once for all of them, so none of them loses the first
place; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.names import all_columns, spare
from plumbline.session import settle

# Least code points of the lines that are also compared within one edit.
NEAR_CHARS = 16
MOST_EDITS = 1
# Code points of a line that vary together.
BLOCK = 64
# Grain of the beginnings and ends that are compared first.
GRAIN = 8
BITMAP_BITS = 1 << 24
BUCKET_BITS = 32_768


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, line_no, line (trimmed), h1, h2 of every line that is not blank. `doc` orders null last."""
    lines = docs.where(F.col(text) != "").select(
        F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id")).alias("doc"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("#"), "line"))


def first_places(lines: DataFrame) -> DataFrame:
    """h1, h2 and the first (doc, line_no) of every distinct line; digests and places only."""
    return lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line_no")).alias("place"))


def _end_keys(line: Column) -> Column:
    """Hashes of the beginning and the end, for the line's own length and for one less."""
    def keys(length: Column) -> Column:
        m = F.floor(length / (2 * GRAIN)).cast("int") * GRAIN
        return F.array(
            F.xxhash64(F.lit("b"), m, F.substring(line, F.lit(1), m)), F.xxhash64(F.lit("e"), m, F.substring(line, -m, m)))

    size = F.char_length(line)
    return F.when(size % (2 * GRAIN) == 0, F.array_distinct(F.concat(keys(size), keys(size - 1)))).otherwise(keys(size))


def near_places(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Places (doc, line_no, h1, h2) of distinct lines whose beginning or end another distinct line shares."""
    ends = lines.select("doc", "line_no", "h1", F.explode(_end_keys(F.col("line"))).alias("end_key"))
    # Stored, so that the join gets both sides from shuffles of their own and can split a beginning that many lines share.
    shared = settle(ends.groupBy("end_key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
                    .where("low <> high").select("end_key"))
    found = ends.join(shared, "end_key", "left_semi").select("h1").distinct()
    return firsts.join(found, "h1", "left_semi").select("h1", "h2", "place")


def bitmap_of(keys: DataFrame) -> DataFrame:
    """bucket, bits: a bitmap over the hashes in column `k`, BITMAP_BITS / BUCKET_BITS rows of 4 KB at most."""
    spot = F.pmod(F.col("k"), F.lit(BITMAP_BITS))
    return keys.select(spot.alias("spot")).distinct().select(
        F.floor(F.col("spot") / BUCKET_BITS).cast("int").alias("bucket"), (F.col("spot") % BUCKET_BITS).alias("bit"),
    ).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def in_bitmap(rows: DataFrame, k: Column, bitmap: DataFrame, held: bool = True) -> DataFrame:
    """Rows whose hash `k` may be in the bitmap, or the others; it is broadcast, at most BITMAP_BITS / 8 bytes."""
    spot = F.pmod(k, F.lit(BITMAP_BITS))
    bit = (spot % BUCKET_BITS).cast("int")
    marked = rows.withColumn("_bucket", F.floor(spot / BUCKET_BITS).cast("int")).withColumn("_bit", bit).join(
        F.broadcast(bitmap.withColumnRenamed("bucket", "_bucket")), "_bucket", "inner" if held else "left")
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.col("_bit") % 8) == 1, F.lit(False))
    return marked.where(hit if held else ~hit).drop("_bucket", "_bit", "bits")


def near_lines(lines: DataFrame, places: DataFrame) -> DataFrame:
    """Texts of the lines at `places`: id, place, line."""
    place_key = F.xxhash64("doc", "line_no")
    chosen = settle(places)
    likely = in_bitmap(
        lines.select("doc", "line_no", "line"), place_key,
        bitmap_of(chosen.select(F.xxhash64("place.doc", "place.line_no").alias("k"))))
    at = chosen.select(F.col("place.doc.none").alias("none"), F.coalesce("place.doc.id", F.lit(0)).alias("_id"),
                       F.col("place.line_no").alias("line_no"), "h1", "h2", "place")
    joined = likely.withColumn("none", F.col("doc.none")).withColumn("_id", F.coalesce("doc.id", F.lit(0))).join(
        at, ["none", "_id", "line_no"])
    # A repeated doc_id with other text must not answer for this line.
    right = (F.xxhash64("line") == F.col("h1")) & (F.xxhash64(F.lit("#"), "line") == F.col("h2"))
    return joined.where(right).select("h1", "h2", "place", "line").dropDuplicates(["h1", "h2"])


def numbered(near: DataFrame) -> DataFrame:
    """`near` with `id`, a number in the order of the places, and `size`; stored."""
    ordered = ["place.doc.none", "place.doc.id", "place.line_no"]
    dealt = near.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    return settle(dealt.withColumn("id", F.monotonically_increasing_id()).withColumn("size", F.char_length("line")))


def likely_blocks(near: DataFrame) -> DataFrame:
    """id, size, around, start, held, gone: blocks of lines around which another line reads the same.

    `size` is that of the longer line of a pair. A block with `gone` loses one code point; one without is read as a line
    that has one less already. `around` is the hash of everything outside the block. Only where two lines agree on
    it can they differ within the block alone, so other blocks need no variants.
    """
    start = F.col("blk") * BLOCK
    blocks = near.select("id", "size", "line", F.explode(
        F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK).cast("int"))).alias("blk"))
    longer = blocks.select(
        "id", "size", F.xxhash64("blk", F.substring("line", F.lit(1), start), F.substring("line", start + BLOCK + 1, F.col("size"))).alias("around"),
        start.alias("start"), F.substring("line", start + 1, F.lit(BLOCK)).alias("held"), F.lit(True).alias("gone"))
    blocks = near.select("id", "size", "line", F.explode(
        F.sequence(F.lit(0), F.floor(F.col("size") / BLOCK).cast("int"))).alias("blk"))
    shorter = blocks.select(
        "id", (F.col("size") + 1).alias("size"),
        F.xxhash64("blk", F.substring("line", F.lit(1), start), F.substring("line", start + BLOCK, F.col("size"))).alias("around"),
        start.alias("start"), F.substring("line", start + 1, F.lit(BLOCK - 1)).alias("held"), F.lit(False).alias("gone"))
    table = settle(longer.unionAll(shorter))
    met = table.groupBy("around", "size").agg(F.count_if("gone").alias("n_gone"), F.count_if(~F.col("gone")).alias("n_whole")).where(
        "n_gone > 1 OR (n_gone = 1 AND n_whole > 0)")
    return table.join(met.select("around", "size"), ["around", "size"], "left_semi")


def variants(near: DataFrame) -> DataFrame:
    """id, size, key, pos: `pos` is the deleted code point, null where the block is whole."""
    blocks = likely_blocks(near)
    deleted = blocks.where("gone").select(
        "id", "size", "around", "start", "held", F.explode(F.sequence(F.lit(1), F.char_length("held"))).alias("i"))
    without = F.concat(F.substring("held", F.lit(1), F.col("i") - 1), F.substring("held", F.col("i") + 1, F.lit(BLOCK)))
    deleted = deleted.select("id", "size", F.xxhash64("around", without).alias("key"), (F.col("start") + F.col("i")).alias("pos"))
    whole = blocks.where(~F.col("gone")).select(
        "id", "size", F.xxhash64("around", "held").alias("key"), F.lit(None).cast("int").alias("pos"))
    return deleted.unionAll(whole)


def near_ties(near: DataFrame) -> DataFrame:
    """Digests of the later, and id of the earlier, of distinct lines within one edit, verified."""
    table = settle(variants(near))
    gone, whole = table.where("pos IS NOT NULL"), table.where("pos IS NULL")
    firsts = gone.groupBy("key", "pos", "size").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    replaced = gone.join(firsts, ["key", "pos", "size"]).where("id > first").select("id", F.col("first").alias("other"))
    shorter = whole.select("key", "size", F.col("id").alias("w"))
    inserted = gone.join(shorter, ["key", "size"]).select(F.greatest("id", "w").alias("id"), F.least("id", "w").alias("other"))
    ties = replaced.unionAll(inserted).distinct()
    others = near.select(F.col("id").alias("other"), F.col("line").alias("other_line"))
    texts = ties.join(near.select("id", "h1", "h2", "line"), "id").join(others, "other")
    return texts.where(F.levenshtein("line", "other_line", MOST_EDITS) >= 0).select("h1", "h2", "other")


def kept_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, kept (numbers of compared lines that stay), n_near (first places dropped as near)."""
    lines = split_lines(docs, key, text)
    firsts = settle(first_places(lines))
    longer = lines.where(F.char_length("line") >= NEAR_CHARS)
    near = numbered(near_lines(longer, near_places(longer, firsts)))
    dropped = near_ties(near).select("h1", "h2").distinct()
    # Equal lines other than the first are in no first place, so what is kept is read off the first places alone.
    marked = firsts.join(dropped.withColumn("near", F.lit(1)), ["h1", "h2"], "left")
    return marked.groupBy("place.doc").agg(
        F.collect_list(F.when(F.col("near").isNull(), F.col("place.line_no"))).alias("kept"),
        F.count("near").alias("n_near"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with cleaned text and a last column `_lines` of n_lines, n_dropped and n_near."""
    none, id_, stays, near = (spare(docs, name) for name in ("_none", "_id", "_kept", "_near"))
    kept = kept_lines(docs, key, text).select(
        F.col("doc.none").alias(none), F.coalesce("doc.id", F.lit(0)).alias(id_), F.col("kept").alias(stays), F.col("n_near").alias(near))
    rows = docs.withColumn(none, F.col(key).isNull()).withColumn(id_, F.coalesce(key, F.lit(0)))
    # Columns of their own, since an expression inside a lambda is evaluated anew for every element.
    split, stay_at = spare(docs, "_split"), spare(docs, "_stay")
    joined = rows.join(kept, [none, id_], "left").withColumn(split, F.split(F.col(text), "\n", -1))
    lines = F.col(split)
    numbers = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    blank = F.filter(F.transform(lines, lambda line, i: F.when(F.trim(line) == "", i)), lambda i: i.isNotNull())
    joined = joined.withColumn(
        stay_at, F.array_intersect(numbers, F.concat(blank, F.coalesce(stays, F.array().cast("array<int>")))))
    stay = F.col(stay_at)
    cleaned = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    counted = F.struct(
        F.when(empty, 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(empty, 0).otherwise(F.size(lines) - F.size(stay)).cast("long").alias("n_dropped"),
        F.coalesce(near, F.lit(0)).cast("long").alias("n_near"))
    counts = spare(docs, "_lines")
    return joined.withColumn(counts, counted).withColumn(
        text, F.when(F.col(text).isNull(), F.lit(None).cast("string")).when(empty, "").otherwise(cleaned)
    ).select(*all_columns(docs), F.col(counts).alias("_lines"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, cleaned text, and how many lines there were, were dropped, and were dropped in first places as near."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "_lines.n_lines", "_lines.n_dropped", "_lines.n_near")


OP5_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS raw FROM
    (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')),
trimmed AS (SELECT *, trim(raw, ' ') AS line FROM lines),
firsts AS (SELECT line, min((doc_id, line_no)) AS place FROM trimmed WHERE line <> '' GROUP BY line),
halves AS (SELECT line, place, unnest([length(line) // 2, (length(line) - 1) // 2]) AS m FROM firsts
  WHERE length(line) >= {NEAR_CHARS}),
keyed AS (SELECT DISTINCT line, place, m, s, CASE s WHEN 'b' THEN left(line, m) ELSE right(line, m) END AS part
  FROM halves CROSS JOIN (SELECT unnest(['b', 'e']) AS s)),
pairs AS (SELECT DISTINCT a.line AS line, b.line AS other FROM keyed a JOIN keyed b USING (m, s, part)
  WHERE a.place > b.place AND abs(length(a.line) - length(b.line)) <= 1),
near AS (SELECT DISTINCT line FROM pairs WHERE levenshtein(line, other) <= {MOST_EDITS}),
judged AS (
  SELECT t.doc_id, t.line_no, t.raw, n.line IS NOT NULL AND (t.doc_id, t.line_no) = f.place AS is_near,
    t.line = '' OR (n.line IS NULL AND (t.doc_id, t.line_no) = f.place) AS stays
  FROM trimmed t LEFT JOIN firsts f USING (line) LEFT JOIN near n USING (line))
SELECT d.doc_id, any_value(CASE WHEN d.text IS NULL THEN NULL ELSE '' END)
    || coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (stays), '') AS text,
  count(line_no) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, count(*) FILTER (is_near) AS n_near
FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id"""
