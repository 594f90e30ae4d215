"""Personal data, and terms that give it away.

Base spans (addresses, network addresses, card and phone numbers) are found by pattern. Each distinct base value is a
protected entity. The corpus then tells how strongly a term reveals it: over the N distinct texts, with n(e) texts that
hold e, n(t) that hold t and n(e,t) both, PMI(e, t) = log2(n(e,t) N / (n(e) n(t))) is the information t gives about e, and
IC(e) = log2(N / n(e)) all there is. A term with PMI / IC at or above a threshold is removed, or, above the lower one,
generalised, wherever it stands in any text. It must also make the entity at least as likely as not, n(e,t) / n(t) >= 1/2;
otherwise an entity in very many texts would have common words marked in texts that have nothing to do with it.

Chance is ruled out by a test: were t spread over the texts at random, n(e,t) or more common texts would have a
probability of at most 2^-bits, bits = n(t) D(n(e,t) / n(t) || n(e) / N), D being the relative entropy in bits. With V
terms tried for an entity, `RISK` / V is the most allowed, so an entity has a false term with a probability of `RISK` at most.
One common text proves nothing, so entities and terms need two; copies of a text count once.

Everything is Column expressions and joins. Pairs are made of classes, not of entities and terms: entities that stand in
the same texts are one class, and so are terms that stand in the same texts with entities and are equally frequent. A text
that lists a thousand entities, or copies with slight changes, are thus few pairs. Only terms rare enough to pass take part.

Defined cases: null and empty texts have no spans; repeated rows are documents of their own and repeat in the
result, but are one text for the statistics; null doc_ids are kept; a corpus of one document reveals nothing (IC is 0);
words inside something like a base value are no terms; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.line_dedup import bitmap_of, in_bitmap
from plumbline.llm.names import all_columns, spare
from plumbline.llm.spans import count_kind, guarded_spans, kind_spans, let, match_spans, running, spelled
from plumbline.session import settle

# The base patterns. Possessive repeats give the same matches without recursion or backtracking; a start
# inside a run could only match what its beginning did, so it is ruled out unless the last match ended there.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
BASE_KINDS = ("email", "ip", "card", "phone")
# Kinds that the method adds, in the order of `spans`.
REMOVED, GENERALISED = "removed", "generalised"

TERM = r"[\p{L}\p{N}]{3,}"
# What looks like a base value is passed over; group 1 is a term.
TOKEN = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
         rf"|{IP}|{PHONE}|[0-9](?:[\x20-]?[0-9]){{12,}}+|({TERM})")
# Share of the entity's information that a term must give.
REMOVE_AT, GENERALISE_AT = 0.95, 0.8
# Least share of the texts with a term that hold the entity.
LEAST_SHARE = 0.5
# Parts into which the rows of one text are dealt when its added spans are joined.
DEAL = 8
# Probability, for each entity, that any of its terms is there by chance; least number of common texts.
RISK = 0.01
LEAST_TEXTS = 2

SPANS = "array<struct<start:int,number:int,end:int,kind:string,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds, by kind and then by start."""
    whole = F.coalesce(text, F.lit(""))
    email = guarded_spans(whole, F.contains(whole, F.lit("@")), EMAIL)
    ip = F.filter(guarded_spans(whole, whole.rlike(r"[0-9]\.[0-9]+\.[0-9]"), IP), lambda s: s["value"].rlike(IP_PARTS))
    card = F.filter(
        guarded_spans(whole, whole.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), CARD),
        lambda s: F.when(F.length(_digits(s["value"])).between(13, 19), _luhn(_digits(s["value"]))).otherwise(False))
    phone = F.filter(guarded_spans(whole, F.contains(whole, F.lit("+")), PHONE),
                     lambda s: F.length(_digits(s["value"])).between(9, 15))
    found = [kind_spans(spans, kind, n) for n, (kind, spans) in enumerate(zip(BASE_KINDS, (email, ip, card, phone)))]
    return F.concat(*found).cast(SPANS)


def digest_of(text: str) -> Column:
    return F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def find_base(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base spans and digest of the text of every row."""
    return docs.select(F.col(key).alias("doc_id"), base_spans(F.col(text)).alias("base"), digest_of(text).alias("digest"))


def terms_of(text: str) -> Column:
    """Distinct terms of a text, lower-cased."""
    words = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(1))
    return F.filter(F.array_distinct(F.transform(words, F.lower)), lambda w: w != "")


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """term and the number of distinct texts that have it; copies are left out before the terms are taken.

    Only texts whose digest repeats, or shares its bit with one that does, are shuffled whole.
    """
    rows = docs.where(F.col(text).isNotNull()).select(digest_of(text).alias("digest"), F.col(text).alias("text"))
    repeated = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("digest").alias("k"))
    bitmap, place = settle(bitmap_of(repeated)), F.xxhash64("digest")
    copies = in_bitmap(rows, place, bitmap).groupBy("digest").agg(F.first("text").alias("text"))
    texts = in_bitmap(rows, place, bitmap, held=False).select("digest", "text").unionAll(copies)
    return texts.select(F.explode(terms_of("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))


def texts_of(docs: DataFrame, digests: DataFrame, text: str = "text") -> DataFrame:
    """digest and text, once each, of the texts whose digests are asked for; a bitmap keeps the others out of the shuffle.

    Not a semi-join: where Spark expects to broadcast the digests, it moves that below the grouping and the bitmap; when they
    then turn out too large, all texts are shuffled. The digests are distinct, so an inner join gives the same rows.
    """
    wanted = digests.select("digest").distinct()
    likely = in_bitmap(docs.select(digest_of(text).alias("digest"), F.col(text).alias("text")), F.xxhash64("digest"),
                       bitmap_of(wanted.select(F.xxhash64("digest").alias("k"))))
    return likely.groupBy("digest").agg(F.first("text").alias("text")).join(wanted, "digest")


def _same_texts() -> list[Column]:
    """Names the set of texts of a group by 128 bits; each text occurs once in it."""
    return [F.bit_xor(F.xxhash64("digest")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("#"), F.col("digest"))).alias("x2")]


def evidence(total: int) -> tuple[Column, Column]:
    """(share of the information of e that t gives, bits against chance) from n_e, n_t and n_et."""
    n, e, t, both = F.lit(float(max(total, 1))), F.col("n_e"), F.col("n_t"), F.col("n_et")
    share, usual = both / t, e / n
    rest = F.when(both < t, (1 - share) * F.log2((1 - share) / (1 - usual))).otherwise(0.0)
    return F.log2(both * n / (e * t)) / F.log2(n / e), t * (share * F.log2(share / usual) + rest)


def revealing_terms(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """term and the largest share of an entity's information that it gives, for the terms that reveal one."""
    total = found.select("digest").distinct().count()
    each = found.where(F.size("base") > 0).select("digest", F.explode(F.transform(
        "base", lambda s: F.xxhash64(s["kind"], s["value"]))).alias("entity")).distinct()
    entities = each.groupBy("entity").agg(F.count("*").alias("n_e"), *_same_texts()).where(F.col("n_e") >= LEAST_TEXTS)
    holders = settle(each.join(entities, "entity").select("digest", F.struct("n_e", "x1", "x2").alias("e_class")).distinct())
    frequency = settle(document_frequency(docs, text))
    tried = max(frequency.count(), 1)
    beside = settle(texts_of(docs, holders, text).select("digest", F.explode(terms_of("text")).alias("term")))
    terms = settle(
        beside.groupBy("term").agg(F.count("*").alias("beside"), *_same_texts()).where(F.col("beside") >= LEAST_TEXTS)
        .join(frequency, "term").select("term", F.struct("n_t", "beside", "x1", "x2").alias("t_class")))
    standing = beside.join(terms, "term").select("digest", "t_class").distinct()
    n_e, n_t = F.col("e_class.n_e"), F.col("t_class.n_t")
    # A more frequent term could not reach the threshold even if it stood in every text that holds the entity.
    rare = (n_t <= n_e / LEAST_SHARE) & (n_t <= n_e * F.pow(F.lit(float(max(total, 1))) / n_e, F.lit(1 - GENERALISE_AT)) * (1 + 1e-9))
    pairs = holders.join(standing, "digest").where(rare).groupBy("e_class", "t_class").agg(F.count("*").alias("n_et"))
    disclosed, bits = evidence(total)
    return (
        pairs.where((F.col("n_et") >= LEAST_TEXTS) & (F.col("n_et") >= n_t * LEAST_SHARE) & (n_e < total)).select("t_class", n_e.alias("n_e"), n_t.alias("n_t"), "n_et")
        .select("t_class", disclosed.alias("disclosed"), bits.alias("bits"))
        .where((F.col("disclosed") >= GENERALISE_AT - 1e-12) & (F.col("bits") >= F.log2(F.lit(tried / RISK))))
        .groupBy("t_class").agg(F.max("disclosed").alias("disclosed"))
        .join(terms, "t_class").select("term", "disclosed"))


def term_spans(docs: DataFrame, revealing: DataFrame, text: str = "text") -> DataFrame:
    """digest and the spans of all occurrences of the revealing terms, for the texts that have any."""
    known = settle(bitmap_of(revealing.select(F.xxhash64("term").alias("k"))))
    held = in_bitmap(docs.select(digest_of(text).alias("digest"), F.explode(terms_of(text)).alias("term")), F.xxhash64("term"), known)
    hits = settle(held.distinct().join(revealing, "term"))
    spans = F.filter(match_spans(F.col("text"), TOKEN, 1), lambda s: s["part"] != "")
    placed = texts_of(docs, hits, text).select("digest", F.explode(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("term")))).alias("at"))
    removed = F.col("disclosed") >= REMOVE_AT
    number = len(BASE_KINDS) + F.when(removed, 0).otherwise(1)
    return (
        in_bitmap(placed.select("digest", "at.*"), F.xxhash64("term"), known).join(hits, ["digest", "term"])
        .groupBy("digest").agg(F.array_sort(F.collect_list(F.struct(
            number.alias("number"), F.col("start"), F.col("end"),
            F.when(removed, REMOVED).otherwise(GENERALISED).alias("kind"), F.col("term").alias("value")))).alias("added")))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and all spans of every row: base spans by kind and start, then the terms that reveal them."""
    found = settle(find_base(docs, key, text))
    added = term_spans(docs, settle(revealing_terms(docs, found, text)), text)
    # Copies may crowd on one digest, so their rows are dealt out and the one row of added spans is repeated.
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(DEAL)))
    added = added.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long"))))
    extra = F.transform(F.coalesce("added", F.array()), lambda s: F.struct(
        s["start"].alias("start"), s["number"].alias("number"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["value"].alias("value")))
    return found.join(added, ["digest", "part"], "left").select(
        "doc_id", F.concat("base", F.coalesce(extra, F.array()).cast(SPANS)).alias("spans"))


def mask(text: Column, spans: Column) -> Column:
    """The text with base values and removed terms replaced by their kind, generalised ones by their shape."""
    def put(s: Column, covered: Column) -> Column:
        shape = F.when(s["kind"] == GENERALISED, F.when(s["value"].rlike("^[0-9]+$"), "[number]").otherwise("[word]"))
        new = F.when(s["kind"] == REMOVED, F.lit("")).otherwise(F.coalesce(shape, F.concat(F.lit("["), s["kind"], F.lit("]"))))
        # A span that begins inside those before it is covered already, but for what sticks out.
        return F.when(s["start"] < covered, F.lit("")).otherwise(F.concat(F.substring(text, covered + 1, s["start"] - covered), new))

    def cut(ordered: Column, ends: Column) -> Column:
        pieces = F.transform(ordered, lambda s, i: put(s, F.when(i == 0, 0).otherwise(ends[i - 1])))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.array_sort(spans), lambda ordered: let(
        running(F.transform(ordered, lambda s: s["end"]), F.greatest), lambda ends: cut(ordered, ends))))


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with personal data and revealing terms replaced in `text`; null texts stay null."""
    key, found, match = spare(docs, "_doc_id"), spare(docs, "_spans"), spare(docs, "_match")
    # Rows that repeat a doc_id may differ in text, so the text's own digest is part of the match.
    spans = personal_data(docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("h"))))
    spans = spans.groupBy("doc_id").agg(F.first("spans").alias(found)).withColumnRenamed("doc_id", key)
    rows = docs.withColumn(match, F.struct("doc_id", F.xxhash64("text").alias("h")))
    joined = rows.join(spans, rows[match].eqNullSafe(spans[key]))
    return joined.withColumn("text", mask(F.col("text"), F.col(found))).select(*all_columns(docs))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{folder}/documents.parquet"))
    base = F.filter("spans", lambda s: s["number"] < len(BASE_KINDS))
    counts = [count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(spelled(base), "UTF-8"), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"))
