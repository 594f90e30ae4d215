"""WARC archives with a globally ordered capture index.

Pages are written as gzip members, one per record, into archives of bounded size. Every writing task also yields a
run: the index rows of its archives, locally sorted by URL key, time and page. The runs are cut at common key
boundaries and each key range is merged by a loser tree over its slices of the runs; the ranges follow one
another, so the stored index is in global order. Records with equal payloads of at least `REVISIT_BYTES` are one response,
the one with the largest page_id, and revisits that refer to it.

Lost executors: an archive's name contains a fresh identifier, and only archives named by the committed manifest are
read, so what a lost or repeated task left behind is never seen. All files lie under the shared folder.

Defined cases: a null html is an empty payload; a null url has the empty URL key; rows repeating a page_id are records of
their own (equal payloads of one page_id: all rows but none refer beyond the page_id); a null page_id is read back
as null and never chosen over a page_id; an empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.batches import small_batches
from plumbline.session import fresh_folder, settle

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 * 1024 * 1024
CAPTURED = "2024-01-01T00:00:00Z"
# Index rows merged in one task.
RANGE_ROWS = 500_000
# Keys drawn for the range boundaries; ranges are this uneven at most in expectation, whatever the input.
SAMPLE_PER_RANGE = 100

INDEX = ("urlkey string, captured string, page_id bigint, digest string, payload_bytes bigint, record_type string, "
         "refers_to bigint, archive string, offset bigint, length bigint, run string")
ORDER = ["urlkey", "captured", "page_id", "archive", "offset"]


def url_key(url: Column) -> Column:
    """Host labels reversed, then the path with its query: com,example,www)/path?x. Scheme, port and fragment go."""
    lower = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(lower, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(lower, r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", ""), "#.*$", "")
    return F.when(lower == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, digest, record_type, refers_to for every row of `pages`.

    The group of one digest is reduced to its largest page_id before the shuffle, whatever the size of the group. Only
    digests that occur twice are joined to, so unlike payloads never meet in a task.
    """
    body = payload(F.col("html"))
    rows = pages.select("page_id", "url", "html", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("digest"))
    leads = (
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.max("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1 AND lead IS NOT NULL").select("digest", "lead"))
    # The lead of every copy, by page: small rows, so that the texts move at most once.
    copies = (rows.select("page_id", "digest", "payload_bytes").where(F.col("payload_bytes") >= REVISIT_BYTES)
              .join(leads, "digest").where(~F.col("page_id").eqNullSafe(F.col("lead")))
              .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "lead").distinct())
    joined = rows.join(copies, rows["page_id"].eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "digest",
        F.when(F.col("lead").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("lead").alias("refers_to"))


def record_bytes(row, captured: str) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload."""
    page_id, url, body, digest, kind, refers = row
    body = b"" if kind == "revisit" else body
    heads = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        # A line break in a URL would end the header.
        heads.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        heads.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers}')}>")
        heads.append(f"X-Refers-To-Page-ID: {refers}")
        heads.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    heads.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(heads) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    length = int(fields["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record length and content differ")
    return fields, rest[:length]


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder given as a URI or a plain path."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_archives(decided: DataFrame, folder: str, captured: str = CAPTURED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all records below `folder`; the index rows, sorted within each run, as a stored table."""
    # Numbers that may be null travel as text: pandas would turn them into floats.
    rows = decided.select(
        F.col("page_id").cast("string").alias("page_id"), "url", payload(F.col("html")).alias("body"), "digest", "record_type",
        F.col("refers_to").cast("string").alias("refers_to"), "payload_bytes",
        url_key(F.col("url")).alias("urlkey"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        run, lines, out, name, at = uuid.uuid4().hex, [], None, "", 0
        try:
            for batch in batches:
                for page, url, body, digest, kind, refers, size, key in batch.itertuples(index=False, name=None):
                    page = None if pd.isna(page) else int(page)
                    refers = None if pd.isna(refers) else int(refers)
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    member = gzip.compress(record_bytes((page, url, body, digest, kind, refers), captured), 4, mtime=0)
                    out.write(member)
                    lines.append((key, captured, page, digest, int(size), kind, refers, name, at, len(member), run))
                    at += len(member)
                if len(lines) >= RANGE_ROWS:  # a run is sorted in memory, so it ends here
                    yield run_frame(lines)
                    run, lines = uuid.uuid4().hex, []
        finally:
            if out is not None:
                out.close()
        if lines:
            yield run_frame(lines)

    small_batches(decided.sparkSession)
    return settle(rows.mapInPandas(write, INDEX))


def run_frame(lines: list[tuple]) -> pd.DataFrame:
    lines.sort(key=order_key)
    frame = pd.DataFrame(lines, columns=[part.split()[0] for part in INDEX.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def order_key(line: tuple) -> tuple:
    """Order of the index: URL key, time, page_id with null first, place in the archive."""
    return line[0].encode(), line[1], line[2] is not None, line[2] or 0, line[7], line[8]


class LoserTree:
    """Merges k sorted iterators; every step replays one path of comparisons, from the winner's leaf to the root."""

    def __init__(self, sources: list[Iterator[tuple]], key):
        self.sources, self.key = sources, key
        self.k = max(len(sources), 1)
        self.heads: list = [None] * self.k
        for i in range(len(sources)):
            self._advance(i)
        self.losers = [-1] * self.k
        self.winner = self._play(1) if sources else 0

    def _advance(self, i: int) -> None:
        row = next(self.sources[i], None)
        self.heads[i] = None if row is None else (self.key(row), i, row)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or a[:2] < b[:2])

    def _play(self, node: int) -> int:
        """First round below an inner node: keeps the loser, passes the winner up."""
        if node >= self.k:
            return node - self.k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        winner, loser = (left, right) if self._beats(left, right) else (right, left)
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner][2]
            i = self.winner
            self._advance(i)
            node = (i + self.k) // 2
            while node >= 1:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merge_runs(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All index rows in global order as a stored table; `range_no` numbers the key ranges.

    A range holds about `range_rows` rows whatever the number of runs and however often a URL key occurs, since time,
    page and place are part of the boundaries. Spark hands a task its slices run by run; the loser tree merges them.
    """
    ranges = max(1, -(-index.count() // range_rows))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[str, list[tuple]] = {}
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            for line in batch.itertuples(index=False, name=None):
                slices.setdefault(line[10], []).append(line)
        out: list[tuple] = []
        for line in LoserTree([iter(s) for s in slices.values()], order_key):
            out.append(line)
            if len(out) == 10_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(lines: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(lines, columns=[part.split()[0] for part in INDEX.split(", ")])
        return made.astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = index.repartitionByRange(ranges, *ORDER).sortWithinPartitions("run", *ORDER)
    return settle(dealt.mapInPandas(merge, INDEX).withColumn("range_no", F.spark_partition_id()))


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Records read back by the index: page_id, url, html, payload_digest, payload_bytes, record_type, refers_to.

    `payload_bytes` and the digest of a response are taken from the bytes read; a revisit has those of its response,
    as the standard says, from the record's own head and the index.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_folder(folder)
        for batch in batches:
            out = []
            for archive, lines in batch.groupby("archive", sort=False):
                with store.open_input_file(f"{base}/{archive}") as file:
                    for line in lines.sort_values("offset").itertuples(index=False):
                        fields, body = parse_record(gzip.decompress(file.read_at(int(line.length), int(line.offset))))
                        kind = fields["WARC-Type"]
                        digest = hashlib.sha1(body).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"][5:]
                        url = fields.get("WARC-Target-URI")
                        if url is not None:
                            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        out.append((
                            int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, url,
                            body.decode() if kind == "response" else None, digest,
                            len(body) if kind == "response" else int(line.payload_bytes), kind,
                            int(fields["X-Refers-To-Page-ID"]) if kind == "revisit" else None))
            frame = pd.DataFrame(out, columns=["page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    small_batches(index.sparkSession)
    # Neighbours in an archive are read together.
    places = index.select("archive", "offset", "length", "payload_bytes").repartition("archive").sortWithinPartitions("archive", "offset")
    return places.mapInPandas(
        read, "page_id bigint, url string, html string, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint")


def archive_pages(pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(merged index, records read back) of `pages`, archived below `folder`."""
    index = merge_runs(write_archives(decide(pages), folder))
    return index, read_archives(index, folder)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    _, records = archive_pages(pages, fresh_folder(spark, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = f"""
WITH sized AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
  sha1(coalesce(html, '')) AS payload_digest FROM pages),
lead AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to
FROM lead"""
