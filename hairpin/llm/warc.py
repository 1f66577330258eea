"""WARC archives written and read by Spark, with record boundaries proved by their chain from the start of a file.

Writing. A page's payload is its HTML in UTF-8, behind the header of an HTTP response. Of pages with equal payloads of at least LEAST_BYTES the one
with the smallest id is a ``response``, the others are ``revisit`` records: they carry the HTTP header and name the response, not the payload.
The smallest ids are those of groups of two or more pages only, found by digest with partial minima; the table of these groups is joined to the
pages, broadcast by Spark if it is small, else shuffled with skewed digests split at run time. Records go straight from the scan into files, one
text after the other, by Spark's own text writer: a file is a valid uncompressed archive.

Reading. The line that begins a record may stand in a payload as well. Files are read as texts parted by that line, so Spark deals out parts of
files, however long a file is, and each piece between two such lines is a candidate. A task turns each candidate whose header states a
length into a pointer to the place behind that record. Within a part of a file pointers are followed at once, from the last candidate to
the first, which leaves each candidate a pointer to a later part. These pointers are jumped over all parts of all files, doubled in each
round, from the start of each file; a part's entry is the candidate that was reached. Then each task follows its part once more, from the entry:
what lies on the way are records, all other candidates are pieces of payloads and are put back into them. A record that goes on in a later
part, because its payload holds such lines across the border, is put together from its pieces after a shuffle of these alone. A chain
that doesn't end at the end of its file raises ValueError: nothing is dropped silently.

Entries are one row for each part of a file, about 128 MB of archive. Up to BROADCAST_PARTS of them are broadcast to the second pass; beyond, they
meet the pieces by a shuffle.

Defined results: null HTML is an empty payload; payloads under LEAST_BYTES are all responses; a null page_id stands as ``-`` in its record and is
read as null, is never the page that others revisit, and is a response; rows with equal payload and the smallest id are all responses;
line breaks and spaces in an URL are percent-encoded, a null URL is left out; an empty table gives an empty table; columns other
than page_id, url and html are not archived, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hairpin.plans.lineage import discard, shared_folder, store

LEAST_BYTES = 100
#: The line that begins a record.
MAGIC = "WARC/1.1\r\n"
#: Parts of files (rows of some 100 bytes) that are broadcast at most.
BROADCAST_PARTS = 100_000
#: Of every record: the archive is a function of its pages.
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_END = b"\r\n\r\n"


# --- writing ----------------------------------------------------------------------------------------------------------


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def copies(pages: DataFrame) -> DataFrame:
    """(digest, first): payloads that several pages have, and the smallest of their ids."""
    text = _payload(F.col("html"))
    long = pages.where((F.octet_length(text) >= LEAST_BYTES) & F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), _digest(text).alias("digest"))
    return long.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _named(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _url(url: Column) -> Column:
    for char, code in (("\r", "%0D"), ("\n", "%0A"), (" ", "%20")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def records(pages: DataFrame, groups: DataFrame) -> DataFrame:
    """(value): each page's record, from MAGIC on, without its last line feed, which the writer adds. ``groups``: see :func:`copies`."""
    text = _payload(F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("html"), _digest(text).alias("digest"), F.octet_length(text).alias("size"))
    rows = rows.join(groups, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    page = lambda c: F.concat(F.lit(f"<{_ID}"), c.cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit(MAGIC),
        _named("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _named("WARC-Record-ID", F.coalesce(page(F.col("page_id")), F.lit(f"<{_ID}->"))),
        _named("WARC-Date", F.lit(DATE)),
        _named("WARC-Target-URI", _url(F.col("url"))),
        _named("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _named("WARC-Refers-To", page(F.col("refers_to"))),
        _named("WARC-Profile", F.when(revisit, F.lit(REVISIT))),
        _named("Content-Type", F.lit("application/http; msgtype=response")),
        _named("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, http, F.when(revisit, F.lit("")).otherwise(F.col("html")), F.lit("\r\n\r")).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Writes the archives of ``pages`` as files in the folder ``path``."""
    groups = store(copies(pages))
    records(pages, groups).write.option("lineSep", "\n").text(path)
    discard(groups)


# --- boundaries -------------------------------------------------------------------------------------------------------


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, value): what stands between the lines that begin records, in order within each part of a file."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), "value")


def _parts(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[str, int, list[list]]]:
    """Each part of a file with the values of ``columns`` of its rows, which come one part after the other."""
    key, held = None, []
    for batch in batches:
        files, parts = batch.column("file").to_pylist(), batch.column("part").to_numpy(zero_copy_only=False)
        change = [0, *(i for i in range(1, batch.num_rows) if parts[i] != parts[i - 1] or files[i] != files[i - 1]), batch.num_rows]
        for a, b in zip(change[:-1], change[1:], strict=True):
            if a == b:
                continue
            own = (files[a], int(parts[a]))
            if own != key:
                if key:
                    yield *key, held
                key, held = own, []
            held.append([batch.column(c).slice(a, b - a) for c in columns])
    if key:
        yield *key, held


def _follow(sizes: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, last, leaves) of the candidates of a part, places counted from the part's first piece: the last record of the chain from
    each, and where that chain leaves the part; -1 where it breaks. ``spans``: bytes from a piece's begin to the next record's, -1 for none."""
    after = np.cumsum(sizes + len(MAGIC))
    at = after - sizes - len(MAGIC)
    total = int(after[-1])
    goal = np.where(spans >= 0, at + spans, -1)
    to = np.searchsorted(at, goal)
    within = (goal >= 0) & (goal < total)
    whole = within & (at[np.minimum(to, len(at) - 1)] == goal)
    last, leaves = np.arange(len(at)), np.where(goal >= total, goal, -1)
    for i in np.flatnonzero(whole)[::-1].tolist():
        last[i], leaves[i] = last[to[i]], leaves[to[i]]
    return at, at[last], leaves


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, bytes, at, last, leaves): the candidates of each part of a file, see :func:`_follow`; bytes: the part's."""
    header = F.substring_index("value", "\r\n\r\n", 1)
    length = F.regexp_extract(header, r"(?:^|\r\n)Content-Length: (\d{1,18})(?:\r\n|$)", 1).try_cast("long")
    # the header, its end, the block and the two line ends behind it, and the next record's first line
    span = F.when(F.octet_length(header) < F.octet_length("value"), F.octet_length(header) + length + 2 * len(_END) + len(MAGIC))
    rows = _pieces(spark, path).select("file", "part", F.octet_length("value").alias("size"), F.coalesce(span, F.lit(-1)).cast("long").alias("span"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, part, held in _parts(batches, ["size", "span"]):
            sizes, spans = (np.concatenate([h[i].to_numpy() for h in held]).astype(np.int64) for i in (0, 1))
            at, last, leaves = _follow(sizes, spans)
            total = int(sizes.sum()) + len(MAGIC) * len(sizes)
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), *[pa.array(x, pa.int64()) for x in (np.full(n, part), np.full(n, total), at, last, leaves)]], names=["file", "part", "bytes", "at", "last", "leaves"])

    return rows.mapInArrow(run, "file string, part long, bytes long, at long, last long, leaves long")


def entries(found: DataFrame) -> DataFrame:
    """(file, part, base, entry, owner): where the chain from a file's start enters each of its parts, null where it doesn't, and the
    record that the pieces before it belong to. ``found``: stored :func:`candidates`."""
    parts = found.groupBy("file", "part").agg(F.max("bytes").alias("bytes"))
    w = Window.partitionBy("file").orderBy("part")
    parts = store(parts.withColumns({"base": F.sum("bytes").over(w) - F.col("bytes"), "end": F.sum("bytes").over(Window.partitionBy("file"))}))
    there = found.join(parts.select("file", "part", "base", "end"), ["file", "part"])
    absolute = there.select("file", "part", (F.col("at") + F.col("base")).alias("at"), (F.col("last") + F.col("base")).alias("last"), F.when(F.col("leaves") >= 0, F.col("leaves") + F.col("base")).alias("to"), "end")
    # of all candidates, those that a chain can come to from an earlier part
    aims = absolute.select("file", F.col("to").alias("at")).where("at IS NOT NULL").distinct()
    first = len(MAGIC)  # behind the line that a file begins with
    jumps = store(absolute.join(aims, ["file", "at"], "left_semi").unionByName(absolute.where(f"at = {first}")).distinct())
    reached = jumps.where(f"at = {first}").select("file", "at")
    known, step, used = 0, jumps.select("file", "at", "to"), []
    while True:
        reached = store(reached.unionByName(reached.join(step, ["file", "at"]).select("file", F.col("to").alias("at"))).where("at IS NOT NULL").distinct())
        used.append(reached)
        now = reached.count()
        if now == known:
            break
        known = now
        step = store(step.join(step.select("file", F.col("at").alias("to"), F.col("to").alias("_to")), ["file", "to"]).select("file", "at", F.col("_to").alias("to")))
        used.append(step)
    on = jumps.join(reached, ["file", "at"], "left_semi")
    # a chain is whole if it comes to the end of its file
    ends = parts.select("file", "end").distinct().where(f"end > {first}")
    broken = ends.join(reached.select("file", F.col("at").alias("end")), ["file", "end"], "left_anti").limit(1).select("file").collect()
    if broken:
        raise ValueError(f"the records of {broken[0][0]} don't follow one another up to its end")
    marks = on.select("file", "part", F.col("at").alias("entry"), "last")
    out = parts.select("file", "part", "base").join(marks, ["file", "part"], "left")
    before = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = store(out.select("file", "part", "base", "entry", before.alias("owner")))
    discard(parts, jumps, *used)
    return out


# --- reading ----------------------------------------------------------------------------------------------------------

_FIELDS = "file string, at long, piece long, value binary"


def _whole_records(spark: SparkSession, path: str, where: DataFrame) -> DataFrame:
    """(file, at, piece, value): records as bytes without MAGIC; piece is null, or the place of a piece of a record that goes over a border."""
    rows = _pieces(spark, path).withColumn("value", F.col("value").cast("binary"))
    if where.count() <= BROADCAST_PARTS:
        rows = rows.join(F.broadcast(where), ["file", "part"])  # keeps the order of the rows
    else:
        rows = rows.withColumn("seq", F.monotonically_increasing_id()).join(where, ["file", "part"]).sortWithinPartitions("file", "part", "seq")
    rows = rows.select("file", "part", "base", "entry", "owner", "value")
    magic = MAGIC.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"key": None, "held": []}

        def done() -> list[tuple]:
            """What was put together of a record: all of it, or a piece."""
            if not state["held"]:
                return []
            whole = state["have"] == state["need"]
            return [(state["key"][0], state["owner"], None if whole else state["begin"], magic.join(state["held"]))]

        for batch in batches:
            out: list[tuple] = []
            values = batch.column("value")
            files, parts, bases, begins, owners = (batch.column(c).to_pylist() for c in ("file", "part", "base", "entry", "owner"))
            for i in range(batch.num_rows):
                if (files[i], parts[i]) != state["key"]:
                    out += done()
                    state = {"key": (files[i], parts[i]), "at": bases[i], "next": begins[i], "owner": owners[i], "begin": bases[i], "need": None, "have": 0, "held": []}
                value = values[i].as_py()
                if state["at"] == state["next"]:
                    out += done()
                    need = _span(value)
                    state |= {"owner": state["at"], "begin": state["at"], "next": state["at"] + need, "need": need, "have": 0, "held": []}
                if state["owner"] is not None:  # not so before a file's first line
                    state["held"].append(value)
                    state["have"] += len(value) + len(magic)
                state["at"] += len(value) + len(magic)
            if out:
                yield _batch(out)
        if out := done():
            yield _batch(out)

    return rows.mapInArrow(run, _FIELDS)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "at", "piece", "value"])


_LENGTH = re.compile(rb"(?:^|\r\n)Content-Length: (\d{1,18})(?:\r\n|$)")


def _span(piece: bytes) -> int:
    """Bytes from a record's begin, behind MAGIC, to the next one's."""
    header = piece[: piece.index(_END)]
    return len(header) + int(_LENGTH.search(header)[1]) + 2 * len(_END) + len(MAGIC)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, intact) of each record in the folder ``path``.

    payload is null for revisits, whose bytes and digest are those that the record states of its response. intact: the payload's digest is
    the one stated.
    """
    found = store(candidates(spark, path))
    where = entries(found)
    discard(found)
    return parsed(_joined(_whole_records(spark, path, where)))


def _joined(rows: DataFrame) -> DataFrame:
    """(value): records, those that come in pieces put together."""
    parted = rows.where("piece IS NOT NULL").groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("x"))
    line = F.lit(MAGIC).cast("binary")
    glued = F.aggregate("x", F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x.value).otherwise(F.concat(a, line, x.value)))
    return rows.where("piece IS NULL").select("value").unionByName(parted.select(glued.alias("value")))


def parsed(rows: DataFrame) -> DataFrame:
    """The fields of records given as bytes (value): see :func:`read`."""
    end, head = "\r\n\r\n", F.col("head")
    # both headers, that of the record and that of the response in it
    r = rows.withColumn("head", F.substring_index(F.col("value").cast("string"), end, 2)).withColumn("size", F.octet_length("head") + len(end))
    field = lambda name: F.nullif(F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    page = lambda c: F.regexp_extract(c, rf"^<{_ID}(-?\d+)>$", 1).try_cast("long")
    kind, http = field("WARC-Type"), F.substring_index(head, end, -1)
    stated = F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1)
    r = r.select(
        page(field("WARC-Record-ID")).alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        kind.alias("record_type"),
        page(field("WARC-Refers-To")).alias("refers_to"),
        F.when(kind == "response", F.expr(f"substring(value, size + 1, octet_length(value) - size - {len(end)})")).alias("payload"),
        F.regexp_extract(http, r"\r\nContent-Length: (\d+)$", 1).try_cast("long").alias("_bytes"),
        stated.alias("_digest"),
    )
    r = r.withColumn("payload_digest", F.coalesce(F.sha2("payload", 256), "_digest"))
    size = F.coalesce(F.octet_length("payload").cast("long"), "_bytes").alias("payload_bytes")
    return r.select("page_id", "url", "record_type", "refers_to", "payload", size, "payload_digest", (F.col("payload_digest") == F.col("_digest")).alias("intact"))


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, read back from archives in the shared folder, which are
    deleted then."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/hairpin-{uuid.uuid4().hex}"
    write(pages, path)
    out = store(read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    discard(spark.read.text(path))
    return out
