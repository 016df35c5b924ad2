"""WARC archives: writing, and reading by boundary-chain verification (operator 3).

Records are written by Spark's text writer, so files appear by its commit
protocol on whatever file system holds the shared folder.  The reader cuts files
into byte ranges.  Each task emits every place in its range that looks like a
record, with the place where the record would end.  Inside a range these links
are followed to the first one beyond it; across ranges pointer jumping, started at
offset 0 of each file, doubles the known chain every round.  Only records on the
chain are read, so magic bytes inside a payload never become records.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .shared import Scratch

MAGIC = b"WARC/1.1\r\n"
SEGMENT_BYTES, TASK_BYTES = 8 << 20, 128 << 20
HEADER_BYTES = 64 << 10  # read beyond a range at first; a longer header is read on to its end
RECORDS_PER_FILE = 50_000
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
_LINES = re.compile(rb"(?:[^\r\n]++\r\n)*+")  # whole lines with a text
_OPEN = re.compile(rb"[^\r\n]*+\r?")  # a line that may go on beyond the buffer
_DIGITS = re.compile(r"[0-9]{1,18}")


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record per row to the folder ``out``.

    Null html is an empty payload, a null url an empty target.  Of equal payloads
    with ``least_bytes`` or more, rows with the least id are responses and the others
    revisits of it, with an empty block; rows that repeat the least id are all
    responses, and a null id counts as larger than any other.  Ids are written
    url-encoded, and a null id as ``<urn:none>``; line breaks in a url become blanks.
    An empty table writes no record.
    """
    with Scratch(pages.sparkSession, "payloads") as scratch:
        _write_warc(scratch, pages, out, id_col, url_col, html_col, least_bytes, records_per_file)


def _write_warc(scratch: Scratch, pages: DataFrame, out: str, id_col: str, url_col: str, html_col: str, least_bytes: int, records_per_file: int) -> None:
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    digest = F.sha2(F.col("html"), 256).alias("digest")
    first = scratch.write(
        base.filter(F.octet_length("html") >= least_bytes).select("id", digest).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("twin"), "first"), "payloads"
    )
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    typed = base.withColumn("digest", digest).join(first, F.col("digest") == F.col("twin"), "left").withColumn("revisit", F.col("twin").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(F.col(c).cast("string")), F.lit(">")), F.lit("<urn:none>"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(head, F.lit("\r\n\r\n"), block)
    typed.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(out)


def _open(uri: str):
    """A random-access file of the folder that executors share."""
    from pyarrow import fs

    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:] if line)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


class _Bytes:
    """Bytes of a file from ``base`` on; the buffer is doubled while a header has no end yet."""

    def __init__(self, f, base: int, upto: int, size: int) -> None:
        self.f, self.base, self.size = f, base, size
        self.buffer = f.read_at(upto - base, base)

    def _grow(self) -> bool:
        at = self.base + len(self.buffer)
        more = self.f.read_at(min(self.size - at, max(HEADER_BYTES, len(self.buffer))), at) if at < self.size else b""
        self.buffer += more
        return bool(more)

    def lines_end(self, at: int) -> tuple[int, bool]:
        """Where the lines that begin at ``at`` end, and if a blank line ends them."""
        while True:
            at = _LINES.match(self.buffer, at).end()
            if self.buffer.startswith(b"\r\n", at):
                return at, True
            if _OPEN.match(self.buffer, at).end() < len(self.buffer) or not self._grow():
                return at, False

    def record(self, at: int) -> tuple[dict[str, str], int, int] | None:
        """(fields, where the block begins, its length) if a record begins at ``at``."""
        if self.buffer[at : at + len(MAGIC)] != MAGIC:
            return None
        end, blank = self.lines_end(at)
        fields = _fields(self.buffer[at:end]) if blank else {}
        length = fields.get("content-length", "")
        return (fields, end + 2, int(length)) if _DIGITS.fullmatch(length) and "warc-type" in fields else None

    def records(self, upto: int) -> Iterator[tuple[int, int]]:
        """(at, where the record would end) of all places before ``upto`` that look like a record.

        Magic bytes within the lines of another place end where that one ends, so each
        run of lines is read once.
        """
        at = self.buffer.find(MAGIC)
        while 0 <= at < upto:
            end, blank = self.lines_end(at)
            length, last = "", -1  # the last length counts; ``last`` is where a magic must end before
            if blank:
                spots: dict[bytes, tuple[int, bytes]] = {}
                spot = at
                for line in self.buffer[at:end].split(b"\r\n"):
                    key, _, value = line.partition(b":")
                    if (key := key.strip().lower()) in (b"content-length", b"warc-type"):
                        spots[key] = spot, value
                    spot += len(line) + 2
                if len(spots) == 2:
                    length = spots[b"content-length"][1].strip().decode("utf-8", "replace")
                    last = min(spot for spot, _ in spots.values())
            fits, stop = _DIGITS.fullmatch(length) is not None, min(upto, max(end, at + 1))
            while 0 <= at < stop:
                if fits and at + len(MAGIC) <= last:
                    yield at, end + 2 + int(length) + 4
                at = self.buffer.find(MAGIC, at + 1)


def candidates(segments: DataFrame) -> DataFrame:
    """(path, seg, off, leaves): candidate records of each byte range and where their chain leaves it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, seg, low, high, size in frame[["path", "seg", "low", "high", "size"]].itertuples(index=False):
                with _open(path) as f:
                    ends = {low + at: low + end for at, end in _Bytes(f, low, min(size, high + HEADER_BYTES), size).records(high - low)}
                for off in sorted(ends, reverse=True):  # a later link is already followed to its end
                    if ends[off] < high:
                        ends[off] = ends.get(ends[off], -1)
                yield pd.DataFrame({"path": path, "seg": seg, "off": list(ends), "leaves": list(ends.values())}).astype({"off": "int64", "leaves": "int64"})

    return segments.mapInPandas(run, "path string, seg long, off long, leaves long")


def chain(scratch: Scratch, found: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """(path, off): the entries of ranges that are reachable from offset 0, by pointer jumping."""
    reached = starts.select("path", F.lit(0).cast("long").alias("off"))
    entry = found.select("path", F.col("leaves").alias("off")).distinct().unionByName(reached).distinct()
    jump = scratch.write(found.join(entry, ["path", "off"]).select("path", "off", F.col("leaves").alias("to")), "jumps")
    span = 1
    while span <= longest:
        reached = scratch.write(reached.join(jump, ["path", "off"]).select("path", F.col("to").alias("off")).unionByName(reached).distinct(), "reached")
        span *= 2
        if span <= longest:
            after = jump.select("path", F.col("off").alias("to"), F.col("to").alias("next"))
            jump = scratch.write(jump.join(after, ["path", "to"]).select("path", "off", F.col("next").alias("to")), "jumps")
    return reached


def read_warc(spark: SparkSession, path: str, segment_bytes: int = SEGMENT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records on each file's chain: path, off, type, record_id, refers_to, uri, digest, length, sha256 and payload.

    Headers may have any length.  A chain ends at the file's end; a place before it that
    isn't a whole record raises ``ValueError``.
    Empty files and folders without records give no rows.
    """
    with Scratch(spark, "chain") as scratch:
        todo = scratch.write(_entries(scratch, spark, path, segment_bytes), "entries", keep=True)
    todo = todo.repartition(tasks(todo.agg(F.count(F.lit(1)), F.sum(F.col("high") - F.col("off"))).first(), spark), "path", "off")
    return _records(todo, with_payload)


def tasks(sized: tuple[int, int], spark: SparkSession) -> int:
    """Tasks for so many ranges and bytes: about TASK_BYTES each, but the usual parallelism at least."""
    ranges, total = sized[0], sized[1] or 0
    return max(1, min(ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))))


def _entries(scratch: Scratch, spark: SparkSession, path: str, segment_bytes: int) -> DataFrame:
    """(path, off, high, size): where the records of each byte range begin."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    segments = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / segment_bytes) - 1)).alias("seg")).select(
        "path", "size", F.col("seg").cast("long").alias("seg"), (F.col("seg") * segment_bytes).cast("long").alias("low"), F.least(F.col("size"), (F.col("seg") + 1) * segment_bytes).cast("long").alias("high")
    )
    segments = scratch.write(segments, "segments")
    longest, *sized = segments.agg(F.max("seg"), F.count(F.lit(1)), F.sum(F.col("high") - F.col("low"))).first()
    spread = segments.repartition(tasks(sized, spark), "path", "seg")
    found = scratch.write(candidates(spread), "candidates")
    entries = chain(scratch, found, segments.filter("seg = 0").select("path"), longest or 0)
    return entries.withColumn("seg", F.floor(F.col("off") / segment_bytes)).join(segments, ["path", "seg"]).filter(F.col("off") < F.col("size")).select("path", "off", "high", "size")


def _records(todo: DataFrame, with_payload: bool) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for path, off, high, size in frame[["path", "off", "high", "size"]].itertuples(index=False):
                with _open(path) as f:
                    data, begin = _Bytes(f, off, min(size, high + HEADER_BYTES), size), off
                    rows, held = [], 0
                    while off < high:
                        if (r := data.record(off - begin)) is None:
                            raise ValueError(f"{path}: no record at byte {off} of {size}")
                        fields, at, length = r
                        payload = data.buffer[at : at + length]
                        if len(payload) < length:  # the block may begin beyond the buffer's end
                            there = begin + at + len(payload)
                            payload += f.read_at(min(length - len(payload), size - there), there) if there < size else b""
                        if len(payload) < length:
                            raise ValueError(f"{path}: the record at byte {off} of {size} is cut off")
                        rows.append((path, off, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), length, hashlib.sha256(payload).hexdigest(), payload if with_payload else None))
                        held += at - (off - begin) + length * with_payload
                        off = begin + at + length + 4
                        if held > 4 << 20 or len(rows) >= 5_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    names = ["path", "off", "type", "record_id", "refers_to", "uri", "digest", "length", "sha256", "payload"]
    return todo.mapInPandas(run, "path string, off long, type string, record_id string, refers_to string, uri string, digest string, length long, sha256 string, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits resolved: page id (null for a null id), full payload bytes and digest, type and refers_to."""
    page = lambda c: F.when(F.col(c).startswith("<urn:page:"), F.url_decode(F.regexp_extract(F.col(c), r"^<urn:page:(.*)>$", 1)))
    rows = records.select("type", page("record_id").alias("page"), page("refers_to").alias("of"), "digest", "length", "sha256")
    rows = Scratch(records.sparkSession, "records").write(rows, "records", keep=True)
    own = rows.filter("type != 'revisit'").select("page", F.col("length").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("string").alias("refers_to"))
    again = rows.filter("type = 'revisit'").select("page", "of", F.regexp_replace("digest", "^sha256:", "").alias("payload_digest"))
    whole = own.select(F.col("page").alias("of"), "payload_bytes", "payload_digest").distinct()
    back = again.join(whole, ["of", "payload_digest"], "left").select("page", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("of").alias("refers_to"))
    return own.unionByName(back)


def round_trip(pages: DataFrame, id_col: str = "page_id", **named) -> DataFrame:
    """Write ``pages`` to a scratch folder and read the archives back, per page."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType
    with Scratch(spark, "warc") as scratch:
        out = scratch.path("archives")
        write_warc(pages, out, id_col, **named)
        back = resolved(read_warc(spark, out, with_payload=False))
    return back.withColumns({id_col: F.col("page").cast(kind), "refers_to": F.col("refers_to").cast(kind)}).select(id_col, "payload_bytes", "payload_digest", "record_type", "refers_to")
