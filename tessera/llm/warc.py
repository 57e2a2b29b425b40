"""WARC archives: a writer with one gzip member a record, and a salvage reader.

The reader checks each record: gzip trailer, version line, headers, Content-Length, the blank lines after
the block, and the payload digest. After a failed check it searches for the next gzip member or version
line from which a record passes, goes on there, and logs the bytes between as a quarantined gap with
file, offsets and reason. Plain and compressed archives, and mixtures of both, are read, with any number of records
a member:

* The search for the next version line also runs inside a member's unpacked bytes, so one bad record there costs
  itself; its gap has the member's offsets and those within its unpacked bytes (inner_start, inner_stop).
* Of a member that is cut off, or whose packed bytes or trailer are damaged, all that could be unpacked is read,
  but only records whose payload digest is there and matches are kept, as the trailer vouches for none. The rest of
  the member is a gap.

A member is unpacked in blocks of UNPACKED packed bytes and searched once, so reading is linear in the archive. An
archive is one value of a task (a file of up to 2 GB), beside which the task holds one member's unpacked bytes.

Archives are written and read through Spark's file systems: the packed members of an archive are one
value of at most ARCHIVE_BYTES (or one record, if that is longer), written as bytes; an empty member ends
each file, as the text writer wants a line end.

Defined results: a null html is an empty payload; rows with equal page_id and payload are all responses,
as each is the smallest; a null page_id is a response; an empty table gives no archive and no row;
further columns of the input are ignored. A revisit whose response was lost keeps its digest and gets a
null length.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch_path, table, written

#: Packed bytes of an archive.
ARCHIVE_BYTES = 8 << 20
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
UNPACKED = 1 << 16
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
RECORD = "kind string, file string, start long, stop long, inner_start long, inner_stop long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def member(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes, level: int = 4) -> bytes:
    """A record as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    clean = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    record = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at this offset and the offset after it. Raises ValueError with the check that failed."""
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    body = data.find(b"\r\n\r\n", at)
    if body < 0:
        raise ValueError("headers don't end")
    fields = {}
    for line in data[at:body].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no length")
    start, stop = body + 4, body + 4 + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("block doesn't end where its length says")
    block = data[start:stop]
    payload = block[block.find(b"\r\n\r\n") + 4 :] if fields.get("content-type", "").startswith("application/http") and b"\r\n\r\n" in block else block
    kind = fields.get("warc-type", "")
    digest, own = fields.get("warc-payload-digest", "").removeprefix("sha256:"), hashlib.sha256(payload).hexdigest()
    if kind != "revisit" and digest and digest != own:
        raise ValueError("payload digest differs")
    return {"fields": fields, "type": kind, "payload": payload, "digest": digest or own, "proven": digest == own}, stop + 4


def _unpacked(data: memoryview, at: int) -> tuple[bytearray, int, str]:
    """The unpacked bytes of the gzip member at this offset, the offset after it, and what is wrong with it, if
    anything; then the offset doesn't count and the bytes are all that come before the fault."""
    unpacker, out, pos = zlib.decompressobj(31), bytearray(), at
    while not unpacker.eof and pos < len(data):
        block = data[pos : pos + UNPACKED]
        try:
            out += unpacker.decompress(block)
        except zlib.error as e:  # once a damaged member: byte by byte up to the fault
            again = zlib.decompressobj(31)
            for start in range(at, pos, UNPACKED):
                again.decompress(data[start : min(start + UNPACKED, pos)])
            try:
                for k in range(len(block)):
                    out += again.decompress(block[k : k + 1])
            except zlib.error:
                pass
            return out, at, f"gzip: {e}"
        pos += len(block)
    if not unpacker.eof:
        return out + unpacker.flush(), at, "gzip member is cut off"
    return out, pos - len(unpacker.unused_data), ""


def _records(plain: bytes, digests: bool) -> Iterator[tuple[int, int, dict | str]]:
    """(start, stop, record or what failed) of unpacked bytes, in order; with digests, only records that have one."""
    at, gap, reason = 0, None, ""
    while at < len(plain):
        try:
            record, stop = parse_record(plain, at)
            if digests and not record["proven"]:
                raise ValueError("no digest in a damaged member")
        except ValueError as e:
            if gap is None:
                gap, reason = at, str(e)
            found = plain.find(VERSION, at + 1)
            at = found if found >= 0 else len(plain)
            continue
        if gap is not None:
            yield gap, at, reason
            gap = None
        yield at, stop, record
        at = stop
    if gap is not None:
        yield gap, len(plain), reason


class _Search:
    """The next place of a mark from an offset on; offsets only grow, so all bytes are searched once."""

    def __init__(self, data: bytes, mark: bytes) -> None:
        self.data, self.mark, self.at = data, mark, -1

    def after(self, at: int) -> int:
        if self.at <= at:
            found = self.data.find(self.mark, at + 1)
            self.at = found if found >= 0 else len(self.data)
        return self.at


def salvage(data: bytes) -> Iterator[tuple[str, int, int, int | None, int | None, object]]:
    """("record", start, stop, inner start, inner stop, record) and ("gap", ..., reason), in order of offset; inner
    offsets are those in a member's unpacked bytes, null outside of members. A damaged member's stop is the place
    where reading goes on."""
    view, magic, version = memoryview(data), _Search(data, MAGIC), _Search(data, VERSION)
    at, gap, reason = 0, None, ""
    while at < len(data):
        fault, rows, stop = "", [], at
        if data.startswith(MAGIC, at):
            plain, stop, fault = _unpacked(view, at)
            rows = [("gap" if isinstance(x, str) else "record", start, end, x) for start, end, x in _records(bytes(plain), bool(fault))]
            if fault:
                stop = min(magic.after(at), version.after(at))
                good = [r[2] for r in rows if r[0] == "record"]
                rows = [r for r in rows if good and r[1] < good[-1]]
                if good:
                    rows.append(("gap", good[-1], len(plain), fault))
            elif rows and all(r[0] == "gap" for r in rows):
                fault, rows, stop = rows[0][3], [], min(magic.after(at), version.after(at))
        else:
            try:
                record, stop = parse_record(data, at)
                rows = [("record", None, None, record)]
            except ValueError as e:
                fault, stop = str(e), min(magic.after(at), version.after(at))
        if fault and not rows:
            if gap is None:
                gap, reason = at, fault
        else:
            if gap is not None and (rows or stop == len(data)):
                yield "gap", gap, at, None, None, reason
                gap = None
            for kind, start, end, x in rows:
                yield kind, at, stop, start, end, x
        at = stop
    if gap is not None:
        yield "gap", gap, len(data), None, None, reason


def with_types(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which records revisit which. Only ids and digests are
    shuffled; the few revisits are a written table, so that Spark knows its size and broadcasts it only below
    its threshold."""
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = full.where(F.length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").drop("last")
    revisits = written(long.join(firsts, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct(), "warc-revisits")
    return full.join(revisits, ["page_id", "digest"], "left")


def write(pages: DataFrame, path: str) -> None:
    """Archives of all pages below path."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                kind = "response" if row["refers_to"] is None else "revisit"
                members.append(member(row["page_id"], row["url"], kind, row["refers_to"], row["digest"], row["payload"]))
                size += len(members[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.record_batch([pa.array([b"".join(members)], pa.binary())], ["value"])
                    members, size = [], 0
        if members:
            yield pa.record_batch([pa.array([b"".join(members)], pa.binary())], ["value"])

    archives = with_types(pages).mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    archives.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdigit() else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps of the archives below path; with payloads, their bytes as well."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, data, rows = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), []
                for kind, *place, x in salvage(data):
                    if kind == "gap":
                        rows.append(("gap", name, *place, x, None, None, None, None, None, None, None))
                    else:
                        f, revisit = x["fields"], x["type"] == "revisit"
                        rows.append(("record", name, *place, None, _page(f.get("warc-record-id", "")), f.get("warc-target-uri"), x["type"], _page(f.get("warc-refers-to", "")) if revisit else None, None if revisit else len(x["payload"]), x["digest"], x["payload"] if payloads else None))
                    if len(rows) >= 1024:
                        yield batched(rows)
                        rows = []
                if rows:
                    yield batched(rows)

    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"]
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(scan, f"{RECORD}, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Records with the lengths of revisits taken from the responses they refer to."""
    answers = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("found"))
    revisits = records.where("record_type = 'revisit'").join(answers, ["refers_to", "payload_digest"], "left").withColumn("payload_bytes", F.col("found")).select(records.columns)
    return records.where("record_type <> 'revisit'").unionByName(revisits)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    write(pages, path)
    if not pages.take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    records = written(read(spark, path).where("kind = 'record'").drop("payload"), "warc-records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
f as (select *, case when n >= {REVISIT_BYTES} then min(page_id) over (partition by digest) end as first_id from p)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
    case when page_id > first_id then 'revisit' else 'response' end as record_type,
    case when page_id > first_id then first_id end as refers_to
from f
"""
