"""WARC archives: writing pages as segmented records, and reading archives back with segment reassembly.

Writing: each page is a response record, or a revisit of the response with an equal payload and the smallest page_id. A response's
block is an HTTP message whose body is chunked; a block over SEGMENT bytes is split into a response record with segment number 1 and
continuation records, the last of which tells the total length. Urls are percent-encoded as UTF-8 where they aren't printable ASCII (none: urn:none). Every record is a gzip member of its own. A Spark task
writes the archives of its partition under names of its attempt and returns them; the table of these names, which Spark commits for one attempt of each
task only, tells which archives are then renamed into place. So a task that runs again or twice leaves no second record, in
whatever order it gets its rows. Files are written through pyarrow's file systems (local, HDFS, object stores).

Reading: archives (.warc, .warc.gz) come through Spark's binary file reader and are walked by offset, a few kilobytes at a time; a gzip member may
hold several records. Records without continuation are decoded where they are read. Others are grouped by origin identifier, ordered by segment
number, checked against the total length, and decoded.

Defined results: null html is an empty payload. Payloads shorter than min_revisit bytes are always responses. Rows that repeat a
page_id are records of their own: those with the same payload and page_id as the response are responses too. Rows with a null page_id
are responses. A table without rows gives no archives and no rows. Records that lack a segment or whose length is wrong are returned
with ok = false and a null payload. A stretch of an archive that can't be read gives one row with ok = false and what its headers still tell, and
reading goes on at the next gzip member or record that can be read. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, met, parted, remove, scratch, stored

SEGMENT = 16_384
CHUNK = 4_096
#: Bytes after which a task begins its next archive.
ARCHIVE = 16 << 20
#: Characters of a url that stand for themselves in a header.
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
DATE = "2024-01-01T00:00:00Z"  # a fixed value, so that archives don't depend on when they are written


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """body in chunked transfer framing."""
    out = [b"%x\r\n%s\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    """The body of chunked framing; extensions and trailers are skipped. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        n = int(data[at:end].split(b";")[0].strip(), 16)
        if n < 0:
            raise ValueError("chunk of negative size")
        at = end + 2
        if n == 0:
            return b"".join(out)
        if len(data) < at + n + 2 or data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(data[at : at + n])
        at += n + 2


def _clean(url) -> str:
    """A header's form of a url: trimmed, and what isn't printable ASCII percent-encoded as UTF-8."""
    return quote((url or "").strip(), safe=PRINTABLE) or "urn:none"


def page_records(rid: str, page_id, url, payload: bytes, original, segment: int = SEGMENT):
    """The WARC records of one page. original: the page_id it revisits, or None."""
    digest = digest32(payload)
    named = [("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        named.append(("X-Page-Id", str(page_id)))
    if original is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield record("revisit", rid, [*named, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(original))], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record("response", rid, named, block)
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record("response", rid, [*named, ("WARC-Segment-Number", "1")], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
        yield record("continuation", f"{rid}:{k}", [("WARC-Segment-Origin-ID", f"<{rid}>"), ("WARC-Segment-Number", str(k)), *last], part)


def originals(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(_rev, original): the pages that revisit another and the smallest page_id with the same payload."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = stored(pages.filter("page_id is not null").select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")).filter(F.col("n") >= min_revisit), "digests")
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("original"), F.max("page_id").alias("last"), F.count("*").alias("size")).filter("original < last").drop("last")
    return met(keyed, stored(first, "originals"), ["digest"]).filter("page_id <> original").select(F.col("page_id").alias("_rev"), "digest", "original").distinct()


def write_archives(pages: DataFrame, path: str, min_revisit: int = 0, segment: int = SEGMENT) -> None:
    """Write pages (page_id, url, html) as .warc.gz files below path."""
    rev = stored(originals(pages, min_revisit), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    # only pages that may be revisits are shuffled
    maybe, rest = parted(rows, "page_id", rev, "_rev")
    body = F.sha2(F.encode(F.coalesce("html", F.lit("")), "utf-8"), 256)
    maybe = maybe.withColumn("_sha", body).join(rev.hint("merge"), (F.col("page_id") == F.col("_rev")) & (F.col("_sha") == F.col("digest")), "left").select("page_id", "url", "html", "original")
    rows = maybe.union(rest.withColumn("original", F.lit(None).cast("long")))

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(f"{base}/_attempts", recursive=True)
        out, size, k, n = None, 0, 0, 0
        named = []

        pack = lambda x: (c := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(x) + c.flush()
        for batch in batches:
            for page_id, url, html, original in zip(*(c.to_pylist() for c in batch.columns)):
                rid = f"urn:page:{part}:{n}:{page_id}"
                n += 1
                for rec in page_records(rid, page_id, url, (html or "").encode(), original, segment):
                    if out is None:
                        named.append((f"part-{part:06d}-{attempt}-{k:05d}.warc.gz", f"part-{part:06d}-{k:05d}.warc.gz"))
                        out, size, k = store.open_output_stream(f"{base}/_attempts/{named[-1][0]}", compression=None), 0, k + 1
                    member = pack(rec)
                    out.write(member)
                    size += len(member)
                    if size >= ARCHIVE:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in named], pa.string()) for i in (0, 1)], ["written", "name"])

    def place(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        there = lambda name: store.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound
        for batch in batches:
            for written, name in zip(*(c.to_pylist() for c in batch.columns)):
                if there(f"_attempts/{written}"):
                    store.move(f"{base}/_attempts/{written}", f"{base}/{name}")
                elif not there(name):
                    raise FileNotFoundError(f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    kept = stored(rows.mapInArrow(write, "written string, name string"), "archives")
    kept.mapInArrow(place, "n long").agg(F.sum("n")).collect()
    if exists(pages.sparkSession, f"{path}/_attempts"):
        remove(pages.sparkSession, f"{path}/_attempts")


MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that are decompressed at a time.
STEP = 1 << 16
#: Key of a header line that no archive can hold: the record couldn't be read whole.
BROKEN = ":broken"


def _member(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """(content, end, whether it is whole) of the gzip member at at; of one that breaks off, what can be read."""
    start, step, view = at, STEP, memoryview(data)
    z, out = zlib.decompressobj(31), []
    while not z.eof and at < len(data):
        try:
            out.append(z.decompress(view[at : at + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), at, False
            z, out, fault, step = zlib.decompressobj(31), [], at, 1  # once more, byte by byte where it fails
            for at in range(start, fault, STEP):
                out.append(z.decompress(view[at : min(fault, at + STEP)]))
            at = fault
            continue
        at += min(step, len(data) - at)
    return b"".join(out), at - len(z.unused_data), z.eof


NEXT = re.compile(rb"(?:^|\r\n)WARC/[0-9]")


def _records(raw: bytes):
    """Yield (headers, block) of the records that follow one another in raw."""
    at = 0
    while at < len(raw):
        found = NEXT.search(raw, at)
        start = len(raw) if found is None else found.end() - 6
        if raw[at:start].strip():
            yield {BROKEN: ""}, b""
        if found is None:
            return
        end = raw.find(b"\r\n\r\n", start)
        head, block, at = {}, b"", len(raw)
        for line in raw[start : end if end >= 0 else None].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        size = head.get("content-length", "")
        if end < 0 or not size.isdecimal():
            head[BROKEN] = ""
            after = NEXT.search(raw, start + 6)
            at = len(raw) if after is None else after.start()
        else:
            at = end + 4 + int(size)
            block = raw[end + 4 : at]
            if len(block) < int(size):
                head[BROKEN] = ""
        yield head, block


def parse_archive(data: bytes):
    """Yield (headers, block) of each record of an archive; the headers of what can't be read whole have the key BROKEN."""
    if not data.startswith(MAGIC) and NEXT.match(data):
        yield from _records(data)
        return
    at, lost = 0, False
    while at < len(data):
        if not data.startswith(MAGIC, at):
            if not lost:
                yield {BROKEN: ""}, b""
            lost, at = True, data.find(MAGIC, at)
            if at < 0:
                return
        raw, end, whole = _member(data, at)
        if whole:
            yield from _records(raw)
            lost, at = False, end
            continue
        found = list(_records(raw)) if NEXT.search(raw) else []
        yield from found[:-1]
        if found:
            yield found[-1][0] | {BROKEN: ""}, found[-1][1]
        elif not lost:
            yield {BROKEN: ""}, b""
        lost, at = True, data.find(MAGIC, at + 1)
        if at < 0:
            return


FIELDS = "rid string, page_id long, url string, record_type string, refers_to long, digest string, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below path; rid is the origin's identifier for continuations, broken tells what can't be read whole."""

    def parse(batches):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
        names = [*(x.split()[0] for x in FIELDS.split(", ")), "broken"]
        number = lambda h, k: int(h[k]) if h.get(k, "").isdecimal() and len(h[k]) < 10 + 9 * (k[:2] == "x-") else None
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for h, block in parse_archive(data.as_py()):
                    rid = h.get("warc-segment-origin-id") or h.get("warc-record-id", "")
                    digest = h.get("warc-payload-digest", "")
                    rows.append((rid.strip("<>"), number(h, "x-page-id"), h.get("warc-target-uri"), h.get("warc-type"), number(h, "x-refers-to-page"), digest[5:] if digest.startswith("sha1:") else None, number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), block, BROKEN in h))
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    return files.select("content").mapInArrow(parse, FIELDS + ", broken boolean")


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: continuation records are joined to their origin in the order of their segment numbers; ok tells if none is missing."""
    fine = ~F.col("broken") if "broken" in records.columns else F.lit(True)
    records = records.withColumn("fine", fine)
    whole = records.filter("segment is null").select("rid", "page_id", "url", "record_type", "refers_to", "digest", "block", F.col("fine").alias("ok"))
    parts = records.filter("segment is not null").groupBy("rid").agg(
        *(F.max(c).alias(c) for c in ("page_id", "url", "refers_to", "digest", "total")),
        F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"), F.min("fine").alias("fine"))
    # a binary column has no aggregate that joins: as Latin-1 text, which maps bytes to characters one by one
    numbered = F.aggregate("parts", F.struct(F.lit(0).alias("k"), F.lit(True).alias("ok")), lambda s, p: F.struct((s["k"] + 1).alias("k"), (s["ok"] & (p["segment"] == s["k"] + 1)).alias("ok")))
    block = F.encode(F.array_join(F.transform("parts", lambda p: F.decode(p["block"], "ISO-8859-1")), ""), "ISO-8859-1")
    joined = parts.select("rid", "page_id", "url", "record_type", "refers_to", "digest", block.alias("block"), "total", (numbered["ok"] & F.col("fine")).alias("ok"))
    joined = joined.withColumn("ok", F.col("ok") & F.col("record_type").isNotNull() & F.coalesce(F.col("total") == F.octet_length("block"), F.lit(False))).drop("total")
    return whole.union(joined.select(*whole.columns))


def decode(whole: DataFrame, keep_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, ok and, if wanted, payload. Bytes and digest of a revisit are those it was recorded with."""
    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, ok boolean" + ", payload binary" * keep_payload

    def run(batches):
        for batch in batches:
            sizes, digests, oks, payloads = [], [], [], []
            for kind, digest, block, ok in zip(*(batch.column(c) for c in ("record_type", "digest", "block", "ok"))):
                kind, digest, data, ok = kind.as_py(), digest.as_py(), block.as_py(), ok.as_py()
                payload, n = None, None
                head, _, body = data.partition(b"\r\n\r\n")
                fields = dict(x.lower().split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
                try:
                    if ok and kind == "revisit":
                        n = int(fields.get(b"content-length", 0))
                    elif ok:
                        payload = dechunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                        n, found = len(payload), digest32(payload)
                        ok = digest is None or found == digest
                        digest = found
                except ValueError:
                    ok = False
                sizes.append(n)
                digests.append(digest)
                oks.append(ok)
                payloads.append(payload if ok else None)
            cols = [batch.column("page_id"), batch.column("url"), batch.column("record_type"), batch.column("refers_to"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(oks, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(payloads, pa.binary())] * keep_payload, ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "ok"] + ["payload"] * keep_payload)

    return whole.mapInArrow(run, ddl)


def round_trip(pages: DataFrame, min_revisit: int = 0, segment: int = SEGMENT, keep_payload: bool = False) -> DataFrame:
    """Write pages as archives below the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, min_revisit, segment)
    if not exists(spark, path):
        return decode(spark.createDataFrame([], FIELDS).drop("segment", "total").withColumn("ok", F.lit(True)), keep_payload)
    return decode(reassemble(read_records(spark, path)), keep_payload)
