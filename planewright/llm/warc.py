"""WARC archives: pages written as (segmented, chunked) records, and records put together again.

Of pages with equal payloads one is a response record and the others revisit it. A block longer than
the segment size is split: the first record carries segment number 1, continuation records name the
first as their origin, and the last one states the total length. Reading groups the segments of an
origin, orders them by number, checks the total length and takes the chunked transfer framing off.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planewright.llm.common import HOT, HOT_ROWS, shared_folder, with_keys, written

#: Blocks are split into records of so many bytes.
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
#: Payloads from this size on are deduplicated.
REVISIT_BYTES = 1000
#: A task starts another file after so many compressed bytes.
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
HTTP = {"Content-Type": "application/http; msgtype=response"}


# ------------------------------------------------------------------------------ framing


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """An HTTP response's payload, out of its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record(fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def records(stream: io.IOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of a plain or gzipped archive, a seekable file."""
    packed = stream.read(2) == b"\x1f\x8b"
    stream.seek(0)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream) if packed else stream, 1 << 18)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends inside a record")
        yield fields, block


def page_records(page_id: object, url: str | None, payload: bytes, digest: str, segment: int) -> tuple[str, list[bytes]]:
    """Record id and records of a response, in one or more segments; ids are new each time."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    base, paid = _common(page_id, url), {"WARC-Payload-Digest": f"sha1:{digest}"}
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return own, [record({"WARC-Type": "response", "WARC-Record-ID": own, **base, **paid, **HTTP}, block)]
    out = []
    for k, at in enumerate(range(0, len(block), segment), 1):
        last = {"WARC-Segment-Total-Length": len(block)} if at + segment >= len(block) else {}
        part = {"WARC-Segment-Number": k, **last}
        if k == 1:
            out.append(record({"WARC-Type": "response", "WARC-Record-ID": own, **base, **paid, **part, **HTTP}, block[:segment]))
        else:
            out.append(record({"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Segment-Origin-ID": own, **base, **part}, block[at : at + segment]))
    return own, out


def revisit_record(page_id: object, url: str | None, size: int, digest: str, target: str) -> bytes:
    """A revisit of the response whose record id is ``target``."""
    more = {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Refers-To": target, "WARC-Profile": PROFILE, "X-Payload-Length": size}
    return record({"WARC-Type": "revisit", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", **_common(page_id, url), **more, **HTTP}, HEAD + b"\r\n")


def _common(page_id: object, url: str | None) -> dict[str, object]:
    return {"WARC-Target-URI": (url or "").replace("\r", " ").replace("\n", " ") or None, "WARC-Date": DATE, "X-Page-Id": page_id}


class Archives:
    """Gzipped archives of one task attempt, under names of their own; a new file after so many bytes."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.folder, self.fs, self.out = folder, fs.FileSystem, None
        self.paths: list[str] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        if self.out is None or self.size >= FILE_BYTES:
            self.close()
            files, where = self.fs.from_uri(f"{self.folder}/{uuid.uuid4().hex}.warc.gz")
            files.create_dir(where.rpartition("/")[0])
            self.out, self.size = files.open_output_stream(where, compression=None, buffer_size=1 << 20), 0
            self.paths.append(f"{self.folder}/{where.rpartition('/')[2]}")
            self.counts.append(0)
        deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
        data = deflate.compress(data) + deflate.flush()
        self.out.write(data)
        self.size += len(data)
        self.counts[-1] += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


# ------------------------------------------------------------------------------ Spark


def write_archives(pages: DataFrame, folder: str | None = None, segment: int = SEGMENT_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzipped archives; returns their table (path, n_records).

    Page ids are integers (others count as null). Null html is an empty payload, a null url leaves its
    field out; rows that repeat a page id with the same payload are all responses, of which revisits
    name one; a page without an id counts as the smallest of its group; very long pages go in segments;
    an empty table gives no archive; further columns are ignored. Responses are written first and tell
    their record ids, then the revisits that refer to them. Each attempt of a task writes files of its
    own names and the table lists those of the accepted attempts.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    slim = pages.select(F.expr("try_cast(page_id AS bigint)").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    slim = slim.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = written(slim.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1"), "groups")
    total = int(groups.agg(F.sum("n")).first()[0] or 0)
    again = "page_id IS NULL AND target IS NOT NULL OR page_id <> target"
    alone = slim.join(F.broadcast(groups.filter(F.col("n") > max(HOT_ROWS, total // HOT)).drop("n")), "digest", "left").withColumn("hot", F.col("target").isNotNull())
    marked = alone.filter("hot").unionByName(alone.filter("NOT hot").drop("target").join(groups.filter(F.col("n") <= max(HOT_ROWS, total // HOT)).drop("n"), "digest", "left"))
    first = marked.filter(f"NOT coalesce({again}, false)").select("page_id", "url", "payload", "digest", F.col("target").isNotNull().alias("named"))

    def responses(batches: Iterator) -> Iterator:
        import pyarrow as pa

        archives = Archives(folder)
        for batch in batches:
            named = ([], [])
            for page_id, url, payload, digest, is_target in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                own, parts = page_records(page_id, url, payload, digest, segment)
                for data in parts:
                    archives.add(data)
                if is_target:
                    named[0].append(digest)
                    named[1].append(own)
            if named[0]:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(named[0]), pa.string()), pa.nulls(len(named[0]), pa.int64()), *map(pa.array, named)], ["path", "n_records", "digest", "record"])
        archives.close()
        if archives.paths:
            n = len(archives.paths)
            yield pa.RecordBatch.from_arrays([pa.array(archives.paths), pa.array(archives.counts, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], ["path", "n_records", "digest", "record"])

    def revisits(batches: Iterator) -> Iterator:
        import pyarrow as pa

        archives = Archives(folder)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                archives.add(revisit_record(*row))
        archives.close()
        if archives.paths:
            yield pa.RecordBatch.from_arrays([pa.array(archives.paths), pa.array(archives.counts, pa.int64())], ["path", "n_records"])

    done = written(first.mapInArrow(responses, "path string, n_records long, digest string, record string"), "responses")
    known = done.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("record").alias("record"))
    targets = written(groups.join(known, "digest"), "targets")
    light = slim.filter(F.col("size") >= least).select("page_id", "url", F.col("size").cast("long").alias("size"), "digest")
    later = with_keys(light, targets, "digest", total).filter(again).select("page_id", "url", "size", "digest", "record")
    table = written(later.mapInArrow(revisits, "path string, n_records long"), "revisits")
    return done.filter("path IS NOT NULL").select("path", "n_records").unionByName(table)


def read_archives(spark: SparkSession, table: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of the archives in ``table.path``.

    Every archive is read once. Segments of a record are put together wherever they stand; a record
    whose segments don't add up to the stated length, or whose digest differs from the stated one,
    fails the query. ``refers_to`` is the page of the record that a revisit names, null if no archive
    has it.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    paths = table.select("path").repartition(n, "path")
    fields = [("kind", "string"), ("record", "string"), ("refers", "string"), ("number", "int"), ("total", "long"), ("page_id", "long"), ("url", "string"), ("payload_bytes", "long"), ("payload_digest", "string"), ("payload", "binary")]

    def batch_of(rows: list[tuple]):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])

    def number(x: str | None) -> int | None:
        return int(x) if x not in (None, "None") else None

    def checked(page: int | None, block: bytes, stated: str | None) -> tuple[int, str, bytes]:
        payload = payload_of(block)
        digest = hashlib.sha1(payload).hexdigest()
        if stated and stated != digest:
            raise ValueError(f"page {page}: the payload's digest is {digest}, not {stated}")
        return len(payload), digest, payload

    def parts(batches: Iterator) -> Iterator:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                files, where = fs.FileSystem.from_uri(path)
                with files.open_input_file(where) as f:
                    for x, block in records(f):
                        page, url, stated = number(x.get("x-page-id")), x.get("warc-target-uri"), x.get("warc-payload-digest", "").removeprefix("sha1:")
                        if "warc-segment-number" in x:
                            rows.append(("segment", x.get("warc-segment-origin-id", x["warc-record-id"]), None, int(x["warc-segment-number"]), number(x.get("warc-segment-total-length")), page, url, None, stated, block))
                        elif x["warc-type"] == "revisit":
                            rows.append(("revisit", x["warc-record-id"], x.get("warc-refers-to"), None, None, page, url, number(x.get("x-payload-length")), stated, None))
                        elif x["warc-type"] == "response":
                            rows.append(("response", x["warc-record-id"], None, None, None, page, url, *checked(page, block, stated)))
                        held += len(block)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def assemble(batches: Iterator) -> Iterator:
        for batch in batches:
            for origin, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block, page = b"".join(p["payload"] for p in found), found[0]["page_id"]
                if [p["number"] for p in found] != list(range(1, len(found) + 1)) or found[-1]["total"] != len(block):
                    raise ValueError(f"page {page}: segments are missing or don't add up to the stated length")
                yield batch_of([("response", origin, None, None, None, page, found[0]["url"], *checked(page, block, found[0]["payload_digest"]))])

    schema = ", ".join(f"{name} {kind}" for name, kind in fields)
    read = written(paths.mapInArrow(parts, schema), "records")
    grouped = read.filter("kind = 'segment'").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("number", "total", "page_id", "url", "payload_digest", "payload"))).alias("found"))
    whole = read.filter("kind = 'response'").unionByName(grouped.mapInArrow(assemble, schema))
    revisits = read.filter("kind = 'revisit'")
    asked = revisits.groupBy("refers").agg(F.count("*").alias("n"))
    origins = read.filter("kind = 'response' OR number = 1").select(F.col("record").alias("refers"), F.col("page_id").alias("refers_to"))
    targets = written(asked.join(origins, "refers", "left"), "origins")
    referred = with_keys(revisits.filter("refers IS NOT NULL"), targets.filter("refers IS NOT NULL"), "refers", int(targets.agg(F.sum("n")).first()[0] or 0))
    out = whole.unionByName(revisits.filter("refers IS NULL")).withColumn("refers_to", F.lit(None).cast("long")).unionByName(referred)
    return out.select("page_id", "url", F.col("kind").alias("record_type"), "refers_to", "payload_bytes", "payload_digest", "payload")
