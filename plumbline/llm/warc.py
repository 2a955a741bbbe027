"""WARC archives as chunked record tables.

A record is rows of (archive, record, chunk): its header first, then its block in chunks of at most CHUNK bytes, each
with the digest of the payload so far. A record is one gzip member, so the rows' bytes in that order are a .warc.gz file
(WARC/1.1). Writing and reading stream the chunks: neither puts a record together in memory, so a payload of any size
costs one chunk.
"""

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import arrow_schema, durable, join_groups, small_batches

CHUNK = 256 << 10
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

TABLE = "archive int,record long,chunk int,data binary,payload_sha1 string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def urn(page) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(name: str):
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def header(page, url, size, sha1_hex, refers_to) -> bytes:
    """A record's own header and the HTTP header that begins its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    again = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", urn(page)), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(sha1_hex))), ("X-Payload-Length", size),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to))] if again else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (0 if again else size)),
    ]
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]).encode() + END + http


def keyed(pages: DataFrame, id_col, url_col, body_col) -> DataFrame:
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("body"))
    return rows.withColumns({"sha": F.sha2("body", 256), "size": F.octet_length("body").cast("long")})


def revisits(rows: DataFrame, least: int) -> DataFrame:
    """(page_id, sha, refers_to) of the pages whose payload a page with a larger id has too."""
    names = durable(rows.filter(F.col("size") >= least).select("page_id", "sha"))
    total = names.count()
    groups = names.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to")).filter("n > 1")
    return join_groups(names, groups, ["sha"], total).filter("page_id < refers_to").select("page_id", "sha", "refers_to").distinct()


def write_records(pages: DataFrame, least=0, id_col="page_id", url_col="url", body_col="html") -> DataFrame:
    """The archives of a table of pages, as a chunked record table; each task of the write makes an archive.

    Of pages with equal payloads of at least `least` bytes the one with the largest id is a response, the others are
    revisits of it. A null payload is empty; a page with a null id is a response; pages repeated with their id are each
    written. Other columns are ignored.
    """
    rows = keyed(pages, id_col, url_col, body_col)
    known = rows.join(revisits(rows, least), ["page_id", "sha"], "left")
    # the rows of a record follow each other; what a row does not need of its page stays behind in the JVM
    chunks = F.when(F.col("refers_to").isNull(), F.ceil(F.col("size") / CHUNK).cast("int")).otherwise(0)
    cut = known.withColumn("sha1", F.sha1("body")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks))).select(
        F.spark_partition_id().alias("archive"), "page_id", F.when(F.col("chunk") == 0, F.col("url")).alias("url"), "size", "sha1", "refers_to", "chunk", chunks.alias("last"),
        F.when(F.col("chunk") > 0, F.expr(f"substring(body, (chunk - 1) * {CHUNK} + 1, {CHUNK})")).alias("data"),
    )
    schema = arrow_schema(TABLE)

    def run(batches):
        record, digest, member = -1, None, None
        for batch in batches:
            out = []
            for archive, page, url, size, sha1, refers, chunk, last, data in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk == 0:
                    record, digest, member = record + 1, hashlib.sha1(), zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = header(page, url, size, sha1, refers)
                else:
                    digest.update(data)
                data = member.compress(data)
                if chunk == last:
                    if refers is None and digest.hexdigest() != sha1:
                        raise ValueError(f"page {page}: chunks do not give its payload")
                    data += member.compress(END) + member.flush()
                out.append((archive, record, chunk, data, digest.hexdigest()))
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(schema), schema.types)], schema=schema)

    return cut.mapInArrow(run, TABLE)


class Reader:
    """Reads one record's bytes as they come; holds its header and the payload's digest, never the payload."""

    def __init__(self):
        self.head, self.fields, self.left, self.http, self.digest, self.size, self.tail = b"", None, 0, b"", hashlib.sha1(), 0, b""
        self.member = zlib.decompressobj(31)

    def feed(self, packed: bytes) -> None:
        while packed:
            self.take(self.member.decompress(packed, CHUNK))
            packed = self.member.unconsumed_tail

    def take(self, data: bytes) -> None:
        if self.fields is None:
            self.head += data
            at = self.head.find(END)
            if at < 0:
                return
            lines = self.head[:at].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            self.fields = dict(line.split(": ", 1) for line in lines[1:])
            self.left = int(self.fields["Content-Length"])
            data, self.head = self.head[at + 4 :], b""
        block, behind = data[: self.left], data[self.left :]
        self.left -= len(block)
        self.tail += behind
        if self.http is not None:
            self.http += block
            at = self.http.find(END)
            if at < 0:
                return
            block, self.http = self.http[at + 4 :], None
        self.digest.update(block)
        self.size += len(block)

    def row(self):
        self.take(self.member.flush())
        f = self.fields
        if f is None or self.left or self.tail != END or not self.member.eof:
            raise ValueError("a record is cut off")
        digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
        if f["WARC-Type"] == "response" and (base32(self.digest.digest()), self.size) != (digest, int(f["X-Payload-Length"])):
            raise ValueError(f"{f['WARC-Record-ID']}: payload and digest differ")
        refers = f.get("WARC-Refers-To")
        return page_of(f["WARC-Record-ID"]), int(f["X-Payload-Length"]), digest, f["WARC-Type"], refers and page_of(refers)


def read_records(table: DataFrame, in_order=False) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, read from the bytes and verified.

    `in_order` says that each partition of the table has whole archives in their order, as a checkpoint of written
    records has; else rows are brought together by record first. A record that is cut off is an error either way.
    """
    small_batches(table.sparkSession)
    ddl = "page_id long,payload_bytes long,payload_digest string,record_type string,refers_to long"
    schema = arrow_schema(ddl)

    def run(batches):
        at, reader = None, None
        out = []

        def rows():
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * len(schema), schema.types)], schema=schema)

        for batch in batches:
            for archive, record, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (archive, record) != at:
                    if reader:
                        out.append(reader.row())
                    at, reader = (archive, record), Reader()
                reader.feed(data)
            yield rows()
            out = []
        if reader:
            out.append(reader.row())
        yield rows()

    order = ["archive", "record", "chunk"]
    rows = table if in_order else table.repartition("archive", "record").sortWithinPartitions(*order)
    return rows.select("archive", "record", "data").mapInArrow(run, ddl)


def save_files(table: DataFrame, folder: str) -> DataFrame:
    """Write each archive to `folder` (mounted on every executor) as a .warc.gz file; per archive its path and bytes."""
    ddl = "path string,bytes long"
    schema = arrow_schema(ddl)

    def run(batches):
        import os

        files, done = None, {}
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.join(folder, f"{archive:06d}.warc.gz")
                if path not in done:
                    if files:
                        files.close()
                    files, done[path] = open(path, "wb"), 0
                files.write(data)
                done[path] += len(data)
        if files:
            files.close()
        yield pa.record_batch([pa.array(list(done)), pa.array(list(done.values()), pa.int64())], schema=schema)

    return table.repartition("archive").sortWithinPartitions("archive", "record", "chunk").select("archive", "data").mapInArrow(run, ddl)
