"""WARC archives: write whole-file gzip streams, rewrite them with a member per record, read records by offset.

`write_archives` writes records through Spark's text sink, whose gzip files are one stream each. `normalise` inflates every such
file once, in pieces of bounded size, writes each record as a gzip member of its own and returns a sidecar index (file, offset,
length, record id). `read_records` seeks to the members that an index names. Archives live in a folder that every executor
reaches, by a URI that pyarrow's file systems open (file, hdfs, s3, gs). A file is written under a name of its own and then renamed;
members depend on the records alone, so a task that runs again gives the same file and index.

Cases: a null html counts as empty; null or repeated page ids are kept, and all rows with a payload's largest id are its responses;
if no row with a payload has an id, all are responses; line breaks and blanks in a url become %20; an empty table gives empty
results; other columns are ignored. A damaged file keeps the records before the damage and one index row with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_SCHEMA = "file string, offset long, length long, record_id string, error string"
RECORD_SCHEMA = "file string, offset long, record_id string, record_type string, refers_to string, target_uri string, page_id long, payload_length long, stated_digest string, payload_digest string, payload binary"
CHUNK = 1 << 20


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: ten hex digits are eight of base 32."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """One WARC record (as text, without the closing blank lines) per page; later pages keep the payload, others revisit them."""
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), F.regexp_replace(F.coalesce(pages["url"], F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"),
        html.alias("html"), base32_sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"),
    )
    shared = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_last")).filter("_n > 1").drop("_n")
    rows = rows.join(shared, "digest", "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    line, urn = "\r\n", lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("bytes").cast("string"), F.lit(line * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{line}WARC-Record-ID: "), urn(F.col("page_id")),
        F.lit(f"{line}WARC-Date: {date}{line}WARC-Target-URI: "), F.col("url"), F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{line}WARC-Refers-To: "), urn(F.col("_last")), F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "), F.octet_length(block).cast("string"), F.lit(line * 2),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(records: DataFrame, path: str, file_records: int = 20_000) -> None:
    """Write records as gzip files, one stream each, of at most `file_records` records."""
    records.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records).text(path)


def opened(uri: str):
    """File system and path of a URI."""
    from pyarrow import fs

    uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
    return fs.FileSystem.from_uri(uri)


def inflated(stream) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or more members, in bounded pieces."""
    import zlib

    inflate, fed = zlib.decompressobj(31), False
    while raw := stream.read(CHUNK):
        while raw:
            fed = True
            if plain := inflate.decompress(raw, CHUNK):
                yield plain
            raw = inflate.unconsumed_tail or inflate.unused_data
            if inflate.eof:
                inflate, fed = zlib.decompressobj(31), False
    if fed:
        raise EOFError("the file ends within a gzip member")


class Plain:
    """Reads lines and counted bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def until_blank(self) -> bytes:
        """A record's head with its blank line; line breaks before it are skipped; empty at the end."""
        while True:
            kept = self.held.lstrip(b"\r\n")
            if kept or not self.more():
                break
        self.held, at = kept, 0
        while (at := self.held.find(b"\r\n\r\n", max(0, at))) < 0:
            at = len(self.held) - 3
            if not self.more():
                if self.held:
                    raise EOFError("the file ends within a record's head")
                return b""
        return self.take(at + 4)[0]

    def take(self, n: int) -> list[bytes]:
        """The next n bytes, as one piece."""
        while len(self.held) < n:
            if not self.more():
                raise EOFError("the file ends within a record")
        out = bytes(memoryview(self.held)[:n])
        del self.held[:n]
        return [out]

    def pass_on(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces of bounded size."""
        while n:
            if not self.held and not self.more():
                raise EOFError("the file ends within a record")
            out = self.take(min(n, len(self.held), CHUNK))[0]
            n -= len(out)
            yield out


def headers(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def rewrite(source: str, target: str, level: int = 6) -> Iterator[tuple]:
    """Rewrite one file; yields (offset, length, record id, error) for each member."""
    import uuid
    import zlib

    here, path = opened(source)
    there, out_path = opened(target)
    there.create_dir(out_path.rpartition("/")[0], recursive=True)
    own = f"{out_path}.{uuid.uuid4().hex}.part"
    with here.open_input_stream(path, compression=None) as stream, there.open_output_stream(own, compression=None) as out:
        plain, offset = Plain(inflated(stream)), 0
        try:
            while head := plain.until_blank():
                said = headers(head)
                deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                pieces = [deflate.compress(head)]
                for part in plain.pass_on(int(said["content-length"])):
                    pieces.append(deflate.compress(part))
                pieces += [deflate.compress(b"\r\n\r\n"), deflate.flush()]
                member = b"".join(pieces)
                out.write(member)
                yield offset, len(member), said.get("warc-record-id"), None
                offset += len(member)
        except (EOFError, zlib.error, KeyError, ValueError) as e:
            yield None, None, None, f"{type(e).__name__}: {e}"
    there.move(own, out_path)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every gzip file of `source` into `target`, each by one task; returns the index, which the caller writes beside it."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = ["file", "offset", "length", "record_id", "error"]
        frame = lambda rows: pd.DataFrame(rows, columns=names, dtype=object)
        for batch in batches:
            for path in batch["path"]:
                name, rows = f"{target}/{path.rpartition('/')[2].removesuffix('.txt.gz')}.warc.gz", []
                for found in rewrite(path, name):
                    rows.append((name, *found))
                    if len(rows) == 5000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    n = max(1, files.count())
    return files.repartition(n).mapInPandas(run, INDEX_SCHEMA)


def read_records(index: DataFrame) -> DataFrame:
    """The records that the index names, read by offset; the payload is what follows the HTTP head (null in a revisit)."""

    def run(batches: Iterator) -> Iterator:
        import base64
        import gzip
        import hashlib

        import pandas as pd

        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        at, stream = None, None
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                if file != at:
                    if stream:
                        stream.close()
                    system, path = opened(file)
                    at, stream = file, system.open_input_file(path)
                stream.seek(int(offset))
                head, _, rest = gzip.decompress(stream.read(int(length))).partition(b"\r\n\r\n")
                said = headers(head)
                http, _, payload = rest[: int(said["content-length"])].partition(b"\r\n\r\n")
                digest = None if said["warc-type"] == "revisit" else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                number = said["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                rows.append((file, offset, said["warc-record-id"], said["warc-type"], said.get("warc-refers-to"), said.get("warc-target-uri"), None if number == "null" else int(number), int(headers(http)["content-length"]), said["warc-payload-digest"].removeprefix("sha1:"), digest, None if digest is None else payload))
                held += len(payload)
                if held > 16 * CHUNK:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names, dtype=object)

    known = index.filter("error is null")
    files = max(1, known.agg(F.count_distinct("file")).first()[0])  # as a number, so that the few index rows aren't put together
    return known.repartition(files, "file").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInPandas(run, RECORD_SCHEMA)
