"""WARC archives of pages: written as gzip members, read back from byte ranges."""

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_folder, written

#: Smaller payloads are always stored whole.
LEAST_REVISIT = 100

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = b"\r\n\r\n"
#: Decoded bytes after which a candidate member without a full header is not a record.
_HEADER_LIMIT = 1 << 20


def marked(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, payload, digest, refers_to. Of equal payloads of at least LEAST_REVISIT bytes the
    page with the smallest id is stored, and the others refer to it. Pages without id are always stored whole."""
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Written, so that the join below has one row per digest on one side and a hot digest on the other can be split.
    firsts = written(firsts.withColumnRenamed("digest", "first_digest"), "firsts")
    joined = rows.join(firsts.hint("shuffle_hash"), rows["digest"] == firsts["first_digest"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def _record_id(page_id) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())


def _member(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record as a gzip member, without the zero byte at its end, which the writer puts between members."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _BREAK
    block = http if refers_to is not None else http + payload
    header = [
        VERSION, b"WARC-Type: " + (b"revisit" if refers_to is not None else b"response"), b"WARC-Record-ID: " + _record_id(page_id),
        b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        header.insert(3, b"WARC-Target-URI: " + b"".join(b"%%%02X" % c if c < 33 or c == 127 else bytes([c]) for c in url.encode()))
    if refers_to is not None:
        header += [b"WARC-Refers-To: " + _record_id(refers_to), b"WARC-Profile: " + PROFILE]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(b"\r\n".join(header) + _BREAK + block + _BREAK) + packer.flush()
    if member[-1]:
        # The last byte of a member is the top byte of its size, 0 below 16 MB. An empty member makes it 0 for all.
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member += packer.flush()
    return member[:-1]


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write marked pages as archives: one file per task, one gzip member per record. Spark's text writer puts the
    members into the files, with the zero byte that ends each member as its separator, so any file system will do."""

    def pack(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([_member(*r, date) for r in rows], pa.binary())], names=["member"])

    members = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(pack, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Opened:
    """A gzip member that is decoded as its bytes come."""

    def __init__(self):
        self.decoder, self.out, self.pieces = zlib.decompressobj(31), bytearray(), []

    @property
    def is_record(self) -> bool:
        return self.out.startswith(VERSION[:-1]) and _BREAK in self.out

    def feed(self, piece) -> bool | None:
        """True when the member is complete, None while it goes on, False if this is no WARC record."""
        self.pieces.append(piece)
        try:
            self.out += self.decoder.decompress(piece[1])
        except zlib.error:
            return False
        if not VERSION.startswith(bytes(self.out[: len(VERSION) - 1])):
            return False
        if self.decoder.eof or len(self.out) >= _HEADER_LIMIT and _BREAK not in self.out[:_HEADER_LIMIT]:
            return self.is_record and self.decoder.eof
        return None


class _Members:
    """Finds records in a sequence of (place, bytes) pieces that all start with the gzip magic.

    A magic inside compressed data starts a piece too, which goes on with the member before it. A piece that starts no
    record is passed over, and what came after it is looked at anew. ``loose`` gathers the pieces that may belong to a
    member which starts before the sequence, or ends after it.
    """

    def __init__(self):
        self.opened, self.loose, self.seen = None, [], False

    def push(self, pieces):
        waiting = list(pieces)
        while waiting:
            self.opened = self.opened or _Opened()
            state = self.opened.feed(waiting.pop(0))
            if state is None:
                continue
            opened, self.opened = self.opened, None
            if state:
                self.seen = True
                yield _record(bytes(opened.out))
            else:
                if not self.seen:
                    self.loose.append(opened.pieces[0])
                waiting = opened.pieces[1:] + waiting

    def finish(self):
        while self.opened:
            opened, self.opened = self.opened, None
            if opened.is_record:
                self.loose += opened.pieces
            else:
                # Too little to tell: it may start a record or only wait for bytes as if it did.
                self.loose.append(opened.pieces[0])
                self.seen = False
                yield from self.push(opened.pieces[1:])


_FIELDS = ["record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload"]


def _record(data: bytes) -> tuple:
    """The fields of a decoded record."""
    head, _, rest = data.partition(_BREAK)
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    block = rest[: int(fields.get(b"content-length", len(rest)))]
    payload, length = block, None
    if fields.get(b"content-type", "").startswith("application/http"):
        http, _, payload = block.partition(_BREAK)
        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
    number = lambda x: int(x) if (x := (x or "").removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields.get(b"warc-type")
    return (
        kind, number(fields.get(b"warc-record-id")), fields.get(b"warc-target-uri"), number(fields.get(b"warc-refers-to")),
        fields.get(b"warc-payload-digest", "").removeprefix("sha256:"), len(payload) if length is None or kind != "revisit" else length, payload,
    )


_SCHEMA = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_PARTS = _SCHEMA + ", file string, block long, seq int, piece binary"
_NAMES = [*_FIELDS, "file", "block", "seq", "piece"]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int32(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _candidates(batches):
    """Records that start in the byte ranges of a task, and the loose pieces of members that cross a false magic and a range.

    The text reader cuts a range at each gzip magic and gives what starts inside it, each candidate up to the next magic,
    also beyond the range's end.
    """
    place, members, seq, rows, size = None, _Members(), 0, [], 0

    def end():
        found = [r + (None,) * 4 for r in members.finish()]
        return found + [(None,) * len(_FIELDS) + (*place, k, piece) for k, piece in members.loose]

    for batch in batches:
        for value, file, block in zip(*batch.columns):
            value, here = value.as_py(), (file.as_py(), block.as_py())
            if here != place:
                rows += end() if place else []
                place, members, seq = here, _Members(), 0
                if here[1] == 0:  # what stands before the first magic of a file
                    continue
            seq += 1
            for record in members.push([(seq, MAGIC + value)]):
                rows.append(record + (None,) * 4)
                size += len(record[6])
            if size > 4_000_000 or len(rows) >= 2000:
                yield _batch(rows)
                rows, size = [], 0
    rows += end() if place else []
    if rows:
        yield _batch(rows)


def _stitched(table: pa.Table) -> pa.Table:
    """Records of one file whose pieces lie in several ranges."""
    loose = sorted(((r["block"], r["seq"]), r["piece"]) for r in table.select(["block", "seq", "piece"]).to_pylist())
    members = _Members()
    rows = [*members.push(loose), *members.finish()]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(_FIELDS, _TYPES))})


#: Names that Spark's text reader would decode as one stream before the magic is looked for; ``.gz`` is read as it is.
_STREAMS = r"\.(bz2|deflate|snappy|lz4|zst)$"
#: Hands the bytes of files with this ending on as they are. Such files are not split: one task reads one, as a stream.
#: The second setting has another name in Hadoop's shaded client, which comes with Spark.
_AS_IT_IS = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": ".gz",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".gz",
}


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All WARC records of the gzip archives under ``path``: record_type, page_id, url, refers_to, payload_digest,
    payload_bytes (of the full payload), payload.

    Files are split, but for those named ``.gz``, which go to one task each. A task takes the candidate members that start
    in its byte range, and keeps those that decode to a WARC header. Bytes that belong to no valid member are passed over.
    Files named like another compressed stream raise ValueError: Spark's readers decode them, and members are not seen.
    """
    streams = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(_STREAMS)).select("path").head()
    if streams:
        raise ValueError(f"{streams.path} would be decoded as one stream; name archives without the ending of a compression")
    raw = (
        spark.read.options(lineSep=MAGIC.decode("latin-1"), encoding="ISO-8859-1", **_AS_IT_IS).text(path)
        .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )
    parts = raw.mapInArrow(_candidates, _PARTS)
    whole = parts.where("file is null").select(*_FIELDS)
    return whole.unionByName(parts.where("file is not null").groupBy("file").applyInArrow(_stitched, _SCHEMA))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    The digest of a response is that of the payload read, the digest of a revisit the one in its header. Null html is an empty
    payload; a null url is left out; repeated rows are records like any other, and rows that share the smallest id of
    equal payloads are all stored whole. An empty table gives no records.
    """
    path = new_folder(pages.sparkSession, "warc")
    write_archives(marked(pages, id_col, url_col, html_col), path)
    records = read_archives(pages.sparkSession, path)
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", "url")
