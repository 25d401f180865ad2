"""WARC archives with a two-level capture index.

Writing: each task writes its records, one gzip member each, to archive files in a shared folder. Indexing:
the captures are sorted by reversed-host URL key and cut into compressed blocks of lines; a shard file is a
series of blocks and, behind them, the directory of their first keys. Reading: binary search over the first
keys of the shards, then over the shard's directory, then a range read of one block and of one record.

Files are written under names that no other attempt uses, and only those that a finished task reports are
read; so a lost or repeated task leaves at most an unused file.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut_lineage, scratch_path

#: Payloads of fewer bytes are always written whole.
REVISIT_BYTES = 1000
LINES = 1000
ARCHIVE_BYTES = 256 << 20
_KEY = ("url_key", "page_id")


def url_key(url: Column) -> Column:
    """The host's labels from the last to the first, then port, path and query: ``org,example)/a?b``."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][\w+.-]*:)?//([^/?#:]*)", 1))
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][\w+.-]*:)?//[^/?#:]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def _place(folder: str):
    """File system and path of a folder that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record as a gzip member. A revisit names the record with the payload and leaves it out."""
    from urllib.parse import quote

    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http + payload if refers_to is None else http
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html); the captures (url_key, page_id, file,
    at, size) that say where. Of equal payloads of REVISIT_BYTES or more the largest page_id has the response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", url_key(F.col("url")).alias("url_key"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("digest", "page_id")
    owners = large.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null")
    # Written first: a side that is an aggregate over its own exchange keeps AQE from splitting a hot payload.
    joined = rows.join(cut_lineage(owners.select("digest", "owner")), "digest", "left")
    joined = joined.select("page_id", "url", "url_key", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner")).alias("refers_to"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _place(folder)
        name, out, at = "", None, 0
        for batch in batches:
            names, starts, sizes = [], [], []
            for row in zip(*(batch.column(i) for i in (0, 1, 3, 4, 5)), strict=True):
                page_id, url, body, digest, refers_to = (x.as_py() for x in row)
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                member = _record(page_id, url or "", body, digest, refers_to, date)
                out.write(member)
                names.append(name)
                starts.append(at)
                sizes.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["url_key", "page_id", "file", "at", "size"])
        if out is not None:
            out.close()

    return cut_lineage(joined.mapInArrow(run, f"url_key string, page_id {kind}, file string, at long, size long"))


def _order(key: str, page_id) -> tuple:
    """Spark's order of (url_key, page_id): UTF-8 bytes, null first."""
    return key.encode(), page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str, shards: int, lines: int = LINES) -> DataFrame:
    """Writes the captures in sorted shards to the folder; (shard, url_key, page_id): each shard's first key."""
    kind = captures.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _place(folder)
        name, out, at, held, directory = f"{uuid.uuid4().hex}.cdx", None, 0, [], []

        def flush() -> None:
            nonlocal at, held
            block = zlib.compress("\n".join(map(json.dumps, held)).encode())
            directory.append((held[0][0], held[0][1], at, len(block)))
            out.write(block)
            at += len(block)
            held = []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                # Captures of one key stay in one block, so that a search ends in it.
                if len(held) >= lines and held[-1][:2] != line[:2]:
                    flush()
                held.append(line)
        if held:
            flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            page = pa.array([directory[0][1]], batch.column(1).type)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([directory[0][0]]), page], names=["shard", "url_key", "page_id"])

    ordered = captures.repartitionByRange(shards, *_KEY).sortWithinPartitions(*_KEY, "file", "at").select(*_KEY, "file", "at", "size")
    return cut_lineage(ordered.mapInArrow(run, f"shard string, url_key string, page_id {kind}"))


class _Reader:
    """Looks keys up in the two levels and reads records, keeping one shard, block and archive open."""

    def __init__(self, archives: str, index: str, firsts: list[tuple]) -> None:
        self.files, self.archives = _place(archives)
        _, self.index = _place(index)
        self.firsts, self.keys = firsts, [_order(*x[1:]) for x in firsts]
        self.shard, self.block, self.archive = None, None, None

    def _open(self, name: str) -> None:
        self.file = self.files.open_input_file(f"{self.index}/{name}")
        end = self.file.size()
        size = int.from_bytes(self.file.read_at(8, end - 8), "big")
        self.directory = json.loads(zlib.decompress(self.file.read_at(size, end - 8 - size)))
        self.first_keys = [_order(*x[:2]) for x in self.directory]
        self.shard, self.block = name, None

    def captures(self, key: str, page_id) -> list[list]:
        """The index lines of a key."""
        wanted = _order(key, page_id)
        at = bisect.bisect_right(self.keys, wanted) - 1
        if at < 0:
            return []
        if self.shard != self.firsts[at][0]:
            self._open(self.firsts[at][0])
        number = bisect.bisect_right(self.first_keys, wanted) - 1
        if number < 0:
            return []
        if self.block != number:
            _, _, start, size = self.directory[number]
            self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(size, start)).split(b"\n")]
            self.line_keys, self.block = [_order(*x[:2]) for x in self.lines], number
        return self.lines[bisect.bisect_left(self.line_keys, wanted) : bisect.bisect_right(self.line_keys, wanted)]

    def record(self, name: str, at: int, size: int) -> tuple[dict[str, str], bytes]:
        if self.archive is None or self.archive[0] != name:
            self.archive = name, self.files.open_input_file(f"{self.archives}/{name}")
        return parse(self.archive[1].read_at(size, at))


def read_back(wanted: DataFrame, shards: DataFrame, archives: str, index: str, tasks: int) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of each capture of the
    ``wanted`` (url_key, page_id). For a revisit bytes and payload are null and the digest is the header's.
    The shards' first keys, one for each shard, go to every task."""
    kind = wanted.schema["page_id"].dataType
    firsts = sorted(((r.shard, r.url_key, r.page_id) for r in shards.collect()), key=lambda x: _order(*x[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        reader = _Reader(archives, index, firsts)
        for batch in batches:
            done, held = [], 0
            asked = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            places = [(name, at, size, page_id) for key, page_id in asked for _, _, name, at, size in reader.captures(key, page_id)]
            for name, at, size, page_id in sorted(places, key=lambda x: x[:2]):  # an archive is opened once a batch
                fields, payload = reader.record(name, at, size)
                whole = fields["WARC-Type"] == "response"
                refers = fields.get("WARC-Refers-To", "<urn:page:>")[10:-1]
                digest = hashlib.sha1(payload).hexdigest() if whole else fields["WARC-Payload-Digest"][5:]
                done.append((page_id, fields["WARC-Target-URI"], fields["WARC-Type"], int(refers) if refers else None, len(payload) if whole else None, digest, payload if whole else None))
                held += size
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema)
                    done, held = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
    ordered = wanted.select(*_KEY).distinct().repartitionByRange(tasks, *_KEY).sortWithinPartitions(*_KEY)
    found = ordered.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive(pages: DataFrame, shards: int | None = None) -> DataFrame:
    """Writes ``pages`` to archives and an index in the shared folder and reads every page back: (page_id,
    payload_bytes, payload_digest, record_type, refers_to); bytes and digest are those of the full payload.

    A null html is an empty payload; null urls share the empty key; a row without page_id is never the
    response of others. Repeated rows have a record each; where two rows share the largest page_id of a
    payload, both are responses. An empty table gives an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    archives, index = scratch_path(spark, "warc"), scratch_path(spark, "cdx")
    for folder in (archives, index):
        files, root = _place(folder)
        files.create_dir(root, recursive=True)
    captures = write_archives(pages, archives)
    firsts = write_index(captures, index, shards)
    wanted = pages.select(url_key(F.col("url")).alias("url_key"), "page_id")
    read = cut_lineage(read_back(wanted, firsts, archives, index, shards).drop("payload", "url"))
    whole = read.where("record_type = 'response' and payload_bytes is not null").groupBy(F.col("page_id").alias("_owner"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    joined = read.join(whole, (F.col("refers_to") == F.col("_owner")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
