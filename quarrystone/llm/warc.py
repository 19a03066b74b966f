"""WARC archives as a chunked record table: a payload is rows of (record, chunk number) that carry running digests, and never one value."""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.tables import by_keys, cut_lineage, fresh_dir, join_hot, reduce_rows

#: Bytes of a payload in a row, and bytes after which a file is closed and the next begun.
CHUNK, ROLL = 1 << 20, 1 << 30
#: Repeated rows of one record that a task writes before the next block of them.
_BLOCK = 4096
#: Fixed by the WARC 1.1 standard.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LINE_MOST = 1 << 20
_READ = "uri string, record string, record_type string, target_uri string, refers_to string, chunk_no long, chunk binary, payload_bytes long, payload_digest string, last boolean"


def digest_text(sha1: bytes) -> str:
    """A SHA-1 as WARC headers carry it, in upper-case base32."""
    return base64.b32encode(sha1).decode()


class ArchiveWriter:
    """The WARC files of one task.

    A record begins with its headers and takes its payload piece by piece; a
    file that is full is closed and renamed to its final name.  A compressed
    record is a gzip member of its own.
    """

    def __init__(self, folder: str, part: int, date: str, roll: int, compress: bool):
        self.folder, self.part, self.date, self.roll, self.compress = folder, part, date, roll, compress
        self.number, self.records, self.sink, self.left, self.files = 0, 0, None, 0, []
        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)

    def _open(self) -> None:
        self.uri = f"{self.folder}/part-{self.part:06d}-{self.number:04d}.warc{'.gz' if self.compress else ''}"
        self.temporary = f"{self.uri}.{uuid.uuid4().hex}"
        self.sink = self.store.open_output_stream(fs.FileSystem.from_uri(self.temporary)[1], compression=None, buffer_size=1 << 20)
        self.records, self.written, self.number = 0, 0, self.number + 1
        info = b"format: WARC File Format 1.1\r\n"
        self.begin({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.uri)}>", "Content-Type": "application/warc-fields"}, info, 0)
        self.records = 0

    def _send(self, raw: bytes | memoryview) -> None:
        raw = self.squeeze.compress(raw) if self.compress else raw
        self.written += len(raw)
        self.sink.write(raw)

    def begin(self, headers: dict[str, str], block: bytes, size: int) -> None:
        """A record of the block and ``size`` more bytes, which ``add`` gives."""
        if self.sink is not None and self.written >= self.roll:
            self.close()
        if self.sink is None:
            self._open()
        self.squeeze = zlib.compressobj(6, zlib.DEFLATED, 31) if self.compress else None
        self.left, self.records = size, self.records + 1
        lines = {**headers, "WARC-Date": self.date, "Content-Length": str(len(block) + size)}
        self._send(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n").encode() + block)
        if not size:
            self._end()

    def add(self, piece: bytes | memoryview) -> None:
        if len(piece):
            self._send(piece)
            self.left -= len(piece)
            if self.left <= 0:
                self._end()

    def _end(self) -> None:
        if self.left < 0:
            raise ValueError("a payload is longer than its size")
        self._send(b"\r\n\r\n")
        if self.compress:
            self.sink.write(self.squeeze.flush())

    def close(self) -> None:
        if self.sink is not None:
            if self.left:
                raise ValueError("a payload is shorter than its size")
            self.sink.close()
            self.store.move(fs.FileSystem.from_uri(self.temporary)[1], fs.FileSystem.from_uri(self.uri)[1])
            self.files.append({"uri": self.uri, "records": self.records})
            self.sink = None


def _record_id(name: object, sha1: str, copy: object = 0) -> str:
    return f"<urn:record:{'' if name is None else quote(str(name), safe='')}:{sha1}:{copy}>"


def record_name(record: Column) -> Column:
    """The id that a record was written under, as text; null for a null id."""
    name = F.url_decode(F.regexp_extract(record, "^<urn:record:([^:]*):", 1))
    return F.when(name != "", name)


def payload_kinds(rows: DataFrame, least: int) -> DataFrame:
    """(id, uri, size, sha1, copies, head_id, head_uri, is_head) of the different rows (id, uri, size, sha1).

    Of equal payloads of at least ``least`` bytes the row of least id, then
    least URI (nulls last), is the head; smaller payloads have a null
    ``is_head``.  Rows are counted before they are shuffled, and groups of
    many members meet their head by broadcast.
    """
    same = cut_lineage(rows.groupBy("id", "uri", "size", "sha1").agg(F.count("*").alias("copies")))
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("id"), F.col("uri").isNull().alias("b"), F.col("uri").alias("uri"))
    heads = cut_lineage(same.where(F.col("size") >= least).groupBy("size", "sha1").agg(F.min(order).alias("head"), F.count("*").alias("members")))
    met = join_hot(same, heads, ["size", "sha1"], "members", same.count())
    is_head = F.col("id").eqNullSafe(F.col("head.id")) & F.col("uri").eqNullSafe(F.col("head.uri"))
    known = met.select(*same.columns, F.col("head.id").alias("head_id"), F.col("head.uri").alias("head_uri"), is_head.alias("is_head"))
    return known.unionByName(same.where(F.col("size") < least), allowMissingColumns=True)


def chunked(rows: DataFrame, payload: str, size: str, chunk: int = CHUNK) -> DataFrame:
    """``rows`` with chunk_no and chunk in the place of ``payload``: one row for each ``chunk`` bytes, at least one, in order."""
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest((F.col(size) - 1) / chunk, F.lit(0)).cast("long")))
    cut = F.substring(F.col(payload), (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk))
    return rows.withColumn("chunk_no", number).withColumn("chunk", cut).drop(payload)


def write_warc(
    rows: DataFrame, folder: str, record: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0,
    date: str = "1970-01-01T00:00:00Z", chunk: int = CHUNK, roll: int = ROLL, compress: bool = True,
) -> DataFrame:
    """Write a record for each row to files in ``folder``; returns the manifest (uri, records), one row a file.

    Of records with equal payloads of at least ``least`` bytes that of the
    least id is a response; the others are revisits that refer to it and carry
    no payload.  Payloads reach the files as rows of ``chunk`` bytes, below a
    header with the digest and size found before, and do not go through a
    shuffle unless the list of revisits is too long to be sent to every task.
    A task closes files at about ``roll`` bytes, under names of its own that it
    then renames, so a second attempt only replaces equal records.

    Strings are taken as UTF-8.  Null and empty payloads are empty; a null id
    is an id after all others; a null URI is left out; rows that repeat id,
    URI and payload are revisits of the first; very long payloads are read and
    written in pieces; other columns are passed over; an empty table writes no
    file.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    own = rows.select(F.col(record).alias("id"), F.col(uri).alias("uri"), raw.alias("payload"))
    own = own.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    kinds = cut_lineage(payload_kinds(own.select("id", "uri", "size", "sha1"), least))
    keys = {k: F.col(k) for k in ("id", "uri", "size", "sha1")}

    # Payloads that are written: all but those of revisits; of a repeated head one.
    repeated = (F.col("copies") > 1) & F.col("is_head")
    total = kinds.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    whole = by_keys(own, kinds.where(~F.col("is_head") | repeated), keys, "copies", total, False)
    if not kinds.where(repeated).isEmpty():
        again = by_keys(own, kinds.where(repeated), keys, "copies", total, True)
        whole = whole.unionByName(again.groupBy("id", "uri", "size", "sha1").agg(F.any_value("payload").alias("payload")))
    whole = chunked(whole, "payload", "size", chunk)

    # Revisits have no payload; many of one record are dealt out in blocks.
    other = kinds.withColumn("copies", F.col("copies") - F.col("is_head").cast("int")).where("copies > 0 AND is_head IS NOT NULL")
    blocks = other.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("copies") - 1) / _BLOCK).cast("long"))))
    blocks = blocks.withColumn("copies", F.least(F.col("copies") - F.col("block") * _BLOCK, F.lit(_BLOCK)))
    revisits = blocks.repartition(reduce_rows(rows.sparkSession), "id", "block")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, archive, serial = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            plain = batch.drop_columns(["chunk"]).to_pylist()
            for row, piece in zip(plain, batch.column("chunk")):
                archive = archive or ArchiveWriter(folder, part, date, roll, compress)
                if row["copies"] is None:
                    if not row["chunk_no"]:
                        serial += 1
                        archive.begin(*_response(row, 0 if row["size"] >= least else f"{part}.{serial}"))
                    archive.add(memoryview(piece.as_buffer()))
                for copy in range(row["copies"] or 0):
                    archive.begin(*_revisit(row, row["block"] * _BLOCK + copy + 1))
        if archive:
            archive.close()
            yield pa.RecordBatch.from_pylist(archive.files)

    both = whole.unionByName(revisits.drop("is_head"), allowMissingColumns=True)
    return cut_lineage(both.mapInArrow(write, "uri string, records long"))


def _common(row: dict, kind: str, copy: object) -> dict[str, str]:
    target = {} if row["uri"] is None else {"WARC-Target-URI": quote(row["uri"], safe="%/:=&?~#+!$,;'@()*[]")}
    head = {"WARC-Type": kind, "WARC-Record-ID": _record_id(row["id"], row["sha1"], copy), **target}
    return head | {"WARC-Payload-Digest": "sha1:" + digest_text(bytes.fromhex(row["sha1"])), "Content-Type": "application/http; msgtype=response"}


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _response(row: dict, copy: object) -> tuple[dict[str, str], bytes, int]:
    return _common(row, "response", copy), _http(row["size"]), row["size"]


def _revisit(row: dict, copy: int) -> tuple[dict[str, str], bytes, int]:
    return _common(row, "revisit", copy) | {"WARC-Profile": _PROFILE, "WARC-Refers-To": _record_id(row["head_id"], row["sha1"])}, _http(row["size"]), 0


class _Source(io.RawIOBase):
    """A file's bytes, of all gzip members if it is compressed, without holding more than a piece."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.file, self.packed = store.open_input_stream(path, compression=None), path.endswith(".gz")
        self.open, self.rest, self.ready = None, b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if not self.packed:
            return self.file.readinto(into)
        while not self.ready:
            if not self.rest:
                self.rest = self.file.read(1 << 16)
                if not self.rest:
                    if self.open is not None:
                        raise EOFError("a gzip member has no end")
                    return 0
            self.open = self.open or zlib.decompressobj(31)
            self.ready = self.open.decompress(self.rest, 1 << 20)
            self.rest = self.open.unconsumed_tail
            if self.open.eof:
                self.rest, self.open = self.open.unused_data, None
        n = min(len(into), len(self.ready))
        into[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def _fields(source: io.BufferedReader) -> tuple[dict[str, str], int]:
    """Header lines up to the empty one, names in lower case, and how many bytes they took."""
    out, size = {}, 0
    while True:
        line = source.readline(_LINE_MOST)
        size += len(line)
        if not line.endswith(b"\n"):
            raise EOFError("a header has no end")
        if line in (b"\r\n", b"\n"):
            return out, size
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()


def archive_chunks(uri: str, chunk: int = CHUNK) -> Iterator[dict]:
    """The chunk rows of a file's responses and revisits, read front to back; a payload that is not its header's digest is an error."""
    with io.BufferedReader(_Source(uri), 1 << 18) as source:
        while line := source.readline(_LINE_MOST):
            if not line.strip():
                continue
            if not line.startswith(b"WARC/1."):
                raise ValueError(f"no record where one should begin in {uri}")
            head, _ = _fields(source)
            left = int(head["content-length"])
            if head["warc-type"] not in ("response", "revisit"):
                while left:
                    left -= len(_full(source, min(chunk, left)))
                continue
            status = source.readline(_LINE_MOST)
            if not status.startswith(b"HTTP/"):
                raise ValueError(f"no HTTP message in {head['warc-record-id']}")
            http, size = _fields(source)
            left -= len(status) + size
            known = head["warc-payload-digest"].removeprefix("sha1:")
            row = {"uri": uri, "record": head["warc-record-id"], "record_type": head["warc-type"], "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to")}
            if head["warc-type"] == "revisit":
                yield row | {"chunk_no": 0, "chunk": b"", "payload_bytes": int(http["content-length"]), "payload_digest": known, "last": True}
                continue
            digest, done, number = hashlib.sha1(), 0, 0
            while left or not number:
                piece = _full(source, min(chunk, left))
                digest.update(piece)
                left, done = left - len(piece), done + len(piece)
                so_far = digest_text(digest.digest())
                if not left and so_far != known:
                    raise ValueError(f"the payload of {head['warc-record-id']} is not that of its digest")
                yield row | {"chunk_no": number, "chunk": piece, "payload_bytes": done, "payload_digest": so_far, "last": not left}
                number += 1


def _full(source: io.BufferedReader, size: int) -> bytes:
    raw = source.read(size)
    if len(raw) < size:
        raise EOFError("a record has no end")
    return raw


def read_warc(manifest: DataFrame, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """(uri, record, record_type, target_uri, refers_to, chunk_no, chunk, payload_bytes, payload_digest, last) of the files that ``manifest`` names.

    A payload is one row for each ``chunk`` bytes; bytes and digest run over
    the pieces so far, so the ``last`` row has those of the whole payload.  A
    revisit is one row with the size and digest of what it refers to.  Without
    ``payloads`` the pieces are read and digested but only last rows come out,
    without their bytes.  Files are the unit of work, and a task holds a few
    megabytes whatever a record's length.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}.get(t, pa.string())) for n, t in (c.split() for c in _READ.split(", "))])
        out, size = [], 0
        for uri in (u for batch in batches for u in batch.column("uri").to_pylist()):
            for row in archive_chunks(uri, chunk):
                if not payloads:
                    if not row["last"]:
                        continue
                    row["chunk"] = None
                out.append(row)
                size += len(row["chunk"] or b"")
                if len(out) >= 1024 or size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return manifest.select("uri").repartitionByRange(reduce_rows(manifest.sparkSession), "uri").mapInArrow(read, _READ)


def warc_round_trip(rows: DataFrame, record: str = "page_id", folder: str | None = None, **more) -> DataFrame:
    """(record, payload_bytes, payload_digest, record_type, refers_to) of each row, written to ``folder`` (a new shared one if none is given) and read back."""
    kind = dict(rows.dtypes)[record]
    manifest = write_warc(rows, folder or fresh_dir(rows.sparkSession, "warc"), record, **more)
    back = read_warc(manifest, more.get("chunk", CHUNK), payloads=False)
    refers = record_name(F.col("refers_to")).cast(kind)
    return back.where("last").select(record_name(F.col("record")).cast(kind).alias(record), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"))
