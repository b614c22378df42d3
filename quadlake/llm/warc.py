"""WARC archives: a writer with revisit records, and a reader that salvages damaged ones.

Writer: one gzip member for each record, members concatenated to archives of bounded size.
Of the records with one payload of at least ``min_bytes`` bytes that with the largest id is
the response; the others are revisit records which name it and carry no payload.

Reader: goes from member to member. When a member fails (damaged gzip data, a bad length, a
digest that does not match) it searches for the next place where a whole valid member, or an
uncompressed record's version line, begins, goes on there, and logs the gap between as
quarantined bytes. Searches go on from where the last ones ended, members are inflated bit by bit until they
fail, and a header has to end within ``HEAD`` bytes, so damage does not make reading slow. Records after a damaged part are recovered; so are the valid records of a
member around a failed one, whose gap has the place of the member. Payload length and digest
are checked where a record has them, so archives of other writers are read, too.

An archive is a row (archive, data); ``write_files`` and ``read_files`` turn such rows
to .warc.gz files in a folder and back. Archives are written to the scratch folder.

Defined results: null html is an empty payload; null ids are kept as empty id headers;
repeated rows give a record each (the first one met of equal id and payload is as good as
any other); extra columns are ignored; no rows give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm.common import slices, texts, written

VERSION, MAGIC, EOL = b"WARC/1.1", b"\x1f\x8b\x08", b"\r\n"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_SHA1 = re.compile(r"[A-Z2-7]{32}")
RECORDS = "archive string, at long, size long, kind string, id string, uri string, refers_to string, digest string, payload_bytes long, payload binary, gap string"


#: Bytes within which a record's header ends.
HEAD = 1 << 16


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, ident: str, uri: str, payload: bytes, size: int, digest: str, refers_to: str | None = None) -> bytes:
    """A record's bytes. A revisit record has the size and digest of the payload it leaves out."""
    lines = [VERSION, f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:page:{ident}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z", b"WARC-Target-URI: " + uri.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A")]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}".encode(), f"WARC-Payload-Length: {size}".encode(), f"Content-Length: {len(payload)}".encode(), b"", payload, b"", b""]
    return EOL.join(lines)


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` and its end; ValueError if it fails a check."""
    if not _LINE.match(data, at):
        raise ValueError("no version line")
    end = data.find(EOL * 2, at, at + HEAD)
    if end < 0:
        raise ValueError("no end of header")
    head = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(b":") for x in data[at:end].split(EOL)[1:]) if colon}
    try:
        n = int(head[b"content-length"])
        size = int(head.get(b"warc-payload-length", n))
        kind, digest = head[b"warc-type"].decode(), head.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") or None
    except (KeyError, UnicodeDecodeError) as e:
        raise ValueError(f"bad header: {e}") from e
    stop = end + 4 + n + 4
    if n < 0 or len(data) < stop or data[stop - 4 : stop] != EOL * 2:
        raise ValueError("bad length")
    payload = data[end + 4 : end + 4 + n]
    # Of HTTP messages the digest is that of the body; digests of other kinds cannot be checked.
    bodies = [payload, *payload.split(EOL * 2, 1)[1:]] if head.get(b"content-type", b"").startswith(b"application/http") else [payload]
    if kind == "response" and digest and _SHA1.fullmatch(digest) and digest not in map(digest_of, bodies):
        raise ValueError("bad digest")
    ident = lambda k: head[k].decode("utf-8", "replace").removeprefix("<urn:page:").removesuffix(">") if k in head else None
    return {"kind": kind, "id": ident(b"warc-record-id"), "uri": head.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "refers_to": ident(b"warc-refers-to"), "digest": digest, "payload_bytes": size, "payload": payload}, stop


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """The plain bytes of the member at ``at``, and its end."""
    z, out, pos, step, view = zlib.decompressobj(31), [], at, 1 << 10, memoryview(data)
    while not z.eof:
        if pos >= len(data):
            raise ValueError("member cut short")
        try:
            out.append(z.decompress(view[pos : pos + step]))
        except zlib.error as e:
            raise ValueError(f"bad member: {e}") from e
        pos, step = min(pos + step, len(data)), min(2 * step, 1 << 20)
    return b"".join(out), pos - len(z.unused_data)


def _at(data: bytes, at: int) -> tuple[list[dict], int]:
    """Records of the member or plain record that begins at ``at``, and its end."""
    if not data.startswith(MAGIC, at):
        r, end = parse(data, at)
        return [r], end
    plain, end = _inflated(data, at)
    out, inner, good, why = [], 0, False, ""
    while inner < len(plain):
        try:
            r, inner = parse(plain, inner)
            out.append(r)
            good = True
        except ValueError as e:
            why = str(e)
            if not out or out[-1]["kind"] != "gap":
                out.append({"kind": "gap", "gap": why})
            line = _LINE.search(plain, inner + 1)
            inner = line.start() if line else len(plain)
    if not good:
        raise ValueError(why or "empty member")
    return out, end


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive with ``at`` and ``size`` of the bytes they stand in; quarantined
    gaps have kind "gap" and the reason in ``gap``. Records and gaps cover all bytes, in order."""
    at, bad, why = 0, -1, ""
    magic = line = -1  # the next ones from where they were last looked for
    while at < len(data):
        try:
            records, end = _at(data, at)
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)
            if magic <= at:
                magic = data.find(MAGIC, at + 1)
                magic = len(data) if magic < 0 else magic
            if line <= at:
                found = _LINE.search(data, at + 1)
                line = found.start() if found else len(data)
            at = min(magic, line)
            continue
        if bad >= 0:
            yield {"kind": "gap", "at": bad, "size": at - bad, "gap": why}
            bad = -1
        for r in records:
            yield r | {"at": at, "size": end - at}
        at = end
    if bad >= 0:
        yield {"kind": "gap", "at": bad, "size": len(data) - bad, "gap": why}


def _write(size: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, total, n = TaskContext.get().partitionId(), [], 0, 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([f"{number:06d}-{n:06d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], ["archive", "data"])

        for batch in batches:
            for part in slices(batch):
                cols = [part.column(c).to_pylist() for c in ("page_id", "url", "sha1", "target")]
                for ident, url, sha1, target, payload in zip(*cols, texts(part.column("html")), strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    name, revisit = "" if ident is None else str(ident), target is not None
                    held.append(member(record("revisit" if revisit else "response", name, url or "", b"" if revisit else payload, len(payload), digest, str(target) if revisit else None), level))
                    total += len(held[-1])
                    if total >= size:
                        yield out()
                        held, total, n = [], 0, n + 1
        if held:
            yield out()

    return run


_ARROW = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("size", pa.int64()), *((c, pa.string()) for c in ("kind", "id", "uri", "refers_to", "digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("gap", pa.string())])


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column("archive")[i].as_py(), []
                for r in salvage(texts(batch.column("data").slice(i, 1))[0]):
                    rows.append({"archive": name} | (r if payloads else {k: v for k, v in r.items() if k != "payload"}))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def archives(pages: DataFrame, min_bytes: int = 0, size: int = 4 << 20, level: int = 1) -> DataFrame:
    """Archives (archive, data) of page rows (page_id, url, html), one record for each row."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # The digests alone are grouped, with partial maxima before the shuffle.
    last = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    last = last.where((F.col("n") > 1) & F.col("last").isNotNull()).drop("n")
    target = F.when((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.join(last, "sha1", "left").withColumn("target", target).select("page_id", "url", "sha1", "target", "html").mapInArrow(_write(size, level), "archive string, data binary")


def read_archives(rows: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of archives (archive, data), by the salvage reader."""
    return rows.select("archive", "data").mapInArrow(_read(payloads), RECORDS)


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write archives as files to a folder that every executor can reach; returns the paths."""

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, data in zip(batch.column("archive").to_pylist(), texts(batch.column("data")), strict=True):
                with open(f"{folder}/{name}.tmp", "wb") as f:
                    f.write(data)
                os.replace(f"{folder}/{name}.tmp", f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("archive")], ["archive"])

    return rows.select("archive", "data").mapInArrow(run, "archive string")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Archives (archive, data) from files of any store that Spark reads."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.col("content").alias("data"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page to archives in the scratch folder, and read their records back."""
    return read_archives(written(archives(pages, min_bytes), "warc"), payloads=False)
