"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Every record is a gzip member of its own. Archives go through the session's text writer, so they reach any file system
that Spark writes to and are committed task by task: a member ends with the highest byte of its length, which is zero
below 16 MiB, so a member without that byte is the "line" and the zero byte the line separator. A longer record gets an
empty member behind it, which ends in a zero byte as well.

The reader checks each member's CRC, the version line, the lengths and the block's digest. After a failed check it
searches for the next gzip magic or version line at which a whole record passes, goes on from there, and reports the
bytes between as a quarantined gap. A member may hold any number of records, as in a file that was gzipped at once: they
are read one after another, damage among them is skipped within the inflated bytes, and if the member breaks off, the
records before the last one reached are given out (that one may be damaged and is quarantined). Positions of records
within such a member are the compressed bytes read until then.

An archive is closed once it has ``archive_bytes``, whatever the sizes of its records, so it exceeds that by a record at
most. Archives are cut into pieces in the JVM, one at a time, and stream through the Python worker, which holds a record of
up to RECORD_BYTES (longer ones are quarantined) and KEEP bytes to go back to. What Spark reads as one file, below 2 GiB,
is the limit of an archive from elsewhere.

Edge cases: a null html is an empty payload; a null url becomes the record's own urn; control characters in a url are
percent-encoded. Rows with a null page_id are written and come back null; they are responses only where no row of the
same payload has an id. Of rows that repeat the largest id with the same payload each is a response. An empty table
writes archives without records. Other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, join_small, materialize, shared_dir

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
#: A version line and well-formed header lines, so that a header doesn't run across damaged bytes.
HEAD = re.compile(rb"WARC/1\.[01](?:\r\n[!-9;-~]+:[^\x00-\x08\x0A-\x1F]*)+")
#: What may follow HEAD where a well-formed header is cut.
CUT = re.compile(rb"\r?|\r\n(?:[!-9;-~]*|\r)")
LINE = re.compile(re.escape(VERSION))
CANDIDATE = re.compile(re.escape(MAGIC) + b"|" + re.escape(VERSION))
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this are always kept in full.
LEAST_BYTES = 1000
CHUNK = 1 << 16
#: Bytes of a piece in which an archive reaches a worker; of a record; and of a broken member that are searched again.
PIECE, RECORD_BYTES, KEEP = 1 << 17, 1 << 30, 1 << 26
RECORDS = "kind string, file string, begin long, end long, reason string, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def member(data: bytes) -> bytes:
    """A gzip member, the last byte of which is zero."""
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = gz.compress(data) + gz.flush()
    if out[-1]:
        empty = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += empty.flush()
    return out


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}",
        *[f"{k}: {v}" for k, v in fields], f"WARC-Block-Digest: {sha1(block)}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response with its payload, or a revisit with the response's head alone."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else urn(page_id)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", uri), ("Content-Type", "application/http;msgtype=response")]
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is None:
        return record("response", urn(page_id), fields, http + payload, date)
    fields += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE)]
    return record("revisit", urn(page_id), fields, http, date)


def _id(x):
    return None if pd.isna(x) else int(x)


def write(pages: DataFrame, path: str, *, archive_bytes: int = 64 << 20, date: str = "2000-01-01T00:00:00Z", torn: int = 0) -> None:
    """Archive every page below ``path``; of equal payloads one is a response, the others revisit it.

    With ``torn``, one in so many records of a batch has its first half written before it, as by a
    writer that is killed and begins it again: damage of which the reader must salvage what follows.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    facts = materialize(rows.select("page_id", "digest", F.octet_length("payload").alias("n")))
    groups = facts.where(F.col("n") >= LEAST_BYTES).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("c"))
    groups = materialize(groups.where((F.col("c") > 1) & F.col("response").isNotNull()).select("digest", "response"))
    rows = join_small(rows, groups, ["digest"])
    revisits = ~F.col("page_id").eqNullSafe(F.col("response")) & F.col("response").isNotNull()
    rows = rows.withColumn("refers_to", F.when(revisits, F.col("response"))).drop("response")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written = 0
        for b in batches:
            columns = zip(b["page_id"], b["url"], b["payload"], b["digest"], b["refers_to"], strict=True)
            out = [member(page_record(_id(i), u, bytes(p), d, _id(r), date))[:-1] for i, u, p, d, r in columns]
            out = [y for k, x in enumerate(out) for y in ([x[: len(x) // 2], x] if torn and k % torn == 0 else [x])]
            before = written + np.cumsum([0, *[len(x) + 1 for x in out]])
            written = int(before[-1])
            yield pd.DataFrame({"value": out, "archive": before[:-1] // archive_bytes})

    lines = rows.mapInPandas(members, "value binary, archive long").select(F.col("value").cast("string").alias("value"), "archive")
    files = lines.write.mode("overwrite").option("partitionOverwriteMode", "static")  # no archive of an earlier run stays
    files.option("lineSep", "\x00").partitionBy("archive").text(path)


class Stream:
    """Bytes from ``base`` on of what comes in pieces; earlier ones have been let go."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.base = iter(pieces), bytearray(), 0

    def reaches(self, end: int) -> bool:
        """Whether there are ``end`` bytes; as many as that are read."""
        while self.base + len(self.held) < end:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.held += piece
        return True

    def cut(self, begin: int, end: int) -> bytes:
        """The bytes there, fewer at the end."""
        self.reaches(end)
        return bytes(memoryview(self.held)[max(begin - self.base, 0) : max(end - self.base, 0)])

    def let_go(self, at: int) -> None:
        if at - self.base > CHUNK:
            del self.held[: at - self.base]
            self.base = at

    def search(self, pattern: re.Pattern[bytes], at: int, length: int) -> int:
        """Where the pattern of at most ``length`` bytes next matches, or the end. What lies before is let go."""
        while True:
            found = pattern.search(self.held, at - self.base)
            if found:
                return self.base + found.start()
            end = self.base + len(self.held)
            if not self.reaches(end + 1):
                return end
            at = max(at, end - length)
            self.let_go(at)


class Inflated:
    """The content of the gzip member at ``at``, in pieces; zlib checks its CRC and length."""

    def __init__(self, data: Stream, at: int):
        self.data, self.begin, self.at, self.error = data, at, at, ""

    def __iter__(self) -> Iterator[bytes]:
        gz, size = zlib.decompressobj(31), 1 << 12
        try:
            while not gz.eof:
                piece, before = self.data.cut(self.at, self.at + size), gz.copy()
                try:
                    plain = gz.decompress(piece, CHUNK)
                except zlib.error:
                    yield from self._until_fault(before, piece)
                    raise
                if not piece and not plain and not gz.eof:
                    raise ValueError("the gzip member ends early")
                self.at += len(piece) - len(gz.unused_data if gz.eof else gz.unconsumed_tail)
                self.data.let_go(max(self.begin + 1, self.at - KEEP))
                size = min(2 * size, CHUNK)
                if plain:
                    yield plain
        except (ValueError, zlib.error) as e:
            self.error = str(e)


    def _until_fault(self, gz, piece: bytes) -> Iterator[bytes]:
        """What a piece yields before the byte at which it breaks off, found in ever smaller steps."""
        for step in (1024, 32, 1):
            for at in range(0, len(piece), step):
                before, own = gz.copy(), piece[at : at + step]
                try:
                    plain = gz.decompress(own)
                except zlib.error:
                    gz, piece = before, own
                    break
                self.at += len(own)
                if plain:
                    yield plain


def _parse(data: Stream, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the plain record at ``at``; every check that fails raises ValueError."""
    size = 1 << 12
    while (stop := (head := data.cut(at, at + size)).find(b"\r\n\r\n")) < 0 and len(head) == size:
        begun = HEAD.match(head)
        if not begun or not CUT.fullmatch(head, begun.end()):
            break
        size *= 4  # a header as long as its lines are well-formed
    if stop < 0 or not HEAD.fullmatch(head, 0, stop):
        raise ValueError("no version line or no well-formed header")
    lines = head[:stop].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise ValueError("no length or no type")
    begin = at + stop + 4
    end = begin + int(fields["content-length"])
    if end - begin > RECORD_BYTES:
        raise ValueError("the block is longer than a task holds")
    block = data.cut(begin, end)
    if len(block) < end - begin or data.cut(end, end + 4) != b"\r\n\r\n":
        raise ValueError("the block's length is wrong")
    wanted = fields.get("warc-block-digest", "")
    if wanted.startswith("sha1:") and wanted != sha1(block):
        raise ValueError("the block's digest is wrong")
    return fields, block, end + 4


def _member(data: Stream, begin: int) -> Iterator[tuple]:
    """Records and gaps of the gzip member at ``begin``; the last item is ("end", where, error)."""
    pieces = Inflated(data, begin)
    plain, at, pending, why = Stream(pieces), 0, [], ""
    since = begin  # compressed bytes that what has been given out accounts for
    while plain.reaches(at + 1):
        try:
            fields, block, at = _parse(plain, at)
        except ValueError as e:
            why = why or str(e)
            at = plain.search(LINE, at + 1, len(VERSION))
            continue
        if pending:  # what comes after it is a record, so it was whole
            yield from pending
            since = pending[-1][2]
        here, pending = max(since, pieces.at), []
        if why:
            pending.append(("gap", since, here, why))
        pending.append(("record", here if why else since, here, fields, block))
        why = ""
        plain.let_go(at)
    if pieces.error:
        yield "end", since, pieces.error
        return
    if pending:
        yield from pending[:-1]
        _, first, last, *record = pending[-1]
        since = last if why else pieces.at
        yield "record", first, since, *record
    if why:
        yield "gap", min(since, pieces.at), pieces.at, why
    yield "end", pieces.at, ""


def salvage(data: bytes | Iterable[bytes]) -> Iterator[tuple]:
    """("record", begin, end, fields, block) for each valid record and ("gap", begin, end, reason) between them."""
    stream, at, lost, why = Stream([data] if isinstance(data, (bytes, bytearray, memoryview)) else data), 0, None, ""
    while stream.reaches(at + 1):
        error, again = "", at + 1
        if stream.cut(at, at + 3) == MAGIC:
            for item in _member(stream, at):
                if item[0] == "end":
                    error, again = item[2], max(item[1], at + 1)
                    end = item[1]
                    break
                if lost is not None:
                    yield "gap", lost, at, why
                    lost = None
                yield item
            if error and lost is None:
                lost, why = end, error
            elif not error and lost is not None:  # a whole member without records
                yield "gap", lost, at, why
                lost = None
        else:
            try:
                fields, block, end = _parse(stream, at)
            except ValueError as e:
                error = str(e)
                if lost is None:
                    lost, why = at, error
            else:
                if lost is not None:
                    yield "gap", lost, at, why
                    lost = None
                yield "record", at, end, fields, block
        at = stream.search(CANDIDATE, again, len(VERSION)) if error else end
        stream.let_go(at)
    if lost is not None:
        yield "gap", lost, at, why


def _row(file: str, item: tuple, payloads: bool) -> tuple:
    if item[0] == "gap":
        return ("gap", file, item[1], item[2], item[3], *[None] * 7)
    _, begin, end, fields, block = item
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    said = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    size = len(payload) if kind != "revisit" else int(said[1]) if said else None
    digest = fields.get("warc-payload-digest", "")
    if kind == "response" and digest and digest != sha1(payload):
        return ("gap", file, begin, end, "the payload's digest is wrong", *[None] * 7)
    digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    content = payload if payloads and kind == "response" else None
    own = ("record", file, begin, end, None, kind, fields.get("warc-record-id"), fields.get("warc-refers-to"))
    return (*own, fields.get("warc-target-uri"), digest, size, content)


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """RECORDS' rows of all archives below ``path``: records, and the gaps that were quarantined."""

    names = [x.split()[0] for x in RECORDS.split(", ")]

    def salvaged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = (x for b in batches for x in zip(b["path"], b["piece"], strict=True))
        for file, own in groupby(pieces, key=lambda x: x[0]):
            rows, held = [], 0
            for item in salvage(bytes(piece) for _, piece in own):
                rows.append(_row(file, item, payloads))
                held += len(item[4]) if item[0] == "record" else 0
                if held > 1 << 22 or len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    bound_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # numbers are exploded, not pieces, so that no second copy of an archive is made
    numbers = files.select("path", "content", F.explode(F.expr(f"sequence(0, cast(greatest(length - 1, 0) div {PIECE} as int))")).alias("i"))
    return numbers.select("path", F.expr(f"substring(content, i * {PIECE} + 1, {PIECE})").alias("piece")).mapInPandas(salvaged, RECORDS)


def quarantined(records: DataFrame) -> DataFrame:
    """The log of byte gaps: ``file``, ``begin``, ``end`` and ``reason`` of the first check that failed."""
    return records.where("kind = 'gap'").select("file", "begin", "end", "reason")


def round_trip(pages: DataFrame, *, path: str | None = None, **parameters) -> DataFrame:
    """Write the archives and return what reading them back tells of each page."""
    spark, path = pages.sparkSession, path or shared_dir(pages.sparkSession)
    write(pages, path, **parameters)
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    return read(spark, path, payloads=False).where("kind = 'record'").select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to")
    )
