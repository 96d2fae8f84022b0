"""WARC archives: writing with revisits and segments, reading back and reassembling.

Writing: a page's HTML is the payload of an HTTP response in chunked transfer
framing. Payloads that occur before (equal bytes, smaller page id) become
``revisit`` records; long blocks become a segment and ``continuation`` records.
An archive is text lines whose separator is the two line ends that close every
record, so Spark's own committed text writer makes valid archives, compressed
and of bounded size, on any file system it knows.

Reading: archives are parsed record by record by their declared lengths,
continuations are grouped by origin, put in order of segment number, checked
against the total length, and freed of the chunked framing; digests are checked.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsentry.session import materialise

# Least payload bytes a revisit is written for, bytes of a segment, of a chunk, and of an archive.
REVISIT_FROM = 0
SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
ARCHIVE_BYTES = 16 << 20
_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cut_utf8(data: bytes, size: int) -> list[bytes]:
    """``data`` in parts of at most ``size`` bytes that end between characters; no data is one empty part."""
    parts, at = [], 0
    while len(data) - at > size:
        end = at + size
        while end > at + 1 and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:end])
        at = end
    parts.append(data[at:])
    return parts


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [p for p in cut_utf8(payload, size) if p]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunk(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        parts.append(body[at : at + size])
        at += size + 2


def _record(kind: str, record_id: str, block: bytes, **fields) -> str:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{record_id}>"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    lines = ["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines) + block.decode("utf-8", "surrogateescape")


def _line(text: str | None) -> str | None:
    return None if text is None else " ".join(text.split())


def records(
    pages: DataFrame, id_col: str, url_col: str, body_col: str, input_bytes: int, revisit_from: int = REVISIT_FROM,
    null_ids: bool = False,
) -> DataFrame:
    """``record``: the WARC records of ``pages``, dealt to partitions of about ``ARCHIVE_BYTES`` of payload.

    Null bodies are empty payloads, null URLs have no target line. Every row has a
    record of its own, named by id, payload digest and the number of the copy, so ids
    may repeat, with equal or different bodies. With ``null_ids``, rows without an id are
    written too, else left out; a null id is greater than any other and empty in the name.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    page, sha = F.col(id_col).cast("long"), F.sha1(body.cast("binary"))
    rows = (pages if null_ids else pages.where(page.isNotNull())).select(
        page.alias("_id"), F.col(url_col).cast("string").alias("_url"), body.alias("_body"), sha.alias("_sha"),
        F.octet_length(body).alias("_size"), F.concat_ws(".", F.coalesce(page.cast("string"), F.lit("")), sha).alias("_key"),
    )
    first = (
        rows.where(F.col("_size") >= revisit_from)
        .groupBy("_sha", "_size")
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_c"))
        .where("_c > 1 AND _first IS NOT NULL")
        .select("_sha", "_size", "_first")
    )
    refers = (
        rows.select("_id", "_sha", "_size", "_key").join(first, ["_sha", "_size"]).where("NOT _id <=> _first")
        .groupBy("_key").agg(F.min("_first").alias("_first"))
    )
    # Bodies move once: to meet their revisits, and equal rows each other, where their archive is written.
    archives = max(1, -(-input_bytes // ARCHIVE_BYTES))
    dealt = rows.select("_id", "_url", "_body", "_key").repartition(archives, "_key")
    marked = dealt.join(refers, "_key", "left").select("_id", "_url", "_body", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: Counter[tuple] = Counter()
        for batch in batches:
            out = []
            for page, url, text, origin in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                payload = text.encode("utf-8", "surrogateescape")
                sha = digest(payload)
                copies[page, sha] += 1
                key = f"{'' if page is None else page}.{sha}.{copies[page, sha]}"
                common = {"WARC_Target_URI": _line(url), "WARC_Date": "2024-01-01T00:00:00Z", "WARC_Payload_Digest": f"sha1:{sha}"}
                if origin is not None:
                    out.append(_record("revisit", key, b"", **common, WARC_Refers_To=f"<urn:record:{origin}.{sha}.1>",
                                       WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                    continue
                block = _HTTP.encode() + chunked(payload)
                parts = cut_utf8(block, SEGMENT_BYTES)
                for k, part in enumerate(parts, 1):
                    one = {} if len(parts) == 1 else {"WARC_Segment_Number": k}
                    if k > 1:
                        one["WARC_Segment_Origin_ID"] = f"<urn:record:{key}>"
                        if k == len(parts):
                            one["WARC_Segment_Total_Length"] = len(block)
                    kind, name = ("response", key) if k == 1 else ("continuation", f"{key}.{k}")
                    out.append(_record(kind, name, part, **(common if k == 1 else {}), **one))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.encode("utf-8", "surrogateescape") for r in out], pa.binary()).cast(pa.string())], ["record"]
            )

    return marked.mapInArrow(run, "record string")


def write_archives(recs: DataFrame, path: str) -> None:
    """Write ``records`` as one compressed archive for each partition."""
    recs.write.option("lineSep", _END).option("compression", "gzip").text(path)


def parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive: header fields (lower-case names) and ``block``."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        fields["block"] = archive[end + 4 : end + 4 + size]
        if len(fields["block"]) != size or archive[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield fields
        at = end + 8 + size


def _urn(value: str | None) -> tuple[int | None, str | None]:
    """The page id, if it has one, and the name of the record ``value`` stands for."""
    if value is None:
        return None, None
    name = value.removeprefix("<urn:record:").rstrip(">")
    page = name.split(".")[0]
    return int(page) if page else None, name


def read_records(spark, path: str) -> DataFrame:
    """One row per record: ``origin``, ``segment``, ``kind``, ``total``, ``refers_to``, ``digest``, ``block``.

    ``origin`` and ``refers_to`` are page ids; ``record`` and ``target`` name the records meant.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["origin", "segment", "kind", "total", "refers_to", "digest", "block", "record", "target"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                archive = content.as_py()
                for f in parse(gzip.decompress(archive) if archive[:2] == b"\x1f\x8b" else archive):
                    total = f.get("warc-segment-total-length")
                    origin, record = _urn(f.get("warc-segment-origin-id", f["warc-record-id"]))
                    refers_to, target = _urn(f.get("warc-refers-to"))
                    rows.append((
                        origin, int(f.get("warc-segment-number", 0)), f["warc-type"],
                        None if total is None else int(total), refers_to,
                        f.get("warc-payload-digest", "").removeprefix("sha1:") or None, f["block"], record, target,
                    ))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, "origin long, segment int, kind string, total long, refers_to long, digest string, block binary, record string, target string")


def reassemble(recs: DataFrame) -> DataFrame:
    """``page_id``, ``kind``, ``refers_to``, ``payload_digest``, ``payload``, ``valid`` for every response and revisit.

    ``record`` names the row's record and ``target`` the one a revisit refers to.
    A response is valid if its segments are there in full, of the declared total
    length, its framing holds and its payload has the declared digest; otherwise
    its payload is null. A revisit has no payload of its own and is valid.
    """
    head = F.when(F.col("kind") != "continuation", F.struct("kind", "refers_to", "digest", "target"))
    part = F.struct("segment", "block")
    # Only segmented records have to meet others.
    whole = recs.where("segment = 0").select("record", "origin", head.alias("_head"), F.col("total").alias("_total"), F.array(part).alias("_parts"))
    segmented = (
        recs.where("segment > 0")
        .groupBy("record", "origin")
        .agg(F.max(head).alias("_head"), F.max("total").alias("_total"), F.sort_array(F.collect_list(part)).alias("_parts"))
    )
    pages = whole.unionByName(segmented)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, totals = (batch.column(i).to_pylist() for i in (2, 3))
            payloads, valid = [], []
            for k, head in enumerate(heads):
                payload, ok = None, head is not None
                if head is not None and head["kind"] == "response":
                    segments = batch.column(4)[k].as_py()
                    numbers = [s["segment"] for s in segments]
                    block = b"".join(s["block"] for s in segments)
                    ok = numbers == ([0] if totals[k] is None else list(range(1, len(segments) + 1)))
                    ok = ok and (totals[k] is None or totals[k] == len(block))
                    try:
                        payload = unchunk(block[block.index(b"\r\n\r\n") + 4 :]) if ok else None
                    except ValueError:
                        payload = None
                    ok = payload is not None and digest(payload) == head["digest"]
                payloads.append(payload if ok else None)
                valid.append(ok)
            get = [[None if h is None else h[x] for h in heads] for x in ("kind", "refers_to", "digest", "target")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(get[0], pa.string()), pa.array(get[1], pa.int64()), pa.array(get[2], pa.string()),
                 pa.array(payloads, pa.binary()), pa.array(valid, pa.bool_()), batch.column(0), pa.array(get[3], pa.string())],
                ["page_id", "kind", "refers_to", "payload_digest", "payload", "valid", "record", "target"],
            )

    return pages.mapInArrow(
        run, "page_id long, kind string, refers_to long, payload_digest string, payload binary, valid boolean, record string, target string"
    )


def resolve(pages: DataFrame) -> DataFrame:
    """Digest rows of reassembled ``pages``: revisits get the length of the payload they refer to.

    The digest rows are written to the shared folder, so archives are read once.
    A revisit whose response is missing, or has another digest, is not valid.
    """
    own = materialise(
        pages.select("page_id", F.col("kind").alias("record_type"), "refers_to", "payload_digest", "valid", "record", "target",
                     F.octet_length("payload").cast("long").alias("payload_bytes")),
        "warc-pages",
    )
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"]
    responses = own.where("record_type != 'revisit'")
    origin = responses.select(F.col("record").alias("_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    revisits = (
        own.where("record_type = 'revisit'")
        .join(origin, F.col("target") == F.col("_to"), "left")
        .withColumn("payload_bytes", F.col("_bytes"))
        .withColumn("valid", F.coalesce(F.col("_digest") == F.col("payload_digest"), F.lit(False)))
    )
    return responses.select(*columns).unionByName(revisits.select(*columns))
