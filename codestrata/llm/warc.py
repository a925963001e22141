"""WARC archives: segmented, chunk-framed writing with revisit records, and reading with segment reassembly (operator 7).

Writing.  A page becomes an HTTP response whose body is the HTML in UTF-8, sent with ``Transfer-Encoding: chunked``.  Of
the pages whose payloads are equal and at least ``min_dedup_bytes`` long, the one with the largest page id is written in
full and the others become ``revisit`` records that refer to it.  A block longer than ``segment_chars`` characters is cut
into a first record and ``continuation`` records.  Spark's own text writer puts the records into gzip files of at most
``records_per_file`` records, in any store that Spark can write to.

Reading.  Files are parsed record by record by their content lengths.  Unsegmented records go on at once; segments are
grouped by their origin, put in order of their segment numbers and joined, the total length is verified, and then the
chunk framing is taken off.  A record with a missing, repeated or odd segment, a wrong total length or broken framing
comes out with ``complete`` false and no payload; it is never dropped.

Defined cases: null HTML is the empty payload; a null page id gives a record without one, which never wins over a page
with an id; equal rows are records of their own, of which one wins; an empty table gives an archive without records and
an empty result; only the three named columns are read; control characters in a URL are percent-encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha1
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
HTTP_HEAD = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"])
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Columns of a read archive.
RECORD = "record_id string, record_type string, page_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, n_segments int, complete boolean"
_PARSED = "origin string, segment int, total long, record_type string, page_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, block binary"


def _urn(key: str) -> str:
    h = f"md5({key})"
    parts = ", '-', ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat('<urn:uuid:', {parts}, '>')"


def _pieces(text: str, size: str) -> str:
    """SQL for an array of a text's pieces of ``size`` characters (at least one)."""
    return f"transform(sequence(0, greatest(0, cast(ceil(char_length({text}) / {size}) AS int) - 1)), k -> substr({text}, cast(k * {size} + 1 AS int), cast({size} AS int)))"


def with_roles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_dedup_bytes: int = 1000) -> DataFrame:
    """Rows ``key, id, url, html, n_bytes, digest, is_revisit, rep_id, rep_key``: which pages revisit which.

    The winners of repeated payloads come from one aggregation with partial results, so a payload that a third of all
    pages share costs no more than another; the join back to the pages is one that Spark splits where it is skewed.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    ).withColumn("key", F.monotonically_increasing_id())
    rows = rows.withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.expr("sha1(cast(html AS binary))"))
    long = F.col("n_bytes") >= min_dedup_bytes
    winners = (
        rows.filter(long)
        .groupBy("digest", "n_bytes")
        .agg(F.max(F.struct("id", "key")).alias("rep"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("digest", "n_bytes", F.col("rep.id").alias("rep_id"), F.col("rep.key").alias("rep_key"))
    )
    return rows.join(winners, ["digest", "n_bytes"], "left").withColumn("is_revisit", F.expr("rep_key IS NOT NULL AND rep_key <> key"))


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_dedup_bytes: int = 1000,
    segment_chars: int = 32_768,
    chunk_chars: int = 4_096,
    records_per_file: int = 500,
    date: str = "2020-01-01T00:00:00Z",
) -> None:
    """Write one archive record per page (and its continuations) under ``path``, a new folder of any store."""
    rows = with_roles(pages, id_col=id_col, url_col=url_col, html_col=html_col, min_dedup_bytes=min_dedup_bytes)
    rows = rows.withColumn("record", F.expr(_urn("concat('record ', key)"))).withColumn("rep_record", F.expr(_urn("concat('record ', rep_key)")))
    rows = rows.withColumn("uri", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20"))
    # At most 256 chunks and 256 segments a page, so that cutting a very long text stays linear.
    rows = rows.withColumn("chunk", F.expr(f"greatest({chunk_chars}, ceil(char_length(html) / 256))"))
    chunks = f"array_join(transform({_pieces('html', 'chunk')}, c -> if(c = '', '', concat(lower(hex(octet_length(c))), '{CRLF}', c, '{CRLF}'))), '')"
    full = f"concat('{HTTP_HEAD}', '{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}', {chunks}, '0{CRLF}{CRLF}')"
    bare = f"concat('{HTTP_HEAD}', '{CRLF}Content-Length: ', n_bytes, '{CRLF}{CRLF}')"
    rows = rows.withColumn("block", F.expr(f"if(is_revisit, {bare}, {full})"))
    rows = rows.withColumn("per", F.expr(f"greatest({segment_chars}, ceil(char_length(block) / 256))"))
    rows = rows.withColumn("segments", F.expr(_pieces("block", "per")))
    rows = rows.withColumn("total", F.octet_length("block")).withColumn("n", F.size("segments"))
    # Outer, for Spark puts a filter that works out all of the above again under any other explosion.
    cut = rows.select("id", "key", "record", "rep_record", "rep_id", "uri", "digest", "is_revisit", "total", "n", F.posexplode_outer("segments").alias("at", "segment"))

    def line(name: str, value: str, when: str = "true") -> str:
        return f"if({when}, concat('{name}: ', {value}), null)"

    head = [
        "'WARC/1.1'",
        f"concat('WARC-Type: ', CASE WHEN at > 0 THEN 'continuation' WHEN is_revisit THEN 'revisit' ELSE 'response' END)",
        line("WARC-Record-ID", f"if(at = 0, record, {_urn("concat('record ', key, ' segment ', at)")})"),
        f"'WARC-Date: {date}'",
        line("WARC-Target-URI", "uri"),
        line("X-Page-Id", "cast(id AS string)", "at = 0 AND id IS NOT NULL"),
        line("WARC-Payload-Digest", "concat('sha1:', digest)", "at = 0"),
        line("WARC-Segment-Number", "at + 1", "n > 1"),
        line("WARC-Segment-Origin-ID", "record", "at > 0"),
        line("WARC-Segment-Total-Length", "total", "at > 0 AND at = n - 1"),
        line("WARC-Profile", f"'{REVISIT_PROFILE}'", "is_revisit AND at = 0"),
        line("WARC-Refers-To", "rep_record", "is_revisit AND at = 0"),
        line("X-Refers-To-Page-Id", "cast(rep_id AS string)", "is_revisit AND at = 0 AND rep_id IS NOT NULL"),
        "'Content-Type: application/http; msgtype=response'",
        line("Content-Length", "octet_length(segment)"),
    ]
    record = f"concat(concat_ws('{CRLF}', {', '.join(head)}), '{CRLF}{CRLF}', segment, '{CRLF}')"
    out = cut.select(F.expr(record).alias("value"))
    # Each row lacks the last line end of its record, which the writer adds.
    out.write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed archive."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:stop].decode("utf-8").split(CRLF)
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        first = stop + 4
        after = first + int(head["content-length"])
        if data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield head, data[first:after]
        at = after + 4


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file; other data as they are."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out += [d.decompress(data), d.flush()]
        data = d.unused_data
    return b"".join(out)


def dechunk(body: bytes) -> bytes | None:
    """The content of a body in chunked transfer coding, or null where the framing is broken."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        size = body[at:stop].split(b";")[0].strip() if stop >= 0 else b""
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size):
            return None
        n, at = int(size, 16), stop + 2
        if n == 0:
            return b"".join(out) if body.endswith(b"\r\n\r\n") or body[at:] == b"\r\n" else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(CRLF)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for files in batches:
        for content in files.column(0):
            rows, size = [], 0
            for head, block in parse_records(gunzip(content.as_py())):
                if head["warc-type"] not in ("response", "revisit", "continuation"):
                    continue
                length = None
                if head["warc-type"] == "revisit":
                    length = split_http(block)[0].get("content-length")
                rows.append(
                    (
                        head.get("warc-segment-origin-id", head["warc-record-id"]),
                        int(head["warc-segment-number"]) if "warc-segment-number" in head else None,
                        int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None,
                        head["warc-type"],
                        head.get("x-page-id"),
                        head.get("warc-target-uri"),
                        head.get("x-refers-to-page-id"),
                        None if length is None else int(length),
                        head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        block,
                    )
                )
                size += len(block)
                if size > 4_000_000:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


def _open_payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take HTTP head and chunk framing off whole blocks, and check them against the digest of the record."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            payload, length, digest, ok = None, row["payload_bytes"], row["payload_digest"], row["complete"]
            if row["record_type"] == "response" and ok:
                head, body = split_http(row["block"])
                payload = dechunk(body) if head.get("transfer-encoding", "").lower() == "chunked" else body
                ok = payload is not None
                if ok:
                    length, found = len(payload), sha1(payload).hexdigest()
                    ok, digest = digest in (None, found), found
            out.append((row["origin"], row["record_type"], row["page_id"], row["target_uri"], row["refers_to"], length, digest, payload if ok else None, row["n_segments"], ok))
        if out:
            names = [x.split()[0] for x in RECORD.split(", ")]
            kinds = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record under ``path``, segments joined: the columns of ``RECORD``.

    The groups of the reassembly are the segments of one record, so no group is larger than its record.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = files.mapInArrow(_parse_files, _PARSED)
    fields = ["record_type", "page_id", "target_uri", "refers_to", "payload_bytes", "payload_digest"]
    single = parsed.filter("segment IS NULL").select("origin", *fields, "block", F.lit(1).alias("n_segments"), F.lit(True).alias("complete"))
    parts = F.array_sort(F.collect_list(F.struct("segment", "block")))
    joined = (
        parsed.filter("segment IS NOT NULL")
        .groupBy("origin")
        .agg(parts.alias("parts"), F.max("total").alias("total"), *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in fields])
        .withColumn("block", F.expr("aggregate(parts, cast('' AS binary), (a, p) -> concat(a, p.block))"))
        .withColumn("n_segments", F.size("parts"))
        .withColumn("complete", F.expr("record_type IS NOT NULL AND coalesce(total = octet_length(block), false) AND parts.segment = sequence(1, n_segments)"))
        .select("origin", F.expr("coalesce(record_type, 'continuation')").alias("record_type"), *fields[1:], "block", "n_segments", "complete")
    )
    return single.unionByName(joined).mapInArrow(_open_payloads, RECORD)


def round_trip(pages: DataFrame, folder: str, *, id_col: str = "page_id", **options) -> DataFrame:
    """Write ``pages`` to a new archive under ``folder``, read it back, and give one row per page: id,
    ``payload_bytes``, ``payload_digest`` (bare lower-case hex SHA-1), ``record_type``, ``refers_to`` (the page id of the
    response for a revisit, else null), ``n_segments`` and ``complete``."""
    path = f"{folder.rstrip('/')}/warc-{uuid4().hex}"
    kind = pages.schema[id_col].dataType.simpleString()
    write_warc(pages, path, id_col=id_col, **options)
    back = read_warc(pages.sparkSession, path)
    return back.select(
        F.col("page_id").cast(kind).alias(id_col),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "n_segments",
        "complete",
    )
