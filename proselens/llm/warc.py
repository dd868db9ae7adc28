"""WARC archives with an index first (operator 9).

Writing streams each partition's records into archive files, one gzip member
per record, and yields an index row per record: file, offset, length, URL and
digest.  Reading takes any selection of the index, sorts it by file and
offset, joins neighbouring byte ranges into one read, and checks every payload
against its digest.  Equal payloads are stored once: the record of the
smallest page id is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proselens.llm.common import Scratch, join_on_hot_key, pick, ship

INDEX = ("page_id long, url string, file string, offset long, length long, payload_digest string, "
         "payload_bytes long, record_type string, refers_to long")
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, payload binary")
SEGMENT_BYTES = 256 << 20
# Bytes of records that one task reads back.
READ_BYTES = 64 << 20
_LINE = "\r\n"


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(value: str | None) -> int | None:
    digits = (value or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           is_revisit: bool, date: str) -> bytes:
    """One WARC record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        head += [f"WARC-Refers-To: {_id(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = (_LINE.join(head) + _LINE * 2).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises when its digest does not hold."""
    data = zlib.decompress(raw, 31)
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "surrogatepass").split(_LINE)[1:]
    head = dict(x.split(": ", 1) for x in lines)
    block = data[end + 4:end + 4 + int(head["Content-Length"])]
    payload = block[block.index(b"\r\n\r\n") + 4:]
    if head["WARC-Type"] == "response" and sha1(payload) != head["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return head, payload


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, scratch: Scratch, least_revisit_bytes: int = 0,
                   segment_bytes: int = SEGMENT_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; returns their INDEX.

    A null html is an empty payload.  Rows that repeat the smallest page id of
    their payload are responses as well.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pick(pages, "page_id", "url", "html").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    firsts = scratch.write(
        rows.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")), "digests")
    total = firsts.agg(F.sum("_n")).first()[0] or 0
    joined = join_on_hot_key(rows, firsts, "sha", total=total).select("page_id", "url", "html", "first")
    folder = scratch.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        try:
            for batch in batches:
                index = []
                for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = html.encode("utf-8", "surrogatepass")
                    revisit = page != first and first is not None and len(payload) >= least_revisit_bytes
                    digest = sha1(payload)
                    raw = record(page, url, payload, digest, first, revisit, date)
                    if out is None or out.tell() > segment_bytes:
                        if out is not None:
                            out.close()
                        # a name of its own for each attempt: a repeated task
                        # never writes over what another has indexed
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    index.append((page, url, f"{folder}/{name}", out.tell(), len(raw), digest, len(payload),
                                  "revisit" if revisit else "response", first if revisit else None))
                    out.write(raw)
                yield _batch(index, INDEX)
        finally:
            if out is not None:
                out.close()

    return scratch.write(joined.mapInArrow(run, INDEX), "index")


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.strip().split(" ") for c in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


def ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[int]]]:
    """Join sorted (file, offset, length) rows at most ``gap`` bytes apart into
    reads of at most ``most`` bytes (one record may be longer): (file, start,
    end, rows)."""
    here: tuple[str, int, int, list[int]] | None = None
    for i, (file, offset, length) in enumerate(rows):
        end = offset + length
        if here and here[0] == file and offset <= here[2] + gap and end - here[1] <= most:
            here = (file, here[1], max(here[2], end), here[3] + [i])
        else:
            if here:
                yield here
            here = (file, offset, end, [i])
    if here:
        yield here


def read_records(index: DataFrame, with_payload: bool = True, gap: int = 64 << 10, most: int = 8 << 20,
                 task_bytes: int = READ_BYTES) -> DataFrame:
    """Records of the selected index rows: RECORD, parsed from the archives.
    A revisit has no payload of its own (null).  Tasks are counted by the bytes
    of the records, not of their index rows."""
    ship(index.sparkSession)
    count = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // task_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held: tuple[str, object] | None = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for file, start, end, members in ranges(rows, gap, most):
                if held is None or held[0] != file:
                    store, path = fs.FileSystem.from_uri(file)
                    if held:
                        held[1].close()
                    held = (file, store.open_input_file(path))
                held[1].seek(start)
                data = held[1].read(end - start)
                out = []
                for i in members:
                    at = rows[i][1] - start
                    head, payload = parse(data[at:at + rows[i][2]])
                    revisit = head["WARC-Type"] == "revisit"
                    out.append((_page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"),
                                int(head["Payload-Length"]) if revisit else len(payload),
                                head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"],
                                _page(head.get("WARC-Refers-To")) if revisit else None,
                                payload if with_payload and not revisit else None))
                yield _batch(out, RECORD)
        if held:
            held[1].close()

    order = ["file", "offset"]
    tasks = index.select("file", "offset", "length").repartitionByRange(count, *order).sortWithinPartitions(*order)
    return tasks.mapInArrow(run, RECORD)


def archive_and_read(pages: DataFrame, least_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages, read all records back: RECORD without payloads.  Null
    html is empty, null urls have no target header, repeated rows have a record
    each, an empty table gives no rows, other columns are ignored."""
    scratch = Scratch(pages.sparkSession, "warc")
    return read_records(write_archives(pages, scratch, least_revisit_bytes), with_payload=False).drop("payload")
