"""WARC archives, written index first and read back by coalesced byte ranges.

Records are deduplicated by payload: of equal payloads the record with the
smallest id is a ``response`` and the others are ``revisit`` records that name
it. A payload's digest and size are grouped in narrow rows; the texts then move
through one shuffle, the join on the digest, which adaptive execution splits
where copies are many. Every task of that join writes one archive, a gzip member
a record, in a file named by its partition and attempt: an attempt never touches
another's bytes, and the index (file, offset, length, page, url, digest, type),
which the writing job returns and Spark commits for one attempt of each task,
names the files that count. Files of attempts that didn't are deleted.

Reading takes index rows, sorts them by file and offset, joins ranges whose gaps
are small into spans of bounded size, reads each span once and checks every
record's digest. Its tasks are as many as the bytes to be read ask for, each
reading whole sections of ``GROUP_BYTES``.

Defined results: null html is an empty payload; a null url leaves out the target
line; rows that repeat both the smallest id and the payload are responses each;
a row with a null id is a revisit if an equal payload has an id, else a response;
payloads below ``least_bytes`` are all responses; a payload of any length is one
record; an empty table gives an empty index; other columns are ignored.
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

from . import common

LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
GAP_BYTES = 1 << 16
SPAN_BYTES = 1 << 22
GROUP_BYTES = 1 << 23
MOST_TASKS = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"


def _base32_sha1(payload):
    """Bare upper-case base32 of SHA-1 in SQL: five hex digits are four base32 digits."""
    h = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is None:
        body = HTTP + payload
    else:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
        body = HTTP
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(1, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """(header lines by name, payload) of one gzip member."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(named["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return named, body[len(HTTP) :]


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``folder/part-*.warc.gz`` and ``folder/index``; the index's rows."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), _base32_sha1(payload).alias("digest"))
    first = base.filter(F.octet_length("payload") >= least_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first_id"))
    rows = base.join(first, base["digest"] == first["d"], "left")
    again = F.col("first_id").isNotNull() & (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    # a revisit needs the payload's size alone, not the payload
    rows = rows.select("page_id", "url", "payload", "digest", F.when(again, F.col("first_id")).alias("refers_to"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        return archived(batches, folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz")

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    drop_orphans(folder, {r.file for r in index.select("file").distinct().collect()})  # a name for each task
    return index


def archived(batches, folder: str, name: str) -> Iterator[pa.RecordBatch]:
    """Writes rows (page_id, url, payload, digest, refers_to) to the file and gives
    their index rows. A failure leaves no file."""
    store, root = _open(folder)
    at, out = 0, None
    try:
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(5)]
            offsets, lengths = [], []
            for page, url, data, digest, ref in zip(*cols, strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}", compression=None)  # members are packed already
                member = _record(page, url, data, digest, ref)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            kinds = ["response" if r is None else "revisit" for r in cols[4]]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(kinds), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), batch.column(0), batch.column(1), batch.column(3), pa.array(kinds, pa.string()), batch.column(4)], ["file", "offset", "length", "page_id", "url", "digest", "record_type", "refers_to"])
    except BaseException:
        if out is not None:
            out.close()
            store.delete_file(f"{root}/{name}")
        raise
    if out is not None:
        out.close()


def drop_orphans(folder: str, named: set[str]) -> None:
    """Deletes archives that the index doesn't name, of attempts that were lost."""
    from pyarrow import fs

    store, root = _open(folder)
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.endswith(".warc.gz") and info.base_name not in named:
            store.delete_file(info.path)


def spans(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = SPAN_BYTES) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) joined to (start, end, count) spans: neighbours at
    most ``gap`` apart share one while it stays within ``most`` bytes."""
    out: list[list[int]] = []
    for offset, length in ranges:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][1], out[-1][2] = max(out[-1][1], offset + length), out[-1][2] + 1
        else:
            out.append([offset, offset + length, 1])
    return [tuple(s) for s in out]


def read_records(index: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload])
    of the selected index rows, from the archives' bytes alone. A revisit's
    size and digest are those of the payload it refers to."""
    ranges = index.select("file", "offset", "length", F.floor(F.col("offset") / GROUP_BYTES).alias("part"))

    def records(data: memoryview, base: int, rows):
        for offset, length in rows:
            head, payload = parse_record(data[offset - base : offset - base + length])
            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
            ref = head.get("WARC-Refers-To")
            size = int(head["X-Payload-Length"])
            if ref is None and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError("a payload doesn't match its digest")
            number = lambda urn: None if urn in (None, "<urn:x-page:None>") else int(urn[len("<urn:x-page:") : -1])
            yield number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], number(ref), payload

    def run(batches) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        name = file = None
        for batch in batches:
            names, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if names[at] != name:
                    if file is not None:
                        file.close()
                    name = names[at]
                    file = store.open_input_file(f"{root}/{name}")
                rows = list(zip(offsets[at:end], lengths[at:end], strict=True))
                done = 0
                for lo, hi, n in spans(rows):
                    data = memoryview(file.read_at(hi - lo, lo))
                    got = list(zip(*records(data, lo, rows[done : done + n]), strict=True))
                    done += n
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())[: 5 + with_payload]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(got, kinds, strict=False)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 5 + with_payload])
                at = end
        if file is not None:
            file.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    held = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, min(MOST_TASKS, -(-held // GROUP_BYTES)))
    return ranges.repartition(tasks, "file", "part").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(run, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    return read_records(write_archives(common.table(spark, sf_dir, "pages"), folder), folder)
