"""Archives survive attempts that are lost; reading is parted by bytes."""

import hashlib
import os

import pyarrow as pa
import pytest

from orrery.llm import common, warc

NAMES = ["page_id", "url", "payload", "digest", "refers_to"]


def batch(rows):
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], NAMES)


def page(i):
    data = f"payload {i}".encode()
    return (i, f"http://u/{i}", data, warc.base64.b32encode(hashlib.sha1(data).digest()).decode(), None)


def test_attempts_of_a_task_do_not_touch_each_other(spark):
    folder = common.scratch(spark, "warc-attempts")
    rows = [page(i) for i in range(6)]
    lost = list(warc.archived([batch(rows[::-1])], folder, "part-000000-1.warc.gz"))  # finished, never committed

    def broken():
        yield batch(rows[:3])
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        list(warc.archived(broken(), folder, "part-000000-2.warc.gz"))
    _, root = warc._open(folder)
    assert sorted(os.listdir(root)) == ["part-000000-1.warc.gz"]  # the failed one left nothing
    kept = pa.Table.from_batches(list(warc.archived([batch(rows)], folder, "part-000000-3.warc.gz")))
    assert lost[0].column(1).to_pylist() != kept.column("offset").to_pylist()  # rows came in another order
    index = spark.createDataFrame(kept.to_pandas().astype(object).where(lambda x: x.notna(), None).values.tolist(), warc.INDEX)
    warc.drop_orphans(folder, {r.file for r in index.select("file").distinct().collect()})
    assert sorted(os.listdir(root)) == ["part-000000-3.warc.gz"]
    got = {r.page_id: bytes(r.payload) for r in warc.read_records(index, folder, with_payload=True).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_repeats_long_payloads_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(warc, "GROUP_BYTES", 1 << 10)
    long = "".join(chr(33 + (i * i) % 90) for i in range(3_000_000))
    rows = [(1, "u", long, "x", 1), (2, "v", long, "y", 2), (1, "u", long, "x", 1), (3, "w", "", None, None), (4, None, None, None, None)]
    rows += [(100 + i, "u", f"page {i}", "d", 0) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, offset int")
    folder = common.scratch(spark, "warc-odd")
    index = warc.write_archives(pages, folder)
    frame = warc.read_records(index, folder)
    assert frame.rdd.getNumPartitions() > 1
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in frame.collect())
    assert got[:5] == [(1, "response", None, len(long)), (1, "response", None, len(long)), (2, "revisit", 1, len(long)), (3, "response", None, 0), (4, "revisit", 3, 0)]
    assert len(got) == len(rows) and all(r[1] == "response" for r in got[5:])
