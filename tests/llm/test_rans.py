"""Checkpoints are used: single documents, runs of long blocks; checksums hold."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orrery.llm import common, rans


def coded(n, docs=1, seed=1):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.3, n), 49000).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    table = rans.Table(symbols.astype(np.int64), rans.scaled(symbols.astype(np.int64), counts.astype(np.int64)))
    cuts = np.sort(rng.choice(n, docs - 1, replace=False)) if docs > 1 else np.zeros(0, int)
    lengths = np.diff(np.concatenate([[0], cuts, [n]]))
    return ids, lengths, table, rans.encode_block(ids, np.arange(docs), np.zeros(docs), lengths, table)


def test_ordinary_blocks_have_checkpoints():
    _, _, _, data = coded(rans.BLOCK_TOKENS + 100)
    assert len(rans.read_block(data)[7]) >= 4  # the start and three more
    assert len(data) < 0.2 * 4 * rans.BLOCK_TOKENS * 3


def test_a_document_is_read_from_the_checkpoint_before_it(monkeypatch):
    ids, lengths, table, data = coded(rans.BLOCK_TOKENS, docs=200)
    block, ends = rans.read_block(data), np.cumsum(lengths)
    steps, plain = [], rans.decode_run
    monkeypatch.setattr(rans, "decode_run", lambda t, lanes, n, words, mark, stop: steps.append((mark[0], stop)) or plain(t, lanes, n, words, mark, stop))
    for k in (0, 57, 120, 199):
        lo, hi = int(ends[k] - lengths[k]), int(ends[k])
        assert (rans.decode_range(block, table, lo, hi) == ids[lo:hi]).all()
    last = -(-rans.BLOCK_TOKENS // block[1])
    assert steps[0][0] == 0 and steps[-1][0] >= last - rans.CHECK_STEPS and all(b - a <= rans.CHECK_STEPS + 3 for a, b in steps)


def test_crc32_joined():
    rng = np.random.default_rng(2)
    for a, b in ((0, 0), (0, 5), (7, 0), (1000, 12345)):
        x, y = rng.bytes(a), rng.bytes(b)
        assert rans.crc32_joined(zlib.crc32(x), zlib.crc32(y), b) == zlib.crc32(x + y)


ROWS = [(i, f"some words of document {i} " * (1 + i % 7)) for i in range(40)] + [(100, "a very long text goes on and on " * 30000), (101, None), (None, "null id"), (101, "again"), (102, "z " * 5000)]


@pytest.fixture(scope="module")
def stored(spark):
    out = common.scratch(spark, "rans-test")
    rans.encode_documents(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3), out, rans.default_tokenizer(), block_tokens=20_000)
    return out


def test_long_blocks_are_decoded_by_run(spark, stored, monkeypatch):
    want = sorted(rans.read_documents(spark, stored).collect(), key=lambda r: r.start)
    long = rans.read_documents(spark, stored, long_tokens=10_000, with_ids=True)
    got = sorted(long.collect(), key=lambda r: r.start)
    assert [tuple(r)[:4] for r in got] == [tuple(r) for r in want] and len(got) == len(ROWS)
    lib = {i: Tokenizer.from_file(rans.default_tokenizer()).encode(t or "", add_special_tokens=False).ids + [2] for i, t in ROWS if i in (100, 102)}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and (r.doc_id not in lib or r.ids == lib[r.doc_id])
    blocks = spark.read.parquet(f"{stored}/blocks").collect()
    assert max(len(rans.read_block(bytes(b.payload))[7]) for b in blocks) >= 4


def test_single_documents(spark, stored):
    want = {(r.doc_id, r.start): r for r in rans.read_documents(spark, stored, with_ids=True).collect()}
    some = rans.read_documents(spark, stored, with_ids=True, only=[5, 101, 102, 77]).collect()
    assert sorted(r.doc_id for r in some) == [5, 101, 101, 102] and all(want[r.doc_id, r.start] == r for r in some)


def test_equal_rows_are_kept(spark):
    frame = spark.createDataFrame([(7, "the same")] * 500 + [(1, "x"), (9, "y")], "doc_id long, text string")
    got = rans.round_trip(frame).collect()
    assert len(got) == 502 and sorted(r.start for r in got)[:3] == [0, 2, 2 + max(r.n_tokens for r in got if r.doc_id == 7)]
    assert max(r.start for r in got if r.doc_id == 7) < [r.start for r in got if r.doc_id == 9][0]
