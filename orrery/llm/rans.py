"""Token-id output coded by a static range asymmetric numeral system (rANS).

``encode_documents`` tokenises every text, counts the ids of the whole corpus
into one shared frequency table, orders the documents by id and writes them as
independent blocks. A block is one binary record:

    magic "rA1\\0" | version, precision bits, lanes, steps between checkpoints |
    documents, tokens, words, checkpoints | crc32 of the ids | crc32 of the body |
    body: document ids, null flags, document lengths, lane states at the start,
          checkpoints (step, word offset, lane states), 32-bit words

Token t of a block belongs to lane ``t % lanes``; all lanes share one word
stream, so numpy steps all of them together. A checkpoint holds the lane
states and the word offset at a step, so decoding may begin there: an ordinary
block has three. Reading decodes the runs between them: the blocks' by a task
each, but a block of ``LONG_TOKENS`` or more, as a very long document makes one,
is parted into its runs, which are dealt out and decoded by tasks of their own; a
document's checksum is then combined from its runs'. Single documents are decoded
from the checkpoint before them. Both checksums are verified on reading.

Defined results: null text counts as empty (its document holds the end id
alone); null ids sort first; repeated ids keep one entry each, ordered by their
content, and rows equal in both may be parted over tasks; an empty table gives no
blocks and no rows; other columns are ignored. Documents never span blocks, so a
block is as large as its longest document.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 20
LOW = np.uint64(1 << 31)
MASK32 = np.uint64(0xFFFFFFFF)
BLOCK_TOKENS = 1 << 18
MAX_LANES = 1024
CHECK_STEPS = 64
LONG_TOKENS = 1 << 20
CACHE_WORDS = 1_000_000
END_ID = 2
#: A word that a lower-casing tokenizer leaves whole: small Latin-1 letters.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
HEAD = struct.Struct("<4sHHIIIIIIII")
MAGIC = b"rA1\0"


# ---------------------------------------------------------------- tokeniser


class WordTokenizer:
    """Whole-text encoding through a cache of words, vectorised over a batch.

    Exact for tokenizers that lower-case and whose pre-tokenizer drops white
    space and parts letters from punctuation, as ``path``'s does. Words are
    parted at plain blanks only; any other white space stays inside a word and
    is left to the library. Words of Latin-1 letters are lower-cased and a final
    ``.`` or ``,`` is split off; both is what the library does. New words are
    encoded by the library, together, parted by a special token. Words of up to
    24 bytes live in an open-addressing table that compares all their bytes;
    longer ones in a dictionary. Both are emptied when ``CACHE_WORDS`` is passed.
    """

    SEP = "<|startoftext|>"
    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # small Latin-1 letters pass the normalizer and the splitting pattern unchanged: the model alone does them
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.stop_id = self.bare.encode(".").ids[0]
        self.sep_id = self.tok.token_to_id(self.SEP)
        letters = np.zeros(256, bool)
        letters[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = True
        self.letters, self.lower = letters, np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self._clear()

    def _clear(self) -> None:
        self.used, self.n_ids, self.long = 0, 0, {}
        self.table, self.key = np.full(1 << 18, -1, np.int32), np.zeros((4, 1 << 16), np.uint64)
        self.flat, self.start, self.size = np.zeros(1 << 18, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    @staticmethod
    def _grown(x: np.ndarray, n: int) -> np.ndarray:
        while x.shape[-1] < n:
            x = np.concatenate([x, np.zeros_like(x)], axis=-1)
        return x

    def _add(self, words: list[bytes]) -> int:
        """Encodes new words; the code of the first."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [PLAIN(t) is not None for t in texts]
        ids_of: list = [None] * len(texts)
        for tok, sep, sep_id, which in ((self.bare, " . ", self.stop_id, True), (self.tok, f" {self.SEP} ", self.sep_id, False)):
            own = [i for i, p in enumerate(plain) if p == which]
            groups = [own[i : i + 256] for i in range(0, len(own), 256)]
            for group, enc in zip(groups, tok.encode_batch_fast([sep.join([texts[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(enc.ids, np.uint32)
                cuts = np.flatnonzero(ids == sep_id)
                if len(cuts) == len(group) - 1:
                    lo = 0
                    for i, hi in zip(group, [*cuts.tolist(), len(ids)], strict=True):
                        ids_of[i] = ids[lo:hi]
                        lo = hi + 1
                else:  # a word holds the separator itself
                    for i in group:
                        ids_of[i] = np.array(tok.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        got, sizes = ids_of, [np.array([len(x) for x in ids_of])]
        size, ids, first = np.concatenate(sizes), np.concatenate(got), self.used
        self.used, self.n_ids = first + len(words), self.n_ids + len(ids)
        self.flat, self.start, self.size = self._grown(self.flat, self.n_ids), self._grown(self.start, self.used), self._grown(self.size, self.used)
        self.flat[self.n_ids - len(ids) : self.n_ids] = ids
        self.size[first : self.used] = size
        self.start[first : self.used] = self.n_ids - len(ids) + np.cumsum(size) - size
        return first

    def _find(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        code, at, todo = np.full(len(h), -1, np.int32), (h & np.uint64(len(self.table) - 1)).view(np.int64), np.arange(len(h))
        while len(todo):
            c = self.table[at]
            some = c >= 0
            c, at, todo = c[some], at[some], todo[some]
            hit = np.ones(len(c), bool)
            for k in range(4):
                hit &= self.key[k][c] == key[k][todo]
            code[todo[hit]] = c[hit]
            at, todo = (at[~hit] + 1) & (len(self.table) - 1), todo[~hit]
        return code

    def _place(self, first: int, h: np.ndarray) -> None:
        at, todo = (h & np.uint64(len(self.table) - 1)).view(np.int64), np.arange(first, first + len(h), dtype=np.int32)
        while len(todo):
            free = np.flatnonzero(self.table[at] < 0)
            spot, i = np.unique(at[free], return_index=True)
            self.table[spot] = todo[free[i]]
            left = np.ones(len(todo), bool)
            left[free[i]] = False
            at, todo = at[left], todo[left]
            at = np.where(self.table[at] < 0, at, (at + 1) & (len(self.table) - 1))

    def _hash(self, key: np.ndarray) -> np.ndarray:
        h = key[0] * self.MIX[0]
        for k in (1, 2, 3):
            h = (h ^ (h >> np.uint64(31)) ^ key[k]) * self.MIX[k]
        return h ^ (h >> np.uint64(29))

    def _codes(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The code of each span of the padded buffer."""
        lanes = np.ndarray((len(buf) - 7,), "<u8", buf.data, 0, (1,))
        key = np.empty((4, len(start)), np.uint64)
        for k in range(3):
            key[k] = lanes[start + 8 * k] & self.MASKS[np.clip(size - 8 * k, 0, 8)]
        key[3] = size
        short = size <= 24
        if short.all():
            return self._short(buf, start, size, key)
        code = np.empty(len(start), np.int32)
        code[short] = self._short(buf, start[short], size[short], key[:, short])
        rest = np.flatnonzero(~short)
        words = [buf[s : s + n].tobytes() for s, n in zip(start[rest], size[rest], strict=True)]
        new = list(dict.fromkeys(w for w in words if w not in self.long))
        if new:
            first = self._add(new)
            self.key = self._grown(self.key, self.used)
            self.key[3, first : self.used] = 0  # never equal to a short word's
            self.long.update(zip(new, range(first, self.used), strict=True))
        code[rest] = [self.long[w] for w in words]
        return code

    def _short(self, buf, start, size, key) -> np.ndarray:
        h = self._hash(key)
        code = self._find(key, h)
        while len(missing := np.flatnonzero(code < 0)):
            _, i = np.unique(h[missing], return_index=True)
            new = missing[i]
            first = self._add([buf[s : s + n].tobytes() for s, n in zip(start[new].tolist(), size[new].tolist(), strict=True)])
            self.key = self._grown(self.key, self.used)
            self.key[:, first : self.used] = key[:, new]
            if 2 * self.used > len(self.table):
                self.table = np.full(4 * len(self.table), -1, np.int32)
                held = np.flatnonzero(self.key[3, : self.used])
                order = self._hash(self.key[:, : self.used])
                for lo, hi in _runs(held):
                    self._place(lo, order[lo:hi])
            else:
                self._place(first, h[new])
            code[missing] = self._find(key[:, missing], h[missing])
        return code

    def encode(self, texts: list[str | None], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        if self.used > CACHE_WORDS:
            self._clear()
        raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        text_at = np.cumsum([0] + [len(r) + 1 for r in raw])
        buf = np.frombuffer(b" ".join(raw) + b" " * 33, np.uint8).copy()
        # Latin-1 letters; of C3's second bytes 97 and B7 are signs, 80-9E capitals
        tail = np.zeros(len(buf), bool)
        tail[1:] = buf[:-1] == 0xC3
        good = self.letters[buf]
        good &= ~(tail & ((buf == 0x97) | (buf == 0xB7)))
        good &= (buf < 0x80) | (buf == 0xC3) | tail
        blank = (buf == 32) | (buf == 10) | (buf == 9) | (buf == 13)
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(buf) and not blank[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        bad = np.cumsum(~good)
        cut = ((buf[end - 1] == 46) | (buf[end - 1] == 44)) & (end - start > 1)
        last = end - cut
        plain = bad[last - 1] - bad[start] + ~good[start] == 0
        cut &= plain
        last = end - cut
        mark = np.zeros(len(buf) + 1, np.int8)
        mark[start[plain]] = 1
        mark[last[plain]] -= 1
        inside = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
        low = self.lower[buf]
        low = np.where(tail & (buf >= 0x80) & (buf <= 0x9E), buf + np.uint8(32), low)
        buf = np.where(inside, low, buf)
        # a cut-off sign follows its word
        n = 1 + cut.astype(np.int64)
        at = np.cumsum(n) - n
        s, size = np.repeat(start, n), np.ones(int(n.sum()), np.int64)
        size[at] = last - start
        s[at[cut] + 1] = last[cut]
        code = self._codes(buf, s, size) if len(s) else np.zeros(0, np.int32)
        lens, starts = self.size[code], self.start[code]
        upto = np.concatenate([[0], np.cumsum(lens)])
        bound = upto[np.searchsorted(s, text_at)]
        bound[-1] = upto[-1]
        ids = self.flat[np.repeat(starts - upto[:-1], lens) + np.arange(int(upto[-1]))]
        n_ids = np.diff(bound)
        if end_id is not None:
            ids = np.insert(ids, bound[1:], end_id)
            n_ids = n_ids + 1
        return ids, n_ids


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) != 1)
    return list(zip(x[np.concatenate([[0], cut + 1])].tolist(), (x[np.concatenate([cut, [len(x) - 1]])] + 1).tolist(), strict=True))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a Python worker; its cache lives as long as the worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def _small(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` characters, at least a text each."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def tokenised(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(doc_id, n, width, ids): the ids as zstd-packed little-endian integers of so
    many bytes; a task's last row, of width 0, has the counts of all its ids."""

    def run(batches):
        tok, pack, total = tokenizer(path), zstandard.ZstdCompressor(level=1), np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _small(texts):
                ids, n = tok.encode(texts[lo:hi], end_id)
                got = np.bincount(ids)
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
                wide = ids.astype("<u4") if len(ids) and ids.max() > 0xFFFF else ids.astype("<u2")
                cuts = np.cumsum(n)
                blobs = [pack.compress(wide[hi - k : hi].tobytes()) for hi, k in zip(cuts, n, strict=True)]
                size = pa.array(np.full(len(n), wide.dtype.itemsize, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), size, pa.array(blobs, pa.binary())], ["doc_id", "n", "width", "ids"])
        some = np.flatnonzero(total)
        held = np.stack([some, total[some]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(some)], pa.int64()), pa.array([0], pa.int32()), pa.array([held], pa.binary())], ["doc_id", "n", "width", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(common.trimmed(run), "doc_id long, n long, width int, ids binary")


def _unpack(unpacker, blob: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(unpacker.decompress(blob, max_output_size=max(1, n * width)), f"<u{width}").astype(np.uint32)


# -------------------------------------------------------- frequency tables


def symbol_counts(ids: DataFrame) -> DataFrame:
    """(symbol, n) over all documents, from the tasks' counts: one row a symbol and task is shuffled."""

    def run(batches):
        for batch in batches:
            for held in batch.column(0).to_pylist():
                symbols, counts = np.frombuffer(held, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(symbols.astype(np.int32)), pa.array(counts)], ["symbol", "n"])

    return ids.filter("width = 0").select("ids").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def scaled(symbols: np.ndarray, counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for every symbol that occurs."""
    total, room = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(0, np.int64)
    if len(symbols) > room:
        raise ValueError("more symbols than the precision can hold")
    freq = np.maximum(1, counts * room // total)
    rest = room - int(freq.sum())
    order = np.lexsort((symbols, -counts))
    if rest > 0:
        freq[order[0]] += rest
    while rest < 0:  # only where many symbols were lifted to 1
        for i in order:
            take = min(-rest, int(freq[i]) - 1, max(1, int(freq[i]) // 8))
            freq[i] -= take
            rest += take
            if not rest:
                break
    return freq


class Table:
    """Dense lookups of one frequency table."""

    def __init__(self, symbols, freq, bits: int = BITS):
        self.bits, size = bits, (int(symbols.max()) + 1 if len(symbols) else 1)
        order = np.argsort(symbols)
        self.freq, self.cum = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.freq[symbols[order]] = freq[order]
        self.cum[symbols[order]] = np.cumsum(freq[order]) - freq[order]
        self.slots = np.repeat(np.asarray(symbols)[order], freq[order]).astype(np.uint32)


# ------------------------------------------------------------------ blocks


def lanes_for(n: int) -> int:
    lanes = 1
    while lanes < MAX_LANES and n >= lanes * 2 * 64:
        lanes *= 2
    return lanes


def encode_block(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    freq, cum = table.freq[ids], table.cum[ids]
    most, bits = freq << np.uint64(63 - table.bits), np.uint64(table.bits)
    x, out, marks, sent = np.full(lanes, LOW, np.uint64), [], [], 0
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        f, xa = freq[a:b], x[: b - a]
        over = xa >= most[a:b]
        words = xa[over]
        if len(words):
            out.append((words & MASK32).astype("<u4"))
            sent += len(words)
            xa[over] = words >> np.uint64(32)
        q = xa // f
        x[: b - a] = (q << bits) + (xa - q * f) + cum[a:b]
        if s and s % CHECK_STEPS == 0:
            marks.append((s, sent, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    body = b"".join(
        [doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), lengths.astype("<u4").tobytes(), x.astype("<u8").tobytes()]
        + [struct.pack("<II", s, sent - at) + state.astype("<u8").tobytes() for s, at, state in marks[::-1]]
        + [words.tobytes()]
    )
    return HEAD.pack(MAGIC, 1, table.bits, lanes, CHECK_STEPS, len(doc_ids), n, len(words), len(marks), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def read_block(data: bytes):
    """(lanes, doc ids, null flags, lengths, tokens, crc of ids, marks, words);
    marks: (step, word offset, states), the first at step 0."""
    magic, _, bits, lanes, _, docs, n, n_words, n_marks, ids_crc, body_crc = HEAD.unpack_from(data)
    if magic != MAGIC or zlib.crc32(data[HEAD.size :]) != body_crc:
        raise ValueError("damaged block")
    at = HEAD.size

    def take(kind, count):
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, nulls, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    marks = [(0, 0, take("<u8", lanes))]
    for _ in range(n_marks):
        step, offset = (int(v) for v in take("<u4", 2))
        marks.append((step, offset, take("<u8", lanes)))
    return bits, lanes, doc_ids, nulls, lengths, n, ids_crc, marks, take("<u4", n_words)


def decode_run(table: Table, lanes: int, n: int, words: np.ndarray, mark, stop: int) -> np.ndarray:
    """The ids from the mark's step up to the step ``stop``."""
    first, pos, state = mark
    x, bits, low = state.astype(np.uint64), np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = np.empty(min(n, stop * lanes) - first * lanes, np.uint32)
    for s in range(first, stop):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        xa = x[: b - a]
        slot = xa & low
        sym = table.slots[slot.view(np.int64)]
        xa = table.freq[sym] * (xa >> bits) + slot - table.cum[sym]
        under = xa < LOW
        k = int(np.count_nonzero(under))
        if k:
            xa[under] = (xa[under] << np.uint64(32)) | words[pos : pos + k]
            pos += k
        x[: b - a] = xa
        out[a - first * lanes : b - first * lanes] = sym
    return out


def _runs_of(lanes: int, n: int, marks: list) -> list[tuple]:
    """(mark, step past the last) of each run."""
    return list(zip(marks, [m[0] for m in marks[1:]] + [-(-n // lanes)], strict=True))


def decode_block(data: bytes, table: Table):
    """(doc ids, null flags, lengths, ids) of a block; every run between two
    checkpoints is decoded on its own, and both checksums are verified."""
    _, lanes, doc_ids, nulls, lengths, n, ids_crc, marks, words = read_block(data)
    ids = np.concatenate([decode_run(table, lanes, n, words, m, e) for m, e in _runs_of(lanes, n, marks)]) if n else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("decoded ids don't match the block's checksum")
    return doc_ids, nulls, lengths, ids


def decode_range(block: tuple, table: Table, lo: int, hi: int) -> np.ndarray:
    """Ids lo to hi of a block that was read, decoded from the checkpoint before lo."""
    _, lanes, _, _, _, n, _, marks, words = block
    mark = max((m for m in marks if m[0] * lanes <= lo), key=lambda m: m[0])
    ids = decode_run(table, lanes, n, words, mark, -(-hi // lanes))
    return ids[lo - mark[0] * lanes : hi - mark[0] * lanes]


def _times(matrix: list[int], v: int) -> int:
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= matrix[k]
        v, k = v >> 1, k + 1
    return out


def crc32_joined(first: int, second: int, size: int) -> int:
    """The crc32 of two byte strings one after the other, from theirs and the
    second's size: the first's is moved on by that many zero bytes, each of which
    is a linear map over bits, squared for every power of two."""
    move = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        move = [_times(move, row) for row in move]
    while size:
        if size & 1:
            first = _times(move, first)
        size >>= 1
        move = [_times(move, row) for row in move]
    return first ^ second


# ----------------------------------------------------------------- dataset


def encode_documents(docs: DataFrame, out: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Writes ``out/table`` (symbol, freq) and ``out/blocks`` (part, seq, start,
    n_tokens, first_id, last_id, payload), blocks in ascending order of document id."""
    spark = docs.sparkSession
    stage = common.scratch(spark, "rans-ids")
    tokenised(docs, tokenizer_path, id_col, text_col, end_id).write.parquet(stage)
    ids = spark.read.parquet(stage)
    counts = symbol_counts(ids).orderBy("symbol").toPandas()  # at most one row an id of the vocabulary
    symbols, freq = counts["symbol"].to_numpy(np.int64), scaled(counts["symbol"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    rows = [(int(s), int(f)) for s, f in zip(symbols, freq, strict=True)]
    spark.createDataFrame(rows, "symbol int, freq int").coalesce(1).write.parquet(f"{out}/table")

    def run(batches):
        table, unpack, part = Table(symbols, freq), zstandard.ZstdDecompressor(), TaskContext.get().partitionId()
        seq = start = held = 0
        d, z, n, chunks = [], [], [], []

        def flush():
            nonlocal seq, start, held
            data = encode_block(np.concatenate(chunks), np.array(d, np.int64), np.array(z), np.array(n), table)
            ends = [pa.array([None if z[k] else d[k]], pa.int64()) for k in (0, -1)]
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([held], pa.int64()), *ends, pa.array([data], pa.binary())], ["part", "seq", "start", "n_tokens", "first_id", "last_id", "payload"])
            seq, start, held = seq + 1, start + held, 0
            for x in (d, z, n, chunks):
                x.clear()
            return row

        for batch in batches:
            for doc, size, width, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids")), strict=True):
                d.append(doc or 0)
                z.append(doc is None)
                n.append(size)
                chunks.append(_unpack(unpack, blob, width, size))
                held += size
                if held >= block_tokens:
                    yield flush()
        if d:
            yield flush()

    # rows that are equal may be parted anywhere, so that none of them are many in one range
    keys = ["doc_id", F.xxhash64("ids").alias("tie"), F.monotonically_increasing_id().alias("place")]
    placed = ids.filter("width > 0").select("n", "width", "ids", *keys).repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie")
    placed.mapInArrow(common.trimmed(run), "part int, seq int, start long, n_tokens long, first_id long, last_id long, payload binary").write.parquet(f"{out}/blocks")
    common.drop_path(spark, stage)


def _documents(doc_ids, nulls, starts, lengths, crcs, ids=None) -> pa.RecordBatch:
    cols = [pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    if ids is not None:
        cols.append(pa.array([c.astype(np.int32) for c in ids], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(cols, names)


def read_documents(spark: SparkSession, path: str, *, with_ids: bool = False, only: list[int] | None = None, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files, in parallel
    by block and, of long ones, by run. ``only`` reads the documents of these ids,
    from the blocks that may hold them."""
    blocks = spark.read.parquet(f"{path}/blocks")
    pairs = spark.read.parquet(f"{path}/table").orderBy("symbol").toPandas()
    symbols, freq = pairs["symbol"].to_numpy(np.int64), pairs["freq"].to_numpy(np.int64)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = parts.select("part", F.expr("sum(held) over (order by part) - held").alias("before"))  # a row for each written part
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        table = Table(symbols, freq)
        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if only is None:
                    doc_ids, nulls, lengths, ids = decode_block(data, table)
                    ends = np.cumsum(lengths.astype(np.int64))
                    cuts = [ids[e - k : e] for e, k in zip(ends, lengths, strict=True)]
                else:
                    block = read_block(data)
                    ends = np.cumsum(block[4].astype(np.int64))
                    at = np.flatnonzero(np.isin(block[2], only) & (block[3] == 0))
                    doc_ids, nulls, lengths, ends = block[2][at], block[3][at], block[4][at], ends[at]
                    cuts = [decode_range(block, table, int(e) - int(k), int(e)) for e, k in zip(ends, lengths, strict=True)]
                crcs = [zlib.crc32(c.astype("<u4").tobytes()) for c in cuts]
                yield _documents(doc_ids, nulls, first + ends - lengths, lengths, crcs, cuts if with_ids else None)

    placed = blocks.join(F.broadcast(before), "part").withColumn("first", F.col("start") + F.col("before"))
    if only is not None:
        wanted = F.array(*[F.lit(int(i)).cast("long") for i in only])
        held = placed.filter(F.exists(wanted, lambda i: (F.coalesce("first_id", F.lit(-(2**63))) <= i) & (i <= F.col("last_id"))))
        return held.select("first", "payload").mapInArrow(common.trimmed(run), schema)
    out = placed.filter(F.col("n_tokens") < long_tokens).select("first", "payload").mapInArrow(common.trimmed(run), schema)
    if blocks.filter(F.col("n_tokens") >= long_tokens).isEmpty():
        return out
    return out.unionByName(_read_long(placed.filter(F.col("n_tokens") >= long_tokens), symbols, freq, with_ids))


def _read_long(blocks: DataFrame, symbols: np.ndarray, freq: np.ndarray, with_ids: bool) -> DataFrame:
    """The documents of long blocks: each block parted into runs, which are decoded
    by tasks of their own, and its documents put together from their pieces."""
    run_schema = "block long, run int, lanes int, n long, step int, stop int, state binary, words binary, pieces binary"

    def parted(batches):
        for batch in batches:
            for part, seq, first, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "first", "payload")), strict=True):
                _, lanes, doc_ids, nulls, lengths, n, ids_crc, marks, words = read_block(data)
                ends = np.cumsum(lengths.astype(np.int64))
                for k, (mark, stop) in enumerate(_runs_of(lanes, n, marks)):
                    lo, hi = mark[0] * lanes, min(n, stop * lanes)
                    a, b = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi, side="left")) + 1
                    at = np.arange(a, min(b, len(ends)))
                    begin = ends[at] - lengths[at]
                    rows = np.stack([at, doc_ids[at], nulls[at], first + begin, lengths[at], np.minimum(ends[at], hi) - np.maximum(begin, lo)], axis=1).astype("<i8")
                    # the block as a whole, to verify its checksum
                    rows = np.concatenate([rows, np.array([[-1, ids_crc, 0, 0, n, hi - lo]], "<i8")])
                    past = marks[k + 1][1] if k + 1 < len(marks) else len(words)
                    cells = (part << 32 | seq, k, lanes, n, mark[0], stop, mark[2].tobytes(), words[mark[1] : past].tobytes(), rows.tobytes())
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], ["block", "run", "lanes", "n", "step", "stop", "state", "words", "pieces"])

    piece_schema = "block long, at long, id long, null long, start long, n_tokens long, run int, size long, crc long, ids binary"

    def decoded(batches):
        table = Table(symbols, freq)
        for batch in batches:
            for block, run, lanes, n, step, stop, state, words, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode_run(table, lanes, n, np.frombuffer(words, "<u4"), (step, 0, np.frombuffer(state, "<u8")), stop).astype("<u4")
                rows = np.frombuffer(pieces, "<i8").reshape(-1, 6)
                cut = np.concatenate([[0], np.cumsum(rows[:-1, 5])])
                own = [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)] + [ids.tobytes()]
                crcs = [zlib.crc32(x) for x in own]
                blobs = [x if with_ids else b"" for x in own[:-1]] + [b""]
                cols = [pa.array([block] * len(rows)), *[pa.array(rows[:, c]) for c in range(5)], pa.array([run] * len(rows), pa.int32()), pa.array(rows[:, 5]), pa.array(crcs, pa.int64()), pa.array(blobs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["block", "at", "id", "null", "start", "n_tokens", "run", "size", "crc", "ids"])

    def joined(batches):
        for batch in batches:
            rows = []
            for at, key, null, start, n, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                crc = 0
                for p in pieces:
                    crc = crc32_joined(crc, p["crc"], 4 * p["size"])
                if at >= 0:
                    rows.append((key, null, start, n, crc, np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4")))
                elif crc != key:
                    raise ValueError("decoded ids don't match the block's checksum")
            cols = [np.array([r[k] for r in rows], np.int64) for k in range(5)]
            yield _documents(cols[0], cols[1], cols[2], cols[3], cols[4], [r[5] for r in rows] if with_ids else None)

    runs = blocks.select("part", "seq", "first", "payload").mapInArrow(common.trimmed(parted), run_schema)
    pieces = runs.repartition("block", "run").mapInArrow(common.trimmed(decoded), piece_schema)
    whole = pieces.groupBy("block", "at", "id", "null", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("run", "size", "crc", "ids"))).alias("pieces"))  # those of one document
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return whole.select("at", "id", "null", "start", "n_tokens", "pieces").mapInArrow(common.trimmed(joined), schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Writes all documents to the shared folder and reads them back."""
    spark = docs.sparkSession
    out = common.scratch(spark, "rans")
    encode_documents(docs, out, tokenizer_path or default_tokenizer())
    return read_documents(spark, out)


def op1_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
