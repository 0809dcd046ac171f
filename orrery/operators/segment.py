"""Words of unspaced text: a lexicon learnt from the corpus, and the best path
through each run's word lattice.

A candidate is an n-gram inside a run of letters that are written without blanks. It
is a word if it is frequent, if its parts cohere (it is seen more often than any way
of putting it together from two parts would explain), and if what stands next to it
on either side varies (entropy). All of these are counts of n-grams, made by grouping
in Spark; runs that repeat are counted once with their number. The words found are
then counted along a first segmentation, which parts overlapping candidates.

A run is cut where the product of its words' shares is largest; a letter that is no
word costs less than any word has. The lexicon is bounded (``MOST_WORDS``), so it
may be sent to all tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session, storage

#: Scripts that are written without blanks between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+"
LONGEST = 5
LEAST, COHESION, ENTROPY = 5, 1.5, 0.7
MOST_WORDS = 200_000
#: What stands before and after a run when neighbours are counted.
EDGE = "\u0001"


@dataclass
class Lexicon:
    """Words with the logarithm of their share, the longest's length, and what a
    letter that is no word costs."""

    words: dict[str, float]
    longest: int
    unknown: float
    pattern: str = UNSPACED


def runs(texts: DataFrame, pattern: str = UNSPACED) -> DataFrame:
    """(run, n) of (text): distinct runs and how often they occur."""
    found = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(pattern), F.lit(0))
    return texts.select(F.explode(found).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def ngrams(found: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(gram, n) of up to longest + 1 letters, the last for neighbours, runs edged;
    those rarer than ``least`` are left out, single letters never. Tasks count
    the n-grams of some runs at a time as numbers, so that a row is a distinct n-gram
    of many runs and not each one's place."""
    edged = found.select(F.concat(F.lit(EDGE), F.col("run"), F.lit(EDGE)).alias("run"), "n")

    def counted(batches):
        for b in batches:
            for runs, n in _some(b):
                yield from _grams(runs, n, longest + 1)

    count = edged.mapInArrow(counted, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return count.filter((F.col("n") >= least) | (F.length("gram") == 1))


#: Letters whose n-grams are counted at once.
LETTERS = 1 << 20
#: Letters that one number holds.
PACKED = 3


def _cut(b: pa.RecordBatch, column: str):
    """A batch in parts of about ``LETTERS`` letters of that column, one row at least."""
    sizes = np.cumsum(pa.compute.utf8_length(b[column]).to_numpy())
    start = 0
    while start < b.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + LETTERS, side="right")))
        yield b.slice(start, stop - start)
        start = stop


def _some(b: pa.RecordBatch):
    """(runs, n) of a batch, in parts."""
    for part in _cut(b, "run"):
        yield part["run"], part["n"].to_numpy()


def _letters(texts: pa.Array) -> np.ndarray:
    """The letters of all texts, one after another, as numbers."""
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)


def _grams(runs: pa.Array, n: np.ndarray, longest: int):
    """Batches (gram, n): the n-grams of one to ``longest`` letters of runs that occur
    n times each. An n-gram is one number for every ``PACKED`` of its letters."""
    letters = _letters(runs)
    lengths = pa.compute.utf8_length(runs).to_numpy()
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))  # letters to the run's end
    times = np.repeat(n, lengths)
    packed = [letters]  # of one, two and three letters from each place on
    for k in range(1, PACKED):
        packed.append((packed[-1] << 21) | np.concatenate([letters[k:], np.zeros(min(k, len(letters)), np.int64)]))
    for k in range(1, longest + 1):
        at = np.flatnonzero(left >= k)
        if not len(at):
            return
        cuts = [(i, min(PACKED, k - i)) for i in range(0, k, PACKED)]
        names = [f"k{i}" for i, _ in cuts]
        table = pa.table({**{f"k{i}": packed[size - 1][at + i] for i, size in cuts}, "n": times[at]})
        sums = table.group_by(names, use_threads=False).aggregate([("n", "sum")])
        codes = [(sums[name].to_numpy() >> (21 * (size - 1 - j))) & 0x1FFFFF for name, (_, size) in zip(names, cuts, strict=True) for j in range(size)]
        text = np.ascontiguousarray(np.stack(codes, 1).astype("<u4")).view(f"<U{k}").ravel()
        yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), sums["n_sum"].combine_chunks().cast(pa.int64())], ["gram", "n"])


def _repeated(grams: DataFrame, inner, name: str) -> DataFrame:
    """(gram, name): the sum of c log c over the letters next to each n-gram on one
    side, c being how often one stands there."""
    n = F.col("n").cast("double")
    return grams.filter(F.length("gram") > 1).select(inner.alias("gram"), "n").groupBy("gram").agg(F.sum(n * F.log(n)).alias(name))


def candidates(grams: DataFrame, longest: int = LONGEST, cohesion: float = COHESION, entropy: float = ENTROPY) -> DataFrame:
    """(gram, n): n-grams of two letters and more that cohere and have varied
    neighbours. A neighbour too rare for ``ngrams`` counts as seen once."""
    plain = grams.filter(~F.contains("gram", F.lit(EDGE)))
    letters = plain.filter(F.length("gram") == 1).agg(F.sum("n").alias("letters"))
    words = plain.filter((F.length("gram") > 1) & (F.length("gram") <= longest))
    right = _repeated(grams, F.expr("substring(gram, 1, length(gram) - 1)"), "right")
    left = _repeated(grams, F.expr("substring(gram, 2)"), "left")
    varied = lambda c: F.log(F.col("n").cast("double")) - F.coalesce(F.col(c), F.lit(0.0)) / F.col("n") >= entropy
    words = words.join(right, "gram", "left").join(left, "gram", "left").filter(varied("right") & varied("left")).select("gram", "n")
    words = storage.written(words, "segment-varied")
    parts = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda k: F.struct(F.substring(F.col("gram"), F.lit(1), k).alias("a"), F.substring(F.col("gram"), k + 1, F.length("gram")).alias("b")))
    split = words.select("gram", "n", F.explode(parts).alias("p")).select("gram", "n", "p.*")
    side = lambda c: session.small(plain.select(F.col("gram").alias(c), F.col("n").alias(f"n_{c}")))
    bound = split.join(side("a"), "a").join(side("b"), "b").crossJoin(F.broadcast(letters))  # one row
    pmi = F.log(F.col("n").cast("double")) + F.log(F.col("letters").cast("double")) - F.log(F.col("n_a").cast("double")) - F.log(F.col("n_b").cast("double"))
    return bound.groupBy("gram", "n").agg(F.min(pmi).alias("least")).filter(F.col("least") >= cohesion).select("gram", "n")


def _lexicon(counts: DataFrame, pattern: str, most: int) -> Lexicon:
    """Shares of the most frequent words (gram, n), at most ``most``."""
    held = counts.orderBy(F.desc("n"), "gram").limit(most).collect()
    total = sum(r.n for r in held) or 1
    words = {r.gram: math.log(r.n / total) for r in held}
    return Lexicon(words, max(map(len, words), default=1), math.log(0.5 / total), pattern)


def learn(texts: DataFrame, pattern: str = UNSPACED, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, entropy: float = ENTROPY, most: int = MOST_WORDS) -> Lexicon:
    """The lexicon of (text). Null and empty texts, and texts without a run, add nothing."""
    found = storage.written(runs(texts, pattern), "segment-runs")
    grams = storage.written(ngrams(found, longest, least), "segment-grams")
    single = grams.filter((F.length("gram") == 1) & (F.col("gram") != EDGE))
    first = _lexicon(candidates(grams, longest, cohesion, entropy).unionByName(single), pattern, most)

    sent = texts.sparkSession.sparkContext.broadcast(first)  # MOST_WORDS words

    def counted(batches):
        lattice = Lattice(sent.value)
        for b in batches:
            for part, times in _some(b):
                lattice.count(_letters(part), pa.compute.utf8_length(part).to_numpy(), times)
        held = lattice.counted()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "n"])

    used = found.mapInArrow(counted, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return _lexicon(used, pattern, most)


def best_path(run: str, lexicon: Lexicon) -> list[str]:
    """The words of the path with the largest product of shares; of equal ones that
    with the longer last word, so that results don't depend on order."""
    score, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for start in range(max(0, end - lexicon.longest), end):
            share = lexicon.words.get(run[start:end], lexicon.unknown if end - start == 1 else None)
            if share is not None and score[start] + share > score[end] + 1e-12:
                score[end], back[end] = score[start] + share, start
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


#: Entries of a table of next letters; a level that would need more is searched.
DENSE = 1 << 22
#: Places of runs, each as long as the longest of them, whose paths are found at once.
PLACES = 1 << 18


class Lattice:
    """``best_path`` for many runs at once. The words are a tree of letters, a level for
    each length: from each place on, all runs' letters go down a level together. Runs of
    about the same length then move on by a letter together."""

    def __init__(self, lexicon: Lexicon):
        self.unknown = lexicon.unknown
        words = list(lexicon.words)
        share = np.array(list(lexicon.words.values()), np.float64)
        lengths = np.array([len(w) for w in words], np.int64)
        flat = _letters(pa.array(words, pa.string()))
        start = np.cumsum(lengths) - lengths
        used = np.unique(flat)
        self.size = len(used) + 1  # the last is any other letter
        self.letter = np.full(0x110000, len(used), np.int32)
        self.letter[used] = np.arange(len(used))
        self.levels, node, place = [], np.zeros(len(words), np.int64), np.arange(len(words))
        for k in range(int(lengths.max(initial=0))):
            own = place[lengths > k]
            keys, node[own] = np.unique(node[own] * self.size + self.letter[flat[start[own] + k]], return_inverse=True)
            shares, names = np.full(len(keys), -np.inf), np.full(len(keys), -1)
            last = place[lengths == k + 1]
            shares[node[last]], names[node[last]] = share[last], last
            above, table = (len(self.levels[-1][0]) if k else 1) * self.size, None
            if above <= DENSE:
                table = np.full(above, -1, np.int32)
                table[keys] = np.arange(len(keys))
            self.levels.append((keys, table, shares, names))
        self.words, self.n, self.single = words, np.zeros(len(words), np.int64), {}

    def _shares(self, letters: np.ndarray, left: np.ndarray) -> tuple[list, list]:
        """For each length, the share and the word (-1: none) from each place on."""
        ids = self.letter[letters]
        at, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        shares, names = [np.full(len(letters), self.unknown)], [np.full(len(letters), -1, np.int32)]
        for k, (keys, table, share, name) in enumerate(self.levels):
            key = node * self.size + ids[at + k]
            if table is not None:
                to = table[key].astype(np.int64)
            else:
                to = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                to = np.where(keys[to] == key, to, -1)
            at, node = at[to >= 0], to[to >= 0]
            if k:
                shares.append(np.full(len(letters), -np.inf))
                names.append(np.full(len(letters), -1, np.int32))
            word = name[node] >= 0
            shares[k][at[word]], names[k][at[word]] = share[node[word]], name[node[word]]
            more = left[at] > k + 1
            at, node = at[more], node[more]
        return shares, names

    def paths(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """(places where words begin, their lengths, ``_shares``' words) of runs one after
        another; of equal paths the one that ``best_path`` takes."""
        lengths = np.asarray(lengths, np.int64)
        first = np.cumsum(lengths) - lengths
        left = np.repeat(first + lengths, lengths) - np.arange(len(letters))
        shares, names = self._shares(letters, left)
        begins = np.zeros(len(letters), np.int8)  # the length of the word that begins there
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        while len(order):
            own = order[: max(1, PLACES // int(lengths[order[0]]))]
            order = order[len(own) :]
            self._walk(shares, first[own], lengths[own], begins)
        at = np.flatnonzero(begins)
        return at, begins[at].astype(np.int64), names

    def _walk(self, shares: list, first: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> None:
        """Runs by falling length: scores and last words of all runs at each place."""
        score = np.full((int(lengths[0]) + 1, len(first)), -np.inf)
        back = np.zeros(score.shape, np.int8)
        score[0] = 0
        active = np.searchsorted(-lengths, -np.arange(len(score)), side="right")  # runs so long
        for end in range(1, len(score)):
            m = active[end]
            best, last = score[end, :m], back[end, :m]
            for k in range(min(len(shares), end), 0, -1):
                reached = score[end - k, :m] + shares[k - 1][first[:m] + (end - k)]
                better = reached > best + 1e-12
                np.copyto(best, reached, where=better)
                last[better] = k
        at, run = lengths.copy(), np.arange(len(first))
        while len(run):
            size = back[at[run], run]
            at[run] -= size
            begins[first[run] + at[run]] = size
            run = run[at[run] > 0]

    def count(self, letters: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> None:
        """Adds the words of runs that occur so many times."""
        at, size, names = self.paths(letters, lengths)
        n = np.repeat(times, lengths)[at]
        word = np.full(len(at), -1, np.int64)
        for k, name in enumerate(names, 1):
            word[size == k] = name[at[size == k]]
        np.add.at(self.n, word[word >= 0], n[word >= 0])
        each, which = np.unique(letters[at[word < 0]], return_inverse=True)  # letters that are no word
        sums = np.zeros(len(each), np.int64)
        np.add.at(sums, which, n[word < 0])
        for c, x in zip(each.tolist(), sums.tolist(), strict=True):
            self.single[chr(c)] = self.single.get(chr(c), 0) + x

    def counted(self) -> dict[str, int]:
        at = np.flatnonzero(self.n)
        return self.single | {self.words[i]: x for i, x in zip(at.tolist(), self.n[at].tolist(), strict=True)}

    def spaced(self, pieces: pa.ListArray) -> list[str]:
        """Each row's pieces (p, run) as one text: a blank before each word, and one after each run."""
        ends = pieces.offsets.to_numpy().astype(np.int64)
        own = pieces.values.slice(ends[0], ends[-1] - ends[0])
        said, run = own.field("p"), own.field("run").to_numpy(zero_copy_only=False)
        letters, lengths = _letters(said), pa.compute.utf8_length(said).to_numpy().astype(np.int64)
        inside = np.repeat(run, lengths)
        at = np.flatnonzero(inside)[self.paths(letters[inside], lengths[run])[0]]
        stops = np.cumsum(lengths)
        places = np.concatenate([at, stops[run]])  # a blank goes before the letter at each
        text = np.insert(letters, places, 32).astype("<u4").tobytes().decode("utf-32-le")
        upto = np.concatenate([[0], np.cumsum(lengths + np.bincount(np.repeat(np.arange(len(run)), lengths)[at], minlength=len(run)) + run)])[ends - ends[0]]
        return [text[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


def spaced(df: DataFrame, column: str, lexicon: Lexicon) -> DataFrame:
    """df with blanks between the words of its unspaced runs (and around the runs),
    so that every tokenizer after it sees words; texts without such a run stay as
    they are. Runs are cut out in the JVM; Python sees rows that have one."""
    one = lexicon.pattern[:-1]  # its letters: a part begins in a run or outside, and stays there
    has = F.coalesce(F.col(column).rlike(one), F.lit(False))
    names, at = df.columns, df.columns.index(column)
    parts = F.split(F.col(column), f"(?={one})(?<!{one})|(?<={one})(?!{one})")
    rows = df.filter(has).withColumn("__parts", F.transform(parts, lambda p: F.struct(p.alias("p"), p.rlike(f"^{one}").alias("run"))))
    sent = df.sparkSession.sparkContext.broadcast(lexicon)  # MOST_WORDS words

    def run(batches):
        lattice = Lattice(sent.value)
        for whole in batches:
            for b in _cut(whole, column):
                columns = [b.column(i) for i in range(len(names))]
                columns[at] = pa.array(lattice.spaced(b["__parts"]), pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    done = rows.mapInArrow(run, df.schema)
    return done.unionByName(df.filter(~has))
