"""A stored index that grows: segments, tombstones and a manifest.

``add`` writes the new chunks as a segment of its own: chunks, postings, vectors,
name-like words, triples, and the segment's statistics. ``delete``
writes a tombstone: the ids that go, and what their rows take from the statistics.
Both end by naming themselves in a new manifest, which is moved into place and never
over another one: a change that is lost on the way leaves nothing visible, and of
two writers one fails. Term counts are sums over segments less those of tombstones,
so nothing is counted again.

``index`` joins the live segments to one ``search.Index``. What depends on the whole
corpus (idf, the best entities of a chunk) is worked out once for a
manifest from the stored counts, no text being read, and stored under its number.
``compact`` writes the smallest segments as one, without what is dead; ``vacuum``
removes what the last manifest doesn't name.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session, storage
from ..functions import text as T
from ..operators import bm25, entity_graph, kg, vector
from . import search

#: Segments that may stand side by side before ``compact`` joins the smallest.
FAN = 8
#: Rows of a segment's own statistics: chunks, chunks with a text, with a token, and tokens.
_SUMS = ("n_chunks", "n_texts", "n_counted", "n_tokens")


@dataclass
class Manifest:
    """Live segments and tombstones, each (number, folder); numbers rise with every change."""

    version: int = 0
    last: int = 0
    segments: list[tuple[int, str]] = field(default_factory=list)
    tombs: list[tuple[int, str]] = field(default_factory=list)


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- the manifest

    def _fs(self, path: str):
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def manifest(self) -> Manifest:
        """The last one; an empty one if there is none."""
        found = self._versions()
        if not found:
            return Manifest()
        text = self.spark.read.text(f"{self.path}/manifests/v{found[-1]}", wholetext=True).first()[0]
        held = json.loads(text)
        return Manifest(held["version"], held["last"], [tuple(s) for s in held["segments"]], [tuple(t) for t in held["tombs"]])

    def _commit(self, before: Manifest, last: int, segments: list, tombs: list) -> Manifest:
        """Moves a new manifest into place; an error if another writer was first."""
        new = Manifest(before.version + 1, last, segments, tombs)
        jvm = self.spark.sparkContext._jvm
        temp, fs = self._fs(f"{self.path}/manifests/.new-{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        at, _ = self._fs(f"{self.path}/manifests/v{new.version}")
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(temp), fs.makeQualified(at), none)  # fails if it is there
        return new

    # ---- tables over the live segments

    def _read(self, folder: str, table: str) -> DataFrame | None:
        jpath, fs = self._fs(f"{self.path}/{folder}/{table}")
        return self.spark.read.parquet(f"{self.path}/{folder}/{table}") if fs.exists(jpath) else None

    def live(self, table: str, m: Manifest | None = None, only: set[int] | None = None) -> DataFrame | None:
        """The rows of a table in all live segments, with their segment as ``seg``;
        a tombstone holds for the segments before it."""
        m, out = m or self.manifest(), None
        for number, folder in m.segments:
            rows = None if only is not None and number not in only else self._read(folder, table)
            if rows is None:
                continue
            dead = [self._read(f, "ids").filter(F.col("seg") == number).select("chunk_id") for t, f in m.tombs if t > number]
            for ids in dead:
                rows = rows.join(session.small(ids), "chunk_id", "left_anti")
            rows = rows.withColumn("seg", F.lit(number))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def _sums(self, m: Manifest, table: str, by: list[str], values: tuple[str, ...]) -> DataFrame:
        """A statistic over live segments, less what tombstones take from these."""
        numbers, out = [n for n, _ in m.segments], None
        for sign, (_, folder) in [(1, s) for s in m.segments] + [(-1, t) for t in m.tombs]:
            rows = self._read(folder, table).filter(F.col("seg").isin(numbers)).select(*by, *[(sign * F.col(v)).alias(v) for v in values])
            out = rows if out is None else out.unionByName(rows)
        return out.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])

    # ---- changes

    def _write_segment(self, number: int, tables: dict[str, DataFrame]) -> tuple[int, str]:
        folder = f"segments/{number}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            if df is not None:
                df.write.parquet(f"{self.path}/{folder}/{name}")
        self._write_sums(folder, self._read(folder, "chunks").withColumn("seg", F.lit(number)), self._read(folder, "postings").withColumn("seg", F.lit(number)))
        return number, folder

    def _write_sums(self, folder: str, chunks: DataFrame, post: DataFrame) -> None:
        """The statistics of rows (with ``seg``): document counts by term, and totals."""
        post.groupBy("seg", "term").agg(F.count("*").alias("df")).write.parquet(f"{self.path}/{folder}/terms")
        counted = F.count_if(F.coalesce(F.col("content").rlike(T.TOKEN), F.lit(False)))
        texts = chunks.groupBy("seg").agg(F.count("*").alias("n_chunks"), F.count("content").alias("n_texts"), counted.alias("n_counted"))
        tokens = post.groupBy("seg").agg(F.sum("tf").alias("n_tokens"))
        texts.join(tokens, "seg", "left").na.fill(0).write.parquet(f"{self.path}/{folder}/totals")

    def _tomb(self, m: Manifest, number: int, ids: DataFrame) -> tuple[int, str] | None:
        """Writes what goes with these ids; None if no live chunk has one of them."""
        folder = f"tombs/{number}-{uuid.uuid4().hex}"
        chunks = self.live("chunks", m)
        if chunks is None:
            return None
        hit = chunks.select("chunk_id", "seg").join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
        hit.write.parquet(f"{self.path}/{folder}/ids")
        hit = self._read(folder, "ids")
        if hit.isEmpty():
            return None
        taken = session.small(hit)
        self._write_sums(folder, chunks.join(taken, ["chunk_id", "seg"], "left_semi"), self.live("postings", m).join(taken, ["chunk_id", "seg"], "left_semi"))
        return number, folder

    def add(self, chunks: DataFrame, triples: DataFrame | None = None) -> Manifest:
        """Chunks (chunk_id, source, content, ...) as a new segment, with their triple
        records if given. A chunk whose id is live replaces it. Chunks without an id
        are left out; of several with one id the one whose content sorts first stays."""
        m = self.manifest()
        order = F.struct(F.coalesce("content", F.lit("")), F.coalesce("source", F.lit("")))
        rows = storage.written(chunks.filter("chunk_id IS NOT NULL"), "segment-chunks")
        twice = storage.written(rows.groupBy("chunk_id").count().filter("count > 1").select("chunk_id"), "segment-twice")
        if not twice.isEmpty():
            first = rows.join(session.small(twice), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min_by(F.struct(*[c for c in chunks.columns if c != "chunk_id"]), order).alias("r"))
            rows = storage.written(rows.join(session.small(twice), "chunk_id", "left_anti").unionByName(first.select("chunk_id", "r.*")), "segment-chunks")
        tomb = self._tomb(m, m.last + 1, rows)
        clean = None if triples is None else kg.clean_triples(triples.join(rows.select("chunk_id"), "chunk_id", "left_semi"))
        seg = self._write_segment(m.last + 2, {"chunks": rows, "postings": bm25.postings(rows), "vectors": vector.embed(rows), "named": entity_graph.named_words(rows), "triples": clean})
        return self._commit(m, m.last + 2, [*m.segments, seg], [*m.tombs, tomb] if tomb else m.tombs)

    def delete(self, ids: DataFrame) -> Manifest:
        """Without the chunks of these ids (chunk_id); ids that aren't live change nothing."""
        m = self.manifest()
        tomb = self._tomb(m, m.last + 1, ids)
        return self._commit(m, m.last + 1, m.segments, [*m.tombs, tomb]) if tomb else m

    def compact(self, fan: int = FAN) -> Manifest:
        """Where more than ``fan`` segments stand, the smallest become one: all but
        the ``fan - 1`` largest. ``fan=1`` makes one of all."""
        m = self.manifest()
        if len(m.segments) <= fan and not (fan == 1 and m.tombs):
            return m
        sizes = {n: self._read(f, "totals").agg(F.sum("n_chunks")).first()[0] or 0 for n, f in m.segments}
        merged = {n for n, _ in sorted(m.segments, key=lambda s: (-sizes[s[0]], s[0]))[fan - 1 :]}
        tables = {t: self.live(t, m, merged) for t in ("chunks", "postings", "vectors", "named", "triples")}
        tables = {t: df.drop("seg") for t, df in tables.items() if df is not None}
        seg = self._write_segment(m.last + 1, tables)
        rest = [s for s in m.segments if s[0] not in merged]
        tombs = [t for t in m.tombs if any(n < t[0] for n, _ in rest)]
        return self._commit(m, m.last + 1, [*rest, seg], tombs)

    def vacuum(self) -> None:
        """Removes segments, tombstones, views and manifests that the last manifest doesn't need."""
        m = self.manifest()
        held = {f for _, f in [*m.segments, *m.tombs]} | {f"views/{m.version}", f"manifests/v{m.version}"}
        for kind in ("segments", "tombs", "views", "manifests"):
            folder, fs = self._fs(f"{self.path}/{kind}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{kind}/{s.getPath().getName()}" not in held:
                    fs.delete(s.getPath(), True)

    # ---- search

    def _view(self, m: Manifest, name: str, make) -> DataFrame:
        """A table worked out for a manifest; once, and whole or not at all."""
        path = f"{self.path}/views/{m.version}/{name}"
        done, fs = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(done):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def index(self, graph: bool = False) -> search.Index:
        """The live segments as an index, as ``search.build_index`` of all live chunks gives it."""
        m = self.manifest()
        if not m.segments:
            raise ValueError("nothing was added")
        chunks, post, vectors = (self.live(t, m).drop("seg") for t in ("chunks", "postings", "vectors"))
        totals = self._view(m, "totals", lambda: self._sums(m, "totals", [], _SUMS))
        stats = totals.select(F.col("n_counted").alias("n"), (F.col("n_tokens") / F.col("n_counted")).alias("avgdl"))
        terms = self._view(m, "terms", lambda: bm25.weighed(self._sums(m, "terms", ["term"], ("df",)).filter("df > 0"), stats))
        ec = edges = None
        if graph:
            texts = totals.select(F.col("n_texts").alias("n"))
            ec = self._view(m, "entities", lambda: entity_graph.entities_of(post, self.live("named", m).drop("seg"), texts))
            edges = entity_graph.cooccurrence(ec)
        triples = self.live("triples", m)
        return search.Index(chunks, vectors, bm25.Index(post, terms, stats), ec, edges, None if triples is None else triples.drop("seg"))
