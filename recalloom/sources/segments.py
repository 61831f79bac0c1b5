"""A standing index that takes upserts and deletes by chunk id.

Every change writes a segment: its chunks, their postings (frequencies, not weights), vectors, the
ids it makes obsolete in segments before it, and signed sums of document frequencies, chunks and
lengths. A row is live unless a later change named its id. The statistics of the corpus are the sums
over all segments, so weights are always those that a rebuild of the live chunks would give.

A manifest lists the segments that are read. It is written aside and moved to its number, which
only one of several writers can take; the others get ``ConcurrentChange`` and may try again. Segments
of one order of size are merged when there are ``FAN_IN`` of them, and all of them when more than
half of the rows are dead, so the files that are read stay within twice the live rows. ``vacuum``
removes what no manifest in use names.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.embedding import Embedder
from ..functions.text import Tokenizer, word_tokens
from ..operators import bm25
from ..operators.search import Index
from ..scale import broadcast_if_small

FAN_IN = 4
# Changes in a row whose manifests keep their segments on disk for searches under way.
KEPT_MANIFESTS = 2

_SEGMENT = "name string, rows bigint, low bigint, high bigint, n bigint, dl bigint"
_MANIFEST = f"next bigint, tags map<string,bigint>, segments array<struct<{_SEGMENT.replace(' string', ':string').replace(' bigint', ':bigint')}>>"
# Tables of a segment; chunks also carry all columns of the store.
_POSTINGS = "chunk_id string, seq bigint, dl int, token string, tf int"
_GONE = "chunk_id string, seq bigint"
_TERMS = "token string, df bigint"


class ConcurrentChange(RuntimeError):
    """Another change of the same index was committed first."""


@dataclass(frozen=True)
class SegmentPostings:
    """The sparse side of a store in the state of one manifest; searched like any sparse index."""

    store: SegmentStore
    manifest: dict
    by: tuple[str, ...] = ()

    def matches(self, terms: DataFrame, small: bool) -> DataFrame:
        """``chunk_id, token, weight`` of the live postings whose token is in ``terms``."""
        hint = F.broadcast if small else (lambda df: df)
        terms = hint(terms)
        postings = self.store.live("postings", self.manifest)
        if small:
            # No more values than there are buckets.
            wanted = [r[0] for r in terms.select(bm25.token_bucket(F.col("token"), self.store.buckets)).distinct().collect()]
            postings = postings.where(F.col("bucket").isin(wanted))
        n, dl = (sum(s[c] for s in self.manifest["segments"]) for c in ("n", "dl"))
        model = self.store.table("terms", self.manifest).join(terms, "token", "left_semi").groupBy("token").agg(F.sum("df").alias("df"))
        model = model.where("df > 0").select("token", bm25.idf(F.lit(n), F.col("df")).alias("idf"))
        weight = bm25.doc_weight(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(dl / max(n, 1)), self.store.k1, self.store.b)
        return postings.join(hint(model), "token").select("chunk_id", "token", weight.alias("weight")).repartition("chunk_id")


class SegmentStore:
    """An index below ``path``. ``columns`` are those of its chunks beside ``chunk_id`` and ``index_text``, as DDL."""

    def __init__(self, spark: SparkSession, path: str, columns: str = "content_text string", tokenizer: Tokenizer = word_tokens,
                 embed: Embedder | None = None, buckets: int = 16, k1: float = config.BM25_K1, b: float = config.BM25_B) -> None:
        self.spark, self.path, self.tokenizer, self.embed = spark, path.rstrip("/"), tokenizer, embed
        self.buckets, self.k1, self.b = buckets, k1, b
        extra = f", {columns}" if columns else ""
        self.schemas = {"chunks": f"chunk_id string, seq bigint, dl int, index_text string{extra}, segment string",
                        "postings": f"{_POSTINGS}, segment string, bucket int", "gone": f"{_GONE}, segment string",
                        "terms": f"{_TERMS}, segment string", "vectors": "chunk_id string, seq bigint, embedding array<float>, segment string"}

    # -- manifests ---------------------------------------------------------------------------

    @cached_property
    def _files(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        return jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)

    def _hadoop_path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def manifest(self) -> dict:
        """The last committed state; ``number`` 0 before the first change."""
        try:
            found = self.spark.read.schema(f"{_MANIFEST}, number bigint").json(f"{self.path}/manifest")
            row = found.orderBy(F.desc("number")).first()
        except AnalysisException:
            row = None
        return row.asDict(True) if row else {"number": 0, "next": 1, "tags": {}, "segments": []}

    def _commit(self, before: dict, segments: list[dict], tags: dict | None = None, used: int = 0) -> dict:
        """Make a state the current one, if nobody else has changed the one it was made from."""
        after = {"next": before["next"] + used, "tags": {**before["tags"], **(tags or {})},
                 "segments": [{c: s[c] for c in ("name", "rows", "low", "high", "n", "dl")} for s in segments]}
        aside = self._hadoop_path("aside", uuid.uuid4().hex)
        row = [(after["next"], after["tags"], [tuple(s.values()) for s in after["segments"]])]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.json(aside.toString())
        self._files.mkdirs(self._hadoop_path("manifest"))
        number = before["number"] + 1
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        try:
            # Without the option to overwrite this fails when the number is taken.
            context.rename(aside, self._hadoop_path("manifest", f"number={number}"), gateway.new_array(rename, 0))
        except Exception as error:
            raise ConcurrentChange(f"change {number} of {self.path} was made by someone else") from error
        return {**after, "number": number}

    # -- tables ------------------------------------------------------------------------------

    def table(self, name: str, manifest: dict) -> DataFrame:
        """A table over the segments of a manifest, dead rows included."""
        names = [s["name"] for s in manifest["segments"]]
        try:
            found = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:
            found = self.spark.createDataFrame([], self.schemas[name])
        return found.where(F.col("segment").isin(names) if names else F.lit(False))

    def live(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The rows of a table that no later change has made obsolete."""
        manifest = manifest or self.manifest()
        gone = self.table("gone", manifest).groupBy("chunk_id").agg(F.max("seq").alias("_gone"))
        rows = self.table(name, manifest).join(broadcast_if_small(gone), "chunk_id", "left")
        return rows.where(F.col("_gone").isNull() | (F.col("seq") >= F.col("_gone"))).drop("_gone")

    def _write(self, name: str, rows: DataFrame, segment: str) -> None:
        parts = ["segment", *(["bucket"] if name == "postings" else [])]
        names = [f.split()[0] for f in self.schemas[name].split(", ")]
        rows = rows.withColumn("segment", F.lit(segment))
        if name == "postings":
            # A file holds a range of one bucket, and a token found everywhere fills several.
            order = ("bucket", "token", "chunk_id")
            rows = rows.withColumn("bucket", bm25.token_bucket(F.col("token"), self.buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
        rows.select(*names).write.mode("append").partitionBy(*parts).parquet(f"{self.path}/{name}")

    def _read_segment(self, name: str, segment: str) -> DataFrame:
        return self.table(name, {"segments": [{"name": segment}]})

    # -- changes -----------------------------------------------------------------------------

    def upsert(self, chunks: DataFrame, tags: dict | None = None) -> dict:
        """Add chunks (``chunk_id, index_text`` and the store's columns); those of known ids replace the old ones.

        An id must come once in a batch. ``tags`` are remembered with the change, so that a source
        can tell what was taken in already.
        """
        return self._change(chunks, None, tags)

    def delete(self, ids: DataFrame, tags: dict | None = None) -> dict:
        """Remove the chunks of these ids (``chunk_id``); unknown ids are passed over."""
        return self._change(None, ids.select(F.col("chunk_id").cast("string")).distinct(), tags)

    def _change(self, chunks: DataFrame | None, ids: DataFrame | None, tags: dict | None) -> dict:
        before = self.manifest()
        seq, segment = before["next"], f"s{before['next']:012d}-{uuid.uuid4().hex[:8]}"
        rows = n = dl = 0
        if chunks is not None:
            texts = chunks.withColumn("chunk_id", F.col("chunk_id").cast("string")).withColumn("seq", F.lit(seq).cast("bigint"))
            tokens = self.tokenizer(F.coalesce(F.col("index_text"), F.lit("")))
            self._write("chunks", texts.withColumn("dl", F.size(tokens)), segment)
            stored = self._read_segment("chunks", segment)
            rows, different, dl = stored.agg(F.count(F.lit(1)), F.count_distinct("chunk_id"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if rows != different:
                raise ValueError("a batch must have every chunk_id once")
            n, ids = rows, stored.select("chunk_id")
            keyed = bm25.tokenise(stored, tokenizer=self.tokenizer)
            self._write("postings", bm25.term_frequencies(keyed).withColumn("seq", F.lit(seq).cast("bigint")), segment)
            if self.embed is not None:
                self._write("vectors", stored.select("chunk_id", "seq", self.embed(F.col("index_text")).cast("array<float>").alias("embedding")), segment)
        old = self.live("chunks", before).join(ids, "chunk_id", "left_semi")
        self._write("gone", old.select("chunk_id", F.lit(seq).cast("bigint").alias("seq")), segment)
        gone = self._read_segment("gone", segment)
        lost = self.live("chunks", before).join(broadcast_if_small(gone.select("chunk_id")), "chunk_id", "left_semi")
        fewer, shorter = lost.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        # One posting per chunk and token: their number is the document frequency.
        minus = self.live("postings", before).join(broadcast_if_small(gone.select("chunk_id")), "chunk_id", "left_semi").select("token", F.lit(-1).alias("df"))
        plus = self._read_segment("postings", segment).select("token", F.lit(1).alias("df"))
        sums = plus.unionByName(minus).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        self._write("terms", sums, segment)
        made = {"name": segment, "rows": rows, "low": seq, "high": seq, "n": n - fewer, "dl": dl - shorter}
        return self.tidy(self._commit(before, [*before["segments"], made], tags, 1))

    # -- merging -----------------------------------------------------------------------------

    def tidy(self, manifest: dict | None = None) -> dict:
        """Merge what the rules of the module ask for."""
        manifest = manifest or self.manifest()
        segments = manifest["segments"]
        if sum(s["rows"] for s in segments) > 2 * max(sum(s["n"] for s in segments), 1) and len(segments) > 1:
            return self._merge(manifest, segments)
        tiers: dict[int, list[dict]] = {}
        for s in segments:
            tiers.setdefault(int(math.log(max(s["rows"], 1), FAN_IN)), []).append(s)
        full = [t for _, t in sorted(tiers.items()) if len(t) >= FAN_IN]
        return self._merge(manifest, full[0]) if full else manifest

    def _merge(self, manifest: dict, some: list[dict]) -> dict:
        """Replace some segments by one that holds their live rows, each with its old number."""
        names = {s["name"] for s in some}
        others = [s for s in manifest["segments"] if s["name"] not in names]
        segment = f"m{manifest['number']:012d}-{uuid.uuid4().hex[:8]}"
        inside = F.col("segment").isin(sorted(names))
        for name in ("chunks", "postings", *(["vectors"] if self.embed is not None else [])):
            self._write(name, self.live(name, manifest).where(inside).drop("segment", "bucket"), segment)
        # An id is forgotten once no segment outside has rows from before it was named.
        oldest = min((s["low"] for s in others), default=None)
        gone = self.table("gone", manifest).where(inside).groupBy("chunk_id").agg(F.max("seq").alias("seq"))
        self._write("gone", gone.where(F.lit(False) if oldest is None else F.col("seq") > oldest), segment)
        self._write("terms", self.table("terms", manifest).where(inside).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0"), segment)
        made = {"name": segment, "rows": self._read_segment("chunks", segment).count(), "low": min(s["low"] for s in some),
                "high": max(s["high"] for s in some), "n": sum(s["n"] for s in some), "dl": sum(s["dl"] for s in some)}
        return self.tidy(self._commit(manifest, [*others, made]))

    def vacuum(self, keep: int = KEPT_MANIFESTS) -> list[str]:
        """Delete manifests but the last ``keep``, and segments that none of those names; returns the segments' names.

        Not to be called while a change is under way: what it has written is in no manifest yet.
        """
        last = self.manifest()["number"]
        if not last:
            return []
        found = self.spark.read.schema(f"{_MANIFEST}, number bigint").json(f"{self.path}/manifest")
        used = {r[0] for r in found.where(F.col("number") > last - keep).select(F.explode("segments.name")).distinct().collect()}
        removed = set()
        for name in self.schemas:
            folder = self._hadoop_path(name)
            for status in (self._files.listStatus(folder) if self._files.exists(folder) else []):
                segment = status.getPath().getName().partition("segment=")[2]
                if segment and segment not in used:
                    self._files.delete(status.getPath(), True)
                    removed.add(segment)
        for status in self._files.listStatus(self._hadoop_path("manifest")):
            number = status.getPath().getName().partition("number=")[2]
            if number and int(number) <= last - keep:
                self._files.delete(status.getPath(), True)
        return sorted(removed)

    # -- reading -----------------------------------------------------------------------------

    def open(self) -> Index:
        """The live index in its present state; later changes don't touch what it reads before a vacuum."""
        manifest = self.manifest()
        vectors = self.live("vectors", manifest).select("chunk_id", "embedding") if self.embed is not None else None
        return Index(self.live("chunks", manifest).drop("seq", "dl", "segment"), SegmentPostings(self, manifest), vectors, self.tokenizer)

    def count(self) -> int:
        return sum(s["n"] for s in self.manifest()["segments"])
