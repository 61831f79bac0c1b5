"""Index building: documents to chunks, postings, vocabulary, statistics and vectors."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.embedding import Embedder
from ..functions.models import Model
from ..functions.text import Tokenizer, word_tokens
from ..operators import bm25, chunkers, enrich, sections
from ..sources.index_store import IndexStore
from . import registry


@dataclass(frozen=True)
class Build:
    """Everything that one build needs besides the documents."""

    store: IndexStore
    tokenizer: Tokenizer = word_tokens
    embed: Embedder | None = None
    model: Model | None = None
    file_meta: DataFrame | None = None
    section_meta: DataFrame | None = None
    # Partitions of the postings by token. A search reads those of its terms; more of them
    # pay off when each still holds many files.
    token_buckets: int = 16


def index_key(kb: str, chunker: str, section_mode: str = "presplit", with_meta: bool = False) -> dict:
    """The identity of an index. A trailing ``_meta`` of a chunker name asks for metadata."""
    if chunker.endswith("_meta") and chunker not in registry.CHUNKERS:
        chunker, with_meta = chunker[: -len("_meta")], True
    if not registry.chunker(chunker).allows_meta:
        with_meta = False
    if section_mode not in ("presplit", "raw"):
        raise ValueError("section_mode must be presplit or raw")
    return {"kb": kb, "chunker": chunker, "section_mode": section_mode, "with_meta": with_meta}


def split_documents(docs: DataFrame, key: dict) -> DataFrame:
    """Sections of ``docs`` (``file_id, text``) as the chunker of ``key`` wants them."""
    text = docs.select("file_id", "text")
    if registry.chunker(key["chunker"]).source == "headers":
        headed = sections.header_sections(text)
        return headed.withColumn("title", F.coalesce(
            F.get("headers", F.size("headers") - 1)["title"], F.lit("")))
    if key["section_mode"] == "raw":
        return sections.whole_document(text)
    return sections.detect_sections(text)


def chunk_documents(docs: DataFrame, key: dict, setup: Build) -> DataFrame:
    """The chunks of one index. The id is made of file, section and place, so it is the
    same in every run and never collides."""
    entry = registry.chunker(key["chunker"])
    if entry.needs_model and setup.model is None:
        raise ValueError(f"chunker {key['chunker']} needs a model")
    parts = split_documents(docs, key)
    made = entry.build(parts, setup.model)
    place = [F.col("parent_idx").cast("string")] if "parent_idx" in made.columns else (
        [F.col("paragraph_idx").cast("string")] if "paragraph_idx" in made.columns else [])
    made = made.withColumn("chunk_id", F.concat_ws(
        "#", "file_id", F.col("section_idx").cast("string"), *place, F.col("ord").cast("string")))
    if key["with_meta"]:
        if setup.file_meta is None or setup.section_meta is None:
            raise ValueError("an index with metadata needs file_meta and section_meta")
        made = enrich.inject_metadata(enrich.attach_metadata(made, setup.file_meta, setup.section_meta))
    else:
        made = made.withColumns({n: F.lit("") for n in ("file_type", "file_summary", "section_summary")})
    return made.select(
        "chunk_id", "file_id", F.col("file_id").alias("source"),
        F.col("section_idx").cast("int").alias("section_idx"),
        F.col("section_idx").cast("string").alias("section_id"), F.col("title").alias("section_title"),
        F.col("ord").cast("int").alias("ord"), "index_text", "content_text",
        F.when(F.lit(key["with_meta"]), F.col("file_id")).otherwise("").alias("file_name"),
        "file_type", "file_summary", "section_summary")


def build_index(docs: DataFrame, key: dict, setup: Build, force: bool = False) -> int:
    """Build one index unless it exists; returns its number of chunks.

    Each table is written from the chunks written before it, so chunking and embedding run
    once. All of them belong to a version of this build; the store goes on serving the
    version before until the last table is written, and from then on only the new one.
    """
    store = setup.store
    if not force and store.has(key):
        return store.count(key)
    version = f"v{uuid.uuid4().hex}"
    store.write("chunks", chunk_documents(docs, key, setup), key, version)
    chunks = store.read_version("chunks", key, version)
    tokenised = bm25.tokenise(chunks, tokenizer=setup.tokenizer)
    store.write("vocab", bm25.token_ids(bm25.vocabulary(tokenised)), key, version)
    postings = bm25.document_weights(tokenised, vocab=store.read_version("vocab", key, version))
    # A file holds a range of one bucket, sorted by token. The chunk id in the range splits
    # a token that occurs everywhere over many files.
    order = ("bucket", "token", "chunk_id")
    bucketed = postings.withColumn("bucket", bm25.token_bucket(F.col("token"), setup.token_buckets))
    store.write("postings", bucketed.repartitionByRange(*order).sortWithinPartitions(*order), key, version, "bucket")
    if setup.embed is not None:
        store.write("vectors", chunks.select(
            "chunk_id", setup.embed(F.col("index_text")).alias("embedding")), key, version)
    store.write("stats", bm25.corpus_stats(tokenised).withColumns(
        {"k1": F.lit(config.BM25_K1), "b": F.lit(config.BM25_B),
         "buckets": F.lit(setup.token_buckets)}), key, version)
    store.switch(key, version)
    return store.count(key)


def build_all(docs: DataFrame, kb: str, setup: Build, names: list[str] | None = None,
              section_mode: str = "presplit", pure: bool = False, force: bool = False) -> dict[str, int | str]:
    """Build several indexes; one that fails is reported and does not stop the others.

    Without ``names`` all strategies are built, ``pure`` leaving out those that need a
    model or metadata. A strategy asked for by name is always built.
    """
    if names is None:
        names = [n for n, c in registry.CHUNKERS.items()
                 if not pure or (not c.needs_model and not n.startswith("parent_child") and c.allows_meta)]
    report: dict[str, int | str] = {}
    for name in names:
        try:
            key = index_key(kb, name, section_mode, with_meta=not pure)
            report[name] = build_index(docs, key, setup, force)
        except Exception as error:
            report[name] = f"{type(error).__name__}: {error}"
    return report


def make_metadata(docs: DataFrame, model: Model, section_mode: str = "presplit") -> tuple[DataFrame, DataFrame]:
    """File and section metadata written by a model, for an index with metadata."""
    text = docs.select("file_id", "text")
    parts = sections.detect_sections(text) if section_mode == "presplit" else sections.whole_document(text)
    section_meta = enrich.summarise_sections(parts, model)
    return enrich.file_metadata(section_meta, model), section_meta


def stored_metadata(spark: SparkSession, docs: DataFrame, model: Model, path: str,
                    section_mode: str = "presplit") -> tuple[DataFrame, DataFrame]:
    """The same through caches below ``path``: a model is asked only for what is new."""
    from ..sources.index_store import MetadataCache

    text = docs.select("file_id", "text")
    parts = sections.detect_sections(text) if section_mode == "presplit" else sections.whole_document(text)
    keyed = parts.withColumn("content_hash", F.sha2("section_text", 256))
    section_cache = MetadataCache(spark, f"{path}/sections", "file_id string, section_idx int, "
                                  "content_hash string, section_summary string",
                                  ["file_id", "section_idx", "content_hash"])
    key = ["file_id", "section_idx"]
    made = section_cache.extend(keyed, lambda new: enrich.summarise_sections(new, model).join(
        new.select(*key, "content_hash"), key))
    current = made.join(keyed.select(*key, "content_hash"), [*key, "content_hash"], "left_semi")
    # One fingerprint per file without listing its sections.
    section_print = F.xxhash64("section_idx", "content_hash")
    prints = keyed.groupBy("file_id").agg(F.concat_ws(
        "-", F.hex(F.bit_xor(section_print)), F.hex(F.sum(F.shiftrightunsigned(section_print, 16))),
        F.count(F.lit(1)).cast("string")).alias("content_hash"))
    file_cache = MetadataCache(spark, f"{path}/files", "file_id string, content_hash string, "
                               "file_type string, file_summary string", ["file_id", "content_hash"])
    files = file_cache.extend(prints, lambda new: enrich.file_metadata(
        current.join(new.select("file_id"), "file_id", "left_semi"), model).join(new, "file_id"))
    current_files = files.join(prints, ["file_id", "content_hash"], "left_semi")
    return current_files.drop("content_hash"), current.drop("content_hash")


__all__ = ["Build", "build_all", "build_index", "chunk_documents", "index_key", "make_metadata",
           "split_documents", "stored_metadata", "chunkers"]
