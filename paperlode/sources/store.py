"""Snapshot storage: documents, chunks and postings as Parquet segments, and a log of commits that say which segments count.

A commit is one small JSON file, written aside and renamed into place under the next number: it either is there, whole, or is
not. It names its segments, and the documents removed from each. Adding writes one new segment and leaves the others as they
are; removing writes none. Readers take the newest commit; a crash leaves at most a segment that no commit names, which
vacuum() deletes, as it does what older commits alone still name. compact() writes the live rows as one segment.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.titles import normal_title
from ..operators import chunking, index, lexical
from ..services import Embedder, HashEmbedder, embed_documents
from .markdown import read_markdown

DOCUMENTS = "doc_id string, source_path string, title string, normalized_title string, file_hash string, chunk_count int, indexed_at timestamp"
CHUNKS = "chunk_id string, doc_id string, title string, source_path string, page_start int, page_end int, block_start int, block_end int, section_hint string, text string, normalized_text string, keywords_hint string, vector array<float>"
POSTINGS = "term string, chunk_id string, doc_id string, tf long, positions array<int>, n_tokens int"
SCHEMAS = {"documents": DOCUMENTS, "chunks": CHUNKS, "postings": POSTINGS}
#: Of the layout of a store; a store of another number must be built anew.
LAYOUT = 2


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class Store:
    """A store under `path`, any folder that Spark reaches. One writer at a time (a second one's commit fails); readers see whole commits."""

    spark: SparkSession
    path: str

    # the log

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _listed(self, folder: str) -> list[str]:
        fs, at = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _delete(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.delete(at, True)

    def version(self) -> int:
        """The number of the newest commit; 0 for a store with none."""
        done = [n for n in self._listed("commits") if n.endswith(".json") and not n.startswith("_")]
        return int(done[-1].removesuffix(".json")) if done else 0

    def log(self) -> dict:
        version = self.version()
        if not version:
            return {"layout": LAYOUT, "segments": {}}
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/commits/{version:010d}.json").collect())  # one line
        found = json.loads(text)
        if found.get("layout") != LAYOUT:
            raise RuntimeError(f"{self.path}: its layout is outdated; build it anew")
        return found

    def _commit(self, segments: dict[str, dict], after: int) -> int:
        """segments: for each its name: {"removed": name of the list of removed documents or None}."""
        aside = f"{self.path}/commits/_{uuid.uuid4().hex}"
        fs, at = self._fs(aside)
        out = fs.create(at)
        out.write(bytearray(json.dumps({"layout": LAYOUT, "segments": segments}).encode()))
        out.close()
        if not fs.rename(at, self._fs(f"{self.path}/commits/{after + 1:010d}.json")[1]):
            fs.delete(at, False)
            raise RuntimeError(f"{self.path}: another writer has committed")
        return after + 1

    # reading

    def table(self, name: str) -> DataFrame:
        """documents, chunks or postings as the newest commit has them."""
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        parts = []
        for segment, told in self.log()["segments"].items():
            rows = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/segments/{segment}/{name}")
            for removed in told["removed"]:
                rows = rows.join(self.spark.read.schema("doc_id string").parquet(f"{self.path}/removed/{removed}"), "doc_id", "left_anti").select(names(SCHEMAS[name]))
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts) if parts else empty

    def postings(self) -> DataFrame:
        return self.table("postings")

    def corpus(self) -> DataFrame:
        """One row: docs, avg_n (tokens a chunk), for BM25 over postings: kept by segment, corrected for removed documents."""
        return self.table("postings").where("term = ''").agg(F.count("*").alias("docs"), F.avg("n_tokens").alias("avg_n"))

    def chunk(self, chunk_id: str) -> dict:
        found = self.table("chunks").where(F.col("chunk_id") == chunk_id).first()
        if found is None:
            raise KeyError(chunk_id)
        return found.asDict()

    def document_chunks(self, doc_id: str) -> DataFrame:
        return self.table("chunks").where(F.col("doc_id") == doc_id).orderBy("chunk_id")

    def list_documents(self) -> DataFrame:
        return self.table("documents").drop("indexed_at").orderBy("title", "source_path")

    def document_at(self, source_path: str) -> dict | None:
        found = self.table("documents").where(F.col("source_path") == source_path).first()
        return found and found.asDict()

    def document_titled(self, normalized_title: str) -> dict | None:
        found = self.table("documents").where(F.col("normalized_title") == normalized_title).first()
        return found and found.asDict()

    def signature(self) -> dict:
        """What changes whenever the store does."""
        return {"version": self.version(), "segments": sorted(self.log()["segments"])}

    def warm(self) -> dict:
        """How many chunks there are and of how many dimensions; a store that is not there or cannot be read is an error."""
        if not self.version():
            raise RuntimeError(f"no index at {self.path}: build one first")
        try:
            row = self.table("chunks").agg(F.count("*").alias("chunks_loaded"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("vector_dimensions"), F.count_distinct(F.size("vector")).alias("n")).first()
        except Exception as e:
            raise RuntimeError(f"the index at {self.path} cannot be read: build it anew") from e
        if row["n"] > 1:
            raise RuntimeError(f"the index at {self.path} holds vectors of different lengths")
        return {"chunks_loaded": row["chunks_loaded"], "vector_dimensions": row["vector_dimensions"]}

    # writing

    def _write(self, documents: DataFrame, chunks: DataFrame) -> str:
        """A new segment; chunks are laid out by document and postings by term, so that lookups prune files."""
        segment = f"s-{uuid.uuid4().hex}"
        at = f"{self.path}/segments/{segment}"
        documents.select(names(DOCUMENTS)).write.parquet(f"{at}/documents")
        chunks.select(names(CHUNKS)).repartition("doc_id").sortWithinPartitions("doc_id", "chunk_id").write.parquet(f"{at}/chunks")
        stored = self.spark.read.schema(CHUNKS).parquet(f"{at}/chunks")
        whole = stored.select("chunk_id", "doc_id", F.concat_ws(" ", "title", "text", "keywords_hint", "source_path").alias("text"))
        lexical.postings(whole, "chunk_id", carried=("doc_id",)).select(names(POSTINGS)).repartitionByRange("term", F.xxhash64("chunk_id")).sortWithinPartitions("term", "chunk_id").write.parquet(f"{at}/postings")
        return segment

    def _remove(self, segments: dict[str, dict], ids: DataFrame) -> dict[str, dict]:
        """The segments without the documents of `ids` (doc_id)."""
        if not segments:
            return segments
        name = f"r-{uuid.uuid4().hex}"
        ids.select("doc_id").distinct().coalesce(1).write.parquet(f"{self.path}/removed/{name}")
        return {k: {"removed": [*v["removed"], name]} for k, v in segments.items()}

    def add(self, *paths: str, **options) -> dict:
        """Indexes the .md files under the paths; unchanged files are skipped before they are parsed. Returns the counts and failures."""
        return self.add_files(read_markdown(self.spark, *paths), **options)

    def add_files(self, files: DataFrame, embedder: Embedder | None = None, chunk_size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP, rebuild: bool = False, artifacts: str | None = None) -> dict:
        """add() for rows as read_markdown() gives them. rebuild: only these files make up the store. artifacts: a folder for
        what becomes of each document (see Artifacts)."""
        embedder = embedder or HashEmbedder()
        version, log = (self.version(), {"segments": {}}) if rebuild else (self.version(), self.log())
        state = self.spark.createDataFrame([], DOCUMENTS) if rebuild else self.table("documents")
        known = state.select(F.col("source_path").alias("_p"), F.col("file_hash").alias("_h"), F.col("doc_id").alias("_known"))
        files = files.persist()
        same = files.select("source_path", "file_hash").join(known, (F.col("source_path") == F.col("_p")) & (F.col("file_hash") == F.col("_h")))
        fresh = files.join(known, (F.col("source_path") == F.col("_p")) & (F.col("file_hash") == F.col("_h")), "left_anti")
        status = index.file_status(chunking.chunk_documents(fresh, chunk_size, overlap), state).persist()
        aside = f"{self.path}/segments/_{uuid.uuid4().hex}"
        try:
            if clash := status.where("status = 'conflict'").select("source_path", "title").first():
                raise RuntimeError(f"{clash[0]}: its new title belongs to another document: {clash[1]}")
            embed_documents(status.where("status = 'processed'"), embedder).write.parquet(aside)  # each text is embedded once
            done = self.spark.read.parquet(aside)
            good = done.where("error is null").withColumn("chunk_count", F.size("chunks")).withColumn("indexed_at", F.current_timestamp())
            counts = index.build_stats(status.select("status").unionByName(same.select(F.lit("skipped").alias("status")))).first().asDict()
            failed = status.where("status = 'failed'").select("source_path", "error").unionByName(done.where("error is not null").select("source_path", "error"))
            # the messages are shown one by one: the first thousand; the count is whole
            counts["failed_files"] = [f"{r[0]}: {r[1]}" for r in failed.orderBy("source_path").limit(1000).collect()]
            late = done.where("error is not null").count()
            counts |= {"processed": counts["processed"] - late, "failed": counts["failed"] + late, "chunks_indexed": good.agg(F.coalesce(F.sum("chunk_count"), F.lit(0))).first()[0]}
            if counts["processed"] or rebuild or not version:
                gone = reduce(DataFrame.unionByName, [state.join(good.select(k).distinct(), k, "left_semi").select("doc_id") for k in ("doc_id", "source_path", "normalized_title")])
                segments = self._remove(log["segments"], gone) | {self._write(good, chunking.chunk_table(good)): {"removed": []}}
                self._commit(segments, version)
            if artifacts:
                kept = Artifacts(self.spark, artifacts)
                again = kept.missing(same.select(F.col("_known").alias("doc_id")))
                counts["artifacts_written"] = kept.write(self, good.select("doc_id").unionByName(again), chunk_size, overlap)
        finally:
            self._delete(aside)
            status.unpersist()
            files.unpersist()
        return counts

    def delete_source(self, source_path: str) -> bool:
        """Deletes a document's Markdown file; False if it is not there. Any other kind of file is refused."""
        fs, at = self._fs(source_path if "://" in source_path else f"file://{source_path}")
        if not fs.exists(at):
            return False
        if fs.getFileStatus(at).isDirectory() or not source_path.lower().endswith(".md"):
            raise RuntimeError(f"not a Markdown file, and so not deleted: {source_path}")
        return fs.delete(at, False)

    def delete(self, wanted: str, artifacts: str | None = None, delete_source: bool = False) -> dict:
        """Removes the one document that the request names by title or file name; none or several are errors. Its file stays
        unless delete_source asks otherwise."""
        found = index.delete_matches(self.table("documents"), wanted).limit(6).collect()
        if not found:
            raise ValueError(f"no document matches {wanted!r}")
        if len(found) > 1:
            raise ValueError(f"{wanted!r} is ambiguous: " + ", ".join(f"{r['title']} ({r['source_path']})" for r in found))
        row = found[0]
        chunks = self.table("chunks").where(F.col("doc_id") == row["doc_id"]).count()
        self._commit(self._remove(self.log()["segments"], self.spark.createDataFrame([(row["doc_id"],)], "doc_id string")), self.version())
        gone = Artifacts(self.spark, artifacts).delete(row["doc_id"]) if artifacts else 0
        return {"doc_id": row["doc_id"], "title": row["title"], "source_path": row["source_path"], "matched_by": row["matched_by"], "chunks": chunks, "artifacts_deleted": gone, "source_deleted": delete_source and self.delete_source(row["source_path"])}

    def clear(self) -> None:
        self._commit({}, self.version())

    def compact(self) -> None:
        """The live rows as one segment, without lists of removed documents."""
        self._commit({self._write(self.table("documents"), self.table("chunks")): {"removed": []}}, self.version())

    def vacuum(self) -> int:
        """Deletes what the newest commit does not name, and older commits. Returns how many folders and files went."""
        log, version = self.log(), self.version()
        removed = {r for told in log["segments"].values() for r in told["removed"]}
        old = [f"commits/{n}" for n in self._listed("commits") if n != f"{version:010d}.json"]
        old += [f"segments/{n}" for n in self._listed("segments") if n not in log["segments"]]
        old += [f"removed/{n}" for n in self._listed("removed") if n not in removed]
        return sum(self._delete(f"{self.path}/{n}") for n in old)


@dataclass
class Artifacts:
    """What became of each document, for people to look at: chunks/doc_id=<id> (JSON) and preview/doc_id=<id> (Markdown)."""

    spark: SparkSession
    path: str
    KINDS = ("chunks", "preview")

    def _at(self, kind: str, doc_id: str | None = None):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}" + (f"/doc_id={doc_id}" if doc_id else ""))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, doc_id: str) -> bool:
        return all(fs.exists(at) for fs, at in (self._at(k, doc_id) for k in self.KINDS))

    def delete(self, doc_id: str) -> int:
        return sum(fs.delete(at, True) for fs, at in (self._at(k, doc_id) for k in self.KINDS))

    def clear(self) -> None:
        for fs, at in (self._at(k) for k in self.KINDS):
            fs.delete(at, True)

    def missing(self, ids: DataFrame) -> DataFrame:
        """Of doc_id those without both kinds."""
        for kind in self.KINDS:
            fs, at = self._at(kind)
            if not fs.exists(at):
                return ids
        held = [self.spark.read.format("binaryFile").option("basePath", f"{self.path}/{k}").load(f"{self.path}/{k}").select(F.regexp_extract("path", "doc_id=([^/]+)", 1).alias("doc_id")).distinct() for k in self.KINDS]
        return ids.join(held[0].join(held[1], "doc_id"), "doc_id", "left_anti")

    def write(self, store: Store, ids: DataFrame, chunk_size: int, overlap: int) -> int:
        """Both kinds for the documents of `ids`. Returns how many artifacts were written."""
        ids = ids.select("doc_id").distinct()
        documents = store.table("documents").join(ids, "doc_id", "left_semi")
        chunk = F.struct("chunk_id", "section_hint", "page_start", "page_end", "block_start", "block_end", "keywords_hint", "text")
        chunks = store.table("chunks").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
        empty = F.array().cast("array<struct<chunk_id: string, section_hint: string, page_start: int, page_end: int, block_start: int, block_end: int, keywords_hint: string, text: string>>")
        rows = documents.join(chunks, "doc_id", "left").select("doc_id", "title", "source_path", "file_hash", F.lit("markdown_chunked").alias("cleaning_profile"), F.lit(chunk_size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), "chunk_count", F.coalesce("chunks", empty).alias("chunks"))
        told = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false", "pretty": "true"})
        self._put("chunks", rows.select(told.alias("value"), "doc_id"))
        field = lambda name, c: F.concat(F.lit(f"- {name}: `"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("`"))
        piece = "concat('\n## Chunk ', lpad(cast(i + 1 as string), 4, '0'), '\n\n- chunk_id: `', c.chunk_id, '`\n- section_hint: `', coalesce(c.section_hint, ''), '`\n- keywords_hint: `', c.keywords_hint, '`\n\n', c.text, '\n')"
        head = F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.lit(""), *[field(c, c) for c in ("doc_id", "source_path", "file_hash", "chunk_count", "chunk_size", "chunk_overlap")])
        preview = F.concat(head, F.lit("\n"), F.expr(f"array_join(transform(chunks, (c, i) -> {piece}), '')"))
        self._put("preview", rows.select(preview.alias("value"), "doc_id"))
        return 2 * documents.count()

    def _put(self, kind: str, rows: DataFrame) -> None:
        """Replaces the folders of the documents in `rows`, and no others."""
        rows.repartition("doc_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").text(f"{self.path}/{kind}")


__all__ = ["Artifacts", "Store", "normal_title"]
