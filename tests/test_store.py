"""Build, add, delete, look up and search over small papers; commits, clean-up and artifacts."""

import json

import pytest
from pyspark.sql import functions as F

from paperlode.plans import recall as R
from paperlode.services import HashEmbedder
from paperlode.sources.store import Artifacts, Store

PAPERS = {
    "direct.md": "# Direct Paper on Alkaline Growth\n\n## Abstract\n\nAlkaline conditions promote calcium phosphate growth in solution.\n",
    "background.md": "# Background Paper on Bone Chemistry\n\n## Abstract\n\nBone mineralization depends on pH in several ways.\n",
    "off.md": "# Off Target Paper about Pores\n\n## Abstract\n\nNanoconfinement shapes crystals in narrow channels.\n",
    "bad.md": "## Abstract\n\nNo title here.\n",
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("papers")
    for name, text in PAPERS.items():
        (root / name).write_text(text)
    (root / "notes.txt").write_text("not Markdown")
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    store.root, store.kept = root, f"file://{tmp_path_factory.mktemp('artifacts')}"
    counts = store.add(f"file://{root}", f"file://{root}/direct.md", f"file://{root}/notes.txt", f"file://{root}/none", artifacts=store.kept)
    assert (counts["processed"], counts["failed"], counts["skipped"], counts["chunks_indexed"], counts["artifacts_written"]) == (3, 1, 0, 3, 6)
    assert "bad.md" in counts["failed_files"][0]
    return store


def test_search_finds_the_direct_paper(store):
    assert R.search(store, "alkaline calcium phosphate", "vector", 2).count() == 2
    for mode in ("keyword", "hybrid"):
        assert R.search(store, "alkaline calcium phosphate", mode).first()["title"].startswith("Direct Paper")
    assert R.search(store, "?", "keyword").count() == 0 and R.search(store, "x", "vector", 5, 0).count() == 0
    assert [r["title"][:6] for r in R.search(store, "growth", "keyword", phrases=["calcium phosphate"]).collect()] == ["Direct"]
    with pytest.raises(ValueError):
        R.search(store, "x", "other")


def test_postings_rank_as_the_texts_do(store):
    from paperlode.operators import lexical

    words = ["growth", "paper", "ph"]
    by_text = {r[0]: r[1] for r in lexical.bm25(R.searched(store.table("chunks")), words, "chunk_id", "_all").collect()}
    by_index = {r[0]: r[1] for r in lexical.bm25_postings(store.postings(), store.corpus(), words).collect()}
    assert by_text.keys() == by_index.keys() and all(by_text[k] == pytest.approx(by_index[k]) for k in by_text)


def test_lookups(store):
    listed = store.list_documents().collect()
    assert [r["title"].split()[0] for r in listed] == ["Background", "Direct", "Off"]
    one = listed[1]
    assert store.document_chunks(one["doc_id"]).count() == one["chunk_count"] == 1
    assert store.chunk(f"{one['doc_id']}:0001")["doc_id"] == one["doc_id"] and store.document_at(one["source_path"])["doc_id"] == one["doc_id"]
    assert store.document_titled(one["normalized_title"])["doc_id"] == one["doc_id"] and store.document_at("none") is None
    with pytest.raises(KeyError):
        store.chunk("none")
    assert store.warm() == {"chunks_loaded": 3, "vector_dimensions": 64}


def test_artifacts(store):
    kept, doc = Artifacts(store.spark, store.kept), store.list_documents().first()
    assert kept.exists(doc["doc_id"])
    told = json.loads("\n".join(r[0] for r in store.spark.read.text(f"{store.kept}/chunks/doc_id={doc['doc_id']}").collect()))
    assert told["title"] == doc["title"] and told["chunk_count"] == len(told["chunks"]) == 1 and told["cleaning_profile"] == "markdown_chunked"
    preview = [r[0] for r in store.spark.read.text(f"{store.kept}/preview/doc_id={doc['doc_id']}").collect()]
    assert preview[0] == f"# {doc['title']}" and "## Chunk 0001" in preview
    assert kept.delete(doc["doc_id"]) == 2 and not kept.exists(doc["doc_id"])
    assert store.add(f"file://{store.root}", artifacts=store.kept)["artifacts_written"] == 2 and kept.exists(doc["doc_id"])


def test_second_run_skips_and_changes_replace(store):
    before = store.signature()
    counts = store.add(f"file://{store.root}")
    assert (counts["skipped"], counts["processed"]) == (3, 0) and store.signature() == before
    (store.root / "dup.md").write_text(PAPERS["off.md"])
    assert store.add(f"file://{store.root}")["duplicates_skipped"] == 1
    (store.root / "dup.md").unlink()
    (store.root / "off.md").write_text(PAPERS["off.md"].replace("narrow", "wide"))
    assert store.add(f"file://{store.root}")["processed"] == 1 and len(store.log()["segments"]) == 2
    assert store.table("documents").count() == 3 and store.table("chunks").where("text like '%wide%'").count() == 1
    assert store.table("chunks").where("text like '%narrow%'").count() == 0 and store.corpus().first()["docs"] == 3


def test_a_title_taken_by_another_file_stops_the_run(store):
    (store.root / "off.md").write_text(PAPERS["direct.md"])
    with pytest.raises(RuntimeError, match="belongs to another document"):
        store.add(f"file://{store.root}")
    (store.root / "off.md").write_text(PAPERS["off.md"].replace("narrow", "wide"))


def test_a_failed_embedding_fails_its_file_only(spark, tmp_path):
    class Picky(HashEmbedder):
        def embed_texts(self, texts):
            if any("Bone" in t for t in texts):
                raise ConnectionError("no answer")
            return super().embed_texts(texts)

    for name in ("direct.md", "background.md"):
        (tmp_path / name).write_text(PAPERS[name])
    store = Store(spark, f"file://{tmp_path}/store")
    counts = store.add(f"file://{tmp_path}", embedder=Picky())
    assert (counts["processed"], counts["failed"]) == (1, 1) and "embedding failed: no answer" in counts["failed_files"][0]
    assert store.table("documents").count() == 1 and store.add(f"file://{tmp_path}")["processed"] == 1


def test_commits_are_whole(spark, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text(PAPERS["direct.md"])
    store = Store(spark, f"file://{tmp_path}/store")
    with pytest.raises(RuntimeError):
        store.warm()
    store.add(f"file://{tmp_path}/a.md")
    (tmp_path / "b.md").write_text(PAPERS["background.md"])

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(Store, "_commit", crash)
    with pytest.raises(OSError):
        store.add(f"file://{tmp_path}")
    monkeypatch.undo()
    assert store.table("documents").count() == 1  # the segment is there, but no commit names it
    assert store.add(f"file://{tmp_path}/b.md")["processed"] == 1 and store.table("documents").count() == 2
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit({}, 1)
    store.delete("b.md")
    store.compact()
    assert store.vacuum() > 0 and store.table("documents").count() == 1 and store.table("chunks").count() == 1 and len(store.log()["segments"]) == 1
    assert store.add(f"file://{tmp_path}/b.md", rebuild=True)["processed"] == 1 and store.table("documents").first()["title"].startswith("Background")
    store.clear()
    assert store.table("documents").count() == 0 and store.warm() == {"chunks_loaded": 0, "vector_dimensions": 0}
    (tmp_path / "store" / "commits" / "0000000099.json").write_text('{"layout": 1, "segments": {}}')
    with pytest.raises(RuntimeError, match="outdated"):
        store.table("documents")


def test_delete_by_title_and_file_name(store):
    with pytest.raises(ValueError, match="no document"):
        store.delete("none.md")
    gone = store.delete("some/folder/OFF.md", artifacts=store.kept)
    assert gone["matched_by"] == "filename" and gone["chunks"] == 1 and gone["artifacts_deleted"] == 2 and (store.root / "off.md").exists()
    gone = store.delete("background paper on bone chemistry!", delete_source=True)
    assert gone["matched_by"] == "title" and gone["source_deleted"] and not (store.root / "background.md").exists()
    assert not store.delete_source(str(store.root / "background.md"))
    with pytest.raises(RuntimeError, match="not a Markdown file"):
        store.delete_source(str(store.root / "notes.txt"))
    assert store.table("documents").count() == 1 and store.table("chunks").where(F.col("title").startswith("Off")).count() == 0


def test_streamed_files_are_indexed_once(spark, tmp_path):
    from paperlode.streaming.ingest import ingest_markdown

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "direct.md").write_text(PAPERS["direct.md"])
    store = Store(spark, f"file://{tmp_path}/store")
    for extra in (None, "background.md"):
        if extra:
            (tmp_path / "in" / extra).write_text(PAPERS[extra])
        ingest_markdown(store, f"file://{tmp_path}/in", f"file://{tmp_path}/state").awaitTermination()
    assert store.table("documents").count() == 2
