"""A knowledge base from files: states, changed and broken documents, deletion, and searches over what is there."""

import io
import zipfile

from parlance.operators.knowledge_base import KnowledgeBase

FILES = "doc_id string, title string, path string, content binary"


def _docx(*paragraphs):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<w:document xmlns:w='w'>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "</w:document>")
    return out.getvalue()


def test_documents_from_files_to_answers(spark, tmp_path):
    base = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    files = lambda *rows: spark.createDataFrame([(d, t, f"{d}.{e}", bytearray(c)) for d, t, e, c in rows], FILES)
    queries = spark.createDataFrame([(1, "annual fee of the card"), (2, "lost card report")], "query_id long, text string")
    best = lambda: {r["query_id"]: r["doc_id"] for r in base.search(queries, k=1).collect()}

    long = "the fee table of many cards and more words about it. " * 60
    first = (("fees", "Fees", "txt", f"The annual fee of the gold card.\n\n{long}".encode()), ("loss", "Loss", "docx", _docx("Report a lost card at once.", "A new card is sent.")), ("bad", "Bad", "pdf", b"%PDF-1.4"), ("void", "Void", "txt", b" \n"))
    assert base.ingest(files(*first)) == {"ready": 2, "failed": 2, "unchanged": 0}
    states = {r["doc_id"]: r for r in base.states().collect()}
    assert (states["bad"]["state"], states["bad"]["attempts"], states["fees"]["state"]) == ("failed", 1, "ready") and states["fees"]["chunk_count"] > 2 and "library" in states["bad"]["error"] and states["void"]["error"] == "no text"
    assert best() == {1: "fees", 2: "loss"}

    # what is ready and unchanged isn't read again; what failed is tried again
    assert base.ingest(files(*first)) == {"ready": 0, "failed": 2, "unchanged": 2} and {r["doc_id"]: r["attempts"] for r in base.states().collect()} == {"bad": 2, "void": 2, "fees": 1, "loss": 1}
    assert base.ingest(files(("bad", "Bad", "txt", b"now it can be read: interest rates")))["ready"] == 1

    # a shorter version leaves none of the old chunks; one that fails leaves them all
    before = base.chunks().where("doc_id = 'loss'").count()
    assert base.ingest(files(("fees", "Fees", "txt", b"Nothing about money here."), ("loss", "Loss", "docx", b"PK broken"))) == {"ready": 1, "failed": 1, "unchanged": 0}
    assert [r["text"] for r in base.chunks().where("doc_id = 'fees'").collect()] == ["Nothing about money here."] and base.chunks().where("doc_id = 'loss'").count() == before
    live = {r["chunk_id"] for r in base.chunks().collect()}
    assert live == {r["chunk_id"] for r in base.sparse.chunks().collect()} == {r["chunk_id"] for r in base.vectors.ids().collect()}

    gone = spark.createDataFrame([("loss",), ("unknown",)], "doc_id string")
    assert base.delete(gone) == before and base.delete(gone) == 0 and "loss" not in {r["doc_id"] for r in base.states().collect()}
    assert "loss" not in {r["doc_id"] for r in base.search(queries).collect()}
    live = {r["chunk_id"] for r in base.chunks().collect()}
    assert live == {r["chunk_id"] for r in base.sparse.chunks().collect()} == {r["chunk_id"] for r in base.vectors.ids().collect()}


def test_nothing_to_read(spark, tmp_path):
    base = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    assert base.delete(spark.createDataFrame([("x",)], "doc_id string")) == 0
    assert base.ingest(spark.createDataFrame([], FILES)) == {"ready": 0, "failed": 0, "unchanged": 0} and base.states().count() == 0
