"""Plans, judgements, answers and reports with scripted services."""

import pytest

from paperlode.config import Settings
from paperlode.plans import answer as A
from paperlode.plans import citing, prompts
from paperlode.plans.errors import MissingService, StageError, excerpt
from paperlode.plans.planning import bundles, distinct, groups, make_plan, strings
from paperlode.services import HashEmbedder, WordReranker
from paperlode.sources.store import Store

PAPERS = [f"# Paper {w} about calcium phosphate growth\n\n## Abstract\n\nAlkaline {w} conditions promote calcium phosphate growth at pH {n}.\n" for n, w in enumerate(("one", "two", "three", "four", "five", "six"), 5)]
PLAN = {"target_claim": "Alkaline water makes calcium phosphate grow.", "entity_terms_en": ["calcium phosphate"], "condition_terms_en": ["alkaline"], "query_bundles": [{"bundle_name": "main", "query": "alkaline calcium phosphate", "keyword_phrases": ["calcium phosphate"]}]}


class Script:
    """A chat model: answers by the kind of request."""

    def __init__(self, judge=None, reports=(), plan=PLAN):
        self.judge, self.reports, self.plan, self.asked, self.closed = judge, list(reports), plan, [], False

    def complete_json(self, system, user):
        self.asked.append((system, user))
        if system == prompts.PLANNER:
            return self.plan
        if system == prompts.JUDGE:
            return self.judge(user)
        return {"report": self.reports.pop(0), "used_ref_ids": [1]}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("papers")
    for n, text in enumerate(PAPERS):
        (root / f"p{n}.md").write_text(text)
    store = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    assert store.add(f"file://{root}")["processed"] == 6
    return store


def services(**more):
    return {"reranker": WordReranker(), "embedder": HashEmbedder()} | more


def test_loose_json_becomes_lists():
    assert strings([" a ", {"x": ["A!", None, 3]}, ""]) == ["a", "3"] and strings("x") == ["x"] and strings(None) == []
    assert groups([["a", "b"], "c", []]) == [["a", "b"], ["c"]] and groups({"x": "a"}) == [["a"]] and groups("a") == [["a"]] and groups(None) == []
    assert [(b.name, b.query) for b in bundles({"n": "q one", "m": {"query": "Q, one"}, "k": {"query": " "}})] == [("n", "q one")]
    assert [(b.name, b.query) for b in bundles(["a", {"query": "b", "bundle_name": "x"}])] == [("bundle_1", "a"), ("x", "b")] and bundles(7) == [] and bundles("q")[0].query == "q"
    assert distinct(["A-b", "a b", " ", "ab"]) == ["A-b"]


def test_plan_fills_in_what_is_missing():
    plan = make_plan("問?", {"target_claim": "c", "must_have_terms": list("abcdefgh"), "condition_terms_en": ["x"], "numeric_constraints": ["pH 9", "X"], "mode": "odd", "top_k_vector": "0", "top_k_keyword": "many"})
    assert plan.entities == list("abcdef") and plan.groups == [list("abcdef"), ["x", "pH 9"]] and plan.language == "zh" and plan.hard == ["x", "pH 9"]
    assert [b.name for b in plan.bundles] == ["exact_condition", "numeric_condition", "domain_entity", "mechanistic_variant"]
    assert plan.bundles[0].query == "x a b c" and plan.bundles[1].phrases == ["pH 9", "X", "a", "b"] and plan.bundles[2].required == ["a", "b", "c", "x"]
    assert (plan.mode, plan.top_k_vector, plan.top_k_keyword) == ("hybrid", 1, 30) and plan.must_have[-2:] == ["x", "pH 9"]
    many = make_plan("q", {"target_claim": "c", "entity_terms_en": ["e"], "query_bundles": [f"query {i}" for i in range(12)]})
    assert len(many.bundles) == 8 and many.brief(True)["query_bundles"][0]["query"] == "query 0" and len(many.snapshot()["query_bundles"]) == 8
    for bad in ({}, {"target_claim": "c"}):
        with pytest.raises(ValueError):
            make_plan("q", bad)


def hit(n, doc="d", **more):
    return {"doc_id": doc, "chunk_id": f"{doc}-{n}:000{n}", "title": doc.upper(), "citation": f"{doc.upper()} (p. 0, chunk {n}:000{n})", "page_start": 0, "page_end": 0, "score_final": n / 10, "score_constraint": 0.0, "section_hint": None, "text": f"text {n}", "retrieval_source": "hybrid"} | more


def test_assessments():
    doc = {"doc_id": "d", "top_chunks": [hit(1, matched_constraints=["a"]), hit(2)]}
    told = citing.assessment({"label": " Direct_Support", "answer_line": "2) It  grows.", "supporting_chunk_ids": ["d-1:0001", "other", "d-2:0002"], "matched_constraints": "A"}, doc)
    assert told["label"] == "direct_support" and told["supporting_chunk_ids"] == ["d-1:0001", "d-2:0002"]
    found = citing.supporting_hits(told, doc)
    assert [h["chunk_id"] for h in found] == ["d-2:0002", "d-1:0001"] and found[1]["matched_constraints"] == ["a"]
    assert citing.assessment({"label": "background_only"}, doc)["supporting_chunk_ids"] == ["d-1:0001"] and citing.assessment({"label": "great", "answer_line": "x"}, doc) | {"reason": ""} == citing.assessment({}, doc)
    with pytest.raises(ValueError):
        citing.assessment({"label": "direct_support", "answer_line": " "}, doc)
    assert citing.assembled([doc], {"d": told}) == {"answer": "1. It grows.", "citations": ["[1] D (p. 0, chunk 2:0002; p. 0, chunk 1:0001)"], "confidence": "high"}
    assert citing.assembled([doc], {}) == {"answer": citing.NO_SUPPORT, "citations": [], "confidence": "low"}


def test_report_citations_merge_by_document():
    hits = [hit(1, "a"), hit(2, "b"), hit(3, "a"), hit(1, "a")]
    text, refs = citing.report_of({"report": "x [3, 1] y [2][2] [9]. [1] [3]", "used_ref_ids": ["[4]", 9, "x", 2]}, 4)
    assert refs == [3, 1, 2, 4]
    report, citations = citing.merged_report(text, refs, hits)
    assert report == "x [1] y [2]. [1]" and citations == ["[1] A (p. 0, chunk 3:0003; p. 0, chunk 1:0001)", "[2] B (p. 0, chunk 2:0002)"]
    assert citing.collapsed("[1][1] [2][1] z") == "[1][2]z" and citing.dangling("[1][3]", ["x"]) == [3] and citing.ref_ids("[2]", 3) == [2] and citing.ref_ids(None, 3) == []
    with pytest.raises(ValueError):
        citing.report_of({"report": " "}, 3)


def test_payloads():
    h = hit(1, matched_constraints=list("abcdefgh"), section_hint="S")
    assert prompts.hit_payload(h, 3)["text"] == "tex" and prompts.hit_payload(h)["matched_constraints"] == list("abcdef")
    assert prompts.reference_payload(h, 4)["ref_id"] == 4 and "section_hint" not in prompts.reference_payload(hit(1), 1)
    assert prompts.chunk_rerank_text(h) == f"Title: D\nChunk: {h['chunk_id']}\nSection: S\nEvidence: text 1"
    doc = {"title": "D", "top_chunks": [h, hit(2), hit(3), hit(4)]}
    assert prompts.document_rerank_text(doc).count("Evidence") == 3 and prompts.document_rerank_text(doc, 3, 10) == "Title:..."
    assert excerpt("a  b", 0) == "a b" and excerpt("abcdef", 5) == "ab..." and excerpt("abcdef", 2) == "ab" and excerpt(" ") is None
    assert citing.rerank_batches(["x" * 400, "y" * 400, "z" * 9000], "q", budget=330) == [[0, 1], [2]] and citing.rerank_batches([], "q") == []


def test_answer_cites_the_supporting_documents(store):
    chat = Script(lambda user: {"label": "direct_support", "answer_line": "1. It grows."} if "Paper two" in user or "Paper four" in user or "Paper five" in user else {"label": "background_only"})
    events = list(A.answer_stream(store, "Does alkaline help?", llm=chat, **services()))
    kinds = [e["event"] for e in events]
    assert kinds[0] == "scan_started" and kinds[-1] == "scan_completed" and kinds.count("document_judged") == 6 and kinds.count("first_answer_emitted") == kinds.count("answer_updated") == 1
    final = events[-1]["answer"]
    assert final["answer"].count("It grows.") == 3 and len(final["citations"]) == 3 and final["confidence"] == "high" and not final["stopped_early"]
    assert final["used_queries"][0] == "alkaline calcium phosphate" and final["performance_counters"]["judge_documents_total"] == 6 and "6 of 6" in final["scan_status"]
    assert set(final["stage_timings"]) == {f"{s}_seconds" for s in ("analyze", "retrieve", "rerank", "judge", "total")}
    none = A.answer(store, "q", llm=Script(lambda user: {"label": "off"}), **services())
    assert none["answer"] == citing.NO_SUPPORT and none["confidence"] == "low"


def test_pressure_lowers_concurrency_and_asks_again(store):
    tries = []

    def judge(user):
        tries.append(user)
        if len(tries) <= 2:
            raise RuntimeError("429: too many requests")
        return {"label": "background_only"}

    final = A.answer(store, "q", Settings(judge_concurrency=2), llm=Script(judge), **services())
    n = final["performance_counters"]
    assert n["judge_concurrency_final"] == 1 and n["provider_pressure_events"] == 2 and len(tries) == 8


def test_malformed_judgements_are_asked_for_twice(store):
    seen = {}

    def judge(user):
        seen[user] = seen.get(user, 0) + 1
        return {"label": "direct_support"}  # without a line

    events = list(A.answer_stream(store, "q", llm=Script(judge), **services()))
    assert set(seen.values()) == {2} and events[-1]["failed_documents"] == 6 and all(e["error"] for e in events if e["event"] == "document_judged")


def test_a_long_run_without_support_ends_the_scan(store, monkeypatch):
    monkeypatch.setattr(A, "STREAK", 2)
    final = A.answer(store, "q", Settings(judge_concurrency=1), llm=Script(lambda user: {"label": "off_target"}), **services())
    assert final["stopped_early"] and final["stopped_after_documents"] == 2 and "stopped sending" in final["scan_status"]


def test_research(store):
    long = "word " * 120
    chat = Script(reports=["short [1]", long + "[1][2] and [1, 99]."])
    out = A.research(store, "q", llm=chat, **services())
    assert out["report"].endswith("[1][2]and [1].") and len(out["citations"]) == 2 and [s for s, _ in chat.asked][-1] == prompts.EXTENDER
    assert out["chunks_in_context"] == out["chunks_reranked"] == out["chunks_recalled"] == 6
    with pytest.raises(StageError) as e:
        A.research(store, "q", llm=Script(reports=["short", "short"]), **services())
    assert e.value.stage == "research_generate" and e.value.diagnostics()["query_analysis"]["target_claim"] == PLAN["target_claim"]


def test_failures_say_their_stage(store):
    class Broken:
        def rerank(self, **_):
            raise OSError("gone")

    with pytest.raises(StageError) as e:
        A.research(store, "q", llm=Script(), embedder=HashEmbedder(), reranker=Broken())
    assert e.value.stage == "research_rerank" and e.value.diagnostics()["rerank_documents"] == 6
    for stage, chat, more in (("analyze", Script(plan={}), {}), ("rerank", Script(), {"reranker": Broken()})):
        with pytest.raises(StageError) as e:
            A.answer(store, "q", llm=chat, **services(**more))
        assert e.value.stage == stage
    for missing in ({}, {"llm": Script()}, {"llm": Script(), "embedder": HashEmbedder()}):
        with pytest.raises(MissingService):
            A.answer(store, "q", **missing)
    with pytest.raises(MissingService):
        A.Answerer(store).answer("q")


def test_steps_can_be_replaced(store):
    class Mine(A.Answerer):
        def documents(self, question, plan, clock):
            docs, used = super().documents(question, plan, clock)
            return docs[:1], used

    found = []
    mine = Mine(store, Script(lambda user: {"label": "direct_support", "answer_line": "Yes."}), find=lambda query, mode, v, k, phrases: found.append((query, phrases)) or A.R.candidates(store.table("chunks"), query, "keyword"))
    assert mine.answer("q")["answer"] == "1. Yes." and ("alkaline calcium phosphate", ["calcium phosphate"]) in found and ("alkaline calcium phosphate", None) in found


def test_interactive_mode(store, capsys):
    from paperlode.cli import interactive, main, waiting

    lines = iter(["research", "what?", ""])
    assert interactive(store, Settings(), lambda prompt: next(lines), llm=Script(reports=["word " * 120 + "[1]"]), **services()) == 0
    out = capsys.readouterr().out
    assert "6 chunks, 64 dimensions" in out and "References:" in out and "- chunks in context: 6" in out
    lines = iter(["", "what?"])  # then the input ends

    def read(prompt):
        try:
            return next(lines)
        except StopIteration:
            raise EOFError from None

    chat = Script(lambda user: {"label": "direct_support", "answer_line": "Yes."})
    assert main(["--index-path", store.path], store.spark, read, llm=chat, **services()) == 0 and "1. Yes." in capsys.readouterr().out
    assert main(["--index-path", store.path, "answer", "what?"], store.spark, llm=chat, **services()) == 0 and '"confidence": "high"' in capsys.readouterr().out
    assert main(["--index-path", store.path, "answer", "what?"], store.spark) == 1 and "needed and not configured" in capsys.readouterr().err
    assert main(["--index-path", store.path + "-none"], store.spark, read) == 1
    import io

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    screen = Terminal()
    assert waiting("thinking", lambda: __import__("time").sleep(0.3) or 7, screen) == 7 and "thinking..." in screen.getvalue()
