"""Question answering and research: recall as DataFrames, then injected services over bounded lists of hits.

A question goes through stages: a plan, recall, reranking, and then either the judging of documents one by one (a stream of
events that ends in an answer) or a report. The services are a chat model (complete_json), a reranker and an embedder;
`search` may be replaced too. An Answerer's steps are methods, so that a subclass can replace any of them.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Any

from ..config import Settings
from ..services import LLM, Embedder, Reranker
from . import citing, prompts
from . import recall as R
from .errors import MissingService, StageError
from .planning import Plan, make_plan
from .recall import search

__all__ = ["Answerer", "MissingService", "StageError", "answer", "answer_stream", "research", "search"]

#: Documents in a row without support that end a scan.
STREAK = 20
STOPPED = f"{STREAK} documents in a row without direct support"


@dataclass
class Scan:
    """The state of a scan, as its events report it."""

    total_documents: int
    initial: int
    concurrency: int
    judged_documents: int = 0
    dispatched_documents: int = 0
    in_flight_documents: int = 0
    direct_documents: int = 0
    background_documents: int = 0
    failed_documents: int = 0
    stopped_after_documents: int = 0
    stopped_early: bool = False
    pressure_events: int = 0
    streak: int = 0

    def state(self) -> dict[str, Any]:
        names = ("total_documents", "judged_documents", "dispatched_documents", "in_flight_documents", "direct_documents", "background_documents", "failed_documents", "stopped_early", "stopped_after_documents")
        return {k: getattr(self, k) for k in names} | {"active_judge_concurrency": self.concurrency, "concurrency_locked": self.concurrency < self.initial, "dispatch_stopped": self.stopped_early, "stop_reason": STOPPED if self.stopped_early else None}

    def count(self, label: str | None) -> None:
        """Takes a document's label (None: its judging failed)."""
        self.judged_documents += 1
        self.direct_documents += label == "direct_support"
        self.background_documents += label == "background_only"
        self.failed_documents += label is None
        self.streak = 0 if label == "direct_support" else self.streak + 1
        if self.streak >= STREAK and not self.stopped_early:
            self.stopped_early, self.stopped_after_documents = True, self.judged_documents

    def status(self) -> str:
        if not self.stopped_early:
            return f"scanned all ranked documents: {self.judged_documents} of {self.total_documents} judged"
        return f"stopped sending documents after {self.stopped_after_documents} of {self.total_documents} ({STOPPED}); those under way were finished: {self.judged_documents} judged, {self.direct_documents} with direct support"


class Clock:
    """Seconds by stage."""

    def __init__(self):
        self.began = self.last = time.perf_counter()
        self.seconds: dict[str, float] = {}

    def lap(self, stage: str) -> None:
        now = time.perf_counter()
        self.seconds[f"{stage}_seconds"], self.last = now - self.last, now

    def total(self) -> dict[str, float]:
        return self.seconds | {"total_seconds": time.perf_counter() - self.began}


@dataclass
class Answerer:
    store: Any
    llm: LLM | None = None
    reranker: Reranker | None = None
    embedder: Embedder | None = None
    find: R.Search | None = None
    settings: Settings = field(default_factory=Settings)

    def chat(self, question: str) -> LLM:
        if self.llm is None:
            raise MissingService(question, "a chat model")
        return self.llm

    def analyze(self, question: str) -> Plan:
        chat = self.chat(question)
        try:
            return make_plan(question, chat.complete_json(prompts.PLANNER, prompts.plan_request(question)), self.settings.top_k_vector, self.settings.top_k_keyword)
        except Exception as e:
            raise StageError("analyze", question, e) from e

    # documents

    def recall_documents(self, question: str, plan: Plan) -> tuple[list[dict], list[str]]:
        found, used = R.recall_documents(self.store, plan, self.find, max(1, self.settings.document_recall_limit), self.embedder)
        return [r.asDict(recursive=True) for r in found.collect()], used  # at most document_recall_limit rows

    def rerank_documents(self, question: str, plan: Plan, docs: list[dict]) -> list[dict]:
        if self.reranker is None or len(docs) < 2:
            return docs
        s = self.settings
        scores = self.rerank(question, plan, [prompts.document_rerank_text(d, s.rerank_document_chunks, s.rerank_document_text_limit) for d in docs])
        key = lambda i: (-scores.get(i, float("-inf")), -docs[i]["aggregate_score"], -docs[i]["matched_bundle_count"], -docs[i]["top_chunks"][0]["score_final"], i)
        return [docs[i] | {"rerank_score": scores.get(i)} for i in sorted(range(len(docs)), key=key)]

    def rerank(self, question: str, plan: Plan, texts: list[str]) -> dict[int, float]:
        """Scores by position, in requests that keep to the token budget; positions outside a request are dropped."""
        query, scores = plan.target.strip() or question, {}
        for batch in citing.rerank_batches(texts, query, self.settings.rerank_instruct, self.settings.rerank_token_budget):
            for i, score in self.reranker.rerank(query=query, documents=[texts[k] for k in batch], top_n=len(batch)):
                if isinstance(i, int) and 0 <= i < len(batch):
                    scores[batch[i]] = float(score)
        return scores

    def documents(self, question: str, plan: Plan, clock: Clock) -> tuple[list[dict], list[str]]:
        """Recalled and reranked, at most document_judge_limit."""
        docs, used = self.recall_documents(question, plan)
        clock.lap("retrieve")
        try:
            docs = self.rerank_documents(question, plan, docs)
        except Exception as e:
            raise StageError("rerank", question, e, plan) from e
        return docs[: max(1, self.settings.document_judge_limit)], used

    def judge(self, question: str, plan: Plan, doc: dict) -> dict[str, Any]:
        """One document's assessment; a malformed answer or a timeout is asked for once more."""
        chat = self.chat(question)
        for attempt in (1, 2):
            try:
                return citing.assessment(chat.complete_json(prompts.JUDGE, prompts.judge_request(question, plan, doc)), doc)
            except Exception as e:
                if attempt == 2 or not (isinstance(e, ValueError) or "timed out" in str(e).lower()):
                    raise StageError("judge_document", question, e, plan) from e
        raise AssertionError

    def stream(self, question: str) -> Iterator[dict[str, Any]]:
        """Events: scan_started, document_judged, first_answer_emitted, answer_updated, scan_completed.

        Documents are judged a few at a time and counted in rank order. A provider under pressure gets one request fewer at a
        time from then on, and the document again. The answer is given anew after every document_answer_stride more supports.
        """
        self.chat(question)
        clock = Clock()
        plan = self.analyze(question)
        clock.lap("analyze")
        docs, used = self.documents(question, plan, clock)
        clock.lap("rerank")
        window = max(1, self.settings.judge_concurrency)
        scan, judged, told = Scan(len(docs), window, window), {}, 0
        yield {"event": "scan_started"} | scan.state()

        def one(rank: int) -> dict | StageError:
            try:
                return self.judge(question, plan, docs[rank])
            except StageError as e:
                return e

        with ThreadPoolExecutor(window) as pool:
            under_way, done, at = {}, {}, 0
            while True:
                while not scan.stopped_early and scan.dispatched_documents < len(docs) and scan.dispatched_documents - at < scan.concurrency:
                    under_way[pool.submit(one, scan.dispatched_documents)] = scan.dispatched_documents
                    scan.dispatched_documents += 1
                if at not in done:
                    if not under_way:
                        break
                    for task in wait(under_way, return_when=FIRST_COMPLETED).done:
                        done[under_way.pop(task)] = task.result()
                    continue
                found = done.pop(at)
                if isinstance(found, StageError) and found.pressure:
                    scan.concurrency = max(1, scan.concurrency - 1)
                    scan.pressure_events += 1
                    under_way[pool.submit(one, at)] = at
                    continue
                failed = isinstance(found, StageError)
                scan.count(None if failed else found["label"])
                scan.in_flight_documents = len(under_way)
                yield {"event": "document_judged", "document": docs[at], "assessment": None if failed else found, "error": str(found) if failed else None} | scan.state()
                if not failed:
                    judged[docs[at]["doc_id"]] = found
                    if found["label"] == "direct_support" and (not told or scan.direct_documents - told >= max(1, self.settings.document_answer_stride)):
                        yield {"event": "answer_updated" if told else "first_answer_emitted", "answer": self.assembled(docs, judged, used)} | scan.state()
                        told = scan.direct_documents
                at += 1
        clock.lap("judge")
        scan.stopped_after_documents = scan.stopped_after_documents or scan.judged_documents
        final = self.assembled(docs, judged, used) | {
            "stopped_early": scan.stopped_early, "stop_reason": scan.state()["stop_reason"], "stopped_after_documents": scan.stopped_after_documents, "total_documents": len(docs),
            "scan_status": scan.status(), "stage_timings": clock.total(),
            "performance_counters": {"judge_documents_total": len(docs), "judge_concurrency_initial": window, "judge_concurrency_final": scan.concurrency, "provider_pressure_events": scan.pressure_events},
        }
        yield {"event": "scan_completed", "answer": final} | scan.state()

    def assembled(self, docs: list[dict], judged: dict[str, dict], used: list[str]) -> dict[str, Any]:
        return citing.assembled(docs, judged) | {"used_queries": used, "rounds": 1}

    def answer(self, question: str) -> dict[str, Any]:
        last: dict[str, Any] = {}
        for last in self.stream(question):
            pass
        if last.get("event") != "scan_completed":
            raise StageError("scan_completed", question, "the scan ended without an answer")
        return last["answer"]

    # research

    def recall_hits(self, question: str, plan: Plan) -> tuple[list[dict], int, list[str]]:
        """The first hits, as many as are reranked, how many there are in all, and the queries."""
        most = max(1, self.settings.research_rerank_chunks)
        found, used = R.recall(self.store, plan, self.find, most, self.embedder)
        found = found.persist()
        hits = [r.asDict(recursive=True) for r in found.orderBy(*R.by_priority()).limit(most).collect()]
        count = found.count()
        found.unpersist()
        return hits, count, used

    def rerank_hits(self, question: str, plan: Plan, hits: list[dict]) -> list[dict]:
        if self.reranker is None or len(hits) < 2:
            return hits
        scores = self.rerank(question, plan, [prompts.chunk_rerank_text(h) for h in hits])
        key = lambda i: (-scores.get(i, float("-inf")), -hits[i]["score_final"], -hits[i]["score_constraint"], i)
        return [hits[i] for i in sorted(range(len(hits)), key=key)]

    def rerank_diagnostics(self, question: str, plan: Plan, hits: list[dict]) -> dict[str, int]:
        batches = citing.rerank_batches([prompts.chunk_rerank_text(h) for h in hits], plan.target.strip() or question, self.settings.rerank_instruct, self.settings.rerank_token_budget)
        return {"rerank_documents": len(hits), "rerank_batches": len(batches), "rerank_request_token_budget": self.settings.rerank_token_budget}

    def context(self, hits: list[dict]) -> list[dict]:
        """The longest run of first hits whose payloads fit the token budget."""
        room, out = max(1, max(1, self.settings.research_context_tokens) - 2000), []
        for n, h in enumerate(hits[: max(1, self.settings.research_context_chunks)], 1):
            room -= citing.token_count(prompts.reference_text(h, n)) + 16
            if room < 0:
                break
            out.append(h)
        return out

    def write(self, question: str, plan: Plan, hits: list[dict]) -> tuple[str, list[int]]:
        """The report; one that is too short is extended once."""
        chat, least = self.chat(question), max(0, self.settings.research_least_chars)
        if not hits:
            raise ValueError("no passage fits the context's token budget")
        report, used = citing.report_of(chat.complete_json(prompts.WRITER, prompts.report_request(question, hits, least)), len(hits))
        if len(report) < least:
            report, used = citing.report_of(chat.complete_json(prompts.EXTENDER, prompts.extend_request(question, hits, least, report, used)), len(hits))
        if len(report) < least:
            raise ValueError(f"the report has {len(report)} characters even when extended; {least} are asked for")
        return report, used

    def research(self, question: str) -> dict[str, Any]:
        self.chat(question)
        clock = Clock()
        plan = self.analyze(question)
        clock.lap("analyze")
        hits, count, used = self.recall_hits(question, plan)
        clock.lap("retrieve")
        try:
            ranked = self.rerank_hits(question, plan, hits)
        except Exception as e:
            raise StageError("research_rerank", question, e, plan, **self.rerank_diagnostics(question, plan, hits)) from e
        clock.lap("rerank")
        context = self.context(ranked)
        try:
            report, refs = self.write(question, plan, context)
            report, citations = citing.merged_report(report, refs, context)
        except StageError:
            raise
        except Exception as e:
            raise StageError("research_generate", question, e, plan) from e
        clock.lap("generate")
        return {"report": report, "citations": citations, "used_queries": used, "chunks_recalled": count, "chunks_reranked": len(hits), "chunks_in_context": len(context), "stage_timings": clock.total()}


def configured(store, question: str, settings: Settings, llm=None, reranker=None, embedder=None, find=None) -> tuple[Answerer, list]:
    """An Answerer with the services given, the others made from the settings (and returned, to be closed)."""
    from ..clients import ChatClient, EmbeddingClient, RerankClient

    own, missing = [], []
    if llm is None and settings.chat_key:
        llm = ChatClient(settings.chat_url, settings.chat_key, settings.chat_model)
        own.append(llm)
    if reranker is None and settings.rerank_key:
        reranker = RerankClient(settings.rerank_url, settings.rerank_key, settings.rerank_model, instruct=settings.rerank_instruct)
    if embedder is None and settings.embedding_key:
        embedder = EmbeddingClient(settings.embedding_url, settings.embedding_key, settings.embedding_model, settings.embedding_dimensions)
    if llm is None:
        raise MissingService(question, "a chat model")
    if embedder is None and find is None:
        missing.append("query embeddings")
    if reranker is None:
        missing.append("a reranker")
    if missing:
        raise MissingService(question, *missing)
    return Answerer(store, llm, reranker, embedder, find, settings), own


def _closed(clients: list) -> None:
    for c in clients:
        for name in ("close", "aclose"):
            if callable(getattr(c, name, None)):
                getattr(c, name)()
                break


def answer_stream(store, question: str, settings: Settings | None = None, **services) -> Iterator[dict[str, Any]]:
    answerer, own = configured(store, question, settings or Settings(), **services)
    try:
        yield from answerer.stream(question)
    finally:
        _closed(own)


def answer(store, question: str, settings: Settings | None = None, **services) -> dict[str, Any]:
    answerer, own = configured(store, question, settings or Settings(), **services)
    try:
        return answerer.answer(question)
    finally:
        _closed(own)


def research(store, question: str, settings: Settings | None = None, **services) -> dict[str, Any]:
    answerer, own = configured(store, question, settings or Settings(), **services)
    try:
        return answerer.research(question)
    finally:
        _closed(own)

