"""What the chat model is asked: planning, judging one document, writing and extending a report. All answers are JSON objects."""

from __future__ import annotations

import json
from typing import Any

from .planning import Plan

PLANNER = """You plan the search for a question about scientific papers. The papers are in English; the question may be in another language.
Keep the question's claim and its conditions as they are (pH, medium, scale, kind of evidence): a condition under which something is to be shown must be met, it is not background.
Put the search terms into the English that papers use. Make several query bundles (an exact one, one with numbers if there are any, one by the entities, one by the mechanism) that all keep the conditions.
Answer with one JSON object with the fields original_question, target_claim (one English sentence), evidence_type, question_language (zh or en), intent_type, analysis, must_have_terms, optional_terms, entity_terms_en, condition_terms_en, relation_terms_en, numeric_constraints, query_variants, keyword_phrases, query_bundles (objects with bundle_name, query, keyword_phrases, required_terms), must_match_groups (lists of alternatives), diagnostic_notes, mode (keyword, vector or hybrid), top_k_vector, top_k_keyword."""

JUDGE = """You judge whether one paper supports a claim. You see the paper's passages only, with their chunk ids.
label is direct_support if the passages themselves support the claim under all its conditions, background_only if they are on the subject but miss a condition, off_target otherwise.
supporting_chunk_ids names the passages that count, out of those shown. For direct_support, answer_line is required: two or three sentences in the question's language on what these passages show, with the particulars they give and nothing they do not say. Otherwise answer_line is empty.
Answer with one JSON object with the fields doc_id, label, supporting_chunk_ids, matched_constraints, missing_constraints, reason, answer_line."""

WRITER = """You write a report that answers a question from numbered passages of papers, and from nothing else, in the question's language.
Cite passages by their numbers in brackets, such as [1] or [2, 5]; cite only numbers that are there. Use the passages that serve the answer, in whatever form suits it. If they do not suffice, say so and cite the nearest.
Answer with one JSON object with the fields report and used_ref_ids (the numbers cited)."""

EXTENDER = """You make a report longer that is too short, in its language, with its claims and citations kept, from the numbered passages alone.
Answer with one JSON object with the fields report and used_ref_ids."""


def _json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


def plan_request(question: str) -> str:
    return f"Question:\n{question}"


def hit_payload(hit: dict[str, Any], limit: int | None = None) -> dict[str, Any]:
    """A hit as the judge sees it."""
    text = hit["text"][:limit] if limit and limit > 0 else hit["text"]
    keep = {k: hit.get(k) for k in ("doc_id", "chunk_id", "title", "citation", "section_hint", "score_final", "score_constraint")}
    return keep | {k: list(hit.get(k) or [])[:6] for k in ("matched_constraints", "missing_constraints")} | {"text": text}


def document_payload(doc: dict[str, Any], plan: Plan, chunks: int = 3, limit: int | None = None) -> dict[str, Any]:
    keep = {k: doc.get(k) for k in ("doc_id", "title", "source_path", "aggregate_score", "matched_bundle_count")}
    return keep | {"query_plan": plan.brief(), "chunks": [hit_payload(h, limit) for h in doc["top_chunks"][:chunks]]}


def judge_request(question: str, plan: Plan, doc: dict[str, Any]) -> str:
    return f"Question:\n{question}\n\nPlan:\n{_json(plan.brief())}\n\nPaper:\n{_json(document_payload(doc, plan))}"


def reference_payload(hit: dict[str, Any], number: int) -> dict[str, Any]:
    """A hit as the writer sees it; what it lacks is left out."""
    out = {"ref_id": number} | {k: hit.get(k) for k in ("chunk_id", "title", "citation", "score_final", "retrieval_source", "text")}
    return out | {k: hit[k] for k in ("section_hint", "matched_constraints") if hit.get(k)}


def reference_text(hit: dict[str, Any], number: int) -> str:
    return _json(reference_payload(hit, number))


def report_request(question: str, hits: list[dict[str, Any]], least: int) -> str:
    ask = f"The report must have at least {least} characters (a Chinese character counts as one); there is no upper limit." if least > 0 else "There is no limit of length."
    return f"Question:\n{question}\n\n{ask}\n\nPassages:\n{_json([reference_payload(h, n) for n, h in enumerate(hits, 1)])}"


def extend_request(question: str, hits: list[dict[str, Any]], least: int, draft: str, used: list[int]) -> str:
    return f"{report_request(question, hits, least)}\n\nNumbers that may be cited:\n{list(range(1, len(hits) + 1))}\n\nDraft ({len(draft)} characters):\n{draft}\n\nNumbers it cites:\n{used}"


def chunk_rerank_text(hit: dict[str, Any]) -> str:
    lines = [f"Title: {hit['title']}", f"Chunk: {hit['chunk_id']}", f"Section: {hit['section_hint']}" if hit.get("section_hint") else "", f"Evidence: {hit['text']}"]
    return "\n".join(x for x in lines if x).strip()


def document_rerank_text(doc: dict[str, Any], chunks: int = 3, limit: int = 0) -> str:
    from .errors import excerpt

    lines = [f"Title: {doc['title']}"]
    for n, h in enumerate(doc["top_chunks"][: max(1, chunks)], 1):
        lines += [f"Chunk {n}: {h['chunk_id']}", *([f"Section: {h['section_hint']}"] if h.get("section_hint") else []), f"Evidence: {h['text']}"]
    text = "\n".join(lines).strip()
    return (excerpt(text, limit) or "") if limit > 0 else text
