"""Judgements, answers, reports and their citations: plain records in, plain records out."""

from __future__ import annotations

import re
from typing import Any

from .planning import distinct, strings

LABELS = ("direct_support", "background_only", "off_target")
NO_SUPPORT = "No document found directly supports an answer to this question."


def document_key(hit: dict[str, Any]) -> str:
    return next((hit[k] for k in ("doc_id", "source_path", "title", "chunk_id") if hit.get(k)), "")


def assessment(payload: dict[str, Any], doc: dict[str, Any]) -> dict[str, Any]:
    """A judge's JSON in one form. Unknown labels are off target; only chunks of this document support it, the first one if none
    is named; direct support without a line to quote is an error."""
    label = str(payload.get("label", "off_target")).strip().lower()
    label = label if label in LABELS else "off_target"
    shown = [h["chunk_id"] for h in doc["top_chunks"]]
    support = [c for c in strings(payload.get("supporting_chunk_ids")) if c in shown]
    line = str(payload.get("answer_line") or "").strip()
    if label == "direct_support" and not line:
        raise ValueError("direct_support without an answer_line")
    return {
        "doc_id": doc["doc_id"], "label": label, "supporting_chunk_ids": support or (shown[:1] if label != "off_target" else []),
        "matched_constraints": strings(payload.get("matched_constraints")), "missing_constraints": strings(payload.get("missing_constraints")),
        "reason": str(payload.get("reason", "")).strip(), "answer_line": line if label == "direct_support" else "",
    }


def supporting_hits(judged: dict[str, Any], doc: dict[str, Any]) -> list[dict[str, Any]]:
    """The hits that an assessment names (the first if none), best first, with the constraints of both."""
    by_id = {h["chunk_id"]: h for h in doc["top_chunks"]}
    hits = [by_id[c] for c in judged["supporting_chunk_ids"] if c in by_id] or doc["top_chunks"][:1]
    both = [h | {k: distinct([*(h.get(k) or []), *judged[k]]) for k in ("matched_constraints", "missing_constraints")} for h in hits]
    return sorted(both, key=lambda h: -h["score_final"])


def answer_line(text: str) -> str:
    """Without a list number, on one line. A point right before a digit is part of a value (3.5 mg)."""
    return " ".join(re.sub(r"^\s*\d+\s*(?:\.(?!\d)|[)、])\s*", "", text).split())


def numbered(lines: list[str]) -> str:
    return "\n\n".join(f"{n}. {line}" for n, line in enumerate(lines, 1))


def merged_citation(hits: list[dict[str, Any]]) -> str:
    """One hit's citation, or the title with the place of every hit."""
    if len(hits) < 2:
        return hits[0]["citation"] if hits else ""

    def place(h):
        pages = f"p. {h['page_start']}" if h["page_start"] == h["page_end"] else f"pp. {h['page_start']}-{h['page_end']}"
        return f"{pages}, chunk {h['chunk_id'].rsplit('-', 1)[-1]}"

    return f"{hits[0]['title']} ({'; '.join(map(place, hits))})"


def numbered_citations(citations: list[str]) -> list[str]:
    return [f"[{n}] {c}" for n, c in enumerate(citations, 1)]


def assembled(docs: list[dict[str, Any]], judged: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """The answer from assessments by doc_id: a line and a citation for each document that supports it, in the documents' order."""
    lines, citations = [], []
    for doc in docs:
        found = judged.get(doc["doc_id"])
        if found is None or found["label"] != "direct_support":
            continue
        hits, line = supporting_hits(found, doc), answer_line(found["answer_line"])
        if line and hits:
            lines.append(line)
            citations.append(merged_citation(hits))
    return {"answer": numbered(lines) or NO_SUPPORT, "citations": numbered_citations(citations), "confidence": "high" if lines else "low"}


def ref_ids(value: Any, most: int) -> list[int]:
    """Whole numbers from 1 to most, each once, out of what JSON holds ("[3]" is 3)."""
    out: list[int] = []
    for item in value if isinstance(value, list) else [] if value is None else [value]:
        text = str(item).strip().strip("[]").strip()
        if re.fullmatch(r"[+-]?\d+", text) and 1 <= int(text) <= most and int(text) not in out:
            out.append(int(text))
    return out


def cited_ids(report: str) -> list[int]:
    """The numbers in the report's brackets, each once, in order."""
    return list(dict.fromkeys(int(n) for group in re.findall(r"\[([\d,\s]+)\]", report) for n in re.findall(r"\d+", group)))


def report_of(payload: dict[str, Any], most: int) -> tuple[str, list[int]]:
    """The report and its references: those in the text first, then those declared."""
    report = str(payload.get("report", "")).strip()
    if not report:
        raise ValueError("the answer holds no report")
    return report, list(dict.fromkeys([n for n in cited_ids(report) if 1 <= n <= most] + ref_ids(payload.get("used_ref_ids"), most)))


def collapsed(text: str) -> str:
    """Runs such as [1][1] [2] keep each number once."""
    return re.sub(r"(?:\[\d+\]\s*){2,}", lambda run: "".join(f"[{n}]" for n in dict.fromkeys(re.findall(r"\[(\d+)\]", run[0]))), text)


def dangling(report: str, citations: list[str]) -> list[int]:
    return sorted(n for n in cited_ids(report) if not 1 <= n <= len(citations))


def merged_report(report: str, refs: list[int], hits: list[dict[str, Any]]) -> tuple[str, list[str]]:
    """The report with references to hits renumbered by document, in the order in which `refs` names them, and a citation for
    each document over all its hits that are named. References to nothing go."""
    by_doc: dict[str, dict[str, dict[str, Any]]] = {}
    number: dict[int, int] = {}
    for ref in refs:
        if 1 <= ref <= len(hits):
            hit = hits[ref - 1]
            by_doc.setdefault(document_key(hit), {}).setdefault(hit["chunk_id"], hit)
            number[ref] = list(by_doc).index(document_key(hit)) + 1
    renumbered = re.sub(r"\[([\d,\s]+)\]", lambda m: "".join(f"[{n}]" for n in dict.fromkeys(number[int(x)] for x in re.findall(r"\d+", m[1]) if int(x) in number)), report)
    renumbered = collapsed(renumbered)
    citations = numbered_citations([merged_citation(list(chunks.values())) for chunks in by_doc.values()])
    if lost := dangling(renumbered, citations):
        raise ValueError(f"the report cites numbers that nothing stands behind: {', '.join(map(str, lost))}")
    return renumbered, citations


def token_count(text: str) -> int:
    """A quarter token for each ASCII character and one for any other, rounded up, one at least."""
    line = " ".join(text.split())
    plain = sum(c < "\x80" for c in line)
    return max(1, -(-plain // 4) + len(line) - plain)


def rerank_batches(documents: list[str], query: str, instruct: str = "", budget: int = 3600) -> list[list[int]]:
    """Positions in batches whose tokens, with the request's own, keep to the budget; one that is too long alone has its own."""
    room = max(1, max(1, budget) - (token_count(query) + token_count(instruct) + 64))
    out: list[list[int]] = []
    used = 0
    for i, d in enumerate(documents):
        n = token_count(d) + 16
        if not out or used + n > room:
            out.append([])
            used = 0
        out[-1].append(i)
        used += n
    return out
