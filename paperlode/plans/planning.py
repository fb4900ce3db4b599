"""The query plan: what a planner's JSON says, brought to one form, and what stands in for what it leaves out."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

MODES = ("keyword", "vector", "hybrid")
BUNDLES, GROUP, FROM_MUST_HAVE = 8, 6, 6

#: The default bundles. For each: its name, then (kind of term, how many) for the query, the phrases and the required terms.
DEFAULTS = (
    ("exact_condition", (("conditions", 3), ("entities", 3)), (("conditions", 3), ("entities", 2)), (("conditions", 3), ("entities", 2))),
    ("numeric_condition", (("numbers", 3), ("entities", 3)), (("numbers", 3), ("entities", 2)), (("numbers", 3), ("conditions", 2), ("entities", 2))),
    ("domain_entity", (("entities", 4), ("relations", 2), ("conditions", 1)), (("entities", 4),), (("entities", 3), ("conditions", 1))),
    ("mechanistic_variant", (("relations", 3), ("entities", 3), ("conditions", 2)), (("relations", 3), ("entities", 2), ("conditions", 1)), (("entities", 2), ("conditions", 2))),
)


def distinct(values: Iterable[str]) -> list[str]:
    """In order, blanks dropped; equal up to case and punctuation counts once."""
    first: dict[str, str] = {}
    for v in map(str.strip, values):
        if v:
            first.setdefault(re.sub(r"\W+", "", v.lower()), v)
    return list(first.values())


def strings(value: Any) -> list[str]:
    """A flat list of distinct strings from whatever JSON holds."""
    if value is None:
        return []
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, (list, tuple)):
        return distinct(s for v in value for s in strings(v))
    return [s] if (s := str(value).strip()) else []


def groups(value: Any) -> list[list[str]]:
    """Groups of strings; a plain value is a group of its own."""
    items = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else [value]
    return [g for g in map(strings, items) if g]


def query_key(query: str) -> str:
    """By which queries count as the same."""
    return re.sub(r"[^\w一-鿿]+", " ", query.lower()).strip()


@dataclass
class Bundle:
    name: str
    query: str
    phrases: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)


def bundles(value: Any) -> list[Bundle]:
    """Bundles from a list, a mapping of names, or a query; without a query, or with one met before, they are left out."""
    if isinstance(value, str):
        value = [value]
    if isinstance(value, dict):
        named = [(str(k), v) for k, v in value.items()]
    else:
        named = [(f"bundle_{n}", v) for n, v in enumerate(value if isinstance(value, list) else [], 1)]
    out = []
    for name, item in named:
        item = item if isinstance(item, dict) else {"query": item}
        query = str(item.get("query") or "").strip()
        if query:
            own = str(item.get("bundle_name") or name).strip()
            out.append(Bundle(own or "bundle", query, strings(item.get("keyword_phrases")), strings(item.get("required_terms"))))
    return merged(out)


def merged(*lists: list[Bundle], most: int | None = None) -> list[Bundle]:
    first: dict[str, Bundle] = {}
    for b in (b for bs in lists for b in bs):
        first.setdefault(query_key(b.query), b)
    return list(first.values())[:most]


def default_bundles(terms: dict[str, list[str]]) -> list[Bundle]:
    out = []
    for name, *picks in DEFAULTS:
        query, phrases, required = (distinct(t for kind, n in pick for t in terms[kind][:n]) for pick in picks)
        if query:
            out.append(Bundle(name, " ".join(query), phrases, required))
    return out


@dataclass
class Plan:
    """What to look for: bundles of queries, and the terms that hits are rescored by."""

    target: str
    question: str = ""
    entities: list[str] = field(default_factory=list)
    conditions: list[str] = field(default_factory=list)
    relations: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    must_have: list[str] = field(default_factory=list)
    optional: list[str] = field(default_factory=list)
    variants: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    groups: list[list[str]] = field(default_factory=list)
    bundles: list[Bundle] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    evidence: str = "direct_support"
    language: str = "en"
    intent: str = "literature_qa"
    analysis: str = ""
    mode: str = "hybrid"
    top_k_vector: int = 30
    top_k_keyword: int = 30

    @property
    def hard(self) -> list[str]:
        """Conditions and numbers together: equal up to case counts once."""
        first: dict[str, str] = {}
        for t in self.conditions + self.numbers:
            first.setdefault(t.strip().lower(), t.strip())
        return [t for t in first.values() if t]

    def snapshot(self) -> dict[str, Any]:
        """For diagnostics."""
        return self._terms() | {"query_bundles": [{"bundle_name": b.name, "query": b.query, "keyword_phrases": b.phrases, "required_terms": b.required} for b in self.bundles], "must_match_groups": self.groups}

    def _terms(self) -> dict[str, Any]:
        return {"target_claim": self.target, "evidence_type": self.evidence, "entity_terms_en": self.entities, "condition_terms_en": self.conditions, "relation_terms_en": self.relations, "numeric_constraints": self.numbers}

    def brief(self, with_bundles: bool = False) -> dict[str, Any]:
        """For a prompt: the head of every list."""
        most = {"entity_terms_en": 5, "condition_terms_en": 6, "relation_terms_en": 5, "numeric_constraints": 4}
        out = {k: v[: most[k]] if k in most else v for k, v in self._terms().items()}
        out |= {"question_language": self.language, "must_match_groups": [g[:5] for g in self.groups[:3]]}
        if with_bundles:
            out["query_bundles"] = [{"bundle_name": b.name, "query": b.query, "required_terms": b.required[:4]} for b in self.bundles[:5]]
        return out


def _word(payload: dict[str, Any], name: str, default: str) -> str:
    return str(payload.get(name, default)).strip() or default


def _at_least_one(value: Any, default: int) -> int:
    try:
        return max(1, int(value))
    except (TypeError, ValueError):
        return default


def make_plan(question: str, payload: dict[str, Any], top_k_vector: int = 30, top_k_keyword: int = 30) -> Plan:
    """A planner's JSON in one form: missing term lists fall back on one another, default bundles are added, queries are distinct."""
    target = str(payload.get("target_claim") or "").strip()
    if not target:
        raise ValueError("the plan has no target_claim")
    terms = {k: strings(payload.get(name)) for k, name in (("entities", "entity_terms_en"), ("conditions", "condition_terms_en"), ("relations", "relation_terms_en"), ("numbers", "numeric_constraints"))}
    must = strings(payload.get("must_have_terms"))
    terms["entities"] = terms["entities"] or must[:FROM_MUST_HAVE]
    found = merged(bundles(payload.get("query_bundles")), default_bundles(terms), most=BUNDLES)
    if not found:
        raise ValueError("the plan has no query_bundles")
    either = distinct(terms["conditions"] + terms["numbers"])
    mode = str(payload.get("mode", "hybrid")).strip().lower()
    return Plan(
        target=target,
        question=str(payload.get("original_question") or question).strip(),
        **terms,
        must_have=distinct(must + [t for k in ("entities", "conditions", "relations", "numbers") for t in terms[k]]),
        optional=strings(payload.get("optional_terms")),
        variants=distinct(strings(payload.get("query_variants")) + [b.query for b in found]),
        phrases=distinct(strings(payload.get("keyword_phrases")) + [p for b in found for p in b.phrases]),
        groups=groups(payload.get("must_match_groups")) or [g[:GROUP] for g in (terms["entities"], either, terms["relations"]) if g],
        bundles=found,
        notes=strings(payload.get("diagnostic_notes")),
        evidence=_word(payload, "evidence_type", "direct_support"),
        language=_word(payload, "question_language", "zh" if re.search("[一-鿿]", question) else "en"),
        intent=_word(payload, "intent_type", "literature_qa"),
        analysis=str(payload.get("analysis", "")).strip(),
        mode=mode if mode in MODES else "hybrid",
        top_k_vector=_at_least_one(payload.get("top_k_vector", top_k_vector), top_k_vector),
        top_k_keyword=_at_least_one(payload.get("top_k_keyword", top_k_keyword), top_k_keyword),
    )
