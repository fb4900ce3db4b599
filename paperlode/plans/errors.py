"""What a question can fail by."""

from __future__ import annotations

from typing import Any

#: By these a provider's error says that it is under pressure.
PRESSURE = ("429", "timed out", "timeout", "too many requests", "rate limit", "engine is currently overloaded", "engine_overloaded_error", "overloaded", "temporarily unavailable", "temporary failure")


def excerpt(text: str | None, limit: int = 800) -> str | None:
    """The head of a text on one line; null for none. A limit of zero or less keeps all of it."""
    line = " ".join((text or "").split())
    if limit > 0 and len(line) > limit:
        line = line[: limit - 3].rstrip() + "..." if limit > 3 else line[:limit]
    return line or None


class StageError(RuntimeError):
    """A stage of a question failed: setup, analyze, rerank, judge_document, research_rerank, research_generate or scan_completed."""

    def __init__(self, stage: str, question: str, cause: Exception | str, plan=None, **extra: Any):
        super().__init__(str(cause).strip() or f"{stage} failed")
        self.stage, self.question, self.cause, self.plan, self.extra = stage, question, cause, plan, extra
        raw = getattr(cause, "raw_response", None)
        self.raw_response = raw if isinstance(raw, str) else None

    def diagnostics(self) -> dict[str, Any]:
        out: dict[str, Any] = {"stage": self.stage, "message": str(self), "question": self.question}
        if self.plan is not None:
            out["query_analysis"] = self.plan.snapshot()
        if (raw := excerpt(self.raw_response)) is not None:
            out["raw_response_excerpt"] = raw
        return out | self.extra

    @property
    def pressure(self) -> bool:
        """Whether the provider, not the request, is at fault."""
        said = f"{self}\n{self.raw_response or ''}".lower()
        return any(p in said for p in PRESSURE)


class MissingService(StageError):
    """A question needs a service that no setting and no caller gives."""

    def __init__(self, question: str, *needs: str):
        super().__init__("setup", question, f"needed and not configured: {' and '.join(needs)}")
