"""Typed results, and the time that steps took."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, fields

STEPS = ("fetch", "chunk", "embed", "rerank", "total")


class Trace:
    """Milliseconds by step, and what a search came to."""

    def __init__(self, mode: str = "simple"):
        self.spent = dict.fromkeys(STEPS, 0.0)
        self.found = {"doc_count": 0, "chunk_count": 0, "topic": "", "mode": mode}

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.spent[name] += (time.monotonic() - began) * 1000

    def to_dict(self) -> dict:
        return {f"{k}_ms": v for k, v in self.spent.items()} | self.found

    def summary(self) -> str:
        times = " ".join(f"{k}={self.spent[k]:.0f}ms" for k in ("total", "fetch", "chunk", "embed", "rerank"))
        return f"{times} docs={self.found['doc_count']} chunks={self.found['chunk_count']}"


def dumped(value, indent: int | None = None) -> str:
    return json.dumps(value, indent=indent, default=str, ensure_ascii=False)


class Rendered:
    """Text forms of what to_dict() gives, and of the chunks."""

    query: str
    chunks: list[dict]

    def to_dict(self) -> dict:
        raise NotImplementedError

    def envelope(self) -> dict:
        return {"query": self.query}

    def to_json(self, indent: int = 2) -> str:
        return dumped(self.to_dict(), indent)

    def to_jsonl(self) -> str:
        """A line per chunk: the envelope's fields, then the chunk's, which win."""
        return "\n".join(dumped(self.envelope() | c) for c in self.chunks)

    def to_mongodb(self, session: str = "") -> dict:
        return self.to_dict() | {"_id": f"{session}:{self.query[:40]}"}


@dataclass
class Context(Rendered):
    """A built context: its chunks in order, and how much of the budget they take."""

    query: str
    chunks: list[dict] = field(default_factory=list)
    budget: int = 3000
    truncated: bool = False

    @property
    def total_tokens(self) -> int:
        return sum(c["tokens"] for c in self.chunks)

    @property
    def sources(self) -> list[str]:
        return list(dict.fromkeys(c["domain"] for c in self.chunks))

    def to_prompt(self) -> str:
        return "\n\n".join(f"[Source: {c['domain']} | Score: {c['score']:.2f} | Chunk: {c['chunk_index']}]\n{c['content']}" for c in self.chunks)

    def to_dict(self) -> dict:
        return {"query": self.query, "chunks": self.chunks, "total_tokens": self.total_tokens, "token_budget": self.budget, "utilization": round(self.total_tokens / self.budget, 3) if self.budget else 0.0, "sources": self.sources, "truncated": self.truncated}

    def summary(self) -> str:
        return f"{len(self.chunks)} chunks, {self.total_tokens} of {self.budget} tokens, {len(self.sources)} sources"


@dataclass
class Result(Rendered):
    success: bool = False
    session: str = ""
    query: str = ""
    mode: str = "simple"
    chunks: list[dict] = field(default_factory=list)
    sources: list[dict] = field(default_factory=list)
    docs: list[dict] = field(default_factory=list)
    context: Context | None = None
    doc_count: int = 0
    chunk_count: int = 0
    indexed_count: int = 0
    topic: str = ""
    trace: Trace = field(default_factory=Trace)
    error: str | None = None
    reason: str | None = None
    status: str | None = None
    conflicts: list[dict] = field(default_factory=list)

    def __bool__(self) -> bool:
        return self.success

    def to_dict(self) -> dict:
        """Everything but the documents and the context, which may be long."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("docs", "context", "trace")} | {"trace": self.trace.to_dict()}

    def envelope(self) -> dict:
        return {"session": self.session, "query": self.query, "topic": self.topic}

    def to_mongodb(self, session: str = "") -> dict:
        return super().to_mongodb(session or self.session)

    def to_prompt(self, most: int = 5, max_chars: int = 600) -> str:
        """The built context's prompt, else the first chunks with their titles and sources."""
        if self.context:
            return self.context.to_prompt()
        return "\n\n".join(f"[{i}] {c.get('title', '')}\nSource: {c.get('source', '')}\n{c.get('content', '')[:max_chars]}" for i, c in enumerate(self.chunks[:most], 1))

    def to_llm(self, question: str | None = None) -> dict:
        """For a language model: numbered chunks with their confidence, what is known of the search, and a prompt."""
        asked = question or self.query
        listed = [{"index": i, "source": c.get("source") or c.get("url") or "unknown", "confidence": round(c.get("score", c.get("coherence_score", 0.0)) or 0.0, 3), "text": c.get("text", c.get("content", ""))} for i, c in enumerate(self.chunks, 1)]
        return {
            "query": asked, "session": self.session, "topic": self.topic, "retrieved_chunks": len(listed), "sources_count": len(self.sources), "timing": self.trace.summary(), "conflicts": self.conflicts, "context": listed, "prompt_ready": prompt_block(asked, listed),
        }


def prompt_block(question: str, listed: list[dict]) -> str:
    if not listed:
        return f"[NO CONTEXT AVAILABLE]\nQuestion: {question}"
    head = ["[RETRIEVAL CONTEXT]", f"question: {question}", f"chunks: {len(listed)}", ""]
    body = [line for c in listed for line in (f"[{c['index']}] {c['source']} — confidence {c['confidence']}", c["text"].strip(), "")]
    return "\n".join([*head, *body, "[END CONTEXT]"])


