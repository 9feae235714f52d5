"""Command line: search, index, ingest, query, read, inspect, verify, sessions, stale, serve."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Config
from .engine import Engine
from .errors import TesseraError
from .functions import fixed
from .functions import scalar as S
from .operators import state as ST


def render_table(text: str, max_rows: int = 15, width: int = 24) -> str:
    """Lines with pipes as aligned columns under a rule; separator rows are left out."""
    rows = [[c.strip() for c in line.strip().strip("|").split("|")] for line in text.split("\n") if "|" in line]
    rows = [r for r in rows if any(c.strip("-: ") for c in r)][:max_rows]
    if not rows:
        return ""
    n = max(map(len, rows))
    rows = [r + [""] * (n - len(r)) for r in rows]
    widths = [min(width, max(len(r[i]) for r in rows)) for i in range(n)]
    lines = ["  ".join(c[:w].ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n") if x.strip()]


def is_nav(text: str) -> bool:
    """Mostly short lines."""
    lines = _lines(text)
    return bool(lines) and sum(len(x) < 30 for x in lines) / len(lines) > 0.7


def is_garbage(text: str) -> bool:
    return not text or sum("\x80" <= c <= "\x9f" for c in text) / len(text) > 0.05


def render_paragraphs(text: str, max_paras: int = 3, max_chars: int = 300) -> str:
    """The first paragraphs of some length that are neither navigation nor garbage, else groups of three sentences, cut at a sentence's end."""
    paras = [p.strip() for p in re.split(r"\n{2,}", text) if len(p.strip()) > 60 and not is_nav(p) and not is_garbage(p)]
    if not paras:
        s = re.split(r"(?<=[.!?])\s+", text.strip())
        paras = [p for p in (" ".join(s[i : i + 3]) for i in range(0, len(s), 3)) if len(p.strip()) > 60]
    found = []
    for p in paras[:max_paras]:
        if len(p) > max_chars:
            cut = p[:max_chars]
            end = max(cut.rfind(x) for x in (". ", "! ", "? "))
            p = (cut[: end + 1] if end > max_chars * 0.6 else cut).strip() + "..."
        found.append(p.strip())
    return "\n\n".join(found)


def unrepeated(chunks: list[dict], least: float = 0.25) -> list[str]:
    """What reading a document shows: tables, and each paragraph of the coherent chunks once."""
    seen, found = set(), []
    for c in chunks:
        content = c["content"].strip()
        if c["coherence_score"] < least or is_garbage(content):
            continue
        if content.count("|") > 4:
            found.append(render_table(content))
            continue
        if is_nav(content):
            continue
        for p in [x for x in content.split("\n\n") if len(x.strip()) > 40] or ([content] if len(content) > 40 else []):
            p = " ".join(p.split())
            if p not in seen:
                seen.add(p)
                found.append(p)
    return found


def score_table(rows: list[dict]) -> str:
    """Chunks as aligned columns: place, score, source, title."""
    if not rows:
        return ""
    cells = [("#", "score", "source", "title")] + [(str(i), f"{shown(c):.3f}", c["source"][:40], (c["title"] or "")[:40]) for i, c in enumerate(rows, 1)]
    widths = [max(len(r[k]) for r in cells) for k in range(4)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def shown(chunk: dict) -> float:
    return 1 - chunk["distance"] if "distance" in chunk else chunk.get("coherence_score") or 0.0


def _remembered() -> str:
    return os.path.join(tempfile.gettempdir(), "tessera_last_search.json")


def remember(sources: list[dict]) -> None:
    """The results of the last search, for `read N`."""
    with open(_remembered(), "w") as f:
        json.dump([{"url": s["url"], "title": s["title"]} for s in sources], f)


def recalled(number: int) -> str:
    """The URL of a result of the last search, counted from 1."""
    try:
        with open(_remembered()) as f:
            known = json.load(f)
    except FileNotFoundError as e:
        raise TesseraError("no search is remembered", "request") from e
    if not 1 <= number <= len(known):
        raise TesseraError(f"the last search had {len(known)} results", "request")
    return known[number - 1]["url"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Retrieval analytics on Spark")
    p.add_argument("--path", default="./tessera_db")
    p.add_argument("--preset", default="full", choices=["lightweight", "fast", "full"])
    p.add_argument("--pages", help="a Parquet table of pages (url, html) that stands for the web")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "index", "verify"):
        c = sub.add_parser(name)
        c.add_argument("query")
        c.add_argument("--session", default="default")
        c.add_argument("--force-new", action="store_true")
        c.add_argument("--max-results", type=int, default=12)
        c.add_argument("--format", default="text", choices=["text", "json", "jsonl"])
    c = sub.add_parser("ingest")
    c.add_argument("source")
    c.add_argument("--session", default="default")
    c.add_argument("--table")
    c.add_argument("--query")
    c.add_argument("--force-new", action="store_true")
    c = sub.add_parser("query")
    c.add_argument("question")
    c.add_argument("--session", default="default")
    c.add_argument("-k", type=int, default=5)
    c.add_argument("--context", action="store_true")
    c.add_argument("--json", action="store_true", help="chunks as JSON")
    c.add_argument("--scores", action="store_true", help="a table of scores")
    c.add_argument("--budget", type=int)
    c = sub.add_parser("read")
    c.add_argument("source", help="a URL, a file, or the number of a result of the last search")
    c.add_argument("--raw", action="store_true", help="the whole text")
    c = sub.add_parser("inspect")
    c.add_argument("--show", default="chunks", choices=["chunks", "reputation", "lexicon", "candidates"])
    c.add_argument("--session")
    c.add_argument("--domain")
    c.add_argument("--topic")
    c.add_argument("--status")
    sub.add_parser("sessions")
    c = sub.add_parser("stale")
    c.add_argument("session")
    c.add_argument("--hours", type=float, default=24)
    c = sub.add_parser("serve")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=8000)
    return p


def inspect(engine: Engine, a: argparse.Namespace) -> list[dict]:
    """The best 20 reputations, or 15 active terms and 20 candidates, or a session's chunks by domain."""
    if a.show == "chunks":
        rows = engine.store.table(a.session).withColumn("domain", S.domain(F.col("url"))).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coherence_score"), 4).alias("coherence")).orderBy(F.desc("n"), "domain")
        return [r.asDict() for r in rows.collect()]
    if a.show == "reputation":
        return [r.asDict() for r in ST.top_reputation(engine.reputation(), a.domain or "", a.topic).collect()]
    wanted = [a.status] if a.status else ["candidate"] if a.show == "candidates" else ["active", "candidate"]
    return [r.asDict() for status in wanted for r in ST.top_terms(engine.lexicon(), status, a.topic).collect()]


def read(engine: Engine, a: argparse.Namespace) -> str:
    """The text of a page, a file or a remembered result: whole, or what is worth reading of its chunks."""
    from .operators.chunk import chunk_documents
    from .sources.files import ingest

    source = recalled(int(a.source)) if a.source.isdigit() else a.source
    if "://" in source and not source.startswith(("file:", "sqlite:")):
        docs, _ = engine.documents(engine.spark.createDataFrame([(0, source, 1)], "query_id long, url string, rank int"))
    else:
        docs = ingest(engine.spark, source)
    docs = docs.select("content", "title", "source")
    if a.raw:
        return "\n\n".join(r["content"] for r in docs.collect())
    rows = chunk_documents(docs, engine.embedder, threshold=engine.config.semantic_threshold).orderBy("source", "chunk_index").collect()
    return "\n\n".join(unrepeated([r.asDict() for r in rows]))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    pages = spark.read.parquet(a.pages) if a.pages else None
    engine = Engine(spark, Config.preset(a.preset, path=a.path), pages=pages)
    try:
        if a.command in ("search", "index", "verify"):
            r = engine.verify(a.query, a.session) if a.command == "verify" else engine.search(a.query, a.session, a.force_new, a.max_results)
            remember(r.sources)
            if a.format == "json":
                print(r.to_json())
            elif a.format == "jsonl":
                print("\n".join(json.dumps(s) for s in r.sources))
            else:
                print(f"{fixed.BADGES.get(r.topic, '◆')} {r.topic}: {r.doc_count} documents, {r.chunk_count} chunks, {r.indexed_count} indexed ({r.reason or r.status})")
                for d in r.docs:
                    print(f"- {d['title']} <{d['source']}>\n{render_table(d['content']) if d['content'].count('|') > 4 else render_paragraphs(d['content'], 1)}")
                for c in r.conflicts[:5]:
                    print(f"! {c['source_a']['url']} / {c['source_b']['url']}: newest {c['newest_source']}")
        elif a.command == "ingest":
            print(json.dumps(engine.ingest(a.source, a.session, a.force_new, **{k: v for k, v in (("table", a.table), ("query", a.query)) if v})))
        elif a.command == "query":
            if a.context:
                print(engine.build_context(a.question, a.session, a.k, a.budget).to_prompt())
            elif a.json:
                print(json.dumps(engine.query(a.question, a.session, a.k), indent=2, default=str, ensure_ascii=False))
            elif a.scores:
                print(score_table(engine.query(a.question, a.session, a.k)))
            else:
                for i, c in enumerate(engine.query(a.question, a.session, a.k), 1):
                    print(f"[{i}] {c['title']} <{c['url']}> {shown(c):.3f}\n{render_paragraphs(c['content'])}\n")
        elif a.command == "read":
            print(read(engine, a))
        elif a.command == "inspect":
            print("\n".join(json.dumps(r, default=str) for r in inspect(engine, a)))
        elif a.command == "sessions":
            print("\n".join(engine.list_sessions()))
        elif a.command == "serve":
            from .server import make_server

            make_server(engine, a.host, a.port).serve_forever()
        else:
            print("stale" if engine.is_stale(a.session, a.hours) else "fresh")
    except TesseraError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
