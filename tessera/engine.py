"""The engine: search, ingest, query and context over sessions of chunks.

Each call describes DataFrames over all its queries and runs them; only the few rows that an
answer consists of come to the driver.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from . import registry
from .config import Config
from .errors import SessionNotFound, TesseraError
from .functions import scalar as S
from .index import ChunkStore, staleness
from .operators import classify as Q
from .operators import context as X
from .operators import documents as D
from .operators import rank as R
from .operators import state as ST
from .operators import telemetry as TM
from .operators.chunk import Embedder, chunk_documents, hashed_embedder
from .result import Context, Result, Trace
from .sources import providers as P
from .sources.files import ingest as read_source
from .sources.html import extract_pages

REPUTATION = [x.split()[0] for x in ST.REPUTATION_SCHEMA.split(", ")]


class Engine:
    """providers answer queries with URLs; get fetches a URL, or pages (url, html) stand for the web. embedder may be a name of the registry.

    clock gives the time in seconds; nothing else in the engine looks at one.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, providers: list | None = None, pages: DataFrame | None = None, get: Callable | None = None, embedder: Embedder | str | None = None, clock: Callable[[], float] | None = None):
        import time

        self.spark, self.config = spark, config or Config()
        self.pages, self.get, self.clock = pages, get, clock or time.time
        self.providers = providers if providers is not None else ([P.TableProvider(pages)] if pages is not None else [])
        self.embedder = registry.make("embedder", embedder) if isinstance(embedder, str) else embedder or hashed_embedder()
        self.store = ChunkStore(spark, self.config.path, self.embedder)
        self.used: DataFrame | None = None
        self._writing = threading.Lock()  # searches run beside each other, but one at a time changes the tables

    # -- state tables
    def _state(self, name: str, schema: str) -> DataFrame:
        path = f"{self.config.path.rstrip('/')}/{name}"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        versions = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        return self.spark.read.schema(schema).parquet(f"{path}/{versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    def _save(self, name: str, rows: DataFrame) -> None:
        """Each write is a new version beside the last, so that a failed one leaves the state as it was."""
        path = f"{self.config.path.rstrip('/')}/{name}"
        rows.write.mode("errorifexists").parquet(f"{path}/v{int(self.clock() * 1e6):020d}")

    def reputation(self) -> DataFrame:
        return self._state("reputation", ST.REPUTATION_SCHEMA)

    def lexicon(self) -> DataFrame:
        return self._state("lexicon", ST.LEXICON_SCHEMA)

    def _queries(self, queries: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")

    def _now(self) -> str:
        import datetime

        return datetime.datetime.fromtimestamp(self.clock(), datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S")

    # -- search
    def classify(self, queries: list[str]) -> DataFrame:
        lexicon = None
        if self.config.use_lexicon:
            lexicon = ST.weighted_terms(self.lexicon().filter("status = 'active'"), self.clock()).select("topic", "term", "weight")
        return Q.predict(self._queries(queries), lexicon=lexicon)

    def discover(self, query: str, max_results: int) -> tuple[DataFrame, str]:
        """(url rows in the order to fetch them, topic)."""
        told = self.classify([query]).first()
        topic = told["topic"]
        one = self._queries([query]).withColumn("topic", F.lit(topic)).withColumn("ambiguous", F.lit(bool(told["ambiguous"])))
        if self.config.use_query_intelligence:
            expansions = ST.expand_queries(one, self.lexicon(), self.clock()) if self.config.use_lexicon else None
            asked = Q.variants(one, expansions=expansions).select(F.col("rank").cast("long").alias("query_id"), F.col("text").alias("query"))
        else:
            asked = one.select("query_id", "query")
        hits = P.search(asked, self.providers, max_results)
        urls = P.first_urls(hits.withColumn("variant", F.col("query_id")).withColumn("query_id", F.lit(0)), "variant", "place").withColumn("topic", F.lit(topic)).withColumn("pos", F.col("variant") * 1000 + F.col("place"))
        known = self.reputation().select("domain", "topic", "retrieval_confidence") if self.config.use_reputation else None
        return R.select_urls(urls.select("query_id", "topic", "pos", "url"), known, max_results), topic

    def documents(self, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(documents with url and pos, fetch telemetry) of the selected URLs."""
        if self.pages is not None and self.get is None:
            found = urls.select("url", "rank").join(self.pages.select("url", "html").dropDuplicates(["url"]), "url", "left")
            telemetry = found.select(S.domain(F.col("url")).alias("domain"), F.lit(0.0).alias("latency"), F.col("html").isNull().alias("failed"), F.lit(False).alias("rate_limited"))
            docs = extract_pages(found, self.config.max_chars, self._now(), keep=["rank"])
        else:
            tried = P.fetch(urls, self.config.max_chars, get=self.get, session_timeout=self.config.session_timeout).cache()
            telemetry = tried.select("domain", "latency", "failed", "rate_limited")
            docs = tried.filter("content is not null").join(urls.select("url", "rank"), "url").withColumn("timestamp", S.or_default(F.col("timestamp"), self._now())).select("rank", "content", "source", "title", "timestamp", "author", "image")
        docs = D.dedup_documents(docs, "rank") if self.config.use_dedup else docs
        return docs, telemetry

    def search(self, query: str, session: str, force_new: bool = False, max_results: int | None = None, mode: str = "simple") -> Result:
        """Finds, fetches, chunks, judges and indexes pages for a query."""
        trace = Trace(mode)
        result = Result(session=session, query=query, mode=mode, trace=trace)
        with trace.step("total"):
            with trace.step("fetch"):
                urls, topic = self.discover(query, max_results or self.config.max_results)
                docs, telemetry = self.documents(urls)
                docs = docs.cache()
                result.docs = [r.asDict() for r in docs.orderBy("rank").collect()]
            result.topic = trace.found["topic"] = topic
            result.doc_count = trace.found["doc_count"] = len(result.docs)
            if not result.docs:
                result.reason = "no_docs"
                return result
            with trace.step("chunk"):
                chunks = chunk_documents(docs, self.embedder, max_tokens=self.config.chunk_size, dedupe=self.config.dedupe_threshold, threshold=self.config.semantic_threshold).withColumn("domain", S.domain(F.col("source"))).cache()
                result.chunk_count = trace.found["chunk_count"] = chunks.count()
            if not result.chunk_count:
                result.reason = "no_chunks"
                return result
            stats = None
            if self.config.use_quality_evaluator:
                judged = D.evaluate_chunks(chunks)
                domains = D.domain_quality(judged).cache()
                verdict = D.session_quality(domains).first()
                stats = TM.chunk_records(domains)
                if not verdict["accepted"]:
                    result.reason = "quality_gate_failed"
                    return result
            if self.config.use_recency_ranking:
                chunks = R.rank_recency(chunks, F.lit(self._now()).cast("timestamp"), F.lit(topic), self.config.recency_weight, self.config.recency_decay_days)
            with trace.step("embed"), self._writing:
                counts = self.store.add(chunks, session, self._now(), force_new)
            result.indexed_count = counts["indexed"]
            result.sources = [{"url": d["source"], "title": d["title"], "timestamp": d["timestamp"]} for d in result.docs]
            if self.config.use_reputation and stats is not None:
                with self._writing:
                    self.learn(query, topic, telemetry, stats)
            result.success, result.status = True, "ok"
        return result

    def learn(self, query: str, topic: str, telemetry: DataFrame, chunk_stats: DataFrame) -> None:
        """Updates reputation with a search's signals, and the lexicon with those that did well."""
        signals = TM.with_chunks(TM.by_domain(telemetry), chunk_stats).select("domain", F.lit(topic).alias("topic"), *ST.METRICS, F.lit(float(self.clock())).alias("at"))
        old = self.reputation()
        new = ST.update_reputation(signals, old.join(signals.select("domain", "topic"), ["domain", "topic"], "left_semi")).cache()
        self._save("reputation", ST.upsert(old, new, ["domain", "topic"]))
        if self.config.use_lexicon:
            heard = ST.notify(new).select(F.lit(query).alias("query"), "topic", F.col("retrieval_confidence").alias("confidence"), F.col("last_updated").alias("at"), "domain")
            terms = ST.observed(heard).drop("query")
            known = self.lexicon()
            learned = ST.observe_terms(terms, known.join(terms.select("term", "topic").distinct(), ["term", "topic"], "left_semi"), ("at", "domain")).cache()
            if not learned.isEmpty():
                self._save("lexicon", ST.upsert(known, learned, ["term", "topic"]))

    def parallel_search(self, plan: list[dict]) -> list[Result]:
        """All items at once, each on its own; an error becomes a result."""
        def one(item: dict) -> Result:
            try:
                return self.search(item["query"], item["session"], item.get("force_new", False), mode="parallel")
            except TesseraError as e:
                return Result(query=item["query"], session=item["session"], mode="parallel", error=str(e), reason=e.code)

        if not plan:
            return []
        with ThreadPoolExecutor(min(8, len(plan))) as pool:
            return list(pool.map(inheritable_thread_target(self.spark)(one), plan))

    def sequential_search(self, steps: list[dict]) -> list[Result]:
        """In order; a step that depends on a session gets a line of its best chunk put into its query."""
        found = []
        for step in steps:
            query = step["query"]
            if step.get("depends_on"):
                k = step.get("inject_top_k", 3)
                best = D.injectable(self.store.search(step["depends_on"], self._queries([query]), 2 * k))
                best = R.rerank(best.withColumn("query", F.lit(query)), k, R.lexical_scorer(F.col("query"), F.col("content")), "rank").first()
                if best:
                    query = self._queries([query]).select(S.inject_context(F.col("query"), F.lit(best["content"])).alias("q")).first()["q"]
            found.append(self.search(query, step["session"], step.get("force_new", False), mode="sequential"))
        return found

    def verify(self, query: str, session: str) -> Result:
        """A fresh search, and the pairs of its documents whose months differ."""
        result = self.search(query, session, force_new=True, mode="verify")
        if result.docs:
            docs = self.spark.createDataFrame([(session, i, d["source"], d["timestamp"], d["content"]) for i, d in enumerate(result.docs)], "session string, pos int, source string, timestamp string, content string")
            result.conflicts = [r.asDict(True) for r in D.conflicts(docs).collect()]
            result.status = "conflict" if result.conflicts else "consistent"
        return result

    # -- ingest and read
    def ingest(self, source: str, session: str, force_new: bool = False, **options) -> dict:
        docs = read_source(self.spark, source, now=options.pop("now", self._now()), **options)
        chunks = chunk_documents(docs, self.embedder, max_tokens=self.config.chunk_size, threshold=self.config.semantic_threshold).cache()
        n = chunks.count()
        if not n:
            return {"success": False, "docs": docs.count(), "chunks": 0, "indexed": 0}
        return {"success": True, "docs": docs.count(), "chunks": n, "indexed": self.store.add(chunks, session, self._now(), force_new)["indexed"]}

    def query_session(self, query: str, session: str, k: int = 5) -> list[dict]:
        """The nearest chunks, not reranked."""
        return [r.asDict() for r in self.store.search(session, self._queries([query]), k).orderBy("rank").collect()]

    def _ranked(self, query: str, session: str, k: int) -> DataFrame:
        near = self.store.search(session, self._queries([query]), 2 * k)
        if self.config.use_reranker:
            scorer = R.lexical_scorer(F.lit(query), F.col("content"))
            return R.rerank(near, k, scorer, "rank")
        return near.orderBy(F.desc("coherence_score"), "rank").limit(k)

    def query(self, query: str, session: str, k: int = 5) -> list[dict]:
        return [r.asDict() for r in self._ranked(query, session, k).collect()]

    def build_context(self, query: str, session: str, k: int = 10, token_budget: int | None = None) -> Context:
        topic = self.classify([query]).first()["topic"]
        chunks = self.spark.createDataFrame([(0, i, r["content"], r["source"], r["title"], r["chunk_index"], r["coherence_score"]) for i, r in enumerate(self.query(query, session, k))], "query_id long, pos int, content string, source string, title string, chunk_index int, coherence_score double")
        known = None
        if self.config.use_reputation:
            keys = chunks.select(S.domain(F.col("source")).alias("domain"), F.lit(topic).alias("topic")).distinct()
            known = ST.confidences(keys, self.reputation(), self.clock())
        budget = min(token_budget or X.BUDGET, X.BUDGET)
        rows = [r.asDict() for r in X.build_context(chunks, budget, known, self.used).orderBy("place").collect()]
        if rows:
            now = self.spark.createDataFrame([(0, r["fingerprint"]) for r in rows], "query_id long, fingerprint string")
            self.used = now if self.used is None else self.used.union(now)
        return Context(query, rows, budget)

    def reset_session(self) -> None:
        self.used = None

    def is_stale(self, session: str, max_age_hours: float = 24) -> bool:
        try:
            rows = self.store.table(session).select("session", "timestamp")
        except SessionNotFound:
            return True
        return staleness(rows, F.lit(self._now()).cast("timestamp"), max_age_hours).first()["stale"]

    def list_sessions(self) -> list[str]:
        return self.store.sessions()

    def delete_session(self, session: str) -> None:
        self.store.delete(session)

    def export_reputation(self, path: str) -> None:
        """All reputation rows as JSON lines, best first."""
        ST.reputation_summary(self.reputation()).write.mode("overwrite").json(path)

    def answer(self, query: str, session: str, k: int = 5) -> Result:
        """The best chunks as a result, with the topic and the time it took."""
        trace = Trace("query")
        with trace.step("total"), trace.step("rerank"):
            chunks = self.query(query, session, k)
        trace.found |= {"topic": self.classify([query]).first()["topic"], "chunk_count": len(chunks)}
        sources = [{"url": u} for u in dict.fromkeys(c["source"] for c in chunks)]
        return Result(True, session, query, "query", chunks, sources, chunk_count=len(chunks), topic=trace.found["topic"], trace=trace, status="ok")

    def llm_context(self, query: str, session: str, k: int = 5) -> str:
        """A prompt block of numbered chunks for a language model."""
        return self.answer(query, session, k).to_llm()["prompt_ready"]

    def with_preset(self, name: str) -> Engine:
        """The same engine under another preset."""
        other = Engine(self.spark, Config.preset(name, path=self.config.path), self.providers, self.pages, self.get, self.embedder, self.clock)
        other._writing = self._writing
        return other
