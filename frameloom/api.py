"""One entry point over a set of tables: the public queries of the survey's §2.11, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import text as tx
from frameloom.functions.timefmt import iso
from frameloom.operators import funnel, health, logs, retrieval, timeline


@dataclass(frozen=True)
class Engine:
    """Tables in the shapes of ``frameloom.plans``: chunks, segments, the action log and jobs (one row per state)."""

    chunks: DataFrame
    segments: DataFrame
    log: DataFrame
    jobs: DataFrame

    def search(self, query: str, vector=None, **options) -> DataFrame:  # Q1
        return retrieval.search(self.chunks, query, vector, **options)

    def browse(self, **options) -> tuple[DataFrame, DataFrame]:  # Q4
        return retrieval.browse(self.chunks, **options)

    def strip(self, t_from, t_to) -> DataFrame:  # Q6, by time
        return timeline.strip(self.chunks, t_from, t_to)

    def stats(self) -> DataFrame:  # Q7
        return health.gate_health(health.index_counts(self.chunks))

    def log_range(self, t_from: int, t_to: int) -> DataFrame:  # Q8
        return logs.range_read(self.log, t_from, t_to)

    def resolved(self, t_from: int, t_to: int) -> DataFrame:  # Q9
        cols = self.log.columns
        return logs.fold(self.log_range(t_from, t_to).select(*cols))

    def resolve(self, entry_id: str) -> DataFrame:  # Q10, by any entry of the chain
        roots = logs.with_roots(self.log).filter(F.col("entry_id") == entry_id).select("root")
        return logs.fold(self.log).join(roots, "root", "left_semi")

    def tiles(self, requests: DataFrame) -> DataFrame:  # Q11
        return timeline.tile_ranges(requests, self.segments)

    def clip(self, requests: DataFrame) -> DataFrame:  # Q32, the plan
        return timeline.clip_plan(timeline.require_complete(self.tiles(requests)))

    def retention(self, now_us: int, older_than_s: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:  # Q24, Q25
        plan = health.retention_plan(self.segments, now_us=now_us, older_than_s=older_than_s)
        return plan, health.doomed_chunks(self.chunks, now_us=now_us, older_than_s=older_than_s), health.retention_blockers(self.jobs, now_us=now_us, older_than_s=older_than_s)

    def amend(self, changes: DataFrame) -> DataFrame:  # Q29
        return logs.amend(self.log, changes)

    def fire(self, requests: DataFrame, pad_s: float = 5.0) -> DataFrame:  # Q28
        return funnel.brakes(requests, pad_s=pad_s)

    def ask(self, question: str, vector=None, **options) -> DataFrame:
        """A turn without a model: hits, whether they ground an answer, the answer, and whether to watch again (Q16 to Q18).

        One row: grounded, coverage, missing (details asked for and not seen),
        answer, escalate. No hits are not grounded.
        """
        hits = self.search(question, vector, **options)
        q = F.lit(question)
        got = hits.agg(
            F.count(F.lit(1)).alias("n"),
            F.array_distinct(F.flatten(F.collect_list(tx.tokenize("caption")))).alias("seen"),  # of at most top_n hits
            F.min_by(F.concat(iso("t_start"), F.lit(" .. "), iso("t_end"), F.lit(" (UTC): "), "caption"), "rank").alias("best"),
        )
        wanted = tx.answer_terms(q)
        missing = tx.missing_details(q, F.col("seen"))
        cov = tx.coverage(wanted, F.col("seen"))
        details = F.array_intersect(wanted, F.array(*[F.lit(w) for w in tx.DETAIL_TERMS]))
        return got.select(
            ((F.col("n") > 0) & (F.size(missing) == 0) & (cov >= 0.6)).alias("grounded"),
            F.round(cov, 6).alias("coverage"),
            missing.alias("missing"),
            F.when(F.col("n") == 0, "No caption of that range matches the question.").otherwise(F.concat(F.lit("Closest caption: "), "best")).alias("answer"),
            (F.size(details) > 0).alias("escalate"),
        )

    def dispatch(self, name: str, **arguments) -> DataFrame:
        """A tool by name (Q21); an unknown one raises."""
        tools = {"search_index": self.search, "browse": self.browse, "read_log": self.log_range, "resolve": self.resolve, "tiles": self.tiles, "ask": self.ask}
        if name not in tools:
            raise KeyError(f"no tool {name!r}")
        return tools[name](**arguments)
