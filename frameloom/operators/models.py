"""The places where a model is plugged in, by kind and name.

A model is a function that makes a Column from Columns, or a DataFrame from
DataFrames, so that it becomes part of the plan; one that calls out wraps a
Pandas UDF. The stand-ins registered here are deterministic and stay in the
JVM where they can.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.text import STOP_CONFIRM, coverage, tokenize, term_set, yes_no
from frameloom.functions.timefmt import scene_number
from frameloom.functions.vector import hash_embed
from frameloom.operators import gate, health, retrieval

#: What a model of each kind is called with and gives.
KINDS = {
    "embedder": "(text, dims) -> array<double>",
    "reranker": "(candidates, query words, text column) -> candidates with rerank_score",
    "vectors": "(rows, query vector, k) -> the k most similar rows with ann_score",
    "gate": "(windows) -> windows with passed, reason, score",
    "captioner": "(window id) -> caption",
    "confirmer": "(caption, task text) -> boolean; false where it cannot say",
    "language": "(prompt) -> answer",
    "verifier": "(requests, results) -> requests with state and confidence",
    "analyser": "(range id, question) -> answer",
    "verdict": "(state, confidence) -> verified, retracted or null",
}
_MODELS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, make: Callable, *, replace: bool = False) -> None:
    """Add a model; an unknown kind, or a name that is taken, raises."""
    if kind not in KINDS:
        raise ValueError(f"no kind {kind!r}; there are {', '.join(sorted(KINDS))}")
    if (kind, name) in _MODELS and not replace:
        raise ValueError(f"{kind} {name!r} is there already")
    _MODELS[kind, name] = make


def model(kind: str, name: str) -> Callable:
    """The model of that name; an unknown one raises with those there are."""
    if (kind, name) not in _MODELS:
        raise ValueError(f"no {kind} {name!r}; there are {', '.join(sorted(n for k, n in _MODELS if k == kind)) or 'none'}")
    return _MODELS[kind, name]


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _MODELS if k == kind)


def _passthrough(windows: DataFrame, **_) -> DataFrame:
    return windows.withColumn("passed", F.lit(True)).withColumn("reason", F.lit("passthrough")).withColumn("score", F.lit(None).cast("double"))


def _covers(caption: Column, wanted: Column, least: float = 0.5) -> Column:
    return F.coalesce(coverage(term_set(wanted, STOP_CONFIRM), term_set(caption, STOP_CONFIRM)) >= least, F.lit(False))


def _from_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    return requests.join(results.select("job_id", "state", "confidence"), "job_id", "left")


register("embedder", "hashing", lambda text, dims=768: hash_embed(tokenize(text), dims))
register("reranker", "lexical", lambda rows, words, text_col="caption": retrieval.lexical_rerank(rows, words, text_col=text_col))
register("vectors", "scan", lambda rows, query, k=60: retrieval.cosine_topk(rows, query, id_col="chunk_id", vec_col="embedding", k=k))
register("gate", "motion", gate.decide)
register("gate", "passthrough", _passthrough)
register("captioner", "stub", lambda key: F.format_string("scene %d", scene_number(key)))
register("confirmer", "stub", _covers)
register("confirmer", "answer", lambda answer, _wanted: yes_no(answer))
register("language", "echo", lambda prompt: prompt)
register("verifier", "results", _from_results)
register("verifier", "none", lambda requests, _results=None: requests.withColumn("state", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double")))
register("analyser", "stub", lambda key, _question: F.format_string("scene %d", scene_number(key)))
register("verdict", "threshold", health.verdict)
