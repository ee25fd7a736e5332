"""Reports of evaluations: where the figures come from, the figures, and whether they may be published."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..settings import Settings
from ..sources import files
from . import evaluate

#: The file of each kind of report.
FILES = {
    "retrieval": "eval_results.json",
    "attribution": "attribution_results.json",
    "quality": "generation_quality_results.json",
    "corrective": "corrective_results.json",
}
#: The backends that each kind of figure depends on, and the settings that it names.
BACKENDS = {
    "retrieval": ("embedder", "reranker"),
    "attribution": ("generator", "embedder", "reranker"),
    "quality": ("generator", "scorer", "embedder", "reranker"),
    "corrective": ("generator", "corrector", "judge", "embedder", "reranker"),
}
NAMED = {
    "retrieval": ("embedding_model", "rrf_k", "top_k_dense", "top_k_sparse", "seed", "resamples"),
    "attribution": ("llm_model", "embedding_model", "top_k_rerank"),
    "quality": ("llm_model", "embedding_model", "top_k_rerank", "n_questions"),
    "corrective": ("llm_model", "embedding_model", "top_k_rerank", "max_query_rewrites", "max_regenerations", "min_relevant_docs", "min_attribution_rate"),
}


@dataclass(frozen=True)
class Backend:
    """What did a part of the work; live is false for an offline stand-in."""

    name: str
    live: bool


@dataclass(frozen=True)
class Report:
    """sections are small result tables, the shortest first when rendered."""

    kind: str
    provenance: dict
    sections: dict[str, DataFrame]

    def json(self) -> str:
        """The same results give the same bytes."""
        return evaluate.report_json({"provenance": self.provenance, **self.sections})

    def write(self, spark: SparkSession, folder: str) -> str:
        path = f"{folder}/{FILES[self.kind]}"
        files.put(spark, path, self.json())
        return path

    def render(self) -> str:
        p = self.provenance
        parts = [f"{self.kind} evaluation of {p['n_queries']} queries"]
        parts.append("  ".join(f"{part}={name}" for part, name in p["backends"].items()))
        parts.append(f"git {(p['git_sha'] or 'unknown')[:12]}  corpus {(p['corpus_sha256'] or 'unknown')[:16]} in {p['corpus_dir']}")
        parts.append("  ".join(f"{name}={value}" for name, value in p["settings"].items()))
        if not p["publishable"]:
            parts.append("Not for publication: offline stand-ins did part of the work.")
        if p["single_run"]:
            parts.append("One run of live models; another run may differ.")
        return "\n".join(parts) + "\n\n" + "\n\n".join(evaluate.render(name, table) for name, table in self.sections.items())


def provenance(kind: str, settings: Settings, meta: dict, backends: dict[str, Backend], n_queries: int) -> dict:
    """meta: what the build recorded of the index."""
    used = {part: backends[part] for part in BACKENDS[kind]}
    return {
        "backends": {part: b.name for part, b in used.items()},
        "settings": {name: getattr(settings, name) for name in NAMED[kind]},
        "git_sha": meta.get("git_sha"),
        "corpus_sha256": meta.get("corpus_sha256"),
        "corpus_dir": settings.corpus_dir,
        "library_versions": meta.get("library_versions", {}),
        "n_queries": n_queries,
        "single_run": any(b.live for part, b in used.items() if part in ("generator", "scorer", "corrector", "judge")),
        "publishable": evaluate.publishable(*(not b.live for b in used.values())),
    }
