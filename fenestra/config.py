"""Configuration of a fingerprint, and the name of the retention that it implies."""

from __future__ import annotations

from dataclasses import dataclass

#: Levels and structural roles, in the order that comparisons use. Fixed values.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")
TRACE, DEBUG, INFO, WARN, ERROR, FATAL, UNKNOWN = range(7)
ROLES = ("None", "GroupBegin", "GroupEnd", "Terminator", "Progress")
NONE, GROUP_BEGIN, GROUP_END, TERMINATOR, PROGRESS = range(5)

#: Generation of the salience rules, version and schedule names of the document format. Fixed values.
SALIENCE_GENERATION = "salience-1"
VERSION = "0.10.0"
DURATION_SCHEDULE = "dur-log2-ns-v1"
ORDINAL_BINS = 48
CUBE_BUDGET = 4096
SHIFT_FLOOR = 32

KEYS = ["source", "window_id"]


@dataclass(frozen=True)
class SourceBlock:
    """Where a document's events come from; tags are pairs of key and value."""

    service: str | None = None
    fleet: str | None = None
    host_count: int | None = None
    host: str | None = None
    tags: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Config:
    top_k_size: int = 64
    reservoir_size: int = 0
    reservoir_per_kind_cap: int = 0
    reservoir_error_reserve: int = 0
    ngram_size: int = 2
    top_ngrams_size: int = 32
    max_ngram_keys: int = 4096
    trace_scoping_enabled: bool = True
    max_active_traces: int = 4096
    max_active_spans: int = 16384
    max_service_edges: int = 4096
    span_edges_size: int = 32
    max_span_edge_keys: int = 4096
    emit_stability: bool = True
    top_branching_size: int = 64
    dominant_path_max_steps: int = 8
    producer_version: str = VERSION
    source_ref: str | None = None
    canonicalization_version: str | None = None
    retention_profile: str | None = None
    ruleset: str | None = None
    transport: str | None = None
    max_param_histograms: int = 0
    max_histogram_values: int = 64
    max_text_bytes: int = 64
    source_block: SourceBlock = SourceBlock()

    def __post_init__(self) -> None:
        cap = self.max_text_bytes
        if cap < 32 or cap > 4096 or cap & (cap - 1):
            raise ValueError(f"max_text_bytes must be a power of two from 32 to 4096, not {cap}")

    @property
    def effective_ngram_size(self) -> int:
        return min(3, max(2, self.ngram_size))

    @property
    def retention_profile_name(self) -> str:
        axes = {
            "k": self.top_k_size, "m": self.reservoir_size, "c": self.reservoir_per_kind_cap, "e": self.reservoir_error_reserve,
            "n": self.effective_ngram_size, "p": self.max_param_histograms, "v": self.max_histogram_values, "l": self.max_text_bytes,
        }
        return f"{SALIENCE_GENERATION}/" + "-".join(f"{tag}{value}" for tag, value in axes.items())
