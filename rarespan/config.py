"""Parameters of the engine, with their documented defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Mating:
    """How matches of a query read are counted."""

    kernel: str = "kmer"  # or "alignment"
    k: int = 24
    overlap: float = 0.5  # of the shorter read
    similarity: float = 0.95
    both_strands: bool = True  # alignment only; k-mers always use both
    n_mismatch: bool = False  # N against N is a mismatch too
    n_wildcard: bool = False  # N matches anything
    literal_reverse: bool = False  # the historic reverse complement that loses a base
    on_short: str = "error"  # reads shorter than k: "error" or "drop"

    def __post_init__(self):
        checks = (
            (self.kernel in ("kmer", "alignment"), "kernel is kmer or alignment"),
            (1 <= self.k <= 32, "k is 1 to 32"),
            (0 < self.overlap <= 1, "overlap is above 0, at most 1"),
            (0 < self.similarity <= 1, "similarity is above 0, at most 1"),
            (self.on_short in ("error", "drop"), "on_short is error or drop"),
        )
        for ok, what in checks:
            if not ok:
                raise ValueError(what)


@dataclass(frozen=True)
class Sampling:
    """The query set and the rarefaction grid."""

    max_queries: int | None = None  # 10000 for k-mers, 1000 for alignments
    query_portion: float = 0.0  # overrides max_queries when above 0
    replicates: int = 1024
    factor: float = 0.7  # of the logarithmic grid; 0: linear
    low: float = 0.0
    high: float = 1.0
    step: float = 0.01
    seed: int = 1
    portion_as_label: bool = False

    def __post_init__(self):
        checks = (
            (0 <= self.factor < 1, "factor is 0 or more, below 1"),
            (0 <= self.query_portion <= 1, "query_portion is 0 to 1"),
            (0 <= self.low <= self.high <= 1, "0 <= low <= high <= 1"),
            (0 < self.step <= 1, "step is above 0, at most 1"),
            (self.replicates >= 1, "replicates is 1 or more"),
        )
        for ok, what in checks:
            if not ok:
                raise ValueError(what)

    def queries_for(self, kernel: str) -> int:
        return self.max_queries or {"kmer": 10_000, "alignment": 1_000}[kernel]

    def with_(self, **changes) -> "Sampling":
        return replace(self, **changes)
