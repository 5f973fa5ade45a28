"""All tunables of retrieval in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalConfig:
    """Thresholds and caps; `dataclasses.replace` gives a changed copy for a sweep."""

    merge_threshold: float = 0.85
    bm25_top: int = 100
    seed_top: int = 10
    first_round_slack: float = 0.03
    later_round_floor: float = 0.4
    hybrid_boost: float = 0.3
    overlap_weight: float = 0.05
    overlap_cap: float = 0.30
    overlap_top: int = 3
    match_threshold: float = 0.5
    match_slack: float = 0.05
    match_top: int = 3
    bindings_per_virtual: int = 5
    variants_per_subquestion: int = 8
    max_paths: int = 200
    max_rounds: int = 5
    extra_rounds: int = 2
    promote_bonus: float = 0.10
    top_paths: int = 3
    tight: tuple[int, int, float] = (2, 5, 0.05)
    wide: tuple[int, int, float] = (2, 8, 0.10)
    tied_slack: float = 0.05
    max_lineage_variants: int = 600
    pagerank_anchors: int = 5
    pagerank_floor: float = 0.5
    pagerank_alpha: float = 0.5
    pagerank_top: int = 20
    chunk_sentences: int = 5
    chunk_chars: int = 800
    chunk_keep_sentences: int = 8
    treat_other_as_unknown: bool = False
