"""Limits and defaults of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Fixed values are those that the service documents; the others are choices made here."""

    max_upload_bytes: int = 52_428_800
    upload_suffixes: tuple[str, ...] = (".pdf", ".txt", ".docx")
    list_limit: int = 100
    max_results: int = 10
    max_hops: int = 3
    min_strength: float = 0.5
    vector_candidates: int = 40
    default_title: str = "Untitled Document"
    # Choices: what counts as an entity and as a relationship, and BM25.
    entity_letters: int = 8
    entity_documents: int = 5
    relationship_floor: float = 0.25
    path_seeds: int = 10
    range_sections: int = 2048
    seed_ranges: int = 4
    restart: float = 0.15
    spread_rounds: int = 2
    fusion: int = 60
    answer_sentences: int = 3
    answer_relevance: float = 0.7
    alias_edits: int = 1
    alias_times: int = 3
    term_words: int = 3
    term_letters: int = 3
    term_likelihood: float = 10.83
    term_value: float = 5.0
    sketch_bits: int = 12
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


SETTINGS = Settings()
