"""Explicit schemas of everything that is read or exchanged."""

from __future__ import annotations

TRIPLES = "triples array<struct<source: string, relation: string, target: string, description: string>>"
QUESTIONS = "id string, category string, difficulty string, question string, expected_strategic_intent string"
SCORE = "struct<faithfulness_score: int, relevance_score: int, context_precision_score: int, academic_justification: string, error: string>"
RESULTS = f"id string, category string, question string, baseline_vector_rag struct<answer: string, scores: {SCORE}>, proposed_graph_rag struct<answer: string, scores: {SCORE}>"
VECTORS = "id string, document string, embedding array<float>"
PAGES = "doc_id string, page_idx int, text string"
