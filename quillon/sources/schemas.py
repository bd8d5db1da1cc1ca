"""Schemas of records, outputs and payloads; see FIXTURES.md."""

from __future__ import annotations

RECORD = "text string, image_path string, text_source string, image_source string, gt_answers string, fake_cls string"

_QA = "array<struct<question: string, answer: string, confidence: double, citations: array<struct<url: string, title: string>>>>"
_RUN = "provider: string, model: string, temperature: double, q_chains: int, q_per_chain: int, answer_questions: boolean, answer_max_sources: int, search_provider: string, questions_enabled: boolean"

SETTINGS = "q_chains: int, q_per_chain: int, answer_questions: boolean, answer_max_sources: int, temperature: double, search_provider: string"

#: One line of a pipeline's output.
OUTPUT = f"""
image_path string, headline string, provider string, model string,
settings struct<{SETTINGS}>, run_params struct<{_RUN}>,
relevancy struct<aligned: string, confidence: double, explanation: string, raw: string>,
visual_veracity struct<ai_generated: boolean, confidence: double, explanation: string, anomalies: array<string>, raw: string>,
best_qa_per_chain {_QA},
token_usage struct<prompt: bigint, completion: bigint, total: bigint>,
modules struct<relevancy: boolean, visual_veracity: boolean, questions: boolean, question_answering: boolean, judge: boolean>,
sample_index bigint, dataset_order_index bigint, iteration_index bigint,
sample_details struct<dataset_index: bigint, gt_answers: string, fake_cls: string, text_source: string, image_source: string>,
judgement struct<label: string, confidence: double, logprob_confidence: double, rationale: string, key_factors: array<string>, raw: string,
                 logprob_stats: struct<token_count: int, avg_logprob: double, geo_mean_prob: double>>
"""

CHECKPOINT = """
run_id string, processed_count bigint, next_index bigint, chunk_size bigint, jsonl_path string, html_report_path string, created_at string,
args_snapshot map<string, string>, args_fingerprint string, status string, written_count bigint
"""
