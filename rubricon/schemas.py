"""Schemas of the documents read and written."""

ANSWERS = (
    "question string, success boolean, answer string, "
    "error struct<type string, message string, traceback string, context struct<max_turns int>>"
)
TAXONOMY_REQUIRED = ["question", "proposed_domain", "proposed_workflow"]
FACTS = (
    "question string, category string, model string, facts array<string>, answer_file string, answer_index int"
)
WEIGHTS = "struct<critical double, important double, optional double, hallucination double>"
RUBRIC = "struct<critical array<string>, important array<string>, optional array<string>>"
STATS = "struct<critical int, important int, optional int, total int>"
QUALITY = (
    "struct<scores struct<specificity double, atomicity double, tier_correctness double, coverage double>, "
    "overall double, issues array<string>, suggestions array<string>>"
)
RUBRICS = (
    f"question string, category string, weights {WEIGHTS}, rubric {RUBRIC}, stats {STATS}, "
    f"answer_files array<string>, quality {QUALITY}, recommendation string"
)
VERDICTS = "array<struct<fact string, met boolean, reason string>>"
BREAKDOWN = (
    "struct<critical_earned double, critical_possible double, important_earned double, "
    "important_possible double, optional_earned double, optional_possible double, "
    "hallucination_penalty double, raw_score double, max_score double, normalized double>"
)
GRADES = (
    "model string, summary struct<count int, average_score double, min_score double, max_score double>, "
    f"results array<struct<question string, score double, verdict struct<critical {VERDICTS}, "
    f"important {VERDICTS}, optional {VERDICTS}, hallucination_detected boolean>, "
    f"score_breakdown {BREAKDOWN}>>"
)
_COST = "struct<input double, output double, total double>"
TURNS = (
    "timestamp string, duration_seconds double, retry_overhead_seconds double, effective_duration_seconds double, "
    "query_result struct<output_text string, finish_reason struct<reason string, raw string>, "
    f"metadata struct<cost {_COST}, duration_seconds double, in_tokens long, out_tokens long, "
    "reasoning_tokens long, cache_read_tokens long, cache_write_tokens long>>, "
    "tool_call_records array<struct<tool_call struct<id string, name string, args string>, "
    "tool_output struct<output string, success boolean>, duration_seconds double, success boolean>>"
)
