"""Grading of answers against rubrics, from judge replies to run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rubricon.operators import grading
from rubricon.operators.grouping import tasks_for


def grade_answers(
    criteria: DataFrame, answers: DataFrame, replies: DataFrame, reply_keys: Sequence[str], dealbreaker: str = "critical"
) -> dict[str, DataFrame]:
    """``criteria(question, tier, ...)``, ``answers(question, model, category, hallucination)``
    and ``replies(<keys>, met, reason, failure)`` to verdicts, scores, gated scores and
    both summaries.

    Every answer is judged and scored on its own: a question that several models answered has its
    criteria once per model, and ``reply_keys`` name the model where replies differ by it. An answer
    to a question without criteria scores 0 and counts.

    Answers are counted first. Their verdicts lie scattered after the join with the replies, so a count
    there would hold a group per verdict; they are dealt by answer to tasks of a bounded number of
    answers, which count them as they stream by. Criteria, the longer side, stream by the answers of
    their questions; those are never broadcast, since there may be many models to a question.
    """
    asked = criteria.join(answers.select("question", "model").hint("shuffle_hash"), "question")
    verdicts = grading.attach_verdicts(asked, replies, reply_keys)
    keys, tasks = ["model", "question"], tasks_for(answers)
    scores = grading.roll_up(verdicts.repartition(tasks, *keys), keys, answers.repartition(tasks, *keys))
    gated = grading.gate(scores, dealbreaker)
    return {
        "verdicts": verdicts,
        "scores": scores,
        "summary": grading.run_summary(scores),
        "gated": gated,
        "gated_summary": grading.gated_summary(gated, dealbreaker=dealbreaker),
    }
