"""Prompt prefixes and the rules that pick a prompt or a vector kind."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, functions as F

from pairforge import constants as K


def _prefixed(prompts: dict[str, str], name: Column, text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(prompts.items())])
    # A null or unknown name finds nothing and leaves the text as it is.
    prefix = F.try_element_at(table, F.coalesce(name, F.lit("")))
    return F.concat(F.coalesce(prefix, F.lit("")), text)


@dataclass(frozen=True)
class Prompts:
    """Prompt tables; overrides are merged over the defaults."""

    teacher: dict[str, str] = field(default_factory=dict)
    student: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: dict) -> "Prompts":
        section = config.get("prompts") or {}
        return cls(section.get("teacher") or {}, section.get("student") or {})

    def teacher_text(self, name: Column, text: Column) -> Column:
        return _prefixed(K.TEACHER_PROMPTS | self.teacher, name, text)

    def student_text(self, name: Column, text: Column) -> Column:
        return _prefixed(K.STUDENT_PROMPTS | self.student, name, text)


def effective_student_prompt(role: Column, name: Column) -> Column:
    """Passage-like sides lose a task prompt; spelled-out nulls become null."""
    clean = F.when(~name.isin(*K.NULL_PROMPT_NAMES), name)
    task_prompts = [p for p in K.STUDENT_PROMPTS if p != "document"]
    passage_side = role.isin("positive", "negative", "document", "sentence_b")
    return F.when(passage_side & clean.isin(*task_prompts), F.lit("document")).otherwise(clean)


def wants_query_vector(task: Column, role: Column, side: Column) -> Column:
    """Sides whose teacher vector is the query-prompted one."""
    flag = (
        (role == "query")
        | ((task == "sts") & (role == "sentence_a"))
        | ((task == "bitext") & (side == 0))
    )
    return F.coalesce(flag, F.lit(False))


def is_query_prompted(role: Column, teacher_prompt: Column) -> Column:
    """Sides that get a query-prompted encoding at all."""
    skip = ("document", *K.NULL_PROMPT_NAMES)
    return (
        teacher_prompt.isNotNull()
        & ~teacher_prompt.isin(*skip)
        & role.isin("query", "sentence_a", "sentence_b")
    )
