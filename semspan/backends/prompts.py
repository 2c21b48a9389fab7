"""The wording of questions. Roles: what the task is, how to answer, examples, the data, the instruction."""

from __future__ import annotations

import re

from semspan.backends.base import Prompt

TASKS = {
    "map": "Work out new values for the record below, following the instruction at the end.",
    "filter": "Decide whether the record below meets the condition at the end.",
    "join": "Decide whether the left and the right value belong together under the condition at the end.",
    "join_block": "Find all pairs of one left and one right value that belong together under the condition at the end.",
    "rank": "Say which of the two values meets the criterion at the end better.",
    "reduce": "Combine all values below into one answer, following the instruction at the end.",
    "judge": "Check whether the draft answers the instruction for the record. Say pass, or what is wrong with it.",
    "refine": "Improve the draft with the remarks made about it.",
    "summarize": "Describe what each column of the table below holds.",
    "relevance": "Decide whether the data set below helps to answer the question at the end.",
    "rewrite": "Write the instruction at the end as one Spark SQL expression over the columns below.",
}
ANSWERS = {
    "filter": "True or False",
    "join": "True or False",
    "relevance": "True or False",
    "join_block": "the pairs as L0-R0 with the labels shown, separated by commas, or nothing",
    "rank": "1 if the first value meets it better, 2 if the second does, 0 if both do alike",
    "rewrite": "the expression in a code block marked sql, or nothing if there is none",
    "judge": "pass, or your remarks",
}


def is_media(kind: str, value: str) -> bool:
    """Whether a value is sent as media: a data URI or an address, not the bare name of a file."""
    return kind in ("image", "audio", "file") and value.startswith(("data:", "http://", "https://"))


def render(prompt: Prompt) -> str:
    lines = [f"TASK: {TASKS[prompt.operation]}"]
    what = ANSWERS.get(prompt.operation, "your answer")
    lines.append("ANSWER FORMAT: " + " ".join(f"<{t}>{what}</{t}>" for t in prompt.tags))
    for data, answer in prompt.demonstrations:
        lines.append("EXAMPLE: " + "; ".join(f"{k} = {v}" for k, v in data))
        lines.append(f"EXAMPLE ANSWER: {answer}")
    for label, kind, value in prompt.items:
        # What is no text is sent as a part of its own; the text only says that it is there.
        lines.append(f"[{label}|{kind}] {f'(see the attached {kind})' if is_media(kind, value) else value}")
    if prompt.draft is not None:
        lines.append(f"DRAFT: {prompt.draft}")
    if prompt.feedback is not None:
        lines.append(f"REMARKS: {prompt.feedback}")
    lines.append(f"INSTRUCTION: {prompt.instruction}")
    return "\n".join(lines)


_ITEM = re.compile(r"^\[([^|\]]*)\|(\w+)\] (.*?)(?=\n\[[^|\]]*\|\w+\] |\nDRAFT: |\nREMARKS: |\nINSTRUCTION: |\Z)", re.MULTILINE | re.DOTALL)


def read_back(text: str) -> tuple[list[tuple[str, str]], str, str | None]:
    """(label, value) items, instruction and draft of a rendered question: how offline backends see it."""
    items = [(m.group(1), m.group(3)) for m in _ITEM.finditer(text)]
    instruction = text.rpartition("\nINSTRUCTION: ")[2]
    draft = re.search(r"^DRAFT: (.*?)(?=\nREMARKS: |\nINSTRUCTION: )", text, re.MULTILINE | re.DOTALL)
    return items, instruction, draft.group(1) if draft else None
