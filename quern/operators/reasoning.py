"""Checks of reasoning traces and code in responses."""

from __future__ import annotations

import ast
import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import scored, single

NAMES = "think|redacted_reasoning"
SPAN = rf"(?is)<({NAMES})\s*>.*?</\1\s*>"
FENCE = r"(?s)```[^\n`]*\n.*?```"


def pure_think(field: str | Column = "output") -> Column:
    """1: code outside the thinking span only; 0: inside too; -1: none outside; -2: no thinking span."""
    text = single(field)
    outside = F.regexp_replace(text, SPAN, "")
    inside = F.array_join(F.regexp_extract_all(text, F.lit(SPAN), F.lit(0)), "\n")
    return F.when(~text.rlike(SPAN), -2.0).when(~outside.rlike(FENCE), -1.0).when(inside.rlike(FENCE), 0.0).otherwise(1.0)


def think_or_not(field: str | Column = "output") -> Column:
    """1 if any thinking tag, opening or closing, occurs."""
    return single(field).rlike(rf"(?i)</?({NAMES})\s*>").cast("int")


def code_blocks(text: str) -> list[str]:
    """The fenced blocks, else the whole text."""
    found = re.findall(r"```[^\n`]*\n(.*?)```", text, re.S)
    return found or [text]


def is_python(text: str | None) -> int:
    if not text or not text.strip():
        return 0
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for block in code_blocks(text):
            try:
                ast.parse(block)
            except (SyntaxError, ValueError, MemoryError, RecursionError):
                return 0
    return 1


def tree_sitter_python(text: str | None) -> int:
    """is_python() by tree-sitter's grammar, where that is installed: 1 if no block's tree has an error."""
    if not text or not text.strip():
        return 0
    import tree_sitter
    import tree_sitter_python as grammar

    parser = tree_sitter.Parser(tree_sitter.Language(grammar.language()))
    return int(not any(parser.parse(b.encode()).root_node.has_error for b in code_blocks(text)))


def ts_python(field: str | Column = "output", parser=is_python) -> Column:
    """1 if every code block (or the text, if it has none) parses as Python; empty: 0. parser may be replaced, as by
    tree_sitter_python, which differs on old syntax."""

    return scored(single(field), parser, kind="int")
