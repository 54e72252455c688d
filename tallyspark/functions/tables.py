"""Parsers as table functions, for lateral joins in SQL: ``SELECT .. FROM statements s, LATERAL statement_lines(s.text, 'yes', 'ace') t``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tallyspark.operators.parsing import RULES, LineRule
from tallyspark.operators.registry import READERS, SEVERAL

_SCHEMA = StructType().add("pos", IntegerType()).add("day", StringType()).add("description", StringType()).add("amount", StringType()).add("mark", StringType()).add("ref_no", StringType())


def rule_for(bank: str, variant: str | None) -> LineRule:
    """The line rule of a bank and variant, or of the bank's default."""
    known = {(b, v): r for b, v, r in READERS}
    name = known.get((bank, variant or "default")) or known.get((bank, "default"))
    if name is None or name in SEVERAL:
        raise ValueError(f"no single line rule for {bank}/{variant or 'default'}")
    return RULES[name]


class _StatementLines:
    """The parts of each transaction line as printed; bank and variant are constants, which the planner checks."""

    @staticmethod
    def analyze(text: AnalyzeArgument, bank: AnalyzeArgument, variant: AnalyzeArgument) -> AnalyzeResult:
        if text.dataType != StringType():
            raise ValueError("the first argument is the text")
        if not (bank.isConstantExpression and variant.isConstantExpression):
            raise ValueError("bank and variant are constants")
        rule_for(bank.value, variant.value)
        return AnalyzeResult(_SCHEMA)

    def __init__(self) -> None:
        self.known: dict[tuple, tuple[LineRule, re.Pattern, re.Pattern | None]] = {}

    def eval(self, text: str, bank: str, variant: str) -> Iterator[tuple]:
        if (bank, variant) not in self.known:
            rule = rule_for(bank, variant)
            self.known[bank, variant] = rule, re.compile(rule.pattern), re.compile(rule.skip) if rule.skip else None
        rule, pattern, skip = self.known[bank, variant]
        for pos, line in enumerate(re.split(r"\r\n?|\f|\n", text or "")):
            if rule.stop and rule.stop in line:
                return
            found = pattern.search(line)
            if found and not (skip and skip.search(line)):
                part = lambda n: (found[n] or None) if n else None  # noqa: B023, E731
                yield pos, part(rule.date), part(rule.description), part(rule.amount), (part(rule.mark) or rule.default_mark).upper(), part(rule.ref)


def register(spark: SparkSession) -> None:
    """Make ``statement_lines(text, bank, variant)`` known to the session: (pos, day, description, amount, mark, ref_no) of each transaction line.

    Rows go to Python and back pickled: with Arrow each statement's few lines would be a table of their own, which takes longer than to find them.
    """
    spark.udtf.register("statement_lines", udtf(_StatementLines, useArrow=False))
