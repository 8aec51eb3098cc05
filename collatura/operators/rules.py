"""Ordered rules over error rows: the first that holds gives a row its reason, or protects it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Thresholds and switches; a JSON object overrides any of them."""

    edit_distance: int = 2
    protected_distance: int = 1
    protected_length: int = 5
    phonetic: float = 0.95
    confidence: float = 0.9
    chain_seconds: float = 3.0
    chain_distance: int = 3
    verbs_around: int = 3
    name_share: float = 0.5
    lemma_length: int = 5
    protect_case: bool = True
    use_lemmas: bool = True
    use_homophones: bool = True

    @classmethod
    def load(cls, text: str | None = None) -> Config:
        own = json.loads(text) if text else {}
        unknown = set(own) - set(asdict(cls()))
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(cls(), **own)


@dataclass(frozen=True)
class Rule:
    """A predicate over error rows.  ``protects``: rows it holds for are kept whatever comes later."""

    priority: float
    label: str
    test: Callable[[Config], Column]
    protects: bool = False
    confidence: float = 1.0


_RULES: dict[str, Rule] = {}


def register_rule(rule: Rule) -> Rule:
    """Add a rule, or replace the one with its label; rules are plain column expressions and stay in the plan."""
    _RULES[rule.label] = rule
    return rule


def unregister_rule(label: str) -> None:
    _RULES.pop(label, None)


def registered_rules() -> list[Rule]:
    """All rules in order: by priority, then label."""
    return sorted(_RULES.values(), key=lambda r: (r.priority, r.label))


def rule(priority: float, label: str, protects: bool = False, confidence: float = 1.0):
    def add(test: Callable[[Config], Column]) -> Callable[[Config], Column]:
        register_rule(Rule(priority, label, test, protects, confidence))
        return test

    return add


def verdict(config: Config, rules: Iterable[Rule] | None = None) -> Column:
    """The label of the first rule that holds; a predicate that is null does not hold."""
    rules = registered_rules() if rules is None else list(rules)
    tests = [F.when(F.coalesce(r.test(config), F.lit(False)), F.lit(r.label)) for r in rules]
    return F.coalesce(*tests, F.lit(None).cast("string")) if tests else F.lit(None).cast("string")


def filter_errors(rows: DataFrame, config: Config | None = None, rules: Iterable[Rule] | None = None) -> DataFrame:
    """``rows`` with ``rule`` (the first that holds) and ``filter_reason`` (null: the row is kept)."""
    config = config or Config()
    rules = registered_rules() if rules is None else list(rules)
    keepers = [r.label for r in rules if r.protects]
    out = rows.withColumn("rule", verdict(config, rules))
    reason = F.when(F.col("rule").isin(*keepers), F.lit(None).cast("string")).otherwise(F.col("rule")) if keepers else F.col("rule")
    return out.withColumn("filter_reason", reason)


def early_drop(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """Rows left after dropping what a rule of enough confidence already explains; protections still come first."""
    config = config or Config()
    sure = [r for r in registered_rules() if r.protects or r.confidence >= config.confidence]
    return filter_errors(rows, config, sure).where("filter_reason IS NULL").drop("rule", "filter_reason")


def of_types(rows: DataFrame, *types: str) -> DataFrame:
    return rows.where(F.col("type").isin(*types))


def reason_counts(rows: DataFrame) -> DataFrame:
    """(reason, n, share) with a row of reason "total"; kept rows have the reason "kept"."""
    reason = F.coalesce("filter_reason", F.lit("kept"))
    n = rows.select(reason.alias("reason")).rollup("reason").agg(F.count("*").alias("n"))
    total = F.max("n").over(_all())
    return n.select(F.coalesce("reason", F.lit("total")).alias("reason"), "n", (F.col("n") / total).alias("share"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # a row a reason
