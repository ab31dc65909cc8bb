"""Rules: reading them from YAML, checking and selecting them.

A rule is a few kilobytes of metadata, so it is read on the driver; what it searches is a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.functions.labels import label_selector

DEFAULT_RULESET = "default-ruleset"
CATEGORIES = ("potential", "optional", "mandatory")


@dataclass
class Condition:
    """``op`` is ``and``, ``or`` or a capability such as ``builtin.filecontent``; ``value`` its parts or its fields."""

    op: str
    value: object
    negate: bool = False
    ignore: bool = False
    name: str = ""
    source: str = ""


@dataclass
class Rule:
    rule_id: str
    when: Condition
    ruleset: str = DEFAULT_RULESET
    description: str = ""
    category: str = "potential"
    effort: int | None = None
    labels: list[str] = field(default_factory=list)
    message: str | None = None
    tags: list[str] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    variables: list[dict] = field(default_factory=list)


class RuleError(ValueError):
    pass


def condition(data: dict) -> Condition:
    own = {k: v for k, v in data.items() if k not in ("not", "ignore", "as", "from")}
    if len(own) != 1:
        raise RuleError(f"a condition names one search, not {sorted(own)}")
    (op, value), = own.items()
    if op in ("and", "or"):
        if not isinstance(value, list) or not value:
            raise RuleError(f"{op} needs a list of conditions")
        value = in_chain_order([condition(x) for x in value])
    return Condition(op, value, bool(data.get("not")), bool(data.get("ignore")), data.get("as", ""), data.get("from", ""))


def in_chain_order(parts: list[Condition]) -> list[Condition]:
    """Producers before their consumers; names are unique, and nothing consumes itself. A consumer of a name that no part
    gives has no place in the order and is left out."""
    names = [p.name for p in parts if p.name]
    if len({*names}) != len(names):
        raise RuleError("a name is given twice")
    if any(p.name and p.name == p.source for p in parts):
        raise RuleError("a condition consumes itself")

    def chain(part: Condition) -> list[Condition]:
        return [part, *(y for x in parts if part.name and x.source == part.name for y in chain(x))]

    return [x for p in parts if not p.source for x in chain(p)]


def rule(data: dict, ruleset: str, labels: list[str]) -> Rule:
    rule_id = str(data.get("ruleID") or "")
    if not rule_id or "\n" in rule_id or ";" in rule_id:
        raise RuleError(f"not a rule id: {rule_id!r}")
    if "when" not in data or not (data.get("message") or data.get("tag")):
        raise RuleError(f"{rule_id}: needs a condition, and a message or tags")
    category = str(data.get("category") or "potential").lower()
    return Rule(rule_id, condition(data["when"]), ruleset, data.get("description") or "", category if category in CATEGORIES else "potential", data.get("effort"), list(dict.fromkeys([*(data.get("labels") or []), *labels])), data.get("message"), list(data.get("tag") or []), list(data.get("links") or []), list(data.get("customVariables") or []))


def load(path: str) -> list[Rule]:
    """Rules of a YAML file, or of a directory tree; a directory's ``ruleset.yaml`` names its rules and gives them labels.

    Test files and other file types are skipped, as are rules with an invalid id; an id given twice in a file is an error."""
    top, out = Path(path), []
    files = [top] if top.is_file() else sorted(p for p in top.rglob("*") if p.suffix in (".yaml", ".yml"))
    for p in files:
        if p.name == "ruleset.yaml" or p.name.endswith((".test.yaml", ".test.yml")):
            continue
        meta_file = p.parent / "ruleset.yaml"
        meta = yaml.safe_load(meta_file.read_text()) if meta_file.exists() else {}
        rules, seen = [], set()
        for data in yaml.safe_load(p.read_text()) or []:
            try:
                one = rule(data, (meta or {}).get("name") or DEFAULT_RULESET, (meta or {}).get("labels") or [])
            except RuleError as e:
                if "not a rule id" in str(e):
                    continue
                raise
            if one.rule_id in seen:
                raise RuleError(f"{one.rule_id} is given twice")
            seen.add(one.rule_id)
            rules.append(one)
        out += rules
    return out


SCHEMA = "ruleset string, rule_id string, description string, category string, effort int, labels array<string>, tags array<string>, message string"


def as_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    return spark.createDataFrame([(r.ruleset, r.rule_id, r.description, r.category, r.effort, r.labels, r.tags, r.message) for r in rules], SCHEMA)


def selected(rules: DataFrame, selectors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped): a rule is kept if all selectors hold for its labels."""
    keep = F.lit(True)
    for s in selectors:
        keep = keep & label_selector(F.col("labels"), s)
    return rules.filter(keep), rules.filter(~keep).select("ruleset", "rule_id")
