"""Labels ``[prefix/]key[=value]`` and selectors over them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ruleframe.functions.versions import version

VALID = r"^[A-Za-z0-9](?:[-A-Za-z0-9_.]*[A-Za-z0-9])?(?:\.[A-Za-z0-9.-]+)?(?:/[-A-Za-z0-9_.]+)?(?:=(?:[A-Za-z0-9](?:[-A-Za-z0-9. ]*[A-Za-z0-9+-])?)?)?$"
NAME = r"^(.*?)(\d[\d.]*)?([+-])?$"
#: Key of the label that settles a rule's selection, whatever the selector.
INCLUDE = "ruleframe/include"


def label_key(label: Column) -> Column:
    return F.substring_index(label, "=", 1)


def label_value(label: Column) -> Column:
    return F.when(F.instr(label, "=") > 0, F.regexp_replace(label, "^[^=]*=", ""))


def valid(labels: Column) -> Column:
    return F.filter(labels, lambda x: x.rlike(VALID))


def value_matches(rule: Column, asked: Column) -> Column:
    """``name[version][+|-]`` of a rule against ``name[version]`` of a selector: ``+`` and above, ``-`` and below, else equal; a
    selector without a version takes any; an empty rule value matches all."""
    name, number, sign = (F.regexp_extract(rule, NAME, k) for k in (1, 2, 3))
    asked_name, asked_number = F.regexp_extract(asked, NAME, 1), F.regexp_extract(asked, NAME, 2)
    mine, theirs = version(number), version(asked_number)
    fits = F.when(sign == "+", theirs >= mine).when(sign == "-", mine >= theirs).otherwise(theirs == mine)
    same = F.when(asked_number == "", F.lit(True)).when(number == "", F.lit(False)).otherwise(F.coalesce(fits, F.lit(False)))
    return (rule == "") | ((name == asked_name) & same)


def has_label(labels: Column, wanted: str) -> Column:
    """``key``: any label with the key; ``key=value``: one whose value matches."""
    key, _, value = wanted.partition("=")
    if not value:
        return F.exists(labels, lambda x: label_key(x) == key)
    return F.exists(labels, lambda x: (label_key(x) == key) & value_matches(F.coalesce(label_value(x), F.lit("")), F.lit(value)))


def select(expression: str, match: Callable[[str], Column]) -> Column:
    """A selector of names joined by ``!``, ``&&``, ``||`` and round brackets, as one column; ``match`` gives a name's column.

    The names are bound as columns, and the connectives are Python's own over columns."""
    names: list[str] = []

    def bind(m: re.Match) -> str:
        names.append(m[0].strip().removesuffix("="))
        return f" c[{len(names) - 1}] "

    text = re.sub(r"[^!&|()]*[^!&|()\s][^!&|()]*", bind, expression)
    if not re.fullmatch(r"(?:c\[\d+\]|!|&&|\|\||[()]|\s)*", text) or not names:
        raise ValueError(f"not a selector: {expression!r}")
    text = text.replace("&&", "&").replace("||", "|").replace("!", "~")
    try:
        return eval(text, {"__builtins__": {}}, {"c": [match(x) for x in names]})  # only c[n], ~, &, | and brackets
    except (SyntaxError, TypeError) as e:
        raise ValueError(f"not a selector: {expression!r}") from e


def label_selector(labels: Column, expression: str) -> Column:
    """Selector over valid labels; ``include=always`` and ``include=never`` come first."""
    good = valid(labels)
    chosen = select(expression, lambda x: has_label(good, x))
    return F.when(F.array_contains(labels, f"{INCLUDE}=always"), True).when(F.array_contains(labels, f"{INCLUDE}=never"), False).otherwise(chosen)


def incident_selector(variables: Column, expression: str) -> Column:
    """Selector over ``key=value`` of an incident's variables. A dotted value is met by a variable that contains it followed by
    a dot; others need equality. Values that labels cannot hold count as absent."""
    items = F.transform(F.map_entries(variables), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    items = F.filter(F.coalesce(items, F.array()), lambda x: x.rlike(VALID))

    def match(wanted: str) -> Column:
        if "=" not in wanted:
            return F.exists(items, lambda x: label_key(x) == wanted)
        if "." in wanted:
            return F.exists(items, lambda x: F.contains(x, F.lit(wanted + ".")) | (x == wanted))
        return F.array_contains(items, wanted)

    return select(expression, match)
