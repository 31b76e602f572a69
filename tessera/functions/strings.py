"""Texts, identifiers and parameter strings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bracket tokens of parsers and what they stand for.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LCB-": "{", "-RCB-": "}", "-LSB-": "[", "-RSB-": "]", "``": '"', "''": '"'}


def normal_name(text: Column) -> Column:
    """A drug's or gazetteer's name for comparison: lower case, without hyphens, slashes, commas, backslashes and spaces."""
    return F.lower(F.regexp_replace(text, r"[-/,\\ ]", ""))


def escaped(text: Column) -> Column:
    """A text for an attribute of a markup file."""
    out = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def unescaped(token: Column) -> Column:
    """A parser's token as it stands in the text."""
    out = token
    for name, mark in BRACKETS.items():
        out = F.replace(out, F.lit(name), F.lit(mark))
    return out


def export_text(token: Column) -> Column:
    """A token for a parse file: brackets by name, no spaces inside."""
    out = token
    for name, mark in list(BRACKETS.items())[:6]:
        out = F.replace(out, F.lit(mark), F.lit(name))
    return F.replace(out, F.lit(" "), F.lit("-"))


def number_of(identifier: Column, letter: str) -> Column:
    """The number after a letter in the last part of a hierarchical id, null without one."""
    return F.nullif(F.regexp_extract(identifier, rf"(?:^|\.){letter}(\d+)$", 1), F.lit("")).cast("long")


def next_free(identifiers: Column, letter: str) -> Column:
    """Aggregate: one more than the highest number in use, 0 where there is none."""
    return F.coalesce(F.max(number_of(identifiers, letter)) + 1, F.lit(0))


def parent_id(identifier: Column, levels: int = 1) -> Column:
    """A hierarchical id without its last parts."""
    return F.array_join(F.slice(F.split(identifier, r"\."), 1, F.greatest(F.size(F.split(identifier, r"\.")) - levels, F.lit(0))), ".")


def interaction_id(doc: Column, sent: Column, e1: Column, e2: Column) -> Column:
    return F.concat_ws(".", doc, sent, F.concat(e1, F.lit("-"), e2))


def affixes(token: Column, longest: int = 3) -> Column:
    """Names of a token's prefixes and suffixes of 1 to ``longest`` characters."""
    low = F.lower(token)
    n = F.least(F.length(low), F.lit(longest))
    return F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.struct(F.substr(low, F.lit(1), k).alias("prefix"), F.substr(low, F.length(low) - k + 1, k).alias("suffix"))
    )


def range_boosted(value: Column, high: Column, boost: float) -> Column:
    """A positive score below the part ``1 - boost`` of its class's highest one turned negative, others as they are; for boosts under 1."""
    return F.when((F.lit(boost) < 1) & (value > 0) & (value < (1 - F.lit(boost)) * high), -value - 1).otherwise(value)


def signed_scale(value: Column, low: Column, high: Column) -> Column:
    """A score less the lowest, over the sum of the bounds' absolute values; 0 where that is 0."""
    width = F.abs(low) + F.abs(high)
    return F.when(width == 0, 0.0).otherwise((value - low) / width)


def super_pos(tag: Column) -> Column:
    """The first letter of a word-class tag."""
    return F.substring(tag, 1, 1)


_OPEN, _CLOSE = "([{", ")]}"


def split_parameters(text: str, mark: str = ":") -> list[str]:
    """Parts of a parameter string; marks inside brackets or quotes don't split."""
    out, depth, quote, part = [], 0, "", ""
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in _OPEN:
            depth += 1
        elif ch in _CLOSE:
            depth -= 1
        if ch == mark and not depth and not quote:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part] if text else []


def parameters(text: str | Mapping | None) -> dict[str, object]:
    """``a:b=1,2:c`` as {a: True, b: ["1", "2"], c: True}; a single value stays a text."""
    if text is None or isinstance(text, Mapping):
        return dict(text or {})
    out: dict[str, object] = {}
    for part in split_parameters(text):
        name, _, value = part.partition("=")
        values = split_parameters(value, ",") if "=" in part else [True]
        out[name.strip()] = values[0] if len(values) == 1 else values
    return out


def parameter_string(values: Mapping[str, object], skip: Sequence = (None,)) -> str:
    """The inverse of ``parameters``, names in order; values to skip are left out."""
    one = lambda k, v: k if v is True else f"{k}={','.join(map(str, v)) if isinstance(v, list | tuple) else v}"
    return ":".join(one(k, v) for k, v in sorted(values.items()) if not any(v is s for s in skip))


def with_defaults(text: str | Mapping | None, defaults: Mapping[str, object]) -> dict[str, object]:
    """Parameters over their defaults; a name that has none is an error."""
    given = parameters(text)
    if unknown := set(given) - set(defaults):
        raise KeyError(f"no parameter {min(unknown)}")
    return {**defaults, **given}
