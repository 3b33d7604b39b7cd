"""Functions over text and names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CUTS = r"_|(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"


def line_count(text: Column) -> Column:
    """Line breaks, and one more if the last line has none; 0 for null and empty texts."""
    n = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(n + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def identifier_tokens(name: Column) -> Column:
    """An array of the words of an identifier, as rules.base.name_tokens() cuts them."""
    return F.filter(F.split(name, _CUTS), lambda x: x != "")


def negated(name: Column, prefixes: list[str], allow: list[str]) -> Column:
    """Whether an identifier begins with a negation that an upper-case letter follows."""
    both = "|".join([*prefixes, *(p[:1].lower() + p[1:] for p in prefixes)])
    return name.rlike(rf"^(?:{both})\p{{Lu}}") & ~name.isin(*allow)


def stutters(name: Column, package: Column) -> Column:
    """Whether an identifier begins with its package's name, at a word's bound."""
    rest = F.substring(name, F.length(package) + 1, F.length(name))
    return F.startswith(F.lower(name), F.lower(package)) & ((rest == "") | rest.rlike("^[A-Z]"))
