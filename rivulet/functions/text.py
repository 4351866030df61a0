"""Text expressions: templates, truth in the sense of "has a value that counts", title cleaning and classification."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.functions import vocabulary as v


def shown(value: Column) -> Column:
    """A value inside a message; a missing one reads None."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(shown(values[p]) if k % 2 else F.lit(p) for k, p in enumerate(parts) if p))


def given(text: Column) -> Column:
    """text, or null if it is empty."""
    return F.nullif(text, F.lit(""))


def some(number: Column) -> Column:
    """Whether a number is there and not zero."""
    return F.coalesce(number, F.lit(0)) != 0


def trim(text: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_title(raw: Column) -> Column:
    """A listed title without surrounding space and its trailing date and time."""
    return F.regexp_replace(trim(raw), "(?U)" + v.TITLE_STAMP, "")


def absolute(link: Column, host: str = v.LINK_HOST) -> Column:
    """A link with the host in front, unless it begins with http or is missing."""
    return F.when((link != "") & ~link.startswith("http"), F.concat(F.lit(host), link)).otherwise(link)


def first_word_of(text: Column, rules: Iterable[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule whose word the text contains in lower case."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(word), F.lit(value)) for word, value in rules), F.lit(default).cast("string"))


def title_status(title: Column) -> Column:
    return first_word_of(title, v.STATUS_WORDS, v.PARENT)


def title_period(title: Column) -> Column:
    """The period of a title; null for titles that are of none or of a quarter that is not named by a figure."""
    period = first_word_of(title, v.PERIOD_WORDS)
    return F.when((period != v.QUARTER) | title_quarter(title).isNotNull(), period)


def title_quarter(title: Column) -> Column:
    """The lowest quarter that a quarterly title names."""
    named = first_word_of(title, ((f"quý {q}", str(q)) for q in range(1, 5))).cast("int")
    return F.when(first_word_of(title, v.PERIOD_WORDS) == v.QUARTER, named)


def today(as_of: Column) -> Column:
    """What the clock says."""
    return F.date_format(as_of, v.TODAY)
