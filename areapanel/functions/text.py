"""Sentences for display and descriptions from page HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentences shown next to an area, in words of our own.
PAST_TEXT = "Prediction only applicable for years after 2015"
HIGH_TEXT = "Not eligible: above average house value and/or income"
LOW_INCREASE_TEXT = "Not eligible: house value did not increase enough"


def area_sentence(area: Column, start: Column, end: Column) -> Column:
    return F.format_string("Probability for area %s over %s to %s", area.cast("string"), start.cast("string"),
                           end.cast("string"))


def reason_sentence(reason: Column) -> Column:
    """Sentence for an ineligibility reason; NULL for an eligible area."""
    return (
        F.when(reason == "Past", PAST_TEXT)
        .when(reason == "High Income and/or Housing", HIGH_TEXT)
        .when(reason == "Low Increase Rate", LOW_INCREASE_TEXT)
    )


def permit_sentence(a1: Column, a2: Column, nb: Column, dm: Column) -> Column:
    return F.format_string("Count by permit type: A1 = %s, A2 = %s, NB = %s, DM = %s",
                           *[c.cast("string") for c in (a1, a2, nb, dm)])


def feature_sentence(label: str, value: Column) -> Column:
    """'label: value' with a missing value shown as 0."""
    return F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit(0)).cast("string"))


def first_paragraph(html: Column, skip_if: str = "Coordinates:") -> Column:
    """Text of the first paragraph of a page, or of the second if the first holds ``skip_if``.

    Scripts and styles go first, because markup may be quoted inside them. NULL when there is no such paragraph.
    """
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", "")
    paragraphs = F.regexp_extract_all(body, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    texts = F.transform(paragraphs, lambda p: F.regexp_replace(p, r"<[^>]*>", ""))
    wanted = F.when(F.contains(F.try_element_at(texts, F.lit(1)), F.lit(skip_if)), F.lit(2)).otherwise(F.lit(1))
    return F.try_element_at(texts, wanted)
