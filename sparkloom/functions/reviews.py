"""Fields of free-text reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has, lines, strip


def field(text: Column, label: str) -> Column:
    """What follows a label: the rest of its line without brackets and stars, else the next line that is not blank."""
    after = F.when(text.contains(label), F.substring(text, F.instr(text, label) + F.lit(len(label)), F.length(text)))
    rows = lines(after)
    first = strip(F.regexp_replace(F.regexp_replace(strip(F.try_element_at(rows, F.lit(1))), r"\A\[+|\]+\z", ""), r"\A\*+|\*+\z", ""))
    later = strip(F.try_element_at(F.filter(F.slice(rows, 2, 2**30), lambda x: strip(x) != ""), F.lit(1)))
    return F.when(F.size(rows) > 0, F.when(first == "", later).otherwise(first))


def _first_of(text: Column, *labels: str) -> Column:
    return F.coalesce(*[field(text, x) for x in labels])


def verdict(text: Column) -> Column:
    upper = F.upper(text)
    guess = (
        F.when(has(upper, "DIVERGENT"), "DIVERGENT")
        .when(has(upper, "EQUIVALENT") & has(upper, "LIKELY"), "LIKELY EQUIVALENT")
        .when(has(upper, "EQUIVALENT"), "EQUIVALENT")
        .otherwise("INSUFFICIENT DATA")
    )
    return F.coalesce(_first_of(text, "### Verdict:", "**Verdict:**", "Verdict:"), guess)


def confidence(text: Column) -> Column:
    """0 to 100; 50 where there is none or no number."""
    found = _first_of(text, "### Confidence:", "**Confidence:**", "Confidence:")
    return F.least(F.coalesce(strip(F.regexp_replace(found, r"%+\z", "")).try_cast("int"), F.lit(50)), F.lit(100))


def summary(text: Column) -> Column:
    plain = F.try_element_at(F.filter(lines(text), lambda x: (strip(x) != "") & ~x.startswith("#")), F.lit(1))
    return F.coalesce(_first_of(text, "### Summary", "**Summary:**"), plain, F.lit("No summary available."))


def spec_results(output: Column) -> Column:
    """A-15: (passed, failed, failures) of a test run's output: lines of a test that is ok, and the lines of those that are not."""
    tests = F.filter(lines(output), lambda x: x.contains("test "))
    failures = F.filter(tests, lambda x: x.contains("... FAILED"))
    passed = F.size(F.filter(tests, lambda x: x.contains("... ok")))
    return F.struct(passed.alias("passed"), F.size(failures).alias("failed"), failures.alias("failures"))
