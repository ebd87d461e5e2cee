"""Decision rules over results and budgets, as columns. Order of the branches is part of each rule."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_filter(name: Column, names: list[str] | None = None, pattern: str | None = None) -> Column:
    """Exact names, a pattern, or all; a pattern that does not compile lets nothing through."""
    if names is not None:
        return name.isin(*names) if names else F.lit(False)
    if pattern is None:
        return F.lit(True)
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return name.rlike(pattern)


def is_reliable(successes: Column, failures: Column) -> Column:
    return (successes > 0) & ((failures == 0) | (successes * 2 >= successes + failures))


def graduated_state(compiles: Column, unsafe: Column, score: Column, threshold: Column, errors: Column) -> Column:
    return (
        F.when(compiles & (unsafe == 0) & (score >= threshold), "Validated")
        .when(compiles & (unsafe > 0) & (score >= 50), "CompilesUnsafe")
        .when(compiles & (score < threshold), "CompilesLowScore")
        .when(~compiles & (errors <= 5) & (score >= 50), "NearlyCompiles")
        .otherwise("FallbackUnsafe")
    )


def warm_start(state: Column, score: Column, compiles: Column) -> Column:
    return (
        F.when(state.isin("Validated", "CompilesUnsafe") & (score >= 70), "Skip")
        .when((state == "NearlyCompiles") & (score >= 50), "SeedRepair")
        .when(compiles & (score >= 40), "SeedRepair")
        .otherwise("Retranslate")
    )


def validated(compiles: Column, score: Column, least: Column, same: Column) -> Column:
    """same is null where outputs were not compared: then 80 points are asked for at least."""
    return compiles & F.when(same.isNull(), score >= F.greatest(least, F.lit(80))).otherwise((score >= least) & same)


def next_state(passed: Column, state: Column, iteration: Column, most: int = 5) -> Column:
    """struct(state, iteration) after a check."""
    repairing = state == "Repairing"
    after = F.when(passed, "Validated").when(repairing & (iteration >= most), "FallbackUnsafe").otherwise("Repairing")
    return F.struct(after.alias("state"), F.when(after == "Repairing", F.when(repairing, iteration + 1).otherwise(1)).alias("iteration"))


def budget_phase(most: Column, used: Column) -> Column:
    share = F.floor(used * 100 / F.nullif(most, F.lit(0)))
    return F.when(most.isNull() | (most == 0), "Normal").when(share >= 100, "SaveAndExit").when(share >= 95, "AssembleNow").when(share >= 80, "SkipRepairs").otherwise("Normal")


def over_budget(tokens: Column, budget: Column, calls: Column, most: Column) -> Column:
    """Tokens above the budget, or calls above 120 % of theirs; a null limit is none."""
    return F.coalesce(tokens > budget, F.lit(False)) | F.coalesce(calls > most + F.floor(most / 5), F.lit(False))


def adaptive_budget(modules: Column, asked: Column) -> Column:
    return F.greatest(modules * 10 + 25, asked)


def repair_iterations(asked: Column, c_lines: Column, chunked: Column) -> Column:
    return (
        F.when(chunked, F.greatest(asked, F.lit(8)))
        .when(c_lines > 5000, F.least(asked, F.lit(3)))
        .when(c_lines > 2000, F.least(asked, F.lit(2)))
        .when(c_lines > 1000, F.least(asked, F.lit(3)))
        .otherwise(asked)
    )


def suite_repairs(interfaces: Column, c_lines: Column) -> Column:
    return F.least(F.lit(5) + F.floor(interfaces / 3) + F.when(c_lines > 2000, 2).when(c_lines > 1000, 1).otherwise(0), F.lit(10))


def should_retranslate(errors: Column, attempts: Column) -> Column:
    return (errors > 100) & (attempts == 0)


def ensemble_trigger(enabled: Column, state: Column, iteration: Column, score: Column, errors: Column, least: int = 70) -> Column:
    tired = (state == "Repairing") & (iteration >= 2) & ((errors > 0) | (F.coalesce(score, F.lit(0)) < least))
    return enabled & (tired | (state == "FallbackUnsafe"))


def ensemble_replaces(winner_compiles: Column, compiles: Column, winner_score: Column, score: Column) -> Column:
    return (winner_compiles & ~compiles) | (winner_score > F.coalesce(score, F.lit(0)))


def model_tier(difficulty: Column, task: Column) -> Column:
    """large for hard units, medium for medium ones and all analysis, small for the rest."""
    return F.when(difficulty == "hard", "large").when((difficulty == "medium") | (task == "analysis"), "medium").otherwise("small")


#: Lines up to which a small and a medium model do, for whole projects and for interfaces of modules.
PROJECT_BANDS, INTERFACE_BANDS = (300, 1500), (100, 500)


def tier_by_lines(n_lines: Column, bands: tuple[int, int], provider: Column, local: Column) -> Column:
    """F-17: a local model if one is named; one model of a provider without sizes; else small, medium or large by lines."""
    sized = F.when(n_lines <= bands[0], "small").when(n_lines <= bands[1], "medium").otherwise("large")
    return F.when(local.isNotNull(), F.concat(F.lit("local:"), local)).when(provider == "deepseek", "chat").otherwise(sized)


def provider_tier(difficulty: Column, task: Column, provider: Column, keys: Column) -> Column:
    """F-17: who translates and at which size: the local model where asked for, else the preferred provider with a key.

    `keys` are the providers that have one. The provider with two sizes takes its reasoning one for hard units.
    """
    two = F.when(difficulty == "hard", "deepseek:reasoner").otherwise("deepseek:chat")
    other = F.array_contains(keys, "deepseek")
    return (
        F.when(provider == "ollama", "ollama").when((provider == "deepseek") & other, two)
        .when(F.array_contains(keys, "anthropic"), F.concat(F.lit("anthropic:"), model_tier(difficulty, task))).when(other, two).otherwise("ollama")
    )


def error_severity(kind: Column) -> Column:
    return F.when(kind.isin("Validation", "Tool"), "Low").when(kind.isin("Agent", "NoSourceFiles", "Orchestration"), "Medium").when(kind.isin("Io", "BudgetExceeded"), "High")


def error_code(kind: Column) -> Column:
    special = F.create_map(F.lit("NoSourceFiles"), F.lit("E_NO_SOURCE"), F.lit("BudgetExceeded"), F.lit("E_BUDGET"))
    return F.coalesce(F.try_element_at(special, kind), F.concat(F.lit("E_"), F.upper(kind)))


def unsafe_retry(unsafe_before: Column, unsafe_after: Column) -> Column:
    """keep: no retry was due; accept: the retry has fewer; reject: it has not."""
    return F.when(unsafe_before <= 5, "keep").when(unsafe_after < unsafe_before, "accept").otherwise("reject")


def safe_path(path: Column) -> Column:
    """No part is `..`, and an absolute path lies under /tmp. Links are not followed."""
    return ~F.array_contains(F.split(path, "/"), "..") & (~path.startswith("/") | path.startswith("/tmp/"))


def status_label(compiles: Column, tests: Column) -> Column:
    return F.when(tests, "PASS").when(compiles, "BUILD_OK").otherwise("FAIL")


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 70, "mid").otherwise("low")


#: C types that traces can write, and those that are texts.
SCALAR_TYPES = (
    "int", "unsigned int", "unsigned", "long", "unsigned long", "short", "unsigned short", "char", "unsigned char", "float", "double", "long double",
    "size_t", "ssize_t", "int8_t", "int16_t", "int32_t", "int64_t", "uint8_t", "uint16_t", "uint32_t", "uint64_t", "bool", "_Bool",
)
TEXT_TYPES = ("const char*", "const char *", "char*", "char *")


def parameter_types(head: Column) -> Column:
    """The types in the parentheses of a function's first line, pointers as type and stars; `void` and nothing give none."""
    inside = F.when(head.contains("(") & head.contains(")"), F.regexp_extract(head, r"(?s)\A[^(]*\((.*)\)", 1)).otherwise("")
    words = F.transform(F.split(inside, ","), lambda p: F.array_remove(F.split(p, r"\s+"), ""))

    def kind(p: Column) -> Column:
        type_words = F.slice(p, 1, F.size(p) - 1)
        bare = F.array_remove(F.transform(type_words, lambda w: F.regexp_replace(w, r"\*+\z", "")), "")
        stars = F.regexp_count(F.array_join(p, " "), F.lit(r"\*"))
        return F.when(F.size(p) == 1, p[0]).when(stars > 0, F.concat(F.array_join(bare, " "), F.repeat(F.lit("*"), stars))).otherwise(F.array_join(type_words, " "))

    some = F.filter(words, lambda p: F.size(p) > 0)
    return F.when(F.trim(inside).isin("void", ""), F.array().cast("array<string>")).otherwise(F.transform(some, kind))


def not_instrumentable(head: Column, returns: Column) -> Column:
    """F-05: why a function, given by its first line and return type, cannot be traced; null if it can.

    The first parameter that does not fit decides, by the first rule that it breaks; then the return type.
    """
    scalar = lambda t: t.isin(*SCALAR_TYPES)
    pointed = lambda t: F.trim(F.regexp_replace(t, r"\*+\z", ""))
    to_scalar = lambda t: t.endswith("*") & (scalar(pointed(t)) | (pointed(t).startswith("const ") & scalar(F.substring(pointed(t), F.lit(7), F.length(t)))))
    because = lambda what, t: F.concat(F.lit(f"{what}: "), t)

    def fault(t: Column) -> Column:
        out = F.when(t.contains("void*") | t.contains("void *"), because("void* parameter", t))
        out = out.when(t.startswith("struct ") | t.startswith("union "), because("struct/union parameter", t))
        out = out.when(t.contains("(*"), because("function pointer parameter", t)).when(t.contains("FILE"), because("FILE parameter", t))
        return out.when(~(scalar(t) | t.isin(*TEXT_TYPES) | to_scalar(t)), because("unsupported parameter type", t))

    first = F.get(F.array_compact(F.transform(parameter_types(head), fault)), F.lit(0))
    fits = (returns == "void") | scalar(returns) | returns.isin(*TEXT_TYPES) | returns.endswith("*")
    return F.when(head.contains("..."), "variadic function").when(first.isNotNull(), first).when(~fits, because("unsupported return type", returns))
