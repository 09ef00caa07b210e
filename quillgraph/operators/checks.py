"""Checks around a task: its request, its scope, its risks, what is missing and what to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Profiles that a request may name.
PROFILES = ("agents-scaffold", "thesis-coding", "docs-paper-sync", "rri-oracle", "vin-baseline", "rollout-planning")
# Parts and beginnings of paths that questions aren't asked about.
QUIET_PARTS = ("/tests/", "/test_", "/external/", "/.agents/", "/docs/", "__pycache__")
QUIET_BEGINNINGS = ("tests/", "external/", ".agents/")
# The word that asks for a check of claims, and words that claim too much.
CLAIM_CHECK = "claim-check"
OVERCLAIMS = ("finished", "end-to-end", "real-device", "online rl", "deployed")


def checked_request(task: str, profile: str, budget: int) -> tuple[str, str, int]:
    """A request with its task trimmed; an error for an unknown profile, a blank task or a budget under 1."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; expected one of: {', '.join(PROFILES)}")
    if not task.strip():
        raise ValueError("the task must not be empty")
    if budget < 1:
        raise ValueError("the budget must be at least 1")
    return task.strip(), profile, budget


def in_scope(paths: list[Column | str], prefixes: list[str] | None) -> Column:
    """Whether one of a row's paths starts with one of the prefixes; without prefixes all rows are in scope."""
    if not prefixes:
        return F.lit(True)
    out = F.lit(False)
    for p in paths:
        for prefix in prefixes:
            out = out | F.coalesce(F.startswith(text.col(p), F.lit(prefix)), F.lit(False))
    return out


def may_ask(path: Column | str, prefixes: list[str]) -> Column:
    """Whether questions are asked about a path: below a prefix, and nothing about tests, documents or tools."""
    p = text.col(path)
    quiet = F.lit(False)
    for part in QUIET_PARTS:
        quiet = quiet | F.contains(p, F.lit(part))
    for start in QUIET_BEGINNINGS:
        quiet = quiet | F.startswith(p, F.lit(start))
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | F.startswith(p, F.lit(prefix))
    return ~quiet & wanted


def overclaims(task: Column | str) -> Column:
    """Whether a task that asks for a check of claims has a word that claims too much, whatever the case."""
    low = text.ascii_lower(task)
    found = F.lit(False)
    for word in OVERCLAIMS:
        found = found | F.contains(low, F.lit(word))
    return F.contains(low, F.lit(CLAIM_CHECK)) & found


def risk_flags(task: Column | str, found: list[tuple[Column, Column]]) -> Column:
    """Sorted distinct flags: the texts of the (condition, text) that hold, and that of a task that claims too much."""
    flags = [F.when(condition, flag) for condition, flag in [*found, (overclaims(task), F.lit("unsupported_overclaim"))]]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*flags))))


def backend_flag(recommendation: Column, name: Column, repair: Column) -> Column:
    """The flag of a backend that should be refreshed or lacks its source; null for others."""
    refresh = F.concat(F.lit("backend_refresh_first:"), name, F.lit(": "), F.coalesce(repair, F.lit("inspect capabilities")))
    missing = F.concat(F.lit("backend_missing_leaf:"), name, F.lit(": "), F.coalesce(repair, F.lit("resolve missing source")))
    return F.when(recommendation == "refresh_first", refresh).when(recommendation == "missing_leaf", missing)


def missing_leaves(backends: DataFrame, asked: DataFrame) -> DataFrame:
    """``provider, query, status, resolution_command``: leaves (those columns without status) that are asked for in any case, and configured backends (name, state, recommendation, configured, repair_command) to be refreshed or filled; of equal (provider, query) one, by both."""
    own = backends.where(F.col("configured") & F.col("recommendation").isin("missing_leaf", "refresh_first"))
    own = own.select(F.col("name").alias("provider"), F.concat(F.lit("Backend is "), "state", F.lit("; resolve before treating generated context as current.")).alias("query"), F.coalesce("repair_command", F.lit("inspect capabilities")).alias("resolution_command"))
    every = asked.select("provider", "query", "resolution_command").unionByName(own)
    one = every.groupBy("provider", "query").agg(F.min("resolution_command").alias("resolution_command"))
    return one.select("provider", "query", F.lit("pending").alias("status"), "resolution_command").orderBy("provider", "query")


def action_plan(task: str, advice: str, repairs: list[str], leaves: list[tuple[str, str]], flags: list[str]) -> list[str]:
    """What to do first: the task, a profile's advice, the first repair, the first missing leaf (provider, command) and the first risk."""
    out = [f"Start with the smallest edit that advances `{task.strip()}`; use evidence spans before opening wider surfaces.", advice]
    out += [f"Refresh first if needed: {x}" for x in repairs[:1]]
    out += [f"Resolve missing leaf when it affects the task: {provider} -> {command}" for provider, command in leaves[:1]]
    return out + [f"Mitigate highest risk flag before finalizing: {x}" for x in flags[:1]]


def verification_commands(profile: str, by_profile: dict[str, list[str]], otherwise: list[str]) -> list[str]:
    """Sorted distinct commands that check work under a profile."""
    return sorted(set(by_profile.get(profile, otherwise)))
