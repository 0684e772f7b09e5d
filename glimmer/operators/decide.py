"""Decision tables: scores, tiers and verdicts as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Fixed values of the score."""

    loud: int = 423
    loud_cap: int = 3384
    quiet: int = 3
    some: int = 38
    aged_months: int = 48
    base_floor: float = 0.3


EARLY = ("prototype", "pilot")


def evidence_score(rows: DataFrame, rule_setter: str, organisations: str, fresh: str, players: str) -> DataFrame:
    """Adds d1: +2 for an organisation that sets rules; +1 for two organisations, -1 for none; +1 for a fresh event; +2 for three players, +1 for two."""
    n, p = F.coalesce(F.col(organisations), F.lit(0)), F.coalesce(F.col(players), F.lit(0))
    score = F.when(F.col(rule_setter), 2.0).otherwise(0.0) + F.when(n >= 2, 1.0).when(n == 0, -1.0).otherwise(0.0) + F.when(F.col(fresh), 1.0).otherwise(0.0) + F.when(p >= 3, 2.0).when(p == 2, 1.0).otherwise(0.0)
    return rows.withColumn("d1", score)


def candidate_score(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds status, tier, score and aged to rows of term, n_evidence, d1, stage, total, recent, age_months, fresh, players, named, base, area.

    The first rule that applies decides, and no score is below 0. Null total or recent is not measured; null area is an area that was not
    measured. A signal needs a named organisation (`named`).
    """
    early, scaled = F.col("stage").isin(*EARLY), F.col("stage") == "scaled"
    bonus, malus = F.when(early, 1.5).otherwise(0.0), F.when(scaled, 2.5).otherwise(0.0)
    total, recent, d1 = F.col("total"), F.col("recent"), F.col("d1")
    share = recent / total
    aged = F.coalesce(F.col("age_months") > limits.aged_months, F.lit(False))
    stale = aged & (total > 30) & (share < F.greatest("base", F.lit(limits.base_floor))) & ~F.col("fresh")
    # least() passes over nulls, so an area that was not measured is asked for first.
    loud = F.when(F.col("area").isNull(), limits.loud).otherwise(F.greatest(F.lit(limits.loud), F.least(F.floor(F.col("area") * 0.02), F.lit(limits.loud_cap))))
    ratio = F.when(total < 10, 0.0).otherwise(share / F.col("base"))
    growth = F.when(ratio >= 1.7, 4.0).when(ratio >= 1.2, 2.5).when(ratio >= 0.9, 1.0).otherwise(0.0)
    quiet = F.when(total <= limits.quiet, 2.5).when(total <= limits.some, 1.5).otherwise(0.0)
    stage = bonus + F.when(F.col("stage") == "limited_sales", 1.0).otherwise(0.0) - malus
    measured = F.greatest(F.lit(0.0), growth + quiet + d1 + stage)
    signal = (measured >= 5) & F.col("named") & ~aged
    no_term, no_evidence = F.col("term").isNull(), F.col("n_evidence") == 0
    rules: list[tuple[Column, str, str, Column]] = [
        (no_term & no_evidence, "rejected", "rejected", F.lit(0.0)),
        (no_term, "no_term", "review", F.greatest(F.lit(0.0), d1 + bonus - malus)),
        (no_evidence, "rejected", "rejected", F.lit(0.0)),
        (total.isNull() | recent.isNull(), "unmeasured", "review", F.greatest(F.lit(0.0), d1 + bonus)),
        (stale, "aged", "review", F.lit(0.0)),
        ((total > loud) & scaled, "scaled", "review", F.lit(0.0)),
        (total > loud, "too_loud", "too_loud", F.when(F.col("players") >= 2, 1.0).otherwise(0.5)),
        (scaled & (total > F.floor(loud / 4)), "scaled", "review", F.lit(0.0)),
        (total == 0, "unseen", "review", F.greatest(F.lit(0.0), 1 + d1 + F.when(early, 1.0).otherwise(0.0) - malus)),
        (signal, "measured", "signal", measured),
    ]
    status, tier, score = F.lit("measured"), F.lit("review"), measured
    for when, s, t, v in reversed(rules):
        hit = F.coalesce(when, F.lit(False))
        status, tier, score = F.when(hit, s).otherwise(status), F.when(hit, t).otherwise(tier), F.when(hit, v).otherwise(score)
    return rows.withColumns({"status": status, "tier": tier, "score": score, "aged": aged})


def adjusted(rows: DataFrame) -> DataFrame:
    """Adds the score and tier of a card after its domains, doubts, implementers, rounds, events and stage.

    Implementers can make a reviewed card a signal if its measurement raised no flag: it is neither aged nor loud. A rejected card stays
    rejected. Rounds and events add to the score after that; a signal on one domain, and any card whose early stage is not confirmed, goes to review.
    """
    score = F.col("score") + F.when(F.col("domains") >= 2, 1.5).otherwise(0.0)
    score = F.when(F.col("doubtful"), F.greatest(F.lit(0.0), score - 3)).otherwise(score)
    loud = F.col("implementers") >= 8
    score = score + F.when(loud, 0.0).when(F.col("implementers") >= 3, 2.5).when(F.col("implementers") == 2, 1.5).otherwise(0.0)
    promoted = (F.col("tier") == "review") & (score >= 5) & (F.col("status") == "measured") & ~F.col("aged") & ~loud
    score = score + F.when(F.col("rounds") > 0, 1.0).otherwise(0.0) + F.when(F.col("events") >= 2, 0.5).otherwise(0.0)
    signal = promoted | (F.col("tier") == "signal")
    tier = F.when(F.col("tier") == "rejected", "rejected").when(loud, "too_loud").when(F.col("assessed") != "early", "review").when(signal & (F.col("domains") < 2), "review").when(promoted, "signal").otherwise(F.col("tier"))
    return rows.withColumns({"card_score": score, "card_tier": tier})


def fitness(rows: DataFrame) -> DataFrame:
    """Verdict on a query: the first that applies of no_material, wrong_sense, ambiguous, too_broad, else ok."""
    verdict = (
        F.when((F.col("hits") < 6) | (F.col("hosts") < 4), "no_material")
        .when(F.col("consumer") >= 0.4, "wrong_sense")
        .when((F.col("second") >= 0.25) & (F.col("cosine") < 0.8), "ambiguous")
        .when((F.col("groups") >= 5) & (F.col("top") < 0.3), "too_broad")
        .otherwise("ok")
    )
    return rows.withColumn("verdict", verdict)


FACT = "id string, kind string, customer string, supplier string, date string, days int, quote_id string, supports boolean, distinct_parties boolean, in_use boolean, named boolean, dated boolean, own_words boolean"
CHECKS = ("supports", "distinct_parties", "in_use", "named", "dated", "own_words")


def passed_facts(rows: DataFrame, json: str, quote: str, cutoff: str) -> DataFrame:
    """The facts of each answer with `passed`: an id that occurs once, all six checks literally true, a date by the cutoff, and named parties inside
    the quote. The schema is typed: "true" for a boolean and "2" for a number are null, and fail."""
    facts = rows.withColumn("f", F.explode(F.from_json(json, f"array<struct<{FACT.replace(' ', ':').replace(',:', ',')}>>")))
    once = F.size(F.filter(F.from_json(json, f"array<struct<{FACT.replace(' ', ':').replace(',:', ',')}>>"), lambda x: x["id"] == F.col("f.id"))) == 1
    checks = F.lit(True)
    for c in CHECKS:
        checks = checks & F.coalesce(F.col(f"f.{c}"), F.lit(False))
    named = F.coalesce(F.col(quote).contains(F.col("f.customer")) & F.col(quote).contains(F.col("f.supplier")), F.lit(False))
    return facts.withColumn("passed", checks & once & named & F.coalesce(F.col("f.date") <= cutoff, F.lit(False)))
