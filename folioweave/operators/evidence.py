"""Evidence mentions, possession status, gaps, stages and risk per text."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioweave.functions import text as tx
from folioweave.operators.quality import banded
from folioweave.rules import evidence as rules

WORD = "[a-z0-9_]"


@dataclass(frozen=True)
class Cues:
    """Possession cues in order; at equal distance the earlier one counts."""

    positive: Sequence[str] = tuple(rules.POSITIVE_BEFORE)
    possessive: Sequence[str] = tuple(rules.POSSESSIVE_AFTER)
    negative_before: Sequence[str] = tuple(rules.NEGATIVE_BEFORE)
    negative_after: Sequence[str] = tuple(rules.NEGATIVE_AFTER)
    uncertain_before: Sequence[str] = tuple(rules.UNCERTAIN_BEFORE)
    uncertain_after: Sequence[str] = tuple(rules.UNCERTAIN_AFTER)
    holder_word: str = rules.HOLDER_WORD
    other_holders: Sequence[str] = tuple(rules.OTHER_HOLDERS)
    bare: str = rules.BARE_POSITIVE
    negators: Sequence[str] = tuple(rules.NEGATORS)


def _either(phrases: Sequence[str]) -> str:
    return "|".join(sorted(phrases, key=len, reverse=True))


def nearest_before(context: Column, phrases: Sequence[str], limit: int, hidden: dict[str, Column] | None = None) -> Column:
    """``(gap, nth, phrase)`` of the whole phrase that ends nearest to the context's end.

    Of equal gaps the phrase that is earlier in the list wins; null beyond ``limit``.
    ``hidden`` gives some phrases another text of the same length to search.
    """
    spots = []
    for nth, phrase in enumerate(phrases):
        where = (hidden or {}).get(phrase, context)
        pattern = rf"(?s)^(?:.*[^a-z0-9_])?(?:{phrase})((?:[^a-z0-9_].*)?)$"
        gap = F.length(F.regexp_extract(where, pattern, 1))
        spot = F.struct(gap.alias("gap"), F.lit(nth).alias("nth"), F.lit(phrase).alias("phrase"))
        spots.append(F.when(F.contains(where, F.lit(phrase)) & where.rlike(pattern) & (gap <= limit), spot))
    return F.array_min(F.array(*spots))


def after_last(context: Column, phrase: Column) -> Column:
    """Characters after the last occurrence of the phrase, inside words too."""
    return F.length(F.call_function("substring_index", context, phrase, F.lit(-1)))


def first_after(context: Column, phrases: Sequence[str]) -> Column:
    """Characters before the first whole phrase; null when there is none."""
    pattern = rf"(?s)^(.*?[^a-z0-9_]|)(?:{_either(phrases)})(?:[^a-z0-9_].*)?$"
    return F.when(context.rlike(pattern), F.length(F.regexp_extract(context, pattern, 1)))


def mentions(texts: DataFrame, aliases: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Every whole-word alias occurrence with 80 characters on both sides.

    ``texts``: ``text_id, domain, folded``; ``aliases``: ``(domain, evidence_id,
    folded alias)``, a closed rule list.  The aliases present are found in one
    projection; occurrences are located by the lengths of the parts between them.
    """
    table = F.array(
        *[F.struct(F.lit(d).alias("domain"), F.lit(e).alias("evidence_id"), F.lit(a).alias("alias")) for d, e, a in aliases]
    )
    present = F.filter(
        table, lambda s: (s["domain"] == F.col("domain")) & F.contains(F.col("folded"), s["alias"])
    )
    rows = texts.select("text_id", "folded", F.explode(present).alias("a")).select(
        "text_id", "folded", F.col("a.evidence_id").alias("evidence_id"), F.col("a.alias").alias("alias")
    )
    parts = F.split("folded", F.concat(F.lit(r"\Q"), F.col("alias"), F.lit(r"\E")), F.lit(-1))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        begin,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + F.length("alias")).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + F.length(p))).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    spots = rows.select("*", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + F.length("alias"))
    before = F.substring(
        F.col("folded"), F.greatest(F.col("start") - rules.CONTEXT, F.lit(0)) + 1, F.least(F.col("start"), F.lit(rules.CONTEXT))
    )
    after = F.substring(F.col("folded"), F.col("stop") + 1, F.lit(rules.CONTEXT))
    whole = ~before.rlike(rf"{WORD}$") & ~after.rlike(rf"^{WORD}")
    return spots.withColumns({"before": before, "after": after}).filter(whole).drop("folded")


def possession(found: DataFrame, cues: Cues | None = None, default_present: Column | None = None) -> DataFrame:
    """Status and confidence of every mention from the nearest cues."""
    c = cues or Cues()
    lim = rules.LIMITS
    before, after = F.col("before"), F.col("after")
    # a negated bare cue is masked, keeping all distances
    masked = F.regexp_replace(
        before, rf"({'|'.join(c.negators)}) {c.bare}([^a-z0-9_]|$)", f"$1 {'x' * len(c.bare)}$2"
    )
    measured = found.withColumns(
        {
            "_p": nearest_before(before, c.positive, lim["positive"], {c.bare: masked})["phrase"],
            "_n": nearest_before(before, c.negative_before, lim["negative_before"])["phrase"],
            "_u": nearest_before(before, c.uncertain_before, lim["uncertain_before"]).isNotNull()
            | F.coalesce(first_after(after, c.uncertain_after) <= lim["uncertain_after"], F.lit(False)),
            "_nf": F.coalesce(first_after(after, c.negative_after) <= lim["negative_after"], F.lit(False)),
            "_po": F.coalesce(first_after(after, c.possessive) <= lim["possessive"], F.lit(False)),
            "_h": F.contains(before, F.lit(c.holder_word)) & tx.any_term(before, list(c.other_holders)),
            "_d": F.coalesce(default_present, F.lit(False)) if default_present is not None else F.lit(False),
        }
    )
    has_pos, has_neg = F.col("_p").isNotNull(), F.col("_n").isNotNull()
    real_neg = has_neg & ~F.coalesce((F.col("_p") == c.bare) & F.col("_n").endswith(c.bare), F.lit(False))
    nearer = after_last(before, F.col("_p")) <= after_last(before, F.col("_n"))
    def judged(name: str, value: float) -> Column:
        return F.struct(F.lit(name).alias("s"), F.lit(value).alias("c"))

    verdict = (
        F.when(F.col("_h") | F.col("_u"), judged("uncertain", 0.72))
        .when(has_pos & F.col("_nf"), judged("contradicted", 0.82))
        .when(real_neg & has_pos & nearer, judged("present", 0.86))
        .when(real_neg, judged("missing", 0.88))
        .when(F.col("_nf"), judged("missing", 0.80))
        .when(has_pos, judged("present", 0.90))
        .when(F.col("_po") & ~has_neg, judged("present", 0.85))
        .when(F.col("_d"), judged("present", 0.78))
        .otherwise(judged("uncertain", 0.45))
    )
    return measured.withColumn("_v", verdict).select(
        *found.columns, F.col("_v.s").alias("status"), F.col("_v.c").alias("status_confidence")
    )


def merge_facts(facts: DataFrame) -> DataFrame:
    """One verdict per text and item: contradicted > missing > present > uncertain."""
    status, conf = F.col("status"), F.col("status_confidence")

    def best(name: str) -> Column:
        return F.max(F.when(status == name, conf))

    grouped = facts.groupBy("text_id", "evidence_id").agg(
        F.count(F.lit(1)).alias("mentions"),
        best("contradicted").alias("_c"), best("missing").alias("_m"), best("present").alias("_p"), F.max(conf).alias("_a"),
    )
    clash = F.col("_c").isNotNull() | (F.col("_m").isNotNull() & F.col("_p").isNotNull())
    return grouped.select(
        "text_id", "evidence_id", "mentions",
        F.when(clash, "contradicted").when(F.col("_m").isNotNull(), "missing")
        .when(F.col("_p").isNotNull(), "present").otherwise("uncertain").alias("status"),
        F.when(clash, F.lit(0.8)).otherwise(F.coalesce("_m", "_p", "_a")).alias("status_confidence"),
    )


def assess_gaps(texts: DataFrame, merged: DataFrame, required: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Every required item of a text's domain with its status.

    ``texts``: ``text_id, domain, has_input``; ``required``: ``(domain,
    evidence_id, priority)``, a closed rule list.
    """
    table = F.array(
        *[F.struct(F.lit(d).alias("domain"), F.lit(e).alias("evidence_id"), F.lit(p).alias("priority")) for d, e, p in required]
    )
    wanted = texts.select(
        "text_id", "has_input", F.explode(F.filter(table, lambda s: s["domain"] == F.col("domain"))).alias("r")
    ).select("text_id", "has_input", F.col("r.evidence_id").alias("evidence_id"), F.col("r.priority").alias("priority"))
    silent = F.when(~F.col("has_input") | (F.col("priority") == "high"), "missing").otherwise("uncertain")
    joined = wanted.join(merged.select("text_id", "evidence_id", "status", "status_confidence"), ["text_id", "evidence_id"], "left")
    return joined.select(
        "text_id", "evidence_id", "priority",
        F.coalesce("status", silent).alias("status"),
        F.coalesce("status_confidence", F.when(silent == "missing", 0.0).otherwise(0.35)).alias("status_confidence"),
    )


def coverage(assessed: DataFrame) -> DataFrame:
    """Weighted share of required evidence that is present, and the gaps."""
    weights = F.create_map(*[F.lit(x) for kv in rules.PRIORITY_WEIGHTS.items() for x in kv])
    w = F.coalesce(weights[F.col("priority")], F.lit(1.0))
    share = (
        F.when(F.col("status") == "present", 1.0)
        .when(F.col("status") == "contradicted", rules.CONTRADICTED_SHARE)
        .when(F.col("status") == "uncertain", rules.UNCERTAIN_SHARE)
        .otherwise(0.0)
    )
    return assessed.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("required"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("present", "missing", "uncertain", "contradicted")],
        F.count_if((F.col("priority") == "high") & (F.col("status") != "present")).alias("priority_gaps"),
        F.round(F.least(F.sum(w * share) / F.sum(w), F.lit(1.0)), 6).alias("coverage"),
    )


def consistent_advice(advice: DataFrame, present: DataFrame, acquire: Sequence[str], mark: str) -> DataFrame:
    """Advice to obtain what is already there is reworded; repeats are dropped.

    ``advice``: ``text_id, place, advice``; ``present``: ``text_id, alias``.
    """
    low = tx.fold_accents(F.col("advice"))
    asks = tx.any_term(low, acquire)
    owned = present.groupBy("text_id").agg(F.collect_set("alias").alias("aliases"))
    joined = advice.join(owned, "text_id", "left")
    clash = asks & F.coalesce(F.exists("aliases", lambda a: F.contains(low, a)), F.lit(False))
    reworded = F.when(clash, F.concat(F.lit(mark), "advice")).otherwise(F.col("advice"))
    rows = joined.select("text_id", "place", clash.alias("reworded"), reworded.alias("advice"))
    return rows.groupBy("text_id", tx.normalize(F.col("advice")).alias("key")).agg(
        F.min("place").alias("place"), F.min_by("advice", "place").alias("advice"), F.bool_or("reworded").alias("reworded")
    ).drop("key")


def contradicting_sentences(prose: DataFrame, present: DataFrame, acquire: Sequence[str], copies: Sequence[str]) -> DataFrame:
    """Sentences that ask for evidence already present, and the cleaned prose.

    Sentences about copies are exempt.  ``prose``: ``text_id, text``.
    """
    owned = present.groupBy("text_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    joined = prose.join(owned, "text_id", "left")
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?\n])"), lambda s: F.trim(s)), lambda s: s != "")

    def wrong(s: Column) -> Column:
        low = tx.fold_accents(s)
        return (
            tx.any_term(low, acquire) & ~tx.any_term(low, copies)
            & F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(low, a))
        )

    return joined.withColumn("_s", parts).select(
        "text_id", F.size("_s").alias("sentences"), F.size(F.filter("_s", wrong)).alias("flagged"),
        F.array_join(F.filter("_s", lambda s: ~wrong(s)), " ").alias("clean"),
    )


def detect_stage(df: DataFrame, text_col: str, keywords: Sequence[tuple[str, Sequence[str]]], default: str = rules.DEFAULT_STAGE) -> DataFrame:
    """Adds ``stage, stage_index, stage_confidence, progress``; ties go to the earlier stage."""
    label, hits, total = tx.best_label(F.lower(F.col(text_col)), keywords, default)
    order = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(keywords) for x in (s, i)])
    last = max(len(keywords) - 1, 1)
    scored = df.withColumns({"stage": label, "_h": hits, "_t": total})
    index = F.coalesce(order[F.col("stage")], F.lit(1))
    return scored.withColumns(
        {
            "stage_index": index,
            "stage_confidence": F.when(F.col("_h") == 0, F.lit(0.4)).otherwise(
                F.round(F.least(F.lit(0.95), F.col("_h") / F.greatest(F.col("_t"), F.lit(1)) + 0.3), 6)
            ),
            "progress": F.round(index / last * 100, 0).cast("int"),
        }
    ).drop("_h", "_t")


def risk_scores(cases: DataFrame, stage_risk: dict[str, int], default: int = 40) -> DataFrame:
    """Stage base + missing coverage + priority gaps, at most 100, with bands.

    ``cases``: ``text_id, stage, coverage, priority_gaps``.
    """
    table = F.create_map(*[F.lit(x) for kv in stage_risk.items() for x in kv])
    score = F.least(
        F.lit(100.0),
        F.coalesce(table[F.col("stage")], F.lit(default))
        + (F.lit(1.0) - F.col("coverage")) * rules.COVERAGE_PENALTY
        + F.col("priority_gaps") * rules.GAP_PENALTY,
    )
    return cases.withColumn("risk_score", F.round(score, 4)).withColumn(
        "risk_level", banded(F.col("risk_score"), rules.RISK_BANDS, "low")
    )


def _of_key(key: Column, table: dict, entry) -> Column:
    """The literal list of a key in a small rule table; an empty list for other keys."""
    full = {k: F.array(*[entry(e) for e in rows]) for k, rows in table.items() if rows}
    some = next(iter(full.values()))
    chain = None
    for name, rows in full.items():
        chain = F.when(key == name, rows) if chain is None else chain.when(key == name, rows)
    return chain.otherwise(F.slice(some, 1, 0))


def stage_outlook(
    staged: DataFrame, order: Sequence[str] = tuple(rules.STAGES), deadlines: dict = rules.DEADLINES, alerts: dict = rules.ALERTS,
) -> DataFrame:
    """Adds ``next_stage, deadlines array<struct<what, number, unit>>, alerts`` to rows with ``stage, stage_index``.

    The last stage is its own next one.  The tables are closed, so they become
    literal lists and no join.  A stage without entries has empty lists.
    """
    following = F.element_at(F.array(*map(F.lit, order)), F.least(F.col("stage_index") + 2, F.lit(len(order))))
    due = lambda e: F.struct(*[F.lit(v).alias(n) for n, v in zip(("what", "number", "unit"), e)])
    return staged.withColumns(
        {"next_stage": following, "deadlines": _of_key(F.col("stage"), deadlines, due), "alerts": _of_key(F.col("stage"), alerts, F.lit)}
    )


def stated_facts(text: Column, cues: Sequence[str], extra: Column | None = None, limit: int = 6) -> Column:
    """Clauses of over 15 characters that contain a cue, then extra facts of over 5 not yet among them; at most ``limit``.

    Case does not matter.  A clause that is stated twice counts twice, as facts in
    the text are taken as they stand; an extra fact is added once.
    """
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?;,\n]+"), lambda s: F.trim(s))
    own = F.filter(parts, lambda s: (F.length(s) > 15) & tx.any_term(F.lower(s), cues))
    if extra is None:
        return F.slice(own, 1, limit)
    given = F.filter(F.coalesce(extra, F.array().cast("array<string>")), lambda s: F.length(s) > 5)
    low = lambda a: F.transform(a, lambda s: F.lower(s))
    new = F.filter(given, lambda s, i: ~F.array_contains(low(own), F.lower(s)) & (F.array_position(low(given), F.lower(s)) == i + 1))
    return F.slice(F.concat(own, new), 1, limit)


def stage_risk_level(stage: Column) -> Column:
    """The risk class that a stage alone stands for."""
    return F.when(stage.isin(rules.HIGH_RISK_STAGES), "high").when(stage.isin(rules.MEDIUM_RISK_STAGES), "medium").otherwise("low")


def risk_report(
    cases: DataFrame, assessed: DataFrame, strengths: dict = rules.STRENGTHS, weaknesses: dict = rules.WEAKNESSES,
    taken_back: Sequence[str] = tuple(rules.TAKEN_BACK), little: str = rules.LITTLE_EVIDENCE,
) -> DataFrame:
    """``text_id, strengths, weaknesses, missing_points, warnings``: what speaks for and against each case.

    ``cases``: ``text_id, domain, text, stage, coverage, priority_gaps, risk_score,
    risk_level``; ``assessed``: as ``assess_gaps`` gives it.  Present evidence (at
    most three, by id) is the strength; only without any do words of the domain
    count, unless a word that takes them back stands before.  Weaknesses are the
    domain's words, two uncertain and two contradicted items, or ``little`` when
    there are none and the score is 50 or more.  Lists hold entries of closed rule
    tables, so they are bounded; a case without requirements has none of them.
    """
    ids = lambda status, n: F.slice(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("evidence_id")))), 1, n)
    listed = assessed.groupBy("text_id").agg(
        ids("present", 3).alias("_p"), ids("uncertain", 2).alias("_u"), ids("contradicted", 2).alias("_c"), ids("missing", 6).alias("_m")
    )
    low = F.lower(F.coalesce("text", F.lit("")))
    said = lambda word: F.contains(low, F.lit(word)) & ~tx.any_term(low, [t + word for t in taken_back])
    named = lambda words, label, test: F.when(functools.reduce(lambda a, b: a | b, [test(w) for w in words]), F.lit(label))
    from_words = lambda table, test: F.array_compact(_of_key(F.col("domain"), table, lambda e: named(*e, test)))
    none = F.array().cast("array<string>")
    got = lambda c: F.coalesce(c, none)
    marked = lambda mark, c: F.transform(got(c), lambda e: F.concat(F.lit(mark), e))
    joined = cases.join(listed, "text_id", "left").withColumn(
        "_w", F.concat(
            from_words(weaknesses, lambda w: F.contains(low, F.lit(w))), marked("uncertain:", F.col("_u")), marked("contradicted:", F.col("_c"))
        ),
    )
    warnings = F.array_compact(F.array(
        F.when(F.col("risk_level").isin("high", "critical"), "high_risk"), F.when(F.col("coverage") < 0.4, "weak_evidence"),
        F.when(F.col("stage").isin(rules.COURT_STAGES), "court"), F.when(F.col("priority_gaps") >= 3, "priority_gaps"),
    ))
    return joined.select(
        "text_id",
        F.when(F.size(got(F.col("_p"))) > 0, marked("present:", F.col("_p"))).otherwise(from_words(strengths, said)).alias("strengths"),
        F.when((F.size("_w") == 0) & (F.col("risk_score") >= 50), F.array(F.lit(little))).otherwise(F.col("_w")).alias("weaknesses"),
        got(F.col("_m")).alias("missing_points"), warnings.alias("warnings"),
    )


def journey(cases: DataFrame) -> DataFrame:
    """Milestone states and the overall risk of a case.

    ``cases``: ``text_id, stage_index, coverage, priority_gaps``.
    """
    shortfall = F.greatest(F.lit(0), F.floor((F.lit(0.6) - F.col("coverage")) * 50).cast("int"))
    score = F.col("stage_index") * 10 + F.col("priority_gaps") * 20 + shortfall
    level = banded(F.col("journey_score"), rules.JOURNEY_BANDS, "low")
    return cases.withColumn("journey_score", score).withColumns(
        {
            "journey_risk": level,
            "evidence_milestone": F.when(F.col("coverage") >= 0.7, "done").when(F.col("coverage") >= 0.4, "in_progress").otherwise("pending"),
            "risk_milestone": F.when(level == "high", "warning").when(level == "medium", "in_progress").otherwise("done"),
        }
    )


def action_plan(candidates: DataFrame) -> DataFrame:
    """Deduplicated actions in three priority buckets.

    ``candidates``: ``text_id, place, step, priority``; the first place of a
    repeated step decides.
    """
    first = candidates.groupBy("text_id", "step").agg(F.min_by("priority", "place").alias("priority"), F.min("place").alias("place"))
    def bucket(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("priority") == name, F.struct("place", "step"))))
        return F.array_join(F.transform(rows, lambda s: s["step"]), "; ").alias(name)
    return first.groupBy("text_id").agg(bucket("immediate"), bucket("important"), bucket("optional"))


def compliance(cases: DataFrame, templates: dict[str, Sequence[tuple[str, str, Sequence[str]]]], fallback: str) -> DataFrame:
    """Checklist score per case: an item is covered when a keyword occurs.

    ``cases``: ``text_id, template_key, text``; ``templates``: key to rows of
    ``(item, priority, keywords)``; unknown keys use the fallback template.
    """
    low = F.lower("text")
    key = F.when(F.col("template_key").isin(*templates), F.col("template_key")).otherwise(F.lit(fallback))
    chain = None
    for name, rows in templates.items():
        missing = F.array(
            *[F.struct((~tx.any_term(low, words)).alias("missing"), F.lit(p).alias("priority")) for _, p, words in rows]
        )
        chain = F.when(F.col("template") == name, missing) if chain is None else chain.when(F.col("template") == name, missing)
    judged = cases.withColumn("template", key).withColumn("_i", chain)
    gaps = F.size(F.filter("_i", lambda s: s["missing"]))
    critical = F.size(F.filter("_i", lambda s: s["missing"] & (s["priority"] == "critical")))
    return judged.select(
        "text_id", "template", F.size("_i").alias("items"), gaps.alias("missing"), critical.alias("critical"),
        F.round(F.lit(1.0) - gaps / F.size("_i"), 6).alias("score"),
    )
