"""Deciding what an unknown skill name means, and undoing such a decision.

Decisions are ``(match_key, name, decision, skill_id, confidence, reason, model)``; a proposal is a
name with the decision to take: ``alias``, ``new`` or ``pending``.
"""

from __future__ import annotations

import difflib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.operators.ingest import assign_ids
from hiregrain.operators.merges import ALIAS_FIELDS, Taxonomy, apply_merges, file_keys
from hiregrain.operators.taxonomy import CURATED, EXTRACTED, lookup, mark_blocked, resolve, usage
from hiregrain.plans.blocks import best_matches
from hiregrain.plans.graphs import components
from hiregrain.plans.skew import first_per_key
from hiregrain.session import materialize

NEAREST = 10
NEW_CONFIDENCE = 0.7
ALIAS_CONFIDENCE = 0.9


def undecided(names: DataFrame, decisions: DataFrame, order: str = "seq") -> DataFrame:
    """One row per undecided match key, with its first spelling."""
    keyed = names.select(T.match_key("name").alias("key"), "name", order)
    fresh = keyed.join(decisions.select(F.col("match_key").alias("key")), "key", "left_anti")
    return first_per_key(fresh, ["key"], [order]).select("key", "name")


def score_ratio(queries: pd.DataFrame, items: pd.DataFrame, k: int) -> pd.DataFrame:
    """Ratcliff-Obershelp ratio of the ``k`` most similar keys; an upper bound on each skips the rest."""
    keys, others = queries["value"].tolist(), items["value"].tolist()
    letters = {c: i for i, c in enumerate(sorted(set().union(*keys, *others)))}

    def counts(texts: list[str]) -> np.ndarray:
        table = np.zeros((len(texts), max(1, len(letters))), np.int16)
        for row, text in enumerate(texts):
            for c in text:
                table[row, letters[c]] += 1
        return table

    item_counts, lengths = counts(others), np.array([len(o) for o in others])
    number = items["item_id"].to_numpy()
    found = []
    for query_id, key, own in zip(queries["query_id"], keys, counts(keys), strict=True):
        # Letters in common bound the ratio from above for all items at once; the best bounds are tried first.
        bounds = 2.0 * np.minimum(item_counts, own).sum(axis=1) / np.maximum(lengths + len(key), 1)
        matcher = difflib.SequenceMatcher(None, "", "")
        best: list[tuple[float, int]] = []  # (score, -item id), the worst kept pair on top
        for at in np.argsort(-bounds, kind="stable"):
            if len(best) == k and bounds[at] < best[0][0]:
                break
            other = others[at]
            if other == key:
                continue
            matcher.set_seqs(key, other)
            entry = (matcher.ratio(), -int(number[at]))
            if len(best) < k:
                heapq.heappush(best, entry)
            else:
                heapq.heappushpop(best, entry)
        found += [(query_id, -negative, score) for score, negative in best]
    return pd.DataFrame(found, columns=["query_id", "item_id", "score"])


def nearest_skills(names: DataFrame, skills: DataFrame, k: int = NEAREST) -> DataFrame:
    """``(key, skill_id, score, rank)``: the most similar skills per unknown key, never the same key."""
    queries = names.select(F.col("key").alias("query_id"), F.col("key").alias("value"))
    items = skills.select(F.col("id").alias("item_id"), T.match_key("canonical_name").alias("value"))
    found = best_matches(queries, items, score_ratio, k)
    return found.select(F.col("query_id").alias("key"), F.col("item_id").alias("skill_id"), "score", "rank")


def candidate_test(pairs: DataFrame, skills: DataFrame, nearest: DataFrame) -> DataFrame:
    """Add ``is_candidate`` to ``(key, skill_id)``: a curated skill of another key, or one of the nearest.

    Every curated skill is a candidate of every name, so that list is tested, never written out.
    """
    target = skills.select(F.col("id").alias("skill_id"), T.match_key("canonical_name").alias("_key"), "origin")
    near = nearest.select("key", "skill_id", F.lit(True).alias("_near"))
    return (
        pairs.join(target, "skill_id", "left")
        .join(near, ["key", "skill_id"], "left")
        .withColumn(
            "is_candidate",
            F.coalesce((F.col("_key") != F.col("key")) & ((F.col("origin") == CURATED) | F.col("_near")), F.lit(False)),
        )
        .withColumn("is_itself", F.coalesce(F.col("_key") == F.col("key"), F.lit(False)))
        .drop("_key", "_near", "origin")
    )


def target_spellings(skills: DataFrame, aliases: DataFrame, definitions: DataFrame) -> DataFrame:
    """Names that count for a blocked pair with a skill: its own, its aliases, its file canonical."""
    own = skills.select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("spelling"))
    keyed = own.withColumn("key", T.match_key("spelling")).join(file_keys(definitions), "key")
    return (
        own.unionByName(aliases.select("skill_id", F.col("alias").alias("spelling")))
        .unionByName(keyed.select("skill_id", F.col("file_canonical").alias("spelling")))
        .distinct()
    )


def with_blocked(pairs: DataFrame, spellings: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Add ``blocked`` to ``(key, name, skill_id)`` pairs."""
    hits = (
        mark_blocked(pairs.select("key", "name", "skill_id").join(spellings, "skill_id"), "name", "spelling", blocklist)
        .where("blocked")
        .select("key", "skill_id", F.lit(True).alias("blocked"))
        .distinct()
    )
    return pairs.join(hits, ["key", "skill_id"], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def decide(
    answers: DataFrame, skills: DataFrame, aliases: DataFrame, definitions: DataFrame, blocklist: DataFrame,
    nearest: DataFrame, new_confidence: float = NEW_CONFIDENCE, alias_confidence: float = ALIAS_CONFIDENCE,
) -> DataFrame:
    """Turn model answers ``(key, name, answer, skill_id, confidence, category, reason)`` into proposals."""
    tested = with_blocked(candidate_test(answers, skills, nearest), target_spellings(skills, aliases, definitions), blocklist)
    answer, sure = F.col("answer"), F.col("confidence")
    says_new = ((answer == "new") & F.col("skill_id").isNull()) | ((answer == "same_as") & F.col("is_itself"))
    says_alias = (answer == "same_as") & F.col("is_candidate") & ~F.col("blocked") & (sure >= alias_confidence)
    decision = (
        F.when(says_new, F.when(sure >= new_confidence, "new").otherwise("pending"))
        .when(says_alias, "alias")
        .otherwise("pending")
    )
    return tested.withColumn("decision", decision).select(
        "key", "name", "decision",
        F.when((F.col("decision") != "new") & F.col("is_candidate"), F.col("skill_id")).alias("skill_id"),
        "confidence", "category", "reason",
    )


def complete_batches(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of batches that return every requested key exactly once and nothing else."""
    asked = requests.groupBy("batch", "key").agg(F.count("*").alias("_asked"))
    got = answers.groupBy("batch", "key").agg(F.count("*").alias("_got"))
    bad = (
        asked.join(got, ["batch", "key"], "full_outer")
        .where("_asked is null or _got is null or _got <> 1")
        .select("batch")
        .distinct()
    )
    return answers.join(bad, "batch", "left_anti")


def consolidate(proposals: DataFrame, skills: DataFrame, aliases: DataFrame, definitions: DataFrame, job_skills: DataFrame) -> DataFrame:
    """Point every alias of a connected group at one canonical skill.

    Canonical: curated, then a spelling of the alias file, then most used, then lowest id. The
    proposal that names the canonical itself becomes ``new``.
    """
    chosen = materialize(
        resolve(
            proposals.where("decision = 'alias' and skill_id is not null").withColumnRenamed("skill_id", "_target").drop("key"),
            lookup(skills, aliases),
        ).withColumnRenamed("skill_id", "_own")
    )
    ends = chosen.select("key", F.explode(F.array_compact(F.array("_own", "_target"))).alias("skill_id")).distinct()
    grouped = materialize(components(ends, "skill_id", "key"))
    file_canonical = definitions.select(T.match_key("canonical").alias("_key")).distinct().withColumn("_file", F.lit(True))
    ranked = (
        grouped.join(skills.select(F.col("id").alias("skill_id"), "origin", T.match_key("canonical_name").alias("_key")), "skill_id", "left")
        .join(file_canonical, "_key", "left")
        .join(usage(job_skills), "skill_id", "left")
        .select(
            "component", "skill_id",
            F.coalesce((F.col("origin") != CURATED).cast("int"), F.lit(1)).alias("_o1"),
            F.col("_file").isNull().cast("int").alias("_o2"),
            (-F.coalesce("links", F.lit(0))).alias("_o3"),
        )
    )
    canonical = first_per_key(ranked, ["component"], ["_o1", "_o2", "_o3", "skill_id"]).select(
        "component", F.col("skill_id").alias("_canonical")
    )
    pointed = (
        chosen.join(grouped.withColumnRenamed("skill_id", "_target"), "_target")
        .join(canonical, "component")
        .withColumn("decision", F.when(F.col("_own") == F.col("_canonical"), "new").otherwise("alias"))
        .withColumn("skill_id", F.when(F.col("decision") == "alias", F.col("_canonical")))
        .select(*proposals.columns)
    )
    rest = proposals.where("not (decision = 'alias' and skill_id is not null)")
    return rest.select(*proposals.columns).unionByName(pointed)


def apply_decisions(
    state: Taxonomy, proposals: DataFrame, definitions: DataFrame, blocklist: DataFrame, *, model: str | None = None,
    replace_pending: bool = False,
) -> tuple[Taxonomy, DataFrame]:
    """Carry out consolidated proposals; returns the new state and the proposals that were refused.

    A name that has a decision is refused, unless a pending one may be replaced; so is an alias whose
    target is missing or blocked.
    """
    previous = state.decisions.select(F.col("match_key").alias("key"), F.col("decision").alias("_before"))
    spellings = target_spellings(state.skills, state.aliases, definitions)
    checked = with_blocked(proposals, spellings, blocklist).join(previous, "key", "left")
    checked = checked.join(state.skills.select(F.col("id").alias("skill_id"), F.lit(True).alias("_exists")), "skill_id", "left")
    decided = F.col("_before").isNotNull()
    if replace_pending:
        decided = decided & (F.col("_before") != "pending")
    bad_target = (F.col("decision") == "alias") & (F.col("_exists").isNull() | F.col("blocked"))
    checked = materialize(checked.withColumn("_refused", decided | bad_target))
    refused = checked.where("_refused").select(*proposals.columns)
    usable = checked.where("not _refused").select(*proposals.columns)
    owned = resolve(usable.drop("key").withColumnRenamed("skill_id", "_target"), lookup(state.skills, state.aliases))
    owned = materialize(owned.withColumnRenamed("skill_id", "_own"))
    alias = owned.where("decision = 'alias'")
    # Groups to merge: the target, plus the skill that carried the name so far.
    targets = alias.select(F.col("_target").alias("skill_id"), F.col("_target").alias("keep_id"))
    absorbed = alias.where("_own is not null and _own <> _target").select(F.col("_own").alias("skill_id"), F.col("_target").alias("keep_id"))
    members = targets.unionByName(absorbed).distinct()
    named = members.join(state.skills.select(F.col("id").alias("skill_id"), "canonical_name"), "skill_id")
    display = (
        state.skills.select(F.col("id").alias("keep_id"), F.col("canonical_name").alias("_name"))
        .withColumn("key", T.match_key("_name"))
        .join(file_keys(definitions), "key", "left")
        .select("keep_id", F.coalesce("file_canonical", "_name").alias("keep_name"))
    )
    plan = named.join(display, "keep_id").withColumn("affected", F.lit(0).cast("long"))
    provenance = alias.select(F.col("name").alias("alias"), F.col("confidence").cast("decimal(3,2)").alias("confidence"), "reason")
    merged = apply_merges(state, plan.select("skill_id", "canonical_name", "keep_id", "keep_name", "affected"), blocklist, source="llm", confidence=provenance)
    learned = alias.select(
        F.col("_target").alias("skill_id"), F.col("name").alias("alias"), F.lit("llm").alias("source"),
        F.col("confidence").cast("decimal(3,2)").alias("confidence"), "reason",
    )
    merged.aliases = (
        merged.aliases.join(learned.select("alias"), "alias", "left_anti").select(*ALIAS_FIELDS).unionByName(learned.select(*ALIAS_FIELDS))
    )
    fresh = owned.where("decision <> 'alias'")
    created = assign_ids(fresh.where("_own is null").select("key", "name", "decision", "category"), state.skills, ["name"])
    category = fresh.where("decision = 'new' and _own is not null").groupBy(F.col("_own").alias("id")).agg(F.max("category").alias("_category"), F.lit(True).alias("_set"))
    merged.skills = (
        merged.skills.join(category, "id", "left")
        .withColumn("category", F.when(F.col("_set"), F.col("_category")).otherwise(F.col("category")))
        .select(*state.skills.columns)
        .unionByName(
            created.select(
                "id", F.col("name").alias("canonical_name"), F.when(F.col("decision") == "new", F.col("category")).alias("category"),
                F.lit(EXTRACTED).alias("origin"),
            )
        )
    )
    outcome = (
        owned.join(created.select("key", F.col("id").alias("_created")), "key", "left")
        .select(
            F.col("key").alias("match_key"), "name", "decision",
            F.when(F.col("decision") == "alias", F.col("_target")).otherwise(F.coalesce("_own", "_created")).alias("skill_id"),
            F.col("confidence").cast("decimal(3,2)").alias("confidence"), "reason", F.lit(model).cast("string").alias("model"),
        )
    )
    kept = merged.decisions.join(outcome.select("match_key"), "match_key", "left_anti")
    merged.decisions = kept.select(*outcome.columns).unionByName(outcome)
    return merged, refused


def review_list(decisions: DataFrame, decision: str | None = None) -> DataFrame:
    return decisions if decision is None else decisions.where(F.col("decision") == decision)


def approve_pending(requests: DataFrame, state: Taxonomy) -> DataFrame:
    """Proposals from ``(name, canonical)`` requests on pending decisions with another existing target."""
    pending = state.decisions.where("decision = 'pending'").select(F.col("match_key").alias("_pending"), F.col("name").alias("_name"), F.col("skill_id").alias("_current"))
    wanted = requests.withColumn("_pending", T.match_key("name")).join(pending, "_pending")
    found = resolve(wanted, lookup(state.skills, state.aliases), "canonical")
    return found.where("skill_id is not null and not (skill_id <=> _current)").select(
        F.col("_pending").alias("key"), F.col("_name").alias("name"), F.lit("alias").alias("decision"), "skill_id",
        F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("category"), F.lit("Approved by reviewer.").alias("reason"),
    )


def keep_pending_as_new(decisions: DataFrame, names: DataFrame) -> DataFrame:
    keep = names.select(T.match_key("name").alias("match_key")).distinct().withColumn("_keep", F.lit(True))
    hit = F.col("_keep").isNotNull() & (F.col("decision") == "pending")
    return (
        decisions.join(keep, "match_key", "left")
        .withColumn("reason", F.when(hit, F.lit("Kept as a distinct skill by reviewer.")).otherwise(F.col("reason")))
        .withColumn("decision", F.when(hit, F.lit("new")).otherwise(F.col("decision")))
        .select(*decisions.columns)
    )


def revert_aliases(state: Taxonomy, names: DataFrame) -> tuple[Taxonomy, DataFrame]:
    """Undo learned aliases; returns the new state and ``(alias, affected)`` link counts.

    Links that mention the alias move to its own skill. A link whose remaining evidence still names
    the canonical skill keeps that evidence and is doubled instead.
    """
    wanted = names.select(T.match_key("name").alias("key")).distinct()
    undone = state.aliases.where("source = 'llm'").withColumn("key", T.match_key("alias")).join(wanted, "key", "left_semi")
    undone = undone.join(state.decisions.select(F.col("match_key").alias("key")), "key", "left_semi")
    undone = materialize(undone.select("key", "alias", F.col("skill_id").alias("canonical_id")))
    own = state.skills.select(F.col("id").alias("own_id"), F.col("canonical_name").alias("alias"))
    missing = undone.join(own, "alias", "left_anti")
    created = assign_ids(missing.select("alias"), state.skills, ["alias"]).select(F.col("id").alias("own_id"), "alias")
    undone = materialize(undone.join(own.unionByName(created), "alias"))
    links = state.job_skills
    hit = (
        links.join(undone.withColumnRenamed("canonical_id", "skill_id"), "skill_id")
        .where(T.mentions("evidence_text", "alias"))
        .withColumn(
            "_left",
            F.regexp_replace(
                F.regexp_replace(T.casefold(T.collapse("evidence_text")), T.phrase_pattern(T.casefold(T.collapse("alias"))), F.lit("")),
                r"^[ ;]+|[ ;]+$", "",
            ),
        )
    )
    hit = materialize(hit)
    spelled = (
        state.skills.select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("wording"))
        .unionByName(state.aliases.select("skill_id", F.col("alias").alias("wording")))
    )
    still = (
        hit.join(spelled, "skill_id")
        .where((F.col("wording") != F.col("alias")) & T.mentions("_left", "wording"))
        .select("id", "alias")
        .distinct()
        .withColumn("_still", F.lit(True))
    )
    present = links.select("job_id", F.col("skill_id").alias("own_id"), "requirement_type", F.lit(True).alias("_present")).distinct()
    judged = materialize(
        hit.join(still, ["id", "alias"], "left").join(present, ["job_id", "own_id", "requirement_type"], "left")
    )
    trimmed = judged.where("_still").select("id", F.col("_left").alias("_trim"))
    moved = judged.where("_still is null").select("id", F.col("_present").alias("_drop"), F.col("own_id").alias("_to"))
    changed = (
        links.join(trimmed, "id", "left")
        .join(moved, "id", "left")
        .where("_drop is null")
        .withColumn("evidence_text", F.coalesce("_trim", "evidence_text"))
        .withColumn("skill_id", F.coalesce("_to", "skill_id"))
        .select(*links.columns)
    )
    doubled = judged.where("_still and _present is null").select(
        "job_id", F.col("own_id").alias("skill_id"), "requirement_type", F.col("alias").alias("evidence_text")
    )
    added = assign_ids(doubled, links, ["job_id", "skill_id", "requirement_type"]).select(*links.columns)
    skills = state.skills.unionByName(
        created.select(
            F.col("own_id").alias("id"), F.col("alias").alias("canonical_name"), F.lit(None).cast("string").alias("category"),
            F.lit(EXTRACTED).alias("origin"),
        ).select(*state.skills.columns)
    )
    rejected = undone.select(F.col("key").alias("match_key"), F.col("own_id").alias("_own"))
    decisions = (
        state.decisions.join(rejected, "match_key", "left")
        .withColumn("decision", F.when(F.col("_own").isNotNull(), F.lit("rejected")).otherwise(F.col("decision")))
        .withColumn("reason", F.when(F.col("_own").isNotNull(), F.lit("Alias reverted by reviewer.")).otherwise(F.col("reason")))
        .withColumn("skill_id", F.coalesce("_own", "skill_id"))
        .select(*state.decisions.columns)
    )
    aliases = state.aliases.join(undone.select("alias"), "alias", "left_anti").select(*state.aliases.columns)
    affected = undone.join(hit.groupBy("alias").agg(F.count("*").alias("affected")), "alias", "left").select(
        "alias", F.coalesce("affected", F.lit(0)).alias("affected")
    )
    return Taxonomy(skills, aliases, changed.unionByName(added), decisions), affected
