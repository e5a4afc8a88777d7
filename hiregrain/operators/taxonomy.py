"""Skill names: lookup, evidence, normalization of postings' skills, and taxonomy checks.

``skills`` has ``id, canonical_name, category, origin``; ``aliases`` has ``skill_id, alias`` and
provenance; ``job_skills`` has ``id, job_id, skill_id, requirement_type, evidence_text``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.operators.ingest import assign_ids
from hiregrain.plans.skew import first_per_key
from hiregrain.session import written

EXTRACTED, CURATED = "extracted", "curated"


def wordings(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every spelling of every skill: ``(skill_id, name)``."""
    return skills.select(F.col("id").alias("skill_id"), F.col("canonical_name").alias("name")).unionByName(
        aliases.select("skill_id", F.col("alias").alias("name"))
    )


def lookup(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(key, skill_id)``; the lowest skill id owns a key several skills spell."""
    names = wordings(skills, aliases)
    return names.groupBy(T.match_key("name").alias("key")).agg(F.min("skill_id").alias("skill_id"))


def resolve(claims: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Add ``skill_id``, null where no skill has a spelling with the same match key."""
    keyed = claims.withColumn("key", T.match_key(name))
    return keyed.join(known, "key", "left")


def claimed_skills(postings: DataFrame, job: str, evidence: str) -> DataFrame:
    """One row per claimed skill with ``mentioned``: is its own spelling in the evidence text.

    The test runs inside the posting's row, so the text is cut into words once and never copied per skill.
    """
    def claims(column: str, kind: str, rank: int) -> Column:
        return F.transform(
            F.coalesce(F.col(column), F.array().cast("array<string>")),
            lambda name, at: F.struct(
                F.lit(rank).alias("type_rank"), F.lit(kind).alias("requirement_type"), at.alias("pos"), T.collapse(name).alias("name")
            ),
        )

    listed = F.concat(claims("required_skills", "required", 0), claims("preferred_skills", "preferred", 1))
    kept = F.filter(listed, lambda c: (c["name"] != "") & (F.length(c["name"]) <= T.MAX_SKILL_CHARS))
    # Each step reads what the one before made more than once, so Spark keeps them apart.
    folded = postings.select(F.col(job).alias("job_id"), F.col(evidence).alias("_text"), kept.alias("_kept")).select(
        "job_id", "_text", "_kept", F.transform("_kept", lambda c: T.casefold(c["name"])).alias("_folded")
    )
    said = folded.select("job_id", "_kept", "_folded", T.named_among("_text", F.array_distinct("_folded")).alias("_said"))
    tested = F.transform("_kept", lambda c, i: F.struct(c.alias("c"), F.array_contains(F.col("_said"), F.get("_folded", i)).alias("mentioned")))
    return said.select("job_id", F.explode_outer(tested).alias("_t")).where("_t is not null").select("job_id", "_t.c.*", "_t.mentioned")


@dataclass
class NormalizedSkills:
    links: DataFrame  # job_id, skill_id, requirement_type, evidence_text
    new_skills: DataFrame  # id, canonical_name, category, origin
    unknown: DataFrame  # job_id, name; only filled in strict mode


def short_enough(name: Column | str = "name") -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return (T.word_count(name) <= T.MAX_NEW_SKILL_WORDS) & (F.length(name) <= T.MAX_NEW_SKILL_CHARS)


def normalize_skills(
    postings: DataFrame, skills: DataFrame, aliases: DataFrame, *, job: str = "record_no",
    evidence: str = "evidence", create_missing: bool = True,
) -> NormalizedSkills:
    """Link postings to skills that their own text names; required beats preferred.

    Names without a skill become extracted skills when they are short and mentioned; the first
    spelling in record order is canonical. In strict mode they are only reported.
    """
    # Keys are made once per name. Tables are written with their true sizes: where names are few, no claim is shuffled to meet them.
    claims = written(claimed_skills(postings, job, evidence))
    names = claims.select("name").distinct().select("name", T.match_key("name").alias("key"), short_enough().alias("_short"))
    names = written(names.join(lookup(skills, aliases), "key", "left"))
    candidates = claims.where("mentioned").join(names.where("skill_id is null and _short").select("name", "key"), "name")
    order = ["job_id", "type_rank", "pos"]
    if create_missing:
        first = first_per_key(candidates.select("key", "name", *order), ["key"], order)
        created = written(assign_ids(first, skills, order))
    else:
        created = candidates.limit(0).select("key", "name", *order).withColumn("id", F.lit(None).cast("long"))
    new_skills = created.select(
        "id", F.col("name").alias("canonical_name"), F.lit(None).cast("string").alias("category"), F.lit(EXTRACTED).alias("origin")
    )
    start = F.struct(*order)
    since = created.select("key", F.col("id").alias("_created"), start.alias("_from"))
    owned = written(names.join(since, "key", "left").select("name", F.coalesce("skill_id", "_created").alias("skill_id"), "_from").where("skill_id is not null"))
    # A created skill exists from the record that created it onwards.
    resolved = claims.join(owned, "name").where(F.col("_from").isNull() | (start >= F.col("_from")))
    # The first of a posting's claims of a skill gives the link. A claim not spelled in its own text counts if the text holds
    # another spelling of the skill; that is the same for all claims of the skill, and only asked where one comes first.
    claim = F.struct("type_rank", "pos", "requirement_type", "name")
    numbered = resolved.where("job_id is not null and skill_id is not null")  # as the joins below infer, so that both read one shuffle
    firsts = numbered.groupBy("job_id", "skill_id").agg(F.min(claim).alias("first"), F.min(F.when(F.col("mentioned"), claim)).alias("own"))
    open_ones = F.col("own").isNull() | (F.col("own") != F.col("first"))
    other = wordings(skills.select("id", "canonical_name").unionByName(new_skills.select("id", "canonical_name")), aliases)
    spellings = written(other.groupBy("skill_id").agg(F.collect_set(T.casefold(T.collapse("name"))).alias("_spellings")))
    # A posting's text meets all of its open skills once, as one list, and is cut into words once.
    asked = (
        firsts.where(open_ones).join(spellings, "skill_id")
        .groupBy("job_id").agg(F.collect_list(F.struct("skill_id", "first", "own", "_spellings")).alias("_asked"))
    )
    said = asked.join(postings.select(F.col(job).alias("job_id"), F.col(evidence).alias("_text")), "job_id").select(
        "job_id", "_asked", T.named_among("_text", F.array_distinct(F.flatten("_asked._spellings"))).alias("_said")
    )
    held = lambda a: F.arrays_overlap(F.col("_said"), a["_spellings"])
    decided = F.transform("_asked", lambda a: F.struct(a["skill_id"], F.when(held(a), a["first"]).otherwise(a["own"]).alias("claim")))
    # A posting that is there twice has two texts.
    reworded = said.select("job_id", F.explode(decided).alias("_d")).select("job_id", "_d.*").groupBy("job_id", "skill_id").agg(F.min("claim").alias("claim"))
    unnumbered = resolved.where("job_id is null and mentioned").groupBy("job_id", "skill_id").agg(F.min(claim).alias("claim"))
    links = (
        firsts.where(~open_ones).select("job_id", "skill_id", F.col("own").alias("claim")).unionByName(reworded).unionByName(unnumbered)
        .where("claim is not null").select("job_id", "skill_id", "claim.requirement_type", F.col("claim.name").alias("evidence_text"))
    )
    unknown = candidates.select("job_id", "name").distinct()
    return NormalizedSkills(links, new_skills, unknown if not create_missing else unknown.limit(0))


def learnable_names(claims: DataFrame, skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """Claims worth learning: mentioned, short, and not already owned by a curated skill."""
    curated = resolve(claims, lookup(skills, aliases)).join(
        skills.select(F.col("id").alias("skill_id"), "origin"), "skill_id", "left"
    )
    undecided = F.col("skill_id").isNull() | (F.col("origin") == EXTRACTED)
    return curated.where(undecided & (F.col("name") != "") & short_enough() & F.col("mentioned")).select(*claims.columns)


def definition_names(definitions: DataFrame) -> DataFrame:
    """``(canonical, name, key)`` for every spelling in the alias file."""
    spelled = definitions.select("canonical", F.explode(F.concat(F.array("canonical"), "aliases")).alias("name"))
    return spelled.withColumn("key", T.match_key("name"))


def alias_conflicts(definitions: DataFrame) -> DataFrame:
    """Keys that are empty or claimed by several canonical names; any row is an error."""
    owners = definition_names(definitions).groupBy("key").agg(
        F.min("canonical").alias("first_owner"), F.max("canonical").alias("last_owner"),
        F.count_distinct("canonical").alias("owners"),
    )
    return owners.where((F.col("owners") > 1) | (F.col("key") == ""))


def blocked_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Symmetric ``(low, high)`` match keys of name pairs that must never merge."""
    a, b = T.match_key(left), T.match_key(right)
    return pairs.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct()


def mark_blocked(pairs: DataFrame, left: str, right: str, blocklist: DataFrame) -> DataFrame:
    a, b = T.match_key(left), T.match_key(right)
    keyed = pairs.withColumn("low", F.least(a, b)).withColumn("high", F.greatest(a, b))
    return (
        keyed.join(blocklist.withColumn("_hit", F.lit(True)), ["low", "high"], "left")
        .withColumn("blocked", F.coalesce("_hit", F.lit(False)))
        .drop("low", "high", "_hit")
    )


def usage(job_skills: DataFrame) -> DataFrame:
    return job_skills.groupBy("skill_id").agg(F.count("*").alias("links"))


def market_skills(job_skills: DataFrame) -> DataFrame:
    return job_skills.select("skill_id").distinct()


def pieces(folded: Column) -> Column:
    """Words and single marks of a text, in order."""
    return F.regexp_extract_all(folded, F.lit(rf"[{T.WORD}]+|[^{T.WORD}\s]"), F.lit(0))


def named_anywhere(texts: DataFrame, phrases: DataFrame, doc: str, text: str, phrase: str) -> DataFrame:
    """``(doc, phrase)`` for every whole-word mention of a catalog phrase in a text.

    A mention implies that the phrase's words and marks follow each other in the text, so runs of the
    lengths that occur in the catalog meet the phrases in an equi-join; then the literal test decides.
    """
    catalog = (
        phrases.select(F.col(phrase).alias("phrase"), T.casefold(T.collapse(phrase)).alias("folded"))
        .where("folded <> ''")
        .distinct()
        .withColumn("_p", pieces(F.col("folded")))
        .select("phrase", "folded", F.array_join("_p", " ").alias("gram"), F.size("_p").alias("len"))
    )
    lengths = catalog.agg(F.array_sort(F.collect_set("len")).alias("l")).scalar()
    folded = texts.select(F.col(doc).alias("doc"), F.coalesce(T.casefold(T.collapse(text)), F.lit("")).alias("_text"))
    runs = T.let(
        pieces(F.col("_text")),
        lambda w: F.flatten(
            F.transform(
                F.col("_lengths"),
                lambda n: F.when(
                    F.size(w) >= n,
                    F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")),
                ).otherwise(F.array().cast("array<string>")),
            )
        ),
    )
    keyed = folded.withColumn("_lengths", lengths).select("doc", F.explode_outer(F.array_distinct(runs)).alias("gram"))
    hits = keyed.join(catalog.select("phrase", "folded", "gram"), "gram")
    # A text meets the phrases it may hold once, as one list, so it is never copied.
    listed = hits.groupBy("doc").agg(F.collect_set(F.struct("phrase", "folded")).alias("_hits"))
    tested = F.filter("_hits", lambda h: F.contains(F.col("_spaced"), T.spaced(h["folded"])))
    return (
        listed.join(folded.select("doc", T.spaced(F.col("_text")).alias("_spaced")), "doc")
        .select(F.col("doc").alias(doc), F.explode(tested).alias("_h")).select(doc, F.col("_h.phrase").alias(phrase)).distinct()
    )
