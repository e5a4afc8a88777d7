"""Cleaning, validation, hashing and deduplication of raw postings.

A raw posting is a row of string columns plus ``record_no`` (its 1-based number in the file). All
operators are lazy except the two deduplications, which iterate when rows carry two keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiregrain.functions import text as T
from hiregrain.plans.graphs import keep_first_on_both

# Accepted spellings of field names, and the typed fields of a posting.
FIELD_ALIASES = {
    "job_description": "description",
    "description_text": "description",
    "raw_description": "description",
    "company_name": "company",
    "min_experience": "experience_years_min",
}
SKILL_FIELDS = ["required_skills", "preferred_skills", "technical_skills"]
TEXT_FIELDS = ["title", "company", "location", "employment_type", "description", "source_url", "experience"]
RECORD_FIELDS = [*TEXT_FIELDS, "experience_years_min", *SKILL_FIELDS, "source_record_hash"]
MODEL_FIELDS = ["title", "company", "location", "employment_type", "description", "source_url", "technical_skills"]
URL = r"(?i)^https?://[^\s/?#]+([/?#]\S*)?$"
MAX_URL_CHARS = 2083


def rename_fields(raw: DataFrame) -> DataFrame:
    """Map accepted spellings to field names; of two columns for one field the later one wins."""
    target: dict[str, list[str]] = {}
    for name in raw.columns:
        key = " ".join(name.split())
        if key.casefold() in T.MISSING:
            continue
        target.setdefault(FIELD_ALIASES.get(key.casefold(), key), []).append(name)
    return raw.select(*[F.col(f"`{names[-1]}`").alias(field) for field, names in target.items()])


def clean_records(raw: DataFrame) -> DataFrame:
    """Normalize every text field, null the missing markers, keep line breaks between skills."""
    renamed = rename_fields(raw)
    kinds = dict(renamed.dtypes)
    present = set(renamed.columns)
    added = [F.lit(None).cast("string").alias(f) for f in RECORD_FIELDS if f not in present]
    cleaned = []
    for name in renamed.columns:
        column = F.col(f"`{name}`")
        if kinds[name] == "string":
            column = T.clean_lines(column) if name in SKILL_FIELDS else T.clean(column)
        elif kinds[name] == "array<string>":
            column = T.clean_array(T.nfkc_items(column))
        elif kinds[name] == "map<string,string>":
            column = clean_map(column)
        cleaned.append(column.alias(name))
    return renamed.select(*cleaned, *added)


def clean_map(extra: Column) -> Column:
    """Further fields of a record with clean names and values, in the order of their names."""
    entries = F.transform(F.map_entries(extra), lambda e: F.struct(T.collapse(e["key"]).alias("key"), T.null_if_missing(T.collapse(e["value"])).alias("value")))
    return F.when(extra.isNotNull(), ordered_map(entries))


def ordered_map(entries: Column) -> Column:
    """A map in the order of its keys; of several values for one key the last counts."""
    latest = F.reverse(entries)
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(latest, lambda e: e["key"] == n), F.lit(0))["value"]))


def canonical_url(url: Column) -> Column:
    """One spelling of a URL: scheme and host in lower case, no default port, ``/`` for an empty path."""
    form = r"^([A-Za-z]+)://([^/?#]*)([^?#]*)(.*)$"
    scheme, host, path, rest = (F.regexp_extract(url, form, i) for i in (1, 2, 3, 4))
    scheme = F.lower(scheme)
    port = F.when(scheme == "https", F.lit(":443")).otherwise(F.lit(":80"))
    host = F.lower(host)
    host = F.when(F.endswith(host, port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(url.rlike(form), F.concat(scheme, F.lit("://"), host, path, rest)).otherwise(url)


def check(records: DataFrame, rules: list[tuple[str, Column, str]]) -> tuple[DataFrame, DataFrame]:
    """Split rows by ``(field, failed, message)`` rules into good rows and ``(record, error)``.

    The error names the first failed rule; a bad row never stops the others.
    """
    failed = F.filter(
        F.array(
            *[
                F.when(F.coalesce(condition, F.lit(False)), F.lit(f"{field}: {message}"))
                for field, condition, message in rules
            ]
        ),
        lambda x: x.isNotNull(),
    )
    marked = records.withColumn("_error", F.get(failed, F.lit(0)))
    good = marked.where("_error is null").drop("_error")
    return good, marked.where("_error is not null").select(F.col("record_no").alias("record"), F.col("_error").alias("error"))


def raw_rules() -> list[tuple[str, Column, str]]:
    url = F.col("source_url")
    return [
        ("description", F.col("description").isNull() | (F.col("description") == ""), "description is required"),
        ("source_url", url.isNotNull() & ~(url.rlike(URL) & (F.length(url) <= MAX_URL_CHARS)), "not a valid http(s) URL"),
    ]


def extracted_rules() -> list[tuple[str, Column, str]]:
    return [
        ("title", F.col("title").isNull() | (F.trim("title") == ""), "title is required"),
        ("experience_years_min", F.col("experience_years_min") < 0, "must not be negative"),
        *raw_rules(),
    ]


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON object with sorted keys, nulls kept and no spaces."""
    members = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.to_json(members, {"ignoreNullFields": "false"})


def raw_hash(records: DataFrame) -> Column:
    """SHA-256 of the cleaned record; a supplied lower-case 64-digit hash wins.

    ``record_no`` is not part of the record.
    """
    names = [c for c in records.columns if c != "record_no"]
    computed = F.sha2(canonical_json({n: F.col(f"`{n}`") for n in names}), 256)
    supplied = F.col("source_record_hash")
    return F.when(supplied.rlike(r"^[0-9a-f]{64}\z"), supplied).otherwise(computed)


def content_hash() -> Column:
    """SHA-256 of what makes two extracted postings the same job."""
    folded = {n: T.casefold(n) for n in ("title", "company", "location", "employment_type")}
    rest = {"experience_years_min": F.col("experience_years_min"), "description": T.collapse("description")}
    return F.sha2(canonical_json({**folded, **rest}), 256)


def without_stored(rows: DataFrame, stored: DataFrame | None, *keys: str) -> DataFrame:
    """Drop rows sharing any of the keys with stored rows; a null key matches nothing."""
    if stored is not None:
        for key in keys:
            known = stored.where(F.col(key).isNotNull()).select(key).distinct()
            rows = rows.join(known, key, "left_anti")
    return rows


def drop_duplicates_on(rows: DataFrame, stored: DataFrame | None, hash_key: str) -> DataFrame:
    """Rows to keep in record order: neither hash nor url stored, nor claimed by an earlier kept row.

    Both sides are read once for their keys, which are written out: each of the passes over them would clean and hash
    the texts again. Rows of nothing but keys are not read a second time.
    """
    from hiregrain.session import materialize

    keys = ["record_no", hash_key, "source_url"]
    if stored is not None:
        stored = materialize(stored.select(hash_key, canonical_url(F.col("source_url")).alias("source_url")))
    rows = rows.withColumn("source_url", canonical_url(F.col("source_url")))
    claims = materialize(rows.select(*keys))
    fresh = without_stored(claims, stored, hash_key, "source_url")
    keep = keep_first_on_both(fresh, "record_no", hash_key, "source_url")
    if set(rows.columns) != set(keys):
        fresh = without_stored(rows, stored, hash_key, "source_url")
    return fresh.join(keep, "record_no", "left_semi").select(*rows.columns)


def extract_structured(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings whose own fields already name skills, and the rows left for a model.

    Required skills fall back to ``technical_skills``. A digit string counts as years of experience,
    so a CSV column behaves like a JSON number.
    """
    kinds = dict(records.dtypes)
    technical, required, preferred = (T.skill_items(f, kinds[f]) for f in ("technical_skills", "required_skills", "preferred_skills"))
    parsed = (
        records.withColumn("_required", F.when(F.size(required) > 0, required).otherwise(technical))
        .withColumn("_preferred", preferred)
        .withColumn(
            "_years",
            F.coalesce(
                F.col("experience_years_min").cast("string").try_cast("int"), T.parse_experience("experience")
            ),
        )
    )
    usable = F.coalesce(
        F.col("title").isNotNull()
        & F.col("description").isNotNull()
        & (F.size("_required") + F.size("_preferred") > 0),
        F.lit(False),
    )
    done = parsed.where(usable).select(
        *[c for c in records.columns if c not in ("required_skills", "preferred_skills", "experience_years_min")],
        F.col("_years").alias("experience_years_min"),
        F.col("_required").alias("required_skills"),
        F.col("_preferred").alias("preferred_skills"),
    )
    return done, parsed.where(~usable).select(*records.columns)


def keep_source_facts(model_output: DataFrame, records: DataFrame) -> DataFrame:
    """Model output per record with everything the source states put back in place."""
    facts = records.select(
        "record_no", *[F.col(f).alias(f"_{f}") for f in ("title", "company", "location", "employment_type", "source_url", "description")]
    )
    joined = model_output.join(facts, "record_no")
    stated = {f: F.coalesce(F.nullif(F.col(f"_{f}"), F.lit("")), F.col(f)) for f in ("title", "location", "employment_type", "source_url")}
    return joined.select(
        "record_no",
        *[column.alias(name) for name, column in stated.items()],
        F.col("_company").alias("company"),
        F.col("_description").alias("description"),
        *[c for c in model_output.columns if c not in {"record_no", "company", "description", *stated}],
    )


def evidence_text() -> Column:
    """The text in which a posting's skills must be named; skills may be text or a list."""
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")), F.concat_ws(" ", F.col("technical_skills")))


def model_request() -> Column:
    """The only fields of a record that are sent to a model."""
    return F.to_json(F.struct(*MODEL_FIELDS), {"ignoreNullFields": "false"})


def add_companies(companies: DataFrame, postings: DataFrame) -> DataFrame:
    """Existing companies plus one row per new case-insensitive name, ids following the highest."""
    named = postings.where(F.col("company").isNotNull()).withColumn("_key", F.lower("company"))
    new = (
        named.groupBy("_key")
        .agg(F.min_by("company", "record_no").alias("name"), F.min("record_no").alias("_first"))
        .join(companies.select(F.lower("name").alias("_key")), "_key", "left_anti")
    )
    return companies.select("id", "name").unionByName(assign_ids(new, companies, ["_first"]).select("id", "name"))


def assign_ids(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Give rows the ids after the highest existing one, in order, without a single-task sort.

    Rows are range-partitioned by ``order``; each partition numbers its own rows after the rows of the
    partitions before it.
    """
    highest = existing.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("m"))
    return numbered(new, order, "_n").withColumn("id", F.col("_n") + highest.scalar()).drop("_n")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in global order; only one count per partition is gathered."""
    from hiregrain.session import materialize

    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    from pyspark.sql import Window

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_at", "_part", "_before")
    )


@dataclass
class Import:
    """Tables of one import: inserted postings, quarantined rows, and the fate of every record."""

    postings: DataFrame
    quarantine: DataFrame
    fates: DataFrame

    def summary(self) -> DataFrame:
        return summarize(self.fates)


def summarize(fates: DataFrame) -> DataFrame:
    """Counters of an import from one row per record with its ``fate`` and ``path``."""
    fate, path = F.col("fate"), F.col("path")
    return fates.agg(
        F.count("*").alias("processed"),
        F.count_if(fate == "inserted").alias("inserted"),
        F.count_if(fate.isin("known", "duplicate")).alias("skipped_duplicates"),
        F.count_if(fate == "failed").alias("failed"),
        F.count_if(fate == "known").alias("skipped_before_model"),
        F.count_if(path == "structured").alias("deterministic"),
        F.count_if(path == "model").alias("model_records"),
    )


def import_postings(raw: DataFrame, stored: DataFrame | None = None, extract=None) -> Import:
    """Clean, validate, deduplicate and extract a batch of postings against the stored ones.

    ``stored`` has ``raw_hash``, ``content_hash`` and ``source_url``. ``extract`` is an optional
    ``DataFrame -> DataFrame`` for records without structured skills that returns ``record_no``,
    ``title``, ``company``, ``location``, ``employment_type``, ``source_url``,
    ``experience_years_min``, ``required_skills`` and ``preferred_skills``; records it does not
    return have failed. A failed record has still claimed its keys, as a later copy is no retry.
    """
    from hiregrain.session import materialize

    cleaned = clean_records(raw)
    cleaned = materialize(cleaned.withColumn("raw_hash", raw_hash(cleaned)))
    valid, invalid = check(cleaned, raw_rules())
    prepared = materialize(drop_duplicates_on(valid, stored, "raw_hash"))
    structured, pending = extract_structured(prepared)
    columns = [
        "record_no", "title", "company", "location", "employment_type", "description", "source_url",
        "experience_years_min", "required_skills", "preferred_skills", "raw_hash", "evidence",
    ]
    prepared_evidence = prepared.select("record_no", "raw_hash", evidence_text().alias("evidence"))
    done = structured.withColumn("evidence", evidence_text()).select(*columns)
    failed = pending.select("record_no")
    if extract is not None:
        answered = keep_source_facts(extract(pending), pending).join(prepared_evidence, "record_no").select(*columns)
        answered = materialize(answered)
        failed = failed.join(answered, "record_no", "left_anti")
        done = done.unionByName(answered)
    good, bad = check(done, extracted_rules())
    good = materialize(good.withColumn("content_hash", content_hash()))
    inserted = materialize(drop_duplicates_on(good, stored, "content_hash"))
    quarantine = (
        invalid.unionByName(bad)
        .unionByName(failed.select(F.col("record_no").alias("record"), F.lit("no structured posting could be made of the record").alias("error")))
    )
    fates = (
        cleaned.select("record_no")
        .join(quarantine.select(F.col("record").alias("record_no"), F.lit(1).alias("_bad")), "record_no", "left")
        .join(prepared.select("record_no", F.lit(1).alias("_prepared")), "record_no", "left")
        .join(inserted.select("record_no", F.lit(1).alias("_inserted")), "record_no", "left")
        .join(pending.select("record_no", F.lit(1).alias("_pending")), "record_no", "left")
        .select(
            "record_no",
            F.when(F.col("_bad").isNotNull(), "failed")
            .when(F.col("_inserted").isNotNull(), "inserted")
            .when(F.col("_prepared").isNotNull(), "duplicate")
            .otherwise("known")
            .alias("fate"),
            F.when(F.col("_pending").isNotNull(), "model").when(F.col("_prepared").isNotNull(), "structured").alias("path"),
        )
    )
    return Import(inserted, quarantine, fates)
