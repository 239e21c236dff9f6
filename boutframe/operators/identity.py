"""Entity resolution between a primary and a secondary source: a chain of conservative rules, each auditable.

The first rule whose guard holds takes a row, also when its inner check then fails. Keys are computed once; uniqueness is
a count over the key; joins are on keys that are unique on the primary side, so nothing fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutframe.functions.text import canonical_id, cleaned_name_key, dob_status, name_key

PRIMARY, SECONDARY = "ufcstats", "sherdog"
CLOSE = ("near", "month_day_swap", "same_year_close")


class OverrideError(ValueError):
    """Manual overrides contradict each other or point nowhere."""


def normalize_overrides(raw: DataFrame, primary: str = PRIMARY, secondary: str = SECONDARY) -> DataFrame:
    """Valid overrides only: decisions in lower case; approved and rejected have a target, accepted_unresolved has none."""
    rows = raw.select(
        F.coalesce("source", F.lit(secondary)).alias("source"), "source_fighter_id", F.coalesce("target_source", F.lit(primary)).alias("target_source"), "target_source_fighter_id",
        F.lower(F.trim("decision")).alias("decision"),
    )
    target = F.nullif(F.trim("target_source_fighter_id"), F.lit("")).isNotNull()
    right = (F.col("decision").isin("approved", "rejected") & target) | ((F.col("decision") == "accepted_unresolved") & ~target)
    valid = (F.col("source") == secondary) & (F.col("target_source") == primary) & F.col("source_fighter_id").isNotNull() & right
    return rows.where(valid).dropDuplicates(["source", "source_fighter_id", "target_source_fighter_id", "decision"])


def check_overrides(overrides: DataFrame, primary_ids: DataFrame) -> None:
    """Raise on two approved targets, two primary decisions, or an approved target that doesn't exist, in this order."""
    approved = overrides.where("decision = 'approved'")
    if not approved.groupBy("source_fighter_id").agg(F.count_distinct("target_source_fighter_id").alias("n")).where("n > 1").isEmpty():
        raise OverrideError("more than one approved target for a fighter")
    main = overrides.where("decision in ('approved', 'accepted_unresolved')")
    if not main.groupBy("source_fighter_id").agg(F.count_distinct("decision").alias("n")).where("n > 1").isEmpty():
        raise OverrideError("more than one decision for a fighter")
    if not approved.join(primary_ids, approved["target_source_fighter_id"] == primary_ids["source_fighter_id"], "left_anti").isEmpty():
        raise OverrideError("an approved target does not exist")


def with_keys(fighters: DataFrame) -> DataFrame:
    """Name keys, and how often each key occurs in the row's source; rows without a key each count once, and so don't meet in one task."""
    rows = fighters.withColumns({"exact_key": name_key(F.col("full_name")), "clean_key": cleaned_name_key(F.col("full_name"))})
    rows = rows.withColumns({k: F.nullif(F.col(k), F.lit("")) for k in ("exact_key", "clean_key")})
    sizes = {}
    for key in ("exact", "clean"):
        apart = F.when(F.col(f"{key}_key").isNull(), F.col("source_fighter_id"))
        sizes[f"{key}_n"] = F.count(F.lit(1)).over(Window.partitionBy("source", f"{key}_key", apart))
        sizes[f"{key}_dob_n"] = F.count(F.lit(1)).over(Window.partitionBy("source", f"{key}_key", apart, "dob"))
    return rows.withColumns(sizes)


def link(fighters: DataFrame, overrides: DataFrame | None = None, primary: str = PRIMARY, secondary: str = SECONDARY) -> DataFrame:
    """``source, source_fighter_id, canonical_fighter_id, link_method, confidence`` of every fighter of both sources."""
    keyed = with_keys(fighters)
    main = keyed.where(F.col("source") == primary)
    rows = keyed.where(F.col("source") == secondary)
    for key in ("exact", "clean"):
        by_dob = main.where((F.col(f"{key}_dob_n") == 1) & F.col("dob").isNotNull() & F.col(f"{key}_key").isNotNull())
        by_dob = by_dob.select(F.col(f"{key}_key"), "dob", F.col("source_fighter_id").alias(f"{key}_dob_id"))
        rows = rows.join(by_dob, [f"{key}_key", "dob"], "left")
        by_name = main.where((F.col(f"{key}_n") == 1) & F.col(f"{key}_key").isNotNull())
        rows = rows.join(by_name.select(F.col(f"{key}_key"), F.col("source_fighter_id").alias(f"{key}_id"), F.col("dob").alias(f"{key}_dob")), f"{key}_key", "left")
    if overrides is None:
        rows = rows.withColumns({"approved_id": F.lit(None).cast("string"), "unresolved": F.lit(False), "rejected": F.array().cast("array<string>")})
    else:
        by_id = overrides.groupBy("source_fighter_id").agg(
            F.max(F.when(F.col("decision") == "approved", F.col("target_source_fighter_id"))).alias("approved_id"), F.bool_or(F.col("decision") == "accepted_unresolved").alias("unresolved"),
            F.collect_set(F.when(F.col("decision") == "rejected", F.col("target_source_fighter_id"))).alias("rejected"),
        )
        rows = rows.join(by_id, "source_fighter_id", "left").withColumns({"unresolved": F.coalesce("unresolved", F.lit(False)), "rejected": F.coalesce("rejected", F.array().cast("array<string>"))})
    free = lambda c: ~F.array_contains("rejected", F.col(c))
    own = F.struct(F.lit(secondary).alias("s"), F.col("source_fighter_id").alias("id"), F.lit("source_self").alias("m"), F.lit(1.0).alias("c"))
    to = lambda c, m, conf: F.struct(F.lit(primary).alias("s"), F.col(c).alias("id"), (m if not isinstance(m, str) else F.lit(m)).alias("m"), F.lit(conf).alias("c"))
    choice = F.when(F.col("approved_id").isNotNull(), to("approved_id", "manual_override", 1.0))
    choice = choice.when(F.col("unresolved"), F.struct(F.lit(secondary).alias("s"), F.col("source_fighter_id").alias("id"), F.lit("manual_unresolved").alias("m"), F.lit(1.0).alias("c")))
    for key, name, conf in (("exact", "exact_name_dob", 1.0), ("clean", "cleaned_name_dob", 0.95)):
        choice = choice.when(F.col(f"{key}_dob_id").isNotNull(), F.when(free(f"{key}_dob_id"), to(f"{key}_dob_id", name, conf)).otherwise(own))
    for key, name, conf in (("exact", "exact_name_dob_", 0.92), ("clean", "cleaned_name_dob_", 0.9)):
        status = dob_status(F.col("dob"), F.col(f"{key}_dob"))
        guard = (F.col(f"{key}_n") == 1) & F.col(f"{key}_id").isNotNull()
        choice = choice.when(guard, F.when(status.isin(*CLOSE) & free(f"{key}_id"), to(f"{key}_id", F.concat(F.lit(name), status), conf)).otherwise(own))
    chosen = choice.otherwise(own)
    linked = rows.select(F.lit(secondary).alias("source"), "source_fighter_id", canonical_id(chosen["s"], chosen["id"]).alias("canonical_fighter_id"), chosen["m"].alias("link_method"), chosen["c"].alias("confidence"))
    base = main.select("source", "source_fighter_id", canonical_id(F.lit(primary), F.col("source_fighter_id")).alias("canonical_fighter_id"), F.lit("source_self").alias("link_method"), F.lit(1.0).alias("confidence"))
    return base.unionByName(linked)


def match_reason(method: Column) -> Column:
    """Why a link method links, in words."""
    #: Fixed values.
    said = {
        "source_self": "source_self", "manual_override": "manual override approval", "manual_unresolved": "manual unresolved acceptance",
        "exact_name_dob": "exact normalized full name + exact dob", "cleaned_name_dob": "cleaned full name + exact dob",
        **{f"{key}_name_dob_{close}": f"unique {key} name + compatible dob ({close})" for key in ("exact", "cleaned") for close in CLOSE},
    }
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in said.items() for x in pair]), method)


def canonical_fighters(fighters: DataFrame, links: DataFrame, primary: str = PRIMARY) -> DataFrame:
    """Of each canonical fighter and column the first value that is known: primary source first, then by id."""
    joined = fighters.join(links, ["source", "source_fighter_id"])
    rank = F.struct(F.when(F.col("source") == primary, 0).otherwise(1), F.col("source_fighter_id"))
    columns = [c for c in fighters.columns if c not in ("source", "source_fighter_id")]
    return joined.groupBy("canonical_fighter_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns])


def resolve(rows: DataFrame, links: DataFrame, id_col: str, name: str, strict: bool = False) -> DataFrame:
    """Add the canonical id of ``source, id_col``; with ``strict`` an id without a link raises."""
    keys = links.select("source", F.col("source_fighter_id").alias(id_col), F.col("canonical_fighter_id").alias(name))
    if strict and not rows.where(F.col(id_col).isNotNull()).join(keys, ["source", id_col], "left_anti").isEmpty():
        raise KeyError(f"{id_col} without a link")
    return rows.join(keys, ["source", id_col], "left")


def review_candidates(fighters: DataFrame, links: DataFrame, primary: str = PRIMARY, secondary: str = SECONDARY) -> DataFrame:
    """Fighters of the secondary source left on their own, with the primary fighters of the same cleaned name and birth date."""
    keyed = with_keys(fighters)
    alone = links.where((F.col("source") == secondary) & (F.col("link_method") == "source_self")).select("source", "source_fighter_id")
    rows = keyed.join(alone, ["source", "source_fighter_id"], "left_semi").select("source_fighter_id", "clean_key", "dob")
    main = keyed.where(F.col("source") == primary).select(F.col("source_fighter_id").alias("candidate"), "clean_key", "dob")
    return rows.join(main, ["clean_key", "dob"]).groupBy("source_fighter_id").agg(F.expr("listagg(candidate, ';') within group (order by candidate)").alias("candidates"), F.count(F.lit(1)).alias("n"))


def review(fighters: DataFrame, links: DataFrame, overrides: DataFrame, primary: str = PRIMARY, secondary: str = SECONDARY, strict: bool = False) -> DataFrame:
    """Every fighter of the secondary source with its link, its candidates, and what was decided by hand.

    ``overrides``: source, source_fighter_id, target_source, target_source_fighter_id, decision, note, created_at_utc and
    updated_at_utc. Candidates are the primary fighters of the same cleaned name and birth date that were not rejected, for
    fighters left on their own. Links by a near birth date show as unresolved unless ``strict``, then as linked_near.
    Decisions are grouped by fighter first, so that nothing fans out.
    """
    keyed = with_keys(fighters).join(links, ["source", "source_fighter_id"])
    main = keyed.where(F.col("source") == primary).select(F.col("source_fighter_id").alias("candidate"), F.col("canonical_fighter_id").alias("candidate_canonical"), F.col("full_name").alias("candidate_name"), "clean_key", "dob")
    rows = keyed.where(F.col("source") == secondary)
    rejected = overrides.where((F.col("decision") == "rejected") & (F.col("source") == secondary) & (F.col("target_source") == primary))
    pairs = rows.where("link_method = 'source_self'").select("source_fighter_id", "clean_key", "dob").join(main, ["clean_key", "dob"])
    pairs = pairs.join(rejected.select("source_fighter_id", F.col("target_source_fighter_id").alias("candidate")), ["source_fighter_id", "candidate"], "left_anti")
    joined = lambda c, by: F.expr(f"listagg({c}, '{by}') within group (order by {c})")
    candidates = pairs.groupBy("source_fighter_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), joined("candidate", ", ").alias("candidate_source_fighter_ids"), joined("candidate_canonical", ", ").alias("candidate_canonical_fighter_ids"),
        joined("candidate_name", " | ").alias("candidate_full_names"),
    )
    approved, alone = F.col("decision") == "approved", F.col("decision") == "accepted_unresolved"
    first = lambda c: F.coalesce(F.max(F.when(approved, F.col(c))), F.max(F.when(alone, F.col(c))))
    decided = overrides.groupBy("source_fighter_id").agg(
        F.bool_or(approved).alias("is_approved"), F.bool_or(alone).alias("is_alone"), F.max(F.when(approved, F.col("target_source_fighter_id"))).alias("approved_target_source_fighter_id"),
        first("note").alias("manual_note"), first("created_at_utc").alias("manual_created_at_utc"), first("updated_at_utc").alias("manual_updated_at_utc"),
        F.count_if(F.col("decision") == "rejected").alias("rejected_pair_count"),
    )
    out = rows.join(candidates, "source_fighter_id", "left").join(decided, "source_fighter_id", "left")
    count, method = F.coalesce("candidate_count", F.lit(0)), F.col("link_method")
    status = F.when(method == "manual_override", "linked_manual").when(method == "manual_unresolved", "accepted_unresolved").when(method == "exact_name_dob", "linked_exact").when(method == "cleaned_name_dob", "linked_cleaned")
    if strict:
        status = status.when(method.rlike("^(exact|cleaned)_name_dob_"), "linked_near")
    decision = F.when(F.col("is_approved"), "approved").when(F.col("is_alone"), "accepted_unresolved").otherwise("none")
    return out.select(
        "source", "source_fighter_id", "canonical_fighter_id", "full_name", "dob", "link_method", "confidence", F.col("exact_key").alias("exact_name_key"), F.col("clean_key").alias("cleaned_name_key"), match_reason(method).alias("match_reason"),
        status.when(count > 0, "candidate_review").otherwise("unresolved").alias("review_status"), count.alias("candidate_count"), (count > 0).alias("has_candidate"),
        "candidate_source_fighter_ids", "candidate_canonical_fighter_ids", "candidate_full_names", decision.alias("decision_status"), "approved_target_source_fighter_id",
        canonical_id(F.lit(primary), F.col("approved_target_source_fighter_id")).alias("approved_target_canonical_fighter_id"),
        "manual_note", "manual_created_at_utc", "manual_updated_at_utc", F.coalesce("rejected_pair_count", F.lit(0)).alias("rejected_pair_count"),
    )


def suggestions(fighters: DataFrame, links: DataFrame, overrides: DataFrame, seen: DataFrame, primary: str = PRIMARY, secondary: str = SECONDARY) -> DataFrame:
    """Whom each fighter of the secondary source may be: primary fighters born on the same day whose exact *or* cleaned name key is equal.

    The OR is a union of two equi-joins that share no pair: the second leaves out what the first finds. Rejected pairs go, other
    decisions on a pair are shown. A decision without a target stands for all of the fighter's candidates that have none of their
    own; of several on one pair the last in the alphabet counts, so a rejection does. ``seen``: ``fighter_id`` with counts of bouts,
    by the canonical id, where there is one. As pairs may be many, decisions and counts are joined to the fighters, before these meet:
    no pair is shuffled.
    """
    keyed = with_keys(fighters)
    decided = overrides.where((F.col("source") == secondary) & (F.col("target_source") == primary))
    said = decided.groupBy("source_fighter_id", F.col("target_source_fighter_id").alias("target")).agg(F.max(F.struct("decision", "note")).alias("said"))
    said = said.groupBy("source_fighter_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("target", "said")))).alias("of_pair"), F.max(F.when(F.col("target").isNull(), F.col("said"))).alias("of_all"),
    )
    own = keyed.where((F.col("source") == secondary) & F.col("dob").isNotNull()).select("source_fighter_id", "exact_key", "clean_key", "dob").join(said, "source_fighter_id", "left")
    main = keyed.where((F.col("source") == primary) & F.col("dob").isNotNull()).join(links.where(F.col("source") == primary).select("source_fighter_id", "canonical_fighter_id"), "source_fighter_id")
    shown, counts = [c for c in ("full_name", "url") if c in fighters.columns], [c for c in seen.columns if c != "fighter_id"]
    main = main.join(seen.withColumnRenamed("fighter_id", "canonical_fighter_id"), "canonical_fighter_id", "left")
    main = main.select(F.col("source_fighter_id").alias("target_source_fighter_id"), F.col("canonical_fighter_id").alias("target_canonical_fighter_id"), *shown, *counts, F.col("exact_key").alias("their_exact"), F.col("clean_key").alias("their_clean"), "dob")
    exact = own.join(main.withColumn("exact_key", F.col("their_exact")), ["exact_key", "dob"]).withColumn("candidate_reason", F.lit("exact_name_dob"))
    clean = own.join(main.withColumn("clean_key", F.col("their_clean")), ["clean_key", "dob"]).where(~F.coalesce(F.col("exact_key") == F.col("their_exact"), F.lit(False))).withColumn("candidate_reason", F.lit("cleaned_name_dob"))
    decision = F.coalesce(F.try_element_at("of_pair", F.col("target_source_fighter_id")), F.col("of_all"))
    columns = ("target_canonical_fighter_id", "source_fighter_id", "target_source_fighter_id", *shown, "dob", "candidate_reason", decision["decision"].alias("manual_decision"), decision["note"].alias("manual_note"), *counts)
    return exact.select(*columns).unionByName(clean.select(*columns)).where("coalesce(manual_decision, '') <> 'rejected'")


def ordered_suggestions(found: DataFrame, source_fighter_id: str) -> DataFrame:
    """Those of one fighter, in the order of a review screen."""
    return found.where(F.col("source_fighter_id") == source_fighter_id).orderBy("candidate_reason", "full_name", "target_source_fighter_id")
