"""Which observations describe the same unit.

Two rows match strictly if both have a rent, the rents differ by 500 at most, at
least three of six unit fields are known on both sides, and all of these agree.

No pair is ever built. A row with known fields ``A`` matches a row with known
fields ``B`` iff they agree on ``A & B``, so for each of the few field sets that
occur, rows are grouped by their values on the common fields, reduced to one
point per rent, and the best point in reach is read with a range window. Windows
are cut into rent buckets, so one holds at most ``BUCKET + 2 * 500`` points however
many copies a unit has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from sightline import constants as K
from sightline.functions.text import blank_to_null, normalize_text
from sightline.session import cut, shuffled

FIELDS = ["f_estate", "f_unit", "f_floor", "f_flat", "f_layout", "f_area"]
MIN_SHARED = 3
BUCKET = 4096


def with_fields(df: DataFrame, normalize: bool = True) -> DataFrame:
    """Adds the six unit fields (null if unknown), the set of known ones as ``mask``, and the rent to compare."""

    def text(*names: str) -> Column:
        raw = F.coalesce(*[blank_to_null(F.col(n)) for n in names if n in df.columns])
        return blank_to_null(normalize_text(raw)) if normalize else raw

    rent = "last_rent_hkd" if "last_rent_hkd" in df.columns else "rent_hkd"
    area = F.when(F.col("usable_area_sqft") != 0, F.col("usable_area_sqft").cast("string"))
    values = [text("estate_name"), text("block", "building"), text("floor"), text("flat"), text("layout"), area]
    out = df.withColumns(dict(zip(FIELDS, values)))
    mask = F.lit(0)
    for bit, name in enumerate(FIELDS):
        mask = mask + F.when(F.col(name).isNotNull(), F.lit(1 << bit)).otherwise(F.lit(0))
    return out.withColumns({"mask": mask, "rent": F.when(F.col(rent) != 0, F.col(rent))})


def strict_match(a: str, b: str) -> Column:
    """Strict match of two aliased rows prepared by ``with_fields``."""
    shared, agree = F.lit(0), F.lit(True)
    for f in FIELDS:
        both = F.col(f"{a}.{f}").isNotNull() & F.col(f"{b}.{f}").isNotNull()
        shared = shared + both.cast("int")
        agree = agree & (~both | (F.col(f"{a}.{f}") == F.col(f"{b}.{f}")))
    near = F.abs(F.col(f"{a}.rent") - F.col(f"{b}.rent")) <= K.RENT_TOLERANCE
    return F.coalesce(near & (shared >= MIN_SHARED) & agree, F.lit(False))


def _comparable(df: DataFrame) -> DataFrame:
    return df.where(F.col("rent").isNotNull() & (F.bit_count("mask") >= MIN_SHARED))


def _masks(df: DataFrame) -> list[int]:
    """Field sets that occur: 42 at most, whatever the size of the data."""
    return sorted(r.mask for r in df.select("mask").distinct().collect())


def _common_values(common: Column) -> Column:
    parts = [F.when(common.bitwiseAND(F.lit(1 << bit)) != 0, F.col(name)) for bit, name in enumerate(FIELDS)]
    return F.concat_ws("\x1f", *parts)


def _shared_sets(own: Column, masks: list[int]) -> Column:
    every = F.array(*[F.struct(F.lit(m).alias("other"), own.bitwiseAND(F.lit(m)).alias("common")) for m in masks])
    every = every.cast("array<struct<other:int,common:int>>")  # the type of an empty list
    return F.filter(every, lambda s: F.bit_count(s["common"]) >= MIN_SHARED)


PROFILE = ["mask", *FIELDS, "rent"]


def best_in_reach(probes: DataFrame, candidates: DataFrame, best: Column, probe_masks: list[int], masks: list[int]) -> DataFrame:
    """Adds the smallest ``best`` and the number of the strict matches to every probe that has one.

    Both sides are comparable rows of ``with_fields``, the probes one per profile;
    ``best`` is an orderable column of the candidates.
    """
    cols = probes.columns
    # The hash stands first in joins and sorts: one long to compare instead of texts, which still decide.
    group = ["hash", "side", "common", "vals"]
    point = [*group, "rent"]
    spread = (
        probes.withColumn("s", F.explode(_shared_sets(F.col("mask"), masks)))
        .select(*cols, F.col("s.other").alias("side"), F.col("s.common").alias("common"))
        .withColumn("vals", _common_values(F.col("common")))
        .withColumn("hash", F.xxhash64("side", "common", "vals"))
    )
    own = F.array_distinct(F.transform(_shared_sets(F.col("mask"), probe_masks), lambda s: s["common"]))
    cand = (
        candidates.select(*PROFILE, best.alias("best")).withColumn("common", F.explode(own))
        .select(F.col("mask").alias("side"), "common", _common_values(F.col("common")).alias("vals"), "rent", "best")
        .withColumn("hash", F.xxhash64("side", "common", "vals"))
        .groupBy(*point)
        .agg(F.min("best").alias("best"), F.count("*").alias("n"))
    )
    reach = F.array_distinct(
        F.array(*[F.floor((F.col("rent") + d) / BUCKET) for d in (-K.RENT_TOLERANCE, 0, K.RENT_TOLERANCE)])
    )
    asked = spread.select(*point).distinct().withColumns(
        {"best": F.lit(None).cast(cand.schema["best"].dataType), "n": F.lit(0).cast("bigint"),
         "bucket": F.floor(F.col("rent") / BUCKET), "asked": F.lit(True)}
    )
    points = cand.withColumn("bucket", F.explode(reach)).withColumn("asked", F.lit(False)).unionByName(asked)
    near = Window.partitionBy(*group, "bucket").orderBy("rent").rangeBetween(-K.RENT_TOLERANCE, K.RENT_TOLERANCE)
    found = (
        points.withColumns({"found": F.min("best").over(near), "matches": F.sum("n").over(near)})
        .where(F.col("asked") & F.col("found").isNotNull())
        .select(*point, "found", "matches")
    )
    return (
        spread.join(shuffled(found), point)
        .groupBy(*cols)
        .agg(F.min("found").alias("best"), F.sum("matches").alias("matches"))
    )


def _profiles(df: DataFrame) -> DataFrame:
    return _comparable(df).select(*PROFILE).distinct()


def _join_profile(rows: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """Back from profiles to rows; equal profiles are null-safe through a text key.

    Rows that match nothing get keys of their own by content, so that they do not meet in one partition.
    """
    key = F.concat_ws("\x1f", F.col("mask").cast("string"), F.col("rent").cast("string"), *FIELDS)
    right = found.select(key.alias("_profile"), "best", "matches")
    alone = F.concat(F.lit("\x1e"), F.xxhash64(*[f.name for f in rows.schema if isinstance(f.dataType, AtomicType)]).cast("string"))
    comparable = F.col("rent").isNotNull() & (F.bit_count("mask") >= MIN_SHARED)
    keyed = rows.withColumn("_profile", F.when(comparable, key).otherwise(alone))
    return keyed.join(shuffled(right), "_profile", how).drop("_profile")


def known_source(observations: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``listing_id`` of the source record, null for a new record."""
    return observations.join(shuffled(state.select("source_key", "listing_id")), "source_key", "left")


def same_identity(observations: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds ``exact_id``: the oldest listing with the same identity key, if it also matches strictly."""
    first = listings.groupBy("identity_key").agg(
        F.min_by(F.struct("listing_id", "rent", *FIELDS), "listing_id").alias("_first")
    )
    joined = observations.alias("a").join(shuffled(first.select("identity_key", "_first.*")).alias("b"), "identity_key", "left")
    return joined.select("a.*", F.when(strict_match("a", "b"), F.col("b.listing_id")).alias("exact_id"))


def best_candidate(observations: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds ``candidate_id``: the strict match that is active first, then seen last, then oldest; all listings compete."""
    rank = F.struct((~F.col("active")).alias("gone"), (-F.unix_micros("last_seen_at")).alias("age"), "listing_id")
    probes = cut(_profiles(observations), "probes")
    known = cut(_comparable(listings).select(*PROFILE, "active", "last_seen_at", "listing_id"), "candidates")
    found = best_in_reach(probes, known, rank, _masks(probes), _masks(known))
    return _join_profile(observations, found).withColumn("candidate_id", F.col("best.listing_id")).drop("best", "matches")


def match_summary(units: DataFrame, id_col: str) -> DataFrame:
    """Strict matches of every row within its own table: how many others, and the lowest id among them and itself.

    The pairs themselves grow with the square of the copies and are not listed.
    """
    rows = cut(_comparable(units).select(*PROFILE, id_col), "units")
    masks = _masks(rows)
    found = best_in_reach(_profiles(rows), rows, F.col(id_col), masks, masks)
    return _join_profile(units, found).withColumns(
        {"matches": F.coalesce(F.col("matches") - 1, F.lit(0)), "first_match": F.coalesce("best", F.col(id_col))}
    ).drop("best")


def leaders(units: DataFrame, id_col: str) -> DataFrame:
    """Greedy groups in id order: a row joins the first earlier leader it matches, else it leads.

    Copies share a decision, so the work is per profile. Every round decides all
    profiles whose first match in reach is themselves or a leader, at least the
    lowest open one; rounds go on until none is open. Returns ``id_col`` and ``leader``.
    """
    open_ = cut(_comparable(units).groupBy(*PROFILE).agg(F.min(id_col).alias("id")))
    masks = _masks(open_)
    led = open_.limit(0)
    groups = []
    while not open_.isEmpty():
        alive = open_.withColumn("open", F.lit(True)).unionByName(led.withColumn("open", F.lit(False)))
        found = best_in_reach(open_, alive, F.struct("id", "open"), masks, masks)
        leads = F.col("best.id") == F.col("id")
        step = cut(found.withColumns({"leads": leads, "done": leads | ~F.col("best.open")}))
        groups.append(step.where("done").select(*PROFILE, F.col("best.id").alias("best")))
        led = led.unionByName(step.where("leads").select(*open_.columns))
        open_ = step.where("not done").select(*open_.columns)
    found = units.select(*PROFILE, F.col(id_col).alias("best")).limit(0) if not groups else groups[0]
    for g in groups[1:]:
        found = found.unionByName(g)
    rows = _join_profile(units, found.withColumn("matches", F.lit(1)))
    return rows.withColumn("leader", F.coalesce("best", F.col(id_col))).drop("best", "matches")


def resolve_batch(observations: DataFrame, state: DataFrame, listings: DataFrame) -> DataFrame:
    """Listing of every observation of a batch: known source, same identity, best candidate, else a group of the batch.

    ``observations`` (obs_id, source_key, identity_key and the unit columns) are
    matched with ``listings`` as they were before the batch. All observations of a
    source record follow its first one. A new listing is named by the obs_id that
    opens it. Adds ``listing_id`` and ``resolved_by``.
    """
    known = known_source(observations, state)
    fresh = known.where("listing_id is null").drop("listing_id")
    heads = fresh.groupBy("source_key").agg(F.min("obs_id").alias("obs_id"))
    first = with_fields(fresh.join(shuffled(heads), ["source_key", "obs_id"], "left_semi"))
    old = with_fields(listings)
    tried = cut(best_candidate(same_identity(first, old), old))
    matched = F.coalesce("exact_id", "candidate_id")
    new = leaders(tried.where(matched.isNull()), "obs_id").select("source_key", F.col("leader").alias("listing_id"))
    decided = tried.where(matched.isNotNull()).select(
        "source_key", matched.alias("listing_id"),
        F.when(F.col("exact_id").isNotNull(), F.lit("identity")).otherwise(F.lit("candidate")).alias("resolved_by"),
    )
    by_key = decided.unionByName(new.withColumn("resolved_by", F.lit("batch")))
    return known.where("listing_id is not null").withColumn("resolved_by", F.lit("source")).unionByName(
        fresh.join(shuffled(by_key), "source_key")
    )


