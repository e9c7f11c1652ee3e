"""Model registry over append-only logs.

  model_versions (name, version, run_id, path, size, framework, registered_at, seq)
  stage_events   (name, version, seq, stage, ts, reason)
  tag_log        (name, version, seq, key, value)
  tombstones     (name, version[, seq])   with seq, only what was logged up to it is gone: the number may be used again
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import base_name, framework, suffix
from ..session import cut_lineage
from .runs import without_deleted
from .ranks import latest_by, previous_in_group, running_total

ID = ["name", "version"]


def live(versions: DataFrame, tombstones: DataFrame | None) -> DataFrame:
    """Versions, stage events or tags without what tombstones cover."""
    return without_deleted(versions, tombstones, ID)


def register_models(batch: DataFrame, existing: DataFrame, catalog: DataFrame) -> DataFrame:
    """Number a batch (name, seq, path, run_id, version, stage, ts) as if registered one by one.

    A row without version gets the highest version so far plus one.  With ``autos`` as the
    running count of such rows, that is autos + max(highest existing, explicit - autos at
    that explicit row) over the rows before: two running folds instead of a loop.  Rows
    without file, and explicit versions already taken, come back with a ``reason``.
    """
    files = catalog.filter(~F.col("is_dir")).select("path", F.col("size").alias("_size"))
    sized = batch.join(files, "path", "left")
    missing = sized.filter("_size IS NULL").withColumn("reason", F.lit("model file not found"))
    top = existing.groupBy("name").agg(F.max("version").alias("_top"))
    usable = sized.filter("_size IS NOT NULL").join(top, "name", "left")
    order = [F.col("seq")]
    auto = F.when(F.col("version").isNull(), 1).otherwise(0).cast("bigint")
    counted = running_total(usable, ["name"], order, auto, "_autos")
    floor = F.greatest(F.coalesce(F.col("_top"), F.lit(0)), F.col("version") - F.col("_autos")).cast("bigint")
    folded = running_total(counted, ["name"], order, floor, "_floor", how="max")
    numbered = folded.withColumn("_asked", F.col("version").isNotNull()).withColumn(
        "version", F.coalesce(F.col("version"), F.col("_autos") + F.col("_floor")).cast("bigint"))
    # Versions of the batch that occur twice or already exist: the earliest holder keeps them.
    firsts = numbered.groupBy(*ID).agg(F.min("seq").alias("_first"))
    held = existing.select(*ID).distinct().withColumn("_held", F.lit(True))
    decided = numbered.join(firsts.join(held, ID, "left"), ID)
    taken = F.col("_held").isNotNull() | (F.col("seq") > F.col("_first"))
    columns = ["name", "version", "run_id", "path", "size", "framework", "registered_at", "seq", "stage", "reason"]

    def shaped(df: DataFrame) -> DataFrame:
        return df.select("name", F.col("version").cast("bigint").alias("version"), "run_id", "path",
                         F.col("_size").alias("size"), framework(suffix(base_name(F.col("path")))).alias("framework"),
                         F.col("ts").alias("registered_at"), "seq", "stage", "reason").select(*columns)

    return shaped(decided.withColumn("reason", F.when(taken, "version already exists"))).unionByName(shaped(missing))


def initial_stages(registered: DataFrame) -> DataFrame:
    """First stage event of every accepted registration."""
    return registered.filter("reason IS NULL").select(
        *ID, "seq", "stage", F.col("registered_at").alias("ts"), F.lit(None).cast("string").alias("reason"))


def stage_history(stage_events: DataFrame) -> DataFrame:
    """Stage events in order with the stage they came ``from_stage``: one row per event."""
    return previous_in_group(stage_events, ID, "seq", "stage", "from_stage")


def current_stage(stage_events: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    return latest_by(live(stage_events, tombstones), ID, "seq", ["stage", "reason"]).select(
        *ID, "stage", F.col("reason").alias("deprecation_reason"))


def promote_models(batch: DataFrame, stage_events: DataFrame, versions: DataFrame) -> DataFrame:
    """Stage events to append from (name, version, seq, stage, ts[, reason]); unknown versions get an ``error``."""
    if "reason" not in batch.columns:
        batch = batch.withColumn("reason", F.lit(None).cast("string"))
    known = versions.select(*ID).distinct()
    good = batch.join(known, ID, "left_semi").select(*stage_events.columns).withColumn("_new", F.lit(True))
    # only the history of what is promoted
    past = stage_events.join(good.select(*ID).distinct(), ID, "left_semi").select(*stage_events.columns)
    moved = stage_history(past.withColumn("_new", F.lit(False)).unionByName(good)).filter("_new").drop("_new")
    bad = batch.join(known, ID, "left_anti").select(*stage_events.columns).withColumn(
        "from_stage", F.lit(None).cast("string"))
    return moved.withColumn("error", F.lit(None).cast("string")).unionByName(
        bad.withColumn("error", F.lit("model/version not found")))


def deprecate_models(batch: DataFrame, stage_events: DataFrame, versions: DataFrame) -> DataFrame:
    """Promotion to ``deprecated`` with a reason, from (name, version, seq, ts, reason)."""
    return promote_models(batch.withColumn("stage", F.lit("deprecated")), stage_events, versions)


def tag_models(batch: DataFrame, versions: DataFrame) -> DataFrame:
    """Tag rows to append; unknown versions get an ``error``."""
    known = versions.select(*ID).distinct().withColumn("_known", F.lit(True))
    return batch.join(known, ID, "left").withColumn(
        "error", F.when(F.col("_known").isNull(), "model/version not found")).drop("_known")


def current_tags(tag_log: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """(name, version, key, value): last value per key."""
    return latest_by(live(tag_log, tombstones), [*ID, "key"], "seq", ["value"]).select(*ID, "key", "value")


def delete_model_versions(versions: DataFrame, ids: DataFrame, seq: Column | int | None = None,
                          tombstones: DataFrame | None = None) -> DataFrame:
    """Tombstones for the versions that exist; unknown and already deleted ones get an ``error``.

    ``seq`` is the place of the delete in the logs; without it the number can never be used again.
    """
    known = live(versions, tombstones).select(*ID).distinct().withColumn("_known", F.lit(True))
    place = [] if seq is None else [(F.lit(seq) if isinstance(seq, int) else seq).cast("bigint").alias("seq")]
    return ids.select(*ID).distinct().join(known, ID, "left").select(
        *ID, *place, F.when(F.col("_known").isNull(), "model/version not found").alias("error"))


def list_models(versions: DataFrame, stage_events: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """(name, version_count, latest_version, current_stage) per model, by name.

    The versions themselves are rows of ``versions``; they are not packed into one list.
    """
    folded = live(versions, tombstones).groupBy("name").agg(
        F.count(F.lit(1)).alias("version_count"), F.max("version").alias("version"))
    return (folded.join(current_stage(stage_events, tombstones), ID, "left")
            .select("name", "version_count", F.col("version").alias("latest_version"),
                    F.coalesce("stage", F.lit("unknown")).alias("current_stage"))
            .orderBy("name"))


def model_versions_with_files(versions: DataFrame, catalog: DataFrame, stage_events: DataFrame,
                              tombstones: DataFrame | None = None) -> DataFrame:
    """Versions with stage, ``file_exists`` and the size on disk (else the recorded one)."""
    files = catalog.filter(~F.col("is_dir")).select("path", F.col("size").alias("_disk"))
    return (live(versions, tombstones).join(files, "path", "left").join(current_stage(stage_events, tombstones), ID, "left")
            .select(*ID, "stage", "run_id", "path", F.coalesce("_disk", "size").alias("size"), "framework",
                    F.col("_disk").isNotNull().alias("file_exists"), "deprecation_reason"))


def model_facts(info: DataFrame, tags: DataFrame, latest_metrics: DataFrame) -> DataFrame:
    """(name, version, field, value): what a comparison looks at, as text."""
    basic = info.select(*ID, F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in ("size", "stage", "framework")])))
    tagged = tags.select(*ID, F.concat(F.lit("tags."), "key").alias("field"), "value")
    scored = info.select(*ID, "run_id").join(latest_metrics.select("run_id", "key", "value"), "run_id").select(
        *ID, F.concat(F.lit("latest_run_metrics."), "key").alias("field"), F.col("value").cast("string").alias("value"))
    return basic.unionByName(tagged).unionByName(scored)


def compare_model_versions(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, version_a, version_b, field, a, b) for every pair (name, version_a, version_b)."""
    def side(which: str, other: str) -> DataFrame:
        one = pairs.join(facts.withColumnRenamed("version", f"version_{which}"), ["name", f"version_{which}"])
        return one.select("name", "version_a", "version_b", "field", F.col("value").alias(which),
                          F.lit(None).cast("string").alias(other))

    facts = cut_lineage(facts)  # both sides read the facts once made
    both = side("a", "b").unionByName(side("b", "a"))
    return both.groupBy("name", "version_a", "version_b", "field").agg(F.max("a").alias("a"), F.max("b").alias("b"))


def model_lineage(versions: DataFrame, runs: DataFrame, params: DataFrame) -> DataFrame:
    """(name, version, run_id, run_status, dataset_hint): parameters that mention data, one per row."""
    hints = params.filter(F.lower("key").contains("data")).select(
        "run_id", F.concat_ws("=", "key", "value").alias("dataset_hint"))
    return (versions.select(*ID, "run_id").join(runs.select("run_id", F.col("status").alias("run_status")), "run_id", "left")
            .join(hints, "run_id", "left").select(*ID, "run_id", "run_status", "dataset_hint"))
