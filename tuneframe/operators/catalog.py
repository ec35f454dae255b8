"""Catalog queries over dataset, model, library and run tables.

Filters, sorts and top-k are plain DataFrame operations (``orderBy().limit``
plans as TakeOrderedAndProject: each task keeps k rows). Joins go through
the size check of :mod:`tuneframe.functions.joins`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.functions.joins import join_small, attach_row

# Quality bands of the dataset list.
QUALITY_RED_BELOW, QUALITY_AMBER_BELOW = 50.0, 80.0


def quality_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), "n/a")
        .when(score < QUALITY_RED_BELOW, "red")
        .when(score < QUALITY_AMBER_BELOW, "amber")
        .otherwise("green")
    )


def list_datasets(registry: DataFrame) -> DataFrame:
    """Summary rows with the quality band, newest first."""
    return registry.withColumn("quality_band", quality_band(F.col("quality_score"))).orderBy(
        F.col("created_at").desc()
    )


def is_vision(tags: Column, repo_id: Column) -> Column:
    """A tag containing vision (case-sensitive), vl (any case) or
    image-text; or a repo id containing llava, -vl or vision (any case)."""
    tag_hit = F.exists(
        F.coalesce(tags, F.array().cast("array<string>")),
        lambda t: t.contains("vision") | F.lower(t).contains("vl") | t.contains("image-text"),
    )
    rid = F.lower(repo_id)
    return tag_hit | rid.contains("llava") | rid.contains("-vl") | rid.contains("vision")


def list_models(models: DataFrame, bookmarked_only: bool = False, vision: bool | None = None) -> DataFrame:
    """Optional equality filters, newest first."""
    out = models
    if bookmarked_only:
        out = out.filter(F.col("bookmarked"))
    if vision is not None:
        out = out.filter(F.col("is_vision") == F.lit(bool(vision)))
    return out.orderBy(F.col("created_at").desc())


def recent_models(models: DataFrame, limit: int = 10) -> DataFrame:
    """Recently used models (a top-k)."""
    return models.filter(F.col("last_used_at").isNotNull()).orderBy(F.col("last_used_at").desc()).limit(int(limit))


def list_runs(runs: DataFrame) -> DataFrame:
    """C4: newest first, the larger id first on ties."""
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc())


def _truthy(c: Column, dtype: str) -> Column:
    if dtype == "string":
        return F.nullif(c, F.lit(""))
    if dtype in ("bigint", "int", "double"):
        return F.nullif(c, F.lit(0))
    return c


def upsert_models(current: DataFrame, downloads: DataFrame) -> DataFrame:
    """New repos are inserted; existing ones get the new path and
    downloaded=true, other fields only from truthy new values; is_vision is
    computed on insert only; further columns of ``current`` stay, renewed by a
    non-null value of the same name. A repo that comes more than once counts by
    its last ``_order``, without that column by its largest row. A full outer
    join on ``repo_id`` makes the new snapshot."""
    fields = ["architecture", "param_count", "context_length", "license"]
    types = dict(current.dtypes)
    rest = [c for c in downloads.columns if c not in ("repo_id", "_order")]
    first = ["_order"] if "_order" in downloads.columns else []
    one = downloads.groupBy("repo_id").agg(F.max(F.struct(*first, *rest)).alias("_d")).select("repo_id", "_d.*")
    c, d = current.alias("c"), one.alias("d")
    j = c.join(d, on="repo_id", how="full_outer")
    new = F.col("c.display_name").isNull() & F.col("c.is_vision").isNull()
    cols = [F.col("repo_id")]
    cols.append(
        F.coalesce(F.nullif(F.col("d.display_name"), F.lit("")), F.col("c.display_name"), F.col("repo_id")).alias("display_name")
    )
    for f in fields:
        cols.append(F.coalesce(_truthy(F.col(f"d.{f}"), types.get(f, "string")), F.col(f"c.{f}")).alias(f))
    vision_new = is_vision(F.col("d.tags"), F.col("repo_id"))
    cols.append(F.when(new, vision_new).otherwise(F.col("c.is_vision")).alias("is_vision"))
    cols.append(F.coalesce(F.col("d.local_path"), F.col("c.local_path")).alias("local_path"))
    cols.append((F.col("d.local_path").isNotNull() | F.coalesce(F.col("c.downloaded"), F.lit(False))).alias("downloaded"))
    cols.append(F.coalesce(F.col("c.bookmarked"), F.lit(False)).alias("bookmarked"))
    known = {"repo_id", "display_name", *fields, "is_vision", "local_path", "downloaded", "bookmarked"}
    for x in [x for x in current.columns if x not in known]:
        cols.append((F.coalesce(F.col(f"d.{x}"), F.col(f"c.{x}")) if x in rest else F.col(f"c.{x}")).alias(x))
    return j.select(*cols)


def search_models(models: DataFrame, query: str, pipeline_tag: str = "text-generation", limit: int = 20) -> DataFrame:
    """Substring search inside one pipeline tag, top by downloads."""
    q = query.lower()
    hit = (F.col("pipeline_tag") == pipeline_tag) & F.lower(F.col("repo_id")).contains(q)
    return models.filter(hit).orderBy(F.col("downloads").desc(), F.col("repo_id")).limit(int(limit))


def catalog_with_library(catalog: DataFrame, library: DataFrame) -> DataFrame:
    """Every catalog row with downloaded/bookmarked flags (false when absent).

    The library is reduced to one row per repo first (the last by ``_order``;
    without that column a flag set in any of them holds), then left-joined;
    broadcast only when its estimated size is small.
    """
    last = F.max_by(F.struct("downloaded", "bookmarked"), F.col("_order"))
    either = F.struct(F.max("downloaded").alias("downloaded"), F.max("bookmarked").alias("bookmarked"))
    lib = library.groupBy("repo_id").agg((last if "_order" in library.columns else either).alias("_l"))
    j = join_small(catalog, lib, on="repo_id", how="left")
    return j.select(
        *catalog.columns,
        F.coalesce(F.col("_l.downloaded"), F.lit(False)).alias("downloaded"),
        F.coalesce(F.col("_l.bookmarked"), F.lit(False)).alias("bookmarked"),
    )


def runs_with_dataset(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Resolve each run's dataset (inner equi-join)."""
    return runs.join(datasets, on="dataset_id", how="inner")


def orphan_runs(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Runs whose dataset does not exist (left anti join)."""
    return runs.join(datasets.select("dataset_id"), on="dataset_id", how="left_anti")


def dashboard(runs: DataFrame, models: DataFrame) -> DataFrame:
    """One row of counts."""
    r = runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status").isin("running", "preparing")).alias("active_runs"),
        F.count_if(F.col("status") == "completed").alias("completed_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
    )
    m = models.agg(
        F.count(F.lit(1)).alias("total_models"),
        F.count_if(F.col("downloaded")).alias("downloaded_models"),
    )
    return attach_row(r, m)


def newest_runs(runs: DataFrame, n: int = 6) -> DataFrame:
    """The newest runs (a top-k)."""
    return runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(int(n))
