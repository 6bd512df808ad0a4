"""Site registry: registration, retention of sites, and merging duplicate sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitfold.functions.columns import flag
from hitfold.operators.rollup import insert_new, merge
from hitfold.schema import UNIQUE_HOUR, Rollup
from hitfold.session import reliable


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in the given order, without one task seeing all rows.

    Rows are sorted by ranges and written once; the number is the position in the range plus
    the sizes of the ranges before it (one small row per range).
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumns(
            {
                "_range": F.shiftright(F.col("_m"), 33),
                "_pos": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)),
            }
        )
        .drop("_m")
    )
    stored = reliable(ranged, "numbered")
    # the window sees one row per range, that is, per shuffle partition
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        stored.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        stored.join(earlier, "_range")
        .withColumn(name, F.col("_before") + F.col("_pos") + 1)
        .drop("_range", "_pos", "_before")
    )


# -- merging duplicates --------------------------------------------------------------

def merge_map(sites: DataFrame) -> DataFrame:
    """(site_id, canonical_id) for every site that shares its panel id with an older one."""
    known = sites.where(F.col("panel_site_id") > 0)
    canonical = known.groupBy("panel_site_id").agg(F.min("id").alias("canonical_id"))
    return (
        known.join(canonical, "panel_site_id")
        .where(F.col("id") != F.col("canonical_id"))
        .select(F.col("id").alias("site_id"), "canonical_id")
    )


def _canonical(df: DataFrame, mapping: DataFrame) -> DataFrame:
    moved = df.join(mapping, "site_id", "left")
    return moved.withColumn("site_id", F.coalesce("canonical_id", "site_id")).drop("canonical_id")


def merge_rollup(partials: DataFrame, mapping: DataFrame, rollup: Rollup) -> DataFrame:
    """Fold duplicate sites into one.

    Each site's own partials add up first. Where two sites hold the same key they are
    two records of the same traffic, so the larger value of each measure is kept, not the sum.
    Sketches unite.
    """
    moved = _canonical(merge(partials, rollup), mapping)
    return moved.groupBy(*rollup.keys).agg(
        *[F.max(c).alias(c) for c in rollup.sums + rollup.maxes],
        *[F.hll_union_agg(c).alias(c) for c in rollup.sketches],
    )


def merge_sketches(sketches: DataFrame, mapping: DataFrame) -> DataFrame:
    return merge(_canonical(sketches, mapping), UNIQUE_HOUR)


def merge_details(details: DataFrame, mapping: DataFrame) -> DataFrame:
    """Details move to the canonical site; all rows stay."""
    return _canonical(details, mapping).select(*details.columns)


def merge_exact(rows: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Legacy first-seen rows: the canonical site's own row wins, then the lowest duplicate's."""
    own = rows.join(mapping.select("site_id"), "site_id", "left_anti")
    moved = rows.join(mapping, "site_id")
    moved = moved.withColumn("_source", F.col("site_id")).withColumn("site_id", F.col("canonical_id"))
    return insert_new(own, moved.select(*rows.columns, "_source"), keys, ("_source",))


# -- registration --------------------------------------------------------------------

def register(sites: DataFrame, discovered: DataFrame) -> dict[str, DataFrame]:
    """Bring discovered sites (panel_site_id, name, document_root, log_path,
    web_server) into the registry.

    A site is found by its panel id, else by its log path; the lowest id stays. Returns
    the new ``sites``, the ``merges`` (site_id, canonical_id) whose rollups must be folded,
    and ``rebuilds`` (site_id) whose rollups must be deleted and read again because an old
    path ended in a stray semicolon. Rows that share a panel id, then rows that share a log path, are
    one site: the last by name and path, then the one with the highest panel id.
    """
    last = lambda rows, key, *order: rows.groupBy(key).agg(
        F.max_by(F.struct(*discovered.columns), F.struct(*order)).alias("_row")
    ).select("_row.*")
    known = last(discovered.where(F.col("panel_site_id").isNotNull()), "panel_site_id", "name", "log_path")
    known = known.unionByName(discovered.where(F.col("panel_site_id").isNull()))
    incoming = last(known, "log_path", "panel_site_id", "name").select(
        F.col("panel_site_id").alias("n_panel"),
        F.col("name").alias("n_name"),
        F.col("document_root").alias("n_root"),
        F.col("log_path").alias("n_path"),
        F.col("web_server").alias("n_server"),
    )
    by_panel = sites.where(F.col("panel_site_id") > 0).groupBy("panel_site_id").agg(
        F.min("id").alias("panel_id")
    )
    by_path = sites.select(
        F.col("log_path").alias("n_path"),
        F.col("id").alias("path_id"),
        F.col("panel_site_id").alias("path_panel"),
    )
    matched = (
        incoming.join(by_panel, F.col("n_panel") == F.col("panel_site_id"), "left")
        .drop("panel_site_id")
        .join(by_path, "n_path", "left")
        .withColumn("id", F.coalesce("panel_id", "path_id"))
    )
    absorbed = matched.where(
        F.col("panel_id").isNotNull()
        & F.col("path_id").isNotNull()
        & (F.col("path_id") != F.col("panel_id"))
        & (F.col("path_panel") <= 0)
    ).select(F.col("path_id").alias("site_id"), F.col("panel_id").alias("canonical_id"))
    duplicates = merge_map(sites).join(
        matched.where(F.col("panel_id").isNotNull()).select(F.col("panel_id").alias("canonical_id")),
        "canonical_id",
        "left_semi",
    )
    merges = duplicates.select("site_id", "canonical_id").unionByName(absorbed).distinct()

    updates = matched.where(F.col("id").isNotNull())
    fresh = number_rows(matched.where(F.col("id").isNull()).drop("id"), ["n_panel", "n_path"], "_no")
    highest = sites.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]

    kept = sites.join(merges.select(F.col("site_id").alias("id")), "id", "left_anti")
    pick = lambda new, old: F.coalesce(F.col(new), F.col(old)).alias(old)
    changed = kept.join(
        updates.select("id", "n_panel", "n_name", "n_root", "n_path", "n_server"), "id", "left"
    )
    seen = F.col("n_name").isNotNull()
    old_rows = changed.select(
        "id",
        pick("n_panel", "panel_site_id"),
        pick("n_name", "name"),
        pick("n_root", "document_root"),
        pick("n_path", "log_path"),
        pick("n_server", "web_server"),
        (F.col("enabled") | seen).alias("enabled"),
        "user_enabled",
    )
    new_rows = fresh.select(
        (F.lit(highest) + F.col("_no")).alias("id"),
        F.col("n_panel").alias("panel_site_id"),
        F.col("n_name").alias("name"),
        F.col("n_root").alias("document_root"),
        F.col("n_path").alias("log_path"),
        F.col("n_server").alias("web_server"),
        F.lit(True).alias("enabled"),
        F.lit(True).alias("user_enabled"),
    )
    old_path = F.rtrim(F.regexp_replace(F.col("log_path"), ";+$", ""))
    rebuilds = changed.where(
        seen & (F.col("log_path") != F.col("n_path")) & (old_path == F.col("n_path"))
        & (F.col("n_panel") > 0)
    ).select(F.col("id").alias("site_id"))
    return {"sites": old_rows.unionByName(new_rows), "merges": merges, "rebuilds": rebuilds}


def retain(sites: DataFrame, log_paths: DataFrame) -> DataFrame:
    """Enable exactly the sites whose log path is still known; nothing is deleted."""
    known = log_paths.select("log_path").distinct().withColumn("_known", F.lit(True))
    return (
        sites.join(known, "log_path", "left")
        .withColumn("enabled", F.coalesce("_known", F.lit(False)))
        .select(*sites.columns)
    )


def set_enabled(sites: DataFrame, site_id: int, enabled: bool) -> DataFrame:
    """The user's own switch; unlike ``enabled`` it survives the next registration."""
    hit = F.col("id") == site_id
    return sites.withColumn(
        "user_enabled", F.when(hit, F.lit(enabled)).otherwise(F.col("user_enabled"))
    )


def active(sites: DataFrame) -> DataFrame:
    return sites.where(F.col("enabled") & F.col("user_enabled"))


def by_name(name: Column | str = "name") -> Column:
    """Case-insensitive order of names (ASCII letters)."""
    column = F.col(name) if isinstance(name, str) else name
    return F.collate(column, "UTF8_LCASE")


def list_sites(sites: DataFrame, progress: DataFrame) -> DataFrame:
    """Enabled sites with their ingest counters, in name order."""
    counters = progress.groupBy("site_id").agg(
        F.sum("lines").alias("lines"), F.sum("events").alias("events"),
        F.sum("rejected").alias("rejected"),
    )
    joined = active(sites).join(counters, F.col("id") == F.col("site_id"), "left").drop("site_id")
    return joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("lines", "events", "rejected")}
    ).orderBy(by_name(), "id")


def search(sites: DataFrame, text: str) -> DataFrame:
    return sites.where(F.lower("name").contains(text.strip().lower())) if text.strip() else sites


SORT_KEYS = ("name", "pv", "uv", "ip", "requests", "body_bytes", "error_rate")


def sort_sites(rows: DataFrame, key: str = "name", descending: bool = False) -> DataFrame:
    """Order by a column; equal rows go by name, in the same direction."""
    if key not in SORT_KEYS:
        raise ValueError(f"cannot sort sites by {key}")
    order = [F.lower("name") if key == "name" else F.col(key), F.lower("name"), F.col("name")]
    return rows.orderBy(*[c.desc() if descending else c.asc() for c in order])


def with_presence(sites: DataFrame, metric: DataFrame) -> DataFrame:
    """Whether a site has any metric row."""
    found = metric.select(F.col("site_id").alias("id")).distinct().withColumn("_f", F.lit(True))
    return sites.join(found, "id", "left").select(
        *sites.columns, flag(F.col("_f")).alias("has_statistics")
    )
