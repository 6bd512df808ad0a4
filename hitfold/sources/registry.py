"""Sites from a registry table, logs that belong to no site, and whose log a file is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitfold.operators.sites import number_rows


def registered(rows: DataFrame, log_folder: str) -> DataFrame:
    """Usable registry rows (id, name, path, optional web_server and log_path).

    A row needs a name and a positive id. The default log is ``<name>.log``, for
    Apache ``<name>-access_log``.
    """
    has = lambda c: c in rows.columns
    server = F.coalesce(F.col("web_server"), F.lit("nginx")) if has("web_server") else F.lit("nginx")
    name = F.trim(F.coalesce(F.col("name"), F.lit("")))
    default = F.concat(
        F.lit(log_folder.rstrip("/") + "/"), name,
        F.when(server == "apache", F.lit("-access_log")).otherwise(F.lit(".log")),
    )
    given = F.nullif(F.col("log_path"), F.lit("")) if has("log_path") else F.lit(None)
    root = F.coalesce(F.col("path"), F.lit("")) if has("path") else F.lit("")
    return rows.where((name != "") & (F.col("id") > 0)).select(
        F.col("id").cast("bigint").alias("panel_site_id"),
        name.alias("name"),
        root.alias("document_root"),
        F.coalesce(given, default).alias("log_path"),
        server.alias("web_server"),
    )


def orphans(files: DataFrame, known: DataFrame) -> DataFrame:
    """Logs of no known site, as sites with ids -1, -2, … in name order.

    Error logs and the server's catch-all ``access.log`` are left out.
    """
    named = files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("log_path")
    ).withColumn("file", F.element_at(F.split("log_path", "/"), -1))
    loose = named.where(
        F.col("file").endswith(".log")
        & ~F.col("file").endswith(".error.log")
        & (F.col("file") != "access.log")
    ).join(known.select("log_path"), "log_path", "left_anti")
    return number_rows(loose, ["log_path"], "_no").select(
        (-F.col("_no")).alias("panel_site_id"),
        F.regexp_replace("file", r"\.log$", "").alias("name"),
        F.lit("").alias("document_root"),
        "log_path",
        F.lit("nginx").alias("web_server"),
    )


def with_site(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Add ``site_id`` by ``file_path``: the site whose log path starts the file's path.

    Distinct files are matched by equality on every prefix of their path, which stands for
    ``startswith`` without pairing each file with each site. A log path with a scheme is compared with
    the whole location, one without (or with ``file:``, which is written in several ways) with the path alone; names are compared decoded. Files of no site keep
    their rows, with a null ``site_id``. Pass staged rows, whose paths are one small column, rather than raw text.
    """
    return rows.join(owners(rows, sites), "file_path", "left")


def owners(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """(file_path, site_id) of the files that ``with_site`` finds a site for."""
    # the reader writes a file's location as a URI, in which + is a plain sign
    decoded = F.coalesce(F.try_url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B"))), "file_path")
    files = rows.select("file_path").where("file_path IS NOT NULL").distinct().withColumn("_whole", decoded)
    files = files.withColumn("_path", F.regexp_replace("_whole", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/"))
    forms = files.select("file_path", F.explode(F.array_distinct(F.array("_whole", "_path"))).alias("_form"))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.length("_form")), lambda n: F.col("_form").substr(F.lit(1), n)
    )
    return (
        forms.select("file_path", F.explode(prefixes).alias("log_path"))
        .join(sites.select(F.regexp_replace("log_path", "^file:/+", "/").alias("log_path"), F.col("id").alias("site_id")), "log_path")
        .groupBy("file_path")
        .agg(F.max_by("site_id", F.struct(F.length("log_path"), -F.col("site_id"))).alias("site_id"))
    )
