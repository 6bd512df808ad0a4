"""Request-level expressions: path, suffix, page view, exclusion, errors, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitfold.functions.columns import any_of
from hitfold.functions.ip import let

# scheme, then authority, then the path up to a query or fragment
_PATH = r"r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)'"
_AUTHORITY = r"r'^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)'"
_SUFFIX = r"r'(?:^|/)[^/]+\.([^./]+)(?:/\.?)*\z'"


def _general_path(uri: str) -> str:
    cleaned = rf"regexp_replace(regexp_replace({uri}, r'^[\x00-\x20]+', ''), r'[\t\r\n]', '')"

    def split(text: str) -> str:
        authority = f"regexp_extract({text}, {_AUTHORITY}, 1)"
        return (
            f"CASE WHEN contains({authority}, '[') != contains({authority}, ']') "
            f"THEN substring_index({uri}, '?', 1) ELSE regexp_extract({text}, {_PATH}, 1) END"
        )

    return let(cleaned, split)


def request_path(uri: str = "uri") -> Column:
    """Path of a request target, ``/`` when empty.

    Nearly every target is origin-form (``/x?y``) and needs no pattern at all; the rest takes
    the general rule, kept out of the hot code by a lambda.
    """
    origin_form = (
        f"startswith({uri}, '/') AND NOT startswith({uri}, '//') AND NOT (contains({uri}, chr(9)) "
        f"OR contains({uri}, chr(10)) OR contains({uri}, chr(13)))"
    )
    plain = f"substring_index(substring_index({uri}, '?', 1), '#', 1)"
    general = let(uri, _general_path)
    path = f"CASE WHEN {origin_form} THEN {plain} ELSE {general} END"
    return F.expr(f"coalesce(nullif({path}, ''), CASE WHEN {uri} IS NOT NULL THEN '/' END)")


def path_suffix(path: str = "path") -> Column:
    """Lower-case suffix of the last path segment, without the dot; '' for none."""
    return F.expr(_suffix(path))


def _suffix(path: str) -> str:
    return f"CASE WHEN contains({path}, '.') THEN regexp_extract(lower({path}), {_SUFFIX}, 1) ELSE '' END"


def is_page_view(static: Sequence[str], path: str = "path") -> Column:
    """A successful GET or HEAD by a person for something that is not a static file.

    Needs ``method``, ``status`` and ``is_bot``.
    """
    page = f"NOT ({_suffix(path)}) IN ({', '.join(map(repr, static))})" if static else "true"
    return F.expr(
        "upper(method) IN ('GET', 'HEAD') AND status >= 200 AND status < 400 "
        f"AND NOT is_bot AND {page}"
    )


def is_excluded(path: Column, prefixes: Sequence[str]) -> Column:
    return any_of(path.startswith(p) for p in prefixes if p)


def error_in_range(status: Column) -> Column:
    """4xx or 5xx: minute metrics, crawlers, detail keeping."""
    return (status >= 400) & (status <= 599)


def error_open(status: Column) -> Column:
    """400 and above: day dimensions and the error list."""
    return status >= 400


def server_error(status: Column) -> Column:
    """500 and above, no upper limit: the 5xx filter."""
    return status >= 500


def salted_hash(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt + "\0"), value), 256)


def visitor_hash(ip: Column, user_agent: Column, salt: str) -> Column:
    return salted_hash(F.concat(ip, F.lit("\0"), user_agent), salt)


def ip_hash(ip: Column, salt: str) -> Column:
    return salted_hash(ip, salt)


def csv_guard(value: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    text = value.cast("string")
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def byte_size(value: Column) -> Column:
    """Human-readable size: B, KB, MB, GB, TB."""
    size = F.greatest(F.coalesce(value, F.lit(0)).cast("double"), F.lit(0.0))
    chain = F.when(size < 1024, F.concat(F.format_string("%.0f", size), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), start=1):
        chain = chain.when(size < 1024.0 ** (power + 1), _scaled(size / 1024.0**power, unit))
    return chain.otherwise(_scaled(size / 1024.0**4, "TB"))


def _scaled(size: Column, unit: str) -> Column:
    number = F.when(size >= 100, F.format_string("%.0f", size)).otherwise(
        F.format_string("%.2f", size)
    )
    return F.concat(number, F.lit(" " + unit))
