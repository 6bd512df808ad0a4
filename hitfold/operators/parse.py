"""Text lines and live messages to request events.

The line pattern runs once per line: it is rewritten to its groups joined by a
newline (which no line can hold) and split, where one ``regexp_extract`` per
field would run it eight times. The quoted strings use the unrolled possessive form; the nested
alternation form overflows the JVM stack on long targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitfold.functions import ip
from hitfold.functions.columns import once
from hitfold.functions.requests import is_excluded, request_path
from hitfold.options import Options
from hitfold.schema import EVENT_FIELDS

# white space as Unicode sees it, plus the four ASCII separators
_WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_S, _N = f"[{_WS}]", f"[^{_WS}]"
_QUOTED = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
LINE = (
    rf"(?s)^{_S}*+({_N}+){_S}+{_N}+{_S}+{_N}+{_S}+\[([^\]]+)\]{_S}+"
    rf'"({_QUOTED})"{_S}+([0-9]{{3}}){_S}+([0-9]+|-)'
    rf'(?:{_S}+"({_QUOTED})"{_S}+"({_QUOTED})")?.*$'
)
_GROUPS = "\n".join(f"${i}" for i in range(1, 8))
_TIME = r"^[0-9]{1,2}/[A-Za-z]{3}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}$"


def unescape(text: Column) -> Column:
    r"""``\x22`` to a quote, ``\x5C`` to a backslash, ``\"`` to a quote, in this order."""
    plain = text
    for escaped, char in ((r"\x22", '"'), (r"\x5C", "\\"), (r"\"", '"')):
        plain = F.replace(plain, F.lit(escaped), F.lit(char))
    return F.when(text.contains("\\"), plain).otherwise(text)


def log_time(text: Column) -> Column:
    """``1/Sep/2026:10:20:30 +0800`` to epoch seconds; null when it is no valid time."""
    wall = F.substring_index(text, " ", 1)
    offset = F.substring_index(text, " ", -1)
    minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int")
    seconds = F.when(offset.startswith("-"), -minutes).otherwise(minutes) * 60
    utc = F.unix_seconds(
        F.try_to_timestamp(F.concat(wall, F.lit(" +0000")), F.lit("d/MMM/yyyy:HH:mm:ss Z"))
    )
    return F.when(text.rlike(_TIME) & (minutes < 1440), utc - seconds)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Access-log lines (common or combined form) to events.

    Every input row is kept, with all its other columns; ``timestamp`` is null where the
    line was rejected.
    """
    keep = [c for c in lines.columns if c != column]
    part = lambda i: F.element_at("_g", i)
    groups = F.split(F.regexp_replace(F.col(column), LINE, _GROUPS), "\n", -1)
    split = once(lines, _g=groups).select(
        *keep, F.when(F.size("_g") == 7, F.col("_g")).alias("_g")
    )
    request = once(
        split,
        _r=F.split(unescape(part(3)), " ", 3),
        _time=log_time(part(2)),
        _bytes=F.when(part(5) == "-", F.lit(0).cast("bigint")).otherwise(
            part(5).try_cast("bigint")
        ),
    )
    word = lambda i: F.element_at("_r", i)
    one_word = F.size("_r") < 2
    valid = F.col("_time").isNotNull() & F.col("_bytes").isNotNull()
    columns = {
        "timestamp": F.col("_time"),
        "remote_addr": part(1),
        "method": F.when(one_word, F.lit("")).otherwise(word(1)),
        "uri": F.when(one_word, word(1)).otherwise(word(2)),
        "protocol": F.when(F.size("_r") == 3, word(3)).otherwise(F.lit("")),
        "status": part(4).cast("int"),
        "body_bytes": F.col("_bytes"),
        "referer": unescape(part(6)),
        "user_agent": unescape(part(7)),
        "host": F.lit(""),
        "cookie": F.lit(""),
    }
    # a line has no length limit on its address
    columns["remote_addr"] = part(1)
    return request.select(
        *keep, *[F.when(valid, columns[name]).alias(name) for name in EVENT_FIELDS]
    )


# Fields of one live message.
MESSAGE_FIELDS = (
    "time", "host", "remote_addr", "ip", "x_forwarded_for", "forwarded_for", "x_real_ip",
    "true_client_ip", "cf_connecting_ip", "ali_cdn_real_ip", "cdn_real_ip", "client_ip",
    "method", "uri", "protocol", "status", "bytes", "referer", "ua", "user_agent", "cookie",
)
# Tag of a live message, with the site id, before the JSON body.
MESSAGE = r"(?s)^(?:.*?[\t-\r ])?wa_([0-9]+)_access:[\t-\r ]*(\{.*\})[\t-\r ]*$"
_JSON_OPTIONS = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def iso_time(text: Column, tz: str) -> Column:
    """ISO time with zone, offset or neither (then ``tz`` holds) to epoch seconds."""
    zoned = F.unix_seconds(text.try_cast("timestamp"))
    wall = F.convert_timezone(F.lit(tz), F.lit("UTC"), text.try_cast("timestamp_ntz"))
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.when(text.rlike(_ZONED), zoned).otherwise(F.timestamp_diff("SECOND", epoch, wall))


def _whole_number(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.coalesce(trimmed.try_cast("bigint"), F.floor(trimmed.try_cast("double")).cast("bigint"))


def parse_messages(messages: DataFrame, options: Options, column: str = "value") -> DataFrame:
    """Live messages (``wa_<site>_access: {json}`` at the end of a syslog line) to events.

    Every input row is kept; ``timestamp`` is null where the message was rejected.
    """
    keep = [c for c in messages.columns if c != column]
    text = F.col(column).cast("string")
    schema = ", ".join(f"`{name}` STRING" for name in MESSAGE_FIELDS)
    # site number and body on two lines; text that does not match stays as it is
    found = once(messages.withColumn("_text", text), _found=F.regexp_replace("_text", MESSAGE, "$1\n$2"))
    matched = F.col("_found") != F.col("_text")
    line = lambda i: F.element_at(F.split("_found", "\n", 2), i)
    split = once(
        found.select(*keep, "_text", "_found"),
        panel_site_id=F.when(matched, line(1).try_cast("bigint")),
        _j=F.when(matched, F.from_json(line(2), schema, _JSON_OPTIONS)),
    )
    field = lambda name: F.col(f"_j.{name}")
    text_of = lambda name: F.coalesce(field(name), F.lit(""))
    size = _whole_number(F.coalesce(F.nullif(field("bytes"), F.lit("")), F.lit("0")))
    address_fields = ("remote_addr", "ip", "x_forwarded_for", "forwarded_for", *ip.CLIENT_FIELDS)
    headers = {name: f"_j.{name}" for name in address_fields}
    typed = once(
        split.select(*keep, "panel_site_id", "_j"),
        _peer=F.expr(ip.peer_address(headers)),
        _time=iso_time(field("time"), options.timezone),
        _status=_whole_number(F.coalesce(field("status"), F.lit("0"))).try_cast("int"),
        _size=size,
    )
    valid = (
        F.col("panel_site_id").isNotNull()
        & F.col("_time").isNotNull()
        & F.col("_status").isNotNull()
        & F.col("_size").isNotNull()
    )
    columns = {
        "timestamp": F.col("_time"),
        "remote_addr": F.expr(ip.client_behind("_peer", headers, options.trusted_proxies)),
        "method": text_of("method"),
        "uri": text_of("uri"),
        "protocol": text_of("protocol"),
        "status": F.col("_status"),
        "body_bytes": F.greatest(F.lit(0).cast("bigint"), F.col("_size")),
        "referer": text_of("referer"),
        "user_agent": F.coalesce(F.nullif(field("ua"), F.lit("")), text_of("user_agent")),
        "host": text_of("host"),
        "cookie": text_of("cookie"),
    }
    return typed.select(
        *keep,
        F.when(valid, F.col("panel_site_id")).alias("panel_site_id"),
        *[F.when(valid, columns[name]).alias(name) for name in EVENT_FIELDS],
    )


ACCEPTED, REJECTED, DEFERRED = "accepted", "rejected", "deferred"


def accept_condition(options: Options, since: int = 0) -> Column:
    """Parsed, not excluded, not older than ``since``."""
    keep = F.col("timestamp").isNotNull()
    if options.excluded_paths:
        keep = keep & ~is_excluded(request_path("uri"), options.excluded_paths)
    if since:
        keep = keep & (F.col("timestamp") >= since)
    return F.coalesce(keep, F.lit(False))


def judge(parsed: DataFrame, options: Options, since: int = 0) -> DataFrame:
    """Add ``verdict``: accepted or rejected."""
    ok = accept_condition(options, since)
    return parsed.withColumn("verdict", F.when(ok, F.lit(ACCEPTED)).otherwise(F.lit(REJECTED)))


def accepted(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("verdict") == ACCEPTED).drop("verdict")


def accounting(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Lines read, events accepted and lines rejected per key."""
    return judged.groupBy(*keys).agg(
        F.count("*").alias("lines"),
        F.count_if(F.col("verdict") == ACCEPTED).alias("events"),
        F.count_if(F.col("verdict") == REJECTED).alias("rejected"),
    )
