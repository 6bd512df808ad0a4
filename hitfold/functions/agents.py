"""User-agent classification (crawler, browser, system, device).

A rule is a case-insensitive substring test. ``lower`` once and plain ``contains`` measured ten times
faster than a chain of ``rlike``. The crawler rules are tried only when a token that every rule implies
is present, which most traffic lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Crawler names in order of precedence, each with the substrings that
# name it; the one with ``.*`` is a pattern.
SPIDERS = (
    ("Baiduspider", ("baiduspider",)),
    ("Googlebot", ("googlebot",)),
    ("Bingbot", ("bingbot", "msnbot")),
    ("Sogou", ("sogou.*spider",)),
    ("360Spider", ("360spider", "haosouspider")),
    ("Shenma", ("yisouspider", "sm.cn")),
    ("YandexBot", ("yandexbot",)),
    ("Bytespider", ("bytespider",)),
    ("AhrefsBot", ("ahrefsbot",)),
    ("SemrushBot", ("semrushbot",)),
    ("MJ12bot", ("mj12bot",)),
    ("DotBot", ("dotbot",)),
    ("PetalBot", ("petalbot",)),
    ("GPTBot", ("gptbot", "chatgpt-user")),
    ("ClaudeBot", ("claudebot", "anthropic-ai")),
    ("CommonCrawl", ("ccbot", "commoncrawl")),
    ("ArchiveBot", ("ia_archiver", "archive.org_bot")),
)
GENERIC_SPIDER = ("bot", "spider", "crawler", "slurp")
OTHER_SPIDER = "OtherBot"

# Client families in order of precedence.
BROWSERS = (
    ("Edge", ("edg/",)),
    ("Opera", ("opr/", "opera")),
    ("Chrome", ("chrome/", "crios/")),
    ("Firefox", ("firefox/", "fxios/")),
    ("Safari", ("safari/",)),
)
SYSTEMS = (
    ("Windows", ("windows",)),
    ("Android", ("android",)),
    ("iOS", ("iphone", "ipad", "ios")),
    ("macOS", ("mac os", "macintosh")),
    ("Linux", ("linux",)),
)
DEVICES = (
    ("Bot", GENERIC_SPIDER),
    ("Tablet", ("ipad", "tablet")),
    ("Mobile", ("mobile", "iphone", "android")),
)


def _holds(text: str, tokens) -> str:
    tests = []
    for token in tokens:
        # substrings are several times cheaper than patterns, so a pattern runs only where its start occurs
        start, pattern, _ = token.partition(".*")
        test = f"contains({text}, '{start}')"
        tests.append(f"({test} AND {text} RLIKE '{token}')" if pattern else test)
    return "(" + " OR ".join(tests) + ")"


def _first(text: str, rules, otherwise: str) -> str:
    arms = " ".join(f"WHEN {_holds(text, tokens)} THEN '{name}'" for name, tokens in rules)
    return f"CASE {arms} ELSE '{otherwise}' END"


def _gate_tokens() -> tuple[str, ...]:
    """The generic tokens plus every specific needle that holds none of them.

    One of them occurs exactly when some crawler rule holds.
    """
    needles = [needle for _, tokens in SPIDERS for needle in tokens]
    return GENERIC_SPIDER + tuple(
        n for n in needles if not any(token in n for token in GENERIC_SPIDER)
    )


def is_bot(text: str) -> str:
    """SQL for whether any crawler rule holds: cheap, where the name is not needed."""
    return _holds(text, _gate_tokens())


def spider_name(text: str) -> str:
    """SQL for the crawler name of a lower-cased user agent, null for people."""
    named = _first(text, SPIDERS, OTHER_SPIDER)
    return f"CASE WHEN {is_bot(text)} THEN {named} END"


def browser(text: str) -> str:
    return _first(text, BROWSERS, "Other")


def system(text: str) -> str:
    return _first(text, SYSTEMS, "Other")


def device(text: str) -> str:
    return _first(text, DEVICES, "Desktop")


def with_agent(df: DataFrame, column: str = "user_agent") -> DataFrame:
    """Add ``is_bot``, ``spider``, ``browser``, ``system`` and ``device``.

    The lower-cased text is its own projection so that it is computed once per row.
    """
    rules = {
        "is_bot": is_bot, "spider": spider_name,
        "browser": browser, "system": system, "device": device,
    }
    return (
        df.withColumn("_ua", F.expr(f"lower(coalesce({column}, ''))"))
        .withColumns({name: F.expr(rule("_ua")) for name, rule in rules.items()})
        .drop("_ua")
    )
