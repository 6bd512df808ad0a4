"""Scalar expressions against the Python standard library."""

import hashlib
import ipaddress
import random
import re
from pathlib import PurePosixPath
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from hitfold.functions import agents, ip
from hitfold.functions import clock
from hitfold.functions import requests as R
from hitfold.functions.columns import once

rng = random.Random(7)


def table(spark, values, name="v", kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_paths_and_suffixes_match_the_standard_library(spark):
    pieces = ["/", "//", "a", "b.js", ".x", "?q=1", "#f", "http:", "host", ":443", " ", "\t",
              "%20", "..", "A.PNG", "x.tar.gz", "|", ";", "/.", "é"]
    uris = {"".join(rng.choice(pieces) for _ in range(rng.randint(0, 7))) for _ in range(4000)}
    uris |= {"", "/", "host:443", "//x/y", "http://h/p?q", "*"}
    rows = table(spark, sorted(uris)).withColumn("path", R.request_path("v"))
    for row in rows.select("v", "path", R.path_suffix("path").alias("suffix")).collect():
        path = urlsplit(row.v).path or "/"
        assert row.path == path, row.v
        assert row.suffix == PurePosixPath(path.lower()).suffix.lstrip("."), row.v


def python_spider(ua):
    for name, needles in agents.SPIDERS:
        for needle in needles:
            if re.search(re.escape(needle).replace(r"\.\*", ".*"), ua, re.I):
                return name
    return agents.OTHER_SPIDER if re.search("bot|spider|crawler|slurp", ua, re.I) else None


def python_first(ua, rules, otherwise):
    for name, needles in rules:
        if any(n in ua.lower() for n in needles):
            return name
    return otherwise


def test_agents_follow_the_rules_in_order(spark):
    words = ["Sogou", "web", "spider", "Bot", "GPTBot", "sm.cn", "ChatGPT-User", "anthropic-ai",
             "MSNBOT", "Chrome/1", "Edg/2", "OPR/3", "Opera", "CriOS/", "FxiOS/", "Safari/", "Firefox/",
             "Windows", "Android", "iPhone", "iPad", "Helios", "Mac OS", "Linux", "Tablet", "Mobile",
             "ia_archiver", "archive.org_bot", "CCBot", "commoncrawl", "Slurp", "haosouspider", "\n"]
    values = {" ".join(rng.sample(words, rng.randint(0, 4))) for _ in range(3000)}
    rows = agents.with_agent(table(spark, sorted(values), "user_agent")).collect()
    for r in rows:
        ua = r.user_agent
        assert r.spider == python_spider(ua), ua
        assert r.is_bot == (r.spider is not None), ua
        assert r.browser == python_first(ua, agents.BROWSERS, "Other"), ua
        assert r.system == python_first(ua, agents.SYSTEMS, "Other"), ua
        assert r.device == python_first(ua, agents.DEVICES, "Desktop"), ua


def random_address():
    if rng.random() < 0.3:
        parts = [rng.choice(["0", "1", "10", "127", "192", "168", "203", "255", "256", "224", "01"])
                 for _ in range(rng.choice([3, 4, 4, 4, 5]))]
        return ".".join(parts)
    pool = ["0", "0", "0", "1", "ab", "FFFF", "0db8", "2001", "0000"] + ["12345", "g"] * (rng.random() < 0.1)
    groups = [rng.choice(pool) for _ in range(rng.choice([8, 8, 7, 9, 3]))]
    text = ":".join(groups)
    if rng.random() < 0.6:
        text = ":".join(groups[: rng.randint(0, 4)]) + "::" + ":".join(groups[: rng.randint(0, 4)])
    if rng.random() < 0.15:
        text += ":1.2.3.4"
    return text + "%eth0" * (rng.random() < 0.05)


def test_addresses_match_the_standard_library(spark):
    values = {random_address() for _ in range(2500)} | {
        "", "-", "::", "::1", ":::", "1::2::3", "fe80::1%", "ff02::1", "64:ff9b::1", "2001:20::1",
        "192.0.0.9", "::ffff:10.0.0.1", "::ffff:127.0.0.1", "100.64.0.1", "172.31.0.1", "172.32.0.1",
    }

    def expected(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None, "invalid"
        kinds = (("loopback", a.is_loopback), ("private", a.is_private),
                 ("reserved", a.is_multicast or a.is_unspecified or a.is_reserved))
        return str(a), next((name for name, hit in kinds if hit), "public")

    rows = table(spark, sorted(values)).select(
        "v", F.expr(ip.canonical("v")).alias("c"), F.expr(ip.address_class("v")).alias("k")
    )
    for r in rows.collect():
        assert (r.c, r.k) == expected(r.v), r.v


def test_networks_match_the_standard_library(spark):
    cidrs = ["10.0.0.0/8", "172.16.0.0/12", "203.0.113.8/29", "9.9.9.9/32", "128.0.0.0/1", "2001:db8::/33"]
    values = ["10.1.2.3", "172.15.0.1", "172.16.0.1", "172.31.9.9", "203.0.113.7", "203.0.113.15", "9.9.9.9",
              "127.0.0.1", "200.1.1.1", "2001:db8::1", "2001:db8:8000::1", "::1"]
    nets = [ipaddress.ip_network(c) for c in cidrs]
    rows = table(spark, values).select("v", F.expr(ip.in_networks("v", cidrs)).alias("hit")).collect()
    for r in rows:
        assert r.hit == any(ipaddress.ip_address(r.v) in n for n in nets), r.v
    # nothing behind a malformed network counts
    rows = table(spark, ["10.0.0.1", "9.9.9.9"]).select(
        F.expr(ip.in_networks("v", ["10.0.0.0/8", "bad", "9.9.9.9/32"])).alias("hit")
    )
    assert [r.hit for r in rows.collect()] == [True, False]


def client(spark, trusted, **headers):
    names = ", ".join(f"{n} string" for n in headers)
    df = spark.createDataFrame([tuple(headers.values())], names)
    fields = {n: n for n in headers}
    out = once(df, peer=F.expr(ip.peer_address(fields)))
    return out.select(F.expr(ip.client_behind("peer", fields, trusted)).alias("c")).first().c


def test_client_address_behind_proxies(spark):
    chain = "198.51.100.7, 10.0.0.7"
    ten = ["10.0.0.0/8"]
    assert client(spark, ten, remote_addr="10.0.0.8", x_forwarded_for=chain) == "198.51.100.7"
    assert client(spark, ten, remote_addr="203.0.113.9", x_forwarded_for=chain) == "203.0.113.9"
    assert client(spark, ["127.0.0.0/8"], remote_addr="127.0.0.1", x_forwarded_for="198.51.100.2",
                  cf_connecting_ip="2001:DB8:0::8") == "2001:db8::8"
    assert client(spark, ten, remote_addr="10.0.0.8", x_forwarded_for="10.1.1.1, 10.2.2.2") == "10.1.1.1"
    assert client(spark, ten, remote_addr="10.0.0.8", x_forwarded_for="junk") == "10.0.0.8"
    assert client(spark, ten, remote_addr="", ip="10.0.0.8:1234", x_real_ip="[2001:db8::1]") == "2001:db8::1"
    assert client(spark, ten, remote_addr="nonsense") == ""


def walk(peer, chain, nets):
    """Rightmost hop outside the trusted networks, by a plain loop."""
    trusted = lambda a: any(ipaddress.ip_address(a) in n for n in nets)
    if not trusted(peer):
        return peer
    hops = []
    for hop in chain.split(","):
        hop = hop.strip().strip("[]")
        if hop.count(":") == 1 and "." in hop:
            hop = hop.split(":")[0]
        try:
            hops.append(str(ipaddress.ip_address(hop)))
        except ValueError:
            pass
    return next((h for h in reversed(hops) if not trusted(h)), hops[0] if hops else peer)


def test_forwarding_chains_match_a_plain_walk(spark):
    cidrs = ["10.0.0.0/8", "172.16.0.0/12", "fc00::/7"]
    nets = [ipaddress.ip_network(c) for c in cidrs]
    hops = ["10.0.0.1", " 10.2.3.4 ", "8.8.8.8", "172.20.0.1:99", " 9.9.9.9:80", "junk", "", "-", "[2001:db8::1]", "fd00::2",
            "2001:DB8:0:0::5", "\t1.1.1.1"]
    chains = {",".join(rng.choice(hops) for _ in range(rng.randint(1, 4))) for _ in range(1500)}
    rows = [(rng.choice(["10.9.9.9", "172.31.0.1", "4.4.4.4"]), c) for c in sorted(chains)]
    fields = {"remote_addr": "p", "x_forwarded_for": "x"}
    df = once(spark.createDataFrame(rows, "p string, x string"), peer=F.expr(ip.peer_address(fields)))
    for r in df.select("p", "x", F.expr(ip.client_behind("peer", fields, cidrs)).alias("c")).collect():
        assert r.c == walk(r.p, r.x, nets), (r.p, r.x)


def test_hashes(spark):
    row = spark.createDataFrame([("1.2.3.4", "ua é")], "ip string, ua string").select(
        R.visitor_hash(F.col("ip"), F.col("ua"), "s").alias("v"), R.ip_hash(F.col("ip"), "s").alias("i")
    ).first()
    assert row.v == hashlib.sha256("s\0001.2.3.4\0ua é".encode()).hexdigest()
    assert row.i == hashlib.sha256("s\0001.2.3.4".encode()).hexdigest()


def test_csv_guard_and_sizes(spark):
    cells = ["=1+1", "+1", "-1", "@x", "a=b", "", "'x"]
    out = [r[0] for r in table(spark, cells).select(R.csv_guard(F.col("v"))).collect()]
    assert out == ["'=1+1", "'+1", "'-1", "'@x", "a=b", "", "'x"]
    sizes = table(spark, [-5, 0, 1023, 1024, 1536, 102400, 5 * 2**30, 3 * 2**50], "n", "bigint")
    out = [r[0] for r in sizes.select(R.byte_size(F.col("n"))).collect()]
    assert out == ["0 B", "0 B", "1023 B", "1.00 KB", "1.50 KB", "100 KB", "5.00 GB", "3072 TB"]


def test_local_days(spark):
    stamps = table(spark, [0, -1, 1709164800 - 1, 1711846800], "ts", "bigint")
    utc = [str(r[0]) for r in stamps.select(clock.local_day("ts")).collect()]
    assert utc == ["1970-01-01", "1969-12-31", "2024-02-28", "2024-03-31"]
    east = [str(r[0]) for r in stamps.select(clock.local_day("ts", "Asia/Shanghai")).collect()]
    assert east == ["1970-01-01", "1970-01-01", "2024-02-29", "2024-03-31"]
