"""Log lines and live messages."""

import pytest

from hitfold.operators import parse
from hitfold.options import Options

LINE = ('198.51.100.23 - - [14/Mar/2025:03:04:05 -0500] "POST /cart/add?item=42 HTTP/1.0" 302 77 '
        '"https://shop.invalid/cart" "Demo/2.1"')


def parse_one(spark, line):
    return parse.parse_lines(spark.createDataFrame([(line,)], "value string")).first()


def test_combined_line(spark):
    r = parse_one(spark, LINE)
    assert (r.timestamp, r.remote_addr, r.method, r.uri, r.protocol) == (
        1741939445, "198.51.100.23", "POST", "/cart/add?item=42", "HTTP/1.0")
    assert (r.status, r.body_bytes, r.referer, r.user_agent, r.host) == (
        302, 77, "https://shop.invalid/cart", "Demo/2.1", "")


def test_common_line_and_missing_size(spark):
    r = parse_one(spark, '2001:db8:5::9 - - [02/Jan/2025:23:59:59 +0000] "OPTIONS /any HTTP/3.0" 205 -')
    assert (r.remote_addr, r.method, r.status, r.body_bytes, r.referer, r.user_agent) == (
        "2001:db8:5::9", "OPTIONS", 205, 0, "", "")


@pytest.mark.parametrize("line", [
    "not an access log", "",
    '1.1.1.1 - - [31/Feb/2026:10:21:30 +0800] "GET / HTTP/1.1" 200 1',
    '1.1.1.1 - - [01/Foo/2026:10:21:30 +0800] "GET / HTTP/1.1" 200 1',
    '1.1.1.1 - - [01/Feb/2026:24:21:30 +0800] "GET / HTTP/1.1" 200 1',
    '1.1.1.1 - - [01/Feb/2026:10:21:30 +2400] "GET / HTTP/1.1" 200 1',
    '1.1.1.1 - - [01/Feb/2026:10:21:30] "GET / HTTP/1.1" 200 1',
    '1.1.1.1 - - [01/Feb/2026:10:21:30 +0000] "GET / HTTP/1.1" 20 1',
    '1.1.1.1 - - [01/Feb/2026:10:21:30 +0000] "GET / HTTP/1.1" 200 99999999999999999999',
])
def test_rejected_lines(spark, line):
    assert all(v is None for v in parse_one(spark, line))


def test_odd_but_valid_lines(spark):
    r = parse_one(spark, r'1.1.1.1 - - [1/sep/2026:10:21:30 -0130] "GET /a\"b\x22c\x5Cd HTTP/1.1" 404 12 "-" "x" more')
    assert (r.uri, r.timestamp, r.user_agent) == ('/a"b"c\\d', 1788263490, "x")
    r = parse_one(spark, '1.1.1.1 - - [01/Feb/2026:10:21:30 +2359] "" 200 1 "-" "x"')
    assert (r.method, r.uri, r.protocol) == ("", "", "")
    r = parse_one(spark, '  9.9.9.9 - bob [01/Feb/2026:10:21:30 +0000] "GET / b c d" 200 9 "-" "open')
    assert (r.method, r.uri, r.protocol, r.referer, r.user_agent) == ("GET", "/", "b c d", "", "")
    r = parse_one(spark, '1.1.1.1 - - [01/Feb/2026:10:21:30 +0000] "GET /"  200 1 "-" "x"\r')
    assert (r.method, r.uri, r.protocol, r.user_agent) == ("GET", "/", "", "x")


def test_long_values_stay_whole(spark):
    r = parse_one(spark, LINE.replace("/cart/add?item=42", "/" + "a" * 20000).replace("Demo", "d" * 9000))
    assert (len(r.uri), len(r.user_agent)) == (20001, 9004)


def test_accounting(spark):
    stamp = '- - [01/Sep/2026:10:20:30 +0800] "GET'
    lines = [f'1.1.1.1 {stamp} / HTTP/1.1" 200 100', f'1.1.1.2 {stamp} /app.js HTTP/1.1" 200 200',
             f'1.1.1.1 {stamp} /missing HTTP/1.1" 404 50', f'1.1.1.1 {stamp} /internal-health HTTP/1.1" 200 1']
    parsed = parse.parse_lines(spark.createDataFrame([(1, x) for x in lines], "site_id int, value string"))
    judged = parse.judge(parsed, Options(excluded_paths=("/internal-",)))
    assert tuple(parse.accounting(judged, ["site_id"]).first()) == (1, 4, 3, 1)
    late = parse.judge(parsed, Options(), since=1788229231)
    assert tuple(parse.accounting(late, ["site_id"]).first()) == (1, 4, 0, 4)


def message(spark, text, **options):
    rows = spark.createDataFrame([(text,)], "value string")
    return parse.parse_messages(rows, Options(**options)).first()


def test_live_message(spark):
    r = message(spark, '<190>Sep  1 13:40:22 wa_17_access: {"time":"2026-09-01T13:40:22+08:00","ip":"203.0.113.2",'
                       '"method":"GET","uri":"/news?id=1","protocol":"HTTP/2.0","status":200,"bytes":1234,'
                       '"referer":"-","ua":"Mozilla/5.0"}')
    assert (r.panel_site_id, r.timestamp, r.remote_addr, r.uri, r.status, r.body_bytes, r.user_agent) == (
        17, 1788241222, "203.0.113.2", "/news?id=1", 200, 1234, "Mozilla/5.0")


def test_live_message_fallbacks(spark):
    r = message(spark, 'wa_1_access: {"time":"2026-09-01T13:40:22Z","remote_addr":"10.0.0.8","status":"404",'
                       '"x_forwarded_for":"198.51.100.7, 10.0.0.7","bytes":-3,"ua":"","user_agent":"b"}')
    assert (r.timestamp, r.remote_addr, r.status, r.body_bytes, r.user_agent) == (
        1788270022, "198.51.100.7", 404, 0, "b")
    r = message(spark, 'wa_1_access: {"time":"2026-09-01T13:40:22+0800"}')
    assert (r.timestamp, r.status, r.body_bytes, r.uri) == (1788241222, 0, 0, "")
    r = message(spark, 'wa_1_access: {"time":"2026-09-01 13:40:22"}', timezone="Asia/Shanghai")
    assert r.timestamp == 1788241222


@pytest.mark.parametrize("text", [
    "nothing", "wa_x_access: {}", 'wa_1_access: {"time":"x"}', "wa_1_access: {'time':'2026-09-01T13:40:22Z'}",
    'wa_1_access: {"time":"2026-09-01T13:40:22Z","bytes":"-"}', 'xwa_1_access: {"time":"2026-09-01T13:40:22Z"}',
    'wa_1_access: {"time":"2026-09-01T13:40:22Z","status":"abc"}', 'wa_1_access: {"ip":"1.1.1.1"}',
])
def test_rejected_messages(spark, text):
    assert all(v is None for v in message(spark, text))


def test_a_filter_does_not_repeat_the_pattern(spark):
    lines = spark.createDataFrame([(LINE,)], "value string")
    events = parse.parse_lines(lines).where("timestamp > 0 and status = 200")
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") == 1
