"""IP addresses as SQL expressions: canonical text, CIDR membership, address class.

Functions take SQL text of a string expression (a column name, usually) and return SQL text. Valid IPv4 text is
compared octet by octet with plain string tests; IPv6 becomes 32 hex digits, so that a network is a
closed range of text. The rare IPv6 branches sit in lambdas, which keeps the generated code of the
common path small enough to be compiled to machine code. No Python worker is needed.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Mapping, Sequence
from itertools import count

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"r'^{_OCTET}(?:\.{_OCTET}){{3}}$'"
_IPV4_TAIL = rf"r'^(.*:)({_OCTET}(?:\.{_OCTET}){{3}})$'"
_GROUP = "[0-9a-f]{1,4}"
_GROUPS = f"{_GROUP}(?::{_GROUP})*"
_IPV6 = f"r'^(?:{_GROUP}(?::{_GROUP}){{7}}|(?:{_GROUPS})?::(?:{_GROUPS})?)$'"

# Special-purpose IPv4 blocks that count as private, and the
# exceptions inside them (IANA registry).
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
PUBLIC_IN_PRIVATE_V4 = ("192.0.0.9/32", "192.0.0.10/32")
# The same for IPv6.
PRIVATE_V6 = (
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
PUBLIC_IN_PRIVATE_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
)
# IPv6 blocks the IETF keeps reserved.
RESERVED_V6 = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3",
    "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5",
    "f800::/6", "fe00::/9",
)

# Location label of each address class.
CLASS_LABELS = {
    "invalid": "无效地址",
    "loopback": "本机",
    "private": "内网地址",
    "reserved": "保留地址",
    "public": "未知",
}
UNKNOWN_LOCATION = CLASS_LABELS["public"]

_names = count()


def let(value: str, body) -> str:
    """Evaluate ``value`` once; ``body`` gets the name of the lambda variable that holds it."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _any(tests: Sequence[str]) -> str:
    return "(" + " OR ".join(tests) + ")" if tests else "false"


# -- IPv4 ----------------------------------------------------------------------------

def is_v4(a: str) -> str:
    return f"({a} RLIKE {IPV4})"


def v4_text(number: str) -> str:
    """BIGINT as dotted quad."""
    octets = ", ".join(f"(shiftrightunsigned({number}, {s}) & 255)" for s in (24, 16, 8, 0))
    return f"concat_ws('.', {octets})"


def v4_hex(a: str, separator: str = "") -> str:
    """Dotted quad as 8 hex digits, null when it is none."""
    digits = [f"lpad(lower(hex(try_cast(split_part({a}, '.', {i}) AS INT))), 2, '0')" for i in (1, 2, 3, 4)]
    return f"concat({digits[0]}, {digits[1]}, '{separator}', {digits[2]}, {digits[3]})"


def _in_v4(net: ipaddress.IPv4Network, a: str) -> str:
    octets, whole, rest = net.network_address.packed, net.prefixlen // 8, net.prefixlen % 8
    if whole == 4:
        return f"{a} = '{net.network_address}'"
    tests = []
    if whole:
        tests.append(f"startswith({a}, '{'.'.join(map(str, octets[:whole]))}.')")
    if rest:
        low = octets[whole]
        high = low + (1 << (8 - rest)) - 1
        tests.append(f"try_cast(split_part({a}, '.', {whole + 1}) AS INT) BETWEEN {low} AND {high}")
    return "(" + " AND ".join(tests or ["true"]) + ")"


# -- IPv6 ----------------------------------------------------------------------------

def _padded(groups: str) -> str:
    name = f"v{next(_names)}"
    kept = f"filter(split({groups}, ':'), {name} -> {name} != '')"
    return f"transform({kept}, {name} -> lpad({name}, 4, '0'))"


def v6_hex(a: str) -> str:
    """IPv6 text (any case, optional zone) as 32 hex digits; null when invalid."""

    def widen(plain: str) -> str:
        def join(halves: str) -> str:
            tail = f"CASE WHEN size({halves}.b) > 1 THEN {_padded(f'{halves}.b[1]')} ELSE array() END"
            return let(
                f"named_struct('n', size({halves}.b), 'h', {_padded(f'{halves}.b[0]')}, 't', {tail})",
                lambda g: f"CASE WHEN {g}.n = 1 OR size({g}.h) + size({g}.t) <= 7 THEN "
                f"array_join(concat({g}.h, array_repeat('0000', 8 - size({g}.h) - size({g}.t)), {g}.t), '')"
                " END",
            )

        parted = let(f"named_struct('b', split({plain}, '::', -1))", join)
        return f"CASE WHEN {plain} RLIKE {_IPV6} THEN {parted} END"

    def expand(bare: str) -> str:
        quad = let(f"regexp_extract({bare}, {_IPV4_TAIL}, 2)", lambda q: v4_hex(q, ":"))
        plain = (
            f"CASE WHEN {bare} RLIKE {_IPV4_TAIL} THEN "
            f"concat(regexp_extract({bare}, {_IPV4_TAIL}, 1), {quad}) ELSE {bare} END"
        )
        return let(plain, widen)

    bare = f"lower(regexp_replace({a}, '%[^%]+$', ''))"
    return f"CASE WHEN contains({a}, ':') THEN {let(bare, expand)} END"


def _shorten(groups: str) -> str:
    """Replace the longest run of two or more zero groups, leftmost first, by ``::``."""
    run = lambda n: f"r'^(?:(.*?):)??0(?::0){{{n - 1}}}(?::(.*))?$'"
    arms = " ".join(
        f"WHEN {groups} RLIKE {run(n)} THEN regexp_replace({groups}, {run(n)}, '$1::$2')"
        for n in range(8, 1, -1)
    )
    return f"CASE {arms} ELSE {groups} END"


def v6_text(digits: str) -> str:
    """32 hex digits as canonical IPv6 text."""
    groups = ", ".join(
        f"regexp_replace(substring({digits}, {4 * i + 1}, 4), '^0{{1,3}}', '')" for i in range(8)
    )
    quad = let(f"CAST(conv(substring({digits}, 25, 8), 16, 10) AS BIGINT)", v4_text)
    return (
        f"CASE WHEN startswith({digits}, '{'0' * 20}ffff') THEN concat('::ffff:', {quad}) "
        f"ELSE {let(f'concat_ws(chr(58), {groups})', _shorten)} END"
    )


def _canonical_v6(a: str) -> str:
    text = lambda d: f"CASE WHEN {d} IS NOT NULL THEN {v6_text(d)} END"
    return f"concat({let(v6_hex(a), text)}, regexp_extract({a}, '(%[^%]+)$', 1))"


def canonical(a: str) -> str:
    """Canonical text of an IPv4 or IPv6 address, null when it is neither."""
    return (
        f"CASE WHEN {is_v4(a)} THEN {a} "
        f"WHEN contains({a}, ':') THEN {let(a, _canonical_v6)} END"
    )


def header_address(value: str) -> str:
    """Address in a header field: trimmed, brackets and a port removed, canonical."""

    def clean(text: str) -> str:
        bare = (
            f"CASE WHEN contains({text}, '.') AND {text} RLIKE '^[^:]*:[^:]*$' "
            f"THEN substring_index({text}, ':', 1) ELSE {text} END"
        )
        return let(bare, canonical)

    def trim(raw: str) -> str:
        stripped = (
            rf"regexp_replace(regexp_replace({raw}, r'^\s+|\s+$', ''), r'^[\[\]]+|[\[\]]+$', '')"
        )
        return let(stripped, clean)

    return (
        f"CASE WHEN {value} IS NULL OR {value} IN ('', '-') THEN NULL "
        f"WHEN {is_v4(value)} THEN {value} ELSE {let(value, trim)} END"
    )


# -- networks ------------------------------------------------------------------------

def _network(cidr: str):
    try:
        return ipaddress.ip_network(str(cidr), strict=False)
    except ValueError:
        return None


def _in_v6(net: ipaddress.IPv6Network, digits: str) -> str:
    low, high = int(net.network_address), int(net.broadcast_address)
    return f"{digits} BETWEEN '{low:032x}' AND '{high:032x}'"


def in_networks(a: str, cidrs: Sequence[str]) -> str:
    """Whether a canonical address lies in any network of the list.

    Networks after the first malformed one are not considered.
    """
    networks = []
    for cidr in cidrs:
        net = _network(cidr)
        if net is None:
            break
        networks.append(net)
    in_v4 = _any([_in_v4(n, a) for n in networks if n.version == 4])
    v6 = [n for n in networks if n.version == 6]
    if not v6:
        return f"coalesce({in_v4} AND NOT contains({a}, ':'), false)"
    in_v6 = let(v6_hex(a), lambda d: _any([_in_v6(n, d) for n in v6]))
    return f"coalesce(CASE WHEN contains({a}, ':') THEN {in_v6} ELSE {in_v4} END, false)"


# Request fields a trusted proxy may name the client in, in order of trust.
CLIENT_FIELDS = (
    "cf_connecting_ip",
    "true_client_ip",
    "ali_cdn_real_ip",
    "cdn_real_ip",
    "x_real_ip",
    "client_ip",
)


def peer_address(fields: Mapping[str, str]) -> str:
    """Address of the connection itself; ``fields`` maps header fields to SQL text."""
    peer = _either(fields, "remote_addr", "ip")
    return "CAST(NULL AS STRING)" if peer is None else let(peer, header_address)


def _either(fields: Mapping[str, str], *names: str) -> str | None:
    given = [f"nullif({fields[n]}, '')" for n in names if n in fields]
    return f"coalesce({', '.join(given)})" if given else None


def client_behind(peer: str, fields: Mapping[str, str], trusted: Sequence[str]) -> str:
    """Real client address behind a peer that may be a trusted proxy.

    The first valid client field counts; then the forwarding chain from its right end, up
    to the first address that is no trusted proxy; then its leftmost address; then the peer.
    """
    named = [header_address(fields[n]) for n in CLIENT_FIELDS if n in fields]
    forwarded = _either(fields, "x_forwarded_for", "forwarded_for")
    if forwarded is not None:
        hop = f"v{next(_names)}"
        bare = f"transform(split({forwarded}, ','), {hop} -> trim({hop}))"
        hops = (
            f"filter(transform({bare}, {hop} -> {header_address(hop)}), {hop} -> {hop} IS NOT NULL)"
        )
        foreign = f"v{next(_names)}"

        def outermost(chain: str) -> str:
            outside = f"filter(reverse({chain}), {foreign} -> NOT {in_networks(foreign, trusted)})"
            return f"coalesce(get({outside}, 0), get({chain}, 0))"

        # most chains end in one or two plain IPv4 hops: those need no arrays
        last = f"trim(substring_index({forwarded}, ',', -1))"
        before = f"trim(substring_index(substring_index({forwarded}, ',', -2), ',', 1))"
        plain_foreign = lambda hop: f"{is_v4(hop)} AND NOT {in_networks(hop, trusted)}"
        named.append(
            f"CASE WHEN {plain_foreign(last)} THEN {last} "
            f"WHEN {is_v4(last)} AND {plain_foreign(before)} THEN {before} "
            f"ELSE {let(hops, outermost)} END"
        )
    return (
        f"CASE WHEN {peer} IS NULL THEN '' WHEN NOT {in_networks(peer, trusted)} THEN {peer} "
        f"ELSE coalesce({', '.join([*named, peer])}) END"
    )


# -- classes and labels --------------------------------------------------------------

def _class_v4(a: str) -> str:
    inside = lambda cidrs: _any([_in_v4(_network(c), a) for c in cidrs])
    return (
        f"CASE WHEN startswith({a}, '127.') THEN 'loopback' "
        f"WHEN {inside(PRIVATE_V4)} AND NOT {inside(PUBLIC_IN_PRIVATE_V4)} THEN 'private' "
        f"WHEN {inside(['224.0.0.0/4'])} THEN 'reserved' ELSE 'public' END"
    )


def _class_v6(digits: str) -> str:
    inside = lambda cidrs: _any([_in_v6(_network(c), digits) for c in cidrs])
    quad = let(v4_text(f"CAST(conv(substring({digits}, 25, 8), 16, 10) AS BIGINT)"), _class_v4)
    mapped = let(quad, lambda c: f"CASE WHEN {c} IN ('loopback', 'private') THEN {c} ELSE 'reserved' END")
    return (
        f"CASE WHEN {digits} IS NULL THEN 'invalid' "
        f"WHEN startswith({digits}, '{'0' * 20}ffff') THEN {mapped} "
        f"WHEN {digits} = '{1:032x}' THEN 'loopback' "
        f"WHEN {inside(PRIVATE_V6)} AND NOT {inside(PUBLIC_IN_PRIVATE_V6)} THEN 'private' "
        f"WHEN {inside(['ff00::/8'])} OR {inside(RESERVED_V6)} THEN 'reserved' ELSE 'public' END"
    )


def address_class(a: str) -> str:
    """invalid, loopback, private, reserved or public."""
    any_form = lambda t: (
        f"CASE WHEN {is_v4(t)} THEN {_class_v4(t)} "
        f"WHEN contains({t}, ':') THEN {let(v6_hex(t), _class_v6)} ELSE 'invalid' END"
    )
    return let(f"trim({a})", any_form)


def class_label(address_class: str) -> str:
    arms = " ".join(f"WHEN '{key}' THEN '{label}'" for key, label in CLASS_LABELS.items())
    return f"CASE {address_class} {arms} END"


def place_name(country: str, region: str, city: str) -> str:
    """Distinct non-empty parts joined by a middle dot, or the unknown label."""
    part = f"v{next(_names)}"
    parts = f"filter(array({country}, {region}, {city}), {part} -> {part} != '')"
    return f"coalesce(nullif(array_join(array_distinct({parts}), ' · '), ''), '{UNKNOWN_LOCATION}')"
