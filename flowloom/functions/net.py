"""Addresses, ports and networks as column expressions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import constants as K

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# fixed values: IPv4 networks that are not public Internet
_V4_PRIVATE = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
               "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4"]
_V4_PUBLIC_WITHIN = ["192.0.0.9/32", "192.0.0.10/32"]
_V4_LOOPBACK, _V4_LINK_LOCAL, _V4_MULTICAST = ["127.0.0.0/8"], ["169.254.0.0/16"], ["224.0.0.0/4"]

# fixed values: IPv6 networks by class
_V6_PRIVATE = ["::/128", "::1/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"]
_V6_PUBLIC_WITHIN = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]
_V6_GLOBAL, _V6_SITE, _V6_LINK_LOCAL, _V6_MULTICAST = ["2000::/3"], ["fec0::/10"], ["fe80::/10"], ["ff00::/8"]
_V6_MAPPED = "00000000000000000000ffff"


def _v4_value(ip: Column) -> Column:
    parts = [F.substring_index(ip, ".", 1), F.substring_index(F.substring_index(ip, ".", 2), ".", -1),
             F.substring_index(F.substring_index(ip, ".", -2), ".", 1), F.substring_index(ip, ".", -1)]
    value = F.lit(0).cast("bigint")
    for part, weight in zip(parts, (1 << 24, 1 << 16, 1 << 8, 1)):
        value = value + part.try_cast("bigint") * F.lit(weight).cast("bigint")
    return value


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ip_number(ip: Column) -> Column:
    """IPv4 text to BIGINT, null for anything else."""
    return F.when(ip.rlike(_V4), _v4_value(ip))


def _base(text: Column) -> Column:
    """IPv6 text in lower case and without its scope; other text as it is."""
    return F.when(text.contains(":"), F.lower(F.substring_index(text, "%", 1))).otherwise(text)


def _digits(text: Column, base: Column, number: Column) -> Column:
    """The 32 hexadecimal digits of IPv6 text; ``number`` is that of an IPv4 address in its last group."""
    last = F.substring_index(base, ":", -1)
    tail = F.concat(F.lpad(F.hex(F.shiftright(number, 16)), 4, "0"), F.lit(":"), F.lpad(F.hex(number.bitwiseAND(0xFFFF)), 4, "0"))
    plain = F.when(~base.contains("."), base).otherwise(F.lower(F.concat(F.substring(base, F.lit(1), F.length(base) - F.length(last)), tail)))
    none = F.array().cast("array<string>")

    def groups(half: Column) -> Column:
        return F.when(half == "", none).otherwise(F.split(half, ":"))

    def joined(halves: Column) -> Column:
        head = groups(F.element_at(halves, 1))
        rest = F.when(F.size(halves) > 1, groups(F.element_at(halves, -1))).otherwise(none)
        short = F.lit(8) - F.size(head) - F.size(rest)
        right = F.when(F.size(halves) == 2, short >= 1).otherwise((F.size(halves) == 1) & (short == 0))
        every = F.concat(head, F.array_repeat(F.lit("0"), short), rest)

        def is_group(g: Column) -> Column:
            return F.length(g).between(1, 4) & (F.translate(g, "0123456789abcdef", "") == "")

        return F.when(right & F.forall(every, is_group), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    scope = F.substring(text, F.length(F.substring_index(text, "%", 1)) + 1, F.length(text))
    named = (F.length(scope) > 1) & ~F.substring(scope, F.lit(2), F.length(scope)).contains("%")
    return F.when(text.contains(":") & ((scope == "") | named), bound(F.split(plain, "::"), joined))


def ip6_digits(ip: Column) -> Column:
    """IPv6 text to its 32 hexadecimal digits, null for anything else; a scope after ``%`` is left out."""
    return bound(_base(ip), lambda base: bound(ip_number(F.substring_index(base, ":", -1)), lambda n: _digits(ip, base, n)))


def _within(value: Column, networks: list[str]) -> Column:
    """Whether an address, as a number or as hexadecimal digits, lies in one of the networks."""
    hit = F.lit(False)
    for network in map(ipaddress.ip_network, networks):
        low, high = int(network.network_address), int(network.broadcast_address)
        if network.version == 4:
            hit = hit | value.between(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))
        else:
            hit = hit | value.between(f"{low:032x}", f"{high:032x}")
    return hit


def _v4_private(n: Column) -> Column:
    return _within(n, _V4_PRIVATE) & ~_within(n, _V4_PUBLIC_WITHIN)


def _v6_private(d: Column) -> Column:
    mapped = F.conv(F.substring(d, 25, 8), 16, 10).cast("bigint")
    own = _within(d, _V6_PRIVATE) & ~_within(d, _V6_PUBLIC_WITHIN)
    return F.when(F.substring(d, 1, 24) == _V6_MAPPED, bound(mapped, _v4_private)).otherwise(own)


# bits of an address class
V4, V6, EMPTY, PRIVATE, INTERNAL, LOOPBACK, LINK_LOCAL, MULTICAST = (1 << i for i in range(8))


def _bits(own: int, private: Column, others: dict[int, Column], also_internal: Column) -> Column:
    out = F.lit(own)
    for bit, holds in others.items():
        out = out + F.when(holds, bit).otherwise(0)
    return out + F.when(private, PRIVATE | INTERNAL).when(also_internal, INTERNAL).otherwise(0)


def _v4_class(n: Column) -> Column:
    multicast = _within(n, _V4_MULTICAST)
    return _bits(V4, _v4_private(n), {
        LOOPBACK: _within(n, _V4_LOOPBACK), LINK_LOCAL: _within(n, _V4_LINK_LOCAL), MULTICAST: multicast}, multicast)


def _v6_class(d: Column) -> Column:
    return _bits(V6, _v6_private(d), {
        LOOPBACK: _within(d, ["::1/128"]), LINK_LOCAL: _within(d, _V6_LINK_LOCAL), MULTICAST: _within(d, _V6_MULTICAST)},
        ~_within(d, [*_V6_GLOBAL, *_V6_SITE]))


def _text_class(text: Column) -> Column:
    """Class of text as it stands: 0 for what is no address. One regular expression, evaluated once."""
    def known(base: Column, number: Column) -> Column:
        v4 = F.when(number.isNotNull(), bound(number, _v4_class)).otherwise(0)
        v6 = bound(_digits(text, base, number), lambda d: F.when(d.isNotNull(), _v6_class(d)).otherwise(0))
        return F.when(text.contains(":"), v6).otherwise(v4)

    return F.coalesce(bound(_base(text), lambda base: bound(
        ip_number(F.substring_index(base, ":", -1)), lambda number: known(base, number))), F.lit(0))


def _may_be_internal(text: Column) -> Column:
    """Whether text starts like an address of the networks above; others need no closer look."""
    firsts: set[int] = set()
    for network in map(ipaddress.ip_network, _V4_PRIVATE + _V4_MULTICAST):
        firsts.update(range(network.network_address.packed[0], network.broadcast_address.packed[0] + 1))
    return text.contains(":") | F.substring_index(text, ".", 1).isin(*map(str, sorted(firsts)))


def address_class(ip: Column) -> Column:
    """All that the tests below ask about an address, as bits of one integer.

    Empty counts as internal, unparsable text has no bits and so counts as external. Tables that many
    tests read keep it as a column, see :func:`with_address_classes`.
    """
    return F.when(ip.isNull() | (F.trim(ip) == ""), EMPTY | INTERNAL).otherwise(bound(F.trim(ip), _text_class))


def class_column(name: str) -> str:
    return f"{name}_class"


def with_address_classes(df: DataFrame, *names: str) -> DataFrame:
    """Add the class of each named address column, for tables that several rules read."""
    return df.withColumns({class_column(n): address_class(F.col(n)) for n in names})


def class_of(df: DataFrame, name: str) -> Column:
    """The class of an address column: the kept one where the table has it."""
    return F.col(class_column(name)) if class_column(name) in df.columns else address_class(F.col(name))


def internal_of(df: DataFrame, name: str) -> Column:
    """:func:`is_internal_ip` of an address column, from its class where the table has it."""
    return has(F.col(class_column(name)), INTERNAL) if class_column(name) in df.columns else is_internal_ip(F.col(name))


def has(mask: Column, *bits: int) -> Column:
    return mask.bitwiseAND(sum(bits)) != 0


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(_V4), F.lit(False))


def is_ip(value: Column) -> Column:
    return has(bound(value, _text_class), V4, V6)


def is_internal_ip(ip: Column) -> Column:
    """Not public Internet. Empty counts as internal, unparsable text as external."""
    text = F.trim(ip)
    return F.when(ip.isNull() | (text == ""), True).otherwise(_may_be_internal(text) & has(bound(text, _text_class), INTERNAL))


def is_external_ip(ip: Column) -> Column:
    return ~is_internal_ip(ip)


def is_private_ip(ip: Column) -> Column:
    """The report's narrower test: private ranges only; empty or unparsable text is not private."""
    return has(bound(ip, _text_class), PRIVATE)


def ip_scope(ip: Column) -> Column:
    """``none``, ``invalid``, ``loopback``, ``link_local``, ``multicast``, ``private``, ``public``."""
    return bound(address_class(ip), lambda m: (
        F.when(has(m, EMPTY), "none").when(m == 0, "invalid").when(has(m, LOOPBACK), "loopback")
        .when(has(m, LINK_LOCAL), "link_local").when(has(m, MULTICAST), "multicast").when(has(m, INTERNAL), "private")
        .otherwise("public")))


def is_lan_destination(ip: Column) -> Column:
    """The flow record's variant: private, loopback or link-local (multicast is not)."""
    return ip_scope(ip).isin("private", "loopback", "link_local")


def cidr_bounds(cidr: str) -> tuple[int, int]:
    """First and last address of an IPv4 network given as text (driver-side parameter)."""
    net = ipaddress.ip_network(cidr, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_cidrs(ip_num: Column, cidrs: list[str]) -> Column:
    """Literal range test for a short list of networks; ``ip_num`` is an :func:`ip_number` column."""
    hit = F.lit(False)
    for cidr in cidrs:
        if ":" in cidr:
            continue
        lo, hi = cidr_bounds(cidr)
        hit = hit | ip_num.between(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"))
    return F.coalesce(hit, F.lit(False))


def is_local_only(src: Column, dst: Column) -> Column:
    return is_internal_ip(src) & is_internal_ip(dst)


def is_lan_service(dst: Column, port: Column, protocol: Column) -> Column:
    """Discovery and address-assignment traffic that stays on the local network."""
    proto = F.upper(F.coalesce(F.nullif(protocol, F.lit("")), F.lit("TCP")))
    return is_internal_ip(dst) & F.coalesce(port, F.lit(0)).isin(*K.LAN_SERVICE_PORTS) & (proto == "UDP")


def packet_severity(dst: Column, port: Column, protocol: Column, info: Column) -> Column:
    """Severity class of one packet or event from port, scope and text."""
    text = F.lower(F.coalesce(info, F.lit("")))
    keyword = F.lit(False)
    for word in K.CLASSIFY_KEYWORDS:
        keyword = keyword | text.contains(word)
    outside = F.when(port.isin(*K.SUSPICIOUS_PORTS), "high").when(protocol.isin("TCP", "UDP"), "medium")
    return F.when(port.isin(*K.HIGH_RISK_PORTS), "critical").otherwise(F.coalesce(
        F.when(is_external_ip(dst), outside), F.when(keyword, "high"), F.lit("info")))


def app_layer(protocol: Column, server_port: Column, src_port: Column, dst_port: Column,
              payload_len: Column, first_byte: Column, request_line: Column) -> Column:
    """Application layer told by one packet; null where the packet says nothing.

    ``request_line`` is true for a payload that starts with an HTTP GET or POST.
    """
    tcp = (
        F.when(F.coalesce(payload_len, F.lit(0)) <= 0, F.lit(None).cast("string"))
        .when(server_port.isin(443, 8443) | F.coalesce(first_byte == 0x16, F.lit(False)), "TLS")
        .when(server_port.isin(80, 8080, 8000) | F.coalesce(request_line, F.lit(False)), "HTTP")
        .when(server_port == 22, "SSH")
        .when(server_port == 445, "SMB")
        .when(server_port == 3389, "RDP")
    )
    return (
        F.when(protocol == "ICMP", "ICMP")
        .when(protocol == "UDP", F.when((dst_port == 53) | (src_port == 53), "DNS"))
        .when(protocol == "TCP", tcp)
    )


def tcp_flag_text(flags: Column) -> Column:
    """``SYN,ACK,FIN,RST`` subset set in the flag byte, ``data`` when none is."""
    names = F.array_compact(F.array(*[
        F.when(flags.bitwiseAND(bit) != 0, name)
        for bit, name in ((0x02, "SYN"), (0x10, "ACK"), (0x01, "FIN"), (0x04, "RST"))
    ]))
    return F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise("data")


def tls_fingerprint(version: Column, ciphers: Column, extensions: Column, groups: Column,
                    formats: Column) -> Column:
    """Client fingerprint in its published form: five comma-separated fields, lists joined by ``-``."""
    def joined(values: Column) -> Column:
        return F.array_join(F.coalesce(values, F.array().cast("array<int>")).cast("array<string>"), "-")

    text = F.concat_ws(",", version.cast("string"), joined(ciphers), joined(extensions),
                       joined(groups), joined(formats))
    return F.when(version.isNotNull(), F.md5(text))
