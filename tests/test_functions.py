import ipaddress
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.functions import net, sqlfunctions, text, values

c = F.col


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(c("x")).alias("y")).first()["y"]


def internal(s):
    """The address test by the standard library."""
    if not s or not s.strip():
        return True
    try:
        ip = ipaddress.ip_address(s.strip())
    except ValueError:
        return False
    return bool(ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved
                or ip.is_unspecified or s == "255.255.255.255")


ADDRESSES = [
    "192.168.1.1", "239.255.255.250", "224.0.0.251", "127.0.0.1", "8.8.8.8", "", None, "  ", "x", "1.2.3", "1.2.3.4.5",
    "256.1.1.1", "01.2.3.4", "10.0.0.1", "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.0.0.8", "192.0.0.9",
    "192.0.0.10", "192.0.0.170", "192.0.2.1", "192.0.3.1", "198.17.0.1", "198.18.0.1", "198.19.255.1", "198.20.0.1",
    "198.51.100.7", "203.0.113.9", "203.0.114.9", "100.64.0.1", "169.254.3.4", "0.0.0.0", "0.1.2.3", "240.0.0.1",
    "255.255.255.255", "223.255.255.255", "::1", "::", "fe80::1", "ff02::1", "2001:db8::1", "2001:0db8::1", "2002:1::",
    "2606:4700::1111", "2a00:1450::1", "3fff::1", "fd00::1", "2001:4860:4860::8888", "2001:0:1::", "64:ff9b::1",
]


def test_internal_addresses_match_the_standard_library(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    got = {r.ip: r.i for r in df.select("ip", net.is_internal_ip(c("ip")).alias("i")).collect()}
    assert got == {a: internal(a) for a in ADDRESSES}


ODD = ["aa:bb:cc:dd:ee:ff", "1:2:3", "::::", ":::", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "::1:2:3:4:5:6:7:8",
       ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::1.2.3", "::256.1.1.1", "1.2.3.4::", "12345::", "g::1",
       "2001:1::1", "2001:1::2", "2001:1::3", "2001:3::1", "2001:4:112::1", "2001:20::1", "2001:30::5", "2001:1ff::1", "2001:200::1", "2002:808:808::", "fec0::1", "FF02::FB", "FE80::A",
       "1.2.3.4%x", "::%1", "2001:DB8::1", "100::1", "100:0:0:1::1", "64:ff9b:1::9", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fc00::", "fdff::9", " 10.0.0.1 "]


def test_addresses_of_every_form_match_the_standard_library(spark):
    import random

    rng = random.Random(1)
    texts = list(ODD)
    for _ in range(400):
        n = rng.choice([rng.getrandbits(128), rng.getrandbits(64), 0x2001 << 112 | rng.getrandbits(rng.choice([16, 90, 112])), 0xfe << 120 | rng.getrandbits(119)])
        ip = ipaddress.IPv6Address(n)
        texts += [rng.choice([ip.compressed, ip.exploded, ip.compressed.upper()])]
        texts.append(":".join(rng.choice(["", "0", "ab", "1f2e", "xyz"]) for _ in range(rng.randint(1, 9))))
    df = spark.createDataFrame([(a,) for a in texts], "ip string")
    out = df.select("ip", net.is_internal_ip(c("ip")).alias("i"), net.is_ip(c("ip")).alias("v"), net.is_private_ip(c("ip")).alias("p")).collect()

    def valid(s):
        try:
            return ipaddress.ip_address(s)
        except ValueError:
            return None

    assert [(r.ip, r.i) for r in out] == [(a, internal(a)) for a in texts]
    assert [(r.ip, r.v) for r in out] == [(a, valid(a) is not None) for a in texts]
    assert [(r.ip, r.p) for r in out] == [(a, bool(valid(a) and valid(a).is_private)) for a in texts]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=300, max_size=300))
def test_random_ipv4(spark, numbers):
    addresses = [str(ipaddress.ip_address(n)) for n in numbers]
    df = spark.createDataFrame([(a,) for a in addresses], "ip string")
    out = df.select("ip", net.is_internal_ip(c("ip")).alias("i"), net.ip_number(c("ip")).alias("n")).collect()
    assert all(r.i == internal(r.ip) and r.n == int(ipaddress.ip_address(r.ip)) for r in out)


def entropy(items):
    n = len(items)
    return -sum(k / n * math.log2(k / n) for k in Counter(items).values()) if n else 0.0


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="abcdefgé0123.-", max_size=20), min_size=150, max_size=150))
def test_entropy_and_ratios(spark, names):
    sqlfunctions.register(spark)
    df = spark.createDataFrame([(n,) for n in names], "s string")
    out = df.select("s", text.shannon_entropy(c("s")).alias("e"), text.bigram_entropy(c("s")).alias("b"),
                    text.consonant_vowel_ratio(c("s")).alias("r"), F.expr("fl_entropy(s)").alias("q"),
                    F.expr("fl_bigram_entropy(s)").alias("qb"), F.expr("fl_consonant_ratio(s)").alias("qr")).collect()
    for r in out:
        pairs = [r.s[i:i + 2] for i in range(len(r.s) - 1)]
        assert math.isclose(r.e, entropy(r.s), abs_tol=1e-9) and math.isclose(r.q, r.e, abs_tol=1e-9)
        assert math.isclose(r.b, entropy(pairs), abs_tol=1e-9) and math.isclose(r.qb, r.b, abs_tol=1e-9)
        low = r.s.lower()
        vowels = sum(ch in "aeiou" for ch in low)
        assert math.isclose(r.r, sum(ch.isalpha() and ch not in "aeiou" for ch in low) / max(vowels, 1))
        assert r.r == r.qr


@pytest.mark.parametrize("value,code", [("TCP", 1), ("udp", 2), ("Icmp", 3), ("6", 1), ("17", 2), ("1", 3), ("47", 0), ("", 0), (None, 0), ("6.0", 1)])
def test_protocol_codes(spark, value, code):
    assert one(spark, values.encode_protocol, value) == code


def test_calibration_anchors(spark):
    d = [0.3, 0.15, 0.0, -0.1, -0.2, -0.5]
    df = spark.createDataFrame([(x,) for x in d], "d double")
    got = [r[0] for r in df.select(values.calibrated_score(c("d"), -0.2, 0.3)).collect()]
    assert got == sorted(got) and got[0] == 0.0 and got[2] == 5.0 and got[3] == 7.5 and got[-1] == 10.0
    plain = [r[0] for r in df.select(values.calibrated_score(c("d"))).collect()]
    assert plain[2] == 5.0 and plain[4] == 10.0


def test_times(spark):
    zone = one(spark, lambda x: F.unix_micros(values.parse_time(x)), "2026-01-01T12:00:05.000000+0000")
    assert zone == one(spark, lambda x: F.unix_micros(values.parse_time(x)), "2026-01-01T12:00:05Z")
    assert one(spark, lambda x: F.unix_micros(values.parse_time(x)), "1700000000.5") == 1_700_000_000_500_000
    assert one(spark, values.parse_time, "nonsense") is None


def test_domain_patterns(spark):
    hosts = spark.createDataFrame([("a.google.com",), ("google.com",), ("notgoogle.com",), ("x.org",)], "h string")
    got = {r.h: r.m for r in hosts.select("h", text.matches_domain(c("h"), "*.google.com").alias("m")).collect()}
    assert got == {"a.google.com": True, "google.com": True, "notgoogle.com": False, "x.org": False}
    by_column = hosts.withColumn("p", F.lit("*.google.com")).select("h", text.matches_domain(c("h"), c("p")).alias("m"))
    assert {r.h: r.m for r in by_column.collect()} == got


def test_connection_key_ignores_zero_ports(spark):
    df = spark.createDataFrame([("a", "b", 0, 80, "TCP")], "s string, d string, sp int, dp int, p string")
    assert df.select(text.connection_key(*[c(x) for x in ("s", "d", "sp", "dp", "p")])).first()[0] == "a|b||80|TCP"


def test_intel_verdicts(spark):
    schema = "vt bigint, abuse bigint, new_domain boolean, pulses bigint, sandbox bigint, scanner string, known_good boolean, vulns bigint"
    from flowloom.operators.intel import with_verdict

    data = [(0, 0, None, None, None, None, None, None), (5, 50, None, None, None, None, None, None),
            (None, None, None, 50, None, None, None, None), (None, None, True, None, None, "benign", None, 3),
            (9, 90, True, 9, 2, "malicious", None, 1), (None, None, None, None, 1, None, True, None)]
    out = with_verdict(spark.createDataFrame(data, schema)).select("is_malicious", F.round("confidence", 6).alias("k")).collect()
    assert [tuple(r) for r in out] == [(False, 0.0), (True, 0.75), (True, 0.25), (True, 0.15), (True, 1.0), (False, 0.0)]


def test_first_json_object(spark):
    assert one(spark, text.first_json_object, 'text {"a": {"b": 1}} tail') == '{"a": {"b": 1}}'
    assert one(spark, text.first_json_object, "none") is None


@pytest.mark.parametrize("test", [net.is_internal_ip, net.is_private_ip, net.is_ip, net.ip_scope, net.is_lan_destination, net.address_class])
def test_an_address_is_parsed_once(spark, test):
    plan = spark.range(1).select(c("id").cast("string").alias("ip")).select(test(c("ip")).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1


def test_kept_classes_are_used(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("8.8.8.8",), (None,), ("x",)], "ip string")
    kept = net.with_address_classes(df, "ip")
    assert [net.has(net.class_of(t, "ip"), net.INTERNAL)._jc.toString().count("rlike") for t in (kept,)] == [0]
    rows = kept.select("ip", net.has(net.class_of(kept, "ip"), net.INTERNAL).alias("i")).collect()
    assert {r.ip: r.i for r in rows} == {a: internal(a) for a in ("10.0.0.1", "8.8.8.8", None, "x")}
