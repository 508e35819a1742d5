"""Conversions, encodings and verdict expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom import constants as K


def safe_double(value: Column) -> Column:
    """Null, NaN and unparsable text become 0."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def lookup(mapping: dict, key: Column, default) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def encode_protocol(protocol: Column) -> Column:
    """TCP 1, UDP 2, ICMP 3, from names or IP protocol numbers; anything else 0."""
    p = F.upper(F.regexp_replace(protocol.cast("string"), r"\.0$", ""))
    return (
        F.when(p.isin("TCP", "6"), 1).when(p.isin("UDP", "17"), 2).when(p.isin("ICMP", "1"), 3)
        .otherwise(0)
    )


def us_to_ms(us: Column) -> Column:
    return F.greatest(us, F.lit(0.0)) / 1000.0


def us_to_seconds(us: Column) -> Column:
    return F.greatest(us, F.lit(0.0)) / 1_000_000.0


def seconds_to_us(seconds: Column) -> Column:
    return seconds * 1_000_000.0


def parse_time(text: Column) -> Column:
    """ISO text (with ``Z`` or an offset) or an epoch number; null when neither."""
    number = text.try_cast("double")
    return F.coalesce(
        F.when(number.isNotNull(), F.timestamp_micros((number * 1e6).cast("bigint"))),
        text.try_cast("timestamp"),
    )


def hour_or_noon(ts: Column) -> Column:
    return F.coalesce(F.hour(ts), F.lit(12))


def severity_score(severity: Column) -> Column:
    return lookup(K.SEVERITY_SCORES, severity, 5.0)


def severity_order(severity: Column) -> Column:
    return lookup(K.SEVERITY_ORDER, severity, 5)


def merge_rank(severity: Column, default: int = 0) -> Column:
    """Rank used when incidents merge; it knows no ``low``."""
    return lookup(K.MERGE_RANK, F.lower(F.coalesce(severity, F.lit("info"))), default)


def severity_of_rank(rank: Column) -> Column:
    return lookup({v: k for k, v in K.MERGE_RANK.items()}, rank, "info")


def signature_severity(level: Column, view: str = "alert") -> Column:
    """Signature priority to severity; ``view`` is ``alert``, ``display`` or ``finding``."""
    mapping, default = K.SIGNATURE_SEVERITY[view]
    return lookup(mapping, level.cast("int"), default)


def alert_severity(score: Column, threshold: float) -> Column:
    return (
        F.when(score >= min(threshold + 2.0, 9.5), "critical")
        .when(score >= threshold + 1.0, "high")
        .otherwise("medium")
    )


def calibrated_score(decision: Column, d_min: Column | float | None = None,
                     d_max: Column | float | None = None) -> Column:
    """Forest decision value to 0–10 with the boundary (decision 0) at 5.

    Without valid bounds (``d_min < 0 < d_max``) a slope of 25 applies.
    """
    lo = d_min if isinstance(d_min, Column) else F.lit(d_min).cast("double")
    hi = d_max if isinstance(d_max, Column) else F.lit(d_max).cast("double")
    valid = F.coalesce((lo < 0) & (hi > 0), F.lit(False))
    scaled = F.when(decision >= 0, 5.0 * (1.0 - decision / hi)).otherwise(5.0 + 5.0 * decision / lo)
    score = F.when(valid, scaled).otherwise(5.0 - decision * 25.0)
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.round(score, 2)))


def newly_registered(created: Column, now: Column, days: int = 30) -> Column:
    return F.coalesce(created > now - F.expr(f"interval {days} days"), F.lit(False))


def sandbox_verdict(level: Column) -> Column:
    return lookup(K.SANDBOX_VERDICTS, level.cast("int"), "No info")


def intel_confidence(vt: Column, abuse: Column, new_domain: Column, pulses: Column,
                     sandbox: Column, scanner: Column, known_good: Column,
                     vulns: Column) -> Column:
    """Confidence from the providers in their fixed order.

    A benign scanner verdict lowers the sum (not below 0) before the vulnerability bonus is added.
    """
    def add(cond: Column, amount: float) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), amount).otherwise(0.0)

    base = (
        add(vt > 2, 0.4) + add(abuse > 25, 0.35) + add(new_domain, 0.25) + add(pulses > 2, 0.25)
        + add(sandbox == 1, 0.15) + add(sandbox >= 2, 0.35)
    )
    bad = F.coalesce(scanner == "malicious", F.lit(False))
    good = F.coalesce(known_good, F.lit(False)) | F.coalesce(scanner == "benign", F.lit(False))
    scanned = F.when(bad, base + 0.3).when(good, F.greatest(F.lit(0.0), base - 0.2)).otherwise(base)
    return F.least(F.lit(1.0), scanned + add(vulns > 0, 0.1))


def intel_malicious(vt: Column, abuse: Column, new_domain: Column, pulses: Column,
                    sandbox: Column, scanner: Column) -> Column:
    hits = [vt > 2, abuse > 25, new_domain, pulses > 2, sandbox >= 2, scanner == "malicious"]
    out = F.lit(False)
    for hit in hits:
        out = out | F.coalesce(hit, F.lit(False))
    return out


def intel_signals(vt: Column, abuse: Column, new_domain: Column, pulses: Column,
                  sandbox: Column, scanner: Column, vulns: Column) -> Column:
    """One entry per provider that answered: ``provider:triggered``."""
    def entry(name: str, present: Column, hit: Column) -> Column:
        state = F.when(F.coalesce(hit, F.lit(False)), "true").otherwise("false")
        return F.when(present, F.concat(F.lit(name + ":"), state))

    return F.array_compact(F.array(
        entry("virustotal", vt.isNotNull(), vt > 2),
        entry("abuseipdb", abuse.isNotNull(), abuse > 25),
        entry("whois", new_domain.isNotNull(), new_domain),
        entry("otx", pulses.isNotNull(), pulses > 2),
        entry("anyrun", sandbox.isNotNull(), sandbox >= 2),
        entry("greynoise", scanner.isNotNull(), scanner == "malicious"),
        entry("internetdb", vulns.isNotNull(), F.lit(False)),
    ))
