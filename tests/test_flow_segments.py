"""Flows stitched from segments, and names as a child table, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import flows as FL

PACKETS = ("file string, seq bigint, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, payload_len int, "
           "header_len int, tcp_flags int, win int, first_byte int, is_request boolean, sni string, http_host string, user_agent string, "
           "dns_qnames array<string>, tls_version int, tls_ciphers array<int>, tls_extensions array<int>, tls_groups array<int>, tls_formats array<int>")


def _packets(n, seed):
    rng, rows, ts = random.Random(seed), [], 100.0
    for seq in range(n):
        ts += rng.choice([0.0, 0.25, 0.5, 3.0, -0.125])
        ends = [("10.0.0.1", 5000 + rng.randrange(2)), ("8.8.8.8", 443)] if rng.random() < 0.8 else [("10.0.0.1", 7), ("10.0.0.1", 7)]
        if rng.random() < 0.4:
            ends.reverse()
        proto = rng.choice(["TCP", "TCP", "UDP", "ICMP"])
        rows.append(("f", seq, ts, ends[0][0], ends[1][0], ends[0][1], ends[1][1], proto, rng.randrange(100), 20 + 4 * rng.randrange(3),
                     rng.randrange(64), rng.randrange(9000), None, False, rng.choice([None, None, "a.example", "b.example"]),
                     rng.choice([None, "h1.example", "login.example"]), None, rng.choice([None, ["q1.example", "q2.example"], []]), *[None] * 5))
    return rows


def _plain(rows):
    flows = {}
    for r in rows:
        a, b = (r[3], 0 if r[7] == "ICMP" else r[5]), (r[4], 0 if r[7] == "ICMP" else r[6])
        flows.setdefault((min(a, b), max(a, b), r[7]), []).append(r)
    out = {}
    for key, own in flows.items():
        gaps = [y[2] - x[2] for x, y in zip(own, own[1:])]
        forward = [r for r in own if r[7] == "ICMP" or r[3] == own[0][3]]
        backward = [r for r in own if not (r[7] == "ICMP" or r[3] == own[0][3])]
        mean = sum(gaps) / len(gaps) if gaps else 0.0

        def total(side):
            return sum(g for x, y in zip(side, side[1:]) if (g := y[2] - x[2]) >= 0)

        std = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) if len(gaps) > 1 else 0.0
        sni = [r[14] for r in own if r[14]]
        out[key] = (len(forward), len(backward), round(mean, 6), round(std, 4), max(gaps, default=0.0), min(gaps, default=0.0), round(total(forward), 6),
                    round(total(backward), 6), sni[-1] if sni else None, sorted({r[15] for r in own if r[15]}), sorted({q for r in own for q in r[17] or []}))
    return out


@pytest.mark.parametrize("size", [1, 3, 7, 10_000])
def test_flows_are_the_same_however_they_are_cut(spark, size):
    rows = _packets(400, 11)
    df = spark.createDataFrame(rows, PACKETS).repartition(5)
    flows = FL.with_names(FL.flow_table(df, size), FL.flow_names(df))
    got = {((r.lo_ip, r.lo_port), (r.hi_ip, r.hi_port), r.protocol): (
        r.packets_sent, r.packets_recv, round(r.iat_mean, 6), round(r.iat_std, 4), r.iat_max, r.iat_min, round(r.fwd_iat_total, 6),
        round(r.bwd_iat_total, 6), r.tls_sni, r.http_hosts, r.dns_queries) for r in flows.collect()}
    assert got == _plain(rows)


@pytest.mark.parametrize("size", [1, 4, 10_000])
def test_gaps_of_packets_across_slices(spark, size):
    rows = _packets(150, 4)
    got = {r.seq: (r.gap, r.dir_gap) for r in FL.packet_gaps(spark.createDataFrame(rows, PACKETS), size).select("seq", "gap", "dir_gap").collect()}
    last, last_side, want = {}, {}, {}
    for r in rows:
        a, b = (r[3], 0 if r[7] == "ICMP" else r[5]), (r[4], 0 if r[7] == "ICMP" else r[6])
        key = (min(a, b), max(a, b), r[7])
        side = (key, "*" if r[7] == "ICMP" else r[3])
        gap = r[2] - last[key] if key in last else None
        own = r[2] - last_side[side] if side in last_side else None
        want[r[1]] = (gap, own if own is not None and own >= 0 else None)
        last[key] = last_side[side] = r[2]
    assert got == want


def test_one_scan_and_two_exchanges(spark, tmp_path):
    spark.createDataFrame(_packets(50, 1), PACKETS).write.parquet(str(tmp_path / "p"))
    plan = FL.flow_table(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_names_beyond_the_shown_stay_in_the_child_table(spark):
    base = _packets(1, 2)[0]
    rows = [(*base[:1], i, *base[2:3], "10.0.0.1", "8.8.8.8", 1, 80, "TCP", *base[8:15], f"h{i:03}.example" if i else "zz-login.example", "agent", None,
             *base[18:]) for i in range(30)]
    df = spark.createDataFrame(rows, PACKETS)
    flow = FL.build_flows(df, shown=3).first()
    assert flow.http_hosts == ["h001.example", "h002.example", "zz-login.example"]
    assert (flow.http_host_count, flow.user_agent_count, flow.dns_query_count, flow.user_agents, flow.dns_queries) == (30, 1, 0, ["agent"], [])
    names = FL.names_by_flow(FL.flow_table(df), FL.flow_names(df))
    assert names.where("kind = 'host'").count() == 30
    assert names.where("kind = 'agent'").select("flow_id", "mentions", "first_seq").first() == (flow.flow_id, 30, 0)
    assert FL.build_flows(df.limit(0)).count() == 0
