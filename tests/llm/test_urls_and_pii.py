import random

import pytest
from pyspark.sql import functions as F

from flowloom.llm import linkgraph, pii
from flowloom.llm.queries import URL_RULES
from tests.llm import brute

PAGES = "page_id bigint, url string, html string, rule string, host string"


def _page(i, url, html=None):
    return (i, url, html, "own", "own")


def test_hosts_paths_and_longest_rules(rows):
    urls = [None, "", "no-scheme/x", "http://NET/", "http://net", "https://A.B.Net/x?y", "http://example.net/en/1", "ftp://m.example.net/de/1",
            "http://example.com/de/1#z", "http://example.com/de", "http://xexample.com/de/1", "http://blog.example.org/fr/a?b#c",
            "http://org/fr/", "http://é.ÖRG/fr/", "://x.net/y", "http://h?q=/de/", "http://u:p@h.net:80/x", "http://a://net/"]
    found = linkgraph.judge(rows([_page(i, u) for i, u in enumerate(urls)] * 2, PAGES), URL_RULES).collect()
    assert len(found) == 2 * len(urls)
    for r in found:
        host, path = brute.host_path(urls[r.page_id])
        action, rule = brute.rule_of(host, path, URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (action is None or r.verdict == action)


def _ranks(pages, rules, damping, rounds):
    """trust and distrust by plain loops."""
    own, edges = {}, {}
    for _, url, html, *_ in pages:
        host, path = brute.host_path(url)
        if not host:
            continue
        action, _ = brute.rule_of(host, path, rules)
        own.setdefault(host, {"allow": 0, "block": 0, None: 0})[action] += 1
        for link in (html or "").split('"')[1::2]:
            target = brute.host_path("http:" + link if link.startswith("//") else link)[0]
            if target and target != host:
                edges[(host, target)] = edges.get((host, target), 0) + 1
    hosts = set(own) | {h for e in edges for h in e}
    start = {h: own.get(h, {"allow": 0, "block": 0}) for h in hosts}
    out = {h: sum(n for (a, _), n in edges.items() if a == h) for h in hosts}
    into = {h: sum(n for (_, b), n in edges.items() if b == h) for h in hosts}
    trust, distrust = {h: float(start[h]["allow"]) for h in hosts}, {h: float(start[h]["block"]) for h in hosts}
    for _ in range(rounds):
        t, d = {h: float(start[h]["allow"]) for h in hosts}, {h: float(start[h]["block"]) for h in hosts}
        for (a, b), n in edges.items():
            t[b] += damping * trust[a] * n / out[a]
            d[a] += damping * distrust[b] * n / into[b]
        trust, distrust = t, d
    return own, trust, distrust


def test_trust_and_distrust_follow_the_links(rows):
    rng = random.Random(4)
    names = ["good.org", "bad.net", *(f"h{i}.info" for i in range(8))]
    pages = []
    for i in range(120):
        host = rng.choice(names)
        links = "".join(f'<a href="{rng.choice(["http:", "https:", ""])}//{rng.choice(names)}/p">x</a><a href="/own">y</a>' for _ in range(rng.randint(0, 3)))
        pages.append(_page(i, f"http://{host}/{rng.choice(['fr/', 'x/'])}{i}", links or None))
    found = linkgraph.judge(rows(pages, PAGES), URL_RULES).collect()
    own, trust, distrust = _ranks(pages, URL_RULES, linkgraph.DAMPING, linkgraph.ROUNDS)
    assert any(r.rule is None and r.distrust > 0 for r in found)
    for r in found:
        assert r.trust == pytest.approx(trust[r.host], rel=1e-3, abs=1e-3)
        assert r.distrust == pytest.approx(distrust[r.host], rel=1e-3, abs=1e-3)
        if r.rule is None:
            bad = distrust[r.host] > 0.5 * (distrust[r.host] + trust[r.host] + own[r.host][None])
            assert r.verdict == ("block" if bad else "allow")


def test_empty_pages(rows):
    assert linkgraph.judge(rows([], PAGES), URL_RULES).count() == 0


PIECES = ["a.b@c.de", "x@y", "@z.com", "a@b.c@d.e", "a@b.c_d@e.fg", "a@b.c..@x.y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.002.003.0255", "1.2.3",
          "4111111111111111", "4111 1111-1111 1111", "4111  1111", "12 34", "0" * 12, "0" * 20, "9" * 19, "+1 (555) 123-4567", "+12", "+1234567890123456",
          "++49 30 1234567", "+1 2.", "ünï", "漢字", "😀", " ", "\n", "-", ".", "(555) 123-4567", "mail me (at) home dot", "joe [at] site [dot] org", "7"]


def test_base_spans_equal_plain_matching(rows):
    rng = random.Random(7)
    texts = [None, "", *PIECES, *("".join(rng.choice(PIECES) + rng.choice(["", " ", " x "]) for _ in range(rng.randint(1, 12))) for _ in range(600))]
    texts.append(" ".join(f"u{i}@h.com 10.0.0.{i % 300}" for i in range(900)))  # more matches than one level holds
    texts.append("1" * 40000 + "a" * 40000)
    schema = "doc_id bigint, text string, spans string, base int"
    found = pii.detect(rows([(i, t, "x", 1) for i, t in enumerate(texts)], schema)).withColumn("written", pii.written("base"))
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute.base_spans(text)
        assert [tuple(s) for s in got[i].base] == want
        assert got[i].written == brute.written(want)
        assert set(want) <= {tuple(s) for s in got[i].spans}


def test_supervision_finds_reliable_labelers_and_weak_spans(rows):
    texts = [(i, f"call phone: +1 (555) 123-{1000 + i} or tel (555) 321-{2000 + i} today, " + (
        "card 4111 1111 1111 1111" if i % 2 else "order 9111 1111 1111 111" + str(i % 5))) for i in range(60)]
    docs = rows(texts, "doc_id bigint, text string")
    learned = pii.learn(pii.candidates(docs)).collect()
    card = next(r for r in learned if r.kind == "card")
    assert all(card.yes[3 * j + 2] > card.no[3 * j + 2] for j in range(3))  # each labeler says yes on true spans
    assert all(0 < r.posterior < 1 and 0 < r.chance < 1 for r in learned)
    added = [s for r in pii.detect(docs).collect() for s in r.spans if s not in r.base]
    assert any(pii.KINDS[s.kind] == "phone" for s in added)
    assert not any(pii.KINDS[s.kind] == "card" for s in added)


def test_pii_without_rows_and_in_builtin_functions_only(rows):
    docs = rows([], "doc_id bigint, text string")
    assert pii.detect(docs).count() == 0
    plan = pii.candidates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    one = pii.detect(rows([(None, None), (1, ""), (1, "")], "doc_id bigint, text string")).select(F.sha2(pii.written("base").cast("binary"), 256).alias("h"))
    assert {r.h for r in one.collect()} == {brute.sha("")} and one.count() == 3


def test_distrust_reaches_hosts_many_links_away(rows):
    chain = [f"h{i}.test" for i in range(32)] + ["bad.blocked"]
    edges = rows([(a, b, 1.0) for a, b in zip(chain[:-1], chain[1:])], "source string, target string, links double")
    seeds = rows([("bad.blocked", 0, 10000), ("h0.test", 0, 0)], "host string, trusted bigint, distrusted bigint")
    found = {r.host: r.distrust for r in linkgraph.spread(edges, seeds).collect()}
    for far, host in enumerate(reversed(chain)):
        assert abs(found[host] - 10000 * linkgraph.DAMPING ** far) < 1e-3
    assert linkgraph.DAMPING ** linkgraph.ROUNDS <= linkgraph.SETTLED
