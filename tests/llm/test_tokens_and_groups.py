"""Byte-level BPE, the source audit and centroid clustering against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowloom.llm import bytebpe, centroids, divergence

P = pytest.importorskip("public_tokenizers")


# ---- byte-level BPE --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def words():
    return bytebpe.Vocabulary(bytebpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))


@pytest.fixture(scope="module")
def library(words):
    import tiktoken

    ranks = {t: i for i, t in enumerate(words.tokens)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoded(texts, words):
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    ids, starts = bytebpe.encode_chunk(np.frombuffer(b"".join(raw), np.uint8), offsets, words.ready())
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


PIECES = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\r\n", "a", "bc", "é", "漢", "1", "٣", "!", '"', "\x1c",
          "\x85", "　", "<|endoftext|>", "😀", "́", "''", "The", " the", "Straße", "0x1f"]


def test_random_strings_encode_as_the_library(words, library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    assert _encoded(texts, words) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_encodes_as_the_library(words, library):
    every = [*range(0xD800), *range(0xE000, 0x110000, 7)]
    texts = ["".join(f"a{chr(c)}1" for c in every[i:i + 500]) for i in range(0, len(every), 500)]
    assert _encoded(texts, words) == [library.encode_ordinary(t) for t in texts]


def test_long_pre_tokens_take_the_heap(words, library):
    texts = ["ab" * 20_000, "x" * 5_000, "é" * 3_000, "漢字" * 2_000, " " * 4_000, "=" * 4_000]
    assert _encoded(texts, words) == [library.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal_and_complete(words):
    slots = np.sort(words.table._slot(words.keys, words.table.shift[words.table._bucket(words.keys)]))
    assert (slots == np.arange(len(words.tokens))).all()
    assert (words.table(words.keys) == np.arange(len(words.tokens))).all()


def test_a_deceiving_hash_is_found_out(words, library, monkeypatch):
    """All hashes equal: every pre-token is taken for the same entry, and the proof sends texts the exact way."""
    monkeypatch.setattr(bytebpe, "hashes_of", lambda data, begin, end: np.full(len(begin), words.keys[500]))
    texts = ["Two words, and a third.", "", "another"]
    assert _encoded(texts, words) == [library.encode_ordinary(t) for t in texts]


def test_memory_of_merged_pre_tokens_turns_over(words, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 5)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("bcdfgaeiou") for _ in range(9)) for _ in range(40)) for _ in range(20)] * 2
    assert _encoded(texts, words) == [library.encode_ordinary(t) for t in texts]


def test_encode_and_decode_tables(spark, words, library):
    data = [(1, "The cat's hat", "a"), (1, "The cat's hat", "b"), (None, "ü" * 70_000, None), (3, None, "c"), (4, "", "d")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    back = bytebpe.decode(bytebpe.encode(docs, words), words).collect()
    got = Counter((r["doc_id"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist()), bytes(r["decoded"])) for r in back)
    assert got == Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in data)
    empty = bytebpe.decode(bytebpe.encode(docs.limit(0), words), words)
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0
    assert bytebpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids binary"), words).collect()[0]["decoded"] is None


# ---- source audit ----------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _audit(docs, least, top):
    uses, holders, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        uses[lang, source].update(words)
        holders[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in holders[lang].items() if n >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: shares(uses[lang, s]) for s in sources}
        whole = shares(sum((uses[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], whole[t])) for t in kept if uses[lang, s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def _audited(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def _corpus(n, seed):
    rng = random.Random(seed)
    common = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)] + ["Größe", "ÄRGER", "été", "zz漢"]
    docs = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "b", "é", None, "z"])
        docs.append((lang, source, " ".join(rng.choice(common) for _ in range(rng.randint(0, 30))) + rng.choice(["", " 12,X", " q"])))
    return docs + [("fr", "only", "zu wenig"), ("es", "x", None), ("es", "y", ""), ("en", "a", "wab " * 30_000)]


@pytest.mark.parametrize("block", [3, 1 << 14])
def test_audit_equals_the_plain_sums(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    docs = _corpus(300, 5)
    df = spark.createDataFrame([(a, b, c, "x", "y") for a, b, c in docs], "lang string, source string, text string, term string, n string")
    assert _audited(divergence.audit(df, 4, 3)) == _audit(docs, 4, 3)


def test_audit_in_small_holdings_and_repeated_rows(spark, monkeypatch):
    docs = _corpus(60, 8) * 3
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    monkeypatch.setattr(divergence, "HELD_ENTRIES", 7)
    assert _audited(divergence.audit(df, 10, 10)) == _audit(docs, 10, 10)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
    poor = spark.createDataFrame([("en", "a", "x"), ("en", "b", None)], "lang string, source string, text string")
    assert _audited(divergence.audit(poor)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_hold_large_counts():
    counts, total, size = [0, 1, 10**12, 7 * 10**14], 8 * 10**14, 10**7
    assert divergence.shares(np.array(counts), total, size).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * size) for c in counts]


# ---- centroid clustering ---------------------------------------------------------------------

def _clustered(rows, k, rounds, width, scale):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(centres)]
    return Counter((i, *reversed(nearest(v))) for i, v in kept), centres


def _assigned(assigned):
    return Counter((r["vec_id"], r["cluster"], r["distance"]) for r in assigned.collect())


VECTORS = "vec_id bigint, embedding array<float>, cluster int, v string"


@pytest.mark.parametrize("k, rounds", [(4, 3), (9, 2), (40, 1), (3, 0)])
def test_clusters_equal_the_plain_rounds(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) + 3 * (i % 4)]) for i in range(150)]
    rows += [(150 + i, rows[0][1]) for i in range(60)]  # a third says the same
    rows += [(7, rows[3][1]), (None, rows[5][1]), (300, None), (301, [1.0] * 5), (302, [1.0] * 5 + [None]), (303, [float("nan")] * 6),
             (304, [float("inf")] + [0.0] * 5), (305, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], VECTORS).repartition(4)
    got, centres = centroids.cluster(df, k, rounds, 6, 64)
    want, wanted = _clustered(rows, k, rounds, 6, 64)
    assert _assigned(got) == want and centres.tolist() == wanted
    facts = centroids.described(got, centres).collect()
    whole = sum(d * n for (_, _, d), n in want.items())
    for r in facts:
        assert r["inertia"] == whole
        assert r["cluster_inertia"] == sum(d * n for (_, c, d), n in want.items() if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, wanted[r["cluster"]])).encode()).hexdigest()


def test_products_change_by_moved_components_only():
    rng = np.random.default_rng(2)
    v, c = rng.integers(-90, 90, (50, 8)), rng.integers(-90, 90, (5, 8))
    new = c.copy()
    new[1, 3] += 4
    new[4] -= 1
    assert ((v @ c.T) + centroids._products(v, new - c) == v @ new.T).all()
    large = rng.integers(-2**27, 2**27, (20, 8))
    assert (centroids._products(large, large[:5]) == large @ large[:5].T).all()


def test_few_vectors_large_values_and_none(spark):
    rows = [(1, [float(2**20), 0.5]), (2, [-float(2**20), -0.5]), (3, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "") for i, v in rows], VECTORS)
    got, centres = centroids.cluster(df, 16, 3, 2, 64)
    assert _assigned(got) == _clustered(rows[:2], 16, 3, 2, 64)[0] and len(centres) == 2
    assert centroids.described(*centroids.cluster(df.limit(0), 16, 3, 2, 64)).count() == 0
