import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.llm import chatformat, mixing, sharding
from tests.llm import brute

DOCS = "doc_id bigint, text string, source string, slot int, copy string"


@given(st.integers(1, 3000), st.integers(0, 2**40))
@settings(max_examples=60, deadline=None)
def test_permutation_is_a_bijection_with_inverse(n, seed):
    at = sharding.permute(np.arange(n), n, seed)
    assert sorted(at.tolist()) == list(range(n))
    assert (sharding.permute(at, n, seed, back=True) == np.arange(n)).all()


def test_shards_are_even_gapless_and_independent_of_layout(rows, monkeypatch):
    data = [(i if i % 9 else None, f"t{i % 50}" if i % 7 else None, "s", 1, "c") for i in range(500)] + [(4, "same", "s", 1, "c")] * 300
    docs = rows(data, DOCS)
    found = sharding.shard_rows(docs, 8).collect()
    assert len(found) == len(data) and sorted(r.row_number for r in found) == list(range(len(data)))
    counts = Counter(r.shard for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, held in counts.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(held))
    assert (sharding.locate([r.shard for r in found], [r.slot for r in found], len(data), 8, 20240607) == [r.row_number for r in found]).all()
    again = sharding.shard_rows(docs.repartition(5, "text"), 8).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows_and_odd_shard_counts(rows, n):
    found = sharding.shard_rows(rows([(i, "t", "s", 1, "c") for i in range(n)], DOCS), 5).collect()
    assert sorted((r.slot, r.shard) for r in found) == [(0, i) for i in range(n)]


def test_rates_reach_the_target_weights(rows):
    sizes = {"a": 6000, "b": 900, None: 90, "tiny": 1}
    docs = rows([(k * 10000 + i, "t", s, 1, "c") for k, (s, n) in enumerate(sizes.items()) for i in range(n)], DOCS)
    weights = rows([("a", 1.0), ("b", 1.0), (None, 1.0), ("tiny", 1.0), ("absent", 5.0)], "source string, weight double")
    got = Counter(r.source for r in mixing.mix_sources(docs, weights).select("source").collect())
    for source in sizes:
        assert got[source] == pytest.approx(sum(sizes.values()) / 4, rel=0.15)


def test_copies_follow_the_poisson_distribution_and_repeat(rows):
    docs = rows([(i, "t", "s", 1, "c") for i in range(20000)], DOCS)
    weights = rows([("s", 2.0)], "source string, weight double")
    mixed = mixing.mix_sources(docs, weights, rows_wanted=30000)
    times = Counter(r["count"] for r in mixed.groupBy("doc_id").count().collect())
    for k, chance in ((1, 0.3347), (2, 0.2510), (3, 0.1255), (4, 0.0471)):
        assert times[k] / 20000 == pytest.approx(chance, abs=0.012)
    once, twice = (Counter(map(tuple, mixing.mix_sources(d, weights, rows_wanted=30000).select("doc_id", "part", "copy", "shuffle_key").collect()))
                   for d in (docs, docs.repartition(3)))
    assert once == twice and max(once.values()) == 1


def test_mixing_odd_rows(rows):
    docs = rows([(None, f"t{i}", "s", 1, "c") for i in range(300)] + [(None, None, "s", 1, "c")] * 3 + [(5, "x", "zero", 1, "c"), (6, "x", "none", 1, "c")], DOCS)
    weights = rows([("s", 1.0), ("zero", 0.0), ("none", None)], "source string, weight double")
    mixed = mixing.mix_sources(docs, weights, rows_wanted=606)
    got = mixed.collect()
    assert {r.source for r in got} == {"s"} and 480 < len(got) < 740
    assert set(mixed.columns) == {"doc_id", "text", "source", "slot", "part", "copy", "shuffle_key"}
    assert len({Counter(r.text for r in got)[f"t{i}"] for i in range(300)}) > 3  # null ids draw by text
    assert mixing.mix_sources(docs.limit(0), weights).count() == 0
    plan = mixed._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


CHAT = "conv_id bigint, turn bigint, role string, text string, part int, formatted string"
BITS = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<", "|", "\\", "\n", "<\\\\|", "user", "é", "漢", "", " ", "<|", "\\|"]


def _digest(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), brute.sha(whole), len(loss), brute.sha(loss)


@pytest.mark.parametrize("large,part_bytes", [(1024, 1 << 22), (4, 60)])
def test_conversations_read_back(rows, large, part_bytes):
    rng = random.Random(3)
    data = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9) if conv != 7 else 120):
            role = rng.choice(["user", "assistant", "system", None, "odd\nrole", "<|im_end|>\\"])
            text = rng.choice([None, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))])
            data.append((conv, turn if turn % 5 else None, role, text, 1, "x"))
    data += [(3, 1, "assistant", "again", 1, "x")] * 2
    rng.shuffle(data)
    want: dict = {}
    for conv, turn, role, text, *_ in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        want.setdefault(conv, []).append((role or "", text or ""))
    formatted = chatformat.format_conversations(rows(data, CHAT), large, part_bytes)
    got = {r.conv_id: r for r in chatformat.digests(formatted).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == _digest(turns)
    chars = dict(formatted.groupBy("conv_id").agg(F.sum(F.char_length(F.col("formatted").cast("string"))).alias("n")).collect())
    assert {c: r.formatted_chars for c, r in got.items()} == chars
    if large == 1024:
        assert formatted.count() == len(want)


@given(st.lists(st.lists(st.sampled_from(BITS), max_size=6).map("".join), max_size=12))
@settings(max_examples=150, deadline=None)
def test_texts_are_escaped_together_as_one_by_one(texts):
    import pyarrow as pa

    data, offsets = chatformat._escaped(pa.array(texts, pa.string()))
    got = [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
    assert got == [chatformat.escape(t.encode()) for t in texts]
    assert [chatformat.unescape(g).decode() for g in got] == texts


@pytest.mark.parametrize("per_batch", [1, 3])
def test_conversations_go_on_over_batches(spark, rows, per_batch):
    data = [(c if c else None, i, "assistant" if i % 2 else "user", "<|im_end|>" * (i % 3) + "x" * (i * c % 23), 1, "x") for c in range(12) for i in range(1 + c * 2 % 7)]
    columns = ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"]

    def parts(size):
        got = chatformat.format_conversations(rows(data, CHAT), 1024, size).select(columns).collect()
        return sorted((repr(r.conv_id), r.part, r.n_turns, bytes(r.formatted), r.loss_start, r.loss_end) for r in got)

    whole, cut = parts(1 << 22), parts(90)
    known = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        assert parts(1 << 22) == whole and parts(90) == cut
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", known)
    assert len(whole) == 12 < len(cut)
    joined = {}
    for conv, _, turns, blob, starts, ends in cut:
        held = joined.setdefault(conv, [0, b"", []])
        assert len(blob) <= 90 or turns == 1
        held[2] += [blob[a:b] for a, b in zip(starts, ends)]
        held[0], held[1] = held[0] + turns, held[1] + blob
    assert [(conv, 0, *held[:2]) for conv, held in sorted(joined.items())] == [w[:4] for w in whole]
    assert all(joined[w[0]][2] == [w[3][a:b] for a, b in zip(w[4], w[5])] for w in whole)


def test_no_conversations(rows):
    assert chatformat.digests(chatformat.format_conversations(rows([], CHAT))).count() == 0


def test_texts_are_not_shuffled_by_source(spark, tmp_path):
    spark.range(50).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('t', 100) AS text").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    plan = mixing.mix_sources(docs, mixing.tempered(docs))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("BroadcastExchange")[0] and plan.count("hashpartitioning(shuffle_key") == 1
