"""The pipeline's stages against brute force on the smallest tables, and the registered queries' contracts."""

import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from flowloom.llm import neardup
from flowloom.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from tests.llm import brute
from tests.oracle import compare, connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return {r[0]: r for r in duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet'").fetchall()}


def test_stages_keep_what_they_should(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]

    def apply(i, given):
        out = corpus_pipeline.STAGES[i][1](spark, given, SF).persist()
        assert i == 4 or out.columns == columns
        return out, [tuple(r) for r in out.collect()]

    first, rows = apply(0, docs)
    assert {r[0] for r in rows} == {i for i, r in documents.items() if r[1] and any(ch.isalpha() for ch in r[1])}
    second, rows = apply(1, first)
    want = brute.near_duplicates([(r.doc_id, r.text) for r in first.collect()], 5, 80)
    assert sorted(r[0] for r in rows) == sorted(i for i, (_, root) in want.items() if i == root)
    third, rows = apply(2, second)
    items = [brute.lower(t).split() for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]

    def holds(text):
        words = brute.lower(text).split()
        return any(words[k:k + len(i)] == i for i in items for k in range(len(words) - len(i) + 1))

    left = {r[0] for r in rows}
    before = {r.doc_id: r.text for r in second.collect()}
    assert not any(holds(before[i]) for i in left)
    assert len([i for i in before if i not in left and not holds(before[i])]) <= 1
    fourth, rows = apply(3, third)
    assert {r[0] for r in rows} <= left and Counter(r[0] for r in rows).most_common(1)[0][1] > 1
    _, rows = apply(4, fourth)
    assert len(rows) == fourth.count()
    assert sorted(r[-1] * 8 + r[-2] for r in rows) == list(range(len(rows)))


def test_stages_leave_columns_of_any_name_alone(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    extra = docs.selectExpr("*", "concat('s', doc_id) AS Score", "concat('p', doc_id) AS part", "concat('c', doc_id) AS copy", "concat('k', doc_id) AS shuffle_key",
                            "concat('l', doc_id) AS lang_pred", "concat('r', doc_id) AS __row").persist()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, SF)
        assert out.schema.names == extra.schema.names, name
        left = out.collect()
        assert left and all((r.Score, r.part, r.copy, r.shuffle_key, r.lang_pred) == tuple(f"{x}{r.doc_id}" for x in "spckl") for r in left), name


def test_the_whole_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert set(found.columns) >= {"doc_id", "text", "shard", "slot", "row_number"} and found.count() > 50


def test_entry_registers_all():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_with_sql(spark, name):
    assert compare(spark_rows(QUERIES[name](spark, SF)), duck_rows(connect(SF), ORACLE_SQL[name])) is None


def test_url_query(spark):
    urls = dict(duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall())
    found = QUERIES["op1_link_trust"](spark, SF).collect()
    assert Counter(r.page_id for r in found) == Counter(urls.keys())
    for r in found:
        host, path = brute.host_path(urls[r.page_id])
        action, rule = brute.rule_of(host, path, URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and action in (None, r.verdict)


def test_pii_query(spark, documents):
    found = QUERIES["op2_weak_supervision"](spark, SF).collect()
    assert len(found) == len(documents)
    for r in found:
        spans = brute.base_spans(documents[r.doc_id][1])
        kinds = Counter(k for _, k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in range(4))
        assert r.base_sha256 == brute.sha(brute.written(spans))
        assert {s for s in brute.written(spans).split(",") if s} <= set(r.spans.split(","))


def test_shard_query(spark, documents):
    found = QUERIES["op3_feistel"](spark, SF).collect()
    assert sorted(r.slot * 8 + r.shard for r in found) == list(range(len(documents)))
    for r in found:
        data = (documents[r.doc_id][1] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_chat_query(spark):
    turns: dict = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for conv, _, role, text in duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet' order by 1, 2").fetchall():
        turns.setdefault(conv, []).append((role or "", text or ""))
    found = {r.conv_id: r for r in QUERIES["op4_chat_bytes"](spark, SF).collect()}
    assert set(found) == set(turns)
    for conv, own in turns.items():
        r, loss = found[conv], "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), brute.sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss)) and r.formatted_chars > r.loss_chars


def test_near_duplicate_query(spark, documents):
    want = brute.near_duplicates([(i, r[1]) for i, r in documents.items()], 2, 80)
    found = QUERIES["op5_hyperminhash"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert neardup.BANDS * neardup.BAND_ROWS == neardup.REGISTERS


def test_top_k_query(spark):
    vectors = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in QUERIES["op7_histogram_topk"](spark, SF).collect())
    assert found == sorted(brute.top_k(vectors, lambda q: q % 100 == 0, 10))


def test_learned_queries_hold_their_contract(spark, documents):
    toxic = {r.doc_id: r for r in QUERIES["op8_subword_toxicity"](spark, SF).collect()}
    language = {r.doc_id: r for r in QUERIES["op9_language_filters"](spark, SF).collect()}
    assert set(toxic) == set(language) == set(documents)
    for i, (_, text, lang, *_) in documents.items():
        crc = zlib.crc32(str(i).encode())
        assert toxic[i].held_out == (crc % 3 == 1) and toxic[i].predicted == int(toxic[i].score >= 0.7) and 0 <= toxic[i].score <= 1
        assert language[i].held_out == (crc % 4 == 2) and 0 <= language[i].score <= 1
    held = [i for i in documents if language[i].held_out and documents[i][2]]
    assert sum(language[i].lang_pred == documents[i][2] for i in held) >= 0.97 * len(held)
