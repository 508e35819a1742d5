import random

import numpy as np
import pytest

from flowloom.llm import bytewords, neardup
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, key int, digest string"


def _texts(seed, n):
    """Random texts with families of edited copies, shared passages and odd cases."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choices(words, k=30))
    texts = [None, "", " \t\n", "one", "One", "one two", "ÄB äb", "x" * 300]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.4 or len(texts) < 12:
            texts.append(" ".join(rng.choices(words, k=rng.randint(1, 80))))
        elif kind < 0.6:
            texts.append(passage + " " + " ".join(rng.choices(words, k=rng.randint(0, 20))))
        else:
            own = (texts[rng.randrange(8, len(texts))] or "a b").split(" ")
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("k,percent,seed", [(2, 80, 1), (5, 80, 2), (1, 60, 3)])
def test_components_equal_all_pairs(rows, k, percent, seed):
    docs = list(enumerate(_texts(seed, 400)))
    want = brute.near_duplicates(docs, k, percent)
    found = neardup.near_duplicates(rows([(i, t, 1, "x") for i, t in docs], SCHEMA), k=k, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_large_groups_of_near_copies_meet_in_small_blocks(rows, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    docs = [(i, " ".join([*common, *(f"u{rng.randrange(9)}" for _ in range(rng.randint(0, 14)))])) for i in range(150)]
    found = neardup.near_duplicates(rows(docs, "doc_id bigint, text string"), k=2).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: c for i, (_, c) in brute.near_duplicates(docs, 2, 80).items()}


def test_repeated_rows_null_ids_and_empty_tables(rows):
    data = [(1, "a b c", 0, ""), (1, "a b c", 0, ""), (None, "a b c", 0, ""), (None, "q r s", 0, ""), (7, None, 0, ""), (None, None, 0, "")]
    found = neardup.near_duplicates(rows(data, SCHEMA), k=2).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0, r.kept) for r in found)
    assert got == sorted([(False, 1, 2, False, 1, True)] * 2 + [
        (True, 0, 2, False, 1, False), (True, 0, 2, True, 0, True), (False, 7, 0, False, 7, True), (True, 0, 0, True, 0, True)])
    assert neardup.near_duplicates(rows([], SCHEMA), k=2).count() == 0


def test_one_stays_of_each_group(rows):
    docs = rows([(3, "a b c d e f", 1, "x"), (5, "a b c d e f", 2, "y"), (5, "a b c d e f", 2, "y"), (9, "other words here", 3, "z"), (9, "other words here", 3, "z")], SCHEMA)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9]


def test_rows_are_judged_by_their_texts_whatever_their_ids(rows):
    long, near, other = "one two three four five six seven eight", "one two three four five six seven eight", "nothing in common with any of the rest at all"
    data = [(1, long, 1, "a"), (1, other, 2, "b"), (2, near, 3, "c"), (2, "a third text of seven words here", 4, "d"), (None, long, 5, "e"), (None, "only a null id has this text", 6, "f"),
            (None, "only a null id has this text", 6, "f"), (7, None, 7, "g"), (7, None, 7, "g"), (None, " \t ", 8, "h")]
    kept = sorted(((r[0] is None, r[0] or 0, r[1]) for r in neardup.keep_one(rows(data, SCHEMA)).collect()), key=str)
    assert kept == sorted([(False, 1, long), (False, 1, other), (False, 2, "a third text of seven words here"), (True, 0, "only a null id has this text"),
                           (False, 7, None), (False, 7, None), (True, 0, " \t ")], key=str)
    assert neardup.keep_one(rows([], SCHEMA)).count() == 0


def test_words_and_shingles_follow_the_definition():
    texts = ["A b  c", "", "\tAa aA\x0b", "é É ", "x", "a" * 5 + " " + "b" * 7]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    hashes, starts = bytewords.words(data, offsets)
    names: dict = {}
    for i, t in enumerate(texts):
        own = brute.SPACES.findall(brute.lower(t))
        assert starts[i + 1] - starts[i] == len(own)
        for w, h in zip(own, hashes[starts[i]:starts[i + 1]]):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 400, 5000):
        for share in (0.3, 0.8):
            union = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            common = int(len(union) * share)
            rest = union[common:]
            left, right = np.sort(np.concatenate([union[:common], rest[::2]])), np.sort(np.concatenate([union[:common], rest[1::2]]))
            exact = common / len(union)
            equal = (neardup.registers_of(left) == neardup.registers_of(right)).mean() if len(left) and len(right) else 0.0
            assert abs(neardup.corrected_jaccard(equal) - exact) < 0.2
