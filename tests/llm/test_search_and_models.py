import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import decontaminate, langid, topk, toxicity
from flowloom.llm.bytewords import text_buffers
from tests.llm import brute

VECTORS = "vec_id bigint, embedding array<float>, label int, rank int, score string"


@pytest.mark.parametrize("bins,block", [(2048, 512), (8, 4)])
def test_top_k_equals_sorting_all_scores(rows, monkeypatch, bins, block):
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = random.Random(2)
    data = [(i, [rng.uniform(-1, 1) for _ in range(6)], 1, 1, "x") for i in range(300)]
    data += [(1000 + i, [0.5] * 6, 1, 1, "x") for i in range(80)]  # ties
    data += [(20, data[20][1], 1, 1, "x"), (31, data[31][1], 1, 1, "x"), (31, data[31][1], 1, 1, "x")]  # repeated rows
    data += [(2000, None, 1, 1, "x"), (2010, [1.0, None], 1, 1, "x"), (2020, [float("nan")] * 6, 1, 1, "x"), (2030, [float("inf")] * 6, 1, 1, "x"),
             (None, [1.0] * 6, 1, 1, "x"), (2040, [], 1, 1, "x"), (2050, [0.25, -0.5], 1, 1, "x")]
    frame = rows(data, VECTORS)
    got = sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 10 == 0, 7).collect()))
    kept = [(r.vec_id, r.embedding) for r in frame.collect()]
    assert got == sorted(brute.top_k(kept, lambda q: q % 10 == 0, 7))


def test_top_k_of_few_and_huge(rows):
    few = rows([(0, [1.0], 1, 1, ""), (1, [2.0], 1, 1, "")], VECTORS)
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0, 10).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert topk.top_k(rows([], VECTORS), F.lit(True)).count() == 0
    huge = rows([(0, [1e30], 1, 1, ""), (1, [1e30], 1, 1, ""), (2, [-1e30], 1, 1, ""), (3, [0.5], 1, 1, "")], VECTORS)
    assert [r.score for r in topk.top_k(huge, F.col("vec_id") == 0, 2).orderBy("rank").collect()][0] == topk.HIGH


def _words(rng, n, stem="w"):
    return [f"{stem}{int(rng.random() ** 2 * 400)}" for _ in range(n)]


DOCS = "doc_id bigint, text string, item_id int, similarity string"


def test_leaks_are_found_as_brute_force_finds_them(rows):
    rng = random.Random(6)
    items = [(i, " ".join(_words(rng, rng.randint(12, 60)))) for i in range(40)] + [(90, None), (91, " .,"), (92, "Zz yy xx"), (93, None)]
    docs, planted = [], set()
    for d in range(400):
        words = _words(rng, rng.randint(0, 400))
        if d % 4 == 0:
            i = rng.randrange(40)
            own = items[i][1].split()
            if d % 8 == 0:  # a paraphrase: a tenth of the words replaced, punctuation and case changed
                own = [w if rng.random() > 0.1 else "new" for w in own]
                own = [w.upper() + "," for w in own]
            at = rng.randint(0, len(words))
            words[at:at] = own
            planted.add((d, i))
        docs.append((d, " ".join(words), 1, "x"))
    docs += [(500, None, 1, "x"), (501, "", 1, "x"), (502, "so ZZ, yy xx", 1, "x"), (None, items[0][1], 1, "x"), (0, docs[0][1], 1, "x")]
    found = decontaminate.leaks(rows(docs, DOCS), rows(items, "item_id bigint, text string")).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert len(pairs) == len(found)
    assert pairs >= {(502, 92)}
    assert len(pairs & planted) >= 0.97 * len(planted)
    assert not {p for p in pairs if p not in planted and p != (502, 92)}


def test_short_items_word_by_word_in_prose_of_the_same_words(rows):
    rng = random.Random(11)
    items = [(i, " ".join(_words(rng, 3 + i % 13))) for i in range(150)] + [(i, " ".join(_words(rng, 40))) for i in range(150, 250)]
    items += [(300, items[0][1]), (301, items[0][1] + " and more"), (302, "w1")]
    docs = []
    for d in range(450):
        words = _words(rng, 90)
        at = rng.randint(0, 90)
        words[at:at] = items[d % 150][1].split()
        docs.append((d, " ".join(words), 1, "x"))
    docs.append((500, " ".join(items[i][1] for i in range(60)), 1, "x"))
    docs.append((501, "w399 " * 30 + items[7][1] + " w399" * 30, 1, "x"))
    docs += [(502, items[9][1].rsplit(" ", 1)[0], 1, "x"), (503, items[9][1].rsplit(" ", 1)[1], 1, "x")]  # no item across documents
    found = decontaminate.leaks(rows(docs, DOCS), rows(items, "item_id bigint, text string")).collect()
    pairs = {(r.doc_id, r.item_id): r for r in found}
    held = {(d, k) for d, text, *_ in docs for k, item in items if f" {item} " in f" {text} "}
    assert len(held) > 500 and held <= set(pairs)
    assert all(pairs[p].matched_words == pairs[p].item_words for p in held)
    assert (502, 9) not in held and (503, 9) not in pairs


def test_a_sampled_fit_weighs_the_corpus_as_the_full_one(rows, monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    items = [(i, " ".join(_words(rng, rng.randint(8, 40)))) for i in range(200)]
    docs = [(d, " ".join(_words(rng, 400) + items[d % 200][1].split()), 1, "x") for d in range(300)]
    docs += [(d, " ".join(f"w{i}" for i in range(300, 340)), 1, "x") for d in range(300, 1500)]  # one text many times
    held = decontaminate.encode_items([i for i, _ in items], pa.array([t for _, t in items]))
    encoded = decontaminate.encode(rows(docs, DOCS), held, "doc_id", "text").persist()
    batch = encoded.toArrow().combine_chunks().to_batches()[0]
    matrix = np.concatenate([m for _, _, m, _ in decontaminate._passages(batch, len(held.vocabulary))])

    def fitted():
        latent = decontaminate.latent_space(encoded, held)
        found = decontaminate.search(encoded, held, latent).collect()
        return float((decontaminate._project(matrix, latent.basis) ** 2).sum()), {(r.doc_id, r.item_id) for r in found}

    full, pairs = fitted()
    assert pairs >= {(d, d % 200) for d in range(300)}
    monkeypatch.setattr(decontaminate, "FIT_PASSAGES", len(matrix) // 10)
    sampled, again = fitted()
    assert again == pairs and sampled > 0.95 * full


def test_small_benchmark_blocks_change_nothing(rows, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(_words(rng, 30))) for i in range(12)]
    docs = rows([(i, " ".join(_words(rng, 50)) + " " + items[i][1], 1, "x") for i in range(12)], DOCS)
    bench = rows(items, "item_id bigint, text string")
    one = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == one == {(i, i) for i in range(12)}
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 0


def test_leaks_go_row_by_row(rows):
    item = "the quick fox jumps over seven lazy dogs at noon"
    clean, leaking = "a clean text that holds nothing of it", f"before {item} after"
    docs = rows([(1, clean, 1, "x"), (1, leaking, 1, "x"), (None, leaking, 1, "x"), (None, clean, 1, "x"), (3, None, 1, "x"), (4, leaking, 1, "x"), (4, leaking, 1, "x")], DOCS)
    kept = decontaminate.without_leaks(docs, rows([(9, item)], "item_id bigint, text string"))
    assert sorted(((r[0] is None, r[0] or 0, r[1]) for r in kept.collect()), key=str) == sorted([(False, 1, clean), (True, 0, clean), (False, 3, None)], key=str)


def test_a_full_language_filter_keeps_frequent_grams(rows, monkeypatch):
    rng = random.Random(2)
    letters = {"aa": "abcdefghij", "bb": "klmnopqrst"}
    data = [(" ".join("".join(rng.choice(own) for _ in range(6)) for _ in range(30)), lang) for lang, own in letters.items() for _ in range(60)]
    labelled = rows([(lang, text) for text, lang in data], "lang string, text string")
    monkeypatch.setattr(langid, "MAX_ROWS_LOG2", 12)
    model = langid.learn(labelled)
    assert model.rows.shape[1] == 1 << 12 and max(model.false_positive) < 0.2
    found = langid.predict(rows([(t,) for t, _ in data], "text string"), model).collect()
    assert Counter((r.lang_pred == lang) for r, (_, lang) in zip(found, data)) == {True: 120}


def test_empty_benchmark_or_documents(rows):
    docs, none = rows([(1, "a b c d e f", 1, "x")], DOCS), rows([], "item_id bigint, text string")
    assert decontaminate.leaks(docs, none).count() == 0
    assert decontaminate.leaks(rows([], DOCS), rows([(1, "a b c d e f")], "item_id bigint, text string")).count() == 0


def test_common_subsequence_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


LANGS = {"aa": "bala kolo minu", "bb": "stroz krapt vlent", "cc": "ûnê ôlî êtâ"}


def _sentence(rng, lang):
    parts = LANGS[lang].replace(" ", "")
    return " ".join("".join(rng.choice([parts[i:i + 3] for i in range(0, len(parts) - 2)]) for _ in range(3)) for _ in range(rng.randint(4, 30)))


def test_languages_of_held_out_texts(rows):
    rng = random.Random(9)
    data = [(i, _sentence(rng, lang), lang, 1, "x") for i in range(300) for lang in [rng.choice(list(LANGS))]]
    data += [(400, None, "aa", 1, "x"), (401, "", "aa", 1, "x"), (402, "123 !?", "bb", 1, "x"), (403, "b", "aa", 1, "x"), (404, "ßßßß", None, 1, "x"),
             (None, _sentence(rng, "cc"), None, 1, "x"), (0, data[0][1], data[0][2], 1, "x")]
    docs = rows(data, "doc_id bigint, text string, lang string, lang_pred int, score string")
    model = langid.learn(langid.teaching_rows(docs))
    found = langid.predict(docs, model).withColumn("held", langid.fold_of("doc_id", 4) == 2).collect()
    assert len(found) == len(data)
    by = {r.doc_id: r for r in found}
    held = [r for r in found if r.held and r.lang and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert [by[i].lang_pred for i in (400, 401, 402)] == ["und"] * 3 and by[None].lang_pred == "cc"
    assert by[403].lang_pred in LANGS and by[404].lang_pred in LANGS and all(0 <= r.score <= 1 for r in found)


def test_too_little_evidence_rejects_no_document(spark, rows):
    import corpus_pipeline

    rng = random.Random(10)
    data = [(i, _sentence(rng, lang), lang) for i in range(300) for lang in [rng.choice(["aa", "bb"])]]
    taught = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 4 != 2)
    data += [(400, "A.", "aa"), (401, "xq", None), (402, "ABCD", "bb"),
             (taught, "жизнь прекрасна когда солнце светит над морем", "dd"),  # its grams occur once
             (403, "wuxi qepo jifa zuhe wemi xuga pofi gehu qiwa fuxe", None), (404, "123", "aa"), (405, None, "aa")]
    docs = rows(data, "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, *_ in data} - {403, 404, 405}


def test_more_languages_than_one_word_holds(rows):
    rng = random.Random(3)
    stems = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}q" for i in range(130)]
    docs = rows([(i, " ".join(rng.choice("xyzuvw") + stems[i % 130] + rng.choice("xyz") for _ in range(12)), f"l{i % 130}", 1, "") for i in range(1300)],
                "doc_id bigint, text string, lang string, lang_pred int, score string")
    found = langid.predict(docs, langid.learn(docs.select("lang", "text"))).collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.95 * len(found)


def test_nothing_to_learn_languages_from(rows):
    docs = rows([(1, "text", None)], "doc_id bigint, text string, lang string")
    found = langid.predict(docs, langid.learn(langid.teaching_rows(docs))).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)]
    assert langid.predict(docs.limit(0), langid.learn(docs.limit(0).select("lang", "text"))).count() == 0


def test_grams_do_not_span_texts():
    import pyarrow as pa

    texts = ["abc", "", "de fg", "h"]
    code, text = langid.grams(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        framed = f" {t} "
        want = [framed[j:j + 4] for j in range(len(framed) - 3) if "  " not in framed[j:j + 4]]
        assert [int(c).to_bytes(4, "big").decode() for c in code[text == i]] == want


def test_toxicity_generalises_to_misspellings(rows):
    rng = random.Random(5)
    bad = ["moronic", "scumbag", "worthless"]
    data, labels = [], []
    for i in range(900):
        words = [f"{rng.choice('abcdefgh')}{rng.choice(['lor', 'tin', 'ped', 'sat'])}{rng.choice('aeiou')}{rng.choice(['m', 'n', 'rs'])}" for _ in range(rng.randint(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(max(1, len(words) // 30)):
                word = rng.choice(bad)
                if i % 2:
                    at = rng.randrange(1, len(word))
                    word = word[:at] + rng.choice("xyz") + word[at:]
                words.insert(rng.randrange(len(words)), word)
        data.append((i, " ".join(words), "en", 1, "x"))
        labels.append((i, 1, int(toxic)))
    data += [(5000, None, None, 1, "x"), (5001, "", None, 1, "x"), (None, "kind words", None, 1, "x"), (5002, "lorem " * 3000, None, 1, "x"), (1, data[1][1], "en", 1, "x")]
    labels += [(2, 1, None), (3, None, 7), (None, 1, 1), (1, 1, 0)]
    docs = rows(data, "doc_id bigint, text string, lang string, score int, predicted string")
    found = toxicity.classify(docs, rows(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(found) == len(data)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 900]
    hits = sum(r.predicted for r in held if r.doc_id % 3 == 0) / sum(r.doc_id % 3 == 0 for r in held)
    wrong = sum(r.predicted for r in held if r.doc_id % 3) / sum(r.doc_id % 3 > 0 for r in held)
    assert hits > 0.9 and wrong < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    assert all(r.predicted == 0 for r in found if r.doc_id is None or r.doc_id >= 5000)


def test_toxicity_without_both_classes(rows):
    docs = rows([(1, "text"), (2, None)], "doc_id bigint, text string")
    found = toxicity.classify(docs, rows([(1, 0)], "doc_id bigint, toxic int")).collect()
    assert [r.score for r in found] == [0.0, 0.0]
    assert toxicity.classify(docs.limit(0), rows([], "doc_id bigint, toxic int")).count() == 0


def test_training_is_repeatable():
    texts, labels = [b"good words here", b"vile words here"] * 20, np.array([0, 1] * 20)
    one, two = toxicity.train(texts, labels), toxicity.train(texts, labels)
    assert (one.weights == two.weights).all() and one.bias == two.bias


def test_latent_space_is_fitted_on_all_passages(spark, monkeypatch):
    """The sketch is (A^T A) G of every passage's TF-IDF row, and the energy that of all of them."""
    import pyarrow as pa

    from flowloom.llm import decontaminate as D

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    items = D.encode_items([1], pa.array([" ".join(words)]))
    texts = [" ".join(rng.choice(words, size=int(n), p=np.arange(400, 0, -1) / 80200)) for n in rng.integers(1, 200, 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    encoded = D.encode(docs, items, "doc_id", "text")
    passages = np.concatenate([m for b in encoded.toArrow().to_batches() for _, _, m, _ in D._passages(b, len(items.vocabulary))])
    monkeypatch.setattr(D, "FIT_PASSAGES", 50, raising=False)
    seen, inner = {}, D.sketch

    def spy(encoded, idf, random, *rest):
        seen.update(idf=idf, random=random, found=inner(encoded, idf, random, *rest))
        return seen["found"]

    monkeypatch.setattr(D, "sketch", spy)
    D.latent_space(encoded, items)
    dense = np.zeros((len(passages), len(seen["idf"]) + 1))
    np.add.at(dense, (np.repeat(np.arange(len(passages)), D.PASSAGE), passages.ravel()), 1.0)
    dense = dense[:, :-1] * seen["idf"]
    corpus, energy = seen["found"]
    want = dense.T @ (dense @ seen["random"])
    assert len(passages) > 400 and abs(energy / (dense ** 2).sum() - 1) < 1e-5
    assert np.abs(corpus - want).max() < 1e-4 * np.abs(want).max()
