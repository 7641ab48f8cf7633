"""Operators on single texts: words, BPE, quality rules, toxicity, decontamination."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderloom.llm import decontaminate, quality_rules, toxicity
from orderloom.llm.bpe import ByteBpe, bpe_decode, bpe_encode, bpe_round_trip
from orderloom.llm.words import (
    LOWER, content_hashes, gram_hashes, prefix_hashes, slices, span_hashes, text_bytes, word_spans,
)
from tests.conftest import rows
from tests.llm.conftest import LONG, SENTENCE, TEXTS

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, name, folder=DATA):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def test_words_and_their_hashes():
    texts = [t for _, t in TEXTS] + ["a\x0bb", "x" * 50, "  "]
    data, offsets = text_bytes(pa.array(texts))
    starts, ends, bounds = word_spans(data, offsets)
    hashes = span_hashes(prefix_hashes(data), starts, ends)
    for seed in (0, 1):
        content = content_hashes(data, starts, ends, seed)
        assert len(set(zip(hashes.tolist(), content.tolist()))) == len(set(content.tolist())) == len(set(hashes.tolist()))
    known = {}
    for i, text in enumerate(texts):
        found = [data[a:z].tobytes().decode() for a, z in zip(starts[bounds[i]:bounds[i + 1]], ends[bounds[i]:bounds[i + 1]])]
        assert found == WORD.findall(text or "")
        for word, h in zip(found, hashes[bounds[i]:bounds[i + 1]]):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    assert [r for r in slices(offsets, 10)][-1][1] == len(texts)
    assert LOWER[ord("Q")] == ord("q") and LOWER[0xC3] == 0xC3
    assert len(gram_hashes(hashes[:2], 3)) == 0
    assert gram_hashes(hashes[:3], 3) != gram_hashes(hashes[:3][::-1], 3)


def test_a_slice_of_an_arrow_column_is_read_in_place():
    data, offsets = text_bytes(pa.array(["skip", "ab", None, "c"]).slice(1))
    assert data.tobytes() == b"abc" and offsets.tolist() == [0, 2, 2, 3]


def test_bpe_equals_the_tokenizers_library():
    reference = Tokenizer.from_file(VOCABULARY)
    reference.no_padding()
    reference.no_truncation()
    own, rng = ByteBpe(VOCABULARY), random.Random(5)
    texts = [t or "" for _, t in TEXTS] + [
        "a" * 300, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "don't we'll I'D 's",
        "\x1c\x1d\x85  　 z", "١٢٣ ²³½ Ⅷ", "é", "   \n\n  x  ", "!?" * 90,
    ]
    texts += [
        "".join(rng.choice("ab é'\n\t<|>sdlm12日 ") for _ in range(rng.randrange(80)))
        for _ in range(300)
    ]
    for text, ids in zip(texts, own.encode(texts)):
        expected = reference.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert own.decode(ids) == reference.decode(expected, skip_special_tokens=False) == text
    # Ids that do not spell UTF-8.
    broken = [own.encode(["é"])[0][0] + 1, 200, 220]
    assert own.decode(np.array(broken)) == reference.decode(broken, skip_special_tokens=False)


def test_bpe_of_odd_rows(spark, odd, no_docs):
    tokens = bpe_encode(odd, VOCABULARY)
    assert tokens.columns == ["doc_id", "ids"]
    decoded = rows(bpe_decode(tokens, VOCABULARY).select("doc_id", "text"))
    assert decoded == sorted([(i, t or "") for i, t in TEXTS], key=repr)
    trip = bpe_round_trip(odd, VOCABULARY, with_ids=True)
    assert rows(trip.select("doc_id", "decoded_sha256")) == sorted(
        [tuple(r) for r in odd.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()],
        key=repr,
    )
    assert trip.where("n_tokens <> size(ids)").isEmpty()
    assert trip.where("doc_id = 4").first().n_tokens == 0
    assert bpe_round_trip(no_docs, VOCABULARY).isEmpty()


def statistics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for k, window in enumerate(windows):
        if seen[window] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


def test_statistics(spark, odd, no_docs):
    rng = random.Random(2)
    texts = [t for _, t in TEXTS] + [
        "".join(rng.choice("ab|#\n \x0b") for _ in range(rng.randrange(120))) for _ in range(80)
    ] + ["a b c a b c a b c a", "x " * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {r.doc_id: tuple(r)[2:] for r in quality_rules.with_statistics(df).collect()}
    assert found == {i: statistics(t) for i, t in enumerate(texts)}
    assert quality_rules.with_statistics(odd).columns[-5:] == list(quality_rules.STATISTICS)
    assert quality_rules.with_statistics(no_docs).isEmpty()


def test_a_text_with_more_windows_than_the_packed_positions_hold(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "_POSITIONS", 3)
    monkeypatch.setattr(quality_rules, "_POSITION_BITS", 2)
    texts = ["a b c a b c a b", "a b c d e f g a b c d", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    found = {r.doc_id: tuple(r)[2:] for r in quality_rules.with_statistics(df).collect()}
    assert found == {i: statistics(t) for i, t in enumerate(texts)}


def test_rules_find_what_the_labels_say(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    docs, marks = [], []
    for i in range(900):
        text = " ".join(rng.choice(words) + str(rng.randrange(900)) for _ in range(80))
        bad = i % 6 == 0
        if bad:
            text = text.replace(" ", "### ")
        docs.append((i, text))
        # One label in fifty is wrong.
        marks.append((i, int(bad == (i % 50 == 7))))
    docs = spark.createDataFrame(docs, "doc_id int, text string")
    marks = spark.createDataFrame(marks, "doc_id int, quality int")
    rules = quality_rules.learn_rules(docs, marks)
    assert rules.rules and all(r.precision >= 0.9 for r in rules.rules)
    scored = quality_rules.score_quality(docs, rules)
    assert scored.where("kept = (doc_id % 6 = 0)").isEmpty()
    assert "symbol" in str(rules.rules[0]) or "mean_word" in str(rules.rules[0])
    kept = quality_rules.keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.count() == 750


def test_rules_of_odd_rows(spark, odd, no_docs, labels):
    for marks in (labels, labels.where("false")):
        rules = quality_rules.learn_rules(odd, marks)
        assert rules.rules == ()
        kept = quality_rules.keep_good(odd, rules)
        assert kept.columns == odd.columns
        # Fifty words or more, not mostly repeated: none of the odd texts.
        assert kept.isEmpty()
    scored = quality_rules.score_quality(odd, rules)
    assert scored.count() == len(TEXTS) and scored.where("base_failed <> true OR kept").isEmpty()
    assert quality_rules.keep_good(no_docs, rules).isEmpty()


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, marks = table(spark, "documents", folder), table(spark, "labels", folder)
    model = toxicity.fit_toxicity(docs, marks)
    labelled = toxicity.score_toxicity(docs, model).select("doc_id", "score").join(marks, "doc_id")
    held = [(r.score, r.toxic) for r in labelled.where(toxicity.held_out("doc_id")).collect()]
    assert 800 < len(held) < 1200
    scores, truth = np.array([s for s, _ in held]), np.array([y for _, y in held])
    order = scores.argsort().argsort()
    positive = truth.sum()
    auc = (order[truth == 1].mean() - (positive - 1) / 2) / (len(truth) - positive)
    flagged = scores >= 0.3
    assert auc > 0.9
    assert truth[flagged].mean() > 0.75 and flagged[truth == 1].mean() > 0.7
    assert model.thresholds["en"] > 0


def test_toxicity_of_odd_rows(spark, odd, no_docs, labels):
    model = toxicity.fit_toxicity(odd, labels)
    scored = toxicity.score_toxicity(odd, model)
    assert scored.columns == ["doc_id", "score", "threshold", "toxic"]
    assert scored.count() == len(TEXTS)
    assert scored.where("score is null or score < 0 or score > 1").isEmpty()
    same = scored.where("doc_id in (1, 2)").select("score").distinct()
    assert same.count() == 1
    empty = scored.where("doc_id in (3, 4, 5)").select("score").distinct()
    assert empty.count() == 1
    assert toxicity.score_toxicity(no_docs, model).isEmpty()
    assert toxicity.fit_toxicity(odd, labels.where("false")).thresholds == {}


def test_a_long_text_is_scored_in_pieces(monkeypatch):
    model = toxicity.train([(p, "en", y, np.full((4, 3), 5 + y, np.int32)) for p in (0, 1, 2) for y in (0, 1) for _ in range(30)])
    _, _, buckets, bounds = next(toxicity.text_buckets(pa.array([LONG, "", "a b", LONG])))
    found = []
    for step in (100_000_000, 777):
        monkeypatch.setattr(toxicity, "WINDOWS_AT_ONCE", step)
        flat, starts, of = toxicity.padded(buckets, bounds)
        found.append(model.pooled(flat, starts, of, len(bounds) - 1, model.table()))
    assert np.array_equal(*found)


def tiles_by_loops(item, doc, least):
    """Greedy string tiling, one longest match at a time, by comparing all positions."""
    used_item, used_doc, tiles = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while (i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k]
                       and i + k not in used_item and j + k not in used_doc):
                    k += 1
                if k >= least and (best is None or (-k, i, j) < best):
                    best = (-k, i, j)
        if best is None:
            return tiles
        k, i, j = -best[0], best[1], best[2]
        used_item |= set(range(i, i + k))
        used_doc |= set(range(j, j + k))
        tiles.append((k, i, j))


@pytest.mark.parametrize("letters", ["ab", "abcdefghij"])
def test_tiling_against_loops(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        item = [rng.choice(letters) for _ in range(rng.randrange(1, 30))]
        doc = [rng.choice(letters) for _ in range(rng.randrange(0, 30))]
        cut = rng.randrange(len(item))
        doc = doc[:5] + item[cut:] + doc[5:] + item[:cut]
        a, b = (np.array([ord(c) * 7919 for c in x], np.uint64) for x in (item, doc))
        for least in (1, 3):
            found = decontaminate.greedy_tiles(a, b, least)
            for k, i, j in found:
                assert item[i:i + k] == doc[j:j + k] and k >= least
            for side, length in ((1, len(item)), (2, len(doc))):
                taken = Counter(p for t in found for p in range(t[side], t[side] + t[0]))
                assert not taken or (max(taken) < length and set(taken.values()) == {1})
            # Ties between equally long matches may be cut differently.
            expected = tiles_by_loops(item, doc, least)
            assert sorted(k for k, _, _ in found)[-1:] == sorted(k for k, _, _ in expected)[-1:]


def test_contaminated_documents_are_found(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, items).collect()}
    plain = {
        (d.doc_id, b.item_id)
        for d in docs.collect() for b in items.collect() if b.text in (d.text or "")
    }
    assert plain and plain <= found
    # Small blocks: more scans, the same pairs.
    again = decontaminate.contaminated_pairs(docs, items, block_tokens=60)
    assert {(r.doc_id, r.item_id) for r in again.collect()} == found
    clean = decontaminate.clean_documents(docs, items)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_reordered_passages_count_in_full(spark, odd, no_docs):
    half = SENTENCE.split()
    item = " ".join(half[9:] + half[:9])
    items = spark.createDataFrame(
        [(1, item), (1, item), (2, None), (None, item), (3, ""), (4, "one two"), (5, "never seen words here at all ok")],
        "item_id bigint, text string",
    )
    found = decontaminate.contaminated_pairs(odd, items)
    got = Counter((r.doc_id, r.item_id, r.coverage, r.tiles) for r in found.collect())
    assert got == Counter({
        (1, 1, 1.0, 2): 2, (2, 1, 1.0, 2): 4, (None, 1, 1.0, 2): 2, (10, 4, 1.0, 1): 1,
    })
    clean = decontaminate.clean_documents(odd, items)
    assert clean.columns == odd.columns
    assert rows(clean.select("doc_id")) == sorted(
        [(i,) for i, t in TEXTS if t != SENTENCE and i != 10], key=repr
    )
    assert decontaminate.contaminated_pairs(no_docs, items).isEmpty()
    for empty in (decontaminate.contaminated_pairs, decontaminate.clean_documents):
        result = empty(odd, items.where("false"))
        assert result.count() == (len(TEXTS) if empty is decontaminate.clean_documents else 0)


def test_items_without_id_clean_documents_too(spark, odd):
    items = spark.createDataFrame([(None, SENTENCE), (None, None), (1, "one two")], "item_id bigint, text string")
    clean = decontaminate.clean_documents(odd, items)
    assert rows(clean.select("doc_id")) == sorted(
        [(i,) for i, t in TEXTS if t != SENTENCE and i != 10], key=repr
    )


def _loop_logit(model, words):
    """Logit of one text, word by word and filter by filter."""
    pad = [toxicity.PAD] * toxicity.KINDS
    words = [list(w) for w in words] + [pad] * (max(toxicity.WIDTHS) - 1)
    starts = range(max(1, len(words) - max(toxicity.WIDTHS) + 1))
    logit, column = model.intercept, 0
    for w, bias in zip(model.filters, model.biases):
        for f in range(toxicity.FILTERS):
            best = max(
                sum(
                    float(model.embeddings[bucket] @ w[k][:, f])
                    for k in range(len(w)) for bucket in (words + [pad])[s + k]
                )
                for s in starts
            )
            logit += max(best + bias[f], 0) * model.dense[column]
            column += 1
    return logit


def _small_model(rng):
    size, d = toxicity.BUCKETS + 1, toxicity.DIMENSIONS
    embeddings = np.zeros((size, d))
    embeddings[:40] = rng.normal(0, 0.5, (40, d))
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    return toxicity.ToxicityModel(
        embeddings, [rng.normal(0, 0.5, (w, d, toxicity.FILTERS)) for w in toxicity.WIDTHS],
        [rng.normal(0, 0.1, toxicity.FILTERS) for _ in toxicity.WIDTHS], rng.normal(0, 0.5, n), -0.3,
    )


def test_toxicity_network_against_a_loop():
    rng = np.random.default_rng(3)
    model = _small_model(rng)
    texts = [rng.integers(0, 40, (n, toxicity.KINDS)).astype(np.int32) for n in (0, 1, 2, 5, 12)]
    bounds = np.cumsum([0, *map(len, texts)])
    flat, starts, of = toxicity.padded(np.concatenate(texts), bounds)
    logits = model.logits(model.pooled(flat, starts, of, len(texts), model.table()))
    assert np.allclose(logits, [_loop_logit(model, t) for t in texts], atol=1e-4)


def test_toxicity_gradients_against_differences():
    rng = np.random.default_rng(4)
    model = _small_model(rng)
    rows = [(int(n % 2), rng.integers(0, 40, (n, toxicity.KINDS)).astype(np.int32)) for n in (1, 3, 6, 9)]

    def loss():
        logits = np.array([_loop_logit(model, b) for _, b in rows])
        labels = np.array([y for y, _ in rows])
        return float(np.mean(np.log1p(np.exp(logits)) - labels * logits))

    def slope(array, at):
        kept, values = array[at], []
        for step in (1e-6, -1e-6):
            array[at] = kept + step
            values.append(loss())
        array[at] = kept
        return (values[0] - values[1]) / 2e-6

    class Recorder:
        steps, seen = 0, {}

        def update(self, name, weight, gradient):
            self.seen[name] = gradient
            return weight

    expected = {}
    for i, w in enumerate(model.filters):
        at = (len(w) - 1, 2, 5)
        expected[f"filter{i}", at] = slope(w, at) + 1e-4 * w[at]
        expected[f"bias{i}", (3,)] = slope(model.biases[i], (3,))
    for j in range(0, len(model.dense), 5):
        expected["dense", (j,)] = slope(model.dense, (j,)) + 1e-4 * model.dense[j]
    embedded = {(b, d): slope(model.embeddings, (b, d)) for b in rows[2][1][:2].ravel() for d in (0, 7)}
    before, recorder = model.embeddings.copy(), Recorder()
    toxicity._step(model, rows, recorder)
    for (name, at), value in expected.items():
        assert np.isclose(recorder.seen[name][at], value, atol=1e-5), name
    moved = (before - model.embeddings) / 0.05
    for at, value in embedded.items():
        assert np.isclose(moved[at], value, atol=1e-5), at


def test_toxicity_threshold_against_all_cuts():
    rng = np.random.default_rng(5)
    for _ in range(50):
        scores, labels = rng.integers(0, 8, 30) / 8, rng.integers(0, 2, 30)

        def f1(cut):
            said = scores >= cut
            return 2 * (labels * said).sum() / (said.sum() + labels.sum())

        assert np.isclose(f1(toxicity._threshold(scores, labels)), max(f1(c) for c in set(scores)))


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    # An id in 500 rows, a very long text, and short ones: the long one takes no other's place.
    data = [(1, "rep eated", "en")] * 500 + [(2, "word " * 5000, "en")]
    data += [(i, f"text number {i}", "en") for i in range(3, 60)]
    docs = spark.createDataFrame(data, "doc_id int, text string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id int, toxic int")
    given = []
    monkeypatch.setattr(toxicity, "train", given.extend)
    toxicity.fit_toxicity(docs, marks, fit_rows=100, fit_words=10_000)
    learned = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 4 != 2 and i != 2]
    assert 0 < len(given) <= 100 and max(len(b) for *_, b in given) <= 100
    assert len(given) == 100 if 1 in learned else len(given) == len(learned)
    given.clear()
    toxicity.fit_toxicity(docs, marks, fit_rows=1000, fit_words=500)
    assert sum(len(b) for *_, b in given) <= 500 and len(given) > 10
