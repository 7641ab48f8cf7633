"""Near duplicates of documents and of lines, and the pipeline, against loops."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderloom.llm import line_dedup, linkage, ngram_join
from orderloom.llm import words as words_module
from orderloom.llm.ngram_join import (
    Tiles, document_sets, ngram_components, node_of, one_per_component, overlap, parity_bitmap,
    sketch_words,
)
from tests.conftest import rows
from tests.llm.conftest import SENTENCE, TEXTS

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + n]) for k in range(len(words) - n + 1))


def components_by_loops(docs, n, percent):
    """Of each row (id, text): the smallest id that it is linked with, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(doc)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at:at + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(2)
    return " ".join(words)


def corpus(rng, families=12):
    """Families of near copies that drift apart, exact copies, short texts, a shared passage."""
    docs, passage = [], [f"license{i}" for i in range(30)]
    for f in range(families):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 12, 40, 90, 300]))]
        for _ in range(rng.randrange(1, 14)):
            text = edited(rng, words, rng.randrange(0, 4))
            if rng.random() < 0.3:
                words = text.split() or words
            docs.append(text)
            docs += [text] * (rng.random() < 0.3)
    docs += [" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(25)]) for _ in range(25)]
    docs += ["a b c d", "A B C D", "a b c", "", None, " \n "]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_components_against_loops(spark, n, percent, seed):
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    found = ngram_components(df, n, percent).select("doc_id", "n_shingles", "component_id")
    assert rows(found) == sorted(components_by_loops(docs, n, percent), key=repr)


def test_long_texts_with_a_common_passage_are_ruled_out_by_bitmaps(spark, monkeypatch):
    """Twelve long texts share a fifth, and only one of them has a near copy."""
    rng, verified = random.Random(7), []
    passage = [f"p{i}" for i in range(600)]
    texts = [passage + [f"u{rng.randrange(10**9)}" for _ in range(2400)] for _ in range(12)]
    docs = list(enumerate([*(" ".join(t) for t in texts), edited(rng, texts[5], 20)]))
    true = ngram_join._verified

    def counted(rows, items, pairs, n, percent):
        verified.extend(tuple(sorted(p)) for p in pairs.collect())
        return true(rows, items, pairs, n, percent)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = ngram_components(df, 5, 80).select("doc_id", "n_shingles", "component_id")
    assert rows(found) == sorted(components_by_loops(docs, 5, 80), key=repr)
    assert len(set(verified)) == 1


@pytest.mark.parametrize("size,more", [(1400, 0), (1400, 200), (3000, 400), (200_000, 30_000)])
def test_bitmaps_of_unlike_sizes_are_folded(spark, size, more):
    rng = np.random.default_rng(size + more)
    x = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
    y = np.unique(np.concatenate([x, rng.integers(0, 1 << 63, more, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
    words = [sketch_words(len(s), 80) for s in (x, y)]
    sketches = [parity_bitmap(s, w) for s, w in zip((x, y), words)]
    least = min(words)
    expected = np.bitwise_count((parity_bitmap(x, least) ^ parity_bitmap(y, least)).view(np.uint64)).sum()
    assert expected <= more and max(words) <= 1024
    widths, folded = linkage._folded(pa.array([[1], *(s.tolist() for s in sketches)], pa.list_(pa.int64())).slice(1))
    place, all_of_least = folded[least]
    assert widths.tolist() == words
    assert linkage.numpy_hamming(all_of_least[place[0]], all_of_least[place[1]]) == expected
    df = spark.createDataFrame([(s.tolist(), t.tolist()) for s, t in (sketches, sketches[::-1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(linkage.folded_hamming("a", "b", 16)).collect()] == [expected] * 2


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature_and_pass_the_bitmap(percent):
    rng, tiles = random.Random(percent), Tiles(percent)
    for _ in range(300):
        size = rng.choice([1, 2, 3, 5, 8, 13, 40, 120, 600])
        a = {rng.randrange(1 << 64) for _ in range(size)}
        b = set(a)
        while True:
            smaller = set(rng.sample(sorted(b), len(b) - 1)) if rng.random() < 0.5 else b | {rng.randrange(1 << 64)}
            both = len(a & smaller)
            if not smaller or 100 * both < percent * (len(a) + len(smaller) - both):
                break
            b = smaller
            if rng.random() < 0.02:
                break
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        assert overlap(x, y) == len(a & b)
        assert set(tiles.signatures(x).tolist()) & set(tiles.signatures(y).tolist())
        differ = int(np.bitwise_count((parity_bitmap(x) ^ parity_bitmap(y)).view(np.uint64)).sum())
        assert differ <= len(a ^ b)
    # A signature takes a whole cell in common.
    x = np.array(sorted(rng.randrange(1 << 64) for _ in range(300)), np.uint64)
    assert len(tiles.signatures(x)) < 300


def test_sets_of_short_texts_are_their_own():
    found = [g for _, g in document_sets(pa.array(["a b", "a b c", "a", "A  b", None, ""]), 3)]
    assert len(found) == 4 and node_of(found[0]) == node_of(found[3])
    assert len({int(node_of(g)) for g in found}) == 3


def test_components_of_odd_rows(spark, odd, no_docs):
    found = ngram_components(odd, 3, 90)
    expected = components_by_loops(TEXTS, 3, 90)
    assert rows(found.select("doc_id", "n_shingles", "component_id")) == sorted(expected, key=repr)
    assert ngram_components(no_docs, 3, 90).isEmpty()
    one = one_per_component(odd)
    assert one.columns == odd.columns
    assert one.where("_key <> 'k' OR node <> 2 OR _row <> 1").isEmpty()
    # The sentence stays once, with the smallest id; rows without words all stay.
    assert rows(one.select("doc_id")) == sorted(
        [(i,) for i in (1, 3, 4, 5, None, 6, 8, 9, 10, 11, 12)], key=repr
    )
    nulls = spark.createDataFrame([(None, SENTENCE), (None, SENTENCE + " x")] * 2, "doc_id bigint, text string")
    assert one_per_component(nulls, 3, 80).count() == 1
    assert one_per_component(no_docs).isEmpty()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        step = [i]
        for j, y in enumerate(b, 1):
            step.append(min(row[j] + 1, step[-1] + 1, row[j - 1] + (x != y)))
        row = step
    return row[-1]


def edit(rng, line, alphabet):
    line = list(line)
    for _ in range(rng.randrange(4)):
        kind, at = rng.randrange(3), rng.randrange(len(line) + 1)
        if kind == 0:
            line.insert(at, rng.choice(alphabet))
        elif at < len(line):
            line[at:at + 1] = [] if kind == 1 else [rng.choice(alphabet)]
    return "".join(line)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefg é"])
def test_edit_distance_and_segments(alphabet):
    rng = random.Random(len(alphabet))

    def keys(text):
        batch = pa.RecordBatch.from_arrays([pa.array([text])], ["text"])
        return {k for b in line_dedup._signed(iter([batch]), 2, 6) for k in b.column(0).to_pylist()}

    for _ in range(150):
        line = "".join(rng.choice(alphabet) for _ in range(rng.randrange(6, 40)))
        others = [edit(rng, line, alphabet) for _ in range(6)] + ["", line]
        a, bs = line.encode(), [o.encode() for o in others]
        for limit in (0, 1, 2, 3):
            assert line_dedup.near(a, bs, limit).tolist() == [distance(a, b) <= limit for b in bs]
        for other, b in zip(others, bs):
            if len(b) >= 6 and b != a and distance(a, b) <= 2:
                assert keys(line) & keys(other)


def deduped_by_loops(docs, least=line_dedup.MIN_BYTES):
    """The texts that should remain, from all pairs of lines."""
    lines = [
        (doc is None, doc or 0, n, line.encode())
        for doc, text in docs if text is not None for n, line in enumerate(text.split("\n"))
    ]
    distinct = sorted({x for *_, x in lines if len(x) >= line_dedup.MIN_BYTES})
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = [x for x in distinct if len(x) >= least]
    for i, x in enumerate(near):
        for y in near[:i]:
            if abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                parent[find(x)] = find(y)
    first = {}
    for null, doc, n, x in sorted(lines):
        if len(x) >= line_dedup.MIN_BYTES:
            first.setdefault(find(x), (null, doc, n))
    return [
        (doc, text if text is None else "\n".join(
            line for n, line in enumerate(text.split("\n"))
            if len(line.encode()) < line_dedup.MIN_BYTES
            or first[find(line.encode())] == (doc is None, doc or 0, n)
        ))
        for doc, text in docs
    ]


def test_lines_against_loops(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef é") for _ in range(rng.choice([5, 25, 50, 80]))) for _ in range(25)]
    docs = []
    for i in range(60):
        lines = [edit(rng, rng.choice(base), "abcdef é") for _ in range(rng.randrange(6))]
        docs.append((i, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, base[-1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    found = line_dedup.dedup_lines(df)
    assert rows(found.select("doc_id", "text")) == sorted(deduped_by_loops(docs), key=repr)
    counts = found.where("doc_id in (100, 101, 102)").select("doc_id", "n_lines", "n_dropped")
    assert rows(counts) == [(100, 0, 0), (101, 1, 0), (102, 3, 0)]


def test_short_lines_are_near_too(spark):
    rng = random.Random(20)
    base = ["".join(rng.choice("abcdef ") for _ in range(size)) for size in (20, 21, 30, 47, 48) * 3]
    docs = [(i, "\n".join(edit(rng, rng.choice(base), "abcdef ") for _ in range(4))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_chars", F.lit(0))
    found = rows(corpus_pipeline.line_dedup(spark, df, DATA).select("doc_id", "text"))
    expected = deduped_by_loops(docs)
    assert expected != deduped_by_loops(docs, 48)
    assert found == sorted([(d, t) for d, t in expected if WORD.search(t)], key=repr)


def test_lines_of_odd_rows(spark, odd, no_docs):
    found = line_dedup.dedup_lines(odd)
    assert found.columns == [c for c in odd.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    texts = Counter((r.doc_id, r.text) for r in found.collect())
    # The sentence stays in its first row; repeated rows count as one, and a null id comes last.
    assert texts[1, SENTENCE] == 1 and texts[2, ""] == 2 and texts[None, ""] == 1
    # One word more is five bytes: not near.
    assert sum(n for (_, t), n in texts.items() if t and t.startswith("w0x0")) == 2
    kept = found.where("_key <> 'k' OR node <> 2 OR _row <> 1")
    assert kept.isEmpty()
    assert line_dedup.dedup_lines(no_docs).isEmpty()


def test_the_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        results[name] = (docs, stage(spark, docs, DATA).toPandas())
        columns = list(results[name][1].columns)
        if name != names[-1]:
            assert columns == docs.columns
            docs = spark.createDataFrame(results[name][1], docs.schema).repartition(4)

    def texts(frame):
        frame = frame.toPandas() if hasattr(frame, "toPandas") else frame
        return list(zip(frame.doc_id.tolist(), frame.text.tolist()))

    before, after = results[names[1]]
    expected = deduped_by_loops(texts(before))
    given = dict(texts(before))
    expected = [(d, t) for d, t in expected if WORD.search(t) or t == given[d]]
    assert sorted(texts(after)) == sorted(expected)
    assert all(after.n_chars == after.text.str.len())

    before, after = results[names[2]]
    placed = components_by_loops(texts(before), 5, 80)
    assert sorted(after.doc_id) == sorted(d for d, _, c in placed if d == c)

    before, after = results[names[3]]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert not any(i in t for _, t in texts(after) for i in items)
    gone = set(before.toPandas().doc_id) - set(after.doc_id)
    assert len(gone) < 0.2 * before.count()
    final = results[names[4]][1]
    assert sorted(final.doc_id) == sorted(after.doc_id)
    assert (final.n_tokens == final.ids.map(len)).all()


def test_the_pipeline_on_odd_rows(spark, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, str(tmp_path))
            assert result.count() <= docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert result.columns == docs.columns


def test_lines_that_collide_in_running_hashes_stay(spark):
    # The sequence of bit counts and its complement have equal power sums modulo 2^64.
    one = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((one + other).encode(), np.uint8)
    sums, at = words_module.prefix_hashes(data), np.array([0, 2048, 4096])
    assert len(set(words_module.span_hashes(sums, at[:-1], at[1:]).tolist())) == 1
    assert len(set(words_module.content_hashes(data, at[:-1], at[1:]).tolist())) == 2
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id bigint, text string")
    found = line_dedup.dedup_lines(docs)
    assert rows(found.select("doc_id", "text")) == [(1, one), (2, other), (3, "")]
    assert rows(ngram_join.ngram_components(docs, 3, 90).select("doc_id", "component_id")) == [(1, 1), (2, 2), (3, 1)]


def test_lines_that_share_a_node_by_chance_stay(spark, monkeypatch):
    # A node of 4 bits: nearly all lines share theirs with others.
    lines = [f"line {i} of {i * 7919 % 1000} and something to fill it up {i}" for i in range(40)]
    data = np.frombuffer("".join(lines).encode(), np.uint8)
    sizes = np.array([len(x) for x in lines])
    ends = np.cumsum(sizes)
    nodes, checks = line_dedup.identities(data, ends - sizes, ends)
    assert len(set(nodes.tolist())) == len(set(checks.tolist())) == 40
    table = [(i, i, 0, int(n) & 15, int(c)) for i, (n, c) in enumerate(zip(nodes, checks))]
    table += [(100, 100, 0, int(nodes[3]) & 15, int(checks[3]))]
    stored = spark.createDataFrame(table, line_dedup._LINES)
    linked = spark.createDataFrame([], "node bigint, check int, component bigint")
    monkeypatch.setattr(line_dedup, "line_classes", lambda *_: (stored, linked))
    monkeypatch.setattr(line_dedup, "row_key", lambda row_id, text: F.col(row_id))
    docs = spark.createDataFrame(
        [(i, x) for i, x in enumerate(lines)] + [(100, lines[3])], "doc_id bigint, text string"
    )
    found = line_dedup.dedup_lines(docs).where("n_dropped > 0")
    assert rows(found.select("doc_id")) == [(100,)]
