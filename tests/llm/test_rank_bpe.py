"""Rank BPE against the tiktoken library and a loop that merges one pair at a time."""

import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from __spark_entry__ import queries
from orderloom.llm import rank_bpe
from orderloom.llm.rank_bpe import PairTable, RankBpe, rank_decode, rank_encode, rank_round_trip
from tests.llm.conftest import LONG, TEXTS

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return RankBpe(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library():
    listed = dict(map(bytes.split, open(RANKS, "rb")))
    ranks = {base64.b64decode(text): int(rank) for text, rank in listed.items()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def lists(values, counts):
    ends = np.cumsum(counts)
    return [values[z - n : z].tolist() for n, z in zip(counts, ends)]


def test_equals_the_library(own, library):
    rng = random.Random(3)
    texts = [t or "" for _, t in TEXTS] + [
        "a" * 300, "a" * 5_000, "z" * 255, "z" * 256, "z" * 257, "é" * 700, "日本語" * 200, " " * 999 + "x",
        "don't we'll I'D 's", "　\x85 x\x1c\x1d y", "\n\n  x", "<|endoftext|>",
        "".join(rng.choice("abc") for _ in range(5_000)),
        "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(2_000)),
    ]
    ids, counts = own.encode(texts)
    assert lists(ids, counts) == [library.encode_ordinary(t) for t in texts]
    data, sizes = own.decode(ids, counts)
    assert [bytes(x) for x in lists(data, sizes)] == [t.encode() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(own, library, texts):
    ids, counts = own.encode(texts)
    assert lists(ids, counts) == [library.encode_ordinary(t) for t in texts]


def test_matrices_and_long_words_and_memory_do_not_change_ids(own, library, monkeypatch):
    rng = random.Random(4)
    words = [bytes(rng.randrange(97, 105) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    ids, counts = own.merge(words)
    monkeypatch.setattr(rank_bpe, "CELLS", 64)
    assert lists(*own.merge(words)) == lists(ids, counts)
    monkeypatch.setattr(rank_bpe, "WIDEST", 3)
    assert lists(*own.merge(words)) == lists(ids, counts)
    monkeypatch.setattr(rank_bpe, "WORDS_REMEMBERED", 10)
    monkeypatch.setattr(rank_bpe, "LONG_TEXT", 1_000)
    monkeypatch.setattr(rank_bpe, "WORDS_AT_ONCE", 70)
    texts = [LONG[:50_000], "one two", "", LONG[:3_000]]
    assert lists(*own.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def by_loop(word, ranks):
    """Merges the leftmost pair of lowest rank until there is none."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 10**9:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_ranks_that_no_training_gives(tmp_path):
    # Ranks in random order: a merge may make a pair of lower rank than its own.
    rng = random.Random(8)
    longer = {bytes(rng.randrange(97, 100) for _ in range(rng.randrange(2, 6))) for _ in range(80)}
    tokens = [bytes([b]) for b in range(256)] + sorted(longer)
    rng.shuffle(tokens)
    path = tmp_path / "own.ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    ranks = {t: i for i, t in enumerate(tokens)}
    own = RankBpe(str(path), PATTERN)
    words = [bytes(rng.randrange(97, 101) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    words += [bytes(rng.randrange(97, 100) for _ in range(400)) for _ in range(3)]
    assert lists(*own.merge(words)) == [by_loop(w, ranks) for w in words]


def test_pair_table_resolves_collisions():
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 400, (5_000, 2)), axis=0).astype(np.int32)
    table = PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    assert (table.ranks(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    known = set(map(tuple, pairs.tolist()))
    others = rng.integers(0, 500, (5_000, 2)).astype(np.int32)
    missing = np.array([tuple(p) not in known for p in others.tolist()])
    assert ((table.ranks(others[:, 0], others[:, 1]) == rank_bpe._NONE) == missing).all()


def test_rank_files_and_ids_are_checked(tmp_path, own):
    path = tmp_path / "part.ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="without a rank"):
        RankBpe(str(path), PATTERN)
    with pytest.raises(ValueError, match="not in the rank file"):
        own.decode(np.array([10**6]), np.array([1]))


def test_frames_and_odd_rows(odd, no_docs, library):
    coded = rank_encode(odd, RANKS, PATTERN)
    expected = sorted(((i, library.encode_ordinary(t or "")) for i, t in TEXTS), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in coded.collect()), key=repr) == expected
    spelled = sorted(((r.doc_id, bytes(r.bytes)) for r in rank_decode(coded, RANKS, PATTERN).collect()), key=repr)
    assert spelled == sorted(((i, (t or "").encode()) for i, t in TEXTS), key=repr)
    trip = sorted(map(tuple, rank_round_trip(odd, RANKS, PATTERN).collect()), key=repr)
    assert trip == sorted(map(digests, TEXTS, [library] * len(TEXTS)), key=repr)
    for frame in (rank_encode(no_docs, RANKS, PATTERN), rank_round_trip(no_docs, RANKS, PATTERN)):
        assert frame.collect() == []


def digests(row, library):
    i, text = row
    ids = library.encode_ordinary(text or "")
    coded = sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    return i, len(ids), coded, sha256((text or "").encode()).hexdigest()


def test_null_lists_spell_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [64, 64])], "doc_id int, ids array<int>")
    found = {r.doc_id: bytes(r.bytes) for r in rank_decode(df, RANKS, PATTERN).collect()}
    assert found[1] == found[2] == b"" and len(found[3]) == 2


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(map(tuple, queries()["op11_rank_bpe"](spark, DATA).collect()))
    assert found == sorted(digests(tuple(d), library) for d in docs)
