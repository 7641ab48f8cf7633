"""Merkle manifest against a tree built by plain loops."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from orderloom.llm import merkle
from orderloom.llm.merkle import merkle_manifest
from tests.llm.conftest import TEXTS


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields):
    return digest("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """The root, and for each node its path of (left, right)."""
    paths = [[] for _ in nodes]
    of_leaf = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(of_leaf):
            first = at // 3 * 3
            paths[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 3])))
            of_leaf[i] = at // 3
        nodes = [digest("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return (nodes[0] if nodes else None), paths


def manifest(rows):
    """Sorted (doc_id, source, leaf, subroot, root, path) of (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append((row[0] is not None, row[0], leaf(*row)))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for source in sources:
        trees[source].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        built[source] = tree([x[2] for x in trees[source]])
    root, above = tree([built[s][0] for s in sources])
    return sorted(
        (
            (doc, source, node, built[source][0], root, path + up)
            for source, up in zip(sources, above)
            for (_, doc, node), path in zip(trees[source], built[source][1])
        ),
        key=repr,
    )


def found(df):
    return sorted(
        (
            (r.doc_id, r.source, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path])
            for r in df.collect()
        ),
        key=repr,
    )


def test_against_loops(spark):
    # Sources of one block and of several, their last ones of one node and more; one hot.
    sizes = {None: 2, "": 1, "a": 3, "b": 4, "é": 243, "c": 244, "z": 10, "hot": 3 * 243 + 82}
    docs, i = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            i += 1
            docs.append((i * 7919 % 100_003, source, "en" if i % 3 else None, i, f"text\n{i}"))
    # More sources than a block has room for.
    docs += [(10**6 + i, f"one-{i}", None, None, None) for i in range(300)]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    df = merkle_manifest(spark.createDataFrame(docs, schema).repartition(5))
    assert found(df) == manifest(docs)
    assert df.where("verified").count() == len(docs)
    proofs = {(r.doc_id, r.proof_sha256) for r in df.collect()}
    assert proofs == {(m[0], digest("".join(a + b for a, b in m[5]))) for m in manifest(docs)}


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 28])
def test_small_blocks_give_the_same_tree(spark, monkeypatch, size):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 3)
    docs = [(i, "s", None, i, f"t{i}") for i in range(size)]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    assert found(merkle_manifest(spark.createDataFrame(docs, schema))) == manifest(docs)


def test_odd_rows(odd, no_docs):
    docs = [(i, None if n % 3 else "s", "en" if n % 2 else None, None, t) for n, (i, t) in enumerate(TEXTS)]
    df = merkle_manifest(odd)
    assert found(df) == manifest(docs)
    assert df.where("NOT verified").count() == 0
    assert merkle_manifest(no_docs).collect() == []


def test_a_changed_field_is_found(odd):
    changed = merkle_manifest(odd, claims={"text": F.replace("text", F.lit("\n"), F.lit(""))})
    for row in changed.collect():
        assert row.verified == (row.claimed_leaf == row.leaf) == (row.folded_root == row.root)
        assert row.verified == (row.doc_id not in (5, 8, 11))
    nulls = merkle_manifest(odd, claims={"text": F.lit(None).cast("string")})
    assert nulls.where("verified").count() == sum(t is None for _, t in TEXTS)


def test_repeated_rows_are_leaves_of_their_own(spark):
    docs = [(1, "s", "en", 3, "abc")] * 500
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    assert found(merkle_manifest(spark.createDataFrame(docs, schema))) == manifest(docs)
