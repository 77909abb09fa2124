"""Merkle manifest: trees against a plain version, proofs against the root, tampering, edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from appconv.llm import merkle

DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string, tree int, number string, proof int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """Root and proofs, level by level."""
    proofs, under, nodes = ["" for _ in leaves], [[k] for k in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        above, members = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k in range(len(run)):
                for i in under[a + k]:
                    proofs[i] += "".join(run[:k] + run[k + 1 :])
            above.append(H(*run))
            members.append([i for u in under[a : a + 16] for i in u])
        nodes, under = above, members
    return nodes[0], proofs


def plain(rows):
    """Rows -> (doc_id, leaf, subroot, root, proof) of all."""
    sources = defaultdict(list)
    for row in rows:
        sources[row[1]].append((row[0], leaf(row)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = []
    for s in order:
        docs = sorted(sources[s], key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
        built.append((docs, *tree([d for _, d in docs])))
    if not built:
        return Counter()
    root, above = tree([subroot for _, subroot, _ in built])
    return Counter(
        (i, d, subroot, root, proof + more)
        for (docs, subroot, proofs), more in zip(built, above, strict=True)
        for (i, d), proof in zip(docs, proofs, strict=True)
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "n", 9) for r in rows], DOCUMENTS).repartition(3)


def result(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    out = [(k, "big", "en", k, f"Text {k}") for k in range(4200)]
    out += [(k, f"s{k % 40}", None, 3, f"text {draw.random()}") for k in range(5000, 5300)]
    out += [(1, None, "de", None, None), (None, None, None, None, ""), (9, "alone", "fr", 1, "É" * 50_000)]
    out += [(8, "twice", "en", 2, "same"), (8, "twice", "en", 2, "same"), (8, "twice", "en", 2, "other"), (2**60 + 1, "twice", "en", 2, "x")]
    return out


def test_against_plain_trees(spark, rows):
    """More than a block in one source, more than 16 sources, nulls, repeats, a lone leaf."""
    got = merkle.manifest(frame(spark, rows))
    assert result(got) == plain(rows)
    assert got.filter("folded_root != root or claimed != leaf").count() == 0
    for r in got.limit(300).collect():
        assert merkle.fold(r.leaf, r.proof, [(r.number, r.total), (r.tree, r.trees)]) == r.root
    short = merkle.manifest(frame(spark, rows), proof="proof_sha256")
    assert Counter((r.doc_id, r.proof_sha256) for r in short.collect()) == Counter((r.doc_id, H(r.proof)) for r in got.collect())


def test_several_rounds_of_blocks(spark, rows, monkeypatch):
    """Blocks of one level give the same trees as blocks of three."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    digests = [leaf(r) for r in rows[:700]]
    want, proofs = tree(digests)
    nodes = [list(digests)]
    while len(nodes[-1]) > 1:
        level = nodes[-1]
        nodes.append([merkle.forward(level[a : a + 16], a, len(level))[0] for a in range(0, len(level), 16)])
    assert nodes[-1] == [want]
    suffixes = [""]
    for level in reversed(nodes[:-1]):
        below = []
        for a in range(0, len(level), 16):
            _, inner = merkle.forward(level[a : a + 16], a, len(level))
            below += merkle.backward(inner, suffixes[a // 16], a, len(level))
        suffixes = below
    assert suffixes == proofs


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4096])
def test_sweeps_of_a_block(n):
    digests = [H(str(k)) for k in range(n)]
    want, proofs = tree(digests)
    root, nodes = merkle.forward(digests, 0, n)
    assert root == want
    got = merkle.backward(nodes, "", 0, n)
    assert got == proofs
    assert all(merkle.fold(d, p, [(k, n)]) == want for k, (d, p) in enumerate(zip(digests, got, strict=True)))
    if n > 1:
        assert merkle.fold(H("no"), got[0], [(0, n)]) != want


def test_queue_delivers_by_label():
    queue = merkle.MessageQueue()
    for label, message in [((5, 2), "c"), ((3, 1), "a"), ((5, 1), "b"), ((3, 1), "z")]:
        queue.send(label, message)
    assert not queue.due((2, 9))
    assert queue.due((3, 1))
    assert [queue.receive() for _ in range(3)] == [((3, 1), ["a", "z"]), ((5, 1), ["b"]), ((5, 2), ["c"])]


def test_tampering_is_found(spark):
    rows = [(k, "s", "en", 1, "Upper" if k % 2 else "lower") for k in range(40)]
    got = merkle.manifest(frame(spark, rows), F.lower("text")).collect()
    assert all((r.folded_root == r.root) == (r.doc_id % 2 == 0) for r in got)


def test_empty_table(spark):
    assert merkle.manifest(frame(spark, [(1, "s", None, None, None)]).limit(0)).count() == 0
