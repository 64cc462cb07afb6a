"""The Merkle manifest against a plain tree built row by row."""
import hashlib

import pytest
from pyspark.sql import functions as F

from wattlens.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string, node string, at int, tree int, `a.b` int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def plain_tree(nodes):
    """(top, siblings of each node)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, at in zip(paths, places):
            p += [(n, n < at, nodes[n]) for n in (at ^ 1,) if n < len(nodes)] or [(None, False, "")]
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        places = [at // 2 for at in places]
    return nodes[0], paths


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, above = plain_tree([trees[g][0] for g in names])
    out = []
    for g, outer in zip(names, above):
        for r, path in zip(groups[g], trees[g][1]):
            claimed = (*r[:3], None if r[3] is None else r[3] + 1, r[4]) if (1 if r[0] is None else r[0]) % 3 == 0 else r
            node = plain_leaf(claimed)
            for _, left, sibling in path + outer:
                node = h(sibling, node) if left else h(node, sibling)
            out.append((r[0], plain_leaf(r), trees[g][0], root, [s for n, _, s in path + outer if n is not None], node,
                        node == root))
    return out


def key(row):
    return tuple(str(v) for v in row)


@pytest.mark.parametrize("block_levels", [1, 2, 10])
def test_manifest_equals_a_plain_tree(spark, block_levels):
    rows = [(i * 7 % 41, f"s{i % 2}", ["en", "de", "Ω", "en", "en"][i % 5], i, "wörd " * (i % 4)) for i in range(41)]
    rows += [(None, None, None, None, None), (None, "s", "en", None, ""), (5, "", None, 1, "x" * 100_000), (77, "s", "", -1, "\n"),
             (3, "s1", "en", 9, "same"), (3, "s1", "en", 9, "same"), (3, "s1", "en", 9, "other"), (2 ** 62 + 1, "s", "de", 3, "t")]
    docs = spark.createDataFrame([(*r, "n", 1, 2, 3) for r in rows], SCHEMA)
    claims = {"n_chars": F.when(F.coalesce("doc_id", F.lit(1)) % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = merkle.manifest(docs, claims=claims, block_levels=block_levels)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(plain_manifest(rows), key=key)


def test_one_row_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "s", "en", 1, "a", "n", 1, 2, 3)], SCHEMA)
    row = merkle.manifest(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof == [] and row.verified
    assert merkle.manifest(docs.limit(0)).count() == 0
