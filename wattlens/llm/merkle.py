"""Merkle manifest of a table: leaf digests, one tree per group, a root over the groups, and a proof for every row.

Leaves get their place by a range-partitioned sort. A superblock is `2 ** BLOCK_LEVELS` neighbouring nodes of one tree: it is
reduced to one node by a group of its own, its nodes are reduced again, and so on, so that no group ever holds more and a
tree with most of the rows is spread like all others. On the way down, every superblock is cogrouped with the outer nodes
that it needs (the siblings above its top, about one per doubling of the rows): one function reduces it locally, joins its
proofs and folds them. Tables between the tiers are stored, so a lost executor repeats one tier's tasks.
"""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wattlens.llm.arrow_text import ship
from wattlens.plans.joins import lookup_join
from wattlens.plans.ordering import global_rank
from wattlens.plans.staging import stage

BLOCK_LEVELS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 in hex of all values one after the other, each as its UTF-8 length, `:` and itself; null is `-`."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def reduced(nodes: list[str], steps: int) -> list[list[str]]:
    """The nodes and `steps` levels above them; an odd last node goes up as the digest of itself alone."""
    levels = [nodes]
    for _ in range(steps):
        below = levels[-1]
        levels.append([digest("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return levels


def local_steps(size: int, block_levels: int) -> int:
    """Levels that a superblock of a tree with `size` nodes rises: to the tree's top, or as far as all others do."""
    return min(block_levels, (int(size) - 1).bit_length())


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """The sibling of each level on the way up from node `at`: `<` or `>` for its side and its digest; empty: none."""
    path = []
    for level in levels[:-1]:
        other = at ^ 1
        path.append((("<" if other < at else ">") + level[other]) if other < len(level) else "")
        at >>= 1
    return path


def fold(node: str, path: list[str]) -> str:
    """The root that a node and its path lead to."""
    for step in path:
        node = digest(step[1:] + node if step[:1] == "<" else node + step[1:])
    return node


def rise(nodes: DataFrame, block_levels: int) -> DataFrame:
    """(tree, pos, node, size) of the next tier: one node for every superblock."""
    def up(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        size, pos = int(block["size"].iloc[0]), int(block["pos"].iloc[0]) >> block_levels
        top = reduced(block["node"].tolist(), local_steps(size, block_levels))[-1][0]
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "pos": [pos], "node": [top],
                             "size": [-(-size >> block_levels)]})

    return (ship(nodes).groupBy("tree", F.shiftright("pos", block_levels).alias("block"))
            .applyInPandas(up, "tree bigint, pos bigint, node string, size bigint"))


def tiers(nodes: DataFrame, largest: int, block_levels: int) -> list[DataFrame]:
    """Stored tiers from `nodes` up to one node per tree."""
    out = [nodes]
    while largest > 1:
        out.append(stage(rise(out[-1], block_levels), "merkle-tier"))
        largest = -(-largest >> block_levels)
    return out


def descend(nodes: DataFrame, outer: DataFrame, block_levels: int, finish: bool = False) -> DataFrame:
    """Cogroup superblocks with their outer nodes. `outer`: tree, pos (of the superblock), path, subroot, root.

    Gives the same columns for every node of the superblocks, or with `finish` the finished rows of leaves: id, leaf,
    subroot, root, proof (siblings from the leaf up to the root), folded_root (from `claimed`, else from the leaf).
    """
    def down(key: tuple, block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        levels = reduced(block["node"].tolist(), local_steps(block["size"].iloc[0], block_levels))
        top, outside = above.iloc[0], list(above["path"].iloc[0])
        paths = [siblings(levels, i) + outside for i in range(len(block))]
        roots = {"subroot": [top["subroot"]] * len(block), "root": [top["root"]] * len(block)}
        if not finish:
            return pd.DataFrame({"tree": block["tree"].to_numpy(), "pos": block["pos"].to_numpy(), "path": paths, **roots})
        folded = [fold(claimed or node, path) for claimed, node, path in zip(block["claimed"], block["node"], paths)]
        return pd.DataFrame({"id": block["id"].to_numpy(), "leaf": block["node"].to_numpy(), **roots,
                             "proof": [[s[1:] for s in path if s] for path in paths], "folded_root": folded})

    schema = ("id string, leaf string, subroot string, root string, proof array<string>, folded_root string" if finish
              else "tree bigint, pos bigint, path array<string>, subroot string, root string")
    block = F.shiftright("pos", block_levels).alias("block")
    above = outer.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return ship(nodes).groupBy("tree", block).cogroup(above).applyInPandas(down, schema)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: list[str] | None = None,
             claims: dict[str, Column] | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of `docs`: the id, leaf, subroot (of its group), root, proof, folded_root, verified.

    A leaf is the digest of `fields`. The leaves of a group ascend by id (null first; equal ids by their leaves, so repeated
    rows stand side by side) and pair up level by level, an odd last one alone, up to the subroot; a lone leaf is its
    group's subroot. Subroots, null group first and then by UTF-8 bytes, lead to the root in the same way. `proof` holds
    the siblings from the leaf to the root; none if there is one row only. `claims` maps field names to the values that
    a holder of the row claims now: folded_root is the root that these lead to with the proof, and `verified` whether it
    is the true one. Null, empty and very long values are digested whole. Other columns are left out, whatever their
    names are. Empty table: no rows.
    """
    column = {name: F.col(f"`{name}`") for name in docs.columns}
    fields = fields or FIELDS
    leaf = leaf_digest([column[f] for f in fields])
    claimed = leaf_digest([{**column, **(claims or {})}[f] for f in fields])
    leaves = docs.select(column[id_col].alias("id"), column[group_col].alias("group"), leaf.alias("node"),
                         F.nullif(claimed, leaf).alias("claimed"))
    placed = global_rank(leaves, ["group", "id", "node", "claimed"], "at")
    groups = stage(placed.groupBy("group").agg(F.min("at").alias("start"), F.count("*").alias("size")), "merkle-groups")
    trees = stage(global_rank(groups, ["group"], "tree"), "merkle-trees")
    nodes = (lookup_join(placed, trees, ["group"], spread=["at"], null_safe=True)
             .select("tree", (F.col("at") - F.col("start")).alias("pos"), "node", "size", F.col("id").cast("string").alias("id"),
                     "claimed"))
    largest, count = trees.agg(F.max("size"), F.count("*")).first()
    lower = tiers(nodes, largest or 0, block_levels)
    subroots = stage(lower[-1].select("tree", "node"), "merkle-subroots")
    upper = tiers(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"), "node",
                                  F.lit(count).cast("long").alias("size")), count, block_levels)
    outer = upper[-1].select("tree", "pos", F.array().cast("array<string>").alias("path"),
                             F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for tier in upper[-2::-1]:
        outer = descend(tier, outer, block_levels)
    outer = (outer.select((F.col("pos") + 1).alias("tree"), "path", "root").join(subroots, "tree")
             .select("tree", F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root"))
    for tier in lower[-2:0:-1]:
        outer = stage(descend(tier, outer, block_levels), "merkle-outer")
    if len(lower) == 1:  # every group is a lone leaf, which is a superblock of its own
        outer = stage(outer, "merkle-outer")
    return (descend(nodes, outer, block_levels, finish=True)
            .withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The claim: rows whose crc32 of the id 7 divides say one character more than they have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = manifest(docs, claims={"n_chars": more})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
                       "folded_root", "verified")


OP12_SQL = """
WITH RECURSIVE crc(doc_id, c) AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
    string_split(doc_id::VARCHAR, ''), lambda d: list_concat([ascii(d)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)
  FROM documents),
leaves AS (
  SELECT d.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY d.lang) AS n, d.head || d.chars || d.tail AS plain,
    d.head || CASE WHEN crc.c % 7 = 0 THEN d.more ELSE d.chars END || d.tail AS claimed
  FROM (SELECT doc_id, lang,
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') AS head,
      coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS chars,
      coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS more,
      coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents) d JOIN crc USING (doc_id)),
low(lang, lv, pos, node, n) AS (
  SELECT lang, 0, pos, sha256(plain), n FROM leaves
  UNION ALL
  SELECT lang, lv + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2
  FROM low WHERE n > 1 GROUP BY lang, lv, pos // 2),
tops AS (SELECT lang, lv AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
  count(*) OVER () AS n FROM low WHERE n = 1),
high(lv, pos, node, n) AS (
  SELECT 0, pos, subroot, n FROM tops
  UNION ALL
  SELECT lv + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2
  FROM high WHERE n > 1 GROUP BY lv, pos // 2),
top AS (SELECT node AS root, lv AS height FROM high WHERE n = 1),
steps AS (
  SELECT l.doc_id, s.lv, (l.pos >> s.lv) % 2 AS odd, b.node AS sibling
  FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang JOIN range(64) s(lv) ON s.lv < t.height
  LEFT JOIN low b ON b.lang IS NOT DISTINCT FROM l.lang AND b.lv = s.lv AND b.pos = xor(l.pos >> s.lv, 1)
  UNION ALL
  SELECT l.doc_id, t.height + s.lv, (t.pos >> s.lv) % 2, b.node
  FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang CROSS JOIN top JOIN range(64) s(lv) ON s.lv < top.height
  LEFT JOIN high b ON b.lv = s.lv AND b.pos = xor(t.pos >> s.lv, 1)),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY lv), '')) AS proof_sha256 FROM steps GROUP BY doc_id),
folds(doc_id, lv, node) AS (
  SELECT doc_id, 0, sha256(claimed) FROM leaves
  UNION ALL
  SELECT f.doc_id, f.lv + 1, sha256(CASE WHEN s.odd = 1 THEN coalesce(s.sibling, '') || f.node ELSE f.node || coalesce(s.sibling, '') END)
  FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.lv = f.lv)
SELECT l.doc_id, sha256(l.plain) AS leaf, t.subroot, top.root,
  coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = top.root AS verified
FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang CROSS JOIN top LEFT JOIN proofs p ON p.doc_id = l.doc_id
JOIN folds f ON f.doc_id = l.doc_id AND f.lv = t.height + top.height
"""
