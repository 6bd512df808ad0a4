"""Merkle manifest of a table: a digest of each row, a tree for each group, a tree over the groups.

Nodes are lowercase hex SHA-256 digests, 64 characters each. The nodes of one group lie in order, and every 4,096 of them form an
*aligned block*: a row that keeps each level of its part of the tree as one string. Level k+1 is level k cut into runs of 1,024
characters (16 nodes) that are hashed and joined; the siblings of a node are the characters of its run to the left and to the right of its own.
A block ends in one node after three levels, and these nodes are the leaves of the next round, until each group has one.
All of it is DataFrame work: a block is one row, no group is gathered anywhere, and the rows of a large group spread over as many tasks as it has blocks.

Nulls: a null value is hashed as ``-``, a null group is a group of its own (before all others), rows without an id come first in their group.
Rows that repeat an id follow each other in the order of their digests; equal rows are equal leaves, each with a place of its own.
Texts of any length are hashed whole by the JVM. Columns that are not named are not read. An empty table has no root and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hitfold.llm.common import documents, partitions, written
from hitfold.session import scratch_path

RUN, DEPTH, HEX = 16, 3, 64
BLOCK, SPAN = RUN**DEPTH, RUN * HEX
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"


def digest(*values: Column) -> Column:
    """SHA-256 of texts joined, in lowercase hex."""
    return F.sha2(F.concat(*values), 256)


def leaf(*values: Column) -> Column:
    """The digest of a row: each value as its size in bytes, a colon and its text; null as a dash."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return digest(*parts)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``pos``, the place of a row within its ``group`` from 0 on, and ``n``, the rows of the group.

    Rows are dealt into sorted ranges and counted there, so a group may span any number of tasks; only one row a group and range is
    summed up. ``order`` must tell all rows apart.
    """
    held = written(
        rows.repartitionByRange(partitions(rows.sparkSession), "group", *order).sortWithinPartitions("group", *order)
        .withColumn("__llm_id", F.monotonically_increasing_id()),
        "numbered",
    )
    part = F.shiftright("__llm_id", 33).alias("__llm_part")
    within = Window.partitionBy("group")
    before = within.orderBy("__llm_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = held.groupBy("group", part).agg(F.min("__llm_id").alias("__llm_first"), F.count(F.lit(1)).alias("__llm_rows")).select(
        "group", "__llm_part", (F.coalesce(F.sum("__llm_rows").over(before), F.lit(0)) - F.col("__llm_first")).alias("__llm_shift"),
        F.sum("__llm_rows").over(within).alias("n"),
    )
    return held.withColumn("__llm_part", part).join(runs, ["group", "__llm_part"]).select(
        *rows.columns, (F.col("__llm_id") + F.col("__llm_shift")).alias("pos"), "n"
    )


def _above(level: str, n: Column) -> Column:
    """The string of the next level; where the group has one node, the level itself."""
    runs = F.sequence(F.lit(0), F.expr(f"int((octet_length({level}) - 1) div {SPAN})"))
    joined = F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(F.col(level), i * SPAN + 1, F.lit(SPAN)), 256)), "")
    return F.when(n > 1, joined.cast("binary")).otherwise(F.col(level))


def blocks_of(nodes: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Aligned blocks of ``nodes`` (group, pos, n, node and what is ``carried``): their members and levels as strings."""
    rows = nodes.groupBy("group", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "node", *carried))).alias("members")
    )
    rows = rows.withColumn("level0", F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary"))
    n = F.col("n")
    for k in range(DEPTH):
        rows = rows.withColumn(f"level{k + 1}", _above(f"level{k}", n))
        n = F.ceil(n / RUN)
    return rows.withColumn("node", F.col(f"level{DEPTH}").cast("string"))


def _path(i: Column) -> Column:
    """The siblings of a block's member ``i``, level by level: what lies left and right of it in its run."""
    steps = []
    for k in range(DEPTH):
        level = F.col(f"level{k}")
        at, own = F.floor(i / RUN**k).cast("int"), F.floor(i / RUN**k).cast("int") % RUN
        left = F.substring(level, (at - own) * HEX + 1, own * HEX)
        right = F.substring(level, at * HEX + HEX + 1, (RUN - 1 - own) * HEX)
        steps.append(F.struct(left.cast("string").alias("l"), right.cast("string").alias("r")))
    levels = sum((F.when(F.col("n") > RUN**k, 1).otherwise(0) for k in range(DEPTH)), F.lit(0))
    return F.slice(F.array(*steps), F.lit(1), levels)


def members(blocks: DataFrame, above: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """The members of blocks with their ``path`` to the top of the tree; ``above`` has the paths of the blocks' own nodes."""
    if above is None:
        rows, rest = blocks, F.lit(None).cast(PATH)
    else:
        rows = blocks.drop("node").join(above.select("group", F.col("pos").alias("block"), F.col("path").alias("__llm_rest")), ["group", "block"])
        rest = F.col("__llm_rest")
    rest = F.coalesce(rest, F.array().cast(PATH))
    held = F.transform("members", lambda m, i: F.struct(m["pos"].alias("pos"), m["node"].alias("node"), *[m[c].alias(c) for c in carried], F.concat(_path(i), rest).alias("path")))
    return rows.select("group", F.inline(held))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(path, node, lambda own, step: digest(step["l"], own, step["r"]))


def siblings(path: Column) -> Column:
    """The digests of all siblings, level by level, joined."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["l"], step["r"])), "")


@dataclass
class Tree:
    """A tree as tables of aligned blocks, one for each three levels, below ``path``."""

    spark: SparkSession
    path: str
    rounds: int
    carried: tuple[str, ...] = ()

    def blocks(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{k}")

    def tops(self) -> DataFrame:
        """(group, node): the one node that is left of each group."""
        return self.blocks(self.rounds - 1).select("group", "node")

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """(group, pos, node, carried columns, path) of all leaves."""
        for k in reversed(range(self.rounds)):
            above = members(self.blocks(k), above, () if k else self.carried)
        return above


def grow(nodes: DataFrame, path: str, carried: tuple[str, ...] = ()) -> Tree:
    """Write the trees over ``nodes`` (group, pos, n, node); a round for every three levels."""
    spark, k = nodes.sparkSession, 0
    while True:
        blocks_of(nodes, () if k else carried).write.parquet(f"{path}/{k}")
        below = spark.read.parquet(f"{path}/{k}")
        k += 1
        if below.filter(f"n > {BLOCK}").isEmpty():
            return Tree(spark, path, k, carried)
        nodes = below.select("group", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), "node")


@dataclass
class Manifest:
    """The trees of the groups, and the tree over their tops."""

    groups: Tree
    whole: Tree
    root: str | None

    def proofs(self) -> DataFrame:
        """(group, pos, node, carried columns, subroot, path): every leaf with the siblings that lead it to the root."""
        subroots = self.whole.paths().select(F.col("name").alias("group"), F.col("node").alias("subroot"), F.col("path").alias("__llm_up"))
        top = F.lit(0).cast("long").alias("pos")
        above = subroots.select("group", top, F.col("__llm_up").alias("path"))
        tops = subroots.select("group", "subroot")
        return self.groups.paths(above).join(tops, "group")


def manifest(leaves: DataFrame, path: str, *order: str, carried: tuple[str, ...] = ()) -> Manifest:
    """Write the manifest of ``leaves`` (group string, node, and the columns that order and accompany them)."""
    placed = numbered(leaves, *order)
    groups = grow(placed, f"{path}/groups", carried)
    names = groups.tops().select(F.lit("").alias("group"), F.col("group").alias("name"), "node")
    whole = grow(numbered(names, "name"), f"{path}/whole", ("name",))
    top = whole.tops().first()  # one digest
    return Manifest(groups, whole, top["node"] if top else None)


def group_of(source: Column) -> Column:
    """A group's key: sorted as text, the null group first."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def tampered(doc_id: Column) -> Column:
    """Whether the check tampers with a document: 5 divides the crc32 of its decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def verify(docs: DataFrame, path: str) -> DataFrame:
    """Every document's proof, and where it leads after the given part of them was tampered with."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = [F.col(c) for c in COLUMNS]
    rows = written(
        docs.select(
            "doc_id", group_of(F.col("source")).alias("group"), leaf(*own).alias("node"),
            F.when(tampered(F.col("doc_id")), leaf(*own[:-1], lowered)).alias("altered"), F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    made = manifest(rows, path, "doc_id", "node", "row", carried=("doc_id", "altered"))
    root = F.lit(made.root).cast("string")
    return made.proofs().select(
        "doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("altered", "node"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by source, and the check of every leaf against its root."""
    return verify(documents(spark, sf_dir, *COLUMNS), scratch_path(spark, "merkle"))


_CRC_STEP = "xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)"
ORACLE = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE given AS (
  SELECT *, row_number() OVER () AS row,
    CASE WHEN doc_id IS NULL THEN false ELSE xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
      string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: {_CRC_STEP}),
      4294967295) % 5 = 0 END AS bad FROM documents
), parts AS (
  SELECT row, doc_id, source, bad, text,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM given
), leaves AS (
  SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN bad THEN sha256(head || coalesce(strlen(text) || ':' ||
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS altered FROM parts
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp FROM leaves
), tree AS (
  SELECT 0 AS level, grp, pos, leaf AS node, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT level + 1, grp, run, node, count(*) OVER (PARTITION BY grp) FROM (
    SELECT level, grp, pos // 16 AS run, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM tree WHERE n > 1 GROUP BY level, grp, pos // 16)
), runs AS (
  SELECT level, grp, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS nodes FROM tree WHERE n > 1 GROUP BY level, grp, pos // 16
), subroots AS (SELECT grp, node FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS level, grp AS pos, node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, run, node, count(*) OVER () FROM (
    SELECT level, pos // 16 AS run, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM crown WHERE n > 1 GROUP BY level, pos // 16)
), high AS (
  SELECT level, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS nodes FROM crown WHERE n > 1 GROUP BY level, pos // 16
), climbed AS (
  SELECT 0 AS level, row, grp, pos, coalesce(altered, leaf) AS own, '' AS seen FROM placed
  UNION ALL
  SELECT c.level + 1, c.row, c.grp, c.pos // 16, sha256(substr(nodes, 1, (c.pos % 16) * 64) || own || substr(nodes, (c.pos % 16) * 64 + 65)),
    seen || substr(nodes, 1, (c.pos % 16) * 64) || substr(nodes, (c.pos % 16) * 64 + 65)
  FROM climbed c JOIN runs r ON r.level = c.level AND r.grp = c.grp AND r.run = c.pos // 16
), inner_top AS (SELECT row, grp, arg_max(own, level) AS own, arg_max(seen, level) AS seen FROM climbed GROUP BY row, grp
), outer_climb AS (
  SELECT 0 AS level, row, grp AS pos, own, seen FROM inner_top
  UNION ALL
  SELECT c.level + 1, c.row, c.pos // 16, sha256(substr(nodes, 1, (c.pos % 16) * 64) || own || substr(nodes, (c.pos % 16) * 64 + 65)),
    seen || substr(nodes, 1, (c.pos % 16) * 64) || substr(nodes, (c.pos % 16) * 64 + 65)
  FROM outer_climb c JOIN high r ON r.level = c.level AND r.run = c.pos // 16
), ended AS (SELECT row, arg_max(own, level) AS own, arg_max(seen, level) AS seen FROM outer_climb GROUP BY row
), top AS (SELECT node AS root FROM crown WHERE n = 1)
SELECT p.doc_id, p.leaf, s.node AS subroot, root, sha256(seen) AS proof_sha256, own AS folded_root, own = root AS verified
FROM placed p JOIN subroots s USING (grp) JOIN ended USING (row) CROSS JOIN top
"""
}
