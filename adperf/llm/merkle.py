"""Merkle manifest of a table, and the climb that checks every row against its root.

Every row is a leaf: the hash of its fields. The leaves of one group (``lang``), ascending by
id, stand under a tree of runs of ``FANOUT`` nodes; the groups' subroots, ordered by group,
stand under one more tree, whose top is the root of the table.

Built levels are stored as parent-linked node rows: a node holds its children's digests and
names its parent and its own place in the parent's run. A recursive query then ascends from
every leaf at once: each step joins the node above, appends the siblings it holds (the digests
beside the climber's own place) and folds the climber's digest with them. The digest that
arrives at the top equals the root only if the leaf that set out is the one in the manifest.

At scale: texts are hashed where they are read and never shuffled. Places inside a group come
from one range shuffle of (group, id, digest) rows and counts per (partition, group), not from
a window over a group. A node above ``BLOCK`` leaves is stored once for each block of them, so
the join of a step meets no hot key: not even at the root, where all leaves arrive. A climber
takes its digest along only; the siblings of a step are in that step's row, and are put
together per leaf once, at the end. Above a block all its leaves have the same siblings, which
its first leaf appends for all.

Edge cases: a null field hashes as ``-``; null ids come first in their group and a null group
before all others; a row with a null id is never tampered with; rows that repeat an id are
ordered by digest, and equal rows are equal leaves with places of their own; a group with one
row is its own subroot, and a table with one group has that group's subroot as root; an empty
table gives no rows; texts of any length are hashed whole; other columns are not read, so
clashing names do not matter.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import cut, scope

FANOUT = 8
BLOCK = FANOUT ** 4  # leaves that share one stored copy of the nodes above them
CELL_ROWS = 20_000  # rows of a partition of the order, where there are few
ROOT_TREE = -1
NODE_ROWS = ("for_tree long, block long, tree long, level int, idx long, children binary, "
             "up_tree long, up_level int, up_idx long, slot int, wide boolean")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

CLIMB = """
WITH RECURSIVE climb (tree, block, leaf_at, hop, up_tree, up_level, up_idx, slot, folded,
                      wide, siblings, doc_id, leaf) AS (
    SELECT tree, block, idx, 0, up_tree, up_level, up_idx, slot, coalesce(changed, hash),
           false, CAST(NULL AS BINARY), doc_id, hash
    FROM {leaves}
    UNION ALL
    SELECT c.tree, c.block, c.leaf_at, c.hop + 1, n.up_tree, n.up_level, n.up_idx, n.slot,
           unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * c.slot), c.folded,
                                       substring(n.children, 32 * c.slot + 33)))), 256)),
           n.wide,
           CASE WHEN NOT n.wide OR c.leaf_at % {size} = 0
                THEN concat(substring(n.children, 1, 32 * c.slot),
                            substring(n.children, 32 * c.slot + 33)) END,
           CAST(NULL AS BIGINT), CAST(NULL AS BINARY)
    FROM climb c JOIN {nodes} n
      ON n.for_tree = c.tree AND n.block = c.block
     AND n.tree = c.up_tree AND n.level = c.up_level AND n.idx = c.up_idx
)
SELECT tree, block, leaf_at, hop, folded, wide, siblings, doc_id, leaf FROM climb
"""


def _digest(binary: Column) -> Column:
    """H of digests, which enter as hex text; as bytes."""
    return F.unhex(F.sha2(F.lower(F.hex(binary)), 256))


def leaf_digest(*fields: Column) -> Column:
    """H of the fields: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    parts = [F.coalesce(F.concat(F.octet_length(v := f.cast("string")), F.lit(":"), v), F.lit("-"))
             for f in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaf_rows(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """grp, doc_id, hash of each document, and ``changed``: the hash after tampering (A-Z of
    the text in lower case) where ``tampered`` holds, else null."""
    head = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars")]
    text = F.col("text")
    lowered = leaf_digest(*head, F.translate(text, UPPER, LOWER))
    return docs.select(
        F.col("lang").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(*head, text).alias("hash"),
        F.when(F.lit(False) if tampered is None else tampered, lowered).alias("changed"))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``tree`` (number of the group), ``idx`` (place in the group by id, digest)
    and ``n`` (rows of the group); and the groups: grp, tree, n."""
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(most, -(-rows.count() // CELL_ROWS)))
    order = ["grp", "doc_id", "hash", "uid"]  # uid: equal rows may lie in several partitions
    laid = (rows.withColumn("uid", F.monotonically_increasing_id())
            .repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .withColumn("at", F.monotonically_increasing_id()).drop("uid"))
    laid = cut(laid.withColumn("cell", F.shiftright("at", 33)), "merkle-laid")
    cells = cut(laid.groupBy("cell", "grp").agg(F.min("at").alias("first"),
                                                F.count(F.lit(1)).alias("rows")), "merkle-cells")
    running = Window.partitionBy("grp").orderBy("cell")
    cells = cells.withColumn("before", F.sum("rows").over(running) - F.col("rows"))
    sums = cells.groupBy("grp").agg(F.min("cell").alias("cell"), F.sum("rows").alias("n"))
    # groups are numbered by the partition they start in (few rows), then inside it
    starts = sums.groupBy("cell").agg(F.count(F.lit(1)).alias("k"))
    starts = starts.select(F.col("cell").alias("at_cell"), (
        F.sum("k").over(Window.orderBy("cell")) - F.col("k")).alias("base"))
    inside = F.row_number().over(Window.partitionBy("cell").orderBy("grp"))
    groups = (sums.withColumn("inside", inside).join(starts, F.col("cell") == F.col("at_cell"))
              .select("grp", (F.col("base") + F.col("inside") - 1).alias("tree"), "n"))
    groups = cut(groups, "merkle-groups")
    g = groups.withColumnRenamed("grp", "g")
    cells = (cells.join(g, F.col("grp").eqNullSafe(F.col("g")))
             .select(F.col("cell").alias("c"), "g", "tree", "n",
                     (F.col("before") - F.col("first")).alias("shift")))
    cells = cut(cells, "merkle-shifts")
    out = (laid.join(cells, (F.col("cell") == F.col("c")) & F.col("grp").eqNullSafe(F.col("g")))
           .select("tree", (F.col("at") + F.col("shift")).alias("idx"), "n", "doc_id", "hash",
                   "changed"))
    return cut(out, "merkle-leaves"), groups


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Levels above ``nodes`` (tree, idx, n, hash), of which a tree has ``most`` at most: each
    (tree, level, idx, n, children, hash); ``n`` is the number of nodes of the tree's level."""
    out = []
    while most > 1:
        run = F.sort_array(F.collect_list(F.struct("idx", "hash")))
        children = F.aggregate(F.col("run"), F.lit(b""), lambda acc, x: F.concat(acc, x["hash"]))
        up = (nodes.where(F.col("n") > 1)
              .groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("up"))
              .agg(run.alias("run"), F.first("n").alias("n"))
              .select("tree", F.lit(len(out) + 1).alias("level"), F.col("up").alias("idx"),
                      F.ceil(F.col("n") / FANOUT).alias("n"), children.alias("children")))
        nodes = cut(up.withColumn("hash", _digest(F.col("children"))), "merkle-level")
        out.append(nodes)
        most = -(-most // FANOUT)
    return out


def _linked(nodes: DataFrame, trees: int) -> DataFrame:
    """``nodes`` with their parent and their place in its run; the root has none."""
    inner, top = F.col("n") > 1, (F.col("tree") >= 0) & F.lit(trees > 1)
    place = F.when(inner, F.col("idx")).when(top, F.col("tree"))
    up = F.when(inner, F.col("tree")).when(top, F.lit(ROOT_TREE))
    return nodes.withColumns({
        "up_tree": up.cast("long"), "up_idx": F.floor(place / FANOUT),
        "up_level": F.when(inner, F.col("level") + 1).when(top, F.lit(1)),
        "slot": (place % FANOUT).cast("int")})


def _node_rows(spark: SparkSession, levels: list[DataFrame], tops: list[DataFrame],
               groups: DataFrame, trees: int) -> DataFrame:
    """Node rows, one for each block of leaves below: what the climb joins."""
    last = F.floor((F.col("rows") - 1) / BLOCK)
    sizes = groups.select("tree", F.col("n").alias("rows"))
    out = spark.createDataFrame([], NODE_ROWS)  # nothing stands above a lone leaf
    for k, level in enumerate(levels, 1):
        rows = _linked(level, trees).withColumns({
            "for_tree": F.col("tree"), "wide": F.lit(FANOUT ** (k - 1) >= BLOCK)})
        if FANOUT ** k <= BLOCK:
            rows = rows.withColumn("block", F.floor(F.col("idx") * FANOUT ** k / BLOCK))
        else:
            step = FANOUT ** k // BLOCK
            ends = F.least((F.col("idx") + 1) * step - 1, last)
            rows = (rows.join(sizes, "tree")
                    .withColumn("block", F.explode(F.sequence(F.col("idx") * step, ends))))
        out = out.unionByName(rows.select(*out.columns))
    for k, level in enumerate(tops, 1):
        under = sizes.select(F.col("tree").alias("for_tree"), "rows",
                             F.floor(F.col("tree") / FANOUT ** k).alias("idx"))
        rows = (_linked(level, trees).join(under, "idx")
                .withColumn("wide", F.lit(True))
                .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))))
        out = out.unionByName(rows.select(*out.columns))
    return out


@contextmanager
def _whole_recursion(spark: SparkSession):
    """The recursive query returns a row for each leaf and level, in as many partitions as its
    first step has: meanwhile no row limit, and no partitions joined for being small."""
    wanted = {"spark.sql.cteRecursionRowLimit": "-1",
              "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    Digests are lowercase hex. ``tampered`` (a condition on a row) marks the rows whose text is
    changed after the manifest was built: their climb starts from the changed leaf.
    """
    with scope() as made:
        out = _proved(cut(leaf_rows(docs, tampered), "merkle-hashes"))
        made.remove(out)
    return out


def _proved(rows: DataFrame) -> DataFrame:
    """The manifest of ``rows`` (from :func:`leaf_rows`) and every row's climb, as a table."""
    spark = rows.sparkSession
    leaves, groups = placed(rows)
    size = groups.agg(F.max("n"), F.count(F.lit(1))).first()
    most, trees = size[0] or 0, size[1]
    levels = _levels(leaves, most)
    subroots = None
    for nodes in [leaves, *levels]:
        top = nodes.where(F.col("n") == 1).select("tree", "hash")
        subroots = top if subroots is None else subroots.unionByName(top)
    subroots = cut(subroots, "merkle-subroots")
    tops = _levels(subroots.select(F.lit(ROOT_TREE).cast("long").alias("tree"),
                                   F.col("tree").alias("idx"), F.lit(trees).alias("n"), "hash"),
                   trees)
    last = (tops[-1] if tops else subroots).select(F.lower(F.hex("hash"))).first()
    root = F.lit(last[0] if last else None).cast("string")
    starts = _linked(leaves.withColumn("level", F.lit(0)), trees).withColumn(
        "block", F.floor(F.col("idx") / BLOCK))
    nodes = cut(_node_rows(spark, levels, tops, groups, trees), "merkle-nodes")
    climb = spark.sql(CLIMB, leaves=starts, nodes=nodes, size=BLOCK)
    # one shuffle by block serves the groups of a leaf and what the block's first leaf appended
    steps = F.sort_array(F.collect_list(F.struct("hop", "wide", "siblings")))
    per_leaf = (climb.repartition("tree", "block").groupBy("tree", "block", "leaf_at")
                .agg(F.max("doc_id").alias("doc_id"), F.max("leaf").alias("leaf"),
                     steps.alias("steps"), F.max_by("folded", "hop").alias("folded")))

    def appended(wide: bool) -> Column:
        own = F.filter("steps", lambda x: x["wide"] == F.lit(wide))
        return F.concat_ws("", F.transform(own, lambda x: F.lower(F.hex(x["siblings"]))))

    above = F.max(appended(True)).over(Window.partitionBy("tree", "block"))
    per_leaf = (per_leaf.withColumn("text", F.concat(appended(False), above))
                .join(subroots.withColumnRenamed("hash", "subroot"), "tree"))
    out = per_leaf.select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"),
        root.alias("root"), F.sha2("text", 256).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"))
    with _whole_recursion(spark):
        return cut(out.withColumn("verified", F.col("folded_root") == F.col("root")),
                   "merkle-out")


def tampered_third(id_col: str = "doc_id") -> Column:
    """Rows whose decimal id has a CRC-32 that three divides; never a null id."""
    crc = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    return F.coalesce(crc % 3 == 0, F.lit(False))
