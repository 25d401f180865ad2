"""Merkle manifest of a dataset: a tree of digests per source, a tree over the sources, and a proof per row.

At every level the rows of slot zero look for their siblings by an equi-join on computed indices: in a run of
``arity`` consecutive nodes the siblings of slot s are the slots s + 1, ..., s + arity - 1 modulo ``arity`` (for two,
index XOR 1). They then emit the parents, each with the digests of its run. Levels go up until each tree has one node; paths
come down the same levels, each parent handing its run and its own path on to at most ``arity`` children.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.numbering import running_sums
from lorekeep.session import cut_lineage

ARITY = 16
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    """The digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in fields]), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def slot_siblings(idx: Column, arity: int) -> Column:
    """The indices of the other nodes of a node's run, whether they exist or not."""
    if arity == 2:
        return F.array(idx.bitwiseXOR(F.lit(1)))
    base, slot = F.floor(idx / arity) * arity, idx % arity
    return F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda d: base + (slot + d) % arity)


def parents(nodes: DataFrame, arity: int) -> DataFrame:
    """The next level of trees with n > 1 nodes at this one (tree, idx, n, digest): (tree, idx, n, digest, run), run being the
    digests of the children one after another.

    The rows of slot zero ask for their siblings and emit the parents; a run of one becomes a parent too. No key
    is asked for more than once, so none is hot however large a tree is."""
    zero = nodes.where(F.col("idx") % arity == 0)
    asks = zero.select("tree", "idx", "n", F.explode(slot_siblings(F.col("idx"), arity)).alias("sibling")).where("sibling < n")
    held = nodes.select("tree", F.col("idx").alias("sibling"), "digest")
    met = asks.join(held, ["tree", "sibling"]).select("tree", "idx", "n", "sibling", "digest")
    own = zero.select("tree", "idx", "n", F.col("idx").alias("sibling"), "digest")
    members = F.array_sort(F.collect_list(F.struct("sibling", "digest")))
    runs = own.unionByName(met).groupBy("tree", "idx", "n").agg(members.alias("members"))
    run = F.aggregate("members", F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("run")
    up = F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n")
    return runs.select("tree", *up, run).withColumn("digest", F.unhex(F.sha2(as_hex(F.col("run")), 256)))


def climb(nodes: DataFrame, height: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """(the parents of each level with their runs, the top (tree, digest, height) of each tree). Each level is written.

    ``nodes`` has (tree, idx, n, digest), n being the tree's number of leaves; ``height`` is that of the highest.
    """
    levels, tops = [], []
    for h in range(height):
        tops.append(nodes.where("n = 1").select("tree", "digest", F.lit(h).alias("height")))
        nodes = cut_lineage(parents(nodes.where("n > 1"), arity))
        levels.append(nodes)
    tops.append(nodes.select("tree", "digest", F.lit(height).alias("height")))
    top = tops[0]
    for further in tops[1:]:
        top = top.unionByName(further)
    return levels, top


def height_of(n: int, arity: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // arity), height + 1
    return height


NO_PATH = "cast(array() as array<struct<run:binary,slot:bigint>>)"


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """``leaves`` (tree, idx, ...) with path and the further columns of ``tops``: path lists the run of digests that holds a node, and its
    slot there, from the leaf to the top and on along the path of ``tops`` (tree, height, path, ...).

    Paths come down from parents, each to ``arity`` children at most; a leaf row meets its parent only."""
    more = [c for c in tops.columns if c not in ("tree", "path", "height")]
    starts = tops.withColumns({"idx": F.lit(0).cast("long"), "run": F.lit(None).cast("binary")})
    carried = ["tree", "idx", "run", "path", *more]

    def step(nodes: DataFrame, above: DataFrame) -> DataFrame:
        """``nodes`` of a level below their parents; a top takes the path of its tree, which has no run."""
        up = above.withColumnsRenamed({"idx": "_up", "run": "_run"})
        met = nodes.withColumn("_up", F.floor(F.col("idx") / arity)).join(up, ["tree", "_up"])
        here = F.array(F.struct(F.col("_run").alias("run"), (F.col("idx") % arity).alias("slot")))
        path = F.when(F.col("_run").isNull(), F.col("path")).otherwise(F.concat(here, F.col("path")))
        return met.withColumn("path", path).drop("_up", "_run")

    above = starts.where(F.col("height") == len(levels)).select(*carried)
    for h, level in reversed(list(enumerate(levels))):
        stepped = step(level.select("tree", "idx", "run"), above).select(*carried)
        above = stepped.unionByName(starts.where(F.col("height") == h).select(*carried))
    return step(leaves, above).select(*leaves.columns, "path", *more)


def _sides(x: Column) -> list[Column]:
    """The digests before and behind a slot, in hex."""
    size, slot = F.lit(32), x["slot"].cast("int")
    return [as_hex(F.substring(x["run"], F.lit(1), slot * size)), as_hex(F.substring(x["run"], slot * size + size + 1, F.length(x["run"])))]


def proof_digest(path: Column) -> Column:
    """The digest of a path's sibling digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(*_sides(x))), ""), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to, in hex."""

    def up(held: Column, x: Column) -> Column:
        left, right = _sides(x)
        return F.sha2(F.concat(left, held, right), 256)

    return F.aggregate(path, as_hex(digest), up)


@dataclass
class Manifest:
    """The rows with their leaf, subroot, root and path, the root in hex, and the nodes of each level above the leaves and above the subroots."""

    rows: DataFrame
    root: str | None
    levels: list[DataFrame]
    top_levels: list[DataFrame]


def build(docs: DataFrame, extra: dict[str, Column] | None = None, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, arity: int = ARITY) -> Manifest:
    """The manifest of ``docs``. ``rows`` has the order column, group, leaf, path, subroot, root (digests as 32 bytes) and the columns
    of ``extra`` (computed where the leaf is, from the columns of ``docs``).

    Leaves are ordered by ``order`` within ``group`` (nulls first in both; equal ones by leaf, so repeated rows, which are
    equal leaves, have definite places), and the groups bytewise. Absent fields of a row count as nulls and
    empty texts as ``0:``. An empty table has no rows and no root; other columns of ``docs`` are not read.
    """
    extra = extra or {}
    digest = leaf([F.col(c) for c in fields])
    # A key without nulls that sorts as the group does: null first, then bytewise.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(order).alias("_at"), digest.alias("digest"), F.lit(1).alias("_one"), *[c.alias(k) for k, c in extra.items()])
    placed = cut_lineage(running_sums(cut_lineage(rows), ["tree"], ["_at", "digest"], "_one", "idx", "n"))
    subtrees = placed.where("idx = 0").select("tree", "n")
    most = subtrees.agg(F.max("n")).first()[0]
    levels, subroots = climb(placed.select("tree", "idx", "n", "digest"), height_of(most or 0, arity), arity)
    subroots = cut_lineage(subroots.select(F.col("tree").alias("key"), F.col("digest").alias("subroot"), F.col("height").alias("below"), F.lit(1).alias("_one"), F.lit("").alias("tree")))
    numbered = cut_lineage(running_sums(subroots, ["tree"], ["key"], "_one", "idx", "n"))
    trees = numbered.agg(F.max("n")).first()[0]
    top_levels, root = climb(numbered.select("tree", "idx", "n", F.col("subroot").alias("digest")), height_of(trees or 0, arity), arity)
    found = root.first()
    root_digest = found["digest"] if found else None
    start = root.select("tree", "height", F.expr(NO_PATH).alias("path"))
    known = numbered.select("tree", "idx", "key", "subroot", "below")
    tops = descend(known, top_levels, start, arity).select(F.col("key").alias("tree"), F.col("below").alias("height"), "path", "subroot")
    result = descend(placed, levels, cut_lineage(tops), arity)
    name = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias(group)
    chosen = result.select(F.col("_at").alias(order), name, F.col("digest").alias("leaf"), "path", "subroot", F.lit(root_digest).cast("binary").alias("root"), *extra)
    return Manifest(chosen, bytes(root_digest).hex() if root_digest else None, levels, top_levels)


def verify(manifest: Manifest, claimed: str) -> DataFrame:
    """The manifest's rows with digests in hex, the digest of each proof, the root folded from the leaf in the column ``claimed`` and
    the original siblings, and whether that is the root."""
    hexed = [as_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    others = [c for c in manifest.rows.columns if c not in ("leaf", "subroot", "root", "path", claimed)]
    folded = manifest.rows.select(
        *others, *hexed, proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col(claimed), F.col("path")).alias("folded_root")
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(docs: DataFrame, every: int = 5) -> Column:
    """The leaf of a row whose text is lower-cased (A-Z) where ``every`` divides the crc32 of the decimal doc_id, else the true leaf.
    Null ids are left alone."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    text = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return leaf([text if c == "text" else F.col(c) for c in FIELDS])


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``, every fifth tampered with."""
    built = build(docs, {"claimed": tampered(docs)})
    return verify(built, "claimed")
