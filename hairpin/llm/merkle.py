"""A Merkle manifest of a table: a root, and for each row a proof that it belongs to that root.

A row's leaf is the SHA-256 of its framed columns. The leaves of a source, ascending by id, are the nodes of level 0; every FANOUT consecutive
nodes become one node of the next level until one is left, the source's subroot. The subroots, ordered by source, are the leaves of a
second tree, whose last node is the root.

One level is one window over the runs of FANOUT nodes: lag and lead columns of fixed offsets 1 to FANOUT - 1, masked by a node's slot and
its run's length, are its siblings, and the row of each run's first child hashes the parent from them. A window's group is one run,
whatever the size of its source, so a source that holds a third of all rows is dealt out like any other. Places within a source come
from a sort by range, with counts of each part of it: no task holds a source. Texts are read once and don't leave the
scan; level 0 is hashed again for the proofs rather than stored with its siblings.

Defined results: a null column is framed as ``-`` and so differs from an empty one; a null source is a source of its own, ordered first; null ids
come first within it; rows with equal ids are ordered by their leaves, so repeated rows are neighbours with leaves of their own; a source of
one row has that leaf as its subroot, and a table of one source has that subroot as its root; an empty table gives an empty table; columns
other than the five are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hairpin.plans.lineage import discard, store

FANOUT = 16
#: A row is tampered with, for the check, where this divides the crc32 of its id as decimal text.
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, tampered, salt): tampered is the leaf of the row with its text's A-Z in lower case, null where the row isn't chosen
    for it; salt parts rows that are equal in all else."""
    c = {n: F.col(f"`{n}`") for n in ("doc_id", "source", "lang", "n_chars", "text")}
    leaf = lambda text: _hash(*[framed(c[n]) for n in ("doc_id", "source", "lang", "n_chars")], framed(text))
    chosen = F.crc32(c["doc_id"].cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(
        F.coalesce(F.concat(F.lit(":"), c["source"]), F.lit("-")).alias("key"),  # null first, then bytewise
        c["doc_id"].alias("doc_id"),
        leaf(c["text"]).alias("leaf"),
        F.when(chosen, leaf(F.translate(c["text"], _UPPER, _LOWER))).alias("tampered"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` of stored data with idx, the place from 0 within its key by ``order``, and n, the key's rows.

    Rows are dealt out by range of (key, order); a part's rows of one key are consecutive, so a row's place is its distance from the first
    of them and the key's rows in the parts before.
    """
    dealt = store(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))
    stretches = dealt.groupBy("key", "part").agg(F.min("seq").alias("first"), F.count("*").alias("rows"))
    own = Window.partitionBy("key")
    before = F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    stretches = stretches.select("key", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(own).alias("n"))
    placed = store(dealt.join(stretches, ["key", "part"]).withColumn("idx", F.col("seq") + F.col("shift")).drop("part", "seq", "shift"))
    discard(dealt)
    return placed


def with_siblings(nodes: DataFrame, value: str = "h") -> DataFrame:
    """``nodes`` (key, idx, n, value) with run, slot and the digests left and right of each in its run, concatenated."""
    run = nodes.withColumns({"run": F.expr(f"idx div {FANOUT}"), "slot": (F.col("idx") % FANOUT).cast("int")})
    size = F.least(F.lit(FANOUT), F.col("n") - F.col("run") * FANOUT)
    w = Window.partitionBy("key", "run").orderBy("idx")
    none = F.lit("")
    left = [F.when(F.col("slot") >= k, F.lag(value, k).over(w)).otherwise(none) for k in range(FANOUT - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < size, F.lead(value, k).over(w)).otherwise(none) for k in range(1, FANOUT)]
    return run.withColumns({"left": F.concat(*left), "right": F.concat(*right)})


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes``, which have siblings: one row for each run, from its first child."""
    first = nodes.where((F.col("slot") == 0) & (F.col("n") > 1))
    return first.select("key", F.col("run").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), _hash(F.col("h"), F.col("right")).alias("h"))


def tree(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, h) of the last node of each key, and the stored levels from 1 upward with their siblings. ``nodes`` (key, idx, n, h) is stored."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, level = [], nodes
    while most > 1:
        below = with_siblings(level.select("key", "idx", "n", "h")) if not levels else level
        level = store(with_siblings(_parents(below)))
        levels.append(level)
        most = -(-most // FANOUT)
    ends = [x.where("n = 1").select("key", "h") for x in [nodes, *levels]]
    tops = ends[0]
    for x in ends[1:]:
        tops = tops.unionByName(x)
    return tops, levels


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """(key, run, path, columns of ``above``) for the parents of the nodes of level 0, run 0 where a key has one node: the siblings from the
    parent up to the key's last node, then those that ``above`` (key, path, ...) has for the key."""
    more = [c for c in above.columns if c not in ("key", "path")]
    known, used = None, []
    for level in reversed(levels):
        last = level.where("n = 1").select("key", "idx").join(above, "key").select("key", F.col("idx").alias("run"), "path", *more)
        if known is not None:
            own = F.array(F.struct("left", "right"))
            inner = level.where("n > 1").select("key", "idx", "run", "left", "right").join(known, ["key", "run"])
            last = last.unionByName(inner.select("key", F.col("idx").alias("run"), F.concat(own, "path").alias("path"), *more))
        known = store(last)
        used.append(known)
    discard(*used[:-1])
    return known


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs``.

    proof_sha256 is the hash of the row's siblings, level by level up to the root; folded_root is what the row's leaf and these siblings
    give, the leaf being that of the tampered row where the row is chosen for it.
    """
    scanned = store(leaves(docs))
    nodes = numbered(scanned, ["doc_id", "leaf", "salt"])
    subroots, levels = tree(nodes.withColumnRenamed("leaf", "h"))
    # the second tree: one key, whose leaves are the subroots
    tops = store(subroots.select(F.col("key").alias("source_key"), F.lit("").alias("key"), "h"))
    upper = numbered(tops, ["source_key"])
    roots, upper_levels = tree(upper)
    start = roots.select("key", F.col("h").alias("root"), F.array().cast(_PATH).alias("path"))
    leaf_paths = _joined(with_siblings(upper), upper_levels, start)
    above = store(leaf_paths.select(F.col("source_key").alias("key"), F.col("h").alias("subroot"), "root", "path"))
    # proofs of the rows
    rows = _joined(with_siblings(nodes, "leaf"), levels, above)
    fold = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda h, x: _hash(x.left, h, x.right))
    proof = _hash(F.array_join(F.transform("path", lambda x: F.concat(x.left, x.right)), ""))
    done = store(rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root")))
    discard(scanned, nodes, tops, upper, above, *levels, *upper_levels)
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def _joined(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``nodes`` of level 0, with siblings, and their whole paths: their own siblings, unless they are alone, and those of ``above``."""
    more = [c for c in above.columns if c not in ("key", "path")]
    single = nodes.where("n = 1").join(above, "key")
    if not levels:
        return single
    own = F.concat(F.array(F.struct("left", "right")), F.col("path"))
    inner = nodes.where("n > 1").join(paths(levels, above), ["key", "run"]).withColumn("path", own)
    columns = [c for c in nodes.columns if c != "run"]
    return inner.select(*columns, "path", *more).unionByName(single.select(*columns, "path", *more))
