"""Merkle manifest of a table, with proofs climbed by a recursive query.

``build`` hashes every row to a leaf, orders the leaves of each source, and stores the tree level
by level: 16 consecutive nodes become the next level's node until one, the source's subroot, is
left; subroots become a tree of the same kind. Stored are

* ``runs``: the first level, a row per run of up to 16 leaves with its leaves in order;
* ``nodes``: every node above, with its parent's id and the digests of its siblings left and
  right of it.

``prove`` climbs with a recursive query. Its rows are runs, not leaves: the up to 16 leaves of a
run meet the same siblings above, so they share a row that holds one folded digest per leaf.
In each step the row joins its node, appends that node's siblings to the proof, folds every
digest between them, and goes on with the parent, until no node is left. Digests are kept as 32
bytes and hashed as lowercase hex text.

All orders and numbers come from one range shuffle by (source, id); a group is a run of 16, so a
source with most of the rows is no hot key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import ship, written
from wordmill.llm.components import join_by_weight
from wordmill.operators.rows import dense_index

FANOUT = 16
#: The letters that tampering lower-cases.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*texts) -> Column:
    """sha256 of the concatenated texts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def as_text(digests: Column) -> Column:
    """Digests (one or several side by side) as hex text."""
    return F.lower(F.hex(digests))


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def tampered_text(every: int = 5) -> Column:
    """The text with A-Z lower-cased in rows whose id's crc32 is divisible by ``every``."""
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
    return F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


class Manifest(NamedTuple):
    """``runs``: tree, n, id, kids (idx, doc_id, leaf, now), states (the run's digest with each
    kid as it reads now). ``nodes``: id, parent, before, after (hex text). ``subroots``: tree, n,
    subroot. ``root`` and its ``root_id`` are None for an empty table; ``height`` is the number of
    levels above the runs."""
    runs: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: bytes | None
    root_id: str | None
    height: int


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``doc_id, source, leaf, now``: now is the leaf of the row as it reads with the text
    ``tampered`` in place of its own (the same leaf without one)."""
    docs = docs.select(*[docs[c] for c in FIELDS])
    own = [field(F.col(c)) for c in FIELDS[:-1]]
    text = F.col("text") if tampered is None else tampered
    d = docs.select("doc_id", "source", digest(*own, field(F.col("text"))).alias("leaf"),
                    F.concat(*own).alias("_own"), F.col("text"), text.alias("_text"))
    now = F.when(F.col("_text").eqNullSafe(F.col("text")), F.col("leaf")).otherwise(
        digest("_own", field(F.col("_text"))))
    return d.select("doc_id", "source", "leaf", now.alias("now"))


def _grouped(level: DataFrame, *kid) -> DataFrame:
    """Runs of ``FANOUT`` nodes of a tree: ``tree, idx, n`` of the next level (n nodes in all) and
    ``kids`` in order."""
    kids = F.array_sort(F.collect_list(F.struct("idx", *kid)))
    g = (level.groupBy("tree", F.floor(F.col("idx") / FANOUT).cast("long").alias("up"))
         .agg(kids.alias("kids"), F.first("n").alias("n")))
    return g.select("tree", F.col("up").alias("idx"),
                    F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), "kids")


def _name(kind: str, height: int) -> Column:
    return F.concat_ws(".", F.lit(kind), F.lit(height), "tree", "idx")


def _others(texts, p) -> tuple[Column, Column]:
    """What stands before and after place ``p`` of an array of texts, joined."""
    return (F.array_join(F.slice(texts, F.lit(1), p), ""),
            F.array_join(F.slice(texts, p + 2, F.lit(FANOUT)), ""))


def _tree(level: DataFrame, most: int, kind: str, height: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Levels above ``level`` (tree, idx, n, id, digest; at most ``most`` nodes a tree) until every
    tree has one node: node rows of each level, the last nodes, and the height reached."""
    links, tops = [], []
    while most > 1:
        tops.append(level.where("n = 1"))
        height, most = height + 1, -(-most // FANOUT)
        groups = _grouped(level.where("n > 1"), "id", "digest").withColumn("id", _name(kind, height))
        groups, _ = written(groups.withColumn("texts", F.transform("kids", lambda k: as_text(k["digest"]))),
                            "merkle-groups")
        kid = groups.select(F.col("id").alias("parent"), "texts", F.posexplode("kids").alias("p", "kid"))
        before, after = _others("texts", F.col("p"))
        links.append(kid.select(F.col("kid.id").alias("id"), "parent", before.alias("before"),
                                after.alias("after")))
        level = groups.select("tree", "idx", "n", "id",
                              digest(F.array_join("texts", "")).alias("digest"))
    for t in tops:
        level = level.unionByName(t)
    return links, level, height


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of a table with the columns ``FIELDS``.

    Nulls are ``-`` in the leaf, so null and empty texts differ. A null source is a source of its
    own, before all others; null ids come before all others, and rows that repeat an id are
    ordered by their leaves (equal ones are alike). An empty table has no root. Other columns are
    not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, _ = written(leaves(docs, tampered), "merkle-leaves")
    # a key for every source, null or not, that orders bytewise with null first
    rows = rows.withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    rows = dense_index(rows, [F.col("skey"), F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("now")],
                       name="at")
    sources = rows.groupBy("skey").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    sources, _ = written(dense_index(sources, [F.col("skey")], name="tree"), "merkle-sources")
    total, most, n_sources = sources.agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).head()
    level = join_by_weight(rows, sources, "skey", "n", total or 0)
    runs = _grouped(level.withColumn("idx", F.col("at") - F.col("first")), "doc_id", "leaf", "now")
    runs = runs.withColumn("id", _name("run", 0)).withColumn(
        "texts", F.transform("kids", lambda k: as_text(k["leaf"])))
    # a source of one row is its leaf, not a run of one
    alone = (F.col("n") == 1) & (F.size("kids") == 1)
    runs = runs.withColumn("digest", F.when(alone, F.element_at("kids", 1)["leaf"]).otherwise(
        digest(F.array_join("texts", ""))))

    def now(kid, p):
        before, after = _others("texts", p)
        return (F.when(kid["now"] == kid["leaf"], F.col("digest")).when(alone, kid["now"])
                .otherwise(digest(before, as_text(kid["now"]), after)))

    runs, _ = written(runs.withColumn("states", F.transform("kids", now)).drop("texts"), "merkle-runs")
    level = runs.select("tree", "idx", "n", "id", "digest")
    links, subroots, height = _tree(level, -(-(most or 0) // FANOUT), "node", 0)
    subroots, _ = written(subroots.select("tree", "id", "digest"), "merkle-subroots")
    level = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"),
                            F.lit(n_sources).cast("long").alias("n"), "id", "digest")
    above, root, height = _tree(level, n_sources, "top", height)
    top = root.head()
    nodes = spark.createDataFrame([], "id string, parent string, before string, after string")
    for part in links + above:
        nodes = nodes.unionByName(part)
    nodes, _ = written(nodes, "merkle-nodes")
    subroots = subroots.join(sources.select("tree", F.col("n").alias("rows")), "tree").select(
        "tree", "rows", F.col("digest").alias("subroot"))
    return Manifest(runs, nodes, subroots, bytes(top["digest"]) if top else None,
                    top["id"] if top else None, height)


CLIMB = """
WITH RECURSIVE climb(id, cur, states, proof) MAX RECURSION LEVEL {levels} AS (
    SELECT id, id, states, cast('' AS binary) FROM {runs}
    UNION ALL
    SELECT c.id, n.parent,
           transform(c.states, s -> unhex(sha2(
               cast(concat(n.before, lower(hex(s)), n.after) AS binary), 256))),
           concat(c.proof, unhex(concat(n.before, n.after)))
    FROM climb c JOIN {nodes} n ON c.cur = n.id)
SELECT id, states, proof FROM climb WHERE cur = {root}
"""
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def climb(m: Manifest) -> DataFrame:
    """From every run up to the root: ``id, states, proof``. states are the roots that the run's
    leaves fold to as they read now, proof the siblings above the run, level by level. The
    recursion ends with the tree's height; its row limit, a guard against endless ones, is off
    while the result is written."""
    spark = m.runs.sparkSession
    found = spark.sql(CLIMB, levels=m.height + 2, runs=m.runs.select("id", "states"), nodes=m.nodes,
                      root=m.root_id or "")
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return written(found, "merkle-climb")[0]
    finally:
        spark.conf.set(ROW_LIMIT, before)


def prove(m: Manifest) -> DataFrame:
    """A row per row of the table: ``doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified``; digests as hex text. An empty table gives an empty result."""
    up = climb(m).select("id", F.col("states").alias("folded"), "proof")
    runs = m.runs.select("tree", "id", "kids").join(up, "id")
    total = m.subroots.agg(F.sum("rows")).head()[0] or 0
    runs = join_by_weight(runs, m.subroots, "tree", "rows", total)
    runs = runs.withColumn("texts", F.transform("kids", lambda k: as_text(k["leaf"])))
    kid = runs.select("subroot", "folded", "proof", "texts", F.posexplode("kids").alias("p", "kid"))
    before, after = _others("texts", F.col("p"))
    root = F.lit(m.root.hex() if m.root else None).cast("string")
    folded = as_text(F.get("folded", F.col("p")))
    return kid.select(
        F.col("kid.doc_id").alias("doc_id"), as_text(F.col("kid.leaf")).alias("leaf"),
        as_text(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(F.concat(before, after, as_text(F.col("proof"))).cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == root).alias("verified"))
