"""Merkle manifest of a dataset by supersteps over RDDs (operator 11).

Rows are leaves, in order of id within their language; ``fanout`` neighbours make a node, up to
a language's subroot, and subroots, in order of language, make up the root.  As in Pregel, a
vertex acts once it has its messages:

* upward: children send their digests to their parent.  A parent that has all its children, which
  the size of its tree tells, hashes them and sends its own digest on; a lone node is
  its tree's root and stops.
* downward: a root sends its path to its children, and each vertex hands on the path it got with
  the siblings of the child, until every leaf has all that its verification needs.

Each superstep is one shuffle, by tree and place; a vertex gets ``fanout`` messages at most.  Its
vertices are written to the shared folder, so a lost executor costs no earlier superstep.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .linededup import LOWER, UPPER
from .shared import Scratch

FANOUT = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: vertices of a partition at the upper levels, and rows of a broadcast
VERTICES, BROADCAST_ROWS = 2_000, 100_000
ROOT = ""  # the tree of the subroots; those of languages have names that begin with a sign

_VERTEX = "tree string, place long, size long, kids array<string>"
_FOUND = "tree string, level int, digest string"
_PATH = "tree string, place long, path array<string>, subroot string"


def digest(parts: Iterable[str]) -> str:
    """Hash of digests, as their hex text one after the other."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field_text(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*(field_text(c) for c in columns)), 256)


def tree_name(lang: Column) -> Column:
    """Names sort as null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit("-"))


def _spot(key: tuple[str, int]) -> int:
    """Partition of a vertex: the same in every process."""
    return zlib.crc32(f"{key[1]}/{key[0]}".encode())


def ranked(scratch: Scratch, leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``place`` in and ``size`` of their tree.

    Rows are sorted by range, so a tree may lie in several partitions; only the counts of each partition and tree are summed up over them.
    """
    n = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", "id", "leaf", "altered", "row"]
    dealt = leaves.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.write(dealt.withColumn("part", F.shiftright("at", 33)), "sorted")
    counts = dealt.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tree = W.partitionBy("tree")
    ahead = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.write(counts.select("part", "tree", (ahead - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size")), "starts")
    if starts.count() <= BROADCAST_ROWS:  # partitions and trees
        starts = F.broadcast(starts)
    return dealt.join(starts, ["part", "tree"]).select("tree", (F.col("at") + F.col("shift")).alias("place"), "size", "id", "leaf", "altered")


def _partitions(spark: SparkSession, vertices: int) -> int:
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), vertices // VERTICES + 1))


def climb(scratch: Scratch, nodes: RDD, most: int, total: int, fanout: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """Upward supersteps over (tree, place, size, digest): each level's vertices and partitions, and (tree, level, digest) of all roots.

    ``most`` is the size of the largest tree, ``total`` that of all.
    """
    spark, levels, roots, level = scratch.spark, [], [], 0

    def send(node: tuple) -> Iterator[tuple]:
        tree, place, size, own = node
        if size > 1:  # place among the children, size of the parents' level, number of children, digest
            yield (tree, place // fanout), (place % fanout, -(-size // fanout), min(fanout, size - place // fanout * fanout), own)

    def complete(vertex: tuple) -> tuple:
        (tree, place), got = vertex[0], sorted(vertex[1])
        if len(got) != got[0][2]:
            raise RuntimeError(f"node {place} of {tree!r} has {len(got)} of {got[0][2]} children")
        return tree, place, got[0][1], [m[3] for m in got]

    while True:
        roots.append(nodes.filter(lambda n: n[2] == 1).map(lambda n, at=level: (n[0], at, n[3])))
        if most == 1:
            break
        most, total, level = -(-most // fanout), -(-total // fanout), level + 1
        parts = _partitions(spark, total)
        own = scratch.write(spark.createDataFrame(nodes.flatMap(send).groupByKey(parts, _spot).map(complete), _VERTEX), f"level{level}")
        levels.append((own, parts))
        nodes = own.rdd.map(lambda v: (v["tree"], v["place"], v["size"], digest(v["kids"])))
    return levels, scratch.write(spark.createDataFrame(spark.sparkContext.union(roots), _FOUND), "roots")


def _meet(left: RDD, right: RDD, parts: int) -> RDD:
    """(key, messages of both kinds) at their vertices."""
    return left.mapValues(lambda v: (0, v)).union(right.mapValues(lambda v: (1, v))).groupByKey(parts, _spot).mapValues(lambda got: ([v for k, v in got if not k], [v for k, v in got if k]))


def _told(paths: DataFrame) -> RDD:
    return paths.rdd.map(lambda r: ((r["tree"], r["place"]), (r["path"], r["subroot"])))


def descend(scratch: Scratch, levels: list[tuple[DataFrame, int]], roots: DataFrame, fanout: int, last: int) -> DataFrame:
    """Downward supersteps: (tree, place, path, subroot) of the nodes at level ``last``.

    ``roots``: tree, level, path, subroot.  A path holds one text a level, from the node's parent up: the
    siblings to the left, a slash, those to the right.
    """

    def hand_on(vertex: tuple) -> Iterator[tuple]:
        (tree, place), ((kids,), ((path, subroot),)) = vertex
        for i in range(len(kids)):
            yield tree, place * fanout + i, [_siblings(kids, i), *path], subroot

    begin = lambda level: roots.filter(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("place"), "path", "subroot")
    paths = begin(len(levels))
    for level in range(len(levels), last, -1):
        vertices, parts = levels[level - 1]
        below = _meet(vertices.rdd.map(lambda v: ((v["tree"], v["place"]), v["kids"])), _told(paths), parts).flatMap(hand_on)
        paths = scratch.write(scratch.spark.createDataFrame(below, _PATH), f"paths{level}").unionByName(begin(level - 1))
    return paths


def _siblings(kids: list[str], i: int) -> str:
    return "".join(kids[:i]) + "/" + "".join(kids[i + 1 :])


def prove(
    docs: DataFrame,
    leaf: Column,
    found: Column,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    fanout: int = FANOUT,
    with_proof: bool = False,
) -> DataFrame:
    """Per row: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` (and ``proof``).

    ``leaf`` is a row's digest, ``found`` the digest of what it is checked against (null: unchanged); ``folded_root``
    is what ``found`` and the siblings on the way up give.  ``proof`` lists these
    siblings from the leaf up, one text for each level.  ``docs`` are trees by language, null being one of its own.

    Within a language null ids come first; rows with equal ids go in order of their digests, and equal rows are leaves of their own.
    An empty table gives no rows; columns that no argument names are ignored.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    rows = docs.select(tree_name(F.col(lang_col)).alias("tree"), F.col(id_col).alias("id"), leaf.alias("leaf"), found.alias("altered"))
    with Scratch(spark, "manifest") as scratch:
        leaves = scratch.write(ranked(scratch, scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")), "ranked")
        most, total = leaves.agg(F.coalesce(F.max("size"), F.lit(1)), F.count(F.lit(1))).first()
        levels, subroots = climb(scratch, leaves.select("tree", "place", "size", "leaf").rdd.map(tuple), most, total, fanout)

        in_order = subroots.rdd.map(lambda r: (r["tree"], r["level"], r["digest"])).sortBy(lambda r: r[0]).zipWithIndex().map(lambda r: (*r[0], r[1]))
        placed = scratch.write(spark.createDataFrame(in_order, f"{_FOUND}, place long"), "subroots")
        trees = placed.count()
        upper, roots = climb(scratch, placed.rdd.map(lambda r: (ROOT, r["place"], trees, r["digest"])), max(1, trees), trees, fanout)
        top = roots.select("tree", "level", F.array().cast("array<string>").alias("path"), F.col("digest").alias("subroot"))
        above = descend(scratch, upper, top, fanout, 0).select("place", "path")
        starts = scratch.write(placed.join(above, "place").select("tree", "level", "path", F.col("digest").alias("subroot")), "starts")
        root = (roots.select("digest").first() or [None])[0]  # one row

        # leaves meet the path of their parent; a lone leaf has no parent
        paths = descend(scratch, levels, starts, fanout, min(1, len(levels)))
        if levels:
            lone = starts.filter("level = 0").select("tree", F.lit(-1).cast("long").alias("place"), "path", "subroot")
            paths = paths.unionByName(lone)
        else:
            paths = paths.withColumn("place", F.lit(-1).cast("long"))
        sent = leaves.rdd.map(lambda r: ((r["tree"], r["place"] // fanout if r["size"] > 1 else -1), (r["place"], r["leaf"], r["id"], r["altered"])))

        def verify(vertex: tuple) -> Iterator[tuple]:
            (_, place), (own, ((path, subroot),)) = vertex
            own = sorted(own, key=lambda r: r[0])
            kids = [r[1] for r in own]
            for i, (_, mine, key, altered) in enumerate(own):
                way = ([_siblings(kids, i)] if place >= 0 else []) + path
                folded = altered or mine
                for step in way:
                    left, right = step.split("/")
                    folded = digest((left, folded, right))
                proof = [step.replace("/", "") for step in way]
                yield (key, mine, subroot, root, digest(proof), folded, folded == root, *([proof] if with_proof else []))

        text = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        schema = T.StructType([T.StructField(id_col, kind), *text, T.StructField("verified", T.BooleanType()), *([T.StructField("proof", T.ArrayType(T.StringType()))] if with_proof else [])])
        checked = _meet(sent, _told(paths), _partitions(spark, total)).flatMap(verify)
        return scratch.write(spark.createDataFrame(checked, schema), "result", keep=True)


def manifest(docs: DataFrame, with_proof: bool = False) -> DataFrame:
    """``prove`` for the columns of ``documents``, checked against texts of which every third lost its capitals A-Z.

    Which third is told by the CRC-32 of the id; rows with a null id or text stay as they are.
    """
    columns = {c: F.col(c) for c in COLUMNS}
    lowered = columns | {"text": F.translate(F.col("text").cast("string"), UPPER, LOWER)}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return prove(docs, leaf_digest(*columns.values()), F.when(tampered, leaf_digest(*lowered.values())), with_proof=with_proof)
