"""A Merkle manifest of a table, with nested-interval labels.

Leaves are ranked within their tree, and every node is labelled with the interval of
leaf ranks it covers. An inner node and its children make a family: the node's interval,
and the children's intervals and digests. Leaves get their ancestors' families by joins
on (tree, bucket), a bucket being the ranks of BAND levels of nodes, and a family belongs
to a leaf if its interval contains the leaf's rank. The children that don't are the
leaf's siblings on that level: the parent's interval without the child's own.

Trees of all sources grow together, BAND levels to a shuffle, so each step moves
FAN ** BAND times fewer rows. The path from a band's top to the root is attached to the
band, not to its leaves, so leaves are joined once whatever the height of the tree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.common import let, numbered, stored

FAN = 3   # children of a node
BAND = 3  # levels that one shuffle builds
WIDTH = FAN ** BAND

FAMILIES = "array<struct<lo:bigint,hi:bigint,children:array<struct<lo:bigint,hi:bigint,digest:string>>>>"


def _encoded(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[_encoded(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def joined_digest(digests: Column) -> Column:
    """H of an array of digests, left to right."""
    return F.sha2(F.array_join(digests, ""), 256)


def _within(node: Column, rank: Column) -> Column:
    return (node["lo"] <= rank) & (rank < node["hi"])


def _grown(nodes: Column, go: Column) -> Column:
    """Families of one level over sorted nodes; none if the tree ends below it."""
    places = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FAN).cast("int") - 1)
    families = F.transform(places, lambda i: let(F.slice(nodes, i * FAN + 1, F.lit(FAN)), lambda c: F.struct(
        F.element_at(c, 1)["lo"].alias("lo"), F.element_at(c, -1)["hi"].alias("hi"), c.alias("children"))))
    return F.when(go, families).otherwise(F.array().cast(FAMILIES))


def _tops(families: Column, nodes: Column) -> Column:
    """The nodes that families make, or the nodes as they are where the tree ended."""
    made = F.transform(families, lambda f: F.struct(
        f["lo"].alias("lo"), f["hi"].alias("hi"), joined_digest(F.transform(f["children"], lambda c: c["digest"])).alias("digest")))
    return F.when(F.size(families) > 0, made).otherwise(nodes)


def _band(nodes: DataFrame, level: int, name: str) -> DataFrame:
    """Nodes (tree, n, lo, hi, digest) of a level to bands: tree, n, bucket, lo, hi and
    digest of the band's top node, and the families inside, lower levels first. A band has
    at most WIDTH nodes."""
    size = FAN ** level
    rows = nodes.groupBy("tree", "n", F.floor(F.col("lo") / (size * WIDTH)).alias("bucket")).agg(
        F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("nodes"))
    rows = rows.withColumn("families", F.array().cast(FAMILIES))
    for step in range(BAND):
        rows = rows.withColumn("made", _grown(F.col("nodes"), F.col("n") > size * FAN ** step))
        rows = rows.withColumn("families", F.concat("families", "made")).withColumn("nodes", _tops(F.col("made"), F.col("nodes")))
    top = F.element_at("nodes", 1)
    return stored(rows.select("tree", "n", "bucket", top["lo"].alias("lo"), top["hi"].alias("hi"),
                              top["digest"].alias("digest"), "families"), f"{name}-band-{level}")


def forest(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of leaves (tree, n, rank, digest): the lowest bands (tree, bucket, families: all
    families of the band, and those above its top, up to the root), and the roots (tree, n,
    digest). A tree of one leaf has no family, and its leaf is the root."""
    nodes = leaves.select("tree", "n", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")
    most = leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    bands, level = [], 0
    while True:
        band = _band(nodes, level, name)
        bands.append(band)
        level += BAND
        # Trees that ended are whole in one band; only the others go on.
        nodes = band.filter(F.col("n") > FAN ** level).select("tree", "n", "lo", "hi", "digest")
        if most <= FAN ** level:
            break
    roots = None
    for k, band in enumerate(bands):
        size = FAN ** (BAND * k)
        ended = band.filter((F.col("n") <= size * WIDTH) & ((F.col("n") > size) | F.lit(k == 0))).select("tree", "n", "digest")
        roots = ended if roots is None else roots.unionByName(ended)
    above = bands[-1].select("tree", "bucket", "families")
    for band in reversed(bands[:-1]):
        # A band's top belongs to the bucket of WIDTH tops above it, and takes the families that contain it.
        upper = above.select(F.col("tree").alias("_tree"), F.col("bucket").alias("_bucket"), F.col("families").alias("_upper"))
        joined = band.join(upper, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("bucket") / WIDTH) == F.col("_bucket")), "left")
        path = F.filter(F.coalesce("_upper", F.array().cast(FAMILIES)), lambda f: _within(f, F.col("lo")))
        above = joined.select("tree", "bucket", F.concat("families", path).alias("families"))
    return above, roots


def with_ancestors(leaves: DataFrame, bands: DataFrame, out: str) -> DataFrame:
    """leaves (tree, rank, ...) with `out`: the families that contain each, from its
    parent's up to the root's."""
    upper = bands.select(F.col("tree").alias("_tree"), F.col("bucket").alias("_bucket"), F.col("families").alias("_every"))
    joined = leaves.join(upper, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("rank") / WIDTH) == F.col("_bucket")))
    return joined.withColumn(out, F.filter("_every", lambda f: _within(f, F.col("rank")))).drop("_tree", "_bucket", "_every")


def siblings(families: Column, rank: Column) -> Column:
    """Digests of each level's children that don't contain the rank, level by level."""
    return F.flatten(F.transform(families, lambda f: F.transform(
        F.filter(f["children"], lambda c: ~_within(c, rank)), lambda c: c["digest"])))


def folded(digest: Column, families: Column, rank: Column) -> Column:
    """The root that a leaf's digest and its siblings make."""
    return F.aggregate(families, digest, lambda acc, f: joined_digest(F.transform(
        f["children"], lambda c: F.when(_within(c, rank), acc).otherwise(c["digest"]))))


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, source, rank (of its leaf within the source), leaf,
    subroot, root, proof (digests of the siblings, up to the root), and tampered, folded_root,
    verified: the leaf after the line feeds of its text are deleted, if its number's checksum
    is even, and what the proof says of it.

    Leaves of a source ascend by doc_id (null first), rows of one doc_id by their digest.
    Repeated rows are leaves of their own, with equal digests and different proofs. A null
    text stays null; an empty one is hashed as empty. A row without id isn't tampered with.
    An empty table gives no rows. Columns other than the five hashed ones are not read.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    cut = F.translate(columns[4].cast("string"), "\n", "")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    # Null sources come first: "-" is below "=".
    rows = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("tree"),
                       leaf_digest(*columns).alias("digest"),
                       F.when(chosen & F.contains(columns[4].cast("string"), F.lit("\n")), leaf_digest(*columns[:4], cut)).alias("tampered"))
    leaves = numbered(rows, "merkle-leaves", "tree", ["doc_id", "digest"])
    bands, roots = forest(leaves, "merkle")

    tops = numbered(roots.select("tree", "digest").withColumn("every", F.lit("")), "merkle-sources", "every", ["tree"])
    tops = tops.select(F.col("every").alias("tree"), F.col("tree").alias("_of"), "digest", "rank", "n")
    upper, root = forest(tops, "merkle-root")
    tops = with_ancestors(tops, upper, "_over").join(root.select("tree", F.col("digest").alias("root")), "tree")
    tops = stored(tops.select(F.col("_of").alias("tree"), F.col("digest").alias("subroot"), F.col("rank").alias("_place"),
                              "_over", "root"), "merkle-tops")

    out = with_ancestors(leaves, bands, "_families").join(tops, "tree")
    rank, place = F.col("rank"), F.col("_place")
    proof = F.concat(siblings(F.col("_families"), rank), siblings(F.col("_over"), place))
    end = folded(folded(F.coalesce("tampered", "digest"), F.col("_families"), rank), F.col("_over"), place)
    return out.select("doc_id", "source", "rank", F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof"),
                      F.coalesce("tampered", "digest").alias("tampered"), end.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
