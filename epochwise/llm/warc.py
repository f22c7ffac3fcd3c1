"""WARC archives of pages, and a fixity audit of two replicas by Merkle trees over offset ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwise.session import materialize

FANOUT = 16
END = "\r\n\r\n"  # closes every record


def record(uri: Column, identity: Column, body: Column) -> Column:
    """A WARC/1.0 resource record as text, without the closing blank lines; a null body is empty."""
    body = F.coalesce(body, F.lit(""))
    digest = F.sha1(body.cast("binary"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(identity.cast("string"), F.lit("none")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")), F.lit("\r\nWARC-Block-Digest: sha1:"), digest, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit(END),
    )
    return F.concat(head, body)


def lay_out(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", records_per_archive: int = 512) -> DataFrame:
    """Pages as records of archives: ``archive, offset, length, copies, id, digest`` and the record's bytes ``content``.

    Archives are dealt by the record's digest, so their number follows the table and none grows with one key;
    inside an archive records follow each other by id, then digest, and ``offset`` is where a record starts.
    Pages that are equal in all three columns are one record with ``copies`` over 1. Null ids come first; null
    urls and bodies are empty. Other columns of ``pages`` are not stored.
    """
    made = pages.select(F.col(id_col).cast("long").alias("id"), record(F.col(url_col), F.col(id_col), F.col(body_col)).alias("content"))
    rows = made.select("id", F.sha2("content", 256).alias("digest"), (F.octet_length("content") + len(END)).cast("long").alias("length"))
    unique = materialize(rows.groupBy("id", "digest", "length").agg(F.count(F.lit(1)).alias("copies")), "records")
    archives = max(1, -(-unique.count() // records_per_archive))
    placed = unique.withColumn("archive", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % archives)
    before = Window.partitionBy("archive").orderBy(F.col("id").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)))


def contents(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``id, digest, content``: the bytes of every page's record and the digest that names it in the layout."""
    made = pages.select(F.col(id_col).cast("long").alias("id"), record(F.col(url_col), F.col(id_col), F.col(body_col)).alias("content"))
    return made.withColumn("digest", F.sha2("content", 256))


def write_archives(layout: DataFrame, records: DataFrame, folder: str) -> None:
    """Write the records as WARC files, a folder for each archive, in the order of their offsets."""
    joined = records.join(layout.select("id", "digest", "archive", "offset"), on=[records["id"].eqNullSafe(layout["id"]), records["digest"] == layout["digest"]])
    rows = joined.select("archive", "offset", F.col("content").alias("value")).repartition("archive").sortWithinPartitions("archive", "offset")
    rows.select("archive", "value").write.partitionBy("archive").option("lineSep", END).text(folder)


def leaves(replica: DataFrame) -> DataFrame:
    """Leaf hashes ``archive, offset, length, hash`` of a replica's ``archive, offset, length, content_hash``.

    A leaf covers what stands at an offset: its place, its length and the hash of its bytes.
    """
    return replica.select("archive", "offset", "length", F.sha2(F.concat_ws(":", "offset", "length", "content_hash"), 256).alias("hash"))


def tree(rows: DataFrame, leaf_range: int = 1 << 16, height: int = 4) -> list[DataFrame]:
    """Merkle tree over offsets: level 0 the leaves, level ``k`` the ranges of ``leaf_range * FANOUT ** (k - 1)`` bytes.

    A node is named by archive and number of its range; its hash is that of its children's hashes in order.
    The last level has one node for each archive, its root. A node has at most ``FANOUT`` children, or
    what starts in ``leaf_range`` bytes. Each level is made of the one below.
    """
    levels = [rows]
    below = rows.select("archive", "hash", F.col("offset").alias("at"), F.floor(F.col("offset") / leaf_range).cast("long").alias("node"))
    for level in range(1, height + 1):
        top = level == height
        key = F.lit(0).cast("long") if top else F.col("node")
        ordered = F.sort_array(F.collect_list(F.struct("at", "hash")))
        nodes = below.groupBy("archive", key.alias("node")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["hash"]), ""), 256).alias("hash"))
        levels.append(nodes)
        below = nodes.select("archive", "hash", F.col("node").alias("at"), F.floor(F.col("node") / FANOUT).cast("long").alias("node"))
    return levels


def audit(left: DataFrame, right: DataFrame, leaf_range: int = 1 << 16, height: int = 4) -> DataFrame:
    """Where two replicas differ: ``archive, offset, status, left_length, right_length``.

    ``left`` and ``right`` have ``archive, offset, length, content_hash``, one row per record. ``status`` is ``changed`` (other
    bytes or another length at the same offset), ``missing`` (only left) or ``extra`` (only right). Roots are compared first, an absent
    archive differing from any; below, only children of differing nodes are read. Several records at one offset
    are compared as one. Levels are stored in the shared folder once and read from there. Equal replicas
    give no row. Null archives, offsets or hashes are compared as values.
    """
    fold = F.struct(F.sort_array(F.collect_list(F.struct("length", "content_hash"))).alias("x"))
    sides = []
    for name, rows in (("left", left), ("right", right)):
        plain = rows.select(F.coalesce(F.col("archive").cast("long"), F.lit(-1)).alias("archive"), F.coalesce(F.col("offset"), F.lit(-1)).alias("offset"), "length", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
        merged = plain.groupBy("archive", "offset").agg(F.sum("length").alias("length"), F.sha2(F.to_json(fold), 256).alias("content_hash"))
        levels, stored = [], None
        for k, level in enumerate(tree(materialize(leaves(merged), f"{name}-leaves"), leaf_range, height)):
            stored = level if k == 0 else materialize(level, f"{name}-level-{k}")
            levels.append(stored)
        sides.append(levels)

    def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        both = a.withColumnRenamed("hash", "ha").join(b.withColumnRenamed("hash", "hb"), keys, "full_outer")
        return both.filter(~F.col("ha").eqNullSafe(F.col("hb")))

    suspects = differing(sides[0][height], sides[1][height], ["archive", "node"]).select("archive", "node")
    for level in range(height - 1, 0, -1):
        wide = F.lit(0).cast("long") if level + 1 == height else F.floor(F.col("node") / FANOUT).cast("long")
        parts = [s[level].withColumn("parent", wide).join(suspects.withColumnRenamed("node", "parent"), ["archive", "parent"], "left_semi").drop("parent") for s in sides]
        suspects = differing(*parts, ["archive", "node"]).select("archive", "node")
    place = F.floor(F.col("offset") / leaf_range).cast("long")
    parts = [s[0].withColumn("node", place).join(suspects, ["archive", "node"], "left_semi").withColumnRenamed("length", f"{n}_length").drop("node") for n, s in zip(("left", "right"), sides)]
    found = differing(*parts, ["archive", "offset"])
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("changed")
    return found.select("archive", "offset", status.alias("status"), "left_length", "right_length")
