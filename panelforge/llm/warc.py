"""WARC records and a Merkle fixity audit of their replicas.

Two archives are laid out each by itself: records in the order of their ids, in
files that are ranges of the id, every record with its offset and length.  A leaf is
the SHA-256 of a record's bytes.  Above the leaves, contiguous runs of records form
nodes; a run begins where a hash of the record's own name says so (one in FANOUT
names for the lowest level, one in FANOUT^2 for the next), not at every so-many-th
record.  A node's hash covers the hashes and lengths of its ordered children, that is
the offset ranges relative to its own begin.  So a lost, extra or longer record
changes the nodes above it and no others, although all offsets after it move.

The audit compares roots, then files, then only children of nodes that differ, so its
cost follows the damage, not the archive.  Hashing is a map; only (id, length, hash)
rows are shuffled, once, never record bytes; all levels of a file's tree are
aggregations inside its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm import ordered
from panelforge.llm.shared import cut

FANOUT = 64
#: Levels between records and files.
LEVELS = 3
_CRLF = "\r\n"


def record(url, body, record_id):
    """Column of a WARC/1.1 resource record: header, block, closing lines."""
    block = body.cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: resource{_CRLF}WARC-Record-ID: <urn:record:"), record_id, F.lit(f">{_CRLF}WARC-Target-URI: "), url,
        F.lit(f"{_CRLF}WARC-Block-Digest: sha256:"), F.sha2(block, 256), F.lit(f"{_CRLF}Content-Type: text/html{_CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(_CRLF * 2),
    )
    return F.concat(head.cast("binary"), block, F.lit(_CRLF * 2).cast("binary"))


def read_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record; raises ValueError on a malformed one."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at offset {at}")
        fields = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8").split(_CRLF)[1:])
        n = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the record at offset {at} is cut short")
        yield at, fields, block
        at = end + 8 + n


def hashed(records: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """``page_id, length, hash`` of each row's record; null bodies and urls are written as empty ones."""
    page, url, body = F.col(id_col).cast("long"), F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    own = record(url, body, F.coalesce(page.cast("string"), F.lit("")))
    return records.select(page.alias("page_id"), F.octet_length(own).cast("long").alias("length"), F.sha2(own, 256).alias("hash"))


def layout(records: DataFrame, bounds: list[int], fanout: int = FANOUT) -> DataFrame:
    """Records with their place: ``page_id, length, hash, file, number, offset`` (in the file), ``name`` and the nodes ``k1`` to ``k3`` they lie in.

    Order: rising id, null first, then hash.  A record's name is its id and which one
    of that id it is.  Files are ranges of the id, so one task orders one file.
    """
    d = records.withColumn("file", (F.lit(len(bounds)) - ordered.falling_range(F.col("page_id"), bounds)).cast("int"))
    w = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "hash")
    same = Window.partitionBy("file", "page_id").orderBy("hash")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("name", F.concat_ws("#", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.row_number().over(same).cast("string")))
    chance = F.pmod(F.xxhash64("name"), F.lit(fanout**LEVELS))
    d = d.withColumn("number", F.row_number().over(w).cast("long") - 1).withColumn("offset", F.sum("length").over(so_far) - F.col("length"))
    for k in range(1, LEVELS + 1):  # records before a file's first mark have the node ""
        d = d.withColumn(f"k{k}", F.coalesce(F.last(F.when(chance % fanout**k == 0, F.col("name")), True).over(so_far), F.lit("")))
    return d


def tree(placed: DataFrame) -> DataFrame:
    """Nodes of all levels: ``level, file, key, parent, first, size, hash``; files are level LEVELS + 1."""
    level = placed.select("file", *(f"k{k}" for k in range(1, LEVELS + 1)), F.col("number").alias("first"), F.col("length").alias("size"), "hash")
    out = None
    for k in range(1, LEVELS + 2):
        above = [f"k{j}" for j in range(k, LEVELS + 1)]
        children = level.groupBy("file", *above).agg(F.min("first").alias("first"), F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct(F.col("first").alias("f"), F.col("size").alias("s"), F.col("hash").alias("h")))).alias("c"))
        joined = F.concat_ws("|", F.transform("c", lambda x: F.concat_ws(":", x["s"].cast("string"), x["h"])))
        level = children.select("file", *above, "first", "size", F.sha2(joined, 256).alias("hash"))
        key, parent = (F.col(c[0]) if c else F.lit("") for c in (above, above[1:]))
        nodes = level.select(F.lit(k).alias("level"), "file", key.alias("key"), parent.alias("parent"), "first", "size", "hash")
        out = nodes if out is None else out.unionByName(nodes)
    return out


def root(nodes: DataFrame) -> str | None:
    """The root's hash over the ordered files (as many rows as files); null for an empty archive."""
    files = nodes.where(F.col("level") == LEVELS + 1).agg(F.array_sort(F.collect_list(F.struct("file", "size", "hash"))).alias("c"))
    return files.select(F.when(F.size("c") > 0, F.sha2(F.concat_ws("|", F.transform("c", lambda x: F.concat_ws(":", x["size"].cast("string"), x["hash"]))), 256)).alias("h")).first()["h"]


def differing(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``file, key`` of the lowest nodes that differ, from two node tables; no rows where the roots are equal.

    Trees may be of any shapes: a node that only one side has differs, and so do the
    nodes that hold its children on the other side.
    """
    torn = None
    if root(primary) == root(replica):
        return primary.where("false").select("file", "key")
    for level in range(LEVELS + 1, 0, -1):
        a, b = (d.where(F.col("level") == level) for d in (primary, replica))
        if torn is not None:
            above = torn.withColumnRenamed("key", "parent")
            a, b = (d.join(above, ["file", "parent"], "left_semi") for d in (a, b))
        x, y = (d.select("file", "key", F.struct("size", "hash").alias(c)) for d, c in ((a, "expected"), (b, "found")))
        torn = cut(x.join(y, ["file", "key"], "full").where(~F.col("expected").eqNullSafe(F.col("found"))).select("file", "key"))
    return torn


def audit(primary: DataFrame, replica: DataFrame, torn: DataFrame) -> DataFrame:
    """``page_id, file, offset, length, replica_offset, expected_sha256, found_sha256`` of the records in ``torn`` nodes that are not on both sides.

    Records with the same id and hash cancel out, copies one for one; what is left of
    an id is paired in order.  A lost record has no found hash, an extra one no expected hash.
    """
    at = torn.withColumnRenamed("key", "k1")
    order = Window.partitionBy("file", "id", "hash").orderBy("number")
    a, b = (d.join(at, ["file", "k1"], "left_semi").select("file", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("id"), "page_id", "hash", "number", "offset", "length") for d in (primary, replica))
    a, b = (d.withColumn("copy", F.row_number().over(order)) for d in (a, b))
    same, each = ["file", "id", "hash", "copy"], Window.partitionBy("file", "id").orderBy("number")
    left, right = (x.join(y.select(*same), same, "left_anti").withColumn("nth", F.row_number().over(each)) for x, y in ((a, b), (b, a)))
    left = left.select("file", "id", "nth", F.col("page_id").alias("page"), "offset", "length", F.col("hash").alias("expected_sha256"))
    right = right.select("file", "id", "nth", F.col("page_id").alias("other"), F.col("offset").alias("replica_offset"), F.col("hash").alias("found_sha256"))
    return left.join(right, ["file", "id", "nth"], "full").select(F.coalesce("page", "other").alias("page_id"), "file", "offset", "length", "replica_offset", "expected_sha256", "found_sha256")


def _bases(placed: DataFrame, name: str) -> DataFrame:
    """Where each file begins in the archive: as many rows as files."""
    files = placed.groupBy("file").agg(F.sum("length").alias("size"))
    return files.select("file", (F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias(name))


def fixity(primary: DataFrame, replica: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", fanout: int = FANOUT) -> DataFrame:
    """Audit a replica of an archive: one row for each record that the two do not share.

    Both are tables of records with any rows.  Returns ``page_id, archive_offset,
    length, replica_offset, expected_sha256, found_sha256``: a damaged record has both
    hashes, a lost one no found hash and replica offset, an extra one no expected hash,
    length and archive offset.  A record that only moved is intact.

    Null bodies and urls are written as empty ones; null ids come first.  Repeated
    rows are records of their own and share a file, which one task orders.  Empty
    tables: no records, all of the other side are lost or extra.  Other columns are not read.
    """
    rows = [hashed(d, id_col=id_col, url_col=url_col, body_col=body_col) for d in (primary, replica)]
    # the ids of both sides, so that no file holds much more than its share of either
    bounds = ordered.bounds_of(rows[0].select("page_id").unionByName(rows[1].select("page_id")), "page_id")
    placed = [cut(layout(r, bounds, fanout)) for r in rows]
    nodes = [cut(tree(p)) for p in placed]
    found = audit(*placed, differing(*nodes))
    for p, c in zip(placed, ("base", "replica_base")):
        found = found.join(F.broadcast(_bases(p, c)), "file", "left")
    return found.select("page_id", (F.col("base") + F.col("offset")).alias("archive_offset"), "length", (F.col("replica_base") + F.col("replica_offset")).alias("replica_offset"), "expected_sha256", "found_sha256")
