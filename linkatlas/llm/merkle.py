"""WARC records and Merkle fixity audits: hash trees over records and their ordered offset ranges.

A record's leaf hashes its place (offset and length in its file) and its bytes' digest. ``FANOUT``
neighbours make a node, up to one root per file and then one root over all files. Two replicas are
compared from the top: each level joins only the children of nodes that differed one level above, so
an intact replica costs one row, and a corrupt byte a path. Files are ranges of ids that hold
``PER_FILE`` records, so sorting and offsets stay within small groups; a file swollen by repeated ids is
cut into parts. ``written`` fixes each record's file, number and offset when the archive is made, and
replicas carry them along: what corruption changes never moves a record. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

PER_FILE, FANOUT, MOST = 256, 16, 1024
NODE = ["file", "level", "idx", "hash"]


def record_bytes(url: Column, html: Column) -> Column:
    """A WARC/1.0 resource record as text, its content's bytes counted in the header; nulls count as empty."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def written(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """The archive's records with the places they are written to: page_id, url, html, warc_file, warc_seq, warc_offset.

    This is the one layout of an archive and its replicas. Order within a file is (page_id, digest); files
    swollen by repeated ids are cut by a hash of both. Null ids share file "none"; equal rows are all kept, one
    after the other. Url and html may be null or empty; an empty table has no records.
    """
    text = record_bytes(F.col("url"), F.col("html"))
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    # Equal records travel as one row with a count.
    made = made.withColumn("range", F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-(1 << 62))))
    made = made.groupBy("range", "page_id", "digest", "length").agg(F.count("*").alias("copies"), F.first("url").alias("url"), F.first("html").alias("html"))
    made = kept(made, "records")
    swollen = made.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("range", F.ceil(F.col("n") / per_file).alias("parts"))
    made = made.join(kept(swollen, "swollen"), "range", "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("page_id", "digest"), F.col("parts"))).cast("long")
    name = F.when(F.col("page_id").isNull(), "none").otherwise(F.lpad(F.col("range").cast("string"), 12, "0"))
    made = made.withColumn("file", F.concat_ws("-", name, F.lpad(part.cast("string"), 6, "0")))
    w = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("at", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(w), F.lit(0))).withColumn("first", F.coalesce(F.sum("copies").over(w), F.lit(0)))
    each = made.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.select("page_id", "url", "html", F.col("file").alias("warc_file"), (F.col("first") + F.col("copy")).alias("warc_seq"), (F.col("at") + F.col("copy") * F.col("length")).alias("warc_offset"))
    return kept(each, "written")


def leaves(records: DataFrame) -> DataFrame:
    """Records in place: page_id, file, seq, offset, length, digest (of the bytes), hash (of place and digest).

    Places are those of ``written``, which replicas carry along; a table without them is an error, since
    numbers counted anew would move with every lost or added record.
    """
    if missing := {"warc_file", "warc_seq", "warc_offset"} - {*records.columns}:
        raise ValueError(f"records without places: {sorted(missing)}")
    text = record_bytes(F.col("url"), F.col("html"))
    each = records.select("page_id", F.col("warc_file").alias("file"), F.col("warc_seq").alias("seq"), F.col("warc_offset").alias("offset"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    return each.withColumn("hash", F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256))


def _up(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """One level up within each file; a group has at most ``fanout`` members."""
    g = nodes.groupBy("file", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("below"))
    return g.select("file", F.lit(level).alias("level"), "idx", F.sha2(F.concat_ws("|", F.transform("below", lambda x: x["hash"])), 256).alias("hash"))


def tree(placed: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels, leaves first; the last has one row per file, idx 0. An empty table has an empty tree."""
    levels = [kept(placed.select("file", F.lit(0).alias("level"), F.col("seq").alias("idx"), "hash"), "tree")]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        levels.append(kept(_up(levels[-1], len(levels), fanout), "tree"))
    return levels


def roots_tree(levels: list[DataFrame], fanout: int = FANOUT) -> list[DataFrame]:
    """The levels above the files: nodes are keyed by ever shorter prefixes of a hash of the file's name, up to one root."""
    at = F.substring(F.sha2("file", 256), 1, 8)
    out = [levels[-1].select(at.alias("name"), F.lit(8).alias("level"), "file", "hash")]
    top = out[0].groupBy("name").agg(F.array_sort(F.collect_list(F.struct("file", "hash"))).alias("below"))
    top = top.select("name", F.sha2(F.concat_ws("|", F.transform("below", lambda x: F.concat_ws("=", x["file"], x["hash"]))), 256).alias("hash"))
    uppers = [kept(top, "tree")]
    for width in range(6, -1, -2):
        g = uppers[-1].groupBy(F.substring("name", 1, width).alias("name")).agg(F.array_sort(F.collect_list(F.struct("name", "hash"))).alias("below"))
        uppers.append(kept(g.select("name", F.sha2(F.concat_ws("|", F.transform("below", lambda x: F.concat_ws("=", x["name"], x["hash"]))), 256).alias("hash")), "tree"))
    return uppers


def _differ(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    both = a.select(*on, F.col("hash").alias("ha")).join(b.select(*on, F.col("hash").alias("hb")), on, "full")
    return both.where(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The records (file, seq) whose leaves differ between two replicas' ``leaves``, with both hashes (null: absent)."""
    la, lb = tree(a, fanout), tree(b, fanout)
    ua, ub = roots_tree(la, fanout), roots_tree(lb, fanout)
    bad = _differ(ua[-1], ub[-1], ["name"]).select("name")
    for x, y in zip(ua[-2::-1], ub[-2::-1], strict=True):
        up = F.expr("substring(name, 1, length(name) - 2)")
        below = lambda t: t.withColumn("up", up).join(bad.withColumnRenamed("name", "up"), "up", "left_semi").select("name", "hash")  # noqa: B023, E731
        bad = kept(_differ(below(x), below(y), ["name"]).select("name"), "differ")
    named = lambda t: t.withColumn("name", F.substring(F.sha2("file", 256), 1, 8)).join(bad, "name", "left_semi").select("file")
    files = named(la[-1].select("file")).union(named(lb[-1].select("file"))).distinct()
    out = files.select("file", F.lit(0).cast("long").alias("idx"))
    for depth in range(max(len(la), len(lb)) - 1, -1, -1):
        x, y = (t[depth] if depth < len(t) else None for t in (la, lb))
        x, y = x if x is not None else y.limit(0), y if y is not None else x.limit(0)
        if depth == max(len(la), len(lb)) - 1:
            inside = lambda t: t.join(out, ["file", "idx"], "left_semi")  # noqa: B023, E731
        else:
            inside = lambda t: t.withColumn("up", F.floor(F.col("idx") / fanout)).join(out.withColumnRenamed("idx", "up"), ["file", "up"], "left_semi")  # noqa: B023, E731
        out = kept(_differ(inside(x), inside(y), ["file", "idx"]), "differ")
        if depth:
            out = out.select("file", "idx")
    return out.select("file", F.col("idx").alias("seq"), F.col("ha").alias("hash"), F.col("hb").alias("replica_hash"))


def audit_report(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of an archive in its place, ok false where the replica's differs or is lost, and what only the replica has.

    Both have the columns of ``written``. A record that only the replica has comes with its own place and ok
    false. Null urls and texts count as empty, null ids are one file's; a place that stands twice in a replica is
    compared with each of them; long records travel as digests; of two empty tables nothing is reported; other columns
    are ignored.
    """
    a, b = kept(leaves(records), "leaves"), kept(leaves(replica), "leaves")
    bad = kept(audit(a, b).select("file", "seq").distinct(), "bad")
    place = ["file", "seq"]
    cols = ["page_id", *place, "offset", "length", "digest"]
    own = a.join(bad.withColumn("bad", F.lit(True)), place, "left").select(*cols, F.col("bad").isNull().alias("ok"))
    added = b.join(bad, place, "left_semi").join(a.select(place), place, "left_anti").select(*cols, F.lit(False).alias("ok"))
    return own.unionByName(added)


def op10_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """Audits a replica in which one byte of each page with page_id % 97 = 5 has been flipped."""
    pages = written(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    flipped = F.concat(F.lit("~"), F.expr("substring(html, 2)"))
    replica = pages.withColumn("html", F.when(F.col("page_id") % 97 == 5, flipped).otherwise(F.col("html")))
    return audit_report(pages, replica)


OP10_SQL = r"""
with r as (
  select page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''),
    chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10),
    coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) as t, html
  from pages),
d as (
  select page_id, concat(lpad(cast(page_id // 256 as varchar), 12, '0'), '-000000') as file, strlen(t) as length, sha256(t) as digest,
    not (page_id % 97 = 5 and html is not null and html not like '~%') as ok
  from r)
select page_id, file, row_number() over w - 1 as seq, cast(sum(length) over w - length as bigint) as "offset", length, digest, ok
from d window w as (partition by file order by page_id, digest)
"""
