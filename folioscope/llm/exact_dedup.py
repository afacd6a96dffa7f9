"""Operator 4: exact dedup against immutable snapshots screened by static binary-fuse filters.

A ``Snapshot`` is an immutable set of documents: a written table of its groups of equal texts by SHA-256 digest, and a
binary-fuse filter for each bucket of digests. ``dedup`` takes an incoming batch: equal texts within the batch are
grouped by digest on their own; the batch's distinct digests are screened bucket by bucket by the filters; only
positives join the snapshot's groups, exactly by digest, which removes the filters' rare false alarms. Rows of groups
with several members are then compared byte for byte with the row that stays.

Nothing gathers at one place: groups are counted with partial sums, filters hold bounded buckets of distinct digests,
and the rows of a large group meet copies of the row that stays under as many salts as the group needs.

Defined results: null counts as the empty text, and empty texts are equal; of equal texts the row with the largest
doc_id stays (null only if all are null); rows that share doc_id and text are one document and share its fate; an
empty table gives no rows; extra columns are ignored. Two texts that share a SHA-256 digest but differ would raise an
error rather than be merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fuse_filter
from .common import absent, plain, small_side, written

#: Distinct digests that one bucket's filter holds, about.
BUCKET = 50_000
#: Rows of a group that meet one copy of the row that stays.
SALT_ROWS = 64


def _digest():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _bucket(n: int, first: int = 9):
    """A number below ``n`` from four bytes of the digest; filters see its first eight bytes only."""
    return F.pmod(F.conv(F.hex(F.substring("digest", first, 4)), 16, 10).cast("long"), F.lit(n)).cast("int")


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row; texts stay where they are."""
    return docs.select(F.col("doc_id").cast("long"), _digest().alias("digest"))


def groups(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, n) of digest rows."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))


@dataclass
class Snapshot:
    """Groups of an immutable set of documents, with a filter for each of ``buckets`` buckets of their digests."""

    groups: DataFrame
    filters: DataFrame
    buckets: int

    @classmethod
    def build(cls, own: DataFrame) -> Snapshot:
        """From (digest, keep_id, n), a written table."""
        n = max(1, -(-own.count() // BUCKET))

        def make(keys, batch):
            import pyarrow as pa

            data = fuse_filter.build(_heads(batch.column("digest").to_pylist()))
            return pa.table({"bucket": pa.array([keys[0].as_py()], pa.int32()), "filter": pa.array([data], pa.binary())})

        made = own.select("digest", _bucket(n).alias("bucket")).groupBy("bucket").applyInArrow(make, "bucket int, filter binary")
        return cls(own, written(made, "filters"), n)

    def screen(self, own: DataFrame) -> DataFrame:
        """The rows of ``own`` (digest, keep_id, n; distinct digests) whose digest the filters let through.

        A batch far larger than the snapshot meets copies of each filter, so that no task gets much over ``BUCKET``
        digests.
        """
        parts = max(1, -(-own.count() // (self.buckets * BUCKET)))

        def probe(left, right):
            import pyarrow as pa

            if not right.num_rows or not left.num_rows:
                return left.slice(0, 0).select(["digest", "keep_id", "n"])
            hit = fuse_filter.probe(right.column("filter")[0].as_py(), _heads(left.column("digest").to_pylist()))
            return left.filter(pa.array(hit)).select(["digest", "keep_id", "n"])

        dealt = own.withColumns({"bucket": _bucket(self.buckets), "part": _bucket(parts, 13)})
        filters = self.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = dealt.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part"))
        return pairs.applyInArrow(probe, "digest binary, keep_id long, n long")


def _heads(digests: list[bytes]) -> np.ndarray:
    """The first 8 bytes of each digest as a number."""
    return np.frombuffer(b"".join([d[:8] for d in digests]), dtype="<u8")


def merge(snapshot: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together, where the batch has a share: (digest, keep_id, n, known).

    ``batch``: (digest, keep_id, n), the batch's own groups, a written table. ``known`` marks digests of the snapshot.
    """
    hits = snapshot.screen(batch).select("digest")
    old = snapshot.groups.join(small_side(written(hits, "positives")), "digest")
    old = written(old.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n")), "matched")
    both = batch.join(small_side(old), "digest", "left")
    return both.select("digest", F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("n") + F.coalesce("old_n", F.lit(0))).alias("n"), F.col("old_n").isNotNull().alias("known"))


def verified(docs: DataFrame, several: DataFrame) -> DataFrame:
    """``several`` (digest, keep_id, n) after each member's text was compared with that of the row that stays."""
    several = several.withColumn("salts", F.ceil(F.col("n") / SALT_ROWS).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), _digest().alias("digest"))
    members = written(texts.join(small_side(several), "digest").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "salts").cast("int")), "members")
    stays = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "salts").agg(F.min("text").alias("kept_text"))
    stays = stays.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    same = members.join(stays, ["digest", "salt"]).withColumn("same", F.col("text") == F.col("kept_text"))
    counted = same.groupBy("digest", "salt", "keep_id").agg(F.count_if("same").alias("m"), F.count_if(~F.col("same")).alias("odd"))
    summed = counted.groupBy("digest", "keep_id").agg(F.sum("m").alias("n"), F.sum("odd").alias("odd"))
    return summed.select("digest", F.when(F.col("odd") == 0, F.col("keep_id")).otherwise(F.raise_error(F.lit("texts of one digest differ")).cast("long")).alias("keep_id"), "n")


def dedup(docs: DataFrame, in_snapshot=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``in_snapshot``: a condition on doc_id that says which rows are the immutable snapshot; the others are the incoming
    batch. The result does not depend on it. Default: an even split by hash.
    """
    snap = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    rows = written(digest_rows(docs).withColumn("snap", F.coalesce(snap, F.lit(False))), "digests")
    return decided(docs, rows).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def several_groups(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The groups of equal texts with several members, as snapshot and incoming batch give them together."""
    own = written(rows.groupBy("digest", "snap").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")), "groups")
    old = own.filter("snap").drop("snap")
    merged = merge(Snapshot.build(old), own.filter("not snap").drop("snap"))
    merged = written(merged.filter("n > 1"), "merged")
    # Groups that only the snapshot has stay as they were.
    rest = old.filter("n > 1").join(small_side(merged.filter("known").select("digest")), "digest", "left_anti")
    several = written(merged.drop("known").unionByName(rest.select("digest", "keep_id", "n")), "several")
    return written(verified(docs, several), "verified")


def decided(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The digest rows with keep_id, group_size and kept."""
    joined = rows.join(small_side(several_groups(docs, rows)), "digest", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", "digest", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact dedup drops; all columns stay, whatever their names."""
    rows = written(digest_rows(docs).withColumn("snap", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), "digests")
    digest, keep = absent(docs.columns, "digest", "keep_id")
    several = several_groups(docs, rows).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    marked = docs.withColumn(digest, _digest()).join(small_side(several), digest, "left")
    stays = plain(keep).isNull() | (F.col("doc_id") == plain(keep))
    return marked.filter(stays).select(*map(plain, docs.columns))
