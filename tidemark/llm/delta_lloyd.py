"""Clusters by Lloyd's rounds, of which each looks only at what the last one changed.

Vectors become integers once, floor(scale * x), and are stored with a row number, bucketed by it. A round stores its
assignments (owner and distance of each row) in the same buckets, so that the next one joins both without a shuffle.
A row whose owner has moved is compared with all centroids; any other keeps its distance and is compared only with
those that moved. Rows that change owner carry their vector in the stored round as a signed transfer: the sums and
counts of all clusters, which the driver holds (clusters x dims numbers), get what came and lose what went. A centroid is
floor(sum / count) of its cluster, exactly. The rounds end early once no centroid moves, since nothing would change.

A round writes a few numbers a row and reads the vectors; a transfer is as long as the rows that moved. The assignments
of the round before the last are deleted. A lost executor costs the reading of stored tables.

Defined cases
- vectors that are null, of another size, or with a null, infinite or NaN component, or one of 2^17 or more in size (its
  distances might not fit 64 bits): left out.
- ties of distance: the smaller cluster. Empty clusters keep their centroid. Fewer vectors than clusters: as many clusters.
- null vec_ids: kept, never a first centroid before others. Repeated rows: each is a row; equal ones may both be first
  centroids, of which the second stays empty.
- sums over clusters that do not fit a long are null. Empty table: no rows. Extra columns are not read.
- the input is numbered as it is read: it has to be a stored table (write others first).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.paths import delete, fresh

#: Components at and beyond this leave a vector out.
LARGEST = 2.0**17
ASSIGNED = "row long, vec_id long, was int, cluster int, distance long, moved array<long>"


@dataclass(frozen=True)
class Lloyd:
    clusters: int = 8
    dims: int = 64
    rounds: int = 10
    scale: int = 1024
    salt: str = "3:"
    #: Rows of a bucket: its assignments are a task's hash table.
    bucket_rows: int = 500_000


def quantised(vectors: DataFrame, how: Lloyd) -> DataFrame:
    """vec_id, q: the kept vectors as integers."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    kept = vectors.where((F.size("embedding") == how.dims) & whole)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(how.scale))).cast("long")).alias("q"))


class _Buckets:
    """Tables bucketed by `row` under the shared folder."""

    def __init__(self, spark, n: int):
        self.spark, self.n = spark, n

    def stored(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path, table = fresh(self.spark, name), f"lloyd_{uuid.uuid4().hex}"
        df.write.bucketBy(self.n, "row").option("path", path).saveAsTable(table)
        out = self.spark.table(table)
        out.schema  # noqa: B018  resolved while the name is there
        self.spark.sql(f"DROP TABLE {table}")  # the name only; the files stay
        return out, path


def nearest(q: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners (-1: none yet) and distances of vectors after the `changed` centroids have moved."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        far = np.stack([((q[lost] - c) ** 2).sum(axis=1) for c in centroids], axis=1)
        owner[lost] = far.argmin(axis=1)  # the first of equal ones
        distance[lost] = far[np.arange(len(far)), owner[lost]]
    rest = np.flatnonzero(~lost)
    for c in np.flatnonzero(changed) if len(rest) else ():
        d = ((q[rest] - centroids[c]) ** 2).sum(axis=1)
        won = (d < distance[rest]) | ((d == distance[rest]) & (c < owner[rest]))
        owner[rest[won]], distance[rest[won]] = c, d[won]
    return owner, distance


def _round(centroids: np.ndarray, changed: np.ndarray):
    dims = centroids.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            was = batch.column("cluster").fill_null(-1).to_numpy(zero_copy_only=False)
            owner, distance = nearest(q, was, batch.column("distance").fill_null(0).to_numpy(zero_copy_only=False), centroids, changed)
            went = owner != was
            offsets = np.concatenate([[0], np.cumsum(went * dims)]).astype(np.int32)
            moved = pa.ListArray.from_arrays(pa.array(offsets), pa.array(q[went].ravel()), mask=pa.array(~went))
            each = [batch.column("row"), batch.column("vec_id"), batch.column("cluster"), pa.array(owner.astype(np.int32)), pa.array(distance), moved]
            yield pa.RecordBatch.from_arrays(each, ["row", "vec_id", "was", "cluster", "distance", "moved"])

    return of


def _transfers(assigned: DataFrame) -> list:
    """cluster, dim, n, s of each cluster that vectors came to or went from: how many more it has, and by how much its sum is larger."""
    came, went = F.struct(F.col("cluster"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("cluster"), F.lit(-1).alias("sign"))
    signed = assigned.where("moved IS NOT NULL").select("moved", F.explode(F.array(came, went)).alias("to")).where("to.cluster IS NOT NULL")
    each = signed.select("to.cluster", "to.sign", F.posexplode("moved").alias("dim", "x"))
    return each.groupBy("cluster", "dim").agg(F.sum("sign").alias("n"), F.sum(F.col("x") * F.col("sign")).alias("s")).collect()


def cluster(vectors: DataFrame, how: Lloyd = Lloyd()) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every kept vector, and the centroids of the last round."""
    spark = vectors.sparkSession
    kept = quantised(vectors, how)
    buckets = _Buckets(spark, max(spark.sparkContext.defaultParallelism, -(-vectors.count() // how.bucket_rows)))
    numbered = kept.withColumn("row", F.monotonically_increasing_id()).repartition(buckets.n, "row")
    stored, _ = buckets.stored(numbered, "lloyd-vectors")
    first = F.sha2(F.concat(F.lit(how.salt), F.col("vec_id").cast("string")), 256)
    centroids = np.array([r.q for r in stored.orderBy(first.asc_nulls_last(), "q", "row").limit(how.clusters).select("q").collect()], np.int64).reshape(-1, how.dims)
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    changed = np.ones(len(centroids), bool)
    assigned, path = None, None
    for turn in range(how.rounds + 1):
        rows = stored.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("long")})
        if assigned is not None:
            rows = stored.join(assigned.select("row", "cluster", "distance").hint("shuffle_hash"), "row")
        new, at = buckets.stored(rows.mapInArrow(_round(centroids, changed), ASSIGNED), "lloyd-assigned")
        if path:
            delete(spark, path)
        assigned, path = new, at
        if turn == how.rounds:
            break
        for r in _transfers(assigned):
            sums[r.cluster, r.dim] += r.s
            counts[r.cluster] += r.n if r.dim == 0 else 0
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
        changed = (moved != centroids).any(axis=1)
        centroids = moved
        if not changed.any():
            break
    return assigned.select("vec_id", "cluster", "distance"), centroids


def judge(vectors: DataFrame, how: Lloyd = Lloyd()) -> DataFrame:
    """vec_id, cluster, distance (squared, to the centroid), cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    rows, centroids = cluster(vectors, how)
    spark = rows.sparkSession
    named = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    digests = spark.createDataFrame(named, "cluster int, centroid_sha256 string")
    total = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own"))
    both = total.crossJoin(total.agg(F.sum("own").alias("all"))).select("cluster", F.expr("try_cast(own AS bigint)").alias("cluster_inertia"), F.expr("try_cast(all AS bigint)").alias("inertia"))
    return rows.join(F.broadcast(both.join(digests, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
