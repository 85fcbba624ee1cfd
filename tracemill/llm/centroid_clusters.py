"""Clustering of integer vectors around centroids, by a search in shrinking balls.

A vector keeps its nearest and second nearest centroid, an upper bound of its distance to the
first and a lower bound of its distances to all others. When the centroids have moved, the
bounds move with them; a vector whose bounds still don't meet stays where it is. For the others

1. the remembered two are measured, and the search starts from the closer one;
2. the centroids are scanned in the order of their distance from that one, as far as its own
   distance plus that of the second nearest found so far: nothing beyond can be second;
3. every centroid within is compared by exact squared distance, in integers, ties by number.

The bounds are doubles with a margin wider than their rounding, so they only spare work and
decide nothing. Each round is one pass over the vectors, written to the shared folder; the
driver has the centroids and their sums alone, k rows of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import drop_staged, staged

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 16, 3, 64, 64, 1
LARGEST = 1 << 27  # of a component, so that a squared distance of 64 of them fits 64 bits
MARGIN = 1e-9  # relative, for bounds that have been rounded


def _integers(vector: Column, scale: int) -> Column:
    return F.transform(
        vector.cast("array<double>"),
        lambda x: F.floor(F.least(F.greatest(x * F.lit(float(scale)), F.lit(float(-LARGEST))), F.lit(float(LARGEST)))).cast("int"),
    )


def _whole(vector: Column, size: int) -> Column:
    """Whether there are ``size`` components, all of them finite numbers."""
    finite = lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))  # noqa: E731  NaN is above infinity
    return (F.size(vector) == size) & F.forall(vector.cast("array<double>"), finite)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Centroids:
    """The centroids, for each the others by distance, and how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        gap = np.stack([_squared(at, np.broadcast_to(c, at.shape)) for c in at])
        gap[np.arange(k), np.arange(k)] = -1  # itself first, also among equal ones
        order = np.argsort(gap, axis=1, kind="stable")
        self.near, self.gap = order[:, 1:], np.sqrt(np.take_along_axis(gap, order, 1)[:, 1:])
        moved = np.sqrt(_squared(at, before)) if before is not None else np.zeros(k)
        self.moved = moved
        self.others = np.array([np.delete(moved, i).max(initial=0.0) for i in range(k)])

    def search(self, x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second nearest centroid of each row of ``x`` and their squared distances, from any two hints that differ."""
        d1, d2 = _squared(x, self.at[first]), _squared(x, self.at[second])
        swap = (d2 < d1) | ((d2 == d1) & (second < first))
        start, other = np.where(swap, second, first), np.where(swap, first, second)
        n1, n2, d1, d2 = start.copy(), other.copy(), np.where(swap, d2, d1), np.where(swap, d1, d2)
        from_start, live = np.sqrt(d1), np.arange(len(x))
        for t in range(self.near.shape[1]):
            ball = (from_start[live] + np.sqrt(d2[live])) * (1 + MARGIN)
            live = live[self.gap[start[live], t] <= ball]
            if not len(live):
                break
            j = self.near[start[live], t]
            at, j = live[j != other[live]], j[j != other[live]]
            d = _squared(x[at], self.at[j])
            best = (d < d1[at]) | ((d == d1[at]) & (j < n1[at]))
            next_ = ~best & ((d < d2[at]) | ((d == d2[at]) & (j < n2[at])))
            a = at[best]
            n2[a], d2[a], n1[a], d1[a] = n1[a], d1[a], j[best], d[best]
            a = at[next_]
            n2[a], d2[a] = j[next_], d[next_]
        return n1, n2, d1, d2

    def assign(self, x: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bring the state of the vectors up to date, in place."""
        if len(self.at) == 1:
            first[:] = 0
            return
        upper += self.moved[first]
        lower -= self.others[first]
        bound = np.maximum(lower, self.gap[first, 0] / 2) * (1 - MARGIN)
        open_ = np.flatnonzero(~(upper * (1 + MARGIN) < bound))
        upper[open_] = np.sqrt(_squared(x[open_], self.at[first[open_]]))
        open_ = open_[~(upper[open_] * (1 + MARGIN) < bound[open_])]
        n1, n2, d1, d2 = self.search(x[open_], first[open_], second[open_])
        first[open_], second[open_], upper[open_], lower[open_] = n1, n2, np.sqrt(d1), np.sqrt(d2)


STATE = ["nearest", "second", "upper", "lower", "distance"]


def _assigned(vectors: DataFrame, size: int, centroids: Centroids) -> DataFrame:
    """``vectors`` (id, v and, but in the first round, the state) with the state after these centroids."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, size)
            if "nearest" in batch.schema.names:
                state = [batch.column(c).to_numpy().copy() for c in STATE[:4]]
            else:
                n = len(x)
                state = [np.zeros(n, np.int32), np.full(n, min(1, len(own.at) - 1), np.int32), np.full(n, np.inf), np.zeros(n)]
            own.assign(x, *state)
            distance = _squared(x, own.at[state[0]])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), *map(pa.array, [*state, distance])], ["id", "v", *STATE])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(assign, f"id {kind}, v array<int>, nearest int, second int, upper double, lower double, distance long")


def _moved(vectors: DataFrame, size: int, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the componentwise floor of the mean of its vectors; one without any stays."""
    out = centroids.copy()
    sums = [F.sum(F.get("v", i).cast("long")).alias(f"s{i}") for i in range(size)]
    for row in vectors.groupBy("nearest").agg(F.count("*").alias("n"), *sums).collect():  # a row for each centroid
        out[row["nearest"]] = [row[f"s{i}"] // row["n"] for i in range(size)]
    return out


def cluster_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    size: int = SIZE, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """Per vector ``key``, its ``cluster`` and the squared ``distance`` to that centroid; and the centroids.

    A vector's components are floor(scale * x). Rows whose vector is null, hasn't ``size`` components, or
    has one that is null or not finite are left out. A component beyond 2^27 counts as 2^27, so that
    distances fit 64 bits. Centroids start as the vectors with the smallest SHA-256 of ``seed:key``
    (a null key is empty there; equal keys by their components), so with fewer vectors than ``clusters``
    there are as many as vectors. After ``rounds`` of assigning and moving, vectors are assigned once
    more; ties go to the smaller number. Repeated rows are vectors each. Other columns are not looked
    at. A table without such vectors gives no rows.
    """
    whole = vectors.where(_whole(F.col(vector), size)).select(F.col(key).alias("id"), _integers(F.col(vector), scale).alias("v"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = whole.orderBy(order, "v").limit(clusters).select("v").collect()
    if not chosen:
        nothing = whole.select(F.col("id").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing, np.zeros((0, size), np.int64)
    at = np.array([row["v"] for row in chosen], np.int64)
    state = staged(_assigned(whole, size, Centroids(at)), "clusters")
    for _ in range(rounds):
        before, at = at, _moved(state, size, at)
        last, state = state, staged(_assigned(state, size, Centroids(at, before)), "clusters")
        drop_staged(last)
    return state.select(F.col("id").alias(key), F.col("nearest").alias("cluster"), "distance"), at


def op11_centroid_clusters(embeddings: DataFrame) -> DataFrame:
    out, at = cluster_vectors(embeddings)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = out.groupBy("cluster").agg(total("distance").alias("own"))
    every = sums.agg(F.sum("own").alias("every"))
    sha = F.get(F.array(*map(F.lit, names or [""])), F.col("cluster"))
    sums = sums.crossJoin(F.broadcast(every)).select(  # a row for each centroid, and one
        "cluster", F.least("own", most).cast("long").alias("cluster_inertia"), F.least("every", most).cast("long").alias("inertia"),
        sha.alias("centroid_sha256"),
    )
    return out.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _oracle() -> str:
    kept = (
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v"
        f" FROM embeddings WHERE len(embedding) = {SIZE} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {SIZE})"
    )
    parts = [kept, (
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM"
        f" (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {CLUSTERS}))"
    )]
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, j, d FROM (SELECT r, vec_id, v, j, list_sum([(t[1] - t[2]) * (t[1] - t[2]) FOR t IN list_zip(v, c)])"
            f" AS d FROM kept CROSS JOIN c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)"
        )
        if i < ROUNDS:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c"
                f" FROM (SELECT j, i, sum(v[i]) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {SIZE + 1}) AS t(i) GROUP BY j, i) GROUP BY j) AS m USING (j))"
            )
    last = (
        "SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (j)"
    )
    return "WITH " + ", ".join(parts) + " " + last


ORACLE_SQL = _oracle()
