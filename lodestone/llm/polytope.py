"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, least_reachable
from .tiles import Forest, meet_in_tiles, whole_groups
from .workspace import KEY_ROWS, materialize, prepare, spread_join

#: Verified pairs looked at together.
PAIRS = 1 << 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row (length a power of two), in log2 steps, orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` tables of ``hashes`` cross-polytope hashes each.

    A hash rotates the vector (three times: random signs, then Hadamard) and names the nearest signed
    axis.  A table's bucket joins the names of its hashes.  The other probes of a table change one hash
    to its second nearest axis, the hashes with the closest contest first.
    """

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, seed: int):
        self.dim, self.tables, self.hashes, self.probes = dim, tables, hashes, probes
        self.size = 1 << max(0, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.size))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """int64 codes, rows x tables x probes; the first probe is the vector's own bucket."""
        n, k = len(x), self.hashes
        padded = np.zeros((n, self.size))
        padded[:, : self.dim] = x
        rows, out = np.arange(n), np.empty((n, self.tables, self.probes), np.int64)
        for t in range(self.tables):
            first, second, gap = np.empty((n, k), np.int64), np.empty((n, k), np.int64), np.empty((n, k))
            for h in range(k):
                y = padded
                for s in self.signs[t, h]:
                    y = hadamard(y * s)
                size = np.abs(y)
                top = np.argpartition(-size, 1, axis=1)[:, :2] if self.size > 2 else np.argsort(-size, axis=1)[:, :2]
                swap = size[rows, top[:, 0]] < size[rows, top[:, -1]]
                top[swap] = top[swap][:, ::-1]
                name = top * 2 + (y[rows[:, None], top] < 0)
                first[:, h], second[:, h] = name[:, 0], name[:, -1]
                gap[:, h] = size[rows, top[:, 0]] - size[rows, top[:, -1]]
            place = (2 * self.size) ** np.arange(k)
            own = first @ place
            out[:, t, 0] = own
            closest = np.argsort(gap, axis=1, kind="stable")
            for p in range(1, self.probes):
                h = closest[:, p - 1]
                out[:, t, p] = own + (second[rows, h] - first[rows, h]) * place[h]
        return out


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows (finite, not zero) over their norms; scaled by their largest component first, so nothing overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def keyed_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id, key, label, dim, unit``: the digest of label and vector, and the unit vector's bytes; null where a row compares with none."""
    prepare(vectors.sparkSession)
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                labels, lists, n = piece.column("label").to_pylist(), piece.column("vector"), piece.num_rows
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null components become NaN
                ends = np.concatenate([[0], np.cumsum(sizes)])
                keys, units = [None] * n, [None] * n
                for d in np.unique(sizes[sizes > 0]).tolist():
                    rows = np.flatnonzero(sizes == d)
                    x = flat[ends[rows][:, None] + np.arange(d)] + 0.0
                    fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
                    rows, x = rows[fine], x[fine]
                    for r, own, unit in zip(rows.tolist(), x, unit_vectors(x) if len(x) else x, strict=True):
                        if labels[r] is not None:
                            keys[r], units[r] = hashlib.md5(labels[r].encode("utf-8", "surrogatepass") + b"\0" + own.tobytes()).digest(), unit.tobytes()
                yield pa.RecordBatch.from_arrays([piece.column("vec_id"), pa.array(keys, pa.binary()), piece.column("label"), pa.array(sizes, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "key", "label", "dim", "unit"])

    return src.mapInArrow(run, "vec_id long, key binary, label string, dim int, unit binary")


def verify_groups(table: pa.Table, edges: np.ndarray, dim: int, tables: int, probes: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links that keep classes whole (``u, v``, n null) and link counts (``u``, v null, n) of each task key.

    A pair that meets in several buckets counts in the first table, and there the least code, that both
    have.  Buckets are of a label's hash; pairs whose labels differ are left out.
    """
    unit, node = np.frombuffer(b"".join(table.column("unit").to_pylist()), "<f8").reshape(-1, dim), table.column("node").to_numpy()
    label = table.column("label").combine_chunks().dictionary_encode()
    label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
    copies, side = table.column("copies").to_numpy(), table.column("side").to_numpy()
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), "<i8").reshape(-1, tables, probes)
    t_of, code_of = table.column("tbl").to_numpy(), table.column("code").to_numpy()
    whole = table.column("ta").to_numpy() == table.column("tb").to_numpy()
    us, vs, counts = [], [], np.zeros(len(node), np.int64)

    def count(i: np.ndarray, j: np.ndarray) -> None:
        for a in range(0, len(i), PAIRS):
            p, q = i[a : a + PAIRS], j[a : a + PAIRS]
            shared = codes[p][:, :, :, None] == codes[q][:, :, None, :]
            first = shared.any(axis=(2, 3)).argmax(axis=1)
            mine = first == t_of[p]
            p, q, shared = p[mine], q[mine], shared[mine, first[mine]]
            least = np.where(shared.any(axis=2), codes[p, t_of[p]], np.iinfo(np.int64).max).min(axis=1)
            mine = least == code_of[p]
            np.add.at(counts, p[mine], copies[q[mine]])
            np.add.at(counts, q[mine], copies[p[mine]])

    for a, b in zip(edges[:-1], edges[1:], strict=True):
        cut = b if whole[a] else a + int((side[a:b] == 0).sum())
        forest, base = Forest(b - a), a if whole[a] else cut
        for at in range(a, cut, 1024):
            near = unit[at : min(at + 1024, cut)] @ unit[base:b].T >= threshold
            if label[a] != label[b - 1] or (label[a:b] != label[a]).any():
                near &= label[at : min(at + 1024, cut), None] == label[None, base:b]
            i, j = np.nonzero(near)
            i, j = i + at, j + base
            if whole[a]:
                i, j = i[j > i], j[j > i]
            if len(i):
                count(i, j)
                forest.join(i - a, j - a)
        i, j = forest.edges()
        us.append(node[a + i])
        vs.append(node[a + j])
    u, v = np.concatenate(us), np.concatenate(vs)
    hit = np.flatnonzero(counts)
    none = pa.nulls(len(hit), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([u, node[hit]])), pa.chunked_array([pa.array(v, pa.int64()), none]).combine_chunks(), pa.chunked_array([pa.nulls(len(u), pa.int64()), pa.array(counts[hit])]).combine_chunks()],
        names=["u", "v", "n"],
    )


def near_duplicates(
    vectors: DataFrame,
    *,
    threshold: float = 0.98,
    tables: int = 6,
    hashes: int = 3,
    probes: int = 4,
    seed: int = 7,
    tile: int = 1024,
    heavy: int = KEY_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row for each vector: ``vec_id, n_links, component_id, kept``.

    Compares vectors with equal labels (null: with none; labels are compared as strings).  Equal vectors of a label form one class
    by their digest and are never paired; classes are hashed, meet in the buckets of all probes, and
    every pair that meets is verified by its cosine in double precision.  Hot buckets are split into tiles.
    Links are counted, not listed; a spanning set of them finds the components.

    Vectors that are null, empty, zero, or hold null or non-finite components have no links and are
    their own component, as are rows with a null label.  Vectors of different lengths aren't
    compared.  A null id is kept with its link count and links like others.
    Rows that repeat an id count as vectors of their own, each with its own links, whether their vectors are equal or not.  An empty table gives no rows.
    """
    found = materialize(keyed_vectors(vectors, id_col, vector_col, label_col), "vector-keys")
    classes = found.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("_rows"), *(F.first(c).alias(c) for c in ("label", "dim", "unit")))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    links = _bucketed(classes.withColumnRenamed("_rows", "copies"), tables, hashes, probes, seed, tile, threshold)
    links = materialize(links, "vector-links")
    counts = links.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("_n"))
    parts = materialize(connected_components(links.where("v is not null").select("u", "v")), "vector-components")
    by_class = least_reachable(classes.select("node", "key", "least", "_rows"), parts).join(counts, "node", "left")
    by_class = by_class.select("key", "_rows", (F.coalesce("_n", F.lit(0)) + F.col("_rows") - 1).alias("_links"), F.col("component_id").alias("_component"))
    out = spread_join(found.select("vec_id", "key"), by_class, "key", heavy)
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("_component"))
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _bucketed(classes: DataFrame, tables: int, hashes: int, probes: int, seed: int, tile: int, threshold: float) -> DataFrame:
    """``u, v, n`` of :func:`verify_groups` for all classes."""
    dims = [r[0] for r in classes.select("dim").distinct().collect()]
    parts = [_of_dim(classes.where(F.col("dim") == d), d, tables, hashes, probes, seed, tile, threshold) for d in sorted(dims)]
    if not parts:
        return classes.sparkSession.createDataFrame([], "u long, v long, n long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _of_dim(classes: DataFrame, dim: int, tables: int, hashes: int, probes: int, seed: int, tile: int, threshold: float) -> DataFrame:
    prepare(classes.sparkSession)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lsh = CrossPolytope(dim, tables, hashes, probes, seed)
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                piece = b.slice(at, 2048)
                x = np.frombuffer(b"".join(piece.column("unit").to_pylist()), "<f8").reshape(-1, dim)
                codes = lsh.codes(x).reshape(-1, tables * probes)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in ("label_key", "label", "node", "copies", "unit")), pa.array([r.tobytes() for r in codes.astype("<i8")], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                    names=["label_key", "label", "node", "copies", "unit", "codes", "each"],
                )

    hashed = classes.select(F.xxhash64("label").alias("label_key"), "label", "node", "copies", "unit").mapInArrow(hash_all, "label_key long, label string, node long, copies long, unit binary, codes binary, each array<long>")
    hashed = materialize(hashed, "vector-codes")
    keys = hashed.select("label_key", "node", F.posexplode("each").alias("at", "code"))
    keys = keys.withColumn("tbl", F.floor(F.col("at") / probes).cast("long")).dropDuplicates(["node", "tbl", "code"])
    group = {"k1": F.col("label_key"), "k2": F.col("tbl") + F.col("code") * tables}
    keys = keys.select(*(c.alias(k) for k, c in group.items()), F.lit(0).alias("lane"), "node", "tbl", "code")
    met = meet_in_tiles(materialize(keys, "vector-buckets"), tile=tile, payload=hashed.select("node", "label", "copies", "unit", "codes"))
    return met.mapInArrow(lambda batches: whole_groups(batches, lambda t, e: verify_groups(t, e, dim, tables, probes, threshold)), "u long, v long, n long")
