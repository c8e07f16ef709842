"""SimHash fingerprints and near-duplicate classes by tiled exact comparison (operator 3)."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, least_reachable
from .tiles import KEYS, Forest, meet_in_tiles, whole_groups
from .workspace import KEY_ROWS, ids_side, materialize, prepare, spread_join

SEED = 42
#: Rows of a band's value that are all candidates of each other, without a look at their sketches.
FEW = 8
#: Shared bands (their keys with a count) up to this number are sent to all tasks; more are joined by a shuffle.
SHARED_BANDS = 1_000_000
#: Bands of a text's shingle set that candidates may share.
BANDS = 24
#: The level of small texts, as a power of two: all its parts are bands.
LOWEST = 5
#: Shingles hashed at a time: bounds the memory for a very long text.
SHINGLES = 1 << 17


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; zero without words.

    Letters A-Z are lowered, words end at ASCII white space: both are what bytes.lower and bytes.split do.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total, counts = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    if len(words) < shingle:
        grams = iter([b" ".join(words)])
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashed = (xxhash.xxh64_intdigest(g, SEED) for g in grams)
    for at in range(0, total, SHINGLES):
        h = np.fromiter(hashed, "<u8", min(SHINGLES, total - at))
        for a in range(0, len(h), 4096):
            counts += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) over whole texts."""
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id long, fp long")


def _links_in(x: np.ndarray, y: np.ndarray | None, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in x and y (None: pairs within x) of fingerprints at most ``radius`` bits apart.

    Both sides are put in order of population count, and a block of x is compared with that slice
    of y alone whose counts are within the radius.
    """
    ox = np.argsort(np.bitwise_count(x), kind="stable")
    oy = ox if y is None else np.argsort(np.bitwise_count(y), kind="stable")
    px, py = np.bitwise_count(x[ox]).astype(np.int16), np.bitwise_count((x if y is None else y)[oy]).astype(np.int16)
    sx, sy = x[ox], (x if y is None else y)[oy]
    for a in range(0, len(sx), block):
        b = min(a + block, len(sx))
        lo, hi = np.searchsorted(py, px[a] - radius, "left"), np.searchsorted(py, px[b - 1] + radius, "right")
        lo = max(lo, a) if y is None else lo
        if lo >= hi:
            continue
        i, j = np.nonzero(np.bitwise_count(sx[a:b, None] ^ sy[None, lo:hi]) <= radius)
        i, j = i + a, j + lo
        if y is None:
            i, j = i[j > i], j[j > i]
        if len(i):
            yield ox[i], oy[j]


def link_groups(table: pa.Table, edges: np.ndarray, radius: int, small: int = 24) -> Iterator[pa.RecordBatch]:
    """Links ``u, v`` that keep together the classes within each task key."""
    fp, node = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
    side, size = table.column("side").to_numpy(), np.diff(edges)
    group = np.repeat(np.arange(len(size)), size)
    u, v = [], []
    # Small keys all at once: each row with the k-th row after it.
    few = np.repeat((size <= small) & (table.column("ta").to_numpy()[edges[:-1]] < 0), size)
    at = np.flatnonzero(few)
    for k in range(1, int(size.max(initial=0)) if len(at) else 0):
        if k >= small:
            break
        i = at[at + k < len(fp)]
        i = i[group[i] == group[i + k]]
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= radius]
        u.append(node[i])
        v.append(node[i + k])
    for g in np.flatnonzero((size > small) | (table.column("ta").to_numpy()[edges[:-1]] >= 0)):
        a, b = edges[g], edges[g + 1]
        cut = a + int((side[a:b] == 0).sum())
        forest = Forest(b - a)
        within = table.column("ta")[int(a)] == table.column("tb")[int(a)]
        for i, j in _links_in(fp[a:cut], None if within else fp[cut:b], radius):
            forest.join(i, j if within else j + cut - a)
        i, j = forest.edges()
        u.append(node[a + i])
        v.append(node[a + j])
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def fingerprint_links(nodes: DataFrame, *, radius: int = 2, tile: int = 2048) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints (``node, fp``) at most ``radius`` bits apart, enough to keep classes whole.

    Fingerprints within r bits agree on at least one of r + 1 bands, so each band's value is a group;
    within it all tile pairs are compared exactly, but for those whose population counts differ by
    more than r.
    """
    prepare(nodes.sparkSession)
    bands = radius + 1
    width = [64 // bands + (k < 64 % bands) for k in range(bands)]
    starts = [sum(width[:k]) for k in range(bands)]
    keys = [F.struct(F.lit(k).cast("long").alias("k1"), F.shiftrightunsigned("fp", starts[k]).bitwiseAND(F.lit((1 << width[k]) - 1)).alias("k2")) for k in range(bands)]
    rows = nodes.select("node", "fp", F.bit_count("fp").cast("int").alias("lane"), F.explode(F.array(*keys)).alias("k"))
    rows = materialize(rows.select("k.k1", "k.k2", "lane", "node", "fp"), "bands")
    met = meet_in_tiles(rows, radius=radius, tile=tile)
    return met.mapInArrow(lambda batches: whole_groups(batches, lambda t, e: link_groups(t, e, radius)), "u long, v long")


def near_duplicates(docs: DataFrame, *, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = 2048, heavy: int = KEY_ROWS) -> DataFrame:
    """One row for each document: ``doc_id, fingerprint, component_id``.

    Copies share a fingerprint, which stands for them, so they are never paired;
    classes are the components of the links between distinct fingerprints.  A null or empty text, or one of white space,
    has the fingerprint zero and links like any other.  Rows with a null id link like others; a class's id is the smallest
    that one of its rows has, null if none has one.  Repeated rows come out
    as often as they come in; an empty table gives no rows.
    """
    found = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_rows")).withColumn("node", F.col("fp")), "fingerprint-nodes")
    classes = materialize(connected_components(fingerprint_links(nodes.select("node", "fp"), radius=radius, tile=tile)), "fingerprint-classes")
    by_fp = least_reachable(nodes, classes).select("fp", "_rows", "component_id")
    return spread_join(found, by_fp, "fp", heavy).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_shingles(w: list[bytes], words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many of a text's words (fewer words: the whole sequence)."""
    grams = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else iter([b" ".join(w)])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), "<u8"))


def _combined(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the runs of so many words, mixed from the words' own hashes (fewer words: one run)."""
    words = min(words, len(h))
    mixed = np.zeros(len(h) - words + 1, np.uint64)
    for k in range(words):
        mixed = (mixed ^ h[k : k + len(mixed)]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def sketch_bits(size: int) -> int:
    """Bits of a text's parity sketch: a power of two, at least 0.7 for each distinct shingle up to 16,384."""
    return 1 << min(14, max(8, (7 * size // 10 - 1).bit_length()))


def parity_sketch(h: np.ndarray) -> bytes:
    """Whether the number of the distinct hashes that fall on each bit is odd.

    Two sketches of like length differ in no more bits than the sets have hashes that are in one of them alone.
    """
    bits = sketch_bits(len(h))
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_bands(h: np.ndarray, similarity: float, bands: int = BANDS) -> np.ndarray:
    """64-bit keys of a text's bands, from its distinct hashes.

    At a level the hashes are dealt over so many parts (a power of two, 32 at least); a band is one of the first ``bands`` parts (any of 32), and its key the
    exclusive-or of the hashes in it, a wide parity sketch, mixed with the level.  Sets agree on a band if their hashes in it are the same.
    Parts hold some 2.5 to 5 hashes, so sets with a Jaccard similarity of 0.8 agree on a band that isn't empty
    with a probability of 0.37 to 0.53, and miss all 24 in some two of a million cases, 15 at worst.  A text has the level of its size and those of the sizes
    down to the factor ``similarity``, so that texts that may link share one.
    """
    keys = []
    for level in range(_level(len(h) * similarity), _level(len(h)) + 1):
        part = (h >> np.uint64(24)) & np.uint64((1 << level) - 1)
        at = np.flatnonzero(part < (bands if level > LOWEST else 1 << LOWEST))
        order = at[np.argsort(part[at], kind="stable")]
        if len(order):
            edges = np.flatnonzero(np.concatenate([[True], part[order][1:] != part[order][:-1]]))
            keys.append(np.bitwise_xor.reduceat(h[order], edges) + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.concatenate(keys).view(np.int64)


def _level(size: float) -> int:
    """The lowest level with parts of no more than five hashes."""
    return max(LOWEST, math.ceil(math.log2(size / 5 - 1e-9)) if size > 6 else 0)


def _sketches(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, digest`` (of the lowered words), ``sketch``, ``size`` (distinct shingles) and ``bands`` (their keys) of whole texts."""
    prepare(docs.sparkSession)

    def sketch(text: str) -> tuple[bytes, bytes, int, np.ndarray]:
        w = text.encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in w or [b""]), "<u8")
        h = np.unique(_combined(h, words))
        return hashlib.md5(b" ".join(w)).digest(), parity_sketch(h), len(h), sketch_bands(h, similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                piece = b.slice(at, 512)
                digests, sketches, sizes, bands = zip(*(sketch(x or "") for x in piece.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "sketch", "size", "bands"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, digest binary, sketch binary, size long, bands array<long>")


def _tasks(table: pa.Table, edges: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """Start, cut between the sides, end, and whether it is one tile, of each task key."""
    side, same = table.column("side").to_numpy(), table.column(KEYS[2]).to_numpy() == table.column(KEYS[3]).to_numpy()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(a), int(b) if same[a] else int(a + (side[a:b] == 0).sum()), int(b), bool(same[a])


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) made as short as so many words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _close_in(x: np.ndarray, nx: np.ndarray, y: np.ndarray | None, ny: np.ndarray | None, similarity: float, block: int = 64, span: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in x and y (None: pairs within x) of sketches and sizes that allow the similarity.

    Sets of sizes p and q with a Jaccard similarity of s or more differ in at most (p + q)(1 - s)/(1 + s)
    elements, and their sketches in no more bits, so no such pair is left out.
    """
    ox = np.argsort(nx, kind="stable")
    oy = ox if y is None else np.argsort(ny, kind="stable")
    sx, sy = nx[ox], (nx if y is None else ny)[oy]
    x, y = (np.ascontiguousarray(v.T) for v in (x[ox], (x if y is None else y)[oy]))
    within, share = oy is ox, (1 - similarity) / (1 + similarity)
    for a in range(0, len(sx), block):
        b = min(a + block, len(sx))
        lo, hi = np.searchsorted(sy, sx[a] * similarity - 1e-6, "left"), np.searchsorted(sy, sx[b - 1] / similarity + 1e-6, "right")
        for c in range(max(lo, a) if within else lo, hi, span):
            d = min(c + span, hi)
            far = np.bitwise_count(x[0, a:b, None] ^ y[0, None, c:d]).astype(np.uint16)
            for k in range(1, len(x)):
                far += np.bitwise_count(x[k, a:b, None] ^ y[k, None, c:d])
            i, j = np.nonzero(far <= share * float(sx[b - 1] + sy[d - 1]) + 1e-6)
            if not len(i):
                continue
            n, m = sx[a + i], sy[c + j]
            fits = (far[i, j] <= share * (n + m) + 1e-6) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)
            i, j = a + i[fits], c + j[fits]
            if within:
                i, j = i[j > i], j[j > i]
            if len(i):
                yield ox[i], oy[j]


def _candidates(table: pa.Table, edges: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Start of each task key's rows with positions in it of pairs that may be as similar."""
    size, sketch = table.column("size").to_numpy(), table.column("sketch").to_pylist()
    wide = np.fromiter((len(v) // 8 for v in sketch), np.int64, len(sketch))
    for a, cut, b, same in _tasks(table, edges):
        rows = {int(w): np.flatnonzero(wide[a:b] == w) for w in np.unique(wide[a:b])}
        words = {w: np.frombuffer(b"".join(sketch[a + k] for k in at), "<u8").reshape(len(at), w) for w, at in rows.items()}
        for v, w in itertools.product(rows, rows):
            p, q = (slice(None), slice(None)) if same else (rows[v] < cut - a, rows[w] >= cut - a)
            if same and v > w or not len(rows[v][p]) or not len(rows[w][q]):
                continue
            n = min(v, w)
            one, other = rows[v][p], rows[w][q]
            alone = same and v == w
            for i, j in _close_in(_folded(words[v][p], n), size[a + one], None if alone else _folded(words[w][q], n), None if alone else size[a + other], similarity):
                yield a, one[i], other[j]


def _candidate_links(table: pa.Table, edges: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links ``u, v`` that keep together the nodes that candidates connect within each task key."""
    node, forest = table.column("node").to_numpy(), Forest(table.num_rows)
    for a, i, j in _candidates(table, edges, similarity):
        forest.join(a + i, a + j)
    i, j = forest.edges()
    yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])


def _verified(table: pa.Table, edges: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    node, sets, forest = table.column("node").to_numpy(), table.column("shingles"), Forest(table.num_rows)
    for a, i, j in _candidates(table, edges, similarity):
        for x, y in zip((a + i).tolist(), (a + j).tolist(), strict=True):
            if forest.root(x) == forest.root(y):
                continue
            p, q = (np.frombuffer(sets[k].as_buffer(), "<u8") for k in (x, y))
            if min(len(p), len(q)) >= similarity * max(len(p), len(q)):
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= similarity * (len(p) + len(q) - both):
                    forest.link(x, y)
    i, j = forest.edges()
    yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["u", "v"])


def similar_documents(docs: DataFrame, *, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", tile: int = 4096, verify_tile: int = 1024, heavy: int = KEY_ROWS) -> DataFrame:
    """``doc_id, component_id``: classes of texts whose sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity``.

    Candidates share a band of their shingle sets (:func:`sketch_bands`).  Within a band's value, tiles are compared by exclusive-or
    and bit counts of parity sketches (:func:`parity_sketch`), which bound how far two sets differ; tiles are made by the
    number of distinct shingles on a log scale, only neighbours meet, and pairs of sizes too far apart are skipped.
    A band's value that few texts share makes them candidates as they are.  Each link is then verified on the shingles themselves.  Bands miss some two of a million
    pairs at a similarity of 0.8 and fewer above it; the sketches miss none.  First the
    components of the candidates are found; no link can leave one.  Then the shingles of texts with candidates are
    fetched and travel once each, to their component (a large one is split into tiles), and pairs are verified
    there; a pair already in one class isn't verified again.

    Equal texts (but for A-Z case and white space) are one class by their digest.  Null and empty texts are
    equal.  Rows with a null id link like others; a class's id is the smallest that one of its rows has, null if none has one.
    """
    found = materialize(_sketches(docs, words, similarity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    lane = F.floor(F.log("size") / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    # A class of equal texts has the number of its first row; its other columns are the same in all rows.
    same = [F.first(c).alias(c) for c in ("size", "sketch", "bands")]
    nodes = found.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("_rows"), *same)
    nodes = materialize(nodes.withColumn("lane", lane), "sketch-nodes")
    bands = nodes.select(F.explode("bands").alias("k1"), "lane", "node")
    shared = bands.groupBy("k1").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    banded = bands.join(ids_side(materialize(shared, "sketch-bands"), SHARED_BANDS), "k1")
    few = banded.where((F.col("n") <= FEW) & (F.col("node") != F.col("first"))).select(F.col("node").alias("u"), F.col("first").alias("v")).distinct()
    many = materialize(banded.where(F.col("n") > FEW).select("k1", F.lit(0).cast("long").alias("k2"), "lane", "node"), "sketch-groups")
    met = meet_in_tiles(many, radius=1, tile=tile, payload=nodes.select("node", "size", "sketch"))
    loose = few.unionByName(met.mapInArrow(lambda batches: whole_groups(batches, lambda t, e: _candidate_links(t, e, similarity)), "u long, v long"))
    groups = materialize(connected_components(loose), "sketch-components")
    wanted = materialize(nodes.join(groups.select("node"), "node").select("node", "digest", "least"), "shingles-wanted")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = ids_side(wanted.select(F.col("least").alias("_id")).distinct())
    texts = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = [(x or "").encode("utf-8", "surrogatepass").lower().split() for x in b.column(0).slice(at, 256).to_pylist()]
                digests, sets = [hashlib.md5(b" ".join(w)).digest() for w in some], [word_shingles(w, words).tobytes() for w in some]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"])

    # Rows that repeat an id and a text give a node's set more than once, which changes no class.
    sets = texts.mapInArrow(shingled, "digest binary, shingles binary").join(ids_side(wanted), "digest").select("node", "shingles")
    some = nodes.join(groups, "node").select(F.col("component").alias("k1"), F.lit(0).cast("long").alias("k2"), "lane", "node", "size", "sketch")
    met = meet_in_tiles(materialize(some, "sketch-candidates"), radius=1, tile=verify_tile, payload=sets)
    links = met.mapInArrow(lambda batches: whole_groups(batches, lambda t, e: _verified(t, e, similarity)), "u long, v long")
    classes = materialize(connected_components(links), "similar-classes")
    by_digest = least_reachable(nodes.select("digest", "node", "least", "_rows"), classes).select("digest", "_rows", "component_id")
    return spread_join(found.select("doc_id", "digest"), by_digest, "digest", heavy).select("doc_id", "component_id")
