"""Personal data: fixed detectors, and bootstrapped contextual extraction of what they miss (operator 9)."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import ids_side, materialize, prepare

#: The kinds in their order, and the characters and forms of each.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]").search
#: Unseen identifiers up to this number are sent to the workers of a masking pass as a set; more are joined.
SENT_IDENTIFIERS = 200_000
#: What may be an identifier that the detectors miss: a number of 6 to 19 digits, or a name at a host.
NUMBER = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){5,18}(?![A-Za-z0-9])").search
HOST = re.compile(r"[A-Za-z0-9-]+").match
TOKEN = re.compile(r"\w{1,64}|[^\w\s]{1,64}").findall
SPACE = " \t\n\r\x0b\x0c"
WORD_LENGTH = 64


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the fixed detectors in code points, by start and then kind.

    Each kind is matched leftmost and without overlaps; a match that fails its test is dropped.  An
    address is found from its @, since its local part is the run of characters before it; other
    patterns can't restart inside a run that failed, so the work is linear in the text.
    """
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        host, start = DOMAIN(text, at + 1), at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if host and start < at:
            found.append((start, 0, host.end()))
            free = host.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT(text):
        for m in IP.finditer(text) if text.count(".") > 2 else ():
            if all(int(x) <= 255 for x in m[0].split(".") if len(x.lstrip("0")) < 4) and all(len(x.lstrip("0")) < 4 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def hint_kind(token: str) -> str:
    """The one kind that an unseen identifier could be, by its form."""
    if "@" in token:
        return "email"
    if re.fullmatch(r"[0-9]+(\.[0-9]+){2,}", token):
        return "ip"
    return "card" if sum(c.isdigit() for c in token) >= 14 else "phone"


def tokens_of(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """The lowered words and runs of punctuation of a text, each place (spans by start; overlapping ones are one) being one token; where each span's is."""
    tokens, at, free, k = [], [], 0, 0
    while k < len(spans):
        start, end, first = spans[k][0], spans[k][1], k
        while k < len(spans) and (k == first or spans[k][0] < end):
            end, k = max(end, spans[k][1]), k + 1
        tokens += TOKEN(text[free:start].lower())
        at += [len(tokens)] * (k - first)
        tokens.append("".join(text[start:end].lower().split())[:WORD_LENGTH])
        free = end
    return tokens + TOKEN(text[free:].lower()), at


def patterns_at(tokens: list[str], k: int) -> list[str]:
    """Lexical patterns of a place: the token before, the two before, those on both sides."""
    out = []
    if k:
        out.append(f"1 {tokens[k - 1]}")
        if k > 1:
            out.append(f"2 {tokens[k - 2]} {tokens[k - 1]}")
        if k + 1 < len(tokens):
            out.append(f"3 {tokens[k - 1]} {tokens[k + 1]}")
    return out


def places_in(text: str) -> list[tuple[int, int, str, bool]]:
    """``start, end, kind, seed`` of the fixed detectors' spans and the hints, by start."""
    spans = base_spans(text)
    return sorted([(a, b, k, True) for a, b, k in spans] + [(a, b, k, False) for a, b, k in hints(text, spans)], key=lambda x: x[:2])


def hint_places(text: str) -> Iterator[tuple[int, int]]:
    """Where unseen identifiers may be, from left to right and without overlaps: whole names at whole hosts, however long, and numbers."""
    at = free = 0
    named: tuple[int, int] | None = None
    number = NUMBER(text) if DIGIT(text) else None
    while True:
        while named is None and (at := text.find("@", max(at, free))) >= 0:
            host, start = HOST(text, at + 1), at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if host and start < at:
                named = (start, host.end())
            at += 1
        at = len(text) if at < 0 else at
        if named is None and number is None:
            return
        if number is None or (named is not None and named[0] <= number.start()):
            found = named
        else:
            found = number.span()
        yield found
        free = found[1]
        if named is not None and named[0] < free:
            # A name that the number took the start of begins anew after it.
            at, named = (max(at - 1, free), None) if found != named else (free, None)
        if number is not None and number.start() < free:
            number = NUMBER(text, free)


def hints(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Places that look like identifiers and overlap no span."""
    taken, k = sorted((a, b) for a, b, _ in spans), 0
    if "@" not in text and not DIGIT(text):
        return
    for a, b in hint_places(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if all(y <= a for _, y in itertools.takewhile(lambda t: t[0] < b, itertools.islice(taken, k, None))):
            yield a, b, hint_kind(text[a:b])


_PLACE = "struct<start:int,end:int,kind:string,token:string,seed:boolean,patterns:array<string>>"
_ARROW_PLACE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("token", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])
#: Texts looked at together in a worker.
ROWS = 512


def _described(text: str) -> list[dict]:
    """The places of a text with their tokens and patterns, seeds first."""
    found = places_in(text)
    if not found:
        return []
    tokens, at = tokens_of(text, [x[:2] for x in found])
    made = [{"start": a, "end": b, "kind": k, "token": text[a:b].lower(), "seed": s, "patterns": patterns_at(tokens, i)} for (a, b, k, s), i in zip(found, at, strict=True)]
    return sorted(made, key=lambda p: (not p["seed"], p["start"], KINDS.index(p["kind"])))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _scanned(src: DataFrame, text_at: int) -> DataFrame:
    """``src`` and ``places`` of the texts in the column at this position; ``row`` numbers the rows once this is written."""
    names = src.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            places = [_described(x or "") for x in piece.column(text_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(places, pa.list_(_ARROW_PLACE))], names=[*names, "places"])

    schema = T.StructType([*src.schema.fields, T.StructField("places", T._parse_datatype_string(f"array<{_PLACE}>"))])
    return src.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, places, row`` of whole texts: ``places`` are the fixed detectors' spans (``seed``) and the hints.

    ``row`` is a number of the row's own; write the table before it is joined by it.
    """
    prepare(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _scanned(src, 1).drop("text")


class _Hashes(dict):
    """Words' 64-bit hashes, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _pattern_bits(form: int, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Where in a filter of so many bits (a power of two) patterns of two words' hashes lie."""
    x = (a * np.uint64(0xBF58476D1CE4E5B9)) ^ ((b + np.uint64(form)) * np.uint64(0x94D049BB133111EB))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def _pattern_filter(patterns: DataFrame) -> np.ndarray:
    """A bit table that has a bit of each pattern: 16 bits a pattern, up to 8 MB whatever their number."""
    bits = 1 << min(26, max(18, (16 * patterns.count() - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            found = []
            for p in batch.column(0).to_pylist():
                words = p[2:].split(" ")
                a, b = (np.array([hashes[w]], np.uint64) for w in (words[0], words[-1]))
                found.append(int(_pattern_bits(int(p[0]), a, b, bits)[0]))
            yield pa.RecordBatch.from_pydict({"bit": pa.array(found, pa.int64())})

    placed = patterns.mapInArrow(run, "bit long").groupBy(F.shiftright("bit", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in placed.collect():
        table[r.block * 4096 : (r.block + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return table


def count_patterns(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """``pattern, total``: how often each of ``patterns`` (a written table of one column) occurs in the whole texts, whatever stands in it.

    The texts are cut into tokens as :func:`scan` does it, so a place in a pattern is one of the pattern's occurrences.
    Workers count what passes a bit table of the patterns, so some rows are of other patterns: join with the wanted ones.
    """
    prepare(docs.sparkSession)
    table = _pattern_filter(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        hashes = _Hashes()
        for batch in batches:
            for text in itertools.chain.from_iterable(x.column(0).to_pylist() for x in _pieces([batch])):
                words, _ = tokens_of(text or "", [x[:2] for x in places_in(text or "")])
                h = np.fromiter(map(hashes.__getitem__, words), "<u8", len(words))
                for form, apart in ((1, 0), (2, 1), (3, 2)):
                    at = _pattern_bits(form, h[: max(0, len(h) - apart)], h[apart:], len(table) * 8)
                    for k in np.flatnonzero(table[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                        total[f"{form} {words[k]} {words[k + apart]}" if apart else f"1 {words[k]}"] += 1
                if len(total) > 50_000:
                    yield pa.RecordBatch.from_pydict({"pattern": list(total), "n": list(total.values())})
                    total = Counter()
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pattern string, n long")
    return counted.groupBy("pattern").agg(F.sum("n").alias("total"))


def bootstrap(docs: DataFrame, scanned: DataFrame, *, rounds: int = 3, min_instances: int = 3, min_confidence: float = 0.6, smoothing: float = 1.0, text_col: str = "text") -> DataFrame:
    """``token, kind`` of identifiers that only their contexts give away.

    Patterns are induced by the seeds: those in which at least ``min_instances`` distinct seeds of a
    kind stand, however many they are.  All their occurrences in the corpus are
    counted, so a pattern made of everyday words has a low confidence.  Then, in rounds over the graph of
    patterns and instances: a pattern's confidence is the summed score of what stands in it over its
    occurrences plus ``smoothing``; an unseen instance's score is the noisy-or of the confidences of
    its trusted patterns.  Seeds keep the score 1.
    """
    at = scanned.select(F.explode("places").alias("p")).select("p.kind", "p.token", "p.seed", F.explode("p.patterns").alias("pattern"))
    graph = materialize(at.groupBy("pattern", "kind", "token", "seed").agg(F.count("*").alias("n")), "pattern-graph")
    induced = graph.where("seed").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_instances)
    induced = materialize(induced, "patterns")
    if induced.isEmpty():
        return graph.select("token", "kind").limit(0)
    wanted = materialize(induced.select("pattern").distinct(), "wanted-patterns")
    totals = materialize(count_patterns(docs, wanted, text_col).join(wanted, "pattern", "left_semi"), "pattern-totals")
    graph = materialize(graph.join(induced.select("pattern", "kind"), ["pattern", "kind"]).join(totals, "pattern"), "pattern-graph")
    score = graph.select("token", "kind", "seed", F.col("seed").cast("double").alias("score")).distinct()
    for _ in range(rounds):
        trust = graph.join(score, ["token", "kind", "seed"]).groupBy("pattern", "kind").agg(F.least(F.sum(F.col("score") * F.col("n")) / (F.max("total") + smoothing), F.lit(1.0)).alias("confidence"))
        trust = trust.where(F.col("confidence") >= min_confidence)
        new = graph.where("not seed").join(trust, ["pattern", "kind"]).groupBy("token", "kind").agg((1 - F.product(1 - F.col("confidence"))).alias("score"))
        seeds = graph.where("seed").select("token", "kind").distinct()
        score = materialize(seeds.select("token", "kind", F.lit(True).alias("seed"), F.lit(1.0).alias("score")).unionByName(new.select("token", "kind", F.lit(False).alias("seed"), "score")), "instance-scores")
    return score.where(~F.col("seed") & (F.col("score") >= min_confidence)).select("token", "kind")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: ``doc_id, base, spans``, arrays of ``start, rank, end, kind`` in order.

    ``base`` holds the fixed detectors' spans, ``spans`` also what :func:`bootstrap` discovers.
    Offsets are code points of the whole text.  A null or empty text has none; equal texts have equal
    spans; null ids are carried; repeated rows come out as often as they come in; an empty table gives no rows.
    What is discovered is joined by a number of each row, so copies of a text meet in no task.
    """
    scanned = materialize(scan(docs, id_col=id_col, text_col=text_col), "places")
    unseen = materialize(bootstrap(docs, scanned, text_col=text_col, **options), "unseen")
    return _with_spans(scanned, unseen).select("doc_id", "base", "spans")


def _with_spans(scanned: DataFrame, unseen: DataFrame) -> DataFrame:
    """A written scan with ``base`` and ``spans`` in the place of ``places``."""
    places = scanned.select("row", F.explode(F.filter("places", lambda p: ~p["seed"])).alias("p")).select("row", "p.start", "p.end", "p.kind", "p.token")
    more = places.join(ids_side(unseen, SENT_IDENTIFIERS), ["token", "kind"]).groupBy("row").agg(F.collect_list(_span(F.struct("start", "end", "kind"))).alias("_more"))
    base = F.transform(F.filter("places", lambda p: p["seed"]), _span)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    out = scanned.withColumn("base", base).join(more, "row", "left")
    return out.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("_more", none)))).drop("row", "places", "_more")


def _span(p: F.Column) -> F.Column:
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), p["kind"]).cast("int")
    return F.struct(p["start"].alias("start"), rank.alias("rank"), p["end"].alias("end"), p["kind"].alias("kind"))


def joined(spans: F.Column) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span (by start) replaced by its kind; overlapping spans give one replacement."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, *, text_col: str = "text", sent: int = SENT_IDENTIFIERS, **options) -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets; overlapping spans give one replacement.

    One pass finds places, one counts patterns, and one masks texts where they lie: up to ``sent`` unseen
    identifiers go to the workers as a set, and texts aren't shuffled.  If there are more, the spans that they give are joined
    to the written rows by row number.  Null and empty texts stay as they are; rows with null ids and repeated rows are
    masked like others; other columns are carried, whatever their names; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    text_at = docs.columns.index(text_col)
    own = [f"c{k}" for k in range(len(docs.columns))]
    src = docs.toDF(*own).withColumn(own[text_at], F.col(own[text_at]).cast("string"))
    scanned = materialize(_scanned(src.select(own[text_at]), 0).select("places", "row") if sent else _scanned(src, text_at), "places")
    unseen = materialize(bootstrap(src, scanned, text_col=own[text_at], **options), "unseen")
    found = unseen.limit(sent + 1).collect() if sent else []
    if sent and len(found) <= sent:
        known = {(r.token, r.kind) for r in found}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in _pieces(batches):
                columns = list(piece.columns)
                texts = columns[text_at].to_pylist()
                spans = [[(a, b, k) for a, b, k, seed in (places_in(x) if known else ((*y, True) for y in base_spans(x))) if seed or (x[a:b].lower(), k) in known] if x else [] for x in texts]
                columns[text_at] = pa.array([masked(x, y) if y else x for x, y in zip(texts, spans, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=own)

        return src.mapInArrow(run, src.schema).toDF(*docs.columns)
    if sent:
        scanned = materialize(_scanned(src, text_at), "places")
    spanned = _with_spans(scanned, unseen).drop("base")

    def of_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            columns = list(piece.columns)
            pairs = zip(columns[text_at].to_pylist(), columns[-1].to_pylist(), strict=True)
            columns[text_at] = pa.array([masked(x, [(s["start"], s["end"], s["kind"]) for s in y]) if x and y else x for x, y in pairs], pa.string())
            yield pa.RecordBatch.from_arrays(columns[:-1], names=own)

    return spanned.select(*own, "spans").mapInArrow(of_spans, src.schema).toDF(*docs.columns)
