"""Scalar functions as column expressions; Python only where no built-in has the semantics."""

from __future__ import annotations

import ast
import json
import operator
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def model_tag(model: Column) -> Column:
    """Lower-case slug; an organisation before the first slash is upper-cased and put before the rest."""
    at = F.instr(model, "/")
    with_org = F.concat(F.upper(slug(F.substring(model, F.lit(1), at - 1))), F.lit("_"), slug(F.substring(model, at + 1, F.length(model))))
    return F.when(at > 0, with_org).otherwise(slug(model))


def safe_id(c: Column, longest: int = 64) -> Column:
    """Letters, digits, _ and -; runs of _ as one, none at the ends; a digest where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]", "_"), "_+", "_")
    t = F.regexp_replace(F.substring(F.regexp_replace(t, "^_+|_+$", ""), 1, longest), "_+$", "")
    return F.when(F.length(t) > 0, t).otherwise(F.substring(F.sha2(c.cast("binary"), 256), 1, 8))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1)


def utf8_prefix(c: Column, n: int) -> Column:
    """The longest prefix of whole characters within n bytes."""
    raw = F.encode(c, "UTF-8")
    cuts = [F.substring(raw, 1, n - k) for k in range(4)]
    return F.when(F.length(raw) <= n, c).otherwise(F.coalesce(*(F.when(F.is_valid_utf8(x.cast("string")), x.cast("string")) for x in cuts)))


def owner_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"/user_(\d+)(?:/|$)", 1).try_cast("long")


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def document_id(collection: Column, path: Column) -> Column:
    """The same id for the same place."""
    return F.concat(safe_id(stem(path), 40), F.lit("_"), F.substring(F.sha2(F.concat_ws("|", collection, path).cast("binary"), 256), 1, 8))


@F.pandas_udf(T.StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys, compact and escaped to ASCII (``to_json`` doesn't escape); null where invalid."""

    def one(s):  # noqa: ANN001, ANN202
        try:
            return json.dumps(json.loads(s), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        except (TypeError, ValueError):
            return None

    return values.map(one)


_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)


@F.pandas_udf(T.IntegerType())
def json_depth(values: pd.Series) -> pd.Series:
    """How deep arrays and objects are nested, 0 for a bare value; null where invalid.

    Brackets outside texts are counted, so no depth is too great; of texts too deep for the parser only the brackets are checked.
    """

    def one(s):  # noqa: ANN001, ANN202
        try:
            json.loads(s)
        except RecursionError:
            pass
        except (TypeError, ValueError):
            return None
        bare = _QUOTED.sub("", s)
        depth = list(accumulate(1 if c in "[{" else -1 for c in bare if c in "[]{}"))
        return max(depth, default=0) if not depth or (depth[-1] == 0 and min(depth) >= 0) else None

    return values.map(one).astype("Int32")


def step_hash(kind: str, params: Column) -> Column:
    """Digest of a step's parameters as JSON text, whatever the order of their keys."""
    return F.sha2(F.concat_ws("|", F.lit(kind), canonical_json(params)).cast("binary"), 256)


def json_field(doc: Column, path: str) -> Column:
    """A field of a JSON text, after NULs are gone."""
    return F.get_json_object(F.regexp_replace(doc, "\\\\u0000|\\x00", ""), f"$.{path}")


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, port and user kept, no fragment; null unless http or https."""
    form = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)"
    scheme, place, rest = (F.regexp_extract(F.trim(url), form, k) for k in (1, 2, 3))
    user = F.regexp_extract(place, "^(.*@)", 1)
    host = F.lower(F.regexp_replace(place, "^.*@", ""))
    return F.when(F.lower(scheme).isin("http", "https") & (host != ""), F.concat(F.lower(scheme), F.lit("://"), user, host, rest))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


@F.pandas_udf(T.StringType())
def resolve_url(bases: pd.Series, links: pd.Series) -> pd.Series:
    """Absolute form of a link on a page."""
    from urllib.parse import urljoin

    def one(base, link):  # noqa: ANN001, ANN202
        try:
            return urljoin(base or "", link or "")
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(bases, links, strict=True)], dtype=object)


def dense_score(squared: Column) -> Column:
    return 1.0 / (1.0 + F.coalesce(squared, F.lit(0.0)))


def sparse_score(s: Column) -> Column:
    return s / (1.0 + s)


def min_max(c: Column, over, flat: Column | None = None) -> Column:
    """Scaled to 0..1 over a window; ``flat`` (0 by default) where all are equal."""
    low, high = F.min(c).over(over), F.max(c).over(over)
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(0.0) if flat is None else flat)


def seconds_between(a: Column, b: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / 1e6


def safe_long(c: Column, default: int | None = None) -> Column:
    text = c.cast("string")
    return F.coalesce(text.try_cast("long"), text.try_cast("double").try_cast("long"), F.lit(default).cast("long"))


def strict_long(c: Column) -> Column:
    """A text that is a whole or decimal number as a long, rounded half away from zero; null for any other.

    Only blanks, tabs and line ends around the number are left out, where a plain cast leaves out all control characters too.
    """
    text = F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", "")
    number = F.when(text.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"), text)
    return F.coalesce(number.try_cast("long"), F.round(number.try_cast("decimal(38,18)")).try_cast("long"))


def to_timestamp(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c), F.timestamp_seconds(c.try_cast("double")))


#: Functions that a formula may use.
MATH = {"sqrt", "sin", "cos", "tan", "exp", "log", "log10", "abs", "floor", "ceil", "pow", "round"}
_ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: F.pow}


def formula(text: str) -> Column:
    """Arithmetic over numbers and the named functions, as a double; anything else is an error."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in MATH and not node.keywords:
            return F.call_function(node.func.id, *map(build, node.args))
        raise ValueError("not a formula")

    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError:
        raise ValueError("not a formula") from None
    return build(tree.body)


def find_replace(c: Column, pattern: str, replacement: str, *, regex: bool = False, ignore_case: bool = False) -> tuple[Column, Column]:
    """The text after replacement, and how many matches there were."""
    form = pattern if regex else re.escape(pattern)
    form = ("(?i)" if ignore_case else "") + form
    quoted = replacement if regex else replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, form, quoted), F.regexp_count(c, F.lit(form))
