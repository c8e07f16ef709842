"""Exact vectors for operators, and round trips for sources and sinks."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.functions.filters import Condition, check_values, compile_filter, depth, parse_filters, visible_to
from lodestone.operators import chunking as C
from lodestone.operators import crawling as K
from lodestone.operators import graphs as G
from lodestone.operators import listing as L
from lodestone.operators import ranges as N
from lodestone.operators import retrieval as R
from lodestone.operators import traces as T
from lodestone.operators import versions as V
from lodestone.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_rrf_of_two_lists(spark):
    lists = [spark.createDataFrame([("d1", 1), ("d2", 2)], "id string, rank int"), spark.createDataFrame([("d2", 1), ("d3", 2)], "id string, rank int")]
    got = {r.id: round(r.score, 4) for r in R.rrf(lists, key=["id"], k=1).collect()}
    assert got == {"d2": 0.8333, "d1": 0.5, "d3": 0.3333}


def test_linear_fusion(spark):
    dense = spark.createDataFrame([("d1", 0.9), ("d2", 0.8), ("d3", 0.1)], "id string, score double")
    sparse = spark.createDataFrame([("d2", 0.9), ("d3", 0.5)], "id string, score double")
    got = {r.id: r.score for r in R.linear(dense, sparse, key=["id"]).collect()}
    assert got["d2"] == 1.0 and got["d3"] == 0.0 and 0 < got["d1"] < 1
    flat = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "id string, score double")
    assert {r.score for r in R.linear(flat, flat, key=["id"]).collect()} == {0.0}


def test_scores(spark):
    assert [one(spark, S.dense_score(F.lit(x).cast("double"))) for x in (0, 1, None)] == [1.0, 0.5, 1.0]
    assert [one(spark, S.sparse_score(F.lit(float(x)))) for x in (0, 1, 3)] == [0.0, 0.5, 0.75]


@pytest.mark.parametrize("bad", [[], "x", [float("nan")], [float("inf")], [True], ["a"], None])
def test_query_vectors(bad):
    with pytest.raises(ValueError):
        R.check_query_vector(bad)
    assert R.check_query_vector([1, 2.5]) == [1.0, 2.5]


@pytest.mark.parametrize("k", [0, 1001])
def test_top_k_bounds(k):
    with pytest.raises(ValueError):
        R.check_top_k(k)


def test_splitter():
    assert C.split_units("a b c d") == ["a ", "b ", "c ", "d"]
    assert C.split_units("aaa\n\nbbb\n\nccc") == ["aaa\n\n", "bbb\n\n", "ccc"]
    assert C.split_units("第一句。第二句。第三句。", ["。"]) == ["第一句。", "第二句。", "第三句。"]
    assert C.split_units("see ![a b](c d) and `x`", [" "], protect=True)[1] == "![a b](c d) "


@given(st.text(alphabet="ab. ,\n$`|", max_size=80), st.booleans())
@settings(max_examples=200, deadline=None)
def test_splitting_loses_nothing(text, protect):
    assert "".join(C.split_units(text, protect=protect)) == text


def plain_units(text, separators=C.SEPARATORS, protect=False):
    """The splitter one character at a time."""
    shut = {k for a, b in (C.protected_ranges(text) if protect else []) for k in range(a, b)}
    units, start, at = [], 0, 0
    while at < len(text):
        sep = next((s for s in sorted(separators, key=len, reverse=True) if text.startswith(s, at)), None)
        at += len(sep or "x")
        if sep and not shut & set(range(at - len(sep), at)):
            units.append(text[start:at])
            start = at
    return units + [text[start:]] * (start < len(text))


def plain_groups(units, size, overlap, length):
    """Packing from its definition: bounds of each group by sums over slices."""
    n, out, start, at = [length(u) for u in units], [], 0, 0
    while at < len(units):
        end = at + 1
        while end < len(units) and sum(n[start : end + 1]) <= size:
            end += 1
        out.append(units[start:end])
        carry = next(c for c in range(start, end + 1) if sum(n[c:end]) <= overlap)
        start = carry if end < len(units) and sum(n[carry : end + 1]) <= size else end
        at = end
    return out


@given(st.text(alphabet="ab. ,\n$`|", max_size=80), st.booleans())
@settings(max_examples=200, deadline=None)
def test_splitter_equals_brute_force(text, protect):
    assert C.split_units(text, protect=protect) == plain_units(text, protect=protect)


@given(st.lists(st.integers(0, 15), max_size=30), st.integers(1, 12), st.integers(0, 11))
@settings(max_examples=300, deadline=None)
def test_packing_equals_brute_force(units, size, overlap):
    assert C.pack_units(units, size, min(overlap, size - 1), lambda n: n) == plain_groups(units, size, min(overlap, size - 1), lambda n: n)


@pytest.mark.parametrize(("name", "size", "overlap"), [("chunk_recursive", 500, 50), ("chunk_token_packing", 128, 16)])
def test_chunk_queries_equal_brute_force(spark, sf_dir, name, size, overlap):
    from lodestone.plans.registry import QUERIES

    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        if name == "chunk_recursive":
            whole = [[u] if len(u) <= size or C.protected_ranges(u) else [u[k : k + size] for k in range(0, len(u), size)] for u in plain_units(r.text or "", protect=True)]
            groups = plain_groups([x for u in whole for x in u], size, overlap, len)
        else:
            groups = plain_groups(plain_units(r.text or ""), size, overlap, lambda u: len(u) // 4)
        chunks = [c for g in groups if (c := "".join(g).strip())]
        want |= {(r.doc_id, k, c) for k, c in enumerate(chunks)}
    got = [tuple(r) for r in QUERIES[name](spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_token_packing_moves_on():
    assert C.pack_units([8, 2, 9], 10, 3, lambda n: n) == [[8, 2], [9]]
    assert C.pack_units([4, 3, 3, 4], 10, 3, lambda n: n) == [[4, 3, 3], [3, 4]]
    assert C.pack_units([20, 1], 10, 3, lambda n: n) == [[20], [1]]
    assert C.pack_units([], 10, 3, lambda n: n) == []


@given(st.lists(st.integers(1, 15), max_size=30), st.integers(1, 12), st.integers(0, 11))
@settings(max_examples=300, deadline=None)
def test_token_packing_covers_all(units, size, overlap):
    groups = C.pack_units(list(enumerate(units)), size, min(overlap, size - 1), lambda u: u[1])
    assert sorted({u for g in groups for u in g}) == list(enumerate(units))
    assert all(sum(n for _, n in g) <= size or len(g) == 1 for g in groups)


def test_recursive_chunks_fit():
    text = "One. Two, three four\n\n" * 20 + "x" * 90
    chunks = C.recursive_chunks(text, 40, 5)
    assert all(0 < len(c) <= 40 for c in chunks) and chunks[0].startswith("One. Two")


@pytest.mark.parametrize(("text", "size", "overlap", "want"), [("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]), ("abc", 4, 1, ["abc"]), ("", 4, 1, []), ("abcde", None, 0, ["abcde"]), ("naïve😀x", 3, 0, ["naï", "ve😀", "x"])])
def test_character_windows(spark, text, size, overlap, want):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.chunk for r in C.fixed_windows(df, size, overlap).orderBy("index").collect()] == want


@pytest.mark.parametrize("args", [(0, 0), (5, 5), (5, -1)])
def test_chunk_parameters(args):
    with pytest.raises(ValueError):
        C.check_chunk_params(*args)


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nx\ny\n## B\n\nz"), (2, "no heading")], "doc_id long, text string")
    got = [(r.doc_id, r.section, r.title, r.body) for r in C.markdown_sections(df).orderBy("doc_id", "section").collect()]
    assert got == [(1, 0, None, "intro"), (1, 1, "A", "x\ny"), (1, 2, "B", "\nz".strip()), (2, 0, None, "no heading")]


def test_url_normalization(spark):
    norm = lambda u: one(spark, S.normalize_url(F.lit(u)))
    assert norm("HTTP://Ex.com:80/a?b=1#f") == "http://ex.com:80/a?b=1"
    assert norm("mailto:x") is None and norm("ftp://a/b") is None
    assert norm("https://User@Ex.com/A") == "https://User@ex.com/A"


def test_links_resolve(spark):
    page = spark.createDataFrame([("http://a.org/x/y", '<a href="z">1</a><A HREF=\'/w#t\'>2</A><a href="#f"></a><a href="mailto:q"></a><a class=k href="http://B.org/">3</a><a href="z">4</a>')], "url string, html string")
    assert {r.target for r in K.links(page).collect()} == {"http://a.org/x/z", "http://a.org/w", "http://b.org/"}


def test_robots():
    assert K.robots_rules("User-agent: a\nUser-agent: b\nDisallow: /x\nDisallow:\n\nUser-agent: *\nDisallow: /y", "b") == ["/x"]
    assert K.robots_rules("User-agent: *\nDisallow: /y", "c") == ["/y"]


PIECES = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", "a|b", " x  y\n", "&amp;", "<b>", "<TD>", ">"]
ROW = st.lists(st.sampled_from(["<td>a|b</td>", "<th> x  y\n</th>", "<td></td>", "<td>1</th>", " "]), max_size=3).map("".join)
TABLES = st.lists(ROW, max_size=3).map(lambda rows: "<table>" + "".join(f"<tr>{r}</tr> " for r in rows) + "</table>") | st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=300)
@given(TABLES)
def test_plain_tables_are_read_as_the_parser_reads_them(html):
    p = K._Rows()
    p.feed(html)
    rows = [r for r in p.rows if r]
    got = K.table_to_markdown(html)
    assert bool(got) == bool(rows)
    if rows:
        cells = [[c.strip() for c in line[1:-1].replace("\\|", "\0").split("|")] for line in got.split("\n")]
        width = max(map(len, rows))
        assert [[c.replace("\0", "\\|") for c in r] for r in (cells[:1] + cells[2:])] == [r + [""] * (width - len(r)) for r in rows]


def test_plain_tables_need_no_parser(monkeypatch):
    monkeypatch.setattr(K, "_Rows", None)
    assert K.table_to_markdown("<table><tr><th>k</th></tr><tr><td>a|b</td><td>2</td></tr></table>") == "| k |  |\n| --- | --- |\n| a\\|b | 2 |"


def test_cleaning():
    html = "<html><head><title> T  1 </title><meta name=description content='d'><meta name=keywords content='k, l'><style>p{}</style></head><body><nav>skip</nav><h1>H</h1><p>a <b>b</b> <a href='/c'>c</a><br>d</p><ul><li>e</li></ul><script>x</script><div class='ad big'>ad</div></body></html>"
    got = K.clean_html(html, ["nav", ".ad"])
    assert got == {"title": "T 1", "meta": "d\nKeywords: k, l", "markdown": "# H\n\na **b** [c](/c)\nd\n\n- e"}
    assert K.clean_html("<h1>Only <i>h</i></h1>")["title"] == "Only h" and K.clean_html(None)["markdown"] == ""
    assert K.clean_html('<meta property="og:title" content="O">')["title"] == "O"
    assert K.table_to_markdown("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>") == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


@pytest.mark.parametrize(
    ("text", "want"),
    [("nine char", "too_short"), ("contains \x00 null bytes here", "null_bytes"), ("x" * 97 + "�" * 3, "replacement_ratio"), ("x" * 60 + "\x01\x02\x03", "control_ratio"), ("Just a moment... please wait", "ok"), ("see /CDN-CGI/challenge-platform/ now", "challenge"), ("the captcha says: access denied", "ok"), ("<title>Just a moment</title> checking your browser", "challenge"), ("plain and readable text", "ok"), (None, "empty"), ("", "empty"), ("x" * 1000 + "�" * 3, "ok")],
)
def test_text_quality(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(K.text_verdict(F.col("t"))).first()[0] == want
    assert df.select(K.text_verdict(F.col("t"), readable=K.readable_count("t"))).first()[0] == want


def test_page_numbers():
    assert L.page_info(41, 3, 20) == {"total": 41, "page": 3, "total_pages": 3, "has_next": False, "has_previous": True}
    assert L.page_info(0, 9, 20)["total_pages"] == 1 and L.clamp(0, 5) == 1 and L.clamp(9, 5) == 5


def test_step_pairing(spark):
    rows = [(1, 7, "start", 0), (2, 7, "start", 5), (3, 7, "end", 9), (4, 8, "end", 1), (5, 9, "start", 2)]
    df = spark.createDataFrame(rows, "id long, task_id long, phase string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.task_id, r.start_id, r.end_id, r.status, r.seconds) for r in T.pair_steps(df, keys=["task_id"], order=["ts", "id"]).collect()}
    assert got == {(7, 2, 3, "completed", 4.0), (9, 5, None, "running", None)}


def test_tenancy(spark):
    df = spark.createDataFrame([(7,), (8,), (None,)], "user_id long")
    assert [df.where(c).count() for c in (visible_to(None, True), visible_to(7), visible_to(None))] == [3, 1, 0]


def test_filters(spark):
    df = spark.createDataFrame([("a%b", 1), ("axb", 2), (None, 3)], "s string, n long")
    count = lambda e: df.where(compile_filter(e)).count()
    assert count(Condition("s", "contains", "a%b")) == 2
    assert count(Condition("s", "eq", None)) == 0 and count(Condition("s", "is_null")) == 1
    assert count([Condition("n", "eq", 1), (Condition("n", "gte", 2), Condition("s", "is_not_null"))]) == 2
    assert count(None) == count(()) == 3
    with pytest.raises(ValueError):
        Condition("n", "in", 5)
    with pytest.raises(ValueError):
        parse_filters({"n": {"operator": "like", "value": 1}})
    with pytest.raises(ValueError):
        compile_filter(Condition("z", "eq", 1), {"n"})
    with pytest.raises(ValueError):
        check_values(Condition("n", "eq", "x"), {"n": "bigint"})
    deep = Condition("n", "eq", 1)
    for _ in range(12):
        deep = [deep]
    assert depth(deep) == 13
    with pytest.raises(ValueError):
        compile_filter(deep)


@pytest.mark.parametrize(("text", "want"), [("1+2*3", 7.0), ("2**3**1", 8.0), ("7/2", 3.5), ("sqrt(9)", 3.0)])
def test_formulas(spark, text, want):
    assert float(one(spark, S.formula(text))) == want


@pytest.mark.parametrize("text", ["__import__('os')", "a + 1", "1; 2", "1 + 'x'"])
def test_formulas_refuse(text):
    with pytest.raises(ValueError):
        S.formula(text)


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("{",), (None,), ('{"a":{"b":[1,{"c":2}]}}',)], "j string")
    assert [r[0] for r in df.select(S.canonical_json("j")).collect()][:3] == ['{"a":"\\u00e9","b":1}', None, None]
    assert [r[0] for r in df.select(S.json_depth("j")).collect()] == [1, None, None, 4]
    deep = spark.createDataFrame([("[" * 5000 + "]" * 5000,), ("[" * 5000 + "}" * 4999,), ('"[[" ',), ('["\\"[{", {"a]": [[]]}, "\\\\"]',), ("7",)], "j string")
    assert [r[0] for r in deep.select(S.json_depth("j")).collect()] == [5000, None, 0, 4, 0]


def test_safe_long_is_exact(spark):
    df = spark.createDataFrame([("9007199254740993",), ("-9223372036854775808",), ("1e3",), ("12.7",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(S.safe_long(F.col("s"))).collect()] == [9007199254740993, -9223372036854775808, 1000, 12, None, None]


def test_strict_long_takes_decimals_and_no_control_characters(spark):
    told = {"5.": 5, ".5": 1, ".4": 0, "7\x01": None, "\x1f7": None, " 7\t": 7, "+1": 1, "-2.5": -3, "9223372036854775807": (1 << 63) - 1, "9223372036854775808": None, ".": None, "1e": None, "": None}
    df = spark.createDataFrame([(t,) for t in [*told, None]], "s string")
    assert {r[0]: r[1] for r in df.select("s", S.strict_long(F.col("s"))).collect()} == {**told, None: None}


@pytest.mark.parametrize(("text", "n", "want"), [("héllo", 2, "h"), ("héllo", 3, "hé"), ("abc", 9, "abc"), ("😀x", 3, "")])
def test_utf8_prefix(spark, text, n, want):
    assert one(spark, S.utf8_prefix(F.lit(text), n)) == want


def test_merge_keeps_creation(spark):
    base = spark.createDataFrame([(1, "a", 10), (None, "n", 11)], "k long, v string, created long")
    new = spark.createDataFrame([(1, "b", 99), (None, "m", 98), (3, "c", 97)], "k long, v string, created long")
    got = {tuple(r) for r in V.merge(base, new, ["k"], keep=["created"]).collect()}
    assert got == {(1, "b", 10), (None, "m", 11), (3, "c", 97)}


def test_cascade_needs_confirmation(spark):
    tables = {t: spark.createDataFrame([(1,), (2,)], "doc_id long") for t in V.CASCADE}
    same = V.cascade(tables, F.col("doc_id") == 1, confirm=True, preview=True)
    assert all(df.count() == 2 for df in same.values())
    gone = V.cascade(tables, F.col("doc_id") == 1, "parse", confirm=True, preview=False)
    assert {t: df.count() for t, df in gone.items()} == {t: 1 if t in V.SCOPES["parse"] else 2 for t in V.CASCADE}
    assert [r.table for r in V.cascade_plan(tables, F.col("doc_id") == 1).orderBy("step").collect()] == list(V.CASCADE)


def test_bad_owner_fails(spark):
    with pytest.raises(Exception, match="not an integer"):
        V.cast_owner(spark.createDataFrame([("x",)], "user_id string")).collect()


def test_plan_problems_of_long_chains(spark):
    """No step of a chain is a cycle, however long the chain."""
    steps = spark.createDataFrame([(k, [k - 1] if k else []) for k in range(12)] + [(100, [101]), (101, [100])], "id long, deps array<long>")
    got = G.plan_problems(steps)
    assert {(r.problem, r.id) for r in got.collect()} == {("cycle", 100), ("cycle", 101)}


def test_unique_names(spark):
    taken = ["A", "a 2", "a 3", "a 5", "b 2", "x 02", "x", "Long name!", "Long nam 2", *(f"n {k}" for k in range(2, 12)), "n", "m", *(f"m {k}" for k in range(2, 100_010))]
    names = spark.createDataFrame([(t,) for t in taken], "name string")
    wanted = spark.createDataFrame([(w,) for w in ("a", "b", "X", "new", "Long name!!", "N", "m")], "wanted string")
    got = {r.wanted: r.name for r in V.unique_name(names, wanted, longest=10).collect()}
    assert got == {"a": "a 4", "b": "b", "X": "X 2", "new": "new", "Long name!!": "Long nam 3", "N": "N 12", "m": "m 100010"}


def test_plan_problems(spark):
    schema = "id string, deps array<string>"
    assert {(r.problem, r.id) for r in G.plan_problems(spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", ["a"]), ("d", []), ("d", ["z"])], schema)).collect()} == {("cycle", "a"), ("cycle", "b"), ("cycle", "c"), ("duplicate", "d"), ("unknown dependency", "d")}
    assert [r.problem for r in G.plan_problems(spark.createDataFrame([], schema)).collect()] == ["empty"]
    assert G.plan_problems(spark.createDataFrame([("a", []), ("b", ["a"])], schema)).count() == 0


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5, 100), ("k", 1, 101), ("j", 9, 102)], "k string, t long, id long")
    right = spark.createDataFrame([("k", 2, 1), ("k", 5, 2), ("k", 6, 3)], "k string, t long, id long")
    assert {(r.id, r.right_id) for r in N.as_of(left, right, by=["k"], on="t", tie="id").collect()} == {(100, 2), (101, None), (102, None)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"é\nb'), (2, None)], "id int, s string")
    for name in ("t.csv", "t.jsonl", "t.parquet"):
        files.export(df, f"file://{tmp_path}/{name}")
    back = files.read_csv_strings(spark, f"file://{tmp_path}/t.csv")
    assert back.dtypes == [("id", "string"), ("s", "string")] and {r.s for r in back.collect()} == {'a,"é\nb', None}
    assert {r.s for r in files.read_json(spark, f"file://{tmp_path}/t.jsonl", df.schema).collect()} == {'a,"é\nb', None}
    assert '"s":null' in "".join(r.value for r in spark.read.text(f"file://{tmp_path}/t.jsonl").collect())
    assert sorted(spark.read.parquet(f"file://{tmp_path}/t.parquet").collect()) == sorted(df.collect())
    assert files.list_files(spark, f"file://{tmp_path}/t.csv", "*.csv").first().extension == "csv"
    with pytest.raises(ValueError):
        files.export(df, "x.bin")


def test_dialects():
    assert [files.dialect(u) for u in ("postgresql+psycopg2://h/d", "SQLite:///x", "mariadb://h", "", "other://h")] == ["postgresql", "sqlite", "mysql", "unknown", "other"]


def workbook(sheets):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{c}{r}"><v>{v}</v></c>' for c, v in row.items()) + "</row>" for r, row in rows.items())
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    rows = {1: {"A": "Title"}, 2: {"A": "name", "B": "age"}, 3: {"A": "Ann", "B": 3}}
    (tmp_path / "a.xlsx").write_bytes(workbook({"One": rows}))
    got = [r.text for r in files.read_workbook_rows(spark, f"file://{tmp_path}").orderBy("row").collect()]
    assert got == ["Title", "name | age", "name: Ann | age: 3"]
    assert [t for _, _, t in files.workbook_rows(workbook({"X": {1: {"A": "h"}}, "Y": {1: {"A": "t"}}}))] == ["[X] h", "[Y] t"]
    assert {r.text for r in files.read_workbook_cells(spark, f"file://{tmp_path}").collect()} >= {"One A1: Title", "One B3: 3"}


def test_reranked_texts(spark):
    results = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, text string")
    texts = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "text string, position int")
    assert [r.id for r in R.map_reranked(texts, results, key=["id"]).collect()] == [1, 2, 3, 4]
    texts = spark.createDataFrame([("c", 0), ("a", 1)], "text string, position int")
    assert [r.id for r in R.map_reranked(texts, results, key=["id"]).collect()] == [4, 1, 2, 3]


def test_top_k_plans_stay_narrow(spark, sf_dir):
    from lodestone.sources.tables import kb_embeddings

    top = R.vector_top_k(kb_embeddings(spark, sf_dir), [0.0] * 64, 5, key=["chunk_id"], where=F.col("model_tag") == "m1")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Python" not in plan


def test_chunks_of_a_few_texts_at_a_time():
    import pyarrow as pa

    texts = ["one two three. " * 30] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts)], names=["k", "t"])
    got = list(C._chunk_batches(iter([batch]), lambda t: C.token_chunks(t, 8)))
    assert len(got) == 5 and all(len(set(b.column(0).to_pylist())) <= 64 for b in got)
    assert [c for b in got for c in b.column(2).to_pylist()] == C.token_chunks(texts[0], 8) * 300
