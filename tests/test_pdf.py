"""PDF files that the tests write give their pages' texts back."""

import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.sources import files
from lodestone.sources.pdf import page_texts


def made(pages, *, deflate=True, packed=False, cmap=False):
    """A file with a tree of two levels; ``packed`` puts all but streams into an object stream."""
    objects, streams, kids = {}, {}, []

    def stream(n, head, body):
        body = zlib.compress(body) if deflate else body
        streams[n] = b"<< %s /Length %d %s >>\nstream\n%s\nendstream" % (head, len(body), b"/Filter /FlateDecode" if deflate else b"", body)

    for k, lines in enumerate(pages):
        show = []
        for line in lines:
            if cmap:
                show.append(b"<%s> Tj T*" % "".join(f"{ord(c):04X}" for c in line).encode())
            else:
                raw = line.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
                show.append(b"(%s) Tj 0 -12 Td" % raw)
        stream(100 + 2 * k, b"", b"BT /F1 12 Tf " + b" ".join(show) + b" ET")
        objects[101 + 2 * k] = b"<< /Type /Page /Parent 3 0 R /Contents [%d 0 R] >>" % (100 + 2 * k)
        kids.append(b"%d 0 R" % (101 + 2 * k))
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[2] = b"<< /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 5 0 R >> >> >>"
    objects[3] = b"<< /Type /Pages /Kids [%s] >> %% all of them" % b" ".join(kids)
    objects[5] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>" if cmap else b"<< /Type /Font /Subtype /Type1 >>"
    stream(6, b"", b"1 beginbfrange <0000> <FFFF> <0000> endbfrange")
    if packed:
        parts, at = [], 0
        for n, o in objects.items():
            parts.append(b"%d %d" % (n, at))
            at += len(o) + 1
        head = b" ".join(parts) + b" "
        stream(7, b"/Type /ObjStm /N %d /First %d" % (len(objects), len(head)), head + b"\n".join(objects.values()))
        objects = {}
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % kv for kv in (objects | streams).items()) + b"\n%%EOF"


LINE = st.text(st.sampled_from("abc ()\\é€<>/%1"), min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(LINE, max_size=4), max_size=4), st.booleans(), st.booleans(), st.booleans())
def test_texts_come_back(pages, deflate, packed, cmap):
    got = list(page_texts(made(pages, deflate=deflate, packed=packed, cmap=cmap)))
    assert got == [(k + 1, "\n".join(p)) for k, p in enumerate(pages)]


def test_steps_and_lines():
    def body(ops):
        return next(page_texts(b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R 2 0 R] >> endobj 3 0 obj << /Contents 4 0 R >> endobj 4 0 obj << /Length 9 0 R >> stream\n" + ops + b"\nendstream"))[1]

    assert body(b"BT [(Wor) 20 (d) -300 (next)] TJ 5 0 Td (!) Tj 0 -9 TD (b\\) \\101\\\nc) ' ET") == "Word next!\nb) Ac"
    assert body(b"1 0 0 1 0 700 Tm (a) Tj 1 0 0 1 9 700 Tm (b) Tj 1 0 0 1 0 688 Tm <63> Tj BI /W 1 ID (x\xff EI (d) Tj") == "ab\ncd"


def test_files_that_cannot_be_read():
    assert list(page_texts(b"")) == list(page_texts(b"no pdf at all (")) == []
    good = made([["x"]])
    assert list(page_texts(good.replace(b"/FlateDecode", b"/LZWDecode"))) == [(1, None)]
    assert list(page_texts(good + b"trailer << /Encrypt 9 0 R >>")) == [(1, None)]
    assert list(page_texts(good[: len(good) // 2])) in ([], [(1, None)], [(1, "x")])


def test_folder_of_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.pdf").write_bytes(made([[f"file {k}"], [], ["end"]]))
    (tmp_path / "other.txt").write_bytes(b"x")
    got = sorted((r.path.rpartition("/")[2], r.page, r.text) for r in files.pdf_pages(spark, f"file://{tmp_path}").collect())
    assert got == [(f"f{k}.pdf", p, t) for k in range(3) for p, t in ((1, f"file {k}"), (2, ""), (3, "end"))]


def test_objects_are_read_once_and_streams_inflated_once(monkeypatch):
    from lodestone.plans.external import _pdf
    from lodestone.sources import pdf

    read = []
    inflate = zlib.decompressobj
    monkeypatch.setattr(pdf.zlib, "decompressobj", lambda: (read.append(1), inflate())[1])
    text = " ".join(f"wörd{k}😀" for k in range(700))
    pages = list(page_texts(_pdf(text)))
    assert " ".join(t for _, t in pages) == text and len(pages) == 3
    assert len(read) == 4  # The pages and the font's map.
