"""PDF files written by the writer, read back, damaged, encrypted and updated."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.sources.pdf import crypto, filters, semantics, tables, writer
from docloom.sources.pdf.content import Interpreter, lines
from docloom.sources.pdf.document import Document, text_string
from docloom.sources.pdf.fonts import CMap, base_char, glyph_char
from docloom.sources.pdf.objects import NUMBER, REFERENCE, WRITTEN, Keyword, Name, Parser, Ref, Stream, Written, blank, references, renumber, write
from docloom.sources.pdf.writer import Builder, copy, import_page, update


def sample(pages=4):
    b = Builder(info={"Title": "Té", "Author": ""}, attachments=[("a.txt", b"hello")], labels=[(0, "r", "", 1), (2, "D", "p-", 5)])
    for i in range(pages):
        b.page(595, 842, 90 if i == 2 else 0)
        b.text(72, 700, f"Page {i + 1} of {pages} (café)", 18)
        b.text(72, 650, "second line")
        b.text(72, 640, "third")
    assert b.link((1, 2, 3, 4), 0) and b.link((5, 6, 7, 8), "http://x.org/a") and not b.link((0, 0, 1, 1), "é") and not b.link((0, 0, 1, 1), "")
    assert b.outline([(0, "One", 0), (1, "Süb", 1), (0, "Two", pages - 1)])
    assert not Builder().outline([(1, "x", 0)])
    return b


def page_text(doc, i):
    run = Interpreter(doc)
    page = doc.pages()[i][1]
    run.run(doc.contents(page), page.get("Resources"))
    return [(x.text, x.block) for x in lines(run.glyphs)]


@pytest.mark.parametrize("options", [{}, {"packed": True}, {"passwords": ("", "owner")}])
def test_round_trip(options):
    doc = Document(sample().finish(**options))
    assert doc.readable and not doc.repaired and not doc.warnings.found and doc.version() == "2.0"
    assert len(doc.pages()) == 4 and doc.rotation(doc.pages()[2][1]) == 90
    assert page_text(doc, 1) == [("Page 2 of 4 (café)", 0), ("second line", 1), ("third", 1)]
    meta = semantics.metadata(doc)
    assert meta["Title"] == "Té" and meta["Author"] == "" and meta["Subject"] is None
    assert [(o["depth"], o["title"], o["page"], o["parent"]) for o in semantics.outline(doc)] == [(0, "One", 0, -1), (1, "Süb", 1, 0), (0, "Two", 3, -1)]
    assert [(x["page"], x["action"], x["target"], x["to_page"]) for x in semantics.links(doc)] == [(3, "GoTo", None, 0), (3, "URI", "http://x.org/a", None)]
    assert [(a["name"], a["size"], semantics.payload(doc, a["num"])) for a in semantics.attachments(doc)] == [("a.txt", 5, b"hello")]
    assert [(r["page"], r["style"], r["prefix"], r["start"]) for r in semantics.label_ranges(doc)] == [(0, "r", "", 1), (2, "D", "p-", 5)]


def test_passwords():
    raw = sample().finish(passwords=("user", "owner"), permissions=-2056)
    doc = Document(raw)
    assert doc.encrypted and not doc.readable and doc.handler.permissions == -2056
    assert [Document(raw).authenticate(p) for p in ("", "wrong", "user", "owner")] == ["none", "none", "user", "owner"]
    doc.authenticate("user")
    assert page_text(doc, 0)[0][0] == "Page 1 of 4 (café)"


def test_old_handlers():
    """Revisions 2 to 4, built from their definitions."""
    for revision, length, method in ((2, 5, "V2"), (3, 16, "V2"), (4, 16, "AESV2")):
        h = crypto.Handler(4 if revision == 4 else revision - 1, revision, length, b"", b"", b"", b"", -44, b"id", True, method, method)
        h.o = crypto.rc4(h._owner_key(b"own"), (b"usr" + crypto.PAD)[:32])
        for i in range(1, 20 if revision >= 3 else 1):
            h.o = crypto.rc4(bytes(c ^ i for c in h._owner_key(b"own")), h.o)
        key = h.file_key(b"usr")
        h.u = h.check_value(key).ljust(32, b"\0")
        levels = []
        for p in ("no", "usr", "own"):
            h.key, h.level = None, "none"
            levels.append(h.authenticate(p))
        assert levels == ["none", "user", "owner"] and h.key == key
        if method == "V2":
            assert h.decrypt(h.decrypt(b"secret", 7, 0, True), 7, 0, True) == b"secret"


def test_ciphers():
    assert crypto.AES(bytes(range(16))).encrypt(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.AES(bytes(range(32))).encrypt(bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    for n in (0, 1, 15, 16, 40):
        assert crypto.cbc_decrypt_prefixed(b"k" * 16, crypto.cbc_encrypt_prefixed(b"k" * 16, b"i" * 16, b"x" * n)) == b"x" * n


def test_update_keeps_the_file_and_copy_keeps_pages():
    raw = sample().finish()
    doc = Document(raw)
    ref, page = doc.pages()[0]
    new = Document(update(doc, {ref.num: page | {"Rotate": 180}}))
    assert new.data.startswith(raw) and new.rotation(new.pages()[0][1]) == 180 and len(new.revisions) == 2 and not new.repaired
    part = Document(copy(doc, [3, 1], packed=True))
    assert [page_text(part, i)[0][0] for i in range(2)] == ["Page 4 of 4 (café)", "Page 2 of 4 (café)"]
    assert len(part.xref) < len(doc.xref)
    whole = Document(copy(doc))
    assert len(whole.pages()) == 4 and semantics.metadata(whole)["Title"] == "Té"


def test_repair():
    raw = sample().finish()
    for damaged in (raw[:-60], b"junk\n" * 20 + raw, raw.replace(b"startxref", b"startxxxx"), raw.replace(b"xref\n0 1", b"xref\nq 1")):
        doc = Document(damaged)
        assert doc.opened and page_text(doc, 3)[0][0] == "Page 4 of 4 (café)"


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 1 << 30), st.sampled_from([False, True]))
def test_hostile_bytes(seed, packed):
    r, raw = random.Random(seed), bytearray(HOSTILE[packed])
    for _ in range(r.randrange(1, 12)):
        at = r.randrange(len(raw))
        if r.random() < 0.3:
            del raw[at : at + r.randrange(1, 60)]
        else:
            raw[at] = r.randrange(256)
    for name, (_, make, needs) in tables.TABLES.items():
        assert isinstance(list(tables._safe(bytes(raw), make, needs, "")), list), name


HOSTILE = {p: sample(2).finish(packed=p) for p in (False, True)}


def test_syntax():
    p = lambda b: Parser(b).parse()
    assert p(b"<</A 1/B[1 0 R(x\\(\\)\\101\\\n)<4 1 4>]/C/N#20x/D --5/E 1.5.2>>") == {"A": 1, "B": [Ref(1, 0), b"x()A", b"AP"[:1] + b"@"], "C": "N x", "D": -5, "E": 1.5}
    assert p(b"(a(b)c)") == b"a(b)c" and p(b"[1 2") == [1, 2] and p(b"99999999999999999999999") == (1 << 63) - 1
    assert p(b"true") is True and p(b"null") is None and isinstance(p(b"BT"), Keyword) and p(b"% note\n7") == 7
    assert Parser(b"[" * 5000).parse() is not None


VALUES = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-(1 << 40), 1 << 40), st.binary(max_size=12), st.text("ab #/é(", max_size=6).map(Name), st.builds(Ref, st.integers(1, 999), st.integers(0, 9))), lambda x: st.one_of(st.lists(x, max_size=4), st.dictionaries(st.text("abc", min_size=1, max_size=3).map(Name), x, max_size=4)), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_objects_round_trip(value):
    assert Parser(write([value])).parse() == [value]
    assert renumber(value, {r.num: r.num for r in references(value)}) == renumber(value, {i: i for i in range(1000)})


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300))
def test_filters(data):
    assert filters.flate(zlib.compress(data))[:2] == (data, True)
    assert filters.ascii_hex(data.hex().encode() + b">") == data
    import base64

    assert filters.ascii85(base64.a85encode(data) + b"~>") == data
    cut = zlib.compress(data)[:-5]
    assert data.startswith(filters.flate(cut)[0])
    runs = b"".join(bytes([0, c]) for c in data) + b"\x80"
    assert filters.run_length(runs) == data
    for f in (filters.lzw, filters.ascii85, filters.ascii_hex, filters.run_length, lambda d: filters.flate(d)[0]):
        assert isinstance(f(data), bytes)
    rows = data[: len(data) // 6 * 6]
    assert filters.predictor(b"".join(b"\0" + rows[i : i + 6] for i in range(0, len(rows), 6)), {"Predictor": 15, "Columns": 6}) == rows


def test_lzw_and_predictors():
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"
    assert filters.png_rows(b"\x01\x01\x01\x01\x02\x01\x01\x01\x03\x01\x01\x01\x04\x01\x01\x01", 3, 1) == bytes([1, 2, 3, 2, 3, 4, 2, 3, 4, 3, 4, 5])
    assert filters.apply(b"x", [("DCTDecode", {}), ("FlateDecode", {})])[:2] == (b"x", "DCTDecode")


def test_text_and_names():
    assert text_string(b"\xfe\xff\x00A\xd8\x34\xdd\x1e") == "A𝄞" and text_string(b"\x80\x18") == "•˘" and text_string(b"\xef\xbb\xbf\xc3\xa9") == "é"
    assert [glyph_char(n) for n in ("A", "eacute", "uni00410042", "u1D11E", "f_i", "fi", "nope", "Scaron.alt")] == ["A", "é", "AB", "𝄞", "fi", "ﬁ", None, "Š"]
    assert base_char("WinAnsiEncoding", 0x80) == "€" and base_char("MacRomanEncoding", 0x8E) == "é" and base_char("StandardEncoding", 0xAE) == "ﬁ"
    m = CMap.parse(b"1 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 1 beginbfchar <41> <0058> endbfchar 2 beginbfrange <8000> <8002> <0061> <8010> <8011> [<0062> <00630064>] endbfrange 1 begincidrange <8000> <8fff> 5 endcidrange")
    assert m.split(b"\x41\x80\x01") == [(0x41, 1), (0x8001, 2)] and m.chars[0x8002] == "c" and m.chars[0x8011] == "cd" and m.cid(0x8003) == 8


def test_marked_content_and_forms():
    b = Builder()
    b.page()
    b.raw(b"/Artifact BMC /Span BMC")
    b.text(10, 700, "running head")
    b.raw(b"EMC EMC q 2 0 0 2 0 0 cm")
    b.text(10, 100, "kept")
    b.raw(b"Q BT /F1 10 Tf 10 50 Td [(a) -2000 (b) -100 (c)] TJ 0 1 -1 0 200 50 Tm (up) Tj ET BI /W 1 ID xx EI")
    assert [t for t, _ in page_text(Document(b.finish()), 0)] == ["kept", "a bc", "up"]


def fields_document():
    b = Builder()
    b.page()
    doc = Document(b.finish())
    n = max(doc.xref)
    text = {"FT": Name("Tx"), "T": b"total", "V": b"5", "DV": b"0", "MaxLen": 9, "AA": {"C": {"S": Name("JavaScript"), "JS": b"AFSimple_Calculate('SUM',['a'])"}}}
    group = {"T": b"g", "FT": Name("Btn"), "Ff": 1 << 15, "Kids": [Ref(n + 3)]}
    choice = {"FT": Name("Ch"), "T": b"c", "Ff": 1 << 17, "Opt": [[b"x", b"Show x"], b"y"], "V": [b"x", b"y"]}
    root = doc.trailer["Root"]
    changed = {n + 1: text, n + 2: group, n + 3: {"T": b"kid", "Parent": Ref(n + 2)}, n + 4: choice, root.num: doc.catalog() | {"AcroForm": {"Fields": [Ref(n + 1), Ref(n + 2), Ref(n + 4)], "CO": [Ref(n + 1)]}, "OCProperties": {"OCGs": [Ref(n + 5), Ref(n + 6)], "D": {"BaseState": Name("OFF"), "ON": [Ref(n + 5)]}}}, n + 5: {"Type": Name("OCG"), "Name": b"one"}, n + 6: {"Type": Name("OCG"), "Name": b"two"}}
    return Document(update(doc, changed)), n


def test_fields_and_layers():
    doc, n = fields_document()
    found = semantics.fields(doc)
    assert [(f["name"], f["kind"], f["value"], f["many"]) for f in found] == [("total", "text", "5", None), ("g.kid", "radio", "Off", None), ("c", "combo", None, ["x", "y"])]
    assert found[0]["calculated"] == 0 and found[0]["max_len"] == 9 and found[2]["options"] == ["Show x", "y"]
    assert [s["place"] for s in semantics.scripts(doc)] == ["field C"]
    states = {x["num"]: x["visible"] for x in semantics.layers(doc)}
    assert states == {n + 5: True, n + 6: False}
    refs = [Ref(n + 5), Ref(n + 6)]
    show = lambda **d: semantics.visible(doc, d, states)
    assert [show(OCGs=refs, P=Name(p)) for p in ("AnyOn", "AllOn", "AnyOff", "AllOff")] == [True, False, True, False]
    assert show(VE=[Name("And"), refs[0], [Name("Not"), refs[1]]]) and not show(VE=[Name("Or"), refs[1]]) and show()


def test_tables(spark):
    files = [("ok", sample().finish()), ("locked", sample().finish(passwords=("u", "o"))), ("not", b"hello"), ("none", None), ("cut", sample().finish()[:1500])]
    df = spark.createDataFrame(files, "doc_id string, content binary")
    rows = {t: tables.read(df, t).collect() for t in tables.TABLES}
    info = {r.doc_id: r for r in rows["documents"]}
    assert len(info) == 5 and info["ok"].n_pages == 4 and info["ok"].metadata == {"Title": "Té", "Author": ""} and not info["not"].opened and info["locked"].encrypted
    assert {r.doc_id for r in rows["text_lines"] if r.text.startswith("Page 1")} >= {"ok"}
    assert [r.title for r in rows["outline"] if r.doc_id == "ok"] == ["One", "Süb", "Two"]
    assert sum(r.doc_id == "ok" for r in rows["glyphs"]) == 4 * len("Page 1 of 4 (café)second linethird")
    opened = tables.read(df.where("doc_id = 'locked'"), "text_lines", password="u")
    assert opened.count() == 12
    hits = tables.search(tables.read(df, "text_lines"), "PAGE").where("doc_id = 'ok'").collect()
    assert [(r.page_index, r.hits) for r in sorted(hits)] == [(0, 1), (1, 1), (2, 1), (3, 1)]


def test_import_page():
    def made(name, **options):
        b = Builder()
        for i in range(3):
            b.page(300 + i, 200, rotate=90 * i)
            b.text(20, 100, f"{name}{i}")
            b.link((1, 1, 9, 9), 0)
            b.link((1, 20, 9, 29), 1)
        b.outline([(0, f"{name} last", 2)])
        b.info = {"Title": name}
        return b.finish(**options)

    doc = Document(made("a"))
    for options, out in (({}, {}), ({"passwords": ("", "owner")}, {"packed": True})):
        source = Document(made("b", **options))
        for index in range(4):
            new = Document(import_page(doc, source, 1, index, **out))
            names = ["a0", "a1", "a2"]
            names.insert(index, "b1")
            assert [[t for t, _ in page_text(new, i)] for i in range(4)] == [[n] for n in names]
            assert new.boxes(new.pages()[index][1])[0] == (0, 0, 301, 200) and new.pages()[index][1]["Rotate"] == 90
            to = {n: [x["to_page"] for x in semantics.links(new) if x["page"] == i] for i, n in enumerate(names)}
            assert to == {n: [names.index("a0"), names.index("a1")] for n in names if n != "b1"} | {"b1": [None, index]}
            assert [(x["title"], x["page"]) for x in semantics.outline(new)] == [("a last", names.index("a2"))] and semantics.metadata(new)["Title"] == "a"
        assert import_page(doc, source, 3, 0) is None and import_page(doc, source, 0, 4) is None and import_page(doc, source, -1, 0) is None


def test_common_tokens_are_read_as_the_long_way_does(monkeypatch):
    """Any bytes give the same objects, positions and warnings whether or not whole tokens are matched first."""
    import random
    import re

    from docloom.sources.pdf import objects

    def read(data, refs):
        p, out = objects.Parser(data), []
        while p.pos < len(data) and len(out) < 50:
            before = p.pos
            item = p.parse(refs=refs)
            out.append((type(item), repr(item), p.pos))
            if p.pos == before:
                break
        return out, p.warnings.found

    r = random.Random(7)
    bits = [b"/Name", b"/A#42", b"/", b"12", b"-3", b"+4", b"0", b"4294967295", b"4294967296", b"99999999999999999999", b"1.5", b"-.5", b"-0.0", b"1e5", b"12 0 R", b"4000000000 0 R", b"7 123456 R", b"5 0 Rx", b"(a)", b"(a(b)\\n)", b"(a\r\nb)", b"(", b"<</K 1", b"<<", b">>", b"[", b"]", b"<41>", b"true", b"null", b"endobj", b"BT", b"%c\n", b" ", b"\n", b"\0", b"\xff"]
    datas = [b"".join(r.choice(bits) + r.choice((b"", b" ", b"\n")) for _ in range(r.randrange(1, 14))) for _ in range(3000)]
    fast = [read(d, refs) for d in datas for refs in (True, False)]
    monkeypatch.setattr(objects, "_TOKENS", [re.compile(rb"(?!)")] * 2)
    assert fast == [read(d, refs) for d in datas for refs in (True, False)]


def test_rows_of_many_files_leave_together(spark):
    """A batch holds the rows of many files."""
    from docloom.sources.pdf import tables
    from docloom.sources.pdf.writer import Builder

    sizes = []

    def file(n):
        b = Builder()
        for k in range(n):
            b.page()
            b.text(50, 700, f"line {k}")
        return b.finish()

    class Files:
        """Runs the pass over batches here, to see what leaves it."""

        dtypes, sparkSession = [("doc_id", "bigint"), ("content", "binary")], spark
        rows = tables.pa.table({"id": [1, 2, 3], "content": [file(1), file(4), b"no file"]}).to_batches()

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            sizes.extend(b.num_rows for b in run(iter(self.rows)))
            return self

        def withColumnRenamed(self, *_):
            return self

    tables.read(Files(), "text_lines")
    assert sizes == [5]


def test_packed_objects_are_read_when_asked_for(monkeypatch):
    """Opening a packed file leaves its objects unread; each is read once, and fonts are made once a document."""
    from docloom.sources.pdf import content, document

    made = []
    monkeypatch.setattr(content, "Font", lambda doc, d, plain=content.Font: made.append(1) or plain(doc, d))
    raw = copy(Document(sample(6).finish()), packed=True)
    doc = Document(raw)
    packed = [n for n, e in doc.xref.items() if e.kind == "packed"]
    assert len(packed) > 10 and sum(n in doc.cache for n in packed) <= 2
    rows = list(tables.TABLES["text_lines"][1](doc))
    assert len(rows) >= 6 and len(made) == 1
    assert {n: doc.get(Ref(n)) for n in packed} == {n: document.Document(raw).get(Ref(n)) for n in packed}


def test_png_rows_guess_by_their_own_type_alone(monkeypatch):
    """Rows of the encoder that aren't of the fifth type don't work out its guess."""
    from docloom.plans import encoders

    calls = []
    monkeypatch.setattr(encoders, "min", lambda *a, **k: calls.append(1) or min(*a, **k), raising=False)
    data = bytes(range(240))
    raw = encoders.png_rows(data, 24, 1, 8)
    assert len(raw) == 250 and [raw[k * 25] for k in range(10)] == [0, 1, 2, 3, 4] * 2 and len(calls) == 2 * 24


def test_plain_objects_are_read_alike():
    whole = [b"<</A [1 -2 3.5 (x) 4 0 R /N null true] /B <</C (a\\(b\\051)>> /D 9>>", b"[[] <<>> (\\101\n)]", b"<</A 1 0 R /B [1 0 R 2 0 0 R]>>", b"[false[1]/a/b]"]
    odd = [b"<</A 1 /A 2>>", b"<</A>>", b"<<1 2>>", b"[1 2", b"[1 >>", b"<</A <41>>>", b"[1 % 2\n3]", b"[12345678901 +5 .5]", b"[(a(b)c)]", b"<</A 1]", b"[1e5]", b"[" * 200 + b"]" * 200, b"[foo]"]
    for raw in whole + odd:
        for refs in (True, False):
            short, long = Parser(raw + b" /after"), Parser(raw + b" /after")
            found = long._dict(0, refs) if raw.startswith(b"<<") else long._array(0, refs)
            assert repr(short.parse(refs=refs)) == repr(found) and short.pos == long.pos and short.warnings == long.warnings, raw
            if raw in whole and refs:
                assert repr(Parser(raw)._plain(refs)) == repr(found)


def test_tables_of_references_go_by_sections():
    objects = {n: {"N": n} for n in range(1, 301)} | {300: {"Type": Name("Catalog")}}
    raw = writer.rewrite(objects, {"Root": Ref(300)})
    assert b"xref\n0 301\n0000000000 65535 f \n0000000015 00000 n \n" in raw
    assert [n for n, _ in Document(raw).all_entries] == list(range(301)) and not Document(raw).repaired
    new = Document(writer.update(Document(raw), {3: {"N": 0}, 4: {"N": 1}, 9: None}))
    assert [n for n, e in new.all_entries if e.revision == 0] == [3, 4, 9] and new.get(Ref(4)) == {"N": 1} and new.get(Ref(9)) is None
    # Lines that aren't 20 bytes long are read one by one.
    short = raw.replace(b" n \n", b" n\n").replace(b" f \n", b" f\n")
    assert Document(short).xref == Document(raw).xref and not Document(short).repaired


def test_blanks():
    form = blank({"A": [NUMBER, REFERENCE], "B": b"100% (\x00d)", "C": WRITTEN})
    value = {"A": [5, Ref(2)], "B": b"100% (9)", "C": b"\0)"}
    assert form % (5, 2, 9, write(b"\0)")) == write(value)
    for packed in (False, True):
        plain = writer.rewrite({1: {"Type": Name("Catalog"), "A": Ref(2)}, 2: value}, {"Root": Ref(1)}, packed=packed)
        assert writer.rewrite({1: Written(write({"Type": Name("Catalog"), "A": Ref(2)})), 2: Written(write(value))}, {"Root": Ref(1)}, packed=packed) == plain
    with pytest.raises(ValueError):
        writer.rewrite({1: {"Type": Name("Catalog")}, 3: Written(b"1")}, {"Root": Ref(1)})


def test_shapes_read_what_the_long_way_reads():
    from docloom.sources.pdf import objects

    make = [
        lambda n: b"<</Type /X /Kids [%d 0 R %d 0 R]/A %d/B[%d -%d 0.5 (s%d) null]/C<</D true/E[]/F<<>>>>>>" % (n, n + 1, n, n, n, n),
        lambda n: b"<</Type /X /Kids [%b]/A 1>>" % b" ".join([b"%d 0 R" % i for i in range(n)]),
        lambda n: b"[%d %d 0 R/Fit]" % (n, n) + b" " * (n % 3),
        lambda n: b"<</T (%d)/V %b>>" % (n, (b"1", b"1.5", b"1 0 R", b"1 1 R", b"(x)", b"[1]", b"[]", b"(a\\))", b"/N", b"/N1", b"null", b"12345678901")[n % 12]),
    ]
    for n in range(80):
        for raw in (f(n) for f in make):
            short, long = Parser(raw + b" 0 R"), Parser(raw + b" 0 R")
            assert repr(short.parse()) == repr(long._dict(0, True) if raw.startswith(b"<<") else long._array(0, True)), raw
            assert short.pos == long.pos
    assert any(found for _, found in objects._shapes.values())


def test_strings_are_placed_as_their_glyphs_one_by_one():
    class OneByOne(Interpreter):
        def on_glyph(self, glyph):
            self.glyphs.append(glyph)

    b = Builder(programs={"M": {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("X"), "FirstChar": 32, "Widths": list(range(300, 395))}})
    b.page()
    b.raw(b"q 0.3 -2 1.7 0.9 3 -0 cm BT /M 7.3 Tf 1.1 Tw -0.4 Tc 83 Tz 2 Ts 5 100 Td (ab c) Tj [(de) 300 (f g)] TJ 0.6 0.8 -0.8 0.6 9 9 Tm (hij) Tj ET Q")
    b.raw(b"BT /F1 12 Tf 50 700 Td (plain text) Tj -30 -40 Td (under it) Tj 1 0 0.2 1 50 600 Tm (slanted) Tj 1 0 0 1 95 600 Tm (on) Tj (wards) Tj ET")
    b.raw(b"BT /M 1e9 Tf 99999999999 0 0 99999999999 0 0 Tm (xyz) Tj /F1 0 Tf (zero) Tj ET")
    doc = Document(b.finish())
    page = doc.pages()[0][1]
    runs = [Interpreter(doc), OneByOne(doc)]
    for run in runs:
        run.run(doc.contents(page), page["Resources"])
    assert repr(runs[0].glyphs) == repr(runs[1].glyphs) and len(runs[0].glyphs) > 40
    assert repr(runs[0].tm) == repr(runs[1].tm)


def test_words_are_read_alike():
    raw = b"% note\n BT true/A Tj*null% end\r' \" T*[f*]-abc 5x"
    p = Parser(raw)
    found = [p.parse(refs=False) for _ in range(12)]
    assert [(type(x).__name__, x) for x in found[:8]] == [("Keyword", "BT"), ("bool", True), ("Name", "A"), ("Keyword", "Tj*null"), ("Keyword", "'"), ("Keyword", '"'), ("Keyword", "T*"), ("list", [])]
    assert found[8] == 0 and found[9] == 5 and found[10] == "" and p.warnings.found == {"stray word": 1, "number": 3}
    # Operators come up again and again, and are made once; long words aren't kept.
    assert Parser(b" BT").parse() is Parser(b"BT").parse() and Parser(b"w" * 40).parse() == "w" * 40


def test_shapes_have_arrays_of_any_length():
    from docloom.sources.pdf import objects

    make = [
        lambda n: b"<</Limited [(a) (b)] /Names [%b]>>" % b" ".join([b"(k%d) [%d 0 R /Fit]" % (i, i) for i in range(n % 23)]),
        lambda n: b"<</Filed /Y /Names [%b] /Kids [%b] /S (f\\(%d\\);)>>" % (b" ".join([b"(k%d) %d 0 R" % (i, i) for i in range(n % 19)]), b" ".join([b"%d 0 R" % i for i in range(n % 17)]), n),
    ]
    for n in range(80):
        for raw in (f(n) for f in make):
            short, long = Parser(raw), Parser(raw)
            assert repr(short.parse()) == repr(long._dict(0, True)) and short.pos == long.pos
    # One shape reads them all, but for what an array that is empty or not tells apart.
    assert all(0 < len(found) <= 3 and read <= 12 for key, (read, found) in objects._shapes.items() if key.startswith((b"<</Limited", b"<</Filed")))


def test_entries_are_read_when_asked_for():
    raw = writer.rewrite({n: {"N": n} for n in range(1, 301)} | {301: {"Type": Name("Catalog")}}, {"Root": Ref(301)})
    doc = Document(raw)
    assert doc.catalog() == {"Type": "Catalog"} and doc.get(Ref(7)) == {"N": 7} and not doc._xref
    assert len(doc.xref) == 302 and doc.get(Ref(300)) == {"N": 300}
    new = Document(writer.update(Document(raw), {7: {"N": 70}, 8: None}))
    assert [new.get(Ref(n)) for n in (6, 7, 8)] == [{"N": 6}, {"N": 70}, None] and not new._xref
    assert new.xref[7].revision == 0 and new.xref[8].kind == "free" and new.xref[6].revision == 1
    assert [e.revision for n, e in new.all_entries if n == 7] == [0, 1]


def test_an_account_is_filled_in_and_a_row_a_slice():
    import pyarrow as pa

    from docloom.plans import fixtures, pdf_queries

    for n in range(1, 40):
        orders = [{"o_orderkey": 7 * n + k, "o_orderpriority": f"{k % 5}-(P", "o_orderstatus": "O"} for k in range(n)]
        for packed in (0, 1):
            doc = Document(pdf_queries.account({"doc_id": 2 * n + packed, "rows": orders}))
            assert not doc.repaired and not doc.warnings.found and len(doc.pages()) == n
            assert all(v is not None for _, _, v in doc.objects())
            assert [r["title"] for r in semantics.outline(doc)][::2] == [f"Order {7 * n + k}" for k in range(n)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "rows": [{"k": j, "p": str(j)} for j in range(i % 4)]} for i in range(40)])
    assert fixtures._rows(batch) == batch.to_pylist() and fixtures._rows(batch.slice(5, 9)) == batch.slice(5, 9).to_pylist()
