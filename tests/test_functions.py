"""Column functions on rows made up for them."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.functions import bytes as by
from docloom.functions import colour, dates, geometry, maps, numbers
from docloom.functions import text as tx
from docloom.operators import grouping


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_labels(spark):
    want = {0: "", -3: "", 1: "i", 4: "iv", 9: "ix", 14: "xiv", 40: "xl", 90: "xc", 400: "cd", 1999: "mcmxcix", 3888: "mmmdccclxxxviii"}
    rows = spark.createDataFrame([(k,) for k in want], "n int")
    assert {r.n: r.r for r in rows.select("n", tx.roman(F.col("n")).alias("r")).collect()} == want
    assert one(spark, a=tx.letters(F.lit(1)), b=tx.letters(F.lit(26)), c=tx.letters(F.lit(27)), d=tx.letters(F.lit(54)), e=tx.letters(F.lit(0)), f=F.length(tx.letters(F.lit(10_000))), g=F.length(tx.roman(F.lit(200_000)))) == ("a", "z", "aa", "bbb", "", 64, 100)
    assert one(spark, a=tx.base_letters(F.lit(27)), b=tx.base_letters(F.lit(28)), c=tx.base_letters(F.lit(702)), d=tx.base_letters(F.lit(703))) == ("aa", "ab", "zz", "aaa")
    assert one(spark, a=tx.list_marker(F.lit("lower-roman"), F.lit(4)), b=tx.list_marker(F.lit("upper-alpha"), F.lit(28)), c=tx.list_marker(F.lit("disc"), F.lit(1)), d=tx.list_marker(F.lit("none"), F.lit(1))) == ("iv.", "AB.", "•", "")


def test_search(spark):
    cases = [("aaaa", "aa", 2), ("Σας ΣΑΣ", "σασ", 1), ("", "x", 0), ("abc", "", 0), ("The the THE", "the", 3)]
    for text, needle, want in cases:
        assert one(spark, n=tx.hit_count(F.lit(text), needle)).n == want, (text, needle)
    spans = one(spark, s=tx.hit_spans(F.lit("xAAyaaa"), "aa")).s
    assert [(s.start, s.end) for s in spans] == [(1, 3), (4, 6)]
    assert one(spark, s=tx.hit_spans(F.lit("x.y"), "."), t=tx.hit_spans(F.lit("xyz"), ".")) == ([(1, 2)], [])


def test_text(spark):
    assert one(spark, w=tx.words(F.lit("  Don't\tSTOP -- 3.5 é! "))).w == ["dont", "stop", "35", "é"]
    assert one(spark, a=tx.is_rtl(F.lit("שלום x")), b=tx.is_rtl(F.lit("abc שלום")) , c=tx.is_rtl(F.lit("12"))) == (True, True, False)
    assert one(spark, a=tx.one_line(F.lit(" a\nb\x07 ")), b=tx.last_meaningful_line(F.lit("x\n  last \n \n")), c=tx.last_meaningful_line(F.lit(" \n"))) == ("a b", "last", None)
    assert one(spark, a=tx.show_bytes(F.lit(b"ab")), b=tx.show_bytes(F.lit(b"\x00\xff"))) == ("(ab)", "<00ff>")
    assert one(spark, a=tx.percent_decode(F.lit("a%20b+c")), b=tx.percent_decode(F.lit("%zz"))) == ("a b+c", "%zz")
    assert one(spark, a=tx.decode_text_string(F.lit(b"\xfe\xff\x00A\x20\xac")), b=tx.decode_text_string(F.lit(b"\xef\xbb\xbf\xc3\xa9")), c=tx.decode_text_string(F.lit(b"\x80a\x9f\xe9"))) == ("A€", "é", "•a�é")
    assert one(spark, a=tx.plain_text(F.array(F.lit("x"), F.lit("y"))), b=tx.plain_text(F.expr("cast(array() as array<string>)"))) == ("x\ny\n", "")


def test_numbers(spark):
    values = [(1.005, 2, 1.0), (0.285, 2, 0.28), (2.5, 0, 3.0), (-2.5, 0, -3.0), (1e300, 2, 1e300), (0.0, 3, 0.0)]
    for v, d, want in values:
        assert one(spark, x=numbers.round_to(F.lit(v), d)).x == want
    f = lambda v, *a: one(spark, x=numbers.format_number(F.lit(v), *a)).x
    assert [f(-0.004), f(1234567.891), f(-1234.5, 1, 2, 2, "€", False), f(1234.5, 0, 3), f(math.inf), f(math.nan)] == ["0.00", "1,234,567.89", "(1.234,5€)", "1235", None, None]
    assert [one(spark, x=numbers.text_number(F.lit(t))).x for t in ("$ 1,234.5", "", "x", "1e3", None)] == [1234.5, 0, 0, 1000, 0]
    assert [one(spark, x=numbers.format_special(F.lit(t), s)).x for t, s in (("12345-6789", 1), ("555 1234", 2), ("15551234567", 2), ("123", 3))] == ["12345-6789", "555-1234", "1 (555) 123-4567", "123"]
    big = F.lit(9_000_000_000_000_000_000)
    assert one(spark, a=numbers.share_holds(big, big, big - 1, big), b=numbers.share_holds(F.lit(1), F.lit(3), F.lit(2), F.lit(6))) == (False, True)


def test_dates(spark):
    cases = {"D:20240229123060+05'30'": (2024, 2, 29, 12, 30, 59, 330), "1999": (1999, 1, 1, 0, 0, 0, None), "D:20241399": (2024, 12, 31, 0, 0, 0, None), "D:20240101000000Z": (2024, 1, 1, 0, 0, 0, 0), "D:20240101000000-0815": (2024, 1, 1, 0, 0, 0, -495), "x": None, "D:20": None}
    for text, want in cases.items():
        got = one(spark, d=dates.parse_pdf_date(F.lit(text))).d
        assert (tuple(got) if got else None) == want, text
    typed = {"2024-2-3": (2024, 2, 3), "2/3/24": (2024, 2, 3), "2/3/51": (1951, 2, 3), "3 March 1999": (1999, 3, 3), "Dec 31, 49": (2049, 12, 31), "31.2.2000": None, "2 3": None, "2/31/2000": (2000, 2, 31), "a b c": None}
    for text, want in typed.items():
        got = one(spark, d=dates.parse_date(F.lit(text))).d
        assert (tuple(got) if got else None) == want, text
    date = dates.parse_date(F.lit("2005-3-9"))
    assert [one(spark, x=dates.format_date(date, i)).x for i in (*range(12), 99)] == ["3/9", "3/9/05", "3/9/2005", "03/09/05", "03/09/2005", "9-Mar", "9-Mar-05", "9-Mar-2005", "09-Mar-05", "09-Mar-2005", "05-03-09", "2005-03-09", "3/9/05"]


def soft(cb, cs):
    mul = lambda a, b: (a * b + 127) // 255
    d = mul(mul(max(0, 16 * cb - 12 * 255), cb) + 4 * 255, cb) if cb <= 63 else math.isqrt(cb * 255)
    return max(0, cb - mul(mul(255 - 2 * cs, cb), 255 - cb)) if cs <= 127 else cb + mul(2 * cs - 255, max(0, d - cb))


def test_colour(spark):
    rows = spark.createDataFrame([(a, b) for a in range(0, 256, 15) for b in range(0, 256, 17)], "cb int, cs int")
    out = rows.select("cb", "cs", colour.blend("SoftLight", F.col("cb"), F.col("cs")).alias("s"), *[colour.blend(m, F.col("cb"), F.col("cs")).alias(m) for m in colour.SEPARABLE]).collect()
    assert all(r.s == soft(r.cb, r.cs) for r in out) and all(0 <= r[m] <= 255 for r in out for m in colour.SEPARABLE)
    assert one(spark, c=colour.lab_to_rgb(F.lit(100.0), F.lit(0.0), F.lit(0.0))).c == (255, 255, 255) and one(spark, c=colour.lab_to_rgb(F.lit(0.0), F.lit(0.0), F.lit(0.0))).c == (0, 0, 0)
    assert one(spark, c=colour.cmyk_to_rgb(F.lit(0.0), F.lit(2.0), F.lit(math.nan), F.lit(0.0))).c[:2] == (255, 0)
    assert one(spark, c=colour.parse_colour(F.lit("#80FF0001")), d=colour.parse_colour(F.lit("red"))) == ((128, 255, 0, 1), None)
    assert one(spark, x=colour.indexed(F.lit(1.6), F.array(*[F.lit(v) for v in (0, 0, 0, 9, 9, 9, 255, 0, 51)]), 2, 3)).x == pytest.approx([1, 0, 0.2])
    lum = lambda c: (c[0] * 77 + c[1] * 150 + c[2] * 29) // 256
    for mode in ("Hue", "Saturation", "Color", "Luminosity"):
        got = one(spark, c=colour.blend_nonseparable(mode, F.array(*map(F.lit, (200, 30, 90))), F.array(*map(F.lit, (10, 120, 250))))).c
        assert all(0 <= v <= 255 for v in got) and abs(lum(got) - lum((10, 120, 250) if mode == "Luminosity" else (200, 30, 90))) <= 2


def test_geometry(spark):
    box = lambda *v: geometry.rect(*[F.lit(float(x)) for x in v])
    assert one(spark, a=geometry.intersect(box(0, 0, 4, 4), box(6, 6, 2, 2)), b=geometry.intersect(box(0, 0, 1, 1), box(1, 0, 2, 1))) == ((2, 2, 4, 4), None)
    assert [one(spark, x=geometry.normalize_rotation(F.lit(d))).x for d in (0, 90, -90, 450, 44, 45, 315, 359)] == [0, 90, 270, 90, 0, 90, 0, 0]
    m = geometry.matrix(2, 0, 0, 4, 10, 20)
    back = geometry.then(m, geometry.invert(m))
    assert one(spark, x=back).x == (1, 0, 0, 1, 0, 0) and one(spark, x=geometry.invert(geometry.matrix(1, 2, 2, 4, 0, 0))).x is None
    assert one(spark, x=geometry.apply(m, F.lit(1.0), F.lit(1.0))).x == (12, 24)
    assert one(spark, x=geometry.page_pixels(F.lit(595.2756), F.lit(841.8898), F.lit(150 / 72))).x == (1241, 1754)
    assert one(spark, x=geometry.path_bounds(F.array(F.lit(1.0), F.lit(math.inf)), F.array(F.lit(2.0), F.lit(5.0)))).x[0] == 1


def test_bytes(spark):
    raw = b"some bytes"
    d = one(spark, d=by.digests(F.lit(raw))).d
    assert (d.md5, d.sha1, d.sha384, d.sha512, d.crc32) == (hashlib.md5(raw).hexdigest(), hashlib.sha1(raw).hexdigest(), hashlib.sha384(raw).hexdigest(), hashlib.sha512(raw).hexdigest(), zlib.crc32(raw))
    for raw, box, image in ((b"PK\x03\x04", "zip", None), (b"Rar!\x1a\x07\x00", "rar", None), (b"\0" * 257 + b"ustar", "tar", None), (b"BM" + b"\0" * 24, None, "bmp"), (b"BM", None, None), (b"RIFFxxxxWEBP", None, "webp"), (b"xxxxWEBP", None, None), (b"\0\0\0\x1cftypavif", None, "avif"), (b"", None, None)):
        assert one(spark, a=by.container(F.lit(raw)), b=by.image_format(F.lit(raw))) == (box, image)
    assert [one(spark, x=by.claims_image(F.lit(n))).x for n in ("a/b.JPG", ".png", "x.txt", "d/.png", "p.1.webp")] == [True, False, False, False, True]
    assert one(spark, a=by.idpf_key(F.lit(" a\tb "))).a == hashlib.sha1(b"ab").digest() and one(spark, a=by.adobe_key(F.lit("urn:uuid:" + "0f" * 16)), b=by.adobe_key(F.lit("x"))) == (b"\x0f" * 16, None)
    assert one(spark, a=by.may(F.lit(-2056), "print"), b=by.may(F.lit(-2056), "copy"), c=by.may(F.lit(0), "modify")) == (False, True, False)
    names = {"/a/b.c": True, "a": False, "/": False, "/a/": False, "/a.": False, "/a%2Fb": False, "/a b": False, "/%41": True}
    assert {n: one(spark, x=by.part_name_is_legal(F.lit(n))).x for n in names} == names


def test_maps(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("x"))
    assert one(spark, a=maps.get_int(m, "a"), b=maps.get_int(m, "b"), c=maps.get_int(m, "c"), d=maps.insert(m, "a", F.lit("9")), e=maps.insert(m, "z", F.lit("0")), f=maps.without(m, "a"), g=maps.contains(m, "b")) == (1, None, None, {"a": "9", "b": "x"}, {"a": "1", "b": "x", "z": "0"}, {"b": "x"}, True)
    n = lambda **k: F.create_map(*[x for a, b in k.items() for x in (F.lit(a), F.lit(b))])
    assert one(spark, x=maps.absorb(n(a=1, b=2), n(b=3, c=4))).x == {"a": 1, "b": 5, "c": 4}
    assert [one(spark, x=maps.json_kind(F.lit(t))).x for t in ('{"a":1}', "[1]", '"x"', "2.5", "true", "null", "{")] == ["object", "array", "string", "number", "boolean", "null", None]
    record = "probe 1\nfile a b.pdf\nopened no bad header\npages 3\ncap jbig2\ncap jpx\nwarn font missing 2\nms 15\n"
    r = one(spark, x=maps.probe_record(F.lit(record + "done\n")), y=maps.probe_record(F.lit(record)), z=maps.probe_record(F.lit("probe 2\ndone")))
    assert r.x.path == "a b.pdf" and not r.x.opened and r.x.reason == "bad header" and r.x.pages == 3 and r.x.capabilities == ["jbig2", "jpx"] and r.x.warnings == {"font missing": 2} and r.x.millis == 15 and r.y is None and r.z is None
    for text, want in (("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")):
        assert one(spark, x=maps.fnv1a(F.lit(text))).x == want


def test_paging(spark):
    pages = one(spark, p=grouping.paginate(F.lit("aa bb cc\n\n" + "x" * 12 + " d"), 5, 2)).p
    assert [(r.page, r.line, r.text) for r in pages] == [(0, 0, "aa bb"), (0, 1, "cc"), (1, 0, ""), (1, 1, "x" * 12), (2, 0, "d")]
    assert one(spark, p=grouping.pack(F.array(*[F.lit(float(w)) for w in (3, 3, 9, 1, 4)]), F.lit(6.0))).p == [0, 0, 1, 2, 2]
