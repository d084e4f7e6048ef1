"""Text: lines, search, words, direction, white space, labels and markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blocks whose letters count as strongly right-to-left (Hebrew, Arabic, Syriac, Thaana, Arabic Extended-A, presentation forms).
RTL_RANGES = ((0x0590, 0x05FF), (0x0600, 0x06FF), (0x0700, 0x074F), (0x0780, 0x07BF), (0x08A0, 0x08FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF))
# Roman numerals.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
ROMAN_LIMIT = 100_000
LETTER_REPEATS = 64
# What list markers look like.
MARKERS = {"disc": "•", "circle": "◦", "square": "▪"}


def lit(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def plain_text(lines: Column) -> Column:
    """Lines joined, each with a line feed after it."""
    return F.when(F.size(lines) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def fold_case(text: Column) -> Column:
    """Lower case character by character: a final sigma is no special case."""
    return F.lower(F.translate(text, "Σ", "σ"))


def hit_count(text: Column, needle: str) -> Column:
    """Case-insensitive hits that don't overlap; an empty needle has none."""
    if not needle:
        return F.when(text.isNotNull(), F.lit(0).cast("long"))
    folded, n = fold_case(text), fold_case(F.lit(needle))
    return F.floor((F.length(folded) - F.length(F.replace(folded, n))) / F.length(n)).cast("long")


def hit_spans(text: Column, needle: str) -> Column:
    """ARRAY<STRUCT<start, end>> of the hits in one line, in characters from 0."""
    parts = F.split(fold_case(text), "\\Q" + needle.lower() + "\\E", -1)
    n = len(needle)
    lengths = F.transform(parts, lambda p: F.length(p))

    def start(k: Column) -> Column:
        return F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda a, x: a + x) + (k - 1) * n

    if not needle:
        return F.when(text.isNotNull(), F.expr("array_repeat(named_struct('start', 0, 'end', 0), 0)"))
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(start(k).alias("start"), (start(k) + n).alias("end")))).otherwise(F.expr("array_repeat(named_struct('start', 0, 'end', 0), 0)"))


def words(text: Column) -> Column:
    """Split at white space, letters and digits kept, lower-cased, empty words dropped."""
    cleaned = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.filter(cleaned, lambda w: w != "")


def rtl_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in RTL_RANGES) + "]"))


def ltr_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{IsAlphabetic}&&[^" + "".join(f"\\u{a:04X}-\\u{b:04X}" for a, b in RTL_RANGES) + "]]"))


def is_rtl(text: Column) -> Column:
    return rtl_letters(text) > ltr_letters(text)


def one_line(text: Column) -> Column:
    """Control characters become spaces; then trimmed."""
    return F.trim(F.regexp_replace(text, r"\p{Cntrl}", " "))


def collapse(text: Column) -> Column:
    """Runs of collapsible white space become one space."""
    return F.regexp_replace(text, r"[ \t\n\r\f]+", " ")


def trim_line(text: Column) -> Column:
    return F.trim(text)


def last_meaningful_line(text: Column, most: int = 200) -> Column:
    """The last line that isn't blank, trimmed, up to `most` characters; null without any."""
    kept = F.filter(F.transform(split_lines(text), lambda x: F.trim(x)), lambda x: x != "")
    return F.left(F.try_element_at(kept, F.lit(-1)), F.lit(most))


def preview(items: Column, k: int = 5) -> Column:
    return F.array_join(F.slice(items, 1, k), " ")


def roman(n: Column) -> Column:
    """Lower-case roman numeral; empty for numbers below 1, and numbers over ROMAN_LIMIT count as that."""
    n = F.least(lit(n).cast("int"), F.lit(ROMAN_LIMIT))
    out, rest = F.lit(""), n
    for value, letters in ROMAN:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = F.pmod(rest, F.lit(value))
    return F.when(n <= 0, "").otherwise(out)


def letters(n: Column) -> Column:
    """a to z, then aa, bb and so on: the letter repeats."""
    n = lit(n).cast("int")
    return F.when(n <= 0, "").otherwise(F.repeat(F.char(F.pmod(n - 1, F.lit(26)) + 97), F.least(F.floor((n - 1) / 26).cast("int") + 1, F.lit(LETTER_REPEATS))))


def base_letters(n: Column) -> Column:
    """a to z, then aa, ab and so on, as list markers count; five letters at most."""
    n = lit(n).cast("long")
    out, rest = F.lit(""), n
    for _ in range(5):
        more = rest > 0
        out = F.when(more, F.concat(F.char(F.pmod(rest - 1, F.lit(26)) + 97), out)).otherwise(out)
        rest = F.when(more, F.floor((rest - 1) / 26)).otherwise(F.lit(0))
    return out


def label_number(style: Column, n: Column) -> Column:
    """A page label's number: D decimal, R and r roman, A and a letters; no style, no number."""
    return (
        F.when(style == "D", n.cast("string"))
        .when(style == "R", F.upper(roman(n)))
        .when(style == "r", roman(n))
        .when(style == "A", F.upper(letters(n)))
        .when(style == "a", letters(n))
        .otherwise("")
    )


def list_marker(kind: Column, ordinal: Column) -> Column:
    """The marker of a list item, counted from 1."""
    out = F.when(kind == "none", "")
    for name, mark in MARKERS.items():
        out = out.when(kind == name, mark)
    dot = lambda c: F.concat(c, F.lit("."))
    return (
        out.when(kind == "decimal", dot(ordinal.cast("string")))
        .when(kind == "lower-roman", dot(roman(ordinal)))
        .when(kind == "upper-roman", dot(F.upper(roman(ordinal))))
        .when(kind.isin("lower-alpha", "lower-latin"), dot(base_letters(ordinal)))
        .when(kind.isin("upper-alpha", "upper-latin"), dot(F.upper(base_letters(ordinal))))
        .otherwise(MARKERS["disc"])
    )


def same_family(a: Column, b: Column) -> Column:
    """Whether two font families are one: quotes, white space and case don't tell them apart."""
    plain = lambda c: fold_case(F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*[\"']|[\"']\s*$", ""), r"\s+", " ")))
    return plain(a) == plain(b)


def between_rows(parent: Column, text: Column) -> Column:
    """Whether text is white space between the parts of a table, which makes no box."""
    return parent.isin("table", "thead", "tbody", "tfoot", "tr", "colgroup") & text.rlike(r"^[ \t\r\n\f]*$")


def collapses(white_space: Column) -> Column:
    return white_space.isin("normal", "nowrap", "pre-line")


def preserves_breaks(white_space: Column) -> Column:
    return white_space.isin("pre", "pre-wrap", "pre-line")


def wraps(white_space: Column) -> Column:
    return white_space.isin("normal", "pre-wrap", "pre-line")


def show_bytes(value: Column) -> Column:
    """Printable ASCII in parentheses, other bytes as hexadecimal in angle brackets."""
    text = F.decode(value, "ISO-8859-1")
    return F.when(text.rlike(r"^[\x20-\x7E]*$"), F.concat(F.lit("("), text, F.lit(")"))).otherwise(F.concat(F.lit("<"), F.lower(F.hex(value)), F.lit(">")))


def percent_decode(text: Column) -> Column:
    """%xx to characters by UTF-8; a plus stays, and so does the whole text where the bytes aren't UTF-8."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


# Where PDFDocEncoding differs from Latin-1 (bytes 0x18 to 0x1F and 0x80 to 0x9E; 0x9F is undefined).
PDF_DOC_LOW = "˘ˇˆ˙˝˛˚˜"
PDF_DOC_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"


def decode_text_string(value: Column) -> Column:
    """A text string's bytes: UTF-16 or UTF-8 with a byte order mark, else PDFDocEncoding."""
    high = "".join(chr(0x80 + i) for i in range(len(PDF_DOC_HIGH)))
    low = "".join(chr(0x18 + i) for i in range(len(PDF_DOC_LOW)))
    doc = F.translate(F.decode(value, "ISO-8859-1"), low + high + "\x9f", PDF_DOC_LOW + PDF_DOC_HIGH + "\ufffd")
    start = F.hex(F.substring(value, 1, 3))
    return F.when(F.startswith(start, F.lit("FEFF")), F.decode(F.substr(value, F.lit(3)), "UTF-16BE")).when(start == "EFBBBF", F.decode(F.substr(value, F.lit(4)), "UTF-8")).otherwise(doc)


def natural_key(name: Column) -> Column:
    """ARRAY of runs to sort by: digits by their value's length and digits, other runs without ASCII case; then sort by the name."""
    folded = F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = F.regexp_extract_all(folded, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def run(r: Column) -> Column:
        digits, number = F.regexp_replace(r, "^0+", ""), r.rlike("^[0-9]")
        # A run of digits meets one of text as text, by its first character.
        return F.struct(F.when(number, "0").otherwise(F.left(r, F.lit(1))).alias("first"), F.when(number, 0).otherwise(1).alias("kind"), F.when(number, F.length(digits)).otherwise(0).alias("size"), F.when(number, digits).otherwise(r).alias("run"))

    return F.transform(runs, run)
