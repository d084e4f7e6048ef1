"""What files are by their first bytes, digests and keys. value is BINARY."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic bytes in hexadecimal, in the order in which they are tried.
CONTAINERS = (("zip", 0, "504B0304"), ("rar", 0, "526172211A07"), ("7z", 0, "377ABCAF271C"), ("tar", 257, "7573746172"))
IMAGES = (
    ("jpeg", 0, "FFD8FF"),
    ("png", 0, "89504E470D0A1A0A"),
    ("gif", 0, "474946383761"),
    ("gif", 0, "474946383961"),
    ("webp", 8, "57454250"),
    ("avif", 4, "6674797061766966"),
    ("avif", 4, "6674797061766973"),
    ("tiff", 0, "49492A00"),
    ("tiff", 0, "4D4D002A"),
    ("jpeg2000", 0, "0000000C6A5020200D0A870A"),
    ("jpeg2000", 0, "FF4FFF51"),
    ("bmp", 0, "424D"),
)
IMAGE_EXTENSIONS = ("jpg", "jpeg", "jpe", "jfif", "png", "gif", "webp", "bmp", "dib", "tif", "tiff", "avif", "jp2", "j2k", "jpf", "jpx")


def _has(value: Column, at: int, magic: str) -> Column:
    return F.hex(F.substring(value, at + 1, len(magic) // 2)) == magic


def is_pdf(value: Column) -> Column:
    """%PDF- within the first 1024 bytes."""
    return F.contains(F.hex(F.substring(value, 1, 1024)), F.lit("255044462D"))


def container(value: Column) -> Column:
    out = None
    for name, at, magic in CONTAINERS:
        out = F.when(_has(value, at, magic), name) if out is None else out.when(_has(value, at, magic), name)
    return out


def image_format(value: Column) -> Column:
    out = None
    for name, at, magic in IMAGES:
        test = _has(value, at, magic)
        if name == "webp":
            test &= _has(value, 0, "52494646")
        if name == "bmp":
            test &= F.octet_length(value) >= 26
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def claims_image(name: Column) -> Column:
    """By its extension, for entries whose bytes can't be read."""
    file = F.substring_index(name, "/", -1)
    return F.lower(F.regexp_extract(file, r"^.+\.([^.]*)$", 1)).isin(*IMAGE_EXTENSIONS)


def digests(value: Column) -> Column:
    return F.struct(F.md5(value).alias("md5"), F.sha1(value).alias("sha1"), F.sha2(value, 256).alias("sha256"), F.sha2(value, 384).alias("sha384"), F.sha2(value, 512).alias("sha512"), F.crc32(value).alias("crc32"))


def idpf_key(identifier: Column) -> Column:
    """SHA-1 of the identifier without white space."""
    return F.unhex(F.sha1(F.regexp_replace(identifier, r"[\x20\x09\x0D\x0A]", "").cast("binary")))


def adobe_key(identifier: Column) -> Column:
    """The 16 bytes of a UUID; null where the identifier has no 32 hexadecimal digits."""
    digits = F.regexp_replace(F.regexp_replace(identifier, "^urn:uuid:", ""), "[^0-9A-Fa-f]", "")
    return F.when(F.length(digits) == 32, F.unhex(digits))


def is_writable_uri(uri: Column) -> Column:
    return uri.rlike(r"^[\x20-\x7E]+$")


def segment_is_legal(segment: Column) -> Column:
    """A file or directory name inside an EPUB container."""
    return (segment != "") & ~segment.rlike(r'[/"*:<>?\\|\x00-\x1F\x7F-\x9F]') & ~F.endswith(segment, F.lit("."))


def part_name_is_legal(name: Column) -> Column:
    """An OPC part name: /segments that aren't empty, don't end with a dot and encode no slash, dot or unreserved character."""
    segment = r"(?:[A-Za-z0-9\-._~!$&'()*+,;=:@ -￯]|%[0-9A-Fa-f]{2})*(?:[A-Za-z0-9\-_~!$&'()*+,;=:@ -￯]|%[0-9A-Fa-f]{2})"
    return name.rlike(f"^(?:/{segment})+$") & ~name.rlike(r"(?i)%(?:2f|5c)")


# Permission bits of an encryption dictionary, counted from 0.
PERMISSIONS = {"print": 2, "modify": 3, "copy": 4, "annotate": 5, "fill_forms": 8, "accessibility": 9, "assemble": 10, "print_high_res": 11}


def may(permissions: Column, what: str) -> Column:
    return permissions.bitwiseAND(F.lit(1 << PERMISSIONS[what])) != 0
