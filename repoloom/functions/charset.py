"""Column expressions from bytes to text.

Everything is built from `decode`, regular expressions over a Latin-1 view of the
bytes and `translate`; a malformed unit becomes U+FFFD instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoloom.functions.lookups import CHARSET_BYTES, SNIFF_BYTES, SNIFF_PERCENT
from repoloom.functions.paths import extension

# File types that may declare a charset, and the patterns that find it.
DECLARING_EXTENSIONS = (".html", ".htm", ".xml")
CHARSET_PATTERN = r"""(?i)charset\s*=\s*["']?([A-Za-z0-9._\-]+)"""
ENCODING_PATTERN = r"""(?i)encoding\s*=\s*["']([A-Za-z0-9._\-]+)["']"""

# Declared names and the decoder each one selects.
CHARSET_ALIASES = {
    "utf-8": "utf-8",
    "utf8": "utf-8",
    "utf-16": "utf-16le",
    "utf-16le": "utf-16le",
    "unicode": "utf-16le",
    "utf-16be": "utf-16be",
    "utf-32": "utf-32le",
    "iso-8859-1": "latin-1",
    "latin1": "latin-1",
    "latin-1": "latin-1",
    "windows-1252": "cp1252",
    "cp1252": "cp1252",
    "us-ascii": "ascii",
    "iso-8859-15": "latin-9",
}

# Where code page 1252 and Latin-9 differ from Latin-1.
CP1252_FROM = "".join(chr(b) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
LATIN9_FROM, LATIN9_TO = "¤¦¨´¸¼½¾", "€ŠšŽžŒœŸ"

CONTROL_BYTES = "".join(chr(b) for b in [*range(0x01, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F])


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def looks_binary(content: Column) -> Column:
    """Sniff the first bytes: a NUL, or more than 30 % control bytes, means binary."""
    sample = latin1(F.substring(content, 1, SNIFF_BYTES))
    controls = F.length(sample) - F.length(F.translate(sample, CONTROL_BYTES, ""))
    share = F.call_function("div", controls * 100, F.greatest(F.length(sample), F.lit(1)))
    return (F.length(content) > 0) & ((F.instr(sample, "\x00") > 0) | (share > SNIFF_PERCENT))


def utf8_lenient(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def utf8_strict(content: Column) -> Column:
    """Null when the bytes are not well-formed UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def _repaired(content: Column, width: int, good: str, bad: str, mark: str, charset: str, head: str = "") -> Column:
    """Decode fixed-width units after replacing each malformed one by the mark."""
    whole = F.length(content) - F.length(content) % width
    units = latin1(F.substring(content, F.lit(1), whole))
    units = F.regexp_replace(units, rf"(?s)\G((?:{good})*+){bad}", "$1" + mark)
    text = F.decode(F.encode(F.concat(F.lit(head), units), "ISO-8859-1"), charset)
    return F.concat(text, F.when(F.length(content) % width > 0, F.lit("\ufffd")).otherwise(F.lit("")))


def utf16le(content: Column) -> Column:
    pair = r".[\xd8-\xdb].[\xdc-\xdf]"
    return _repaired(content, 2, rf".[^\xd8-\xdf]|{pair}", r".[\xd8-\xdf]", "\xfd\xff", "UTF-16LE")


def utf16be(content: Column) -> Column:
    pair = r"[\xd8-\xdb].[\xdc-\xdf]."
    return _repaired(content, 2, rf"[^\xd8-\xdf].|{pair}", r"[\xd8-\xdf].", "\xff\xfd", "UTF-16BE")


def utf32le(content: Column) -> Column:
    good = r"..[\x01-\x10]\x00|.[^\xd8-\xdf]\x00\x00"
    return _repaired(content, 4, good, r"....", "\xfd\xff\x00\x00", "UTF-32", head="\xff\xfe\x00\x00")


def decode_bom(content: Column) -> Column:
    """Text of content that starts with a byte order mark, else null."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head.startswith("EFBBBF"), utf8_lenient(content))
        .when(head == "FFFE0000", utf32le(content))
        .when(head.startswith("FFFE"), utf16le(content))
        .when(head.startswith("FEFF"), utf16be(content))
    )


def declared_charset(content: Column, path: Column) -> Column:
    """Lower-case charset name that an HTML or XML file declares, else null."""
    sample = latin1(F.substring(content, 1, CHARSET_BYTES))
    found = F.coalesce(
        F.nullif(F.regexp_extract(sample, CHARSET_PATTERN, 1), F.lit("")),
        F.nullif(F.regexp_extract(sample, ENCODING_PATTERN, 1), F.lit("")),
    )
    return F.when(extension(path).isin(*DECLARING_EXTENSIONS), F.lower(found))


def charset_alias(name: Column) -> Column:
    """Decoder for a declared name, null when this package has none."""
    pairs = [F.lit(x) for kv in CHARSET_ALIASES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), name)


def charset_unsupported(content: Column, path: Column) -> Column:
    """A charset is declared for which this package has no decoder (content falls through to UTF-8)."""
    name = declared_charset(content, path)
    return name.isNotNull() & charset_alias(name).isNull()


def decode_as(decoder: Column, content: Column) -> Column:
    """Text by one of the decoders of `charset_alias`; malformed bytes become U+FFFD, null stays null."""
    return (
        F.when(decoder == "utf-8", utf8_lenient(content))
        .when(decoder == "utf-16le", utf16le(content))
        .when(decoder == "utf-16be", utf16be(content))
        .when(decoder == "utf-32le", utf32le(content))
        .when(decoder == "latin-1", latin1(content))
        .when(decoder == "cp1252", F.translate(latin1(content), CP1252_FROM, CP1252_TO))
        .when(decoder == "latin-9", F.translate(latin1(content), LATIN9_FROM, LATIN9_TO))
        .when(decoder == "ascii", F.regexp_replace(latin1(content), r"[\x80-\xff]", "\ufffd"))
    )


def decode_declared(content: Column, path: Column) -> Column:
    return decode_as(charset_alias(declared_charset(content, path)), content)


def strip_bom(text: Column) -> Column:
    return F.ltrim(text, F.lit("\ufeff"))


def decode_text(content: Column, path: Column) -> Column:
    """BOM, then declared charset, then strict UTF-8, then Latin-1; leading U+FEFF removed."""
    return F.when(F.length(content) == 0, F.lit("")).otherwise(
        strip_bom(
            F.coalesce(decode_bom(content), decode_declared(content, path), utf8_strict(content), latin1(content))
        )
    )
