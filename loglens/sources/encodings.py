"""Charsets of log files: names, detection, decoding."""

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII-compatible charsets by label, in order, with the names that Python has for them.
ENCODINGS = {
    "UTF-8": "utf-8", "GB18030": "gb18030", "GBK / GB2312": "gbk", "Big5": "big5", "Shift_JIS": "shift_jis", "EUC-JP": "euc-jp", "EUC-KR": "euc-kr",
    "Windows-1250": "cp1250", "Windows-1251": "cp1251", "Windows-1252 / ISO-8859-1": "cp1252", "Windows-1253": "cp1253", "Windows-1254 / ISO-8859-9": "cp1254", "Windows-1255": "cp1255",
    "Windows-1256": "cp1256", "Windows-1257": "cp1257", "Windows-1258": "cp1258", "Windows-874 / ISO-8859-11": "cp874",
    "ISO-8859-2": "iso-8859-2", "ISO-8859-3": "iso-8859-3", "ISO-8859-4": "iso-8859-4", "ISO-8859-5": "iso-8859-5", "ISO-8859-6": "iso-8859-6", "ISO-8859-7": "iso-8859-7", "ISO-8859-8": "iso-8859-8", "ISO-8859-8-I": "iso-8859-8",
    "ISO-8859-10": "iso-8859-10", "ISO-8859-13": "iso-8859-13", "ISO-8859-14": "iso-8859-14", "ISO-8859-15": "iso-8859-15", "ISO-8859-16": "iso-8859-16",
    "KOI8-R": "koi8-r", "KOI8-U": "koi8-u", "IBM866": "cp866", "macintosh": "mac-roman", "x-mac-cyrillic": "mac-cyrillic", "x-user-defined": "x-user-defined",
}
#: Charsets that a JVM may lack; they are decoded in Arrow batches.
OUTSIDE_JVM = {"iso-8859-10", "iso-8859-14", "mac-roman", "mac-cyrillic", "x-user-defined"}
HEAD = 64 << 10


class EncodingError(ValueError):
    """A charset that can't be read line by line, or isn't known."""


def _bare(name: str) -> str:
    return "".join(c for c in name.lower() if c not in "_-/ ")


def named(name: str) -> str:
    """The first label that starts with the name, case and punctuation aside."""
    for label in ENCODINGS:
        if _bare(label).startswith(_bare(name)):
            return label
    raise EncodingError(f"there is no charset {name!r}")


def detected(head: bytes) -> tuple[str, int]:
    """Charset and length of the byte order mark, from a file's first 64 KiB."""
    if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        raise EncodingError("UTF-16 is not supported")
    if head.startswith(codecs.BOM_UTF8):
        return "UTF-8", 3
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head[:HEAD])  # a sequence cut off at the end is fine
        return "UTF-8", 0
    except UnicodeDecodeError:
        return "GB18030", 0


def _text(data: bytes, name: str) -> str:
    if name == "x-user-defined":  # bytes beyond ASCII are private-use characters
        return "".join(chr(b if b < 0x80 else 0xF700 + b) for b in data)
    return data.decode(name, "replace")


def decoded(raw: Column, label: str) -> Column:
    """Bytes as text; what is invalid becomes U+FFFD."""
    name = ENCODINGS[label]
    if name == "utf-8":
        return F.make_valid_utf8(raw.cast("string"))
    if name not in OUTSIDE_JVM:
        return F.decode(raw, {"cp874": "x-windows-874", "cp866": "IBM866"}.get(name, name.replace("cp", "windows-")))

    @F.pandas_udf("string")
    def outside(found: pd.Series) -> pd.Series:
        return found.map(lambda b: None if b is None else _text(bytes(b), name))

    return outside(raw)


def encoded(text: str, label: str) -> bytes:
    """A literal in a file's charset."""
    name = ENCODINGS[label]
    if name == "x-user-defined":
        return b"".join(bytes([ord(c) & 0xFF]) if ord(c) < 0x80 or 0xF780 <= ord(c) <= 0xF7FF else b"?" for c in text)
    return text.encode(name, "replace")


def latin1(raw: Column) -> Column:
    """One character for each byte, for tests on bytes."""
    return F.decode(raw, "ISO-8859-1")
