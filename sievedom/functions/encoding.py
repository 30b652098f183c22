"""Bytes of a page as text: byte order marks, declared and given encodings."""

from __future__ import annotations

import codecs
import re

#: Labels that the web reads as another encoding than their name says (fixed values).
WEB = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "l1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "iso-8859-8-i": "iso-8859-8", "logical": "iso-8859-8", "csiso88598i": "iso-8859-8", "iso-8859-9": "cp1254", "latin5": "cp1254", "tis-620": "cp874", "gb2312": "gbk", "x-sjis": "cp932", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "big5": "big5hkscs", "utf8": "utf-8", "unicode": "utf-16-le", "utf-16": "utf-16-le", "x-user-defined": "cp1252"}
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_META = re.compile(rb"""<meta\b[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)


def lookup(label: str) -> str | None:
    """Python's name of the encoding that a label stands for; None if there is none."""
    name = label.strip(" \t\n\f\r").lower()
    try:
        return codecs.lookup(WEB.get(name, name)).name
    except LookupError:
        return None


def detect(data: bytes, label: str | None = None) -> str:
    """The encoding by byte order mark, by the given label, by a meta element in the first 1024 bytes, else UTF-8."""
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    if label and (given := lookup(label)):
        return given
    meta = _META.search(data[:1024])
    found = lookup(meta[1].decode()) if meta else None
    if found and found.startswith("utf-16"):
        found = "utf-8"  # what could be read to here is no UTF-16
    return found or "utf-8"


def decode(data: bytes, label: str | None = None) -> str:
    """Text of bytes; what is not valid becomes U+FFFD, a byte order mark goes."""
    name = detect(data, label)
    for mark, _ in _MARKS:
        if data.startswith(mark):
            data = data[len(mark) :]
            break
    return data.decode(name, "replace")


def encode(text: str, label: str = "utf-8") -> bytes:
    """Bytes of text; characters that the encoding lacks become references."""
    name = lookup(label)
    if name is None:
        raise ValueError(f"no encoding: {label}")
    return text.encode(name, "xmlcharrefreplace")
