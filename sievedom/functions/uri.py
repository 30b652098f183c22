"""URI, MIME, data-URI and colour checks."""

from __future__ import annotations

import base64
import re

MAX_URI = 4096
_REF = re.compile(rb"&(?:nbsp;|#[xX]([0-9a-fA-F]+);|#([0-9]+);)")
_SPACES = "\u0009\u000a\u000b\u000c\u000d\u0020\u00a0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u205f\u3000"


def normalize_uri(value: str) -> str | None:
    """Character references decoded, control characters dropped, white space trimmed; None if it is over MAX_URI bytes."""
    raw = value.encode("utf-8", "surrogatepass")
    if len(raw) > MAX_URI:
        return None

    def ref(m: re.Match) -> bytes:
        if m[1] is None and m[2] is None:
            return b"\xc2\xa0"
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code).encode("utf-8", "ignore") if code < 0x110000 else b""

    text = _REF.sub(ref, raw).decode("utf-8", "replace")
    return re.sub(r"[\x00-\x1f\x7f]", "", text).strip(_SPACES)


def image_magic(mime: str, head: bytes) -> bool:
    """Whether the first bytes are those of the MIME type; other image types pass."""
    if mime == "image/png":
        return head.startswith(b"\x89PNG\r\n\x1a\n")
    if mime in ("image/jpeg", "image/jpg"):
        return head.startswith(b"\xff\xd8")
    if mime == "image/gif":
        return head[:6] in (b"GIF87a", b"GIF89a")
    if mime == "image/webp":
        return head[:4] == b"RIFF" and head[8:12] == b"WEBP"
    return True


def check_data_uri(uri: str) -> bool:
    """A data URI of a base64 image whose first bytes agree with its type."""
    head, comma, body = uri[5:].partition(",")
    mime, _, coding = head.lower().partition(";")
    if not comma or coding != "base64" or not mime.startswith("image/"):
        return False
    body = body[:128]
    try:
        return image_magic(mime, base64.b64decode(body[: len(body) // 4 * 4], validate=True))
    except ValueError:
        return False


def _validate(value: str, media: str | None = None) -> bool:
    text = normalize_uri(value)
    if text is None:
        return False
    low = text.lower()
    if low.startswith(("javascript:", "vbscript:", "file:")):
        return False
    if low.startswith("data:"):
        if media and low.startswith(f"data:{media}/"):
            return True
        return low.startswith("data:image/") and not low.startswith("data:image/svg") and check_data_uri(text)
    return True


def validate_uri(value: str) -> bool:
    """Rejects script, file and unverified data URIs."""
    return _validate(value)


def validate_audio_uri(value: str) -> bool:
    return _validate(value, "audio")


def validate_video_uri(value: str) -> bool:
    return _validate(value, "video")


def validate_svg_uri(value: str) -> bool:
    """Fragments only."""
    return (normalize_uri(value) or "").startswith("#")


def validate_strict_uri(value: str) -> bool:
    """http, https, mailto, or a relative one that does not leave its host or folder."""
    text = normalize_uri(value)
    if text is None or not validate_uri(value) or text.startswith("//") or "../" in text or "..\\" in text:
        return False
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", text)
    return m is None or m[1].lower() in ("http", "https", "mailto", "data")


def validate_srcset(value: str) -> bool:
    return all(validate_uri(c.split()[0]) for c in value.split(",") if c.split())


def validate_style(value: str) -> bool:
    return not any(x in value for x in ("expression", "behavior", "url(", "javascript:"))


def validate_sandbox(value: str) -> bool:
    return "allow-scripts" not in value


_NAMED = {
    "black": "000000", "white": "ffffff", "red": "ff0000", "green": "008000", "blue": "0000ff", "yellow": "ffff00", "cyan": "00ffff", "aqua": "00ffff", "magenta": "ff00ff", "fuchsia": "ff00ff",
    "gray": "808080", "grey": "808080", "silver": "c0c0c0", "maroon": "800000", "olive": "808000", "lime": "00ff00", "teal": "008080", "navy": "000080", "purple": "800080", "orange": "ffa500",
    "pink": "ffc0cb", "brown": "a52a2a", "gold": "ffd700", "indigo": "4b0082", "violet": "ee82ee", "transparent": "000000",
}


def css_color(text: str) -> tuple[int, int, int, int]:
    """r, g, b, a of a CSS colour; black for what is not one."""
    s = text.strip().lower()
    if m := re.fullmatch(r"#([0-9a-f]{3}|[0-9a-f]{6})", s):
        h = m[1] if len(m[1]) == 6 else "".join(c * 2 for c in m[1])
    elif m := re.fullmatch(r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,[^)]*)?\)", s):
        return *(min(255, int(x)) for x in m.groups()), 255
    else:
        h = _NAMED.get(s, "000000")
    return int(h[:2], 16), int(h[2:4], 16), int(h[4:], 16), 255
