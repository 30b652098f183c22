"""URLs after the WHATWG rules: parsing, resolving, changing parts, serialising, and their search parameters."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import quote, unquote_to_bytes

# Special schemes with their ports, and characters that are percent-encoded besides controls and what is beyond ASCII.
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
FRAGMENT_SET = ' "<>`'
QUERY_SET = ' "#<>'
PATH_SET = QUERY_SET + "?^`{}"
USER_SET = PATH_SET + "/:;=@[\\]|"
FORBIDDEN_HOST = frozenset("\0\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(c) for c in range(32)}

PARTS = ("scheme", "username", "password", "host", "port", "path", "query", "fragment")


DRIVE = re.compile(r"[a-zA-Z][:|]")


def _encoded(text: str, these: str) -> str:
    return "".join(c if "!" <= c <= "~" and c not in these else quote(c, safe="") if c > "~" else f"%{ord(c):02X}" for c in text.encode("utf-8", "replace").decode())


def _ipv4(host: str) -> str | None:
    """An address whose last part is a number as dotted decimals; None if it is out of range."""
    parts = host.split(".")
    if len(parts) > 1 and not parts[-1]:
        parts.pop()
    if len(parts) > 4:
        return None
    numbers = []
    for p in parts:
        try:
            numbers.append(int(p[2:] or "0", 16) if p[:2] in ("0x", "0X") else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        except ValueError:
            return None
    if any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n << 8 * (3 - i) for i, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


#: Letters that names keep as they are, and code points that they lose.
KEPT, IGNORED = "ßς\u200c\u200d", re.compile("[\u00ad\u034f\u180b-\u180d\u200b\u2060\u2064\ufe00-\ufe0f\ufeff]")


def _label_ok(label: str) -> bool:
    """Whether a label with letters beyond ASCII is in its normal form and has only assigned code points, no mark first."""
    kinds = [unicodedata.category(c) for c in label]
    return unicodedata.normalize("NFC", label) == label and not kinds[0].startswith("M") and not any(k in ("Cc", "Cn", "Co", "Cs") for k in kinds)


def _ascii_name(name: str) -> str | None:
    """A domain with each label in ASCII letters; letters are folded, but the sharp s, the final sigma and joiners stay.  None if a label cannot be, or is an encoded one that no label gives."""
    if not name.isascii():
        folded = "".join(c if c in KEPT else "ß" if c == "ẞ" else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in IGNORED.sub("", name))
        name = unicodedata.normalize("NFC", folded)
    labels = re.split("[.。．｡]", name.lower() if name.isascii() else name)
    for i, label in enumerate(labels):
        try:
            plain = label[4:].encode("ascii").decode("punycode") if label.startswith("xn--") else label
            if label.startswith("xn--") and (plain.isascii() or "xn--" + plain.encode("punycode").decode() != label):
                return None
            if not plain.isascii():
                if not _label_ok(plain):
                    return None
                labels[i] = "xn--" + plain.encode("punycode").decode()
        except (UnicodeError, ValueError):
            return None
    return ".".join(labels)


def parse_host(host: str, special: bool) -> str | None:
    """A host as it is serialised; None if it is not one."""
    if host.startswith("["):
        if not host.endswith("]"):
            return None
        try:
            v6 = ipaddress.IPv6Address(host[1:-1])
        except ValueError:
            return None
        if "%" in host:
            return None
        mapped = v6.ipv4_mapped
        return f"[::ffff:{int(mapped) >> 16:x}:{int(mapped) & 0xFFFF:x}]" if mapped else f"[{v6.compressed}]"
    if not special:
        return None if any(c in FORBIDDEN_HOST and c != "%" for c in host) else _encoded(host, "")
    name = unquote_to_bytes(host).decode("utf-8", "replace")
    name = _ascii_name(name)
    if not name or any(c in FORBIDDEN_HOST for c in name):
        return None
    last = name.rstrip(".").rsplit(".", 1)[-1]
    if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", last):
        return _ipv4(name)
    return name


def _path(text: str, before: list[str], special: bool, scheme: str) -> list[str]:
    out = list(before)
    parts = re.split(r"[/\\]" if special else "/", text)
    for i, p in enumerate(parts):
        if scheme == "file" and not out and DRIVE.fullmatch(p):
            p = p[0] + ":"
        plain, end = p.lower().replace("%2e", "."), i == len(parts) - 1
        if plain == "..":
            if out and not (scheme == "file" and len(out) == 1 and re.fullmatch(r"[a-zA-Z]:", out[0])):
                out.pop()
            if end:
                out.append("")
        elif plain == ".":
            if end:
                out.append("")
        else:
            out.append(_encoded(p, PATH_SET))
    return out


def _port(text: str, scheme: str) -> tuple[bool, int | None]:
    """Whether the text is a port, and the port, None if it is the scheme's own."""
    if not text:
        return True, None
    if not (text.isascii() and text.isdigit()) or int(text) > 65535:
        return False, None
    return True, None if PORTS.get(scheme) == int(text) else int(text)


def parse_url(url: str, base: str | None = None) -> dict | None:
    """Parts of a URL, resolved against a base if it is relative; None if it is not one."""
    text = re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    rest, mark, fragment = text.partition("#")
    fragment = _encoded(fragment, FRAGMENT_SET) if mark else None
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", rest)
    parent = parse_url(base) if base is not None and m is None else None
    if m is None and parent is None:
        return None
    if m is not None and base is not None and m[1].lower() in PORTS and not re.match(r"[/\\]", rest[m.end() :]):
        parent = parse_url(base)  # http:rest is relative to a base of its own scheme
        if parent is None or parent["scheme"] != m[1].lower():
            parent = None
    scheme = m[1].lower() if m else parent["scheme"]
    special = scheme in PORTS
    rest = rest[m.end() :] if m else rest
    rest, mark, query = rest.partition("?")
    query = _encoded(query, QUERY_SET + ("'" if special else "")) if mark else None
    slashes = r"[/\\]" if special else "/"
    out = {"scheme": scheme, "username": "", "password": "", "host": None, "port": None, "path": "", "query": query, "fragment": fragment}
    if parent is not None and not re.match(slashes * 2, rest):
        out |= {k: parent[k] for k in ("username", "password", "host", "port")}
        if parent["path"][:1] != "/" and parent["host"] is None:  # an opaque path has no relatives but fragments
            return out | {"path": parent["path"], "query": parent["query"]} if not rest and query is None and fragment is not None else None
        if not rest:
            return out | {"path": parent["path"], "query": parent["query"] if query is None else query}
        rooted = bool(re.match(slashes, rest))
        below = rest[1:] if rooted else rest
        above = parent["path"].split("/")[1:]
        drive = above[:1] if scheme == "file" and DRIVE.fullmatch(above[0]) else []
        if scheme == "file" and DRIVE.fullmatch(re.split(r"[/\\]", below)[0]):
            above = []
        else:
            above = drive if rooted or len(above) == len(drive) else above[:-1]
        return out | {"path": "/" + "/".join(_path(below, above, special, scheme))}
    if special and scheme != "file" or re.match(slashes * 2, rest):
        body = re.sub(r"\A[/\\]*", "", rest) if special and scheme != "file" else rest[2:]
        end = re.search(slashes, body)
        authority, path = (body[: end.start()], body[end.start() :]) if end else (body, "")
        if scheme == "file":  # no login and no port, and a drive is part of the path
            if DRIVE.fullmatch(authority):
                authority, path = "", "/" + body
            host = parse_host(authority, special) if authority else ""
            if host is None:
                return None
            out["host"] = "" if host == "localhost" else host
            return out | {"path": "/" + "/".join(_path(path[1:], [], special, scheme))}
        login, at, place = authority.rpartition("@")
        if at:
            user, _, password = login.partition(":")
            out["username"], out["password"] = _encoded(user, USER_SET), _encoded(password, USER_SET)
        h = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", place)
        if h is None:
            return None
        ok, out["port"] = _port(h[2] or "", scheme)
        if not ok:
            return None
        if h[1] or special:
            host = parse_host(h[1], special)
            if host is None:
                return None
            out["host"] = host
        else:
            out["host"] = ""
        if path or special:
            out["path"] = "/" + "/".join(_path(path[1:], [], special, scheme))
        return out
    if scheme == "file":
        out["host"] = ""
    if rest.startswith("/") or special:
        out["path"] = "/" + "/".join(_path(re.sub(rf"\A{slashes}", "", rest), [], special, scheme))
    else:
        out["path"] = "".join(c if " " <= c <= "~" else _encoded(c, "") for c in rest)
    return out


def url_string(u: dict) -> str:
    """The URL of some parts."""
    login = u["username"] + (":" + u["password"] if u["password"] else "")
    host = "" if u["host"] is None else "//" + (login + "@" if login else "") + u["host"] + (f":{u['port']}" if u["port"] is not None else "")
    if u["host"] is None and u["path"].startswith("//"):
        host = "/."
    return f"{u['scheme']}:{host}{u['path']}" + (f"?{u['query']}" if u["query"] is not None else "") + (f"#{u['fragment']}" if u["fragment"] is not None else "")


def with_part(url: str, part: str, value: str) -> str | None:
    """The URL with one part set; as it was if the value does not fit, None if it is no URL.

    ``host`` takes a port, too; ``hostname`` does not.  An empty query, fragment
    or port takes the part away.
    """
    u = parse_url(url)
    if u is None:
        return None
    special, fixed = u["scheme"] in PORTS, u["host"] in (None, "") or u["scheme"] == "file"
    if part == "scheme":
        name = value.rstrip(":").lower()
        if re.fullmatch(r"[a-z][a-z0-9+.-]*", name) and (name in PORTS) == special and not (name == "file" and (u["username"] or u["password"] or u["port"] is not None)):
            u["scheme"] = name
            u["port"] = None if u["port"] == PORTS.get(name) else u["port"]
    elif part in ("username", "password"):
        if not fixed:
            u[part] = _encoded(value, USER_SET)
    elif part in ("host", "hostname"):
        m = re.match(r"(\[[^\]]*\]|[^:/?#\\]*)(?::([0-9]*))?", value)
        host = parse_host(m[1], special) if m[1] and u["host"] is not None else None
        if host is not None:
            u["host"] = host
            ok, port = _port(m[2] or "", u["scheme"])
            if part == "host" and m[2] and ok:
                u["port"] = port
    elif part == "port":
        digits = re.match(r"[0-9]*", value)[0]
        ok, port = _port(digits, u["scheme"])
        if not fixed and ok and (digits or not value):
            u["port"] = port
    elif part == "path":
        if u["path"].startswith("/") or special:
            u["path"] = "/" + "/".join(_path(re.sub(r"\A[/\\]" if special else r"\A/", "", value.replace("?", "%3F").replace("#", "%23")), [], special, u["scheme"]))
    elif part == "query":
        u["query"] = _encoded(value.removeprefix("?"), QUERY_SET + ("'" if special else "")) if value else None
    elif part == "fragment":
        u["fragment"] = _encoded(value.removeprefix("#"), FRAGMENT_SET) if value else None
    else:
        raise ValueError(f"no part of a URL: {part}")
    return url_string(u)


def search_params(query: str) -> list[tuple[str, str]]:
    """Name-value pairs of a query in order; plus signs are spaces."""
    out = []
    for p in query.removeprefix("?").split("&"):
        if p:
            name, _, value = p.partition("=")
            out.append(tuple(unquote_to_bytes(x.replace("+", " ")).decode("utf-8", "replace") for x in (name, value)))
    return out


def search_string(pairs: list[tuple[str, str]]) -> str:
    form = lambda s: quote(s, safe="*-._ ").replace("~", "%7E").replace(" ", "+")
    return "&".join(f"{form(n)}={form(v)}" for n, v in pairs)


def edited_params(query: str, action: str, name: str = "", value: str = "") -> str:
    """A query after append, set, delete or sort of its parameters."""
    pairs = search_params(query)
    if action == "append":
        pairs.append((name, value))
    elif action == "set":
        at = next((i for i, (n, _) in enumerate(pairs) if n == name), len(pairs))
        pairs = [p for i, p in enumerate(pairs) if p[0] != name or i < at]
        pairs.insert(at, (name, value))
    elif action == "delete":
        pairs = [p for p in pairs if p[0] != name]
    elif action == "sort":
        pairs.sort(key=lambda p: p[0].encode("utf-16-be", "surrogatepass"))
    else:
        raise ValueError(f"append, set, delete or sort, not {action}")
    return search_string(pairs)
