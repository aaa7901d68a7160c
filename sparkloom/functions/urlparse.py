"""Browser-style URL parsing (the WHATWG rules for http and https) in plain Python."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

_SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.\-]*):")
_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_BAD_HOST = set("\x00\t\n\r #/:<>?@[\\]^|%\x7f") | {chr(c) for c in range(32)}
#: Characters that are percent-encoded in a path and in a query.
_PATH, _QUERY = set(' "#<>?`{}^'), set(" \"#<>'")


class Url(NamedTuple):
    scheme: str
    host: str
    port: str
    path: str
    query: str | None
    fragment: str | None
    user: str

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}{':' + self.port if self.port else ''}"

    def href(self, query: str | None = "", fragment: bool = False) -> str:
        """The URL without its fragment (by default) and credentials; ``query`` replaces the query unless it is ''."""
        q = self.query if query == "" else query
        return self.origin + self.path + ("" if q is None else f"?{q}") + (f"#{self.fragment}" if fragment and self.fragment is not None else "")


def _encode(text: str, unsafe: set[str]) -> str:
    return "".join(c if " " < c < "\x7f" and c not in unsafe else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _host(raw: str) -> str | None:
    if raw.startswith("["):
        return raw.lower() if re.fullmatch(r"\[[0-9a-fA-F:.]+\]", raw) else None
    try:
        name = unquote_to_bytes(raw).decode("utf-8")
        if not name.isascii():
            name = ".".join(part.encode("idna").decode() if not part.isascii() else part for part in re.split("[.。．｡]", name))
    except (UnicodeError, ValueError):
        return None
    name = name.lower()
    if not name or _BAD_HOST & set(name):
        return None
    return name


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = k == len(parts) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def parse(raw: str | None, base: Url | None = None) -> Url | None:
    """Parse an absolute URL, or one relative to ``base``; None where it is not one with a host."""
    if raw is None:
        return None
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    text, mark, fragment = text.partition("#")
    found = _SCHEME.match(text)
    scheme = found.group(1).lower() if found else None
    if scheme is None and base is None:
        return None
    rest = text[found.end() :] if found else text
    if scheme is not None and scheme not in _PORTS:
        return None
    rest, query_mark, query = rest.partition("?")
    rest = rest.replace("\\", "/")
    tail = _encode(fragment, set(' "<>`')) if mark else None
    query = _encode(query, _QUERY) if query_mark else None
    if scheme is None or (base is not None and scheme == base.scheme and not rest.startswith("/")):
        assert base is not None
        if rest.startswith("//"):
            scheme = base.scheme
        else:
            if not rest:
                return base._replace(query=query if query_mark else base.query, fragment=tail)
            path = rest if rest.startswith("/") else base.path.rpartition("/")[0] + "/" + rest
            return base._replace(path=_dots(_encode(path, _PATH)), query=query, fragment=tail)
    rest = rest.lstrip("/")
    authority, slash, path = rest.partition("/")
    user, at, hostport = authority.rpartition("@")
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", hostport)
    if not m:
        return None
    host, port = _host(m.group(1)), (m.group(2) or "").lstrip("0") or ("0" if m.group(2) and set(m.group(2)) == {"0"} else "")
    if host is None or (port and int(port) > 65535):
        return None
    return Url(scheme, host, "" if port == _PORTS[scheme] else port, _dots(_encode("/" + path, _PATH)), query, tail, user if at else "")


def pairs(query: str | None) -> list[tuple[str, str]]:
    """Decoded form pairs of a query, in order."""
    out = []
    for part in (query or "").split("&"):
        if part:
            k, _, v = part.partition("=")
            out.append(tuple(unquote_to_bytes(x.replace("+", " ")).decode("utf-8", "replace") for x in (k, v)))
    return out
