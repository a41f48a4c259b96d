"""URLs as browsers read them, for http and https; other schemes stay opaque.

Plain Python functions, with Arrow-batched column versions at the end.  What SQL
can say about a normalised URL (host, path, segments) is in ``columns``.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from urllib.parse import parse_qsl, quote, unquote_to_bytes, urlencode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: query keys that only track
TRACKING_KEYS = frozenset(
    (
        "utm_source utm_medium utm_campaign utm_term utm_content utm_id "
        "gclid gbraid wbraid dclid fbclid msclkid ttclid mc_cid mc_eid igshid ref_src"
    ).split()
)
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_PORTS = {"http": 80, "https": 443}
_ALWAYS = "".join(map(chr, range(0x21, 0x7F)))
_IN_PATH = "".join(c for c in _ALWAYS if c not in '"#<>?`{}')
_IN_QUERY = "".join(c for c in _ALWAYS if c not in "\"#<>'")
_IN_FRAGMENT = "".join(c for c in _ALWAYS if c not in '"<>`')
_BAD_HOST = re.compile(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]")


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str = ""
    port: int | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None
    opaque: str | None = None  # all after the scheme, of a scheme that is not split
    user: str = ""

    @property
    def netloc(self) -> str:
        """Host, and port where it isn't the scheme's own."""
        return self.host if self.port is None else f"{self.host}:{self.port}"

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.netloc}"

    def __str__(self) -> str:
        if self.opaque is not None:
            return f"{self.scheme}:{self.opaque}"
        tail = ("" if self.query is None else f"?{self.query}") + ("" if self.fragment is None else f"#{self.fragment}")
        return f"{self.scheme}://{self.user}{self.netloc}{self.path}{tail}"


def _host(text: str) -> str | None:
    try:
        name = unquote_to_bytes(text).decode()
    except UnicodeDecodeError:
        return None
    if name.startswith("["):
        return name.lower() if re.fullmatch(r"\[[0-9a-fA-F:.]+\]", name) else None
    if not name.isascii():
        try:
            name = name.encode("idna").decode()
        except UnicodeError:
            return None
    name = name.lower()
    return None if not name or _BAD_HOST.search(name) else name


def _segments(path: str) -> str:
    """A path without dot segments."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = i == len(parts) - 1
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


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """The URL that ``text`` names, read against ``base``; None if it names none."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    found = _SCHEME.match(text)
    scheme = found[1].lower() if found else None
    if scheme and scheme not in _PORTS:
        return Url(scheme, opaque=quote(text[found.end() :], safe=_ALWAYS))
    rest, _, fragment = text[found.end() if found else 0 :].partition("#")
    hash_ = quote(fragment, safe=_IN_FRAGMENT) if "#" in text else None
    rest, asked, query = rest.partition("?")
    search = quote(query, safe=_IN_QUERY) if asked else None
    rest = rest.replace("\\", "/")
    if scheme and (base is None or scheme != base.scheme or rest.startswith("/")):
        rest = "//" + rest.lstrip("/")
    elif base is None or base.opaque is not None:
        return None
    else:
        scheme = base.scheme
    if rest.startswith("//"):
        authority, slash, path = rest.lstrip("/").partition("/")
        user, at, place = authority.rpartition("@")
        name, port = place, None
        if ported := re.fullmatch(r"(.*?):(\d*)", place):
            name, digits = ported.groups()
            if digits and int(digits) > 65535:
                return None
            port = int(digits) if digits and int(digits) != _PORTS[scheme] else None
        if (host := _host(name)) is None:
            return None
        path = _segments("/" + quote(path, safe=_IN_PATH))
        return Url(scheme, host, port, path, search, hash_, user=quote(user, safe=_ALWAYS) + at)
    if not rest:
        return replace(base, query=search if asked else base.query, fragment=hash_)
    whole = rest if rest.startswith("/") else base.path.rpartition("/")[0] + "/" + rest
    return replace(base, path=_segments(quote(whole, safe=_IN_PATH)), query=search, fragment=hash_)


@functools.lru_cache(maxsize=1 << 15)
def normalize(text: str | None) -> str | None:
    """An http(s) URL without fragment and tracking keys; else None."""
    url = parse(text)
    if url is None or url.opaque is not None:
        return None
    pairs = parse_qsl(url.query or "", keep_blank_values=True)
    stay = [(k, v) for k, v in pairs if k.lower() not in TRACKING_KEYS]
    query = url.query
    if not stay:
        query = None
    elif len(stay) < len(pairs):
        query = urlencode(stay, safe="*")
    return str(replace(url, query=query, fragment=None))


@functools.lru_cache(maxsize=1 << 15)
def resolve(href: str | None, base: str | None) -> str | None:
    """Where a link leads; None for none, an empty one or a mere fragment."""
    link = (href or "").strip()
    if not link or link.startswith("#"):
        return None
    url = parse(link, parse(base))
    return None if url is None else str(url)


def is_tracking(key: str) -> bool:
    return key.lower() in TRACKING_KEYS or key.lower().startswith("utm_")


def same_site(url: str | None, origin: str | None) -> bool:
    """Whether scheme aside both are of one host and port."""
    a, b = parse(url), parse(origin)
    return a is not None and b is not None and a.netloc == b.netloc


def path_depth(url: str) -> int:
    found = parse(url)
    return 0 if found is None else sum(s != "" for s in found.path.split("/"))


def registrable_domain(host: str) -> str | None:
    """The last two labels; None of an address or a single label."""
    labels = host.rstrip(".").split(".")
    if len(labels) < 2 or host.startswith("[") or re.fullmatch(r"[\d.]+", host):
        return None
    return ".".join(labels[-2:]).lower()


def matcher(pattern: str, origin: str) -> tuple[str, bool]:
    """(regular expression, whether it is one URL) of a URL or a glob.

    ``*`` is anything but ``/ ? #``, ``**`` anything; a glob ignores case and a
    last slash.  A path is read against ``origin``.
    """
    text = pattern.strip()
    if not re.match("(?i)https?://", text):
        text = origin.rstrip("/") + "/" + text.lstrip("/")
    if "*" not in text:
        return f"^{re.escape(normalize(text) or text)}$", True
    parts = re.split(r"(\*\*|\*)", text[:-1] if text.endswith("/") else text)
    body = "".join(".*" if p == "**" else "[^/?#]*" if p == "*" else re.escape(p) for p in parts)
    return f"(?i)^{body}/?$", False


def template(path: str) -> str:
    """A path with its varying segments named."""

    def one(segment: str) -> str:
        if re.fullmatch(r"\d+|[0-9a-fA-F]{8,}", segment):
            return ":id"
        if "-" in segment or "_" in segment:
            return ":slug"
        return ":id" if re.search(r"\d", segment) else segment

    return "/".join(one(s) if s else s for s in path.split("/"))


# columns

def _batched(one: Callable[..., object], kind: str) -> Callable[..., Column]:
    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*(None if v is None or v is pd.NA else v for v in row)) for row in zip(*columns, strict=True)], dtype=object)

    return run


def normalized(url: Column) -> Column:
    return _batched(normalize, "string")(url)


def host(url: Column) -> Column:
    """Host of a normalised URL."""
    return F.regexp_extract(url, r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://(?:[^/@?#]*@)?([^/?#]+)", 1)


def origin(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^(https?://)", 1), netloc(url))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)


def route(url: Column) -> Column:
    """Origin and path."""
    return F.regexp_extract(url, r"^([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def path_template(url: Column) -> Column:
    """Origin and path of a normalised URL, its varying segments named."""

    def one(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^(\d+|[0-9a-fA-F]{8,})$"), ":id").when(s.rlike("[-_]"), ":slug").when(s.rlike(r"\d"), ":id").otherwise(s)
        )

    return F.concat(origin(url), F.array_join(F.transform(F.split(path(url), "/"), one), "/"))


def query_pairs(url: Column) -> Column:
    """Query pairs as structs (key, value), undecoded."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(p.contains("="), F.regexp_extract(p, "=(.*)$", 1)).otherwise("").alias("value")))


def matchers(pattern: Column, origin_: Column) -> Column:
    """Struct (regex, exact, specificity) of a URL pattern."""

    def run(patterns: pd.Series, origins: pd.Series) -> pd.DataFrame:
        found = [matcher(p or "", o or "") for p, o in zip(patterns, origins, strict=True)]
        size = [1 << 30 if exact else len((p or "").replace("*", "")) for p, (_, exact) in zip(patterns, found, strict=True)]
        return pd.DataFrame({"regex": [f[0] for f in found], "exact": [f[1] for f in found], "specificity": size})

    return F.pandas_udf(run, "struct<regex:string,exact:boolean,specificity:int>")(pattern, origin_)


def of_site(url: Column, origin_: Column) -> Column:
    """Whether both are of one host and port."""
    return _batched(same_site, "boolean")(url, origin_)


def registrable(host_: Column) -> Column:
    """The registrable domain of a host; null of an address or a single label."""
    return _batched(lambda h: None if h is None else registrable_domain(h), "string")(host_)


def read_against(href: Column, base: Column) -> Column:
    """A link's URL read against a base, as it is; null if it is no URL."""
    return _batched(lambda h, b: None if h is None else resolve(h, b), "string")(href, base)


def resolved(href: Column, base: Column) -> Column:
    """A normalised URL of a link read against a base."""
    return _batched(lambda h, b: normalize(resolve(h, b)), "string")(href, base)
