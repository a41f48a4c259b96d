"""What detectors ask of structured data: products, articles, paywalls, reviews."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

Json = Any
_GTINS = ("gtin", "gtin8", "gtin12", "gtin13", "gtin14")
DERIVED = (
    "struct<site_name:string,"
    "product:struct<name:boolean,review:boolean,image:boolean,identifier:boolean,"
    "offers:array<struct<price:double,has_price:boolean,currency:string,has_currency:boolean,has_availability:boolean>>,availability:array<string>,gtins:array<string>>,"
    "article:struct<author:string,published:string,modified:string>,"
    "paywall:array<struct<access:string,parts:array<struct<selector:boolean,access:string>>>>,"
    "reviews:array<struct<own:boolean,author:boolean,rating_without_count:boolean,dated:boolean>>,"
    "organizations:array<struct<name:string,same_as:array<string>>>,"
    "businesses:array<struct<name:string,address:string,phone:string>>,"
    "videos:array<struct<name:boolean,thumbnail:boolean,uploaded:string,content_url:string,embed_url:string>>,"
    "commented:boolean>"
)


def flat(value: Json) -> list[Json]:
    return value if isinstance(value, list) else [] if value is None else [value]


def types(node: Json) -> list[str]:
    return [t for t in flat(node.get("@type")) if isinstance(t, str)] if isinstance(node, dict) else []


def bare(kind: str) -> str:
    return re.sub(r"^(https?://schema\.org/|schema:)", "", kind)


def present(value: Json) -> bool:
    return value is not None and (value.strip() != "" if isinstance(value, str) else len(value) > 0 if isinstance(value, list) else True)


def text(value: Json) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def top(value: Json) -> Iterator[dict]:
    """Nodes at the top, in arrays and in @graph."""
    for node in flat(value):
        if isinstance(node, list):
            yield from top(node)
        elif isinstance(node, dict):
            yield node
            if isinstance(node.get("@graph"), list):
                yield from top(node["@graph"])


def deep(value: Json) -> Iterator[dict]:
    """All objects within, outermost first."""
    if isinstance(value, list):
        for each in value:
            yield from deep(each)
    elif isinstance(value, dict):
        yield value
        for each in value.values():
            yield from deep(each)


def _key(node: dict, name: str) -> Json:
    return next((v for k, v in node.items() if k.lower() == name), None)


def _access(node: dict) -> str:
    value = _key(node, "isaccessibleforfree")
    if not any(k.lower() == "isaccessibleforfree" for k in node):
        return "absent"
    word = str(value).strip().lower() if isinstance(value, bool | str) else ""
    return word if word in ("true", "false") else "invalid"


def _named(value: Json) -> str | None:
    for one in flat(value):
        name = text(one) or (isinstance(one, dict) and (text(one.get("name")) or text(one.get("@id")))) or None
        if name:
            return name
        return None
    return None


def _number(value: Json) -> float | None:
    try:
        found = float(str(value).replace(",", ".")) if isinstance(value, str | int | float) and not isinstance(value, bool) else None
    except ValueError:
        return None
    return found if found is not None and abs(found) != float("inf") else None


def _availability(node: Json) -> list[str]:
    """The last words of all availabilities within."""
    words = []
    for each in deep(node):
        for key, value in each.items():
            if key.lower() == "availability":
                words += [w for t in flat(value) if isinstance(t, str) and (w := re.split("[/#]", t)[-1].strip().lower())]
    return words


def product(blocks: list[Json]) -> dict | None:
    node = next((n for b in blocks for n in top(b) if any(re.fullmatch("(?i)Product|ProductGroup|ProductModel", t) for t in types(n))), None)
    if node is None:
        return None
    offers = [o for o in deep(node) if any(re.fullmatch("(?i)Offer|AggregateOffer", t) for t in types(o))]

    def priced(offer: dict, name: str) -> Json:
        spec = offer.get("priceSpecification")
        return offer[name] if offer.get(name) is not None else spec.get(name) if isinstance(spec, dict) else None

    def digits(value: Json) -> str | None:
        return re.sub(r"\D", "", str(value)).lstrip("0") or None if isinstance(value, str | int | float) else None

    return {
        "name": present(node.get("name")), "review": present(node.get("review")) or present(node.get("aggregateRating")), "image": present(node.get("image")),
        "identifier": any(present(node.get(k)) for k in (*_GTINS, "mpn")) or (present(node.get("brand")) and present(node.get("sku"))),
        "offers": [
            {
                "price": _number(priced(o, "price")), "has_price": present(o.get("price")), "currency": (text(priced(o, "priceCurrency")) or "").upper() or None,
                "has_currency": present(o.get("priceCurrency")), "has_availability": present(o.get("availability")),
            }
            for o in offers
        ],
        "availability": _availability(node),
        "gtins": [d for n in (node, *offers) for k in _GTINS if (d := digits(n.get(k)))],
    }


def derived(blocks: list[Json], og_site_name: str | None, article_types: frozenset[str]) -> dict:
    nodes = [n for b in blocks for n in top(b)]
    every = [n for b in blocks for n in deep(b)]
    article = next((n for n in nodes if any(bare(t) in article_types for t in types(n))), None)
    named = next((n["name"] for n in nodes if {"WebSite", "Organization"} & set(types(n)) and text(n.get("name"))), None)
    own = {n["name"].strip().lower() for n in nodes if {"WebSite", "Organization"} & set(map(bare, types(n))) and text(n.get("name"))}
    paywall = []
    for n in nodes:
        parts = [p for p in flat(_key(n, "haspart")) if isinstance(p, dict)]
        if parts or _access(n) != "absent":
            paywall.append({"access": _access(n), "parts": [{"selector": present(_key(p, "cssselector")), "access": _access(p)} for p in parts]})
    reviews = []
    for n in every:
        if not {"Review", "AggregateRating"} & set(map(bare, types(n))):
            continue
        about = n.get("itemReviewed")
        count = _number(n.get("reviewCount")) if n.get("reviewCount") is not None else _number(n.get("ratingCount"))
        reviews.append({
            "own": isinstance(about, dict) and (_named(about) or "").strip().lower() in own if own else False,
            "author": "AggregateRating" in map(bare, types(n)) or present(n.get("author")), "rating_without_count": count == 0 and present(n.get("ratingValue")),
            "dated": "AggregateRating" in map(bare, types(n)) or present(n.get("datePublished")),
        })

    def address(value: Json) -> str | None:
        return text(value) or (", ".join(str(value[k]) for k in ("streetAddress", "addressLocality", "postalCode") if present(value.get(k))) or None if isinstance(value, dict) else None)

    return {
        "site_name": og_site_name or named, "product": product(blocks),
        "article": None if article is None else {"author": _named(article.get("author")), "published": text(article.get("datePublished")), "modified": text(article.get("dateModified"))},
        "paywall": paywall, "reviews": reviews,
        "organizations": [{"name": text(n.get("name")), "same_as": [s for s in flat(n.get("sameAs")) if isinstance(s, str)]} for n in nodes if "Organization" in map(bare, types(n))],
        "businesses": [{"name": text(n.get("name")), "address": address(n.get("address")), "phone": text(n.get("telephone"))} for n in nodes if any("Business" in t for t in types(n))],
        "videos": [
            {"name": present(n.get("name")), "thumbnail": present(n.get("thumbnailUrl")), "uploaded": text(n.get("uploadDate")), "content_url": text(n.get("contentUrl")), "embed_url": text(n.get("embedUrl"))}
            for n in every if "VideoObject" in map(bare, types(n))
        ],
        "commented": any("Comment" in map(bare, types(n)) for n in every),
    }
