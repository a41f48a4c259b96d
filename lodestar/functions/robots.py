"""robots.txt: parsing, and whether an agent may fetch a URL."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.url import parse as parse_url


@dataclass
class Group:
    agents: list[str] = field(default_factory=list)
    rules: list[tuple[bool, str]] = field(default_factory=list)
    delay: float | None = None


@dataclass
class Robots:
    groups: list[Group]
    sitemaps: list[str]

    def group(self, agent: str) -> Group | None:
        """The group of the longest agent name within ``agent``; else the first for all."""
        agent = agent.lower()
        named = [(len(a), -i, g) for i, g in enumerate(self.groups) for a in g.agents if a != "*" and a in agent]
        if named:
            return max(named, key=lambda x: x[:2])[2]
        return next((g for g in self.groups if "*" in g.agents), None)

    def allows(self, agent: str, url: str) -> bool:
        """By the longest rule that fits; of equally long ones, by one that allows."""
        group, at = self.group(agent), parse_url(url)
        if group is None or at is None or at.opaque is not None:
            return True
        path = at.path + ("" if at.query is None else f"?{at.query}")
        fits = [(len(p), allow) for allow, p in group.rules if _rule(p).match(path)]
        return max(fits)[1] if fits else True

    def delay_ms(self, agent: str) -> int:
        group = self.group(agent)
        return 0 if group is None or group.delay is None else math.floor(group.delay * 1000 + 0.5)


@functools.lru_cache(maxsize=4096)
def _rule(pattern: str) -> re.Pattern:
    body, end = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
    return re.compile(".*".join(map(re.escape, body.split("*"))) + end)


@functools.lru_cache(maxsize=256)
def parse(text: str) -> Robots:
    """Groups and sitemaps; a group ends at a User-agent line after its rules."""
    out = Robots([], [])
    group, naming = Group(), False
    for raw in text.splitlines():
        name, colon, value = raw.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not naming:
                group, naming = Group(), True
                out.groups.append(group)
            group.agents.append(value.lower())
        elif name in ("allow", "disallow"):
            naming = False
            if value:  # an empty rule says nothing
                group.rules.append((name == "allow", value))
        elif name == "crawl-delay":
            naming = False
            if number := re.match(r"[+-]?(\d+\.?\d*|\.\d+)", value):
                group.delay = float(number[0])
        elif name == "sitemap":
            out.sitemaps.append(value)
    return out


def effective(status: Column, text: Column) -> Column:
    """The robots.txt that holds: a server error shuts everyone out, any other answer
    without a text, and none at all, lets everyone in (null)."""
    return F.when((status >= 500) | (status == 429), F.lit("User-agent: *\nDisallow: /")).when(status.between(200, 299), text)


def allowed(text: str | None, agent: str, url: str) -> bool:
    """``text`` None: there is no robots.txt, and all is allowed."""
    return text is None or parse(text).allows(agent, url)


def _allowed_each(text: pd.Series, agent: pd.Series, urls: pd.Series) -> pd.Series:
    return pd.Series([None if us is None else [u is not None and allowed(t, a, u) for u in us] for t, a, us in zip(text, agent, urls, strict=True)])


def allowed_each(robots: Column, agent: str | Column, urls: Column) -> Column:
    """For every URL of an array, whether robots.txt lets the agent fetch it."""
    run = F.pandas_udf(_allowed_each, "array<boolean>")
    return run(robots, F.lit(agent) if isinstance(agent, str) else agent, urls)


def blocked_of(robots: Column, agent: str, urls: Column) -> Column:
    """Those of an array's URLs that robots.txt keeps the agent from."""
    marked = F.arrays_zip(urls.alias("url"), allowed_each(robots, agent, urls).alias("ok"))
    return F.transform(F.filter(marked, lambda x: ~x["ok"]), lambda x: x["url"])


def _groups(text: pd.Series) -> pd.Series:
    return pd.Series([
        None if t is None else [{"group_no": i, "agents": g.agents, "delay": g.delay, "rules": [{"allow": a, "path": p} for a, p in g.rules]} for i, g in enumerate(parse(t).groups)]
        for t in text
    ])


def _sitemaps(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else parse(t).sitemaps for t in text])


def groups(text: Column) -> Column:
    """The groups of robots.txt texts."""
    return F.pandas_udf(_groups, "array<struct<group_no:int,agents:array<string>,delay:double,rules:array<struct<allow:boolean,path:string>>>>")(text)


def sitemaps(text: Column) -> Column:
    """The sitemaps that robots.txt texts name."""
    return F.pandas_udf(_sitemaps, "array<string>")(text)
