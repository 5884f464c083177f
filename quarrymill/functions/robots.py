"""robots.txt: rules as data, so that the test of a path is an expression of columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = "array<struct<len: int, allow: boolean, pattern: string>>"
LEAST_DELAY, MOST_DELAY = 0.25, 30.0


@dataclass(frozen=True)
class Robots:
    """rules: (length of the written pattern, allow, regular expression)."""

    rules: tuple[tuple[int, bool, str], ...] = ()
    delay: float | None = None
    sitemaps: tuple[str, ...] = field(default=())

    def allows(self, path: str) -> bool:
        """The longest pattern that matches decides, Allow at a tie; without one the path is allowed."""
        best = max(((n, allow) for n, allow, rx in self.rules if re.match(rx, path or "/", re.S)), default=None)
        return best is None or best[1]


def pattern(written: str) -> str:
    """A regular expression: * is anything, $ at the end anchors, all else is literal."""
    anchored = written.endswith("$")
    body = written[:-1] if anchored else written
    return "^" + ".*".join(re.escape(x) for x in body.split("*")) + ("$" if anchored else "")


def parse(content: str | None, agent: str) -> Robots:
    """The group of the agent's own name, else that of *; agents in a row share a group and groups of one name join.
    Comments go, empty rules say nothing, a fraction of a delay counts as a whole second. Sitemaps belong to the file."""
    groups: dict[str, list] = {}
    delays: dict[str, float] = {}
    sitemaps: list[str] = []
    names: list[str] = []
    in_rules = True
    for line in (content or "").lstrip("\ufeff").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if not colon:
            continue
        if key == "sitemap":
            if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://", value):
                sitemaps.append(value)
        elif key == "user-agent":
            if in_rules:
                names, in_rules = [], False
            names.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            in_rules = True
            if value:
                for n in names:
                    groups[n].append((len(value), key == "allow", pattern(value)))
        elif key == "crawl-delay":
            in_rules = True
            if re.fullmatch(r"\d*\.?\d+", value):
                for n in names:
                    delays.setdefault(n, float(math.ceil(float(value))))
    own = agent.lower()
    short = own.partition("/")[0]
    name = next((n for n in (own, short, "*") if n in groups), None)
    return Robots(tuple(groups.get(name, ())), delays.get(name), tuple(sitemaps))


ALLOW_ALL = Robots()
DISALLOW_ALL = Robots(((1, False, "^/"),))


def from_response(status: int | None, body: bytes | None, agent: str, limit: int) -> tuple[Robots, bool]:
    """What a fetch of robots.txt means, and whether the server was unavailable. Success: its first `limit` bytes;
    500 and more: nothing is allowed; else (also no answer at all): everything."""
    if status is not None and 200 <= status < 300:
        return parse((body or b"")[:limit].decode("utf-8", "replace"), agent), False
    if status is not None and status >= 500:
        return DISALLOW_ALL, True
    return ALLOW_ALL, False


def allowed(path: Column, rules: Column) -> Column:
    """Robots.allows() of columns; rules of type RULES, null is no rule."""
    at = F.when(path.isNull() | (path == ""), F.lit("/")).otherwise(path)
    hits = F.filter(F.coalesce(rules, F.array().cast(RULES)), lambda r: F.regexp_like(at, F.concat(F.lit("(?s)"), r["pattern"], F.lit(""))))
    return F.coalesce(F.array_max(F.transform(hits, lambda r: F.struct(r["len"].alias("len"), r["allow"].alias("allow"))))["allow"], F.lit(True))


def request_delay(delay: Column) -> Column:
    """Seconds between requests to a host: at least 0.25, at most 30."""
    return F.greatest(F.lit(LEAST_DELAY), F.least(F.coalesce(delay.cast("double"), F.lit(0.0)), F.lit(MOST_DELAY)))
