"""URL columns: parts, origin, canonical form, scope rules, site filter. All stay in the JVM.

Only URLs of the form scheme://host… count as absolute; anything else gives null (or false for predicates). Hosts and
schemes compare without case. Dot segments of paths are resolved, percent escapes are left as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?(\[[^\]/?#]*\]|[^/?#:@]+)(?::([0-9]*))?([^?#\s]*)(\?[^#\s]*)?(#.*)?\s*$"
#: Query parameters that only track, besides all that begin with utm_.
TRACKING = tuple(sorted("yclid wbraid vero_id spm ref_src oly_enc_id oly_anon_id msclkid mc_eid mc_cid igshid gclsrc gclid gbraid fbclid dclid _openstat _hsmi _hsenc".split()))
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21}


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def is_absolute(url: Column) -> Column:
    return F.coalesce(F.regexp_like(url, F.lit(PARTS)), F.lit(False))


_HIT, _CUT = "\x02", "\x01"


def _let(value: Column, body) -> Column:
    """body(value), with the value made once however often the body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _of(url: Column, body) -> Column:
    """body(parts) of an absolute URL: scheme, user, host, port, path, query with its ?, each '' if it is missing. Null for
    what is no absolute URL. One match makes all parts: expressions that matched anew for each grew beyond what compiles."""
    whole = F.regexp_replace(url, PARTS, _HIT + _CUT.join(f"${i}" for i in range(1, 7)))
    ready = lambda s: F.startswith(s, F.lit(_HIT)) & (F.length(F.translate(s, _CUT, "")) == F.length(s) - 5)
    return _let(whole, lambda s: F.when(ready(s), _let(F.split(F.substring(s, 2, 1 << 30), _CUT, -1), body)))


def _port(p: Column) -> Column:
    known = reduce(lambda c, kv: c.when(F.lower(p[0]) == kv[0], kv[1]), DEFAULT_PORTS.items(), F.when(F.lit(False), None))
    return F.coalesce(F.when(p[3] != "", p[3]).try_cast("int"), known)


def _shown_port(p: Column) -> Column:
    """:port, '' for a scheme's default one."""
    default = reduce(lambda c, kv: c.when(F.lower(p[0]) == kv[0], kv[1]), DEFAULT_PORTS.items(), F.when(F.lit(False), None))
    return F.when((p[3] == "") | F.coalesce(p[3].try_cast("int") == default, F.lit(False)), F.lit("")).otherwise(F.concat(F.lit(":"), p[3]))


def _path(p: Column) -> Column:
    return F.when(p[4] == "", F.lit("/")).otherwise(p[4])


def scheme(url: Column) -> Column:
    return _of(url, lambda p: F.lower(p[0]))


def host(url: Column) -> Column:
    return _of(url, lambda p: F.lower(p[2]))


def port(url: Column) -> Column:
    """The port, a scheme's default one if none is named; null for schemes without one."""
    return _of(url, _port)


def path(url: Column) -> Column:
    """The path, / if it is empty; null for what is no absolute URL."""
    return _of(url, _path)


def path_and_query(url: Column) -> Column:
    return _of(url, lambda p: F.concat(_path(p), p[5]))


def origin(url: Column) -> Column:
    """scheme://host:port with the default port filled in."""
    return _of(url, lambda p: F.concat(F.lower(p[0]), F.lit("://"), F.lower(p[2]), F.lit(":"), F.coalesce(_port(p).cast("string"), F.lit("-1"))))


def base(url: Column) -> Column:
    """The URL's root, without a default port."""
    return _of(url, lambda p: F.concat(F.lower(p[0]), F.lit("://"), F.lower(p[2]), _shown_port(p)))


def strip_tracking(query: Column) -> Column:
    """A query without ?, less empty pairs and tracking parameters; the others keep their order."""

    def stays(pair: Column) -> Column:
        key = F.lower(F.split_part(pair, F.lit("="), F.lit(1)))
        return (pair != "") & ~key.startswith("utm_") & ~key.isin(*TRACKING)

    return F.array_join(F.filter(F.split(query, "&"), stays), "&")


def normalise(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no slashes at the path's end, no tracking; dot segments
    resolved; null for null and for what is no absolute URL."""

    def whole(p: Column) -> Column:
        user = F.when(p[1] == "", F.lit("")).otherwise(F.concat(p[1], F.lit("@")))
        trimmed = F.rtrim(_dotless(_path(p)), F.lit("/"))
        query = _let(strip_tracking(F.substring(p[5], 2, 1 << 30)), lambda q: F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
        return F.concat(F.lower(p[0]), F.lit("://"), user, F.lower(p[2]), _shown_port(p), _let(trimmed, lambda t: F.when(t == "", F.lit("/")).otherwise(t)), query)

    return _of(url, whole)


def _dotless(path: Column) -> Column:
    """A path without . and .. segments; a .. takes the segment before it along."""

    def step(done: Column, segment: Column) -> Column:
        return F.when(segment == ".", done).when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(segment)))

    folded = F.aggregate(F.slice(F.split(path, "/", -1), 2, 1 << 30), F.array(F.lit("")), step)
    return F.when(F.contains(path, F.lit("/.")), F.array_join(folded, "/")).otherwise(path)


def matches_site(url: Column, sites: list[str]) -> Column:
    """Whether the host is one of the sites or below one. No sites: true."""
    if not sites:
        return F.lit(True)
    one = lambda p, s: (F.lower(p[2]) == s.lower()) | F.endswith(F.lower(p[2]), F.lit("." + s.lower()))
    return F.coalesce(_of(url, lambda p: reduce(lambda a, b: a | b, [one(p, s) for s in sites])), F.lit(False))


def file_name(url: Column) -> Column:
    """Last path segment, unescaped (a plus stays one), without extension, dashes and underscores as spaces."""
    last = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1)
    plus = F.replace(last, F.lit("+"), F.lit("%2B"))
    plain = F.coalesce(F.try_url_decode(plus), last)
    return F.translate(F.regexp_replace(plain, r"\.[^.]*$", ""), "-_", "  ")


def file_name_contains(url: Column, query: Column) -> Column:
    name = file_name(url)
    return F.coalesce((F.regexp_replace(path(url), "/+$", "") != "") & F.contains(F.lower(name), F.lower(F.translate(query, "-_", "  "))), F.lit(False))


@dataclass(frozen=True)
class HostRule:
    """A scope rule; null parts match everything."""

    scheme: str | None
    host: str
    port: int | None


def parse_host_rule(entry: str | None) -> HostRule | None:
    """[scheme://]host[:port], slashes at the end allowed; None for anything else: a path, a port out of range, an IPv6
    address without brackets."""
    m = re.fullmatch(r"(?:(?P<s>[A-Za-z][A-Za-z0-9+.\-]*)://)?(?P<h>\[[^\]/]+\]|[^\[/:][^/:]*)(?::(?P<p>\d+))?/*", (entry or "").strip(), re.A)
    if not m or m["p"] is not None and not 1 <= int(m["p"]) <= 65535:
        return None
    return HostRule(m["s"] and m["s"].lower(), m["h"].lower(), int(m["p"]) if m["p"] else None)


def origin_rule(url: str) -> HostRule | None:
    """The rule that pins a URL's scheme, host and port."""
    m = re.match(PARTS, url or "")
    return m and HostRule(m[1].lower(), m[3].lower(), int(m[4]) if m[4] else DEFAULT_PORTS.get(m[1].lower()))


def in_scope(url: Column, rules: list[HostRule]) -> Column:
    """Whether any rule allows the URL, which has to be http or https. No rules: false."""
    if not rules:
        return F.lit(False)

    def any_rule(p: Column) -> Column:
        one = [(F.lower(p[2]) == r.host) & (F.lit(True) if r.scheme is None else F.lower(p[0]) == r.scheme) & (F.lit(True) if r.port is None else _port(p) == r.port) for r in rules]
        return F.lower(p[0]).isin("http", "https") & reduce(lambda a, b: a | b, one)

    return F.coalesce(_of(url, any_rule), F.lit(False))


# The same on the driver and in workers that parse pages.


def normalise_text(url: str | None) -> str | None:
    m = re.match(PARTS, url or "")
    if not m:
        return None
    s, h = m[1].lower(), m[3].lower()
    shown = "" if not m[4] or int(m[4]) == DEFAULT_PORTS.get(s) else f":{m[4]}"
    pairs = [p for p in (m[6] or "")[1:].split("&") if p and not p.split("=")[0].lower().startswith("utm_") and p.split("=")[0].lower() not in TRACKING]
    path = m[5]
    if "/." in path:
        done = [""]
        for x in path.split("/")[1:]:
            done = done if x == "." else done[: max(1, len(done) - 1)] if x == ".." else [*done, x]
        path = "/".join(done)
    return f"{s}://{m[2] + '@' if m[2] else ''}{h}{shown}{path.rstrip('/') or '/'}" + ("?" + "&".join(pairs) if pairs else "")


def origin_text(url: str | None) -> str | None:
    r = origin_rule(url or "")
    return f"{r.scheme}://{r.host}:{-1 if r.port is None else r.port}" if r else None


def path_and_query_text(url: str) -> str:
    m = re.match(PARTS, url)
    return (m[5] or "/") + (m[6] or "") if m else "/"


def in_scope_text(url: str, rules: list[HostRule]) -> bool:
    r = origin_rule(url)
    return bool(r) and r.scheme in ("http", "https") and any(x.host == r.host and x.scheme in (None, r.scheme) and x.port in (None, r.port) for x in rules)
