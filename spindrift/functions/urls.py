"""URLs as Spark expressions: parts, the canonical form, resolution against a base, and the policy that a URL must meet.

Everything is a regular expression or string function of the JVM, so URL predicates run inside the scan's stage. A URL
that can't be made canonical gives null."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: scheme, user part, host or bracketed address, port, path, query.
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:([^/?#@]*)@)?(\[[0-9A-Fa-f:.%]+\]|[^/?#:@\[\]]*)(?::([^/?#]*))?([^?#]*)(\?[^#]*)?(?:#.*)?$"
_REST = r"/(?:[^?#]*[^?#\s\x00-\x1f])?(?:\?[^#]*[^#\s\x00-\x1f])?(?:#.*)?\z"
#: A URL that is canonical but for a fragment, as most are: one match spares it the taking apart and joining.
_CANONICAL = r"\Ahttps?://[a-z0-9._~\-]*[a-z0-9_~\-]" + _REST
#: Such a URL whose host is a public name: one that ends in a letter, and isn't the local machine's.
_NAMED = r"\Ahttps?://(?!localhost(?:\.localdomain)?/)[a-z0-9._~\-]*[a-z]" + _REST


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with the value computed once however often make uses it: expressions that repeat their input grow with
    every level, and Catalyst with them."""
    return F.get(F.transform(F.array(value), make), 0)


def _named(**parts: Column) -> Column:
    """A struct whose names don't hang on aliases, which the optimizer drops where a Python UDF feeds it."""
    return F.named_struct(*[x for name, c in parts.items() for x in (F.lit(name), c)])


def trimmed(url: Column) -> Column:
    return F.regexp_replace(url, r"^[\s\x00-\x1f]+|[\s\x00-\x1f]+$", "")


def _host_of(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^[^/]+//(\[[^\]]*\]|[^/:?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-cased host without trailing dots, brackets kept; null where the URL isn't absolute."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(trimmed(url), _PARTS, 3)), r"\.+$", ""), F.lit(""))


def domain_key(url: Column) -> Column:
    """The host that a per-domain limit counts by: one for all schemes and ports."""
    return F.regexp_replace(host(url), r"[\[\]]", "")


def canonicalize(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, "/" for an empty path; path and query as they are.

    Null for a relative URL, one with user info, without a host or with a port that isn't within 1 to 65535."""

    def parts(u: Column) -> Column:
        part = lambda i: F.regexp_extract(u, _PARTS, i)
        return _named(scheme=F.lower(part(1)), user=part(2), host=F.regexp_replace(F.lower(part(3)), r"\.+$", ""), port=part(4), number=part(4).try_cast("int"), path=part(5), query=part(6))

    def joined(p: Column) -> Column:
        number = p["number"]
        default = ((p["scheme"] == "http") & (number == 80)) | ((p["scheme"] == "https") & (number == 443))
        plain = p["port"] == ""
        good = (p["scheme"] != "") & (p["user"] == "") & (p["host"] != "") & (plain | (p["port"].rlike("^[0-9]+$") & number.between(1, 65535)))
        shown = F.when(plain | default, "").otherwise(F.concat(F.lit(":"), number.cast("string")))
        return F.when(good, F.concat(p["scheme"], F.lit("://"), p["host"], shown, F.when(p["path"] == "", "/").otherwise(p["path"]), F.when(p["query"] == "?", "").otherwise(p["query"])))

    return F.when(url.rlike(_CANONICAL), F.substring_index(url, "#", 1)).otherwise(let(let(trimmed(url), parts), joined))


def origin(url: Column) -> Column:
    """Scheme, host and port of the canonical URL."""
    return F.regexp_extract(canonicalize(url), "^[^/]+//[^/]+", 0)


def crawl_key(url: Column) -> Column:
    """The canonical URL, or the URL itself where it has none."""
    return F.coalesce(canonicalize(url), url)


def json_suffix(url: Column) -> Column:
    """The URL's path with .json at its end, for APIs that want it, without the query."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    return F.when(path.endswith(".json"), path).otherwise(F.concat(path, F.lit(".json")))


def resolve(base: Column, link: Column) -> Column:
    """The canonical URL of a link found on a page.

    Absolute links, links from the root and links by scheme are resolved in the JVM; only relative ones, whose dot
    segments need a stack, go through an Arrow UDF, and only for their rows."""
    absolute = link.rlike(r"^\s*[A-Za-z][A-Za-z0-9+.\-]*:")
    by_scheme = link.rlike(r"^\s*//")
    rooted = link.rlike(r"^\s*/") & ~link.rlike(r"/\.{1,2}(/|$|\?)")
    relative = ~(absolute | by_scheme | rooted)
    joined = join_url(F.when(relative, base), F.when(relative, link))
    full = F.when(absolute, link).when(by_scheme, F.concat(F.regexp_extract(base, "^[^/]+", 0), trimmed(link))).when(rooted, F.concat(origin(base), trimmed(link))).otherwise(joined)
    return let(full, canonicalize)


@F.pandas_udf(StringType())
def join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([_join(b, x) for b, x in zip(base, link)], dtype=object)


def _join(base: str | None, link: str | None) -> str | None:
    try:
        return None if base is None or link is None else urljoin(base, link.strip())
    except ValueError:
        return None


def next_url(current: str, token: str | None, query_param: str = "after", json_cursor: bool = False) -> str | None:
    """The page after the current one: a link is resolved; a cursor of a JSON API is set as a query parameter.

    No token, or an empty one, ends the walk."""
    if not token:
        return None
    if not json_cursor or token.startswith(("http://", "https://", "/")):
        return _join(current, token)
    parts = urlsplit(current)
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k != query_param]
    return urlunsplit(parts._replace(query=urlencode([*kept, (query_param, token)])))


@dataclass(frozen=True)
class UrlPolicy:
    """Which URLs may be processed."""

    allowed_domains: Sequence[str] = ()
    allow_subdomains: bool = False
    allow_external_urls: bool = False
    allowed_schemes: Sequence[str] = ("http", "https")
    block_private_networks: bool = True

    def _domains(self) -> tuple[list[str], list[str]]:
        names = [n for d in self.allowed_domains if (n := (d or "").lower().strip().rstrip("."))]
        return [d[1:] for d in names if d.startswith("*.")], [d for d in names if not d.startswith("*.")]

    def domain_allowed(self, h: Column, exact: Column | None = None, subdomains: Column | None = None) -> Column:
        """Whether a host is one of the domains; "*.d" stands for what is below d, not for d itself."""
        wild, plain = self._domains()
        out = (h if exact is None else exact).isin(plain) if plain else F.lit(False)
        for suffix in wild:
            out = out | (h.endswith(suffix) & (h != suffix[1:]))
        if self.allow_subdomains:
            for d in plain:
                below = h.endswith("." + d)
                out = out | (below if subdomains is None else below & subdomains)
        return out

    def origin_allowed(self, url: Column, parent: Column) -> Column:
        """Same origin as the parent; or external, where that is allowed, and of an allowed domain. A port that is
        written out is part of the name to match."""
        same = F.coalesce(origin(url) == origin(parent), F.lit(False))
        if not self.allow_external_urls:
            return same

        def external(canonical: Column) -> Column:
            shown = F.regexp_extract(canonical, "^[^/]+//([^/]+)", 1)
            return self.domain_allowed(_host_of(canonical), exact=shown, subdomains=~shown.rlike(r":[0-9]+$"))

        return same | F.coalesce(let(canonicalize(url), external), F.lit(False))

    def reject_reason(self, url: Column, parent: Column | None = None, dns_private: Column | None = None) -> Column:
        """Null for a URL that is allowed, else why it isn't: invalid, scheme, private, dns, domain or origin, the first
        that holds. dns_private tells, from a table of resolved hosts, whether a host leads to a private address; null
        where it couldn't be resolved counts as such."""
        foreign = F.lit(False) if parent is None else parent.isNotNull() & ~self.origin_allowed(url, parent)

        def reason(x: Column) -> Column:
            c, h = x["c"], x["h"]
            out = F.when(c.isNull(), "invalid").when(~F.regexp_extract(c, "^[^:]+", 0).isin(*self.allowed_schemes), "scheme")
            if self.block_private_networks:
                out = out.when(is_private_host(h), "private")
            if dns_private is not None:
                out = out.when(x["dns"], "dns")
            if self.allowed_domains:
                out = out.when(~self.domain_allowed(h), "domain")
            return out.when(x["foreign"], "origin")

        def plainly_allowed() -> Column:
            """A public name of the parent's own origin, both as written: no more than two matches tell it."""
            same = F.lit(True) if parent is None else parent.isNull() | (parent.rlike(_CANONICAL) & (F.substring_index(url, "/", 3) == F.substring_index(parent, "/", 3)))
            return F.coalesce(url.rlike(_NAMED) & same, F.lit(False))

        dns = F.lit(False) if dns_private is None else F.coalesce(dns_private, F.lit(True))
        found = let(canonicalize(url), lambda c: _named(c=c, h=_host_of(c)))
        out = let(_named(c=found["c"], h=found["h"], dns=dns, foreign=foreign), reason)
        if dns_private is None and not self.allowed_domains and {"http", "https"} <= set(self.allowed_schemes):
            return F.when(~plainly_allowed(), out)
        return out


#: Blocks of IPv4 that aren't public: first address and number of fixed bits.
PRIVATE_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 29), ("192.0.0.170", 31),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]


def is_private_host(h: Column) -> Column:
    """Local names and addresses that aren't public. IPv4 is compared as a number; of IPv6 the local, unique-local,
    link-local, multicast, documentation and mapped blocks are told by their first groups. False for other names."""

    def private(x: Column) -> Column:
        v4 = F.lit(False)
        for first, bits in PRIVATE_V4:
            a = sum(int(v) << (8 * (3 - i)) for i, v in enumerate(first.split(".")))
            v4 = v4 | x["number"].between(a, a + (1 << (32 - bits)) - 1)
        inner = F.regexp_replace(x["h"], r"^\[|\]$", "")
        v6 = inner.contains(":") & inner.rlike(r"(?i)^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|ff[0-9a-f]{2}:|2001:db8:|::ffff:|100::|64:ff9b:1:)")
        return F.coalesce(x["h"].isin("localhost", "localhost.localdomain") | F.coalesce(v4, F.lit(False)) | v6, F.lit(False))

    def number(x: Column) -> Column:
        octets = F.split(x, r"\.")
        total = sum((F.get(octets, i).try_cast("bigint") * (1 << (8 * (3 - i))) for i in range(4)), F.lit(0).cast("bigint"))
        v4 = x.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$") & ~x.endswith(".")
        return _named(h=x, number=F.when(v4, total))

    # A name that ends in a letter, without colons, is no address.
    return F.when(h.rlike(r"\A[^:]*[A-Za-z]\z"), h.isin("localhost", "localhost.localdomain")).otherwise(let(let(h, number), private))
