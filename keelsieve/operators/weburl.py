"""Addresses and pages as relations: canonical forms, scope, scripts, links, robots, guarded ranges. Nothing is fetched."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Sequence
from html.parser import HTMLParser
from urllib.parse import quote_plus, unquote_plus, urljoin, urlsplit, urlunsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from keelsieve.shared import materialise

# Address ranges that are never fetched, script endings, limits in bytes.
BLOCKED = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "::1/128", "fc00::/7", "fe80::/10")
SCRIPT_ENDINGS = (".js", ".mjs", ".cjs")
PAGE_BYTES = SCRIPT_BYTES = 25 * 1024 * 1024
#: Places that the addresses of one host are spread over.
SALTS = 64
_SOURCE_MAP = re.compile(r"//[@#]\s*sourceMappingURL=(\S+)")


def canonical(url: str | None) -> str | None:
    """One spelling per address: lower-case scheme and host, no default port, fragment or final slash, sorted query. None if not absolute."""
    if url is None:
        return None
    try:
        u = urlsplit(url.strip())
    except ValueError:
        return None
    scheme, host = u.scheme.lower(), u.netloc.lower()
    if not scheme or not host:
        return None
    for s, port in (("http", ":80"), ("https", ":443")):
        if scheme == s:
            host = host.removesuffix(port)
    path = u.path or "/"
    if path != "/":
        path = path.removesuffix("/") or "/"
    query = u.query
    if query:
        pairs: dict[str, list[str]] = {}
        for part in query.split("&"):
            if part and ";" not in part:
                k, _, v = part.partition("=")
                pairs.setdefault(unquote_plus(k), []).append(unquote_plus(v))
        query = "&".join(f"{quote_plus(k, safe='~')}={quote_plus(v, safe='~')}" for k in sorted(pairs) for v in sorted(pairs[k]))
    return urlunsplit((scheme, host, path, query, ""))


def canonical_url(c: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(canonical)

    return run(c)


def url_fingerprint(canonical_: Column) -> Column:
    return F.sha2(canonical_, 256)


def in_domains(host: Column, domains: Sequence[str]) -> Column:
    """Host equals an allowed domain or lies below one, whatever the case; an empty list allows all."""
    wanted = [d.strip().lower() for d in domains if d.strip()]
    if not domains:
        return F.lit(True)
    h = F.lower(host)
    out = F.lit(False)
    for d in wanted:
        out = out | (h == d) | h.endswith("." + d)
    return out


def path_excluded(path: Column, prefixes: Sequence[str]) -> Column:
    """Path equals a prefix or continues it at a slash."""
    out = F.lit(False)
    for p in (x.strip() for x in prefixes):
        if p:
            out = out | (path == p) | path.startswith(p.removesuffix("/") + "/")
    return out


def is_script(path: Column) -> Column:
    p = F.lower(path)
    out = F.lit(False)
    for e in SCRIPT_ENDINGS:
        out = out | p.endswith(e)
    return out


def is_page(content_type: Column) -> Column:
    """HTML by its declared type, or of no declared type."""
    t = F.lower(F.trim(F.coalesce(content_type, F.lit(""))))
    return (t == "") | t.contains("text/html")


def source_map(body: Column) -> Column:
    """The source map a script refers to, NULL for none and for inline data."""
    m = F.regexp_extract(body, r"//[@#]\s*sourceMappingURL=(\S+)", 1)
    return F.when((m != "") & ~F.lower(m).startswith("data:"), m)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.inline: list[str] = []
        self.linked: list[str] = []
        self.links: list[str] = []
        self._script: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script":
            if "src" in a:
                self.linked.append(a["src"] or "")
            self._script = None if "src" in a else []
        elif tag in ("a", "link") and a.get("href"):
            self.links.append((tag, a["href"]))

    def handle_data(self, data):
        if self._script is not None:
            self._script.append(data)

    def handle_endtag(self, tag):
        if tag == "script" and self._script is not None:
            body = "".join(self._script).strip()
            if body:
                self.inline.append(body)
            self._script = None


def _resolve(base: str, ref: str) -> str | None:
    ref = ref.strip()
    if not ref or ref.lower().startswith(("data:", "blob:", "javascript:")):
        return None
    try:
        u = urlsplit(urljoin(base, ref))
        return urlunsplit((u.scheme, u.netloc, u.path, u.query, ""))
    except ValueError:
        return None


def parse_page(url: str | None, body: str | None) -> tuple[list[str], list[str], list[str]]:
    """(inline script bodies, linked scripts, other links) of a page; links absolute, without fragment, in order, each once."""
    if not body:
        return [], [], []
    p = _Page()
    p.feed(body)
    p.close()
    p.handle_endtag("script")
    base = url or ""
    scripts, pages = [], []
    refs = list(p.linked)
    for text in p.inline:
        m = _SOURCE_MAP.search(text)
        if m:
            refs.append(m[1])
    for tag, ref in p.links:
        full = _resolve(base, ref)
        if full and urlsplit(full).path.lower().endswith(SCRIPT_ENDINGS):
            refs.append(ref)
        elif full and tag == "a":
            pages.append(full)
    for ref in refs:
        full = _resolve(base, ref)
        if full:
            scripts.append(full)
    return p.inline, list(dict.fromkeys(scripts)), list(dict.fromkeys(pages))


def parsed(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """Pages with ``inline``, ``scripts`` and ``links`` in place of their body; bodies above the size limit are left out."""

    @F.pandas_udf("inline array<string>, scripts array<string>, links array<string>")
    def run(u: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(x, y) for x, y in zip(u, b)], columns=["inline", "scripts", "links"])

    kept = pages.where(F.octet_length(body) <= PAGE_BYTES)
    return kept.withColumn("__x", run(F.col(url), F.col(body))).select(*[c for c in pages.columns if c not in (body, "inline", "scripts", "links")], "__x.*")


def inline_scripts(pages: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Inline scripts of all pages, each body once: where it comes first in ``order``."""
    rows = pages.select(key, *[c for c in order if c != key], F.posexplode("inline").alias("no", "body")).withColumn("body_hash", F.sha2("body", 256))
    first = rows.groupBy("body_hash").agg(F.min_by(F.struct(F.col(key).alias(key), F.col("no").alias("no"), F.col("body").alias("body")), F.struct(*order, "no")).alias("f"))
    return first.select("f.*", "body_hash")


def claim(links: DataFrame, seen: DataFrame, max_pages: int, domains: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    """New addresses of a crawl round in scope, each once, at most ``max_pages`` by their order (``depth``, ``url``).

    ``links``: url, depth. ``seen``: fingerprint. The page budget is a feature of a crawl, taken over the whole round.
    """
    rows = links.select(canonical_url(F.col("url")).alias("url"), "depth").where("url IS NOT NULL")
    host = F.parse_url("url", F.lit("HOST"))
    rows = rows.where(in_domains(host, domains) & ~path_excluded(F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")), excluded))
    rows = rows.groupBy("url").agg(F.min("depth").alias("depth")).withColumn("fingerprint", url_fingerprint(F.col("url")))
    return rows.join(seen.select("fingerprint"), "fingerprint", "left_anti").orderBy("depth", "url").limit(max_pages)


def crawl(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], max_depth: int, max_pages: int, domains: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    """The pages (url, depth, fingerprint) that a crawl from ``start`` (url) claims, round by round: each once, at the least depth.

    ``fetch`` gives the bodies (url, html) of claimed addresses; nothing else touches a network. Links of a page are a level
    deeper. It ends at ``max_depth``, once ``max_pages`` are claimed, or when nothing new is linked.
    """
    links = start.select("url", F.lit(0).alias("depth"))
    claimed = None
    left = max_pages
    for depth in range(max_depth + 1):
        seen = links.select(F.lit("").alias("fingerprint")).where("false") if claimed is None else claimed.select("fingerprint")
        found = materialise(claim(links, seen, left, domains, excluded), "claimed")
        claimed = found if claimed is None else claimed.unionByName(found)
        left = max_pages - claimed.count()
        if depth == max_depth or left <= 0 or found.isEmpty():
            break
        links = parsed(fetch(found)).select(F.explode("links").alias("url"), F.lit(depth + 1).alias("depth"))
    return claimed.select("url", "depth", "fingerprint")


def new_addresses(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct canonical addresses with their fingerprints; malformed ones are dropped."""
    c = urls.select(canonical_url(F.col(url)).alias("url")).where("url IS NOT NULL").distinct()
    return c.withColumn("fingerprint", url_fingerprint(F.col("url")))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``urls`` (url, host) with ``allowed`` by their host's robots text (host, robots); hosts without one allow all.

    Rules are parsed once per host and batch. One host may hold most addresses: they are spread over places by their
    hash, and a host's text, of which 512 KiB are read, goes to the places that need it."""

    @F.pandas_udf("boolean")
    def run(u: pd.Series, r: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for url, text in zip(u, r):
            if not text:
                out.append(True)
                continue
            parser = known.get(text)
            if parser is None:
                parser = known[text] = RobotFileParser()
                parser.parse(text[: 512 * 1024].splitlines())
            out.append(parser.can_fetch(agent, url))
        return pd.Series(out)

    spread = urls.withColumn("__salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    needed = spread.select("host", "__salt").distinct().join(robots.select("host", "robots"), "host")
    return spread.join(needed, ["host", "__salt"], "left").withColumn("allowed", run("url", "robots")).drop("robots", "__salt")


def blocked_address(c: Column, ranges: Sequence[str] = BLOCKED) -> Column:
    """Whether an IP address must not be fetched; mapped IPv4 counts as IPv4, anything unreadable is blocked."""
    nets = [ipaddress.ip_network(r) for r in ranges]

    def bad(text: str | None) -> bool:
        try:
            ip = ipaddress.ip_address((text or "").strip().strip("[]"))
        except ValueError:
            return True
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return any(ip.version == n.version and ip in n for n in nets)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(bad)

    return run(c)


def rejected_hosts(answers: DataFrame) -> DataFrame:
    """Hosts (host, address) with at least one blocked address among their answers."""
    return answers.groupBy("host").agg(F.bool_or(blocked_address(F.col("address"))).alias("rejected")).where("rejected").select("host")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
