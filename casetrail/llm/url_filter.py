"""URL rules, and their decisions for aliases: pages that redirects and canonical links tie together.

A rule names a host with all its subdomains and the begin of a path; the longest that fits an url decides it. Urls without
a rule get the decision of their aliases. Redirects, canonical links and refreshes of pages, and the tidied form of an
url (without fragment, tracking parameters and last slash) are edges between urls, and the connected components of this graph
are the groups of aliases. An url without a rule is blocked when a member of its group is blocked by a rule and no
member is explicitly allowed by one: an allow comes before any number of blocks. Only DataFrame operations run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetrail.llm.components import components
from casetrail.llm.rows import anchored, col, join_counted, placed
from casetrail.session import stash

ALLOW, BLOCK = "allow", "block"
MOST_RULES = 2_000
"""So many rules become part of the plan, which no join is needed for; more are joined."""
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty without."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def deciding(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none does. Of rules of equal length the
    one with the longer host decides, of equal rules the one that allows."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text, r.verdict == ALLOW)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def decided(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with ``found``, what ``deciding`` says of ``host`` and ``path``, for any number of rules.

    The rules are sent to the distinct addresses and looked up by each suffix of the host and by the begins of the path
    that are as long as a path the suffix has rules for.
    """
    rows = stash(rows.withColumn("address", F.struct("host", "path")))
    given = rows.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "on string, begin string, verdict string")
    given = given.withColumn("size", F.length("begin"))
    sizes = given.groupBy("on").agg(F.collect_set("size").alias("sizes"))
    each = rows.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    parts = F.split("address.host", "[.]", -1)
    suffixes = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    asked = each.select("address", "n", F.explode(suffixes).alias("on")).join(F.broadcast(sizes), "on")
    asked = asked.select("address", "n", "on", F.explode("sizes").alias("size")).where(F.col("size") <= F.length("address.path"))
    fits = asked.withColumn("begin", F.left("address.path", F.col("size"))).join(F.broadcast(given), ["on", "begin", "size"])
    text = F.concat("on", "begin")
    order = F.struct(F.length(text), F.length("on"), text.alias("rule"), (F.col("verdict") == ALLOW).alias("allowed"), "verdict")
    best = fits.groupBy("address").agg(F.max(order).alias("best"), F.first("n").alias("n"))
    values = stash(best.select("address", "n", F.struct("best.rule", "best.verdict").alias("found")))
    return join_counted(rows, values, "address").drop("address", "n")


def name_of(url: Column) -> Column:
    """What tells urls apart as pages: host, path and query. Scheme, its own port and fragment do not."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1), F.lit(""))
    port = F.when(url.rlike("(?i)^http://"), ":(?:80)?$").when(url.rlike("(?i)^https://"), ":(?:443)?$").otherwise(":$")
    return F.concat(F.regexp_replace(host_of(url), port, F.lit("")), path_of(url), query)


def tidied(name: Column) -> Column:
    """A name without tracking parameters, an empty query and the last slash."""
    rest = F.regexp_replace(name, rf"(?<=[?&]){TRACKING}=[^&]*(?:&|$)", "")
    return F.regexp_replace(F.regexp_replace(rest, r"[?&]+$", ""), r"(?<=[^/])/$", "")


_PLAIN_TEXT = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript)\b.*?(?:</\1\b|\z)"


def markup(html: Column) -> Column:
    """A page without comments and scripts, which hold no tags; one that does not end goes to the end of the page."""
    return F.when(html.rlike(r"(?i)<(?:link|meta)\b"), F.regexp_replace(html, _PLAIN_TEXT, "")).otherwise("")


def _tags(html: Column, names: str) -> Column:
    # up to the last end of a tag, so every tag that begins has an end and none is looked for twice
    closed = F.left(html, F.length(html) - F.length(F.substring_index(html, ">", -1)))
    return F.regexp_extract_all(closed, F.lit(rf"(?i)<(?:{names})\b[^>]*+>"), F.lit(0))


def _href(tag: Column) -> Column:
    return F.replace(F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("&amp;"), F.lit("&"))


def declared(html: Column) -> Column:
    """The targets that the ``markup`` of a page declares in canonical links and refreshes, as they are written."""
    tags = _tags(html, "link|meta")
    rel = r"(?is)^<link\b.*?\brel\s*=\s*(?:canonical(?![^\s>/])|\"(?:[^\"]*\s)?canonical[\s\"]|'(?:[^']*\s)?canonical[\s'])"
    canonical = F.filter(tags, lambda t: t.rlike(rel))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b.*?\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    links = F.transform(canonical, _href)
    jumps = F.transform(refresh, lambda t: F.replace(F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1), F.lit("&amp;"), F.lit("&")))
    return F.filter(F.concat(links, jumps), lambda t: t != "")


def base_of(html: Column) -> Column:
    """The address that a page's first ``base`` tag with one gives for its links; null without."""
    return F.get(F.filter(F.transform(_tags(html, "base"), _href), lambda t: t != ""), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path that begins with ``/`` without its steps ``.`` and ``..``, which never lead above the root."""
    steps = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/", -1)

    def walk(done: Column, step: Column) -> Column:
        return F.when(step == ".", done).when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(
            F.concat(done, F.array(step)))

    walked = F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.array(F.lit("")), walk)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.array_join(walked, "/")).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """A target as an url, seen from an absolute url; null for other schemes such as ``mailto:``."""
    site = F.concat(F.lit("http://"), host_of(base))
    own = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.substring(target, F.length(path) + 1, F.length(target))
    folder = F.regexp_replace(own, "[^/]*$", "")
    return (F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(site, without_dots(path), rest))
            .when(F.startswith(target, F.lit("?")), F.concat(site, path_of(base), target))
            .when(F.startswith(target, F.lit("#")), base)
            .otherwise(F.concat(site, without_dots(F.concat(folder, path)), rest)))


def _blocked_names(named: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``s whose group has a blocked member and no allowed one. ``named``: ``node`` and the ``verdict`` of its rule."""
    groups = stash(components(edges))
    ruled = named.where("verdict is not null").groupBy("node").agg(
        F.max(F.col("verdict") == ALLOW).alias("allowed"), F.max(F.col("verdict") == BLOCK).alias("blocked"))
    decided = groups.join(ruled, "node").groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    bad = decided.where("blocked and not allowed").select("component")
    sizes = groups.join(bad, "component", "left_semi")
    return sizes.select("node")


def judged(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str | None = "html",
           redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``by`` (``rule``, ``alias``
    or ``default``).

    ``redirects`` (``source``, ``target``: urls) add to what pages declare. A null url and one without ``://`` has an empty host
    and path; rules with a host do not fit it, and it is allowed. Null html declares nothing. Repeated rows are each judged.
    No pages give no rows. Other columns are not looked at.
    """
    pages = anchored(pages)

    def facts(rows: DataFrame, address: str, *kept: str) -> DataFrame:
        host, path = host_of(F.col(address)), path_of(F.col(address))
        given = [*kept, host.alias("host"), path.alias("path"), name_of(F.col(address)).alias("name")]
        if len(rules) > MOST_RULES:
            return decided(rows.select(*given), rules)
        return rows.select(*given, deciding(rules, host, path).alias("found"))

    rows = placed(pages, page_id=col(page_id), address=col(url).cast("string"))
    narrow = stash(facts(rows, "address", "page_id").withColumn("node", F.xxhash64("name")))
    sources = []
    if html:
        page = pages.select(col(url).cast("string").alias("source"), col(html).cast("string").alias("html")).where("source is not null")
        # the generator of one row has the markup computed once and not once for each use
        page = page.select("source", F.explode(F.array(markup(F.col("html")))).alias("html"))
        links = page.select("source", base_of(F.col("html")).alias("base"), F.explode(declared(F.col("html"))).alias("target"))
        seen_from = F.coalesce(F.when(F.col("base").isNotNull(), resolved(F.col("source"), F.col("base"))), F.col("source"))
        sources.append(links.select("source", resolved(seen_from, F.col("target")).alias("target")).where("target is not null"))
    if redirects is not None:
        sources.append(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")).where("source is not null and target is not null"))
    named = [narrow.select("name", "node", F.col("found.verdict").alias("verdict"))]
    edges = []
    for links in sources:
        links = stash(links)
        for end in ("source", "target"):
            own = facts(links, end)
            named.append(own.select("name", F.xxhash64("name").alias("node"), F.col("found.verdict").alias("verdict")))
        edges.append(links.select(F.xxhash64(name_of(F.col("source"))).alias("u"), F.xxhash64(name_of(F.col("target"))).alias("v")))
    every = named[0]
    for more in named[1:]:
        every = every.unionByName(more)
    every = stash(every.where("name <> ''").distinct())
    edges.append(every.select(F.col("node").alias("u"), F.xxhash64(tidied(F.col("name"))).alias("v")).where("u <> v"))
    whole = edges[0]
    for more in edges[1:]:
        whole = whole.unionByName(more)
    blocked = _blocked_names(every, whole)
    times = narrow.where("found is null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    alias = stash(times.join(blocked, "node").withColumn("alias", F.lit(True)))
    met = join_counted(narrow, alias, "node")
    ruled, alias_blocked = F.col("found").isNotNull(), F.col("alias").isNotNull()
    return met.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(alias_blocked, BLOCK).otherwise(ALLOW)).alias("verdict"),
        F.when(ruled, "rule").when(alias_blocked, "alias").otherwise("default").alias("by"))
