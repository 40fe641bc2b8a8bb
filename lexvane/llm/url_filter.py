"""URL rules whose block decisions reach the aliases of a page along redirect and canonical-link edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexvane.llm.common import join_hot, materialise, table
from lexvane.llm.components import connected_components

#: (verdict, rule): host, then path prefix.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: Java patterns: comments (to the end, if not closed); the attributes of a tag, in which > and the other quote may stand within quotes; one
#: attribute with its value; the target in the content of a refresh.
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
TAG = r"""(?is)<%s[\s/]((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
ATTRIBUTE = r"""[^\s"'=<>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
REFRESH_URL = r"""(?is)^\s*[0-9.]*\s*[;,]?\s*url\s*=\s*("[^"]*"|'[^']*'|.*)"""
#: Ports that a URL may leave out.
PORTS = {"http": "80", "https": "443"}
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def url_host(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased; '' for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), "(?s)^([^/?#]*)", 1), F.lit("")), ASCII_UPPER, ASCII_LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or # or the end; '' for null and without ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_scheme(url: Column) -> Column:
    """What stands before the first ://, lower-cased."""
    return F.lower(F.substring_index(url, "://", 1))


def url_key(url: Column) -> Column:
    """What scheme, fragment and default-port variants of a URL share: host, path and query; null without ://."""
    rest, host = F.regexp_extract(_after_scheme(url), "(?s)^[^/?#]*([^#]*)", 1), url_host(url)
    for scheme, port in PORTS.items():
        host = F.when(url_scheme(url) == scheme, F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    return F.when(rest.isNotNull(), F.concat(host, rest))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else nulls; equally long rules: allow first, then by name.

    rules is a short list that stands in the plan; a rule without / is one for the host alone.
    """
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):  # the last that fits wins
        name, slash, rest = rule.partition("/")
        hit = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        fits = F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _without_dots(path: Column) -> Column:
    """A path that starts with /, with its . and .. parts carried out; .. never leaves the host."""
    parts = F.slice(F.split(path, "/"), 2, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    folder = F.when(path.rlike(r"/\.\.?$") & (F.size(walked) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(walked, "/"), folder)


def resolve(url: Column, target: Column) -> Column:
    """target as a URL with a host: as it is, or taken on the host, folder or path of the page at url (RFC 3986, 5.2).

    . and .. go from the paths of relative targets. Null for other schemes (mailto:), and for a fragment alone, the page itself.
    """
    path, rest = F.regexp_extract(target, "(?s)^([^?#]*)", 1), F.regexp_extract(target, "(?s)^[^?#]*(.*)", 1)
    on_host = lambda p: F.concat(url_scheme(url), F.lit("://"), url_host(url), p)
    folder = F.concat(F.regexp_extract(url_path(url), "(?s)^(.*)/", 1), F.lit("/"))
    out = F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(url_scheme(url), F.lit(":"), target))
    out = out.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#") | (target == ""), None)
    out = out.when(target.startswith("?"), on_host(F.concat(url_path(url), target)))
    return out.otherwise(on_host(F.concat(_without_dots(F.when(target.startswith("/"), path).otherwise(F.concat(folder, path))), rest)))


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, made once however often they are read: without the step in between, an optimizer would put their expressions
    wherever their names stand."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_made")).select(*df.columns, "_made.*")


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without its quotes; null without one. Names that only end like it are others."""
    own = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: a.rlike(rf"(?i)^{name}\s*(=|$)"))
    return _unquoted(F.regexp_extract(F.get(own, F.lit(0)), r"(?s)^[^=]*=\s*(.*)$", 1))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) URL keys of all canonical links and refresh redirects outside of comments.

    A value ends at the quote that it starts with. Relative targets are taken on the page's host and folder, or those of its first
    base tag; &amp; is &.
    """
    page = pages.filter(F.col(html).rlike("(?i)canonical|refresh")).select(F.col(url).cast("string").alias("u"), F.regexp_replace(html, COMMENT, " ").alias("h"))
    tags = lambda name: F.regexp_extract_all("h", F.lit(TAG % name), F.lit(1))
    plain = lambda t: F.trim(F.regexp_replace(t, "&(amp|#38|#[xX]26);", "&"))
    based = F.get(F.filter(F.transform(tags("base"), lambda t: attribute(t, "href")), lambda x: x.isNotNull()), F.lit(0))
    page = _once(_once(page, based=plain(based)), on=F.coalesce(resolve(F.col("u"), F.col("based")), "u"))
    marked = lambda kind: F.transform(tags(kind), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("t")))
    found = page.select("u", "on", F.explode(F.concat(marked("link"), marked("meta"))).alias("tag")).select("u", "on", F.col("tag.kind").alias("kind"), F.col("tag.t").alias("t"))
    found = _once(found, **{n.replace("-", "_"): attribute(F.col("t"), n) for n in ("rel", "href", "http-equiv", "content")})
    canonical = (F.col("kind") == "link") & F.array_contains(F.split(F.lower(F.trim("rel")), r"\s+"), "canonical")
    refresh = (F.col("kind") == "meta") & (F.lower(F.trim("http_equiv")) == "refresh")
    target = F.when(canonical, F.col("href")).when(refresh, _unquoted(F.trim(F.regexp_extract("content", REFRESH_URL, 1))))
    found = _once(found.select("u", "on", target.alias("raw")).filter("raw <> ''"), t=plain(F.col("raw"))).filter("t <> ''")
    found = _once(found, to=resolve(F.col("on"), F.col("t")))
    return found.select(url_key(F.col("u")).alias("src"), url_key(F.col("to")).alias("dst")).filter("src is not null and dst is not null")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str | None = "html", max_broadcast: int = 200_000) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, alias_of.

    A page's own rule decides, so an allowed page stays allowed whatever its aliases are (explicit allow precedence). A page
    without a rule is blocked if an alias is blocked by a rule, else allowed. Aliases: pages whose URLs are equal but for scheme,
    fragment and default port, and all that redirects (src, dst URLs, from crawl logs) and the pages' own canonical links and refresh
    redirects connect; URLs in edges need not be pages. alias_of: the least key of the class of a page that has edges, else its
    own key; null for a null or scheme-less URL, which has no aliases and no host: it is allowed if no rule fits. Repeated rows
    and keys each come back; an empty table gives an empty one. Other columns are not read.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("u"))
    base = base.select("page_id", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"), url_key(F.col("u")).alias("key"), F.col("u").alias("own_url"))
    ruled = base.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "key", "hit.rule", F.col("hit.verdict").alias("own"))
    edges = link_edges(pages, url, html) if html and html in pages.columns else None
    if redirects is not None:
        logged = redirects.select(url_key(F.col("src")).alias("src"), url_key(F.col("dst")).alias("dst")).filter("src is not null and dst is not null")
        edges = logged if edges is None else edges.unionByName(logged)
    classes = ruled.select("page_id", "host", "path", "rule", "own", "key", F.col("key").alias("alias_of"))
    members = None
    if edges is not None:
        members = connected_components(edges)
        classes = join_hot(ruled, members.withColumnRenamed("node", "key"), "key", F.col("page_id"), max_broadcast).select("page_id", "host", "path", "rule", "own", "key", F.coalesce("component", "key").alias("alias_of"))
    blocked = classes.filter(F.col("own") == "block").select("alias_of")
    if members is not None:  # a rule also holds for a URL that only edges name
        node_host, node_path = F.regexp_extract("node", "(?s)^([^/?#]*)", 1), F.regexp_extract("node", "(?s)^[^/?#]*([^?#]*)", 1)
        blocked = blocked.unionByName(members.filter(match_rule(node_host, node_path, rules)["verdict"] == "block").select(F.col("component").alias("alias_of")))
    blocked = materialise(blocked.filter("alias_of is not null").distinct().withColumn("hit", F.lit(True)), "blocked")
    open_pages, fixed = classes.filter("own is null"), classes.filter("own is not null")
    decided = join_hot(open_pages, blocked, "alias_of", F.col("page_id"), max_broadcast).withColumn("verdict", F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    columns = ["page_id", "host", "path", "rule", "verdict", "alias_of"]
    return fixed.withColumn("verdict", F.col("own")).select(*columns).unionByName(decided.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def _resolved(name: str, source: str) -> str:
    """SQL of resolve(): source has scheme, host and path of a URL and t, a target; name_to has to_scheme and rest (null: none) as well."""
    return rf"""
{name}_kinds as (select *, regexp_extract(t, '(?s)^[^?#]*(.*)', 1) as tail, regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') as whole_url,
    regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') or starts_with(t, '#') or t = '' as other, case when starts_with(t, '/') then '' else regexp_extract(path, '(?s)^(.*)/', 1) || '/' end || regexp_extract(t, '(?s)^([^?#]*)', 1) as way from {source}),
{name}_walked as (select *, list_reduce(list_transform(split(way, '/')[2:], lambda x: [x]), lambda done, x: case when x[1] = '..' then done[1:len(done) - 1] when x[1] = '.' then done else done || x end, []::varchar[]) as parts from {name}_kinds),
{name}_to as (select * exclude (tail, other, way, parts), case when whole_url then lower(substr(t, 1, strpos(t, '://') - 1)) else scheme end as to_scheme,
    case when whole_url then substr(t, strpos(t, '://') + 3) when starts_with(t, '//') then substr(t, 3) when other then null when starts_with(t, '?') then host || path || t
    else host || '/' || array_to_string(parts, '/') || case when regexp_matches(way, '/\.\.?$') and len(parts) > 0 then '/' else '' end || tail end as rest from {name}_walked)"""


_HOST = f"translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{ASCII_UPPER}', '{ASCII_LOWER}')"
_PATH = "regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1)"


def _key(scheme: str) -> str:
    ports = " ".join(f"when {scheme} = '{s}' then regexp_replace({_HOST}, ':{p}$', '')" for s, p in PORTS.items())
    return f"case {ports} else {_HOST} end || regexp_extract(rest, '(?s)^[^/?#]*([^#]*)', 1)"


def _sql_tags(name: str) -> str:
    return rf"""regexp_extract_all(h, '(?is)<{name}[\s/]((?:[^>"'']|"[^"]*"|''[^'']*'')*)>', 1)"""


def _sql_unquoted(value: str) -> str:
    return f"""case when starts_with({value}, '"') or starts_with({value}, '''') then substr({value}, 2, length({value}) - 2) else {value} end"""


def _sql_attribute(tag: str, name: str) -> str:
    quoted = ATTRIBUTE.replace("'", "''")
    own = rf"list_filter(regexp_extract_all({tag}, '{quoted}'), lambda y: regexp_matches(y, '(?i)^{name}\s*(=|$)'))[1]"
    return _sql_unquoted(rf"regexp_extract({own}, '(?s)^[^=]*=\s*(.*)$', 1)")


def _sql_plain(value: str) -> str:
    return f"trim(regexp_replace({value}, '&(amp|#38|#[xX]26);', '&', 'g'))"


_BASE = f"list_filter(list_transform({_sql_tags('base')}, lambda x: {_sql_attribute('x', 'href')}), lambda x: x is not null)[1]"
_REFRESH = REFRESH_URL.replace("'", "''")
_TARGET = rf"case when kind = 'link' and list_contains(regexp_split_to_array(lower(trim(rel)), '\s+'), 'canonical') then href when kind = 'meta' and lower(trim(equiv)) = 'refresh' then {_sql_unquoted('refresh')} end"

ORACLE = rf"""
with recursive p as (select page_id, url, html, lower(split_part(url, '://', 1)) as scheme, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
b as (select page_id, html, scheme, coalesce({_HOST}, '') as host, coalesce({_PATH}, '') as path, case when rest is not null then {_key("scheme")} end as key from p),
rules as (select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, name, prefix)),
clean as (select key as src, scheme, host, path, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', ' ', 'g') as h from b where key is not null and html is not null),
bases as (select *, {_sql_plain(_BASE)} as t from clean),{_resolved("base", "bases")},
based as (select src, h, case when rest is null then scheme else to_scheme end as scheme, case when rest is null then host else {_HOST} end as host, case when rest is null then path else {_PATH} end as path from base_to),
tags as (select src, scheme, host, path, 'link' as kind, unnest({_sql_tags("link")}) as tag from based union all select src, scheme, host, path, 'meta', unnest({_sql_tags("meta")}) from based),
valued as (select *, {_sql_attribute("tag", "rel")} as rel, {_sql_attribute("tag", "href")} as href, {_sql_attribute("tag", "http-equiv")} as equiv, trim(regexp_extract({_sql_attribute("tag", "content")}, '{_REFRESH}', 1)) as refresh from tags),
targets as (select src, scheme, host, path, {_sql_plain(_TARGET)} as t from valued),
real as (select * from targets where t <> ''),{_resolved("link", "real")},
edges as (select src, {_key("to_scheme")} as dst from link_to where rest is not null),
both_ways as (select src, dst from edges union select dst, src from edges),
reach as (select src as node, src as other from both_ways union select r.node, e.dst from reach r join both_ways e on r.other = e.src),
members as (select node, min(other) as component from reach group by 1),
places as (select page_id, host, path, key from b union all select null, regexp_extract(node, '(?s)^([^/?#]*)', 1), regexp_extract(node, '(?s)^[^/?#]*([^?#]*)', 1), node from members),
hits as (select distinct pl.host, pl.path, r.name || r.prefix as rule, r.verdict, row_number() over (partition by pl.host, pl.path order by length(r.name || r.prefix) desc) as rn
    from (select distinct host, path from places) pl join rules r on (pl.host = r.name or ends_with(pl.host, '.' || r.name)) and starts_with(pl.path, r.prefix)),
judged as (select pl.page_id, pl.host, pl.path, pl.key, h.rule, h.verdict as own, coalesce(m.component, pl.key) as alias_of from places pl left join hits h on pl.host = h.host and pl.path = h.path and h.rn = 1 left join members m on pl.key = m.node),
blocked as (select distinct alias_of from judged where own = 'block' and alias_of is not null)
select page_id, host, path, rule, coalesce(own, case when alias_of in (select alias_of from blocked) then 'block' else 'allow' end) as verdict, alias_of from judged where page_id is not null
"""
