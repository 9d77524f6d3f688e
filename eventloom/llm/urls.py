"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. Each level's
beta-binomial prior has the mean of the level above and a concentration estimated from how
far the level's groups scatter beyond chance (method of moments), so a host of few labels
takes after its domain, and a domain after its suffix. A page is blocked if the posterior
mean of its host's bad share, less ``Z`` standard deviations, exceeds ``LIMIT``, unless a rule
decides: of the rules whose host is the page's or a parent of it and whose path begins
the page's, the longest.

A host counts without its user, port and trailing dot; an address is its own domain and suffix. Suffixes are the last label, or
two where a country's second label is one of ``SECOND``; ``suffixes``, a table such as the public list, has those under which others
register names too (``github.io``), and the longest that fits a host is its.

Counts combine before they meet, three scalars for each level reach the driver, and a
host that holds a third of all pages is one row on one side of a join. The table of suffixes meets the distinct hosts, broadcast
where it has at most ``BROADCAST_SUFFIXES`` rows, otherwise by shuffle. An empty table gives an empty result; a url of any
length is one expression's work.

A null url, or one without ``://``, has an empty host and path. Hosts without labels take
their domain's prior; without any label everything that no rule blocks is allowed. Repeated
pages each keep their row and count once for each row; a page whose labels contradict
each other is bad; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_at_most

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Second labels under which names are registered in some country suffixes.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Hosts that are addresses.
ADDRESS = r"^([0-9]{1,3}\.){3}[0-9]{1,3}$|^\[.*\]$"
BROADCAST_SUFFIXES = 100_000
Z = 1.645
LIMIT = 0.5
LEAST, MOST = 1.0, 1000.0


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def bare(h: Column) -> Column:
    """A host without user, port and trailing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def suffix(h: Column) -> Column:
    """The last label, or two where a country's second label is one of ``SECOND``; all of an address."""
    b = bare(h)
    names = F.when(b.rlike(rf"(^|\.)({'|'.join(SECOND)})\.[a-z][a-z]$"), F.substring_index(b, ".", -2)).otherwise(F.substring_index(b, ".", -1))
    return F.when(b.rlike(ADDRESS), b).otherwise(names)


def domain(h: Column, s: Column | None = None) -> Column:
    """The suffix and one label more; all of an address."""
    b, s = bare(h), suffix(h) if s is None else s
    dots = F.length(s) - F.length(F.replace(s, F.lit("."), F.lit("")))
    return F.when(b.rlike(ADDRESS), b).otherwise(F.call_function("substring_index", b, F.lit("."), -(dots + 2)))


def with_suffixes(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """Hosts with ``suffix`` and ``domain``, by the longest of ``suffixes`` (a column of that name) that fits where one does."""
    x = hosts.withColumn("suffix", suffix(F.col("host")))
    if suffixes is not None:
        table = suffixes.select(F.lower("suffix").alias("_s")).where("_s is not null").distinct()
        if rows_at_most(table, BROADCAST_SUFFIXES):
            table = F.broadcast(table)
        labels = F.split(bare(F.col("host")), r"\.")
        ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        fits = hosts.where(~bare(F.col("host")).rlike(ADDRESS)).select("host", F.explode(ends).alias("_s")).join(table, "_s")
        best = fits.groupBy("host").agg(F.max(F.struct(F.length("_s").alias("n"), "_s")).alias("m")).select(F.col("host").alias("_h"), F.col("m._s").alias("_s"))
        x = x.join(best, x.host.eqNullSafe(F.col("_h")), "left").withColumn("suffix", F.coalesce("_s", "suffix")).drop("_h", "_s")
    return x.withColumn("domain", domain(F.col("host"), F.col("suffix")))


def rule(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        name, verdict = F.when(fits, F.lit(rh + rp)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _shrunk(groups: DataFrame, prior: str) -> float:
    """The concentration of the beta prior of groups with counts n, k and prior mean ``prior``."""
    p, n, k = F.col(prior), F.col("n"), F.col("k")
    v = p * (1 - p)
    r = groups.where("n > 0").agg(F.sum(n * (k / n - p) * (k / n - p) - v).alias("a"), F.sum((n - 1) * v).alias("b")).first()
    rho = r["a"] / r["b"] if r["a"] and r["b"] and r["b"] > 0 else 0.0
    return min(MOST, max(LEAST, 1.0 / rho - 1.0)) if rho > 0 else MOST


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """``host, n, k, mean, bound`` of every host of ``pages(page_id, url)``; ``outcomes`` has
    ``page_id, bad``."""
    o = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    p = pages.select("page_id", host(F.col("url")).alias("host")).join(o, "page_id", "left")
    hosts = p.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = with_suffixes(hosts, suffixes)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    all_ = ends.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = all_["k"] / all_["n"] if all_["n"] else 0.0
    s = ends.withColumn("p", F.lit(rate))
    m = _shrunk(s, "p")
    s = s.select("suffix", ((m * F.col("p") + F.col("k")) / (m + F.col("n"))).alias("s_mean"))
    d = domains.join(s, "suffix")
    m = _shrunk(d, "s_mean")
    d = d.select("domain", ((m * F.col("s_mean") + F.col("k")) / (m + F.col("n"))).alias("d_mean"))
    h = hosts.join(d, "domain")
    m = _shrunk(h, "d_mean")
    a, b = m * F.col("d_mean") + F.col("k"), m * (1 - F.col("d_mean")) + F.col("n") - F.col("k")
    mean, sd = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return h.select("host", "n", "k", mean.alias("mean"), (mean - z * sd).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, suffixes: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, n_labelled`` for every row of ``pages``."""
    rep = reputation(pages, outcomes, suffixes=suffixes).select(F.col("host").alias("_h"), "bound", F.col("n").alias("n_labelled"))
    x = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    x = x.join(rep, x.host == rep._h, "left")
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    return x.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"))


def outcomes(labels: DataFrame) -> DataFrame:
    """Page outcomes from a table of labels: quality 0 is bad."""
    return labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad"))


_BARE = r"regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')"
_DOMAIN = r"case when regexp_matches(bare, '^([0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}$|^\[.*\]$') then bare when regexp_matches(bare, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$') then {0} else {1} end"
_TAIL = r"regexp_extract(bare, '([^.]*\.){{0,{0}}}[^.]*$')"
ORACLE = rf"""
with o as (select doc_id as page_id, max(case when quality = 0 then 1 else 0 end) as bad from labels where doc_id is not null and quality is not null group by 1),
p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
h as (select host, count(bad) as n, coalesce(sum(bad), 0) as k,
             {_DOMAIN.format(_TAIL.format(2), _TAIL.format(1))} as domain, {_DOMAIN.format(_TAIL.format(1), _TAIL.format(0))} as suffix
      from (select *, {_BARE} as bare from p) left join o using (page_id) group by host, bare),
d as (select domain, suffix, sum(n) as n, sum(k) as k from h group by all),
s as (select suffix, sum(n) as n, sum(k) as k from d group by all),
g as (select case when sum(n) > 0 then sum(k)::double / sum(n) else 0.0 end as p from s),
sp as (select s.*, p, p * (1 - p) as v from s, g),
sm as (select case when b > 0 and a > 0 then least({MOST}, greatest({LEAST}, b / a - 1)) else {MOST} end as m from (select sum(n * (k::double / n - p) ^ 2 - v) as a, sum((n - 1) * v) as b from sp where n > 0)),
s2 as (select suffix, (m * p + k) / (m + n) as mean from sp, sm),
dp as (select d.*, mean as p, mean * (1 - mean) as v from d join s2 using (suffix)),
dm as (select case when b > 0 and a > 0 then least({MOST}, greatest({LEAST}, b / a - 1)) else {MOST} end as m from (select sum(n * (k::double / n - p) ^ 2 - v) as a, sum((n - 1) * v) as b from dp where n > 0)),
d2 as (select domain, (m * p + k) / (m + n) as mean from dp, dm),
hp as (select h.*, mean as p, mean * (1 - mean) as v from h join d2 using (domain)),
hm as (select case when b > 0 and a > 0 then least({MOST}, greatest({LEAST}, b / a - 1)) else {MOST} end as m from (select sum(n * (k::double / n - p) ^ 2 - v) as a, sum((n - 1) * v) as b from hp where n > 0)),
h2 as (select host, n, m * p + k as a, m * (1 - p) + n - k as b from hp, hm),
h3 as (select host, n, a / (a + b) - {Z} * sqrt(a * b / ((a + b) ^ 2 * (a + b + 1))) as bound from h2),
r as (select p.page_id, p.host, p.path, h3.n, h3.bound,
        case when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
             when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
             when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
             when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
      from p left join h3 using (host))
select page_id, host, path, rule,
       case rule when 'example.net/en/' then 'allow' when 'example.com/de/' then 'block' when 'org/fr/' then 'allow' when 'net/' then 'block'
                 else case when bound > {LIMIT} then 'block' else 'allow' end end as verdict,
       n::bigint as n_labelled
from r
"""
