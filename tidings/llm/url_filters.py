"""URL filters: rules on host and path, and for what no rule settles the reputation of the host.

Reputation is empirical Bayes. The labelled pages of a host are bad or not; its bad rate has a beta prior whose mean is the
posterior mean of the registered domain, which in turn is shrunk towards the suffix and that towards all pages. How strong a
level's prior is (its number of pseudo-pages) comes from the data: the method of moments of the beta-binomial, from how much
more the counts of that level's members scatter around their parents' rates than binomial counts would. A host is blocked if a
lower bound of its posterior rate passes LIMIT: mean less DEVIATIONS standard deviations, under which at most
1 / (1 + DEVIATIONS^2) of any posterior lies (Cantelli). So a host is judged by evidence: a few bad pages do not block it.

At scale: only counts by host are shuffled, pre-aggregated; parents' rates and the list of blocked hosts are joined by
(key, salt), SALTS rows of the small side for each key, so a host or suffix that holds a third of all rows is dealt to many
tasks. What reaches the driver is four numbers a level. html is not read.

Edge cases: a null url or one without `://` has an empty host and path; the empty host is a host like others, without a
domain; userinfo, port and a final dot belong to the host as written but not to its domain; addresses of digits and hosts of
one label are their own domains, without a suffix; page or label rows that repeat: pages each count, labels of one id are one,
bad if any is; null labels are no outcome, a null page_id has none; without labels nothing is blocked but by rule; very long
urls are judged whole; extra columns are never read; an empty table gives no rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm.work import Workspace

# The rules, by verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
LIMIT, DEVIATIONS = 0.25, 3.0
PSEUDO = (1.0, 1000.0)  # least and largest number of pseudo-pages; the largest also where no member has two labelled pages
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host, then path from its first slash) that fits, null if none; of equally long ones that with the longer host, then the lesser. rules is a short list: each is one comparison a page."""
    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")

    order = sorted(rules, key=lambda r: (-len(r), -r.find("/"), r))
    return F.coalesce(*(F.when(fits(r), F.lit(r)) for r in order)) if order else F.lit(None).cast("string")


def levels_of(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host. The suffix is its last label, or the longest of suffixes that it ends in."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")
    bare = F.regexp_replace(bare, r":[0-9]*$|\.+$", "")
    last = F.substring_index(bare, ".", -1)
    longer = sorted(suffixes, key=lambda s: (-s.count("."), s))
    suffix = F.coalesce(*(F.when(bare.endswith(f".{s}"), F.lit(s)) for s in longer), last) if longer else last
    whole = bare.rlike(r"^[0-9.]*$|^\[") | ~bare.contains(".") | bare.isin(*suffixes)
    first = F.substring_index(F.substr(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1), ".", -1)
    return F.when(whole, bare).otherwise(F.concat_ws(".", first, suffix)), F.when(whole, F.lit("")).otherwise(suffix)


def salted(big: DataFrame, small: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """big joined to small on key; small has one row a key. Rows of big with one key are dealt to SALTS keys by a hash of by."""
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(many, [key, "_salt"], how).drop("_salt")


def _pseudo(members: DataFrame) -> float:
    """Pseudo-pages of a level's prior, from members (n, bad, prior): 1 / rho - 1, rho the correlation of a member's pages."""
    spread = F.col("prior") * (1 - F.col("prior"))
    over = F.pow(F.col("bad") - F.col("n") * F.col("prior"), 2) - F.col("n") * spread
    got = members.agg(F.sum(over), F.sum(F.col("n") * (F.col("n") - 1) * spread)).first()
    rho = got[0] / got[1] if got[1] else 0.0
    return min(max(1 / rho - 1, PSEUDO[0]), PSEUDO[1]) if rho > 0 else PSEUDO[1]


def _shrunk(members: DataFrame, key: str, m: float) -> DataFrame:
    """(key, prior): posterior means, the priors of the level below."""
    return members.select(key, ((F.col("bad") + m * F.col("prior")) / (F.col("n") + m)).alias("prior"))


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, bad): every host's labelled and bad pages. pages: (page_id, host)."""
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("long")).alias("bad"))
    return pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))


def reputations(ws: Workspace, hosts: DataFrame, suffixes: tuple[str, ...] = (), limit: float = LIMIT) -> DataFrame:
    """From (host, n, bad): each host with alpha and beta of its posterior bad rate. The rate of all pages is shrunk by one page at the limit: without labels nothing passes it."""
    domain, suffix = levels_of(F.col("host"), suffixes)
    hosts = ws.stage(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = ws.stage(hosts.groupBy("domain", "suffix").agg(*counts), "domains")
    tops = ws.stage(domains.groupBy("suffix").agg(*counts), "suffixes")
    n, bad = tops.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    tops = tops.withColumn("prior", F.lit(float((bad + limit) / (n + 1))))
    domains = ws.stage(salted(domains, _shrunk(tops, "suffix", _pseudo(tops)), "suffix", F.col("domain")), "domain-priors")
    hosts = ws.stage(salted(hosts, _shrunk(domains, "domain", _pseudo(domains)), "domain", F.col("host")), "host-priors")
    m = _pseudo(hosts)
    return hosts.select("host", (F.col("bad") + m * F.col("prior")).alias("alpha"), (F.col("n") - F.col("bad") + m * (1 - F.col("prior"))).alias("beta"))


def lower_bound(alpha: Column, beta: Column, deviations: float) -> Column:
    total = alpha + beta
    return alpha / total - deviations * F.sqrt(alpha * beta / (total * total * (total + 1)))


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES, suffixes: tuple[str, ...] = (), limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url); labels: (doc_id, quality, toxic) by page_id."""
    ws = Workspace(spark, "urls")
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    posterior = reputations(ws, outcomes(seen.select("page_id", "host"), labels), suffixes, limit)
    blocked = posterior.where(lower_bound(F.col("alpha"), F.col("beta"), deviations) > limit).select("host", F.lit("block").alias("by_host"))
    blocked = ws.stage(blocked, "blocked")
    out = salted(seen.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), blocked, "host", F.struct("page_id", "path"), "left")
    by_rule = reduce(lambda w, r: w.when(F.col("rule") == r, F.lit(rules[r])), rules, F.when(F.lit(False), F.lit("")))
    return out.select("page_id", "host", "path", "rule", F.coalesce(by_rule, "by_host", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the verdict on every page."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(spark, pages, labels)


def _level(name: str, key: str, source: str) -> str:
    """A level's members with prior and pseudo-pages, and their posterior means."""
    rho = f"(sum(pow(bad - n * prior, 2) - n * prior * (1 - prior)) OVER ()) / nullif(sum(n * (n - 1) * prior * (1 - prior)) OVER (), 0)"
    return f"""{name}_m AS (SELECT *, {rho} AS rho FROM ({source})),
 {name} AS (SELECT *, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, {PSEUDO[0]}), {PSEUDO[1]}) ELSE {PSEUDO[1]} END AS m FROM {name}_m),
 {name}_post AS (SELECT {key}, (bad + m * prior) / (n + m) AS prior FROM {name})"""


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 k AS (SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
 h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(host, '.') AS labels FROM p LEFT JOIN k ON page_id = doc_id GROUP BY host),
 hd AS (SELECT *, CASE WHEN len(labels) > 1 THEN labels[-2] || '.' || labels[-1] ELSE host END AS domain, CASE WHEN len(labels) > 1 THEN labels[-1] ELSE '' END AS suffix FROM h),
 {_level("s", "suffix", f"SELECT suffix, n, bad, (sum(bad) OVER () + {LIMIT}) / (sum(n) OVER () + 1) AS prior FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hd GROUP BY suffix)")},
 {_level("d", "domain", "SELECT domain, n, bad, prior FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hd GROUP BY ALL) JOIN s_post USING (suffix)")},
 {_level("e", "host", "SELECT host, n, bad, prior FROM hd JOIN d_post USING (domain)")},
 b AS (SELECT host, bad + m * prior AS a, n - bad + m * (1 - prior) AS b, n + m AS t FROM e),
 r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
   WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
   WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
   WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN a / t - {DEVIATIONS} * sqrt(a * b / (t * t * (t + 1))) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN b USING (host)
"""
