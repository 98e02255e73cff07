"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

Pages are read once: their canonical forms, the rules' verdicts and what the filter says are written to the shared folder.
URLs that the filter rejects are never shuffled. Possible hits are joined by their canonical form to the list; rows of a URL
that many pages have are salted, and only such URLs are repeated in the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_count, bloom_block, bloom_hit, bloom_table, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): the policy of the query; a host rule fits its subdomains, a path rule all paths that start so.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_RULES = 1000
#: Blocks of the filter that is broadcast: 2**16 of 72 bytes are under 5 MB, however long the list is.
MAX_BLOCKS = 1 << 16
#: Rows from which a URL is hot, and the parts that its rows are spread over.
HOT_ROWS, SALTS = 10_000, 16
#: Pages of fewer bytes of HTML are thin; hosts with so many percent of the usual share of them make the list of the query.
THIN_BYTES, THIN_PERCENT = 1300, 125


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host in lower case without a default port, path without closing slashes, query without tracking parameters; no scheme, user or fragment. Null without `://`."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^[^@]*@", ""), r":(80|443)?$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?(?=&|$)", ""), r"^&", "")
    whole = F.concat(host, F.regexp_replace(path_of(url), r"(?<!/)/+$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(F.instr(url, "://") > 0, whole)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null without one. Equal lengths: the longer host, then text order."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"a policy has at most {MAX_RULES} rules; give longer lists as listed URLs")
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2])):  # the last one wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_blocks: int = MAX_BLOCKS, salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Judges every row of `pages`: (page_id, host, path, canonical, rule, listed, verdict).

    listed: DataFrame with the column `canonical`; repeated rows and nulls in it don't matter. Without a fitting rule the
    verdict is block if the page's canonical URL is listed, else allow. A null URL or one without `://` has empty host
    and path, no canonical form, and is allowed. Repeated pages are judged each; URLs of any length are read whole; other
    columns are ignored. An empty list or table gives no blocks or no rows.
    """
    urls = materialize(listed.select(F.col("canonical").alias("k")).where("k is not null").distinct(), "urls_listed")
    blocks = block_count(urls.count(), max_blocks)
    bloom = bloom_table(urls, "k", blocks)
    host, path = host_of(F.col("u")), path_of(F.col("u"))
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("u")).alias("canonical"))
    ruled = page.select("*", *[c.alias(n) for c, n in zip(rule_columns(F.col("host"), F.col("path"), rules), ("rule", "ruled"), strict=True)])
    # max_blocks bounds this broadcast
    probed = ruled.withColumn("block", bloom_block(F.col("canonical"), blocks)).join(F.broadcast(bloom), "block", "left")
    kept = ["page_id", "host", "path", "canonical", "rule", "ruled"]
    judged = materialize(probed.select(*kept, (F.col("canonical").isNotNull() & bloom_hit(F.col("canonical"))).alias("maybe")), "urls_judged")
    possible = judged.where("maybe").select(*kept)
    often = materialize(possible.groupBy(F.col("canonical").alias("k")).agg(F.count("*").alias("m")).where(F.col("m") >= hot_rows).select("k", F.lit(True).alias("often")), "urls_often")
    if often.limit(1).count():
        possible = possible.join(often, possible["canonical"] == often["k"], "left").withColumn("s", F.when(F.col("often"), F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")).otherwise(0)).drop("k", "often")
        urls = urls.join(often, "k", "left").select("k", F.explode(F.sequence(F.lit(0), F.when(F.col("often"), salts - 1).otherwise(0))).alias("s"))
    else:
        possible, urls = possible.withColumn("s", F.lit(0)), urls.withColumn("s", F.lit(0))
    exact = possible.join(urls.withColumn("hit", F.lit(True)), (possible["canonical"] == urls["k"]) & (possible["s"] == urls["s"]), "left").select(*kept, F.coalesce("hit", F.lit(False)).alias("listed"))
    out = exact.unionByName(judged.where("not maybe").select(*kept, F.lit(False).alias("listed")))
    return out.select("page_id", "host", "path", "canonical", "rule", "listed", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def listed_of_thin_hosts(pages: DataFrame, least_bytes: int = THIN_BYTES, percent: int = THIN_PERCENT, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A list that no column of a page decides: canonical forms of all pages of hosts with many thin pages.

    A host is listed if its share of pages of fewer than `least_bytes` bytes of HTML is at least `percent` percent of that of all
    pages, and it has any. Null HTML isn't thin; URLs without `://` have no host and aren't listed. Hosts are counted in
    tasks first, and what joins the pages is one row a host.
    """
    read = pages.select(host_of(F.col(url_col)).alias("h"), canonical(F.col(url_col)).alias("canonical"), F.coalesce((F.octet_length(html_col) < least_bytes).cast("int"), F.lit(0)).alias("thin")).where("canonical is not null")
    hosts = read.groupBy("h").agg(F.sum("thin").alias("thin"), F.count("*").alias("pages"))
    whole = hosts.agg(F.sum("thin").alias("all_thin"), F.sum("pages").alias("all_pages"))  # one row
    many = hosts.join(F.broadcast(whole), (F.col("thin") > 0) & (F.col("thin") * F.col("all_pages") * 100 >= F.col("all_thin") * F.col("pages") * percent)).select("h")
    return read.select("h", "canonical").join(many, "h", "left_semi").select("canonical")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, listed_of_thin_hosts(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(html) AS bytes, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(coalesce(url, ''), '^.*?://[^?#]*\?([^#]*)', 1, 's') AS query, contains(coalesce(url, ''), '://') AS whole
  FROM pages),
q AS (
  SELECT *, trim(replace(regexp_replace('&' || replace(query, '&', '&&') || '&', '&(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?&', '', 'g'), '&&', '&'), '&') AS k0 FROM p),
c AS (
  SELECT *, CASE WHEN whole THEN regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN k0 = '' THEN '' ELSE '?' || k0 END END AS canonical FROM q),
h AS (SELECT host, count(*) AS pages, count(*) FILTER (bytes < 1300) AS thin FROM c WHERE canonical IS NOT NULL GROUP BY host),
l AS (SELECT DISTINCT canonical AS k FROM c JOIN h USING (host) WHERE canonical IS NOT NULL AND thin > 0 AND thin * (SELECT sum(pages) FROM h) * 100 >= (SELECT sum(thin) FROM h) * pages * 125),
r AS (
  SELECT c.*, l.k IS NOT NULL AS listed,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c LEFT JOIN l ON c.canonical = l.k)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
