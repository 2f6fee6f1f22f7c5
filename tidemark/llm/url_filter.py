"""URL filters: rules indexed by their rarest literal token, in DataFrame operations alone.

There are two kinds of rules. Site rules name a host (and its subdomains) and the start of a path; the longest that
fits decides. Pattern rules are globs over the whole URL: `*` is any text, `^` is a separator (anything but an ASCII
letter or digit, or an end); a URL that no site rule fits is blocked if a blocking pattern matches and no allowing one
does, and is allowed otherwise. Both kinds become regular expressions with literal tokens that a URL must have, each
rule is filed under the one that is rarest among the URLs, and a URL's own tokens fetch the rules to try.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An index of at most so many rules is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class SiteRule:
    """Host, start of the path, and allow or block."""

    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        inner = re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", self.path.lower())
        return re.findall(r"[a-z0-9]+", self.host.lower()) + inner

    @property
    def regex(self) -> str:
        return rf"(?s)^(?:(?!://).)*://(?:[^/?#]*\.)?(?i:{_quote(self.host)})(?=[/?#]|\z){_quote(self.path)}"


@dataclass(frozen=True)
class PatternRule:
    """A glob over the URL in lower case, and allow or block."""

    glob: str
    action: str

    @property
    def name(self) -> str:
        return self.glob

    @property
    def tokens(self) -> list[str]:
        """Runs of letters and digits between literal characters or separators: those that any match has as tokens."""
        return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", self.glob)

    @property
    def regex(self) -> str:
        parts = {"*": ".*", "^": "(?:[^a-zA-Z0-9]|^|$)"}
        return "(?is)" + "".join(parts.get(c) or _quote(c) for c in self.glob)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_ ])", r"\\\1", text)


#: The sites of the production query.
SITES = [
    SiteRule("org", "/", "allow"),
    SiteRule("example.org", "/es/", "block"),
    SiteRule("example.org", "/en/1", "block"),
    SiteRule("com", "/fr/", "allow"),
    SiteRule("com", "/de/", "block"),
]
#: Pages that are no use as text: adverts, gambling, adult sites, forms, and pages for machines.
PATTERNS = [PatternRule(g, "block") for g in (
    "^ads^", "^adserver^", "^doubleclick^", "^banner^", "^casino^", "^poker^", "^betting^", "^porn^", "^xxx^", "^escort^", "^viagra^", "^torrent^", "^warez^",
    "^login^", "^signin^", "^logout^", "^register^", "^checkout^", "^cart^", "^password^", "^wp-login.php^", "^wp-admin^", "^cgi-bin^", "^phpmyadmin^", "^xmlrpc.php^",
    "^sitemap.xml^", "^robots.txt^", "^tracking^*^pixel^",
)] + [PatternRule("^login^*^help^", "allow")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))


def rule_table(spark: SparkSession, sites: list[SiteRule], patterns: list[PatternRule]) -> DataFrame:
    """rule, regex, action, rank (rules of higher rank win; site rules have the length, patterns less than 0) and tokens."""
    rows = [(r.name, r.regex, r.action, len(r.name) * 1000 + 999 - i % 1000, r.tokens) for i, r in enumerate(sites)]
    rows += [(r.name, r.regex, r.action, -1 if r.action == "allow" else -2, r.tokens) for r in patterns]
    if bare := [r[0] for r in rows if not r[4]]:
        raise ValueError(f"rules without a literal token cannot be indexed: {bare}")
    return spark.createDataFrame(rows, "rule string, regex string, action string, rank long, tokens array<string>")


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with the token that they are filed under: of a rule's tokens, the one in the fewest of the distinct urls (column url)."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    often = urls.select(F.explode(tokens_of(F.col("url"))).alias("token")).join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    each = rules.select("rule", "regex", "action", "rank", F.explode("tokens").alias("token")).join(often, "token", "left")
    rarest = Window.partitionBy("rule", "action", "rank").orderBy(F.coalesce("n", F.lit(0)), "token")
    return each.withColumn("at", F.row_number().over(rarest)).filter("at = 1").select("token", "rule", "regex", "action", "rank")


def judge(
    pages: DataFrame, sites: list[SiteRule] = SITES, patterns: list[PatternRule] = PATTERNS, url_col: str = "url",
) -> DataFrame:
    """pages with host, path, rule (of the site rule that decides, else null), pattern (of the pattern that decides, else null)
    and verdict (allow or block); columns of these names are replaced.

    Null and odd URLs have an empty host and path, fit no site rule, and are allowed where no pattern matches. Repeated rows
    are kept. An empty table gives an empty result. A URL of any length is one row and read whole. Of site rules that fit equally long
    the first of the list decides (in lists of more than 1,000 that of equal ranks with the greatest text); of patterns that match, one that allows,
    and then the greatest text."""
    spark = pages.sparkSession
    urls = pages.select(F.col(url_col).cast("string").alias("url")).filter("url IS NOT NULL").distinct()
    rules = rule_table(spark, sites, patterns)
    index = rule_index(urls, rules)
    if len(sites) + len(patterns) <= BROADCAST_RULES:
        index = F.broadcast(index)
    tried = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(index, "token").filter(F.rlike(F.col("url"), F.col("regex")))
    best = tried.groupBy("url").agg(F.max(F.struct("rank", "rule", "action")).alias("best"))
    key, found, salt = fresh(pages, "judged_url"), fresh(pages, "best"), fresh(pages, "salt")
    best = best.select(F.col("url").alias(key), F.col("best").alias(found))
    out = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "pattern", "verdict")])
    url, site = F.col(url_col).cast("string"), F.col(f"{found}.rank") >= 0
    # Rows without a URL have no partner: they are dealt out by a number of their own. Frequent URLs are split by adaptive execution.
    apart = F.concat(F.lit("no url "), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    out = out.withColumn(salt, F.coalesce(url, apart))
    return (
        out.join(best, (out[salt] == best[key]) & out[url_col].isNotNull(), "left")
        .withColumns({
            "host": host_of(url),
            "path": path_of(url),
            "rule": F.when(site, F.col(f"{found}.rule")),
            "pattern": F.when(~site, F.col(f"{found}.rule")),
            "verdict": F.coalesce(F.col(f"{found}.action"), F.lit("allow")),
        })
        .drop(key, found, salt)
    )
