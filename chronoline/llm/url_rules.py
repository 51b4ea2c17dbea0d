"""URL filters: host rules, and pattern rules that are indexed by their rarest literal token.

A pattern rule is a regular expression with the literal tokens that any matching URL must hold
as whole tokens (runs of a-z and 0-9 in the lower-cased URL). Of these the one that occurs in the
fewest URLs, counted over the whole table, is the rule's key. A URL's own tokens fetch the rules
filed under them, and only the fetched rules run their expression. Rules without a literal token
are filed under the empty token, which every URL has, so none is lost.

All of it is DataFrame code. The rule lists are configuration: their length is checked before
they are broadcast (``MAX_RULES``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chronoline.llm.common import ascii_lower

#: Bound of either rule list; both are written into the plan or broadcast.
MAX_RULES = 20_000


@dataclass(frozen=True)
class HostRule:
    """A verdict for a host, its subdomains and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """Block URLs whose lower-cased text matches; ``tokens`` are whole tokens that every match holds."""

    name: str
    pattern: str
    tokens: tuple[str, ...]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a text without ``://``."""
    text = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, shape, 1)), F.regexp_extract(text, shape, 2)


def host_rule(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """The longest host rule that fits, as a struct (name, verdict); null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} host rules")
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))
    listed = F.array(*(F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")) for r in ordered))
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    return F.get(fits, F.lit(0))


def tokens(url: Column) -> Column:
    """The distinct whole tokens of a URL, with the empty token that all URLs share."""
    return F.array_union(F.array(F.lit("")), F.array_distinct(F.split(ascii_lower(url), "[^a-z0-9]+")))


def rule_index(urls: DataFrame, rules: list[PatternRule], url: str = "url") -> DataFrame:
    """(token, name, pattern): each rule under the token of its own that the fewest URLs hold.

    Ties go to the longer token, then the smaller. The counts cover every row of ``urls``; only
    tokens that a rule names are counted.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} pattern rules")
    spark = urls.sparkSession
    rows = [(r.name, r.pattern, t.lower()) for r in rules for t in (r.tokens or ("",))]
    listed = spark.createDataFrame(rows, "name string, pattern string, token string")
    wanted = F.array(*(F.lit(t) for t in sorted({x[2] for x in rows if x[2]}))).cast("array<string>")
    counts = (
        urls.select(F.explode(F.array_intersect(tokens(F.col(url)), wanted)).alias("token"))
        .groupBy("token").agg(F.count("*").alias("n"))
    )
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), F.col("token"))
    return (
        listed.join(counts, "token", "left")
        .groupBy("name", "pattern").agg(F.min(rank)["token"].alias("token"))
        .select("token", "name", "pattern")
    )


def pattern_matches(urls: DataFrame, rules: list[PatternRule], url: str = "url") -> DataFrame:
    """(url, pattern_rule, n_candidates, n_matches): one row per distinct URL that some rule matches.

    ``pattern_rule`` is the matching rule of the smallest name. Null URLs match nothing.
    """
    index = F.broadcast(rule_index(urls, rules, url))  # at most MAX_RULES rows, checked there
    # equal URLs are judged once: a URL that holds a third of all rows is combined before the shuffle
    each = urls.select(F.col(url).alias("url")).where(F.col("url").isNotNull()).distinct()
    fetched = each.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(index, "token")
    judged = fetched.select("url", "name", F.rlike(ascii_lower(F.col("url")), F.col("pattern")).alias("hit"))
    return (
        judged.groupBy("url")
        .agg(F.min(F.when(F.col("hit"), F.col("name"))).alias("pattern_rule"), F.count("*").alias("n_candidates"), F.count_if("hit").alias("n_matches"))
        .where(F.col("pattern_rule").isNotNull())
    )


def filter_urls(pages: DataFrame, host_rules: list[HostRule], pattern_rules: list[PatternRule], url: str = "url") -> DataFrame:
    """All rows and columns of ``pages`` with host, path, rule, verdict and pattern_rule.

    A host rule that fits decides, the longest first; else a matching pattern blocks, and what is
    left is allowed. Null and malformed URLs have an empty host and path, fit no host rule and,
    unless a pattern matches their text, are allowed. Repeated rows are each judged. Columns of
    ``pages`` with one of the new names are replaced.
    """
    new = ["host", "path", "rule", "verdict", "pattern_rule"]
    kept = [c for c in pages.columns if c not in new or c == url]
    host, path = split_url(F.col(url))
    base = pages.select(F.struct(*kept).alias("_row"), F.col(url).alias("_url"), host.alias("_host"), path.alias("_path"))
    base = base.withColumn("_rule", host_rule(F.col("_host"), F.col("_path"), host_rules))
    found = pattern_matches(pages.select(url), pattern_rules, url).select(F.col("url").alias("_found"), "pattern_rule")
    return base.join(found, F.col("_url") == F.col("_found"), "left").select(
        "_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule.name").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("pattern_rule").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
        "pattern_rule",
    )
