import re

from pyspark.sql import functions as F

from chronoline.llm import url_rules as U
from chronoline.llm.queries import HOST_RULES, PATTERN_RULES

URLS = [
    "http://a.example.net/en/1", "http://example.net/en/1", "http://example.net/fr/1", "http://notexample.net/en/", "https://x.example.com/de/2", "https://x.example.com/en/2", "http://b.org/fr/", "http://b.org/fr", "HTTP://B.ORG/fr/x",
    "http://cheap-pills.example.com/en/", "http://x.org/en/free-bets", "http://x.org/en/freebets", "http://192.168.0.1/x", "http://adult-x.org/", "ftp://x", "no address cheap-pills", "", None, "http:///path?x", "a://b://c/d", "http://x.org/login?a=verify",
    "http://x.net" + "/y" * 50_000, "http://x.org/\ncasino?", "http://b.org/fr/", "http://b.org/fr/",
]


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "h", "w", "r") for k, u in enumerate(URLS)], "page_id long, url string, host string, _row string, _url string")
    got = U.filter_urls(pages, HOST_RULES, PATTERN_RULES)
    rows = {r["page_id"]: r for r in got.collect()}
    assert len(rows) == len(URLS) and {"_row", "_url"} <= set(got.columns)
    for k, url in enumerate(URLS):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        hits = sorted(r.name for r in PATTERN_RULES if url is not None and re.search(r.pattern, url.lower()))
        want = (host, path, rule and rule.name, rule.verdict if rule else "block" if hits else "allow", hits[0] if hits else None)
        assert tuple(rows[k][c] for c in ("host", "path", "rule", "verdict", "pattern_rule")) == want, url
    assert U.filter_urls(pages.where("false"), HOST_RULES, PATTERN_RULES).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("http://x/cheap",)] * 5 + [("http://x/pills",)] * 2, "url string")
    rules = [U.PatternRule("p", "cheap-pills", ("cheap", "pills")), U.PatternRule("q", "zzz", ("never", "cheap")), U.PatternRule("all", "x", ())]
    assert {r["name"]: r["token"] for r in U.rule_index(urls, rules).collect()} == {"p": "pills", "q": "never", "all": ""}


def test_no_python_on_the_path(spark):
    pages = spark.createDataFrame([(1, "http://x")], "page_id long, url string")
    plan = U.filter_urls(pages, HOST_RULES, PATTERN_RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_a_pattern_is_found_where_its_word_ends_a_longer_token(spark):
    """Rules are filed so that no match is lost, whichever token is rare."""
    urls = ["http://x.org/login?a=preverify", "http://x.org/login/reverify", "http://x.org/login?a=verify"] + ["http://x.org/login"] * 5
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["pattern_rule"]) for r in U.filter_urls(pages, HOST_RULES, PATTERN_RULES).collect()}
    assert got == {k: ("block", "login-trap") if k < 3 else ("allow", None) for k in range(8)}


def test_declared_tokens_stand_between_signs_in_their_patterns():
    for r in PATTERN_RULES:
        plain = re.sub(r"\((\^\|)?\[\^a-z0-9\](\|\$)?\)", "-", r.pattern)
        for t in r.tokens:
            assert re.search(rf"(?:-|\[[/.=]+\]){t}-", plain), (r.name, t)
