"""The registered queries of this folder, with comparison SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoline.llm import decontaminate, digest, graph_search, kneser_ney, language, mixing, ngram_join, pieces, pii, quality, ranked_search, spelling, url_rules
from chronoline.llm.common import table
from chronoline.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` and, if there is one, its SQL."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


# --- 1: n-gram Jaccard join ---------------------------------------------------------------------

_OP1_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT w, min(doc_id) AS least, count(*) AS n_copies, row_number() OVER (ORDER BY min(doc_id)) AS t FROM d GROUP BY w),
g AS (
    SELECT DISTINCT t, array_to_string(w[i : i + 4], ' ') AS g
    FROM (SELECT t, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM t WHERE len(w) > 0)),
z AS (SELECT t, count(*) AS n FROM g GROUP BY t),
b AS (SELECT x.t AS a, y.t AS b, count(*) AS n FROM g x JOIN g y ON x.g = y.g AND x.t <> y.t GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN z x ON b.a = x.t JOIN z y ON b.b = y.t WHERE 10 * b.n >= 8 * (x.n + y.n - b.n)),
r AS (SELECT t AS a, t AS b FROM t UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS t, min(t.least) AS class_id FROM r JOIN t ON r.b = t.t GROUP BY r.a)
SELECT d.doc_id, c.class_id, coalesce(k.n, 0)::BIGINT AS n_links, t.n_copies
FROM d JOIN t ON d.w = t.w JOIN c ON c.t = t.t LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = t.t"""


@query("op1_ngram_jaccard_join", _OP1_SQL)
def op1_ngram_jaccard_join(spark, sf_dir):
    """Class, number of links and copies of every document: five words, 0.8."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 2: SentencePiece encoding and decoding -----------------------------------------------------


@query("op2_sentencepiece")
def op2_sentencepiece(spark, sf_dir):
    """Piece ids of every whole document, and whether decoding gives the text again."""
    coded = pieces.encode_and_check(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.read_model())
    return coded.select("doc_id", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")


# --- 3: mixing sources to target weights --------------------------------------------------------

_OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5('7:' || coalesce(doc_id::VARCHAR, '')) AS k
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
o AS (
    SELECT *, 2 * n / w::DOUBLE AS ratio, sum(n) OVER () AS total,
        coalesce(sum(2 * n) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open
    FROM s WINDOW before AS (ORDER BY 2 * n / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, (1.5::DOUBLE * total - capped) / open AS unit FROM o),
f AS (SELECT min(ratio) AS least, min_by(unit, ratio) AS unit FROM u WHERE ratio >= unit),
t AS (
    SELECT u.source, u.n, CASE WHEN u.ratio >= f.least THEN f.unit * u.w ELSE 2.0::DOUBLE * u.n END AS target FROM u, f),
c AS (
    SELECT d.*, t.n, t.target, floor(t.target + 0.5)::BIGINT AS words,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
    (greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - n)))::BIGINT AS taken
FROM c"""


@query("op3_mixing", _OP3_SQL)
def op3_mixing(spark, sf_dir):
    """Words that a mix of 150 % of all words takes of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(settle(docs))  # only ids, sources and sizes are written
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


# the tree's draws are numpy's, beyond SQL; tests compare with its quotas
@query("op3_mixing_shards")
def op3_mixing_shards(spark, sf_dir):
    """Where the same mix puts each read of a document: one partition for each shard, in its local order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    dealt = mixing.in_shards(mixing.deal(mixing.mix(settle(docs))))
    return dealt.select("doc_id", "source", "copy", "words", "shard", "shard_order")


# --- 5: URL filters ---------------------------------------------------------------------------

HOST_RULES = [
    url_rules.HostRule("block", "net"),
    url_rules.HostRule("allow", "example.net", "/en/"),
    url_rules.HostRule("block", "example.com", "/de/"),
    url_rules.HostRule("allow", "org", "/fr/"),
]

PATTERN_RULES = [
    url_rules.PatternRule("ad-tracker", r"[/.]ads-track(er|ing)?[./-]", ("ads",)),
    url_rules.PatternRule("adult", r"(^|[^a-z0-9])adult-[a-z0-9]+\.", ("adult",)),
    url_rules.PatternRule("bets", r"(^|[^a-z0-9])free-bets?([^a-z0-9]|$)", ("free",)),
    url_rules.PatternRule("casino", r"(^|[^a-z0-9])casino([^a-z0-9]|$)", ("casino",)),
    url_rules.PatternRule("pills", r"(^|[^a-z0-9])cheap-pills([^a-z0-9]|$)", ("cheap", "pills")),
    url_rules.PatternRule("spam-farm", r"(^|[^a-z0-9])spam-farm([^a-z0-9]|$)", ("spam", "farm")),
    url_rules.PatternRule("login-trap", r"[/=]login([^a-z0-9]).*verify([^a-z0-9]|$)", ("login",)),  # verify may end a longer token
    url_rules.PatternRule("long-number-host", r"://[0-9]{1,3}(\.[0-9]{1,3}){3}([:/?#]|$)", ()),
]


def _op5_sql() -> str:
    def fits(r):
        return f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"

    ordered = sorted(HOST_RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in ordered)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in ordered)
    lower = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pattern = " ".join(f"WHEN regexp_matches({lower}, '{r.pattern}') THEN '{r.name}'" for r in sorted(PATTERN_RULES, key=lambda r: r.name))
    shape = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    return f"""
WITH split AS (
    SELECT page_id, url,
        translate(regexp_extract(coalesce(url, ''), {shape}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), {shape}, 2) AS path
    FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
    coalesce(CASE {verdict} END, CASE WHEN (CASE {pattern} END) IS NOT NULL THEN 'block' END, 'allow') AS verdict,
    CASE {pattern} END AS pattern_rule
FROM split"""


@query("op5_url_filters", _op5_sql())
def op5_url_filters(spark, sf_dir):
    """A verdict for every page's address."""
    judged = url_rules.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), HOST_RULES, PATTERN_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


# --- 9: document fingerprints -------------------------------------------------------------------


@query("op9_fingerprints")
def op9_fingerprints(spark, sf_dir):
    """Digests of every document and of its edited text, with their likeness."""
    return digest.edited_fingerprints(table(spark, sf_dir, "documents"))


# --- 10: approximate nearest neighbours ---------------------------------------------------------


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark, sf_dir):
    """The five nearest vectors of each vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_search.search(graph_search.build_index(rows), rows.where(F.col("vec_id") % 50 == 0))


# --- 8: language-model scoring ------------------------------------------------------------------


@query("op8_lm_scoring")
def op8_lm_scoring(spark, sf_dir):
    """Log probabilities of every document under a bigram model of four fifths of them."""
    scored = kneser_ney.held_out_scores(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 7: personal data ---------------------------------------------------------------------------


@query("op7_pii")
def op7_pii(spark, sf_dir):
    """Personal data in every whole document: base spans and those found by context."""
    found = pii.extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


# --- 6: quality classifier ----------------------------------------------------------------------


@query("op6_quality")
def op6_quality(spark, sf_dir):
    """A quality score for every document; labels of one fold in four are held out."""
    judged = quality.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


# --- 4: language ID -----------------------------------------------------------------------------


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    """The language of every page and every document; one of page_id and doc_id is null."""
    docs = table(spark, sf_dir, "documents")
    languages, model = language.trigram_model(docs, "text", "lang")
    pages = language.identify_pages(table(spark, sf_dir, "pages"), languages, model)
    found = language.identify_documents(docs.select("doc_id", "text", "lang", "source"), languages, model, ["doc_id", "lang"])
    columns = ["declared", "predicted", "posterior", "rejected"]
    return found.select("doc_id", F.lit(None).cast("long").alias("page_id"), F.col("lang").alias("declared"), *columns[1:]).union(
        pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", *columns)
    )


# --- 11: benchmark decontamination --------------------------------------------------------------

_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11_SQL = rf"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS g
    FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
    SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v))),
h AS (SELECT r, k, p.n, item FROM p JOIN v ON p.n = v.n AND p.g = v.g),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS k FROM h) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN o USING (r)"""


@query("op11_benchmark_decontamination", _OP11_SQL)
def op11_benchmark_decontamination(spark, sf_dir):
    """Every document with the words and items of the benchmark that it holds, ten words in a row."""
    judged = decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


# --- 12: spelling variants ----------------------------------------------------------------------

_OP12_SQL = r"""
WITH RECURSIVE step AS (
    SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) x(i)
    UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
o AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, count(*) AS n, word
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS word FROM documents)
    WHERE len(word) >= 7 GROUP BY ALL),
x AS (SELECT *, hex(encode(doc || ':' || word)) AS h FROM o),
s AS (
    SELECT n, word, xor(list_reduce(
        list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || h[i : i + 1])::BIGINT),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS c
    FROM x, crc),
r AS (
    SELECT CASE WHEN c % 31 = 0 THEN left(word, (c % len(word))::INT) || substr(word, (c % len(word))::INT + 2) ELSE word END AS word, n FROM s),
w AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM w)),
pairs AS (
    SELECT x.word, y.word AS other, y.n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.i = y.i AND x.word <> y.word
    UNION SELECT x.word, y.word, y.n FROM holes x JOIN w y ON x.a || x.b = y.word
    UNION SELECT y.word, x.word, x.n FROM holes x JOIN w y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS most FROM pairs GROUP BY word),
f AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN other END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
    FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM f JOIN (SELECT chain.word, chain.at FROM chain JOIN f ON chain.at = f.word WHERE f.form IS NULL) c ON c.word = f.word"""


@query("op12_spelling_variants", _OP12_SQL)
def op12_spelling_variants(spark, sf_dir):
    """Words of all documents with their near words, their form and its root; some runs lose a letter."""
    counts = spelling.runs(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=31)
    return spelling.group_variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


# --- 13: ranked lexical search ------------------------------------------------------------------

_OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM h),
i AS (
    SELECT item_id, t, count(*) AS c
    FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM h) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
q AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t, docs),
g AS (SELECT f.r, f.t, q.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * h.n * s.docs) // s.terms))) AS gain FROM f JOIN q USING (t) JOIN h USING (r), s),
e AS (SELECT item_id, r, sum(c * gain)::BIGINT AS score FROM i JOIN g USING (t) GROUP BY item_id, r),
k AS (
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM e JOIN h USING (r) WHERE score > 0)
SELECT * FROM k WHERE rank <= 10"""


@query("op13_ranked_search", _OP13_SQL)
def op13_ranked_search(spark, sf_dir):
    """The ten highest-scoring documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")
