"""The registered queries of this subpackage, each with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.llm import brown_lm, index_queries, language_crf, quality_model, secret_scan, toxicity, url_filter
from lumora.llm.decontaminate import contained
from lumora.llm.ngram_jaccard import jaccard_classes, link_counts
from lumora.llm.packing import pack
from lumora.llm.quality_rules import SYMBOLS, quality_rules
from lumora.llm.sampling import fold
from lumora.llm.text import table


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"), percent=75, words=5)


def op1_ngram_links(spark, sf_dir):
    return link_counts(table(spark, sf_dir, "documents"), percent=75, words=5)


def op2_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


#: Fixed by the query's contract.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op3_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_crf.fit(docs.where(fold(5) != 0))
    return language_crf.languages(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score", "n_switches")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark, sf_dir, tokenizer_file=None):
    return pack(table(spark, sf_dir, "documents"), tokenizer_file or vocabulary_path(), size=4096, end_id=2, lower=True)


def op6_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return quality_model.quality_scores(docs, model, threshold=0.3).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op7_brown_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return brown_lm.lm_scores(docs, fold(10) != 0).select("doc_id", (fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.find_secrets(docs, secret_scan.fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != secret_scan.MODEL_KIND)
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secret_scan.KINDS), F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return toxicity.toxicity(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "severity", "grade", "toxic")


def op10_decontaminate(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=75, words=5)


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op1_ngram_links, op2_quality_rules, op3_url_filter, op4_language_id, op5_packing, op6_quality_classifier, op7_brown_lm, op8_secret_scan, op9_toxicity, op10_decontaminate)} | index_queries.QUERIES

#: Words of a text, A to Z lower-cased: DuckDB's lower() folds other letters too.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = f"translate(text, '{_UPPER}', '{_LOWER}')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE_SQL: dict[str, str] = dict(index_queries.ORACLE_SQL)

ORACLE_SQL["op1_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_WORDS}) AS a FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT r, doc_id, unnest(list_distinct(CASE WHEN len(a) >= 5 THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' ')) ELSE [array_to_string(a, ' ')] END)) AS g FROM w WHERE len(a) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
q AS (SELECT s.r, s.g FROM s JOIN f USING (g)),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM q x JOIN q y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(v.doc_id) AS component_id
FROM w LEFT JOIN n ON n.r = w.r JOIN reach ON reach.a = w.r JOIN w v ON v.r = reach.b GROUP BY w.r, w.doc_id
"""

ORACLE_SQL["op1_ngram_links"] = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_WORDS}) AS a FROM documents),
k AS (SELECT r, doc_id, CASE WHEN len(a) = 0 OR a IS NULL THEN NULL WHEN len(a) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' ')))) ELSE [array_to_string(a, ' ')] END AS g FROM w),
d AS (SELECT row_number() OVER () AS i, g, len(g) AS n FROM (SELECT DISTINCT g FROM k WHERE g IS NOT NULL AND doc_id IS NOT NULL)),
s AS (SELECT i, n, unnest(g) AS x FROM d),
p AS (SELECT a.i AS a, b.i AS b FROM s a JOIN s b ON a.x = b.x AND a.i <> b.i GROUP BY a.i, a.n, b.i, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
c AS (SELECT a AS i, count(*) AS n_links FROM p GROUP BY a)
SELECT k.doc_id, CAST(coalesce(len(k.g), 0) AS BIGINT) AS n_shingles, CAST(CASE WHEN k.doc_id IS NULL THEN 0 ELSE coalesce(c.n_links, 0) END AS BIGINT) AS n_links
FROM k LEFT JOIN d ON d.g = k.g LEFT JOIN c USING (i)
"""

_SYMBOL_CLASS = "[" + SYMBOLS.replace("$", r"\$").replace("|", r"\|") + "]"


def _n(pattern: str, text: str = "t") -> str:
    return f"CAST(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')) AS BIGINT)"


ORACLE_SQL["op2_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, {_WORDS}) AS a FROM d),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, {_WORDS}) GROUP BY r),
g AS (SELECT r, unnest(range(1, len(a) - 1)) AS i, unnest(list_transform(range(1, len(a) - 1), lambda i: array_to_string(a[i:i+2], ' '))) AS g FROM w WHERE len(a) > 2),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
again AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM m) GROUP BY r),
c AS (SELECT w.r, doc_id, t, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(a, '')), 0) AS BIGINT) AS word_chars, {_n(_SYMBOL_CLASS)} AS n_symbols,
      CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN lines USING (r) LEFT JOIN again USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_dup_lines <= 3 * n_lines
  AND {_n('[A-Z]')} <= {_n('[a-z]')} AND 5 * {_n('[!?]')} <= n_words AND 5 * {_n('[0-9]')} <= word_chars
  AND 2 * {_n('[A-Za-z]|[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} >= word_chars AS kept
FROM f
"""


def _touching(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def _rule_sql() -> str:
    fits = []
    for rule, verdict in sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}'")
    return "CASE " + " ".join(fits) + " END"


ORACLE_SQL["op3_url_filter"] = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, translate(rest, '{_UPPER}', '{_LOWER}') AS low FROM h),
r AS (SELECT *, {_rule_sql()} AS rule,
  {' OR '.join(_touching(t) for t in url_filter.STRICT)} AS strict_hit,
  {' + '.join(f"CAST({_touching(t)} AS INT)" for t in url_filter.SOFT)} AS soft_n,
  {' + '.join(f"{w} * CAST({_touching(t)} AS INT)" for t, w in url_filter.SOFT.items())} AS soft_sum FROM p)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in URL_RULES)} WHEN strict_hit OR (soft_n > 1 AND soft_sum >= {url_filter.SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

ORACLE_SQL["op10_decontaminate"] = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, {_WORDS}) AS a FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_FOLD}, {_WORDS}) AS a FROM benchmark),
i AS (SELECT q, item_id, least(5, len(a)) AS k, unnest(list_distinct(list_transform(range(1, len(a) - least(5, len(a)) + 2), lambda j: array_to_string(a[j:j + least(5, len(a)) - 1], ' ')))) AS g FROM b WHERE len(a) > 0),
n AS (SELECT q, item_id, CAST(count(*) AS BIGINT) AS n_item FROM i GROUP BY q, item_id),
ks AS (SELECT DISTINCT k FROM i),
s AS (SELECT DISTINCT r, doc_id, k, unnest(list_transform(range(1, len(a) - k + 2), lambda j: array_to_string(a[j:j + k - 1], ' '))) AS g FROM w, ks WHERE len(a) >= k),
c AS (SELECT s.r, s.doc_id, i.q, count(*) AS n_shared FROM s JOIN i ON s.k = i.k AND s.g = i.g GROUP BY s.r, s.doc_id, i.q)
SELECT doc_id, item_id, n_shared, n_item FROM c JOIN n USING (q) WHERE 100 * n_shared >= 75 * n_item
"""
