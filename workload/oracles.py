"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import re

from tidepost.settings import (BIN_WEIGHTS, COST_PER_1K_TOKENS, RATING_PROMPT, STOP_WORDS)
from workload import views as V

NAMES = list(V.PROFILE_LABELS.values())


def text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


# Shared inputs --------------------------------------------------------------------------------

POSTINGS = """
postings AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS job_id, d.source, split_part(d.text, chr(10), 1) AS titles,
         split_part(b.text, ' ', 1) AS companies, d.lang AS location, d.text AS "desc",
         coalesce(l.quality, -1) AS label, l.toxic, d.doc_id,
         TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id % 720 AS INTEGER)) AS posted_at
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""

STORE = POSTINGS + """,
store AS (
  SELECT job_id, source, CASE WHEN toxic = 1 THEN '' ELSE titles END AS titles, companies, location,
         "desc", posted_at,
         CASE WHEN label >= 0 THEN label * 50.0::DOUBLE + 25.0::DOUBLE END AS similarity_score,
         CASE WHEN label >= 0 THEN label * 40.0::DOUBLE END AS score_energy
  FROM postings)"""

INCOMING = STORE + """,
incoming AS (
  SELECT job_id, 'crawl1' AS source, titles, companies, "desc", posted_at, 1 AS scraped_at
  FROM postings WHERE label >= 0
  UNION ALL
  SELECT job_id, 'crawl2', titles, companies, "desc", posted_at, 2 FROM postings WHERE toxic = 1
  UNION ALL
  SELECT 'b' || item_id, 'crawl1', split_part(text, ' ', 1), NULL, text, TIMESTAMP '2024-01-31', 1
  FROM benchmark)"""

MERGED = INCOMING + """,
fresh AS (
  SELECT * EXCLUDE rn FROM (
    SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY scraped_at DESC) AS rn FROM incoming)
  WHERE rn = 1),
merged AS (
  SELECT s.job_id, s.source, s.titles, s.companies, s.location, s."desc", s.similarity_score,
         s.score_energy, s.posted_at, CAST(NULL AS BIGINT) AS scraped_at
  FROM store s WHERE s.job_id NOT IN (SELECT job_id FROM fresh)
  UNION ALL
  SELECT job_id, source, titles, companies, NULL, "desc", NULL, NULL, posted_at,
         CAST(scraped_at AS BIGINT) FROM fresh)"""

LISTINGS = POSTINGS + """,
listings AS (
  SELECT DISTINCT p.job_id, p.titles, p.posted_at, n.n_nationkey AS city_ordinal, n.n_name AS query_city
  FROM postings p JOIN nation n ON n.n_nationkey IN (p.doc_id % 25, p.doc_id % 7))"""

_NAME_CASE = "CASE label " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in V.PROFILE_LABELS.items()) + " END"

SCORED_VECTORS = f"""
anchors AS (
  SELECT {_NAME_CASE} AS profile, arg_min(embedding, vec_id)::DOUBLE[] AS a
  FROM embeddings WHERE label IN ({", ".join(map(str, V.PROFILE_LABELS))}) GROUP BY label),
scores AS (
  SELECT e.vec_id, p.profile,
         coalesce(round_even(100 * list_dot_product(e.embedding::DOUBLE[], p.a)
           / nullif(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))
                    * sqrt(list_dot_product(p.a, p.a)), 0), 2), 0) AS score
  FROM embeddings e, anchors p),
wide AS (
  SELECT vec_id, {", ".join(f"max(score) FILTER (WHERE profile = '{n}') AS score_{n}" for n in NAMES)},
         max(score) AS similarity_score
  FROM scores GROUP BY vec_id)"""

_WS = r"\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def clean(column: str, keep_backslash: bool = False) -> str:
    plain = f"lower(replace(regexp_replace({column}, '<[^\\n]*?>', '', 'g'), '\\n', ' '))"
    letters = r"[^a-zA-Z\\]" if keep_backslash else f"[^a-zA-Z{_WS}]"
    return f"regexp_replace({plain}, '{letters}', '', 'g')"


def clean_words(column: str, keep_backslash: bool = False) -> str:
    return (f"list_filter(string_split_regex({clean(column, keep_backslash)}, '[{_WS}]+'), "
            f"lambda t: t <> '' AND NOT list_contains({strings(STOP_WORDS)}, t))")


def grams(source: str, columns: str = "job_id") -> str:
    """CTEs from a relation to (job_id, term, tf) as ``counts``."""
    return f"""
words AS (
  SELECT job_id, list_filter({clean_words('"desc"')}, lambda t: len(t) > 1) AS w FROM {source}),
counts AS (
  SELECT job_id, term, count(*) AS tf FROM (
    SELECT job_id, unnest(list_concat(w, list_transform(range(1, len(w)),
           lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words)
  GROUP BY job_id, term)"""


def vocab(documents: str, kept: str = "ORDER BY cf DESC, term LIMIT 100000") -> str:
    return f"""
n AS (SELECT count(*) AS total FROM {documents}),
vocab AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts
  GROUP BY term HAVING count(*) <= 0.8::DOUBLE * (SELECT total FROM n) {kept}),
idf AS (SELECT term, df, ln((1 + total)::DOUBLE / (1 + df)) + 1 AS idf FROM vocab, n)"""


WEIGHTS = """
weighted AS (SELECT c.job_id, c.term, c.tf * i.idf AS w FROM {counts} c JOIN idf i USING (term))
SELECT job_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY job_id)), 6) AS weight FROM weighted"""

def field_values(column: str, prefix: str) -> str:
    """CTEs to ``<prefix>_weighted``: (job_id, slot, value) of one text field."""
    body = f"""{grams('postings')}, {vocab('postings')},
weighted AS (SELECT job_id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY job_id)) AS value FROM (
  SELECT c.job_id, '{column}:' || c.term AS slot, c.tf * i.idf AS w FROM counts c JOIN idf i USING (term)))"""
    body = body.replace('"desc"', f'"{column}"')
    for name in ("words", "counts", "n", "vocab", "idf", "weighted"):
        body = re.sub(rf"(?<!\\)\b{name}\b", f"{prefix}_{name}", body)
    return body


_TOKEN_SET = f"list_distinct(list_filter(string_split_regex(lower(\"desc\"), '[{_WS}]+'), lambda t: t <> ''))"


def bin_hits(name: str) -> str:
    phrases = "[" + ", ".join(strings(p.lower().split()) for p in V.BINS[name]) + "]"
    return f"CAST(len(list_filter({phrases}, lambda p: list_has_all(toks, p))) AS BIGINT) AS keyword_{name}"


_TOTAL = " + ".join(f"keyword_{b} * {w}::DOUBLE" for b, w in BIN_WEIGHTS.items())
BIN_COLUMNS = ", ".join(f"keyword_{b}" for b in V.BINS)


def features(source: str, keep: str) -> str:
    return f"""
toks AS (SELECT {keep}, CAST(len(string_split("desc", ' ')) AS BIGINT) AS word_count,
                {_TOKEN_SET} AS toks FROM {source}),
hits AS (SELECT {keep}, word_count, {", ".join(bin_hits(b) for b in V.BINS)} FROM toks),
totals AS (SELECT *, {_TOTAL} AS total_weighted_keywords FROM hits),
features AS (SELECT *, total_weighted_keywords / word_count AS weighted_keywords FROM totals)"""


_NUMERIC = [f"keyword_{b}" for b in V.BINS] + ["weighted_keywords"]
_FEATURE_VALUES = f"""{POSTINGS}, {field_values('desc', 'd')}, {field_values('titles', 't')}, {features('postings', 'job_id')},
numbers AS (""" + " UNION ALL ".join(
    f"SELECT job_id, '{c}' AS slot, coalesce(({c} - min({c}) OVER ())::DOUBLE / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0)"
    f" AS value FROM features" for c in _NUMERIC) + """),
vals AS (SELECT * FROM d_weighted UNION ALL SELECT * FROM t_weighted UNION ALL SELECT * FROM numbers WHERE value <> 0)"""

SCORED = POSTINGS + """,
scored AS (
  SELECT job_id, label, p AS probability, CAST(p >= 0.3 AS INTEGER) AS prediction FROM (
    SELECT job_id, label, round(least(1.0::DOUBLE, len(string_split("desc", ' '))::DOUBLE / 1000), 3) AS p
    FROM postings WHERE label >= 0))"""

_PLACED = """
placed AS (
  SELECT {columns}, row_number() OVER (PARTITION BY {label} ORDER BY md5('0:' || {key}), {key}) AS pos,
         count(*) OVER (PARTITION BY {label}) AS size FROM {source})"""


def placed(source: str, columns: str, label: str, key: str) -> str:
    return _PLACED.format(source=source, columns=columns, label=label, key=key)


FOLD = """CAST(CASE WHEN pos <= (size % 5) * (size // 5 + 1) THEN (pos - 1) // (size // 5 + 1)
              ELSE size % 5 + (pos - 1 - (size % 5) * (size // 5 + 1)) // greatest(size // 5, 1)
              END AS INTEGER) AS fold"""


def metric_columns(by: str, source: str) -> str:
    """CTEs to ``measured``: accuracy, recall, precision and tie-averaged Mann-Whitney AUC."""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""
ranked AS (
  SELECT *, rank() OVER ({part} ORDER BY probability)
            + (count(*) OVER (PARTITION BY {lead} probability) - 1) / 2.0::DOUBLE AS r FROM {source}),
measured AS (
  SELECT {lead} avg(CASE WHEN prediction = label THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy,
         coalesce(sum(CASE WHEN prediction = 1 AND label = 1 THEN 1 ELSE 0 END)::DOUBLE
           / nullif(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END), 0), 0) AS recall,
         coalesce(sum(CASE WHEN prediction = 1 AND label = 1 THEN 1 ELSE 0 END)::DOUBLE
           / nullif(sum(CASE WHEN prediction = 1 THEN 1 ELSE 0 END), 0), 0) AS precision,
         (sum(CASE WHEN label = 1 THEN r ELSE 0 END)
           - sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) * (sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) + 1) / 2.0)
           / nullif(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END)::DOUBLE
                    * sum(CASE WHEN label = 0 THEN 1 ELSE 0 END), 0) AS roc_auc
  FROM ranked {group})"""


def visible(column: str) -> str:
    body = column
    for pattern in ("(?s)<!--.*?-->", "(?is)<script\\b[^>]*>.*?</script>",
                    "(?is)<style\\b[^>]*>.*?</style>", "(?s)<[^>]*>"):
        body = f"regexp_replace({body}, '{pattern}', ' ', 'g')"
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        body = f"replace({body}, {text(entity)}, {text(char)})"
    return f"trim(regexp_replace({body}, '[{_WS}]+', ' ', 'g'))"


def inner(tag: str) -> str:
    return visible(f"regexp_extract(html, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)")


def attr(tag: str, name: str) -> str:
    found = f"regexp_extract(html, '(?is)<{tag}\\b[^>]*?\\b{name}=[\"'']([^\"'']*)[\"'']', 1)"
    return f"trim(replace({found}, '&amp;', '&'))"


_FILLED = {"profile": text(V.PROFILE_TEXT), "criteria": text(V.CRITERIA)} | {
    name: f"coalesce({column}, '')" for name, column in
    (("companies", "companies"), ("titles", "titles"), ("location", "location"), ("desc", '"desc"'))}


def prompt_sql() -> str:
    rest, parts = RATING_PROMPT, []
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [text(head), _FILLED[name]]
    return " || ".join(parts + [text(rest)])


_REPLIES = """
replies AS (
  SELECT event_id AS job_id, event_type, CAST(floor(value) AS BIGINT) AS total_tokens,
         CASE event_id % 5 WHEN 0 THEN k || '/10' WHEN 1 THEN ' ' || k || ' ' ELSE k END AS raw
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events))"""

_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"

# Queries --------------------------------------------------------------------------------------

ORACLES = {
    "profile_scores": f"WITH {SCORED_VECTORS} SELECT * FROM wide",
    "topk_overall": f"""WITH {SCORED_VECTORS} SELECT vec_id, similarity_score FROM wide
        ORDER BY similarity_score DESC, vec_id LIMIT 10""",
    "topk_per_profile": f"""WITH {SCORED_VECTORS}, r AS (SELECT profile, vec_id, score,
        CAST(row_number() OVER (PARTITION BY profile ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
        SELECT profile, rank, vec_id, score FROM r WHERE rank <= 3""",
    "topk_many_profiles": """WITH unit AS (
          SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings),
        scores AS (SELECT p.vec_id AS profile, e.vec_id,
            coalesce(round_even(100 * list_dot_product(e.v, p.v) / nullif(e.len * p.len, 0), 2), 0) AS score
          FROM unit e, unit p WHERE p.vec_id % 20 = 0 AND e.v IS NOT NULL AND p.v IS NOT NULL),
        r AS (SELECT profile, vec_id, score,
            CAST(row_number() OVER (PARTITION BY profile ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
        SELECT profile, rank, vec_id, score FROM r WHERE rank <= 3""",
    "rank_threshold": f"""WITH {SCORED_VECTORS} SELECT vec_id, similarity_score FROM wide
        WHERE similarity_score >= 10 ORDER BY similarity_score DESC, vec_id""",
    "semantic_ranking": f"""WITH {SCORED_VECTORS},
        lists AS (SELECT profile AS list, vec_id, score, 3 AS cap FROM scores
                  UNION ALL SELECT 'similarity_score', vec_id, similarity_score, 10 FROM wide),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY list ORDER BY score DESC, vec_id) AS INTEGER) AS rank
              FROM lists)
        SELECT list, rank, vec_id, score FROM r WHERE rank <= cap""",

    "semantic_run": f"""WITH {POSTINGS},
        texts AS (SELECT job_id AS k, "desc" AS t FROM postings WHERE doc_id % 2 <> 0
                  UNION ALL SELECT CASE item_id WHEN 0 THEN 'first' ELSE 'second' END, text FROM benchmark WHERE item_id < 2),
        tok AS (SELECT k, unnest(list_filter(string_split_regex(lower(t), '[{_WS}]+'), lambda x: x <> '')) AS t FROM texts),
        cells AS (SELECT k, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS INTEGER) AS dim, count(*)::DOUBLE AS c
                  FROM tok GROUP BY ALL),
        norms AS (SELECT k, sqrt(sum(c * c)) AS norm FROM cells GROUP BY k),
        dots AS (SELECT d.k, a.k AS profile, sum(d.c * a.c) AS dot FROM cells d JOIN cells a USING (dim)
                 WHERE a.k IN ('first', 'second') GROUP BY ALL),
        scores AS (SELECT p.job_id, q.profile, coalesce(round_even(100 * dot / (n.norm * m.norm), 2), 0) AS score
                   FROM postings p CROSS JOIN (SELECT unnest(['first', 'second']) AS profile) q
                   LEFT JOIN dots ON dots.k = p.job_id AND dots.profile = q.profile
                   LEFT JOIN norms n ON n.k = p.job_id LEFT JOIN norms m ON m.k = q.profile WHERE p.doc_id % 2 <> 0),
        best AS (SELECT job_id, max(score) AS score FROM scores GROUP BY job_id),
        lists AS (SELECT profile AS list, job_id, score, 3 AS cap FROM scores
                  UNION ALL SELECT 'similarity_score', job_id, score, 10 FROM best),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY list ORDER BY score DESC, job_id) AS INTEGER) AS rank FROM lists)
        SELECT 'table' AS list, 0 AS rank, job_id, coalesce(b.score, 50.0) AS score FROM postings LEFT JOIN best b USING (job_id)
        UNION ALL SELECT 'csv', 0, job_id, score FROM best
        UNION ALL SELECT list, rank, job_id, score FROM ranked WHERE rank <= cap""",
    "upsert_replace": f"""WITH {MERGED} SELECT job_id, source, titles, companies, location, "desc",
        similarity_score, score_energy, {_STAMP.format('posted_at')}, scraped_at FROM merged""",
    "score_update": f"""WITH {STORE} SELECT s.job_id,
        CASE WHEN l.doc_id IS NULL THEN s.similarity_score ELSE l.toxic * 10.0::DOUBLE + 1 END AS similarity_score,
        CASE WHEN l.doc_id IS NULL THEN s.score_energy WHEN l.quality = 1 THEN 7.5::DOUBLE END AS score_energy
        FROM store s LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = s.job_id""",
    "new_ids_anti": f"""WITH {INCOMING} SELECT job_id, source, titles FROM incoming
        WHERE job_id NOT IN (SELECT job_id FROM store)""",
    "refetch_anti": f"""WITH {INCOMING} SELECT job_id, source, titles FROM incoming
        WHERE job_id NOT IN (SELECT job_id FROM store WHERE length(titles) > 0 AND length("desc") > 0)""",
    "unscored_scan": f"""WITH {STORE} SELECT job_id, source, titles, location FROM store
        WHERE similarity_score IS NULL""",
    "evolve_schema": f"""WITH {POSTINGS} SELECT job_id, source, titles, CAST(NULL AS VARCHAR) AS companies,
        location, CAST(NULL AS VARCHAR) AS level,
        {", ".join(f"CAST(NULL AS DOUBLE) AS score_{n}" for n in NAMES)},
        CAST(NULL AS DOUBLE) AS similarity_score FROM postings""",
    "multi_query_dedupe": f"""WITH {LISTINGS} SELECT job_id, arg_min(query_city, city_ordinal) AS query_city,
        CAST(min(city_ordinal) AS BIGINT) AS city_ordinal, any_value(titles) AS titles FROM listings GROUP BY job_id""",
    "crawl_budget": f"""WITH {LISTINGS},
        listed AS (SELECT *, row_number() OVER (PARTITION BY query_city ORDER BY posted_at DESC, job_id) AS listed_at
                   FROM listings),
        fresh AS (SELECT query_city, job_id, titles,
                         row_number() OVER (PARTITION BY query_city ORDER BY posted_at DESC, job_id) AS rank
                  FROM listed WHERE listed_at <= 1000
                  AND job_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels))
        SELECT query_city, rank, job_id, titles FROM fresh WHERE rank <= 125""",
    "search_filter": f"""WITH {POSTINGS} SELECT job_id, titles, location, {_STAMP.format('posted_at')}
        FROM postings WHERE (contains(lower(titles), 'the') OR contains(lower("desc"), 'the'))
        AND contains(lower(location), 'en')
        AND posted_at >= TIMESTAMP '{V.AS_OF}' - to_seconds(604800)""",

    "clean_text": f"""WITH {POSTINGS} SELECT job_id, array_to_string({clean_words('"desc"')}, ' ') AS clean
        FROM postings""",
    "clean_text_literal": f"""WITH {POSTINGS} SELECT job_id,
        array_to_string({clean_words('"desc"', True)}, ' ') AS clean FROM postings""",
    "lemma_lookup": f"""WITH {POSTINGS} SELECT job_id, array_to_string(list_transform({clean_words('"desc"')},
        lambda t: CASE t {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.LEMMAS)} ELSE t END), ' ') AS lemmatized
        FROM postings""",
    "word_count": f"""WITH {POSTINGS} SELECT job_id, CAST(len(string_split("desc", ' ')) AS BIGINT) AS word_count
        FROM postings""",
    "company_in_desc": f"""WITH {POSTINGS} SELECT job_id,
        CAST(coalesce(contains("desc", companies), false) AS INTEGER) AS company_in_desc FROM postings""",
    "fill_defaults": f"""WITH {MERGED} SELECT job_id, coalesce(location, '') AS location,
        coalesce(companies, '') AS companies, 'n/a' AS level FROM merged""",
    "keyword_bins": f"""WITH {POSTINGS}, {features('postings', 'job_id')}
        SELECT job_id, {BIN_COLUMNS} FROM features""",
    "keyword_table": f"""WITH {POSTINGS}, {features('postings', 'job_id')}
        SELECT job_id, {BIN_COLUMNS} FROM features""",
    "weighted_keywords": f"""WITH {POSTINGS}, {features('postings', 'job_id')}
        SELECT job_id, round(total_weighted_keywords, 6) AS total_weighted_keywords,
               round(weighted_keywords, 6) AS weighted_keywords FROM features""",
    "minmax_scaled": f"""WITH {POSTINGS}, {features('postings', 'job_id')}
        SELECT job_id, {", ".join(
            f"round(coalesce(({c} - min({c}) OVER ())::DOUBLE / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), 6)"
            f" AS {c}" for c in [f"keyword_{b}" for b in V.BINS] + ["weighted_keywords"])},
            0.0::DOUBLE AS constant FROM features""",
    "dedupe_subset": f"""WITH {POSTINGS} SELECT job_id, titles, location, companies FROM (SELECT *,
        row_number() OVER (PARTITION BY titles, location, "desc" ORDER BY doc_id) AS rn FROM postings)
        WHERE rn = 1""",
    "union_synthetic": f"""WITH {POSTINGS} SELECT titles, CAST(NULL AS VARCHAR) AS companies, "desc", label
        FROM postings UNION ALL SELECT split_part(text, ' ', 1), NULL, text, 1 FROM benchmark""",
    "union_sources": f"""WITH {POSTINGS} SELECT job_id, titles, source, location FROM postings
        UNION ALL SELECT NULL, split_part(text, ' ', 1), 'cards', NULL FROM benchmark
        UNION ALL SELECT conv_id || '-' || turn, NULL, role, NULL FROM conversations""",
    "labelled_filter": f"WITH {POSTINGS} SELECT job_id, label FROM postings WHERE label >= 0",
    "class_distribution": f"""WITH {POSTINGS} SELECT label, count(*) AS n,
        round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM postings GROUP BY label""",
    "csv_roundtrip": f"""WITH {POSTINGS} SELECT job_id, titles, "desc", label AS true_labels FROM postings""",
    "training_frame": f"""WITH {POSTINGS},
        kept AS (SELECT replace(titles, '\\n', ' ') AS titles, companies, replace("desc", '\\n', ' ') AS "desc", label
                 FROM (SELECT *, row_number() OVER (PARTITION BY titles, companies, location, "desc"
                                                    ORDER BY doc_id) AS rn FROM postings) WHERE rn = 1
                 UNION ALL SELECT split_part(text, ' ', 1), NULL, text, 1 FROM benchmark),
        {features('kept', 'titles, companies, "desc", label')}
        SELECT titles, companies, md5("desc") AS desc_md5, label, word_count, {BIN_COLUMNS},
               round(total_weighted_keywords, 6) AS total_weighted_keywords,
               round(weighted_keywords, 6) AS weighted_keywords FROM features""",

    "ngram_counts": f"WITH {POSTINGS}, {grams('postings')} SELECT job_id, term, tf FROM counts",
    "vocabulary": f"""WITH {POSTINGS}, {grams('postings')}, {vocab('postings')}
        SELECT term, df, cf FROM vocab""",
    "idf_table": f"""WITH {POSTINGS}, {grams('postings')}, {vocab('postings', '')}
        SELECT term, df, round(idf, 6) AS idf FROM idf""",
    "tfidf_weights": f"WITH {POSTINGS}, {grams('postings')}, {vocab('postings')}, "
                     + WEIGHTS.format(counts="counts"),
    "apply_tfidf": f"""WITH {POSTINGS}, train AS (SELECT * FROM postings WHERE label >= 0),
        fresh AS (SELECT * FROM postings WHERE label < 0), {grams('train')}, {vocab('train')},
        {grams('fresh').replace('words AS', 'fresh_words AS').replace('FROM words', 'FROM fresh_words')
                       .replace('counts AS', 'fresh_counts AS')}, """ + WEIGHTS.format(counts="fresh_counts"),
    "feature_vectors": f"""WITH {_FEATURE_VALUES} SELECT job_id, slot, round(value, 6) AS value FROM vals""",
    "feature_variance": f"""WITH {_FEATURE_VALUES}, total AS (SELECT count(*) AS m FROM postings)
        SELECT count(*) AS slots, round(sum((q - s * s / m) / (m - 1)), 5) AS total_variance FROM (
        SELECT slot, sum(value) AS s, sum(value * value) AS q FROM vals GROUP BY slot), total""",
    "hash_embed": f"""WITH {POSTINGS},
        tok AS (SELECT job_id, unnest(list_filter(string_split_regex(lower("desc"), '[{_WS}]+'),
                lambda t: t <> '')) AS t FROM postings),
        cells AS (SELECT job_id, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS INTEGER) AS dim,
                  count(*)::DOUBLE AS c FROM tok GROUP BY ALL)
        SELECT job_id, dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY job_id)), 6) AS weight FROM cells""",

    "hash_embed_windows": f"""WITH {POSTINGS},
        tok AS (SELECT job_id, list_filter(string_split_regex(lower("desc"), '[{_WS}]+'), lambda t: t <> '') AS w FROM postings),
        n AS (SELECT job_id, w, CASE WHEN len(w) <= 256 THEN 1 ELSE CAST(ceil((len(w) - 256) / 224.0) AS BIGINT) + 1 END AS windows FROM tok),
        win AS (SELECT job_id, i, w[i * 224 + 1:i * 224 + 256] AS w FROM (SELECT *, unnest(range(windows)) AS i FROM n)),
        cells AS (SELECT job_id, i, size, CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 64 AS INTEGER) AS dim, count(*)::DOUBLE AS c
          FROM (SELECT job_id, i, len(w) AS size, unnest(w) AS t FROM win) GROUP BY ALL),
        unit AS (SELECT *, c / sqrt(sum(c * c) OVER (PARTITION BY job_id, i)) AS x FROM cells),
        total AS (SELECT job_id, sum(len(w)) AS tokens FROM win GROUP BY job_id)
        SELECT job_id, dim, round(sum(x * size) / any_value(tokens), 6) AS weight
        FROM unit JOIN total USING (job_id) GROUP BY job_id, dim""",

    "stratified_split": f"""WITH {placed('labels', 'doc_id, quality', 'quality', 'doc_id')}
        SELECT doc_id, quality, CAST(pos <= floor(size * 0.25 + 0.5) AS INTEGER) AS is_test FROM placed""",
    "stratified_folds": f"""WITH {placed('labels', 'doc_id, quality', 'quality', 'doc_id')}
        SELECT doc_id, quality, {FOLD} FROM placed""",
    "fold_sizes": f"""WITH known AS (SELECT d.doc_id, l.quality AS label FROM documents d JOIN labels l USING (doc_id)
        WHERE l.quality >= 0), {placed('known', 'doc_id, label', 'label', 'doc_id')}
        SELECT fold, label, count(*) AS n, count(*) AS n_predicted FROM (SELECT label, {FOLD} FROM placed) GROUP BY fold, label""",
    "confusion_held_out": """SELECT label, CAST(floor(count(*) * 0.25 + 0.5) AS BIGINT) AS n FROM (
        SELECT l.quality AS label FROM documents d JOIN labels l USING (doc_id) WHERE l.quality >= 0) GROUP BY label""",
    "confusion_matrix": f"""WITH {SCORED} SELECT label, count(*) FILTER (WHERE prediction = 0) AS predicted_0,
        count(*) FILTER (WHERE prediction = 1) AS predicted_1 FROM scored GROUP BY label""",
    "classification_metrics": f"""WITH {SCORED}, {metric_columns('', 'scored')} SELECT round(accuracy, 6) AS accuracy,
        round(recall, 6) AS recall, round(precision, 6) AS precision, round(roc_auc, 6) AS roc_auc FROM measured""",
    "cv_metric_table": f"""WITH {SCORED}, {placed('scored', '*', 'label', 'job_id')},
        folds AS (SELECT job_id, label, probability, prediction, {FOLD} FROM placed),
        runs AS (SELECT 'lenient' AS model, * FROM folds UNION ALL
                 SELECT 'strict', job_id, label, probability, CAST(probability >= 0.6 AS INTEGER), fold FROM folds),
        {metric_columns('model, fold', 'runs')},
        long AS (UNPIVOT (SELECT model, fold, accuracy, recall, precision, roc_auc FROM measured)
                 ON accuracy, recall, precision, roc_auc INTO NAME metric VALUE v)
        SELECT metric, round(avg(v) FILTER (WHERE model = 'lenient'), 6) AS lenient,
               round(avg(v) FILTER (WHERE model = 'strict'), 6) AS strict FROM long GROUP BY metric""",
    "prediction_counts": f"WITH {SCORED} SELECT prediction, count(*) AS n FROM scored GROUP BY prediction",

    # From the markers around the parts, not from element patterns.
    "page_fields": f"""WITH parts AS (SELECT *, {visible("split_part(split_part(html, '<article>', 2), '</article>', 1)")} AS body
        FROM pages)
        SELECT CAST(page_id AS VARCHAR) AS job_id, 'Pages' AS source,
        {visible("split_part(split_part(html, '<h1>', 2), '</h1>', 1)")} AS titles,
        split_part(split_part(html, 'href="', 2), '"', 1) AS companies,
        split_part(split_part(html, 'lang="', 2), '"', 1) AS location,
        {visible("split_part(split_part(html, '<li>', 2), '</li>', 1)")} AS level,
        'First ' || body || ' Last é' AS "desc",
        {visible("split_part(split_part(html, '<div class=" + '"ad"' + ">', 2), '</div>', 1)")} AS ad,
        '2024-01-0' || (page_id % 9 + 1) AS posted_at_raw FROM parts""",
    "page_layouts": f"""WITH parts AS (SELECT *, {visible("split_part(split_part(html, '<article>', 2), '</article>', 1)")} AS body
        FROM pages)
        SELECT CAST(page_id AS VARCHAR) AS job_id, 'article' AS layout, 'Pages' AS source,
        {visible("split_part(split_part(html, '<h1>', 2), '</h1>', 1)")} AS titles,
        split_part(split_part(html, 'href="', 2), '"', 1) AS companies,
        split_part(split_part(html, 'lang="', 2), '"', 1) AS location,
        {visible("split_part(split_part(html, '<li>', 2), '</li>', 1)")} AS level,
        'First ' || body || ' Last é' AS "desc",
        {visible("split_part(split_part(html, '<div class=" + '"ad"' + ">', 2), '</div>', 1)")} AS ad,
        '2024-01-0' || (page_id % 9 + 1) AS posted_at_raw FROM parts""",
    "page_cards": f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS card, {visible("split_part(x, '>', 2)")} AS titles,
        split_part(split_part(x, '"', 1), '/', 2) AS job_id FROM (SELECT page_id, unnest(items) AS x,
        generate_subscripts(items, 1) AS i FROM (SELECT page_id, list_transform(string_split(split_part(split_part(
        html, '<nav>', 2), '</nav>', 1), '<li><a href="')[2:], lambda s: split_part(s, '</a>', 1)) AS items FROM pages))""",
    "html_to_text": f"SELECT page_id, {visible('html')} AS text FROM pages",
    "id_from_urn": """SELECT url, job_id FROM (SELECT url, nullif(split_part(CASE WHEN page_id % 10 = 0 THEN 'urn:li'
        ELSE 'urn:li:jobPosting:' || page_id END, ':', 4), '') AS job_id FROM pages) WHERE job_id IS NOT NULL""",
    "id_from_link": """SELECT url, coalesce(CASE WHEN page_id % 3 = 0 THEN 'a' || page_id END,
        regexp_extract('/jobs/view/' || page_id || '/?ref=' || url, 'view/([^/]*)', 1)) AS job_id FROM pages""",
    "strip_prefix": f"""SELECT page_id, trim(replace(' Seniority level ' || nullif({inner('h1')}, ''),
        'Seniority level', '')) AS level FROM pages""",
    "delimited_part": """SELECT page_id, CASE WHEN len(string_split(t, '|')) >= 2 THEN trim(split_part(t, '|', 2)) END
        AS location FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url ELSE 'Company | ' || url || ' |x' END AS t
        FROM pages)""",
    "posted_at_typed": """SELECT page_id, raw AS posted_at_raw,
        strftime(TRY_CAST(raw AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS posted_at FROM (SELECT page_id,
        CASE WHEN page_id % 2 = 0 THEN strftime(DATE '2024-01-01' + CAST(page_id % 28 AS INTEGER), '%Y-%m-%d')
        ELSE '2 weeks ago' END AS raw FROM pages)""",

    "prompt_build": f"WITH {POSTINGS} SELECT job_id, {prompt_sql()} AS prompt FROM postings",
    "rating_parse": f"""WITH {_REPLIES} SELECT job_id, event_type, rating,
        CAST(rating BETWEEN 1 AND 10 AS INTEGER) AS rating_valid FROM (
        SELECT *, coalesce(TRY_CAST(trim(raw) AS BIGINT), 0) AS rating FROM replies)""",
    "token_cost": f"""WITH {_REPLIES} SELECT CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
        round(sum(total_tokens)::DOUBLE / 1000 * {COST_PER_1K_TOKENS}::DOUBLE, 6) AS cost FROM replies""",

    "stream_dedupe": f"SELECT event_id, user_id, event_type, value, {_STAMP.format('ts')} FROM events",
    "stream_upsert": f"""SELECT user_id, event_id, event_type, value, {_STAMP.format('ts')} FROM (SELECT *,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "stream_score": f"WITH {SCORED_VECTORS} SELECT * FROM wide",
}
