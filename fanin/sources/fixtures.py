"""Test and bench inputs derived by SQL from the driver's Parquet tables.

Each view is one SQL text that runs unchanged in Spark and in DuckDB (a few
need a dialect pair).  ``{name}`` placeholders name the tables or views a
view reads.  Spark binds them to DataFrames through ``spark.sql(text, **dfs)``
(no global temp views); the DuckDB oracles inline them as CTEs in dependency
order.  The operators never see how these rows were made: they take any
DataFrame of the schema.  The modulo rules below model variety in the input
(which pages have a browser capture, which are in the memo, which URLs come
padded or duplicated), as FIXTURES.md defines them; every query runs over all
rows of its views.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# As-of instants used with the fixtures (epoch microseconds, UTC).
SEARCH_AS_OF_US = 1704844800000000   # 2024-01-10 00:00:00
MEMO_AS_OF_US = 1705276800000000     # 2024-01-15 00:00:00

VIEWS: dict[str, str | dict[str, str]] = {
    "pg": """
SELECT page_id, url, html, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang,
       concat(regexp_extract(url, '/(en|fr|de|es)/', 1), '-', CAST(CAST(floor(page_id / 60.0) AS INT) AS STRING)) AS topic,
       regexp_extract(html, '<title>(.*?)</title>', 1) AS title
FROM {pages}""",
    "raw_a": """
SELECT topic AS query_id, CAST(floor((rn - 1) / 5.0) AS INT) + 1 AS page_no, CAST((rn - 1) % 5 AS INT) AS pos,
       CASE WHEN page_id % 31 = 0 THEN '  ' WHEN page_id % 7 = 0 THEN concat(' ', url, ' ') ELSE url END AS url,
       CASE WHEN page_id % 17 = 0 THEN NULL ELSE title END AS title,
       title AS content, CAST(page_id % 10 AS DOUBLE) AS score,
       CASE WHEN page_id % 6 = 0 THEN NULL ELSE 1704067200000000 + page_id * 3600000000 END AS published_us
FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5(concat(url, 'a', k)), page_id) AS rn
      FROM (SELECT *, '0' AS k FROM {pg} UNION ALL SELECT *, '1' AS k FROM {pg} WHERE page_id % 9 = 0) u) r""",
    "raw_b": """
SELECT topic AS query_id, CAST(rn - 1 AS INT) AS pos,
       CASE WHEN page_id % 10 = 0 THEN NULL ELSE v END AS href, CASE WHEN page_id % 10 = 0 THEN v ELSE NULL END AS url,
       title, title AS body, 1704067200000000 + page_id * 3600000000 AS published_us
FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5(concat(url, 'b')), page_id) AS rn,
             concat(regexp_replace(regexp_replace(url, '#.*$', ''), '^https:', 'HTTPS:'),
                    CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'UTM_Medium=alt') AS v
      FROM {pg}) r""",
    "source_outcomes": """
SELECT query_id, source,
       CASE WHEN query_id LIKE 'fr%' AND source = 'b' THEN 'error' WHEN query_id LIKE 'de%' AND source = 'a' THEN 'skipped' ELSE 'ok' END AS outcome
FROM (SELECT query_id, 'a' AS source FROM (SELECT DISTINCT topic AS query_id FROM {pg}) l
      UNION ALL SELECT query_id, 'b' FROM (SELECT DISTINCT topic AS query_id FROM {pg}) l
      UNION ALL SELECT query_id, 'unlisted' FROM (SELECT DISTINCT topic AS query_id FROM {pg}) l) s""",
    "captures": """
SELECT page_id, url, 'static' AS tier, CASE WHEN page_id % 11 = 0 THEN 403 ELSE 200 END AS status,
       CASE WHEN page_id % 13 = 0 THEN 'Application/PDF' ELSE 'text/html; charset=utf-8' END AS content_type,
       CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 5 = 0 THEN '<html><body><div>app</div></body></html>' ELSE html END AS html,
       CAST(NULL AS STRING) AS error, 1704067200000000 + page_id AS captured_at
FROM {pg}
UNION ALL
SELECT page_id, url, 'static', 404, 'text/html', '<html><body>gone</body></html>', 'http 404', 1704067200000000 + 2 * page_id + 7
FROM {pg} WHERE page_id % 3 = 0
UNION ALL
SELECT page_id, url, 'static', 200, 'text/html', concat(html, '<p>', title, '</p>'), CAST(NULL AS STRING), 1704067200000000 + 2 * page_id + 9
FROM {pg} WHERE page_id % 4 = 1
UNION ALL
SELECT page_id, url, 'browser', CASE WHEN page_id % 22 = 0 THEN 403 ELSE 200 END, 'text/html',
       CASE WHEN page_id % 22 = 0 THEN '' ELSE html END, CASE WHEN page_id % 22 = 0 THEN 'blocked' ELSE NULL END, CAST(NULL AS BIGINT)
FROM {pg} WHERE page_id % 5 = 0 OR page_id % 11 = 0""",
    "memo": """
SELECT url, 'markdown' AS fmt, 20000 AS max_len, 1705276800000000 - page_id * 600000000 AS ts_us,
       CASE WHEN page_id % 11 = 0 THEN 403 ELSE 200 END AS status, concat(title, html) AS content, title,
       CAST(least(20000, length(concat(title, html))) AS BIGINT) AS content_length,
       CASE WHEN page_id % 4 = 0 THEN 'browser' ELSE 'static' END AS method,
       CASE WHEN page_id % 11 = 0 THEN 'http 403' ELSE NULL END AS error
FROM {pg}""",
    "attempts": """
SELECT event_id, concat('u', CAST(user_id AS STRING)) AS source, ts, event_type <> 'error' AS ok FROM {events}""",
    "request_log": """
SELECT event_id, concat(CAST(user_id AS STRING), '|', event_type) AS req_key, ts FROM {events}""",
    "serp_big": """
SELECT concat('q', CAST(l_partkey AS STRING)) AS query_id, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS source,
       CAST(row_number() OVER (PARTITION BY l_partkey, l_suppkey % 2 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS raw_rank,
       concat('https://S', CAST(l_suppkey % 3 AS STRING), '.example.com/item/', CAST(l_orderkey % 7 AS STRING),
              CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '?utm_source=x' ELSE '#f' END) AS href
FROM {lineitem}""",
    # ---- views of our own, same style ------------------------------------
    # Per-query search parameters for the raw_a / raw_b queries.
    "search_requests": """
SELECT query_id,
       CASE substring(query_id, 1, 2) WHEN 'en' THEN 25 WHEN 'fr' THEN 6 WHEN 'de' THEN 200 ELSE 30 END AS num_results,
       CASE substring(query_id, 1, 2) WHEN 'en' THEN 'w' WHEN 'de' THEN 'd' WHEN 'es' THEN 'm' ELSE '' END AS time_range
FROM (SELECT DISTINCT topic AS query_id FROM {pg}) q""",
    # The search queries as raw research requests (numbers as text; one length invalid, one absent).
    "research_requests": """
SELECT query_id, concat(' ', query_id, ' ') AS query, CAST(num_results AS STRING) AS num_results,
       CASE substring(query_id, 1, 2) WHEN 'en' THEN '600' WHEN 'de' THEN '100' WHEN 'es' THEN 'x' ELSE NULL END AS max_content_length,
       time_range
FROM {search_requests}""",
    # A scrape request for every page, some for a URL that has no capture or none at all.
    "scrape_asks": """
SELECT page_id AS request_id, CASE WHEN page_id % 31 = 0 THEN '  ' WHEN page_id % 29 = 0 THEN concat(url, '&none') ELSE url END AS url,
       CASE page_id % 3 WHEN 0 THEN ' Text' WHEN 1 THEN 'markdown' ELSE NULL END AS format,
       CASE page_id % 5 WHEN 0 THEN '700' WHEN 1 THEN '100' WHEN 2 THEN 'x' WHEN 3 THEN NULL ELSE '1000000' END AS max_content_length,
       CASE page_id % 4 WHEN 0 THEN 'Always ' WHEN 1 THEN 'auto' ELSE NULL END AS js_render
FROM {pg}""",
    # Raw tool requests, numbers as the text that arrived.
    "requests": """
SELECT CAST(event_id AS STRING) AS query_id,
       CASE WHEN event_id % 13 = 0 THEN '   ' WHEN event_id % 17 = 0 THEN NULL
            ELSE concat(' ', event_type, ' ', CAST(user_id AS STRING), ' ') END AS query,
       CASE event_id % 11 WHEN 0 THEN 'abc' WHEN 1 THEN NULL WHEN 2 THEN '0' WHEN 3 THEN '-5' WHEN 4 THEN '3.9'
            WHEN 5 THEN '201' WHEN 6 THEN '1000000' WHEN 7 THEN ' 42 ' ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS num_results,
       CASE event_id % 7 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN '100'
            ELSE CAST(CAST(floor(value * 1000) AS BIGINT) AS STRING) END AS max_content_length,
       CASE event_id % 8 WHEN 0 THEN ' D ' WHEN 1 THEN 'w' WHEN 2 THEN 'm' WHEN 3 THEN 'y' WHEN 4 THEN 'x'
            WHEN 5 THEN NULL ELSE '' END AS time_range
FROM {events}""",
    # PDF page texts: each document's lines stand in for its pages.
    "pdf_pages": {
        "spark": """
SELECT doc_id, CAST(pos + 1 AS INT) AS page_no, col AS text
FROM (SELECT doc_id, posexplode(split(text, chr(10))) FROM {documents}) t""",
        "duckdb": """
SELECT doc_id, CAST(generate_subscripts(l, 1) AS INT) AS page_no, unnest(l) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {documents}) t""",
    },
    # Extracted PDF pages of the captures served with a PDF content type.
    "pdf_capture_pages": """
SELECT p.url, d.page_no, d.text
FROM {pdf_pages} d JOIN {pg} p ON p.page_id = d.doc_id
WHERE p.page_id % 13 = 0 AND p.page_id % 2 = 0""",
    # Outcome of each source call for every serp_big query (about 1 in 8 calls fails or is skipped).
    "serp_outcomes": """
SELECT query_id, source,
       CASE substr(md5(concat(query_id, source)), 1, 1) WHEN '0' THEN 'error' WHEN '1' THEN 'skipped' ELSE 'ok' END AS outcome
FROM (SELECT query_id, 'a' AS source FROM (SELECT DISTINCT concat('q', CAST(l_partkey AS STRING)) AS query_id FROM {lineitem}) q
      UNION ALL SELECT query_id, 'b' FROM (SELECT DISTINCT concat('q', CAST(l_partkey AS STRING)) AS query_id FROM {lineitem}) q
      UNION ALL SELECT query_id, 'unlisted' FROM (SELECT DISTINCT concat('q', CAST(l_partkey AS STRING)) AS query_id FROM {lineitem}) q) s""",
    # Attempt log per URL for the retry frontier.
    "fetch_attempts": """
SELECT event_id, concat('https://h', CAST(user_id % 7 AS STRING), '.example.com/p/', CAST(user_id AS STRING)) AS url,
       ts, event_type <> 'error' AS ok,
       CASE WHEN event_type = 'error' THEN concat('http ', CAST(500 + user_id % 4 AS STRING)) ELSE NULL END AS error
FROM {events}""",
}

_REF = re.compile(r"\{(\w+)\}")


def view_sql(name: str, dialect: str) -> str:
    v = VIEWS[name]
    return v[dialect] if isinstance(v, dict) else v


@lru_cache(maxsize=None)
def deps(name: str) -> tuple[str, ...]:
    texts = VIEWS[name].values() if isinstance(VIEWS[name], dict) else [VIEWS[name]]
    out: list[str] = []
    for t in texts:
        for d in _REF.findall(t):
            if d not in out:
                out.append(d)
    return tuple(out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, _memo: dict | None = None) -> DataFrame:
    """Build fixture view ``name`` over the tables in ``sf_dir`` as a DataFrame."""
    memo = {} if _memo is None else _memo
    if name in memo:
        return memo[name]
    if name in BASE_TABLES:
        df = table(spark, sf_dir, name)
    else:
        args = {d: view(spark, sf_dir, d, memo) for d in deps(name)}
        df = spark.sql(view_sql(name, "spark"), **args)
    memo[name] = df
    return df


def _order(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in BASE_TABLES or n in seen:
            return
        for d in deps(n):
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def duckdb_with(*names: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """``WITH a AS (...), b AS (...)`` for the named views, their inputs, then ``ctes``."""
    parts = []
    for n in _order(list(names)):
        body = _REF.sub(lambda m: m.group(1), view_sql(n, "duckdb")).strip()
        parts.append(f"{n} AS (\n{body}\n)")
    for n, body in ctes or []:
        parts.append(f"{n} AS (\n{body.strip()}\n)")
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""
