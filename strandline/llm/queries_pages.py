"""Queries over pages."""

from __future__ import annotations

from strandline.llm.html_text import extract
from strandline.llm.url_filter import ALPHABET, SIZE, judge
from strandline.llm.warc import round_trip
from strandline.session import table


def op7_html_density(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op9_warc_zstd(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_url_markov(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_URL_SQL = f"""
    WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0 FROM r),
    u AS (
        SELECT row_number() OVER () AS rn, page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path
        FROM h
    ),
    v AS (
        SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
        FROM u
    ),
    t AS (
        SELECT *, substr(md5(host || path), 1, 1) IN ('0', '1', '2') AS left_out, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block' END AS says,
               '^^' || regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[^a-z0/._-]', '~', 'g') AS s
        FROM v
    ),
    g AS (
        SELECT rn, says, left_out, strpos('{ALPHABET}', s[i]) - 1 AS a, strpos('{ALPHABET}', s[i + 1]) - 1 AS b, strpos('{ALPHABET}', s[i + 2]) - 1 AS c
        FROM (SELECT rn, says, left_out, s, unnest(range(1, length(s) - 1)) AS i FROM t)
    ),
    seen AS (SELECT says AS verdict, a, b, c, count(*) AS n3 FROM g WHERE says IS NOT NULL AND NOT left_out GROUP BY ALL),
    two AS (SELECT verdict, b, c, sum(n3) AS n2 FROM seen GROUP BY ALL), one AS (SELECT verdict, c, sum(n3) AS n1 FROM seen GROUP BY ALL),
    after3 AS (SELECT verdict, a, b, sum(n3) AS t3, count(*) AS u3 FROM seen GROUP BY ALL),
    after2 AS (SELECT verdict, b, sum(n2) AS t2, count(*) AS u2 FROM two GROUP BY ALL), after1 AS (SELECT verdict, sum(n1) AS t1 FROM one GROUP BY ALL),
    grid AS (
        SELECT k.verdict, x.a, x.b, x.c, (coalesce(n1, 0) + 1) / (coalesce(t1, 0) + {SIZE})::DOUBLE AS p1, coalesce(n2, 0) AS n2, coalesce(t2, 0) AS t2, coalesce(u2, 0) AS u2,
               coalesce(n3, 0) AS n3, coalesce(t3, 0) AS t3, coalesce(u3, 0) AS u3
        FROM (SELECT DISTINCT a, b, c FROM g) x CROSS JOIN (SELECT unnest(['allow', 'block']) AS verdict) k
        LEFT JOIN seen ON seen.verdict = k.verdict AND seen.a = x.a AND seen.b = x.b AND seen.c = x.c LEFT JOIN two ON two.verdict = k.verdict AND two.b = x.b AND two.c = x.c
        LEFT JOIN one ON one.verdict = k.verdict AND one.c = x.c LEFT JOIN after3 ON after3.verdict = k.verdict AND after3.a = x.a AND after3.b = x.b
        LEFT JOIN after2 ON after2.verdict = k.verdict AND after2.b = x.b LEFT JOIN after1 ON after1.verdict = k.verdict
    ),
    est2 AS (SELECT *, CASE WHEN t2 > 0 THEN (n2 + u2 * p1) / (t2 + u2) ELSE p1 END AS p2 FROM grid),
    est3 AS (SELECT a, b, c, sum(CASE WHEN verdict = 'allow' THEN 1 ELSE -1 END * ln(CASE WHEN t3 > 0 THEN (n3 + u3 * p2) / (t3 + u3) ELSE p2 END)) AS llr FROM est2 GROUP BY ALL),
    score AS (SELECT rn, avg(llr) AS score FROM g JOIN est3 USING (a, b, c) GROUP BY rn),
    binned AS (SELECT says, greatest(-500, least(500, floor(score / 0.02)))::INT AS bin, count(*) AS n FROM score JOIN t USING (rn) WHERE says IS NOT NULL AND left_out GROUP BY ALL),
    total AS (SELECT sum(n) FILTER (says = 'allow') AS allows, sum(n) FILTER (says = 'block') AS blocks FROM binned),
    wrong AS (
        SELECT border, round(coalesce(sum(n) FILTER (says = 'allow' AND bin < border), 0) / any_value(allows) + coalesce(sum(n) FILTER (says = 'block' AND bin >= border), 0) / any_value(blocks), 9) AS lost
        FROM binned, total, (SELECT unnest(range(-500, 502)) AS border) GROUP BY border
    ),
    best AS (SELECT border, row_number() OVER (ORDER BY border) - 1 AS k, count(*) OVER () AS n FROM wrong WHERE lost = (SELECT min(lost) FROM wrong)),
    threshold AS (SELECT coalesce((SELECT border FROM best WHERE k = (n - 1) // 2), 0) * 0.02 AS threshold)
    SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict
    FROM t LEFT JOIN score USING (rn) CROSS JOIN threshold
"""

QUERIES = {"op6_url_markov": op6_url_markov, "op7_html_density": op7_html_density, "op9_warc_zstd": op9_warc_zstd}
ORACLES = {
    "op6_url_markov": _URL_SQL,
    "op9_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT *, strlen(html) AS size, max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, size::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN size >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN size >= 1000 AND page_id < last THEN last END AS refers_to
        FROM k
    """,
}
