"""What the registered queries share: tables, feeds, and SQL for the engine they are compared with."""

from __future__ import annotations

from vacantia.sources import feed

#: Leading tables of a comparison query over the observation feed, with fingerprints.
OBS = f"obs0 AS ({feed.OBSERVATIONS}), obs AS (SELECT *, CASE WHEN trim(coalesce(source_job_id, '')) <> '' THEN source_code || ':' || source_job_id ELSE source_code || ':URL:' || sha256(source_code || '|' || detail_url || '|' || title || '|' || company_name) END AS fingerprint FROM obs0)"
PERIODS = f"periods AS ({feed.PERIODS})"
CV = f"cv AS ({feed.CV_TEXT})"

SEEN = """seen AS (SELECT fingerprint, arg_max(title, (collected_at, l_orderkey, l_linenumber)) AS title, arg_max(company_name, (collected_at, l_orderkey, l_linenumber)) AS company_name,
  arg_max(salary_text, (collected_at, l_orderkey, l_linenumber)) FILTER (WHERE true) AS salary_any, min(collected_at) AS first_seen_at, max(collected_at) AS last_seen_at, count(*) AS sightings FROM obs GROUP BY fingerprint)"""


def fold(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(strip_accents(lower({x})), 'đ', 'd'), 'ø', 'o'), '\\s+', ' ', 'g'))"


def compact(x: str) -> str:
    return f"regexp_replace({fold(x)}, '[^a-z0-9+#]+', '', 'g')"
