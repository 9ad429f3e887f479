"""The SQL each query is checked with, over the same tables."""

from __future__ import annotations

from ..config import CURRENCY_BY_COUNTRY, DEFAULT
from ..functions.text import KEYWORD, STOP_WORDS
from ..functions.titles import SENIOR_WORD
from ..functions.urls import TRACKING_KEYS
from ..functions.years import NOISE_NEARBY, YEAR_PATTERNS
from ..operators.counts import DEGREES
from ..sources.fixtures import postings_sql
from .queries import FIRST_DAY, GRID, LEDGER_BATCHES, OVERLAY, SHARED_TURNS, SIGNED, SITES

# A stream's batches have its own numbers.
SHARED_NAMES = [(who, SHARED_TURNS[:i].count(who)) for i, who in enumerate(SHARED_TURNS)]
P = f"p AS ({postings_sql()})"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _any(patterns) -> str:
    return "'" + "|".join(f"(?:{p})" for p in patterns) + "'"


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


def _canonical(u: str) -> str:
    key = "split_part(q, '=', 1)"
    kept = (
        f"list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: q <> '' "
        f"AND {key} NOT IN ({_quoted(TRACKING_KEYS)}) AND NOT starts_with(lower({key}), 'utm_'))"
    )
    query = f"array_to_string(list_transform({kept}, lambda q: CASE WHEN contains(q, '=') THEN q ELSE concat(q, '=') END), '&')"
    path = f"rtrim(regexp_extract({u}, '^(?:[A-Za-z]+://[^/?#]*)?([^?#]*)', 1), '/')"
    return (
        f"CASE WHEN {u} IS NULL THEN '' ELSE concat(lower(regexp_extract({u}, '^([A-Za-z]+://[^/?#]*)', 1)), "
        f"CASE WHEN {path} = '' THEN '/' ELSE {path} END, "
        f"CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END) END"
    )


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _matches(c: str, patterns) -> str:
    return f"coalesce(regexp_matches({c}, {_any(patterns)}, 'i'), false)"


FINGERPRINT = f"concat({_norm('company')}, '|', {_norm('title')}, '|', {_norm('location')})"
WANTED = f"({_matches('title', DEFAULT.title_include_patterns)} AND NOT {_matches('title', DEFAULT.title_exclude_patterns)})"
SENIOR = _matches("title", DEFAULT.senior_title_patterns)
SENIOR_EITHER = f"({SENIOR} OR {_matches('title', [SENIOR_WORD])})"
LISTED = _matches("company", [_escaped(c) for c in DEFAULT.fortune_500_companies])
LISTED_WORD = _matches("company", [rf"\b(?:{'|'.join(_escaped(c) for c in DEFAULT.fortune_500_companies)})\b"])
HTTP = r"(regexp_matches(url, '^https?://[^/?#\s]+'))"
HAS_TITLE = "(title IS NOT NULL AND trim(title) <> '')"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _decided(name: str, src: str, seen: str | None, kept: str = "") -> str:
    """CTEs: winners of both dedupe steps of ``src`` with their stage; ``kept`` may be MATERIALIZED."""
    is_seen = f"url IN (SELECT job_url FROM {seen})" if seen else "false"
    return f"""
{name}_k AS (SELECT *, {_canonical('job_url')} AS url, {FINGERPRINT} AS fp FROM {src}),
{name}_u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn,
             count(*) OVER (PARTITION BY url) AS copies FROM {name}_k) t WHERE rn = 1),
{name}_g AS (SELECT *, CASE WHEN coalesce(lower(company) <> 'unknown', true) AND length(fp) > 2 THEN fp
             ELSE concat('#', CAST(seq AS VARCHAR)) END AS grp FROM {name}_u),
{name}_w AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY grp ORDER BY seq) AS rn2 FROM {name}_g) t WHERE rn2 = 1),
{name} AS {kept} (SELECT *, CASE WHEN {is_seen} THEN 'seen' WHEN NOT {HAS_TITLE} OR NOT {HTTP} THEN 'invalid'
           WHEN NOT {WANTED} THEN 'unwanted title' ELSE 'kept' END AS stage FROM {name}_w)"""


def _fixed(url: str, listed: str) -> str:
    """The fixed columns of a validated row."""
    return f"""{url} AS job_url, trim(title) AS title, coalesce(nullif(trim(company), ''), 'Unknown') AS company,
  coalesce(nullif(trim(location), ''), 'Unknown') AS location, date_posted, coalesce(nullif(trim(description), ''), '') AS description,
  site, source_query, source_location, coalesce(is_remote, false) AS is_remote, job_type, {listed} AS is_fortune_500,
  CAST(NULL AS INTEGER) AS est_min_years, CAST(NULL AS INTEGER) AS est_max_years"""


VALID = f"""
urls AS (SELECT *, {_canonical('job_url')} AS url FROM p),
valid AS (SELECT seq, {_fixed('url', 'false')} FROM urls WHERE url <> '' AND {HAS_TITLE} AND {HTTP})"""

LATER = "later AS (SELECT * FROM p WHERE batch_id > 0)"
LEDGER0 = "b0 AS (SELECT * FROM p WHERE batch_id = 0), " + _decided("d0", "b0", None) + ", seen AS (SELECT url AS job_url FROM d0 WHERE stage = 'kept')"
LATER_URL = f"lu AS (SELECT seq, {_canonical('job_url')} AS job_url FROM later)"
INGESTED = _decided("d", "later", "seen")
ALL_INGESTED = _decided("d", "p", None)


def _years(src: str, text: str) -> str:
    """CTEs ending in years(seq, lo, hi): mark the matches, split there, rank what stays."""
    marked = []
    for i, pattern in enumerate(YEAR_PATTERNS):
        second = "\\2" if pattern.count(r"(\d{1,2})") == 2 else ""
        marked.append(
            f"SELECT seq, {i} AS pat, s, string_split(regexp_replace(s, '{pattern}', concat(chr(1), '\\1', chr(2), '{second}', "
            f"chr(2), '\\0', chr(1)), 'gi'), chr(1)) AS parts FROM y_src"
        )
    return f"""
y_src AS (SELECT seq, {text} AS s FROM {src} WHERE regexp_matches({text}, '\\d\\s*\\+?\\s*(?:year|yr)', 'i')),
y_marked AS ({' UNION ALL '.join(marked)}),
y_parts AS (SELECT seq, pat, s, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM y_marked WHERE len(parts) > 1),
y_text AS (SELECT seq, pat, s, i, part, i % 2 = 0 AS hit, CASE WHEN i % 2 = 0 THEN split_part(part, chr(2), 3) ELSE part END AS t FROM y_parts),
y_pos AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY seq, pat ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM y_text),
y_num AS (SELECT seq, pat, pos, s, t, TRY_CAST(split_part(part, chr(2), 1) AS INTEGER) AS a, TRY_CAST(nullif(split_part(part, chr(2), 2), '') AS INTEGER) AS b FROM y_pos WHERE hit),
y_cand AS (SELECT seq, pat, pos, coalesce(least(a, b), a) AS lo, CASE WHEN b IS NOT NULL THEN greatest(a, b) END AS hi FROM y_num
  WHERE NOT regexp_matches(substr(s, CAST(greatest(pos - 40, 0) + 1 AS BIGINT), CAST(least(pos, 40) + length(t) + 40 AS BIGINT)), '{NOISE_NEARBY}', 'i')),
years AS (SELECT seq, lo, CASE WHEN hi <= 20 THEN hi END AS hi FROM (
  SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pat, lo, pos) AS rn FROM y_cand WHERE lo BETWEEN 0 AND 20) t WHERE rn = 1)"""


def _skill_rows(name: str, src: str, text: str, skills) -> str:
    """CTE name(seq, skill, place): skills a text mentions."""
    values = ", ".join(f"({i}, '{s}', '\\b{_escaped(s)}\\b')" for i, s in enumerate(skills))
    return (
        f"{name} AS (SELECT x.seq, v.skill, v.place FROM {src} x JOIN (VALUES {values}) v(place, skill, rx) "
        f"ON regexp_matches(lower({text}), v.rx))"
    )


def _counted(name: str, of: str, skills) -> str:
    return f"{name} AS (SELECT seq, count(*) AS n FROM {of} WHERE skill IN ({_quoted(skills)}) GROUP BY seq)"


def _enriched(src: str, listed: str = "is_fortune_500", profile=(DEFAULT.my_skills, 2, 4)) -> str:
    """CTEs ending in enriched: ``src`` with the analysis columns."""
    skills, lo, hi = profile
    all_skills = tuple(dict.fromkeys((*DEFAULT.key_skills, *DEFAULT.my_skills, *DEFAULT.nice_skills, *skills)))
    return f"""
e_src AS (SELECT * REPLACE (coalesce(title, '') AS title, coalesce(description, '') AS description), {listed} AS e_listed FROM {src}),
{_years('e_src', 'description')},
{_skill_rows('e_desc', 'e_src', 'description', DEFAULT.key_skills)},
{_skill_rows('e_text', 'e_src', "concat(title, ' ', description)", all_skills)},
{_counted('e_key', 'e_desc', DEFAULT.key_skills)}, {_counted('e_must', 'e_text', DEFAULT.must_skills)},
{_counted('e_nice', 'e_text', DEFAULT.nice_skills)}, {_counted('e_prof', 'e_text', skills)},
{_skill_rows('e_mine', 'e_src', "concat(title, ' ', description)", DEFAULT.my_skills)},
e_list AS (SELECT seq, string_agg(skill, ', ' ORDER BY place) AS matched_skills FROM e_mine GROUP BY seq),
e_base AS (SELECT x.*, CAST(y.lo AS INTEGER) AS lo, CAST(y.hi AS INTEGER) AS hi, coalesce(k.n, 0) AS n_key, coalesce(m.n, 0) AS n_must,
  coalesce(c.n, 0) AS n_nice, coalesce(f.n, 0) AS n_prof, coalesce(l.matched_skills, '') AS matched_skills, lower(title) AS tl
  FROM e_src x LEFT JOIN years y USING (seq) LEFT JOIN e_key k USING (seq) LEFT JOIN e_must m USING (seq)
  LEFT JOIN e_nice c USING (seq) LEFT JOIN e_prof f USING (seq) LEFT JOIN e_list l USING (seq)),
e_mid AS (SELECT *, CAST(CASE WHEN contains(tl, 'data engineer') THEN 3 ELSE 0 END + CASE WHEN contains(tl, 'analytics engineer') THEN 3 ELSE 0 END
  + CASE WHEN contains(tl, 'etl') THEN 2 ELSE 0 END + CASE WHEN contains(tl, 'software engineer') THEN 1 ELSE 0 END
  + CASE WHEN n_key >= 3 THEN 2 ELSE 0 END + CASE WHEN n_key >= 7 THEN 2 ELSE 0 END
  - CASE WHEN {_matches('title', [SENIOR_WORD])} THEN 5 ELSE 0 END - CASE WHEN contains(tl, 'principal') THEN 5 ELSE 0 END
  - CASE WHEN contains(tl, 'director') THEN 5 ELSE 0 END
  - CASE WHEN lo >= 8 THEN 4 ELSE 0 END + CASE WHEN lo BETWEEN 2 AND 4 THEN 2 ELSE 0 END AS DOUBLE) AS mid_level_score,
  CASE WHEN lo IS NULL AND hi IS NULL THEN true ELSE coalesce(lo <= {hi}, true) AND coalesce(hi >= {lo}, true) END AS in_experience_band FROM e_base),
e_flag AS (SELECT *, NOT {SENIOR} AND coalesce(lo <= 5, true) AND mid_level_score >= 1 AS is_mid_level FROM e_mid),
enriched AS (SELECT *, CAST(5 * n_must - 3 * ({len(DEFAULT.must_skills)} - n_must) + 2 * n_nice
  + CASE WHEN contains(tl, 'data engineer') THEN 3 ELSE 0 END + CASE WHEN contains(tl, 'analytics engineer') THEN 2 ELSE 0 END
  - CASE WHEN {SENIOR_EITHER} THEN 8 ELSE 0 END
  + CASE WHEN lo IS NULL THEN 1 WHEN lo BETWEEN 2 AND 4 THEN 6 WHEN lo > 4 THEN -6 ELSE 0 END
  - CASE WHEN hi < 2 THEN 3 ELSE 0 END + CASE WHEN e_listed THEN 1 ELSE 0 END + CASE WHEN is_mid_level THEN 2 ELSE 0 END AS DOUBLE) AS match_score,
  n_prof > 0 AND NOT {SENIOR_EITHER} AND in_experience_band AS is_profile_match FROM e_flag)"""


VALID_WANTED = f"chosen AS (SELECT * FROM valid WHERE {WANTED})"
ANALYSED_CTES = (P, VALID, VALID_WANTED, _enriched("chosen"))
BEST_PLACE = "CAST(row_number() OVER (ORDER BY match_score DESC, in_experience_band DESC, is_mid_level DESC, is_fortune_500 DESC, job_url) AS INTEGER) AS rank"
ANALYSED_COLUMNS = "seq, job_url, title, match_score, is_mid_level, is_profile_match, in_experience_band"
REPORTED = (
    "concat_ws(' ', lower(title), lower(company), lower(location), lower(coalesce(site, '')), lower(coalesce(source_location, '')), "
    "lower(coalesce(source_query, '')), matched_skills)"
)
CRITERIA = f"contains({REPORTED}, 'engineer') AND is_mid_level AND (lo IS NULL OR lo <= 4) AND round(match_score, 1) >= 8.0"
ENRICHED_OUT = """seq, batch_id, job_url, title, company, location, date_posted, description, site, source_query, source_location, is_remote,
  job_type, is_fortune_500, lo AS est_min_years, hi AS est_max_years, mid_level_score, is_mid_level, matched_skills, match_score,
  is_profile_match, in_experience_band"""


def _kept_rows(columns: str) -> str:
    return f"SELECT {columns}, {_fixed('url', LISTED)} FROM d WHERE stage = 'kept'"


def _top(section: str, source: str, key: str, k: int) -> str:
    return (
        f"SELECT '{section}' AS section, CAST(rank AS INTEGER) AS rank, key, CAST(n AS DOUBLE) AS value FROM (SELECT key, n, "
        f"row_number() OVER (ORDER BY n DESC, key) AS rank FROM (SELECT {key} AS key, count(*) AS n FROM {source} GROUP BY 1) g WHERE key IS NOT NULL) r WHERE rank <= {k}"
    )


def _summary(src: str, skills: str, running: str, running_k: int = 30) -> str:
    total = [
        ("total_jobs", "count(*)"), ("mid_level_jobs", "count(*) FILTER (is_mid_level)"),
        ("profile_match_jobs", "count(*) FILTER (is_profile_match)"),
        ("in_band_jobs", "count(*) FILTER (in_experience_band)"), ("avg_est_min_years", "avg(lo)"),
        ("avg_est_max_years", "avg(hi)"), ("experience_band_min", "coalesce(max(2), 2)"), ("experience_band_max", "coalesce(max(4), 4)"),
    ]
    parts = [f"SELECT 'totals' AS section, {i + 1} AS rank, '{k}' AS key, round(CAST({e} AS DOUBLE), 4) AS value FROM {src}" for i, (k, e) in enumerate(total)]
    parts.append(_top("top_skills", skills, "skill", 30))
    parts.append(_top("persistent_total_recurrence", running, "skill", running_k))
    degrees = " UNION ALL ".join(
        f"SELECT '{d}' AS degree FROM {src} WHERE regexp_matches(lower(concat(title, ' ', description)), '{rx}')" for d, rx in DEGREES.items()
    )
    parts.append(_top("degree_counts", f"({degrees}) dg", "degree", 3))
    parts.append(_top("jobs_by_site", src, "coalesce(site, 'unknown')", 12))
    parts.append(_top("jobs_by_location", src, "coalesce(source_location, 'unknown')", 12))
    parts.append(_top("top_titles", src, "title", 12))
    parts.append(_top("top_companies", src, "company", 12))
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") s WHERE value IS NOT NULL"


KEY_TEXT = _skill_rows("ks", "p", "concat(coalesce(title, ''), ' ', description)", DEFAULT.key_skills)
VALID_SKILLS = _skill_rows("es", "enriched", "concat(title, ' ', description)", DEFAULT.key_skills)


def _keywords(src: str, text: str) -> str:
    return (
        f"kw AS (SELECT w AS keyword FROM (SELECT unnest(regexp_extract_all(lower(coalesce({text}, '')), '{KEYWORD}')) AS w FROM {src}) t "
        f"WHERE w NOT IN ({_quoted(STOP_WORDS)}))"
    )


def _trend(src: str, words: str, listed: str) -> str:
    return f"""
SELECT 'totals' AS section, CAST(0 AS INTEGER) AS rank, key, n FROM (
  SELECT unnest(['total', 'listed', 'other', 'united_states', 'india']) AS key,
         unnest([count(*), count(*) FILTER ({listed}), count(*) FILTER (NOT {listed}),
                 count(*) FILTER (source_location = 'United States'), count(*) FILTER (source_location = 'India')]) AS n FROM {src}) t
UNION ALL SELECT 'job_types', 0, coalesce(job_type, 'unknown'), count(*) FROM {src} GROUP BY 3
UNION ALL SELECT section, rank, key, CAST(value AS BIGINT) FROM ({_top('top_titles', src, 'title', 8)}) a
UNION ALL SELECT section, rank, key, CAST(value AS BIGINT) FROM ({_top('top_companies', src, 'company', 8)}) b
UNION ALL SELECT section, rank, key, CAST(value AS BIGINT) FROM ({_top('keywords', words, 'keyword', 12)}) c"""


def _batches(n: int = 3, which: str = "batch_id", named: list[tuple[str, int]] | None = None) -> str:
    """CTEs ending in stored: n batches, each against the URLs kept before it; ``named`` gives (source, batch_id) of each."""
    ctes, seen = [], None
    for b in range(n):
        ctes.append(f"r{b} AS (SELECT * FROM p WHERE {which} = {b})")
        ctes.append(_decided(f"t{b}", f"r{b}", seen, "MATERIALIZED"))
        before = f"SELECT job_url FROM {seen} UNION " if seen else ""
        ctes.append(f"s{b} AS MATERIALIZED ({before}SELECT url AS job_url FROM t{b} WHERE stage = 'kept')")
        seen = f"s{b}"
    own = [f"'{named[b][0]}' AS source, CAST({named[b][1]} AS BIGINT) AS batch_id" if named else "batch_id" for b in range(n)]
    union = " UNION ALL ".join(f"SELECT seq, {own[b]}, {_fixed('url', LISTED)} FROM t{b} WHERE stage = 'kept'" for b in range(n))
    ctes.append(f"stored AS MATERIALIZED ({union})")
    return ", ".join(ctes)


def _html_escaped(c: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{char}', '{entity}')"
    return c


COUNTRY = (
    "CASE WHEN contains(l, 'india') THEN 'in' WHEN contains(l, 'bangladesh') THEN 'bd' "
    "WHEN contains(l, 'united kingdom') OR contains(l, 'uk') THEN 'gb' ELSE 'us' END"
)


def _currency(country: str) -> str:
    return f"CASE {country} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CURRENCY_BY_COUNTRY.items()) + " ELSE 'USD' END"


GRID_CTES = (
    f"loc AS (SELECT unnest([{_quoted(GRID.locations)}]) AS source_location), "
    f"term AS (SELECT unnest([{_quoted(GRID.search_terms)}]) AS source_query), "
    f"cells AS (SELECT source_location, source_query, source_location IN ({_quoted(GRID.remote_locations)}) AS remote_only FROM loc, term)"
)


def _shown(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 'Yes' ELSE 'No' END"


DISPLAY = {
    "Match": "printf('%.1f', match_score)", "Title": "title", "Company": "company", "Location": "location",
    "Search location": "coalesce(source_location, '')", "Site": "coalesce(site, '')",
    "Min years": "coalesce(CAST(lo AS VARCHAR), '—')", "Mid-level": _shown("is_mid_level"), "Band": _shown("in_experience_band"),
    "Your skills": "matched_skills", "Fortune 500": _shown("is_fortune_500"), "Remote": _shown("is_remote"),
    "Profile match": _shown("is_profile_match"), "Search term": "coalesce(source_query, '')",
}


def _display(snake: bool, title: str | None = None) -> str:
    def name(k: str) -> str:
        return k.lower().replace(" ", "_").replace("-", "_") if snake else k

    return ", ".join(f'{title if title and k == "Title" else v} AS "{name(k)}"' for k, v in DISPLAY.items())


def _html_row() -> str:
    parts = [f"'<tr data-search=\"', {_html_escaped(REPORTED)}, '\">'"]
    for header, value in DISPLAY.items():
        if header == "Title":
            parts.append(
                f"'<td><a href=\"', {_html_escaped('job_url')}, '\" target=\"_blank\" rel=\"noopener noreferrer\">', {_html_escaped(value)}, '</a></td>'"
            )
        else:
            parts.append(f"'<td>', {_html_escaped(value)}, '</td>'")
    return f"concat({', '.join(parts)}, '</tr>')"


def _html_text(c: str) -> str:
    out = rf"regexp_replace({c}, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return rf"trim(regexp_replace({out}, '[ \t\r\n]+', ' ', 'g'))"


BLOCK = (
    "concat('JOB #', seq, chr(10), 'TITLE: ', title, chr(10), 'COMPANY: ', company, chr(10), 'LOCATION: ', location, chr(10), "
    "'SITE: ', coalesce(site, 'None'), chr(10), 'URL: ', job_url, chr(10), repeat('-', 40), chr(10), 'DESCRIPTION:', chr(10), "
    "description, chr(10), repeat('=', 80), chr(10))"
)
NOTE = (
    "CASE seq % 4 WHEN 0 THEN 'say \"hi\", now' WHEN 1 THEN concat('two', chr(10), 'lines') "
    "WHEN 2 THEN 'back\\slash \\\" end' ELSE ' padded ' END"
)


def _facet_counts() -> str:
    """Counts by facet value; a facet's own filter does not count for it."""
    choices = (
        {}, {"site": "site IN ('linkedin', 'indeed')", "is_remote": "is_remote = 'true'"},
        {"job_type": "job_type = 'contract'", "source_location": "source_location = 'India'", "site": "site = 'remotive'"},
    )
    return " UNION ALL ".join(
        f"SELECT {i} AS choice, '{f}' AS facet, {f} AS value, count(*) FILTER ({' AND '.join(c for n, c in chosen.items() if n != f) or 'true'}) AS n "
        f"FROM v WHERE {f} IS NOT NULL GROUP BY {f}"
        for i, chosen in enumerate(choices) for f in ("site", "source_location", "job_type", "is_remote"))


def oracle_sql() -> dict[str, str]:
    p = _with(P)
    analysed = _with(*ANALYSED_CTES)
    later = (P, LATER, LEDGER0)
    return {
        "canonical_urls": p + f"SELECT 'pages' AS source, page_id AS id, {_canonical('url')} AS url FROM pages UNION ALL "
                              f"SELECT 'postings', seq, {_canonical('job_url')} FROM p",
        "fingerprints": p + f"SELECT seq, {FINGERPRINT} AS fingerprint FROM p",
        "coerced_values": p + "SELECT seq, seq % 7 IN (0, 2, 4) AS flag, CASE WHEN seq % 7 = 1 THEN 'padded' WHEN seq % 7 BETWEEN 3 AND 5 THEN title END AS label FROM p",
        "dedupe_by_url": _with(P, _decided("d", "p", None)) + "SELECT seq, url AS job_url FROM d_u",
        "dedupe_by_raw_url": p + "SELECT min(seq) AS seq, job_url FROM p GROUP BY job_url",
        "dedupe_two_stage": _with(P, ALL_INGESTED) + "SELECT seq, url AS job_url, title, company, location FROM d",
        "dedupe_pages": f"SELECT min(page_id) AS page_id, {_canonical('url')} AS url FROM pages GROUP BY 2",
        "first_per_company": p + "SELECT company, date_posted, seq, title FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY date_posted, seq) AS rn FROM p) t WHERE rn = 1",
        "validated": _with(P, VALID) + "SELECT * FROM valid",
        "rejected_by_reason": _with(P, VALID) + f"SELECT CASE WHEN url = '' THEN 'missing url' WHEN NOT {HAS_TITLE} THEN 'missing title' ELSE 'bad url' END AS reason, "
                              f"count(*) AS n FROM urls WHERE NOT (url <> '' AND {HAS_TITLE} AND {HTTP}) GROUP BY 1",
        "wanted_titles": p + f"SELECT seq, title FROM p WHERE {WANTED}",
        "non_senior_titles": p + f"SELECT seq, title FROM p WHERE NOT {SENIOR}",
        "listed_companies": p + f"SELECT seq, company, {LISTED} AS is_listed, {LISTED_WORD} AS is_listed_word FROM p",
        "countries": p + f"SELECT seq, country, {_currency('country')} AS currency FROM (SELECT seq, {COUNTRY} AS country FROM "
                         "(SELECT seq, lower(concat_ws(', ', location, source_location)) AS l FROM p) a) b",
        "years_estimated": _with(P, _years("p", "description")) + "SELECT p.seq, CAST(lo AS INTEGER) AS est_min_years, CAST(hi AS INTEGER) AS est_max_years FROM p LEFT JOIN years USING (seq)",
        "years_whole_texts": _with(
            P, "long AS (SELECT doc_id AS seq, concat_ws(' ', text, description, text, description) AS t FROM documents LEFT JOIN p ON doc_id = seq)", _years("long", "t")
        ) + "SELECT long.seq, CAST(lo AS INTEGER) AS est_min_years, CAST(hi AS INTEGER) AS est_max_years FROM long LEFT JOIN years USING (seq)",
        "band_filter": _with(P, _years("p", "description"), "y AS (SELECT p.seq, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM p LEFT JOIN years USING (seq))")
                       + "SELECT keep_unknown, lo AS est_min_years, hi AS est_max_years, count(*) AS n FROM y, (SELECT unnest([true, false]) AS keep_unknown) u "
                         "WHERE CASE WHEN lo IS NULL AND hi IS NULL THEN keep_unknown ELSE coalesce(lo <= 4, true) AND coalesce(hi >= 2, true) END GROUP BY ALL",
        "skills_matched": _with(P, KEY_TEXT) + "SELECT p.seq, coalesce(skills, '') AS skills FROM p LEFT JOIN (SELECT seq, string_agg(skill, ', ' ORDER BY place) AS skills FROM ks GROUP BY seq) g USING (seq)",
        "skill_doc_freq": _with(P, KEY_TEXT) + "SELECT skill, count(*) AS n FROM ks GROUP BY skill",
        "top_skills": _with(P, KEY_TEXT) + "SELECT skill, count(*) AS n FROM ks GROUP BY skill ORDER BY n DESC, skill LIMIT 5",
        "dictionary_doc_freq": r"WITH dict AS (SELECT DISTINCT regexp_extract(lower(text), '[\p{L}\p{N}_]+') AS skill FROM documents), "
                               r"words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) "
                               "SELECT skill, count(*) AS n FROM dict JOIN words ON w = skill WHERE skill <> '' GROUP BY skill",
        "dictionary_with_signs": "WITH e AS (SELECT DISTINCT unnest(["
                                 + ", ".join(f"e{i}" for i in range(len(SIGNED))) + "]) AS skill FROM (SELECT "
                                 + ", ".join(f"min(nullif(regexp_extract(text, '{s}'), '')) AS e{i}" for i, s in enumerate(SIGNED)) + " FROM documents GROUP BY lang) g), "
                                 + r"x AS (SELECT skill, concat(CASE WHEN regexp_matches(skill, '^[\p{L}\p{N}_]') THEN '(?:^|[^\p{L}\p{N}_])' ELSE '[\p{L}\p{N}_]' END, "
                                   r"regexp_escape(lower(skill)), CASE WHEN regexp_matches(skill, '[\p{L}\p{N}_]$') THEN '(?:[^\p{L}\p{N}_]|$)' ELSE '[\p{L}\p{N}_]' END) AS rx FROM e WHERE skill IS NOT NULL) "
                                   "SELECT skill, count(*) AS n FROM x JOIN documents ON contains(lower(text), lower(skill)) AND regexp_matches(lower(text), rx) GROUP BY skill",
        "degree_doc_freq": p + " UNION ALL ".join(
            f"SELECT '{d}' AS degree, count(*) AS n FROM p WHERE regexp_matches(lower(concat(title, ' ', description)), '{rx}') HAVING count(*) > 0" for d, rx in DEGREES.items()),
        "mid_level": _with(P, _enriched("p", "false")) + "SELECT seq, mid_level_score, is_mid_level FROM enriched",
        "match_scores": _with(P, VALID, _enriched("valid")) + "SELECT seq, match_score FROM enriched",
        "profile_matches": _with(P, _enriched("p", "false", (("snowflake", "dbt"), 2, 6))) + "SELECT seq, title, lo AS est_min_years FROM enriched WHERE is_profile_match",
        "enriched": _with(P, ALL_INGESTED, "kept AS (" + _kept_rows("seq, batch_id") + ")", _enriched("kept")) + f"SELECT {ENRICHED_OUT} FROM enriched",
        "analysis_soft": analysed + f"SELECT {ANALYSED_COLUMNS} FROM enriched",
        "analysis_hard": analysed + f"SELECT {ANALYSED_COLUMNS} FROM enriched WHERE NOT {SENIOR} AND NOT (lo IS NULL AND hi IS NULL) AND in_experience_band",
        "analysis_funnel": _with(P, VALID, _enriched("valid")) + f"""SELECT count(*) AS loaded, count(*) FILTER (st = 1) AS title_dropped, count(*) FILTER (st = 2) AS senior_dropped,
            count(*) FILTER (st = 3) AS band_dropped, count(*) FILTER (st = 4) AS kept FROM (SELECT CASE WHEN NOT {WANTED} THEN 1 WHEN {SENIOR} THEN 2
            WHEN (lo IS NULL AND hi IS NULL) OR NOT in_experience_band THEN 3 ELSE 4 END AS st FROM enriched) t""",
        "score_range": analysed + "SELECT min(match_score) AS min_score, median(match_score) AS median_score, max(match_score) AS max_score FROM enriched",
        "top_match_jobs": analysed + f"SELECT {BEST_PLACE}, "
                                     "title, company, location, match_score, job_url AS url FROM enriched ORDER BY rank LIMIT 6",
        "ranked_all": analysed + "SELECT seq, row_number() OVER (ORDER BY match_score DESC, in_experience_band DESC, is_mid_level DESC, is_fortune_500 DESC, job_url, seq) AS rank FROM enriched",
        "query_grid": _with(P, GRID_CTES) + "SELECT source_location, source_query, remote_only, count(p.seq) AS n FROM cells LEFT JOIN p USING (source_location, source_query) GROUP BY ALL",
        "source_outcomes": _with(P, GRID_CTES) + f"""SELECT source_location, source_query, remote_only, site, n AS n_rows, CASE WHEN n > 0 THEN 'ok'
            WHEN source_location = 'Bangladesh' AND EXISTS (SELECT 1 FROM p WHERE p.job_url IS NULL AND p.site = g.site AND p.source_query = g.source_query) THEN 'failed'
            ELSE 'empty' END AS status FROM (SELECT source_location, source_query, remote_only, site, count(p.seq) AS n
            FROM (SELECT * FROM cells, (SELECT unnest([{_quoted((*SITES, 'adzuna'))}]) AS site) s) c LEFT JOIN p USING (source_location, source_query, site) GROUP BY ALL) g""",
        "capped_results": p + "SELECT seq, site, source_query, source_location FROM (SELECT *, row_number() OVER (PARTITION BY site, source_query, source_location ORDER BY seq) AS rn FROM p) t WHERE rn <= 100",
        "new_only": _with(*later, LATER_URL) + "SELECT seq, job_url FROM lu WHERE job_url NOT IN (SELECT job_url FROM seen)",
        "already_seen": _with(*later, LATER_URL) + "SELECT seq, job_url FROM lu WHERE job_url IN (SELECT job_url FROM seen)",
        "ledger_after": _with(*later, LATER_URL) + "SELECT job_url FROM seen UNION SELECT job_url FROM lu WHERE job_url <> ''",
        "ingest_final": _with(*later, INGESTED) + _kept_rows("seq, batch_id"),
        "ingest_include_seen": _with(P, LATER, _decided("d", "later", None)) + f"SELECT seq, url AS job_url, {LISTED} AS is_fortune_500 FROM d WHERE stage = 'kept'",
        "ingest_top": _with(*later, INGESTED, "kept AS (" + _kept_rows("seq") + ")") + "SELECT seq, job_url, company FROM kept ORDER BY is_fortune_500 DESC, source_location ASC NULLS LAST, job_url LIMIT 20",
        "ingest_funnel": _with(*later, INGESTED) + """SELECT CAST(6 AS BIGINT) AS queries_run, CAST(sum(copies2) AS BIGINT) AS fetched, count(*) AS deduped,
            count(*) FILTER (stage = 'seen') AS seen_skipped, count(*) FILTER (stage = 'invalid') AS invalid_skipped,
            count(*) FILTER (stage = 'unwanted title') AS title_filtered, count(*) FILTER (stage = 'kept') AS final_count, 'jobs kept' AS diagnosis
            FROM (SELECT d.*, g.copies2 FROM d JOIN (SELECT grp, sum(copies) AS copies2 FROM d_g GROUP BY grp) g USING (grp)) t""",
        "collected_query": p + f"""SELECT seq, site, job_url, CASE WHEN site <> '{SITES[0]}' THEN job_type END AS job_type FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY seq) AS rn
            FROM p WHERE source_query = 'data engineer' AND site IS NOT NULL) t WHERE rn = 1""",
        "feed_a": p + "SELECT source_query, concat('rem-', seq) AS id, 'remotive' AS site, job_url, title, company, coalesce(location, 'Remote') AS location, date_posted, "
                      "trim(description) AS description, job_type, true AS is_remote, CAST(NULL AS VARCHAR) AS company_logo, CAST(NULL AS VARCHAR) AS category FROM p",
        "feed_b": p + f"""SELECT loc AS source_location, concat('adz-', seq) AS id, 'adzuna' AS site, job_url, title, company, location, date_posted, trim(description) AS description,
            nullif(CAST(seq % 4 * 1000 AS DOUBLE), 0) AS min_amount, nullif(CAST(seq % 3 * 2500.5 AS DOUBLE), 0) AS max_amount, {_currency(COUNTRY)} AS currency,
            contains(lower(description), 'remote') AS is_remote FROM (SELECT *, coalesce(source_location, 'Dhaka, Bangladesh') AS loc, lower(coalesce(source_location, 'Dhaka, Bangladesh')) AS l FROM p) t""",
        "feed_ingested": _with(P, "fp AS (SELECT seq, job_url, title, company, coalesce(location, 'Remote') AS location FROM p)", _decided("d", "fp", None),
                               "placed AS (SELECT seq, seq // 10 AS payload, CAST(row_number() OVER (PARTITION BY seq // 10 ORDER BY seq) - 1 AS INTEGER) AS place FROM p)")
                         + "SELECT payload, place, url AS job_url, trim(title) AS title, coalesce(nullif(trim(company), ''), 'Unknown') AS company, location "
                           "FROM d JOIN placed USING (seq) WHERE stage = 'kept'",
        "feed_b_several": _with(P, "l AS (SELECT *, coalesce(source_location, 'Dhaka, Bangladesh') AS loc, lower(coalesce(source_location, 'Dhaka, Bangladesh')) AS l FROM p)")
                          + f"""SELECT min(seq) OVER w AS payload, CAST(row_number() OVER (PARTITION BY seq // 10, loc ORDER BY seq) - 1 AS INTEGER) AS place, concat('adz-', seq) AS id, job_url, company, location,
            nullif(CAST(seq % 4 * 1000 AS DOUBLE), 0) AS min_amount, nullif(CAST(seq % 3 * 2500.5 AS DOUBLE), 0) AS max_amount, {_currency(COUNTRY)} AS currency FROM l WINDOW w AS (PARTITION BY seq // 10, loc)""",
        "ledger_reset": p + f"SELECT DISTINCT {_canonical('job_url')} AS job_url, CAST(2 AS BIGINT) AS batch_id FROM p WHERE batch_id = 2",
        "settings_overlay": _with(P, _skill_rows("os", "p", "concat(coalesce(title, ''), ' ', description)", [s.lower() for s in OVERLAY["my_skills"]]),
                                  "og AS (SELECT seq, string_agg(skill, ', ' ORDER BY place) AS skills FROM os GROUP BY seq)")
                            + f"SELECT p.seq, coalesce(skills, '') AS skills, ({_matches('title', OVERLAY['title_include_patterns'])} AND NOT {_matches('title', DEFAULT.title_exclude_patterns)}) AS wanted, "
                              "false AS is_listed FROM p LEFT JOIN og USING (seq)",
        "feed_c": p + "SELECT seq, site, title, CAST(seq % 2 * 50 AS INTEGER) AS source_offset, 'data engineer' AS source_query, 'India' AS source_location FROM p",
        "union_by_name": p + "SELECT seq, title, CAST(NULL AS VARCHAR) AS company FROM p UNION ALL SELECT seq, NULL, company FROM p",
        "market_summary": _with(*ANALYSED_CTES, VALID_SKILLS) + _summary("enriched", "es", "es"),
        "stored_summary": _with(P, VALID, _enriched("valid"), VALID_SKILLS, KEY_TEXT,
                                "run AS (SELECT skill FROM es UNION ALL SELECT ks.skill FROM ks JOIN p USING (seq) WHERE batch_id = 0)") + _summary("enriched", "es", "run"),
        "summary_document": _with(*ANALYSED_CTES, VALID_SKILLS, f"best AS (SELECT {BEST_PLACE}, * FROM enriched ORDER BY rank LIMIT 6)") + _summary("enriched", "es", "es", 1000)
                            + " UNION ALL SELECT 'top_match_jobs', rank, job_url, match_score FROM best UNION ALL SELECT 'sample_jobs', rank, concat_ws(' | ', title, company, location, job_url), NULL FROM best",
        "totals_imported": _with(P, KEY_TEXT) + "SELECT skill, count(*) AS n FROM ks GROUP BY skill",
        "running_totals": _with(P, KEY_TEXT) + "SELECT skill, count(*) AS n FROM ks GROUP BY skill",
        "totals_replayed": _with(P, KEY_TEXT) + "SELECT skill, count(*) AS n FROM ks GROUP BY skill",
        "keyword_counts": _with(_keywords("documents", "text")) + "SELECT keyword, count(*) AS n FROM kw GROUP BY keyword",
        "top_keywords": _with(_keywords("documents", "text")) + "SELECT keyword, count(*) AS n FROM kw GROUP BY keyword ORDER BY n DESC, keyword LIMIT 12",
        "trend_snapshot": _with(P, ALL_INGESTED, "kept AS (" + _kept_rows("seq") + ")", _keywords("kept", "description"))
                          + _trend("kept", "kw", "is_fortune_500"),
        "trend_log": _with(P, *[f"b{b} AS (SELECT * FROM p WHERE batch_id = {b}), " + _keywords(f"b{b}", "description").replace("kw AS", f"kw{b} AS") for b in range(3)])
                     + " UNION ALL ".join(f"SELECT '2024-01-0{b + 1}' AS run, * FROM ({_trend(f'b{b}', f'kw{b}', 'false')}) t{b}" for b in range(3)),
        "trend_samples": _with(P, ALL_INGESTED, "kept AS (" + _kept_rows("seq") + ")") + "SELECT concat_ws(' | ', title, company, location, coalesce(source_location, 'None')) AS job FROM kept ORDER BY seq LIMIT 5",
        "html_text": f"SELECT page_id, {_html_text('html')} AS text FROM pages",
        "html_escaped": f"SELECT page_id, {_html_escaped('html')} AS html FROM pages",
        "report_dataset": analysed + "SELECT match_score, matched_skills, title, company, location, site, source_location, source_query, is_fortune_500, is_mid_level, mid_level_score, "
                                     "lo AS est_min_years, hi AS est_max_years, in_experience_band, is_profile_match, is_remote, job_url FROM enriched",
        "report_display": analysed + f"SELECT seq, {_display(True)}, {REPORTED} AS search FROM enriched",
        "report_facets": p + " UNION ".join(f"SELECT '{c}' AS facet, trim({c}) AS value FROM p WHERE trim({c}) <> ''" for c in ("site", "source_location", "source_query")),
        "facet_counts": p + ", v AS (SELECT seq, nullif(trim(site), '') AS site, nullif(trim(source_location), '') AS source_location, nullif(trim(job_type), '') AS job_type, "
                        "CASE WHEN is_remote THEN 'true' ELSE 'false' END AS is_remote FROM p) " + _facet_counts(),
        "report_filtered": analysed + f"SELECT seq, title, match_score FROM enriched WHERE {CRITERIA}",
        "report_my_profile": analysed + "SELECT seq, title, lo AS est_min_years FROM enriched WHERE is_mid_level AND in_experience_band AND (lo IS NULL OR lo <= 4)",
        "report_counts": analysed + f"SELECT count(*) FILTER ({CRITERIA}) AS visible, count(*) AS total, 'Postings where query is engineer and mid and years at most 4 and match at least 8.0' AS filters FROM enriched",
        "report_sorted": analysed + "SELECT seq, job_url, source_location, lo AS est_min_years FROM enriched ORDER BY lower(source_location) DESC NULLS LAST, job_url",
        "report_positions": analysed + "SELECT seq, source_location, row_number() OVER (ORDER BY nullif(lower(trim(source_location)), '') DESC NULLS LAST, job_url, seq) AS position FROM enriched",
        "analyze_and_report": _with(P, VALID, VALID_WANTED, _enriched("chosen"), "scored AS MATERIALIZED (SELECT * FROM enriched)",
                                    _skill_rows("es", "scored", "concat(title, ' ', description)", DEFAULT.key_skills), _keywords("scored", "description"),
                                    f"placed AS (SELECT {BEST_PLACE}, * FROM scored)")
                              + f"SELECT concat('summary: ', section) AS section, CAST(rank AS BIGINT) AS rank, key, value FROM ({_summary('scored', 'es', 'es')}) a "
                              + f"UNION ALL SELECT concat('trend: ', section), rank, key, n FROM ({_trend('scored', 'kw', 'is_fortune_500')}) b "
                                "UNION ALL SELECT 'top_jobs', rank, job_url, match_score FROM placed WHERE rank <= 6 "
                              + "".join(f"UNION ALL SELECT DISTINCT 'facets', 0, concat('{c}: ', trim({c})), NULL FROM scored WHERE trim({c}) <> '' " for c in ("site", "source_location", "source_query"))
                              + "UNION ALL SELECT 'skill_totals', 0, skill, count(*) FROM es GROUP BY skill UNION ALL SELECT 'report', rank, job_url, match_score FROM placed "
                                f"UNION ALL SELECT 'visible', 0, job_url, match_score FROM scored WHERE {CRITERIA}",
        "daily_runs": _with(P, _batches(), _enriched("stored"), "scored AS MATERIALIZED (SELECT * FROM enriched)",
                            _skill_rows("es", "scored", "concat(title, ' ', description)", DEFAULT.key_skills), "esb AS MATERIALIZED (SELECT es.*, batch_id FROM es JOIN scored USING (seq))",
                            *[f"x{b} AS (SELECT * FROM scored WHERE batch_id = {b}), s_{b} AS (SELECT * FROM esb WHERE batch_id = {b}), run{b} AS (SELECT * FROM esb WHERE batch_id <= {b}), "
                              + _keywords(f"x{b}", "description").replace("kw AS", f"kw{b} AS") for b in range(3)])
                      + " UNION ALL ".join(
                          f"SELECT CAST({b} AS BIGINT) AS batch_id, concat('summary: ', section) AS section, CAST(rank AS BIGINT) AS rank, key, value FROM ({_summary(f'x{b}', f's_{b}', f'run{b}')}) a{b} "
                          f"UNION ALL SELECT {b}, concat('trend: ', section), rank, key, n FROM ({_trend(f'x{b}', f'kw{b}', 'is_fortune_500')}) b{b}" for b in range(3)),
        "report_export": analysed + f"SELECT {_display(False, title=chr(39).join(['concat(job_url, ', ' | ', ', title)']))} FROM enriched WHERE {CRITERIA}",
        "report_html_rows": analysed + f"SELECT {_html_row()} AS row FROM enriched",
        "csv_roundtrip": _with(P, f"u AS (SELECT *, {_canonical('job_url')} AS url FROM p)", f"f AS (SELECT seq, {_fixed('url', 'false')} FROM u)")
                         + f"SELECT * EXCLUDE (seq) REPLACE (concat(description, {NOTE}) AS description) FROM f",
        "table_appended": p + "SELECT seq, title, CASE WHEN batch_id > 0 THEN company END AS company FROM p",
        "text_dump": _with(P, VALID) + f"SELECT seq, {BLOCK} AS block FROM valid",
        "incremental_runs": _with(P, _batches(), _enriched("stored")) + "SELECT seq, job_url, batch_id, match_score FROM enriched",
        "store_shared": _with(P, _batches(len(SHARED_TURNS), f"seq % {len(SHARED_TURNS)}", SHARED_NAMES)) + "SELECT seq, job_url, source, batch_id, true AS in_ledger FROM stored",
        "ledger_levels": _with(P, f"k AS MATERIALIZED (SELECT DISTINCT (seq % {LEDGER_BATCHES * 7}) // 7 AS batch, {_canonical('job_url')} AS job_url FROM p)",
                               "f AS (SELECT job_url, min(batch) AS first FROM k WHERE job_url <> '' GROUP BY job_url)", "m AS (SELECT count(DISTINCT first) AS n FROM f)")
                         + "SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n_seen, min(job_url) AS first_seen, (SELECT n % 4 + n // 4 % 4 + n // 16 FROM m) AS n_runs "
                           "FROM k JOIN f USING (job_url) WHERE batch > first GROUP BY batch",
        "stream_new_only": _with(P, _batches()) + "SELECT seq, job_url, batch_id FROM stored",
        "stream_skill_totals": _with(P, KEY_TEXT) + "SELECT skill, count(*) AS n FROM ks GROUP BY skill",
        "stream_daily_counts": "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
        "stream_first_within": _with(P, f"u AS (SELECT DISTINCT {_canonical('job_url')} AS job_url, {FIRST_DAY} + (seq * 37) % 120 * 86400 AS at_s FROM p)",
                                     "g AS (SELECT *, lag(at_s) OVER (PARTITION BY job_url ORDER BY at_s) AS before FROM u)")
                               + f"SELECT cuts, job_url, CAST(at_s AS BIGINT) AS at_s FROM g, (SELECT CAST(unnest([1, 3, 6]) AS INTEGER) AS cuts) c WHERE before IS NULL OR at_s - before > {14 * 86400}",
    }
