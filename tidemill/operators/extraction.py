"""Fields out of pages, with the source of each value."""

from __future__ import annotations

from tidemill.operators import markup
from tidemill.operators.base import operator

ATTR = r"""(?i){name}\s*=\s*[\x22\x27]([^\x22\x27]*)[\x22\x27]"""


@operator("responses")
def extract_meta(d):
    """EXT-02: meta name or property → content, the first of a name wins."""
    name = d.ext("part", ATTR.format(name=r"\b(?:name|property)"), 1)
    content = d.ext("part", ATTR.format(name=r"\bcontent"), 1)
    return f"""WITH tags AS ({d.all_rows("@responses", "page_id", "body", r"(?i)<meta\b[^>]*>")}), m AS (SELECT page_id, lower({name}) AS name, {content} AS content, pos FROM tags)
    SELECT page_id, name, min_by(content, pos) AS content FROM m WHERE name <> '' GROUP BY page_id, name"""


@operator("responses")
def extract_app_state(d):
    """EXT-03: the embedded state document of a page, as text: that of a named script, else what is assigned."""
    named = d.from_end(d.among(d.found("body", "(?is)<script[^>]*>.*?</script>"), lambda t: f"{markup.attribute(d, t, 'id')} = '__next_data__'"), 1)
    inner = f"substring({named}, position('>' IN {named}) + 1, length({named}) - position('>' IN {named}) - 9)"
    rest = "trim(substring(body, position('_STATE__' IN body) + 8))"
    assigned = f"CASE WHEN position('_STATE__' IN body) > 0 AND {d.rx(rest, '^=')} THEN concat(trim(substring(split_part({rest}, '}};', 1), 2)), '}}') END"
    return f"SELECT page_id, coalesce(nullif({inner}, ''), {assigned}) AS app_state FROM @responses"


@operator("observed_requests")
def extract_json(d):
    """EXT-04: a field of JSON bodies; absent ones are left out."""
    return f"SELECT req_id, 'k' AS field, {d.json('body', '$.k')} AS value FROM @observed_requests WHERE {d.json('body', '$.k')} IS NOT NULL"


@operator("observed_requests")
def read_json_paths(d):
    """PRJ-17: whether the required path is there."""
    return f"SELECT req_id, {d.json('body', '$.k')} AS value, {d.json('body', '$.k')} IS NOT NULL AS present FROM @observed_requests"


@operator("responses")
def extract_heuristic(d):
    """EXT-06: the first heading, else the title."""
    text = lambda tag: f"nullif(trim({d.sub(d.ext('body', f'(?is)<{tag}' + r'\b[^>]*>(.*?)' + f'</{tag}>', 1), '<[^>]+>', '')}), '')"
    return f"SELECT page_id, coalesce({text('h1')}, {text('title')}) AS title FROM @responses"


@operator("responses", "extract_meta", "extract_heuristic")
def extractor_values(d):
    """All values of a field, by extractor position."""
    return """SELECT page_id, 'title' AS field, 1 AS position, 'meta' AS source, content AS value FROM @extract_meta WHERE name IN ('og:title', 'title') AND content <> ''
    UNION ALL SELECT page_id, 'title', 2, 'heuristic', title FROM @extract_heuristic WHERE title IS NOT NULL
    UNION ALL SELECT page_id, 'description', 1, 'meta', content FROM @extract_meta WHERE name IN ('description', 'og:description') AND content <> ''"""


@operator("extractor_values")
def extract_fields(d):
    """EXT-07: the first extractor's value per field, with its source."""
    return "SELECT page_id, field, min_by(value, position) AS value, min_by(source, position) AS source FROM @extractor_values GROUP BY page_id, field"


@operator("extractor_values")
def quorum_fields(d):
    """EXT-08: agreement of the extractors per field."""
    return """SELECT page_id, field, CASE WHEN count(DISTINCT value) > 1 THEN 'conflict' WHEN count(*) >= 2 THEN 'high' ELSE 'medium' END AS agreement, count(*) AS sources, min_by(value, position) AS value
    FROM @extractor_values GROUP BY page_id, field"""


@operator("price_texts")
def normalize_numbers(d):
    """PRJ-16, number: currency and spaces go; the last separator is the decimal point, the other kind groups digits."""
    plain = d.sub("raw", "[^0-9,.-]", "")
    comma_last = d.rx("plain", ",[^.]*$")
    value = f"CASE WHEN {comma_last} THEN replace(replace(plain, '.', ''), ',', '.') ELSE replace(plain, ',', '') END"
    return f"SELECT text_id, {d.try_double(value)} AS value FROM (SELECT text_id, {plain} AS plain FROM @price_texts) t"
