"""URL columns: canonical form, redaction, identities, classes."""

from __future__ import annotations

from tidemill.operators.base import operator

#: Tracking parameters, sensitive query keys (two variants), paging parameters.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid yclid mc_cid mc_eid _ga ref ref_src".split()
SENSITIVE = "key api_key apikey access_token auth auth_token token secret client_secret password passwd signature sig sid session sessionid session_id".split()
SENSITIVE_SHORT = "token access_token auth auth_token key apikey api_key signature sig secret password session sid".split()
PAGING = "page offset start skip cursor after before from p limit size".split()


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _parts(d, table: str, key: str, extra: str = "") -> str:
    """Scheme, host with port, path and query of ``url``."""
    return f"""SELECT {key}, url, {extra} lower({d.ext("url", "^([A-Za-z][A-Za-z0-9+.-]*):", 1)}) AS scheme,
      lower({d.ext("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/?#]*)", 2)}) AS host,
      {d.ext("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)} AS path,
      {d.ext("url", "^[^?#]*[?]([^#]*)", 1)} AS query FROM {table}"""


def canonical(d, url: str) -> str:
    """One spelling of an address. No row is taken apart: path and query are arrays of the row.

    Scheme and host are lower, user, default port, fragment and tracking parameters gone,
    dot segments followed, pairs decoded, sorted and written anew; an empty path is ``/``.
    """
    scheme = f"lower({d.ext(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)})"
    host = f"lower({d.ext(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/?#]*)', 2)})"
    path, query = d.ext(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), d.ext(url, "^[^?#]*[?]([^#]*)", 1)
    place = f"CASE {scheme} WHEN 'http' THEN {d.sub(host, ':80$', '')} WHEN 'https' THEN {d.sub(host, ':443$', '')} ELSE {host} END"
    step = lambda acc, t: f"CASE WHEN {t} = '.' THEN {acc} WHEN {t} = '..' THEN CASE WHEN {acc} = '' OR right({acc}, 1) = '/' THEN {acc} ELSE {d.sub(acc, '/[^/]*$', '')} END ELSE concat({acc}, '/', {t}) END"
    walked = f"CASE WHEN {path} = '' THEN '' ELSE {d.folded(d.pieces(f'substring({path}, 2)', '/'), step)} END"
    key, value = lambda t: d.decoded(f"split_part({t}, '=', 1)"), lambda t: d.decoded(f"CASE WHEN position('=' IN {t}) > 0 THEN substring({t}, position('=' IN {t}) + 1) ELSE '' END")
    pairs = d.mapped(d.among(d.pieces(query, "&"), lambda t: f"{t} <> ''"), lambda t: d.pair(key(t), value(t)))
    kept = d.among(pairs, lambda t: f"lower({t}.a) NOT IN ({_quoted(TRACKING)})")
    written = d.glued(d.mapped(d.ordered(kept), lambda t: f"concat({d.encoded(f'{t}.a')}, '=', {d.encoded(f'{t}.b')})"), "&")
    return f"concat({scheme}, '://', {place}, coalesce(nullif({walked}, ''), '/'), CASE WHEN {written} = '' THEN '' ELSE concat('?', {written}) END)"


@operator("responses")
def canonicalize_urls(d):
    """PRJ-01: one spelling of each address."""
    return f"SELECT page_id, {canonical(d, 'trim(url)')} AS canonical_url FROM @responses"


def _redacted(d, table: str, key: str, keys, mask: str) -> str:
    return d.sub("url", "([?&])(" + "|".join(keys) + ")=[^&#]*", f"$1$2={mask}")


@operator("secret_texts")
def redact_urls(d):
    """PRJ-02: values of sensitive query keys masked, in two variants."""
    return f"SELECT doc_id, {_redacted(d, '', '', SENSITIVE, '[REDACTED]')} AS stored_url, {_redacted(d, '', '', SENSITIVE_SHORT, 'REDACTED')} AS observed_url FROM @secret_texts"


@operator("observed_requests")
def endpoint_identity(d):
    """PRJ-03: id-shaped path segments become {id}; paging parameters go; the rest is sorted."""
    ident = "([0-9]+|[0-9a-f]{8,}|[0-9a-fA-F-]{32,})"
    return f"""WITH parts AS ({_parts(d, "@observed_requests", "req_id", "method,")}),
    pairs AS ({d.split_rows("parts", "req_id", "query", "&")}),
    kept AS (SELECT req_id, {d.joined("part")} AS q FROM pairs WHERE part <> '' AND {d.ext("part", "^([^=]*)", 1)} NOT IN ({_quoted(PAGING)}) GROUP BY req_id),
    segments AS ({d.split_rows("parts", "req_id", "path", "/")}),
    shaped AS (SELECT req_id, pos, CASE WHEN {d.rx("part", "^" + ident + "$")} THEN '{{id}}' ELSE part END AS part FROM segments),
    paths AS (SELECT req_id, {"string_agg(part, '/' ORDER BY pos)" if d.duck else "array_join(transform(array_sort(collect_list(struct(pos, part))), x -> x.part), '/')"} AS path FROM shaped GROUP BY req_id)
    SELECT p.req_id, concat(p.method, ' ', scheme, '://', host, s.path, CASE WHEN k.q IS NULL THEN '' ELSE concat('?', replace(k.q, ',', '&')) END) AS identity
    FROM parts p JOIN paths s ON p.req_id = s.req_id LEFT JOIN kept k ON p.req_id = k.req_id"""


@operator("observed_requests")
def add_site_keys(d):
    """PRJ-04: host, registrable domain (last two labels), same origin and same site as the page."""
    host = lambda x: f"lower({d.ext(x, '^[A-Za-z]+://([^/?#]*)', 1)})"
    domain = lambda x: d.ext(host(x), "([^.]+[.][^.]+)$", 1)
    return f"""SELECT req_id, {host("url")} AS host, {domain("url")} AS registrable_domain,
      {d.ext("url", "^([A-Za-z]+://[^/?#]*)", 1)} = {d.ext("page_url", "^([A-Za-z]+://[^/?#]*)", 1)} AS same_origin, {domain("url")} = {domain("page_url")} AS same_site FROM @observed_requests"""


@operator("responses")
def infer_url_class(d):
    """PRJ-05: class from the path's shape."""
    path = d.sub(d.ext("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    return f"""WITH p AS (SELECT page_id, {path} AS path FROM @responses)
    SELECT page_id, CASE WHEN path = '' THEN 'home' WHEN {d.rx("path", "^[0-9]+(/[0-9]+)*$")} THEN 'entity'
      WHEN {d.rx("path", "(^|/)[0-9]+$")} THEN {d.ext("path", "^(?:[0-9]+/)*([^/]+)", 1)}
      ELSE {d.ext("path", "([^/0-9][^/]*)(?:/[0-9]+)*$", 1)} END AS inferred_class FROM p"""


@operator("responses")
def add_hash_keys(d):
    """PRJ-06: route id, page fingerprint and target hash from sha256."""
    return f"SELECT page_id, concat('http:', substring({d.sha('url')}, 1, 8)) AS route_id, substring({d.sha('url')}, 1, 16) AS page_fingerprint, {d.sha('url')} AS target_hash FROM @responses"


def _matching(d) -> str:
    """The rules, one small array that comes along with each row, whose pattern matches its URL."""
    if d.duck:
        return "list_filter(k.rules, lambda x: regexp_matches(r.url, x.pattern))"
    return "filter(k.rules, x -> r.url RLIKE x.pattern)"


def _rules(d) -> str:
    return "SELECT list(struct_pack(position := position, pattern := pattern, url_class := url_class) ORDER BY position) AS rules FROM @rules" if d.duck else "SELECT sort_array(collect_list(struct(position, pattern, url_class))) AS rules FROM @rules"


@operator("responses", "rules")
def assign_url_class(d):
    """JOIN-01: the first class, in declared order, whose pattern matches. No row is moved."""
    first = d.at("m", 1)
    return f"""SELECT page_id, {first}.url_class AS url_class, CAST({first}.position AS BIGINT) AS position FROM (SELECT r.page_id, {_matching(d)} AS m FROM @responses r CROSS JOIN ({_rules(d)}) k) x"""


@operator("responses", "rules")
def find_class_overlaps(d):
    """JOIN-02: URLs that more than one class matches. No row is moved."""
    names = "array_to_string(list_sort(list_transform(m, lambda x: x.url_class)), ',')" if d.duck else "array_join(sort_array(transform(m, x -> x.url_class)), ',')"
    return f"""SELECT page_id, CAST({d.size("m")} AS BIGINT) AS classes, {names} AS names FROM (SELECT r.page_id, {_matching(d)} AS m FROM @responses r CROSS JOIN ({_rules(d)}) k) x WHERE {d.size("m")} > 1"""


@operator("canonicalize_urls", "queued_pages")
def enqueue_new_urls(d):
    """JOIN-03: each canonical URL once; what the queue doesn't hold yet is added, the rest skipped."""
    return """WITH q AS (SELECT DISTINCT c.canonical_url FROM @canonicalize_urls c JOIN @queued_pages p ON c.page_id = p.page_id)
    SELECT s.url, CASE WHEN q.canonical_url IS NULL THEN 'added' ELSE 'skipped' END AS outcome FROM (SELECT DISTINCT canonical_url AS url FROM @canonicalize_urls) s LEFT JOIN q ON s.url = q.canonical_url"""


@operator("seeds", "advance_queue")
def missing_seeds(d):
    """JOIN-04: seeds that never reached the queue."""
    return f"SELECT DISTINCT s.url FROM @seeds s {'ANTI' if d.duck else 'LEFT ANTI'} JOIN @advance_queue q ON s.url = q.url"
