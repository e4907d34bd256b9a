"""Fields and facts out of whole pages: JSON paths, linked data, selectors, and all extractors together.

Paths, linked data and facts are column expressions. Python runs in Arrow batches only
for what SQL has no function for: selectors over unclosed markup, HTML entities, mail
dates, and links relative to a page.
"""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of linked data and names of meta tags that give a field, best first.
LD_KEYS = {
    "title": ("headline", "name", "title"),
    "name": ("name", "headline"),
    "published_at": ("datePublished", "dateCreated", "uploadDate"),
    "modified_at": ("dateModified",),
    "author": ("author",),
    "description": ("description", "abstract"),
    "price": ("offers.price", "price"),
    "image": ("image",),
}
META_NAMES = {
    "title": ("og:title", "twitter:title"),
    "description": ("og:description", "twitter:description", "description"),
    "image": ("og:image", "twitter:image"),
    "published_at": ("article:published_time",),
    "author": ("article:author",),
    "url": ("og:url",),
}
#: Elements of a wildcard that count, and wildcards that a path may have.
MOST_ITEMS, MOST_WILDCARDS = 1000, 2


# JSON paths


def check_path(path: str) -> None:
    """Dotted names and numbers, ``[*]`` at the end of a part, at most two of them."""
    parts = path.split(".")
    bad = [p for p in parts if not p.strip() or "[" in p and not re.fullmatch(r"[^\[\]]*\[\*\]", p)]
    if bad or path.count("[*]") > MOST_WILDCARDS:
        raise ValueError(f"not a path: {path!r}")


def whole_json(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as a variant; null otherwise.

    Spark's parser stops after the first value. Inside a list and inside an object what
    follows a value has to be different, so a text that parses in both has no more.
    """
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


@F.pandas_udf(T.StringType())
def leading_json(texts: pd.Series) -> pd.Series:
    """The JSON object or list at the start of a text, whatever follows it; null if there is none."""
    decoder = json.JSONDecoder()

    def first(text):
        try:
            return text[: decoder.raw_decode(text)[1]] if text[:1] in ("{", "[") else None
        except (ValueError, RecursionError):
            return None

    return texts.map(first, na_action="ignore").astype(object).where(texts.notna(), None)


def _member(value: Column, name: str) -> Column:
    quoted = name.replace("'", "\\'")
    return F.try_variant_get(value, f"$['{quoted}']", "variant")


def _walk(value: Column, parts: list[str]) -> Column:
    if not parts:
        return value
    part, rest = parts[0], parts[1:]
    if part.endswith("[*]"):
        inner = _member(value, part[:-3]) if part[:-3] else value
        items = F.coalesce(F.try_variant_get(inner, "$", "array<variant>"), F.array().cast("array<variant>"))
        return F.to_variant_object(F.transform(F.slice(items, 1, MOST_ITEMS), lambda x: _walk(x, rest)))
    if re.fullmatch(r"-?[0-9]+", part):
        at = int(part)
        item = F.try_element_at(F.try_variant_get(value, "$", "array<variant>"), F.lit(at + 1 if at >= 0 else at))
        return _walk(F.coalesce(item, _member(value, part)), rest)
    return _walk(_member(value, part), rest)


def json_at(text: Column, path: str) -> Column:
    """PRJ-17: the value at a path of a JSON text, as a variant; null if it is missing or the text is no JSON."""
    check_path(path)
    return _walk(whole_json(text), path.split("."))


def read_json_values(df: DataFrame, column: str, paths: list[str], *keys: str) -> DataFrame:
    """PRJ-17: ``(keys, path, value, present)`` for each path, as JSON text.

    A required path is present if its value is neither null nor an empty list nor a list
    of nulls. Rows with a null or broken text have no values and nothing present.
    """
    each = []
    for path in paths:
        check_path(path)
        value = F.to_json(_walk(F.col("_json"), path.split(".")))
        there = value.isNotNull() & (value != "null") & ~value.rlike(r"^\[(null(,null)*)?\]$")
        each.append(F.struct(F.lit(path).alias("path"), value.alias("value"), F.coalesce(there, F.lit(False)).alias("present")))
    parsed = df.select(*keys, whole_json(F.col(column)).alias("_json"))
    return _exploded(parsed, F.array(*each), *keys)


#: A value that an extractor found of a field.
FOUND = "struct<field:string,value:string>"


def _listed(values: dict[str, Column]) -> Column:
    """Values by field as an array of what was found."""
    each = [F.struct(F.lit(field).alias("field"), value.cast("string").alias("value")) for field, value in values.items()]
    return F.filter(F.array(*each) if each else F.array().cast(f"array<{FOUND}>"), lambda x: x["value"].isNotNull())


def _exploded(df: DataFrame, found: Column, *keys: str) -> DataFrame:
    """Rows ``(keys, <struct's fields>)``. Spark would push the test for empty lists of a plain explode below all that
    makes them, and compute it twice; the outer one has no such test."""
    return df.select(*keys, F.explode_outer(found).alias("_e")).where("_e is not null").select(*keys, "_e.*")


def _json_values(parsed: Column, fields: dict[str, str]) -> dict[str, Column]:
    """Values by paths into a variant, which has to be a plain column: it is read for each of them."""
    out = {}
    for field, path in fields.items():
        check_path(path)
        value = _walk(parsed, path.split("."))
        items = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda x: ~F.is_variant_null(x))
        scalar = F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
        out[field] = F.when(items.isNotNull(), F.when(F.size(items) > 0, F.to_json(F.to_variant_object(items)))).otherwise(scalar)
    return out


def extract_json_fields(df: DataFrame, column: str, fields: dict[str, str], *keys: str) -> DataFrame:
    """EXT-04: ``(keys, field, value)``; nulls of lists are left out, and an empty list is no value."""
    return _exploded(df.select(*keys, whole_json(F.col(column)).alias("_json")), _listed(_json_values(F.col("_json"), fields)), *keys)


# linked data, state, meta


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside a tag's text, quoted or not; null if it is absent."""
    found = [F.regexp_extract(tag, rf"(?i)(?:^|\s){name}\s*=\s*{form}", 1) for form in ('"([^"]*)"', "'([^']*)'", "([^\\s\"'>]+)")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])


def _scripts(body: Column) -> Column:
    """The script elements of a body in order: structs of tag and code."""
    whole = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"
    parts = F.arrays_zip(F.regexp_extract_all(body, F.lit(whole), F.lit(1)).alias("tag"), F.regexp_extract_all(body, F.lit(whole), F.lit(2)).alias("code"))
    return F.transform(parts, lambda x: F.struct(x["tag"].alias("tag"), F.trim(x["code"]).alias("code")))


def _items(value: Column) -> Column:
    """The elements of a list, or the value alone."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))


def _plain(value: Column) -> Column:
    """A scalar's text; the name, id or address of an object; the first element of a list."""
    first = F.coalesce(F.get(F.try_variant_get(value, "$", "array<variant>"), 0), value)
    inside = F.coalesce(*[F.try_variant_get(_member(first, k), "$", "string") for k in ("name", "@id", "url")])
    is_object = F.schema_of_variant(first).startswith("OBJECT")
    return F.when(is_object, inside).when(~F.is_variant_null(first), F.try_variant_get(first, "$", "string"))


def _linked_data(scripts: Column) -> Column:
    """All linked-data objects of a body's scripts in order, members of an ``@graph`` in its place."""
    own = F.filter(scripts, lambda x: F.lower(_attribute(x["tag"], "type")) == "application/ld+json")
    docs = F.filter(F.transform(own, lambda x: whole_json(x["code"])), lambda d: d.isNotNull())
    tops = F.flatten(F.transform(docs, _items))
    members = F.flatten(F.transform(tops, lambda t: F.coalesce(F.try_variant_get(_member(t, "@graph"), "$", "array<variant>"), F.array(t))))
    return F.filter(members, lambda o: F.schema_of_variant(o).startswith("OBJECT"))


def _types(thing: Column) -> Column:
    return F.transform(_items(_member(thing, "@type")), lambda x: F.try_variant_get(x, "$", "string"))


def _of_kind(things: Column, kind: str | None) -> Column:
    """The first object of a type."""
    return F.get(things if kind is None else F.filter(things, lambda o: F.array_contains(_types(o), kind)), 0)


def _ld_values(thing: Column, fields: list[str]) -> dict[str, Column]:
    return {field: F.coalesce(*[_plain(_walk(thing, key.split("."))) for key in LD_KEYS.get(field, (field,))]) for field in fields}


def json_ld_objects(df: DataFrame, kind: str | None, *keys: str) -> DataFrame:
    """``(keys, object)``: the first object, or member of an ``@graph``, of the wanted type."""
    return _ld_objects(df, kind, *keys).where("object is not null")


def _ld_objects(df: DataFrame, kind: str | None, *keys: str) -> DataFrame:
    things = df.select(*keys, _linked_data(_scripts(F.col("body"))).alias("_things"))
    return things.select(*keys, _of_kind(F.col("_things"), kind).alias("object"))


def extract_json_ld(df: DataFrame, kind: str | None, fields: list[str], *keys: str) -> DataFrame:
    """EXT-01: ``(keys, field, value)`` of the first linked-data object of a type."""
    return _exploded(_ld_objects(df, kind, *keys), _listed(_ld_values(F.col("object"), fields)), *keys)


#: Names that pages assign their state to.
STATE_NAMES = ("INITIAL_STATE", "PRELOADED_STATE", "NUXT", "APOLLO_STATE")


def _state(scripts: Column) -> Column:
    """The state that a page carries in its scripts: that of that id, else what is assigned first, up to where its brace closes."""
    own = F.get(F.filter(scripts, lambda x: _attribute(x["tag"], "id") == "__NEXT_DATA__"), 0)["code"]
    code = F.array_join(F.transform(scripts, lambda x: x["code"]), "\n")
    return F.coalesce(own, leading_json(F.nullif(F.regexp_extract(code, rf"(?s)__(?:{'|'.join(STATE_NAMES)})__\s*=\s*(\{{.*)", 1), F.lit(""))))


def extract_state_fields(df: DataFrame, fields: dict[str, str], *keys: str) -> DataFrame:
    """EXT-03: ``(keys, field, value)`` by paths into the state that a page carries in a script."""
    return extract_json_fields(df.select(*keys, _state(_scripts(F.col("body"))).alias("state")), "state", fields, *keys)


def _meta_tags(body: Column) -> Column:
    """The meta tags of a body in order: structs of name and content."""
    tags = F.regexp_extract_all(body, F.lit(r"(?i)<meta\b([^>]*)>"), F.lit(1))
    return F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(_attribute(t, "property"), _attribute(t, "name"))).alias("name"), _attribute(t, "content").alias("content")))


def _meta_values(named: Column, fields: dict[str, tuple]) -> dict[str, Column]:
    of = lambda n: F.get(F.filter(named, lambda m: (m["name"] == n) & m["content"].isNotNull()), 0)["content"]
    return {field: F.coalesce(*[of(n) for n in names]) for field, names in fields.items()}


def extract_meta_fields(df: DataFrame, fields: dict[str, tuple], *keys: str) -> DataFrame:
    """EXT-02: ``(keys, field, value)``: the first name of each field that a meta tag has; of a name the first tag counts."""
    return _exploded(df, _listed(_meta_values(_meta_tags(F.col("body")), fields)), *keys)


# selectors


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset(("script", "style", "noscript", "template"))
STEP = re.compile(r"([A-Za-z][\w-]*)?((?:[#.][\w-]+)*)")


class Selector:
    """Descendant steps of tag, #id and .class, then ``::text`` (default) or ``::attr(name)``."""

    def __init__(self, text: str):
        path, _, what = text.strip().partition("::")
        self.attribute = what[5:-1].lower() if what.startswith("attr(") and what.endswith(")") else None
        if what and what != "text" and self.attribute is None:
            raise ValueError(f"not a selector: {text!r}")
        self.steps = []
        for step in path.split():
            m = STEP.fullmatch(step)
            if not m or not m[0]:
                raise ValueError(f"not a selector: {text!r}")
            marks = re.findall(r"([#.])([\w-]+)", m[2])
            self.steps.append(((m[1] or "").lower(), {v for k, v in marks if k == "#"}, {v for k, v in marks if k == "."}))
        if not self.steps:
            raise ValueError(f"not a selector: {text!r}")

    @staticmethod
    def _fits(step, element) -> bool:
        tag, ids, classes = step
        return (not tag or tag == element[0]) and ids <= element[1] and classes <= element[2]

    def matches(self, stack: list) -> bool:
        """Whether the innermost open element is selected."""
        if not self._fits(self.steps[-1], stack[-1]):
            return False
        left = len(self.steps) - 1
        for element in reversed(stack[:-1]):
            if not left:
                break
            left -= self._fits(self.steps[left - 1], element)
        return not left


class _Reader(HTMLParser):
    """One pass over a page: values of all selectors, each by its first element.

    An element's text is its own first, and then that of its children in turn.
    """

    def __init__(self, selectors: dict[str, Selector]):
        super().__init__(convert_charrefs=True)
        self._open, self._waiting, self._reading, self.values = [], dict(selectors), [], {}

    def handle_starttag(self, tag, attrs):
        known = {k: v or "" for k, v in attrs}
        siblings = self._open[-1][4] if self._open else []
        siblings.append(tag)
        self._open.append((tag, {known["id"]} if known.get("id") else set(), set(known.get("class", "").split()), len(siblings), []))
        for field, selector in [(f, s) for f, s in self._waiting.items() if s.matches(self._open)]:
            del self._waiting[field]
            if selector.attribute is None:
                self._reading.append((len(self._open), field, []))
            else:
                self.values[field] = known.get(selector.attribute)
        if tag in VOID:
            self._close(len(self._open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self._open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] == tag:
                self._close(depth)
                break

    def handle_data(self, data):
        for depth, _, parts in self._reading:
            if not any(e[0] in UNSEEN for e in self._open[depth:]):
                parts.append((tuple(e[3] for e in self._open[depth:]), len(parts), data))

    def _close(self, depth: int) -> None:
        """The elements from ``depth`` on end."""
        for at, field, parts in [r for r in self._reading if r[0] > depth]:
            self.values[field] = " ".join("".join(text for _, _, text in sorted(parts)).split())
        self._reading = [r for r in self._reading if r[0] <= depth]
        del self._open[depth:]

    def finish(self) -> dict:
        self.close()
        self._close(0)
        return {k: v for k, v in self.values.items() if v}


def _css_values(body: Column, selectors: dict[str, str]) -> Column:
    """A map of the values of all selectors, in one parse of the page."""
    compiled = {field: Selector(s) for field, s in selectors.items()}

    @F.pandas_udf("map<string,string>")
    def read(bodies: pd.Series) -> pd.Series:
        def of(body):
            if not body:
                return {}
            reader = _Reader(compiled)
            reader.feed(body)
            return reader.finish()

        return bodies.map(of)

    return read(body)


def extract_css(df: DataFrame, selectors: dict[str, str], *keys: str) -> DataFrame:
    """EXT-05: ``(keys, field, value)`` of the first element of each selector; one parse a page."""
    return df.select(*keys, F.explode(_css_values(F.col("body"), selectors)).alias("field", "value"))


# all extractors

#: Where the heuristic looks for a title, best first.
HEURISTIC = ("h1", "title")


def with_values(df: DataFrame, extractors: list[dict], wanted: set[str] | None = None) -> DataFrame:
    """``df`` with ``values``: what every extractor of a profile found of the ``wanted`` fields (default: all), in its declared order.

    An extractor is ``{"kind": ..., "fields": ...}``: json, json_ld (and ``type``),
    app_state, meta, css or heuristic. ``df`` has ``body`` and ``content_kind``; a BINARY
    body is never parsed, and json reads JSON bodies only. A page is one row from its scan
    to here: its markup is parsed once, for the selectors of all extractors.
    """
    known = [str(e["kind"]) for e in extractors]
    for kind in known:
        if kind not in ("json", "json_ld", "app_state", "meta", "css", "heuristic"):
            raise ValueError(f"no such extractor: {kind!r}")
    body = F.col("_body")
    selectors = {f"{n} {field}": s for n, e in enumerate(extractors) if e["kind"] == "css" for field, s in e.get("fields", {}).items()}
    selectors |= {f"heuristic {tag}": tag for tag in HEURISTIC if "heuristic" in known}
    # what is read more than once gets a column of its own, so that it is computed once
    read, helpers = df.withColumn("_body", F.when(F.col("content_kind") != "BINARY", F.col("body"))), {"_body"}

    def keep(**columns: Column) -> None:
        nonlocal read
        read = read.withColumns(columns)
        helpers.update(columns)

    if selectors:
        keep(_css=_css_values(body, selectors))
    if "json" in known:
        keep(_json=whole_json(F.when(F.col("content_kind") == "JSON", body)))
    if {"app_state", "json_ld"} & set(known):
        keep(_scripts=_scripts(body))
    if "meta" in known:
        keep(_meta=_meta_tags(body))
    if "app_state" in known:
        keep(_state_text=_state(F.col("_scripts")))
        keep(_state=whole_json(F.col("_state_text")))
    if "json_ld" in known:
        keep(_things=_linked_data(F.col("_scripts")))
        keep(**{f"_thing{n}": _of_kind(F.col("_things"), e.get("type")) for n, e in enumerate(extractors) if e["kind"] == "json_ld"})
    found = []
    for n, e in enumerate(extractors):
        kind, fields = e["kind"], e.get("fields", {})
        if kind == "json":
            values = _json_values(F.col("_json"), fields)
        elif kind == "json_ld":
            values = _ld_values(F.col(f"_thing{n}"), list(fields))
        elif kind == "app_state":
            values = _json_values(F.col("_state"), fields)
        elif kind == "meta":
            values = _meta_values(F.col("_meta"), {f: (names,) if isinstance(names, str) else tuple(names or META_NAMES.get(f, (f,))) for f, names in dict(fields).items()})
        elif kind == "css":
            values = {field: F.try_element_at("_css", F.lit(f"{n} {field}")) for field in fields}
        else:
            values = {"title": F.coalesce(*[F.try_element_at("_css", F.lit(f"heuristic {tag}")) for tag in HEURISTIC])}
        values = {field: value for field, value in values.items() if wanted is None or field in wanted}
        source = {"json": "json_path"}.get(kind, kind)
        found.append(F.transform(_listed(values), lambda x: F.struct(x["field"].alias("field"), F.lit(n + 1).alias("position"), F.lit(source).alias("source"), x["value"].alias("value"))))
    whole = F.filter(F.concat(*found), lambda x: x["value"] != "")
    return read.withColumn("values", whole).drop(*sorted(helpers))


def extractor_values(df: DataFrame, extractors: list[dict], *keys: str) -> DataFrame:
    """``(keys, field, position, source, value)`` of every extractor of a profile, in its declared order."""
    return _exploded(with_values(df, extractors), F.col("values"), *keys)


def _of_field(field: str) -> Column:
    return F.filter("values", lambda x: x["field"] == field)


def page_fields(df: DataFrame, extractors: list[dict], *keys: str) -> DataFrame:
    """EXT-07 in one pass: ``(keys, field, value, source)``, per field that of the first extractor that has one."""
    fields = sorted({f for e in extractors for f in e.get("fields", {})} | {"title" for e in extractors if e["kind"] == "heuristic"})
    first = F.array(*[F.get(_of_field(f), 0) for f in fields])
    return _exploded(with_values(df, extractors), F.filter(first, lambda x: x.isNotNull()), *keys).select(*keys, "field", "value", "source")


def page_quorum(df: DataFrame, extractors: list[dict], fields: list[str], *keys: str) -> DataFrame:
    """EXT-08 in one pass: agreement of the extractors on each wanted field; the first value stands."""
    each = []
    for field in fields:
        own = _of_field(field)
        texts = F.array_distinct(F.transform(own, lambda x: x["value"]))
        agreement = F.when(F.size(own) == 0, "missing").when(F.size(texts) > 1, "conflict").when(F.size(own) > 1, "high").otherwise("medium")
        each.append(F.struct(F.lit(field).alias("field"), agreement.alias("agreement"), F.size(own).cast("long").alias("sources"), F.get(own, 0)["value"].alias("value")))
    return _exploded(with_values(df, extractors), F.array(*each), *keys)


def first_values(values: DataFrame, *keys: str) -> DataFrame:
    """EXT-07 of values that are rows already: per field that of the first extractor that has one, and its source."""
    return values.groupBy(*keys, "field").agg(F.min_by("value", "position").alias("value"), F.min_by("source", "position").alias("source"))


# values and facts


@F.pandas_udf(T.StringType())
def unescaped(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def clean_text(value: Column) -> Column:
    """Entities read, control and format characters gone, white space (fixed blanks too) as single spaces."""
    text = F.when(F.contains(value, F.lit("&")), unescaped(value)).otherwise(value)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{C}&&[^\t\n]]", ""), r"(?U)\s+", " "))


#: How a moment may be written besides ISO 8601: as in mail, without the day of the week.
MAIL_DATES = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")


def clean_date(value: Column) -> Column:
    """A moment as ISO 8601 in UTC, in which a time without a zone is taken to be; other texts cleaned."""
    text = clean_text(value)
    mail = F.regexp_replace(F.regexp_replace(text, "^[A-Za-z]{3},? *", ""), " (GMT|UTC?|Z|-0000)$", " +0000")
    zoned = F.coalesce(*[F.try_to_timestamp(mail, F.lit(f)) for f in MAIL_DATES], F.when(text.rlike(r"[0-9](?:Z|[+-][0-9]{2}:?[0-9]{2})$"), text.try_cast("timestamp")))
    plain = F.when(zoned.isNull() & text.rlike("^[0-9]{4}-"), text.try_cast("timestamp_ntz"))
    moment = F.coalesce(F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz"), plain)
    return F.when(moment.isNull(), text).otherwise(F.concat(F.regexp_replace(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "[.]0+$", ""), F.lit("+00:00")))


@F.pandas_udf(T.StringType())
def absolute(links: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else urljoin(b or "", x.strip()) for x, b in zip(links, bases, strict=True)], dtype=object)


def clean_number(value: Column) -> Column:
    """Digits before and after the last of comma and dot, if a comma comes last; else commas only group."""
    kept = F.regexp_replace(value, r"[^0-9,.\-]", "")
    turned = F.reverse(kept)
    comma, dot = F.instr(turned, F.lit(",")), F.instr(turned, F.lit("."))
    comma_last = (comma > 0) & ((dot == 0) | (comma < dot))
    # a comma that comes last is the point: the dots before it group
    as_point = F.translate(kept, ",.", ".")
    return F.when(comma_last, as_point).otherwise(F.translate(kept, ",", "")).try_cast("double").cast("string")


def normalize_values(values: DataFrame, kinds: dict[str, str], base: str | None = None) -> DataFrame:
    """PRJ-16: ``value`` by the declared kind of its ``field``: text (default), number, url, date or raw."""
    of = lambda kind: F.col("field").isin([f for f, k in kinds.items() if k == kind])
    bases = F.col(base) if base else F.lit("")
    value = F.when(of("raw"), F.col("value")).when(of("number"), clean_number(F.col("value"))).when(of("url"), absolute("value", bases)).when(of("date"), clean_date(F.col("value"))).otherwise(clean_text(F.col("value")))
    return values.withColumn("value", value)


@F.pandas_udf(T.ArrayType(T.StringType()))
def all_absolute(links: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([[None if x is None else urljoin(b or "", x.strip()) for x in own] for own, b in zip(links, bases, strict=True)], dtype=object)


def page_facts(df: DataFrame, *keys: str) -> DataFrame:
    """PRJ-25: canonical address, feeds, AMP page, types of linked data, OpenGraph names, state and API hints of a page.

    ``df`` has body and url. Hints are same-site addresses with ``/api/`` or ``graphql`` in
    them, without their query, sorted, 20 at most. A page is one row all the way; null
    bodies have no facts.
    """
    body = F.coalesce("body", F.lit(""))
    tags = F.regexp_extract_all(body, F.lit(r"(?i)<link\b([^>]*)>"), F.lit(1))
    links = F.transform(tags, lambda t: F.struct(F.split(F.lower(F.coalesce(_attribute(t, "rel"), F.lit(""))), r"\s+").alias("rel"), F.lower(F.coalesce(_attribute(t, "type"), F.lit(""))).alias("kind"), _attribute(t, "href").alias("href")))
    links = F.filter(links, lambda x: x["href"].isNotNull())
    of = lambda rel: F.transform(F.filter(F.col("_links"), lambda x: F.array_contains(x["rel"], rel)), lambda x: x["href"])
    feeds = F.transform(F.filter(F.col("_links"), lambda x: F.array_contains(x["rel"], "alternate") & x["kind"].isin("application/rss+xml", "application/atom+xml")), lambda x: x["href"])
    quoted = F.array_distinct(F.regexp_extract_all(body, F.lit(r"""["']((?:https?:/)?/[^"'\s<>]*(?:/api/|graphql)[^"'\s<>]*|/api/[^"'\s<>]*)["']"""), F.lit(1)))
    read = df.withColumn("_links", links).withColumn("_feeds", feeds).withColumn("_all", all_absolute(F.concat(F.array(F.get(of("canonical"), 0), F.get(of("amphtml"), 0)), F.col("_feeds"), quoted), "url"))
    graph = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"""(?i)<meta\b[^>]*?(?:property|name)\s*=\s*["'](og:[\w:.-]+)"""), F.lit(1)), F.lower)))
    states = F.array(*[F.when(F.contains(body, F.lit(f"__{n}__")), F.lit(n)) for n in ("NEXT_DATA", *STATE_NAMES)])
    types = F.filter(F.flatten(F.transform(_linked_data(_scripts(body)), _types)), lambda t: t.isNotNull())
    host = lambda u: F.lower(F.regexp_extract(u, "^[A-Za-z]+://([^/?#:]+)", 1))
    site = lambda u: F.array_join(F.slice(F.split(host(u), "[.]"), -F.least(F.size(F.split(host(u), "[.]")), F.lit(2)), F.lit(2)), ".")
    n_feeds = F.size("_feeds")
    hints = F.transform(F.slice("_all", n_feeds + 3, F.size("_all")), lambda u: F.regexp_replace(u, "[?#].*$", ""))
    hints = F.slice(F.array_sort(F.array_distinct(F.filter(hints, lambda u: site(u) == site(F.col("url"))))), 1, 20)
    return read.select(
        *keys, F.get("_all", 0).alias("canonical"), F.array_sort(F.array_distinct(F.slice("_all", F.lit(3), n_feeds))).alias("feeds"), F.get("_all", 1).alias("amp"), F.array_sort(F.array_distinct(types)).alias("types"),
        graph.alias("open_graph"), F.filter(states, lambda x: x.isNotNull()).alias("state"), hints.alias("api_hints"),
    )
