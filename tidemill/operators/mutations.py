"""Pages damaged on purpose, what a profile does about it, and user functions over pages.

A markup page is read into tags with their places; an edit cuts or inserts at such places
and leaves every other character as it was. A JSON page is parsed, edited and written.
All copies of a page are made together, from one parse, and only those that changed are
judged: a copy is one row from its page to its reaction.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import pages
from tidemill.operators.base import OPERATORS, SPARK
from tidemill.operators.bodies import content_kind

#: Keys behind which a cursor hides.
CURSORS = ("next", "next_cursor", "cursor", "next_page", "after", "continuation")
REMOVALS = ("remove_critical_field", "remove_optional_field")
#: Characters of damaged copies that a Python worker holds before it hands them over.
PIECE = 4_000_000
#: How a page can change.
KINDS = (*REMOVALS, "rename_css_class", "wrap_dom_node", "move_element", "rename_json_key", "empty_collection", "change_field_type", "remove_pagination_cursor")


class _Tags(HTMLParser):
    """Elements of a page: (tag, text of the start tag, start, end of the start tag, end)."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self._lines = [0]
        for m in re.finditer("\n", text):
            self._lines.append(m.end())
        self._open: list[int] = []
        self.elements: list[list] = []
        self._length = len(text)
        self.feed(text)
        self.close()
        self._close(0, len(text))

    def _place(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def _close(self, depth: int, end: int) -> None:
        for at in self._open[depth:]:
            self.elements[at][4] = end
        del self._open[depth:]

    def handle_starttag(self, tag, attrs):
        start, raw = self._place(), self.get_starttag_text() or ""
        if tag == "li" and self._open and self.elements[self._open[-1]][0] == "li":
            self._close(len(self._open) - 1, start)
        self.elements.append([tag, raw, start, start + len(raw), start + len(raw)])
        if tag not in pages.VOID and not raw.endswith("/>"):
            self._open.append(len(self.elements) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, -1, -1):
            if self.elements[self._open[depth]][0] == tag:
                start = self._place()
                self._close(depth + 1, start)
                self._close(depth, self._length if (end := self._rest.find(">", start)) < 0 else end + 1)
                break

    def feed(self, data):
        self._rest = data
        super().feed(data)


@lru_cache(maxsize=1)
def _elements(text: str) -> list[list]:
    """The elements of a page, which is parsed once for all its mutations; nobody changes them."""
    return _Tags(text).elements


@lru_cache(maxsize=1)
def _value(text: str):
    """The value of a JSON page, likewise; None stands for a text that is no JSON."""
    try:
        return (json.loads(text),)
    except (ValueError, RecursionError):
        return None


def _names(field: str) -> tuple[str, ...]:
    """A field's own name and those that linked data has for it."""
    return (field, *(k.split(".")[-1] for k in pages.LD_KEYS.get(field, ())))


def _walked(value, edit: Callable[[str, object], list[tuple[str, object]]]):
    """A JSON value in which ``edit`` says what stands for each member of each object."""
    if isinstance(value, list):
        return [_walked(x, edit) for x in value]
    if isinstance(value, dict):
        return {key: _walked(x, edit) if x is old else x for name, old in value.items() for key, x in edit(name, old)}
    return value


def _without(value, names: tuple[str, ...]):
    return _walked(value, lambda k, v: [] if k in names else [(k, v)])


def damage_json(text: str, kind: str, target: str) -> str:
    if (read := _value(text)) is None:
        return text
    (value,) = read
    if kind in REMOVALS and target:
        value = _without(value, (target,))
    elif kind == "remove_pagination_cursor":
        value = _without(value, (target,) if target else CURSORS)
    elif kind == "rename_json_key" and target:
        value = _walked(value, lambda k, v: [(f"{k}_v2" if k == target else k, v)])
    elif kind == "change_field_type" and target:
        retyped = lambda v: str(v) if isinstance(v, (int, float)) else {"value": v}
        value = _walked(value, lambda k, v: [(k, retyped(v) if k == target else v)])
    elif kind == "empty_collection" and isinstance(value, list):
        value = []
    elif kind == "empty_collection" and isinstance(value, dict):
        one = isinstance(value.get(target), list)
        value = {k: [] if isinstance(v, list) and (not one or k == target) else v for k, v in value.items()}
    else:
        return text
    return json.dumps(value)


def damage_markup(text: str, kind: str, target: str) -> str:
    word = re.compile(rf"(?i)(?<![\w-]){re.escape(target)}(?![\w-])") if target else None
    if kind == "rename_css_class" and word:
        return word.sub(lambda m: f"{m[0]}-v2", text)
    if kind not in (*REMOVALS, "wrap_dom_node", "move_element") or not word:
        return text
    elements = _elements(text)
    if kind == "move_element":
        own = [e for e in elements if e[0] == target.lower()]
        # the first element and the next one that does not lie inside it
        pair = own[:1] + [e for e in own if e[2] >= own[0][4]][:1]
        if len(pair) < 2:
            return text
        (_, _, a, _, b), (_, _, c, _, d) = pair
        return text[:a] + text[c:d] + text[b:c] + text[a:b] + text[d:]
    marked = [e for e in elements if e[0] != "script" and word.search(e[1])]
    if kind == "wrap_dom_node":
        if not marked:
            return text
        start, end = marked[0][2], marked[0][4]
        return f'{text[:start]}<div class="layout-wrapper">{text[start:end]}</div>{text[end:]}'
    # linked data is another source of the field, and goes too
    cuts = [(e[2], e[4], "") for e in marked[:1]]
    for _, raw, _, start, end in (e for e in elements if e[0] == "script" and "ld+json" in e[1].lower()):
        code = text[start:end]
        close = code.lower().rfind("</script")
        code = code[:close] if close >= 0 else code
        try:
            value = json.loads(code)
            fewer = _without(value, _names(target))
        except (ValueError, RecursionError):
            continue
        if fewer != value:
            cuts.append((start, start + len(code), json.dumps(fewer)))
    for start, end, instead in sorted(cuts, reverse=True):
        text = text[:start] + instead + text[end:]
    return text


def mutate_pages(df: DataFrame, mutations: list[tuple[str, str]], *keys: str) -> DataFrame:
    """EXT-11: ``(keys, mutation, kind, target, body, changed)``: a damaged copy of each page for each (kind, target).

    ``df`` has body and content_kind: JSON pages are edited as JSON, other text as markup; a
    binary or null body, or one in which there is nothing to damage, stays as it was. The
    same input gives the same copies. A page goes to Python once, and only copies that
    changed come back beside it, some of them at a time.
    """
    unknown = [kind for kind, _ in mutations if kind not in KINDS]
    if unknown or not mutations:
        raise ValueError(f"not mutations: {unknown or mutations!r}")

    def of(body, content) -> list:
        if body is None or content == "BINARY":
            return [None] * len(mutations)
        damage = damage_json if content == "JSON" else damage_markup
        copies = (damage(body, kind, target) for kind, target in mutations)
        return [None if copy == body else copy for copy in copies]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, copies, held = 0, [], 0
            for at, (body, content) in enumerate(zip(batch.column("body"), batch.column("content_kind"), strict=True)):
                copies.append(of(body.as_py(), content.as_py()))
                held += sum(len(copy) for copy in copies[-1] if copy)
                if held > PIECE or at == batch.num_rows - 1:
                    piece = batch.slice(start, len(copies)).drop_columns(["content_kind"])
                    yield piece.append_column("_copies", pa.array(copies, pa.list_(pa.string())))
                    start, copies, held = at + 1, [], 0

    known = df.select(*keys, "body", "content_kind")
    schema = T.StructType([f for f in known.schema if f.name != "content_kind"]).add("_copies", T.ArrayType(T.StringType()))
    copies = known.mapInArrow(run, schema).select("*", F.posexplode("_copies").alias("mutation", "_copy"))
    named = lambda place: F.get(F.array(*[F.lit(m[place]) for m in mutations]), F.col("mutation"))
    return copies.select(*keys, "mutation", named(0).alias("kind"), named(1).alias("target"), F.coalesce("_copy", "body").alias("body"), F.col("_copy").isNotNull().alias("changed"))


def default_mutations(importance: dict[str, str], classes: list[str], paged: bool, is_json: bool) -> list[tuple[str, str]]:
    """The mutations that say something about a URL class, from what it declares."""
    critical, optional = ([f for f, i in importance.items() if i == x] for x in ("critical", "optional"))
    out = [("remove_critical_field", f) for f in critical] + [("remove_optional_field", f) for f in optional]
    if is_json:
        out += [(kind, f) for f in critical for kind in ("rename_json_key", "change_field_type")] + [("empty_collection", "")]
    else:
        out += [(kind, c) for c in classes for kind in ("rename_css_class", "wrap_dom_node")] + [("move_element", "li")]
    return out + ([("remove_pagination_cursor", "")] if paged else [])


def evaluate_pages(df: DataFrame, evaluate: Callable[[dict], dict], schema: str, *keys: str) -> DataFrame:
    """UDF-01: ``(keys, <schema>, error)``: a user's function of one page (a row of ``df`` as a dict), over Arrow batches.

    What the function returns is read by the names of ``schema``; a name that it leaves
    out is null. A page on which it fails has null values and the failure's text, and ends
    neither its batch nor the job. The columns of ``schema`` and ``keys`` have to differ.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                try:
                    found = dict(evaluate(row) or {})
                    out.append([*(row[k] for k in keys), *(found.get(n) for n in names), None])
                except Exception as e:  # noqa: BLE001 - one bad page is reported, whatever is wrong with it
                    out.append([*(row[k] for k in keys), *(None for _ in names), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(out, columns=[*keys, *names, "error"], dtype=object)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema, "error string"]))


def profile_reactions(damaged: DataFrame, rules: DataFrame, extractors: list[dict], importance: dict[str, str], *keys: str) -> DataFrame:
    """``(keys, mutation, kind, target, changed, observed)``: how triage and extraction react to each damaged page.

    A copy that nothing was damaged in survives. A verdict other than OK is drift, empty,
    incomplete or a failure by what was damaged; else the declared fields decide: all there
    survives, a critical one lost fails, an optional one lost warns. ``damaged`` has url.
    Triage reads only copies that changed, and the extractors only those that it lets pass.
    """
    # all that is known of a copy passes triage as its key: what is judged later needs no join
    own = lambda name: F.when(F.col("changed"), F.col(name)).alias(name)
    one = F.struct(*keys, "mutation", "kind", "target", "changed", own("body")).alias("page_id")
    responses = damaged.select(one, own("url"), F.lit(200).alias("status"), F.lit("").alias("content_type"), F.lit(None).cast("string").alias("cf_mitigated"), F.lit("target").alias("source"), F.lit(None).cast("string").alias("transport_error"), F.lit(None).cast("string").alias("retry_after"), own("body"))
    triaged = OPERATORS["triage_responses"](damaged.sparkSession, responses=responses, rules=rules).select("page_id.*", "verdict")
    good = triaged.withColumn("body", F.when(F.col("verdict") == "OK", F.col("body")))
    found = F.array_distinct(F.transform("values", lambda v: v["field"]))
    fields = pages.with_values(good.withColumn("content_kind", F.expr(content_kind(SPARK, "body", "''"))), extractors, set(importance))
    lost = lambda *levels: F.size(F.array_except(F.array(*[F.lit(f) for f, i in importance.items() if i in levels]).cast("array<string>"), found)) > 0
    by_kind = F.when(F.col("kind").isin("rename_json_key", "change_field_type"), "DRIFT").when(F.col("kind") == "empty_collection", "EMPTY").when(F.col("kind") == "remove_pagination_cursor", "INCOMPLETE").otherwise("FAILS")
    observed = F.when(~F.col("changed"), "SURVIVES").when(F.col("verdict") != "OK", by_kind).when(lost("critical"), "FAILS").when(lost(*importance.values()), "WARNS").otherwise("SURVIVES")
    # joins on a reaction look for where it comes from; unfolded through all columns that it is made of, that takes the planner half a minute
    return fields.select(*keys, "mutation", "kind", "target", "changed", F.explode_outer(F.array(observed)).alias("observed"))
