"""Operators: tables in, a table out, each one declared as a relational expression.

An operator's text names its inputs as ``@name``. ``Operator.__call__`` binds the names
to DataFrames and gives Spark the whole expression to optimise; nothing is collected.
``Dialect`` holds the few spellings in which Spark and the test oracle differ.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_numbers = itertools.count()


class Dialect:
    """Spark's spellings."""

    duck = False

    def rx(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    def sub(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', r'{by}')"

    def ext(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def epoch(self, ts: str) -> str:
        return f"(unix_micros(CAST({ts} AS TIMESTAMP)) / 1000000.0D)"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def octets(self, x: str) -> str:
        return f"octet_length({x})"

    def last_known(self, x: str) -> str:
        """The last value that is not null, as a window function without its OVER."""
        return f"last_value({x}) IGNORE NULLS"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '{path}')"

    def json_by(self, x: str, path: str) -> str:
        """The value at a path that is itself a column; ``x`` has to be JSON."""
        return f"get_json_object({x}, {path})"

    def hex_number(self, x: str) -> str:
        return f"CAST(conv({x}, 16, 10) AS BIGINT)"

    def json_type(self, x: str, key: str) -> str:
        """Type of a top-level value: null, bool, int, float, str, list or dict."""
        kind = f"schema_of_variant(try_variant_get(try_parse_json({x}), '$.{key}', 'variant'))"
        return f"CASE WHEN {self.json(x, '$.' + key)} IS NULL THEN 'null' WHEN {kind} = 'STRING' THEN 'str' WHEN {kind} = 'BOOLEAN' THEN 'bool' WHEN {kind} LIKE 'ARRAY%' THEN 'list' WHEN {kind} LIKE 'OBJECT%' THEN 'dict' WHEN {kind} = 'BIGINT' THEN 'int' ELSE 'float' END"

    def json_keys(self, x: str) -> str:
        """Rows: the top-level keys of a JSON object."""
        return f"explode(json_object_keys({x}))"

    def joined(self, x: str, distinct: bool = False) -> str:
        return f"array_join(sort_array(collect_{'set' if distinct else 'list'}({x})), ',')"

    def count_matches(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, r'{pattern}')"

    def found(self, x: str, pattern: str, group: int = 0) -> str:
        """All matches of a pattern, as an array."""
        return f"regexp_extract_all({x}, r'{pattern}', {group})"

    def among(self, array: str, test: Callable[[str], str]) -> str:
        """The elements that pass a test."""
        return f"filter({array}, t -> {test('t')})"

    def some(self, array: str, test: Callable[[str], str]) -> str:
        """Whether an element passes a test."""
        return f"exists({array}, t -> {test('t')})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def pieces(self, x: str, separator: str) -> str:
        """A text cut at a literal separator."""
        return f"split({x}, r'\\Q{separator}\\E')"

    def from_end(self, array: str, place: int) -> str:
        """An element counted from the end, from 1; null if there is none."""
        return f"try_element_at({array}, -{place})"

    def mapped(self, array: str, value: Callable[[str], str]) -> str:
        return f"transform({array}, t -> {value('t')})"

    def pair(self, first: str, second: str) -> str:
        return f"struct({first} AS a, {second} AS b)"

    def ordered(self, array: str) -> str:
        return f"sort_array({array})"

    def glued(self, array: str, separator: str) -> str:
        return f"array_join({array}, '{separator}')"

    def folded(self, array: str, step: Callable[[str, str], str]) -> str:
        """A text made from texts, one after the other, from an empty one on."""
        return f"aggregate({array}, '', (acc, t) -> {step('acc', 't')})"

    def decoded(self, x: str) -> str:
        """A form value as it was meant; as it stands where that can't be read."""
        return f"coalesce(try_url_decode({x}), {x})"

    def encoded(self, x: str) -> str:
        """A text as a form value: letters, digits and ``_.-~`` stay, spaces become ``+``."""
        return f"replace(replace(url_encode({x}), '%7E', '~'), '*', '%2A')"

    def at(self, array: str, place: int) -> str:
        """An element counted from 1; null if there is none."""
        return f"get({array}, {place - 1})"

    def whole_json(self, x: str) -> str:
        """Whether a text is one JSON value and nothing else: it has to parse inside a list and inside an object."""
        return f"""(try_parse_json(concat('{{"v":', {x}, '}}')) IS NOT NULL AND try_variant_get(try_parse_json(concat('[', {x}, ']')), '$[0]', 'variant') IS NOT NULL)"""

    def try_double(self, x: str) -> str:
        return f"try_cast({x} AS DOUBLE)"

    def split_rows(self, table: str, keep: str, x: str, sep: str) -> str:
        """Rows ``(keep, part, pos)``, pos from 1."""
        return f"SELECT {keep}, part, CAST(pos + 1 AS BIGINT) AS pos FROM {table} LATERAL VIEW posexplode(split({x}, r'{sep}')) p AS pos, part"

    def all_rows(self, table: str, keep: str, x: str, pattern: str) -> str:
        """Rows ``(keep, part, pos)`` for every match of a pattern, pos from 1."""
        return f"SELECT {keep}, part, CAST(pos + 1 AS BIGINT) AS pos FROM {table} LATERAL VIEW posexplode(regexp_extract_all({x}, r'{pattern}', 0)) p AS pos, part"


class Oracle(Dialect):
    """DuckDB's spellings, for tests."""

    duck = True

    def rx(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def sub(self, x, pattern, by):
        return f"regexp_replace({x}, '{pattern}', '{re.sub(r'[$]([0-9])', r'\\\1', by)}', 'g')"

    def ext(self, x, pattern, group=1):
        return f"regexp_extract({x}, '{pattern}', {group})"

    def epoch(self, ts):
        return f"(epoch_us({ts}) / 1000000.0)"

    def sha(self, x):
        return f"sha256({x})"

    def octets(self, x):
        return f"strlen({x})"

    def last_known(self, x):
        return f"last_value({x} IGNORE NULLS)"

    def json(self, x, path):
        return f"json_extract_string({x}, '{path}')"

    def json_by(self, x, path):
        return f"json_extract_string({x}, {path})"

    def hex_number(self, x):
        return f"CAST(concat('0x', {x}) AS BIGINT)"

    def json_type(self, x, key):
        kind = f"json_type({x}, '$.{key}')"
        return f"CASE WHEN {self.json(x, '$.' + key)} IS NULL THEN 'null' WHEN {kind} = 'VARCHAR' THEN 'str' WHEN {kind} = 'BOOLEAN' THEN 'bool' WHEN {kind} = 'ARRAY' THEN 'list' WHEN {kind} = 'OBJECT' THEN 'dict' WHEN {kind} IN ('UBIGINT', 'BIGINT') THEN 'int' ELSE 'float' END"

    def json_keys(self, x):
        return f"unnest(json_keys({x}))"

    def joined(self, x, distinct=False):
        return f"coalesce(string_agg({'DISTINCT ' if distinct else ''}{x}, ',' ORDER BY {x}), '')"

    def count_matches(self, x, pattern):
        return f"len(regexp_extract_all({x}, '{pattern}'))"

    def found(self, x, pattern, group=0):
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    def among(self, array, test):
        return f"list_filter({array}, lambda t: {test('t')})"

    def some(self, array, test):
        return f"(len({self.among(array, test)}) > 0)"

    def size(self, array):
        return f"len({array})"

    def pieces(self, x, separator):
        return f"string_split({x}, '{separator}')"

    def from_end(self, array, place):
        return f"{array}[-{place}]"

    def mapped(self, array, value):
        return f"list_transform({array}, lambda t: {value('t')})"

    def pair(self, first, second):
        return f"struct_pack(a := {first}, b := {second})"

    def ordered(self, array):
        return f"list_sort({array})"

    def glued(self, array, separator):
        return f"array_to_string({array}, '{separator}')"

    def folded(self, array, step):
        return f"list_reduce(list_prepend('', {array}), lambda acc, t: {step('acc', 't')})"

    def decoded(self, x):
        return f"url_decode(replace({x}, '+', ' '))"

    def encoded(self, x):
        return f"replace(url_encode({x}), '%20', '+')"

    def at(self, array, place):
        return f"{array}[{place}]"

    def whole_json(self, x):
        return f"coalesce(json_valid({x}), FALSE)"

    def try_double(self, x):
        return f"TRY_CAST({x} AS DOUBLE)"

    def split_rows(self, table, keep, x, sep):
        return f"SELECT {keep}, p.part AS part, CAST(p.pos AS BIGINT) AS pos FROM (SELECT *, string_split_regex({x}, '{sep}') AS parts FROM {table}) t, LATERAL (SELECT unnest(t.parts) AS part, generate_subscripts(t.parts, 1) AS pos) p"

    def all_rows(self, table, keep, x, pattern):
        return f"SELECT {keep}, p.part AS part, CAST(p.pos AS BIGINT) AS pos FROM (SELECT *, regexp_extract_all({x}, '{pattern}') AS parts FROM {table}) t, LATERAL (SELECT unnest(t.parts) AS part, generate_subscripts(t.parts, 1) AS pos) p"


SPARK, DUCK = Dialect(), Oracle()


@dataclass(frozen=True)
class Operator:
    """A named relational expression over named input tables."""

    name: str
    text: Callable[[Dialect], str]
    inputs: tuple[str, ...]
    doc: str = field(default="", compare=False)

    def __call__(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        missing = set(self.inputs) - tables.keys()
        if missing:
            raise TypeError(f"{self.name} needs the tables {sorted(missing)}")
        sql, views = self.text(SPARK), []
        for name in self.inputs:
            view = f"_{name}_{next(_numbers)}"
            tables[name].createOrReplaceTempView(view)
            views.append(view)
            sql = re.sub(rf"@{name}\b", view, sql)
        try:
            return spark.sql(sql)
        finally:
            for view in views:
                spark.catalog.dropTempView(view)


OPERATORS: dict[str, Operator] = {}


def operator(*inputs: str):
    """Register the decorated text builder as an operator over ``inputs``."""

    def register(text: Callable[[Dialect], str]) -> Operator:
        op = Operator(text.__name__, text, inputs, text.__doc__ or "")
        OPERATORS[op.name] = op
        return op

    return register
