"""Personal data: candidate generators, boosted trees, calibrated thresholds.

Fixed forms (email, ip, card, phone) give the base spans. Looser generators propose more
spans, which may overlap; gradient-boosted trees score them by their format and context;
a threshold calibrated on held-out texts selects those that are added. No candidate
beside the base spans has a label, so the trees learn from the base spans of all
texts, written as people write them around filters (``name at host dot org``, numbers
without their plus or with other separators), against what the generators find elsewhere
in these texts, and against dates, counts and sentences made from them. The trees are
applied as plain SQL conditions: everything runs on DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import stored

#: Base forms. Possessive repeats give the same matches without backtracking; an e-mail
#: can't begin inside a run of its own characters, except where a match has just ended.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: written-out e-mail signs, and runs of digit groups.
LOOSE = {
    "contact": r"[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20|@)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+)++",
    "number": r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,40}+",
}
#: What a text must hold for a form to match at all.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][0-9 -][0-9]", "phone": "\\+[0-9]", "contact": "@|\\bat\\b", "number": "[0-9]"}
CONTEXT_WORDS = "(?i)mail|phone|tel|call|mobile|fax|card|visa|account|addr|host|server|ssn|contact"
BLOCK = 256


def _lengths(text: Column, form: str, needs: str) -> tuple[Column, Column]:
    """Matches of a form, and the lengths of what stands before each of them."""
    there = text.rlike(needs)
    found = F.when(there, F.regexp_extract_all(text, F.lit(f"({form})"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    before = F.when(there, F.transform(F.split(text, form, -1), F.length)).otherwise(F.array().cast("array<int>"))
    return found, before


def _running(steps: Column) -> Column:
    """Sums of the steps up to each place, by blocks so that long arrays stay linear."""

    def sums(part: Column, first: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), F.lit(2), F.greatest(F.size(part), F.lit(1)))

    blocks = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<int>>"))
    totals = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x))
    firsts = F.aggregate(totals, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.flatten(F.transform(blocks, lambda part, b: sums(part, F.element_at(firsts, b + 1))))


def _spans(found: str, before: str, ends: str) -> Column:
    """``array<struct<start, end, text>>``; ``ends`` are running sums of gap plus match."""
    return F.transform(found, lambda m, k: F.struct((F.element_at(F.col(ends), k + 1) - F.length(m)).alias("start"), F.element_at(F.col(ends), k + 1).alias("end"), m.alias("text")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda v, k: F.when(k % 2 == 1, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


OCTETS = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}$"
VALID = {
    "email": None,
    "ip": lambda t: t.rlike(OCTETS),
    "card": lambda t: F.length(_digits(t)).between(16, 19) & luhn(_digits(t)),
    "phone": lambda t: F.length(_digits(t)).between(8, 15),
}


def _where(spans: str, valid) -> Column:
    return F.filter(spans, lambda s: valid(s["text"]))


def find_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with, for each form, an array column ``s_<form>`` of its valid spans."""
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    forms = BASE | LOOSE
    found = {k: _lengths(F.col("_text"), form, NEEDS[k]) for k, form in forms.items()}
    out = out.withColumns({f"_m_{k}": m for k, (m, _) in found.items()} | {f"_b_{k}": b for k, (_, b) in found.items()})
    out = out.withColumns({f"_e_{k}": F.zip_with(F.col(f"_m_{k}"), F.slice(f"_b_{k}", F.lit(1), F.size(f"_m_{k}")), lambda m, b: F.length(m) + b) for k in forms})
    out = out.withColumns({f"_e_{k}": _running(F.col(f"_e_{k}")) for k in forms})
    spans = {f"s_{k}": _spans(f"_m_{k}", f"_b_{k}", f"_e_{k}") for k in forms}
    out = out.withColumns(spans).drop(*[f"_{x}_{k}" for x in "mbe" for k in forms])
    return out.withColumns({f"s_{k}": _where(f"s_{k}", ok) for k, ok in VALID.items() if ok})


def features(span: Column, text: Column) -> dict[str, Column]:
    """Format and context of a candidate, as numbers."""
    own = span["text"]
    near = F.substring(text, F.greatest(F.lit(1), span["start"] - 23), F.least(span["start"], F.lit(24)))
    digits = _digits(own)
    as_number = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": F.length(own).cast("double"),
        "digits": F.length(digits).cast("double"),
        "letters": F.length(F.regexp_replace(own, "[^A-Za-z]", "")).cast("double"),
        "dots": (F.length(own) - F.length(F.replace(own, F.lit("."), F.lit("")))).cast("double"),
        "gaps": F.length(F.regexp_replace(own, r"[^\x20()\-/]", "")).cast("double"),
        "plus": as_number(own.startswith("+")),
        "at": as_number(F.contains(own, F.lit("@"))),
        "luhn": as_number(F.length(digits).between(12, 19) & luhn(digits)),
        "octets": as_number(own.rlike(OCTETS)),
        "context": as_number(near.rlike(CONTEXT_WORDS)),
        "glued": as_number(near.rlike(r"[A-Za-z0-9_.]$")),
        "groups": F.size(F.regexp_extract_all(own, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        "last": F.length(F.regexp_extract(own, "([0-9]*)$", 1)).cast("double"),
        "date": as_number(own.rlike(r"^(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}")),
        "host": as_number(own.rlike(r"(?i)(?:\.|dot[\])]?\x20?)(?:com|org|net|edu|gov|info|io|eu|uk|de|fr|es|it|nl)$")),
        "written": as_number(own.rlike(r"[\[(](?:at|dot)[\])]|\x20dot\x20")),
    }


def _one_of(span: Column, *forms: Column) -> Column:
    """The span with its text in one of some forms, by a hash of what it is."""
    pick = F.pmod(F.xxhash64(span["text"]), F.lit(len(forms))).cast("int") + 1
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.element_at(F.array(*forms), pick).alias("text"))


def _rewritten_email(s: Column) -> Column:
    name, host = F.regexp_extract(s["text"], "^([^@]*)@", 1), F.regexp_extract(s["text"], "@(.*)$", 1)
    dotted = lambda by: F.regexp_replace(host, "[.]", by)
    return _one_of(s, F.concat(name, F.lit(" at "), dotted(" dot ")), F.concat(name, F.lit("[at]"), dotted("[dot]")), F.concat(name, F.lit(" (at) "), host))


def _rewritten_phone(s: Column) -> Column:
    digits = _digits(s["text"])
    grouped = F.regexp_replace(F.right(digits, F.lit(10)), "^([0-9]{3})([0-9]{3})", "$1-$2-")
    return _one_of(s, F.regexp_replace(s["text"], r"^\+[0-9]+\x20?", ""), grouped, F.concat(F.lit("00"), digits))


def _rewritten_card(s: Column) -> Column:
    by = lambda gap: F.regexp_replace(_digits(s["text"]), "([0-9]{4})(?=[0-9])", f"$1{gap}")
    return _one_of(s, by("."), by("/"), by(" - "))


def _made_up(text: Column) -> Column:
    """A date, a count, a long fraction and a sentence with ``at``, at a place of the text."""
    h = F.xxhash64(text)
    number = lambda k, n: F.right(F.abs(F.xxhash64(F.lit(k), text)).cast("string"), F.lit(n))
    two = lambda k, most: F.lpad((F.pmod(F.xxhash64(F.lit(k), text), F.lit(most)) + 1).cast("string"), 2, "0")
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))
    word = lambda k: F.coalesce(F.get(words, F.pmod(F.xxhash64(F.lit(k), text), F.greatest(F.size(words), F.lit(1))).cast("int")), F.lit("of"))
    forms = [
        F.concat(F.lit("20"), two(1, 29), F.lit("-"), two(2, 12), F.lit("-"), two(3, 28)),
        F.concat(two(4, 28), F.lit("/"), two(5, 12), F.lit("/19"), two(6, 98)),
        number(7, 7),
        number(8, 12),
        F.concat(F.lit("0."), number(9, 9)),
        F.regexp_replace(F.concat(F.lit("1"), number(10, 9)), "([0-9])(?=(?:[0-9]{3})+$)", "$1 "),
        F.concat(word(11), F.lit(" at "), word(12), F.lit("."), word(13)),
    ]
    start = F.pmod(h, F.greatest(F.length(text) - 40, F.lit(1))).cast("int")
    return F.array(*[F.struct(start.alias("start"), (start + F.length(f)).alias("end"), f.alias("text")) for f in forms])


def _examples(found: DataFrame, *keep: str) -> DataFrame:
    """One row per labelled candidate with its features: rewritten base spans are 1, the rest 0."""
    base = F.concat(*[F.col(f"s_{k}") for k in BASE])
    each = found.withColumn("_base", base)
    beside = F.filter(F.concat(*[F.col(f"s_{k}") for k in LOOSE]), lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    right = F.concat(F.transform("s_email", _rewritten_email), F.transform("s_phone", _rewritten_phone), F.transform("s_card", _rewritten_card))
    marked = lambda spans, label: F.transform(spans, lambda c: F.struct(c.alias("c"), F.lit(label).alias("label")))
    each = each.withColumn("_e", F.explode(F.concat(marked(right, 1.0), marked(beside, 0.0), marked(_made_up(F.col("_text")), 0.0))))
    return each.select(*keep, F.col("_e.label").alias("label"), *[v.alias(k) for k, v in features(F.col("_e.c"), F.col("_text")).items()])


def _as_sql(node, names: list[str]) -> str:
    if node.subtreeDepth() == 0:
        return repr(float(node.prediction()))
    split = node.split()
    return f"CASE WHEN {names[split.featureIndex()]} <= {float(split.threshold())!r} THEN {_as_sql(node.leftChild(), names)} ELSE {_as_sql(node.rightChild(), names)} END"


def _fitted(rows: DataFrame, names: list[str], trees: int, depth: int, seed: int) -> str:
    """Boosted trees over labelled candidates with weights, as SQL of the log odds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    # Spark reads the places of splits off all rows where they are no more than the square of the bins
    bins = max(32, math.isqrt(rows.count()) + 1)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=bins, weightCol="weight").fit(ready.select("features", "label", "weight"))
    return " + ".join(f"{2 * w!r} * ({_as_sql(t._java_obj.rootNode(), names)})" for t, w in zip(model.trees, model.treeWeights, strict=True))


def _feature_names() -> list[str]:
    return list(features(F.struct(F.lit(0).alias("start"), F.lit("").alias("text")), F.lit("")))


def train(docs: DataFrame, trees: int = 8, depth: int = 3, precision: float = 0.98, seed: int = 3) -> tuple[str, float] | None:
    """``(SQL of the log odds, threshold)``; None without candidates of both labels.

    The candidates of all documents with digits or an at sign count: elsewhere nothing
    is like a base span, so what is beside them says nothing. Candidates that agree in their features are one row
    with their number as its weight, so what the trees learn from grows with the kinds of
    candidates. Texts fall into halves by a hash. Each half is scored by trees that
    learned from the other half; the threshold is the lowest score from which the share
    of right candidates among all of them is at least ``precision``, and the log odds of
    ``precision`` itself where fewer than 20 reach it.
    """
    names = _feature_names()
    found = find_spans(docs.where(F.col("text").rlike("[0-9]{3}|@")).select("text", F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(2)).alias("_half")))
    rows = stored(_examples(found, "_half").groupBy("_half", "label", *names).agg(F.count("*").cast("double").alias("weight")))
    counts = {(r._half, r.label): r.n for r in rows.groupBy("_half", "label").agg(F.sum("weight").alias("n")).collect()}
    of_label = [sum(n for (_, label), n in counts.items() if label == x) for x in (0.0, 1.0)]
    if min(of_label) < 5:
        return None
    levels: dict[float, list[float]] = {}
    for half in (0, 1):
        if all(counts.get((1 - half, x)) for x in (0.0, 1.0)):
            odds = _fitted(rows.where(F.col("_half") != half), names, trees, depth, seed)
            for r in rows.where(F.col("_half") == half).groupBy(F.round(F.expr(odds), 2).alias("score")).agg(F.sum("weight").alias("n"), F.sum(F.col("label") * F.col("weight")).alias("right")).collect():
                level = levels.setdefault(float(r["score"]), [0.0, 0.0])
                level[0], level[1] = level[0] + r["n"], level[1] + r["right"]
    odds = _fitted(rows, names, trees, depth, seed)
    threshold, n, right = math.log(precision / (1 - precision)), 0.0, 0.0
    for score in sorted(levels, reverse=True):
        n, right = n + levels[score][0], right + levels[score][1]
        if n >= 20 and right / n >= precision:
            threshold = score
    return odds, threshold


def _named(kind: Column, spans: str) -> Column:
    return F.transform(F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), lambda s: F.concat_ws(":", kind, s["start"], s["end"]))


def detect(docs: DataFrame, model: tuple[str, float] | None = None) -> DataFrame:
    """Personal data of every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added. Added
    spans have the kinds ``contact`` and ``number``; they overlap no base span. A null or
    empty text has none; repeated rows are scanned alike; other columns are not read.
    """
    found = find_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.concat(*[F.col(f"s_{k}") for k in BASE])
    found = found.withColumn("_base", base)
    added = {f"s_{k}": F.array().cast("array<struct<start:int,end:int,text:string>>") for k in LOOSE}
    if model:
        odds, threshold = model
        # only candidates beside the base spans need a score
        found = found.withColumns({f"s_{k}": F.filter(f"s_{k}", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))) for k in LOOSE})
        scored = {f"f_{k}": F.transform(f"s_{k}", lambda c: F.struct(c.alias("span"), *[v.alias(n) for n, v in features(c, F.col("_text")).items()])) for k in LOOSE}
        found = found.withColumns(scored)
        names = _feature_names()
        inner = odds
        for n in names:
            inner = inner.replace(f"WHEN {n} <=", f"WHEN c.{n} <=")
        added = {f"s_{k}": F.expr(f"transform(filter(f_{k}, c -> ({inner}) >= {threshold!r}D), c -> c.span)") for k in LOOSE}
    found = found.withColumns(added)
    found = found.withColumns({f"o_{k}": _named(F.lit(k), f"s_{k}") for k in BASE | LOOSE})
    counts = [F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    base_list = F.concat(*[F.col(f"o_{k}") for k in BASE])
    all_list = F.concat(*[F.col(f"o_{k}") for k in BASE | LOOSE])
    return found.select("doc_id", *counts, F.sha2(F.array_join(base_list, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(all_list, ",").alias("spans"), (F.size("s_contact") + F.size("s_number")).cast("long").alias("n_added"))
