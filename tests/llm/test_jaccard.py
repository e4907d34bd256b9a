"""The n-gram Jaccard join against brute force: links at the border, large ids, empty fragments, SQL."""

import re

import duckdb
import numpy as np
import pytest

from tidemill.llm import jaccard, packing, queries, secrets
from tidemill.llm.common import Scratch

SCHEMA = "doc_id long, text string, source string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, width):
    w = words_of(text)
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, percent, width):
    """(doc_id, n_shingles, component) of rows, by comparing all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                label[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((i, len(s), least[root(x)] if i is not None else None) for x, (i, s) in enumerate(sets)), key=str)


def families(seed, percent):
    """Texts of all sizes with copies whose similarity lies around the threshold, in chains."""
    rng, rows = np.random.default_rng(seed), []
    for group, n in enumerate([3, 5, 8, 16, 24, 40, 70, 120, 340, 1300]):
        text = [f"g{group}w{k}" for k in range(n)]
        for copy in range(6):
            rows.append((1000 * group + copy, " ".join(text)))
            text = list(text)
            for at in rng.integers(0, n, max(1, round(n * (100 - percent) / 100 / 6 * rng.uniform(0.3, 1.6)))):
                text[at] = f"n{group}c{copy}p{at}"
    return rows


@pytest.mark.parametrize(("percent", "width"), [(90, 3), (80, 5)])
def test_links_are_those_of_all_pairs(spark, percent, width):
    rows = families(percent, percent) + [(90001, ""), (90002, None), (90003, "one two"), (90004, "ONE  two"), (90005, "a a a a a a"), (90006, "a a a a a a a"), (None, "one two"), (None, None), (7, "g0w0 g0w1"), (7, "again")]
    found = jaccard.link(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA), percent, width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, percent, width)


def test_loose_family_meets_in_the_last_round(spark):
    """Many sets that share fragments and do not link, with one pair that does; one round only."""
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        text = list(base)
        for at in range(7):
            text[(k * 5 + at * 40) % 300] = f"x{k}y{at}"
        rows.append((k, " ".join(text)))
    rows.append((999, rows[31][1] + " tail"))
    docs = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(docs, rounds=1).collect()), key=str) == brute(rows, 90, 3)


def test_sets_of_one_band_meet_there_only(spark):
    """Sets of 150, near the end of a band, and of 160 in the next one, where those of 150 are guests."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 160).astype(np.uint64)
    sets = [np.append(base[: n - 3], rng.integers(0, 1 << 63, 3).astype(np.uint64)) for n in (150, 150, 160)]
    rows = [(int(sig), int(size), int(turn), k, -k) for k, t in enumerate(sets) for sig, size, turn in zip(*(x.view(np.int64) for x in jaccard.fragments(np.unique(t), 90)), strict=True)]
    found = lambda some: {(r.s1, r.turn < 0) for r in jaccard._shared(spark.createDataFrame([r for r in rows if r[3] in some], jaccard.SIGNED)).collect()}
    assert found((0, 1)) == {(0, False), (1, False)}
    assert found((0, 2)) == {(0, True), (2, False)}
    assert found((0, 1, 2)) == {(0, False), (1, False), (0, True), (1, True), (2, False)}
    left = jaccard._shared(spark.createDataFrame(rows, jaccard.SIGNED)).selectExpr("sig", "s1 cls", "size", "turn", "s1 component")
    maps = spark.createDataFrame([(k, -1, bytearray(jaccard.parity(t).tobytes())) for k, t in enumerate(sets)], "cls long, wide int, tokens binary")
    sizes = spark.createDataFrame([(k, len(t)) for k, t in enumerate(sets)], "cls long, n long")
    assert sorted(tuple(r) for r in jaccard._all_that_may_link(left, maps, sizes, 90).collect()) == [(0, 1), (0, 2), (1, 2)]


def test_rounds_end_when_they_find_no_links(spark, monkeypatch):
    """Many sets that share fragments and do not link."""
    rows, rounds, best = [], [], jaccard._best_partners
    for k in range(60):
        text = [f"w{i}" for i in range(300)]
        for at in range(7):
            text[(k * 5 + at * 40) % 300] = f"x{k}y{at}"
        rows.append((k, " ".join(text)))
    monkeypatch.setattr(jaccard, "_best_partners", lambda *a: rounds.append(a) or best(*a))
    found = jaccard.link(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, 90, 3)
    assert len(rounds) == jaccard.SOME_ROUNDS


def test_a_pair_leaves_the_last_join_once(spark):
    """Also pairs whose common fragments are none of those that sets bring along, and no pair inside a component."""
    rng = np.random.default_rng(2)
    tokens = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
    has = {k: {int(f) for f in rng.permutation(40)[:25]} for k in range(12)} | {20: {*range(-30, 0), *range(100, 120)}, 21: {*range(-60, -30), *range(100, 120)}, 22: {500}}
    left = spark.createDataFrame([(f, k, 1, 0, k - (k == 1)) for k in has for f in has[k]], "sig long, cls long, size int, turn int, component long")
    maps = spark.createDataFrame([(k, -1, bytearray(jaccard.parity(tokens).tobytes())) for k in has], "cls long, wide int, tokens binary")
    sizes = spark.createDataFrame([(k, len(tokens)) for k in has], "cls long, n long")
    found = [tuple(r) for r in jaccard._all_that_may_link(left, maps, sizes, 90).collect()]
    assert set(found) == {(a, b) for a in has for b in has if a < b and has[a] & has[b] and (a, b) != (0, 1)}
    brought = {k: set(sorted(f)[: jaccard.FIRSTS_KEPT]) for k, f in has.items()}
    assert all(found.count((a, b)) == (1 if brought[a] & brought[b] else len(has[a] & has[b])) for a, b in set(found))
    assert found.count((20, 21)) == 20 and len(found) < 12 * 11 + 20


def test_sets_over_the_threshold_agree_on_a_signature():
    """Also where the only fragments they agree on are empty: sets with uneven tokens."""
    rng = np.random.default_rng(3)
    for trial in range(400):
        n = int(rng.integers(8, 400))
        # tokens crowd into a few fragments, so that most are empty
        same = rng.integers(0, 1 << int(rng.integers(34, 63)), n).astype(np.uint64)
        most = 2 * n * 10 // 190
        gone = int(rng.integers(0, most // 2 + 1))
        a, b = np.unique(same), np.unique(np.concatenate([same[gone:], rng.integers(0, 1 << 63, gone).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert len(np.intersect1d(jaccard.fragments(a, 90)[0], jaccard.fragments(b, 90)[0])), trial


def test_large_ids_beside_nulls(spark):
    ids = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1]
    docs = spark.createDataFrame([(i, f"the same text of all rows {k % 2}", "s") for k, i in enumerate(ids)], SCHEMA).coalesce(1)
    known = sorted(i for i in ids if i is not None)
    for found in (secrets.scan(docs), packing.pack(docs), jaccard.link(docs)):
        assert sorted(r.doc_id for r in found.collect() if r.doc_id is not None) == known
    assert {r.doc_id: r.component_id for r in jaccard.link(docs).collect()} == {2**60 + 1: 2**60 + 1, 2**60 + 3: -(2**62) - 1, -(2**62) - 1: -(2**62) - 1, None: None}


def test_sql_agrees(spark, tmp_path):
    rows = families(4, 90)[:90] + [(95000, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(queries.ORACLE_SQL["op9_ngram_jaccard_join"]).fetchall(), key=str) == brute(rows, 90, 3)


def test_first_tokens_never_drop_a_partner():
    rng = np.random.default_rng(6)
    for _ in range(400):
        n, percent = int(rng.integers(1, 120)), int(rng.choice([75, 80, 90]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.permutation(n)[: n - int(rng.integers(0, n // 4 + 1))]], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both):
            some, need = jaccard.first_tokens(a, percent)
            assert len(np.intersect1d(some, b)) >= need >= 1


def test_fragments_of_the_same_sets_are_one_row_a_member(spark):
    """A pair that shares 30 fragments, a third set that shares 5 of them, and a set alone."""
    rows = [(f, 10 + f, 0, s, -s) for f in range(30) for s in ((1, 2) if f >= 5 else (1, 2, 3))] + [(99, 7, 0, 4, -4), (0, 10, 0, 1, -1)]
    found = sorted(tuple(r[c] for c in ("s1", "s2", "sig", "size", "turn")) for r in jaccard._shared(spark.createDataFrame(rows, jaccard.SIGNED)).collect())
    three, two = sum(range(10, 15)), sum(range(15, 40))
    assert found == [(1, -1, 0, three, 0), (1, -1, 5, two, 0), (2, -2, 0, three, 0), (2, -2, 5, two, 0), (3, -3, 0, three, 0)]


def test_a_token_moves_once_and_no_bucket_moves(spark):
    """Shuffles of the first tokens, and of the tokens when pairs are verified."""
    docs = spark.createDataFrame([(*r, "s") for r in families(5, 90)], SCHEMA)
    scratch = Scratch(spark)
    classes = scratch.keep(jaccard._sets(docs, 3).selectExpr("s1", "s2", "doc_id rep", "n", "doc_id cls"))
    plan = jaccard._hopeful(jaccard._first_rows(docs, 3, 90), classes, 90)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    wide = jaccard._wide(docs, classes.selectExpr("rep doc_id"), 3).join(classes, ["s1", "s2"]).select("cls", "wide", "tokens").dropDuplicates(["cls", "wide"])
    tokens = scratch.keep_in_buckets(wide, "cls", "wide")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = tokens.select(tokens.cls.alias("a"), "wide").join(tokens.select(tokens.cls.alias("a"), "wide", "tokens"), ["a", "wide"])
        assert "Exchange" not in moved._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scratch.drop(tokens, classes)


def test_a_family_round_the_threshold_is_not_tested_in_all_its_pairs(spark, monkeypatch):
    """Sets with up to four changes: most pairs link, but not with the sets that rounds meet first."""
    rng, rows, tried, asked = np.random.default_rng(11), [], [], []
    for k in range(400):
        text = [f"w{i}" for i in range(150)]
        for at in rng.choice(150, int(rng.integers(1, 5)), replace=False):
            text[at] = f"x{k}y{at}"
        rows.append((k, " ".join(text)))
    every, verified = jaccard._all_that_may_link, jaccard._verified
    monkeypatch.setattr(jaccard, "_all_that_may_link", lambda *a: tried.append(every(*a).distinct().count()) or every(*a))
    monkeypatch.setattr(jaccard, "_verified", lambda wide, pairs, *a: asked.append(pairs.count()) or verified(wide, pairs, *a))
    monkeypatch.setattr(jaccard, "SOME_ROUNDS", 1)
    monkeypatch.setattr(jaccard, "MEETINGS", 0)
    found = jaccard.link(spark.createDataFrame([(*r, "s") for r in rows], SCHEMA), 80, 5, rounds=1).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute(rows, 80, 5)
    assert tried[0] <= 4 * len(rows) and sum(asked) <= 8 * len(rows)
