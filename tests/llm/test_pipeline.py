"""Stages of the pipeline against brute force."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tidemill.llm import mixing, queries, secrets, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def shingle_set(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def kept_of(rows, percent=80):
    """Ids left when all but the smallest of each group of near copies go; ids are distinct."""
    sets = {i: shingle_set(t) for i, t, *_ in rows if i is not None}
    label = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    return [i for i in sets if label[i] == i]


def borderline():
    """Texts with copies on both sides of the threshold, and short ones."""
    rng, rows = np.random.default_rng(5), []
    for group, n in enumerate((6, 7, 12, 24, 40, 60, 75, 100, 100, 150, 200, 200, 400, 700)):
        base = [f"w{group}x{k}" for k in range(n)]
        rows.append((100 * group, " ".join(base)))
        for k, changes in enumerate(range(1, 2 + n // 30)):
            copy = list(base)
            for at in np.linspace(4, n - 5, changes + 2).astype(int)[1:-1] if n > 20 else rng.integers(0, n, changes):
                copy[at] = f"new{group}y{k}z{at}"
            rows.append((100 * group + 1 + k, " ".join(copy)))
        rows += [(100 * group + 60 + k, " ".join(base[: n - cut])) for k, cut in enumerate((1, n // 6, n // 5, n // 4))]
    return rows + [(5000, ""), (5001, None), (5002, "one two"), (5003, "ONE two"), (5004, "one two three")]


def test_near_copies_by_five_words(spark):
    rows = borderline()
    known = {i: shingle_set(t) for i, t in rows}
    likeness = [len(known[a] & known[b]) / len(known[a] | known[b]) for a, b in ((700, 702), (1000, 1004))]
    assert all(0.8 <= x < 0.82 for x in likeness)
    docs = table(spark, [(i, t, "s0") for i, t in rows] + [(None, "no id", "s1"), (None, "no id", "s1")])
    left = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(i for i in left if i is not None) == sorted(kept_of(rows)) and left.count(None) == 2


def prose(n, seed=1):
    """Documents of three sources with random sizes, rows without an id and repeated rows."""
    rng = np.random.default_rng(seed)
    rows = [(k, " ".join(f"d{k}x{j}" for j in range(int(rng.integers(1, 40)))), f"s{k % 3 if k % 7 else 0}") for k in range(n)]
    return rows + [(None, "no id a b c", "s0"), (None, "no id d e", "s0"), (n, "same row twice", "s1"), (n, "same row twice", "s1")]


def test_mix_is_what_is_drawn(spark, monkeypatch, tmp_path):
    rows = prose(300)
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    digest, draws = (x.collect() for x in mixing.mix(docs))
    words = Counter()
    for d in draws:
        words[d.row] += d["size"]
    assert {r.row: r.taken for r in digest} == {r.row: words[r.row] for r in digest}
    assert len({(d.row, d.copy) for d in draws}) == len(draws) and {d.shard for d in draws} == set(range(8))
    for target in {r.target for r in digest}:
        assert abs(sum(r.taken for r in digest if r.target == target) - target) <= 40
    # op8 gives what the tree deals: with half of the quotas dealt, less is taken
    monkeypatch.setattr(mixing, "split_quotas", lambda quotas, shards, rng: np.zeros((shards, len(quotas)), np.int64) + (np.arange(shards) == 0)[:, None] * (quotas // 2))
    halved = queries.op8_source_mixing(spark, str(tmp_path)).collect()
    assert 0 < sum(r.taken for r in halved) < sum(r.taken for r in digest)


def test_mix_does_not_follow_the_layout(spark):
    rows = prose(700)
    found = []
    for parts in (1, 3, 7):
        digest, draws = mixing.mix(table(spark, rows).repartition(parts, "text"))
        found.append((sorted((str(r.doc_id), r["size"], r.taken, str(r.draws)) for r in digest.collect()), sorted((d.shard, d.position, str(d.doc_id), d.copy) for d in draws.collect())))
    assert found[0] == found[1] == found[2] and sum(r[2] for r in found[0][0]) > 0


def test_mix_stage_returns_the_draws(spark, tmp_path):
    table(spark, prose(300)).repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    draws = mixing.mix(docs)[1].orderBy("shard", "position").collect()
    left = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert [r.doc_id for r in left] == [d.doc_id for d in draws]
    assert [len(r.text.split()) for r in left if r.doc_id is not None] == [d["size"] for d in draws if d.doc_id is not None]


def test_mix_fills_the_gap_behind_giants(spark):
    """Documents behind one that does not fit are taken; the sum ends within half of the smallest one left."""
    small, big = "a " * 10, "b " * 4000
    rows = [(k, small, "s0") for k in range(600)] + [(1000 + k, big, "s0") for k in range(4)] + [(2000 + k, "c " * 7, "s1") for k in range(4000)]
    for r in mixing.mix(table(spark, rows))[0].groupBy("source_size", "target").agg({"taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r.target) <= 5


def test_prose_after_credential_words_stays(spark):
    clean = ["The author is unknown.", "Authority: government", "The authorship is undetermined.", "Its secretary is experienced."]
    plain = ["An unknown government is experienced and undetermined.", "The government was undetermined, unknown and experienced."]
    secret = "the password is q7Zp-Rx2!vBk9w."
    docs = table(spark, [(k, t, "s0") for k, t in enumerate([*clean, *plain, secret])])
    texts = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, docs, "").collect()}
    assert [texts[k] for k in range(6)] == clean + plain and texts[6] == "the password is [SECRET]."
    assert {r.doc_id for r in secrets.scan(docs).where("n_guess > 0").collect()} == {6}
    # a value that stands in credential contexts only never becomes a common word
    again = table(spark, [(k, "my passphrase is qzkvbxwjpfhdmt", "s0") for k in range(5)])
    assert {r.n_guess for r in secrets.scan(again).collect()} == {1} and "qzkvbxwjpfhdmt" not in secrets.common_words(again)


def test_ids_are_those_of_the_whole_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["end <|endoftext|> start", "end<|endoftext|>start", "One.<|startoftext|>, <|endoftext|>. X", "<|ENDOFTEXT|> a<|EndOfText|>b", "<|endoftext|><|endoftext|>", "é<|endoftext|>È <|end oftext|>", "Plain, text; it's 12.5% off!", "", None]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [806, 49407, 1572]
    for text, ids in zip(texts, tokens.WordTokenizer().encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (plain.encode(text, add_special_tokens=False).ids if text else []), text


def test_common_words_keep_the_bound(spark):
    docs = table(spark, [(0, "aaa aaa aaa bbb bbb ccc ccc ddd", "s0")])
    assert [secrets.common_words(docs, n) for n in (0, 1, 2, 3)] == [[], ["aaa"], ["aaa"], ["aaa", "bbb", "ccc"]]


def test_pipeline_runs_whole(spark):
    """All five stages on the smallest tables: what is packed are whole documents that survived, in full sequences."""
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {r.doc_id for r in rows} <= docs.keys()
    sequences, pieces = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    # a document is packed as often as it was drawn, each time with all of its pieces, and its masked text has about the ids of its own
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for doc_id, own in pieces.items():
        draws = sum(p == 0 for p, _, _ in own)
        assert len(own) % draws == 0 and len(set(own)) == len(own) // draws
        ids = sum(n for _, _, n in set(own))
        assert abs(ids - 1 - len(plain.encode(secrets.redact(docs[doc_id] or ""), add_special_tokens=False).ids)) <= max(40, ids // 10)
    good = [labels[d] for d in pieces if d in labels]
    assert sum(good) / len(good) > 0.9
