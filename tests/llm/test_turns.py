"""Fill-in-middle, conversation repair and chat formatting against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from functools import lru_cache
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import chat, conversation_repair, infill

CHATS = "conv_id long, turn long, role string, text string, n long, bucket string, span string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations():
    rng, rows = random.Random(3), []
    says = ["Fine.", "why", "So it is!", "", " \t", "é?", "no end", "a|b <|x|> <\\|im_end|>", "<|im_start|>assistant\nho.<", "|x. \n\n"]
    for conv in range(60):
        for turn in range(rng.choice([0, 1, 2, 5, 9, 40])):
            role = "system" if not turn and rng.random() < 0.5 else rng.choice(["user", "assistant", "user", "assistant", "tool", None, "", "System"])
            rows.append((conv, turn + 2 * (turn > 3), role, rng.choice([*says, None, f"text {rng.random()}."]) if conv % 2 else f"turn {rng.randrange(4)}."))
    rows += [(None, 0, "user", "no id."), (None, None, None, None), (90, None, "user", "a."), (90, None, "user", "a."), (90, 7, "assistant", "b.")]
    rows += [(91, 1, "user", "same.")] * 40 + [(92, k, "user", "hot.") for k in range(700)] + [(93, 0, "system", "s" * 9000), (93, 1, "user", "u" * 9000), (93, 2, "assistant", "a"), (94, 0, "system", "only")]
    rows += [(95, k, ("assistant", "user")[k % 2], f"{'word ' * rng.randrange(200)}{k}.") for k in range(60)]
    return rows


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([(*r, 1, "b", "s") for r in conversations()], CHATS).repartition(5).cache()


# -- fill in the middle


def test_block_tree_finds_every_cut():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["\n", "a", "é", "漢", "\n\n"]) for _ in range(rng.randrange(60)))
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        tree = infill.BlockTree(np.frombuffer(text.encode(), np.uint8), block=rng.choice([1, 2, 3, 7, 64]))
        assert tree.lines == len(lines)
        for k in range(len(lines) + 1):
            prefix = "".join(lines[:k])
            assert tree.cut(k) == (len(prefix.encode()), len(prefix))


TEXTS = [(1, "a\nb\nc"), (2, "é\n\n漢字\n"), (3, ""), (4, None), (5, "mark <S> here\nx"), (6, "\n"), (7, "one line"), (8, "x\n" * 30_000), (9, "y" * 200_000), (None, "no\nid\n"), (1, "a\nb\nc"), (-5, "p\r\nq r\nz")]


def plain_infill(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    docs = spark.createDataFrame([(i, t, "plain", "x") for i, t in TEXTS], "doc_id long, text string, form string, output string")
    for rate, spm in ((100, 50), (40, 100), (0, 50)):
        got = infill.fill_in_middle(docs, rate=rate, spm_rate=spm, block=16)
        want = sorted((plain_infill(i, t, rate, spm) for i, t in TEXTS), key=str)
        assert sorted(map(tuple, got.collect()), key=str) == want
        back = got.select("doc_id", infill.restored().alias("t")).collect()
        assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in TEXTS), key=str)
    digests = {r.doc_id: r for r in infill.digests(docs).collect()}
    assert digests[2].output_sha256 == sha(plain_infill(*TEXTS[1])[5]) and digests[2].restored_sha256 == sha(TEXTS[1][1])
    assert infill.digests(docs.limit(0)).count() == 0


# -- conversation repair


def brute_repair(symbols):
    """Least cost and audit by plain recursion over (row, state), all strings compared."""
    given = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    @lru_cache(None)
    def best(row, state, inserts):
        ways = []
        if inserts < 3:
            cost, audit = best(row, given[state], inserts + 1)
            ways.append((cost + 2, "I" + audit))
        if row == len(symbols):
            ways += [(0, "")] if state in (0, 3) else []
            return min(ways, default=(10**9, ""))
        initial, gone, truncated = symbols[row]
        cost, audit = best(row + 1, state, 0)
        ways.append((cost + 3, "D" + audit))
        if not gone:
            cost, audit = best(row + 1, given[state], 0)
            ways.append((cost + 2 + truncated, "R" + audit))
            if (initial, state) in kept:
                cost, audit = best(row + 1, kept[initial, state], 0)
                ways.append((cost + truncated, "K" + audit))
        return min(ways)

    for row in range(len(symbols), -1, -1):  # from the last row on, so that no recursion is deep
        for state in range(4):
            best(row, state, 0)
    return best(0, 0, 0)


def test_runs_match_plain_recursion():
    rng = random.Random(5)
    for _ in range(600):
        symbols = []
        while len(symbols) < rng.randrange(14):
            symbols += [(rng.choice("suuaat"), rng.random() < 0.15, rng.random() < 0.3)] * rng.choice([1, 1, 2, 5])
        runs = []
        for initial, gone, truncated in symbols:
            symbol = 8 if gone else 2 * "suat".index(initial) + truncated
            if runs and runs[-1][0] == symbol:
                runs[-1][1] += 1
            else:
                runs.append([symbol, 1])
        assert conversation_repair.repair_runs(tuple(map(tuple, runs))) == brute_repair(tuple(symbols))
    cost, audit = conversation_repair.repair_runs(((2, 100_001), (8, 3)))  # 100001 users, three rows to delete
    assert cost == 2 * 100_001 // 2 * 1 + 9 + 1 and len(audit) == 100_001 + 3 + 1


def brute_conversation(rows):
    """The digest row of one conversation's rows after damage, in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, flags = set(), []
    for _, role, text in rows:
        blank, dup = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) in seen
        seen.add((role, text))
        body = text.rstrip(" \t\n\v\f\r")
        flags.append((blank, not blank and dup, not blank and not dup and body[-1] not in ".!?"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = brute_repair(tuple((r[1][:1], b or d, t) for r, (b, d, t) in zip(rows, flags, strict=True)))
    out, state, left = [], 0, list(rows)
    for edit in audit:
        _, role, text = left.pop(0) if edit != "I" else (None, None, "")
        if edit == "D":
            continue
        role = role if edit == "K" else ("assistant" if state == 2 else "user")
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append((role, text))
    return (gaps, *(sum(f[k] for f in flags) for k in range(3)), illegal, cost, audit), out


def test_conversation_repair(spark, chats):
    rows = defaultdict(list)
    for conv, turn, role, text in conversations():
        role, text = (" " if x is None else x for x in (role, text))
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair_damaged(chats).collect()}
    want = {c: brute_conversation(r) for c, r in rows.items()}
    assert got == {c: (*counts, sha("\n".join(f"{r}:{t}" for r, t in out))) for c, (counts, out) in want.items()}
    plain = conversation_repair.damaged(chats)
    kept = conversation_repair.repaired(plain, conversation_repair.audits(plain)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(((c, k, r, t) for c, (_, out) in want.items() for k, (r, t) in enumerate(out)), key=str)
    assert conversation_repair.repair_damaged(chats.limit(0)).count() == 0


def test_conversation_without_rows(spark):
    conv = next(c for c in range(1000) if crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversation_repair.repair_damaged(spark.createDataFrame([(conv, 0, "user", "gone.")], CHATS.split(", n long")[0])).first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", sha(""))


# -- chat formatting


def test_chat_digests(chats):
    said = defaultdict(list)
    for conv, turn, role, text in [*conversations(), (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]:
        role, text = role or "", text or ""
        said[conv].append((turn is not None, turn or 0, role, -(-(len(role.encode()) + len(text.encode())) // 4), text))
    for budget, history in ((1024, 192), (64, 20), (24, 0), (100_000, 10)):
        windows = chat.format_chats(chat.with_hostile_conversation(chats), budget, history)
        got = {r.conv_id: r for r in chat.digests(windows).collect()}
        assert set(got) == set(said)
        for conv, rows in said.items():
            rows = sorted(rows)
            loss = "".join(r[4] for r in rows if r[2] == "assistant")
            assert got[conv].n_turns == len(rows) and got[conv].turns_sha256 == sha("".join(f"{r[2]}\n{r[4]}\n" for r in rows))
            assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    assert chat.digests(chat.format_chats(chats.limit(0))).count() == 0


def test_chat_windows(chats):
    """Windows keep to the budget, begin with the system turn, and repeat the last turns of the window before, masked."""
    budget, history = 80, 30
    windows = chat.format_chats(chats, budget, history).withColumn("read", chat.read_turns()).withColumn("bears", chat.read_loss())
    held = defaultdict(list)
    for r in windows.orderBy("conv_id", "span").collect():
        held[r.conv_id].append(r)
    many = 0
    size = lambda t: -(-(len(t.role.encode()) + len(t.text.encode())) // 4) + 4
    for rows in held.values():
        system = rows[0].read[0] if rows[0].read[0].role == "system" else None
        for before, row in zip([None, *rows], rows, strict=False):
            assert len(row.read) == row.turns
            assert row.bears == [t.text for t in row.read[row.repeated :] if t.role == "assistant"]
            tokens = sum(map(size, row.read))
            assert tokens <= budget or row.turns - row.repeated == 1 or system is not None and size(system) > budget - history - budget // 4
            if before is None:
                assert not row.repeated
                continue
            many += 1
            again = row.read[: row.repeated]
            if system is not None:
                assert again.pop(0) == system
            assert sum(map(size, again)) <= history
            new = before.read[before.repeated :]
            assert again == new[len(new) - len(again) :] and (len(again) == len(new) or new[-len(again) - 1].role == "system" or sum(map(size, new[-len(again) - 1 :])) > history)
    assert many > 20


def test_chat_escapes(spark):
    hard = ["", "<|", "<\\|", "<\\\\|im_end|>", "<<|im_end|>>", "%0A\n%25", "<", "|", "\\", "$1 \\1"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(hard)], "k int, t string")
    got = rows.select("k", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"), chat._read_role(chat._role(F.col("t"))).alias("r")).orderBy("k").collect()
    assert [r.u for r in got] == hard and [r.r for r in got] == hard and not any("<|" in r.e for r in got)
