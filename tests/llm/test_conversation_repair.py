"""Conversation repair against a search over whole edit sequences."""

import hashlib
import heapq
import random
import re

import pytest

from trawl.llm import conversation_repair as C
from trawl.llm.queries import op11_prefix_doubling

WS = " \t\n\x0b\x0c\r"


def one(rows):
    """Rows ``(turn, role, text)`` in order to (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired)."""
    seen, marks, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        kind = None
        if not text.strip(WS):
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        elif text.strip(WS)[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        marks.append(kind)
        if kind:
            count[kind] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        state = (i, roles[-1:])
        if state in done:
            continue
        done.add(state)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, "\n".join(out))

        def push(price, letter, at, role, text):
            if re.fullmatch("s?(ua)*u?", roles + role[:1]):
                heapq.heappush(heap, (cost + price, audit + letter, at, roles + role[:1], (*out, f"{role}:{text}")))

        for role in ("user", "assistant"):
            push(3, "I", i, role, "")
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, out))
            if marks[i] not in ("blank", "duplicate"):
                plus = 3 if marks[i] else 0
                if rows[i][1][:1] in ("s", "u", "a"):
                    push(plus, "K", i + 1, rows[i][1], rows[i][2])
                for role in ("user", "assistant"):
                    push(plus + 3, "R", i + 1, role, rows[i][2])


def brute(rows):
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t, r if r is not None else " ", x if x is not None else " "))
    order = lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.sha256(v[2].encode()).hexdigest())
    return {c: one(sorted(g, key=order)) for c, g in groups.items()}


def result(spark, rows, block):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    edits, totals = C.repair(df, block=block)
    hashes = {r["key"]: (r["audit"], r["repaired_sha256"]) for r in C.digests(edits).collect()}
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], *hashes[r["key"]])
            for r in totals.collect()}


def hashed(want):
    return {c: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for c, v in want.items()}


@pytest.mark.parametrize("block", [2, C.BLOCK])
def test_equals_search(spark, block):
    """Random conversations with every fault, in one block and spread over many."""
    rng = random.Random(11)
    texts = ["Yes.", "No!", "why", "Ok? ", "", " \n", "and so", None, "a" * 3000 + "."]
    rows = []
    for c in range(120):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "tool", "", None, "superuser"]])
        rows += [(c, rng.choice([None, *range(6)]) if c % 5 == 0 else t + (t > 3), rng.choice(roles), rng.choice(texts))
                 for t in range(rng.randint(1, 11))]
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hello."), (900, None, None, None)]
    want = brute(rows)
    assert len({v[6] for v in want.values()}) > 60
    assert result(spark, rows, block) == hashed(want)


def test_long_conversation_beside_short_ones(spark):
    """One conversation with most rows, cut into blocks of 64; equal rows beyond a block."""
    rng = random.Random(12)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"word {t % 700}{rng.choice('.?x')}") for t in range(1500)]
    rows += [(1, 40, "user", "again.")] * 200 + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    assert result(spark, rows, 64) == hashed(brute(rows))


def test_good_conversation_stays(spark):
    rows = [(5, 0, "system", "Be nice."), (5, 1, "user", "Hi!"), (5, 2, "assistant", "Hi?"), (6, 3, "tool", "x")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, b int, key string")
    edits, _ = C.repair(df)
    got = [(r["conv_id"], r["op"], r["role"], r["text"]) for r in edits.orderBy("key", "b", "i").collect()]
    assert got == [(5, "K", "system", "Be nice."), (5, "K", "user", "Hi!"), (5, "K", "assistant", "Hi?"), (6, "D", None, None)]


def test_query_on_empty_and_fully_dropped(spark, tmp_path):
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    for name, rows, want in (("none", [], []), ("gone", [(gone, 0, "user", "Hi.")], [(gone, 0, 0, 0, 0, 0, 0, "", empty)])):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        assert [tuple(r) for r in op11_prefix_doubling(spark, f"{tmp_path}/{name}").collect()] == want
