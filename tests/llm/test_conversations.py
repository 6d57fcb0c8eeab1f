from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vitrina.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, times long"


def by_search(letters: str) -> tuple[int, str]:
    """Least (cost, audit) by uniform-cost search over edits, one row at a time."""
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, at, roles = heapq.heappop(queue)
        state = roles if len(roles) < 2 else roles[-1]
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(letters) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit
        ok = lambda r: re.fullmatch(r"s?(ua)*u?", roles + r)
        for role in "ua":
            if ok(role):
                heapq.heappush(queue, (cost + 5, audit + "I", at, roles[-2:] + role if len(roles) > 3 else roles + role))
        if at < len(letters):
            x = letters[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, roles))
            extra = 5 if x.isupper() else 0
            for role in "sua":
                if x != "d" and ok(role):
                    if role == x.lower():
                        heapq.heappush(queue, (cost + extra, audit + "K", at + 1, roles + role))
                    if role != "s":
                        heapq.heappush(queue, (cost + extra + 1, audit + "R", at + 1, roles + role))
    raise AssertionError


def all_splits(letters: str):
    """The full chart: every span, every split."""
    n = len(letters)
    chart = {(k, k + 1): C.LEAF[c] for k, c in enumerate(letters)}
    for size in range(2, n + 1):
        for a in range(n - size + 1):
            cells = [C.combined(chart[a, k], chart[k, a + size]) for k in range(a + 1, a + size)]
            assert len(set(cells)) == 1  # every split gives the same cell
            chart[a, a + size] = cells[0]
    return chart[0, n]


@pytest.mark.parametrize("seed", range(150))
def test_least_cost_and_audit(seed):
    rng = random.Random(seed)
    letters = "".join(rng.choice("suauauaoSUAd") for _ in range(rng.randint(1, 9)))
    assert C.solution(C.cell_of(letters)) == by_search(letters)
    if len(letters) < 8:
        assert all_splits(letters) == C.cell_of(letters)


def plain(rows):
    """Result of one conversation from its rows (turn, role, text) after damage, in plain Python."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, letters, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        content = re.sub(r"[ \t-\r]+$", "", text)
        fault = "blank" if not content else "duplicate" if (role, text) in seen else "truncated" if content[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        x = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "d" if fault in ("blank", "duplicate") else x.upper() if fault else x
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = 0, ""
    if rows:  # state by state, from the left
        best = {"": (0, "")}
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

        def inserted(best):
            for _ in range(3):
                for (p, role), q in step.items():
                    if role != "s" and p in best:
                        found = (best[p][0] + 5, best[p][1] + "I")
                        best[q] = min(best.get(q, found), found)
            return best

        for x in letters:
            best, then = inserted(best), {}

            def offer(q, cost, audit, then=then):
                then[q] = min(then.get(q, (cost, audit)), (cost, audit))

            for p, (c, a) in best.items():
                offer(p, c + 2, a + "D")
                for role in "sua" if x != "d" else "":
                    extra = 5 if x.isupper() else 0
                    if (p, role) in step and role == x.lower():
                        offer(step[p, role], c + extra, a + "K")
                    elif (p, role) in step and role != "s":
                        offer(step[p, role], c + extra + 1, a + "R")
            best = then
        best = inserted(best)
        cost, audit = min(best[q] for q in ("", "a") if q in best)
    out, it = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(it)[1:]
        if edit != "D":
            before = [r.split(":", 1)[0] for r in out]
            start = 1 if before and before[0][:1] == "s" else 0
            out.append(f"{role if edit == 'K' else ['user', 'assistant'][(len(out) - start) % 2]}:{text}")
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def check(df, rows):
    want = defaultdict(list)
    for conv, turn, role, text, times in rows:
        want[conv] += [(turn, role, text)] * times
    got = {r.conv_id: tuple(r)[1:] for r in df.collect()}
    assert len(got) == df.count() == len(want)
    for conv, found in want.items():
        assert got[conv] == plain(found), conv


def made(rng, conv, size):
    texts = ["Yes.", "No", "Why?", "", " \n", "Fine!", "Well\t"]
    roles = ["user", "assistant", "user", "assistant", "system", "usher", "", "tool"]
    return [(conv, rng.choice([None, t, t, t, t + 1]), rng.choice(roles) if rng.random() < 0.3 else roles[t % 2], rng.choice([rng.choice(texts), f"{t} said."]), 1) for t in range(size)]


def test_many_short_and_some_long_conversations(spark):
    rng = random.Random(11)
    rows = [r for conv in range(150) for r in made(rng, conv, rng.randint(1, 12))]
    rows += made(rng, 1000, 3_000) + made(rng, None, 700)  # more than one range and chunk
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("key", "part", "chunk", "cost", "piece")})
    check(C.repair(df.select("conv_id", "turn", "role", "text", "times")), rows)


def test_equal_rows_are_counted(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "assistant", "Same.", 5_000), (1, 2, "assistant", "", 3_000), (1, 3, "user", "Hi.", 2), (2, 0, "user", "x" * 1_200_000 + ".", 1), (2, 1, "assistant", "y" * 900_000, 1), (3, None, None, None, 0)]
    check(C.repair(spark.createDataFrame(rows, SCHEMA)), rows)


def test_one_conversation_holds_everything(spark):
    rng = random.Random(2)
    rows = made(rng, 7, 4_000)
    check(C.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)), rows)


def test_damage_and_nulls(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice([None, "user", "assistant", "system"]), rng.choice([None, "", "One. Two! Three?", "open"])) for _ in range(400)]
    after = []
    for conv, turn, role, text in rows:
        role, text = role or " ", " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after.append((conv, turn, role, text, 0 if kind == 0 else 2 if kind == 3 else 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash"))
    check(C.repair(C.damaged(df)), after)


def test_empty_table(spark):
    assert C.repair(C.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
