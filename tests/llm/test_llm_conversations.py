"""Conversation repair against exhaustive edits, and the query against a version in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from meterframe.llm import conversation_repair as cr
from meterframe.llm import queries

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def _exhaustive(symbols: str):
    """Cheapest (cost, audit) over all edits, with at most two insertions at a place."""
    n, best = len(symbols), (4 * len(symbols), "D" * len(symbols))

    def rec(i, roles, audit, cost, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if i == n and GRAMMAR.match(roles):
            best = min(best, (cost, audit))
        if inserted < 2:
            for r in "ua":
                rec(i, roles + r, audit + "I", cost + 3, inserted + 1)
        if i < n:
            c, cut = symbols[i].lower(), 3 * symbols[i].isupper()
            rec(i + 1, roles, audit + "D", cost + 4, 0)
            if c != "-":
                rec(i + 1, roles + c, audit + "K", cost + cut, 0)
                for r in "ua":
                    rec(i + 1, roles + r, audit + "R", cost + 3 + cut, 0)

    rec(0, "", "", 0, 0)
    return best


TAKES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def _by_strings(symbols: str):
    """The same minimum over (cost, audit) pairs, the audits whole strings; and the roles it gives."""
    far = (10**9, "", ())

    def insertions(best):
        for _ in range(3):
            for q in TAKES:
                for r, to in TAKES[q].items():
                    if r != "s":
                        best[q] = min(best[q], (best[to][0] + 3, "I" + best[to][1], (r, *best[to][2])))
        return best

    best = insertions({q: (0, "", ()) if q in ("", "a") else far for q in TAKES})
    for x in reversed(symbols):
        c, cut, now = x.lower(), 3 * x.isupper(), {}
        for q in TAKES:
            now[q] = (best[q][0] + 4, "D" + best[q][1], (None, *best[q][2]))
            if c != "-":
                for r, to in TAKES[q].items():
                    if r != "s":
                        now[q] = min(now[q], (best[to][0] + 3 + cut, "R" + best[to][1], (r, *best[to][2])))
                    if r == c:
                        now[q] = min(now[q], (best[to][0] + cut, "K" + best[to][1], (r, *best[to][2])))
        best = insertions(now)
    return best[""]


def test_decision_is_the_cheapest_of_all():
    r = random.Random(5)
    for _ in range(150):
        s = "".join(r.choice("suaxSUAX-ua") for _ in range(r.randint(0, 4)))
        assert cr.decide(s.encode()) == _exhaustive(s), s


@pytest.mark.parametrize("alphabet", ["ua", "uaS-", "suaxSUAX-", "u", "aU", "s", "x-", "-"])
def test_blocks_change_nothing(alphabet):
    r = random.Random(6)
    for n in (1, 63, 64, 65, 127, 128, 129, 300):
        s = "".join(r.choice(alphabet) for _ in range(n))
        assert cr.decide(s.encode()) == _by_strings(s)[:2], s


def _plain(rows):
    """The query's result from (conv_id, turn, role, text) rows, in plain Python."""
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        convs[conv_id]  # noqa: B018 - conversations without rows count too
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        convs[conv_id] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv_id, said in convs.items():
        name = "-" if conv_id is None else conv_id
        key = lambda x: hashlib.sha256(f"{name}:{len(x[1].encode())}:{x[1]}{x[2]}".encode()).digest()  # noqa: B023, E731
        said.sort(key=lambda x: (x[0] is not None, x[0] or 0, key(x)))
        seen, symbols, blank, duplicate, truncated = set(), "", 0, 0, 0
        for _, role, text in said:
            letters = WORD.findall(text)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not letters:
                blank, symbols = blank + 1, symbols + "-"
            elif (role, text) in seen:
                duplicate, symbols = duplicate + 1, symbols + "-"
            elif letters[-1] not in ".!?":
                truncated, symbols = truncated + 1, symbols + initial.upper()
            else:
                symbols += initial
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, roles = _by_strings(symbols)
        rest, lines = iter(said), []
        for letter, r in zip(audit, roles):
            row = None if letter == "I" else next(rest)
            full = {"u": "user", "a": "assistant"}.get(r)
            if letter == "K":
                lines.append(f"{row[1]}:{row[2]}")
            elif letter != "D":
                lines.append(f"{full}:{row[2] if row else ''}")
        out[conv_id] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _query(spark, conv, path):
    conv.write.parquet(f"{path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(path)).collect()
    result = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(result) == len(got)
    return result


def test_query_on_the_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, path).collect()}
    assert got == _plain(rows)


SCHEMA = "conv_id long, turn long, role string, text string, key string, times long, first long, _kind int, position long, audit string"
NONE = (None,) * 6


def test_odd_tables(spark, tmp_path):
    r = random.Random(2)
    rows = []
    for conv_id in [*range(60), None]:
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "U", "sudo"])
            text = r.choice(["Well.", "So?", "cut", "", " \t\n\x0b", None, "Ja!  ", " ", "a ", "x" * 3000 + ".", "...", f"n{turn}."])
            rows.append((conv_id, r.choice([turn, turn, turn, None, turn // 2, turn * 10]), role, text))
    rows += rows[:40]
    for n, conv_id in ((300, 1000), (131, 1001)):  # more rows than a block
        rows += [(conv_id, i, r.choice(["user", "assistant"]), r.choice([f"t{i}.", f"t{i}", "same."])) for i in range(n)]
    conv = spark.createDataFrame([(*x, *NONE) for x in rows], SCHEMA).repartition(4)
    assert _query(spark, conv, tmp_path) == _plain(rows)


def test_long_run_of_one_turn(spark, tmp_path):
    rows = [(1, 7, "user", "Again.")] * 2500 + [(2, i, "user", f"{i}.") for i in range(50)]
    conv = spark.createDataFrame([(*x, *NONE) for x in rows], SCHEMA).repartition(4)
    assert _query(spark, conv, tmp_path) == _plain(rows)


def test_empty_table(spark, tmp_path):
    assert _query(spark, spark.createDataFrame([], SCHEMA), tmp_path) == {}


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Bye."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    conv = spark.createDataFrame([(*x, *NONE) for x in rows], SCHEMA)
    decided = cr.audits(conv)
    assert {r["conv_id"]: r["audit"] for r in decided.collect()} == {1: _by_strings("sau")[1], 2: "KK"}
    fixed = defaultdict(list)
    for r in cr.repair(conv, decided).orderBy("conv_id", "position").collect():
        fixed[r["conv_id"]].append((r["role"], r["text"]))
    assert fixed[2] == [("user", "Hi."), ("assistant", "Hi.")]
    assert GRAMMAR.match("".join(role[0] for role, _ in fixed[1]))
