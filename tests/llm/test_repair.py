import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from landgauge.llm import queries, repair

SPACES = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def allowed(symbol, state):
    """(edit, cost, next state) of a row."""
    role, more = symbol.lower(), symbol.isupper()
    yield "D", 3, state
    if role != "x":
        to = "a" if state == "u" else "u"
        yield "R", 2 + more, to
        if role == to or (role == "s" and state == ""):
            yield "K", 0 + more, role


def every_audit(symbols, most=2):
    """All audits with at most `most` inserts in a row, with their costs."""

    def go(i, state, cost, audit, inserted):
        if i == len(symbols) and state in ("", "a"):
            yield cost, audit
        if inserted < most:
            yield from go(i, "a" if state == "u" else "u", cost + 2, audit + "I", inserted + 1)
        if i < len(symbols):
            for edit, more, to in allowed(symbols[i], state):
                yield from go(i + 1, to, cost + more, audit + edit, 0)

    return go(0, "", 0, "", 0)


def plain(symbols):
    """The least audit per state as whole strings."""

    def inserted(best):
        for state in ("u", "a", "u"):
            for other in ("", "s", "a") if state == "u" else ("u",):
                if other in best:
                    best[state] = min(best.get(state, (1 << 60, "")), (best[other][0] + 2, best[other][1] + "I"))
        return best

    best = {"": (0, "")}
    for symbol in symbols:
        after = {}
        for state, (cost, audit) in inserted(best).items():
            for edit, more, to in allowed(symbol, state):
                after[to] = min(after.get(to, (1 << 60, "")), (cost + more, audit + edit))
        best = after
    best = inserted(best)
    return min(v for k, v in best.items() if k in ("", "a"))


def joined(symbols, size):
    return repair.join_blocks([repair.transfer(symbols[i : i + size], e) for e in range(4)] for i in range(0, len(symbols), size))


def test_audits_against_every_sequence_of_edits():
    for n in range(4):
        for symbols in map("".join, itertools.product("xsuaoSUAO"[: 9 if n < 3 else 5], repeat=n)):
            assert joined(symbols, 2) == plain(symbols) == min(every_audit(symbols)), symbols


@pytest.mark.parametrize("letters", ["o", "u", "xo", "xsuaoSUAO", "uao", "oOxU"])
def test_long_audits_in_blocks_of_any_size(letters):
    rng = random.Random(letters)
    for n in (17, 60, 150):
        symbols = "".join(rng.choice(letters) for _ in range(n))
        assert {joined(symbols, size) for size in (1, 7, 64, 1000)} == {plain(symbols)}


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(repair, "PRIME", 3)
    rng = random.Random(1)
    for _ in range(100):
        symbols = "".join(rng.choice("xuaoSO") for _ in range(20))
        assert joined(symbols, 50) == plain(symbols)


def expected(rows, damaged=True):
    convs = {}
    for conv, turn, role, text in rows:
        conv_, turn_ = (" " if v is None else str(v) for v in (conv, turn))
        role, text, copies = " " if role is None else role, " " if text is None else text, 1
        h = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20 if damaged else 99
        if h == 0:
            copies = 0
        elif h == 1:
            text = ""
        elif h == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        elif h == 3:
            copies = 2
        elif h == 4:
            role = "user"
        convs.setdefault(conv, []).extend([(turn, role, text)] * copies)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, symbols, faults = set(), "", [0, 0, 0]
        for _, role, text in own:
            bare = text.strip(SPACES)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in (0, 1) else letter.upper() if fault == 2 else letter
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        turns = {r[0] for r in own if r[0] is not None}
        cost, audit = plain(symbols)
        lines, left, state = [], iter(own), ""
        for edit in audit:
            _, role, text = (None, "", "") if edit == "I" else next(left)
            if edit != "D":
                to = "a" if state == "u" else "u"
                state = role[:1] if edit == "K" else to
                lines.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[to]}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def tuples(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_small_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = tuples(queries.op12_conversation_repair(spark, folder))
    assert got == expected(rows) and any("D" in r[7] for r in got)


def test_odd_rows_and_one_conversation_over_many_blocks(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["Yes.", "no", "", " \t", None, "What?", "ok!  ", "[end", "é."]
    roles = ["user", "assistant", "system", "tool", "", None, "unit"]
    rows = [(1, rng.choice([None, *range(400)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.2 else f"Text {rng.randint(0, 900)}.") for _ in range(700)]
    rows += [(rng.choice([None, *range(2, 60)]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    rows += [(70, 1, "user", "Same.")] * 40 + [(71, None, None, None)]
    monkeypatch.setattr(repair.block_rows, "__defaults__", (16,))
    df = spark.createDataFrame(rows, ROWS).repartition(5).withColumn("c", F.lit("clash")).withColumn("n", F.lit(3)).withColumn("kind", F.lit("k"))
    assert tuples(repair.repair(df, damaged=True)) == expected(rows)
    assert tuples(repair.repair(df)) == expected(rows, damaged=False)
    whole = repair.repair(df, texts=True).collect()
    assert all(hashlib.sha256(r.repaired.encode()).hexdigest() == r.repaired_sha256 for r in whole)


def test_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], ROWS), damaged=True).count() == 0
