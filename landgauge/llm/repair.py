"""Repair of conversation structure: the cheapest edits that give each conversation the roles `(s?(ua)+)?`.

Edits of a row and their costs: Keep 0, Rerole to user or assistant 2, Delete 3
(the only choice for blank and duplicate rows); Insert an empty user or assistant
row anywhere 2; a truncated row that is not deleted adds 1. The audit is the
initials of the edits in order, of all cheapest ones the least in ASCII.

Four states (nothing yet, system, user, assistant) run over the rows. What leads
to a state is a linked node (`Trail`), so sequences share their beginnings. Nodes
know their ancestors 1, 2, 4, ... steps back and a rolling hash of the whole
sequence; two sequences of equal cost are compared by a search for their longest
common prefix, and equal hashes are verified. Two cheapest ways to the same
state over the same rows are never prefixes of each other (what is longer has
inserts more and costs more), so the least way may be kept per state.

Rows of a conversation are cut into blocks of BLOCK_ROWS at most, in parallel and
over range partitions, so a conversation of any length is spread. A block gives
the cheapest least audit from each state at its begin to each at its end; these
are put together per conversation block by block. Duplicates are found by an
aggregate. The texts move once, for the digest of the repaired rows, and stream
past the audit; a task holds one audit and one batch of texts at a time.

Null conv_id, turn, role and text read as one space; null ids are one
conversation. Rows of a conversation go by turn (nulls first), then role, then
MD5 of the text, so equal rows are adjacent; of those the first is no duplicate.
A role that is empty or begins with another letter than s, u, a can't be kept.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landgauge.llm.scratch import cut, width

BLOCK_ROWS, REMEMBERED_ROWS = 4096, 16
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
PRIME, BASE = (1 << 61) - 1, 1_000_003
LEGAL = frozenset(("su", "ua", "au"))
SPACES = " \t\n\x0b\x0c\r"

# One letter per row: x must be deleted; s, u, a by role, o any other role; upper case if truncated.
BLOCK = (
    "c string, part int, seq int, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "least_turn long, most_turn long, turns long, first_turn long, last_turn long, costs array<long>, audits array<string>"
)
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Trail:
    """Edit sequences as linked nodes; node 0 is the empty one."""

    def __init__(self) -> None:
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.back: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... steps back

    def add(self, parent: int, edit: str) -> int:
        node = len(self.edit)
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * BASE + ord(edit)) % PRIME)
        steps, at, k = [parent], parent, 0
        while len(self.back[at]) > k:
            at = self.back[at][k]
            steps.append(at)
            k += 1
        self.back.append(steps)
        return node

    def ancestor(self, node: int, depth: int) -> int:
        up = self.depth[node] - depth
        while up:
            k = up.bit_length() - 1
            node = self.back[node][k]
            up -= 1 << k
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.back[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Whether two sequences of one length are equal, edit by edit down to the node they share."""
        while a != b:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.back[a][0], self.back[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the sequence of a is before that of b."""
        shared = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, shared), self.ancestor(b, shared)
        if self.hash[x] == self.hash[y] and self._same(x, y):
            return self.depth[a] < self.depth[b]
        for k in reversed(range(len(self.back[x]))):
            if k < len(self.back[x]) and self.hash[self.back[x][k]] != self.hash[self.back[y][k]]:
                x, y = self.back[x][k], self.back[y][k]
        if self.edit[x] == self.edit[y] or not self._same(self.back[x][0], self.back[y][0]):  # hashes met by chance
            return self.text(a) < self.text(b)
        return self.edit[x] < self.edit[y]


Heads = list[tuple[int, int] | None]  # per state: cost, node


def _best(trail: Trail, ways: list[tuple[int, int, str]]) -> tuple[int, int] | None:
    """The cheapest of (cost, parent, edit), the least in ASCII of those; an empty edit is the parent itself."""
    if not ways:
        return None
    cost = min(ways)[0]
    nodes = [trail.add(parent, edit) if edit else parent for c, parent, edit in ways if c == cost]
    best = nodes[0]
    for node in nodes[1:]:
        if trail.less(node, best):
            best = node
    return cost, best


def _insert(trail: Trail, heads: Heads) -> Heads:
    """The heads after up to two inserted rows."""
    out = list(heads)
    ways = [(h[0], h[1], "") for h in [heads[USER]] if h] + [(h[0] + 2, h[1], "I") for h in (heads[START], heads[SYSTEM], heads[ASSISTANT]) if h]
    out[USER] = _best(trail, ways)
    ways = [(h[0], h[1], "") for h in [heads[ASSISTANT]] if h] + [(h[0] + 2, h[1], "I") for h in [out[USER]] if h]
    out[ASSISTANT] = _best(trail, ways)
    return out


def _row(trail: Trail, heads: Heads, symbol: str) -> Heads:
    """The heads after one row."""
    heads = _insert(trail, heads)
    ways: list[list[tuple[int, int, str]]] = [[] for _ in STATES]
    role, more = symbol.lower(), int(symbol.isupper())
    for state, head in enumerate(heads):
        if head is None:
            continue
        cost, node = head
        ways[state].append((cost + 3, node, "D"))
        if role == "x":
            continue
        to = ASSISTANT if state == USER else USER
        ways[to].append((cost + 2 + more, node, "R"))
        if role == ("a" if state == USER else "u"):
            ways[to].append((cost + more, node, "K"))
        elif role == "s" and state == START:
            ways[SYSTEM].append((cost + more, node, "K"))
    return [_best(trail, w) for w in ways]


def transfer(symbols: str, entry: int) -> list[tuple[int, str] | None]:
    """(cost, audit) of the best way over the rows from a state to each state; inserts behind the last row are left out."""
    trail = Trail()
    heads: Heads = [None] * 4
    heads[entry] = (0, 0)
    for symbol in symbols:
        heads = _row(trail, heads, symbol)
    return [head and (head[0], trail.text(head[1])) for head in heads]


@lru_cache(1 << 14)
def transfer_again(symbols: str, entry: int) -> list[tuple[int, str] | None]:
    """`transfer`, remembered: most conversations are short and few row patterns are all there are."""
    return transfer(symbols, entry)


class Chain:
    """Audits of a conversation as linked blocks; block 0 is the empty beginning."""

    def __init__(self) -> None:
        self.parent, self.piece = [0], [""]

    def add(self, parent: int, piece: str) -> int:
        self.parent.append(parent)
        self.piece.append(piece)
        return len(self.piece) - 1

    def path(self, node: int, stop: int = 0) -> list[int]:
        out = []
        while node != stop:
            out.append(node)
            node = self.parent[node]
        return out[::-1]

    def text(self, node: int) -> str:
        return "".join(self.piece[n] for n in self.path(node))

    def less(self, a: int, b: int) -> bool:
        """Whether the audit of a is before that of b; both stand at the same block."""
        x, y = a, b
        while x != y:
            x, y = self.parent[x], self.parent[y]
        left, right = self.path(a, x), self.path(b, x)
        one = other = ""
        for m, n in zip(left, right):
            one, other = one + self.piece[m], other + self.piece[n]
            shared = min(len(one), len(other))
            if one[:shared] != other[:shared]:
                return one < other
            one, other = one[shared:], other[shared:]
        return one < other


def join_blocks(blocks: Iterator[list[list[tuple[int, str] | None]]]) -> tuple[int, str]:
    """(cost, audit) of the whole conversation; a block is its `transfer` from each state."""
    chain = Chain()
    heads: Heads = [(0, 0), None, None, None]

    def best(ways: list[tuple[int, int, str]]) -> tuple[int, int] | None:
        if not ways:
            return None
        cost = min(ways)[0]
        nodes = [chain.add(parent, piece) for c, parent, piece in ways if c == cost]
        for node in nodes[1:]:
            if chain.less(node, nodes[0]):
                nodes[0] = node
        return cost, nodes[0]

    for block in blocks:
        heads = [best([(h[0] + b[to][0], h[1], b[to][1]) for h, b in zip(heads, block) if h and b[to]]) for to in STATES]
    closing = ("", "II", "I", "")  # per state: rows that are still due
    cost, node = best([(h[0] + 2 * len(due), h[1], due) for h, due in zip(heads, closing) if h])
    return cost, chain.text(node)


def damage(rows: DataFrame) -> DataFrame:
    """c, turn, role, text, n (0 if dropped, 2 if repeated) of `conversations` rows after the stated damage."""
    c = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    turn = F.col("turn").cast("long")
    h = F.crc32(F.concat(c, F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return rows.select(
        c.alias("c"),
        turn.alias("turn"),
        F.when(h == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" "))).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("n"),
    ).withColumn("digest", F.unhex(F.md5("text")))


def whole(rows: DataFrame) -> DataFrame:
    """As `damage`, with nothing damaged."""
    return rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.lit(1).alias("n"),
    ).withColumn("digest", F.unhex(F.md5("text")))


def facts(rows: DataFrame) -> DataFrame:
    """One row per equal rows of `damage`: c, turn, role, digest, n, initial, blank, truncated, again (seen at an earlier turn)."""
    seen = F.trim("text", F.lit(SPACES))
    first = F.substring("role", 1, 1)
    slim = rows.select(
        "c",
        "turn",
        "role",
        "digest",
        "n",
        F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
        (seen == "").alias("blank"),
        (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    same = cut(slim.groupBy("c", "turn", "role", "digest", "initial", "blank", "truncated").agg(F.sum("n").alias("n")))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    head = same.filter("n > 0").groupBy("c", "role", "digest").agg(F.min(when).alias("head"))
    return same.join(head, ["c", "role", "digest"], "left").withColumn("again", ~F.col("turn").eqNullSafe(F.col("head.turn"))).drop("head")


def block_rows(told: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """BLOCK rows of `facts`: counts of each block, and its best ways between states."""
    order = ["c", "turn", "role", "digest"]
    placed = told.select(*order, "n", "initial", "blank", "truncated", "again").repartitionByRange(width(told.sparkSession), *order).sortWithinPartitions(*order)
    names = [x.strip().split()[0] for x in BLOCK.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, None

        def close() -> list:
            # what surely begins its conversation is entered at the start only
            entries = (START,) if held["begins"] else STATES
            symbols, initials, turns = "".join(held["symbols"]), "".join(held["initials"]), held["turns"]
            way = transfer_again if len(symbols) <= REMEMBERED_ROWS else transfer
            ways = [way(symbols, e) if e in entries else [None] * 4 for e in STATES]
            flat = [w for row in ways for w in row]
            return [
                held["c"], part, seq, len(symbols), *held["faults"],
                sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1)), initials[:1], initials[-1:],
                min(turns, default=None), max(turns, default=None), len(turns), turns[0] if turns else None, turns[-1] if turns else None,
                [w and w[0] for w in flat], [w and w[1] for w in flat],
            ]

        def fresh(c: str, begins: bool) -> dict:
            return {"c": c, "begins": begins, "symbols": [], "initials": [], "turns": [], "faults": [0, 0, 0]}

        for batch in batches:
            out = []
            for c, turn, _, _, n, initial, blank, truncated, again in zip(*(x.to_pylist() for x in batch.columns)):
                if held is None or held["c"] != c:
                    if held is not None:
                        out.append(close())
                        seq += 1
                    held = fresh(c, held is not None)
                for copy in range(n):
                    if len(held["symbols"]) == most:
                        out.append(close())
                        seq, held = seq + 1, fresh(c, False)
                    fault = 0 if blank else 1 if again or copy else 2 if truncated else None
                    if fault is not None:
                        held["faults"][fault] += 1
                    held["symbols"].append("x" if fault in (0, 1) else initial.upper() if fault == 2 else initial)
                    held["initials"].append(initial)
                    if turn is not None and held["turns"][-1:] != [turn]:
                        held["turns"].append(turn)
            if out:
                yield _batch(out, names, BLOCK_TYPES)
        if held is not None:
            yield _batch([close()], names, BLOCK_TYPES)

    return placed.mapInArrow(rows, BLOCK)


BLOCK_TYPES = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.string())]
PLAN_TYPES = [pa.string(), *[pa.int64()] * 6, pa.string()]


def _batch(rows: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names)


def plans(blocks: DataFrame) -> DataFrame:
    """c and COUNTS of every conversation, from its blocks in order."""
    names = ["c", *(x.split()[0] for x in COUNTS.split(", "))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (dict(zip(batch.schema.names, row)) for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns)))
        out = []
        for c, group in groupby(stream, lambda b: b["c"]):
            total = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            last, turns, last_turn, span = "", 0, None, []

            def passed() -> Iterator[list]:
                nonlocal last, turns, last_turn, span
                for b in group:
                    if not b["rows"]:
                        continue
                    for k in total:
                        total[k] += b[k]
                    total["illegal"] += bool(last) and last + b["first"] not in LEGAL
                    last = b["last"]
                    if b["turns"]:
                        turns += b["turns"] - (last_turn == b["first_turn"])
                        last_turn, span = b["last_turn"], [*span, b["least_turn"], b["most_turn"]]
                        span = [min(span), max(span)]
                    flat = [None if cost is None else (cost, audit) for cost, audit in zip(b["costs"], b["audits"])]
                    yield [flat[4 * e : 4 * e + 4] for e in STATES]

            cost, audit = join_blocks(passed())
            gaps = span[1] - span[0] + 1 - turns if span else 0
            out.append([c, gaps, *total.values(), cost, audit])
            if len(out) == 1000 or len(audit) > 100_000:
                yield _batch(out, names, PLAN_TYPES)
                out = []
        if out:
            yield _batch(out, names, PLAN_TYPES)

    return blocks.repartition("c").sortWithinPartitions("c", "part", "seq").mapInArrow(rows, f"c string, {COUNTS}")


def repaired_rows(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits of an audit, of rows in order."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K" and state == START and role[:1] == "s":
            state = SYSTEM
        else:
            state = ASSISTANT if state == USER else USER
            role = role if edit == "K" else "user" if state == USER else "assistant"
        yield role, text


def repair(rows: DataFrame, damaged: bool = False, texts: bool = False) -> DataFrame:
    """conv_id, COUNTS and repaired_sha256 of every conversation of `rows` (conv_id, turn, role, text).

    With `texts`, the repaired conversation is returned as well. With `damaged`, the rows are damaged first.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    ready = damage(rows) if damaged else whole(rows)
    plan = cut(plans(block_rows(facts(ready))))
    both = plan.withColumn("kind", F.lit(0)).unionByName(ready.filter("n > 0").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    columns = ["c", *(x.split()[0] for x in COUNTS.split(", ")), "role", "text", "n"]
    ordered = both.repartition("c").sortWithinPartitions("c", "kind", "turn", "role", "digest").select(*columns)
    names, types = [*columns[:8], "repaired_sha256", "repaired"], [*PLAN_TYPES, pa.string(), pa.string()]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns)))
        out = []
        for _, group in groupby(stream, lambda r: r[0]):
            head = next(group)
            turns = ((role, text) for *_, role, text, n in group for _ in range(n))
            sha, parts = hashlib.sha256(), []
            for i, (role, text) in enumerate(repaired_rows(head[7], turns)):
                line = f"{role}:{text}" if i == 0 else f"\n{role}:{text}"
                sha.update(line.encode("utf-8", "surrogatepass"))
                if texts:
                    parts.append(line)
            out.append([*head[:8], sha.hexdigest(), "".join(parts) if texts else None])
            if len(out) == 500 or len(head[7]) > 100_000:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    done = ordered.mapInArrow(digests, f"c string, {COUNTS}, repaired_sha256 string, repaired string")
    conv = F.when(F.col("c") != " ", F.col("c")).cast(kind).alias("conv_id")
    return done.select(conv, *columns[1:8], "repaired_sha256", *(["repaired"] if texts else []))
