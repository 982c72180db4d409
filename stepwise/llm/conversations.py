"""Operator 11, repair of conversations' structure by iterative-deepening A*.

A conversation's rows become one symbol each: role initial and fault. The search walks the rows with
a state of the wanted order ``(s?(ua)+)?`` (nothing yet, after s, after u, after a) and tries the
edits in ASCII order of their initials, Delete, Insert, Keep, Rerole, depth first under a cost bound.
Bounds grow to the least estimate that went beyond the last one. A transposition table keeps, for
every failed state (row, order state), the cost its rest is proven to exceed; it prunes and sharpens
the estimate. The first accepting path is the cheapest one and, among those, the ASCII-least.

Spark does the rest. Equal rows of a conversation (same turn, role and text) are one row with a count,
combined before the shuffle. Rows without their texts are ordered by range over all conversations, so
one conversation may lie in many parts. Chunks of ``CHUNK`` consecutive rows are searched apart: a
conversation in several chunks first gets, per chunk, the 4 x 4 costs between order states, a chain
of which gives each chunk its entry state and exact exit costs; inside a chunk, blocks of ``BLOCK``
rows are chained the same way. So no task holds a conversation; the chain has one small row per
chunk. Texts move once, dealt by conversation and sorted, into a running SHA-256 (which is sequential
by nature: one task streams a conversation's repaired texts, in constant memory).

Rules beyond the contract. Rows of one turn are ordered by role, then by the text's SHA-256, so equal
rows are adjacent and repeated ones duplicates. A null conv_id is a conversation. An empty role has no
initial: it is never legal and never kept. An initial is the role's first character, whatever follows.
Null roles and texts are one space; empty tables give empty results; very long texts are only hashed,
and read for their last character. Further columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

# Fixed values of the repair: costs of the edits, white space, signs that end a sentence.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACE, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: rows of a block of one search, of a chunk of one task (a power of two)
BLOCK, CHUNK_BITS = 24, 16
FAR = 1 << 60
#: order states: 0 nothing yet, 1 after s, 2 after u, 3 after a; the role that may be added and the state after it
ADDED = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, FAR, FAR, 0)
#: a row's symbol: its initial (s, u, a, o for others) if sound, the same in capitals if truncated, x if it must go


def least_cost(symbol: str, begun: bool) -> int:
    """What a row costs at least, whatever surrounds it; ``begun``: something is kept or added before it."""
    if symbol == "x":
        return DELETE
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    fits = role in "ua" or (role == "s" and not begun)
    return min(DELETE, extra + (0 if fits else REROLE))


@lru_cache(maxsize=200_000)
def search(symbols: str, entry: int, exits: tuple, last: bool) -> tuple[int, str, int]:
    """(cost, edits, exit state) of the cheapest, then ASCII-least edits of ``symbols`` from order state ``entry``;
    ``exits`` are the further costs of ending in each state. Edits are D, K, I and R; only ``last`` inserts at the end.
    Cost includes the exit's."""
    n, outside = len(symbols), min(exits)
    ahead = [[outside] * (n + 1) for _ in range(2)]
    for begun in (0, 1):
        for i in range(n - 1, -1, -1):
            ahead[begun][i] = ahead[begun][i + 1] + least_cost(symbols[i], bool(begun))
    failed: dict[tuple[int, int], int] = {}  # state -> the least its rest can cost

    def bound(i: int, state: int) -> int:
        return failed.get((i, state), ahead[state > 0][i])

    def edits(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        role, after = ADDED[state]
        if i == n:
            if last:
                yield "I", INSERT, i, after
            return
        symbol = symbols[i]
        yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, after
        if symbol != "x":
            extra = TRUNCATED if symbol.isupper() else 0
            kept = KEPT.get((state, symbol.lower()))
            if kept is not None:
                yield "K", extra, i + 1, kept
            if symbol.lower() != role:  # keeping it is cheaper and leads to the same state
                yield "R", REROLE + extra, i + 1, after

    def walk(i: int, state: int, budget: int) -> tuple[str, int] | None:
        """Edits from here within ``budget``, in ASCII order; None (and a sharper bound) if there are none."""
        if i == n and exits[state] <= budget:
            return "", state
        needed = exits[state] if i == n else FAR
        for edit, cost, j, after in edits(i, state):
            rest = bound(j, after)
            if cost + rest <= budget:
                found = walk(j, after, budget - cost)
                if found:
                    return edit + found[0], found[1]
                rest = bound(j, after)
            needed = min(needed, cost + rest)
        failed[i, state] = needed
        return None

    budget = bound(0, entry)
    while budget < FAR:
        found = walk(0, entry, budget)
        if found:
            return budget, *found
        budget = bound(0, entry)
    return FAR, "", -1


def row_costs(symbol: str) -> tuple[tuple[int, ...], ...]:
    """Least cost from each order state before a row (added rows first) to each state after it."""
    out = []
    for entry in range(4):
        to = [FAR] * 4
        state, added = entry, 0
        for _ in range(4):  # added rows alternate, so four reach every state
            to[state] = min(to[state], added + DELETE)
            if symbol != "x":
                extra = TRUNCATED if symbol.isupper() else 0
                kept = KEPT.get((state, symbol.lower()))
                if kept is not None:
                    to[kept] = min(to[kept], added + extra)
                changed = ADDED[state][1]
                to[changed] = min(to[changed], added + extra + REROLE)
            state, added = ADDED[state][1], added + INSERT
        out.append(tuple(to))
    return tuple(out)


ROW_COSTS = {s: row_costs(s) for s in "suaoSUAOx"}


def before(costs: tuple, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a row or chunk of ``costs``, from the costs to go after it."""
    return tuple(min(min(c + a for c, a in zip(line, after, strict=True)), FAR) for line in costs)


@lru_cache(maxsize=200_000)
def costs_to_go(symbols: str, after: tuple[int, ...]) -> tuple[int, ...]:
    for symbol in reversed(symbols):
        after = before(ROW_COSTS[symbol], after)
    return after


def chunk_costs(symbols: str) -> list[list[int]]:
    """4 x 4 least costs between the order states at the two ends of a chunk."""
    columns = []
    for state in range(4):
        after = tuple(0 if s == state else FAR for s in range(4))
        for at in range((len(symbols) - 1) // BLOCK * BLOCK, -1, -BLOCK):
            after = costs_to_go(symbols[at : at + BLOCK], after)
        columns.append(after)
    return [[columns[to][entry] for to in range(4)] for entry in range(4)]


#: costs to go behind the last row: nothing, u and a, a, nothing
FINAL = (0, 2 * INSERT, INSERT, 0)


def repair(symbols: str, entry: int = 0, after: tuple[int, ...] | None = None) -> tuple[str, int]:
    """(edits, exit state) of a conversation's rows, or of one chunk of them: ``after`` are the exact costs to go behind
    it (None: nothing follows)."""
    starts = range(0, len(symbols), BLOCK)
    beyond = [after or FINAL]
    for at in reversed(starts[1:]):
        beyond.append(costs_to_go(symbols[at : at + BLOCK], beyond[-1]))
    out = []
    for at in starts:
        last = after is None and at + BLOCK >= len(symbols)
        _, edits, entry = search(symbols[at : at + BLOCK], entry, ENDS if last else beyond[-1], last)
        out.append(edits)
        beyond.pop()
    return "".join(out), entry


# ----------------------------------------------------------------------------- Spark

def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of ``rows`` (conv_id, turn, role, text) after the damage that the CRC of
    ``conv_id:turn`` chooses; 0 copies: dropped."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
                       F.when(kind == 1, "").when(kind == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """The rows as they are, nulls as one space."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       F.lit(1).cast("long").alias("copies"))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """(place, conv_id, turn, role, digest, copies, sign): distinct rows without texts, numbered in order; sign is the last
    character of the text that isn't white space ('' in blank texts)."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    light = rows.where("copies > 0").select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.right(trimmed, F.lit(1)).alias("sign"), "copies")
    light = light.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("sign").alias("sign"))
    order = ["conv_id", "turn", "role", "digest"]
    placed = light.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("place", F.monotonically_increasing_id()), "conversation-rows")


def symbol_rows(ordered: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(chunk, place, conv_id, initial, fault, copies): fault is the row's first one, '' if sound."""
    first = ordered.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("sign") == "", "blank").when(F.col("first").isNull(), "duplicate").when(
        F.instr(F.lit(STOPS), F.col("sign")) == 0, "truncated").otherwise("")
    return ordered.join(first, "place", "left").select(
        F.shiftright("place", chunk_bits).alias("chunk"), "place", "conv_id", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        fault.alias("fault"), "copies")


def symbols_of(initials: list[str], faults: list[str]) -> str:
    return "".join("x" if f in ("blank", "duplicate") else r.upper() if f else r for r, f in zip(initials, faults, strict=True))


def seams(symbols: DataFrame) -> DataFrame:
    """(conv_id, chunk, after) for conversations in several chunks: the exact costs to go behind the chunk, by order state
    (null: nothing follows)."""
    spans = symbols.groupBy("conv_id").agg(F.min("chunk").alias("_lo"), F.max("chunk").alias("_hi")).where("_lo < _hi").select(
        F.col("conv_id").alias("_conv"))
    split = symbols.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")

    def costs(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        line = chunk_costs(symbols_of(rows["initial"].to_pylist(), rows["fault"].to_pylist()))
        return rows.select(["conv_id", "chunk"]).slice(0, 1).append_column("costs", pa.array([sum(line, [])], pa.list_(pa.int64())))

    def chain(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        after: list = [FINAL]
        for line in reversed(rows["costs"].to_pylist()[1:]):
            after.append(before(tuple(tuple(line[k : k + 4]) for k in range(0, 16, 4)), after[-1]))
        after[0] = None
        return rows.select(["conv_id", "chunk"]).append_column("after", pa.array(after[::-1], pa.list_(pa.int64())))

    pieces = split.groupBy("conv_id", "chunk").applyInArrow(costs, "conv_id long, chunk long, costs array<long>")
    return pieces.groupBy("conv_id").applyInArrow(chain, "conv_id long, chunk long, after array<long>")


def plans(symbols: str, edits: str, entry: int) -> list[str]:
    """What each row adds to the repaired conversation: u and a are added rows, K the row itself, U and A the row with the
    role user or assistant."""
    out, state, at, line = [], entry, 0, ""
    for edit in edits:
        role, after = ADDED[state]
        if edit == "I":
            line, state = line + role, after
            continue
        if edit == "K":
            line, state = line + "K", KEPT[state, symbols[at].lower()]
        elif edit == "R":
            line, state = line + role.upper(), after
        out.append(line)
        at, line = at + 1, ""
    out[-1] += line
    return out


SOLVED = ("conv_id long, chunk long, split boolean, entry int, leaves int, cost long, illegal long, opens string, closes string, audit string, "
          "plans array<struct<place: long, plan: string>>")


def solved(symbols: DataFrame, seams: DataFrame) -> DataFrame:
    """The repairs of every conversation's rows in a chunk; of a split conversation, from each of the four order states."""
    fields = [("conv_id", pa.int64()), ("chunk", pa.int64()), ("split", pa.bool_()), ("entry", pa.int32()), ("leaves", pa.int32()), ("cost", pa.int64()),
              ("illegal", pa.int64()), ("opens", pa.string()), ("closes", pa.string()), ("audit", pa.string()),
              ("plans", pa.list_(pa.struct([("place", pa.int64()), ("plan", pa.string())])))]

    def solve(rows: pa.Table, known: pa.Table) -> pa.Table:
        after = {conv: a and tuple(a) for conv, a in zip(known["conv_id"].to_pylist(), known["after"].to_pylist(), strict=True)}
        rows = rows.sort_by("place")
        convs, places, initials, faults, copies = (rows[c].to_pylist() for c in ("conv_id", "place", "initial", "fault", "copies"))
        out, start = [], 0
        while start < len(convs):
            end = start + 1
            while end < len(convs) and convs[end] == convs[start]:
                end += 1
            conv, own, more = convs[start], initials[start:end], copies[start:end]
            symbols = symbols_of(own, faults[start:end])
            illegal = sum(more) - len(more) + sum(a + b not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
            split = conv in after
            for entry in range(4) if split else (0,):
                edits, leaves = repair(symbols, entry, after.get(conv))
                audit, cost = audited(symbols, edits, more)
                kept = [{"place": p, "plan": x} for p, x in zip(places[start:end], plans(symbols, edits, entry), strict=True) if x]
                out.append((conv, rows["chunk"][0].as_py(), split, entry, leaves, cost, illegal, own[0], own[-1], audit, kept))
            start = end
        return pa.table([pa.array(c, f[1]) for c, f in zip(zip(*out, strict=True), fields, strict=True)] if out else [
            pa.array([], f[1]) for f in fields], names=[f[0] for f in fields])

    return symbols.groupBy("chunk").cogroup(seams.groupBy("chunk")).applyInArrow(solve, SOLVED)


def audited(symbols: str, edits: str, copies: list[int]) -> tuple[str, int]:
    """The edits' initials with a D for every further copy of a row behind the row's own, and their cost."""
    out, cost, at = [], 0, 0
    for edit in edits:
        out.append(edit)
        if edit == "I":
            cost += INSERT
            continue
        cost += DELETE if edit == "D" else (REROLE if edit == "R" else 0) + (TRUNCATED if symbols[at].isupper() else 0)
        out.append("D" * (copies[at] - 1))
        cost += DELETE * (copies[at] - 1)
        at += 1
    return "".join(out), cost


def chosen(pieces: DataFrame) -> DataFrame:
    """The ``solved`` rows whose entry state is the one that the chunk before leaves; illegal counts the seam too."""

    def chain(rows: pa.Table) -> pa.Table:
        state, previous, out = 0, None, []
        for r in sorted(rows.to_pylist(), key=lambda r: (r["chunk"], r["entry"])):
            if out and out[-1]["chunk"] == r["chunk"]:
                continue
            if r["entry"] == state:
                seam = int(previous is not None and previous + r["opens"] not in ("su", "ua", "au"))
                out.append({"chunk": r["chunk"], "_conv": r["conv_id"], "_chunk": r["chunk"], "_entry": state, "_seam": seam})
                state, previous = r["leaves"], r["closes"]
        return pa.table([pa.array([o[k] for o in out], t) for k, t in kinds], names=[k for k, _ in kinds])

    kinds = [("_conv", pa.int64()), ("_chunk", pa.int64()), ("_entry", pa.int32()), ("_seam", pa.int64())]
    split = pieces.where("split")
    picks = split.select("conv_id", "chunk", "entry", "leaves", "opens", "closes").groupBy("conv_id").applyInArrow(
        chain, "_conv long, _chunk long, _entry int, _seam long")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk")) & (F.col("entry") == F.col("_entry"))
    through = split.join(picks, same).withColumn("illegal", F.col("illegal") + F.col("_seam")).drop("_conv", "_chunk", "_entry", "_seam")
    return pieces.where("not split").unionByName(through)


def repaired_hashes(rows: DataFrame, ordered: DataFrame, choice: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations that keep or add a row: ``role:text`` lines in order, joined by newlines."""
    key = ["conv_id", "turn", "role", "digest"]
    what = choice.select(F.inline("plans"))
    what = ordered.join(what, "place").select(*key, F.lit(0).alias("kind"), F.lit("").alias("text"), "plan")
    texts = rows.where("copies > 0").select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.lit(1).alias("kind"), "text",
                                            F.lit("").alias("plan"))
    dealt = what.unionByName(texts).repartition("conv_id").sortWithinPartitions(*key, "kind").drop("turn", "digest")
    names = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, waiting = (), None, ""

        def add(line: str) -> None:
            nonlocal sha
            if sha is None:
                sha = hashlib.sha256(line.encode())
            else:
                sha.update(b"\n" + line.encode())

        def added(codes: str) -> str:
            """Adds the added rows that come first; the rest starts with the row itself."""
            while codes and codes[0] in "ua":
                add(f"{names[codes[0]]}:")
                codes = codes[1:]
            return codes

        for batch in batches:
            done = []
            for conv, role, kind, text, plan in zip(*(batch.column(i) for i in range(5)), strict=True):
                if now != (conv.as_py(),):
                    if sha is not None:
                        done.append((now[0], sha.hexdigest()))
                    now, sha, waiting = (conv.as_py(),), None, ""
                if kind.as_py() == 0:
                    waiting = added(plan.as_py())
                elif waiting:
                    add(f"{names.get(waiting[0]) or role.as_py()}:{text.as_py()}")
                    waiting = added(waiting[1:])
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.string()))],
                                             names=["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return dealt.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair_report(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row per conversation of ``rows`` (``damage`` or ``undamaged``): gaps, blank, duplicate, truncated, illegal, cost,
    audit and repaired_sha256. At most 2 ** ``chunk_bits`` distinct rows are repaired in one call."""
    ordered = ordered_rows(rows)
    symbols = stored(symbol_rows(ordered, chunk_bits), "conversation-symbols")
    choice = stored(chosen(stored(solved(symbols, seams(symbols)), "conversation-repairs")), "conversation-choice")
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    turns = rows.groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn)).alias("gaps"))
    one, all_but_one = F.lit(1), F.col("copies") - 1
    faults = symbols.groupBy("conv_id").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("copies"))).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("copies")).when(F.col("fault") != "blank", all_but_one)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", one)).alias("truncated"))
    edits = choice.select("conv_id", "illegal", "cost", F.struct("chunk", "audit").alias("audit"))
    shas = repaired_hashes(rows, ordered, choice)
    parts = turns
    for more in (faults, edits, shas):
        parts = parts.unionByName(more, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    report = parts.groupBy("conv_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts),
                                          F.sort_array(F.collect_list("audit")).alias("audit"), F.max("repaired_sha256").alias("repaired_sha256"))
    return report.withColumn("audit", F.array_join("audit.audit", "")).withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
