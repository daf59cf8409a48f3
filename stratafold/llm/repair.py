"""Repair of the order of speakers in conversations, by Four-Russians block tables.

A conversation's rows are edited at the least cost so that the initials of their roles read ``(s?(ua)+)?``: a row is kept (0), gets
another role (``RENAME``) or is deleted (``DELETE``; blank and repeated rows must be), an empty row may be put in anywhere
(``INSERT``), and each undeleted row that breaks off costs ``BROKEN``. Where several sets of edits are cheapest, the one whose letters
(D, I, K, R in order) are least in ASCII is taken; it is the only one, since a letter and the state before it give the state after it.

The state is what stands at the end so far: nothing, a system row, a user row, an assistant row. What the rest of a conversation costs
from each state is a vector of four numbers; less its least, it takes one of a small fixed number of forms, because edits lead from any
state to any other at a bounded cost. So the change that a row makes is an entry of a table (form, row's kind) -> (form, cost), and so
is that of every block of ``BLOCK`` rows. Conversations are read from the end, a block a lookup; the forms at the block limits are
kept, and blocks are expanded backward where the edits are traced, letter by letter, the least first.

Spark orders the rows (range partitions, so that a conversation of any length spans tasks), finds faults by aggregates, and turns
``CHUNK`` rows at most into one string of kinds. A long conversation's chunks are mapped for every form that may follow them and
traced for every state that may precede them, each in its own task; only one entry per chunk is put in sequence. Texts stay outside the
tables; the digest of a repaired conversation is a stream over its sorted rows, of which none is held. The list of edits of a
conversation is one string by contract.

Nulls in ``conv_id``, ``turn``, ``role`` or ``text`` count as one space where they are written; rows with a null ``conv_id`` are one
conversation, null turns come first. Rows with one turn are ordered by role and text; equal rows stay, the second one as a repeat.
A conversation without rows has no edits and the digest of nothing. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions.ordered import running_totals
from stratafold.llm.common import stored

RENAME, DELETE, INSERT, BROKEN = 1, 2, 5, 5
#: Rows of a block, and of a chunk that one row of kinds holds.
BLOCK, CHUNK = 3, 1 << 16
#: Kinds of rows: one that must go; else its role's initial (user, assistant, system, other), upper case if its text breaks off.
KINDS = "xuasoUASO"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Initials that may follow in a state.
INITIALS = {NOTHING: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}


def _moves(kind: str, state: int):
    """Edits of a row of a kind in a state: letter, cost, initial of the row that stays, state after it."""
    yield "D", DELETE, "-", state
    if kind != "x":
        own, broken = kind.lower(), BROKEN * kind.isupper()
        for initial in INITIALS[state]:
            if initial == own:
                yield "K", broken, initial, STATE_OF[initial]
            elif initial in "ua":
                yield "R", RENAME + broken, initial, STATE_OF[initial]


def _inserts(state: int):
    """Rows that may be put in: initial and state after it."""
    for initial in INITIALS[state]:
        if initial in "ua":
            yield initial, STATE_OF[initial]


def _closed(costs: list[int]) -> list[int]:
    """Costs from each state when rows may be put in first."""
    for _ in range(3):
        costs = [min([c, *(INSERT + costs[after] for _, after in _inserts(s))]) for s, c in enumerate(costs)]
    return costs


#: Costs from each state when no row is left; the end must be after nothing or an assistant row.
END = tuple(_closed([0, 99, 99, 0]))


def _stepped(costs: tuple[int, ...], kind: str) -> list[int]:
    return _closed([min(cost + costs[after] for _, cost, _, after in _moves(kind, s)) for s in range(4)])


@lru_cache(1)
def tables() -> tuple[list[tuple[int, ...]], list[dict[str, tuple[int, int]]]]:
    """The forms that can occur, the first one that of the end, and for each the entries of all blocks of 1 to ``BLOCK`` kinds."""
    forms, number, single = [END], {END: 0}, []
    for form in forms:  # grows while it is walked
        entry = {}
        for kind in KINDS:
            costs = _stepped(form, kind)
            low = min(costs)
            new = tuple(c - low for c in costs)
            if new not in number:
                number[new] = len(forms)
                forms.append(new)
            entry[kind] = (number[new], low)
        single.append(entry)
    blocks = [dict(e) for e in single]
    for length in range(2, BLOCK + 1):
        for f, entry in enumerate(single):
            for kind in KINDS:
                after, cost = entry[kind]
                for rest in product(KINDS, repeat=length - 1):
                    before, more = blocks[after]["".join(rest)]
                    blocks[f]["".join(rest) + kind] = (before, cost + more)
    return forms, blocks


def cost_before(kinds: str, form: int = 0) -> tuple[int, int, list[int]]:
    """What ``kinds`` and what follows them in ``form`` cost, less that form's least: the form before, the added cost, and the forms at the block limits from the end on."""
    _, blocks = tables()
    cost, limits, end = 0, [form], len(kinds)
    while end:
        begin = (end - 1) // BLOCK * BLOCK
        form, more = blocks[form][kinds[begin:end]]
        cost += more
        limits.append(form)
        end = begin
    return form, cost, limits


def trace(kinds: str, state: int = NOTHING, form: int = 0, last: bool = True) -> tuple[list[str], int]:
    """The cheapest edits, least letters first: per row the initials put in before it, its letter and what it becomes; and the state after.

    ``last`` adds what is put in behind all rows.
    """
    forms, blocks = tables()
    limits = cost_before(kinds, form)[2][::-1]
    steps = []
    for b, begin in enumerate(range(0, len(kinds), BLOCK)):
        block = kinds[begin:begin + BLOCK]
        ahead = [(limits[b + 1], 0)]  # forms between the block's rows, from its end
        for kind in reversed(block):
            after, cost = blocks[ahead[-1][0]][kind]
            ahead.append((after, ahead[-1][1] + cost))
        costs = [[c + cost for c in forms[f]] for f, cost in reversed(ahead)]
        for i, kind in enumerate(block):
            put = ""
            while True:
                left = costs[i][state]
                choices = [(letter, initial, after) for letter, cost, initial, after in _moves(kind, state) if cost + costs[i + 1][after] == left]
                choices += [("I", initial, after) for initial, after in _inserts(state) if INSERT + costs[i][after] == left]
                letter, initial, state = min(choices)
                if letter != "I":
                    break
                put += initial
            steps.append(put + letter + initial)
    if last:
        put = ""
        while END[state]:
            initial, state = next((i, s) for i, s in _inserts(state) if INSERT + END[s] == END[state])
            put += initial
        steps.append(put)
    return steps, state


def _written(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy`` after the damage that crc32 of ``conv_id:turn`` sets: dropped, emptied, without ``.!?``, repeated, said by the user."""
    code = F.crc32(F.concat(_written("conv_id"), F.lit(":"), _written("turn")).cast("binary")) % 20
    some = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _written("role").alias("role"),
                       _written("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return some.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``conv`` (a key without nulls), ``place`` from 0 and ``initial``."""
    keyed = rows.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "turn", "role", "text", "copy",
                        F.substring("role", 1, 1).alias("initial"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]
    numbered = running_totals(keyed, ["conv"], order, {"place": F.lit(1).cast("long")})
    return numbered.withColumn("place", F.col("place") - 1)


def faults(rows: DataFrame) -> DataFrame:
    """Ordered rows with their first ``fault`` (blank, duplicate, truncated or none) and their ``kind``."""
    said = [F.xxhash64("role", "text").alias("h1"), F.crc32(F.concat_ws("\0", "text", "role").cast("binary")).alias("h2"), F.length("text").alias("h3")]
    marked = rows.select("*", *said)
    first = marked.groupBy("conv", "h1", "h2", "h3").agg(F.min("place").alias("first"))
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    own = F.when(F.col("initial").isin("u", "a", "s"), F.col("initial")).otherwise("o")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(own)).otherwise(own)
    return marked.join(first, ["conv", "h1", "h2", "h3"]).withColumn("fault", fault).withColumn("kind", kind).drop("h1", "h2", "h3", "first")


def _counts(rows: DataFrame) -> DataFrame:
    """Gaps, faults and illegal neighbours; neighbours meet by their place."""
    count = lambda word: F.count(F.when(F.col("fault") == word, 1)).alias(word)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count(F.when(F.col("new"), 1)), F.lit(0)).alias("gaps")
    turns = rows.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.min("place").alias("place"), F.lit(True).alias("new"))
    after = rows.select("conv", (F.col("place") - 1).alias("place"), F.col("initial").alias("then"))
    both = rows.join(turns.drop("turn"), ["conv", "place"], "left").join(after, ["conv", "place"], "left")
    odd = F.col("then").isNotNull() & ~F.concat("initial", "then").isin("su", "ua", "au")
    return both.groupBy("conv").agg(gaps, count("blank"), count("duplicate"), count("truncated"), F.count(F.when(odd, 1)).alias("illegal"))


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """A row per ``size`` places: ``conv, chunk, kinds, n`` with the number of chunks."""
    part = F.floor(F.col("place") / size).alias("chunk")
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda r: r["kind"]), "")
    made = rows.groupBy("conv", part).agg(kinds.alias("kinds"))
    return made.join(rows.groupBy("conv").agg((F.floor(F.max("place") / size) + 1).alias("n")), "conv")


def _mapped(batches):
    """Per chunk of a longer conversation the form before it and the cost for every form after it."""
    number = len(tables()[0])
    for batch in batches:
        out = [[cost_before(kinds, f)[:2] for f in range(number)] for kinds in batch.column("kinds").to_pylist()]
        yield pa.record_batch([batch.column("conv"), batch.column("chunk"), pa.array([[f for f, _ in o] for o in out], pa.list_(pa.int32())),
                               pa.array([[c for _, c in o] for o in out], pa.list_(pa.int64()))], names=["conv", "chunk", "before", "costs"])


def _linked(group: pa.Table) -> pa.Table:
    """The form after each chunk of one conversation."""
    form, out = 0, []
    for row in group.select(["conv", "chunk", "before"]).sort_by([("chunk", "descending")]).to_pylist():
        out.append((row["conv"], row["chunk"], form))
        form = row["before"][form]
    return pa.table({"conv": [r[0] for r in out], "chunk": pa.array([r[1] for r in out], pa.int64()), "form": pa.array([r[2] for r in out], pa.int32())})


def _traced(batches):
    """Per chunk and state before it: the steps, the state after it, and what it adds to the cost of the whole."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            last = row["chunk"] == row["n"] - 1
            before, cost, _ = cost_before(row["kinds"], row["form"])
            for state in range(4) if row["chunk"] else [NOTHING]:
                steps, after = trace(row["kinds"], state, row["form"], last)
                out.append((row["conv"], row["chunk"], state, after, cost + (0 if row["chunk"] else tables()[0][before][NOTHING]), steps))
        names = ["conv", "chunk", "state", "after", "cost", "steps"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        yield pa.record_batch([pa.array([r[i] for r in out], kinds[i]) for i in range(6)], names=names)


def _entered(group: pa.Table) -> pa.Table:
    """The state before each chunk of one conversation."""
    after = {(r["chunk"], r["state"]): r["after"] for r in group.select(["chunk", "state", "after"]).to_pylist()}
    state, out = NOTHING, []
    for chunk in range(max(c for c, _ in after) + 1):
        out.append(state)
        state = after[chunk, state]
    return pa.table({"conv": [group["conv"][0].as_py()] * len(out), "chunk": pa.array(range(len(out)), pa.int64()), "state": pa.array(out, pa.int32())})


def edits(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``conv, chunk, cost, steps`` of ordered rows with faults; a step per row, and one behind the last chunk's for what is put in there."""
    chunks = stored(_chunks(rows, size), "chunks")
    long = chunks.filter("n > 1").select("conv", "chunk", "kinds").mapInArrow(_mapped, "conv string, chunk long, before array<int>, costs array<long>")
    forms = long.groupBy("conv").applyInArrow(_linked, "conv string, chunk long, form int")
    known = chunks.filter("n = 1").withColumn("form", F.lit(0)).unionByName(chunks.filter("n > 1").join(forms, ["conv", "chunk"]))
    traced = stored(known.select("conv", "chunk", "n", "kinds", "form").mapInArrow(
        _traced, "conv string, chunk long, state int, after int, cost long, steps array<string>"), "traced")
    alone = chunks.filter("n = 1").select("conv", "chunk", F.lit(NOTHING).alias("state"))
    states = traced.join(chunks.filter("n > 1").select("conv").distinct(), "conv", "left_semi").groupBy("conv").applyInArrow(
        _entered, "conv string, chunk long, state int")
    return traced.join(alone.unionByName(states), ["conv", "chunk", "state"]).select("conv", "chunk", "cost", "steps")


def repaired(rows: DataFrame, steps: DataFrame, size: int = CHUNK) -> DataFrame:
    """``conv, place, role, text, first`` of what the edits leave, in order of ``place`` and ``first``."""
    each = steps.select("conv", "chunk", F.posexplode("steps").alias("i", "step")).select(
        "conv", (F.col("chunk") * size + F.col("i")).alias("place"), "step")
    split = each.select("conv", "place", F.regexp_extract("step", "^([ua]*)", 1).alias("put"), F.regexp_extract("step", "([DKR].)$", 1).alias("done"))
    named = lambda c: F.when(c == "u", "user").otherwise("assistant")
    put = split.filter("put <> ''").select("conv", "place", F.posexplode(F.split("put", "")).alias("first", "c")).filter("c <> ''").select(
        "conv", "place", "first", named(F.col("c")).alias("role"), F.lit("").alias("text"))
    kept = rows.join(split.filter("done <> '' AND done NOT LIKE 'D%'"), ["conv", "place"])
    role = F.when(F.col("done").startswith("R"), named(F.substring("done", 2, 1))).otherwise(F.col("role"))
    return kept.select("conv", "place", F.lit(9).alias("first"), role.alias("role"), "text").unionByName(put)


def _digests(batches):
    """SHA-256 of each conversation's lines, from rows sorted by conversation and place; only the running digest is held."""
    now, digest = None, None
    for batch in batches:
        out = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
            line = f"{role}:{text}".encode()
            if conv != now or digest is None:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
        yield pa.record_batch([pa.array([c for c, _ in out], pa.string()), pa.array([d for _, d in out], pa.string())], names=["conv", "repaired_sha256"])
    if digest is not None:
        yield pa.record_batch([pa.array([now], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])


def digests(lines: DataFrame) -> DataFrame:
    rows = lines.repartition("conv").sortWithinPartitions("conv", "place", "first").select("conv", "role", "text")
    return rows.mapInArrow(_digests, "conv string, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row per conversation of ``conversations`` with what is wrong in its ``rows``, the edits and the digest of the repaired rows.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.
    """
    found = stored(faults(ordered(rows)), "faults")
    steps = stored(edits(found, size), "edits")
    letters = F.array_join(F.transform("steps", lambda s: F.regexp_replace(F.regexp_replace(s, "([DKR]).$", "$1"), "[ua]", "I")), "")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", letters.alias("l")))), lambda r: r["l"]), "")
    made = steps.groupBy("conv").agg(F.sum("cost").alias("cost"), audit.alias("audit"))
    all_ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"))
    whole = all_ids.join(_counts(found), "conv", "left").join(made, "conv", "left").join(digests(repaired(found, steps, size)), "conv", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select("conv_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in numbers],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
