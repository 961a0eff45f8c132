"""Operator 11, repair of conversation structure by prefix-doubling path ranking.

A conversation's rows (by turn, nulls first; rows of one turn by role, then by the SHA-256 of the
text) become, by the cheapest edits, a sequence whose role initials spell ``(s?(ua)+)?``. Keep costs
0, Rerole to user/assistant 3, Delete 4 (the only way for blank rows and for duplicates), Insert of an
empty user/assistant row 3; a truncated row that isn't deleted adds 3. A conversation's *audit* is its
edits' initials; among the cheapest the least in ASCII order is taken.

Nodes are (row, state): the state says which role the next row may have. A *block* is a run of at most
``BLOCK`` rows of one conversation, so a conversation of any length is spread over tasks:

1. Rows are dealt by ranges of (conversation, turn, role, text hash), equal rows as one with a
   count, and packed into blocks. Each block gets the least costs from its four entry states to its
   four exit states.
2. Blocks double their reach along the conversation (block b joins block b + 2^k), which gives the
   cost to go behind every block.
3. With that a block knows the cost to go of its nodes and so its optimal arcs. Nodes are ranked by
   audits of 1, 2, 4, ... arcs: a node's rank after a round comes from its own rank and the rank at
   its pointer, which then points twice as far. At each node the arc with the least letter, then the
   least rank behind it, is taken; the path is read off the doubled pointers.
4. The blocks' entry-to-exit maps are doubled in the same way, which tells each block its entry.

Texts take no part until the end, when the rows that stay fetch theirs.

Defined results: null roles and texts are one space (so such a text is blank); a null turn comes
first and isn't a turn number; a null ``conv_id`` is a conversation of its own; an unknown role must be
rerolled or deleted; equal rows are duplicates of the first; texts of any length are only hashed and
passed on; an empty table gives an empty result; other columns are dropped, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship_package

#: Rows of one conversation that one task handles at once.
BLOCK = 1024
#: Arcs of a path that are read off at once.
PATH_ARCS = 1 << 20

RETYPE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
FAR = 1 << 50
#: Role initials as codes, and states: 0 nothing yet, 1 after s, 2 after u, 3 after a.
CODES = {"s": 1, "u": 2, "a": 3}
INSERTED = np.array([2, 2, 3, 2])
#: Cost from each state to the end: only inserts are left.
AT_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
LETTERS = np.array(["", "D", "I", "K", "R"])
ROLES = ["", "", "user", "assistant"]

SPACE = r"\x20\x09-\x0D"
IS_BLANK = f"[^{SPACE}]"
IS_CUT_OFF = rf"[^.!?{SPACE}][{SPACE}]*\z"


def conversation_key(conv_id: str = "conv_id") -> Column:
    """A text that is different for different ids, null included."""
    return F.concat(F.when(F.col(conv_id).isNull(), "n").otherwise("v"), F.coalesce(F.col(conv_id).cast("string"), F.lit("")))


def marked(rows: DataFrame) -> DataFrame:
    """Rows with their conversation's ``key``, the turn as text, the text's hash and whether it is
    blank or cut off."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(
        "conv_id", conversation_key().alias("key"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("turn").cast("long").cast("string"), F.lit("")).alias("turn_text"), role.alias("role"), text.alias("text"),
        F.sha2(text, 256).alias("text_sha"), (~text.rlike(IS_BLANK)).alias("blank"), text.rlike(IS_CUT_OFF).alias("open"))


def faults(rows: DataFrame) -> DataFrame:
    """Marked rows to distinct ones: ``copies`` counts equal rows; ``repeat`` says that role and text
    were seen in an earlier turn."""
    alike = cut(rows.groupBy("key", "turn_text", "role", "text_sha").agg(
        F.max("conv_id").alias("conv_id"), F.max("turn").alias("turn"), F.count(F.lit(1)).alias("copies"),
        F.max("blank").alias("blank"), F.max("open").alias("open")), "alike")
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    again = (alike.groupBy("key", "role", "text_sha").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("times"))
             .where("times > 1").select("key", "role", "text_sha", "earliest"))
    return (alike.join(again, ["key", "role", "text_sha"], "left")
            .withColumn("repeat", F.coalesce(place > F.col("earliest"), F.lit(False))).drop("earliest"))


def _steps(code, forced, open_, copies, after):
    """Costs at four states before a row, from those behind it (last two axes: state, column)."""
    base = DELETE * (copies - 1)[:, None]
    out = after + (base + DELETE)[:, :, None]
    stay = np.where(forced, FAR, base[:, 0] + CUT_OFF * open_)[:, None]
    to_user = np.minimum(after[:, 2] + stay + RETYPE * (code != 2)[:, None], FAR)
    to_assistant = np.minimum(after[:, 3] + stay + RETYPE * (code != 3)[:, None], FAR)
    first = np.where((code == 1)[:, None], np.minimum(after[:, 1] + stay, FAR), FAR)
    out[:, 0] = np.minimum(out[:, 0], np.minimum(first, to_user))
    out[:, 1] = np.minimum(out[:, 1], to_user)
    out[:, 2] = np.minimum(out[:, 2], to_assistant)
    out[:, 3] = np.minimum(out[:, 3], to_user)
    # inserts before the row: one or two, a third leads back
    once, twice = out[:, INSERTED] + INSERT, out[:, INSERTED[INSERTED]] + 2 * INSERT
    return np.minimum(np.minimum(out, FAR), np.minimum(once, twice))


def cost_to_go(size, code, forced, open_, copies, end, keep: bool):
    """Least costs at four states before each block (``end``: blocks x states x columns behind it), and
    with ``keep`` at all nodes (rows of a block, then its end)."""
    head = np.cumsum(size) - size
    now = end.copy()
    nodes = np.zeros((int(size.sum()) + len(size), 4), np.int64) if keep else None
    first = head + np.arange(len(size))
    if keep:
        nodes[first + size] = end[:, :, 0]
    order = np.argsort(-size, kind="stable")
    upto = np.searchsorted(-size[order], -np.arange(int(size.max()) if len(size) else 0), side="left")
    for i in range(len(upto) - 1, -1, -1):
        b = order[:upto[i]]  # blocks with more than i rows
        r = head[b] + i
        now[b] = _steps(code[r], forced[r], open_[r], copies[r], now[b])
        if keep:
            nodes[first[b] + i] = now[b, :, 0]
    return now, nodes


def optimal_arcs(size, code, forced, open_, copies, nodes, last):
    """Of every node (4 a row and block end) the arcs on cheapest paths: letter codes and targets,
    four a node; a missing arc has letter 9 and leads to itself."""
    n = len(nodes)
    ends = np.cumsum(size + 1) - 1
    end = np.zeros(n, bool)
    end[ends] = True
    block = np.repeat(np.arange(len(size)), size + 1)
    row = np.minimum(np.arange(n) - block, max(len(code) - 1, 0))  # unused at ends
    take = (lambda x: x[row]) if len(code) else (lambda x: np.zeros(n, x.dtype))
    code, forced, open_, copies = take(code), take(forced), take(open_), take(copies)
    me = np.arange(n)
    letter = np.full((n, 4, 4), 9)
    target = np.broadcast_to((me[:, None] * 4 + np.arange(4))[:, :, None], (n, 4, 4)).copy()
    nxt = np.minimum(me + 1, n - 1)
    base = DELETE * (copies - 1)
    for s in range(4):
        def arc(kind, ok, cost, to):
            on = ok & (cost == nodes[:, s]) & (nodes[:, s] < FAR)
            letter[on, s, kind - 1] = kind
            target[on, s, kind - 1] = to[on]

        arc(1, ~end, base + DELETE + nodes[nxt, s], nxt * 4 + s)
        # at a block's end inserts follow only if it is the conversation's end
        closing = last[block] & (s in (1, 2))
        arc(2, ~end | closing, INSERT + nodes[:, INSERTED[s]], me * 4 + INSERTED[s])
        to = INSERTED[s]
        stay = base + CUT_OFF * open_
        arc(3, ~end & ~forced & (code == to), stay + nodes[nxt, to], nxt * 4 + to)
        arc(4, ~end & ~forced & (code != to), stay + RETYPE + nodes[nxt, to], nxt * 4 + to)
        if s == 0:
            first = ~end & ~forced & (code == 1) & (stay + nodes[nxt, 1] == nodes[:, 0]) & (nodes[:, 0] < FAR)
            letter[first, 0, 2], target[first, 0, 2] = 3, nxt[first] * 4 + 1
    return letter.reshape(-1, 4), target.reshape(-1, 4)


def rank_paths(letter, target):
    """Prefix doubling over nodes: the arc each node takes, its letter, and the doubled pointers
    (``pointers[k]`` is 2^k arcs ahead; a node without arcs points to itself)."""
    nodes = np.arange(len(letter))
    pick = np.argmin(letter, axis=1)
    own = letter[nodes, pick]
    rank = np.where(own == 9, 0, own).astype(np.int64)
    pointer = target[nodes, pick]
    while True:
        step = pointer[pointer]
        rank = np.unique(rank * (len(nodes) + 5) + rank[pointer], return_inverse=True)[1]
        if np.array_equal(step, pointer):
            break
        pointer = step
    pick = np.argmin(letter * (len(nodes) + 5) + rank[target], axis=1)
    own, pointer = letter[nodes, pick], target[nodes, pick]
    pointers = [pointer]
    while not np.array_equal(ahead := pointers[-1][pointers[-1]], pointers[-1]):
        pointers.append(ahead)
    return np.where(own == 9, 0, own), pointers


def read_paths(starts, most, pointers):
    """All nodes of the paths from ``starts`` (each of at most ``most`` arcs) off the pointers: ``(path
    number, node)`` in order, path ends (which repeat) included."""
    levels = np.minimum(np.ceil(np.log2(np.maximum(most + 1, 2))).astype(int), len(pointers))
    for k in np.unique(levels):
        mine = np.flatnonzero(levels == k)
        chunk = max(1, PATH_ARCS >> int(k))
        for a in range(0, len(mine), chunk):
            who = mine[a:a + chunk]
            path = starts[who][:, None]
            for j in range(int(k) - 1, -1, -1):
                path = np.stack([path, pointers[j][path]], axis=2).reshape(len(who), -1)
            yield who, path


def _flat(batch: pa.RecordBatch, names: list[str]):
    """Rows' numpy columns of a batch of blocks, and rows per block."""
    size = pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64)
    return size, *[batch.column(n).flatten().to_numpy(zero_copy_only=False) for n in names]


def _pack(part: int, most: int):
    """Sorted rows of a partition to blocks, each with its costs from entry to exit states."""

    def pack(table: pa.Table, number: int, final: bool):
        """Blocks of a table; the last (maybe unfinished) one stays back unless ``final``."""
        n = table.num_rows
        key = table.column("key").combine_chunks()
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        place = np.arange(n) - start
        heads = np.flatnonzero(place % most == 0)
        no = place[heads] // most + np.where(start[heads] == 0, number, 0)
        if not final:
            rest, again = table.slice(heads[-1]), int(no[-1])
            table, heads, no = table.slice(0, heads[-1]), heads[:-1], no[:-1]
        else:
            rest, again = table.slice(n), 0
        if not len(heads):
            return None, rest, again
        return emit(table, heads, no), rest, again

    def emit(table: pa.Table, heads, no):
        n = table.num_rows
        size = np.diff(np.append(heads, n))
        col = {c: table.column(c).combine_chunks() for c in table.column_names}
        first_letter = pc.utf8_slice_codeunits(col["role"], 0, 1).to_pylist()
        code = np.array([CODES.get(x, 0) for x in first_letter], np.int64)
        blank, repeat, open_ = (col[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("blank", "repeat", "open"))
        copies = col["copies"].to_numpy()
        forced = blank | repeat
        open_ = open_ & ~forced
        numbered = col["turn"].is_valid().to_numpy(zero_copy_only=False)
        turn = col["turn"].fill_null(0).to_numpy()
        eye = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(size), 4, 4)).astype(np.int64)
        costs, _ = cost_to_go(size, code, forced, open_, copies, eye, keep=False)
        inner = np.ones(n, bool)
        inner[heads] = False
        before = np.maximum(np.arange(n) - 1, 0)
        legal = ((code[before] == 1) & (code == 2)) | ((code[before] == 2) & (code == 3)) | ((code[before] == 3) & (code == 2))
        illegal = copies - 1 + (inner & ~legal)
        newturn = numbered & ~(inner & numbered[before] & (turn[before] == turn))
        duplicate = np.where(blank, 0, np.where(repeat, copies, copies - 1))
        total = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), heads))
        lo, hi = np.where(numbered, turn, np.iinfo(np.int64).max), np.where(numbered, turn, np.iinfo(np.int64).min)
        offsets = pa.array(np.append(heads, n).astype(np.int32))
        ends = np.append(heads[1:], n) - 1
        packed = lambda x: pa.ListArray.from_arrays(offsets, x)
        tail = lambda c, at: col[c].take(pa.array(at))
        return pa.RecordBatch.from_pydict({
            "key": tail("key", heads), "conv_id": tail("conv_id", heads), "part": pa.array(np.full(len(heads), part, np.int32)),
            "no": pa.array(no.astype(np.int64)), "costs": pa.ListArray.from_arrays(
                pa.array(np.arange(len(heads) + 1, dtype=np.int32) * 16), pa.array(costs.reshape(-1))),
            "blank": total(np.where(blank, copies, 0)), "duplicate": total(duplicate), "truncated": total(open_),
            "illegal": total(illegal), "turns": total(newturn),
            "low": pa.array(np.minimum.reduceat(lo, heads)), "high": pa.array(np.maximum.reduceat(hi, heads)),
            "first_code": pa.array(code[heads].astype(np.int32)), "last_code": pa.array(code[ends].astype(np.int32)),
            "first_turn": tail("turn", heads), "last_turn": tail("turn", ends),
            "codes": packed(pa.array(code.astype(np.int32))), "forced": packed(pa.array(forced)), "open": packed(pa.array(open_)),
            "copies": packed(col["copies"]), "turn_texts": packed(col["turn_text"]), "roles": packed(col["role"]),
            "text_shas": packed(col["text_sha"])})

    return pack


_BLOCKS = """key string, conv_id {conv}, part int, no long, costs array<long>, blank long, duplicate long, truncated long,
 illegal long, turns long, low long, high long, first_code int, last_code int, first_turn long, last_turn long,
 codes array<int>, forced array<boolean>, open array<boolean>, copies array<long>, turn_texts array<string>,
 roles array<string>, text_shas array<string>"""


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _pack(TaskContext.get().partitionId(), most)
        held, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            done, held, number = pack(table, number, False)
            if done is not None:
                yield done
        if held is not None and held.num_rows:
            yield pack(held, number, True)[0]

    return run


def blocks(rows: DataFrame, most: int = BLOCK) -> DataFrame:
    """Rows with faults to blocks ``b`` = 0, 1, ... of each conversation, in order."""
    ship_package(rows.sparkSession)
    by = ["key", "turn", "role", "text_sha"]
    rows = rows.select("key", "conv_id", "turn", "turn_text", "role", "text_sha", "copies", "blank", "repeat", "open")
    conv = dict(rows.dtypes)["conv_id"]
    packed = cut(cut(rows, "rows").repartitionByRange(*by).sortWithinPartitions(*by)
                 .mapInArrow(_blocks(most), _BLOCKS.format(conv=conv)), "blocks")
    # a conversation's blocks in earlier partitions: one row a partition it lies in
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lift = packed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("many")).select(
        "key", "part", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("lift"))
    return packed.join(lift, ["key", "part"]).withColumn("b", F.col("no") + F.col("lift")).drop("lift", "no", "part")


def _through(a: str, b: str) -> Column:
    """Least costs over two neighbouring runs of blocks (4 x 4, row by row)."""
    x, y = (lambda i: F.get(F.col(a), F.lit(i))), (lambda i: F.get(F.col(b), F.lit(i)))
    return F.array(*[F.least(F.lit(FAR), *[x(4 * s + m) + y(4 * m + e) for m in range(4)]) for s in range(4) for e in range(4)])


def costs_behind(packed: DataFrame, longest: int) -> DataFrame:
    """``(key, b, ahead)``: costs to the end from the four states before every block."""
    reach, step = packed.select("key", "b", "costs"), 1
    while step < longest:
        ahead = reach.select("key", (F.col("b") - step).alias("b"), F.col("costs").alias("more"))
        reach = cut(reach.join(ahead, ["key", "b"], "left").select(
            "key", "b", F.when(F.col("more").isNull(), F.col("costs")).otherwise(_through("costs", "more")).alias("costs")), "reach")
        step *= 2
    end = [F.lit(int(v)) for v in AT_END]
    return reach.select("key", "b", F.array(*[F.least(*[F.get("costs", F.lit(4 * s + e)) + end[e] for e in range(4)])
                                               for s in range(4)]).alias("ahead"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the costs behind them to their least paths from each entry state (the first block:
    from state 0): exit states, and the edits as letters, rows and states reached."""
    for whole in batches:
        rows = pc.list_value_length(whole.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(rows)
        a = 0
        while a < whole.num_rows:  # at most some ten thousand rows at once
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 16 * BLOCK, side="right")))
            yield _paths_of(whole.slice(a, b - a))
            a = b


def _paths_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    size, code, forced, open_, copies = _flat(batch, ["codes", "forced", "open", "copies"])
    last = batch.column("behind").is_null().to_numpy(zero_copy_only=False)
    behind = np.broadcast_to(AT_END, (len(size), 4)).copy()
    behind[~last] = batch.column("behind").drop_null().flatten().to_numpy().reshape(-1, 4)
    code, forced, open_ = code.astype(np.int64), forced.astype(bool), open_.astype(bool)
    _, nodes = cost_to_go(size, code, forced, open_, copies, behind[:, :, None], keep=True)
    letter, pointers = rank_paths(*optimal_arcs(size, code, forced, open_, copies, nodes, last))
    first = np.cumsum(size + 1) - size - 1
    entries = np.where(batch.column("b").to_numpy() == 0, 1, 4)
    owner = np.repeat(np.arange(len(size)), entries)
    state = np.arange(len(owner)) - np.repeat(np.cumsum(entries) - entries, entries)
    starts = first[owner] * 4 + state
    arcs: list = [None] * len(owner)
    exits = np.zeros(len(owner), np.int32)
    for who, path in read_paths(starts, 3 * size[owner] + 3, pointers):
        real = letter[path] > 0
        exits[who] = pointers[-1][path[:, -1]] % 4
        for w, p, r in zip(who.tolist(), path, real):
            arcs[w] = p[r]
    many = np.array([len(x) for x in arcs], np.int64)
    nodes_of = np.concatenate([*arcs, np.zeros(0, np.int64)]).astype(np.int64)
    at = nodes_of // 4 - np.repeat(first[owner], many)
    offsets = pa.array(np.append(0, np.cumsum(many)).astype(np.int32))
    outer = pa.array(np.append(0, np.cumsum(entries)).astype(np.int32))
    nest = lambda x: pa.ListArray.from_arrays(outer, pa.ListArray.from_arrays(offsets, x))
    names = ["key", "conv_id", "b", "copies", "turn_texts", "roles", "text_shas"]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(n) for n in names), pa.ListArray.from_arrays(outer, pa.array(exits)),
         nest(pa.array(LETTERS[letter[nodes_of]].astype(object), pa.string())), nest(pa.array(at.astype(np.int32))),
         nest(pa.array((pointers[0][nodes_of] % 4).astype(np.int32)))], [*names, "exits", "ops", "at", "to"])


def entries(paths: DataFrame, longest: int) -> DataFrame:
    """``(key, b, entry)`` for every block but the first: the state that the blocks before lead to."""
    upto, step = paths.select("key", "b", "exits"), 1
    while step < longest:
        before = upto.select("key", (F.col("b") + step).alias("b"), F.col("exits").alias("earlier"))
        both = F.transform("earlier", lambda s: F.get(F.col("exits"), s))
        upto = cut(upto.join(before, ["key", "b"], "left").select("key", "b", F.coalesce(both, "exits").alias("exits")), "upto")
        step *= 2
    return upto.select("key", (F.col("b") + 1).alias("b"), F.get("exits", F.lit(0)).alias("entry"))


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``conversations(conv_id, turn, role, text)`` to ``(edits, totals)``.

    ``edits(key, conv_id, b, i, op, copies, role, text)``: the edits of each conversation in the order
    ``(b, i)``; ``role`` and ``text`` are those of the repaired row (null for deletions); ``copies``
    counts equal rows, of which all but the first are deleted behind it. ``totals``: a row a
    conversation with its faults and the cost. ``block``: rows of a conversation in one block.
    """
    rows = marked(rows)
    packed = cut(blocks(faults(rows), block), "blocks-in-order")
    longest = (packed.agg(F.max("b")).first()[0] or 0) + 1  # one number
    ahead = cut(costs_behind(packed, longest), "ahead")
    conv = dict(packed.dtypes)["conv_id"]
    behind = ahead.where("b > 0").select("key", (F.col("b") - 1).alias("b"), F.col("ahead").alias("behind"))
    wide = packed.select("key", "conv_id", "b", "codes", "forced", "open", "copies", "turn_texts", "roles", "text_shas")
    paths = cut(wide.join(behind, ["key", "b"], "left").mapInArrow(
        _paths, f"key string, conv_id {conv}, b long, copies array<long>, turn_texts array<string>, roles array<string>, "
        "text_shas array<string>, exits array<int>, ops array<array<string>>, at array<array<int>>, to array<array<int>>"), "paths")
    state = F.coalesce("entry", F.lit(0))
    chosen = paths.join(entries(paths, longest), ["key", "b"], "left").select(
        "key", "conv_id", "b", "copies", "turn_texts", "roles", "text_shas",
        F.posexplode(F.arrays_zip(*[F.get(c, state).alias(c) for c in ("ops", "at", "to")])).alias("i", "e"))
    at, inserted = F.col("e.at"), F.col("e.ops") == "I"
    role = F.when(F.col("e.ops") == "K", F.get("roles", at)).when(F.col("e.ops") != "D", F.get(F.array(*map(F.lit, ROLES)), F.col("e.to")))
    edits = cut(chosen.select(
        "key", "conv_id", "b", "i", F.col("e.ops").alias("op"), F.when(inserted, 1).otherwise(F.get("copies", at)).alias("copies"),
        role.alias("role"), F.get("turn_texts", at).alias("turn_text"), F.get("roles", at).alias("was"),
        F.get("text_shas", at).alias("text_sha")), "edits")
    kept = edits.where(F.col("op").isin("K", "R"))
    texts = rows.groupBy("key", "turn_text", F.col("role").alias("was"), "text_sha").agg(F.first("text").alias("text"))
    kept = kept.join(texts, ["key", "turn_text", "was", "text_sha"])
    names = ["key", "conv_id", "b", "i", "op", "copies", "role", "text"]
    rest = edits.where(~F.col("op").isin("K", "R")).withColumn("text", F.when(F.col("op") == "I", ""))
    return kept.select(*names).unionByName(rest.select(*names)), _totals(packed, ahead)


def _totals(packed: DataFrame, ahead: DataFrame) -> DataFrame:
    """Faults, gaps and cost a conversation; what crosses a block's edge comes from the block before."""
    heads = packed.select("key", "conv_id", "b", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high",
                          "first_code", "first_turn", "last_code", "last_turn")
    before = heads.select("key", (F.col("b") + 1).alias("b"), F.col("last_code").alias("code"), F.col("last_turn").alias("turn"))
    legal = F.concat_ws("", "code", "first_code").isin("12", "23", "32")
    edge = heads.join(before, ["key", "b"], "left").select(
        heads["*"], F.when(F.col("code").isNotNull() & ~legal, 1).otherwise(0).alias("step"),
        F.when(F.col("turn") == F.col("first_turn"), 1).otherwise(0).alias("same"))
    out = edge.groupBy("key").agg(
        F.max("conv_id").alias("conv_id"), (F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("same"))).alias("gaps"),
        F.sum(F.col("turns")).alias("turns"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.col("step")).alias("illegal"))
    cost = ahead.where("b = 0").select("key", F.get("ahead", F.lit(0)).alias("cost"))
    return out.withColumn("gaps", F.when(F.col("turns") == 0, 0).otherwise(F.col("gaps"))).drop("turns").join(cost, "key")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order to a row a conversation: audit and SHA-256 of the repaired rows. Texts are
    hashed as they pass and not held."""
    key, audit, sha, lines = None, [], None, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])],
                                          ["key", "audit", "repaired_sha256"])

    for batch in batches:
        for k, op, copies, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if key is not None:
                    yield row()
                key, audit, sha, lines = k, [], hashlib.sha256(), 0
            audit.append(op + "D" * (copies - 1))
            if op != "D":
                sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
    if key is not None:
        yield row()


def digests(edits: DataFrame) -> DataFrame:
    """``(key, audit, repaired_sha256)``. SHA-256 reads its bytes in order, so a conversation's digest is
    one stream in one task; memory holds its audit only."""
    ordered = edits.repartition("key").sortWithinPartitions("key", "b", "i")
    return ordered.select("key", "op", "copies", "role", "text").mapInArrow(_digests, "key string, audit string, repaired_sha256 string")


def _put(state: str, cost: str, letter: str, line: str) -> str:
    """SQL: a state with one more edit (null stays null)."""
    return f"case when {state} is not null then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} end"


def _oracle() -> str:
    """Row after row the best (cost, audit, text) of each state, in SQL."""
    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"
    filled_2 = f"list_min([s2, {_put('s0', '3', 'I', user)}, {_put('s1', '3', 'I', user)}, {_put('s3', '3', 'I', user)}])"
    drop = lambda s: _put(s, "4", "D", "''")
    own, plus = "r.role || ':' || r.text || chr(10)", "(case when r.open then 3 else 0 end)"
    stay = lambda s, k, name: (f"case when r.forced then null when left(r.role, 1) = '{k}' then {_put(s, plus, 'K', own)} "  # noqa: E731
                               f"else {_put(s, plus + ' + 3', 'R', f"'{name}:' || r.text || chr(10)")} end")
    first = f"case when not r.forced and left(r.role, 1) = 's' then {_put('s0', plus, 'K', own)} end"
    from .spelling import CRC_SQL, crc_sql

    return f"""
with recursive {CRC_SQL},
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations, crc_table),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when kind = 3 then 2 else 1 end)) as copy from raw where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as i,
    not regexp_matches(text, '{IS_BLANK}') as blank, regexp_matches(text, '{IS_CUT_OFF}') as cut_off from damaged),
seen as (select *, not blank and row_number() over (partition by conv_id, role, text order by i) > 1 as duplicate,
    lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from placed),
marked as (select *, blank or duplicate as forced, cut_off and not duplicate and not blank as open from seen),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::bigint) as blank,
    sum(duplicate::bigint) as duplicate, sum(open::bigint) as truncated,
    coalesce(sum((pair not in ('su', 'ua', 'au'))::bigint), 0) as illegal, max(i) as n from marked group by conv_id),
walk as (
  select conv_id, 0::bigint as i, {{'c': 0, 'a': '', 't': ''}} as s0, null::struct(c integer, a varchar, t varchar) as s1,
    null::struct(c integer, a varchar, t varchar) as s2, null::struct(c integer, a varchar, t varchar) as s3 from counts
  union all
  select conv_id, i, {drop("s0")} as s0, list_min([{drop("s1")}, {first}]) as s1,
    list_min([{drop("x2")}, {stay("s0", "u", "user")}, {stay("s1", "u", "user")}, {stay("x3", "u", "user")}]) as s2,
    list_min([{drop("x3")}, {stay("x2", "a", "assistant")}]) as s3
  from (select r.conv_id, r.i, r, s0, s1, x2, list_min([s3, {_put("x2", "3", "I", assistant)}]) as x3
        from (select w.*, {filled_2} as x2 from walk w) w join marked r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1)),
ended as (select w.conv_id, list_min([s0, s3, {_put("x2", "3", "I", assistant)}]) as best
  from (select w.*, {filled_2} as x2 from walk w) w join counts c on w.conv_id is not distinct from c.conv_id and w.i = c.n)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost,
  coalesce(best.a, '') as audit, sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on o.conv_id is not distinct from c.conv_id
  left join ended e on o.conv_id is not distinct from e.conv_id
"""


ORACLE = _oracle()
