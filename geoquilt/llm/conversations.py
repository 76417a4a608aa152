"""Repair of conversation structure with the fewest edits, by a dynamic programme over many conversations at once.

A conversation's turns are one or, beyond PIECE_ROWS, several pieces. Pieces of
like length are stacked as tensors with the turn as first axis; one vectorised
step a turn goes from the last to the first and stores the cost of finishing
from each state, then one a turn goes forwards and traces the edits.

Where a conversation has several pieces, each is first reduced to the costs
from each state before it to each state after it; what finishing costs after
each piece, and in which state each begins, follow from these few numbers a
piece, and the pieces are then traced on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, small_side

#: Turns and bytes of text up to which a conversation's turns make one piece.
PIECE_ROWS, PIECE_BYTES = 4096, 8 << 20
#: Conversations in several pieces up to which their list is broadcast.
BROADCAST_SPLIT = 100_000

# Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# States: nothing yet, after a system turn, after a user turn, after an assistant turn. What an added turn leads to; what keeping a turn that begins with s, u, a or another letter leads to; what finishing costs with added turns alone.
_NEXT = np.array([2, 2, 3, 2])
_KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
FINISH = (0, 2 * INSERT, INSERT, 0)
_NEVER = 1 << 40
_ROLE = {2: "user", 3: "assistant"}
_DELETED, _KEPT, _REROLED = 0, 1, 2


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with dropped, and damaged by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes its role user. Null roles and texts, and nulls in the key, are one space."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    keyed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), of("role").alias("role"), of("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("k") == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return keyed.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("dropped"), F.explode(times).alias("time")).drop("time")


def _runs(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to a row for each piece; only what may go on in the next batch is held back."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: pa.Table | None = None
    seq, first = 0, True

    def emit(rows: pa.Table, begins: np.ndarray, seqs: list[int], edges: list[bool]) -> pa.RecordBatch:
        stay = ~rows["dropped"].to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(np.add.reduceat(stay.astype(np.int64), begins)))
        kept = rows.filter(pa.array(stay)).combine_chunks()
        lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), kept[c].combine_chunks() if kept.num_rows else pa.array([], rows.schema.field(c).type)) for c in ("turn", "role", "text")]
        n = len(begins)
        return pa.RecordBatch.from_arrays([rows["conv_id"].take(pa.array(begins)).combine_chunks(), pa.array(np.full(n, part, np.int32)), pa.array(np.array(seqs, np.int32)), pa.array(edges), *lists], ["conv_id", "part", "seq", "edge", "turns", "roles", "texts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        codes = rows["conv_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        begins = _runs(codes)
        conv = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(codes))))
        size = np.cumsum(pc.fill_null(pc.binary_length(rows["text"]), 0).to_numpy().astype(np.int64))
        limit = (np.arange(len(codes)) - begins[conv]) // most, (size - size[begins[conv]]) // PIECE_BYTES
        cut = np.unique(np.concatenate([begins, *(np.flatnonzero(x[1:] != x[:-1]) + 1 for x in limit)]))
        whose = conv[cut]
        seqs = np.arange(len(cut)) - np.searchsorted(whose, whose)
        seqs[whose == 0] += seq
        several = np.bincount(whose)[whose] > 1
        edges = several | (seqs > 0) | (first & (whose == 0))
        if len(cut) > 1:
            last = int(cut[-1])
            yield emit(rows.slice(0, last), cut[:-1], seqs[:-1].tolist(), edges[:-1].tolist())
            first = first and whose[-1] == 0
        held, seq = rows.slice(int(cut[-1])), int(seqs[-1])
    if held is not None and held.num_rows:
        yield emit(held.combine_chunks(), np.array([0]), [seq], [True])


def backward(kind: np.ndarray, must: np.ndarray, late: np.ndarray, offsets: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of like length: (their numbers, row of each turn and piece or -1, costs of finishing before each turn).

    ``kind``: 0 to 3 for roles that begin with s, u, a or another letter; ``must``:
    deleting is required; ``late``: what not deleting adds; ``after``: what
    finishing costs after each piece, by state.
    """
    sizes = np.diff(offsets)
    bucket = np.array([int(n).bit_length() for n in sizes], np.int64)
    for b in np.unique(bucket).tolist():
        mine = np.flatnonzero(bucket == b)
        turns = int(sizes[mine].max())
        at = offsets[mine] + np.arange(turns)[:, None]
        at = np.where(np.arange(turns)[:, None] < sizes[mine], at, -1)
        costs = np.empty((turns + 1, len(mine), 4), np.int64)
        costs[turns] = after[mine]
        for t in range(turns - 1, -1, -1):
            row, then = at[t], costs[t + 1]
            to = _KEEP[kind[row]]
            keep = np.where(to >= 0, np.take_along_axis(then, np.maximum(to, 0), 1), _NEVER) + late[row][:, None]
            stay = np.minimum(keep, then[:, _NEXT] + REROLE + late[row][:, None])
            best = np.minimum(then + DELETE, np.where(must[row][:, None], _NEVER, stay))
            best = np.minimum(best, np.minimum(best[:, _NEXT] + INSERT, best[:, _NEXT[_NEXT]] + 2 * INSERT))
            costs[t] = np.where(row[:, None] < 0, then, best)
        yield mine, at, costs


def forward(kind: np.ndarray, must: np.ndarray, late: np.ndarray, mine: np.ndarray, at: np.ndarray, costs: np.ndarray, state: np.ndarray, inserted: np.ndarray, act: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Trace the cheapest edits of pieces from their ``state``, the first letter of D, I, K, R among equals; by row: turns inserted before it, what is done with it, the state before both. Returns the states after the pieces."""
    state, every = state.copy(), np.arange(len(mine))
    for t in range(len(at)):
        row, open_ = at[t], at[t] >= 0
        before[row[open_]] = state[open_]
        added = np.zeros(len(mine), np.int64)
        while open_.any():
            best, then = costs[t, every, state], costs[t + 1]
            delete = open_ & (then[every, state] + DELETE == best)
            insert = open_ & ~delete & (costs[t, every, _NEXT[state]] + INSERT == best)
            to = _KEEP[kind[row], state]
            keep = open_ & ~delete & ~insert & ~must[row] & (to >= 0) & (then[every, np.maximum(to, 0)] + late[row] == best)
            rerole = open_ & ~delete & ~insert & ~keep
            for chosen, what in ((delete, _DELETED), (keep, _KEPT), (rerole, _REROLED)):
                act[row[chosen]] = what
            inserted[row[open_ & ~insert]] = added[open_ & ~insert]
            state = np.where(keep, to, np.where(insert | rerole, _NEXT[state], state))
            added += insert
            open_ = insert
    return state


class _Turns:
    """The turns of a batch of pieces as arrays, with their faults."""

    def __init__(self, batch: pa.RecordBatch):
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        lists = column("roles")
        self.n = batch.num_rows
        self.offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)))
        self.roles, self.texts, self.turns = (pc.list_flatten(column(c)) for c in ("roles", "texts", "turns"))
        self.piece = np.repeat(np.arange(self.n), np.diff(self.offsets))
        initials = pc.utf8_slice_codeunits(self.roles, 0, 1)
        self.kind = np.select([pc.equal(initials, x).to_numpy(zero_copy_only=False) for x in "sua"], [0, 1, 2], 3).astype(np.int64)
        trimmed = pc.utf8_rtrim(self.texts, characters=" \t\n\v\f\r")
        self.blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
        ends = pc.match_substring_regex(trimmed, r"[.!?]\z").to_numpy(zero_copy_only=False)
        words = [self.piece, self.roles.dictionary_encode().indices.to_numpy(zero_copy_only=False), self.texts.dictionary_encode().indices.to_numpy(zero_copy_only=False)]
        copies = pd.DataFrame(dict(enumerate(words))).duplicated().to_numpy()
        earlier = column("copies")
        copies[pc.list_flatten(earlier).to_numpy().astype(np.int64) + np.repeat(self.offsets[:-1], pc.list_value_length(earlier).to_numpy())] = True
        self.duplicate = copies & ~self.blank
        self.truncated = ~ends & ~self.blank & ~self.duplicate
        self.must = self.blank | self.duplicate
        self.late = self.truncated * TRUNCATED

    def counts(self) -> dict[str, np.ndarray]:
        """By piece: faults, pairs of roles that must not be neighbours, and what joins a piece to the one before."""
        total = lambda x: np.bincount(self.piece[np.asarray(x, bool)], minlength=self.n)
        follows = np.r_[False, self.piece[1:] == self.piece[:-1]] if len(self.piece) else np.zeros(0, bool)
        was = np.r_[3, self.kind[:-1]] if len(self.kind) else self.kind
        some = self.n and np.diff(self.offsets) > 0
        at = lambda x, places, none: np.where(some, np.append(x, none)[np.where(some, places, -1)], none)
        known = self.turns.is_valid().to_numpy(zero_copy_only=False)
        turns = pc.fill_null(self.turns, 0).to_numpy(zero_copy_only=False)
        # nulls come first, so that a piece's known turns are its last
        fresh = known & ~(follows & np.r_[False, known[:-1] & (turns[1:] == turns[:-1])]) if len(turns) else known
        return {
            "blank": total(self.blank),
            "duplicate": total(self.duplicate),
            "truncated": total(self.truncated),
            "illegal": total(follows & ~legal(was, self.kind)),
            "first": at(self.kind, self.offsets[:-1], -1),
            "last": at(self.kind, self.offsets[1:] - 1, -1),
            "known": total(known),
            "distinct": total(fresh),
            "least": at(turns, self.offsets[1:] - np.maximum(total(known), 1), 0),
            "most": at(turns, self.offsets[1:] - 1, 0),
        }


def legal(was: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Whether kinds of roles may be neighbours: su, ua or au."""
    return ((was == 0) & (now == 1)) | ((was == 1) & (now == 2)) | ((was == 2) & (now == 1))


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "first", "last", "known", "distinct", "least", "most")


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of long conversations: their counts, and the costs from each state before to each state after."""
    for batch in batches:
        turns = _Turns(batch)
        costs = np.empty((turns.n, 4, 4), np.int64)
        for state in range(4):
            after = np.full((turns.n, 4), _NEVER)
            after[:, state] = 0
            for mine, _, found in backward(turns.kind, turns.must, turns.late, turns.offsets, after):
                costs[mine, :, state] = found[0]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * turns.n + 1, 16, dtype=np.int32)), pa.array(np.minimum(costs, _NEVER).reshape(-1)))
        counts = turns.counts()
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "part", "seq")), lists, *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS)], ["conv_id", "part", "seq", "costs", *_COUNTS])


def _finishing(pieces: pd.DataFrame) -> pd.DataFrame:
    """One long conversation's pieces, a few numbers each: what finishing costs after each of them."""
    pieces = pieces.sort_values(["part", "seq"])
    now, after = np.array(FINISH, np.int64), []
    for costs in pieces["costs"].iloc[::-1]:
        after.append(now.tolist())
        now = (np.array(costs, np.int64).reshape(4, 4) + now).min(axis=1)
    return pieces[["conv_id", "part", "seq"]].assign(after=after[::-1])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each piece of a long conversation, for each state before it."""
    for batch in batches:
        turns, ends = _Turns(batch), np.empty((batch.num_rows, 4), np.int64)
        after = np.array(batch.column(batch.schema.get_field_index("after")).to_pylist(), np.int64).reshape(-1, 4)
        lost = [np.empty(len(turns.kind), np.int64) for _ in range(3)]
        for mine, at, costs in backward(turns.kind, turns.must, turns.late, turns.offsets, after):
            for state in range(4):
                ends[mine, state] = forward(turns.kind, turns.must, turns.late, mine, at, costs, np.full(len(mine), state), *lost)
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "part", "seq")), pa.array(ends.tolist(), pa.list_(pa.int64()))], ["conv_id", "part", "seq", "ends"])


def _beginnings(pieces: pd.DataFrame) -> pd.DataFrame:
    """One long conversation's pieces: the state before each, and what they count together, at the last piece."""
    pieces = pieces.sort_values(["part", "seq"]).reset_index(drop=True)
    state, before, last, turn, illegal, again = 0, [], -1, None, 0, 0
    for p in pieces.itertuples():
        before.append(state)
        state = int(p.ends[state])
        if p.first >= 0:
            illegal += last >= 0 and not bool(legal(np.array(last), np.array(p.first)))
            last = p.last
        if p.known:
            again += turn is not None and turn == p.least
            turn = p.most
    known = pieces[pieces["known"] > 0]
    gaps = int(known["most"].max() - known["least"].min() + 1 - (known["distinct"].sum() - again)) if len(known) else 0
    pieces["start"], pieces["final"] = before, pieces.index == len(pieces) - 1
    pieces["illegal"] += np.where(pieces["final"], illegal, 0)
    pieces["gaps"] = np.where(pieces["final"], gaps, 0)
    return pieces[["conv_id", "part", "seq", "start", "final", "gaps", "illegal"]]


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of all pieces, and the turns that they leave."""
    for batch in batches:
        column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
        turns, n = _Turns(batch), batch.num_rows
        counts = turns.counts()
        after = np.array(column("after").to_pylist(), np.int64).reshape(-1, 4)
        start, final = column("start").to_numpy(zero_copy_only=False).astype(np.int64), column("final").to_numpy(zero_copy_only=False)
        inserted, act, before = (np.zeros(len(turns.kind), np.int64) for _ in range(3))
        cost, state = np.empty(n, np.int64), np.empty(n, np.int64)
        for mine, at, costs in backward(turns.kind, turns.must, turns.late, turns.offsets, after):
            state[mine] = forward(turns.kind, turns.must, turns.late, mine, at, costs, start[mine], inserted, act, before)
            cost[mine] = costs[0, np.arange(len(mine)), start[mine]] - after[mine, state[mine]]
        added = np.where(final, np.array(FINISH)[state] // INSERT, 0)
        cost += added * INSERT
        audits, messages = [], []
        roles, texts = turns.roles.to_pylist(), turns.texts.to_pylist()
        letters = ["DKR"[a] for a in act.tolist()]
        inserted, before, act = inserted.tolist(), before.tolist(), act.tolist()
        for k, (low, high) in enumerate(zip(turns.offsets[:-1].tolist(), turns.offsets[1:].tolist(), strict=True)):
            left: list[tuple[str, str]] = []
            for i in range(low, high):
                s = before[i]
                for _ in range(inserted[i]):
                    s = int(_NEXT[s])
                    left.append((_ROLE[s], ""))
                if act[i] == _KEPT:
                    left.append((roles[i], texts[i]))
                elif act[i] == _REROLED:
                    left.append((_ROLE[int(_NEXT[s])], texts[i]))
            s = int(state[k])
            for _ in range(int(added[k])):
                s = int(_NEXT[s])
                left.append((_ROLE[s], ""))
            audits.append("".join("I" * inserted[i] + letters[i] for i in range(low, high)) + "I" * int(added[k]))
            messages.append([{"role": r, "text": t} for r, t in left])
        gaps = np.where(counts["known"] > 0, counts["most"] - counts["least"] + 1 - counts["distinct"], 0)
        numbers = {c: pa.array(np.asarray(x, np.int64)) for c, x in (("gaps", gaps), ("blank", counts["blank"]), ("duplicate", counts["duplicate"]), ("truncated", counts["truncated"]), ("illegal", counts["illegal"]), ("cost", cost))}
        arrays = [column("conv_id"), column("part"), column("seq"), *numbers.values(), pa.array(audits, pa.string()), pa.array(messages, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "part", "seq", *numbers, "audit", "messages"])


_RESULT = "part int, seq int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, messages array<struct<role:string,text:string>>"


def _copies(split: DataFrame) -> DataFrame:
    """(conv_id, part, seq, copies): places of turns that an earlier piece of the conversation has too. A piece names each of its turns once, so a turn that fills a conversation counts a row a piece."""
    turns = split.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "x"))
    turns = turns.select("conv_id", "part", "seq", "place", F.col("x.roles").alias("role"), F.sha2("x.texts", 256).alias("key"))
    named = save(turns.groupBy("conv_id", "part", "seq", "role", "key").agg(F.min("place").alias("place")), "conversation-turns")
    least = named.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min(F.struct("part", "seq")).alias("least"), F.count("*").alias("n")).where("n > 1")
    again = named.join(least, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))).where(F.struct("part", "seq") != F.col("least"))
    return again.groupBy("conv_id", "part", "seq").agg(F.collect_list("place").alias("copies"))


def _with(pieces: DataFrame, more: DataFrame, how: str = "left") -> DataFrame:
    """Join on the piece."""
    more = more.withColumnsRenamed({"conv_id": "_c", "part": "_p", "seq": "_s"})
    return pieces.join(more, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")), how).drop("_c", "_p", "_s")


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(whole, split): repaired conversations, and pieces of those that are too long for one or lie on the edge of a range.

    ``rows``: conv_id, turn, role, text and dropped (rows that are not there but
    whose conversation is), in any order; turns are taken by turn, nulls first,
    those of one turn by role and text. Both tables have conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit and messages (role, text), in
    ``split`` by part and seq, to be added up and put together in that order; its
    ``gaps`` stand at the last piece. Rows without a conv_id are a conversation
    of their own; an empty table gives none.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    key = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = rows.select("conv_id", "turn", "role", "text", "dropped").repartitionByRange(*key, F.substring("text", 1, 32))
    columns = f"conv_id {kind}, part int, seq int, edge boolean, turns array<long>, roles array<string>, texts array<string>"
    pieces = save(ranged.sortWithinPartitions(*key, "text").mapInArrow(lambda batches: _pieces(batches, piece_rows), columns), "conversation-pieces")
    # a few rows a range
    several = pieces.where("edge").groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("n")).where("n > 1").select("_conv")
    several = small_side(save(several, "conversations-split"), BROADCAST_SPLIT)
    on = F.col("edge") & F.col("conv_id").eqNullSafe(F.col("_conv"))
    none, finish = F.array().cast("array<int>"), F.array(*(F.lit(x).cast("long") for x in FINISH))
    whole = pieces.join(several, on, "left_anti").withColumns({"copies": none, "after": finish, "start": F.lit(0), "final": F.lit(True)})
    whole = whole.mapInArrow(_traced, f"conv_id {kind}, {_RESULT}").drop("part", "seq")
    split = pieces.where("edge").join(several, on, "left_semi")
    if several.isEmpty():
        return whole, whole.where("false").withColumns({"part": F.lit(0), "seq": F.lit(0)})
    split = save(_with(split, _copies(split)).withColumn("copies", F.coalesce("copies", none)), "conversation-copies")
    numbers = ", ".join(f"{c} long" for c in _COUNTS)
    reduced = save(split.mapInArrow(_reduced, f"conv_id {kind}, part int, seq int, costs array<long>, {numbers}"), "conversation-costs")
    one = reduced.groupBy("conv_id")
    after = save(one.applyInPandas(_finishing, f"conv_id {kind}, part int, seq int, after array<long>"), "conversation-finish")
    finishing = save(_with(split, after, "inner"), "conversation-after")
    ends = finishing.mapInArrow(_ends, f"conv_id {kind}, part int, seq int, ends array<long>")
    starts = _with(reduced.drop("costs"), ends, "inner").groupBy("conv_id").applyInPandas(_beginnings, f"conv_id {kind}, part int, seq int, start long, final boolean, gaps long, illegal long")
    starts = save(starts, "conversation-starts")
    traced = _with(finishing, starts.select("conv_id", "part", "seq", "start", "final"), "inner").mapInArrow(_traced, f"conv_id {kind}, {_RESULT}")
    return whole, _with(traced.drop("gaps", "illegal"), starts.select("conv_id", "part", "seq", "gaps", "illegal"), "inner")


def as_text(messages: Column) -> Column:
    """``role:text`` of each turn, with line ends between them."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")


_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to a row for each conversation, one piece after the other through the hash."""
    now, n, audit, sums, text, some = None, 0, [], np.zeros(len(_SUMS), np.int64), hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([now, *(pa.array([int(x)]) for x in sums), pa.array(["".join(audit)]), pa.array([text.hexdigest()])], ["conv_id", *_SUMS, "audit", "repaired_sha256"])

    for batch in batches:
        for k in range(batch.num_rows):
            conv = batch.column(0).slice(k, 1)
            if now is None or not conv.equals(now):
                if now is not None:
                    yield row()
                now, audit, sums, text, some = conv, [], np.zeros(len(_SUMS), np.int64), hashlib.sha256(), False
            sums += [batch.column(batch.schema.get_field_index(c))[k].as_py() for c in _SUMS]
            audit.append(batch.column(batch.schema.get_field_index("audit"))[k].as_py())
            n = batch.column(batch.schema.get_field_index("n"))[k].as_py()
            if n:
                text.update((b"\n" if some else b"") + batch.column(batch.schema.get_field_index("body"))[k].as_py().encode())
                some = True
    if now is not None:
        yield row()


def digests(whole: DataFrame, split: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A long one's pieces go through its hash in order, a piece at a time."""
    short = whole.select("conv_id", *_SUMS, "audit", F.sha2(as_text(F.col("messages")), 256).alias("repaired_sha256"))
    long = split.select("conv_id", "part", "seq", *_SUMS, "audit", F.size("messages").alias("n"), as_text(F.col("messages")).alias("body"))
    long = long.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    kind = whole.schema["conv_id"].dataType.simpleString()
    return short.unionByName(long.mapInArrow(_digests, f"conv_id {kind}, {', '.join(f'{c} long' for c in _SUMS)}, audit string, repaired_sha256 string"))
