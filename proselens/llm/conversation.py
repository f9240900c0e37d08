"""Conversation structure repair by rank-convergence parallel Viterbi.

The repaired roles of a conversation read ``(s?(ua)+)?``.  The states are 0 begin, 1 after system,
2 after user, 3 after assistant; an edit sequence is a path through the rows of a conversation.
``W[i][s]`` is the least cost from before row i in state s to the end; inserts are steps between states.

1. Equal rows (turn, role, text) are counted together, blank and repeated rows are marked, and the rows
   are ordered by conversation and turn over all tasks.  Each task packs its rows into chunks: a few
   bytes a row, of one conversation each.
2. Every chunk walks its rows backwards.  The last chunk of a conversation begins with the costs of its
   end, the others with the same vector as a speculation.  Only differences of costs decide anything,
   so a chunk is right as soon as its vector differs from the right one by a constant.
3. Fix-up passes compare each chunk's vector with the head of the next chunk.  Where they differ, the
   chunk runs again, beside its old vector, until both differ by a constant.  Pass k walks up to 2**k
   neighbouring chunks in one go, so a correction that never dies out takes logarithmically many passes.
4. The stitched costs drive the tracing: a chunk maps each of its four begin states to an end state; maps are
   joined at doubling distances until all are constant (most are at once), which gives each chunk its state.
   From it the least letter that keeps to a least cost is taken at every step.

The edits meet the texts at their rows; lines are put together by chunk, and a conversation of several
chunks is hashed as a stream of its chunks.  No task holds a conversation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tasks

#: rows and text bytes after which a chunk ends
CHUNK_ROWS = 4096
CHUNK_BYTES = 1 << 22
#: ordered rows of a task
TASK_ROWS = 200_000

#: costs of the edits, and of a truncated row that stays
DELETE, REROLE, INSERT, STAYS = 2, 1, 5, 5
INITIALS = "sua"
#: state after a row of each initial; from a state only one of user and assistant can follow
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = 8
NAMES = {"u": "user", "a": "assistant"}


def code_of(initial: str, truncated: bool, forced: bool) -> int:
    """One byte a row: initial (0: another one) and whether it is truncated, or that it must go."""
    return FORCED if forced else 2 * (INITIALS.find(initial) + 1 if initial else 0) + truncated


def insert_from(state: int) -> tuple[str, int]:
    return ("a", 3) if state == 2 else ("u", 2)


def with_inserts(w: list[int]) -> list[int]:
    for _ in range(2):
        w = [min(w[s], INSERT + w[insert_from(s)[1]]) for s in range(4)]
    return w


#: costs after the last row: only 0 and 3 may end
FAR = 1000
END = with_inserts([0, FAR, FAR, 0])


class Walker:
    """Steps over rows on cost vectors whose least cost is 0; vectors, steps and traces are remembered."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple] = {}

    def number(self, vector) -> int:
        vector = tuple(vector)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector]

    def before(self, v: int, code: int) -> list[int]:
        """Costs before a row whose costs after it are those of ``v``."""
        w = self.vectors[v]
        if code == FORCED:
            return [DELETE + x for x in w]
        initial, stays = "-sua"[code // 2], STAYS * (code % 2)
        out = [DELETE + x for x in w]
        for s in range(4):
            if initial in NEXT[s]:
                out[s] = min(out[s], stays + w[NEXT[s][initial]])
            out[s] = min(out[s], REROLE + stays + w[insert_from(s)[1]])
        return with_inserts(out)

    def step(self, v: int, code: int) -> tuple[int, int]:
        found = self.steps.get((v, code))
        if found is None:
            w = self.before(v, code)
            low = min(w)
            found = self.steps[v, code] = self.number([x - low for x in w]), low
        return found

    def backward(self, codes: bytes, v: int) -> list[int]:
        """Vectors before each row, and after the last."""
        out = [v] * (len(codes) + 1)
        for i in range(len(codes) - 1, -1, -1):
            v = out[i] = self.step(v, codes[i])[0]
        return out

    def run(self, codes: bytes, v: int) -> tuple[int, int]:
        """Vector before the first row and the cost taken off on the way."""
        cost = 0
        for code in reversed(codes):
            v, low = self.step(v, code)
            cost += low
        return v, cost

    def rerun(self, codes: bytes, v: int, old: int, old_head: int, old_cost: int) -> tuple[int, int]:
        """The same from another vector, given what came from the old one: ends where both differ by a constant."""
        if v == old:
            return old_head, old_cost
        cost = old_part = 0
        for code in reversed(codes):
            v, low = self.step(v, code)
            old, low_old = self.step(old, code)
            cost, old_part = cost + low, old_part + low_old
            if v == old:
                return old_head, old_cost - old_part + cost
        return v, cost

    def trace(self, v_after: int, code: int, state: int) -> tuple[str, str, str, int]:
        """Audit letters of a row, the initials inserted before it, its own (empty: deleted), and the state after it."""
        found = self.traces.get((v_after, code, state))
        if found is None:
            found = self.traces[v_after, code, state] = self._trace(v_after, code, state)
        return found

    def _trace(self, v_after, code, state):
        if code == FORCED:
            return "D", "", "", state
        before, after = self.before(v_after, code), self.vectors[v_after]
        initial, stays = "-sua"[code // 2], STAYS * (code % 2)
        inserted = ""
        while True:
            cost, (name, to) = before[state], insert_from(state)
            if cost == DELETE + after[state]:
                return "I" * len(inserted) + "D", inserted, "", state
            if cost == INSERT + before[to]:
                inserted, state = inserted + name, to
            elif initial in NEXT[state] and cost == stays + after[NEXT[state][initial]]:
                return "I" * len(inserted) + "K", inserted, "k", NEXT[state][initial]
            else:
                return "I" * len(inserted) + "R", inserted, name, to

    def end(self, state: int) -> str:
        """Initials inserted after the last row."""
        out = ""
        while state not in (0, 3):
            name, state = insert_from(state)
            out += name
        return out

    def exits(self, codes: bytes, vectors: list[int]) -> list[int]:
        out = []
        for state in range(4):
            for i, code in enumerate(codes):
                state = self.trace(vectors[i + 1], code, state)[3]
            out.append(state)
        return out


# ---------------------------------------------------------------- rows and chunks

CHUNK = ("_part int, _seq int, _conv string, _begins boolean, _ends boolean, _codes binary, _times array<long>, _turns array<struct<has: boolean, "
         "turn: long>>, _roles array<string>, _texts array<binary>, _edge int")


def conv_key(col: str) -> Column:
    """The conversation as text that is never null."""
    return F.when(F.col(col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(col).cast("string")))


def _keyed(turns: DataFrame, conv_col, turn_col, role_col, text_col) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    return turns.select(conv_key(conv_col).alias("_conv"), F.struct(
        F.col(turn_col).isNotNull().alias("has"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn")).alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("_role"), text.alias("_line"), F.unhex(F.sha2(text, 256)).alias("_text"))


KEY = ["_conv", "_turn", "_role", "_text"]


def marked(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, whether they are blank, cut short, and said before."""
    visible = r"[^\x20\x09-\x0D]"
    thin = stored(rows.select(
        *KEY, (~F.col("_line").rlike(visible)).alias("_blank"),
        (~F.col("_line").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("_cut"), F.octet_length("_line").cast("long").alias("_bytes"))
        .groupBy(*KEY, "_blank", "_cut", "_bytes").agg(F.count("*").alias("_times")))
    said = ["_conv", "_role", "_text"]
    first = stored(thin.groupBy(*said).agg(F.min("_turn").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1"))
    # what is said in very many turns is looked up by broadcast; of such there are at most four a shuffle partition
    hot = F.col("_rows") > max(16, thin.count() // (4 * tasks(thin.sparkSession)))
    often = F.broadcast(first.where(hot).select(*said, F.col("_first").alias("_early")))
    out = thin.join(often, said, "left")
    mine = out.where("_early is not null")
    rest = out.where("_early is null").drop("_early").join(first.where(~hot).select(*said, F.col("_first").alias("_early")), said, "left")
    both = mine.unionByName(rest)
    return both.select(*thin.columns, F.coalesce(F.col("_early") < F.col("_turn"), F.lit(False)).alias("_again"))


def _packed(rows_max: int, bytes_max: int):
    schema = pa.schema([("_part", pa.int32()), ("_seq", pa.int32()), ("_conv", pa.string()), ("_begins", pa.bool_()), ("_ends", pa.bool_()),
                        ("_codes", pa.binary()), ("_times", pa.list_(pa.int64())),
                        ("_turns", pa.list_(pa.struct([("has", pa.bool_()), ("turn", pa.int64())]))),
                        ("_roles", pa.list_(pa.string())), ("_texts", pa.list_(pa.binary())), ("_edge", pa.int32())])

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        made: list[dict] = []
        open_: dict | None = None
        held = size = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv, turn, role, text, blank, cut, n_bytes, times, again in zip(*columns):
                if open_ is not None and (open_["_conv"] != conv or held >= rows_max or size + n_bytes > bytes_max):
                    open_["_ends"] = open_["_conv"] != conv
                    made.append(open_ | {"_codes": bytes(open_["_codes"])})
                    begins, seq, open_ = open_["_ends"], seq + 1, None
                    if len(made) >= 1024:
                        yield pa.RecordBatch.from_pylist(made, schema)
                        made = []
                else:
                    begins = seq == 0
                if open_ is None:
                    open_ = {"_part": part, "_seq": seq, "_conv": conv, "_begins": begins, "_codes": bytearray(), "_times": [],
                             "_turns": [], "_roles": [], "_texts": [], "_edge": 0}
                    held = size = 0
                open_["_codes"].append(code_of(role[:1], cut and not blank, blank or again))
                open_["_times"].append(times)
                open_["_turns"].append(turn)
                open_["_roles"].append(role)
                open_["_texts"].append(text)
                held, size = held + 1, size + n_bytes
        if open_ is not None:
            made.append(open_ | {"_codes": bytes(open_["_codes"]), "_ends": True, "_edge": 1})
        yield pa.RecordBatch.from_pylist(made, schema)

    return run


def chunked(rows: DataFrame) -> DataFrame:
    """Ordered chunks numbered by ``_g``, neighbours by neighbouring numbers; begin and end of conversations are marked."""
    spark = rows.sparkSession
    rows = stored(rows)
    parts = max(1, min(tasks(spark), rows.count()), -(-rows.count() // TASK_ROWS))
    key = ["_conv", "_turn", "_role", "_text"]
    order = rows.select(*key, "_blank", "_cut", "_bytes", "_times", "_again") \
        .repartitionByRange(parts, *key).sortWithinPartitions(*key)
    chunks = stored(order.mapInArrow(_packed(CHUNK_ROWS, CHUNK_BYTES), CHUNK))
    # one row a task: how many chunks it has made, and the conversations at its borders
    edges = chunks.where("_seq = 0 or _edge = 1").groupBy("_part").agg(
        F.max("_seq").alias("last"), F.min_by("_conv", "_seq").alias("a"), F.max_by("_conv", "_seq").alias("z")).orderBy("_part").collect()
    table, offset = [], 0
    for k, e in enumerate(edges):
        table.append((e._part, offset, k > 0 and edges[k - 1].z == e.a, k + 1 < len(edges) and edges[k + 1].a == e.z))
        offset += e.last + 1
    at = F.broadcast(spark.createDataFrame(table, "_part int, _offset long, _from boolean, _on boolean"))
    return chunks.join(at, "_part").select(
        (F.col("_offset") + F.col("_seq")).alias("_g"), "_conv",
        (F.col("_begins") & ~(F.col("_from") & (F.col("_seq") == 0))).alias("_begins"),
        (F.col("_ends") & ~(F.col("_on") & (F.col("_edge") == 1))).alias("_ends"), "_codes", "_times", "_turns", "_roles", "_texts")


# ---------------------------------------------------------------- costs and states

STATE = "_g long, _tail array<int>, _head array<int>, _cost long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


_STATE = pa.schema([("_g", pa.int64()), ("_tail", pa.list_(pa.int32())), ("_head", pa.list_(pa.int32())), ("_cost", pa.int64())])


def _speculate(batches):
    walker = Walker()
    v = walker.number(END)
    for b in batches:
        rows = []
        for g, codes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            head, cost = walker.run(codes, v)
            rows.append((g, END, walker.vectors[head], cost))
        yield _table(rows, _STATE)


def _fix_up(batches):
    """Chunks of a group by descending number: each takes the head of the one just walked, or what its row says."""
    walker = Walker()
    last = None
    for b in batches:
        rows = []
        for g, codes, tail, head, cost, ends, follow in zip(*[c.to_pylist() for c in b.columns]):
            if not ends:
                new = walker.number(last[1] if last is not None and last[0] == g + 1 else follow)
                found, cost = walker.rerun(codes, new, walker.number(tail), walker.number(head), cost)
                tail, head = walker.vectors[new], walker.vectors[found]
            rows.append((g, tail, head, cost))
            last = (g, head)
        yield _table(rows, _STATE)


def costs(chunks: DataFrame) -> DataFrame:
    """For each chunk the cost vector after its last row (least cost 0), the one before its first, and the cost between."""
    alone = F.col("_begins") & F.col("_ends")
    first = stored(chunks.select("_g", "_codes").mapInArrow(_speculate, STATE))
    long = stored(chunks.where(~alone).select("_g", "_codes", "_ends"))
    states = stored(first.join(long.select("_g"), "_g", "left_semi"))
    done = 0
    while True:
        heads = states.select((F.col("_g") - 1).alias("_g"), F.col("_head").alias("_follow"))
        known = states.join(long.select("_g", "_ends"), "_g").join(heads, "_g", "left")
        wrong = stored(known.where(~F.col("_ends") & (F.col("_follow") != F.col("_tail"))).select(F.shiftright("_g", done).alias("_group")).distinct())
        if not wrong.head(1):
            break
        group = F.shiftright("_g", done).alias("_group")
        again = long.select("_g", "_codes", group).join(wrong, "_group", "left_semi").join(known, "_g")
        redone = again.repartition(tasks(chunks.sparkSession), "_group").sortWithinPartitions("_group", F.desc("_g")).select(
            "_g", "_codes", "_tail", "_head", "_cost", "_ends", "_follow").mapInArrow(_fix_up, STATE)
        kept = states.select("*", group).join(wrong, "_group", "left_anti").drop("_group")
        states = stored(kept.unionByName(redone))
        done += 1
    return first.join(long.select("_g"), "_g", "left_anti").unionByName(states)


def _maps(batches):
    walker = Walker()
    schema = pa.schema([("_g", pa.int64()), ("_map", pa.list_(pa.int32()))])
    for b in batches:
        rows = []
        for g, codes, tail, begins in zip(*[c.to_pylist() for c in b.columns]):
            out = walker.exits(codes, walker.backward(codes, walker.number(tail)))
            rows.append((g, [out[0]] * 4 if begins else out))
        yield _table(rows, schema)


def entries(chunks: DataFrame, states: DataFrame) -> DataFrame:
    """``_g, _entry``: the state in which the chunks that continue a conversation begin."""
    long = chunks.where(~(F.col("_begins") & F.col("_ends")))
    rows = long.select("_g", "_codes", "_begins").join(states.select("_g", "_tail"), "_g").select("_g", "_codes", "_tail", "_begins")
    maps = stored(rows.mapInArrow(_maps, "_g long, _map array<int>"))
    step = 1
    while maps.where(F.size(F.array_distinct("_map")) > 1).head(1):
        earlier = maps.select((F.col("_g") + step).alias("_g"), F.col("_map").alias("_from"))
        maps = stored(maps.join(earlier, "_g", "left").select("_g", F.expr(
            "if(_from is null or size(array_distinct(_map)) = 1, _map, transform(_from, s -> _map[s]))").alias("_map")))
        step *= 2
    return maps.select((F.col("_g") + 1).alias("_g"), F.col("_map")[0].alias("_entry"))


# ---------------------------------------------------------------- edits

EDIT = "struct<at: int, turn: struct<has: boolean, turn: long>, role: string, text: binary, before: string, own: string>"
TRACED = f"_g long, _conv string, _begins boolean, _ends boolean, _audit string, _after string, _counts array<long>, _first string, _last string, _edits array<{EDIT}>"


def _traced(batches):
    walker = Walker()
    edit = pa.struct([("at", pa.int32()), ("turn", pa.struct([("has", pa.bool_()), ("turn", pa.int64())])), ("role", pa.string()),
                      ("text", pa.binary()), ("before", pa.string()), ("own", pa.string())])
    schema = pa.schema([("_g", pa.int64()), ("_conv", pa.string()), ("_begins", pa.bool_()), ("_ends", pa.bool_()), ("_audit", pa.string()),
                        ("_after", pa.string()), ("_counts", pa.list_(pa.int64())), ("_first", pa.string()), ("_last", pa.string()), ("_edits", pa.list_(edit))])
    for b in batches:
        rows = []
        for g, conv, begins, ends, codes, times, turns, roles, texts, tail, entry in zip(*[c.to_pylist() for c in b.columns]):
            vectors = walker.backward(codes, walker.number(tail))
            state, audit, edits, illegal = 0 if begins else entry, [], [], 0
            for i, code in enumerate(codes):
                letters, inserted, own, state = walker.trace(vectors[i + 1], code, state)
                audit.append(letters + "D" * (times[i] - 1))
                if own:
                    edits.append({"at": i, "turn": turns[i], "role": roles[i], "text": texts[i], "before": inserted, "own": own})
                mine = roles[i][:1]
                illegal += times[i] - 1 + (i > 0 and roles[i - 1][:1] + mine not in ("su", "ua", "au"))
            after = walker.end(state) if ends else ""
            cut = sum(c & 1 for c in codes if c != FORCED)
            rows.append((g, conv, begins, ends, "".join(audit) + "I" * len(after), after, [illegal, cut], roles[0][:1], roles[-1][:1], edits))
        yield _table(rows, schema)


def _streamed(batches):
    """SHA-256 of each conversation's pieces, joined by newlines, as they come."""
    schema = pa.schema([("_conv", pa.string()), ("repaired_sha256", pa.string())])
    conv, digest = None, None
    for b in batches:
        rows = []
        for c, piece in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            if digest is not None and c == conv:
                digest.update(b"\n")
            else:
                if digest is not None:
                    rows.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            digest.update(piece.as_buffer())
        yield _table(rows, schema)
    if digest is not None:
        yield _table([(conv, digest.hexdigest())], schema)


class Repair:
    """What the operator finds; each is a DataFrame."""

    def __init__(self, lines: DataFrame, summary: DataFrame):
        self.lines, self.summary = lines, summary


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> Repair:
    """Faults, cheapest edits and repaired lines of every conversation.

    ``lines``: ``conv (text), chunk, at, line`` of every repaired row, where ``line`` is ``role:text`` after the lines of the
    rows inserted before it; in the order of (chunk, at).  ``summary``: ``_conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256``, one row a conversation that has rows; ``_conv`` is ``conv_key`` of its identifier.

    A null role or text counts as one space; rows without a turn come first; rows of equal turn are ordered by role, then by the
    SHA-256 of their text; rows without a conversation are one conversation.  Other columns are ignored; an empty
    table gives empty results.  Faults, costs and edits: Keep (K) 0, Rerole (R) 1, Delete (D) 2, which blank and repeated rows
    require, Insert (I) 5; an undeleted truncated row 5 more; of the cheapest edits those whose letters come first.
    Texts are compared by SHA-256.
    """
    spark = turns.sparkSession
    rows = _keyed(turns, conv_col, turn_col, role_col, text_col)
    thin = stored(marked(rows))
    chunks = stored(chunked(thin))
    states = stored(costs(chunks))
    entry = entries(chunks, states)
    begun = chunks.join(states.select("_g", "_tail"), "_g")
    first = F.col("_begins")
    columns = ["_g", "_conv", "_begins", "_ends", "_codes", "_times", "_turns", "_roles", "_texts", "_tail", "_entry"]
    traced = stored(begun.where(first).withColumn("_entry", F.lit(0)).select(*columns).unionByName(
        begun.where(~first).join(entry, "_g").select(*columns)).mapInArrow(_traced, TRACED))

    # the edits meet their texts; of equal rows one text goes on
    edits = traced.select("_g", "_conv", F.explode("_edits").alias("e")).select(
        "_g", "_conv", F.col("e.turn").alias("_turn"), F.col("e.role").alias("_role"), F.col("e.text").alias("_text"),
        F.col("e.at").alias("_at"), F.col("e.before").alias("_before"), F.col("e.own").alias("_own"))
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    inserted = lambda c: F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.concat(name[x], F.lit(":"))), "\n")
    own = F.concat(F.when(F.col("_own") == "k", F.col("_role")).otherwise(name[F.col("_own")]), F.lit(":"), F.col("_line"))
    lines = rows.groupBy(*KEY).agg(F.any_value("_line").alias("_line")).join(edits, KEY).select("_conv", "_g", "_at", F.when(
        F.col("_before") == "", own).otherwise(F.concat(inserted(F.col("_before")), F.lit("\n"), own)).alias("_line"))
    ends = traced.where("_after != ''").select("_conv", "_g", F.lit(CHUNK_ROWS + 1).alias("_at"), inserted(F.col("_after")).alias("_line"))
    lines = stored(lines.unionByName(ends))
    pieces = lines.groupBy("_g", "_conv").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_line"))), lambda x: x["_line"]), "\n").alias("_piece"))
    alone = traced.select("_g", (first & F.col("_ends")).alias("_alone"))
    pieces = pieces.join(alone, "_g")
    whole = pieces.where("_alone").select("_conv", F.sha2("_piece", 256).alias("repaired_sha256"))
    parted = pieces.where("not _alone").repartition(tasks(spark), "_conv").sortWithinPartitions("_conv", "_g") \
        .select("_conv", "_piece").mapInArrow(_streamed, "_conv string, repaired_sha256 string")

    # counts: faults by row, illegal pairs by chunk and between chunks, gaps by distinct turn
    by_turn = thin.groupBy("_conv", "_turn").agg(
        F.sum(F.when(F.col("_blank"), F.col("_times")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("_blank"), 0).when(F.col("_again"), F.col("_times")).otherwise(F.col("_times") - 1)).alias("duplicate"))
    turn = F.when(F.col("_turn.has"), F.col("_turn.turn"))
    counts = by_turn.groupBy("_conv").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"))
    before = traced.where(~F.col("_ends")).select((F.col("_g") + 1).alias("_g"), F.col("_last").alias("_left"))
    pair = F.concat("_left", "_first")
    found = traced.join(before, "_g", "left").join(states.select("_g", "_head", "_cost"), "_g")
    found = found.groupBy("_conv").agg(
        F.sum(F.col("_counts")[1]).alias("truncated"),
        F.sum(F.col("_counts")[0] + F.coalesce((~pair.isin("su", "ua", "au")).cast("long"), F.lit(0))).alias("illegal"),
        F.sum(F.col("_cost") + F.when(first, F.col("_head")[0]).otherwise(0)).alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_g", "_audit"))), lambda x: x["_audit"]), "").alias("audit"))
    # copies of a row beyond the first are deleted at the same cost, whatever the path
    copies = thin.groupBy("_conv").agg(F.sum(DELETE * (F.col("_times") - 1)).alias("_copies"))
    summary = counts.join(found, "_conv").join(copies, "_conv").join(whole.unionByName(parted), "_conv", "left").select(
        "_conv", "gaps", "blank", "duplicate", "truncated", "illegal", (F.col("cost") + F.col("_copies")).alias("cost"), "audit",
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return Repair(lines.select(F.col("_conv").alias("conv"), F.col("_g").alias("chunk"), F.col("_at").alias("at"), F.col("_line").alias("line")), summary)
