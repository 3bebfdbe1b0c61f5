"""Chat formatting: minimum-cost repair of role sequences, then rendering.

Legal conversations are those of a small automaton: a system turn or none, then
user and assistant in turn, an assistant last.  Each turn of a conversation is
kept, relabelled, merged into the turn before, or preceded by empty inserted turns;
dynamic programming over the automaton's states finds the cheapest repair (ties:
fewest insertions; then the earliest last state in the order system, user, assistant, then the earliest
state before it, and so on back to the start).

Costs of turns add up along states, so a stretch of turns is a matrix of least costs from
any state to any other, and matrices of stretches compose.  Beside each cost stands the rank of its way among
those that end in the same state, in the order of ties, so that a conversation comes out the same wherever it is cut.
Turns are range-partitioned in
order, a partition reports the matrices of the conversations at its two ends, and
those few compose into the states at the cuts; then every partition
traces its own stretch.  A conversation of any length spans as many tasks as it needs.

One row a turn comes out, also for inserted ones: a conversation's ``rendered`` values,
joined in order of ``pos``, are its text.  Merged turns are one turn of the rendering.

Defined results: null texts are empty; roles are compared without case and outer blanks, and roles that
aren't known can become any role at a smaller cost; turns without a
number come first; turns of equal number are ordered by role and the SHA-256 of the text; rows without
a conversation id form one conversation of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import checkpointed, pieces, shuffle_width, text_bytes

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
UNKNOWN = 0
#: Spellings of the roles.
SPELLINGS = {
    "system": SYSTEM, "developer": SYSTEM, "instruction": SYSTEM,
    "user": USER, "human": USER, "prompter": USER, "customer": USER,
    "assistant": ASSISTANT, "ai": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT,
}
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_FAR = np.int64(1) << np.int64(61)
_ONE = 1 << 32  # a unit of cost; below it insertions are counted
#: Text a partition holds: the first as long as partitions number no more than ``MANY_PARTS``, then up to the second.
PART_BYTES, MOST_PART_BYTES, MANY_PARTS = 16 << 20, 128 << 20, 16_384


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3
    relabel_unknown: int = 1


@dataclass(frozen=True)
class Template:
    """What stands before and after a turn, and between merged ones; ``guard`` replaces ``marker`` inside texts."""

    begin: str = "<|im_start|>{role}\n"
    end: str = "<|im_end|>\n"
    between: str = "\n"
    marker: str = "<|im_"
    guard: str = "<| im_"


def inserted(before: int, after: int) -> tuple[int, ...] | None:
    """The shortest row of turns to insert between two states; None if there is none."""
    paths = [()]
    for _ in range(3):
        for path in paths:
            if after in _NEXT[path[-1] if path else before]:
                return path
        paths = [(*p, s) for p in paths for s in _NEXT[p[-1] if p else before]]
    return None


def transitions(costs: Costs) -> np.ndarray:
    """Least cost of a turn by its role, the state before and the state after."""
    table = np.full((4, 4, 4), _FAR, np.int64)
    for role in range(4):
        for after in ROLES:
            label = 0 if role == after else costs.relabel if role else costs.relabel_unknown
            for before in range(4):
                way = inserted(before, after)
                move = _FAR if way is None else len(way) * (costs.insert * _ONE + 1)
                if before == after:
                    move = min(move, costs.merge * _ONE)
                table[role, before, after] = min(_FAR, move + label * _ONE)
    return table


def endings(costs: Costs) -> np.ndarray:
    """Cost of ending in a state: what it takes to get an assistant turn last."""
    need = [0, 2, 1, 0]
    return np.array([n * (costs.insert * _ONE + 1) for n in need], np.int64)


@dataclass(frozen=True)
class Stretch:
    """Least costs by the state before (rows) and after (columns), and the ranks of their ways within a column."""

    cost: np.ndarray
    rank: np.ndarray

    @classmethod
    def empty(cls) -> Stretch:
        return cls(np.where(np.eye(4, dtype=bool), np.int64(0), _FAR), np.zeros((4, 4), np.int64))

    @classmethod
    def of_turn(cls, cost: np.ndarray) -> Stretch:
        """One turn: all ways to a state are the same state."""
        return cls(cost, np.zeros((4, 4), np.int64))

    @classmethod
    def loads(cls, raw: bytes) -> Stretch:
        both = np.frombuffer(raw, np.int64).reshape(2, 4, 4)
        return cls(both[0], both[1])

    def dumps(self) -> bytes:
        return np.stack((self.cost, self.rank)).astype(np.int64).tobytes()

    def through(self, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ways whose costs so far are ``cost`` (a row each): by the state after, the least total and the state before it.

        Of equal totals the way of the better rank counts, then the earlier state.
        """
        total = cost[:, :, None] + self.cost[None, :, :]
        least = total.min(axis=1)
        tie = np.where(total == least[:, None, :], self.rank[None, :, :] * 4 + np.arange(4)[None, :, None], 99)
        return np.minimum(_FAR, least), tie.argmin(axis=1)

    def then(self, other: Stretch) -> Stretch:
        cost, middle = other.through(self.cost)
        states = np.arange(4)
        order = other.rank[middle, states[None, :]] * 16 + middle * 4 + self.rank[states[:, None], middle]
        rank = (order[None, :, :] < order[:, None, :]).sum(axis=1)
        return Stretch(cost, rank)


def trace(roles: np.ndarray, start: int, end: np.ndarray, table: np.ndarray) -> list[int]:
    """States after each turn on the cheapest way from ``start``, where ending in a state costs ``end``."""
    cost = np.full(4, _FAR, np.int64)
    cost[start] = 0
    back = np.empty((len(roles), 4), np.int8)
    for i, role in enumerate(roles):
        total = cost[:, None] + table[role]
        back[i] = total.argmin(axis=0)
        cost = np.minimum(_FAR, total.min(axis=0))
    state = int((cost + end).argmin())
    states = [state]
    for i in range(len(roles) - 1, 0, -1):
        state = int(back[i, state])
        states.append(state)
    return states[::-1]


def _role_codes(column: pa.Array) -> np.ndarray:
    return np.array([SPELLINGS.get((r or "").strip().lower(), UNKNOWN) for r in column.to_pylist()], np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, pa.Table]]:
    """Conversations, or stretches of them, in a partition."""
    held: list[pa.RecordBatch] = []
    current: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_pylist()
        cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and current[0] != ids[a]:
                yield current[0], pa.Table.from_batches(held)
                held = []
            current = [ids[a]]
            held.append(batch.slice(a, b - a))
    if held:
        yield current[0], pa.Table.from_batches(held)


def _ends(costs: Costs):
    """The matrices of the first and the last conversation of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = transitions(costs)
        seen = []
        for conv, rows in _runs(batches):
            seen = [*seen[:1], (conv, rows.select(["part", "role"]))]
        for conv, rows in seen:
            total = Stretch.empty()
            for role in _role_codes(rows["role"]):
                total = total.then(Stretch.of_turn(table[role]))
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([rows["part"][0].as_py()], pa.int32()),
                    "conv_id": pa.array([conv], pa.int64()),
                    "turns": pa.array([rows.num_rows], pa.int64()),
                    "matrix": pa.array([total.dumps()], pa.binary()),
                }
            )

    return run


def boundaries(stretches: list[tuple[int, int | None, int, bytes]], costs: Costs) -> dict[tuple[int, int | None], tuple[int, int, int, bool]]:
    """For stretches of conversations that partitions cut: start state, end state, rows before, whether it is the last."""
    by: dict[int | None, list] = {}
    for part, conv, turns, matrix in sorted(stretches, key=lambda s: s[0]):
        by.setdefault(conv, []).append((part, turns, Stretch.loads(matrix)))
    out = {}
    for conv, held in by.items():
        if len(held) < 2:
            continue
        cost = np.full(4, _FAR, np.int64)
        cost[START] = 0
        back = []
        for _, _, matrix in held:
            least, before = matrix.through(cost[None, :])
            back.append(before[0])
            cost = least[0]
        state = int((cost + endings(costs)).argmin())
        ways = []
        for i in range(len(held) - 1, -1, -1):
            before = int(back[i][state])
            ways.append((before, state))
            state = before
        rows = 0
        for i, ((part, turns, matrix), (a, b)) in enumerate(zip(held, reversed(ways))):
            out[part, conv] = (a, b, rows, i == len(held) - 1)
            rows += turns + int(matrix.cost[a, b] % _ONE)
    return out


def _repaired(shared, costs: Costs, template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, final = transitions(costs), endings(costs)
        for conv, rows in _runs(batches):
            cut = shared.value.get((rows["part"][0].as_py(), conv))
            state, pos, last = (START, 0, True) if cut is None else (cut[0], cut[2], cut[3])
            roles = _role_codes(rows["role"])
            if cut is None:
                end = final
            else:
                end = np.full(4, _FAR, np.int64)
                end[cut[1]] = 0
            out: dict[str, list] = {k: [] for k in ("pos", "turn", "role", "action", "rendered")}

            def add(turn: int | None, role: int, action: str, text: str, opens: bool, before: int) -> None:
                text = text.replace(template.marker, template.guard)
                head = (template.end if before != START else "") + template.begin.format(role=ROLES[role]) if opens else template.between
                for name, value in zip(out, (pos + len(out["pos"]), turn, ROLES[role], action, head + text)):
                    out[name].append(value)

            for role, after, turn, text in zip(roles, trace(roles, state, end, table), rows["turn"].to_pylist(), rows["text"].to_pylist()):
                way = inserted(state, after)
                joined = state == after and (way is None or costs.merge * _ONE <= len(way) * (costs.insert * _ONE + 1))
                if not joined:
                    for extra in way:
                        add(None, extra, "insert", "", True, state)
                        state = extra
                done = [*(["merge"] if joined else []), *(["relabel"] if role != after else [])]
                add(turn, after, "+".join(done) or "keep", text or "", not joined, state)
                state = after
            if last:
                while state != ASSISTANT:
                    extra = _NEXT[state][0]
                    add(None, extra, "insert", "", True, state)
                    state = extra
                out["rendered"][-1] += template.end
            kinds = {"pos": pa.int64(), "turn": pa.int64()}
            yield pa.RecordBatch.from_pydict(
                {"conv_id": pa.array([conv] * len(out["pos"]), pa.int64())} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()}
            )

    return run


def format_chats(conversations: DataFrame, costs: Costs = Costs(), template: Template = Template(), part_bytes: int = PART_BYTES) -> DataFrame:
    """``conv_id, pos, turn, role, action, rendered``: one row a turn of the repaired conversations, inserted ones with a null ``turn``.

    The result depends on the rows alone, not on how they are cut.  The driver sees two rows of 300 bytes a partition.
    """
    spark = conversations.sparkSession
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    n_bytes = text_bytes(turns)[1]
    n_parts = pieces(n_bytes, max(part_bytes, min(MOST_PART_BYTES, n_bytes // MANY_PARTS)), shuffle_width(spark))
    keys = ["conv_id", "turn", "role", F.sha2("text", 256), "nth"]
    laid = checkpointed(
        turns.withColumn("nth", F.monotonically_increasing_id())  # splits repeated rows, which are alike
        .repartitionByRange(n_parts, *keys)
        .sortWithinPartitions(*keys)
        .select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text")
    )
    ends = laid.mapInArrow(_ends(costs), "part int, conv_id long, turns long, matrix binary")
    found = boundaries([tuple(r) for r in ends.collect()], costs)  # two rows a partition at most
    shared = spark.sparkContext.broadcast(found)
    return laid.mapInArrow(_repaired(shared, costs, template), "conv_id long, pos long, turn long, role string, action string, rendered string")
