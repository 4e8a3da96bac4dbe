"""Chat formatting with minimum-cost role repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as S

from pagewright.session import write_through

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
ROLES = (SYSTEM, USER, ASSISTANT)
#: States of the automaton: nothing yet, or the role of the message that was last begun. A conversation is an
#: optional system message, then user and assistant in turn, and ends with the assistant.
START, N = 0, 4
MERGE, INSERT, RELABEL, RELABEL_UNKNOWN = 1, 2, 3, 1
INFINITE = 1 << 40
SEGMENT = 16384  # turns that one task repairs together
OPEN, CLOSE, JOIN = "<|im_start|>{}\n", "<|im_end|>\n", "\n"


def turn_moves(role: str | None) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after): (cost, action) of the cheapest way to take a turn of this role.

    ``place`` begins a message, under another role if need be; ``merge`` goes on with the message before; ``insert``
    puts an empty message of the other role first. Equal costs prefer them in this order.
    """

    def named(as_role: str) -> int:
        return 0 if role == as_role else RELABEL if role in ROLES else RELABEL_UNKNOWN

    moves: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(N):
        legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}[before]
        options = [(after, named(ROLES[after - 1]), "place") for after in legal]
        if before != START:
            options.append((before, MERGE + named(ROLES[before - 1]), "merge"))
        options.append((2 if before == 2 else 3, INSERT + named(USER if before == 2 else ASSISTANT), "insert"))
        for after, cost, action in options:
            if cost < moves.get((before, after), (INFINITE, ""))[0]:
                moves[before, after] = cost, action
    return moves


#: Cost of the empty messages that end a conversation, by state; they are of these roles.
ENDS = {0: [], 1: [USER, ASSISTANT], 2: [ASSISTANT], 3: []}


def end_cost(state: int) -> int:
    return INSERT * len(ENDS[state])


def forward(roles: list[str | None], best: list[int]) -> tuple[list[int], list[list]]:
    """Costs by state after the turns, from costs by state before; and the step that leads to each state, turn by turn.

    Equal costs prefer the lower state before. That choice looks at costs from the conversation's start only, so it
    is the same however the conversation is cut.
    """
    known: dict[str | None, list] = {}
    back = []
    for role in roles:
        if role not in known:
            known[role] = sorted(turn_moves(role).items())
        step, new = [None] * N, [INFINITE] * N
        for (a, z), (cost, action) in known[role]:
            if best[a] + cost < new[z]:
                new[z], step[z] = best[a] + cost, (a, z, action, cost)
        best = new
        back.append(step)
    return best, back


def backward(back: list[list], state: int) -> list[tuple[int, int, str, int]]:
    """(state before, state after, action, cost) of every turn on the path that ends in ``state``."""
    path = []
    for step in reversed(back):
        path.append(step[state])
        state = step[state][0]
    return path[::-1]


FIRST = [0, INFINITE, INFINITE, INFINITE]


def last_state(best: list[int]) -> int:
    """Where the cheapest path ends, the empty messages that end the conversation counted in."""
    return min(range(N), key=lambda s: (best[s] + end_cost(s), s))


def stretch_costs(roles: list[str | None]) -> list[int]:
    """Costs of a stretch of turns, by state before, then by state after."""
    return sum((forward(roles, [0 if s == before else INFINITE for s in range(N)])[0] for before in range(N)), [])


def repair(roles: list[str | None]) -> list[tuple[int, int, str, int]]:
    """The cheapest legal path of a whole conversation."""
    best, back = forward(roles, FIRST)
    return backward(back, last_state(best))


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conv, turn, role, action, new_role, cost, rendered): every turn, repaired at the least cost per conversation.

    ``rendered`` is the turn's share of the rendered conversation; the shares of a conversation in the order of
    turn, role and text are its whole, so no task gathers it. ``action`` is place, merge or insert (see
    ``turn_moves``), ``new_role`` the role of the message that holds the turn; the last turn's ``cost`` counts the
    empty messages that end the conversation, too.

    Turns are sorted apart in ranges, and a range is cut into segments of ``segment`` turns at most. A conversation
    that lies in several segments, however long, is summed up in each by its costs between states; from these
    follow the costs at which each segment is entered, then the states in which the segments end, and all segments
    are repaired apart. What meets in one place is a row of 16 numbers per conversation and segment border.
    ``segment`` is a power of two.

    Rows without a conversation id are one conversation; NULL turns come first in theirs; NULL and unknown roles
    are relabelled or merged; NULL text is empty; repeated rows are turns of their own. An empty table gives no rows.
    """
    names = {"conv": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    stored = write_through(turns.select(S.monotonically_increasing_id().alias("row"), *[S.col(f"`{c}`").alias(n) for n, c in names.items()]))
    order = ["conv", "turn", "role", "sum", "row"]
    narrow = stored.select("conv", "turn", "role", S.md5(S.coalesce("text", S.lit(""))).alias("sum"), "row")
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "row", S.monotonically_increasing_id().alias("pos"))
    ranged = write_through(ranged.withColumn("seg", S.expr(f"pos div {segment}")))
    conv = {f.name: f.dataType.simpleString() for f in ranged.schema}["conv"]

    def parts_of(table):
        """Positions at which the conversations of a sorted segment begin, and the end."""
        convs = table["conv"].to_pylist()
        return convs, [i for i in range(len(convs)) if i == 0 or convs[i] != convs[i - 1]] + [len(convs)]

    def sums(table):
        import pyarrow as pa

        table = table.sort_by("pos")
        convs, cuts = parts_of(table)
        roles = table["role"].to_pylist()
        edge = sorted({0, len(cuts) - 2})  # only the first and the last may go on elsewhere
        return pa.table({
            "seg": pa.array([table["seg"][0].as_py()] * len(edge), pa.int64()),
            "conv": pa.array([convs[cuts[i]] for i in edge], table.schema.field("conv").type),
            "costs": pa.array([stretch_costs(roles[cuts[i]:cuts[i + 1]]) for i in edge], pa.list_(pa.int64())),
        })

    def entries(table):
        """Along the segments of one conversation: the costs at which each is entered."""
        import pyarrow as pa

        table = table.sort_by("seg")
        best, entry = FIRST, []
        for flat in table["costs"].to_pylist():
            entry.append(best)
            best = [min(INFINITE, *(best[a] + flat[a * N + z] for a in range(N))) for z in range(N)]
        last = [-1] * (len(entry) - 1) + [last_state(best)]
        return pa.table({"seg": table["seg"], "conv": table["conv"], "entry": pa.array(entry, pa.list_(pa.int64())), "end": pa.array(last, pa.int32())})

    def paths(table, known):
        """Turn by turn steps of each conversation of a segment: (conversation, steps back, costs after, border row)."""
        convs, cuts = parts_of(table)
        roles = table["role"].to_pylist()
        border = {r["conv"]: r for r in known.to_pylist()}
        for a, z in zip(cuts, cuts[1:]):
            b = border.get(convs[a])
            best, back = forward(roles[a:z], b["entry"] if b else FIRST)
            yield convs[a], back, best, b

    def origins(table, known):
        """For the conversations at a segment's borders: the state before that leads to each state after."""
        import pyarrow as pa

        rows = []
        for conv, back, _, b in paths(table.sort_by("pos"), known):
            if b:
                rows.append((b["seg"], conv, [backward(back, z)[0][0] if back[-1][z] else -1 for z in range(N)], b["end"]))
        cols = list(zip(*rows))
        return pa.table({"seg": pa.array(cols[0], pa.int64()), "conv": pa.array(cols[1], table.schema.field("conv").type), "origin": pa.array(cols[2], pa.list_(pa.int32())), "end": pa.array(cols[3], pa.int32())})

    def ends(table):
        """Along the segments of one conversation, from its end: the state after each."""
        import pyarrow as pa

        table = table.sort_by("seg")
        state, after = table["end"][-1].as_py(), []
        for origin in reversed(table["origin"].to_pylist()):
            after.append(state)
            state = origin[state]
        last = [False] * (len(after) - 1) + [True]
        return pa.table({"seg": table["seg"], "conv": table["conv"], "after": pa.array(after[::-1], pa.int32()), "last": pa.array(last)})

    edges = ranged.groupBy("seg").applyInArrow(sums, f"seg long, conv {conv}, costs array<long>")
    entered = write_through(edges.groupBy("conv").applyInArrow(entries, f"seg long, conv {conv}, entry array<long>, end int"))
    led = ranged.groupBy("seg").cogroup(entered.groupBy("seg")).applyInArrow(origins, f"seg long, conv {conv}, origin array<int>, end int")
    left = led.groupBy("conv").applyInArrow(ends, f"seg long, conv {conv}, after int, last boolean")
    same = [S.col("a.seg") == S.col("b.seg"), S.col("a.conv").eqNullSafe(S.col("b.conv"))]
    borders = write_through(entered.alias("a").join(left.alias("b"), same).select("a.seg", "a.conv", "a.entry", "b.after", "b.last"))

    def decide(table, known):
        import pyarrow as pa

        table = table.sort_by("pos")
        path, last = [], []
        for _, back, best, b in paths(table, known):
            path += backward(back, b["after"] if b else last_state(best))
            last += [False] * (len(back) - 1) + [b["last"] if b else True]
        cols = list(zip(*path))
        return pa.table({"row": table["row"], "before": pa.array(cols[0], pa.int32()), "after": pa.array(cols[1], pa.int32()), "action": pa.array(cols[2]), "cost": pa.array(cols[3], pa.int32()), "last": pa.array(last)})

    plan = ranged.groupBy("seg").cogroup(borders.groupBy("seg")).applyInArrow(decide, "row long, before int, after int, action string, cost int, last boolean")
    return rendered(stored.join(plan, "row")).select(*[S.col(n).alias(names[n]) for n in ("conv", "turn", "role")], "action", "new_role", "cost", "rendered")


def rendered(df: DataFrame) -> DataFrame:
    """Columns new_role, cost (with the end's) and rendered from text, before, after, action and last."""
    role = lambda c: S.element_at(S.array(*map(S.lit, ROLES)), c)
    empty = lambda r: OPEN.format(r) + CLOSE
    close = S.when(S.col("before") != START, CLOSE).otherwise("")
    other = S.when(S.col("after") == 2, empty(ASSISTANT)).otherwise(empty(USER))
    opened = S.concat(S.lit(OPEN.split("{}")[0]), role(S.col("after")), S.lit(OPEN.split("{}")[1]))
    head = S.when(S.col("action") == "merge", S.lit(JOIN)).when(S.col("action") == "insert", S.concat(close, other, opened)).otherwise(S.concat(close, opened))
    tail, extra = S.lit(CLOSE), S.lit(0)
    for state, roles in ENDS.items():
        tail = S.when(S.col("after") == state, CLOSE + "".join(map(empty, roles))).otherwise(tail)
        extra = S.when(S.col("after") == state, end_cost(state)).otherwise(extra)
    return df.withColumns({
        "new_role": role(S.col("after")),
        "cost": (S.col("cost") + S.when(S.col("last"), extra).otherwise(0)).cast("int"),
        "rendered": S.concat(head, S.coalesce("text", S.lit("")), S.when(S.col("last"), tail).otherwise("")),
    })
