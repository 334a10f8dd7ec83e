"""Repair of conversation structure: rows stream by conversation and turn, an edit automaton carries its state across batches.

A repaired conversation's role initials are s?(ua)+ or nothing. What the cheapest edits look like after each row depends
only on the costs of the four states beside each other and on the order of their edits, so every such situation is
worked out once and a row is one look-up; per row only the number of that look-up is remembered.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: States of the repaired row of roles: nothing yet, system, user, assistant. The last and the first may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Costs of the edits Keep, Rerole, Delete, Insert, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: Codes of a row's first fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
SPACES = " \t\n\x0b\f\r"
#: Look-ups that are remembered in memory before they go to a file, 2 bytes each.
REMEMBERED = 1 << 20


def after(state: int, role: int) -> int | None:
    """The state after a role (0 system, 1 user, 2 assistant; 3 any other), if it may follow."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


def wanted(state: int) -> int:
    """The role that an inserted or changed row has: user, or assistant after a user."""
    return 2 if state == USER else 1


def inserted(state: int, most: int) -> Iterator[tuple[str, int]]:
    """Edits and state after 0 to `most` inserts."""
    edits = ""
    for _ in range(most + 1):
        yield edits, state
        state, edits = after(state, wanted(state)), edits + "I"


class Automaton:
    """Situations and the steps between them.

    A situation has for each state that can be reached its cost above the cheapest and the rank of its edits in ASCII
    order. Inserts count to the row they precede, so edits of different states after the same rows are never one
    another's beginning, and ranks stay right whatever follows. A step has for each state the state before and the edits.
    """

    def __init__(self):
        self.situations: list[tuple] = []
        self.steps: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.table: dict[int, tuple[int, int, int]] = {}
        self.first = self.number(((0, 0), None, None, None))

    def number(self, situation: tuple) -> int:
        if situation not in self.known:
            self.known[situation] = len(self.situations)
            self.situations.append(situation)
        return self.known[situation]

    def step(self, at: int, role: int, fault: int) -> tuple[int, int, int]:
        """(situation, step, cost) after a row; the cost is that of its cheapest state above the cheapest before."""
        k = at * 16 + role * 4 + fault
        if k not in self.table:
            self.table[k] = self.worked_out(at, role, fault)
        return self.table[k]

    def worked_out(self, at: int, role: int, fault: int) -> tuple[int, int, int]:
        found: dict[int, tuple] = {}
        for state, best in enumerate(self.situations[at]):
            if best is None:
                continue
            for edits, now in inserted(state, 2):
                options = [("D", now, DELETE)]
                if fault not in (BLANK, DUPLICATE):
                    stays = CUT_SHORT if fault == TRUNCATED else 0
                    options += [("K", after(now, role), KEEP + stays), ("R", after(now, wanted(now)), REROLE + stays)]
                for edit, to, cost in options:
                    if to is not None:
                        candidate = (best[0] + INSERT * len(edits) + cost, best[1], edits + edit, state)
                        found[to] = min(found.get(to, candidate), candidate)
        least = min(x[0] for x in found.values())
        ranks = {s: i for i, s in enumerate(sorted(found, key=lambda s: found[s][1:3]))}
        situation = tuple((found[s][0] - least, ranks[s]) if s in found else None for s in range(4))
        step = tuple((found[s][3], found[s][2]) if s in found else None for s in range(4))
        if step not in self.known:
            self.known[step] = len(self.steps)
            self.steps.append(step)
        return self.number(situation), self.known[step], least

    def end(self, at: int) -> tuple[int, str, int]:
        """(cost above the cheapest state, inserts at the end, last state before them) of the cheapest whole edits."""
        options = []
        for state, best in enumerate(self.situations[at]):
            for edits, now in inserted(state, 2) if best is not None else ():
                if now in ENDS:
                    options.append((best[0] + INSERT * len(edits), best[1], edits, state))
        cost, _, edits, state = min(options)
        return cost, edits, state


class Remembered:
    """Numbers of steps, 2 bytes each; beyond REMEMBERED they go to a file of the task, which ends with it."""

    def __init__(self):
        self.recent, self.file, self.filed = array("H"), None, 0

    def append(self, step: int) -> None:
        self.recent.append(step)
        if len(self.recent) >= REMEMBERED:
            self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115  closed with the conversation
            self.file.write(self.recent.tobytes())
            self.filed += len(self.recent)
            del self.recent[:]

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.recent)
        while self.filed:
            n = min(self.filed, REMEMBERED)
            self.filed -= n
            self.file.seek(self.filed * 2)
            yield from reversed(array("H", self.file.read(n * 2)))
        if self.file:
            self.file.close()


class Conversation:
    """What is known of a conversation after the rows so far: figures, the automaton's situation, a digest for each state."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.at, self.cost, self.steps = automaton, automaton.first, 0, Remembered()
        self.digests = [hashlib.sha256(), None, None, None]
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.low = self.high = self.last_turn = None
        self.turns = 0

    def row(self, turn: str | None, role: str, text: str, kind: int, fault: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.low, self.high, self.turns, self.last_turn = self.low if self.turns else turn, turn, self.turns + 1, turn
        self.faults[fault] += 1
        if self.before is not None and (self.before, kind) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.before = kind
        self.at, step, cost = self.automaton.step(self.at, kind, fault)
        self.cost += cost
        self.steps.append(step)
        self.digests = [x and self.extended(*x, role, text) for x in self.automaton.steps[step]]

    def extended(self, state: int, edits: str, role: str = "", text: str = "") -> hashlib._Hash:
        """The digest of a state with the lines of some edits."""
        digest = self.digests[state]
        if edits != "D":
            digest = digest.copy()
        for edit in edits:
            if edit == "D":
                continue
            name = role if edit == "K" else ("", "user", "assistant")[wanted(state)]
            line = f"{name}:{text if edit != 'I' else ''}"
            digest.update((("\n" if state != START else "") + line).encode())
            state = after(state, INITIALS.find(name[:1]))
        return digest

    def finished(self) -> tuple:
        cost, tail, state = self.automaton.end(self.at)
        digest = self.extended(state, tail).hexdigest()
        parts = [tail]
        for step in self.steps.backwards():
            state, edits = self.automaton.steps[step][state]
            parts.append(edits)
        gaps = int(self.high) - int(self.low) + 1 - self.turns if self.turns else 0
        return gaps, *self.faults[1:], self.illegal, self.cost + cost, "".join(reversed(parts)), digest


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def streamed(frames: Iterator) -> Iterator:
    """Sorted rows (id, turn, role, text, kind, fault) -> a row of figures for each conversation; state outlives the frames."""
    import pandas as pd

    automaton, current, name, done = Automaton(), None, None, []
    for frame in frames:
        names, turns = ([x if isinstance(x, str) else None for x in frame[c]] for c in ("id", "turn"))
        for i, turn, role, text, kind, fault in zip(names, turns, *(frame[c].tolist() for c in ("role", "text", "kind", "fault")), strict=True):
            if current is None or i != name:
                if current is not None:
                    done.append((name, *current.finished()))
                current, name = Conversation(automaton), i
            if fault >= 0:
                current.row(turn, role, text, kind, fault)
        if done:
            yield pd.DataFrame(done, columns=["id", *FIGURES])
            done = []
    if current is not None:
        yield pd.DataFrame([(name, *current.finished())], columns=["id", *FIGURES])


def prepared(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, absent: Column | None) -> DataFrame:
    """(id, turn, role, text, kind, fault) by conversation and, inside it, by turn, role and text; nulls first.

    Rows are shuffled once: duplicates are told by a window over (id, role, text), which the deal by id already serves.
    kind: 0 to 2 for the initials s, u, a, else 3. fault: of an absent row -1.
    """
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), plain(role_col).alias("role"), F.when(gone, "").otherwise(plain(text_col)).alias("text"), gone.alias("gone")).repartition("id")
    seen = F.row_number().over(Window.partitionBy("id", "role", "text", "gone").orderBy("turn")) > 1
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(F.col("gone"), -1).when(shown == "", BLANK).when(seen, DUPLICATE).when(F.substring(shown, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    ordered = dealt.select("id", "turn", "role", "text", kind.alias("kind"), fault.alias("fault"), seen.alias("seen"))
    return ordered.sortWithinPartitions("id", "turn", "role", "text", "seen").drop("seen")


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None) -> DataFrame:
    """One row per conversation: faults, the cheapest edits (audit: D, I, K, R), their cost, SHA-256 of the repaired rows.

    Rows go by turn, nulls first; those of one turn by role and text. A null role or text is one space. Rows without
    more than white space are blank, later ones with the role and text of an earlier one duplicate, those that don't
    end in . ! ? truncated. Blank and duplicate rows are deleted; for what else is cheapest see Automaton; of equally
    cheap edits the least in ASCII order is taken. Null ids are a conversation too. Where absent is true a row only
    says that its conversation exists; one with no other row has zeros, an empty audit and the digest of nothing.
    An empty table gives no rows; other columns aren't read. A conversation is one task's by the method: it streams
    through it in batches, with 2 bytes a row remembered and, beyond a million rows, filed. Turns are whole numbers.
    """
    sorted_rows = prepared(rows, id_col, turn_col, role_col, text_col, absent)
    found = sorted_rows.select(F.col("id").cast("string"), F.col("turn").cast("string"), "role", "text", "kind", "fault").mapInPandas(streamed, SCHEMA)
    return found.select(F.col("id").cast(rows.schema[id_col].dataType).alias(id_col), *FIGURES)


def repaired(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired rows: id, position from 0, role, text, edit (K, R or I). Same rules as repair, whose audits it carries out.

    Rows and edits meet by their number in the conversation, so even one giant conversation spreads over tasks.
    """
    number = F.row_number().over(Window.partitionBy("id").orderBy("turn", "role", "text"))
    own = prepared(rows, id_col, turn_col, role_col, text_col, None).select("id", number.alias("n"), "role", "text")
    audits = repair(rows, id_col, turn_col, role_col, text_col).select(F.col(id_col).alias("of"), F.regexp_extract_all("audit", F.lit("I*[DKR]|I+$"), F.lit(0)).alias("edits"))
    edits = audits.select("of", F.posexplode("edits").alias("k", "edits")).select("of", (F.col("k") + 1).alias("k"), F.explode(F.split("edits", "")).alias("edit"))
    edits = edits.filter(F.col("edit").isin("I", "K", "R")).withColumn("m", F.when(F.col("edit") == "I", 0).otherwise(1))
    at = F.row_number().over(Window.partitionBy("of").orderBy("k", "m")) - 1
    placed = edits.withColumn("position", at).join(own, F.col("of").eqNullSafe(F.col("id")) & (F.col("k") == F.col("n")) & (F.col("m") == 1), "left")
    system = F.max(((F.col("position") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s")).cast("int")).over(Window.partitionBy("of"))
    turn = F.when((F.col("position") - system) % 2 == 0, "user").otherwise("assistant")
    return placed.select(F.col("of").alias(id_col), "position", F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """conversations with its test damage by crc32 of `conv_id:turn` (nulls: one space) modulo 20, and which rows it drops.

    0 drops the row, 1 empties its text, 2 takes out its . ! ?, 3 repeats it, 4 makes its role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), harm.alias("harm"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "harm")
    twice = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("*", twice.alias("copy")), F.col("harm") == 0


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `conversations`, damaged as the contract says, then repaired."""
    rows, dropped = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, absent=dropped)
