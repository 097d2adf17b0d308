"""Conversation structure repair: the cheapest edits that make roles alternate, by dynamic programming over the turns that stay.

A conversation is well formed if its role initials are none, or user and assistant in turn from a user to an assistant, a system turn
before the first or not. Turns are kept (cost 0), given another role (2), deleted (3), and turns without text are inserted (2); blank and
repeated turns must go, a turn that ends without a full stop, question or exclamation mark costs 1 if it stays.

* The programme goes over retained turns. A turn may stay with its role or with another one; what lies between it and the retained turn
  before it is deleted, and the price of that gap is a difference of prefix sums of deletions. So for each role that may come last
  (none yet, system, user, assistant) one running minimum, of cost less prefix sum, stands for all turns before.
* The pair of roles around a gap says which turns are inserted: none or one, at the end of a conversation up to two.
* Ties go to the least audit, the edits' initials in order. Deletions stand before insertions in a gap. No audit of the running minima
  is the beginning of another one, as each ends with the same turn; so they are compared by their order among the four before, and then
  by what is added, and no audit is ever written out to be compared.

Rows are dealt once by conversation and sorted; each conversation streams through its task. Choices that all minima agree on are written
at once, and minima that are too dear to win are dropped, so that a long conversation is not held. Faults are found by Spark.

Edge cases: null roles and texts are one space, null turns come first; rows of one turn stand in order of role and text; a role without
an initial, or with another initial than s, u and a, can't be kept; a null conversation is one; a conversation without rows has an empty
audit and zeros; an empty table gives no rows; columns beyond the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cadenza.llm.common import table

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A state that costs more than the cheapest by this can't win: from any state two insertions lead to the last role assistant, from where
#: every continuation costs at most one deletion more than from any other state.
HOPELESS = 2 * INSERT + DELETE
#: Retained turns after which choices that all states agree on are written.
WRITE_EVERY = 1024
FAULTS = ("blank", "duplicate", "truncated")

_SPACE = " \t\n\x0b\x0c\r"
_NONE, _S, _U, _A = range(4)
_STATE = {"s": _S, "u": _U, "a": _A}
_ROLE = {_U: "user", _A: "assistant"}
#: States inserted between two states, and after the last one; a system turn stays only where nothing is before it.
_BETWEEN = {
    (_NONE, _S): (),
    (_NONE, _U): (), (_S, _U): (), (_A, _U): (), (_U, _U): (_A,),
    (_U, _A): (), (_NONE, _A): (_U,), (_S, _A): (_U,), (_A, _A): (_U,),
}
_AT_END = {_NONE: (), _S: (_U, _A), _U: (_A,), _A: ()}
_FROM = {to: [(a, len(between)) for (a, b), between in _BETWEEN.items() if b == to] for to in (_S, _U, _A)}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, there): a quarter of the turns is dropped (not there), emptied, robbed of end marks, repeated, or made the user's, by a checksum of its number."""
    conv, turn = F.col(conv_col), F.col(turn_col)
    kind = F.pmod(F.crc32(F.concat(_text(conv), F.lit(":"), _text(turn)).cast("binary")), F.lit(20))
    role, text = _text(F.col(role_col)), _text(F.col(text_col))
    rows = conversations.select(conv.alias("conv"), turn.cast("long").alias("turn"), kind.alias("kind"), role.alias("role"), text.alias("text"))
    changed = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": changed, "role": F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")), "there": F.col("kind") != 0})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def judged(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, there) dealt by conversation and in order, with their first fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    body = F.rtrim("text", F.lit(_SPACE))
    same = Window.partitionBy("conv", "role", "text", "there").orderBy(F.col("turn").asc_nulls_first())
    rows = rows.repartition("conv").withColumn("nth", F.row_number().over(same))
    fault = F.when(body == "", 1).when(F.col("nth") > 1, 2).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv", "turn", "role", "text", "there", fault.alias("fault"), "nth").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "nth")


class Repair:
    """One conversation, turn by turn. A choice is [the one before, number of the turn, initial of the edit, its state, role, text, turn]."""

    def __init__(self, take):
        self.take = take  # called with each turn of the repaired conversation, in order
        self.n = self.deleted = self.open = 0
        self.best: dict[int, tuple[int, int, list | None]] = {_NONE: (0, 0, None)}  # state to (cost less prefix sum of deletions, order of its audit, last choice)
        self.audit: list[str] = []
        self.written: tuple[list | None, int, int] = (None, 0, _NONE)  # the last choice written, its number and state
        self.counts = [0, 0, 0]
        self.illegal, self.initial = 0, None
        self.least = self.most = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None:
            self.turns += self.most is None or turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        if fault:
            self.counts[fault - 1] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.n += 1
        before, self.deleted = self.deleted, self.deleted + DELETE
        new = {state: (value, (rank, "D"), choice) for state, (value, rank, choice) in self.best.items()}
        if fault not in (1, 2):
            own = TRUNCATED if fault == 3 else 0
            for state in (_S, _U, _A):
                kept = state == _STATE.get(role[:1])
                if not kept and state == _S:
                    continue
                edit, price = ("K", own) if kept else ("R", own + REROLE)
                found = None
                for last, inserts in _FROM[state]:
                    if last in self.best:
                        value, rank, _ = self.best[last]
                        option = value + before + inserts * INSERT + price - self.deleted, (rank, "I" * inserts + edit), last
                        if found is None or option < found:
                            found = option
                if found is not None and (state not in new or found[:2] < new[state][:2]):
                    new[state] = found[0], found[1], [self.best[found[2]][2], self.n, edit, state, role if kept else _ROLE[state], text, turn]
                    self.open += 1
        dear = min(value for value, _, _ in new.values()) + HOPELESS
        new = {state: x for state, x in new.items() if x[0] <= dear}
        order = {key: k for k, key in enumerate(sorted(key for _, key, _ in new.values()))}
        self.best = {state: (value, order[key], choice) for state, (value, key, choice) in new.items()}
        if self.open >= WRITE_EVERY:
            self._agreed()

    def _path(self, choice: list | None) -> list[list]:
        """Choices after the last one written, up to this."""
        out = []
        while choice is not None and choice is not self.written[0]:
            out.append(choice)
            choice = choice[0]
        return out[::-1]

    def _agreed(self) -> None:
        paths = [self._path(choice) for _, _, choice in self.best.values()]
        same = 0
        while all(len(p) > same for p in paths) and all(p[same] is paths[0][same] for p in paths):
            same += 1
        self._write(paths[0][:same])
        self.open = max(len(p) for p in paths) - same if same else 0

    def _write(self, path: list[list]) -> None:
        for choice in path:
            _, number, edit, state, role, text, turn = choice
            _, last, before = self.written
            inserted = _BETWEEN[before, state]
            self.audit.append("D" * (number - last - 1) + "I" * len(inserted) + edit)
            for s in inserted:
                self.take("I", None, _ROLE[s], "")
            self.take(edit, turn, role, text)
            self.written = choice, number, state
            choice[0] = None

    def finish(self) -> tuple[int, str]:
        """The cost and the audit."""
        ends = [(value + self.deleted + len(_AT_END[state]) * INSERT, (rank, "I" * len(_AT_END[state])), state) for state, (value, rank, _) in self.best.items()]
        cost, _, state = min(ends)
        self._write(self._path(self.best[state][2]))
        self.audit.append("D" * (self.n - self.written[1]) + "I" * len(_AT_END[state]))
        for s in _AT_END[state]:
            self.take("I", None, _ROLE[s], "")
        return cost, "".join(self.audit)

    def gaps(self) -> int:
        return 0 if self.most is None else self.most - self.least + 1 - self.turns


def _conversations(batches, begin) -> Iterator:
    """The state that ``begin(conv)`` makes for every conversation, after ``add`` of all its rows that are there; None between, so that the caller may send on."""
    now, own = None, None
    for batch in batches:
        cols = [batch.column(k).to_pylist() for k in range(6)]
        for conv, turn, role, text, there, fault in zip(*cols, strict=True):
            if now is None or conv != now[0]:
                if now is not None:
                    yield own
                now, own = (conv,), begin(conv)
            if there:
                own.add(turn, role, text, fault)
        yield None
    if now is not None:
        yield own


class _Digest(Repair):
    def __init__(self, conv):
        super().__init__(self._hash)
        self.conv, self.sha, self.first = conv, hashlib.sha256(), True

    def _hash(self, edit, turn, role, text):
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False


def repairs(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, there) to one row a conversation: gaps, faults, illegal pairs of roles, cost, audit and the repaired text's hash."""
    names = ["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"]
    kind = rows.schema["conv"].dataType
    kinds = [to_arrow_type(kind), *[pa.int64()] * 6, pa.string(), pa.string()]

    def run(batches):
        out = []
        for own in _conversations(batches, _Digest):
            if own is not None:
                cost, audit = own.finish()
                out.append((own.conv, own.gaps(), *own.counts, own.illegal, cost, audit, own.sha.hexdigest()))
            if out and (own is None or len(out) >= 10_000):
                yield _record(out, names, kinds)
                out = []
        if out:
            yield _record(out, names, kinds)

    return judged(rows).mapInArrow(run, f"conv_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, there) to the repaired conversations: (conv, position from 1, turn, role, text, edit); inserted turns have no number."""
    names = ["conv", "position", "turn", "role", "text", "edit"]
    kind = rows.schema["conv"].dataType
    kinds = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        out: list[tuple] = []

        def begin(conv):
            at = iter(range(1, 1 << 62))
            return Repair(lambda edit, turn, role, text: out.append((conv, next(at), turn, role, text, edit)))

        for own in _conversations(batches, begin):
            if own is not None:
                own.finish()
            if out and (own is None or len(out) >= 1000):
                yield _record(out, names, kinds)
                out.clear()
        if out:
            yield _record(out, names, kinds)

    return judged(rows).mapInArrow(run, f"conv {kind.simpleString()}, position long, turn long, role string, text string, edit string")


def _record(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same with strings: states none, s, u, a hold (cost, audit, text), and every row may be deleted, kept or given a role after insertions."""

    def step(x: str, cost: str, edit: str, line: str = "''") -> str:
        return f"struct_pack(c := {x}.c + {cost}, a := {x}.a || '{edit}', t := {x}.t || {line})"

    def insert(x: str, role: str) -> str:
        return step(x, str(INSERT), "I", f"chr(10) || '{role}:'")

    never = "struct_pack(c := 1000000::BIGINT, a := '', t := '')"
    stay = f"(CASE fault WHEN 'blank' THEN 1000000 WHEN 'duplicate' THEN 1000000 WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END)"

    def retained(x: str, initial: str, role: str) -> str:
        return f"CASE WHEN x = '{initial}' THEN {step(x, stay, 'K', 'chr(10) || line')} ELSE {step(x, f'({REROLE} + {stay})', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || body')} END"

    return rf"""
WITH RECURSIVE sourced AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda z: ascii(z)::BIGINT) AS bytes FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], bytes),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS kind FROM sourced),
twice AS (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed WHERE kind <> 0),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM twice),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM numbered),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
folded AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, struct_pack(c := 0::BIGINT, a := '', t := '') AS none, {never} AS s, {never} AS u, {never} AS a FROM conversations
  UNION ALL
  SELECT conv_id, i, {step("none", str(DELETE), "D")},
         list_min([{step("s", str(DELETE), "D")}, CASE WHEN x = 's' THEN {step("none", stay, "K", "chr(10) || line")} ELSE {never} END]),
         list_min([{step("u1", str(DELETE), "D")}, {retained("none", "u", "user")}, {retained("s", "u", "user")}, {retained("a1", "u", "user")}]),
         list_min([{step("a1", str(DELETE), "D")}, {retained("u1", "a", "assistant")}])
  FROM (SELECT f.*, list_min([a, {insert("u1", "assistant")}]) AS a1 FROM (
    SELECT d.conv_id, j.i, none, s, u, a, left(j.role, 1) AS x, j.role || ':' || j.text AS line, j.text AS body, j.fault,
           list_min([u, {insert("none", "user")}, {insert("s", "user")}, {insert("a", "user")}]) AS u1
    FROM folded d JOIN judged j ON j.conv_id IS NOT DISTINCT FROM d.conv_id AND j.i = d.i + 1) f)),
ended AS (
  SELECT f.conv_id, t.gaps, t.blank, t.duplicate, t.truncated, t.illegal,
         list_min([f.none, f.a, {insert("f.u", "assistant")}, {insert(f"({insert('f.s', 'user')})", "assistant")}]) AS best
  FROM folded f LEFT JOIN told t ON f.conv_id IS NOT DISTINCT FROM t.conv_id WHERE f.i = coalesce(t.n, 0))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256 FROM ended
"""


OP12_SQL = _sql()
