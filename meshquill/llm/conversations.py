"""Repair of conversation structure: the cheapest edits that make the roles of a conversation a dialogue.

A repaired conversation has the role initials `(s?(ua)+)?`. Four states read it: nothing yet, after a
system turn, after a user turn, after an assistant turn. Rows are kept (0), given the role that is due (2)
or deleted (3); a turn of the role that is due can be inserted anywhere (2). Blank and repeated rows must
go; a truncated row that stays costs 1. A backward pass over the rows gives the cost to go of every state;
a forward walk then takes, among the edits on a cheapest path, the least letter. As every letter leads to
one state, that is the least string of edits.

The passes are cut so that no conversation has to fit in a task. Rows are sorted by range over the whole
table and numbered in that order. A leaf is a run of at most 2^LEAF_BITS rows of one conversation. Costs
of a leaf from each state to each state are a 4 x 4 matrix; matrices of a conversation (one for 65,536
rows, 128 bytes each) are multiplied backward to the costs to go behind each leaf, the leaves' walks are
chained forward to the state in which each is entered, and the walks that count are made leaf by leaf.
Conversations of one leaf take none of these steps but the last. The SHA-256 of a repaired conversation has
to read its turns in order; it reads them as a sorted stream and holds one batch.

Defined cases: rows with a null conv_id are one conversation; null roles and texts count as one space,
which is a blank text and a role that is never right; null turns come first; rows of one turn are ordered
by role and by the MD5 of the text; rows that repeat are duplicates of the first; an initial is compared as
it is (`User` isn't `user`), an empty role has none; a conversation without rows has no edits; an empty
table gives no row. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

LEAF_BITS = 16
BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_ROLES = ("user", "assistant")
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; the state that an added or changed turn leads to.
DUE = (2, 2, 3, 2)
#: State after a row that is kept, by state and initial.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Cost from each state to an end of the dialogue by turns inserted behind the last row.
END = (0, 4, 2, 0)
FAR = 1 << 40
_DUE_ROLE = {2: _ROLES[0], 3: _ROLES[1]}
#: Codes of rows: initial and what holds of the row (0 sound, 1 must be deleted, 2 truncated).
INITIALS, FAULTS = "suao", 3


def _edits(state: int, code: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, in ASCII order."""
    initial, fault = INITIALS[code // FAULTS], code % FAULTS
    out = [("D", DELETE, state)]
    if fault != 1:
        late = TRUNCATED if fault == 2 else 0
        if initial in KEPT[state]:
            out.append(("K", KEEP + late, KEPT[state][initial]))
        out.append(("R", REROLE + late, DUE[state]))
    return out


def _step(code: int) -> np.ndarray:
    """Least cost from each state before a row to each state behind it, turns inserted before it included."""
    cost = np.full((4, 4), FAR, np.int64)
    for state in range(4):
        for _, c, to in _edits(state, code):
            cost[state, to] = min(cost[state, to], c)
    for _ in range(3):
        for state in range(4):
            cost[state] = np.minimum(cost[state], cost[DUE[state]] + INSERT)
    return cost


def leaf_costs(codes: bytes, steps: list[np.ndarray]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for code in reversed(codes):
        out = np.minimum((steps[code][:, :, None] + out[None]).min(axis=1), FAR)
    return out


def costs_to_go(codes: bytes, behind: np.ndarray, steps: list[np.ndarray]) -> list[list[int]]:
    """Of each state before each row, and behind the last one."""
    out = [behind.tolist()]
    for code in reversed(codes):
        behind = np.minimum((steps[code] + behind).min(axis=1), FAR)
        out.append(behind.tolist())
    return out[::-1]


def walk(codes: bytes, costs: list[list[int]], state: int, last: bool) -> tuple[list[tuple[int, str, int]], int]:
    """(row, letter, state reached) of each edit, taken by least letter among those on a cheapest path, and the state at the end.

    Turns behind the last row of a leaf are inserted by the next leaf, behind the last leaf (last) here.
    """
    done = []
    for i, code in enumerate(codes):
        while True:
            go = costs[i][state]
            options = [("I", INSERT, DUE[state], i), *((x, c, to, i + 1) for x, c, to in _edits(state, code))]
            letter, _, to, at = min(o for o in options if o[1] + costs[o[3]][o[2]] == go)
            done.append((i, letter, to))
            state = to
            if at > i:
                break
    while last and state in (1, 2):
        state = DUE[state]
        done.append((len(codes) - 1, "I", state))
    return done, state


def _steps() -> list[np.ndarray]:
    return [_step(code) for code in range(len(INITIALS) * FAULTS)]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    steps = _steps()
    for batch in batches:
        found = [leaf_costs(bytes(codes), steps).reshape(-1).tolist() for codes in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("conv_id"), pa.array(found, pa.list_(pa.int64()))], ["leaf", "conv_id", "costs"])


def _behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, behind, last) of the leaves of each conversation, from its sorted matrices."""
    for batch in batches:
        out = []
        for leaves in batch.column("leaves").to_pylist():
            go = np.array(END, np.int64)
            for k, leaf in enumerate(reversed(leaves)):
                out.append((leaf["leaf"], go.tolist(), k == 0))
                go = np.minimum((np.array(leaf["costs"], np.int64).reshape(4, 4) + go).min(axis=1), FAR)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.bool_())], ["leaf", "behind", "last"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each leaf is left, for each in which it can be entered."""
    steps = _steps()
    for batch in batches:
        found = []
        for codes, behind in zip(batch.column("codes").to_pylist(), batch.column("behind").to_pylist(), strict=True):
            costs = costs_to_go(bytes(codes), np.array(behind, np.int64), steps)
            found.append([walk(bytes(codes), costs, state, False)[1] if costs[0][state] < FAR else -1 for state in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("conv_id"), pa.array(found, pa.list_(pa.int32()))], ["leaf", "conv_id", "ends"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for leaves in batch.column("leaves").to_pylist():
            state = 0
            for leaf in leaves:
                out.append((leaf["leaf"], state))
                state = leaf["ends"][state]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32())], ["leaf", "entry"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each leaf: audit, cost, pairs of roles that no dialogue has, and (id, k, letter, role) of each edit."""
    steps = _steps()
    edit = pa.struct([("id", pa.int64()), ("k", pa.int32()), ("letter", pa.string()), ("role", pa.string())])
    for batch in batches:
        audits, costs, illegal, edits = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("ids", "codes", "behind", "last", "entry"))
        for ids, codes, behind, last, entry in zip(*columns, strict=True):
            to_go = costs_to_go(bytes(codes), np.array(behind, np.int64), steps)
            done, state = walk(bytes(codes), to_go, entry, last)
            audits.append("".join(letter for _, letter, _ in done))
            costs.append(to_go[0][entry] - (0 if last else behind[state]))
            roles = "".join(INITIALS[c // FAULTS] for c in codes)
            illegal.append(sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:])))  # noqa: B905
            edits.append([{"id": ids[i], "k": k, "letter": x, "role": _DUE_ROLE[to] if x in "IR" else None} for k, (i, x, to) in enumerate(done) if x != "D"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("leaf"), batch.column("conv_id"), pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), batch.column("first"), batch.column("final"), pa.array(edits, pa.list_(edit))],
            ["leaf", "conv_id", "audit", "cost", "illegal", "first", "final", "edits"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, joined by newlines; rows arrive sorted by (conv_id, id, k)."""
    key, digest, schema = None, None, None

    def flush(to: list) -> list:
        return [*to, (key[0], digest.hexdigest())] if digest is not None else to

    for batch in batches:
        schema, out = batch.schema.field("conv_id").type, []
        for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if key != (conv,):
                out = flush(out)
                key, digest = (conv,), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], schema), pa.array([x[1] for x in out], pa.string())], ["conv_id", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], schema), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that a hash of conversation and turn puts in."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20).alias("__h"))
    h = F.col("__h")
    text = F.when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("__h <> 0").select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1))))
    return rows.drop("col")


def _initial(role: str) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows numbered by conversation and turn, and without their texts, with their faults; written, so that the numbers stay."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))).withColumn("digest", F.md5(F.col("text").cast("binary")))
    keys = ["conv_id", "turn", "role", "digest"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
    bare = F.rtrim("text", F.lit(BLANK))
    rows = materialise(rows.select("*", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open")), "turns-ordered")
    # The first row of each role and text; its number finds it, so that a text that is everywhere is no join key.
    first = rows.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("new"))
    marked = rows.drop("text").join(first, "id", "left")
    new = F.coalesce("new", F.lit(False))
    judged = marked.select("id", "conv_id", "turn", "role", "blank", (~F.col("blank") & ~new).alias("duplicate"), (~F.col("blank") & new & F.col("open")).alias("truncated"))
    return rows.select("id", "role", "text"), materialise(judged, "turns-judged")


def _leaves(rows: DataFrame, leaf_bits: int) -> DataFrame:
    """Runs of rows of one conversation, at most 2^leaf_bits each: bounded lists, whatever the conversation."""
    initial = _initial("role")
    code = FAULTS * (F.instr(F.lit(INITIALS), initial) - 1) + F.when(F.col("blank") | F.col("duplicate"), 1).when(F.col("truncated"), 2).otherwise(0)
    coded = rows.select("id", "conv_id", code.cast("int").alias("code"))
    leaves = coded.groupBy("conv_id", F.shiftright("id", leaf_bits).alias("run")).agg(F.array_sort(F.collect_list(F.struct("id", "code"))).alias("rows"))
    ids, codes = F.col("rows.id"), F.col("rows.code")
    letter = lambda c: F.substring(F.lit(INITIALS), F.floor(c / FAULTS).cast("int") + 1, F.lit(1))
    return leaves.select(ids[0].alias("leaf"), "conv_id", ids.alias("ids"), codes.alias("codes"), letter(F.element_at(codes, 1)).alias("first"), letter(F.element_at(codes, -1)).alias("final"))


def _sorted_list(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("leaf", *columns))).alias("leaves"))


def repair(rows: DataFrame, leaf_bits: int = LEAF_BITS) -> tuple[DataFrame, DataFrame]:
    """For each conversation of rows (conv_id, turn, role, text) its faults and edits; and the repaired turns.

    Turns: conv_id, place (id of a row and k, to sort by), letter, role and text. Deleted rows are left out.
    """
    kind = dict(rows.dtypes)["conv_id"]
    texts, rows = _ordered(rows)
    leaves = materialise(_leaves(rows, leaf_bits), "turns-leaves")
    long_ones = leaves.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("__conv"))
    long_ones = leaves.join(long_ones, F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi")
    matrices = long_ones.select("leaf", "conv_id", "codes").mapInArrow(_matrices, f"leaf long, conv_id {kind}, costs array<long>")
    behind = materialise(_sorted_list(matrices, "costs").mapInArrow(_behind, "leaf long, behind array<long>, last boolean"), "turns-behind")
    ends = long_ones.join(behind, "leaf").select("leaf", "conv_id", "codes", "behind").mapInArrow(_ends, f"leaf long, conv_id {kind}, ends array<int>")
    entries = _sorted_list(ends, "ends").mapInArrow(_entries, "leaf long, entry int")
    known = leaves.join(behind, "leaf", "left").join(entries, "leaf", "left")
    known = known.withColumns({"behind": F.coalesce("behind", F.array(*(F.lit(x).cast("long") for x in END))), "last": F.coalesce("last", F.lit(True)), "entry": F.coalesce("entry", F.lit(0))})
    walks = known.select("leaf", "conv_id", "ids", "codes", "behind", "last", "entry", "first", "final").mapInArrow(
        _walks, f"leaf long, conv_id {kind}, audit string, cost long, illegal long, first string, final string, edits array<struct<id: long, k: int, letter: string, role: string>>"
    )
    walks = materialise(walks, "turns-walks")

    # Folded by turn first: distinct turns are counted without a set for each conversation.
    by_turn = rows.groupBy("conv_id", "turn").agg(*(F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    faults = by_turn.groupBy(F.col("conv_id").alias("__conv")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    joined = _sorted_list(walks, "audit", "cost", "illegal", "first", "final")
    borders = F.zip_with(F.slice("leaves.final", 1, F.size("leaves") - 1), F.slice("leaves.first", 2, F.size("leaves")), lambda x, y: F.when(F.concat(x, y).isin("su", "ua", "au"), 0).otherwise(1))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    joined = joined.select("conv_id", F.array_join("leaves.audit", "").alias("audit"), total(F.col("leaves.cost")).alias("cost"), (total(F.col("leaves.illegal")) + total(borders)).alias("illegal"))
    summary = joined.join(faults, F.col("conv_id").eqNullSafe(F.col("__conv"))).select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = walks.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")
    turns = edits.join(texts.withColumnRenamed("role", "__role"), "id").select("conv_id", "id", "k", "letter", F.coalesce("role", "__role").alias("role"), F.when(F.col("letter") == "I", "").otherwise(F.col("text")).alias("text"))
    return summary, turns


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: of `role:text` of its turns in order, joined by newlines."""
    kind = dict(turns.dtypes)["conv_id"]
    lines = turns.select("conv_id", "id", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "id", "k").mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def audit(conversations: DataFrame, rows: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """One row for each conv_id of conversations: the repair of its rows, with a digest of the result."""
    summary, turns = repair(rows, leaf_bits)
    every = conversations.select("conv_id").distinct()
    with_key = lambda df, key: df.withColumnRenamed("conv_id", key)
    out = every.join(with_key(summary, "__a"), F.col("conv_id").eqNullSafe(F.col("__a")), "left").join(with_key(digests(turns), "__b"), F.col("conv_id").eqNullSafe(F.col("__b")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audit(conversations, damage(conversations))


ORACLE_SQL = r"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 20 AS h
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed, range(2) AS copies(c) WHERE h <> 0 AND (h = 3 OR c = 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_open
  FROM damaged
), judged AS (
  SELECT *, NOT is_blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_dup, role[1:1] AS initial,
    lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE is_blank) AS blank,
    count(*) FILTER (WHERE is_dup) AS duplicate, count(*) FILTER (WHERE NOT is_blank AND NOT is_dup AND is_open) AS truncated,
    count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), best AS (
  -- v: cost, edits and repaired lines from each state (start, system, user, assistant) to the end.
  SELECT conv_id, n AS i, [
    {'cost': 0, 'audit': '', 'lines': ''},
    {'cost': 4, 'audit': 'II', 'lines': chr(10) || 'user:' || chr(10) || 'assistant:'},
    {'cost': 2, 'audit': 'I', 'lines': chr(10) || 'assistant:'},
    {'cost': 0, 'audit': '', 'lines': ''}] AS v
  FROM (SELECT DISTINCT conv_id, n FROM numbered)
  UNION ALL
  SELECT conv_id, i - 1 AS i, list_transform([1, 2, 3, 4], lambda q: list_sort([b[q],
      {'cost': o2[[3, 3, 4, 3][q]].cost + 2, 'audit': 'I' || o2[[3, 3, 4, 3][q]].audit,
       'lines': chr(10) || ['user:', 'user:', 'assistant:', 'user:'][q] || o2[[3, 3, 4, 3][q]].lines}])[1]) AS v
  FROM (SELECT *, list_transform([1, 2, 3, 4], lambda q: list_sort([b[q],
      {'cost': b[[3, 3, 4, 3][q]].cost + 2, 'audit': 'I' || b[[3, 3, 4, 3][q]].audit,
       'lines': chr(10) || ['user:', 'user:', 'assistant:', 'user:'][q] || b[[3, 3, 4, 3][q]].lines}])[1]) AS o2
    FROM (SELECT r.conv_id, r.i, list_transform([1, 2, 3, 4], lambda q: list_sort([
        {'cost': r.v[q].cost + 3, 'audit': 'D' || r.v[q].audit, 'lines': r.v[q].lines},
        {'cost': CASE WHEN j.is_blank OR j.is_dup THEN 1000000000 ELSE r.v[[3, 3, 4, 3][q]].cost + 2 + CAST(j.is_open AS INTEGER) END,
         'audit': 'R' || r.v[[3, 3, 4, 3][q]].audit,
         'lines': chr(10) || ['user:', 'user:', 'assistant:', 'user:'][q] || j.text || r.v[[3, 3, 4, 3][q]].lines},
        {'cost': CASE WHEN j.is_blank OR j.is_dup OR NOT list_contains([['s', 'u'], ['u'], ['a'], ['u']][q], j.initial) THEN 1000000000
          ELSE r.v[CASE WHEN j.initial = 's' THEN 2 ELSE [3, 3, 4, 3][q] END].cost + CAST(j.is_open AS INTEGER) END,
         'audit': 'K' || r.v[CASE WHEN j.initial = 's' THEN 2 ELSE [3, 3, 4, 3][q] END].audit,
         'lines': chr(10) || j.role || ':' || j.text || r.v[CASE WHEN j.initial = 's' THEN 2 ELSE [3, 3, 4, 3][q] END].lines}])[1]) AS b
      FROM best r JOIN judged j ON j.conv_id IS NOT DISTINCT FROM r.conv_id AND j.i = r.i))
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.v[1].cost, 0) AS BIGINT) AS cost,
  coalesce(b.v[1].audit, '') AS audit, sha256(coalesce(b.v[1].lines[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 0
"""
