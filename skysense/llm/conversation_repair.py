"""Repair of conversations whose turns are missing, blank, repeated, cut off or out of order.

A conversation is one row with its turns as an array; Spark collects and sorts them and
applies the edits with expressions. What the search needs of a turn is a single letter: the
role's initial and its first fault. The search is depth-first branch-and-bound with an
explicit stack: the bound of a suffix is the least cost of finishing it with the rules
on system turns loosened, the incumbent is the best pair of (cost, audit) so far, and each node (turn,
role before it) has a table entry with the best prefix that reached it; worse prefixes are
dropped. It ends when the stack is empty, which proves the incumbent.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Costs of the edits, and of a cut-off turn that stays.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
CUT_STAYS = 5
#: What may follow what: nothing yet, a system turn, a user's, an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an inserted or renamed turn has after each of these.
WANTED = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (NONE, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The letter of a turn that must go; a cut-off turn has its initial as a capital.
GONE, OTHER = "-", "o"
#: Conversations with the same letters have the same edits; so many are remembered per worker.
REMEMBERED = 50_000

SPACE = r"[\x20\x09-\x0D]"


def moves(letter: str, before: int) -> list[tuple[int, str, int]]:
    """(cost, edit, role after it) of everything that can be done with the next turn."""
    found = [(COST["D"], "D", before)]
    if letter != GONE:
        extra = CUT_STAYS if letter.isupper() else 0
        own, wanted = INITIALS.get(letter.lower()), WANTED[before]
        if own == wanted or (own == SYSTEM and before == NONE):
            found.append((COST["K"] + extra, "K", own))
        if own != wanted:
            found.append((COST["R"] + extra, "R", wanted))
    return found


def suffix_bounds(letters: str) -> list[tuple[int, int, int, int]]:
    """Lower bounds of the cost of turns ``i`` and later, per role before them.

    A system turn and an assistant's are taken as one, because both want a user's turn next;
    that lets a conversation end after its system turn, so the bound can be too low there.
    """
    ahead = [0, 0, COST["I"], 0]
    bounds = [tuple(ahead)]
    for letter in reversed(letters):
        now = [min(c + ahead[after] for c, _, after in moves(letter, s)) for s in range(4)]
        now[SYSTEM] = now[ASSISTANT] = min(now[SYSTEM], now[ASSISTANT])
        # Two insertions reach every state that insertions reach.
        for _ in range(2):
            now = [min(now[s], COST["I"] + now[WANTED[s]]) for s in range(4)]
        ahead = now
        bounds.append(tuple(now))
    return bounds[::-1]


#: A prefix of an audit: (the prefix before, its last edit, its length, the turn it deals with).
Prefix = tuple


def letters_of(prefix: Prefix | None, other: Prefix | None) -> tuple[str, str]:
    """Both prefixes from where they part."""
    a, b = [], []
    while prefix is not other:
        if other is None or (prefix is not None and prefix[2] >= other[2]):
            a.append(prefix[1])
            prefix = prefix[0]
        else:
            b.append(other[1])
            other = other[0]
    return "".join(reversed(a)), "".join(reversed(b))


def search(letters: str) -> tuple[int, str, int]:
    """Least cost, its least audit in ASCII order, and the number of prefixes looked at."""
    bounds, n = suffix_bounds(letters), len(letters)
    best: tuple[int, Prefix | None] | None = None
    reached: dict[tuple[int, int], tuple[int, Prefix | None]] = {}
    stack: list[tuple[int, int, int, Prefix | None]] = [(0, 0, NONE, None)]
    looked = 0

    def beats(cost: int, prefix: Prefix | None, rival: tuple[int, Prefix | None] | None) -> bool:
        if rival is None or cost != rival[0]:
            return rival is None or cost < rival[0]
        mine, theirs = letters_of(prefix, rival[1])
        return mine < theirs

    while stack:
        cost, i, before, prefix = stack.pop()
        if best is not None and cost + bounds[i][before] > best[0]:
            continue
        if not beats(cost, prefix, reached.get((i, before))):
            continue
        reached[i, before] = (cost, prefix)
        looked += 1
        if i == n and before in ENDS and beats(cost, prefix, best):
            best = (cost, prefix)
        steps = [(c, e, after, i + 1) for c, e, after in moves(letters[i], before)] if i < n else []
        steps.append((COST["I"], "I", WANTED[before], i))
        # The most promising one is taken up first, and of equals the least edit.
        steps.sort(key=lambda s: (s[0] + bounds[s[3]][s[2]], s[1]), reverse=True)
        size = prefix[2] if prefix else 0
        stack.extend((cost + c, j, after, (prefix, e, size + 1)) for c, e, after, j in steps)
    cost, prefix = best
    return cost, letters_of(prefix, None)[0], looked


def follow(letters: str, audit: str) -> list[tuple[int | None, str | None]]:
    """The repaired conversation: per turn the place it comes from and its new role, if any."""
    turns, i, before = [], 0, NONE
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            before = INITIALS[letters[i].lower()]
            turns.append((i, None))
        else:
            before = WANTED[before]
            turns.append((i if edit == "R" else None, NAMES[before]))
        i += edit != "I"
    return turns


@lru_cache(REMEMBERED)
def plan(letters: str) -> dict:
    cost, audit, _ = search(letters)
    return {"cost": cost, "audit": audit, "turns": [{"place": p, "role": r} for p, r in follow(letters, audit)]}


PLAN = T.StructType([
    T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()), T.StructField("truncated", T.LongType()),
    T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
    T.StructField("turns", T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("role", T.StringType())])))])


def conversation_letters(marks: list[dict]) -> tuple[str, int, int, int]:
    """One letter per turn, and how many turns have each fault first."""
    seen: set[bytes] = set()
    letters, blank, duplicate, truncated = [], 0, 0, 0
    for m in marks:
        letter = m["initial"] if m["initial"] in INITIALS else OTHER
        if m["blank"]:
            blank += 1
            letter = GONE
        elif m["same"] in seen:
            duplicate += 1
            letter = GONE
        elif m["cut"]:
            truncated += 1
            letter = letter.upper()
        seen.add(m["same"])
        letters.append(letter)
    return "".join(letters), blank, duplicate, truncated


@F.arrow_udf(PLAN)
def plans(marks: pa.Array) -> pa.Array:
    found = []
    for m in marks:
        letters, blank, duplicate, truncated = conversation_letters(m.as_py())
        found.append({"blank": blank, "duplicate": duplicate, "truncated": truncated, **plan(letters)})
    fields = [("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("cost", pa.int64()),
              ("audit", pa.string()), ("turns", pa.list_(pa.struct([("place", pa.int32()), ("role", pa.string())])))]
    return pa.array(found, pa.struct(fields))


def _text(name: str, null: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(null))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``gaps``, counts of faults, ``cost``, ``audit``, ``repaired`` (role, text).

    Turns are ordered by ``turn`` (NULL first), then role and a hash of the text, so that
    ties have one order. NULL roles and texts count as one space: no role of the pattern,
    and blank. A NULL conversation is one of its own. Other columns take no part; an empty
    table gives an empty table. A conversation is one value of at most 2 GB, as Spark has
    it; the search itself gets some 50 bytes a turn.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), _text(role, " ").alias("role"), _text(text, " ").alias("text"))
    # One pattern tells the last character that isn't space; none means that the text is blank.
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){SPACE}*+\z", 1)
    marked = rows.select("conv_id", F.struct(
        "turn", "role", F.unhex(F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256)).alias("same"),
        "text", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut")).alias("t"))
    talks = marked.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"),
        F.coalesce(F.max("t.turn") - F.min("t.turn") + 1 - F.size(F.collect_set("t.turn")), F.lit(0)).cast("long").alias("gaps"))
    marks = F.transform("turns", lambda t: F.struct(
        t.initial.alias("initial"), t.blank.alias("blank"), t.cut.alias("cut"), t.same.alias("same")))
    planned = talks.select("conv_id", "gaps", "turns", plans(marks).alias("p"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("turns") - 1), lambda i: F.concat(F.get("turns", i - 1).initial, F.get("turns", i).initial))
    illegal = F.when(F.size("turns") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    repaired = F.transform("p.turns", lambda s: F.struct(
        F.coalesce(s.role, F.get("turns", s.place).role).alias("role"),
        F.coalesce(F.get("turns", s.place).text, F.lit("")).alias("text")))
    return planned.select("conv_id", "gaps", "p.blank", "p.duplicate", "p.truncated", illegal.cast("long").alias("illegal"),
                          "p.cost", "p.audit", repaired.alias("repaired"))


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with a fault in about a quarter of the rows, which one by a checksum."""
    rows = turns.select("conv_id", "turn", _text("role", " ").alias("role"), _text("text", " ").alias("text"))
    fault = F.crc32(F.concat(_text("conv_id", " "), F.lit(":"), _text("turn", " "))) % 20
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    text = (F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    return (rows.withColumn("fault", fault)
            .withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")))


def digest(original: DataFrame, repaired: DataFrame) -> DataFrame:
    """Every conversation of ``original``; those without turns after the damage have nothing to repair."""
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    done = repaired.select(F.col("conv_id").alias("__conv"), *counts, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    every = original.select("conv_id").distinct()
    joined = every.join(done, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    return joined.select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _step(letter_costs: str, state: str, edit: str) -> str:
    return f"{{'c': {state}.c + {letter_costs}, 'a': {state}.a || '{edit}'}}"


def _sql() -> str:
    """The least (cost, audit) per role state, turn by turn, in a recursive query; then its edits are followed."""
    crc = ("xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT), "
           "lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))), 4294967295)")
    ins = {s: f"CASE WHEN {s} IS NOT NULL THEN {_step('5', s, 'I')} END" for s in ("s0", "s1", "s3")}

    def fits(to: str, own: str) -> list[str]:
        froms = {"s1": ["s0"], "s2": ["s0", "s1", "s3"], "s3": ["s2"]}[to]
        found = []
        for s in froms:
            keep = f"CASE WHEN {s} IS NOT NULL AND l <> '-' AND lower(l) = '{own}' THEN {_step('e', s, 'K')} END"
            other = f"CASE WHEN {s} IS NOT NULL AND l <> '-' AND lower(l) <> '{own}' THEN {_step('e + 1', s, 'R')} END"
            found += [keep] if to == "s1" else [keep, other]
        return found

    def gone(s: str) -> str:
        return f"CASE WHEN {s} IS NOT NULL THEN {_step('2', s, 'D')} END"

    after = {s: f"list_min([{', '.join([gone(s), *fits(s, own)])}])" for s, own in (("s1", "s"), ("s2", "u"), ("s3", "a"))}
    return rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT *, {crc} % 20 AS fault FROM o),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, (SELECT unnest([1, 2]) AS copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS i, left(role, 1) AS initial,
    regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS final FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM r),
m AS (SELECT *, final = '' AS blank, final <> '' AND again AS duplicate,
    final NOT IN ('', '.', '!', '?') AND NOT again AS truncated,
    CASE WHEN final = '' OR again THEN '-' WHEN final IN ('.', '!', '?') THEN i1 ELSE upper(i1) END AS letter
  FROM (SELECT *, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS i1 FROM g)),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    string_agg(letter, '' ORDER BY i) AS letters FROM m GROUP BY conv_id),
p AS (
  SELECT conv_id, letters, 0 AS i, {{'c': 0, 'a': ''}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR) AS s1,
    {{'c': 5, 'a': 'I'}} AS s2, {{'c': 10, 'a': 'II'}} AS s3 FROM t
  UNION ALL
  SELECT conv_id, letters, i, s0, s1, s2, list_min([s3, {_step('5', 's2', 'I')}]) FROM (
    SELECT conv_id, letters, i, s0, s1, list_min([s2, {', '.join(ins.values())}]) AS s2, s3 FROM (
      SELECT conv_id, letters, i + 1 AS i, {gone('s0')} AS s0, {after['s1']} AS s1, {after['s2']} AS s2, {after['s3']} AS s3
      FROM (SELECT *, letters[i + 1] AS l, CASE WHEN letters[i + 1] = upper(letters[i + 1]) THEN 5 ELSE 0 END AS e
        FROM p WHERE i < length(letters))))),
b AS (SELECT conv_id, list_min([s0, s3]) AS best FROM p WHERE i = length(letters)),
e AS (SELECT *, count_if(edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS place FROM (
    SELECT conv_id, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS j FROM b)),
k AS (SELECT e.conv_id, e.j, e.edit, CASE WHEN e.edit = 'I' THEN '' ELSE m.text END AS text, m.role,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY e.j) AS n,
    first_value(e.edit = 'K' AND m.initial = 's') OVER (PARTITION BY e.conv_id ORDER BY e.j) AS headed
  FROM e LEFT JOIN m ON e.conv_id IS NOT DISTINCT FROM m.conv_id AND e.place = m.i WHERE e.edit IN ('K', 'R', 'I')),
x AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - headed::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || text, chr(10) ORDER BY j) AS said FROM k GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN t ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN x ON c.conv_id IS NOT DISTINCT FROM x.conv_id"""


SQL = _sql()
