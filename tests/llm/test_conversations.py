"""Chat formatting and conversation repair against plain versions, and their odd cases."""

import hashlib
import random
import re
from itertools import groupby

import pytest

from skysense.llm import chat_format, conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_repair(letters):
    """(cost, audit) by dynamic programming over whole strings: no bounds, no tables of prefixes."""
    after = {0: "u", 1: "u", 2: "a", 3: "u"}
    state = {"s": 1, "u": 2, "a": 3}
    best = {0: (0, "")}

    def inserts(best):
        for _ in range(2):
            for s, (c, a) in list(best.items()):
                t = state[after[s]]
                best[t] = min(best.get(t, (10**9, "")), (c + 5, a + "I"))
        return best

    best = inserts(best)
    for x in letters:
        new = {}

        def put(s, c, a, new=new):
            new[s] = min(new.get(s, (10**9, "")), (c, a))

        for s, (c, a) in best.items():
            put(s, c + 2, a + "D")
            if x == "-":
                continue
            extra, own = 5 * x.isupper(), x.lower()
            if own == after[s] or (own == "s" and s == 0):
                put(state[own], c + extra, a + "K")
            put(state[after[s]], c + 1 + extra, a + "R")
        best = inserts(new)
    return min(best[s] for s in (0, 3) if s in best)


def every_audit(letters):
    """All audits with few insertions, tried one by one."""
    found = []

    def go(i, seq, audit, cost):
        if audit.count("I") > 2:
            return
        if i == len(letters) and re.fullmatch(r"(s?(ua)+)?", seq):
            found.append((cost, audit))
        for r in "ua":
            go(i, seq + r, audit + "I", cost + 5)
        if i < len(letters):
            x = letters[i]
            go(i + 1, seq, audit + "D", cost + 2)
            if x != "-":
                extra = 5 * x.isupper()
                go(i + 1, seq + x.lower(), audit + "K", cost + extra)
                for r in "ua":
                    go(i + 1, seq + r, audit + "R", cost + 1 + extra)

    go(0, "", "", 0)
    return min(found)


def test_search_against_every_audit():
    rng = random.Random(3)
    for n in range(5):
        for _ in range(25):
            letters = "".join(rng.choices("suaoSUAO-", k=n))
            assert conversation_repair.search(letters)[:2] == every_audit(letters) == plain_repair(letters)


@pytest.mark.parametrize("weights", [(1, 5, 5, 1, 0, 1, 1, 0, 1), (1,) * 9, (0, 9, 1, 0, 0, 0, 0, 0, 0), (0, 1, 9, 0, 0, 3, 3, 0, 0)])
def test_search_against_plain(weights):
    rng = random.Random(repr(weights))
    for n in [*range(40)] * 3 + [300]:
        letters = "".join(rng.choices("suaoSUAO-", weights, k=n))
        assert conversation_repair.search(letters)[:2] == plain_repair(letters), letters


def test_search_stays_linear_on_long_conversations():
    """Prefixes looked at per turn don't grow with the length."""
    rng = random.Random(1)
    for weights in [(1, 40, 40, 2, 0, 3, 3, 0, 5), (0, 1, 1, 0, 0, 0, 0, 0, 0), (0, 50, 1, 0, 0, 0, 0, 0, 0)]:
        letters = "".join(rng.choices("suaoSUAO-", weights, k=20_000))
        looked = conversation_repair.search(letters)[2]
        assert looked <= 20 * len(letters)


def plain_faults(rows):
    """Faults of one conversation as they are stated."""
    seen, letters, counts = set(), "", [0, 0, 0]
    for _, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not body:
            counts[0] += 1
            letter = "-"
        elif (role, text) in seen:
            counts[1] += 1
            letter = "-"
        elif body[-1] not in ".!?":
            counts[2] += 1
            letter = letter.upper()
        seen.add((role, text))
        letters += letter
    return letters, counts


def test_repair_of_odd_rows(spark):
    talks = {
        1: [(0, "system", "Be kind."), (1, "user", "Hi."), (2, "assistant", "Yes!")],
        2: [(None, "user", "first?"), (3, "assistant", "cut off"), (3, "user", "first?"), (9, None, "x.")],
        3: [(5, "user", None), (6, "user", " \t\r\n")],
        4: [(0, "assistant", "a."), (0, "assistant", "b."), (0, "user", "c.\u00a0"), (0, "", "d.")],
        5: [(None, "assistant", "only."), (None, "user", "nulls.")],
        6: [(0, "usage", "role by initial."), (1, "assistant", "yes." + " " * 50_000), (2, "user", "x" * 300_000 + ".")],
        None: [(1, "user", "no conversation."), (2, "assistant", "none.")],
    }
    rows = [(c, t, r, x, "extra", "t") for c, ts in talks.items() for t, r, x in ts]
    turns = spark.createDataFrame(rows, SCHEMA + ", turns string, `t` string")
    got = {r.conv_id: r for r in conversation_repair.repair(turns).collect()}
    assert set(got) == set(talks)
    for c, ts in talks.items():
        if c == 4:  # a tie in the turn goes by role, then by hash
            ts = [ts[3], *sorted(ts[:2], key=lambda t: hashlib.sha256(f"9\nassistant\n{t[2]}".encode()).digest()), ts[2]]
        letters, counts = plain_faults(ts)
        cost, audit = plain_repair(letters)
        assert (got[c].audit, got[c].cost, [got[c].blank, got[c].duplicate, got[c].truncated]) == (audit, cost, counts), c
        said = [t.role[:1] for t in got[c].repaired]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(said))
        initials = [(" " if r is None else r)[:1] for _, r, _ in ts]
        assert got[c].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert (got[2].gaps, got[5].gaps, got[4].gaps) == (5, 0, 0)
    assert [tuple(t) for t in got[1].repaired] == [t[1:] for t in talks[1]]
    assert conversation_repair.repair(turns.limit(0)).count() == 0


def test_repair_digest_keeps_conversations_without_turns(spark):
    turns = spark.createDataFrame([(c, t, "user", "Hello.") for c in range(40) for t in range(1)], SCHEMA)
    left = conversation_repair.damaged(turns)
    got = {r.conv_id: r for r in conversation_repair.digest(turns, conversation_repair.repair(left)).collect()}
    lost = set(range(40)) - {r.conv_id for r in left.select("conv_id").distinct().collect()}
    assert set(got) == set(range(40)) and lost
    for c in lost:
        assert (got[c].cost, got[c].audit, got[c].gaps, got[c].repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest())


def talk(rows):
    """The formatted text by the template as it is stated."""
    rows = sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
    esc = lambda x: x.replace("\\", "\\\\").replace("### ", "#\\## ").replace("</turn>", "<\\/turn>")
    text, learnt = "", ""
    for role, turns in groupby(rows, key=lambda t: t[1] or ""):
        text += "### " + esc(role).replace(": ", ":\\ ") + ": "
        for _, _, x in turns:
            text += esc(x or "") + "</turn>"
            learnt += (x or "") if role == "assistant" else ""
    return text, learnt, [(r or "", x or "") for _, r, x in rows]


HARD = ["", None, "\\", "\\\\", "</turn>", "</turn", "<</turn></turn>", "#### ### ", "\\</turn>", "<\\/turn>", "#\\## x", "\U0001f600é\\",
        "### user: hi</turn>", "a\nb\\n", ": ", "x" * 100_000 + "</turn>" * 50]


def test_formatting_of_odd_rows(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    roles = ["user", "assistant", "system", None, "", "to: ol", "### x: y\\", "a</turn>:"]
    talks = {c: [(rng.choice([None, 1, 2, 3, 4]), rng.choice(roles[: 3 if c % 2 else 8]), rng.choice(HARD)) for _ in range(rng.randint(1, 12))] for c in range(60)}
    talks[None] = [(1, "user", "no id"), (1, "user", "no id"), (2, "assistant", "same")]
    talks[99] = [(i, "assistant" if i // 300 % 2 else "user", f"t{i}\\") for i in range(1400)]  # several folds, blocks across them
    rows = [(c, *t, "x", 1) for c, ts in talks.items() for t in ts]
    turns = spark.createDataFrame(rows, SCHEMA + ", loss string, head int")
    made = chat_format.formatted(turns)
    got = {r.conv_id: r for r in made.select("*", chat_format.read_turns(F.col("text")).alias("back"),
                                             chat_format.masked(F.col("text"), F.col("loss")).alias("learnt")).collect()}
    assert set(got) == set(talks)
    for c, ts in talks.items():
        text, learnt, said = talk(ts)
        r = got[c]
        assert (r.text, r.learnt, [tuple(t) for t in r.back]) == (text, learnt, said), c
        assert all(a.stop <= b.start for a, b in zip(r.loss, r.loss[1:]))
    assert chat_format.formatted(turns.limit(0)).count() == 0


def test_hostile_conversation_is_read_back(spark):
    none = spark.createDataFrame([], SCHEMA)
    (r,) = chat_format.digest(chat_format.formatted(chat_format.with_hostile(none))).collect()
    said = "".join(f"{role}\n{chat_format.HOSTILE}\n" for role in ("user", "assistant"))
    assert (r.conv_id, r.n_turns, r.turns_sha256) == (-7, 2, hashlib.sha256(said.encode()).hexdigest())
    assert (r.loss_chars, r.loss_sha256) == (len(chat_format.HOSTILE), hashlib.sha256(chat_format.HOSTILE.encode()).hexdigest())


def test_formatting_runs_no_python(spark, sf):
    turns = chat_format.with_hostile(spark.read.parquet(f"{sf}/conversations.parquet"))
    plan = chat_format.digest(chat_format.formatted(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
