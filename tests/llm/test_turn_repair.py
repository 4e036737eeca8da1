"""Repair of conversations against an exhaustive search, and long conversations in blocks against short ones."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomtext.llm import turn_repair as tr

COLUMNS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "clean" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def searched(rows):
    """Least (cost, audit, repaired) over all edits with at most two inserted turns."""
    faults = faults_of(rows)
    choices = []
    for (role, text), fault in zip(rows, faults, strict=True):
        own = [("D", 2, None)]
        if fault in ("clean", "truncated"):
            more = 5 * (fault == "truncated")
            own += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        choices.append(own)
    best = None
    for picked in itertools.product(*choices):
        for n in range(3):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for roles in itertools.product(("user", "assistant"), repeat=n):
                    steps = []
                    for i in range(len(rows) + 1):
                        steps += [("I", 5, (r, "")) for p, r in zip(places, roles, strict=True) if p == i]
                        steps += picked[i : i + 1]
                    said = [s[2] for s in steps if s[2]]
                    if GRAMMAR.fullmatch("".join(r[:1] or "?" for r, _ in said)):
                        found = (sum(s[1] for s in steps), "".join(s[0] for s in steps), "\n".join(f"{r}:{t}" for r, t in said))
                        best = found if best is None or found[:2] < best[:2] else best
    return best


def by_hand(rows):
    """The report's row, from rows in order."""
    turns = sorted({t for t, _, _ in rows if t is not None})
    said = [(r, x) for _, r, x in rows]
    faults = faults_of(said)
    cost, audit, repaired = searched(said)
    odd = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(said))
    return (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), odd, cost, audit, hashlib.sha256(repaired.encode()).hexdigest())


def damaged(rows):
    out = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        r = "user" if code == 4 else r
        out.setdefault(c, []).extend([(t, r, x)] * (0 if code == 0 else 2 if code == 3 else 1))
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, v in out.items()}


def conversations():
    roles, texts = ["user", "assistant", "system", "tool", "", None, "unknown"], ["Hi there.", "cut off", "", " \t ", "ok!", None, "What?\n", "ü 😀"]
    rows = []
    for c in range(200):
        for t in range(1 + c % 4):
            h = zlib.crc32(f"{c}/{t}".encode())
            rows.append((c, t + (h % 3 == 0), roles[h % 7 if c % 3 == 0 else t % 2], texts[h // 7 % 8 if c % 2 else 0] if c % 5 else f"text {t}."))
    rows += [(None, 0, "user", "no id."), (None, None, "assistant", "no turn."), (7001, None, "user", "a."), (7001, None, "user", "a."), (7002, 3, "system", "s.")]
    rows += [(8000 + i, i % 3, "user", "x.") for i in range(60)]  # among them some that lose their only row
    return rows


def test_reports_against_search(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, COLUMNS).withColumns({"edit": F.lit(1), "conv": F.lit("mine"), "said": F.lit(2)}).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in tr.report(df, tr.repair(tr.damage(df))).collect()}
    want = {c: by_hand(v) if v else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c, v in damaged(rows).items()}
    assert got == want and any(not v for v in damaged(rows).values())
    assert tr.report(df.limit(0), tr.repair(df.limit(0))).count() == 0


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_long_conversations_in_blocks(spark, block):
    rows = [(c, t // 2, ["user", "assistant", "system", "tool"][zlib.crc32(f"{c} {t} {block}".encode()) % 4], ["a.", "b", "", f"{t}.", f"{t}?"][zlib.crc32(f"{t} {c}".encode()) % 5]) for c in (1, 2, None) for t in range(60)]
    rows += [(4, t, "user", "same.") for t in range(40)] + [(5, 0, "user", "short."), (6, 0, "user", "x" * 5000), (6, 1, "assistant", "y.")]
    df = spark.createDataFrame(rows, COLUMNS)
    want = sorted(map(str, tr.digest(tr.repair(df)).collect()))
    assert sorted(map(str, tr.digest(tr.repair(df, most_turns=5, most_bytes=4000, block=block)).collect())) == want
    edits = tr.repair(df, most_turns=5, most_bytes=4000, block=block).where("edit <> 'I'")
    assert edits.count() == len(rows) and edits.where("(role is null) <> (edit = 'D')").count() == 0


def test_inserted_turns_where_they_are_cheap():
    c = tr.Costs(rerole=9, delete=9, insert=1)
    assert tr.plan([(tr.ASSISTANT, tr.CLEAN)], c) == [["Iu", "K"]]
    assert tr.plan([(tr.SYSTEM, tr.CLEAN), (tr.USER, tr.CLEAN)], c) == [["K"], ["K", "Ia"]]
    assert tr.plan([(tr.SYSTEM, tr.CLEAN)], c) == [["K", "Iu", "Ia"]]
