"""Conversation repair against plain dynamic programming and a plain version of the query."""

import hashlib
import itertools
import random
import re
import zlib

from hypothesis import given, settings, strategies as st

from caselens.llm import op13_conversation_repair as op

INK = re.compile(r"[^\x20\x09-\x0d]")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies int, gone string, digest int, fault string, way int, is_row int, audit int"


def plain_edits(rows):
    """Cheapest (cost, audit) by going through the rows with the best edits of each state."""
    roles = {0: "", 1: "s", 2: "u", 3: "a"}
    follows = {"s": {0}, "u": {0, 1, 3}, "a": {2}}
    state_of = {v: k for k, v in roles.items()}

    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                new = state_of["a" if q == 2 else "u"]
                best[new] = min(best.get(new, (cost + 5, audit + "I")), (cost + 5, audit + "I"))
        return best

    best = {0: (0, "")}
    for initial, fault in rows:
        after = {}
        for q, (cost, audit) in inserted(best).items():
            ways = [(2, "D", q)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if initial in follows and q in follows[initial]:
                    ways.append((extra, "K", state_of[initial]))
                ways += [(extra + 1, "R", state_of[r]) for r in "ua" if q in follows[r]]
            for step, letter, to in ways:
                found = (cost + step, audit + letter)
                after[to] = min(after.get(to, found), found)
        best = after
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


FAULTS = ["", "truncated", "blank", "duplicate"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaax"), st.sampled_from(range(4))), max_size=14), st.sampled_from([1, 2, 5, 4096]))
def test_edits_are_the_cheapest_and_least(rows, chunk):
    repair = op.Repair(chunk)
    for row in rows:
        repair.add(row)
    assert repair.finish() == plain_edits([(i, FAULTS[f]) for i, f in rows])


def test_a_long_conversation_in_pieces():
    rng = random.Random(4)
    rows = [(rng.choice("uaua s".replace(" ", "x")), rng.choice([0] * 8 + [1, 2, 3])) for _ in range(3000)]
    found = []
    for chunk in (7, 500, 4096):
        repair = op.Repair(chunk)
        for row in rows:
            repair.add(row)
        found.append(repair.finish())
    assert found == [plain_edits([(i, FAULTS[f]) for i, f in rows])] * 3


def test_both_heaps_are_used():
    """The middle of the lattice is met from both sides: neither settles nearly all points."""
    lattice = op.Lattice([("u", 0), ("u", 0)] * 200)
    visited = []
    ahead, behind = lattice.ahead, lattice.behind
    lattice.ahead = lambda p: visited.append("f") or ahead(p)
    lattice.behind = lambda p: visited.append("b") or behind(p)
    assert lattice.cheapest(0, (0, 3)) == plain_edits([("u", "")] * 400)
    assert min(visited.count("f"), visited.count("b")) > 200


def plain(rows, damage=True):
    """The whole query in plain Python; rows are (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        way = zlib.crc32(key.encode()) % 20 if damage else 9
        kept = out.setdefault(conv, [])
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        kept += [(turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    found = []
    for conv, kept in out.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            ink = INK.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [role[:1] if role[:1] in ("s", "u", "a") else "x" for _, role, _ in kept]
        cost, audit = plain_edits(list(zip(initials, faults)))
        lines, left = [], iter(kept)
        for edit in audit:
            expected = "assistant" if lines and lines[-1][:1] == "u" else "user"
            if edit == "I":
                lines.append(f"{expected}:")
                continue
            _, role, text = next(left)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else expected}:{text}")
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        found.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def odd_rows():
    rng = random.Random(8)
    texts = ["Fine.", "cut off", "", " \t\n\x0b\x0c\r ", None, "Ends with space! \n", "Émile ça va?", "x" * 300_000 + ".", "?", " "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown", "User"]
    rows = []
    for conv in range(120):
        turns = range(rng.randint(1, 12))
        rows += [(conv, t if rng.random() < 0.9 else t + 5, rng.choice(roles), rng.choice(texts)) for t in turns]
    rows += [(None, None, "user", "Fine."), (None, 3, None, None), (None, None, "assistant", "Fine.")]
    rows += [(500, None, None, None), (501, None, "user", "a."), (501, None, "user", "a."), (501, None, "assistant", "b.")]
    rows += [(502, 1, "user", "Same.")] * 300 + [(502, 2, "assistant", "Other.")]  # a third of the rows alike
    return rows + rows[:5]


def test_damage_and_repair_equal_the_plain_version(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "g", 2, "f", 3, 4, 5) for r in rows], SCHEMA).repartition(3)
    got = op.repair(op.damaged(df), chunk=3).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(rows)
    got = op.repair(op.whole(df)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(rows, damage=False)


def test_all_rows_of_a_conversation_dropped_and_no_rows(spark):
    dropped = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    df = spark.createDataFrame([(c, 0, "user", "Hi.") for c in dropped], "conv_id bigint, turn bigint, role string, text string")
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, op.repair(op.damaged(df)).collect())) == [(c, 0, 0, 0, 0, 0, 0, "", nothing) for c in dropped]
    assert op.repair(op.damaged(df.limit(0))).collect() == []


def test_repaired_conversations_need_no_repair(spark):
    df = spark.createDataFrame([(*r, 1, "g", 2, "f", 3, 4, 5) for r in odd_rows()], SCHEMA)
    for row in op.audits(op.damaged(df)).collect():
        kept = [c for c in row.audit if c != "D"]
        assert len(kept) == 0 or len(kept) >= 2
