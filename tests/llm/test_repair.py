"""Operator 13 against a search over all edits, on single blocks, on conversations of many blocks and on damaged rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from isohyet.llm import repair

TURNS = "conv_id long, turn long, role string, text string, fault string, gone string, digest string, audit string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], TURNS)


def every(turns, longest):
    """All (cost, audit, initials) of editing the turns, with at most `longest` roles left."""
    out = [(0, "", "")]
    for t in turns:
        out = [x for o in out for x in inserted(o, longest)]
        late, own = t.isupper(), t.lower()
        step = [(c + 3, a + "D", s) for c, a, s in out]
        if t != "x":
            step += [(c + late, a + "K", s + own) for c, a, s in out]
            step += [(c + 2 + late, a + "R", s + x) for c, a, s in out for x in "ua"]
        out = [x for x in step if len(x[2]) <= longest]
    return [x for o in out for x in inserted(o, longest)]


def inserted(way, longest):
    c, a, s = way
    yield way
    if len(s) < longest:
        for x in "ua":
            yield from inserted((c + 2, a + "I", s + x), longest)


@pytest.mark.parametrize("seed", range(120))
def test_alignment_equals_all_edits(seed):
    r = random.Random(seed)
    turns = "".join(r.choice("sSuUaAoxuaua") for _ in range(r.randrange(5)))
    want = min((c, a) for c, a, s in every(turns, len(turns) + 2) if GRAMMAR.match(s))
    found = repair.repairs(turns, repair.NOTHING)
    assert min(found[e] for e in (repair.NOTHING, repair.AFTER_A) if e in found) == want


# --- a second way for long conversations: states of the grammar, one turn at a time -------------

INSERTS = {0: [(0, 0, ""), (2, 2, "I"), (3, 4, "II")], 1: [(1, 0, ""), (2, 2, "I"), (3, 4, "II")], 2: [(2, 0, ""), (3, 2, "I")], 3: [(3, 0, ""), (2, 2, "I")]}
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def automaton(rows):
    """(cost, audit, repaired turns) of rows (role, text, fault)."""
    live = {0: (0, "", ())}
    for role, text, fault in rows:
        now = defaultdict(list)
        for state, (cost, audit, said) in live.items():
            for mid, more, edits in INSERTS[state]:
                c, a, s, at = cost + more, audit + edits, said, state
                for _ in edits:
                    at = {0: 2, 1: 2, 3: 2, 2: 3}[at]
                    s += (("user" if at == 2 else "assistant") + ":",)
                now[mid].append((c + 3, a + "D", s))
                if fault not in ("blank", "duplicate"):
                    late = fault == "truncated"
                    if (mid, role[:1]) in MOVES:
                        now[MOVES[mid, role[:1]]].append((c + late, a + "K", (*s, f"{role}:{text}")))
                    q = {0: 2, 1: 2, 3: 2, 2: 3}[mid]
                    now[q].append((c + late + 2, a + "R", (*s, f"{'user' if q == 2 else 'assistant'}:{text}")))
        live = {q: min(x) for q, x in now.items()}
    ends = []
    for state, (cost, audit, said) in live.items():
        for mid, more, edits in INSERTS[state]:
            if mid in (0, 3):
                s, at = said, state
                for _ in edits:
                    at = {0: 2, 1: 2, 3: 2, 2: 3}[at]
                    s += (("user" if at == 2 else "assistant") + ":",)
                ends.append((cost + more, audit + edits, s))
    return min(ends)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        seen, marked = set(), []
        for _, _, role, text in mine:
            plain = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, said = automaton(marked)
        turns = [x[1] for x in mine if x[1] is not None]
        count = lambda f: sum(x[2] == f for x in marked)  # noqa: B023, E731
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        sha = hashlib.sha256("\n".join(said).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha), said
    return out


def cases(seed):
    r = random.Random(seed)
    text = lambda: r.choice(["Yes.", "No!", "cut", " \n", "", None, "ok.", f"word {r.randrange(1000)}.", f"more {r.randrange(1000)}? ", "x" * 5000 + "."])
    role = lambda i: r.choice(["user", "assistant"][i % 2 : i % 2 + 1] * 12 + ["system", "tool", "", None, "user", "assistant"])
    rows = []
    for conv in [*range(60), None, -5]:
        n = r.randrange(12)
        rows += [(conv, i + r.choice([0, 0, 0, 1]), "system" if i == 0 and n % 3 == 0 else role(i), text()) for i in range(n)]
    rows += [(900, i, role(i), text()) for i in range(400)]
    rows += [(901, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(300)]
    rows += [(902, i, "system", f"turn {i}") for i in range(200)]
    rows += [(903, i, "user", " ") for i in range(150)] + [(903, 150, "system", "late."), (903, 151, "assistant", "a.")]
    rows += [(904, None, "user", "no turn."), (904, None, "assistant", "none."), (905, 7, "user", "Hi."), (905, 7, "user", "Hi.")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_results_equal_the_automaton(spark, seed):
    rows = cases(seed)
    want = {k: v[0] for k, v in brute(rows, damaged(rows)).items()}
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.structure_repair(frame(spark, rows)).collect()}
    assert got == want


def test_repaired_turns_follow_the_audit(spark):
    rows = [x for x in cases(3) if x[2] is not None]
    plain = [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in rows]
    said = defaultdict(list)
    for r in repair.repaired(frame(spark, rows)).orderBy("conv_id", "place").collect():
        assert r["place"] == len(said[r["conv_id"]])
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    want = {k: list(v[1]) for k, v in brute(plain, plain).items() if v[1]}
    assert dict(said) == want
    for turns in said.values():
        assert GRAMMAR.match("".join(t[0] for t in turns))


def test_empty_table(spark):
    assert repair.structure_repair(frame(spark, [(1, 1, "user", "x")]).filter("false")).count() == 0
