import hashlib
import random
import re
import zlib

import pytest

from trackloom.llm import conversation_repair as m

ROWS = "conv_id long, turn long, role string, text string, part int, digest string, late string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], ROWS).repartition(3)


def damaged(rows):
    out, ids = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return ids, out


STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit, repaired turns) by plain recursion over suffixes; rows are (role, text, forced, truncated)."""
    after = {q: ({0: (0, "", ()), 3: (0, "", ())}.get(q)) for q in range(4)}

    def inserted(options):
        for _ in range(3):
            for q in range(4):
                to = 3 if q == 2 else 2
                if options[to] is not None:
                    c, a, r = options[to]
                    new = (c + 2, "I" + a, (("assistant" if q == 2 else "user", ""), *r))
                    options[q] = new if options[q] is None else min(options[q], new)
        return options

    after = inserted(after)
    for role, text, forced, truncated in reversed(rows):
        here = {}
        for q in range(4):
            c, a, r = after[q]
            options = [(c + 3, "D" + a, r)]
            to = STEPS.get((q, role[:1]))
            if not forced and to is not None:
                c, a, r = after[to]
                options.append((c + truncated, "K" + a, ((role, text), *r)))
            if not forced:
                c, a, r = after[3 if q == 2 else 2]
                options.append((c + 2 + truncated, "R" + a, (("assistant" if q == 2 else "user", text), *r)))
            here[q] = min(options)
        after = inserted(here)
    return after[0]


def slow(ids, rows):
    out = []
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, counts, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, kept = cheapest(marked)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def cases(n=60, long=150):
    rnd = random.Random(5)
    texts = ["Hello.", "So?", "cut off", "", " \t\n", "é!", "ok.", "x" * 3000 + ".", "tail. \n"]
    texts += [f"number {i}." for i in range(30)] + [f"open {i}" for i in range(10)]
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
    rows = []
    for conv in range(n):
        size = rnd.randrange(1, 9) if conv % 15 else long
        proper = rnd.random() < 0.5
        for i in range(size):
            turn = None if rnd.random() < 0.05 else i + (rnd.random() < 0.1) * rnd.randrange(4)
            rows.append((conv, turn, ["user", "assistant"][i % 2] if proper else role(), rnd.choice([*texts, None])))
    rows += [(None, i, "user", "a.") for i in range(4)] + [(500, None, "system", "Be kind.")] * 3 + [(501, 2, "user", "one."), (501, 2, "assistant", "two.")]
    return rows + rows[5:9]


@pytest.mark.parametrize("block", [64, 1, 7])
def test_equals_plain_recursion(spark, block):
    rows = cases()
    got = m.report(m.damage(table(spark, rows)), block)
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow(*damaged(rows))


def test_pieces_hold_the_repaired_turns(spark):
    rows = [r for r in cases() if r[0] is not None]
    wanted = {r[0]: r for r in slow({r[0] for r in rows}, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])}
    pieces = m.repair(table(spark, rows)).cache()
    found = {}
    for r in sorted(m.turns(pieces).collect(), key=lambda r: (r["conv_id"], r["part"], r["no"], r["place"])):
        found.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    audits = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["part"], r["no"])):
        audits[r["conv_id"]] = audits.get(r["conv_id"], "") + r["audit"]
    for conv, want in wanted.items():
        assert audits[conv] == want[7]
        assert hashlib.sha256("\n".join(found.get(conv, [])).encode()).hexdigest() == want[8]


def test_one_conversation_of_most_rows_is_cut(spark):
    rnd = random.Random(2)
    rows = [(1, i, rnd.choice(["user", "assistant"]), f"{i}.") for i in range(600)] + [(i, 0, "user", "a.") for i in range(2, 40)] + [(1, 601, "user", "same.")] * 500
    pieces = m.repair(table(spark, rows), 16).where("conv_id = 1").collect()
    assert len({p["part"] for p in pieces}) > 1
    assert max(len(p["texts"]) for p in pieces) <= 3 * 16 + 2
    ids = {r[0] for r in rows}
    assert sorted((tuple(r) for r in m.report(table(spark, rows), 16).collect()), key=str) == slow(ids, rows)


def test_prices_are_costs_along_tight_arcs():
    rnd = random.Random(1)
    for _ in range(300):
        codes = bytes(rnd.randrange(m.GONE + 1) for _ in range(rnd.randrange(12)))
        lattice = m.Lattice(codes, m.END)
        state = rnd.randrange(4)
        cost = lattice.auction(state)
        assert all(lattice.prices[i] <= c + lattice.prices[to] for i, arcs in enumerate(lattice.arcs) for c, to, _ in arcs)
        least = [m.FAR] * lattice.end + [0]
        for _ in range(3):
            for i in range(4 * len(codes) + 3, -1, -1):
                least[i] = min(c + least[to] for c, to, _ in lattice.arcs[i])
        assert cost == least[state] == m.solve(codes, m.END, state)[0]
        table = m.costs(codes)
        assert min(table[state][q] + m.END[q] for q in range(4)) == cost


def test_empty_and_dropped(spark):
    assert m.report(table(spark, [])).collect() == []
    gone = m.damage(table(spark, [(c, t, "user", "a.") for c in range(40) for t in range(1)]))
    got = {r["conv_id"]: r for r in m.report(gone).collect()}
    dropped = [c for c in range(40) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert len(got) == 40
    assert dropped
    for c in dropped:
        assert tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
