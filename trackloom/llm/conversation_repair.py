"""Repair of conversations by a shortest path: which turns to keep, rerole, delete or insert.

A conversation's rows and what of the pattern ``(s?(ua)+)?`` has been read span a lattice with integer
costs. Its shortest paths are found by the auction algorithm: nodes carry prices, a path from the start
is extended along an arc whose cost is the difference of its ends' prices, or its last node's price
rises to the least offer and the path is shortened. The prices never exceed an arc's cost plus its
end's price, so once the end is reached all shortest paths, and no others, run along tight arcs, and
the path of the least letters is traced along these.

Rows are dealt out by ranges of (conversation, turn, role, text), so that also one conversation with a
third of all rows is cut into many tasks, and into blocks of a bounded size within them. Most
conversations are one block. Those of several get, block by block in all tasks at once, the costs
between the four states at a block's ends; a sweep from the last block to the first turns these into
prices at the blocks' ends, with which each block is solved for itself, and a sweep forwards picks the
state in which each begins. Both sweeps pass a conversation's blocks, a few numbers each, one at a
time; so does the digest with their texts, as a hash of one text can't be split.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded, record_batch, shuffle_partitions, table

SPACE = " \t\n\x0b\x0c\r"
#: Rows that the lattice knows (forced deletions in a row count as one), and bytes of text, of a block.
BLOCK = 64
BLOCK_BYTES = 4_000_000
INITIALS = "sua"
LEGAL = frozenset(("su", "ua", "au"))
#: States: nothing read, s, u next to an a, a. An inserted or reroled turn leads to NEXT, as NAMES says.
NEXT = (2, 2, 3, 2)
NAMES = ("user", "user", "assistant", "user")
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DELETE, INSERT, REROLE = 3, 2, 2
#: A row's code: its initial times two, plus one if truncated. GONE: rows that have to be deleted.
GONE = 2 * len(INITIALS) + 2
#: What is left to pay, and to insert, after the last row.
END, TAILS = (0, 4, 2, 0), ("", "II", "I", "")
FAR = 1 << 40
CUT = (
    "conv_id long, part int, no long, whole boolean, codes binary, runs array<long>, roles array<string>, texts array<string>, "
    "lo long, hi long, turns long, first_turn long, last_turn long, n long, first string, last string, "
    "blank long, duplicate long, truncated long, illegal long"
)
STATS = [x.split()[0] for x in CUT.split(", ")[8:]]
PIECE = "conv_id long, part int, no long, cost long, audit string, roles array<string>, texts array<string>, " + CUT.split("array<string>, ")[-1]
COSTS = "conv_id long, part int, no long, costs array<long>"
EXITS = "part int, no long, exits array<long>, tail boolean"
SOLVED = "conv_id long, part int, no long, tail boolean, paid array<long>, audits array<string>, ends array<int>"
STATES = "part int, no long, tail boolean, state int, block_cost long, letters string"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _row_arcs(code: int) -> list[list[tuple[int, int, str]]]:
    """A row's arcs (cost, offset of the end's number, letter) from each state, by letter."""
    out = []
    for q in range(4):
        arcs = [(DELETE, 4, "D"), (INSERT, NEXT[q] - q, "I")]
        if code != GONE:
            to = KEPT[q].get(INITIALS[code // 2 : code // 2 + 1])
            if to is not None:
                arcs.append((code % 2, 4 + to - q, "K"))
            arcs.append((REROLE + code % 2, 4 + NEXT[q] - q, "R"))
        out.append(arcs)
    return out


ARCS = [_row_arcs(c) for c in range(GONE + 1)]


class Lattice:
    """Rows' codes and the prices ``exits`` of the states after them; node 4 * row + state, the last is the end."""

    def __init__(self, codes: bytes, exits: tuple[int, ...]):
        self.end = 4 * len(codes) + 4
        self.arcs = [[(c, 4 * i + q + step, x) for c, step, x in ARCS[code][q]] for i, code in enumerate(codes) for q in range(4)]
        self.arcs += [[(e, self.end, "")] if e < FAR else [] for e in exits]
        # Prices to begin with that no arc undercuts: what each row costs at the least.
        self.prices = [min(exits)] * 4 + [0]
        for code in reversed(codes):
            self.prices[:0] = [self.prices[0] + (DELETE if code == GONE else code % 2)] * 4

    def auction(self, start: int) -> int:
        """The cost from ``start`` to the end, which must be reachable; prices converge along all shortest paths between them."""
        arcs, prices, path = self.arcs, self.prices, [start]
        while path[-1] != self.end:
            at = path[-1]
            offer, to = min(((c + prices[to], to) for c, to, _ in arcs[at]), default=(FAR, at))
            if offer > prices[at]:
                prices[at] = offer
                if at != start:
                    path.pop()
            else:
                path.append(to)
        return prices[start]

    def trace(self, start: int) -> tuple[str, int]:
        """The least letters of tight arcs from ``start`` to the end, and the state before it."""
        dead, path, letters = set(), [start], []
        while path[-1] != self.end:
            at = path[-1]
            for cost, to, letter in self.arcs[at]:
                if cost + self.prices[to] == self.prices[at] and to not in dead:
                    path.append(to)
                    letters.append(letter)
                    break
            else:
                dead.add(path.pop())
                letters.pop()
        return "".join(letters), path[-2] % 4


@lru_cache(1 << 15)
def solve(codes: bytes, exits: tuple[int, ...], state: int) -> tuple[int, str, int]:
    """Cost, audit and last state of a block's rows from ``state``; equal rows are solved once."""
    lattice = Lattice(codes, exits)
    cost = lattice.auction(state)
    return (cost, *lattice.trace(state))


@lru_cache(1 << 12)
def costs(codes: bytes) -> list[list[int]]:
    """Least cost of a block's rows between each two states, FAR where there is no way."""
    out = [[FAR] * 4 for _ in range(4)]
    for q in range(4):
        reached = {q}
        for code in codes:
            for _ in range(2):
                reached |= {NEXT[r] for r in reached}
            reached = {(r + step) % 4 for r in reached for _, step, x in ARCS[code][r] if x != "I"}
        for to in reached:
            out[q][to] = Lattice(codes, tuple(0 if r == to else FAR for r in range(4))).auction(q)
    return out


class _Block:
    """Rows of one conversation as they come: codes, runs of forced deletions, texts, counts."""

    def __init__(self, conv_id, part: int, no: int):
        self.head = {"conv_id": conv_id, "part": part, "no": no, "whole": False}
        self.codes, self.runs, self.roles, self.texts, self.bytes = bytearray(), [], [], [], 0
        self.stats = dict.fromkeys(STATS) | dict.fromkeys(("turns", "n", "blank", "duplicate", "truncated", "illegal"), 0)

    def full(self, size: int) -> bool:
        return len(self.codes) >= size or self.bytes >= BLOCK_BYTES

    def _gone(self, n: int) -> None:
        if self.codes[-1:] != bytes([GONE]):
            self.codes.append(GONE)
            self.runs.append(0)
        self.runs[-1] += n

    def add(self, turn, role: str, text: str, copies: int, blank: bool, late: bool, truncated: bool) -> None:
        s, initial = self.stats, role[:1]
        if turn is not None:
            if s["lo"] is None:
                s["lo"] = s["first_turn"] = turn
            s["turns"] += turn != s["last_turn"]
            s["hi"] = s["last_turn"] = turn
        s["illegal"] += (s["n"] > 0 and s["last"] + initial not in LEGAL) + copies - 1
        s["first"] = initial if s["n"] == 0 else s["first"]
        s["last"], s["n"] = initial, s["n"] + copies
        if blank:
            s["blank"] += copies
            self._gone(copies)
            return
        s["duplicate"] += copies - (not late)
        if not late:
            s["truncated"] += truncated
            self.codes.append(2 * (INITIALS.find(initial) if initial and initial in INITIALS else len(INITIALS)) + truncated)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text)
        if copies > (not late):
            self._gone(copies - (not late))

    def row(self) -> dict:
        return {**self.head, "codes": bytes(self.codes), "runs": self.runs, "roles": self.roles, "texts": self.texts, **self.stats}


def _batches(rows, schema: str, size: int = 500):
    held, names = [], [x.split()[0] for x in schema.split(", ")]
    heavy = 0
    for r in rows:
        held.append(r)
        heavy += sum(map(len, r.get("texts") or ()))
        if len(held) >= size or heavy > BLOCK_BYTES:
            yield record_batch({n: [x[n] for x in held] for n in names}, schema)
            held, heavy = [], 0
    if held:
        yield record_batch({n: [x[n] for x in held] for n in names}, schema)


def _stream(batches):
    """Rows one after another, of small parts of the batches."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield from b.slice(at, 256).to_pylist()


def _cut(size: int):
    """Sorted rows of a task into blocks. Only one that begins and ends between other conversations is known to be whole."""

    def blocks(batches):
        block, alone = None, False
        for r in _stream(batches):
            if block and (r["conv_id"] != block.head["conv_id"] or block.full(size)):
                other = r["conv_id"] != block.head["conv_id"]
                block.head["whole"] = alone and other
                yield block.row()
                block, alone = _Block(r["conv_id"], r["part"], block.head["no"] + 1), other
            block = block or _Block(r["conv_id"], r["part"], 0)
            if r["copies"]:
                block.add(r["turn"], r["role"], r["text"], r["copies"], r["blank"], r["late"], r["truncated"])
        if block:
            yield block.row()

    return lambda batches: _batches(blocks(batches), CUT)


def _piece(b: dict, cost: int, audit: str, state: int, tail: bool) -> dict:
    """A block's repaired turns along its audit; ``tail`` adds what is missing after the last row."""
    roles, texts, letters, codes = [], [], [], iter(b["codes"])
    kept, runs = iter(zip(b["roles"], b["texts"], strict=True)), iter(b["runs"])
    for letter in audit:
        if letter != "I":
            code = next(codes)
            if code == GONE:
                letters.append("D" * next(runs))
                continue
            role, text = next(kept)
        letters.append(letter)
        if letter == "D":
            continue
        to = KEPT[state][role[0]] if letter == "K" else NEXT[state]
        roles.append(role if letter == "K" else NAMES[state])
        texts.append("" if letter == "I" else text)
        state = to
    if tail:
        for letter in TAILS[state]:
            letters.append(letter)
            roles.append(NAMES[state])
            texts.append("")
            state = NEXT[state]
    cost += DELETE * (sum(b["runs"]) - len(b["runs"]))
    return {**b, "cost": cost, "audit": "".join(letters), "roles": roles, "texts": texts}


def _whole(batches):
    def pieces():
        for b in _stream(batches):
            cost, audit, _ = solve(b["codes"], END, 0)
            yield _piece(b, cost, audit, 0, True)

    yield from _batches(pieces(), PIECE)


def _costs(batches):
    rows = ({**b, "costs": [c for row in costs(b["codes"]) for c in row]} for b in _stream(batches))
    yield from _batches(rows, COSTS)


def _backwards(batches):
    """Blocks from a conversation's last to its first: prices of the states after each."""

    def rows():
        conv, after = object(), END
        for b in _stream(batches):
            if b["conv_id"] != conv:
                conv, after, last = b["conv_id"], END, True
            yield {**b, "exits": list(after), "tail": last}
            c, last = b["costs"], False
            after = tuple(min(c[4 * q + r] + after[r] for r in range(4)) for q in range(4))

    yield from _batches(rows(), EXITS)


def _solved(batches):
    """Each block solved from each state with the prices after it."""

    def rows():
        for b in _stream(batches):
            found = [solve(b["codes"], tuple(b["exits"]), q) for q in range(4)]
            paid = [c - b["exits"][q] if not b["tail"] else c for c, _, q in found]
            yield {**b, "paid": paid, "audits": [a for _, a, _ in found], "ends": [q for _, _, q in found]}

    yield from _batches(rows(), SOLVED)


def _forwards(batches):
    """Blocks from a conversation's first to its last: the state in which each begins, and what follows from it."""

    def rows():
        conv, state = object(), 0
        for b in _stream(batches):
            if b["conv_id"] != conv:
                conv, state = b["conv_id"], 0
            yield {**b, "state": state, "block_cost": b["paid"][state], "letters": b["audits"][state]}
            state = b["ends"][state]

    yield from _batches(rows(), STATES)


def _applied(batches):
    rows = (_piece(b, b["block_cost"], b["letters"], b["state"], b["tail"]) for b in _stream(batches))
    yield from _batches(rows, PIECE)


def faults(rows: DataFrame, space: Workspace) -> DataFrame:
    """Distinct rows with their number of copies, whether they are blank, truncated, or later than an equal role and text.

    Only rows whose role and text occur again are moved to be counted; a row's digest stands for its text in all keys.
    """
    given = F.col("copies") if "copies" in rows.columns else F.lit(1)
    there = given > 0
    text, role = (F.when(there, F.coalesce(c, F.lit(" "))).alias(c) for c in ("text", "role"))
    named = rows.select(F.col("conv_id").cast("long"), F.when(there, F.col("turn")).cast("long").alias("turn"), role, text, given.cast("long").alias("copies"))
    hashed = named.withColumn("digest", F.sha2("text", 256))
    again = hashed.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("least"), F.count("*").alias("times"), F.sum("copies").alias("all"))
    again = again.where("times > 1 OR all > 1 OR digest IS NULL")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "least")
    found, _ = bounded(space.save(again, "repeated"), F.coalesce(F.octet_length("r"), F.lit(0)) + 100)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("role").eqNullSafe(F.col("r")) & F.col("digest").eqNullSafe(F.col("d"))
    met = hashed.join(found, same, "left")
    late = (F.col("least").isNotNull() & ~F.col("least.turn").eqNullSafe(F.col("turn"))).alias("late")
    keys = ["conv_id", "turn", "role", "digest", "text", "late"]
    once = met.where("least IS NULL").select("conv_id", "turn", "role", "digest", "text", late, "copies")
    # A later row goes, so its text is not needed, unless it is blank.
    bare = F.rtrim("text", F.lit(SPACE))
    more = met.where("least IS NOT NULL").select("conv_id", "turn", "role", "digest", F.when(~late | (bare == ""), F.col("text")).alias("text"), late, "copies")
    more = more.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    blank, truncated = F.coalesce(bare == "", F.lit(False)), ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    return once.unionByName(more).select(*keys, "copies", blank.alias("blank"), F.coalesce(truncated, F.lit(False)).alias("truncated"))


def _pieces(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations of one piece, and the pieces of others."""
    space = Workspace(rows.sparkSession, "conversations")
    order = ["conv_id", "turn", "role", "digest"]
    dealt = faults(rows, space).repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    blocks = space.save(dealt.drop("digest").withColumn("part", F.spark_partition_id()).mapInArrow(_cut(block), CUT), "blocks")
    rest = blocks.where("not whole")
    between = rest.select("conv_id", "part", "no", "codes").mapInArrow(_costs, COSTS)
    exits = between.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no")).mapInArrow(_backwards, EXITS)
    solved = rest.select("conv_id", "part", "no", "codes").join(exits, ["part", "no"]).mapInArrow(_solved, SOLVED)
    states = space.save(solved.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(_forwards, STATES), "states")
    return blocks.where("whole").mapInArrow(_whole, PIECE), rest.join(states, ["part", "no"]).mapInArrow(_applied, PIECE)


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each conversation's repaired turns, cost and audit, in one row for most, in several pieces for long ones.

    Takes rows (conv_id, turn, role, text) and, if there, copies: so many rows like it there are; a row of none only tells of its
    conversation. Other columns, whatever their names, are ignored. Returns conv_id, part, no (which order a conversation's pieces),
    cost, audit, roles and texts (the repaired turns, in order), and counts of rows and faults. Rows are taken by turn, nulls
    first; of one turn by role, then by the text's SHA-256. A null text or role is one space, a null conv_id a conversation of its
    own. Rows equal in all columns are copies, of which the first may stay. Empty tables give no rows; long texts count whole.
    """
    whole, rest = _pieces(rows, block)
    return whole.unionByName(rest)


def turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, no, place, role, text): the repaired turns, ordered by part, no and place within a conversation."""
    both = F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "t")
    return pieces.select("conv_id", "part", "no", both).select("conv_id", "part", "no", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))


def _digests(batches):
    def rows():
        now = None
        for p in _stream(batches):
            if now is None or now["conv_id"] != p["conv_id"]:
                if now:
                    yield _result(now)
                now = {**p, "audits": [], "hash": hashlib.sha256(), "any": False}
            else:
                both = p["n"] and now["n"] and now["last"] + p["first"] not in LEGAL
                again = now["last_turn"] is not None and now["last_turn"] == p["first_turn"]
                for k in ("n", "blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                    now[k] += p[k]
                now["illegal"] += bool(both)
                now["turns"] -= again
                now |= {"last": p["last"] if p["n"] else now["last"], "lo": p["lo"] if now["lo"] is None else now["lo"]}
                now |= {k: now[k] if p["hi"] is None else p[k] for k in ("hi", "last_turn")}
            now["audits"].append(p["audit"])
            for role, text in zip(p["roles"], p["texts"], strict=True):
                now["hash"].update(f"{'\n' if now['any'] else ''}{role}:{text}".encode())
                now["any"] = True
        if now:
            yield _result(now)

    yield from _batches(rows(), RESULT)


def _result(now: dict) -> dict:
    gaps = now["hi"] - now["lo"] + 1 - now["turns"] if now["lo"] is not None else 0
    return {**now, "gaps": gaps, "audit": "".join(now["audits"]), "repaired_sha256": now["hash"].hexdigest()}


def report(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation of ``rows``, as ``repair`` takes them: counts of faults and gaps, cost, audit, and the repaired turns' SHA-256."""
    whole, rest = _pieces(rows, block)
    rest = rest.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return whole.mapInArrow(_digests, RESULT).unionByName(rest.mapInArrow(_digests, RESULT))


def damage(rows: DataFrame) -> DataFrame:
    """Rows with faults drawn by the checksum of conversation and turn; a dropped row has no copies."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn"))) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    bare = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies: Column = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), bare.alias("text"), copies.alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damage(table(spark, sf_dir, "conversations")))


SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, CAST(i AS INTEGER), 1)) AS BIGINT)), lambda crc, b:
           list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295), 4294967295) % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS c FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, rtrim(text, E' \t\n\x0b\x0c\r') AS bare FROM n),
f AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS twice, bare = '' OR again AS gone, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS odd, CAST(cut AS INTEGER) AS p FROM o),
m AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS rows FROM f GROUP BY conv_id),
best AS (
  SELECT conv_id, rows AS i, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS s0, {'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']} AS s1,
         {'c': 2, 'a': 'I', 'r': ['assistant:']} AS s2, {'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])} AS s3 FROM m
  UNION ALL
  SELECT conv_id, i - 1,
         list_min([n0, {'c': n2.c + 2, 'a': 'I' || n2.a, 'r': list_prepend('user:', n2.r)}, {'c': n3.c + 4, 'a': 'II' || n3.a, 'r': list_concat(['user:', 'assistant:'], n3.r)}]),
         list_min([n1, {'c': n2.c + 2, 'a': 'I' || n2.a, 'r': list_prepend('user:', n2.r)}, {'c': n3.c + 4, 'a': 'II' || n3.a, 'r': list_concat(['user:', 'assistant:'], n3.r)}]),
         list_min([n2, {'c': n3.c + 2, 'a': 'I' || n3.a, 'r': list_prepend('assistant:', n3.r)}]),
         list_min([n3, {'c': n2.c + 2, 'a': 'I' || n2.a, 'r': list_prepend('user:', n2.r)}])
  FROM (
    SELECT b.conv_id, b.i,
           list_min([{'c': s0.c + 3, 'a': 'D' || s0.a, 'r': s0.r}, CASE WHEN NOT gone AND c = 's' THEN {'c': s1.c + p, 'a': 'K' || s1.a, 'r': list_prepend(role || ':' || text, s1.r)} END,
                     CASE WHEN NOT gone AND c = 'u' THEN {'c': s2.c + p, 'a': 'K' || s2.a, 'r': list_prepend(role || ':' || text, s2.r)} END,
                     CASE WHEN NOT gone THEN {'c': s2.c + 2 + p, 'a': 'R' || s2.a, 'r': list_prepend('user:' || text, s2.r)} END]) AS n0,
           list_min([{'c': s1.c + 3, 'a': 'D' || s1.a, 'r': s1.r}, CASE WHEN NOT gone AND c = 'u' THEN {'c': s2.c + p, 'a': 'K' || s2.a, 'r': list_prepend(role || ':' || text, s2.r)} END,
                     CASE WHEN NOT gone THEN {'c': s2.c + 2 + p, 'a': 'R' || s2.a, 'r': list_prepend('user:' || text, s2.r)} END]) AS n1,
           list_min([{'c': s2.c + 3, 'a': 'D' || s2.a, 'r': s2.r}, CASE WHEN NOT gone AND c = 'a' THEN {'c': s3.c + p, 'a': 'K' || s3.a, 'r': list_prepend(role || ':' || text, s3.r)} END,
                     CASE WHEN NOT gone THEN {'c': s3.c + 2 + p, 'a': 'R' || s3.a, 'r': list_prepend('assistant:' || text, s3.r)} END]) AS n2,
           list_min([{'c': s3.c + 3, 'a': 'D' || s3.a, 'r': s3.r}, CASE WHEN NOT gone AND c = 'u' THEN {'c': s2.c + p, 'a': 'K' || s2.a, 'r': list_prepend(role || ':' || text, s2.r)} END,
                     CASE WHEN NOT gone THEN {'c': s2.c + 2 + p, 'a': 'R' || s2.a, 'r': list_prepend('user:' || text, s2.r)} END]) AS n3
    FROM best b JOIN f ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.i))
SELECT whole.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit,
       sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS whole
LEFT JOIN m ON whole.conv_id IS NOT DISTINCT FROM m.conv_id
LEFT JOIN best ON whole.conv_id IS NOT DISTINCT FROM best.conv_id AND best.i = 0
"""
