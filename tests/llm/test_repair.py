"""Operator 12 against plain versions: all edits of short conversations, and rows damaged and judged one by one."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from bytelore.llm import repair
from bytelore.llm.repair import damaged, digests, op12_repair, repaired, repaired_turns

BLANK, LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")
GOAL = re.compile(r"(s?(ua)+)?\Z")


def plain_damage(rows):
    for conv, turn, role, text in rows:
        conv, role, text = (" " if x is None else x for x in (conv, role, text))
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][: repair.HEAD].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = LAST.search(text)
        out.append("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, faults):
    """The cheapest of all edits, with up to two inserts in each place."""
    names = {"u": "user", "a": "assistant"}
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    ways = [["D"] if fault in ("blank", "duplicate") else ["D", "K", "u", "a"] for fault in faults]
    for edits in itertools.product(*ways):
        for added in itertools.product(inserts, repeat=len(rows) + 1):
            said, cost, audit = [], 0, ""
            for k, place in enumerate(added):
                said += [(names[c], "") for c in place]
                cost, audit = cost + 2 * len(place), audit + "I" * len(place)
                if k == len(rows):
                    break
                cut = faults[k] == "truncated"
                if edits[k] == "D":
                    cost, audit = cost + 3, audit + "D"
                else:
                    kept = edits[k] == "K"
                    said.append((rows[k][1] if kept else names[edits[k]], rows[k][2]))
                    cost, audit = cost + (0 if kept else 2) + cut, audit + ("K" if kept else "R")
            if all(r for r, _ in said) and GOAL.match("".join(r[0] for r, _ in said)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, said
    return best


def forward(rows, faults):
    """Left to right, by state, for longer conversations."""
    states = {"": (0, "", ())}
    step = {"": "u", "s": "u", "a": "u", "u": "a"}
    names = {"u": "user", "a": "assistant"}

    def put(to, state, value):
        if state not in to or value[:2] < to[state][:2]:
            to[state] = value

    def grown(now):
        for _ in range(3):
            for state, (cost, audit, said) in list(now.items()):
                put(now, step[state], (cost + 2, audit + "I", (*said, (names[step[state]], ""))))
        return now

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for state, (cost, audit, said) in grown(states).items():
            put(after, state, (cost + 3, audit + "D", said))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                put(after, step[state], (cost + 2 + cut, audit + "R", (*said, (names[step[state]], text))))
                if role[:1] == step[state] or (state == "" and role[:1] == "s"):
                    put(after, role[:1], (cost + cut, audit + "K", (*said, (role, text))))
        states = after
    states = grown(states)
    return min(states[x] for x in ("", "a") if x in states)


def plain(rows, solve=forward):
    """{conv: row of the query} of (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = plain_order(plain_damage([r for r in rows if r[0] == conv]))
        faults = plain_faults(own)
        cost, audit, said = solve(own, faults)
        turns = {t for t, _, _ in own if t is not None}
        count = lambda f: sum(x == f for x in faults)  # noqa: B023, E731
        initials = [r[1][:1] if r[1][:1] in "sua" else "?" for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, digest)
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def of_query(spark, rows, tmp_path, schema=SCHEMA, parts=1):
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    got = op12_repair(spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[f] for f in FIELDS) for r in got}


def test_forward_pass_equals_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = [(k, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["", "a.", "b", "c!", " "])) for k in range(rng.randrange(4))]
        assert forward(rows, plain_faults(rows)) == (lambda b: (b[0], b[1], tuple(b[2])))(every_edit(rows, plain_faults(rows)))


def test_products_equal_the_forward_pass_in_any_bracketing():
    rng = random.Random(6)
    for _ in range(300):
        kinds = [(rng.choice(["s", "u", "a", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(12))]
        parts = [repair.turns_alike(k, c, 1, False, forced, cut) for k, (c, forced, cut) in enumerate(kinds)]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [repair.joined(parts[k], parts[k + 1])]
        found = repair.settled(parts[0] if parts else repair.EMPTY)
        rows = [(k, c + "x" if c else "", str(k)) for k, (c, _, _) in enumerate(kinds)]
        faults = ["duplicate" if forced else "truncated" if cut else "" for _, forced, cut in kinds]
        assert found[5:7] == forward(rows, faults)[:2]


def test_random_conversations_equal_the_plain_version(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for conv in [None, *range(120)]:
        for k in range(rng.choice([1, 2, 3, 6, 30])):
            turn = rng.choice([k, k, k, None, k * 2])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]), rng.choice(["Yes.", "No", None, "", "Well! ", f"It is {k}.", "x" * 200 + rng.choice("ab.")])))
            rows += [rows[-1]] * (rng.random() < 0.1)
    assert of_query(spark, rows, tmp_path, parts=3) == plain(rows)


def test_a_long_conversation_is_cut_by_ranges(spark, tmp_path):
    rng = random.Random(8)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant"]), f"{rng.randrange(900)} said{rng.choice(['.', '.', ''])}") for k in range(3000)]
    rows += [(7, 3000, "user", "again.")] * 500 + [(k, 0, "user", "Hi.") for k in (1, 9)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert of_query(spark, rows, tmp_path, parts=4) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_dropped_and_empty(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert of_query(spark, [(gone, 0, "user", "Hi.")], tmp_path) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert of_query(spark, [], tmp_path) == {}


def test_other_columns_may_have_any_name(spark, tmp_path):
    row = next(k for k in range(1000) if all(zlib.crc32(f"{k}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(row, 0, "user", "Hi.", 1, "x", 2, "y"), (row, 1, "assistant", "Ho.", 1, "x", 2, "y")]
    got = of_query(spark, rows, tmp_path, SCHEMA + ", copies long, digest string, part int, conv string")
    assert got == plain([r[:4] for r in rows])


def test_long_text_and_turns_of_a_repair(spark):
    long = "word " * 400_000 + "end."
    df = spark.createDataFrame([("c", 2, "assistant", long), ("c", 1, "assistant", "Cut off"), ("c", 3, "tool", "Bye.")], "id string, n int, who string, said string")
    names = {"conv": "id", "turn": "n", "role": "who", "text": "said"}
    found = repaired(df, **names)
    want = forward([(1, "assistant", "Cut off"), (2, "assistant", long), (3, "tool", "Bye.")], ["truncated", "", ""])
    assert [(r.cost, r.audit) for r in found.collect()] == [want[:2]]
    turns = repaired_turns(df, found, **names)
    assert [(r.role, r.text) for r in turns.orderBy("place").collect()] == list(want[2])
    assert [r.repaired_sha256 for r in digests(turns).collect()] == [hashlib.sha256("\n".join(f"{r}:{t}" for r, t in want[2]).encode()).hexdigest()]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_equals_the_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in op12_repair(spark, f"/root/testdata/{sf}").collect()}
    assert got == plain(rows)
    assert damaged(spark.createDataFrame(rows, SCHEMA)).where(F.col("copies") == 0).count()
