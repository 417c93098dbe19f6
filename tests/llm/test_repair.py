"""Repair of conversations against a full chart, a search over all edits, and cases by hand."""

import hashlib
import random
import re
import zlib

import pytest

from quarry.llm import repair
from quarry.llm.repair import CODES, FAULTS, INITIALS, LEAVES, NOTHING, best, combined, damaged, merged, parsed

SCHEMA = "conv_id long, turn long, role string, text string, cost string, pos int"


def search(codes, inserts=3):
    """Least (cost, audit) by trying every edit of every row, with up to so many insertions in each gap."""
    found = []

    def go(i, place, cost, audit, spare):
        if found and cost > min(found)[0]:
            return
        if i == len(codes) and place in repair.ENDS:
            found.append((cost, audit))
        if spare:
            for (initial, p), q in repair.STEPS.items():
                if p == place and initial in "ua":
                    go(i, q, cost + 5, audit + "I", spare - 1)
        if i == len(codes):
            return
        fault, initial = FAULTS[CODES.index(codes[i]) // 4], INITIALS[CODES.index(codes[i]) % 4]
        go(i + 1, place, cost + 2, audit + "D", inserts)
        if fault in ("blank", "duplicate"):
            return
        late = 5 if fault else 0
        for (name, p), q in repair.STEPS.items():
            if p == place:
                if name == initial:
                    go(i + 1, q, cost + late, audit + "K", inserts)
                if name in "ua":
                    go(i + 1, q, cost + 1 + late, audit + "R", inserts)

    go(0, 0, 0, "", inserts)
    return min(found)


def full_chart(codes):
    """Every interval from every division; all divisions must agree."""
    chart = {(i, i + 1): LEAVES[c] for i, c in enumerate(codes)}
    for length in range(2, len(codes) + 1):
        for i in range(len(codes) - length + 1):
            cells = [combined(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)]
            assert all(c == cells[0] for c in cells)
            chart[i, i + length] = cells[0]
    return chart[0, len(codes)] if codes else NOTHING


def test_cells_agree_with_a_search_over_all_edits():
    rng = random.Random(4)
    cases = ["", *CODES, *("".join(rng.choices(CODES[:8] * 3 + CODES, k=rng.randint(2, 6))) for _ in range(60))]
    for codes in cases:
        assert best(merged([LEAVES[c] for c in codes])) == search(codes), codes


def test_any_division_gives_the_same_cell():
    rng = random.Random(5)
    for n in (1, 2, 3, 5, 9, 14):
        codes = "".join(rng.choices(CODES, k=n))
        assert full_chart(codes) == parsed(codes)


def plainly(rows):
    """The whole contract for one conversation in plain Python."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [((turn is not None, turn or 0), "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort()
    seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in out:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes += CODES[FAULTS.index(fault) * 4 + INITIALS.index(role[:1] if role[:1] in ("s", "u", "a") else "?")]
    turns = [t for (known, t), *_ in out if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(out, out[1:])]
    cost, audit = best(full_chart(codes))
    kept, i, n = [], 0, sum(c != "D" for c in audit)
    takes = (["system"] if n % 2 else []) + ["user", "assistant"] * (n // 2)
    for letter in audit:
        if letter == "I":
            kept.append(f"{takes[len(kept)]}:")
            continue
        if letter != "D":
            kept.append(f"{out[i][1] if letter == 'K' else takes[len(kept)]}:{out[i][2]}")
        i += 1
    digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest


def conversation(conv, rng):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "ursula"]
    texts = ["Yes.", "No!", "What?", "cut off", "  ", "", None, "Yes. \n", "naïve \U0001f600.", " "]
    turns = [None, *range(12), 40]
    return [(conv, rng.choice(turns), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(1, 14))]


@pytest.mark.parametrize("block, fan, hot", [(4096, 32, 1_000_000), (2, 2, 3)])
def test_query_agrees_with_plain_python(spark, block, fan, hot):
    rng = random.Random(9)
    data = [row for conv in [None, *range(40)] for row in conversation(conv, rng)]
    frame = spark.createDataFrame([(*r, "7", 7) for r in data], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(frame, damaged(frame), block, fan, hot).collect()}
    assert set(got) == {r[0] for r in data}
    for conv, found in got.items():
        assert found == plainly([r for r in data if r[0] == conv]), conv


def test_conversation_without_rows_after_damage(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(dropped, 0, "user", "Hi.", "", 0)], SCHEMA)
    assert [tuple(r) for r in repair.repair(frame, damaged(frame)).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_very_long_conversation_and_text(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Row {t}.", "", 0) for t in range(3000)] + [(2, 0, "user", "word " * 400_000, "", 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in repair.repair(frame, damaged(frame), block=64, fan=4).collect()}
    assert len(got[1]["audit"].replace("I", "")) == damaged(frame).filter("conv.conv_id = 1").count()
    assert tuple(got[2])[1:] == plainly([r[:4] for r in rows if r[0] == 2])


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert repair.repair(frame, damaged(frame)).count() == 0
