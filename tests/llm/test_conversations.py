"""Conversation repair against a plain search over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from faultline.llm import conversations


def cheapest(letters):
    """Least cost, then least edits, with all edits of all states at hand."""
    def inserted(best):
        best = dict(best)
        for _ in range(3):
            for state, (cost, edits) in list(best.items()):
                after, way = (3 if state == 2 else 2), (cost + 3, edits + "I")
                if after not in best or way < best[after]:
                    best[after] = way
        return best

    best = {0: (0, "")}
    for x in letters:
        after = {}
        for state, (cost, edits) in inserted(best).items():
            ways = [(4, "D", state)]
            if not x.isdigit():
                extra = 3 if x.isupper() else 0
                kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(x.lower(), {})
                if state in kept:
                    ways.append((extra, "K", kept[state]))
                ways.append((3 + extra, "R", 3 if state == 2 else 2))
            for more, edit, new in ways:
                way = (cost + more, edits + edit)
                if new not in after or way < after[new]:
                    after[new] = way
        best = after
    return min(way for state, way in inserted(best).items() if state in (0, 3))


def test_halving_equals_the_plain_search_for_any_chunks():
    dice = random.Random(5)
    for _ in range(3000):
        letters = "".join(dice.choices("suuuaaaoSUAO0123", k=dice.randint(1, 14)))
        whole = conversations.step_of(letters)
        cost, after = conversations.last_state(whole)
        edits = "".join(conversations.edits_of(letters, 0, after)) + conversations.TAIL[after][1]
        assert (cost, edits) == cheapest(letters)
        size = dice.randint(1, 5)
        parts = [letters[i:i + size] for i in range(0, len(letters), size)]
        steps = [conversations.step_of(p) for p in parts]
        assert conversations.joined(steps) == whole
        states = conversations.crossings(steps, 0, after)
        apart = "".join("".join(conversations.edits_of(p, a, b)) for p, a, b in zip(parts, [0, *states], states))
        assert apart + conversations.TAIL[after][1] == edits


def plain(rows):
    kept = {}
    for conv, turn, role, text in rows:
        mine = kept.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    out = []
    for conv, mine in kept.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, letters, initials, count = set(), "", "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            initial, body = role[0] if role[:1] in ("s", "u", "a") else "o", text.rstrip(" \t\n\x0b\x0c\r")
            bad = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            if bad:
                count[bad] += 1
            letters += initial.upper() if bad == "truncated" else "0123"["suao".index(initial)] if bad else initial
            initials += initial
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(letters)
        state, repaired, left = 0, [], iter(mine)
        for edit in audit:
            new = "assistant" if state == 2 else "user"
            if edit != "I":
                _, role, text = next(left)
            if edit == "D":
                continue
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[role[0]]
                repaired.append(f"{role}:{text}")
            else:
                state = 3 if new == "assistant" else 2
                repaired.append(f"{new}:{text if edit == 'R' else ''}")
        illegal = sum(p + q not in ("su", "ua", "au") for p, q in zip(initials, initials[1:]))
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(rows, parts=5):
    return sorted(map(tuple, conversations.repair_damaged(rows, parts).collect()), key=str)


def test_whole_sample_equals_the_plain_version(spark, sample):
    rows = spark.read.parquet(f"{sample}/conversations.parquet")
    assert repaired(rows) == plain([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls everywhere, repeated rows and turns, foreign and empty roles, blank and long texts, one hot conversation."""
    dice = random.Random(1)
    texts = ["Hi.", "ok", "Yes!", "", " ", "no?\n", None, "ends. ", "a.b", "x " * 40_000, "\x1c", "é…"]
    roles = ["user", "assistant", "system", "tool", None, "", "usher"]
    rows = [(dice.choice([1, 2, None, 3]), dice.choice([None, *range(12)]), dice.choice(roles), dice.choice(texts)) for _ in range(300)]
    return rows + [(7, i, dice.choice(roles[:3]), f"w{dice.randint(0, 800)}{dice.choice(['.', ''])}") for i in range(1200)]


@pytest.mark.parametrize("shifts", [conversations.SHIFTS, (2, 4, 6, 9, 20)])
def test_odd_rows_and_a_conversation_of_many_chunks(spark, monkeypatch, odd_rows, shifts):
    monkeypatch.setattr(conversations, "SHIFTS", shifts)
    rows = spark.createDataFrame([(*r, 5, "x") for r in odd_rows], "conv_id long, turn long, role string, text string, at int, fault string")
    assert repaired(rows.repartition(3)) == plain(odd_rows)


def test_no_rows(spark, odd_rows):
    rows = spark.createDataFrame(odd_rows[:1], "conv_id long, turn long, role string, text string")
    assert repaired(rows.limit(0)) == []
    gone = next(i for i in range(99) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    lost = spark.createDataFrame([(gone, 0, "user", "Hi.")], rows.schema)
    assert repaired(lost) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
