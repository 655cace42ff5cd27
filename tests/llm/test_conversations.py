"""The prefix trie and the repair of conversations, against plain programs."""

import collections
import hashlib
import random
import re
import time
import zlib

import pytest

from savora.llm import prefix_trie, structure_repair

DDL = "conv_id long, turn long, role string, text string, path string, words long, gone boolean"
BLANK = " \t\n\x0b\x0c\r"


def crc(text):
    return zlib.crc32(text.encode())


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))


def conversations(rng, n, turns=6, words=2):
    """Few different turns, so that prefixes meet; ties, nulls, repeated rows and a very long conversation."""
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, turns)):
            rows.append((c, t, ["system", "user", "assistant"][(t + (c % 7 > 0)) % 3], " ".join(rng.choice("ab") * 2 for _ in range(words - t % 2))))
    rows += [(3, None, None, None), (3, 1, "user", None), (3, 1, "user", ""), (None, 1, "user", "aa"), (None, None, None, None)]
    rows += [(5, 2, "user", "x y. z!")] * 2 + [(-7, 1, "assistant", "Done."), (6, 1, "", " \n "), (8, 4, "user", "é" * 3000 + " ok?")]
    rows += [(n + k, t, "user" if t % 2 == 0 else "assistant", f"t{t} ok.") for k in range(3) for t in range(90 + 5 * k)]
    return rows


@pytest.fixture(scope="module", params=[(1, 40), (2, 150)])
def rows(request):
    return conversations(random.Random(request.param[0]), request.param[1])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7, True) for r in rows], DDL).repartition(3)


def slow_trie(rows):
    turns = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t, r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in in_order(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = crc(str(c)) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    saved, leaves = collections.Counter(), collections.Counter()
    for p, own in members.items():
        cost = (len(own) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += children[p] == 0
    found = set()
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if whole[c] == p)
        up = min(members[p[:-1]]) if p else None
        found.add((min(own), len(p), up, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return found


@pytest.mark.parametrize("slab_bytes", [1, 3000, prefix_trie.SLAB_BYTES])
def test_trie(spark, rows, slab_bytes):
    found = prefix_trie.trie(prefix_trie.rebuilt(frame(spark, rows)), slab_bytes)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in found.collect()]
    expected = slow_trie(rows)
    assert len(found) == len(expected) and set(found) == expected


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    assert prefix_trie.rebuilt_trie(none).count() == 0
    assert structure_repair.repairs(none).count() == 0


def test_many_copies_are_one_path(spark):
    """A third of all conversations alike, ids hashed piece by piece in numeric order."""
    rows = [(20 * c, t, "user", f"same {t}") for c in range(3000) for t in range(2)]
    made = prefix_trie.trie(prefix_trie.rebuilt(frame(spark, rows))).collect()
    assert [(r.depth, r.n_convs) for r in sorted(made, key=lambda r: r.depth)] == [(0, 3000), (1, 3000), (2, 3000)]
    ids = ",".join(str(20 * c) for c in range(3000))
    assert max(made, key=lambda r: r.depth).ends_sha256 == hashlib.sha256(ids.encode()).hexdigest()


STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def slow_repair(turns):
    """All cheapest derivations as strings, front to back."""
    best = {(0, 0): (0, "", ())}
    seen = {}
    todo = [(0, "", 0, 0, ())]
    import heapq

    while todo:
        cost, audit, at, state, made = heapq.heappop(todo)
        if (at, state) in seen and seen[at, state] <= (cost, audit):
            continue
        seen[at, state] = (cost, audit)
        best[at, state] = (cost, audit, made)
        for symbol in "ua":
            if symbol in STEPS[state]:
                heapq.heappush(todo, (cost + 3, audit + "I", at, STEPS[state][symbol], (*made, "I" + symbol)))
        if at == len(turns):
            continue
        turn, extra = turns[at].lower(), 3 * turns[at].isupper()
        heapq.heappush(todo, (cost + 4, audit + "D", at + 1, state, (*made, "D")))
        if turn == "x":
            continue
        if turn in STEPS[state]:
            heapq.heappush(todo, (cost + extra, audit + "K", at + 1, STEPS[state][turn], (*made, "K")))
        for symbol in "ua":
            if symbol in STEPS[state]:
                heapq.heappush(todo, (cost + extra + 3, audit + "R", at + 1, STEPS[state][symbol], (*made, "R" + symbol)))
    ends = [best[len(turns), s] for s in (0, 3) if (len(turns), s) in best]
    return min(ends)


def test_repaired_against_plain_search():
    rng = random.Random(4)
    for trial in range(3000):
        turns = "".join(rng.choice("uuaasoxUASO") for _ in range(rng.randrange(0, 14)))
        cost, audit, made = slow_repair(turns)
        found, plan = structure_repair.plan_of(turns)
        edits = [structure_repair.EDITS[e] for e in plan]
        assert (found, "".join(e[0] for e in edits), tuple(edits)) == (cost, audit, made), turns


def test_long_conversations_take_linear_time():
    started = time.time()
    for size in (20_000, 100_000):
        cost, plan = structure_repair.plan_of("xs" + "uaoUx" * (size // 5))
        assert len(plan) >= size and cost > 0
    assert time.time() - started < 60


def slow_rows(rows):
    """Rows after damage, by conversation."""
    found = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is None:
            continue
        own, harm = found[c], crc(f"{c}:{' ' if t is None else t}") % 20
        r, x = " " if r is None else r, " " if x is None else x
        if harm == 0:
            continue
        x = "" if harm == 1 else re.sub("[.!?]", "", x) if harm == 2 else x
        own += [(t, "user" if harm == 4 else r, x)] * (2 if harm == 3 else 1)
    return {c: in_order(v) for c, v in found.items()}


def test_repairs(spark, rows):
    expected = set()
    for c, own in slow_rows(rows).items():
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, letters, counts = set(), "", collections.Counter()
        for _, r, x in own:
            bare = x.strip(BLANK)
            fault = "b" if not bare else "d" if (r, x) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((r, x))
            counts[fault] += 1
            letter = "x" if fault in ("b", "d") else r[:1] if r[:1] in ("u", "a", "s") else "o"
            letters += letter.upper() if fault == "t" else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, made = slow_repair(letters)
        left, lines = iter(own), []
        for edit in made:
            role = {"u": "user", "a": "assistant"}.get(edit[1:])
            if edit[0] == "I":
                lines.append(f"{role}:")
                continue
            _, r, x = next(left)
            if edit != "D":
                lines.append(f"{r if edit == 'K' else role}:{x}")
        expected.add((c, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    found = structure_repair.repairs(frame(spark, rows))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [tuple(r) for r in found.collect()]
    assert len(found) == len(expected) and set(found) == expected
