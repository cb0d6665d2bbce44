import hashlib
import random
import zlib

import pytest

from clausefold.llm import repair as R

BLANK = " \t\n\v\f\r"


def step(state, initial):
    if initial == "s":
        return R.SYSTEM if state == R.BEGIN else None
    if initial == "u":
        return R.DUE if state != R.DUE else None
    if initial == "a":
        return R.DONE if state == R.DUE else None
    return None


def exhaustive(turns):
    """The cheapest (cost, audit) of all lists of edits."""
    best = None

    def go(i, state, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(turns) and state in (R.BEGIN, R.DONE) and (best is None or (cost, audit) < best):
            best = cost, audit
        if inserted < 3:
            for x in "ua":
                if (to := step(state, x)) is not None:
                    go(i, to, cost + 2, audit + "I", inserted + 1)
        if i < len(turns):
            t = turns[i]
            go(i + 1, state, cost + 3, audit + "D", 0)
            if not t.must_go:
                if (to := step(state, t.initial)) is not None:
                    go(i + 1, to, cost + t.truncated, audit + "K", 0)
                for x in "ua":
                    if (to := step(state, x)) is not None:
                        go(i + 1, to, cost + 2 + t.truncated, audit + "R", 0)

    go(0, R.BEGIN, 0, "", 0)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_blocks_against_all_lists_of_edits(seed):
    rng = random.Random(seed)
    for _ in range(150):
        turns = [R.Turn(rng.choice("suauat"), rng.random() < 0.2, False) for _ in range(rng.randint(1, 7))]
        for t in turns:
            t.truncated = not t.must_go and rng.random() < 0.2
        size = rng.choice([1, 2, 3, 7])
        ways = [R.transfers(turns[i : i + size]) for i in range(0, len(turns), size)]
        ranks = [{a: k for k, a in enumerate(sorted({a for _, a in w.values()}))} for w in ways]
        cost, path = R.route([{k: (c, r[a]) for k, (c, a) in w.items()} for w, r in zip(ways, ranks, strict=True)])
        audit = "".join(w[p][1] for w, p in zip(ways, path, strict=True)) + "I" * len(R.ENDING[path[-1][1]])
        assert (cost, audit) == exhaustive(turns)


def test_band_holds_every_path():
    rng = random.Random(9)
    for _ in range(300):
        turns = [R.Turn(rng.choice("ua"), rng.random() < 0.3, False) for _ in range(rng.randint(1, 8))]
        target = R.alternating(rng.choice("ua"), rng.randint(0, 10))
        wide = R.align(turns, target, 1000)
        if wide:
            assert R.align(turns, target, wide[0]) == wide
            assert R.align(turns, target, wide[0] - 1) is None


def brute(rows):
    """The contract, in plain Python, for (conv_id, turn, role, text) rows."""
    said = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        own.extend([(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = set()
    for conv, own in convs.items():
        own.sort()
        seen, turns, faults, illegal = set(), [], [0, 0, 0], 0
        for k, (_, _, role, text) in enumerate(own):
            plain = text.strip(BLANK)
            fault = 0 if not plain else 1 if (role, text) in seen else 2 if plain[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            turns.append(R.Turn(role[:1], fault in (0, 1), fault == 2))
            illegal += k > 0 and own[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        numbers = [t for known, t, _, _ in own if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = cheapest(turns)
        made, at, state = [], 0, R.BEGIN
        for e in audit:
            due = "assistant" if state == R.DUE else "user"
            if e != "D":
                made.append((own[at][2] if e == "K" else due, "" if e == "I" else own[at][3]))
                state = step(state, made[-1][0][0])
            at += e != "I"
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out.add((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def cheapest(turns):
    """Row by row: the best (cost, audit) in each state, insertions before a turn."""
    now = {R.BEGIN: (0, "")}
    for t in turns:
        new = {}

        def offer(state, cost, audit, new=new):
            if state is not None and (state not in new or (cost, audit) < new[state]):
                new[state] = cost, audit

        for s, (c, a) in now.items():
            offer(s, c + 3, a + "D")
            for inserted in ("", "u", "a", "ua", "au"):
                to = s
                for x in inserted:
                    to = None if to is None else step(to, x)
                if to is None or t.must_go:
                    continue
                more = a + "I" * len(inserted)
                offer(step(to, t.initial), c + 2 * len(inserted) + t.truncated, more + "K")
                for x in "ua":
                    offer(step(to, x), c + 2 * len(inserted) + 2 + t.truncated, more + "R")
        now = new
    return min((c + 2 * len(R.ENDING[s]), a + "I" * len(R.ENDING[s])) for s, (c, a) in now.items())


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice([f"text {turn}.", "same?", "no end", "", "  ", None, "two\nlines!", "é" * 30])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    rows += [(None, k, "user" if k % 2 == 0 else "assistant", f"t{k}.") for k in range(5)]
    rows += [(900, 5, "user", "again.")] * 40  # one turn, many times
    rows += [(901, k, rng.choice(["user", "assistant", "system"]), rng.choice([f"{k}.", "x!", f"{k}"])) for k in range(400)]  # many blocks
    rows += [(902, 0, "user", "long. " * 300_000), (902, 1, "assistant", "fine.")]
    rows += [(903 + k, None, None, None) for k in range(3)]
    return rows


@pytest.mark.parametrize("block", [64, 3])
def test_query_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rows = rows_of(block)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS copies", "'x' AS cost").repartition(5)
    got = {tuple(r) for r in R.repair_digest(df).collect()}
    assert got == brute(rows)


def test_all_rows_dropped_and_empty_table(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in R.repair_digest(df).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert R.repair_digest(df.limit(0)).count() == 0
