"""Prefix trie, structure repair and license scan against brute force, with nulls, ties, repeats, empties and clashing columns."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from remembrane.llm import licenses, repair, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, base string, n1 string, at string, block string, rows string, gone string, kind string, digest string, lot string, `first` string, seq string, n_chars string"


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame([(*r, *"abcdefghijklm") for r in rows], SCHEMA)


def some_turns(seed, convs, most, base=0):
    r, rows = random.Random(seed), []
    texts = ["hi.", "hi", "", " \t", "why?", "so be it! ", None, "Ünï 😀.", "stop\x85", "x" * 3000 + "."]
    for c in range(convs):
        for t in range(r.randint(1, most)):
            rows.append((base + r.choice((c, c, 3, 100 + c)), r.choice((t, t, t, t + 1, None)), r.choice(("user", "assistant", "system", "tool", "", None)), r.choice(texts)))
    return rows + rows[:5]


ODD = [(-150, 0, "user", "a"), (-100, 0, "user", "a"), (-7, 1, "user", "b"), (0, None, "system", "s"), (0, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "a"), (None, 0, "user", "a"), (12, 0, None, None)]


def crc(text):
    return zlib.crc32(text.encode())


def trie_by_hand(rows, sha):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, sha(f"{len(role)}:{role}{text}"), text))
    own = {c: [(x[1], x[3]) for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h, base = crc(str(c)) % 6, c - int(np.fmod(c, 100))
        paths[c] = tuple(own.get(base, [])[:h] + v[h:])
    nodes = {}
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    children = {n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes) for n in nodes}
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        yield (
            members[0], len(n), nodes[n[:-1]][0] if n else None, len(members), children[n], sum(children[m] == 0 for m in below),
            sum((len(nodes[m]) - 1) * len(m[-1][1]) for m in below if m), sha(",".join(str(c) for c in members if paths[c] == n)),
        )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("block", [10, 1])
def test_prefix_trie(turns, sha, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = ODD + some_turns(1, 60, 9) + some_turns(2, 30, 4, base=1000)
    got = [tuple(r) for r in trie.prefix_trie(turns(rows)).select(TRIE).collect()]
    assert sorted(got, key=str) == sorted(trie_by_hand(rows, sha), key=str)


def test_prefix_trie_of_copies_and_nothing(turns, sha):
    rows = [(c, t, "user", "same") for c in range(450) for t in range(7)]
    got = [tuple(r) for r in trie.prefix_trie(turns(rows)).select(TRIE).collect()]
    assert sorted(got, key=str) == sorted(trie_by_hand(rows, sha), key=str) and len(got) == 8
    assert trie.prefix_trie(turns([])).count() == 0


def repair_by_hand(initials, kinds):
    from functools import lru_cache

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(initials) and state in (0, 3) else []
        if inserted < 3:
            cost, audit = best(i, repair.PUT[state][1], inserted + 1)
            found.append((cost + 3, "I" + audit))
        if i < len(initials):
            cost, audit = best(i + 1, state, 0)
            found.append((cost + 4, "D" + audit))
            if kinds[i] in (repair.GOOD, repair.TRUNCATED):
                late = 3 * (kinds[i] == repair.TRUNCATED)
                if (to := repair.STEP.get(initials[i], {}).get(state)) is not None:
                    cost, audit = best(i + 1, to, 0)
                    found.append((cost + late, "K" + audit))
                cost, audit = best(i + 1, repair.PUT[state][1], 0)
                found.append((cost + 3 + late, "R" + audit))
        return min(found, default=(10**9, ""))

    return best(0, 0, 0)


def test_layers_give_the_least_repair():
    for n in range(5):
        for initials in itertools.product("suat", repeat=n):
            for kinds in ([0] * n, [3, 0, 1, 0][:n], [0, 2, 3, 3][:n]):
                assert repair.least_repair([*initials], bytes(kinds)) == repair_by_hand(initials, tuple(kinds))
    r = random.Random(3)
    for _ in range(2000):
        n = r.randint(5, 40)
        initials, kinds = tuple(r.choice("suaauux ") for _ in range(n)), tuple(r.choice((0, 0, 0, 1, 2, 3)) for _ in range(n))
        assert repair.least_repair([*initials], bytes(kinds)) == repair_by_hand(initials, kinds)


def test_long_conversations_are_repaired_in_linear_space():
    n = 200_000
    cost, audit = repair.least_repair(["u"] * n, bytes(n))
    assert (cost, len(audit)) == (3 * n // 2, n) and audit == "KR" * (n // 2)


def structure_by_hand(rows, sha):
    convs = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = crc(f"{' ' if c is None else c}:{' ' if turn is None else turn}") % 20
        kept = convs.setdefault(c, [])
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        kept += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    for c, kept in convs.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], sha(f"{len(x[1])}:{x[1]}{x[2]}")))
        seen, kinds = set(), []
        for _, role, text in kept:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            kinds.append(repair.BLANK if not bare else repair.DUPLICATE if (role, text) in seen else repair.GOOD if bare[-1] in ".!?" else repair.TRUNCATED)
            seen.add((role, text))
        initials = tuple(role[:1] for _, role, _ in kept)
        cost, audit = repair_by_hand(initials, tuple(kinds))
        lines, i, state = [], 0, 0
        for letter in audit:
            if letter in "IR":
                role, state = repair.PUT[state]
                lines.append(f"{role}:{kept[i][2] if letter == 'R' else ''}")
            elif letter == "K":
                state = repair.STEP[initials[i]][state]
                lines.append(f"{kept[i][1]}:{kept[i][2]}")
            i += letter != "I"
        known = [t for t, _, _ in kept if t is not None]
        yield (
            c, max(known) - min(known) + 1 - len(set(known)) if known else 0, *(kinds.count(k) for k in (repair.BLANK, repair.DUPLICATE, repair.TRUNCATED)),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, sha("\n".join(lines)),
        )


def test_structure_repair(turns, sha):
    rows = ODD + some_turns(4, 80, 9) + some_turns(5, 40, 3, base=1000)
    damaged = repair.damage(turns(rows))
    plans = repair.repair_plans(damaged)
    got = [tuple(r) for r in repair.repair_digests(damaged, plans).collect()]
    assert sorted(got, key=str) == sorted(structure_by_hand(rows, sha), key=str)
    turned = repair.repaired_turns(damaged, plans).where(F.col("seq").isNotNull()).collect()
    roles = {}
    for r in sorted(turned, key=lambda r: r.seq):
        roles[r.conv_id] = roles.get(r.conv_id, "") + r.role[:1]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values()) and roles
    none = repair.damage(turns([]))
    assert repair.repair_digests(none, repair.repair_plans(none)).count() == 0


LINES = [
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.",
    "cc by", "CC-BY all Rights\nreserved general public license", "the license of the mit", "gnu public general license version 3", "cc\x85by", "Ä cc by", "public license version 3 of the gnu general",
]


def scan_by_hand(text, having, total):
    words = licenses.words_of(text or "")
    base = [(at, label) for phrase, label in licenses.BASE.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
    score = lambda w: -np.log((total + 1) / (having.get(w, 0) + 1))
    labels, best = {label for _, label in base}, 1.0 if base else 0.0
    for label, notice, keys in licenses.NOTICES:
        want = licenses.words_of(notice)
        rare = [w for w in sorted(set(want), key=lambda w: (score(w), w)) if w in words][: licenses.RARE]
        for shift in range(-len(want), len(words)):
            agree = sum(any(words[shift + j] == w for j in range(len(want)) if want[j] == w and 0 <= shift + j < len(words)) for w in rare)
            share = sum(0 <= shift + j < len(words) and words[shift + j] == w for j, w in enumerate(want)) / len(want)
            if not rare or agree < min(licenses.AGREE, len(rare)) or share < licenses.SHARE:
                continue
            near = range(max(shift - licenses.SLACK, 0), shift + len(want) + licenses.SLACK + 1)
            if all(any(words[a : a + len(k)] == k and a + len(k) <= shift + len(want) + licenses.SLACK for a in near) for k in map(licenses.words_of, keys)):
                labels.add(label)
                best = max(best, share)
    at = [a for a, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({b for _, b in base})), ",".join(sorted(labels)), best


def test_license_scan(make, odd_rows):
    r = random.Random(6)
    texts = [*LINES, *[" ".join(r.choice([*LINES, "the", "und", "license"]) for _ in range(r.randint(0, 40))) for _ in range(60)]]
    texts += [notice for _, notice, _ in licenses.NOTICES] + ["x " * 20000 + LINES[0]]
    rows = [*odd_rows, *enumerate(texts, 100)]
    sets = [set(licenses.words_of(t or "")) for _, t in rows]
    having = {w: sum(w in s for s in sets) for w in set().union(*sets)}
    got = licenses.scan_licenses(make(rows)).drop("matches").collect()
    want = [(i, *scan_by_hand(t, having, len(rows))) for i, t in rows]
    assert sorted(map(str, (tuple(x)[:-1] for x in got))) == sorted(map(str, (x[:-1] for x in want)))
    assert np.allclose(sorted(x.score for x in got), sorted(x[-1] for x in want))
    found = {t: g for (_, t), g in zip(sorted(rows[len(odd_rows) :]), sorted((tuple(x) for x in got if x.doc_id and x.doc_id >= 100)), strict=True)}
    assert [found[t][6] for t in LINES[:5]] == ["cc-by,cc-by-nc", "gpl,gpl-3.0", "apache-2.0", "mit", "reserved"]
    for label, notice, _ in licenses.NOTICES:
        assert label in found[notice][6].split(",")


def test_license_scan_of_nothing(make, empty):
    assert licenses.scan_licenses(empty).count() == 0
    row = licenses.scan_licenses(make([(1, "a b")]), notices=[], base={}).first()
    assert (row.n_words, row.labels, row.score, row.first_word) == (2, "", 0.0, None)
