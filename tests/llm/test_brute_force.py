"""Licence scans and decontamination against plain versions over all places."""

import random
import re

import pytest

from sitelens.llm import decontaminate, license_scan

PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~\s]+")


def tokens(text):
    return [t for t in PUNCTUATION.split((text or "").lower()) if t]


def tiling(text, item, size):
    """Tokens of ``item`` covered: the longest match of free tokens anywhere, the first of equals, until none of ``size`` is left."""
    a, b = tokens(text), tokens(item)
    taken_a, taken_b, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in taken_a and j + n not in taken_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < size:
            return len(b), tiles
        tiles.append(n)
        taken_a.update(range(i, i + n))
        taken_b.update(range(j, j + n))


@pytest.mark.parametrize("seed", range(3))
def test_tiling_is_that_of_all_places(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(6 if seed == 0 else 40)]  # few words: matches overlap and tie all the time
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for i in range(12)] + [(90, ""), (91, None), (92, "a a a a a a")]
    docs = []
    for d in range(25):
        parts = [rng.choice(items)[1] or "" for _ in range(2)] + [" ".join(rng.choice(words) for _ in range(6))]
        cut = [p for part in parts for p in (part[: len(part) // 2], part[len(part) // 2 :])]
        rng.shuffle(cut)
        docs.append((d, rng.choice([", ", " ", ".\n"]).join(cut)))
    docs += [(50, None), (51, ""), (52, "A a, a! a"), (52, "A a, a! a")]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = []
    for d, text in docs:
        for i, item in items:
            n, tiles = tiling(text, item, 3)
            if n >= 3 and sum(tiles) >= 0.5 * n:
                want.append((d, i, round(sum(tiles) / n, 9), sum(tiles)))
    assert sorted((r.doc_id, r.item_id, round(r.coverage, 9), r.covered) for r in got.collect()) == sorted(want)


def test_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), none).count() == 0


def shingles(text):
    words = re.findall(r"\S+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_notices_by_containment(spark):
    rng = random.Random(4)
    templates = [(f"L{k}", " ".join(f"t{k}x{i}" for i in range(n))) for k, n in enumerate((9, 30, 75, 160))]
    filler = [f"f{i}" for i in range(300)]
    docs, want = [], set()
    for d in range(160):
        name, text = rng.choice(templates)
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 2])):  # words at the edges, so what is left hangs together
            words = words[1:] if rng.random() < 0.5 else words[:-1]
        around = [rng.choice(filler) for _ in range(rng.randrange(0, 200))]
        at = rng.randrange(len(around) + 1)
        docs.append((d, " ".join([*around[:at], *words, *around[at:]])))
    for d, text in docs:
        own = shingles(text)
        for name, template in templates:
            held = shingles(template)
            if len(own & held) >= 0.8 * len(held):
                want.add((d, name, round(len(own & held) / len(held), 9)))
    got = license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), templates)
    assert {(r.doc_id, r.license, round(r.containment, 9)) for r in got.collect()} == want and len(want) > 50
