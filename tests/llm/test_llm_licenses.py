import math
import random
import re

import pytest

from cuesheet.llm import licenses

FILL = "the cat sat on a mat and saw permission software license version rights".split()


def tokens(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, template):
    """The highest share of the template's shingles in a stretch as long as the template."""
    words, own = tokens(text), tokens(template)
    size = min(5, len(own))
    wanted = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
    run = len(own) - size + 1
    found = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    return max((len(wanted & set(found[i : i + run])) / len(wanted) for i in range(len(found))), default=0)


def test_against_brute_force():
    rng, names = random.Random(3), list(licenses.TEMPLATES)
    scanner, rows, want = licenses.Scanner(licenses.TEMPLATES), [], {}
    for i in range(250):
        name = rng.choice(names)
        words = licenses.TEMPLATES[name].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 12])):
            words[rng.randrange(len(words))] = rng.choice(FILL)
        text = " ".join([*rng.choices(FILL, k=rng.randint(0, 150)), *words, *rng.choices(FILL, k=rng.randint(0, 150))])
        rows.append(text)
        for n, t in licenses.TEMPLATES.items():
            if brute(text, t) >= 0.8 - 1e-9:
                want[i, n] = brute(text, t)
    got = {(i, names[t]): share for i, t, share, _ in scanner.scan(rows)}
    assert set(want) <= set(got) and len(want) > 100
    for key in set(got) - set(want):  # a window is somewhat longer than the template
        assert got[key] >= 0.8
    assert all(got[k] >= v - 1e-9 for k, v in want.items())


def test_bands_keep_misses_below_the_bound():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for size, width, step, tables in scanner.plans:
        for i, s in enumerate(scanner.sets):
            if any(i in members for _, members in tables[:1]):
                floor = scanner.need(i) / (width + len(s) - scanner.need(i))
                assert (1 - floor**scanner.rows) ** len(tables) <= licenses.MISS * (1 + 1e-9)
        assert width >= step and size <= 5


def test_places_and_edges(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [
        (1, "x " * 7 + mit.upper()), (2, None), (3, ""), (4, "..."), (5, "All rights"), (6, "all RIGHTS, reserved"), (6, "all RIGHTS, reserved"),
        (None, mit), (8, ("word " * 70_000) + mit + " " + "word " * 70_000), (9, "Released under the"), (10, "MIT License"),
    ]
    df = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license, r.containment, r.first_word) for r in licenses.scan_licenses(df).collect()), key=str)
    want = [(1, "MIT", 1.0, 7), (6, "All-rights-reserved", 1.0, 0), (6, "All-rights-reserved", 1.0, 0), (None, "MIT", 1.0, 0), (8, "MIT", 1.0, 70_000)]
    assert got == sorted(want, key=str)


def test_other_templates_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma")], "doc_id long, text string")
    got = licenses.scan_licenses(df, {"t": "Beta; gamma", "none": "?!", "other": "alpha gamma"}).collect()
    assert [(r.license, r.containment, r.first_word) for r in got] == [("t", 1.0, 1)]
    assert licenses.scan_licenses(df.limit(0)).count() == 0 and licenses.scan_licenses(df, {}).count() == 0


@pytest.mark.parametrize("share", [0.5, 1.0])
def test_contained_share(share):
    template = " ".join(f"w{i}" for i in range(14))  # ten shingles
    scanner = licenses.Scanner({"t": template}, contained=share)
    for cut in range(0, 10):
        text = " ".join(template.split()[cut:]) + " z z z"
        found = list(scanner.scan([text]))
        assert bool(found) == (10 - cut >= math.ceil(10 * share)), cut
