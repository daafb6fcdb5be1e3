"""Operators 1, 2 and 8 against brute force and by hand."""

import math
import re
import random

from riskweave.llm.decontamination import contained_items
from riskweave.llm.license_scan import BLANK, BODIES, COMMENTS, FRONT, HEADERS, NAMED, NOTICES, THRESHOLD, default_templates, licence_scan
from riskweave.llm.topk import top_k


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.random()]) for _ in range(rng.choice([6, 6, 4]))], "clash") for i in range(120)]
    rows += [(200, rows[0][1], "tie"), (250, None, ""), (300, [1.0, None], ""), (350, [float("nan")], ""), (400, [float("inf")], ""), (None, [1.0], ""), (450, [], "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    good = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:5]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    assert set(map(tuple, top_k(table).collect())) == want
    assert top_k(table.where("vec_id < 0")).count() == 0


def test_top_k_repeated_ids(spark):
    """Repeated ids: what a query's own id is stays out, in every row that has it."""
    rows = [(0, [1.0, 0.5]), (0, [0.25, 0.25]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [2.0, 0.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert got and all(r["query_id"] == 0 and r["vec_id"] != 0 for r in got)
    dot = lambda a, b: sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))
    scores = {(i, dot(q, v)) for n, q in rows if n == 0 for i, v in rows if i != 0}
    assert all((r["vec_id"], r["score"]) in scores for r in got)


def test_contained_items(spark):
    rng = random.Random(4)
    w = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(w(n))) for i, n in enumerate((14, 30, 59, 5, 40))] + [(5, "two words"), (6, None), (7, " "), (8, " ".join(["same"] * 20))]
    items.append((9, items[1][1]))
    docs = [(0, " ".join(w(3000))), (1, None), (2, "")]
    for i, t in items[:5]:
        docs.append((10 + i, " ".join([*w(200), *t.upper().split(), *w(5000)])))  # whole, in a long text
        half = t.split()
        docs.append((20 + i, " ".join([*w(50), *half[: len(half) // 2], *w(50)])))  # half of it
    a = items[2][1].split()
    docs.append((30, " ".join([*a[:30], *w(9), *a[27:]])))  # in two places
    docs += [(40, "see two  words here"), (40, "see two words here"), (None, items[0][1]), (41, "same " * 30)]
    got = {(r["doc_id"], r["item_id"]) for r in contained_items(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item int"), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def shingles(text, k):
        x = (text or "").lower().split()
        return {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}

    want = set()
    for i, t in items:
        k = min(5, len((t or "").split()))
        if k:
            s = shingles(t, k)
            want |= {(d, i) for d, x in docs if len(s & shingles(x, k)) >= math.ceil(0.8 * len(s) - 1e-9)}
    assert got == want and (12, 2) in got and (22, 2) not in got
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert contained_items(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contained_items(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_licences(spark):
    rows = [
        (1, "src/LICENSE", "Licensed under the Apache License, Version 2.0.\nmore text", "x"),
        (2, "src/a/one.py", "code\nReleased under the MIT License.\ncode", "x"),
        (3, "src/a/two.py", "plain text of the version", "x"),
        (4, "src/b/c/LICENSE", NOTICES["GPL-3.0"], "x"),
        (5, "src/b/c/d/deep.py", None, "x"),
        (6, "src/b/other.py", "", "x"),
        (7, "alone.py", "nothing here", "x"),
        (8, None, NOTICES["CC-BY-NC-4.0"], "x"),
        (9, None, "nothing", "x"),
        (2, "src/a/one.py", "code\nReleased under the MIT License.\ncode", "x"),
    ]
    table = spark.createDataFrame(rows, "file_id long, path string, text string, score string")
    got = sorted((r["file_id"], r["licence"], r["origin"], r["source_path"]) for r in licence_scan(table).collect())
    assert got == [
        (1, "Apache-2.0", "own", "src/LICENSE"), (2, "MIT", "own", "src/a/one.py"), (2, "MIT", "own", "src/a/one.py"), (3, "Apache-2.0", "inherited", "src/LICENSE"), (4, "GPL-3.0", "own", "src/b/c/LICENSE"),
        (5, "GPL-3.0", "inherited", "src/b/c/LICENSE"), (6, "Apache-2.0", "inherited", "src/LICENSE"), (7, None, "none", None), (8, "CC-BY-NC-4.0", "own", None), (9, None, "none", None),
    ]
    assert licence_scan(table.where("file_id < 0")).count() == 0
    assert all(r["score"] == 1.0 for r in licence_scan(spark.createDataFrame([(i, f"d{i}/f", t) for i, t in enumerate(NOTICES.values())], "file_id long, path string, text string")).collect())


def test_licence_files_and_headers(spark):
    prose = " ".join(f"word{i}" for i in range(400))
    apache = dict(HEADERS)["Apache-2.0"]
    wrapped = [" ".join(apache.split()[i : i + 12]) for i in range(0, len(apache.split()), 12)]
    rows = [(f"b{i}/LICENSE", f"Title of it\n\nCopyright (c) 2020 Jane Doe\n\n{text}", name) for i, (name, text) in enumerate(sorted(BODIES.items()))]
    rows += [(f"h{i}/f", f"{text}\n\n{prose}", name) for i, (name, text) in enumerate(HEADERS)]
    rows += [("c/a.py", "#!/bin/sh\n# " + "\n# ".join(wrapped) + f"\n{prose}", "Apache-2.0"), ("c/mit.c", "/*\n * " + BODIES["MIT"].replace("\n", "\n * ") + f"*/\nint x;\n{prose}", "MIT")]
    rows += [("s/a", f"// SPDX-License-Identifier: MIT\n{prose}", "MIT"), ("s/b", f"{prose}\nSPDX-License-Identifier:GPL-3.0-or-later", "GPL-3.0"), ("s/c", f"SPDX-License-Identifier: Unknown-1.0\n{prose}", None), ("o", prose, None)]
    table = spark.createDataFrame([(i, path, text) for i, (path, text, _) in enumerate(rows)], "file_id long, path string, text string")
    got = {r["file_id"]: r["licence"] if r["origin"] == "own" else None for r in licence_scan(table).collect()}
    assert {i: (rows[i][0], got[i]) for i in got} == {i: (path, want) for i, (path, _, want) in enumerate(rows)}


def test_common_words_beside_a_notice(spark):
    """Words that most files hold weigh little, so a notice among them is found; words that no other file holds weigh much."""
    common = "this project is a file see for details the under it was copyright written by us"
    notices = ["This project is released under the MIT license.", "This file is licensed under the MIT License; see LICENSE for details.", "Released under the MIT License. zorg blat quux fnord gleep wibble"]
    rows = [(i, f"d{i}/f", text) for i, text in enumerate(notices)] + [(10 + i, f"e{i}/f", f"{common} n{i}") for i in range(600)]
    got = licence_scan(spark.createDataFrame(rows, "file_id long, path string, text string"), {"MIT": "Released under the MIT License."}, 0.6).where("licence IS NOT NULL").collect()
    scores = {r["file_id"]: r["score"] for r in got}

    def terms(text):
        return [w.strip(".;").lower() for w in text.split()]

    def cosine(text):
        weight = {w: math.log((1 + len(rows)) / (1 + sum(w in terms(t) for _, _, t in rows))) + 1 for w in {*terms(text), *terms("Released under the MIT License.")}}
        vec = lambda x: {w: (1 + math.log(terms(x).count(w))) * weight[w] for w in set(terms(x))}
        a, b = vec(text), vec("Released under the MIT License.")
        return sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))

    want = {i: round(c, 6) for i, _, text in rows if (c := cosine(text)) >= 0.6}
    assert set(scores) == set(want) and all(abs(scores[i] - want[i]) < 2e-6 for i in want)
    assert {0} <= set(want) and 2 not in want, want


def test_inherited_licences(spark):
    mit = NOTICES["MIT"]
    rows = [
        ("a/LICENSE", f"Some words about this\n\nthing\n{mit}\nmore words here", "own", None), ("a/b/c", "x", "inherited", "a/LICENSE"),
        ("d/e.c", f"\n// Tool\n// Copyright 2020 Jane Doe\n\n// {mit}\nint x;", "own", None), ("d/f.c", "int y;", "inherited", "d/e.c"),
        ("g/x.c", f"int x;\n{mit}\nint y;", "own", None), ("g/y.c", "z", "none", None), ("h/last", f"int x;\n{mit}\n", "own", None), ("h/y", "z", "none", None),
        ("i/text", "The Project\n\nby us all\n\n" + BODIES["MIT"], "own", None), ("i/y", "z", "inherited", "i/text"),
        ("j/LICENSE", mit, "own", None), ("j/A.c", f"// {NOTICES['GPL-3.0']}", "own", None), ("j/y", "z", "inherited", "j/LICENSE"),
        ("k/license_scan.py", f"int x;\n{mit}\nint y;", "own", None), ("k/y", "z", "none", None),
    ]
    table = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "file_id long, path string, text string")
    got = {r["path"]: (r["origin"], r["source_path"] if r["origin"] == "inherited" else None) for r in licence_scan(table).collect()}
    assert got == {path: (origin, source) for path, _, origin, source in rows}


def test_query_inherits(spark):
    from riskweave.llm.registry import QUERIES

    got = QUERIES["op8_license_scan"](spark, "/root/testdata/sf0.001").collect()
    files = {r["path"]: r for r in got}
    heirs = [r for r in got if r["origin"] == "inherited"]
    assert heirs and any(r["path"].count("/") > r["source_path"].count("/") for r in heirs)  # from a directory above as well
    assert all(files[r["source_path"]]["origin"] == "own" and files[r["source_path"]]["licence"] == r["licence"] for r in heirs)


def plain_scan(files, closing):
    """``licence_scan`` over all templates, units and directories by loops: ``file_id -> licence, score, origin, source_path``."""
    front, comments = FRONT.replace("x{a9}", "xa9"), re.compile(COMMENTS)

    def terms(text):
        return re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", re.sub(r"spdx-license-identifier:[ \t]*", "spdx-license-identifier-", text.lower()))

    texts = [text or "" for _, _, text in files]
    held = [set(terms(t)) for t in texts]
    counts = {}
    for h in held:
        for t in h:
            counts[t] = counts.get(t, 0) + 1
    weight = lambda t: math.log((1 + len(files)) / (1 + counts.get(t, 0))) + 1

    def vector(words):
        v = {t: (1 + math.log(words.count(t))) * weight(t) for t in set(words)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    templates = [(name, text, vector(terms(text))) for name, text in default_templates()]
    needed = set()
    for _, _, v in templates:
        total = 0.0
        for t in sorted(v, key=lambda t: (weight(t), t)):
            total += v[t] ** 2
            if total >= THRESHOLD**2 * 0.999999:
                needed.add(t)

    def best(text):
        words = terms(text)
        v = vector(words) if words else {}
        return max(((round(sum(x * w.get(t, 0) for t, x in v.items()), 9), name, n) for n, (name, _, w) in enumerate(templates)), default=(0, "", 0)) if v else (0, "", 0)

    def edge(text, x):
        head = len(re.match(front, text).group())
        body, end = re.sub(front, "", x + "\n", count=1), x.rstrip(BLANK)
        at = x in text[: head + len(x)] and (body == "" or bool(needed & set(terms(body.split("\n")[0]))))
        return at or (closing and text.rstrip(BLANK).endswith(end) and bool(needed & set(terms(end.split("\n")[-1]))))

    own = []
    for text in texts:
        several = [x for x in [*re.split(r"\n\s*\n", text), *comments.findall(text)] if "\n" in x.strip(" ")]
        hits = []
        for x, whole in [*((x, False) for x in [*text.split("\n"), *several]), (text, True)]:
            score, name, n = best(x)
            if score >= THRESHOLD:
                hits.append((score, name, templates[n][1] in BODIES.values() if whole else edge(text, x)))
        top = max(((s, n) for s, n, _ in hits), default=None)
        own.append((*top, any(n == top[1] and stated for _, n, stated in hits)) if top else None)
    given = {}
    for (_, path, _), o in zip(files, own):
        if o and path is not None and (o[2] or re.search(NAMED, path)):
            place = path.rpartition("/")[0]
            given[place] = min(given.get(place, (True, "\uffff", "")), (not re.search(NAMED, path), path, o[1]))
    out = {}
    for (i, path, _), o in zip(files, own):
        if o:
            out[i] = (o[1], round(o[0], 6), "own", path)
            continue
        place, found = path.rpartition("/")[0] if path is not None else None, None
        while place is not None and not found:
            found = given.get(place)
            place = place.rpartition("/")[0] if place else None
        out[i] = (found[2], None, "inherited", found[1]) if found else (None, None, "none", None)
    return out


def test_licences_by_brute_force(spark):
    """Default templates, all units and inheritance against loops; ties of notices, a very long text, odd rows."""
    rng = random.Random(8)
    prose = lambda n: "\n".join(" ".join(rng.choice(["the", "of", "license", "software", f"w{rng.randrange(300)}"]) for _ in range(9)) for _ in range(n))
    stated = [*NOTICES.values(), *(t for _, t in HEADERS), "SPDX-License-Identifier: MIT", "SPDX-License-Identifier:LGPL-3.0-or-later", BODIES["MIT"], BODIES["ISC"], BODIES["BSD-3-Clause"]]
    files = []
    for n, text in enumerate(stated * 3):
        words = text.split()
        if n % 4 == 3:  # some words gone, some others between
            text = " ".join(rng.choice([w, w, w, w, f"x{rng.randrange(50)}"]) for w in words)
        if n % 3 == 1:
            text = "# " + "\n# ".join(text.split("\n"))
        shape = [f"{text}\n\n{prose(3)}", f"{prose(2)}\n\n{text}\n\n{prose(2)}", f"{prose(3)}\n{text}\n", f"Title\n\nCopyright (c) 2020 Jane Doe\n\n{text}"][rng.randrange(4)]
        files.append((n, f"{rng.choice('abc')}/{rng.choice('de')}/{rng.choice(['LICENSE', 'f.c', 'g.py'])}{n if n % 5 else ''}", shape))
    files += [(200 + n, f"{rng.choice('abcz')}/{rng.choice('dey')}/x/{n}.c", prose(4)) for n in range(40)]
    files += [(300, "t/tie", f"{NOTICES['MIT']}\n{NOTICES['BSD-3-Clause']}\n"), (301, "t/u", "x"), (302, "l/long", f"{prose(6000)}\n{NOTICES['MPL-2.0']}"), (303, "l/v", ""), (304, None, None), (305, None, NOTICES["MIT"]), (306, "root.c", "int x;"), (307, "one word", "license")]
    table = spark.createDataFrame([(*f, 0.5) for f in files], "file_id long, path string, text string, score double")
    for closing in (False, True):
        got = {r["file_id"]: (r["licence"], r["score"], r["origin"], r["source_path"]) for r in licence_scan(table, closing=closing).collect()}
        want = plain_scan(files, closing)
        off = {i: (got.get(i), w) for i, w in want.items() if got[i][0] != w[0] or got[i][2:] != w[2:] or abs((got[i][1] or 0) - (w[1] or 0)) > 2e-6}
        assert not off and len(got) == len(files), off
        assert got[300][0] == "MIT" and got[302][0] == "MPL-2.0" and {g[2] for g in got.values()} == {"own", "inherited", "none"}
