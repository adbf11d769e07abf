"""Licence scan against a plain version."""

import random
import re
from collections import Counter

import pytest

from skyweave.llm import license_scan as ls


def brute(rows):
    out, seen = {}, set()
    for doc, text in rows:
        if text is None or (doc, text) in seen:
            continue
        seen.add((doc, text))
        parts = {text, *re.split(r"\n\s*\n", text), *text.split("\n")}
        for segment in {" ".join(re.sub(r"[\W_]+", " ", p.lower()).split()) for p in parts}:
            grams = set(ls.plain_here(segment))
            scores = []
            for k, (name, said) in enumerate(ls.TEMPLATES):
                own = set(ls.plain_here(said))
                c = len(grams & own)
                if c and 200 * c >= ls.PERCENT * (len(grams) + len(own)):
                    scores.append((-c / (len(grams) + len(own)), name, k, 2000 * c // (len(grams) + len(own))))
            if scores:
                _, name, _, pm = min(scores)
                n, best = out.get((doc, name), (0, 0))
                out[doc, name] = n + 1, max(best, pm)
    return sorted(((d, n, *v) for (d, n), v in out.items()), key=repr)


def test_license_scan(spark):
    full = [t for _, t in ls.TEMPLATES]
    rows = [(k, f"Some prose here.\n{t}\nMore prose.") for k, t in enumerate(full)]
    rows += [(100 + k, t) for k, t in enumerate(full)] + [(200 + k, "\n\n".join(t.split(". "))) for k, t in enumerate(full)]
    rows += [(300, None), (301, ""), (302, "MIT"), (303, "released under the mit"), (304, "RELEASED under, the   MIT-license!\n" * 3), (304, "RELEASED under, the   MIT-license!\n" * 3), (None, full[0]), (305, "word " * 40_000 + "\n" + full[0]), (306, full[0] + "\n" + full[17]), (307, "Licensed under CC BY-NC 3.0"), (308, "released under the license of the MIT")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license string, n int").repartition(3)
    got = sorted(map(tuple, ls.scan(df).collect()), key=repr)
    assert got == brute(rows)
    found = Counter(d for d, *_ in got)
    assert all(found[k] and found[100 + k] for k in range(len(full))) and found[304] == 1
    assert ls.scan(df.limit(0)).count() == 0


def test_notices_that_fill_no_line_or_paragraph(spark):
    """Notices of several paragraphs or wrapped lines in longer documents, and sentences within a line of prose."""
    texts = dict(ls.TEMPLATES)
    prose = "\n".join(f"Line {k} tells of maps and rivers and of nothing else at all." for k in range(20))
    apache = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
    bsd2, bsd3 = next(t for n, t in ls.TEMPLATES if n == "BSD-2-Clause"), next(t for n, t in ls.TEMPLATES if n == "BSD-3-Clause")
    apart = lambda t: t.replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ")
    gpl = "This article is about maps. This work is licensed under the GNU General Public License, version 3. Please read on, there is more of it."
    rows = [(1, f"{prose}\n\n{apache}\n\n{prose}"), (2, f"{prose}\n\n{apart(bsd3)}\n\n{prose}"), (3, f"{prose}\n{apart(bsd2)}\n{prose}"), (4, gpl), (5, f"{prose}\n{gpl}\n{prose}"), (None, gpl)]
    rows += [(6, f"{apart(bsd3)}\n\n{prose}\n\n{apart(bsd2)}. {gpl}"), (7, prose), (8, "Please. Licensed under CC BY-NC 3.0, under the source. More."), (4, gpl), (9, texts["Unlicense"] + " " + prose)]
    got = sorted(((r.doc_id, r.license, r.n_segments) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    want = [(1, "Apache-2.0", 1), (2, "BSD-3-Clause", 1), (3, "BSD-2-Clause", 1), (4, "GPL-3.0", 1), (5, "GPL-3.0", 1), (None, "GPL-3.0", 1), (6, "BSD-3-Clause", 1), (6, "BSD-2-Clause", 1), (6, "GPL-3.0", 1), (9, "Unlicense", 1)]
    assert got == sorted(want, key=repr)


def units(text):
    return [u for x in re.split(r"\n|(?<=[.!?;:])\s+", text) if (u := " ".join(re.sub(r"[\W_]+", " ", x.lower()).split()))]


def brute_runs(rows, percent=ls.PERCENT):
    """All runs of units against all templates: the licence of each run that reaches one, the best if several."""
    out = set()
    known = [(name, {tuple(g.split(" ")) for g in ls.plain_here(said)}, len(re.sub(r"[\W_]+", " ", said).split()) * (200 - percent) // percent) for name, said in ls.TEMPLATES]
    for doc, text in rows:
        u = units(text or "")
        for i in range(len(u)):
            for j in range(i, len(u)):
                words = " ".join(u[i : j + 1]).split()
                grams = set(zip(words, words[1:]))
                scores = [(-len(grams & own) / (len(grams) + len(own)), name) for name, own, most in known if len(words) <= most and 200 * len(grams & own) >= percent * (len(grams) + len(own))]
                if scores:
                    out.add((doc, min(scores)[1]))
    return out


def inner(found):
    """Without licences whose template another found one holds: which of both a document shows is settled by their runs."""
    return {(d, n) for d, n in found if not any((d, b) in found for a, b in ls.holding() if a == n)}


def test_runs_against_all_runs(spark):
    """Notices cut, wrapped and shortened at random among prose: the licences that any run reaches, and no others."""
    r = random.Random(11)
    short = [(n, t) for n, t in ls.TEMPLATES if len(t.split()) < 60]
    prose = ["maps and rivers", "the source is here", "under the bridge without version", "provided that you read on", "free of charge", "this software is old."]
    rows = []
    for k in range(120):
        parts = [r.choice(prose) for _ in range(r.randrange(6))]
        for _ in range(r.choice([0, 1, 1, 2])):
            w = r.choice(short)[1].split()
            for _ in range(r.choice([0, 0, 1, 3])):
                w.pop(r.randrange(len(w)))
            at = r.randrange(len(w))
            parts.insert(r.randrange(len(parts) + 1), " ".join(w[:at]) + r.choice([" ", "\n", ". ", ": "]) + " ".join(w[at:]))
        rows.append((k, r.choice([" ", "\n", ". "]).join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.license) for x in ls.scan(df).collect()}
    want = brute_runs(rows) | {(d, n) for d, n, *_ in brute(rows)}
    assert inner(got) == inner(want) and got <= want and len(got) > 60


def test_planted_notices_are_found(spark):
    """Recall of notices, full texts too, in prose of all kinds: wrapped at any width, as comments, one word in 25 changed."""
    r = random.Random(12)
    words = [f"word{k}" for k in range(300)] + ["under", "the", "source", "without", "version", "software", "license"]
    rows, planted = [], []
    for k in range(150):
        name, text = r.choice(ls.TEMPLATES)
        said = [x if r.random() > 0.04 or len(text.split()) < 15 else r.choice(words) for x in text.split()]
        style = r.randrange(4)
        if style == 0:
            body = " ".join(said)
        else:
            width, lead = r.randrange(4, 14), ["", "# ", " * "][style - 1]
            body = "\n".join(lead + " ".join(said[i : i + width]) for i in range(0, len(said), width))
        around = lambda: ". ".join(" ".join(r.choices(words, k=r.randrange(3, 25))) for _ in range(r.randrange(1, 12)))
        rows.append((k, f"{around()}. {body} {around()}" if style == 0 else f"{around()}\n{body}\n{around()}"))
        planted.append((k, name))
    clean = [(1000 + k, ". ".join(" ".join(r.choices(words, k=12)) for _ in range(30))) for k in range(60)]
    got = {(x.doc_id, x.license) for x in ls.scan(spark.createDataFrame(rows + clean, "doc_id long, text string").repartition(3)).collect()}
    assert sum(p in got for p in planted) >= 0.9 * len(planted)
    assert not any(d >= 1000 for d, _ in got)


@pytest.mark.parametrize("lines", [["under the source line"] * 2000, [f"plain words of line {k}" if k % 100 else "without any version" for k in range(1500)]])
def test_prose_with_anchors_makes_few_runs(spark, lines):
    text = "\n".join(lines)
    made = ls.runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    from pyspark.sql import functions as F

    n = made.agg(F.coalesce(F.sum(F.length("segment")), F.lit(0))).first()[0]
    assert n < 20 * len(text)


def test_texts_of_a_folder(spark, tmp_path):
    said = " ".join(f"clause{k} of the long licence" for k in range(50))
    (tmp_path / "Long-1.0.txt").write_text(said)
    known = ls.with_texts(spark, str(tmp_path))
    assert len(known) == len(ls.TEMPLATES) + 1 and known[-1] == ("Long-1.0", said)
    df = spark.createDataFrame([(1, "before\n" + said.replace(" of ", "\nof ") + "\nbehind"), (2, said[:400])], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in ls.scan(df, known).collect()] == [(1, "Long-1.0")]
