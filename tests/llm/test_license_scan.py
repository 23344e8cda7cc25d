from collections import Counter

from rasterloom.llm.license_scan import _WORD, TEMPLATES, THRESHOLD, license_scan, op3_license_scan

D = "/root/testdata/sf0.01"


def plain(text):
    """Every unit against every template, no bounds."""
    lines, units, held = (text or "").split("\n"), [text or ""], []
    for x in [*lines, ""]:
        if _WORD.findall(x.lower()):
            held.append(x)
        elif held:
            units, held = [*units, "\n".join(held)], []
    units += lines
    best = (0.0, "")
    grams = lambda t: Counter(zip(w := _WORD.findall(t.lower()), w[1:]))
    for u in units:
        a = grams(u)
        for name, t in TEMPLATES.items():
            b = grams(t)
            d = 2 * (a & b).total() / max(1, a.total() + b.total())
            if a and d >= THRESHOLD:
                best = min(best, (-d, name))
    return (best[1] or None, -best[0] or 0.0)


def test_equals_plain_search(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(300).collect()
    found = {r.doc_id: (r.license, r.dice) for r in license_scan(spark.createDataFrame([(r.doc_id, r.text) for r in docs], "doc_id long, text string")).collect()}
    assert found == {r.doc_id: plain(r.text) for r in docs}


def test_finds_planted_lines(spark):
    found = op3_license_scan(spark, D)
    lines = spark.read.parquet(f"{D}/documents.parquet").filter("text LIKE '%Released under the MIT License%' OR text LIKE '%Licensed under CC BY-NC%'").select("doc_id")
    assert lines.count() > 0 and lines.join(found, "doc_id").filter("license IS NULL").count() == 0
    assert found.filter("license IS NOT NULL").count() < 0.2 * found.count()


def test_defined_cases(spark):
    mit = TEMPLATES["MIT text"]
    rows = [(1, None, "x"), (2, "", "x"), (None, "one", "x"), (3, mit, "x"), (3, mit, "x"), (4, "intro\n\n" + mit.replace(". ", ".\n") + "\n\nend", "x"), (5, "word " * 200_000, "x"), (6, "RELEASED under the mit license!", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted((r.doc_id or 0, r.license or "", r.dice) for r in license_scan(df).collect())
    assert got == [(0, "", 0.0), (1, "", 0.0), (2, "", 0.0), (3, "MIT text", 1.0), (3, "MIT text", 1.0), (4, "MIT text", 1.0), (5, "", 0.0), (6, "MIT", 1.0)]
    assert license_scan(df.filter("false")).count() == 0


def test_notices_across_and_inside_units(spark):
    """Licence texts over several paragraphs of a source file, and notices within longer lines."""
    mit, bsd, code = TEMPLATES["MIT text"], TEMPLATES["BSD-3-Clause"], "\n".join(f"def f{k}(x): return x * {k} + g{k}(x)" for k in range(200))
    for cut in ("The above copyright", "THE SOFTWARE IS PROVIDED"):
        mit = mit.replace(cut, "\n\n" + cut)
    bsd = bsd.replace("Redistributions", "\n\n * Redistributions").replace("THIS SOFTWARE", "\n\nTHIS SOFTWARE")
    mixed = TEMPLATES["Zlib"].replace(". ", ".\n")
    prose = "We wrote this tool over many years and it is released under the MIT License so that all can use it freely at home or at work."
    rows = [(1, f"Copyright 2020 A. Author\n\n{mit}\n\n{code}"), (2, f"{code}\n\n{bsd}\n\n{code}"), (3, f"{code}\n{mixed}\n{code}"), (4, prose), (5, code)]
    for k, name in enumerate(("AGPL header", "LGPL header", "BSD-2-Clause"), 6):
        rows.append((k, TEMPLATES[name] + "\n" + code))
    got = {r.doc_id: (r.license, r.dice) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {1: "MIT text", 2: "BSD-3-Clause", 3: "Zlib", 4: "MIT", 6: "AGPL header", 7: "LGPL header", 8: "BSD-2-Clause"}
    assert got == {5: (None, 0.0)} | {k: (n, 1.0) for k, n in want.items()}
