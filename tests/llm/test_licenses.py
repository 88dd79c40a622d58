import math
from collections import Counter

from pyspark.sql import functions as F

from tracery.llm import licenses


def brute(text, is_file, n, df):
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for ts in licenses.TEMPLATES.values() for t in ts for w in licenses.words(t)}
    weigh = lambda t: {w: k * idf.get(w, math.log(1 + n) + 1) for w, k in Counter(licenses.words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = (None, 0.0)
    for passage in ([text] if is_file else []) + licenses._BREAK.split(text):
        v = weigh(passage)
        for name, texts in licenses.TEMPLATES.items():
            for t in texts:
                u = weigh(t)
                cos = sum(x * v.get(w, 0) for w, x in u.items()) / ((norm(u) * norm(v)) or 1)
                if cos >= licenses.THRESHOLD and cos > best[1] + 1e-12:
                    best = (name, cos)
    return best


def test_every_template_finds_itself_and_strong_words_lose_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in docs.collect()]
    n, df = licenses.frequencies(docs, licenses.TEMPLATES)
    assert n == len(texts) and df["the"] == sum("the" in licenses.words(t) for t in texts)
    m = licenses.Matcher(licenses.TEMPLATES, n, df)
    for name, own in licenses.TEMPLATES.items():
        for t in own:
            assert m.best(f"Some words here.\n{t}.\nMore words.", False)[0] == name
    for t in [*texts, "", "Licensed under Apache.", "MIT", "the the version"]:
        a, b = m.best(t, False), brute(t, False, n, df)
        assert a[0] == b[0] and math.isclose(a[1], b[1], abs_tol=1e-9)


def test_documents_with_license_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan_documents(docs).collect()}
    assert len(got) == docs.count()
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in docs.collect():
        has = [v for k, v in lines.items() if k in (r.text or "").split("\n")]
        assert (got[r.doc_id].own_license in has) if has else got[r.doc_id].own_license is None
    assert any(r.own_license for r in got.values())


def test_nearest_directory_wins(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [("LICENSE", mit), ("a/LICENSE.txt", apache), ("a/b/c.py", "x"), ("a/b/d.py", f"y\n{mit}"), ("z/y.py", None), ("top.py", ""), (None, "x"), ("a/COPYING", mit), ("q/r/LICENSE", "no licence"), ("q/r/s.py", "x" * 200_000)]
    files = spark.createDataFrame([(*r, "k") for r in rows], "path string, text string, license string")
    got = {r.path: (r.license, r.licensed_by, r.levels_up) for r in licenses.scan_files(files).collect()}
    assert got["a/b/d.py"] == ("MIT", "own", 0) and got["z/y.py"] == ("MIT", "", 2) and got["top.py"][:2] == ("MIT", "")
    assert got["a/b/c.py"] == ("Apache-2.0", "a", 2) and got[None] == (None, None, None) and got["q/r/s.py"][0] == "MIT"
    assert licenses.scan_files(files.union(files)).count() == 2 * len(rows)
    assert licenses.scan_files(files.limit(0)).count() == 0
    kept = licenses.scan_files(files, F.col("license").alias("was"))
    assert kept.columns == ["was", "path", "own_license", "own_score", "license", "licensed_by", "levels_up"]
    clash = licenses.scan_files(files, F.col("license"), F.col("path").alias("dir"))
    assert clash.columns[:3] == ["license_", "dir_", "path"] and {r.license_ for r in clash.collect()} == {"k"}


def test_inheritance_on_the_table(spark, sf):
    """Every document's licence from its directory, by walking up by hand."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in licenses.scan_documents(docs).collect()}
    files = {i: r.path for i, r in got.items()}
    for r in docs.collect():
        top, i = f"{r.source}/{r.doc_id // 512}", r.doc_id
        assert files[i] == (f"{top}/LICENSE" if i % 512 == 0 else f"{top}/{i // 16}/LICENSE" if i % 16 == 0 else f"{top}/{i // 16}/{i}.txt")
    given = {}
    for i, path in sorted(files.items(), key=lambda x: (-got[x[0]].own_score, got[x[0]].own_license or "")):
        if path.endswith("/LICENSE") and got[i].own_license:
            given.setdefault(path.rpartition("/")[0], got[i].own_license)
    for i, path in files.items():
        want, folder, up = (got[i].own_license, "own", 0) if got[i].own_license else (None, None, None), path.rpartition("/")[0], 1
        while want[0] is None and folder:
            if folder in given:
                want = (given[folder], folder, up)
            folder, up = folder.rpartition("/")[0], up + 1
        assert (got[i].license, got[i].licensed_by, got[i].levels_up) == want
