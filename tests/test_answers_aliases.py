"""Marginal relevance, alias resolution and DOCX files on rows made by hand."""

from __future__ import annotations

import random
import re
import zipfile

from pyspark.sql import functions as F

from quillgraph.operators import aliases, answers
from quillgraph.sources import office
from quillgraph.sources.tables import materialized


def words(text):
    return set(re.findall(r"[^\W_]+", text.lower()))


def greedy(rows, query, n, weight):
    """(section_id, content, score) rows to the sentences taken, in plain Python."""
    top, asked, rest = max(s for *_, s in rows), words(query), []
    for sid, content, score in rows:
        for k, sentence in enumerate(re.split(r"(?<=[.!?])\s+", content)):
            if words(sentence):
                rest.append((sid, k, sentence, len(words(sentence) & asked) / max(1, len(asked)) * score / top))
    taken = []
    while rest and len(taken) < n:
        like = lambda r: max((len(words(r[2]) & words(t[2])) / len(words(r[2]) | words(t[2])) for t in taken), default=0.0)  # noqa: E731, B023
        best = min(rest, key=lambda r: (-round(weight * r[3] - (1 - weight) * like(r), 9), r[0], r[1]))
        rest.remove(best)
        taken.append(best)
    return [(t[0], t[1], t[2]) for t in taken]


def test_sentences_of_several_sources(spark):
    rows = [
        ("a", "The cat sat here. The cat sat here! A dog ran away? ", 3.0), ("b", "The cat sat here. Birds fly over the cat.\nNo stop", 2.0),
        ("c", "Nothing of it... the cat, a dog and birds", 1.0), ("d", " . !", 0.5),
    ]
    found = answers.sentences(spark.createDataFrame(rows, "_id string, content string, relevance_score double"))
    for n, weight in ((1, 0.7), (3, 0.7), (4, 0.3), (9, 1.0)):
        got = answers.marginal_sentences(found, "where do the cat and birds sit", n, weight).orderBy("place").collect()
        assert [(r.section_id, r.nth, r.sentence) for r in got] == greedy(rows, "where do the cat and birds sit", n, weight)
    first = answers.marginal_sentences(found, "the cat sat here", 2, 0.4).orderBy("place").collect()
    assert first[0].sentence == "The cat sat here." and words(first[1].sentence) != words(first[0].sentence)
    assert answers.marginal_sentences(found.filter("false"), "cat").count() == 0
    assert answers.marginal_sentences(found, " ?").count() == 3


def edited(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slip(rnd, name):
    at = rnd.randrange(len(name))
    c = rnd.choice("abcdefghij")
    return rnd.choice([name[:at] + name[at + 1 :], name[:at] + c + name[at:], name[:at] + c + name[at + 1 :]])


def test_near_names_equal_all_pairs(spark):
    """Also names of one letter over and over, and both edges of length."""
    rnd = random.Random(9)
    names = {"".join(rnd.choice("abcde") for _ in range(rnd.randint(7, 12))) for _ in range(60)} | {"a" * k for k in range(7, 13)} | {"abababab", "babababa", "ababababa"}
    names |= {slip(rnd, n) for n in sorted(names) for _ in range(2)}
    table = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    long = sorted(n for n in names if len(n) >= 8)
    for edits in (1, 2):
        want = {(a, b) for k, a in enumerate(long) for b in long[k + 1 :] if edited(a, b) <= edits}
        assert {(r.a, r.b) for r in aliases.near_names(table, edits).collect()} == want


def test_planted_slips_are_resolved(spark):
    rnd = random.Random(4)
    names = sorted({"".join(rnd.choice("aeinrstlodmu") for _ in range(rnd.randint(9, 14))) for _ in range(80)})
    planted = {}
    for n in names:
        wrong = slip(rnd, n)
        if wrong not in names and len(wrong) >= 8:
            planted[wrong] = n
    rows = [(n, rnd.randint(20, 60)) for n in names] + [(w, rnd.randint(1, 4)) for w in planted]
    found = {r.alias: r.name for r in aliases.corrected(spark.createDataFrame(rows, "name string, n long")).collect()}
    assert sum(found.get(w) == n for w, n in planted.items()) >= 0.9 * len(planted)
    assert not set(found) & set(names)
    chain = [("elephants", 90), ("elephantz", 20), ("elephanzz", 3), ("crocodile", 5)]
    found = {r.alias: r.name for r in aliases.corrected(spark.createDataFrame(chain, "name string, n long")).collect()}
    assert found == {"elephantz": "elephants", "elephanzz": "elephants"}
    assert aliases.corrected(spark.createDataFrame([], "name string, n long")).count() == 0


def test_initials(spark):
    names = spark.createDataFrame([("support vector machine",), ("random forest",), ("rare find",), ("tree",)], "name string")
    short = spark.createDataFrame([("SVM",), ("SVM",), ("RF",), ("T",), (None,)], "alias string")
    assert [tuple(r) for r in aliases.initialled(names, short).collect()] == [("support vector machine", "SVM")]


XML = '<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def test_docx_files(spark, tmp_path):
    def docx(name, body, part="word/document.xml"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(part, body)

    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    docx("good.docx", XML.format(f"<w:p>{run('One ')}{run('two é &amp; three')}</w:p><w:p/><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>"))
    docx("empty.docx", XML.format(""))
    docx("other.docx", "x", "word/other.xml")
    docx("broken.docx", "<w:document>")
    docx("entity.docx", '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
    (tmp_path / "no.docx").write_bytes(b"not a zip")
    (tmp_path / "notes.txt").write_text("left alone")
    files = materialized(office.docx_files(spark, str(tmp_path)), "docx")
    good, bad = office.parsed(files)
    assert {(r.filename, r.text) for r in good.collect()} == {("good.docx", "One two é & three\n\na\tb\nc"), ("empty.docx", "")}
    assert {r.filename for r in bad.collect()} == {"other.docx", "broken.docx", "entity.docx", "no.docx"} and bad.filter(F.col("error").isNull()).isEmpty()
    nothing = tmp_path / "none"
    nothing.mkdir()
    assert office.docx_files(spark, str(nothing)).count() == 0
