import re

from wavedeck.llm.license_scan import Scanner, scan_licenses
from wavedeck.llm.queries import op1_license_scan

SCAN = Scanner().scan
BASE = {"mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), places


def test_base_places_are_brute_force(spark, sf_dir, documents):
    got = {r.doc_id: r for r in op1_license_scan(spark, sf_dir).collect()}
    for r in documents.collect():
        n, places = brute(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base) == (n, len(places))
        assert (g.first_word, g.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert g.base_labels == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(filter(None, g.labels.split(",")))


def test_edits_and_spans():
    text = "É — Released under the MIT  Licnse; Apach-License Version 2 and cc by nd"
    n, hits = SCAN(text)
    assert n == brute(text)[0]
    assert [(h["label"], h["edits"], h["base"]) for h in hits] == [("mit", 1, False), ("apache-2", 1, False)]
    assert [text[h["start"] : h["stop"]] for h in hits] == ["MIT  Licnse", "Apach-License Version 2"] == [h["matched"] for h in hits]


def test_every_place_within_the_edits_is_found():
    for phrase, label in (("mit license", "mit"), ("gnu general public license", "gpl")):
        for i in range(len(phrase)):
            for changed in (phrase[:i] + phrase[i + 1 :], phrase[:i] + "q" + phrase[i + 1 :], phrase[:i] + "q" + phrase[i:]):
                hits = SCAN(f"under {changed} terms")[1]
                if " " not in (phrase[i], changed[i : i + 1]):
                    assert [(h["label"], h["edits"]) for h in hits] == [(label, 1)], changed


def test_overlapping_places_all_count():
    assert [h["first_word"] for h in SCAN("cc by nc cc by nc by nc")[1]] == [0, 3]
    assert SCAN("mit mit license license mit license")[0] == 6
    assert [h["first_word"] for h in SCAN("mit mit license license mit license")[1] if h["base"]] == [1, 4]


def test_rows(odd, empty, odd_docs):
    got = sorted((r.doc_id or -1, r.n_words) for r in scan_licenses(odd).collect())
    assert got == sorted((d[0] or -1, brute(d[1])[0]) for d in odd_docs)
    assert scan_licenses(empty).count() == 0


def test_bytes_that_are_no_text(spark):
    texts = [b"mit license\xff cc by-nc", b"\xed\xa0\x80 MIT License", b"\xc3\x89 mit license"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) as text")
    got = {r.doc_id: (r.n_words, [(h.first_word, h.label) for h in r.hits if h.base]) for r in scan_licenses(rows).collect()}
    assert got == {i: brute(t.decode(errors="replace")) for i, t in enumerate(texts)}
    assert got[0] == (5, [(2, "cc-by-nc")])


def test_very_many_hits_in_one_text():
    """Work follows the text and its hits: twice the text, about twice the time."""
    import time

    from wavedeck.llm.license_scan import Scanner

    scan, took = Scanner().scan, []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        words, hits = scan("MIT license, mit lisense; " * n)
        took.append(time.perf_counter() - began)
        assert words == 4 * n and sum(h["base"] for h in hits) == n
        assert [h["first_word"] for h in hits if h["base"]] == list(range(0, 4 * n, 4)) and sum(not h["base"] for h in hits) >= n - 1
    assert took[1] < 10 * took[0]
