"""Settings, manifest rules, characters to words, ruled tables, diagnostics, readiness."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.functions import text
from lorebase.operators import corpus, evaluation, layout, snapshot
from lorebase.settings import Settings, settings

SHA = "a" * 64
GOOD = {
    "id": "a", "title": "T", "authority": "A", "competition_scope": ["g"], "edition": "e", "source_url": "https://h/x", "discovery_url": "https://h", "allowed_hosts": ["h"], "effective_from": dt.date(2020, 1, 1),
    "verified_on": dt.date(2020, 1, 1), "verification": "current", "ingest_phase": 2, "coverage": ["x"], "sha256": SHA, "corrections": [{"section_key": "s", "url": "https://h/c", "anchor": "c-1", "sha256": SHA}],
}


def test_settings_have_bounds():
    assert settings({"timeout_seconds": "10", "gpu_layers": "3", "HOME": "/"}) == Settings(3, 10.0)
    for bad in ({"gpu_layers": "-2"}, {"timeout_seconds": "0.5"}, {"timeout_seconds": "601"}, {"max_output_tokens": "255"}, {"dimensions": "385"}, {"dimensions": "many"}):
        with pytest.raises(ValueError):
            settings(bad)


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        ({}, []),
        ({"download_url": "http://h/x"}, ["download_url"]),
        ({"discovery_url": "https://other/x"}, ["discovery_url"]),
        ({"source_url": None, "edition": None}, ["edition", "source_url"]),
        ({"verification": "perhaps", "ingest_phase": 6, "coverage": []}, ["coverage", "phase", "verification"]),
        ({"effective_until": dt.date(2020, 1, 1), "sha256": "x"}, ["interval", "sha256"]),
        ({"corrections": [{"section_key": "s", "url": "https://evil/c", "anchor": "c-1", "sha256": SHA}]}, ["corrections"]),
        ({"corrections": None, "allowed_hosts": None}, ["discovery_url", "hosts", "source_url"]),
    ],
)
def test_source_rules(spark, change, broken):
    row = {n.split(" ")[0]: None for n in schemas.SOURCE.split(", corrections")[0].split(", ")} | {"corrections": None} | GOOD | change
    df = spark.createDataFrame([row], schemas.SOURCE)
    assert sorted(r.broken for r in corpus.breaks(df, corpus.source_rules()).collect()) == broken


def test_dates_and_bounds_of_requests(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(dt.date(2024, 7, 1), "é" * 100, "m", "r1", None)], "day date, said string, name string, revision string, none string")
    try:
        for other in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert df.select(F.unix_seconds(text.midnight(F.col("day")))).first()[0] == 1719792000
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert df.select(text.iso(text.midnight(F.col("day")))).first()[0] == "2024-07-01T00:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    room = lambda n: df.select(text.fits_context(F.lit("abc"), F.col("said"), n)).first()[0]
    assert room(32768 - 512 - 203) and not room(32768 - 512 - 202)
    assert tuple(df.select(text.pinned(F.col("name"), F.col("revision")), text.pinned(F.col("name"), F.col("none"))).first()) == ("m@r1", None)


def test_characters_become_words(spark):
    def chars(said, x, base, size=9.0, font="AB+Cambria", gap=0.5):
        out = []
        for c in said:
            out.append((1, c, x, x + 4.0, base, size, font))
            x += 4.0 + gap
        return out

    rows = chars("the ball", 40.0, 100.0) + chars("2", 77.0, 97.003, 6.0) + chars("far", 200.0, 100.5) + chars("fig", 300.0, 100.0, font="Other") + chars("head", 40.0, 25.0) + chars("huge", 40.0, 200.0, 12.0)
    rows += chars("ab", 40.0, 300.0) + chars("cd", 49.0, 300.0, font="AB+Cambria-Bold") + chars("wide", 40.0, 400.0, gap=2.0)
    df = spark.createDataFrame(rows, "page int, text string, x0 double, x1 double, baseline double, size double, fontname string")
    got = sorted((round(r.bottom, 1), r.x0, r.text) for r in layout.words_of(df, "Cambria|^FIG[+]").collect())
    assert [(b, t) for b, _, t in got] == [(100.0, "the"), (100.0, "ball2"), (100.5, "far"), (300.0, "ab"), (300.0, "cd"), (400.0, "w"), (400.0, "i"), (400.0, "d"), (400.0, "e")]
    assert layout.words_of(df.limit(0), "Cambria").count() == 0


def test_ruled_tables(spark):
    tables = spark.createDataFrame([(1, [10.0, 20.0, 30.0], 5.0, 3), (2, [10.0, 20.0, 30.0], 5.0, 3)], "cell_page int, columns array<double>, first double, edges int")
    rules = spark.createDataFrame([(1, 10.2, 20.1, t) for t in (2.0, 50.0, 50.04, 60.0, 70.0)] + [(1, 30.0, 40.0, 65.0), (2, 10.0, 20.0, 50.0)], "page int, x0 double, x1 double, top double")
    words = spark.createDataFrame([(1, t, x, x + 3, b - 8, b, "F") for t, x, b in [("a", 10.0, 60.0), ("b", 20.0, 55.0), ("c", 12.0, 61.0), ("out", 30.0, 55.0)]], "page int, text string, x0 double, x1 double, top double, bottom double, fontname string")
    grid = layout.ruled_cells(rules, tables)
    assert sorted((r.row_no, r.col_no, r.left, r.upper, r.lower) for r in grid.collect()) == [(0, 0, 10.0, 50.0, 60.0), (0, 1, 20.0, 50.0, 60.0), (1, 0, 10.0, 60.0, 70.0), (1, 1, 20.0, 60.0, 70.0)]
    filled = layout.table_cells(words, grid)
    assert {(r.row_no, r.col_no): r.cell for r in filled.collect()} == {(0, 0): "a", (0, 1): "b", (1, 0): "c"}
    assert sorted(tuple(r) for r in layout.table_faults(tables, grid, filled).collect()) == [(1, "empty cell"), (2, "geometry")]


def test_diagnosis_of_searches(spark):
    cases = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "query_id int, expected array<string>")
    results = spark.createDataFrame([("v", 1, "x", 1), ("v", 1, "b", 2), ("v", 2, "c", 6), ("h", 1, "a", 1), ("h", 2, "c", 4)], "mode string, query_id int, id string, rank int")
    made = spark.createDataFrame([("v", 1, 10), ("v", 2, 20), ("h", 1, 30), ("h", 2, 50), ("r", 1, 5)], "mode string, query_id int, latency_ms int")
    got = {r.mode: (r.hits, r.cases, r.mrr, r.median_ms) for r in evaluation.diagnosis(results, cases, made).collect()}
    assert got == {"v": (1, 2, 0.25, 15.0), "h": (2, 2, 0.625, 40.0), "r": (0, 1, 0.0, 5.0)}


def test_controls_of_answers(spark):
    cases = spark.createDataFrame([(c, s, e) for c, s, e in [("ok", ["answered"], ["s1"]), ("uncited", ["answered"], ["s1"]), ("refused", ["refused", "answered"], ["s1"]), ("free", ["answered"], []), ("wrong", ["answered"], []), ("lost", ["answered"], [])]], "case string, statuses array<string>, expected array<string>")
    answers = spark.createDataFrame([("ok", "answered", ["s1", "s2"]), ("uncited", "answered", ["s2"]), ("refused", "refused", []), ("free", "answered", []), ("wrong", "refused", [])], "case string, status string, cited array<string>")
    got = evaluation.controls(answers, cases)
    assert {r.case for r in got.collect() if r.passed} == {"ok", "refused", "free"}
    assert tuple(evaluation.pass_rate(got, 6).first()) == (False, 6)
    runs = spark.createDataFrame([("q", "f1", 3), ("q", "f1", 4), ("r", "f1", 1), ("r", "f2", 1), ("s", None, None), ("s", "f1", 2)], "question string, corpus_fingerprint string, latency_ms int")
    assert {r.question: (r.same_version, r.latency_ms) for r in evaluation.one_version(runs, "question").collect()} == {"q": (True, 7), "r": (False, 2), "s": (False, None)}


def test_readiness_of_a_store(spark, tmp_path):
    root = str(tmp_path / "store")
    none = {"version": False, "books": False, "chunks": False, "links": False, "postings": False, "embeddings": False}
    assert {r.part: r.ready for r in snapshot.readiness(spark, root).collect()} == none
    (tmp_path / "store" / "versions").mkdir(parents=True)
    (tmp_path / "store" / "CURRENT").write_text('{"version": "v1"}')
    assert {r.part: r.ready for r in snapshot.readiness(spark, root).collect()} == none
    (tmp_path / "store" / "versions" / "v1.json").write_text('{"books": [{"id": "a", "path": "books/a/1", "written": 1}]}')
    for name, kind in (("books", schemas.BOOKS), ("chunks", schemas.CHUNKS)):
        spark.createDataFrame([], kind).write.parquet(f"{root}/books/a/1/{name}")
    assert {r.part for r in snapshot.readiness(spark, root).collect() if r.ready} == {"version", "books", "chunks"}
