"""Versions that share their books' files, their postings, and the run log."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.operators import answering as an
from lorebase.operators import runlog, search, snapshot, textindex

DAY = dt.date(2020, 1, 1)


def book(spark, name, edition="1"):
    return spark.createDataFrame([(name, "T", "A", ["g"], edition, DAY, None, "https://x", "https://x", "0" * 64, None, None, "ready", "m", f"f{name}{edition}")], schemas.BOOKS)


def chunks(spark, name, edition="1", keys=("x", "y")):
    return spark.createDataFrame([(f"{name}-{edition}-{k}", name, edition, k, None, "section", "l", f"title {k}", ["h"], f"body of {name} {k}", None, 1, 1, [], "https://x", "https://x#1", None, None, [1.0, 0.5]) for k in keys], schemas.CHUNKS)


def links(spark, *pairs):
    return spark.createDataFrame([(a, b, "references", None) for a, b in pairs], schemas.LINKS)


def put(spark, root, name, edition="1", keys=("x", "y"), *pairs):
    return snapshot.replace_book(spark, root, book(spark, name, edition), chunks(spark, name, edition, keys), links(spark, *pairs))


def files(root):
    return {p for p in pathlib.Path(root).rglob("*.parquet")}


def ids(frame):
    return sorted(r[0] for r in frame.select("id").collect())


@pytest.fixture
def root(tmp_path):
    return str(tmp_path)


def test_a_publication_writes_its_own_book_only(spark, root):
    for name in "abcde":
        put(spark, root, name)
    before = files(root)
    version = put(spark, root, "b", "2")
    new = files(root) - before
    assert before <= files(root) and {p.relative_to(root).parts[1] for p in new} == {snapshot.manifest(spark, root, version)["b"].path.split("/")[1]}
    assert len(snapshot.manifest(spark, root, version)) == 5
    now = snapshot.open_version(spark, root)
    assert ids(now["chunks"]) == sorted([f"{n}-1-{k}" for n in "acde" for k in "xy"] + ["b-2-x", "b-2-y"])
    assert {r.id for r in now["postings"].select("id").distinct().collect()} == set(ids(now["chunks"])) and now["books"].count() == 5


def test_old_files_go_when_no_version_names_them(spark, root):
    first = put(spark, root, "a")
    put(spark, root, "b")
    put(spark, root, "a", "2")
    last = put(spark, root, "a", "3")
    assert snapshot.vacuum(spark, root, keep=2) == []  # all are young
    gone = snapshot.vacuum(spark, root, keep=2, spared=-1)
    assert len(gone) == 1 and ids(snapshot.open_version(spark, root)["chunks"]) == ["a-3-x", "a-3-y", "b-1-x", "b-1-y"]
    with pytest.raises(FileNotFoundError):
        snapshot.open_version(spark, root, first)
    assert snapshot.vacuum(spark, root, keep=0, spared=-1) and snapshot.read_pointer(spark, root) == last
    assert snapshot.vacuum(spark, str(root) + "/nothing") == []


def test_replacing_a_book_takes_links_to_it_along(spark, root):
    put(spark, root, "a")
    put(spark, root, "b", "1", ("x", "y"), ("b-1-x", "a-1-x"), ("b-1-x", "b-1-y"))
    held = lambda: sorted((r.from_chunk_id, r.to_chunk_id) for r in snapshot.open_version(spark, root)["links"].collect())
    assert held() == [("b-1-x", "a-1-x"), ("b-1-x", "b-1-y")]
    put(spark, root, "a", "1")  # the same ids again: the link went with the old rows
    assert held() == [("b-1-x", "b-1-y")]
    put(spark, root, "b", "1", ("x", "y"), ("b-1-x", "a-1-x"))
    assert held() == [("b-1-x", "a-1-x")]


@pytest.mark.parametrize(
    ("name", "keys", "pairs", "rule"),
    [("b", ("x",), [("b-1-x", "gone")], "link to nowhere"), ("b", ("x",), [("a-1-x", "b-1-x")], "link from nowhere"), ("b", ("x", "x"), [], "section repeats"), ("B", ("x",), [], "book rule"), ("b", ("x",), [("b-1-x", "b-1-x")], "link rule")],
)
def test_rules_hold_across_books(spark, root, name, keys, pairs, rule):
    first = put(spark, root, "a")
    with pytest.raises(snapshot.IntegrityError, match=rule):
        put(spark, root, name, "1", keys, *pairs)
    assert snapshot.read_pointer(spark, root) == first and len(list(pathlib.Path(root, "books").glob("*/*"))) == 1


def test_ids_are_unique_across_books(spark, root):
    put(spark, root, "a")
    with pytest.raises(snapshot.IntegrityError, match="chunk id repeats"):
        snapshot.replace_book(spark, root, book(spark, "b"), chunks(spark, "b").withColumn("id", F.concat(F.lit("a-1-"), "section_key")), links(spark))
    with pytest.raises(snapshot.IntegrityError, match="one book"):
        snapshot.replace_book(spark, root, book(spark, "b").union(book(spark, "c")), chunks(spark, "b"), links(spark))


def test_publishers_of_different_books_both_succeed(spark, root, monkeypatch):
    put(spark, root, "a")
    plain = snapshot.violations

    def slow(*parts):
        monkeypatch.setattr(snapshot, "violations", plain)
        put(spark, root, "b")
        return plain(*parts)

    monkeypatch.setattr(snapshot, "violations", slow)
    put(spark, root, "c", "1", ("x",), ("c-1-x", "a-1-x"))
    now = snapshot.open_version(spark, root)
    assert ids(now["books"]) == ["a", "b", "c"] and now["links"].count() == 1
    assert [b.written for b in snapshot.manifest(spark, root, snapshot.read_pointer(spark, root)).values()] == [1, 2, 3]


def test_a_link_to_a_chunk_that_another_publisher_takes_away_fails(spark, root, monkeypatch):
    put(spark, root, "a")
    plain = snapshot.violations

    def slow(*parts):
        monkeypatch.setattr(snapshot, "violations", plain)
        put(spark, root, "a", "2")
        return plain(*parts)

    monkeypatch.setattr(snapshot, "violations", slow)
    with pytest.raises(snapshot.IntegrityError, match="link to nowhere"):
        put(spark, root, "b", "1", ("x",), ("b-1-x", "a-1-x"))
    assert ids(snapshot.open_version(spark, root)["books"]) == ["a"]


def test_a_claim_that_is_not_followed_is_told(spark, root, monkeypatch):
    first = put(spark, root, "a")
    pathlib.Path(root, f".CURRENT.after.{first}").touch()
    monkeypatch.setattr(snapshot, "CLAIM_SECONDS", 0.5)
    with pytest.raises(snapshot.ConflictError, match="claimed"):
        put(spark, root, "b")


def test_search_with_stored_postings_reads_no_text(spark, root):
    put(spark, root, "a")
    put(spark, root, "b")
    now = snapshot.open_version(spark, root)
    asked = spark.createDataFrame([(1, "the body of b")], "query_id long, question string")
    models = search.Models(an.HashingEmbedder(2))
    found = search.search(asked, now["chunks"].drop("blocks"), models, "hybrid", 5, index=now["postings"])
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    scans = [x for x in plan.splitlines() if "ReadSchema" in x or "FileScan" in x]
    assert scans and not any("body:string" in x for x in scans)
    assert any("PushedFilters" in x and "In(term" in x for x in scans)
    same = search.search(asked, now["chunks"].drop("blocks"), models, "hybrid", 5)
    key = lambda df: sorted((r.id, r.rank) for r in df.collect())
    assert key(found) == key(same) and {r.id for r in found.collect()} >= {"b-1-x", "b-1-y"}
    assert textindex.top(asked.withColumn("question", F.lit("")), now["postings"]).count() == 0


# --- the run log -----------------------------------------------------------------------


def test_answers_are_logged(spark, root):
    plan = {"disposition": "off_topic", "competition": "generic", "scenario": False, "queries": ["x"]}
    usage = [an.Usage(10, 2, 3, None)] if hasattr(an, "Usage") else []
    service = an.AnswerService(an.ScriptedClient([plan], usage), lambda q: None, lambda m, i: True, log=runlog.logger(spark, root), spark=spark)
    out = service.ask("What is the weather?")
    assert out["status"] == "off_topic" and out["telemetry_logged"]
    runlog.append(spark.createDataFrame([runlog.search_record("hybrid", "mark", ["e", "r"], 12, {"embedding": 3})], schemas.RUNS), root)
    rows = {r.retrieval_config: r for r in runlog.read(spark, root).collect()}
    answer, found = rows["hybrid-rerank+rewrite"], rows["hybrid"]
    assert answer.outcome == "off_topic" and answer.refused and answer.trace_id == out["trace_id"] and answer.corpus_fingerprint == "not-retrieved" and "plan" in answer.step_timings_ms
    assert found.model == "e + r" and found.step_timings_ms == {"embedding": 3} and found.cost_usd == 0 and found.trace_id is None and found.day == found.created_at.date()
    assert runlog.read(spark, root, since="2999-01-01").count() == 0


def test_runs_that_break_a_rule_are_refused(spark, root):
    good = runlog.search_record("vector", "mark", ["e"], 5, {})
    for bad in ({"latency_ms": -1}, {"input_tokens": -3}, {"model": None}, {"refused": None}):
        with pytest.raises(runlog.RunError):
            runlog.append(spark.createDataFrame([good, good | bad], schemas.RUNS), root)
    assert not pathlib.Path(root, runlog.FOLDER).exists()
    with pytest.raises(TypeError):
        runlog.record(colour="red")


def test_a_log_that_fails_leaves_the_answer(spark, root):
    service = an.AnswerService(None, lambda q: None, lambda m, i: True, log=lambda row: (_ for _ in ()).throw(runlog.RunError("no")), spark=spark)
    out = service.ask("Anything?")
    assert out["status"] == "configuration_error" and not out["telemetry_logged"]


def test_days_and_outcomes_are_summed(spark, root):
    made = [runlog.record(competition="g", retrieval_config="v", corpus_fingerprint="m", model="e", latency_ms=n, refused=n > 2, outcome=o, input_tokens=t, cost_usd=0.5, created_at=dt.datetime(2024, 1, d, 12)) for n, o, t, d in ((1, "answered", 5, 1), (2, "answered", 6, 1), (3, "off_topic", None, 2))]
    runlog.append(spark.createDataFrame(made, schemas.RUNS), root)
    got = {(r.level, str(r.day), r.outcome): (r.runs, r.refused, r.input_tokens, r.cost_usd, r.mean_ms) for r in runlog.rollup(runlog.read(spark, root)).collect()}
    assert got[(3, "None", None)] == (3, 1, None, 1.5, 2.0) and got[(2, "None", "answered")] == (2, 0, 11, 1.0, 1.5) and got[(1, "2024-01-02", None)] == (1, 1, None, 0.5, 3.0) and len(got) == 7
