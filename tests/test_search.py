"""Stems, search modes, evidence for questions, and the answer service over a published corpus."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase import schemas
from lorebase.functions import stem, text
from lorebase.operators import answering as an
from lorebase.operators import corpus, public, search, snapshot
from lorebase.sources import files

STEMS = {
    "consistency": "consist", "knightly": "knight", "relational": "relat", "running": "run", "hopping": "hop", "hoping": "hope", "players": "player", "penalties": "penalti", "ties": "tie", "dies": "die", "gas": "gas", "kiwis": "kiwi", "agreed": "agre",
    "happiness": "happi", "generously": "generous", "national": "nation", "skies": "sky", "news": "news", "cry": "cri", "by": "by", "say": "say", "adjustment": "adjust", "controlling": "control", "rolled": "roll", "decision": "decis", "goalkeeper's": "goalkeep", "proceeding": "proceed",
    "communication": "communic", "formaliti": "formal", "vietnamization": "vietnam", "electrical": "electr", "offside": "offsid", "kicked": "kick", "restarts": "restart",
}


@pytest.mark.parametrize(("word", "root"), STEMS.items())
def test_stems(word, root):
    assert stem.stem(word) == root


def test_terms_drop_stop_words(spark):
    df = spark.createDataFrame([("The players were kicking the Ball",), (None,)], "t string")
    assert [r[0] for r in df.select(stem.terms(F.col("t"))).collect()] == [["player", "kick", "ball"], []]


CHUNK = "id string, rulebook_id string, edition string, section_key string, parent_section_key string, kind string, law_article string, section_title string, heading_path array<string>, body string, page_start int, page_end int, source_url string, section_url string, embedding array<double>"
MODELS = search.Models(an.HashingEmbedder(32), an.OverlapReranker())


def chunk(key, parent, title, body, i=1):
    return (f"id-{key}", "book", "e", key, parent, "section", "l", title, ["Rules", title], body, i, i, "https://rules.example/", f"https://rules.example/#page={i}", [float(x) for x in MODELS.embedder.encode([body])[0]])


ROWS = [
    chunk("goal", None, "Goals", "a goal is scored when the whole ball passes over the line"),
    chunk("goal/line", "goal", "The line", "players kicked the ball over the goal line between the posts"),
    chunk("throw", None, "Throw-in", "a throw in is awarded when the ball leaves the field over the touch line"),
    chunk("card", None, "Cards", "a caution is shown by a yellow card for dissent"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, CHUNK)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "when is a goal scored"), (2, "yellow cards"), (3, " \t"), (4, "w " * 200)], "query_id long, question string")


def ranks(question):
    """Both rankings, fused and reranked, in plain Python."""
    q = MODELS.embedder.encode([question])[0].astype(float)
    cos = lambda v: 1 - float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v)))
    near = [r[0] for r in sorted(ROWS, key=lambda r: (round(cos(np.array(r[14])), 6), r[0]))]
    words = lambda t: [stem.stem(w) for w in t.lower().replace("-", " ").split() if w not in stem.STOP_WORDS]
    score = {r[0]: round(sum(words(r[7]).count(w) + 0.4 * words(r[9]).count(w) for w in set(words(question))), 6) for r in ROWS}
    said = [i for i in sorted(score, key=lambda i: (-score[i], i)) if score[i] > 0]
    fused = {i: sum(1 / (60 + x.index(i) + 1) for x in (near, said) if i in x) for i in near}
    order = sorted(fused, key=lambda i: (-fused[i], i))
    lap = MODELS.reranker.scores(question, [" > ".join(r[8]) + "\n" + r[9] for r in ROWS])
    best = {r[0]: s for r, s in zip(ROWS, lap, strict=True)}
    return near, order, sorted(order, key=lambda i: (-best[i], order.index(i)))


@pytest.mark.parametrize(("mode", "at"), [("vector", 0), ("hybrid", 1), ("hybrid-rerank", 2)])
def test_search_modes(spark, chunks, asked, mode, at):
    got = search.search(asked, chunks, MODELS, mode, 3).orderBy("query_id", "rank").collect()
    for q, question in ((1, "when is a goal scored"), (2, "yellow cards")):
        assert [r.id for r in got if r.query_id == q] == ranks(question)[at][:3]
    assert {r.query_id for r in got} == {1, 2}


def test_search_bounds(spark, chunks, asked):
    for mode, limit in (("other", 5), ("hybrid", 0), ("hybrid", 21)):
        with pytest.raises(search.ConfigurationError):
            search.search(asked, chunks, MODELS, mode, limit)
    with pytest.raises(search.ConfigurationError):
        search.search(asked, chunks, search.Models(MODELS.embedder), "hybrid-rerank")
    books = spark.createDataFrame([("book", "another model")], "id string, embedding_model string")
    with pytest.raises(search.ConfigurationError):
        search.search(asked, chunks, MODELS, "hybrid", 5, books)
    assert [r[0] for r in asked.orderBy("query_id").select(search.faults(F.col("question"))).collect()] == [None, None, "empty", "too many words"]


def test_definitions_are_ordered(spark, chunks):
    links = spark.createDataFrame([("id-throw", "id-goal", "defines"), ("id-card", "id-goal", "defines"), ("id-card", "id-goal", "explicit_variation")], "from_chunk_id string, to_chunk_id string, relation string")
    results = spark.createDataFrame([(1, "id-goal")], "query_id long, id string")
    assert [r.section_key for r in search.definitions(results, links, chunks).collect()] == ["card", "throw"]


def test_collected_evidence(spark, chunks):
    rows = [(1, 0, "ball over the goal line posts"), (1, 1, "yellow cards"), (1, 2, "yellow cards"), (2, 0, "touch line")]
    got = search.collected(spark.createDataFrame(rows, "question_id long, part int, query string"), chunks, MODELS, budget=150).collect()
    one = sorted((int(r.evidence_id[1:]), r.section_key) for r in got if r.question_id == 1)
    # the line comes with its section; both together fill the budget
    assert [k for _, k in one] == ["goal/line", "goal"] and {r.question_id for r in got} == {1, 2}


def test_evidence_with_ancestors_of_any_depth_and_faults_that_show(spark):
    deep = [chunk(f"d{i}", f"d{i - 1}" if i else None, f"Level {i}", f"level {i}" if i < 8 else "offside trap of the deepest level") for i in range(9)]
    bad = [chunk("lost", "gone", "Lost", "studs and force"), chunk("x", "y", "Ring", "corner flag ring"), chunk("y", "x", "Other", "filler")]
    rows = spark.createDataFrame(deep + bad, CHUNK)
    asked = [(1, 0, "offside trap of the deepest level"), (2, 0, "studs and force"), (3, 0, "corner flag ring")]
    first = {1: "id-d8", 2: "id-lost", 3: "id-x"}
    for q, part, query in asked:
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(search, "EACH", 1)
            got = search.collected(spark.createDataFrame([(q, part, query)], "question_id long, part int, query string"), rows, MODELS).collect()
        if q == 1:
            assert {r.chunk_id: r.fault for r in got} == {f"id-d{i}": None for i in range(9)}, first[q]
        else:
            assert [(r.question_id, r.evidence_id, r.fault) for r in got] == [(q, None, "ancestors are missing or circular")], first[q]


def published(spark, root):
    day = dt.date(2020, 1, 1)
    book = spark.createDataFrame([("book", "T", "A", ["g"], "e", day, None, "https://x", "https://x", "0" * 64, None, dt.datetime(2024, 1, 1), "ready", MODELS.name, "f1")], schemas.BOOKS)
    names = [f.name for f in spark.createDataFrame([], schemas.CHUNKS).schema]
    table = spark.createDataFrame(ROWS, CHUNK)
    kinds = {f.name: f.dataType for f in spark.createDataFrame([], schemas.CHUNKS).schema}
    rows = table.select(*[(F.col(n) if n in table.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names])
    rows = rows.withColumn("blocks", F.array(F.struct(*[{"type": F.lit("paragraph"), "text": F.col("body"), "page": F.col("page_start")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds["blocks"].elementType.fields])))
    return book, rows, spark.createDataFrame([], schemas.LINKS)


def test_answers_over_a_published_corpus(spark, tmp_path):
    root = str(tmp_path)
    snapshot.replace_book(spark, root, *published(spark, root))
    load, fresh = search.loader(spark, root, MODELS, "2024-01-01")
    plan = {"disposition": "rules", "competition": "generic", "scenario": False, "queries": ["goal scored whole ball"]}
    quote = "the whole ball passes over the line"
    draft = {"status": "answered", "sections": [{"label": "Answer", "claims": [{"text": "All of it must cross.", "supports": [{"evidence_id": "E1", "quote": quote}]}]}]}
    audit = {"claims": [{"claim_id": "1.1", "supported": True}], "answers_question": True, "assumptions_supported": True, "judgment_flag_correct": True}
    out = an.AnswerService(an.ScriptedClient([plan, draft, audit]), load, fresh, spark=spark).ask("When is it a goal?")
    assert out["status"] == "answered" and out["citations"][0]["section_key"] == "goal" and out["sources"][0]["id"] == "book"
    assert not fresh("x", []) and fresh(out["corpus_fingerprint"], ["id-goal"]) and not fresh(out["corpus_fingerprint"], ["gone"])


def test_of_two_publishers_of_a_book_one_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    book, rows, links = published(spark, root)
    first = snapshot.replace_book(spark, root, book, rows, links)
    plain = snapshot.violations

    def slow(*parts):
        """Another publisher is faster."""
        monkeypatch.setattr(snapshot, "violations", plain)
        snapshot.replace_book(spark, root, book, rows, links)
        return plain(*parts)

    monkeypatch.setattr(snapshot, "violations", slow)
    with pytest.raises(snapshot.ConflictError):
        snapshot.replace_book(spark, root, book, rows, links)
    now = snapshot.read_pointer(spark, root)
    assert now != first and snapshot.open_version(spark, root)["chunks"].count() == len(ROWS)
    # the one that failed left no folder
    assert len(list((tmp_path / "books").glob("*/*"))) == 2


def test_export_round_trip(spark, tmp_path):
    _, rows, _ = published(spark, str(tmp_path))
    snapshot.write_records(rows, str(tmp_path / "lines"))
    assert files.processed(spark, str(tmp_path / "lines")).count() == len(ROWS)
    (tmp_path / "array.json").write_text(json.dumps([json.loads(x) for x in rows.toJSON().collect()], indent=1))
    assert {r.id for r in files.processed(spark, str(tmp_path / "array.json")).collect()} == {r[0] for r in ROWS}


def test_corrections_replace_blocks_too(spark):
    df = spark.createDataFrame([("a", "https://x", "https://x#page=1", "old", [("paragraph", "old", 7)]), ("b", "https://x", "https://x#page=2", "other", [("paragraph", "other", 8)])], "section_key string, source_url string, section_url string, body string, blocks array<struct<type:string,text:string,page:int>>")
    papers = spark.createDataFrame([("a", "https://y", "n", "0", ["new one", "new two"])], "section_key string, url string, anchor string, sha256 string, paragraphs array<string>")
    got = {r.section_key: r for r in corpus.apply_corrections(df, papers).withColumn("said", corpus.body_of(F.col("blocks"), F.lit("t"))).collect()}
    assert got["a"].said == got["a"].body == "new one\nnew two" and [b.page for b in got["a"].blocks] == [7, 7] and got["b"].said == "other" and got["a"].section_url == "https://y#n"


def test_fingerprints_see_every_column_and_nulls(spark):
    rows = [("b", None, "x", 1), ("b", "x", None, 1), ("b", "x", "", 1), ("b", "x", None, 2)]
    marks = []
    for r in rows:
        df = spark.createDataFrame([r, ("b", "same", "same", 0)], "book string, title string, body string, page int")
        marks.append(corpus.content_fingerprint(df, "book", ["title", "body", "page"]).first().fingerprint)
    assert len(set(marks)) == 4


def test_unicode_forms_reach_words_and_phrases(spark):
    q = spark.createDataFrame([(1, "Résumé éclair")], "question_id long, question string")
    c = spark.createDataFrame([("a", 0, 1, "section", "Resume", "T", "an eclair")], "section_key string, position long, page_start int, kind string, title string, section string, body string")
    assert public.keyword_search(q, c, normal=text.normalize_unicode).count() == 1
    words = q.select(text.score_tokens(F.col("question"), normal=text.normalize_unicode)).first()[0]
    assert words == ["re", "sume", "clair"] and text.normalize_unicode is not text.normalize


def test_blank_questions_are_errors(spark):
    df = spark.createDataFrame([("\t\n",), ("  ",), ("x",)], "q string")
    got = [r[0] for r in df.select(public.status(F.col("q"), F.lit("any"), F.lit(True), F.lit(1))).collect()]
    assert got == ["error", "error", "answered"]
