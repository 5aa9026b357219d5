"""Hand-made cases for rules that the tables do not reach."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lorebase.functions import text, urls
from lorebase.operators import answering as an
from lorebase.operators import corpus, evaluation, layout, public, ranking, snapshot
from lorebase.operators import evidence as ev
from lorebase.sources import files, manifest


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_fusion_counts_an_id_once_per_ranking(spark):
    rows = [(1, "p", "a", 1), (1, "p", "b", 2), (1, "p", "a", 3), (1, "q", "b", 1), (1, "q", "c", 2)]
    got = ranking.fuse(spark.createDataFrame(rows, "query_id long, ranking string, id string, rank int")).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61) and got[1].score == pytest.approx(1 / 61)


def test_fusion_breaks_ties_by_text(spark):
    rows = [(1, "p", 10, 1), (1, "q", 9, 1)]
    got = ranking.fuse(spark.createDataFrame(rows, "query_id long, ranking string, id long, rank int")).orderBy("rank").collect()
    assert [r.id for r in got] == [10, 9]


def test_windows_cover_the_tail(spark):
    words = [str(i) for i in range(2000)]
    df = spark.createDataFrame([(words,)], "w array<string>").select(F.explode(text.windows(F.col("w"), 254)).alias("x")).select("x.start", F.size("x.words").alias("n"))
    got = df.collect()
    assert [r.start for r in got] == list(range(0, 1777, 222)) and max(r.n for r in got) <= 254 and got[-1].start + got[-1].n == 2000
    with pytest.raises(ValueError):
        text.windows(F.col("w"), 32)


def test_expansion_matches_inside_words(spark):
    assert "penalty" in one(spark, text.expand(F.col("q")), q="What happens next?")
    assert one(spark, text.on_topic(F.col("q")), q="What happens next?")
    assert not one(spark, text.on_topic(F.col("q")), q="Who won?")


def test_slug_and_unicode(spark):
    assert one(spark, text.slug(F.col("s")), s="The Café (A)!") == "the-caf-a"
    df = spark.createDataFrame([("Café É",)], "s string")
    assert df.select(text.normalize_unicode(F.col("s"))).first()[0] == "cafe e"


def test_excerpt_prefers_long_lines_and_shortens(spark):
    body = "Title\nshort reat\n" + "x" * 25 + "\n" + ("reat " * 100)
    df = spark.createDataFrame([(body, ["reat"])], "b string, w array<string>")
    got = df.select(text.excerpt(F.col("b"), F.col("w"))).first()[0]
    assert got.startswith("reat reat") and got.endswith("…") and len(got) <= 418


def test_validity_is_half_open(spark):
    books = spark.createDataFrame([("a", "e", "t", "A", ["g"], dt.date(2020, 1, 1), dt.date(2021, 1, 1), None, None, "ready")], "id string, edition string, title string, authority string, competition_scope array<string>, effective_from date, effective_until date, last_checked_at timestamp, sha256 string, status string")
    chunks = spark.createDataFrame([("a", "e", None, None), ("a", "x", None, None)], "rulebook_id string, edition string, effective_from date, effective_until date")
    count = lambda d: corpus.current_chunks(books, chunks, F.lit(d).cast("date")).count()
    assert [count(d) for d in ("2019-12-31", "2020-01-01", "2020-12-31", "2021-01-01")] == [0, 1, 1, 0]


def test_definitions_match_whole_words(spark):
    rows = [("d", "p", "definition", "Play (noun)", "x"), ("a", None, "section", "A", "play resumes"), ("b", None, "section", "B", "player enters"), ("c", None, "section", "C", "éplay"), ("e", "p", "definition", "Law", "y")]
    df = spark.createDataFrame(rows, "section_key string, parent_section_key string, kind string, section_title string, body string")
    assert [(r.from_key, r.to_key) for r in corpus.definition_links(df).collect()] == [("d", "a")]


ROWS = "question_id long, place int, id string, rulebook_id string, section_key string, parent_section_key string, body string"


def packed(spark, rows, maximum=32, budget=1000):
    df = spark.createDataFrame([(q, i, key, "r", key, parent, "x" * size) for q, i, key, parent, size in rows], ROWS)
    return sorted((tuple(r) for r in ev.pack(df, maximum=maximum, budget=budget).collect()), key=str)


def test_packing(spark):
    both = [(1, 0, "c", "p", 100), (1, 1, "p", None, 100)]
    assert packed(spark, [(1, 0, "a", None, 100)], budget=99) == []
    assert packed(spark, both, maximum=1) == [(1, 1, "p", None)]
    assert packed(spark, both, maximum=2) == [(1, 1, "c", None), (1, 2, "p", None)]
    assert packed(spark, [(1, 0, "a", None, 100), (1, 1, "a", None, 100)]) == [(1, 1, "a", None)]
    assert packed(spark, [(1, 0, "big", None, 500), (1, 1, "small", None, 100)], budget=200) == [(1, 1, "small", None)]


def test_a_bad_question_leaves_the_batch_alone(spark):
    fault = "ancestors are missing or circular"
    rows = [(1, 0, "c", "gone", 9), (2, 0, "a", "b", 9), (2, 1, "b", "a", 9), (3, 0, "q", None, 9), (4, 0, "s", "s", 9)]
    assert packed(spark, rows) == [(1, None, None, fault), (2, None, None, fault), (3, 1, "q", None), (4, None, None, fault)]


ITEM = {"evidence_id": "E1", "chunk_id": "c1", "url": "https://rules.example/x#page=3", "body": "A goal is scored when the whole of the ball passes over the line."}
QUOTE = "the whole of the ball passes"


def draft(**over):
    claim = {"text": "The whole ball must cross.", "supports": [{"evidence_id": "E1", "quote": QUOTE}]} | over
    return {"status": "answered", "sections": [{"label": "Answer", "claims": [claim]}]}


AUDIT = {"claims": [{"claim_id": "1.1", "supported": True}], "answers_question": True, "assumptions_supported": True, "judgment_flag_correct": True}
PLAN = {"disposition": "rules", "competition": "generic", "scenario": False, "queries": ["goal", "goal"]}


def service(spark, replies, fresh=True, evidence=(ITEM,), log=None):
    client = an.ScriptedClient(replies, [an.Usage(10, 5, 0, Decimal("0.001"))] * 3)
    return client, an.AnswerService(client, lambda q: an.Bundle(list(evidence), "f"), lambda f, ids: fresh, log, spark)


def test_answer_is_cited_and_logged(spark):
    logged = []
    client, s = service(spark, [PLAN, draft(), AUDIT], log=logged.append)
    out = s.ask("When is it a goal?")
    assert out["status"] == "answered" and out["markdown"] == "**Answer**\n\nThe whole ball must cross. [1](https://rules.example/x#page=3)"
    cited = out["citations"][0]
    assert ITEM["body"][cited["start"] : cited["end"]] == QUOTE and cited["chunk_id"] == "c1" and cited["number"] == 1 and out["usage"]["cost_usd"] == Decimal("0.003")
    assert logged[0]["outcome"] == "answered" and not logged[0]["refused"] and logged[0]["diagnostics"]["citation_count"] == 1
    assert [stage for stage, _ in client.calls] == ["plan", "generate", "audit"]


@pytest.mark.parametrize(
    ("replies", "fresh", "evidence", "status"),
    [
        ([PLAN | {"disposition": "off_topic"}], True, [ITEM], "off_topic"),
        ([PLAN | {"competition": "uefa"}], True, [ITEM], "scope_unavailable"),
        ([PLAN | {"queries": ["x" * 201]}], True, [ITEM], "validation_failed"),
        ([PLAN | {"queries": []}], True, [ITEM], "validation_failed"),
        ([PLAN], True, [], "insufficient_evidence"),
        ([PLAN, draft(text="see [x](http://y)")], True, [ITEM], "validation_failed"),
        ([PLAN, draft(supports=[])], True, [ITEM], "validation_failed"),
        ([PLAN, draft(supports=[{"evidence_id": "E9", "quote": QUOTE}])], True, [ITEM], "validation_failed"),
        ([PLAN, draft(supports=[{"evidence_id": "E1", "quote": "words that are not there"}])], True, [ITEM], "validation_failed"),
        ([PLAN, draft()], True, [ITEM | {"url": "http://rules.example/"}], "validation_failed"),
        ([PLAN, {"status": "clarification", "sections": []}], True, [ITEM], "clarification"),
        ([PLAN, draft() | {"status": "clarification"}], True, [ITEM], "validation_failed"),
        ([PLAN | {"scenario": True}, draft()], True, [ITEM], "validation_failed"),
        ([PLAN, draft(), AUDIT | {"claims": []}], True, [ITEM], "validation_failed"),
        ([PLAN, draft(), AUDIT | {"claims": AUDIT["claims"] * 2}], True, [ITEM], "validation_failed"),
        ([PLAN, draft(), AUDIT | {"answers_question": False}], True, [ITEM], "validation_failed"),
        ([PLAN, draft(), AUDIT], False, [ITEM], "corpus_changed"),
        ([an.ProviderError()], True, [ITEM], "provider_error"),
        ([OSError()], True, [ITEM], "retrieval_error"),
        ([AnalysisException("x")], True, [ITEM], "retrieval_error"),
        ([PLAN, an.CorpusChanged()], True, [ITEM], "corpus_changed"),
    ],
)
def test_refusals_are_scrubbed(spark, replies, fresh, evidence, status):
    _, s = service(spark, replies, fresh, evidence)
    out = s.ask("Question?")
    assert out["status"] == status and out["markdown"] == an.MESSAGES[status] and not out["citations"] and not out["sections"]


def test_a_batch_goes_on_beside_a_question_that_fails(spark):
    _, s = service(spark, [PLAN, an.ProviderError(), PLAN | {"disposition": "off_topic"}, draft(), AUDIT])
    assert [o["status"] for o in s.answer(["a", "b", "c"])] == ["answered", "provider_error", "off_topic"]


def test_service_edges(spark):
    _, s = service(spark, [])
    with pytest.raises(ValueError):
        s.ask(" ")
    assert an.AnswerService(None, None, None).ask("q?")["status"] == "configuration_error"
    for error in (OSError, lambda: AnalysisException("no table")):

        def broken(_, error=error):
            raise error()

        _, s = service(spark, [PLAN, draft(), AUDIT], log=broken)
        assert s.ask("q?")["telemetry_logged"] is False
    assert an.usage_totals([an.Usage(1, None)])["output_tokens"] is None and an.usage_totals([])["input_tokens"] == 0


def faults(spark, *drafts):
    df = spark.createDataFrame([(str(i), d["status"], scenario, [(s["label"], [(c["text"], [(u["evidence_id"], u["quote"]) for u in c["supports"]]) for c in s["claims"]]) for s in d["sections"]]) for i, (d, scenario) in enumerate(drafts)], ev.DRAFTS)
    items = spark.createDataFrame([(str(i), "E1", "c1", "r", "k", ["h"], "e", ITEM["url"], 1, 1, ITEM["body"]) for i in range(len(drafts))], ev.EVIDENCE)
    return df, items, [r.fault for r in ev.draft_faults(df, items).orderBy(F.col("question_id").cast("int")).collect()]


def test_first_faults_of_a_batch_of_drafts(spark):
    two = draft(text="fine")["sections"][0]["claims"] + draft(text=" ")["sections"][0]["claims"]
    _, _, got = faults(
        spark,
        (draft(), False),
        (draft(text="[x](http://evil)", supports=[]), False),
        (draft(supports=[]), False),
        ({"status": "answered", "sections": [{"label": "Answer", "claims": two}]}, False),
        ({"status": "answered", "sections": []}, False),
        ({"status": "insufficient_evidence", "sections": []}, False),
        ({"status": "judgment", "sections": [{"label": "Answer", "claims": []}]}, False),
    )
    assert got == [None, "a claim with markup of its own", "a claim without support", "a claim without words", "the sections are not those asked for", None, "a section without claims"]


def test_scenario_labels_and_numbering(spark):
    claims = [{"text": f"Claim {i}.", "supports": [{"evidence_id": "E1", "quote": q} for q in quotes]} for i, quotes in enumerate([[QUOTE], ["A goal is scored", QUOTE], [QUOTE, QUOTE], ["over the line."]])]
    d = {"status": "judgment", "sections": [{"label": label, "claims": [c]} for label, c in zip(ev.SCENARIO_LABELS, claims, strict=True)]}
    drafts, items, got = faults(spark, (d, True), (d, False))
    assert got == [None, "the sections are not those asked for"]
    out = ev.rendered(drafts, items).where("question_id = '0'").first()
    url = ITEM["url"]
    assert [c.number for c in out.citations] == [1, 2, 3] and out.markdown.startswith("**Referee judgment**\n\n**Decision**\n\nClaim 0. [1]")
    assert [list(s.claims) for s in out.sections] == [[f"Claim 0. [1]({url})"], [f"Claim 1. [2]({url}) [1]({url})"], [f"Claim 2. [1]({url})"], [f"Claim 3. [3]({url})"]]


def test_verdicts_are_one_table(spark):
    rows = [(None, "off_topic", None, None), (None, "rules", "uefa", None), ("provider_error", "rules", "generic", None), (None, "rules", "generic", True), (None, "rules", "generic", False)]
    names = ["failed", "disposition", "competition", "fresh"]
    df = spark.createDataFrame(rows, "failed string, disposition string, competition string, fresh boolean")
    got = [r[0] for r in df.select(an.status_of(names)).collect()]
    assert got == ["off_topic", "scope_unavailable", "provider_error", "answered", "corpus_changed"]
    assert got == [an.verdict(dict(zip(names, r, strict=True))) or "answered" for r in rows]


def test_null_poisons_sums(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (2, 3)], "g int, x int").groupBy("g").agg(evaluation.poisoned_sum(F.col("x")).alias("s"))
    assert {r.g: r.s for r in df.collect()} == {1: None, 2: 3}


def word(said, x, y=50.0, font="Face"):
    return (1, said, float(x), float(x + 3 * len(said)), y - 9.0, y, font)


WORDS = "page int, text string, x0 double, x1 double, top double, bottom double, fontname string"


def test_reading_order(spark):
    df = spark.createDataFrame([word("two", 40), word("next", 10, 65.0), word("one", 10)], WORDS)
    assert [r.text for r in layout.text_lines(df).orderBy("line").collect()] == ["one two", "next"]


def test_lines_are_anchored_on_their_first_word():
    assert layout.line_numbers([50, 51.5, 52.5, 54]) == [0, 0, 1, 1]


LINES = "chapter string, chapter_title string, chapter_kind string, page int, line int, text string, x0 double, left double, x1 double, top double, bottom double, bold boolean, font string"


def laid(spark, *lines, chapter="law", kind="section"):
    rows = [(chapter, "Law", kind, page, i, said, float(x), float(x), float(edge), y - 9.0, float(y), bold, "F") for i, (said, x, y, bold, page, edge) in enumerate(lines)]
    return layout.sections(spark.createDataFrame(rows, LINES)).orderBy("position").collect()


def test_paragraphs_hand_on_their_left_edge(spark):
    assert layout.paragraph_starts([1, 1, 1, 1, 2], [100.0, 99.0, 97.5, 96.0, 0.0]) == [True, False, True, False, True]
    out = laid(spark, ("1. First", 10, 50, False, 1, 60), ("continued", 25, 63, False, 1, 99), ("• Nested", 20, 76, False, 1, 60), ("too far left", 10, 89, False, 1, 60), ("after a gap", 10, 110, False, 1, 60), ("next page", 10, 123, False, 2, 60))
    assert [(b.type, b.text, b.page) for b in out[0].blocks] == [("list_item", "1. First continued", 1), ("list_item", "• Nested", 1), ("paragraph", "too far left", 1), ("paragraph", "after a gap", 1), ("paragraph", "next page", 2)]
    assert out[0].blocks[0].bbox == [10.0, 41.0, 99.0, 63.0] and out[0].blocks[0].indent == 10.0


def test_sections_nest_and_repeat(spark):
    tree = laid(spark, ("1. One", 40, 20, True, 1, 90), ("body", 40, 40, False, 1, 90), ("Sub", 40, 60, True, 1, 90), ("more", 40, 80, False, 1, 90), ("Sub", 40, 100, True, 1, 90), ("1. One", 40, 100, True, 2, 90), ("Far in", 80, 120, True, 2, 90))
    assert [(t.section_key, t.parent_section_key) for t in tree] == [("law", None), ("law/1", "law"), ("law/1/sub", "law/1"), ("law/1/sub-p1", "law/1"), ("law/1-p2", "law")]
    assert tree[2].heading_path == ["Rules", "Law", "1. One", "Sub"] and [b.text for b in tree[0].blocks] == ["Law"] and [b.type for b in tree[4].blocks] == ["heading", "paragraph"]
    terms = laid(spark, ("A term", 90, 20, True, 1, 90), ("meaning", 40, 40, False, 1, 90), ("2. Other", 40, 60, True, 1, 90), kind="definition")
    assert [(t.section_key, t.parent_section_key) for t in terms] == [("law", None), ("law/a-term", "law"), ("law/2", "law")]


def test_headings_of_several_lines(spark):
    tree = laid(spark, ("A long heading that", 40, 20, True, 1, 340), ("goes on", 40, 33, True, 1, 90), ("and on", 40, 46, True, 1, 90), ("text", 40, 66, False, 1, 90), ("Short", 40, 80, True, 1, 90), ("Another", 40, 93, True, 1, 90))
    assert [t.section_title for t in tree] == ["Law", "A long heading that goes on and on", "Short", "Another"]
    assert tree[1].section_key == "law/a-long-heading-that" and tree[1].blocks[0].bbox == [40.0, 11.0, 340.0, 46.0]


def test_a_notice_alone_leaves_the_title(spark):
    df = spark.createDataFrame([("a", "T", [("paragraph", "from 1 July", 3)]), ("b", "U", [("paragraph", "from 1 July", 3)]), ("c", "V", [])], "section_key string, section_title string, blocks array<struct<type:string,text:string,page:int>>")
    got = {r.section_key: [tuple(b) for b in r.blocks] for r in layout.without_notice(df, "a", "1 July").collect()}
    assert got == {"a": [("heading", "T", 3)], "b": [("paragraph", "from 1 July", 3)], "c": []}


def test_html_section_drops_deleted_words():
    html = '<article id="x"><div class="c"><p>Keep <del>gone</del> this &amp; that</p></div></article><article id="y"><div class="c"><p>Other</p></div></article>'
    assert files.section_paragraphs(html, "x", "c") == ["Keep this & that"]
    for bad in ("", '<article id="x"></article>', '<article id="x"><div class="c"><p> </p></div></article>'):
        with pytest.raises(ValueError):
            files.section_paragraphs(bad, "x", "c")


def test_urls(spark):
    ok = lambda u: one(spark, urls.allowed(F.col("u"), ["a.example"]), u=u)
    assert ok("https://a.example/x") and ok("https://A.example:443/x")
    assert not any(ok(u) for u in ("http://a.example/", "https://b.example/", "https://u@a.example/", "https://a.example:8443/", "https://a.example.evil/"))


def test_manifest(spark, tmp_path):
    text_ = "schema_version: 1\nsources:\n- {id: a, title: T, authority: A, competition_scope: [g], edition: e, source_url: 'https://h/x', discovery_url: 'https://h', allowed_hosts: [h], effective_from: 2020-01-01, verified_on: 2020-01-01, verification: current, ingest_phase: 2, coverage: [x]}\n"
    (tmp_path / "m.yaml").write_text(text_)
    df = manifest.load_manifest(spark, str(tmp_path / "m.yaml"))
    assert df.first().effective_from == dt.date(2020, 1, 1) and manifest.selected(df, ["a"]).count() == 1
    for bad in (text_ + text_.split("sources:\n")[1], text_.replace("title", "titel"), "schema_version: 2"):
        with pytest.raises(ValueError):
            manifest.parse_manifest(bad)
    with pytest.raises(ValueError):
        manifest.selected(df, ["zz"])


def test_publishing_replaces_whole_books(spark, tmp_path):
    from lorebase import schemas

    root = str(tmp_path / "store")
    (tmp_path / "store").mkdir()
    day = dt.date(2020, 1, 1)
    book = lambda i, e: spark.createDataFrame([(i, "T", "A", ["g"], e, day, None, "https://x", "https://x", "0" * 64, None, None, "ready", "m", "f")], schemas.BOOKS)

    def chunk(book_id, edition, key, parent=None):
        return (f"{book_id}-{edition}-{key}", book_id, edition, key, parent, "section", "l", "t", ["h"], "body", None, 1, 1, [], "https://x", "https://x#1", None, None, None)

    chunks = lambda *rows: spark.createDataFrame(list(rows), schemas.CHUNKS)
    links = lambda *rows: spark.createDataFrame(list(rows), schemas.LINKS)
    first = snapshot.replace_book(spark, root, book("a", "1"), chunks(chunk("a", "1", "x"), chunk("a", "1", "y", "x")), links(("a-1-x", "a-1-y", "defines", None)))
    snapshot.replace_book(spark, root, book("b", "1"), chunks(chunk("b", "1", "x")), links())
    second = snapshot.replace_book(spark, root, book("a", "2"), chunks(chunk("a", "2", "x")), links())
    now = snapshot.open_version(spark, root)
    assert {r.id for r in now["chunks"].select("id").collect()} == {"a-2-x", "b-1-x"} and now["links"].count() == 0
    assert snapshot.open_version(spark, root, first)["chunks"].count() == 2
    with pytest.raises(snapshot.IntegrityError):
        snapshot.replace_book(spark, root, book("a", "3"), chunks(chunk("a", "3", "x", "missing")), links())
    assert snapshot.read_pointer(spark, root) == second


def test_pass_rate(spark):
    df = spark.createDataFrame([(True,), (True,)], "passed boolean")
    assert evaluation.pass_rate(df, 2).first().passed and not evaluation.pass_rate(df, 3).first().passed


def test_keyword_boosts(spark):
    q = spark.createDataFrame([(1, "offside and throw in")], "question_id long, question string")
    c = spark.createDataFrame([("a", 0, None, "section", "T", "T", "offside throw in"), ("b", 1, 3, "section", "T", "T", "offside throw in")], "section_key string, position long, page_start int, kind string, title string, section string, body string")
    boosts = spark.createDataFrame([("a", ["offside", "throw in"], 50.0)], "section_key string, phrases array<string>, boost double")
    plain = public.keyword_search(q, c).orderBy("rank").collect()
    assert [r.section_key for r in plain] == ["b", "a"]
    assert public.keyword_search(q, c, boosts=boosts).orderBy("rank").first().section_key == "a"


def test_streamed_run_log(spark, tmp_path):
    from lorebase.streaming import runlog

    rows = [(dt.datetime(2024, 1, 1, 0, m), "answered", 10 * m) for m in range(3)] + [(dt.datetime(2024, 1, 1, 5), "answered", 1)]
    spark.createDataFrame(rows, "ts timestamp, outcome string, latency_ms long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, outcome string, latency_ms long").parquet(str(tmp_path / "in"))
    q = runlog.windowed_runs(stream).writeStream.outputMode("complete").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.runs for r in spark.sql("select runs from runs").collect()) == [1, 3]
