"""Ranked lexical search, record files and spelling variants against brute force."""

import collections
import itertools
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorebase.llm import crc, lexical, records, spelling, tables

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


# --- ranked lexical search ---------------------------------------------------------


def ranked(items, docs, k):
    """Every document against every item, in plain Python."""
    find = re.compile(lexical.TERM).findall
    held = [(d, collections.Counter(find((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        if i is not None:
            asked[i].update(find((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w, q in terms.items() if w in c)
            if s > 0:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = ["common%d" % (i // 4) for i in range(16)] + ["w%d" % i for i in range(300)] + ["É", "日本", "x9", "The"]
    chance = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 60)), p=chance / chance.sum())) for _ in range(700)]
    docs = list(enumerate(texts)) + [(700, None), (701, ""), (702, " .,;\n"), (703, texts[5]), (704, texts[5]), (5, texts[5]), (None, texts[6]), (705, "alone " * 5000), (706, "THE the;The-the")]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(30)] + [(30, texts[5]), (31, None), (32, ""), (33, "nowhere at all"), (34, "the the x9"), (35, texts[6]), (None, texts[6]), (30, "w299 w299")]
    return items, docs


@pytest.mark.parametrize(("k", "look", "broadcast"), [(20, 0.01, 400_000), (3, 0.0, 0), (5, 1.0, 400_000)])
def test_ranking_agrees_with_scoring_everything(spark, corpus, monkeypatch, k, look, broadcast):
    monkeypatch.setattr(lexical, "FIRST_LOOK", look)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(lexical, "TOGETHER", 100)
    monkeypatch.setattr(lexical, "GATHERED", 500)
    items, docs = corpus
    docs_df = spark.createDataFrame([(*d, "clash") for d in docs], f"{DOCS}, term string").repartition(5)
    items_df = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, row long")
    got = lexical.search(items_df, lexical.build(docs_df), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in got.collect()]
    # equal rows of one id have equal places
    assert sorted(rows, key=str) == sorted(ranked(items, docs, k), key=str)


def test_most_pairs_are_never_made(spark, corpus, monkeypatch):
    """With a floor, terms that can't reach it are only looked up for documents in question."""
    monkeypatch.setattr(lexical, "FIRST_LOOK", 0.0)
    items, docs = corpus
    index = lexical.build(spark.createDataFrame(docs, DOCS))
    seen = []
    real = lexical.settle
    monkeypatch.setattr(lexical, "settle", lambda df: seen.append(real(df)) or seen[-1])
    item = spark.createDataFrame([(30, docs[5][1])], "item_id long, text string")
    assert lexical.search(item, index, 2).count() == 2
    partial, in_question = seen[3], seen[4]
    assert in_question.count() < partial.count() < len(docs)


def test_empty_tables_give_no_ranks(spark, corpus):
    items, docs = (spark.createDataFrame(rows, s) for rows, s in zip(corpus, ("item_id long, text string", DOCS), strict=True))
    assert lexical.search(items, lexical.build(docs.limit(0))).count() == 0
    assert lexical.search(items.limit(0), lexical.build(docs)).count() == 0
    assert lexical.build(docs.where("doc_id IN (700, 701, 702)")).documents == 0


def test_postings_of_a_term_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lexical, "TOGETHER", 50)
    monkeypatch.setattr(lexical, "GATHERED", 20)
    built = lexical.build(spark.createDataFrame([(i, "same") for i in range(2000)], DOCS))
    assert built.documents == built.terms == 2000
    held = built.postings.where("term = 'same'")
    assert held.agg(F.sum(F.size("rows"))).first()[0] == 2000
    assert held.groupBy(F.input_file_name()).agg(F.sum(F.size("rows")).alias("n")).agg(F.max("n")).first()[0] < 1200


# --- record files --------------------------------------------------------------------


def crc_by_bits(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    rng = np.random.default_rng(1)
    texts = [b"123456789", b"", bytes(32), *(rng.bytes(n) for n in (1, 63, 64, 65, 128, 129, 1000, 4097))]
    got = crc.crc32c(np.frombuffer(b"".join(texts), np.uint8), [len(t) for t in texts])
    assert got.tolist() == [crc_by_bits(t) for t in texts]
    assert got[0] == 0xE3069283 and got[2] == 0x8A9136AA  # published values
    assert int(crc.masked(got[:1])[0]) == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    assert crc.crc32c(np.zeros(0, np.uint8), []).tolist() == []


TEXTS = ["Hello, WORLD's  best—don't!", "", None, " \t\n ", "naïve café é ÅΣς İı", "日本語 のテキスト　x", "a" * 30_000, "<|endoftext|> x<|startoftext|>y", "the quick " * 20_000, "12 345 é\x0bb\x0cc\x1cd\x85e", "one\ntwo"]


def expected(rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    for k, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def written(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] if i < 40 else f"text number {i} of many") for i in range(400)]
    docs = spark.createDataFrame([(*r, 0) for r in rows[::-1]], f"{DOCS}, start int").repartition(7)
    folder = tables.new_folder(spark)
    records.write(docs, folder, VOCABULARY)
    return rows, docs, folder


def test_records_agree_with_the_library(spark, written):
    rows, docs, folder = written
    got = records.digests(docs, VOCABULARY)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == expected(rows)
    wide = records.read(spark, folder, arrays=True).where("doc_id = 0").first()
    assert wide.ids == [*Tokenizer.from_file(VOCABULARY).encode(TEXTS[0]).ids, 1]


def encoded(texts):
    records._remembered.cache_clear()
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["row", "doc_id", "text"])
    out = list(records.encoder(VOCABULARY, None)(iter([batch])))
    return [np.frombuffer(x, "<u2").tolist() for b in out for x in b.column(3).to_pylist()]


def test_parts_are_encoded_as_wholes(monkeypatch):
    """Odd mixes of letters, marks, endings, special tokens and spaces, against whole texts."""
    rng = np.random.default_rng(8)
    some = [*"abSTlvd'’.,3<|>-_ \n\t", "É", "ß", "ÿ", "Þ", "×", "÷", "\u0301", "\u0338", "İ", "ſ", "K", "日", "\u00a0", "\x1c", "\x85", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "word", "Über", "NAÏVE"]
    texts = ["".join(rng.choice(some, int(rng.integers(0, 25)))) for _ in range(4000)] + ["", "a", "É"]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoded(texts) == want
    monkeypatch.setattr(records, "REMEMBERED", 5)
    monkeypatch.setattr(records, "ENCODE_BYTES", 50)
    monkeypatch.setattr(records, "NORMALIZER", [])  # another tokenizer: whole words only
    assert encoded(texts[:500]) == want[:500]


def test_records_without_order_of_rows(spark):
    rows = [(3, "b"), (3, "b"), (None, "n"), (1, None), (3, "a b c")]
    got = sorted(map(tuple, records.digests(spark.createDataFrame(rows, DOCS).coalesce(1), VOCABULARY).collect()), key=lambda r: r[1])
    assert got == expected([(None, "n"), (1, None), (3, "b"), (3, "b"), (3, "a b c")])
    assert records.digests(spark.createDataFrame([], DOCS), VOCABULARY).count() == 0


def test_repeated_ids_are_parted(spark, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 2_000)
    folder = tables.new_folder(spark)
    records.write(spark.createDataFrame([(7, "same text here")] * 2000, DOCS).repartition(3), folder, VOCABULARY)
    per_file = records.index(spark, folder).groupBy("file").count().collect()
    assert len(per_file) > 5 and sum(r["count"] for r in per_file) == 2000
    assert records.read(spark, folder).agg(F.max("start")).first()[0] == 1999 * 4


def test_shuffled_reads_give_all_records_in_a_fixed_order(spark, written):
    _, _, folder = written
    digest = ["doc_id", "start", "n_tokens", F.crc32("ids").alias("c")]
    plain = [tuple(r) for r in records.read(spark, folder).select(*digest).collect()]
    orders = [[tuple(r) for r in records.shuffled(spark, folder, seed, 3).select(*digest).collect()] for seed in (1, 1, 2)]
    assert all(sorted(o) == sorted(plain) for o in orders)
    assert orders[0] == orders[1] != orders[2] != plain


def test_broken_files_are_told(spark, written):
    _, _, folder = written
    name = next(f for f in sorted(os.listdir(folder.removeprefix("file:"))) if f.endswith(".rec"))
    with open(f"{folder.removeprefix('file:')}/{name}", "rb") as f:
        good = f.read()

    def parse(data):
        at = [0]

        def take(n):
            at[0] += n
            return data[at[0] - n : at[0]]

        return sum(map(len, records.parsed(take, "x")))

    n = parse(good)
    assert n > 1
    for broken in (good[:-1], good + b"\0", bytes([good[0] ^ 1]) + good[1:], good[:20] + bytes([good[20] ^ 4]) + good[21:], good[:7] + b"\x7f" + good[8:]):
        with pytest.raises(records.BrokenRecord):
            parse(broken)


def test_only_committed_files_stay(spark, written):
    _, _, folder = written
    writer = records._Writer(tables.new_folder(spark), 2)
    store, root = records.fs.FileSystem.from_uri(writer.path)
    store.create_dir(root)
    for name in ("part-000000-lost.rec", "part-000000-lost.idx", "part-000000-kept.rec", "part-000000-kept.idx"):
        store.open_output_stream(f"{root}/{name}").close()
    writer.commit([records.Written(0, "part-000000-kept", 1, 1), None])
    assert sorted(os.listdir(root)) == [records.MANIFEST, "part-000000-kept.idx", "part-000000-kept.rec"]


# --- spelling variants -----------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    return any((a[:i] + a[i + 1 :] if len(a) == len(b) else a) == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_words(docs):
    counts = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) if (v := near[w]) and max(n[x] for x in v) >= 5 * n[w] else None for w in n}
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return sorted((w, form[w] or "", root[w], n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def spelled(docs_df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.grouped(docs_df).collect())


def test_variants_agree_with_brute_force(spark):
    rng = np.random.default_rng(11)
    base = ["spelling", "variant", "grouping", "résumé", "Segments", "aaaaaa", "ababab"]
    words = []
    for w in base:
        words += [w] * 150
        for _ in range(14):
            i, c = int(rng.integers(0, len(w))), "abÀé×"[int(rng.integers(0, 5))]
            words += [[w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]][int(rng.integers(0, 3))]] * int(rng.integers(2, 30))
    words = list(rng.permutation(words))
    docs = [(int(i), " ".join(words[i::90]) + ("." if i % 2 else "_9")) for i in range(90)] + [(90, None), (91, ""), (92, "x" * 5000), (3, words[0] + "-" + words[1]), (None, "spelling spelling")]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], f"{DOCS}, word string, n int").repartition(4)
    got = spelled(df)
    assert got == brute_words(docs)
    assert any(r[1] and r[2] != r[1] for r in got) or any(r[1] for r in got)


def test_a_hot_half_loses_no_pair(spark):
    """Hundreds of words that share their first half, in all ways to differ by one edit."""
    words = {"pre" + "".join(x) for n in (3, 4) for x in itertools.product("abcd", repeat=n)}
    df = spark.createDataFrame([(w, 10) for w in sorted(words)], "word string, n long")
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if a < b and one_edit(a, b)}
    got = spelling.near_pairs(df).select("a", "b").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_chains_lead_to_the_last_form(spark):
    chain = [("a" * 6 + "b" * i, 5**i) for i in range(1, 12)]
    forms = tables.settle(spelling.variants(spark.createDataFrame(chain, "word string, n long")))
    assert {r.word: r.root for r in spelling.rooted(forms).collect()} == {w: chain[-1][0] for w, _ in chain}


def test_tables_without_words(spark):
    assert spelled(spark.createDataFrame([], DOCS)) == []
    assert spelled(spark.createDataFrame([(1, None), (2, ""), (3, "short 12")], DOCS)) == []
