"""Every operator on small tables with hard cases, against plain versions."""

import random
import tracemalloc
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratadoc.llm import (
    decontamination,
    disclosure,
    embedding_dups,
    language,
    minmax_dups,
    packing,
    suffix_dedup,
    token_files,
    toxicity,
    url_rules,
)
from stratadoc.llm.common import ready, slices
from stratadoc.llm.tokens import WordwiseEncoder

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
#: Columns whose names the operators use themselves.
CLASHING = "row long, part int, n long, key long, label string, ids binary, score double, spans string, lang string, start long"
SCHEMA = f"doc_id long, text string, {CLASHING}"


def prose(seed, n):
    pick = random.Random(seed)
    stems = ["alto", "berin", "canto", "delo", "erum", "fano", "gilo", "Hanu", "io", "jera", "kilo", "lumo"]
    return " ".join(pick.choice(stems) + pick.choice(["", "s", "n", "ra", ",", "."]) for _ in range(n))


def hard_documents():
    passage = prose(1, 80)
    copy = passage.split()
    copy[40] = "otherword"
    texts = [
        (1, passage),
        (2, passage),
        (3, " ".join(copy)),
        (4, prose(2, 60) + " " + " ".join(passage.split()[:30]) + " " + prose(3, 60)),
        (5, ""),
        (6, None),
        (7, "one"),
        (8, "one"),
        (9, "A b\tc\n\n  d   e "),
        (10, "x" * 20_000),
        (11, "x" * 20_000 + " y"),
        (12, "ab" * 300 + " é ñ 文字 ſ İ don't <|endoftext|> 1 2 3"),
        (13, prose(4, 6000)),
        (14, "mail a.b+c@d-e.example.org, x@y 1.2.3.4 999.1.1.1 4111 1111 1111 1111 and +1 (555) 010-9999 5.6.7.8.9.10.11.12"),
        (15, "+12 34 4111-1111-1111-1112 " + "7" * 40 + " a@b.c_d@e.f +1 2"),
        (16, "\x00 \x1c z"),
        (17, "pay 4111 1111 1111 1111, call +1 (555) 010-9999!"),
        (None, passage),
        (None, "nobody's text"),
    ]
    return texts


def documents(spark, texts):
    rows = [(i, t, 9, 9, 9, 9, None, None, 0.5, "s", None, 9) for i, t in texts]
    return ready(spark).createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, hard_documents())


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


def by_id(df, *columns):
    """Rows of a result by id; lists, as ids may repeat."""
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(tuple(r[c] for c in columns))
    return {k: sorted(v, key=repr) for k, v in out.items()}


def expected(texts, values):
    out = defaultdict(list)
    for (i, _), v in zip(texts, values):
        out[i].append(v)
    return {k: sorted(v, key=repr) for k, v in out.items()}


@pytest.mark.parametrize(("path", "spaces", "name"), [(BYTE, "lead", "byte_bpe_50k.json"), (WORD, "drop", "word_bpe_49k.json")])
def test_wordwise_encoding_is_the_library(path, spaces, name):
    pick = random.Random(3)
    letters = list("aAzZéÉß09 .,'!?-\n\t sT́ İſΣς文字\x1c\x0b\r<|>½²_ª") + ["don't", " '", "  ", "\n\n", "<|endoftext|>", " "]
    texts = [t for _, t in hard_documents()] + ["".join(pick.choices(letters, k=pick.randint(0, 25))) for _ in range(4000)]
    encoder = WordwiseEncoder(path, spaces, most_words=500)
    found = []
    for first in range(0, len(texts), 700):
        ids, counts = encoder.encode(texts[first : first + 700], 2)
        found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == brute.encoded(texts, name)


@pytest.mark.parametrize(("path", "spaces", "name"), [(BYTE, "lead", "byte_bpe_50k.json"), (WORD, "drop", "word_bpe_49k.json")])
def test_encoding_cuts_arrow_texts_at_the_ends_of_words(path, spaces, name):
    pick = random.Random(5)
    words = ["tree", "Été", "x", "don't", "7", "?!", "a.b", "\0", ""]
    joints = [" ", "  ", ". ", ", ", ".\n", "\n", "\n ", "\n\n", ":", "; ", "! "]
    texts = [None, "", *["".join(pick.choice(words) + pick.choice(joints) for _ in range(pick.randint(0, 9))) for _ in range(3000)]]
    ids, counts = WordwiseEncoder(path, spaces).encode(pa.array(texts).slice(1), 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == brute.encoded(texts[1:], name)
    # A word is one piece, whatever follows it.
    encoder = WordwiseEncoder(path, spaces)
    encoder.encode(pa.array([f"of {a}{m} {a}{m}" for a in ("tree", "wood", "leaf") for m in ".,;:!?"]), 2)
    assert len(encoder._known) <= 1 + 3 + 6


def test_pieces_that_share_a_hash_stay_apart(monkeypatch):
    from stratadoc.llm import tokens

    texts = ["one two three", "two three four", "four one two", "", "three"]
    monkeypatch.setattr(tokens, "_hashes", lambda pieces: np.zeros(len(pieces), np.uint64))
    encoder = WordwiseEncoder(BYTE, "lead")
    found = []
    for first in range(len(texts)):
        ids, counts = encoder.encode(texts[first : first + 1], 2)
        found += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == brute.encoded(texts, "byte_bpe_50k.json")


def test_grammar_holds_narrow_arrays():
    """Same grammar as ever, at most 85 bytes an id; overlapping runs, one rule within another."""
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, 200_000) % 5_000).astype(np.uint32)
    lengths = np.full(200, 1_000)
    tracemalloc.start()
    left, right, symbols, sizes = token_files.repair(ids, lengths, 5_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 85 * len(ids)
    spans = [1] * 5_000
    for a, b in zip(left.tolist(), right.tolist()):
        spans.append(spans[a] + spans[b])
    assert token_files.expansion_lengths(left, right, 5_000).tolist() == spans[5_000:] and max(spans) > 4
    shard = token_files.TokenShard(token_files.pack_shard(list(range(200)), ids, lengths, 5_000))
    assert np.array_equal(shard.all_ids(), ids) and sizes.sum() == len(symbols)


def test_every_second_place_of_a_run_gives_way():
    after = np.arange(1, 31)
    at = np.array([0, 1, 2, 4, 5, 9, 10, 11, 12, 20, 22])
    kind = np.array([7, 7, 7, 7, 7, 7, 7, 3, 3, 3, 3])
    expected = [True, False, True, True, False, True, False, True, False, True, True]
    assert token_files._alternate(at, after, kind).tolist() == expected


@pytest.mark.parametrize("path, spaces, name", [(BYTE, "lead", "byte_bpe_50k.json"), (WORD, "drop", "word_bpe_49k.json")])
def test_whole_words_are_shown_together(path, spaces, name, monkeypatch):
    from stratadoc.llm import tokens

    texts = ["Élan \0abc abc", "ÀB \u00aa \u00b5x año a\nb É", "\0", "", "one, Two3 don't naïve"]
    sizes, plain = [], tokens.charmap_decode
    monkeypatch.setattr(tokens, "charmap_decode", lambda data, *rest: (sizes.append(len(data)), plain(data, *rest))[1])
    encoder = WordwiseEncoder(path, spaces)
    ids, counts = encoder.encode(texts, 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == brute.encoded(texts, name)
    assert max(sizes) > 30


@pytest.mark.parametrize("end", ["\x00", "\x1f", "\x85", "\xa0", "\u2003", "\u3000", "\n", "\x7f", "é", "a", ""])
def test_pieces_that_end_in_white_space(end):
    texts = [f"one{end} two{end}  three{end}", f" {end}", f"x{end}{end} y", end]
    encoder = WordwiseEncoder(BYTE, "lead")
    ids, counts = encoder.encode(texts, 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == brute.encoded(texts, "byte_bpe_50k.json")


def test_token_files(spark, docs, nothing):
    texts = sorted(hard_documents(), key=lambda d: (d[0] is not None, d[0] or 0))
    ids = brute.encoded([t for _, t in texts], "byte_bpe_50k.json")
    rows = sorted(token_files.token_files(docs, BYTE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    assert rows[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    found = [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows]
    assert sorted(found, key=repr) == sorted([(i, len(x), brute.crc(x)) for (i, _), x in zip(texts, ids)], key=repr)
    assert token_files.token_files(nothing, BYTE).count() == 0


def test_grammar_round_trip_and_slices():
    pick = np.random.default_rng(1)
    docs = [pick.integers(0, 5, n) for n in (0, 1, 2, 400, 0, 3000, 7)] + [np.zeros(500, int), np.tile([1, 2, 3], 200)]
    ids, lengths = np.concatenate(docs).astype(np.uint32), np.array([len(d) for d in docs])
    shard = token_files.TokenShard(token_files.pack_shard([3, None, *range(7)], ids, lengths, 5))
    assert shard.doc_ids == [3, None, *range(7)]
    assert (shard.all_ids() == ids).all()
    assert len(shard.symbols) < len(ids) / 2 and len(shard.left) > 3
    for number, doc in enumerate(docs):
        for a, b in ((0, len(doc)), (len(doc) // 3, len(doc) // 2), (max(len(doc) - 1, 0), len(doc))):
            assert shard.slice(number, a, b).tolist() == doc[a:b].tolist()


def check_pieces(rows, texts, window):
    ids = defaultdict(list)
    for (i, _), x in zip(texts, brute.encoded([t for _, t in texts], "word_bpe_49k.json")):
        ids[i].append(x)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert any(len(x) == r["doc_tokens"] and brute.crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end == window or end & (end - 1) == 0


@pytest.mark.parametrize("window", [4096, 64])
def test_packing(docs, nothing, window):
    check_pieces(packing.pack(docs, WORD, window=window).collect(), hard_documents(), window)
    if window == 64:
        assert packing.pack(nothing, WORD, window=window).count() == 0


def test_packing_plan_places_every_document_once():
    pick = np.random.default_rng(2)
    histogram = np.bincount(pick.integers(1, 64, 3000), minlength=65)
    plan = packing.make_plan(histogram, 64)
    used = defaultdict(list)
    for length in range(1, 64):
        for rank in range(int(histogram[length])):
            pieces = plan.place(length, rank)
            assert sum(p[1] for p in pieces) == length
            for _, size, sequence, offset in pieces:
                used[sequence].append((offset, size))
    for own in used.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end == 64 or end & (end - 1) == 0
    assert plan.placed.sum() > 0.8 * histogram.sum()


def test_url_rules(spark):
    urls = [
        "http://a.example.net/en/1", "http://EXAMPLE.NET/de/", "http://x.net", "http://x.net/", "https://q.org/fr/1?u=http://z.net/",
        "http://example.com/de/x#y", "http://notexample.com/de/", "mailto:x", None, "", "http://x.example.net:80/en/", "://b.org/fr/",
        "http://a.casino-win.org/", "http://b.casinos.org/", "http://b.net/casino-x", "ftp://ÄB.Net/ö",
        "http://x\ny.net/a", "http://x\n.example.net/en/\n/z", "http://example.com\n/de/", "http://net\n/", "http://a\r.ORG/fr/",
    ]
    rows = [(k // 2, u, "clash") for k, u in enumerate(urls)] + [(None, "http://n.net/", None)]
    pages = ready(spark).createDataFrame(rows, "page_id long, url string, verdict string")
    found = sorted((tuple(r) for r in url_rules.judge(pages).collect()), key=repr)
    want = []
    for page, address, _ in rows:
        host, path, best = brute.url(address)
        verdict = best[0] if best else "block" if "casino-" in (address or "") else "allow"
        want.append((page, host, path, best[1] if best else None, verdict))
    assert found == sorted(want, key=repr)
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_thousands_of_rules(spark):
    pick = random.Random(8)
    names = [f"{a}{b}" for a in ("alpha", "beta", "gam", "del", "eps") for b in range(12)]
    host = lambda: ".".join(pick.choice(names) for _ in range(pick.randint(1, 3))) + pick.choice([".com", ".org"])
    path = lambda: "/" + "/".join(pick.choice(names) for _ in range(pick.randint(0, 2)))
    listed = {f"{host()}{path()}": pick.choice(["block", "allow"]) for _ in range(4000)}
    urls = [f"http://{pick.choice(['', 'www.', 'x'])}{host()}{path()}/{pick.choice(names)}" for _ in range(1500)]
    pages = ready(spark).createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(pages, [url_rules.host_rule(v, t) for t, v in listed.items()]).collect()}
    hits = 0
    for k, address in enumerate(urls):
        own_host, own_path = address[7:].split("/", 1)[0], "/" + address[7:].split("/", 1)[1]
        fits = [t for t in listed if (own_host == t.split("/")[0] or own_host.endswith("." + t.split("/")[0])) and own_path.startswith(t[t.index("/") :])]
        if fits:
            best = max(map(len, fits))
            assert len(found[k][0]) == best and found[k][0] in fits and found[k][1] == listed[found[k][0]]
            hits += 1
        else:
            assert found[k] == (None, "allow")
    assert hits > 100


def test_rules_are_filed_under_their_rarest_token():
    rules = (url_rules.host_rule("block", "example.net/en"), url_rules.pattern_rule("block", "x"))
    assert rules[0].literals == {"example", "net"}  # "en" may go on in the URL
    assert url_rules.index_rules(rules, {"example": 5, "net": 2}) == {"net": [0], None: [1]}


def test_embedding_dups(spark):
    pick = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = pick.standard_normal(16)
        for m in range(4):
            rows.append((4 * k + m, (base + 0.12 * m * pick.standard_normal(16)).tolist(), k % 3))
    rows += [(240 + k, rows[0][1], 0) for k in range(7)]
    center = pick.standard_normal(16)
    rows += [(300 + k, (center + 0.05 * pick.standard_normal(16)).tolist(), 1) for k in range(90)]
    sound = list(rows)
    bad = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] * 16, 1), (504, [None] * 16, 1),
           (505, rows[0][1], None), (506, [float("inf")] + [0.0] * 15, 0)]
    other = [(507, rows[0][1][:8], 0)]
    table = ready(spark).createDataFrame([(*r, 1.0, 2) for r in rows + bad + other], "vec_id long, embedding array<double>, label int, rep double, n int")
    found = {r["vec_id"]: tuple(r)[1:] for r in embedding_dups.near_vectors(table, block_rows=20).collect()}
    links = brute.cosine_links(sound)
    label = brute.components([r[0] for r in rows + bad + other], links)
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = {i: (degree[i], c, c == i) for i, c in label.items()}
    assert set(found) == set(want)
    # Hashing may miss a pair near the threshold.
    assert sum(found[i] != want[i] for i in want) <= 2
    assert sum(n for n, _, _ in found.values()) >= 0.99 * 2 * len(links)
    assert embedding_dups.near_vectors(table.limit(0)).count() == 0


def test_embedding_dups_with_repeated_ids(spark):
    pick = np.random.default_rng(14)
    base = pick.standard_normal(16)
    near = [(base + 0.02 * pick.standard_normal(16)).tolist() for _ in range(5)]
    far = pick.standard_normal(16).tolist()
    rows = [(3, near[0], 1), (3, near[1], 1), (5, near[2], 1), (3, far, 1), (4, far, 1), (None, far, 1), (9, near[3], 2), (7, near[3], 2), (7, near[3], 2)]
    table = ready(spark).createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((tuple(r) for r in embedding_dups.near_vectors(table, block_rows=2).collect()), key=str)
    want = [(3, 2, 3, True)] * 2 + [(5, 2, 3, False), (3, 1, 3, True), (4, 1, 3, False), (None, 0, None, True), (9, 2, 7, False)] + [(7, 2, 7, True)] * 2
    assert found == sorted(want, key=str)


@pytest.mark.parametrize("block_hashes", [8_000_000, 40])
def test_decontamination(spark, docs, nothing, block_hashes):
    passage = hard_documents()[0][1].split()
    items = [(7, " ".join(passage[:9] + ["novel"] + passage[9:30])), (70, " ".join(passage[5:20]).upper()), (8, "one"), (9, None), (10, ""), (None, "d e"), (11, "..."), (12, " ".join(passage[5:20]))]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    found = by_id(decontamination.judged(docs, benchmark, block_hashes=block_hashes), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    texts = hard_documents()
    want = brute.contamination([t for _, t in texts], [(i, t) for i, t in items if i is not None])
    assert found == expected(texts, want)
    assert sum(w[4] for w in want) >= 5
    if block_hashes == 40:
        assert decontamination.judged(nothing, benchmark).count() == 0
        assert not any(r["contaminated"] for r in decontamination.judged(docs, benchmark.limit(0)).collect())


def test_personal_data(docs, nothing):
    texts = hard_documents()
    found = by_id(disclosure.judged(docs), "spans", "n_email", "n_ip", "n_card", "n_phone")
    want = []
    for _, text in texts:
        spans = brute.personal(text)
        counts = [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        want.append((",".join(f"{k}:{a}:{b}" for k, a, b in spans), *counts))
    assert found == expected(texts, want)
    assert disclosure.judged(nothing).count() == 0
    clean = by_id(disclosure.sanitised(docs), "text", "spans", "n")
    assert clean[6] == [(None, "s", 9)] and clean[1] == [(texts[0][1], "s", 9)]
    assert clean[14][0][0].startswith("mail [EMAIL], x@y [IP] 999.1.1.1 4111 ")
    assert clean[17][0][0] == "pay [CARD], call [PHONE]!"


def test_disclosing_terms(spark):
    """Counts over whole texts: a name far from the address, one in a footer, in copies, and by a hot address."""
    rows = []
    for k in range(60):
        far = f"{prose(100 + k, 60)} Quillsmith {prose(200 + k, 60)} q@example.org {prose(300 + k, 12)}"
        rows.append((k, far if k < 8 else prose(400 + k, 30)))
    rows += [(100 + k, "Uniqueword says s@example.org here") for k in range(9)]  # copies
    rows += [(200 + k, f"{prose(500 + k, 20)}\nFooterman f@example.org") for k in range(9)]  # one footer
    rows += [(300 + k, f"{prose(600 + k, 20)} hot@example.org {'Hotname' if k % 2 else 'other'}") for k in range(80)]
    rows += [(400, "Rareword r@example.org"), (401, "Rareword r@example.org too"), (402, "Footerman alone, QUILLSMITH ALONE"), (100, "Uniqueword, another s@example.org row")]
    rows += [(None, "Uniqueword without an id s@example.org"), (500, None), (501, "")]
    docs = documents(spark, rows)
    found = by_id(disclosure.judged(docs), "spans")
    texts = [t for _, t in rows]
    want = [",".join(f"{k}:{a}:{b}" for k, a, b in brute.personal(t) + added) for t, added in zip(texts, brute.disclosed(texts))]
    assert found == expected(rows, [(w,) for w in want])
    assert want[0].count("term") == 1 and want[60].count("term") == 3 and "term" in want[69] and "term" not in want[-5]
    clean = by_id(disclosure.sanitised(docs), "text")
    assert "Quillsmith" not in " ".join(t for k in range(8) for (t,) in clean[k])
    assert clean[200][0][0].endswith("[TERM] [EMAIL]") and clean[402] == [("Footerman alone, QUILLSMITH ALONE",)]
    assert clean[None] == [("[TERM] [TERM] an id [EMAIL]",)] or clean[None][0][0].startswith("[TERM]")


def test_language(spark, nothing):
    words = {"xa": "lorem ipsum dolor sit amet consectetur", "yb": "přes žluťoučký kůň úpěl ďábelské", "zc": "на дворе трава на траве дрова"}
    rows = []
    for k in range(400):
        lang = sorted(words)[k % 3]
        pick = random.Random(k)
        text = " ".join(pick.choices(words[lang].split(), k=pick.randint(3, 40)))
        rows.append((k, text, None if k % 50 == 0 else lang, 1.0))
    rows += [(1000, None, "xa", 1.0), (1001, "12 ½ ² ① Ⅷ ... !", "yb", 1.0), (1002, "", None, 1.0), (1003, "lorem " * 9000, "xa", 1.0), (None, "ipsum dolor", "xa", 1.0), (5, rows[5][1], "zc", 1.0)]
    table = ready(spark).createDataFrame(rows, "doc_id long, text string, lang string, score double")
    found = by_id(language.identify(table), "held_out", "lang_pred", "score")
    import zlib

    assert all(found[k][0][0] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(400))
    assert all(found[k][0][1] == sorted(words)[k % 3] and 0 <= found[k][0][2] <= 1 for k in range(400))
    assert [found[k][0][1] for k in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xa"]
    assert found[None][0][:2] == (False, "xa") and len(found[5]) == 2
    assert language.identify(nothing).count() == 0
    unlabelled = language.identify(table.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in unlabelled.collect()} == {("und", 0.0)}


def test_language_is_kernel_ridge_regression(spark):
    """Scores against a plain kernel matrix over the whole sample; with as many landmarks as rows they agree."""
    words = {"xa": "lorem ipsum dolor sit amet", "yb": "přes žluťoučký kůň úpěl", "zc": "на дворе трава дрова"}
    rows = []
    for k in range(90):
        pick = random.Random(k)
        lang = sorted(words)[k % 3]
        rows.append((k, " ".join(pick.choices(words[lang].split() + words["xa"].split(), k=6)) + f" {k}", lang))
    table = ready(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(table).collect()}
    grams = [{n: {t[a : a + n] for a in range(len(t) - n + 1)} for n in (1, 2, 3)} for t in (r[1].lower().encode() for r in rows)]
    kernel = np.array([[np.mean([len(x[n] & y[n]) / np.sqrt(len(x[n]) * len(y[n])) for n in (1, 2, 3)]) for y in grams] for x in grams])
    import zlib

    learned = [k for k in range(90) if zlib.crc32(str(k).encode()) % 5]
    names = sorted(words)
    y = np.array([[1.0 if rows[k][2] == name else -1.0 for name in names] for k in learned])
    count = (y > 0).sum(axis=0)
    weight = np.array([len(learned) / count[names.index(rows[k][2])] for k in learned])
    # Weighted ridge with a penalised bias: the bias is one more feature that is always present.
    own = kernel[np.ix_(learned, learned)] + 1
    alpha = np.linalg.solve(own + language.RIDGE * len(learned) * np.diag(1 / weight), y)
    score = (kernel[:, learned] + 1) @ alpha
    assert all(found[k][0] == names[int(score[k].argmax())] for k in range(90))
    # Presence is hashed into buckets, so kernels agree up to a few collisions.
    assert np.mean([abs(found[k][1] - np.clip((score[k].max() + 1) / 2, 0, 1)) for k in range(90)]) < 0.02


def test_every_language_is_learned(spark):
    pick = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {f"l{n:03d}": ["".join(pick.choices(letters, k=5)) for _ in range(6)] for n in range(260)}
    rows = [(k, " ".join(pick.choices(stems[f"l{k % 260:03d}"], k=12)), f"l{k % 260:03d}") for k in range(1560)]
    table = ready(spark).createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.identify(table).where("not held_out").collect()
    right = sum(r["lang_pred"] == f"l{r['doc_id'] % 260:03d}" for r in found)
    assert right > 0.95 * len(found) and len({r["lang_pred"] for r in found}) > 250


def test_toxicity(spark, nothing):
    import zlib

    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        text = prose(1000 + k, 30 + k % 50).split()
        if toxic:
            text.insert(k % 20, "wretchface")
            text.insert(k % 11, "Wretchface!")
        if k % 3 == 0:
            text.insert(5, "muslim" if toxic or k % 2 else "christian")
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "Many muslim women and gay men live here"), (2003, prose(7, 20_000)), (None, "wretchface wretchface"), (1, rows[1][1])]
    labels += [(3000, 1), (None, 1), (4, None), (5, 7), (8, 1), (8, 0)]
    docs = documents(spark, rows)
    table = spark.createDataFrame([(i, t, 0.5) for i, t in labels], "doc_id long, toxic int, score double")
    found = by_id(toxicity.classify(docs, table), "held_out", "score", "predicted")
    assert all(found[k][0][0] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(600))
    wrong = [k for k in range(600) if found[k][0][2] != (k % 4 == 0)]
    assert len(wrong) <= 6
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for own in found.values() for _, s, p in own)
    assert [found[k][0][2] for k in (2000, 2001, 2002, 2003)] == [0, 0, 0, 0]
    assert found[None][0][0] is False and len(found[1]) == 2
    assert toxicity.classify(nothing, table).count() == 0
    assert {r["predicted"] for r in toxicity.classify(docs, table.limit(0)).collect()} == {0}


def test_swapping_identity_terms_lowers_their_weight():
    pick = np.random.default_rng(5)
    toxic = (np.arange(400) % 2).astype(int)
    x = np.zeros((400, 2), np.int8)
    x[:, 0] = toxic & (pick.random(400) < 0.9)
    x[:, 1] = np.where(toxic, pick.random(400) < 0.8, pick.random(400) < 0.2)  # the mention goes along with the label
    changed = np.flatnonzero(x[:, 1])
    pairs = np.zeros((len(changed), 2), np.int8)
    pairs[:, 1] = -1
    free, _ = toxicity.fit(x, toxic, np.ones(400), pairs[:0], changed[:0])
    held, _ = toxicity.fit(x, toxic, np.ones(400), pairs, changed)
    assert free[1] > 1 and abs(held[1]) < 0.3 * free[1] and held[0] > 1
    swap = toxicity.swapper(toxicity.IDENTITY_TERMS)
    assert swap("A Muslim man") == "A jewish woman" and swap("nothing here") is None


def test_suffix_dedup(docs, nothing, monkeypatch):
    texts = hard_documents()
    want = expected(texts, brute.repeats(texts))
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(suffix_dedup.remove_repeats(docs), *columns) == want
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    assert by_id(suffix_dedup.remove_repeats(docs, with_text=True), *columns) == want
    assert suffix_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [2, 5, 1000])
def test_suffix_dedup_of_a_hot_passage(spark, monkeypatch, hot):
    """A passage in every document with other neighbours each time, over many chunks; ids at the end of the range."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_KINDS", min(hot, 3))
    passage = prose(80, 40)
    texts = [(k, f"{prose(900 + k, 4 + k % 9)} {passage} {prose(1100 + k, 4 + k % 7)}") for k in range(90)]
    texts += [(2**63 - 1, passage + " x"), (2**63 - 1, "y " + passage), (-(2**63), "z " + passage)]
    found = by_id(suffix_dedup.remove_repeats(documents(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == expected(texts, brute.repeats(texts))


def test_longest_previous_factors():
    pick = np.random.default_rng(9)
    for size in (60, 200, 260):
        data = pick.integers(97, 99, size).astype(np.uint8)
        data[size // 2 :] = data[: size - size // 2]
        places = np.sort(pick.choice(size - 49, (size - 49) * 3 // 4, replace=False))
        strings = [data[p : p + 50].tobytes() for p in places]
        agree = lambda x, y: next((n for n in range(50) if x[n] != y[n]), 50)
        length, source = suffix_dedup.longest_previous(*suffix_dedup.suffix_order(data, places))
        for k, own in enumerate(strings):
            best = max((agree(own, s) for s in strings[:k]), default=0)
            assert length[k] == best and (best == 0 or (source[k] < k and agree(own, strings[source[k]]) == best))
        assert suffix_dedup.first_copies(data, places).tolist() == [strings.index(s) for s in strings]


def test_suffix_dedup_on_overlapping_mixtures(spark):
    pick = random.Random(9)
    pool = [prose(50 + k, 25) for k in range(6)]
    texts = [(k // 2 if k % 7 == 0 else k, "".join(p[pick.randint(0, 40) :][: pick.randint(20, 150)] for p in pick.choices(pool, k=6))) for k in range(60)]
    found = by_id(suffix_dedup.remove_repeats(documents(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == expected(texts, brute.repeats(texts))


def test_toxicity_is_a_regularised_logistic_fit():
    """Probabilities against Newton's method on the same loss, with and without the counterfactual term."""
    pick = np.random.default_rng(12)
    x = (pick.random((300, 6)) < 0.4).astype(np.int8)
    toxic = (pick.random(300) < 1 / (1 + np.exp(-(x @ np.array([2.0, -1, 1, 0, 0.5, -2]) - 0.3)))).astype(int)
    weight = np.where(toxic, 1.5, 1.0)
    pairs = np.zeros((40, 6), np.int8)
    pairs[:, 0], pairs[:, 1] = 1, -1
    for own in (pairs[:0], pairs):
        w, bias = toxicity.fit(x, toxic, weight, own, np.arange(len(own)))
        a = np.hstack([x, np.ones((300, 1))]).astype(float)
        share, beta = weight / weight.sum(), np.zeros(7)
        change = np.zeros((7, 7))
        change[:6, :6] = toxicity.RIDGE * np.eye(6)
        if len(own):
            change[:6, :6] += toxicity.COUNTERFACTUAL * own.T.astype(float) @ own / len(own)
        for _ in range(60):
            p = 1 / (1 + np.exp(-a @ beta))
            slope = a.T @ (share * (p - toxic)) + change @ beta
            beta -= np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + change + 1e-12 * np.eye(7), slope)
        assert np.abs(1 / (1 + np.exp(-(x @ w + bias))) - 1 / (1 + np.exp(-a @ beta))).max() < 0.03


def test_near_copies(spark, docs, nothing):
    pick = random.Random(11)
    texts = [d for d in hard_documents() if d[0] is not None]
    base = prose(60, 120).split()
    for k in range(80):  # one large group in which some are too different from the first
        own = list(base)
        for _ in range(pick.randint(0, 7)):
            own[pick.randrange(len(own))] = f"edit{pick.randint(0, 999)}"
        texts.append((100 + k, " ".join(own)))
    want = brute.near_copies(texts)
    rows = by_id(minmax_dups.near_duplicates(documents(spark, texts + [texts[0], (None, texts[0][1]), (None, None)])), "n_shingles", "component_id", "kept")
    nobody = rows.pop(None)
    assert [(c, k) for _, c, k in nobody] == [(None, True)] * 2
    assert rows == {i: [(n, c, c == i)] * (2 if i == texts[0][0] else 1) for i, (n, c) in want.items()}
    assert minmax_dups.near_duplicates(nothing).count() == 0


def most_frequent_pair(symbols, sizes):
    first = np.zeros(len(symbols) + 1, bool)
    first[np.cumsum(sizes) - sizes] = True
    pairs = np.stack([symbols[:-1], symbols[1:]])[:, ~first[1:-1]]
    return np.unique(pairs, axis=1, return_counts=True)[1].max(initial=0)


@pytest.mark.parametrize("vocabulary", [60_000, 1 << 30])
def test_grammar_leaves_no_frequent_pair(vocabulary):
    pick = np.random.default_rng(6)
    passage = pick.integers(0, 60_000, 3000)
    docs = [passage[pick.integers(0, 20) :] for _ in range(40)]  # a hot passage: far longer than 64 ids
    docs += [np.tile(np.arange(9000), 5), np.zeros(7000, int), pick.integers(0, 300, 90_000), pick.integers(0, 2, 5000)]
    ids, lengths = np.concatenate(docs).astype(np.uint32), np.array([len(d) for d in docs])
    left, right, symbols, sizes = token_files.repair(ids, lengths, vocabulary)
    assert most_frequent_pair(symbols, sizes) < 4
    assert sizes[:40].max() < 30  # 6 rounds leave about 47 symbols of each copy at best
    if vocabulary == 60_000:
        shard = token_files.TokenShard(token_files.pack_shard(list(range(len(docs))), ids, lengths, vocabulary))
        assert (shard.all_ids() == ids).all() and shard.spans.max() > 1000
        for number, a, b in ((0, 700, 1900), (39, 5, 6), (41, 0, 7000), (42, 100, 5000), (3, 2900, 10_000)):
            assert shard.slice(number, a, b).tolist() == docs[number][a:b].tolist()


def test_near_copies_compare_every_candidate(spark):
    """Pairs whose signatures differ in many values, in buckets whose smallest member is like none of them."""
    pick = random.Random(21)
    fresh = lambda n: [f"w{pick.randrange(10**9)}" for _ in range(n)]
    base = fresh(80)
    texts = [(0, " ".join(base + fresh(40)))]
    for k in range(1, 81, 2):
        shared = fresh(25)
        texts += [(k, " ".join(base + shared + fresh(30))), (k + 1, " ".join(base + shared + fresh(30)))]
    want = brute.near_copies(texts, 60)
    assert [want[k][1] for k in (0, 1, 2, 79, 80)] == [0, 1, 1, 79, 79]
    rows = ready(spark).createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minmax_dups.near_duplicates(rows, percent=60).collect()}
    assert found == {i: c for i, (_, c) in want.items()}


def test_near_copies_with_repeated_ids(spark):
    words = prose(70, 60).split(), prose(71, 60).split()
    near = [" ".join(w[:30] + ["edit"] + w[31:]) for w in words]
    texts = [(7, " ".join(words[0])), (7, " ".join(words[1])), (9, near[1]), (11, near[0]), (7, "something else"), (12, "something else")] + [(8, near[0])] * 3
    rows = ready(spark).createDataFrame(texts, "doc_id long, text string")
    found = sorted((r["doc_id"], r["component_id"]) for r in minmax_dups.near_duplicates(rows).collect())
    assert found == sorted([(7, 7)] * 3 + [(9, 7), (11, 7), (12, 7)] + [(8, 7)] * 3)


@pytest.mark.parametrize("block_rows", [7, 40])
def test_near_copies_in_blocks(spark, monkeypatch, block_rows):
    """Buckets of hundreds with several components of which no leader is like the others."""
    monkeypatch.setattr(minmax_dups, "BLOCK_ROWS", block_rows)
    pick = random.Random(31)
    fresh = lambda n: [f"w{pick.randrange(10**9)}" for _ in range(n)]
    base, texts = fresh(80), []
    for group in range(70):
        shared = fresh(25)
        texts += [(4 * group + m, " ".join(base + shared + fresh(30))) for m in range(1 + group % 4)]
    hub = fresh(25)
    texts += [(1000 + k, " ".join(base + hub + fresh(30))) for k in range(60)]
    want = brute.near_copies(texts, 60)
    rows = ready(spark).createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minmax_dups.near_duplicates(rows, percent=60).collect()}
    assert found == {i: c for i, (_, c) in want.items()} and len(set(found.values())) == 71


def test_shared_counts(monkeypatch):
    pick = np.random.default_rng(8)
    sets = [np.unique(pick.integers(0, 900, n)).astype(np.uint64) for n in (1, 50, 400, 400, 800, 3)]
    x, y = np.nonzero(np.arange(6)[:, None] < np.arange(6)[None, :])
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert minmax_dups.shared_counts(sets, x, y).tolist() == want
    monkeypatch.setattr(minmax_dups, "COLUMNS", 64)
    assert minmax_dups.shared_counts(sets, x, y).tolist() == want
    assert minmax_dups.shared_counts([sets[0], sets[0] + np.uint64(1)], x[:1], y[:1]).tolist() == [0]


def test_toxicity_holds_few_ngrams_at_a_time():
    texts = pa.RecordBatch.from_arrays([pa.array(["some words of a text, and more of them. " * 50] * 1000)], names=["text"])
    lookup = np.full(1 << toxicity.HASH_BITS, -1, np.int16)
    tracemalloc.start()
    for part in slices(texts, "text", toxicity.SLICE_BYTES):
        toxicity.presence(part.column("text"), lookup, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
