"""The Merkle manifest, quality rules and whitened components against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratadoc.llm import merkle, quality_rules, whitening
from stratadoc.llm.common import ready

CLASHING = "tree long, pos long, n long, node string, super long, part int, words string, row long, component int"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(nodes):
    """Root, and per leaf its siblings as ``left, right`` level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, p in zip(paths, places):
            first = p - p % 3
            path.append((nodes[first:p], nodes[p + 1 : first + 3]))
        places = [p // 3 for p in places]
        nodes = [sha(nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    """``rows``: ``doc_id, source, lang, n_chars, text``."""
    trees = defaultdict(list)
    for row in rows:
        trees[row[1]].append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: plain_tree([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, above = plain_tree([built[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, _, leaf, row), path in zip(sorted(trees[s], key=lambda x: x[:3]), built[s][1]):
            path = path + above[k]
            text = row[4]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = plain_leaf((*row[:4], text))
            for left, right in path:
                folded = sha([*left, folded, *right])
            proof = sha(x for left, right in path for x in (*left, *right))
            out.append((row[0], leaf, built[s][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [7, 1, 2])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SIZE", 3**levels)
    monkeypatch.setattr(merkle, "BLOCK", f"pos div {3**levels}")
    pick = random.Random(levels)
    # A hot source, sources of one to ten rows, a null source, repeated rows and ids, ids beyond doubles.
    sources = ["hot"] * 60 + [f"s{pick.randrange(9)}" for _ in range(40)] + ["é", "z", "", None, None, "ﬀ", "𝄞"]
    rows = [(k, s, pick.choice(["en", None]), pick.choice([3, None]), pick.choice(["a\nb", "c", "", None, "\n" * 9, "é\n" * 5000])) for k, s in enumerate(sources)]
    rows += [rows[3], rows[3], (3, "hot", "x", 1, "other\ntext"), (None, "hot", None, None, "n\n"), (None, None, None, None, None)]
    rows += [(2**53 + 1, "big", "en", 1, "x"), (2**53, "big", "en", 1, "x\ny"), (-5, "big", None, 0, "\n")]
    wide = [(*r, 1, 2, 3, "n", 4, 5, "w", 6, 7) for r in rows]
    docs = ready(spark).createDataFrame(wide, f"doc_id long, source string, lang string, n_chars long, text string, {CLASHING}").repartition(5)
    found = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)
    assert found == plain_manifest(rows)


def test_manifest_of_one_row_and_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = ready(spark).createDataFrame([(1, "s", "en", 2, "a\n")], schema)
    assert [tuple(r) for r in merkle.manifest(one).collect()] == plain_manifest([(1, "s", "en", 2, "a\n")])
    assert merkle.manifest(one.where("doc_id > 1")).collect() == []


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text):
    words = WORD.findall(text or "")
    times = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if times[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed


def good(n, seed):
    pick = random.Random(seed)
    return " ".join(pick.choice(["the", "of", f"word{pick.randrange(10**6)}", "and", f"thing{pick.randrange(10**6)}"]) for _ in range(n))


def test_quality_rules(spark):
    clean = good(80, 1)
    texts = [
        None, "", " \n\t ", "one", "a b", "a b c", "a a a", "a a a a", "x y z x y z", "x y z q x y z", "x y z y z x y z",
        clean, good(50, 2), good(49, 3), clean + "\r\n" + good(30, 4), good(60, 5).replace("\n", "\r") + "\x0b\x0c|",
        (clean + "\n") * 2, "line of it\n" * 40 + clean, "\n".join(["a", "a ", " a", "a", ""]) + "\n\n",
        " ".join(w + "###" for w in clean.split()), clean.upper(), " ".join("wort%d" % k for k in range(99)),
        "\n".join(f"- {good(4, 50 + k)}" for k in range(40)), "\n".join(f"{good(4, 100 + k)}..." for k in range(40)),
        "é ñ 文字 😀 " * 20 + clean, "x" * 100_000 + " " + clean, good(20_000, 6), "\x00 \x1c z w v", "a\\1 $0 .* [z] \\E " * 15,
    ]
    wide = [(k, t, 1, 2, 3, "n", 4, 5, "w", 6, 7) for k, t in enumerate(texts)] + [(None, clean, 1, 2, 3, "n", 4, 5, "w", 6, 7)] * 2
    docs = ready(spark).createDataFrame(wide, f"doc_id long, text string, {CLASHING}").repartition(3)
    rows = quality_rules.judged(docs).collect()
    assert len(rows) == len(wide) and sum(r["doc_id"] is None for r in rows) == 2
    by_id = {r["doc_id"]: r for r in rows}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for k, text in enumerate(texts):
        assert tuple(by_id[k][n] for n in names) == plain_quality(text), text[:50]
    kept = {k for k, r in by_id.items() if r["kept"]}
    assert kept == {11, 12, 14, 15, 26, None}
    broken = {k: r["broken_rules"] for k, r in by_id.items() if not r["base_failed"] and not r["kept"]}
    assert broken[20] == "capitals" and broken[21] == "stop_words"
    assert "symbols" in broken[19] and "list_lines" in broken[22] and "broken_lines" in broken[23] and "word_length" in broken[25]
    assert quality_rules.judged(docs.where("n > 99")).collect() == []


def test_quality_rules_use_no_python(spark):
    docs = ready(spark).createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in quality_rules.judged(docs)._jdf.queryExecution().toString()


def matrices():
    pick = np.random.default_rng(3)
    turn = np.linalg.qr(pick.standard_normal((40, 40)))[0]
    sample = pick.standard_normal((500, 40))
    yield sample.T @ sample / 500
    yield np.eye(7)
    yield np.diag([1.0] * 5 + [2.0] * 4)
    yield (turn * np.r_[np.full(10, 100.0), np.linspace(1, 2, 30)]) @ turn.T
    yield (turn * np.r_[np.zeros(30), 5, 5, 5, np.arange(1, 8)]) @ turn.T
    yield (turn * np.logspace(0, -12, 40)) @ turn.T
    yield np.zeros((3, 3))
    yield np.array([[4.0]])


@pytest.mark.parametrize("matrix", list(matrices()))
def test_spectral_division(matrix):
    values, vectors = whitening.eigen(matrix)
    scale = max(np.abs(matrix).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() <= 1e-13 * scale * len(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * scale * len(matrix)


def plain_whitened(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors.values()], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    centred = ((n * x - sums) / n).astype(float)
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    return n, dict(zip(vectors, deviation)), dict(zip(vectors, centred @ directions / np.sqrt(values))), values / values.sum()


@pytest.mark.parametrize("dim,kind", [(40, "float"), (6, "double")])
def test_whitening(spark, dim, kind):
    pick = np.random.default_rng(dim)
    mixed = pick.standard_normal((300, dim)) @ pick.standard_normal((dim, dim))
    vectors = {k: [float(c) for c in row.astype(np.float32)] for k, row in enumerate(mixed)}
    vectors[299] = vectors[298]
    odd = [(900, None), (901, []), (902, [None] * dim), (903, [float("nan")] * dim), (904, [float("inf")] + [0.0] * (dim - 1)), (905, [1.0] * (dim + 1))]
    rows = [(k, v, 1, 2, 3, "n", 4, 5, "w", 6, 7) for k, v in [*vectors.items(), *odd]]
    table = ready(spark).createDataFrame(rows, f"vec_id long, embedding array<{kind}>, {CLASHING}").repartition(4)
    found = whitening.whitened(table).toPandas()
    n, deviation, want, explained = plain_whitened(vectors)
    shown = min(dim, 32)
    assert len(found) == n * shown and set(found.vec_id) == set(vectors)
    assert (found.n == n).all() and (found.identity_error < 1e-6).all()
    assert all(deviation[k] == d for k, d in zip(found.vec_id, found.deviation))
    grid = found.pivot(index="vec_id", columns="component", values="whitened").loc[list(vectors)].to_numpy()
    target = np.array([want[k] for k in vectors])[:, :shown]
    target = target * np.sign((grid * target).sum(axis=0))
    assert np.abs(grid - target).max() < 1e-6
    assert np.allclose(found.groupby("component").explained.first(), explained[:shown], rtol=1e-9)


def test_whitening_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    session = ready(spark)
    assert whitening.whitened(session.createDataFrame([], schema)).collect() == []
    assert whitening.whitened(session.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []
    rows = whitening.whitened(session.createDataFrame([(1, [0.0, 5.0]), (2, [1.0, 5.0]), (None, [1.0, 5.0])], schema)).collect()
    assert [(r["vec_id"], r["component"], r["deviation"]) for r in sorted(rows, key=lambda r: r["vec_id"] or 9)] == [
        (1, 1, 128**2), (2, 1, 64**2), (None, 1, 64**2)
    ]
    far = whitening.whitened(session.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [-1e30, 3.0])], "vec_id long, embedding array<double>"))
    # Entries stop at 2 ** 40, and what leaves the range of long is null.
    assert sorted(((r["vec_id"], r["deviation"]) for r in far.where("component = 1").collect())) == [(1, None), (2, 64**2), (3, None)]
