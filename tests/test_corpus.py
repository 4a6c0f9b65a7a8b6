"""Corpus selection against a plain model on small inputs."""

import re
from urllib.parse import urlparse

import pytest

from stratadoc import fixed_values as fv
from stratadoc.functions.text import slug
from stratadoc.operators import corpus


def urls(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, url string")


def plain_slug(url):
    parts = [p for p in urlparse(url).path.strip("/").split("/") if p and p != "docs"]
    return re.sub(r"[^a-zA-Z0-9._-]+", "_", "_".join(parts)).strip("_")[:120] or "page" if parts else "home"


SLUGS = [
    "https://h/docs/", "https://h", "https://h/docs/a b/ü/c?x=1#y", "https://h/%%%", "https://h/" + "x" * 130,
    "//h/a;p/b;q=1;r", "https://h/__a__",
]


def test_slug(spark):
    rows = urls(spark, *SLUGS).withColumn("s", slug("url")).orderBy("pos").collect()
    assert [r["s"] for r in rows] == [plain_slug(u) for u in SLUGS]


def test_admission(spark):
    site = fv.SITE
    good = [f"{site}/docs/concepts/x", f"{site}/docs/reference/kubernetes-api/api-index", f"{site}/docs/a"]
    bad = [
        f"{site}/blog/x", f"{site}/docs/contribute/x", f"{site}/docs/x/_print", f"{site}/docs/reference/kubernetes-api/pod",
        "https://other.io/docs/x", "http://kubernetes.io/docs/x",
    ]
    rows = urls(spark, f" {good[0]}/ ", good[1], f'{good[2]}"junk/', *bad)
    assert [r["url"] for r in corpus.admit_urls(rows).orderBy("pos").collect()] == good


def test_first_occurrence_stays(spark):
    got = corpus.unique_urls(urls(spark, "b", "a", "b", "a")).orderBy("pos").collect()
    assert [(r["pos"], r["url"]) for r in got] == [(0, "b"), (1, "a")]


def plain_selection(values, n):
    """The same selection, one URL after the other."""
    home = fv.SITE + "/docs/home/"
    groups = {}
    for u in values:
        path = urlparse(u).path or "/"
        label = next((name for prefix, name in fv.SECTIONS if path.startswith(prefix)), "other")
        groups.setdefault(label, []).append(u)
    known = home.rstrip("/") in {u.rstrip("/") for u in values}
    chosen = [home] if known else []
    for name, quota in fv.QUOTAS:
        quota -= name == "home" and known
        chosen += [u for u in sorted(groups.get(name, [])) if u not in chosen][:quota]
    chosen = chosen[:n]
    chosen += [u for u in values if u not in chosen][: n - len(chosen)]
    if not any("/docs/home" in u for u in chosen):
        chosen = [home, *chosen[: n - 1]]
    return chosen[:n]


BASE = [f"{fv.SITE}/docs/{s}/{i:02d}" for i in range(25) for s in ("tasks", "concepts", "zzz", "setup", "reference")]


@pytest.mark.parametrize("n", [3, 70])
@pytest.mark.parametrize("extra", [[], [f"{fv.SITE}/docs/home"], [f"{fv.SITE}/docs/home/sub", f"{fv.SITE}/docs/home/other"]])
def test_quota_selection(spark, n, extra):
    values = BASE[:60] + extra + BASE[60:]
    got = corpus.select_by_quota(urls(spark, *values), n).orderBy("place").collect()
    assert [r["url"] for r in got] == plain_selection(values, n)
    assert [r["place"] for r in got] == list(range(1, len(got) + 1))


def plain_numbering(values):
    used, out = set(), []
    for seq, url in enumerate(values, 1):
        name = plain_slug(url)
        if name in used:
            name = f"{name}_{seq}"
        used.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize(
    "paths",
    [
        ["a", "a", "b", "a"],
        # A later page is named like a slug that numbering has made.
        ["a", "a", "a_2", "b", "a_2_3"],
        ["a_2", "a", "a", "a_3", "a_3_4", "a_3_4_5"],
        ["x_1", "x", "x_1_3"],
    ],
)
def test_slug_numbering(spark, paths):
    values = [f"https://h/{p}" for p in paths]
    df = spark.createDataFrame([(i + 1, u) for i, u in enumerate(values)], "seq long, url string")
    got = [r["slug"] for r in corpus.number_slugs(df).orderBy("seq").collect()]
    assert got == plain_numbering(values)


def test_build_goes_on_after_failures(spark):
    values = [f"https://h/p{i}" for i in range(8)]
    pages = spark.createDataFrame(
        [(u, f"<title>T{i}</title><article><p>x{i}</p></article>" if i not in (0, 2) else "<p>broken</p>") for i, u in enumerate(values)],
        "url string, html string",
    )
    picked = spark.createDataFrame([(1, values[0], "b"), (2, values[3], "b")], "place int, url string, bucket string")
    tried = corpus.attempts(picked, urls(spark, *values))
    assert [r["url"][-2:] for r in tried.orderBy("seq").collect()] == ["p0", "p3", "p1", "p2", "p4", "p5", "p6", "p7"]
    first = corpus.first_attempts(picked, urls(spark, *values), 4)
    assert [r["url"][-2:] for r in first.orderBy("seq").collect()] == ["p0", "p3", "p1", "p2"]
    rows = corpus.build_corpus(picked, urls(spark, *values), pages, 3).orderBy("seq").collect()
    assert [(r["seq"], r["slug"], r["title"]) for r in rows] == [(2, "p3", "T3"), (3, "p1", "T1"), (5, "p4", "T4")]
    assert rows[0]["text"] == "T3\n==\nSource: https://h/p3\n\nx3\n"


@pytest.mark.parametrize("most", [10_000, 3])
def test_build_in_rounds(spark, monkeypatch, most):
    """Most pages fail, and names collide across rounds."""
    monkeypatch.setattr(corpus, "MOST_AT_ONCE", most)
    values = [f"https://h/{'same' if i % 2 else f'p{i}'}?{i}" for i in range(60)]
    pages = spark.createDataFrame([(u, f"<article>x{i}</article>" if i % 9 == 7 else "no") for i, u in enumerate(values)], "url string, html string")
    picked = spark.createDataFrame([(1, values[16], "b")], "place int, url string, bucket string")
    order = [values[16], *[u for u in values if u != values[16]]]
    names = plain_numbering(order)
    want = [(k + 1, names[k], u) for k, u in enumerate(order) if values.index(u) % 9 == 7]
    rows = corpus.build_corpus(picked, urls(spark, *values), pages, 5).orderBy("seq").collect()
    assert [(r["seq"], r["slug"], r["url"]) for r in rows] == want[:5]
    assert corpus.build_corpus(picked, urls(spark, *values), pages, 50).count() == len(want)


def test_section_counts(spark):
    got = corpus.section_counts(corpus.section_urls(urls(spark, *BASE))).collect()
    assert {r["bucket"]: r["urls"] for r in got} == {"tasks": 25, "concepts": 25, "other": 25, "setup": 25, "reference": 25}
