"""Nearest neighbours, page texts, licence scans and the pipeline against direct computation."""
from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyscope.llm import licence_scan, neighbour_graph, site_style

VECTORS = "vec_id long, embedding array<float>, label int, rank string, score string"


def _nearest(rows, k=5):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.asarray(v, np.float32).astype(float)
    out = {}
    for q, a in good.items():
        if q % 50 == 0:
            near = [(-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 12), i) for i, b in good.items() if i != q and len(a) == len(b)]
            out[q] = [i for _, i in sorted(near)[:k]]
    return out


def _vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return [(i, (centres[i % 20] + 0.4 * rng.normal(size=dim)).astype(np.float32).tolist(), 0, "", "") for i in range(n)]


@pytest.mark.parametrize("shard", [4096, 300])
def test_recall(spark, monkeypatch, shard):
    monkeypatch.setattr(neighbour_graph, "SHARD", shard)
    monkeypatch.setattr(neighbour_graph, "BLOCK", 16)
    rows = _vectors(1500, 24)
    want = _nearest(rows)
    got: dict[int, list] = {}
    vectors = {i: np.asarray(v, float) for i, v, *_ in rows}
    for r in neighbour_graph.nearest(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-7)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 5 * len(want)


def test_copies_nulls_and_few_candidates(spark):
    rows = _vectors(120, 6)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, *x) for i, v, *x in rows]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 0, "", ""), (250, [0.0] * 6, 0, "", ""), (300, [nan] * 6, 0, "", ""), (350, [1.0, None] * 3, 0, "", ""),
             (400, [inf] * 6, 0, "", ""), (None, [1.0] * 6, 0, "", ""), (450, [1.0, 2.0], 0, "", ""), (451, [2.0, 4.0], 0, "", ""), (500, [], 0, "", "")]
    rows += rows[:4]
    got: dict[int, list] = {}
    for r in neighbour_graph.nearest(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == _nearest(rows)
    assert got[0] == [3, 6, 9, 12, 15] and got[450] == [451]
    assert neighbour_graph.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_every_node_can_be_reached():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.normal(size=(400, 8)) * 0.01 + c for c in rng.normal(size=(4, 8)) * 5])
    graph = neighbour_graph.Graph(vectors).build(1)
    nodes, _ = graph.search(vectors, 1)
    assert (nodes[:, 0] == np.arange(len(vectors))).mean() > 0.99


def test_ties_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=24)
    rows = [(i, (base * 2.0 ** (i % 9)).tolist()) for i in range(400)]  # all exactly as near
    rows += [(1000 + i, rng.normal(size=24).tolist()) for i in range(50)]
    got = {}
    for r in neighbour_graph.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 400, 50):
        assert [v for _, v in sorted(got[q])] == [v for v in range(7) if v != q][:5]


PAGES = "page_id long, url string, html string, text string, host string, removed string"


def _page(body, i):
    return (f"<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>x='</p>'</script></head><body>"
            f"<header><a>Site</a></header><nav><ul><li>menu {i}</ul></nav><div class='ad'>buy {i}</div>{body}"
            f"<form><label>mail</label><input></form><aside>side {i}</aside><section id=comments><p>nice {i}</section><footer>&copy; {i}</footer></body></html>")


def test_main_texts(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        paragraphs = [f"word{rng.randint(0, 999)} &amp;  more\n text {i}.{j}" for j in range(rng.randint(1, 6))]
        article = f"<article><h1>Title {i}</h1><p><b>Bold {i}<br>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<div class='share'>share</div></article>"
        rows.append((i, f"http://host{i % 2}.example/{i}", _page(article, i), "", "", ""))
        want[i] = " ".join([f"Title {i}", f"Bold {i}", *[" ".join(p.replace("&amp;", "&").split()) for p in paragraphs]])
    for i in range(60, 90):  # no named main part: the template's unnamed strip is the same on every page
        rows.append((i, "https://user@Plain.example:80/x", f"<div class=strip>Our great site</div><div class=c><p>Own text {i}</p><p>and {rng.random()}</p></div>", "", "", ""))
        want[i] = " ".join(rows[-1][2].split("<div class=c>")[1].replace("<p>", " ").replace("</p>", " ").replace("</div>", " ").split())
    rows += [(90, None, None, "", "", ""), (91, "u", "", "", "", ""), (92, "", "just text &lt;b&gt;", "", "", ""), (None, "x://one/", "<p>single", "", "", ""),
             (93, "x://two/", "<div hidden>no</div><p>a<b>b</b>c<!-- z --></p><template>t</template>", "", "", ""), (94, "x://deep/", "<div>" * 3000 + "deep", "", "", "")]
    want |= {90: "", 91: "", 92: "just text <b>", None: "single", 93: "abc", 94: "deep"}
    rows += rows[:2]
    got = site_style.main_texts(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_chars) == (want[r.page_id], len(want[r.page_id])), r.page_id
    assert site_style.main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_importance_is_entropy(spark):
    pages = [("h", f"<div class=a>same</div><div class=b>text {i}</div>") for i in range(4)]
    removed = site_style.removed_nodes(spark.createDataFrame(pages, "host string, html string")).collect()
    assert [r.host for r in removed] == ["h"]
    assert removed[0].removed == [site_style._hash(b"/div 0 class=a")]


def _texts(spark, bodies, host="h.example"):
    rows = [(i, f"http://{host}/{i}", b, "", "", "") for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in site_style.main_texts(spark.createDataFrame(rows, PAGES)).collect()}


@pytest.mark.parametrize("attributes", ["class='has-sidebar content'", "class='entry-content with-comments'", "class='content no-sidebar'",
                                        "class='overflow-hidden'", "aria-hidden='false'", "class='sidebar'"])
@pytest.mark.parametrize("pages", [1, 9])
def test_names_do_not_drop_the_text(spark, attributes, pages):
    bodies = [f"<nav>all {i}</nav><div {attributes}><p>The story number {i} is told here at length</p></div><div class=x>same</div>" for i in range(pages)]
    got = _texts(spark, bodies)
    assert all(f"The story number {i} is told here at length" in got[i] for i in range(pages))
    assert not any("all" in t.split() for t in got.values())


def test_named_title_is_not_the_whole_page(spark):
    bodies = [f"<h1 class='{c}'>Title {i}</h1><div class='text'>Body of page {i} goes on</div><p>and on {i * i}"
              for i, c in enumerate(["post-title", "entry-title", "post", "content entry"] * 3)]
    got = _texts(spark, bodies)
    assert got == {i: f"Title {i} Body of page {i} goes on and on {i * i}" for i in range(12)}


def test_importance_does_not_fall_with_the_host(spark):
    bodies = [f"<div class=strip>Our site</div><div class=b><h2>Heading {i % 20}</h2><p>Own words {i} of the page</p></div>" for i in range(1500)]
    got = _texts(spark, bodies)
    assert got == {i: f"Heading {i % 20} Own words {i} of the page" for i in range(1500)}


def test_copies_of_a_page_are_one_page(spark):
    page = "<div class=strip>Our site</div><div class=b><h1>Head {0}</h1><p>Own words {0} of the page</p></div>"
    got = _texts(spark, [page.format(i if i < 40 else 0) for i in range(100)])
    assert got == {i: "Head {0} Own words {0} of the page".format(i if i < 40 else 0) for i in range(100)}


def test_licences(spark):
    rng = random.Random(6)
    filler = ["plain words about the weather", "all rights reserved by the county", "the license of the driver was taken", "to any person who likes it"]
    lines = {"Apache": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
             "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    rows, want = [], {}
    for i in range(160):
        text = [rng.choice(filler) + f" {rng.randint(0, 999)}" for _ in range(rng.randint(1, 6))]
        family = rng.choice([*lines, None, None, None])
        if family:
            text.insert(rng.randint(0, len(text)), lines[family])
        rows.append((i, "\n".join(text), "", "", 0.0))
        want[i] = family
    rows += [(200, None, "", "", 0.0), (201, "", "", "", 0.0), (202, "\n\n", "", "", 0.0), (None, lines["MIT"], "", "", 0.0), (203, "word " * 50_000, "", "", 0.0)]
    want |= {200: None, 201: None, 202: None, None: "MIT", 203: None}
    rows += [rows[0]]
    schema = "doc_id long, text string, family string, row string, probability double"
    docs = spark.createDataFrame(rows, schema)
    got = licence_scan.scan_licences(docs).collect()
    assert Counter((r.doc_id, r.family) for r in got) == Counter((r[0], want[r[0]]) for r in rows)
    assert all(r.families == ([r.family] if r.family else []) and r.confirmed == bool(r.family) for r in got)
    assert licence_scan.scan_licences(spark.createDataFrame([], schema)).count() == 0


def test_licences_that_share_a_line(spark):
    """Windows, probabilities and overlaps against plain loops over the weight table; both families of a line are found."""
    import math
    import re

    apache, mit = licence_scan.NOTICES["Apache"][3], licence_scan.NOTICES["MIT"][2]
    gpl = licence_scan.NOTICES["GPL"][0]
    rng = random.Random(9)
    filler = [f"{a}{b}" for a in ("wo", "ne", "ta", "ri") for b in ("ran", "lim", "dor", "kes", "pun")]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    texts = [f"{mit} {apache}", f"{some(700)}. {apache} {some(300)}. {mit} {some(900)}", f"{some(150)} {gpl} {some(150)}",
             some(400), "", ". . ! ?", f"{some(40)}.\n{apache}\n{mit}", some(64), some(65), some(96), some(97)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights, limit = licence_scan.train(docs)
    table = {r["gram"]: [r[f"w{k}"] for k in range(len(licence_scan.FAMILIES))] for r in weights.collect()}
    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    pairs = lambda w: [f"{a} {b}" for a, b in zip(w, w[1:])]
    want = []
    for doc, text in enumerate(texts):
        for number, line in enumerate(text.split("\n")):
            for sentence in re.split(licence_scan.SENTENCE_END, line):
                found = words(sentence)
                starts = [0] if len(found) <= 64 else range(0, math.ceil((len(found) - 64) / 32) * 32 + 1, 32)
                for window in (found[i:i + 64] for i in starts):
                    grams = set(window) | set(pairs(window))
                    sums = [sum(column) for column in zip(table[""], *(table[g] for g in sorted(grams) if g in table))]
                    total = sum(math.exp(v) for v in sums)
                    chance = max((math.exp(v) / total, f) for v, f in zip(sums, list(licence_scan.NOTICES)))
                    if not any(g in table for g in grams) or chance[0] < limit:
                        continue
                    of_family = [set(pairs(words(n))) for n in licence_scan.NOTICES[chance[1]]]
                    overlap = max((len(n & set(pairs(window))) / max(min(len(n), len(window) - 1), 1) for n in of_family if n), default=0.0)
                    want.append((doc, number, chance[1], round(chance[0], 6), round(overlap, 6)))
    got = [(r.doc_id, r.paragraph, r.family, round(r.probability, 6), round(r.overlap, 6))
           for r in licence_scan.paragraph_findings(docs, weights, limit).where("family is not null").collect()]
    assert sorted(got) == sorted(want) and len(want) >= 6
    families = {r.doc_id: r.families for r in licence_scan.scan_licences(docs, (weights, limit)).collect()}
    assert families == {d: ["Apache", "MIT"] if d in (0, 1, 6) else ["GPL"] if d == 2 else [] for d in range(len(texts))}


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("lo", "me", "ta", "ri") for b in ("ran", "lim", "dor", "kes", "pun")]
    rows, labels = [], []
    for i in range(300):
        text = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        if i % 5 == 0:
            text[3] = "scoundrelly"
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(400 + i, rows[1][1], "en", "s0", 0) for i in range(20)] + [(500, None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {r.doc_id for r in kept[0].collect()}
    assert len(clean & {i for i in range(300) if i % 5 == 0}) <= 2 and len(clean & {i for i in range(300) if i % 5}) >= 238
    single = [r.doc_id for r in kept[1].collect()]
    assert len(single) == len(set(single)) and 1 in single and not any(400 <= i < 420 for i in single) and set(single) >= clean - set(range(400, 420))
    assert {r.doc_id for r in kept[2].collect()} <= set(single)
    assert kept[2].groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    assert kept[3].select("doc_id").distinct().count() == kept[2].select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[3].count()


def _blog(n, comments=0):
    story = " ".join(f"word{n}x{k}" for k in range(30))
    replies = "".join(f'<div id="comment-{n * 100 + k}"><p>Reply {n} {k}</p></div>' for k in range(comments))
    return (f'<html><body class="single postid-{n}"><div class="tagline">Our daily line</div><div id="post-{n}" class="hentry post-{n}">'
            f'<h1>Title {n}</h1><p>{story}</p></div><div id="comments-{n}">{replies}</div></body></html>'), f"Title {n} {story}"


def test_numbered_names_share_a_template(spark):
    sizes = []
    for n in (8, 40):
        pages = [(i, f"http://blog.example/{i}", _blog(i, 5)[0]) for i in range(n)]
        frame = spark.createDataFrame(pages, "page_id long, url string, html string")
        for r in site_style.main_texts(frame).collect():
            assert r.text == _blog(r.page_id)[1]
        listed = site_style.removed_nodes(frame.withColumn("host", site_style.host_of(frame.url))).collect()
        sizes.append([(len(r.removed), len(r.spared)) for r in listed])
    assert sizes[0] == sizes[1]


def test_teasers_do_not_win_over_the_story():
    page = ('<body><div class="text"><p>' + "The whole story stands here. " * 20 + "</p></div><article><p>Teaser one</p></article>"
            "<article><p>Teaser two</p></article></body>")
    text = site_style.main_text(page, None)
    assert text.startswith("The whole story stands here.") and text.endswith("Teaser one Teaser two")
    whole = "<body><p>Skip</p><article><p>" + "Long text. " * 30 + "</p></article></body>"
    assert site_style.main_text(whole, None) == ("Long text. " * 30).strip()


def test_importance_equals_plain_entropies(spark):
    rng = random.Random(12)
    words = ["menu", "home", "about", "one", "two"]
    pages = []
    for i in range(40):
        parts = "".join(f"<div class='c{'abc'[k]}'>{rng.choice(words[:k + 2])}{' ' + str(rng.random()) if k == 2 else ''}</div>" for k in range(3))
        pages.append(("h", f"<body>{parts}{'<p>extra</p>' if rng.random() < 0.3 else ''}</body>"))
    counts = {}
    for page in {p for _, p in pages}:
        nodes = {}
        site_style.page_blocks(page, nodes)
        for (path, kind, _), hashes in nodes.items():
            if path:
                counts.setdefault(path, {}).setdefault(kind, []).append(tuple(hashes))
    low = set()
    for path, kinds in counts.items():
        values = []
        for seen in kinds.values():
            total = len(seen)
            entropy = -sum(seen.count(h) / total * math.log(seen.count(h) / total) for h in set(seen))
            values.append(min(entropy / math.log(min(total, site_style.VARIETY)), 1.0) if total > 1 else 1.0)
        if len(next(iter(kinds.values()))) >= site_style.COMPARED and sum(values) / len(values) < site_style.IMPORTANT:
            low.add(path)
    got = site_style.removed_nodes(spark.createDataFrame(pages, "host string, html string")).first()
    assert set(got.removed) == low and low
