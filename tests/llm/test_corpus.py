"""Operators over the whole corpus: joins, models, pages and the pipeline."""

import functools
import random

import brute
import pytest
from brute import prose
from pyspark.sql import functions as F

from dekadal.llm import components, decontamination, html_extraction, jaccard_join, quality_classifier, toxicity


def test_jaccard_components(docs, texts, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    got = sorted(map(tuple, jaccard_join.jaccard_components(docs).distinct().collect()))
    assert got == brute.components(list(enumerate(texts)))
    assert jaccard_join.jaccard_components(docs).count() == docs.count()


def test_a_family_of_near_copies(spark):
    """Copies with one to six changed words, whose links the star does not all find."""
    rng = random.Random(8)
    base = prose(rng, 150).split(" ")
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(rng, 150) + " " + " ".join(base[:60])) for i in range(60)]  # a passage that many share
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == brute.components(rows)


def test_one_of_each(docs, texts, empty):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and jaccard_join.one_of_each(empty).count() == 0
    want = sorted(i for i, _, c in brute.components(list(enumerate(texts))) if i == c)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(70, 100)] + [(5, k) for k in range(6, 40)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {**dict.fromkeys(range(70, 101), 70), **dict.fromkeys(range(5, 40), 5)}


def test_decontamination(spark, docs, texts, empty):
    long = texts[10].split(" ")
    items = [(0, " ".join(long[500:530])), (1, " ".join([*long[900:925], "other", "words"])), (2, " ".join(long[40:60]) + " z z z z z z z z z z"), (3, ""), (4, None), (5, "a b c"), (6, texts[11]), (6, texts[11])]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, decontamination.find_items(docs, table).collect()))
    assert got == brute.contained(list(enumerate(texts)), list(dict(items).items()))
    assert {i for i, _, _, _ in got} >= {10, 11, 12}
    assert decontamination.find_items(empty, table).count() == 0 and decontamination.find_items(docs, table.limit(0)).count() == 0
    clean = decontamination.decontaminate(docs, table)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {g[0] for g in got}


def test_large_benchmarks_are_joined_without_a_broadcast(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    table = spark.createDataFrame([(6, texts[11])], "item_id long, text string")
    assert sorted(map(tuple, decontamination.find_items(docs, table).collect())) == brute.contained(list(enumerate(texts)), [(6, texts[11])])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        words = prose(rng, rng.randint(60, 200)).split(" ")
        toxic = rng.random() < 0.3
        poor = rng.random() < 0.3
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "m0ron", "zorkfus", "zorkfan", "you", "scum"]))
        if poor:
            words = [w + rng.choice(["###", "$$$", "***"]) for w in words]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(900, None, None), (901, "", "y")]
    labels += [(900, None, None), (902, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, features string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score,label,folds", [(quality_classifier.score_quality, "quality", (3, 1)), (toxicity.score_toxicity, "toxic", (5, 0))])
def test_held_out_accuracy(labelled, empty, score, label, folds):
    import zlib

    docs, labels = labelled
    got = score(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds[0] == folds[1]) for r in got)
    held = [r for r in got if r.held_out and r[label] is not None]
    assert len(held) > 50 and sum(r.predicted == r[label] for r in held) >= 0.95 * len(held)
    none = score(docs, labels.limit(0))
    assert none.count() == docs.count()
    assert score(empty.select("doc_id", "text"), labels).count() == 0


def test_drop_toxic(labelled):
    docs, labels = labelled
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 250 < kept.count() < 450


def page(body, article="<p>One &amp; two</p>"):
    return f"<html><head><title>t</title><script>var a='<p>'</script></head><body>{body}<article><h1>Head</h1>{article}</article><footer>f</footer></body></html>"


def test_extraction(spark):
    rows = [
        (1, "http://a.example.com/1", page("<nav><a>m</a></nav>", "<p>One\n\n two<br>three<p>four &lt;<ul><li>a<li>b</ul><div class='comments'><p>c</p></div><aside>s</aside><form>q</form>")),
        (2, "http://a.example.com/2", "<div>no article <b>here</b></div><script>x"),
        (3, None, None), (4, "", ""), (5, "http://b/", "<p>unclosed <b>tag"), (6, "http://b/", "text only &am"), (7, "http://b/", "<!-- c --><p>a</p><!-- open <p>b</p>"),
        (8, "http://b/", page("", "<p>" + "w " * 30000 + "</p>")),
    ]
    for host in range(6):  # a template without a telling name, around bodies of their own
        rows.append((10 + host, f"http://site.example.com/{host}", f"<body><div><span>Brand</span> <i>since 1999</i></div><div><p>own text {host}</p></div></body>"))
        rows.append((20 + host, f"http://copy.example.com/{host}", "<body><div><p>Brand copy</p></div><p>the same everywhere</p></body>"))
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, host int, text string")
    got = {r.page_id: r for r in html_extraction.extract_main_text(df.union(df.where("page_id = 2"))).collect()}
    assert got[1].text == "Head\nOne two three\nfour <\na\nb"
    assert [got[i].text for i in (2, 3, 4, 5, 6, 7)] == ["no article here", "", "", "unclosed tag", "text only &am", "a"]
    assert got[8].n_chars == len("Head\n") + 59999
    assert [got[10 + k].text for k in range(6)] == [f"own text {k}" for k in range(6)]
    assert got[20].text == "Brand copy\nthe same everywhere"  # copies of one page are no template
    assert html_extraction.extract_main_text(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path, labelled, texts, monkeypatch):
    import corpus_pipeline

    docs, labels = labelled
    extra = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = docs.select("doc_id", "text").union(extra).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("bigint")})
    sf = str(tmp_path)
    whole.write.parquet(f"{sf}/documents.parquet")
    labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, texts[-1])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        if name != "packing":
            assert out.columns == now.columns
        out.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/personal_data").collect()}
    assert {r.doc_id for r in now.collect()} == ids
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/toxicity").collect()}
    left = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin(list(toxic))).collect())
    monkeypatch.setattr(brute, "shingles", functools.partial(brute.shingles, n=5))  # the stage's rule: five words, 0.8
    want = {i for i, _, c in brute.components(left, 80) if i == c}
    assert {r.doc_id for r in spark.read.parquet(f"{sf}/near_duplicates").collect()} == want
    monkeypatch.undo()
    assert ids == want - {i for i, *_ in brute.contained([r for r in left if r[0] in want], [(1, texts[-1])])}
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == len(ids)


def test_stages_on_empty_tables_odd_ids_and_clashing_columns(spark, tmp_path, docs, empty, labelled):
    import corpus_pipeline

    sf = str(tmp_path)
    labelled[1].write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    clashing = {c: F.lit(7).cast("long") for c in ("fp", "n", "g", "bits", "shingle", "x", "y", "stem", "__word", "items", "features", "held_out", "fold", "start", "length")}
    odd = docs.withColumns(clashing)
    nulls = odd.where("doc_id in (11, 12, 30)").withColumn("doc_id", F.lit(None).cast("long"))
    both, times = odd.union(nulls).union(nulls), 2 * nulls.count()
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, sf)
        got = stage(spark, both, sf)
        assert none.count() == 0
        if name != "packing":
            assert none.columns == empty.columns and got.columns == both.columns
            kept = got.where("doc_id is null")
            assert kept.count() == times and kept.where("fp = 7 and start = 7").count() == times
        else:
            assert got.where("doc_id is null and start = 0").count() == times


def test_null_ids_link_like_others(spark):
    """Copies and near copies among rows without an id; a component takes the least id that it has."""
    base = prose(random.Random(3), 80)
    rows = [(None, base), (None, base + " end"), (7, base + " end"), (9, base), (None, prose(random.Random(4), 80)), (None, None)]
    rows += [(None, prose(random.Random(5), 60)), (None, prose(random.Random(5), 60) + " z")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("None", "7"), ("None", "7"), ("7", "7"), ("9", "7"), *[("None", "None")] * 4])


def test_shared_passages_make_few_pairs(spark, monkeypatch):
    """Pairs of near copies that all share one passage: with it last in the order, candidate pairs stay near the links."""
    rng = random.Random(21)
    passage = prose(rng, 60)
    rows = []
    for k in range(150):
        words = prose(rng, 100).split(" ")
        rows.append((2 * k, " ".join([passage, *words])))
        words[rng.randrange(10, 90)] += "q"
        rows.append((2 * k + 1, " ".join([passage, *words])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, plain = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == brute.components(rows)
    assert sum(seen) <= 3 * 150


def family(rng, n, replaced=4):
    """Texts of 200 words of which each has four replaced, so that any two are alike to about 0.79."""
    base = prose(rng, 200).split(" ")
    rows = []
    for i in range(n):
        words = list(base)
        for k in rng.sample(range(len(words)), replaced):
            words[k] = f"v{rng.randrange(500)}"
        rows.append((i, " ".join(words)))
    return rows


def test_families_that_do_not_link_make_few_pairs(spark, monkeypatch):
    seen, plain = [], jaccard_join.open_pairs
    monkeypatch.setattr(jaccard_join, "open_pairs", lambda rows, inside, rule: seen.append(plain(rows, inside, rule).count()) or plain(rows, inside, rule))
    rows = family(random.Random(51), 250) + [(1000 + i, t) for i, t in family(random.Random(51), 250)[:20:7]] + [(2000, family(random.Random(51), 1)[0][1] + " x")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect())) == brute.components(rows)
    assert sum(seen) <= 250


@pytest.mark.parametrize("replaced,percent", [(1, 90), (2, 90), (3, 80), (4, 70)])
def test_families_of_any_likeness(spark, monkeypatch, replaced, percent):
    rows = family(random.Random(52), 120, replaced) + family(random.Random(53), 20, replaced)
    rows = [(i, t if i % 9 else t + " and more words at the end of it") for i, (_, t) in enumerate(rows)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=percent)
    assert sorted(map(tuple, got.collect())) == brute.components(rows, percent)


def test_frequent_shingles_need_not_be_known(spark, monkeypatch):
    """Any bound on the ordered shingles, and any size of star, gives the same components."""
    rng = random.Random(22)
    base = prose(rng, 90).split(" ")
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"v{rng.randrange(9)}" for w in base)) for i in range(80)] + [(500 + i, " ".join(base[:50]) + " " + prose(rng, 50)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.components(rows)
    for frequent, star in ((0, 500), (40, 3)):
        monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
        monkeypatch.setattr(jaccard_join, "STAR", star)
        assert sorted(map(tuple, jaccard_join.jaccard_components(docs).collect())) == want


def test_null_ids_of_documents_and_items(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c"), (5, "a b c d e f"), (6, None)], "item_id long, text string")
    assert [tuple(r) for r in decontamination.find_items(docs, items).collect()] == [(1, 5, 2, 2)]
    assert sorted(str(r.doc_id) for r in decontamination.decontaminate(docs, items).collect()) == ["2", "None"]


def test_sites_equal_the_plain_version(spark):
    """Random well-formed sites: menus, notices and footers that recur as they stand or by their form, articles and not."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    some = lambda n: " ".join(word() for _ in range(n))
    rows, want, key = [], {}, 0
    for h in range(8):
        article, n = h % 2 == 0, (2, 4, 5, 9)[h % 4]
        brand, notice = some(3), some(6)
        pages = []
        for k in range(n):
            menu = ("div", "m1", [("ul", "", [("li", "", [("a", "", [word()])]) for _ in range(rng.randint(2, 4))])])
            parts = [("div", "brand", [("b", "", [brand])]), menu, ("div", "x1", [notice if k % 3 else some(4)])]
            body = [("h1", "", [some(4)]), *[("p", "", [some(rng.randint(5, 30)), ("b", "", [word()]), " ", word()]) for _ in range(rng.randint(1, 3))], ("section", "", [("p", "", [brand])])]
            tail = [("footer", "", [some(5)]), ("section", "note", [some(8)])]
            pages.append(("body", "", [*parts, ("article", "", body) if article else ("div", "text", body), *tail]))
        for page, found in zip(pages, brute.site(pages), strict=True):
            rows.append((key, f"http://h{h}.example.com/{key}", brute.render(page)))
            want[key] = found
            key += 1
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = html_extraction.extract_main_text(df).collect()
    assert {r.page_id: (r.text, r.n_template_blocks) for r in got} == want
    none = html_extraction.extract_main_text(df, templates=html_extraction.site_templates(df.limit(0)))
    assert sum(r.n_template_blocks for r in none.collect()) == 0
    changed = {r.page_id for r in none.collect() if r.text != want[r.page_id][0]}
    assert len(changed) >= 15  # without templates, these pages keep menus and notices


def test_markup_drops_no_wrapper_or_paragraph():
    text = lambda source: html_extraction.Page(source).main_text()[0]
    assert text('<div class="content with-sidebar"><article><p>a</p></article></div>') == "a"
    assert text('<div id="page" class="no-sidebar single-post"><p>b c</p></div>') == "b c"
    assert text('<article><p class="search-results">s</p><p class="related">r</p></article>') == "s\nr"
    assert text('<div class="sidebar"><h1>t</h1><p>the whole page</p></div>') == "t\nthe whole page"
    assert text('<div class="ad">buy</div><div><p>some longer text</p></div>') == "some longer text"
    assert text("<p>&am<b>p;</b> &am<!-- -->p; &amp;</p>") == "&amp; &amp; &"
    assert text("<article><div class='comments'><p>c</p></div><p>own text here</p></article><article class='comment'>d</article>") == "own text here"


def comments(*words, tag="li", cls="comment"):
    return "".join(f'<{tag} class="{cls}" id="c{k}"><cite>who{k}</cite> <time>12:0{k}</time><p>{w}</p><a href="/x?replytocom={k}">Reply</a></{tag}>' for k, w in enumerate(words))


def test_comments_sidebars_and_adverts_leave_at_any_size():
    text = lambda source: html_extraction.Page(source).main_text()[0]
    long = "some reader says " * 200
    for words in ("c", long):
        assert text(f"<article><p>one short paragraph</p><div class='comments'><p>{words}</p></div></article>") == "one short paragraph"
        assert text(f"<article><p>own</p><section class='comments-area'><p>{words}</p></section></article>") == "own"
        assert text(f"<div class='text'><p>own</p></div><div class='sidebar'><p>{words}</p></div>") == "own"
        assert text(f"<article><p>own</p><p class='advert'>{words}</p><p>and <span class='ad'>{words}</span>more</p></article>") == "own\nand more"
        assert text(f"<article><p>own</p><ol class='talk'>{comments(words, words)}</ol></article>") == "own"  # by structure alone
        assert text(f"<div><p>own</p></div><div id='x7'>{comments(words, words, tag='div', cls='row')}</div>") == "own"
    # one of them, or articles with an author, a time and an answer link, are no list of comments
    assert text(f"<article><p>own</p>{comments('a', tag='div', cls='note')}</article>").startswith("own\nwho0")
    posts = "".join(f"<div class='post'><h2>t{k}</h2><cite>me</cite><time>1</time><p>post {k}</p><a href='#respond'>answer</a></div>" for k in range(3))
    assert "post 0" in text(posts) and "post 2" in text(posts)
    assert text("<body class='ads'><div class='ad'><h1>t</h1><p>own</p></div></body>") == "t\nown"


def test_templates_act_inside_articles(spark):
    """A site with share bars, adverts and comment lists without telling names inside its articles, other words on each."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for k in range(9):
        bar = "<div class='q1'>" + "".join(f"<a href='/{word()}'>{word()}</a> " for _ in range(rng.randint(2, 5))) + "</div>"
        talk = comments(*[word() for _ in range(rng.randint(2, 4))], cls="k3")
        own = [" ".join(word() for _ in range(9)) for _ in range(rng.randint(1, 3))]
        links = "<ul><li><a href='x'>" + word() + "</a></li></ul>"  # an article's own list of links stays
        rows.append((k, f"http://site.example.com/{k}", f"<article>{''.join(f'<p>{p}</p>' for p in own)}{bar}{links}<div class='z2'>the same appeal</div><ul>{talk}</ul></article>"))
        want[k] = "\n".join([*own, links.split(">")[3].split("<")[0]])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_extraction.extract_main_text(df).collect()}
    assert got == want
    none = html_extraction.extract_main_text(df, templates=html_extraction.site_templates(df.limit(0))).collect()
    assert all(r.text != want[r.page_id] for r in none)  # every page changes by its templates


def test_a_section_of_a_large_host_has_templates(spark):
    rows = [(k, "http://big.example.com/", f"<div><b>section menu</b></div><div><p>own words {k}</p></div>" if k < 30 else f"<div><p>page {k}</p></div>") for k in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = html_extraction.extract_main_text(df, templates=html_extraction.site_templates(df, min_share=0.5, many=25)).collect()
    assert {r.page_id: r.text for r in got} == {k: f"own words {k}" if k < 30 else f"page {k}" for k in range(400)}


def test_pages_of_any_nesting_take_time_with_their_size():
    import time

    for source in ("<b>" * 40_000 + "</i>" * 40_000, "<div><i>" + "<b>" * 40_000 + "</i>" * 40_000, "<b>" * 30_000 + "<p>" * 30_000, "<" + "a" * 200_000 + '"', "<a '" * 50_001, "<div class=ad>x" * 20_000, "<ul>" + "<li>x" * 50_000, "<a " + "class " * 50_000 + ">"):
        began = time.perf_counter()
        html_extraction.Page(source).main_text()
        assert time.perf_counter() - began < 5
