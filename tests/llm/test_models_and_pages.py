"""Operators 3, 4, 7 and 8, clashing column names, and the pipeline."""

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from stepwise.llm import fingerprints, hilbert_shards, html_text, jaccard_join, packing, pieces, quality_rules, repeats, toxicity, url_filter
from stepwise.llm.common import stored
from stepwise.llm.queries import REGISTRY, op3_html_extraction, op7_toxicity, op8_sharding, vocabulary

from .conftest import PAGES

SF = "/root/testdata/sf0.001"


# --- 3: main text -------------------------------------------------------------------------------

def test_articles_of_the_small_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op3_html_extraction(spark, SF).collect():
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id].html).group(1)
        want = " ".join(" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)) for x in re.split(r"</?(?:p|h1|br)>", inner)).split())
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url


PAGE = """<html><head><title>No</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body><header>Top</header>
<nav class="x">Menu</nav><div class="cookie-notice">Accept</div>%s<aside>Side</aside><form>Form <input value="a>b"></form>
<section id="comments"><p>A reader</p></section><div class="ad">Buy</div><footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize("body, want", [
    ("<article><h1>Head &amp; line</h1><p>One <b>bold</b>word<br>two</p>  <p>three\n\n four</article>", "Head & line One boldword two three four"),
    ("<div><p>Plain &eacute; page</p><ul><li>item</ul></div>", "Plain é page item"),
    ("<main><p title='x>y' class=\"a\">text</p><div class='share'>no</div></main><p>outside</p>", "text"),
    ("", ""),
    ("<article><!-- no --><p>a < b and c &lt; d", "a < b and c < d"),
])
def test_parts_that_are_no_article_go(body, want):
    assert html_text.article_text(PAGE % body, frozenset()) == want


@pytest.mark.parametrize("tag", [
    "<p title='x>y' class=\"a\">", "<p data-x='{\"a\":\"<b>\"}'>", "<p title='5\" disk'>", '<p title="it\'s > that">', "<p title=it's>",
    '<p title = "a>b" data-n=1>', '<p title="a>b" alt=\'c"d>e\'>', "<p data-class='ad' title='class=\"ad\"'>", '<p title="">', "<p don't>", "<p a=>",
])
def test_quoted_attributes_end_where_they_end(tag):
    page = f"<html><body><main>{tag}text</p><p>it's \"more\"</p></main><p class=\"x\">outside</p></body></html>"
    assert html_text.article_text(page, frozenset()) == "text it's \"more\""


@pytest.mark.parametrize("names", [
    "home single no-sidebar", "has-sidebar", "post comments-open", "content side-by-side", "overflow-hidden", "search-results", "js no-cookies", "sidebar",
])
def test_no_name_takes_out_an_article(names):
    whole = "Head one two"
    for page in (f'<html class="{names}"><body><article><h1>Head</h1><p>one</p><p>two</article></body></html>',
                 f'<html><body class="{names}"><div><h1>Head</h1><p>one</p><p>two</div></body></html>',
                 f'<body><article class="{names}"><h1>Head</h1><p>one</p><p>two</article><p>outside</p></body>',
                 f'<body><div class="{names}"><div><main id="{names}"><h1>Head</h1><p>one</p><p>two</main></div></div><p>outside</p></body>',
                 f'<body><div class="{names}"><article class="{names}"><h1>Head</h1><p>one</p><p>two</article></div><p>outside</p></body>',
                 f'<body class="{names}"><main><h1>Head</h1><p>one</p><p>two</p><div class="ad">Buy</div></main></body>'):
        assert html_text.article_text(page, frozenset()) == whole, page


def test_names_still_take_out_what_they_name():
    page = '<article><p>one</p></article><section id="comments"><article class="comment-body">A reader</article></section>'
    assert html_text.article_text(page, frozenset()) == "one"
    for names in ("sidebar", "cookie-notice", "site_footer", "hidden", "main-nav wide", "ad", "post comments"):
        assert html_text.article_text(f'<div><p>one</p><div class="{names}">no</div></div>', frozenset()) == "one"
    for names in ("no-sidebar", "overflow-hidden", "content side-by-side", "search-results", "post comments-open"):
        assert html_text.article_text(f'<div class="{names}"><p>one</p></div>', frozenset()) == "one"


def test_a_quote_never_closed_loses_no_text():
    assert html_text.article_text("<main><p title=\"x>text</p><p>more</p></main>", frozenset()) == "text more"
    assert html_text.article_text(PAGE % "<main><p title='x>y' class=\"a\">text</p><div class='share'>no</div></main><p>outside</p>", frozenset()) == "text"


def test_constant_texts_of_a_host_go(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><div><p>Read more here</p><p>own text {i} {'abc ' * (i + 3)}</p></div></body>") for i in range(10)]
    rows += [(20 + i, "https://copies.example/a", "<body><p>all the same</p></body>") for i in range(12)]
    rows += [(40, None, None), (41, "nohost", ""), (42, "https://h.example/x", "   ")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows) and got[3].startswith("own text 3") and got[25] == "all the same"
    assert got[40] == got[41] == got[42] == ""


def words_of(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_one_error_page_and_a_second_layout_empty_no_template(spark):
    notice = "This site is made by a small team and kept by its readers"
    first = "<html><body><div><p>{n}</p></div><div><h1>{h}</h1><p>{t}</p></div><div><p>All rights held since long ago</p></div></body></html>"
    second = "<html><body><section><h2>{h}</h2><p>{t}</p><p>Call us by day or night</p></section></body></html>"
    rows, want = [], {}
    for i in range(30):
        rows.append((i, f"https://two.example/{i}", (first if i < 18 else second).format(n=notice, h=f"Head {i}", t=words_of(i, 30))))
        want[i] = f"Head {i} {words_of(i, 30)}"
    rows.append((30, "https://two.example/e", "<h1>Error 500</h1>"))
    want[30] = "Error 500"
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


def test_classes_out_of_order_are_no_template():
    template = html_text.Template([7, 9, 9, 3, 1, 2, 3, 8, 5, 5, 2, 10, 11])  # class, pages, occurrences, number of tokens, tokens
    order = lambda tokens: {c: ok for c, _, ok in html_text.check_order(tokens, template)}
    nesting = lambda tokens: {c: ok for c, _, ok in html_text.check_nesting(tokens, template)}
    assert order([1, 2, 10, 99, 11, 3]) == {7: True, 8: True} and order([1, 2, 3, 1, 2, 3]) == {7: True}
    assert not order([1, 3, 2])[7] and not order([1, 1, 2, 2, 3, 3])[7] and not order([1, 2])[7] and not order([2, 3, 1])[7]
    assert nesting([1, 2, 10, 11, 3]) == {7: True, 8: True} and nesting([1, 10, 2, 11, 3]) == {7: True, 8: False}
    assert nesting([1, 10, 11, 2, 10, 11, 3]) == {7: True, 8: False}
    places = [{c: p for c, p, _ in html_text.check_nesting(t, template)}[8] for t in ([1, 10, 11, 2, 3], [1, 2, 10, 11, 3], [5, 1, 2, 10, 11, 3])]
    assert places[0] != places[1] == places[2]


def test_constant_texts_go_by_host_not_by_length(spark):
    notice, shared = words_of("n", 60), words_of("c", 100)
    page = "<html><body><div><p>{n}</p></div><section><h1>{h}</h1><p>{t}</p>{q}</section></body></html>"
    rows, want = [], {}
    for i in range(30):  # long and short articles under one notice, and near copies of one article in tags of their own
        if i < 20:
            text, q = words_of(i, 100 if i < 10 else 5), ""
        else:
            text, q = f"edition {i}", f"<blockquote><q><p>{shared}</p></q></blockquote>"
        rows.append((i, f"https://mixed.example/{i}", page.format(n=notice, h=f"Head {i}", t=text, q=q)))
        want[i] = f"Head {i} {text}" + (f" {shared}" if q else "")
    for i in range(40, 60):  # a host of near copies keeps its texts
        rows.append((i, f"https://copies.example/{i}", page.format(n=notice, h="Head", t=f"edition {i}", q=f"<p>{shared}</p>")))
        want[i] = f"{notice} Head edition {i} {shared}"
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


def test_slots_of_the_template_decide_over_a_chance_element(spark):
    rows = [(i, f"https://slot.example/{i}", f"<html><body><main><h1>Head {i}</h1><p>{words_of(i, 9)}</p></main>{'<div><article>card</article></div>' if i == 3 else ''}"
             "</body></html>") for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Head {i} {words_of(i, 9)}" for i in range(12)}


# --- 4: urls ------------------------------------------------------------------------------------

def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in url_filter.RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_rules_match_brute_force(spark):
    urls = ["https://a.Example.ORG/es/1", "http://example.org/en/12?x=1", "http://example.org/en/2", "https://xexample.org/es/", "https://b.com/fr/1#t",
            "https://b.com/de/", "https://b.com/de", "https://org", "https://org/", "https://a.org?x=/es/", None, "", "no scheme", "x://casino-pills.net/",
            "https://com.net/fr/", "https://b.com/frx", "a://b://c.com/fr/", "https://ex\nample.org/es/"] + [f"https://spam-{i}.casino.net/{i}" for i in range(30)]
    urls += [f"https://site{i}.net/en/{i}" for i in range(60)]
    got = url_filter.judge(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), urls[r.page_id]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    model = {urls[r.page_id]: r.verdict for r in got if r.rule is None and urls[r.page_id]}
    assert all(v == ("block" if "casino" in u else "allow") for u, v in model.items() if "net/" in u and "com" not in u)
    assert url_filter.judge(spark.createDataFrame([], PAGES)).count() == 0


# --- 7: toxicity --------------------------------------------------------------------------------

def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    rows = op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.95


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 4.0}, {"trott": 3.0})
    plain, negated, said = g.score("an idiot"), g.score("not an idiot"), g.score("he said idiot")
    assert len(g.clauses("an idiot")) == len(g.clauses("idiot. idiot")) / 2 == 1
    assert negated < plain < g.score("he is an idiot") and said < g.score("he is an idiot")
    assert g.score("I will kill") == g.score("") < g.score("I will kill you")
    assert g.clauses("Trottel!") and g.clauses("") == []


def alone(text, g):
    """The patterns of a text's clauses from five readers that run one by one, each over the whole clause."""
    out = []
    for clause in re.split(r"[.!?;:,\n]", text.lower()):
        words = [g.symbol(w) for w in re.findall(r"[^\W\d_]+", clause)]
        found = {}
        aimed = any(k == toxicity.TARGET for k, _ in words)
        for i, (kind, weight) in enumerate(words):
            if kind in (toxicity.INSULT, toxicity.THREAT):
                negated = any(k == toxicity.NEGATOR for k, _ in words[max(0, i - toxicity.REACH) : i])
                reported = any(k == toxicity.REPORTER for k, _ in words[:i])
                p = ("insult" if kind == toxicity.INSULT else "threat", negated, reported, aimed)
                found[p] = found.get(p, 0.0) + weight
        if found:
            out.append(found)
    return out


def test_composed_machine_equals_its_parts():
    g, rng = toxicity.Grammar({"idiot": 4.0, "scum": 2.5}, {"trott": 3.0}), random.Random(4)
    words = ["idiot", "scum", "trottel", "kill", "you", "they", "not", "never", "said", "called", "a", "the", "house", "was", "I"]
    for _ in range(2000):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",", "!\n"]) for _ in range(rng.randrange(14)))
        got = [{toxicity.PATTERNS[p]: w for p, w in c.items()} for c in g.clauses(text)]
        assert got == alone(text, g), text


@pytest.mark.parametrize("part", list(toxicity.TRANSDUCERS))
def test_every_transducer_decides(spark, part):
    """A corpus whose labels follow the grammar: without any one of the five parts held-out predictions change."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        kind = rng.choice(["idiot", "kill", ""])
        aimed, negated, said = (rng.random() < 0.5 for _ in range(3))
        words = [rng.choice(["the", "house", "stands", "over", "water"]) for _ in range(4)]
        body = ("you " if aimed else "") + ("said that was " if said else "") + ("not " if negated else "") + kind if kind else "all is well"
        rows.append((i, f"{' '.join(words)}. {body}. {' '.join(words[::-1])}"))
        labels.append((i, 1, int(bool(kind) and aimed and not negated and not said)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = toxicity.train_grammar(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = [(t, y) for (i, t), (_, _, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(whole.score(t) >= 0.5) == bool(y) for t, y in held]
    tables = {n: {} if n == part else t for n, t in toxicity.TRANSDUCERS.items()}
    without = toxicity.Grammar(whole.whole, whole.stems, whole.model, toxicity.compose(tables), toxicity.aimed_states(tables))
    less = [(without.score(t) >= 0.5) == bool(y) for t, y in held]
    assert np.mean(right) > 0.95 and np.mean(less) < np.mean(right) - 0.02


def test_toxicity_without_labels(spark, odd_docs, no_docs, no_labels):
    rows = {r.doc_id: r for r in toxicity.judge(odd_docs, no_labels).collect()}
    assert rows[24].predicted == 1 and rows[3].predicted == rows[4].predicted == 0
    assert toxicity.judge(no_docs, no_labels).count() == 0


# --- 8: shards ----------------------------------------------------------------------------------

def test_curve_visits_neighbouring_cells(spark):
    from pyspark.sql import functions as F

    bits, n = 3, 8
    cells = spark.range(n ** 3).select((F.col("id") % n).alias("a"), (F.col("id") / n % n).cast("int").alias("b"), (F.col("id") / n / n).cast("int").alias("c"))
    rows = cells.withColumn("h", hilbert_shards.hilbert_index([F.col("a"), F.col("b"), F.col("c")], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(n ** 3))
    assert all(abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) == 1 for x, y in zip(rows, rows[1:], strict=False))


def check_shards(rows, n):
    assert len(rows) == n
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert set(by) <= set(range(16)) and max(map(len, by.values())) - (min(map(len, by.values())) if len(by) == 16 else 0) <= 1


def test_shards_obey_the_row_law(spark, odd_docs, no_docs):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_sharding(spark, SF).collect()
    check_shards(rows, len(docs))
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) for r in rows)
    odd = hilbert_shards.shard(odd_docs).collect()
    check_shards(odd, odd_docs.count())
    assert hilbert_shards.shard(no_docs).count() == 0


def test_written_shards_hold_every_row_where_shard_put_it(spark, odd_docs, tmp_path):

    from pyspark.sql import functions as F

    hilbert_shards.write_shards(odd_docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    crc = F.crc32(F.coalesce("text", F.lit("")))
    assert Counter(map(tuple, back.select(*odd_docs.columns).collect())) == Counter(map(tuple, odd_docs.collect()))
    own = lambda df, c: Counter(map(tuple, df.select("doc_id", c, "shard", "place").collect()))
    assert own(back, crc) == own(hilbert_shards.shard(odd_docs, 4), F.col("text_crc32"))


# --- all together -------------------------------------------------------------------------------

def test_clashing_names(spark, clashing, no_labels):
    n = clashing.count()
    words, piece = vocabulary("word_bpe_49k.json"), vocabulary("piece_bpe_32k.model")
    assert repeats.without_repeats(clashing, ["doc_id"]).count() == n
    assert fingerprints.compare_edits(clashing).count() == n
    assert quality_rules.judge(clashing).count() == n
    assert pieces.encode(clashing, piece).count() == n
    assert toxicity.judge(clashing, no_labels).count() == n
    assert hilbert_shards.shard(clashing).count() == n
    assert packing.pack(stored(packing.token_pieces(clashing, words), "x")).count() >= n
    assert jaccard_join.near_duplicates(clashing).count() == n


def test_clashing_names_of_pages(spark):
    names = ["prediction", "probability", "rawPrediction", "features", "label", "host", "path", "rule", "verdict", "text", "h", "n", "token", "row"]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    more = pages
    for n in names:
        more = more.selectExpr("*", f"'extra' as `{n}`")
    for judge in (url_filter.judge, html_text.extract):
        assert Counter(map(tuple, judge(more).collect())) == Counter(map(tuple, judge(pages).collect()))
    assert html_text.extract(pages.limit(0)).count() == url_filter.judge(pages.limit(0)).count() == 0
    twice = pages.union(pages)  # repeated rows: the same answers, each twice
    once = Counter(map(tuple, html_text.extract(pages).collect()))
    assert Counter(map(tuple, html_text.extract(twice).collect())) == Counter({k: 2 * v for k, v in once.items()})


def test_written_shards_keep_columns_of_their_names(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 6, f"own{i}", i) for i in range(30)],
                                 "doc_id long, text string, lang string, source string, n_chars long, shard string, place int")
    hilbert_shards.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*docs.columns, "_shard", "_place"}
    assert sorted((r.doc_id, r.shard, r.place) for r in back.collect()) == [(i, f"own{i}", i) for i in range(30)]
    assert sorted(r["count"] for r in back.groupBy("_shard").count().collect()) == [7, 7, 8, 8]


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "a"), (3, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (2, 1, 0), (3, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels, 10).collect()
    assert len(rows) == len({(r.text, r.toxic) for r in rows}) <= 3
    assert [r.held_out for r in toxicity.judge(docs.where("doc_id is null"), labels).collect()] == [True]


def test_stages_keep_the_columns(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        before = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stored(stage(spark, before, SF), f"test-{name}")
            assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
            assert after.count() <= before.count()
            before = after
        assert corpus_pipeline.packed(spark, before, SF).count() >= before.count()


def test_extra_columns_pass_the_stages(spark, clashing):
    before = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = stored(stage(spark, before, SF), f"test-{name}")
        assert before.columns == clashing.columns, name


def test_one_document_of_each_group_stays(spark, odd_docs):
    kept = corpus_pipeline.one_per_group(spark, odd_docs, SF).collect()
    groups = jaccard_join.with_roots(odd_docs).where("n > 0").select("root").distinct().count()
    assert sum(1 for r in kept if (r.text or "").split()) == groups
    assert sum(1 for r in kept if not (r.text or "").split(None)) == 3


def test_pipeline_packs_what_the_stages_keep(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(0 <= r.offset and r.offset + r.length <= packing.ROOM for r in rows)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & {r.doc_id for r in rows}) <= 0.1 * len(toxic) + 1


def test_stored_tables_are_cleared_on_request(spark, odd_docs):
    from stepwise.llm.common import clear_stored, shared_folder

    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    count = lambda: sum("to-clear" in f.getPath().getName() for f in fs.listStatus(path))
    assert stored(odd_docs, "to-clear").count() and count() == 1
    assert clear_stored(spark) >= 1 and count() == 0 and clear_stored(spark) == 0


def test_every_operator_is_registered():
    assert [re.match(r"op(\d+)_", k).group(1) for k in REGISTRY] == [str(i) for i in range(1, 14)]
