"""Extraction, classifiers, filters, rules, packing and encoding: brute force, round trips, held-out accuracy, odd inputs."""

import hashlib
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import byte_bpe, html_text, packing, quality_classifier, quality_rules, toxicity, url_filter

DOCS = "doc_id long, text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PAGES = f"{os.environ.get('TEST_SF_DIR', '/root/testdata/sf0.001')}/pages.parquet"


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.TextEncoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_encoding_is_the_librarys(coder, library):
    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinrst '\n")), max_size=60))
    def check(text):
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text) and coder.decode(ids) == text.encode()

    check()
    assert coder.encode("a" * 20_000) == library.encode_ordinary("a" * 20_000)


def test_prefix_table_appends_and_edits(coder):
    rng = random.Random(0)
    for _ in range(50):
        data = bytes(rng.choice(b"abersthin ") for _ in range(120))
        e = byte_bpe.Encoder(coder.v, data[:50])
        e.append(data[50:])
        assert e.last == byte_bpe.Encoder(coder.v, data).last
        a = rng.randrange(100)
        new = bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 4)))
        computed = e.edit(a, a + 3, new)
        assert e.last == byte_bpe.Encoder(coder.v, data[:a] + new + data[a + 3 :]).last and computed <= len(data)


def test_encode_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "Héllo  world\n"), (3, "Héllo  world\n"), (None, "x")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_tokens": F.lit("clash"), "ids_sha256": F.lit(0)})
    got = sorted(byte_bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect(), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert byte_bpe.digests(spark.createDataFrame([], DOCS), RANKS, public_tokenizers.PATTERN).count() == 0


def test_chunk_tokenizer_is_the_librarys():
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(WORDS), packing.ChunkTokenizer(WORDS)

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeinrst '.,\n\x1c\x85Σİ<|>")), max_size=40))
    def check(text):
        assert mine.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    check()


def test_chunk_tokenizer_is_the_librarys_beyond_the_normal_form():
    """Letters with marks of their own, which the library composes before or after it lower-cases."""
    from tokenizers import Tokenizer

    t, mine = Tokenizer.from_file(WORDS), packing.ChunkTokenizer(WORDS)
    marks = [chr(c) for c in range(0x300, 0x346)]
    letters = "IiAaUuEeÉéΑαΙιΥυϋΰΫῊῃῼ"
    texts = ["I\u0326\u0307", "\u1fca\u0345", "\u03ab\u0301"] + [x + m for x in letters for m in marks]
    rng = random.Random(5)
    texts += ["".join(rng.choice(letters) + "".join(rng.sample(marks, rng.randint(0, 3))) for _ in range(3)) for _ in range(3000)]
    for text in texts:
        assert mine.ids(f"word {text} word") == np.array(t.encode(f"word {text} word", add_special_tokens=False).ids, dtype="<u4").tobytes(), [hex(ord(c)) for c in text]
    assert any(unicodedata.normalize("NFC", x) != x for x in texts)


def test_memory_bounds_change_no_ids(monkeypatch, coder, library):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 5))) for _ in range(200)) for _ in range(30)]
    monkeypatch.setattr(packing, "MEMO_BYTES", 20_000)
    monkeypatch.setattr(byte_bpe, "MEMO_BYTES", 20_000)
    t, mine = Tokenizer.from_file(WORDS), packing.ChunkTokenizer(WORDS)
    for text in texts:
        assert mine.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert coder.encode(text) == library.encode_ordinary(text)


def test_packing_of_rows_that_repeat_a_hundred_times(spark):
    """Equal rows are dealt out like others; clashing extra columns and a very long text don't matter."""
    rows = [(1, "alpha beta gamma delta")] * 400 + [(2, "word " * 50_000), (3, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"piece": F.lit("p"), "length": F.lit(1), "sequence_id": F.lit(2), "offset": F.lit(3)})
    got = packing.pack(packing.cut(packing.tokenize(df, WORDS, 64, "doc_id", "text")), 64, rows_per_partition=300).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 400 * next(r["length"] for r in got if r["doc_id"] == 1)
    assert sum(r["length"] for r in got if r["doc_id"] == 2) == 50_001 and [r["length"] for r in got if r["doc_id"] == 3] == [1]
    lengths = np.array([r["length"] for r in got])
    assert len({r["sequence_id"] for r in got}) <= 1.05 * packing.lower_bound(lengths, 64) + 2


def test_packing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta,", "x.", "Wort"]) for _ in range(rng.randint(0, 120)))) for i in range(300)] + [(900, None), (901, ""), (902, "same"), (902, "same")]
    pieces = packing.tokenize(spark.createDataFrame(rows, DOCS), WORDS, 64, "doc_id", "text")
    got = packing.pack(packing.cut(pieces), 64, rows_per_partition=100).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(i, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 64
    lengths = np.array([r["length"] for r in got])
    assert len(bins) <= 1.02 * packing.lower_bound(lengths, 64) + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), WORDS).count() == 0


def test_lower_bound_is_one():
    """Never more bins than an exact search over small cases needs, and never less than the mass."""

    def fewest(lengths, capacity):
        best = [len(lengths)]

        def put(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(lengths):
                best[0] = len(rooms)
                return
            for i in range(len(rooms)):
                if rooms[i] >= lengths[k]:
                    put(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
            put(k + 1, [*rooms, capacity - lengths[k]])

        put(0, [])
        return best[0]

    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
        bound = packing.lower_bound(np.array(lengths), 20)
        assert -(-sum(lengths) // 20) <= bound <= fewest(lengths, 20)
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3 and packing.lower_bound(np.array([], dtype=int), 20) == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header>Site head</header>
<article><h1>Head &amp; line</h1><p>First   para<b>graph</b> with&nbsp;text.<br>After break.<p>Short.</p>
<div class="ad">Buy now and save a lot of money today because this is an advert with many words.</div><form><input><button>Send</button></form>
<ul><li>Item one</li><li>Item two</li></ul><section id="comments"><p>A reader says many things at great length here, again and again.</p></section></article>
<aside>Side</aside><footer>&copy; Foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst paragraph with text. After break.\nShort.\nItem one\nItem two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<html><body></body></html>") == ""
    assert html_text.main_text("<article><p>cut in the mid") == "cut in the mid"
    assert html_text.main_text("just text") == "just text"
    plain = "<body><div class='top-menu'><a>a</a></div><div><h2>Title</h2>" + "<p>" + "many words in a row " * 12 + "</p>" * 3 + "<p>End.</p></div><div class='comments'><p>" + "bla " * 50 + "</p></div></body>"
    assert html_text.main_text(plain).split("\n")[0] == "Title" and "bla" not in html_text.main_text(plain)


def test_smoothing_decides_what_is_content():
    long = "A paragraph of the article that goes on for a good while, and then for some more of it."
    link = "<p><a href=x>See it</a></p>"
    menu = "".join(f"<p><a href=x{i}>Go there {i}</a></p>" for i in range(9))
    for tag in ("article", "div"):
        page = f"<body><{tag}>{f'<p>{long}</p>' * 3}{link}{f'<p>{long}</p>' * 3}{menu}</{tag}></body>"
        want = "\n".join([*[long] * 3, "See it", *[long] * 3])
        got = html_text.main_text(page).split("\n")
        assert "\n".join(got[:7]) == want and len(got) <= 9 and "Go there 8" not in got  # the smoothing reaches a line or two into the menu
        assert "See it" not in html_text.main_text(page, sigma=0.01)


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables here")
def test_pages_without_an_article_element_need_the_smoothing():
    """The same pages with the article's element as a plain one: whole texts come from ratios, smoothing and clusters."""
    pages = pq.read_table(PAGES, columns=["html"])["html"].to_pylist()
    plain = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h in pages]
    want = [html_text.main_text(h) for h in pages]
    share = lambda sigma: np.mean([html_text.main_text(h, sigma) == w for h, w in zip(plain, want)])
    assert share(html_text.SIGMA) >= 0.9 and share(0.01) <= 0.6


def test_ratio_and_smoothing_by_brute_force():
    rng = random.Random(4)
    values = np.array([rng.random() * 100 for _ in range(40)])
    for sigma in (0.5, 1.5, 4.0):
        reach = int(np.ceil(3 * sigma))
        weight = lambda d, s=sigma: np.exp(-0.5 * (d / s) ** 2)
        want = [sum(weight(j - i) * values[j] for j in range(40) if abs(j - i) <= reach) / sum(weight(j - i) for j in range(40) if abs(j - i) <= reach) for i in range(40)]
        assert np.allclose(html_text.smoothed(values, sigma), want)
    reader = html_text.LineReader()
    reader.feed("<div><p>one <b>two</b> <i>three</i></p><p>four <a href=x>five</a></p></div>")
    reader.close()
    assert [("".join(x.parts), x.tags, x.linked) for x in reader.lines] == [("one two three", 2, 0), ("four five", 1, 4)]
    assert html_text.threshold(np.array([5.0, 5.0])) <= 5.0 and 1 < html_text.threshold(np.array([1.0, 1.0, 90.0, 100.0])) < 90


def test_names_around_most_of_the_text_do_not_empty_it():
    body = "".join(f"<p>Line {i} of an article with a good many words in each of its paragraphs.</p>" for i in range(6))
    for opened in ("<div class='has-sidebar'>", "<article class='post with-comments'>", "<div class='search-results'>", "<div class='header-image'>"):
        tag = opened[1:].split()[0]
        assert html_text.main_text(f"<body>{opened}{body}</{tag}></body>").count("\n") == 5


def test_long_page_is_read_whole_in_linear_time():
    page = "<article>" + "".join(f"<p>word {i}</p>" for i in range(20_000)) + "</article>"
    assert html_text.main_text(page).count("\n") == 19_999


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 6), (2, None, None, 6)], "page_id long, url string, html string, n_chars int")
    got = sorted(map(tuple, html_text.extract(df).collect()))
    text = html_text.main_text(PAGE)
    assert got == [(1, "u", text, len(text)), (2, None, "", 0), (2, None, "", 0)]
    assert html_text.extract(df.limit(0)).count() == 0


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, dict(RULES)[rule] if rule else "allow"


def test_url_rules(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "http://com/", "HTTP://WWW.Example.COM/en/x?y", "https://a.example.com/en/", "https://example.com/enx/", "http://x.net/es/a#b", "http://net/es", "http://xnet/es/", "ftp://é.com/ü", "http://a.com", "http://example.com?en/", "a://b://c.com/", "http://..com/", "http://www.example.com/en/"]
    rows = [(i, u) for i, u in enumerate([*urls, urls[5]])]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit(1)), RULES).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {i: judged(u) for i, u in rows}
    url_filter.write_rules([(f"h{i}.com/", "block") for i in range(5000)], str(tmp_path / "r"))
    opened = url_filter.RuleFile(str(tmp_path / "r"))
    assert (opened.find([b"h17.com/", b"x.com/", b"h4999.com/"]) >= 0).tolist() == [True, False, True]
    url_filter.write_rules([], str(tmp_path / "e"))
    assert url_filter.judge_urls(["http://a.com/"], url_filter.RuleFile(str(tmp_path / "e")), "allow")[0][3] == "allow"
    with pytest.raises(ValueError):
        url_filter.write_rules([("com", "allow")], str(tmp_path / "x"))


def test_colliding_keys_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)
    url_filter.write_rules([("a.com/", "block"), ("b.com/", "allow")], str(tmp_path / "r"))
    got = url_filter.judge_urls(["http://a.com/", "http://b.com/", "http://c.com/"], url_filter.RuleFile(str(tmp_path / "r")), "allow")
    assert [g[2] for g in got] == ["a.com/", "b.com/", None]


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, x in enumerate(g) if g.count(x) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_filter(spark):
    rng = random.Random(2)
    good = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    texts = [None, "", " \t\n", "a", "a b", "a a a a", "x y z x y z", good, good.upper(), " ".join(f"{w}#*" for w in good.split()), "\n".join(["same line of words"] * 40), "é ü|ß <b>", good + "\nline\nline\n\n \nline", "q " * 200, " ".join(good.split()[:50])]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"w": F.lit(1), "__g": F.lit(2), "kept": F.lit(3)})
    got = {r["doc_id"]: r for r in quality_rules.quality_report(df).collect()}
    for i, t in enumerate(texts):
        n = measures(t)
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == n
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    kept = {i for i, r in got.items() if r["kept"]}
    assert kept == {7, 12, 14}
    filtered = quality_rules.quality_filter(df)
    assert filtered.columns == df.columns and {r["doc_id"] for r in filtered.collect()} == kept
    assert quality_rules.quality_report(df.limit(0)).count() == 0 and quality_rules.quality_filter(df.limit(0)).count() == 0


def test_windows_whose_hashes_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "grams", lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.lit(7).cast("long") + i * 0))
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c x a b c y z a b c"), (3, "a b c d a b c")], DOCS)
    n = lambda text: quality_rules.MEASURES["n_repeat_words"](F.col("text"), text)
    got = df.select("doc_id", quality_rules.let(quality_rules.words(F.col("text")), n).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {1: 0, 2: 9, 3: 6}


def test_the_sample_comes_from_the_whole_table(spark):
    """Rows of which the last half fails a rule: the order of the cascade knows of it."""
    good = "".join(f"word{i} " for i in range(60))
    df = spark.createDataFrame([(i, good if i < 600 else "### " * 60) for i in range(1200)], DOCS).repartition(6)
    rules = quality_rules.plan_cascade(df, "text", [quality_rules.OWN_RULES[1], quality_rules.OWN_RULES[0]], rows=200)
    assert [r.name for r in rules] == ["symbols", "word_length"]


def test_very_long_texts(spark):
    long = "word and more of it " * 40_000
    df = spark.createDataFrame([(1, long), (2, "short")], DOCS)
    measured = {r["doc_id"]: r for r in quality_rules.quality_report(df).collect()}
    assert measured[1]["n_words"] == 200_000 and measured[1]["n_repeat_words"] == 200_000 and measured[1]["base_failed"]
    urls = spark.createDataFrame([(1, "http://a.com/" + "x" * 300_000), (2, "http://example.com/en/" + "y" * 300_000)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(urls, RULES).collect()} == {1: "allow", 2: "block"}
    model = toxicity.Model({"dolt": 5.0})
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame([(1, long), (2, "you dolt you dolt")], DOCS), model).collect()} == {1: 0, 2: 1}
    assert quality_classifier.score(df, np.zeros((1 << quality_classifier.BITS) + 1, dtype=np.float32)).count() == 2


def test_cascade_order_changes_cost_only(spark):
    df = spark.createDataFrame([(i, "a B c " * i) for i in range(60)], DOCS)
    rules = [*quality_rules.BASE_RULES, *quality_rules.OWN_RULES]
    sets = []
    for order in (rules, rules[::-1]):
        out = df.select("doc_id", quality_rules.let(quality_rules.words(F.col("text")), lambda w, o=None: w).alias("w"), "text")
        sets.append({r[0] for r in out.where(quality_rules.cascade(order, F.col("text"), F.col("w")).isNotNull()).select("doc_id").collect()})
    assert sets[0] == sets[1]
    assert [r.name for r in quality_rules.plan_cascade(df, "text", rules)][:2] != [] and set(r.name for r in quality_rules.plan_cascade(df.limit(0), "text", rules)) == {r.name for r in rules}


def labelled(spark, n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        bad, toxic = i % 3 == 0, i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["dolt", "grubling", "you dolt", "grubber"]))
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    odd = [(1000, None), (1001, ""), (1001, ""), (None, "text")]
    df = spark.createDataFrame(rows + odd, DOCS).withColumns({"y": F.lit(1), "score": F.lit("s"), "id": F.lit(2)})
    return df, spark.createDataFrame(labels + [(5000, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("label,folds,held,run", [("quality", 3, 1, quality_classifier.quality_scores), ("toxic", 5, 0, toxicity.toxicity_scores)])
def test_classifiers_hold_out(spark, label, folds, held, run):
    df, labels = labelled(spark)
    got = run(df, labels).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] < 1000 and r[label] is not None}
    out = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in got if r["doc_id"] is not None)
    assert len(out) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95
    nothing = run(df, labels.limit(0)).collect()
    assert len(nothing) == 404 and len({r["score"] for r in nothing if r["doc_id"] is not None}) == 1
    assert run(df.limit(0), labels).count() == 0


def test_leader_updates_by_brute_force():
    """The updates' definition, one feature at a time, on a few documents."""
    q = quality_classifier
    texts = [b"good plain words here", b"BAD!! WORDS!! HERE!!", b"plain words again and again", b"BAD!! BAD!! THING"]
    model, z, n = q.Follower(), {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= q.L1 else -(zi - (q.L1 if zi > 0 else -q.L1)) / ((q.BETA + ni**0.5) / q.ALPHA + q.L2)

    bias = len(model.z) - 1
    for _ in range(3):
        for y, (idx, val) in zip((1, 0, 1, 0), q.sparse(texts), strict=True):
            model.learn(idx, val, y)
            x = {**{int(i): float(v) for i, v in zip(idx, val)}, bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / q.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    weights = model.weights()
    assert all(weights[i] == pytest.approx(weight(i), abs=1e-7) for i in z) and np.count_nonzero(weights) <= len(z)
    want = [1 / (1 + np.exp(-(sum(weight(int(i)) * v for i, v in zip(idx, val)) + weight(bias)))) for idx, val in q.sparse(texts)]
    assert np.allclose(q.score_texts(texts, weights), want, atol=1e-6)


def test_held_out_labels_are_not_read(spark):
    df, labels = labelled(spark, 200)
    flipped = labels.withColumns({c: F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(f)) == h, 1 - F.col(c)).otherwise(F.col(c)) for c, f, h in (("quality", 3, 1), ("toxic", 5, 0))})
    for run in (quality_classifier.quality_scores, toxicity.toxicity_scores):
        a, b = (sorted(map(tuple, run(df, x).collect()), key=str) for x in (labels, flipped))
        assert a == b


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"dolt": 4.0, "grub*": 3.0})
    plain, aimed, denied, told, quoted = (g.clause_score(c) for c in ("such a dolt here", "you dolt", "he is not a dolt", "she said dolt things", 'the word "dolt" was'))
    assert aimed > plain > told > 0 and plain > denied and quoted < plain
    assert g.clause_score("dolt is what you are") == aimed  # a target may follow
    assert g.clause_score("they kill time") > 0 == g.clause_score("to kill time")
    assert g.clause_score("grubbing") == 3.0 and g.weight("degrub") == 0
    assert list(g.clauses("good one. bad dolt here! fine, really; a grubby dolt")) == [" bad dolt here", " a grubby dolt"]
    assert g.density(None) == g.density("") == g.density("clean text") == 0.0


def test_toxicity_filter_keeps_columns(spark):
    df = spark.createDataFrame([(1, "you dolt you dolt", 5), (2, "a clean text", 6), (3, None, 7)], "doc_id long, text string, __toxic int")
    out = toxicity.toxicity_filter(df, None, toxicity.Model({"dolt": 5.0}))
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {2, 3}


def test_names_alone_do_not_empty_a_page():
    long = "A paragraph of the article that goes on for a good while, and then for some more."
    body = f"<h1>Title</h1><p>{long}</p><p>{long}</p>"
    want = f"Title\n{long}\n{long}"
    for wrapper in ("div class='content has-sidebar'", "article class='post no-comments'", "div id='page-header-fixed'"):
        assert html_text.main_text(f"<body><{wrapper}>{body}</{wrapper.split()[0]}></body>") == want
        assert html_text.main_text(f"<body><div class='sidebar'><a href=x>a</a> <a href=y>b</a></div><{wrapper}><main>{body}</main></{wrapper.split()[0]}></body>") == want
    for name in ("related-work", "search", "notices", "login", "share"):
        page = f"<article><p>{long}</p><section id='{name}'><h2>Part</h2><p>{long}</p></section><div class='ad'>buy <a href=x>now</a></div><p>{long}</p></article>"
        assert html_text.main_text(page) == f"{long}\nPart\n{long}\n{long}"


def paths(grammar, clause):
    """The weights of all accepting paths, part by part, without the composed machine."""
    kinds, weights = grammar.read(clause)
    live = [(tuple(p.start for p in toxicity.CASCADE), 0.0)]
    for i, kind in enumerate(kinds):
        ahead = []
        for states, total in live:
            ways = [((), (kind, frozenset()))]
            for part, at in zip(toxicity.CASCADE, states, strict=True):
                ways = [((*done, to), out) for done, symbol in ways for to, out in part.step(at, symbol)]
            ahead += [(to, total + (grammar.arc_weight(weights[i], out) if out[0] in toxicity.ABUSE else 0.0)) for to, out in ways]
        live = ahead
    return [w for states, w in live if all(p.accepts(s) for p, s in zip(toxicity.CASCADE, states, strict=True))]


def test_composed_machine_against_all_paths():
    rng = random.Random(3)
    grammar = toxicity.Grammar({"dolt": 4.0, "grub*": 3.0, "grubling": 5.0})
    words = ["dolt", "grubby", "grubling", "kill", "will", "you", "not", "said", '"', "x"]
    for _ in range(800):
        drawn = [rng.choice(words) for _ in range(rng.randint(0, 9))]
        clause = " ".join(drawn)
        found = paths(grammar, clause)
        assert len(found) == 1 and found[0] == pytest.approx(grammar.clause_score(clause))
        kinds, weights = grammar.read(clause)
        want = 0.0  # the marks by looking around
        for i, kind in enumerate(kinds):
            if kind in ("insult", "threat"):
                near = "target" in kinds[max(0, i - toxicity.SPAN) : i + toxicity.SPAN + 1]
                told = "report" in kinds[:i] or kinds[:i].count("quote") % 2
                f = (toxicity.FACTORS["negated"] if "negation" in kinds[max(0, i - toxicity.SPAN) : i] else 1.0) * (toxicity.FACTORS["reported"] if told else 1.0)
                if kind == "insult":
                    want += weights[i] * f * (toxicity.FACTORS["targeted"] if near else 1.0)
                elif near:
                    want += toxicity.FACTORS["threat"] * f * (toxicity.FACTORS["meant"] if "intent" in kinds[max(0, i - toxicity.SPAN) : i] else 1.0)
        assert found[0] == pytest.approx(want)
        assert grammar.profile(clause) @ toxicity.mark_factors(grammar.factors) == pytest.approx(grammar.density(clause))


def test_words_of_any_length_count():
    long = "x" * 200
    grammar = toxicity.Grammar({long: 4.0, "y" * 60 + "*": 2.0})
    assert grammar.density(f"you {long}") > 0 and grammar.density("y" * 500) > 0


def test_negated_and_reported_clauses_need_the_grammar(spark):
    """Clauses that deny or report an insult are marked as clean: with its factors set to 1 the grammar takes them for
    toxic; learned, it tells them apart on held-out rows."""
    rng = random.Random(11)
    plain, denied = ["you are a {}", "what a {}", "the {} came"], ["he is not a {}", "never call anyone {}", 'she said "{}" once']
    rows, labels = [], []
    for i in range(1600):
        noun = rng.choice(["dolt", "grubling", "wretch"]) if i < 500 else rng.choice(["friend", "baker", "sailor"])
        clause = rng.choice(denied if i < 100 or i % 2 else plain).format(noun)
        words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(6)) for _ in range(40)]
        rows.append((i, " ".join(words[:20]) + f". {clause}. " + " ".join(words[20:]) + "."))
        labels.append((i, 1, int(100 <= i < 500 and i % 2 == 0)))
    rows, labels = zip(*((r, x) for r, x in zip(rows, labels) if not (100 <= r[0] < 500 and r[0] % 2)))
    model = toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(model.lexicon) == {"dolt", "grubling", "wretch"} or {w[:3] for w in model.lexicon} == {"dol", "gru", "wre"}
    flat = toxicity.Model(model.lexicon, model.slope, model.offset, dict.fromkeys(model.factors, 1.0))
    out = [(i, t) for i, t in rows if i < 500 and zlib.crc32(str(i).encode()) % 5 == 0]
    right = lambda m, denies: np.mean([(m.scores(np.array([m.grammar().density(t)]))[0] >= 0.5) == (i >= 100) for i, t in out if (i < 100) == denies])
    assert right(model, True) >= 0.9 and right(model, False) >= 0.9 and right(flat, True) <= 0.2


def test_a_stem_that_is_a_threat_stays_a_stem():
    threat = sorted(toxicity.THREATS)[0]
    grammar = toxicity.Grammar({threat + "*": 2.0})
    assert grammar.hits(f"such {threat}ers") == [5] and grammar.density(f"such {threat}ers") > 0
    assert toxicity.Grammar({}).hits(f"such {threat}ers") == []
