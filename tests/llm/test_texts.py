"""Tokens, languages, benchmark passages, personal data, fingerprints, licences and pages."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairforge.llm import boosting, bpe, decontaminate, fingerprint, html_extract, langid, license_scan, pii
from pairforge.llm.inputs import VOCABULARY, documents, table
from pairforge.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_tokens_of_the_table(spark, texts, library):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_bpe"](spark, SF).collect()}
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_every_character_and_special_tokens(library):
    with open(VOCABULARY, encoding="utf-8") as file:
        own = bpe.Vocabulary(file.read())
    marks = ["<|endoftext|>", "a<|startoftext|>b<|endoftext|>", "ΑΣ ΣΑΣ", "aaaaaaaaaaaaaa", "é x", "don't we'll I'M"]
    chars = [f"a{chr(c)}b" for c in [*range(0xD800), *range(0xE000, 0x12000), *range(0x1F000, 0x20000)]]
    for text in marks + chars:
        assert np.frombuffer(own.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text)


def test_odd_rows_of_tokens(odd, nothing):
    got = bpe.encode_decode(odd.withColumn("ids", F.lit(1)), VOCABULARY)
    assert got.columns == [*odd.columns, "ids", "decoded"] and got.count() == odd.count()
    assert {(r.n, r.decoded) for r in got.filter("text IS NULL OR text = ''").selectExpr("size(ids) n", "decoded").collect()} == {(0, "")}
    assert bpe.encode_decode(nothing, VOCABULARY).count() == 0


def test_held_out_languages(spark):
    got = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").join(
        table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id"
    )
    n, right = got.filter("held_out").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right >= 0.98 * n


def test_code_lengths_are_those_of_the_tree():
    """Table look-ups against the recursive definition."""
    texts = {0: b"abab abba", 1: b"cab dab"}
    grams = {}
    for lang, text in texts.items():
        keys = langid._keys(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        for size, column in enumerate(keys, 1):
            for key in column.tolist():
                grams[lang, size, key] = grams.get((lang, size, key), 0) + 1
    rows = np.array([(*k, n) for k, n in grams.items()])
    model = langid._build(["x", "y"], rows[:, 0], rows[:, 1], rows[:, 2].astype(np.uint32), rows[:, 3])

    def bits(lang, size, key):
        context = key >> 8
        follow = [n for (l, s, k), n in grams.items() if (l, s) == (lang, size) and (size == 1 or k >> 8 == context)]
        total, kinds = sum(follow), len(follow)
        seen = grams.get((lang, size, key), 0)
        if seen:
            return np.log2((total + kinds) / seen)
        leave = np.log2((total + kinds) / kinds) if total else 0
        return leave + (8 if size == 1 else bits(lang, size - 1, key & (1 << 8 * (size - 1)) - 1))

    probe = b"abc dabz"
    keys = langid._keys(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))
    want = [sum(bits(lang, 4, key) for key in keys[3].tolist()) for lang in (0, 1)]
    assert np.allclose(model.lengths(np.frombuffer(probe, np.uint8), np.array([0, len(probe)]))[0], want, atol=1e-3)


def test_odd_rows_of_languages(odd, nothing):
    got = langid.identify(odd)
    assert got.count() == odd.count()
    rows = {(r.text or "")[:8]: (r.lang_pred, r.score) for r in got.collect()}
    assert rows[""] == ("und", 0.0) and rows[" \t\n "] == ("und", 0.0) and rows["é 12345 "][0] in ("de", "en")
    assert langid.identify(nothing).count() == 0


def test_joined_benchmark_equals_the_broadcast_one(spark):
    docs, items = documents(spark, SF), table(spark, SF, "benchmark")
    items = items.unionByName(spark.createDataFrame([(900, "of the"), (901, "..."), (902, None), (900, "of the")], items.schema))
    one = decontaminate.find_benchmark(docs, items).select("doc_id", *decontaminate.summary())
    two = decontaminate.find_benchmark(docs, items, broadcast_windows=0).select("doc_id", *decontaminate.summary())
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(one) == rows(two) and any(r[5] for r in rows(one))


def test_odd_rows_of_the_benchmark(odd, nothing):
    items = odd.selectExpr("doc_id AS item_id", "text")
    for bound in (decontaminate.BROADCAST_WINDOWS, 0):
        got = decontaminate.find_benchmark(odd, items, out="mark", broadcast_windows=bound)
        assert got.count() == odd.count() and got.columns[-1] == "mark" or "mark" in got.columns
        hits = {(r.doc_id, r.mark.n_hit) for r in got.filter("doc_id < 6").collect()}
        assert hits == {(1, 15), (2, 15), (3, 0), (4, 0), (5, 0)}
        empty = odd.filter("false").selectExpr("doc_id AS item_id", "text")
        assert decontaminate.find_benchmark(odd, empty, broadcast_windows=bound).filter("found.n_hit > 0").count() == 0
        assert decontaminate.find_benchmark(nothing, items, broadcast_windows=bound).count() == 0


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind, value):
    figures = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        twice = [x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(figures[::-1])]
        return 16 <= len(figures) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 8 <= len(figures) <= 15


def base_of(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in RULES.items() for m in re.finditer(p, text) if accepted(k, m[0]))


TRICKY = [
    "a@b.c_d@e.f x@y x@y.z..w@v.u é+49 (30) 123-456 é 1.2.3.4.5.6.7.8 999.1.1.1 00255.0.0.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 40 + " 5500000000000004 +1 (826) 555-4081 190.137.223.204",
    "𝔘 user@mail.example.com 𝔘 +1234567",
    "@@@..a@b.c-.d +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
]


def test_rules_against_plain_patterns(spark, texts):
    docs = texts + [(10_000 + i, t) for i, t in enumerate(TRICKY)]
    found = pii.find_personal_data(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.doc_id: r for r in found.select("doc_id", *pii.digests()).collect()}
    for i, t in docs:
        want = base_of(t)
        assert got[i].base_sha256 == sha(want), (i, want)
        assert set(want.split(",")) <= {*got[i].spans.split(","), ""}


def test_long_texts_without_personal_data(spark):
    long = "a" * 200_000 + " " + "1 " * 50_000 + "." * 100_000
    assert pii.find_personal_data(spark.createDataFrame([(1, long)], "doc_id long, text string")).select("base.email").first()[0] == []


def test_redaction(spark, odd, nothing):
    text = "mail user@mail.example.com or 10.0.0.1 now"
    df = spark.createDataFrame([(1, text, "e"), (2, None, "e"), (3, "clean 12", "e")], "doc_id long, text string, base string")
    got = {r.doc_id: (r.text, r.base) for r in pii.redact(df.select("doc_id", "text", F.col("base").alias("label"))).selectExpr("*", "label AS base").collect()}
    assert got == {1: ("mail <email> or <ip> now", "e"), 2: (None, "e"), 3: ("clean 12", "e")}
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(nothing).count() == 0


def test_redaction_keeps_columns_of_any_name(spark):
    text = "mail user@mail.example.com now"
    rows = spark.createDataFrame([(1, text, "e", 7, 8, 9, 10)], "doc_id long, text string, base string, spans int, _base int, _candidates int, _spans int")
    assert [tuple(r) for r in pii.redact(rows).collect()] == [(1, "mail <email> now", "e", 7, 8, 9, 10)]
    got = pii.find_personal_data(rows.drop("base", "spans").withColumns({"_held": F.lit(1), "_fold": F.lit(2), "_added": F.lit(3)}))
    assert [tuple(r) for r in got.select("_base", "_candidates", "_spans", "_held", "_fold", "_added").collect()] == [(8, 9, 10, 1, 2, 3)]


def test_keys_after_key_words_are_learned(spark):
    """No rule takes them; the trees do, from labels that are no feature."""
    found = pii.find_personal_data(documents(spark, "/root/testdata/sf0.01").withColumn("whole", F.col("text")))
    keyed = found.filter("whole rlike 'token = \"[0-9a-f]{40}'")
    assert keyed.count() >= 10 and keyed.filter("exists(spans, s -> s.kind = 'secret')").count() == keyed.count()
    assert found.filter("exists(spans, s -> s.kind = 'secret') AND NOT whole rlike '[A-Za-z0-9]{20}'").count() == 0


@pytest.mark.parametrize("n", [1, 255, 256, 257, 512, 1000, 300_000])
def test_offsets_of_many_matches(spark, n):
    text = "12 é3 𝔘 " * n
    got = spark.createDataFrame([(text,)], "text string").select(pii.matches(F.col("text"), pii.DIGITS).alias("m"))
    got = got.select(F.size("m"), F.expr("element_at(m, 1)"), F.expr("element_at(m, -1)"), F.expr("aggregate(m, 0L, (a, x) -> a + x.start)")).first()
    starts = [8 * i + k for i in range(n) for k in (0, 4)]
    assert (got[0], tuple(got[1]), tuple(got[2]), got[3]) == (2 * n, (0, 2, "12"), (8 * n - 4, 8 * n - 3, "3"), sum(starts))


def test_boosting_learns_and_its_column_agrees(spark):
    x = np.array([[a, b] for a in range(6) for b in range(4)])
    n = np.full(len(x), 50)
    positive = np.where((x[:, 0] > 2) & (x[:, 1] < 2), 48, 1)
    model = boosting.fit(["a", "b"], x, n, positive)
    margin = model.margin(x)
    assert ((margin > 0) == (positive > 25)).all()
    df = spark.createDataFrame([(int(a), int(b)) for a, b in x], "a int, b int")
    assert np.allclose([r[0] for r in df.select(model.column(F.col)).collect()], margin)
    assert boosting.least_margin(margin, n, positive, 0.9) > 0 and boosting.least_margin(margin, n, 0 * n, 0.9) == float("inf")


def tree_of(print_):
    """Root, and sections as (node, [(node, [leaf])])."""
    root, _, tree = print_.partition("/")
    sections = []
    for section in tree.split(";"):
        node, _, below = section.partition(":")
        sections.append((node, [(p.partition(":")[0], p.partition(":")[2].split(".")) for p in below.split(",")]))
    return root, sections


def tree_likeness(a, b):
    (root_a, in_a), (root_b, in_b) = tree_of(a), tree_of(b)
    if root_a == root_b:
        return 1.0

    def differing(x, y):
        out = {}
        for node, below in x:
            if node not in {n for n, _ in y}:
                out[node] = below
        return [p for below in out.values() for p in below]

    pa, pb = differing(in_a, in_b), differing(in_b, in_a)
    la, lb = set(differing(pa, pb)), set(differing(pb, pa))
    total = sum(len(leaves) for sections in (in_a, in_b) for _, ps in sections for _, leaves in ps)
    return 1 - (len(la - lb) + len(lb - la)) / total


def check_tree(print_, text):
    """Every node is the hash of the nodes below; borders follow from the nodes; lines and clauses are all there."""
    root, sections = tree_of(print_)
    paragraphs = [p for _, ps in sections for p in ps]
    assert [len(leaves) for _, leaves in paragraphs] == [len(regex.split(r"(?<=[^\p{L}\p{N}]) ", line)) for line in text.split("\n")]
    for node, ps in sections:
        assert node == sha("".join(n for n, _ in ps))[:16] and all(int(n, 16) % fingerprint.SECTION for n, _ in ps[:-1])
    assert all(int(ps[-1][0], 16) % fingerprint.SECTION == 0 for _, ps in sections[:-1])
    assert root == sha(f"{len(text)}:" + "".join(n for n, _ in sections))[:32]


def test_fingerprints_of_the_table(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op3_fingerprint"](spark, SF).collect()}
    prints = {}
    for k, (i, t) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
    assert len(set(prints.values())) == len(prints)
    for k, (i, t) in enumerate(texts):
        r, after = got[i], got[texts[(k + 1) % len(texts)][0]]
        assert r.near_edited == pytest.approx(tree_likeness(r.fingerprint, r.edited_fingerprint), abs=1e-12)
        assert r.near_next == pytest.approx(tree_likeness(r.fingerprint, after.fingerprint), abs=1e-12)
        check_tree(r.fingerprint, t)
    near = [r.near_edited for r in got.values()]
    assert 0.35 < sum(near) / len(near) < 0.65 and sum(r.near_next for r in got.values()) / len(got) < 0.1


def test_changed_paragraphs(spark):
    lines = [f"line {i} is here. It says {i * 7}, and more." for i in range(40)]
    other = [*lines[:11], "something else", *lines[12:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    a, b = fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))
    assert tuple(df.select(fingerprint.changed(a, b), fingerprint.changed(a, a)).first()) == ([11], [])


def test_odd_rows_of_fingerprints(spark, odd, nothing):
    assert fingerprint.compare_edited(odd).count() == odd.count()
    assert fingerprint.compare_edited(nothing).count() == 0
    sparse = spark.createDataFrame([(-(10**15), "ab"), (5, "cdef"), (10**17, "")], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.compare_edited(sparse).collect()}
    assert got == {-(10**15): sha("ac"), 5: sha("cd"), 10**17: sha("")}


@pytest.mark.parametrize("far", [[2**60], [2**60 + i for i in range(5_000)], [-(2**60)], [i * 2**40 for i in range(1, 9_000)]])
def test_buckets_of_ids_are_bounded_for_any_ids(spark, far):
    """Dense ids with one or many far ones: no bucket takes much more than its share, and neighbours are found."""
    ids = sorted([*range(20_000), *far])
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    width = fingerprint._bucket_width(df)
    largest = df.groupBy(F.floor(F.col("doc_id") / width)).count().agg(F.max("count")).first()[0]
    assert largest <= 4 * fingerprint.BUCKET_ROWS
    got = {r.text: r.next_text for r in fingerprint.with_next(df).select("text", "next_text").collect()}
    assert got == {f"text {i}": f"text {j}" for i, j in zip(ids, [*ids[1:], ids[0]])}


def test_licences_with_edits_and_odd_rows(spark, odd, nothing):
    notice = license_scan.TEMPLATES["mit-permission"]
    words = notice.split()
    words[7] = "CHANGED"
    df = spark.createDataFrame([(1, "x y z " * 30 + " ".join(words) + " more"), (2, " ".join(words[:9])), (3, "ALL, RIGHTS -- reserved")], "doc_id long, text string")
    got = {r.doc_id: [f.license for f in r.found] for r in license_scan.scan(df).collect()}
    assert got == {1: ["mit-permission"], 2: [], 3: ["all-rights-reserved"]}
    assert license_scan.scan(odd).filter("size(found) > 0").count() == 0 and license_scan.scan(odd).count() == odd.count()
    assert license_scan.scan(nothing).count() == 0 and license_scan.scan(df, {}).filter("size(found) > 0").count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(df, {"short": "two words"})


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="cookie-notice">We use cookies to serve you well each day.</div>
<div id="page"><h1>Head &amp; line</h1><p>First   paragraph <b>with
bold</b> words &lt;here&gt; and more of them.<p>Second one follows the first one<div class="ad">Buy now cheap things here</div><p>Third &eacute;nd.
<aside>Look aside</aside><form><label>Name</label><input></form><div class="comments"><p>I think so too, said a reader of it.</p></div></div>
<footer>&copy; someone</footer></body></html>"""


def test_main_text_of_pages():
    weights = dict(html_extract.DEFAULT_WEIGHTS)
    want = "Head & line\nFirst paragraph with bold words <here> and more of them.\nSecond one follows the first one\nThird énd."
    assert html_extract.extract(PAGE, weights) == want
    assert html_extract.extract(PAGE.replace('<div id="page">', "<article>"), weights) == want
    assert html_extract.extract(None, weights) == html_extract.extract("", weights) == html_extract.extract("<br><p>", weights) == ""
    assert html_extract.extract("plain words", weights) == "plain words"
    assert html_extract.extract("<article><p>a b c <!-- no > text --><p>d e", weights) == "a b c\nd e"


def test_best_run_is_the_largest():
    rng = np.random.default_rng(1)
    for _ in range(200):
        scores = rng.integers(-4, 5, rng.integers(0, 9)).tolist()
        low, high = html_extract.best_run(scores)
        assert sum(scores[low:high]) == max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])


def test_pages_of_the_table(spark):
    rows = QUERIES["op4_html_extract"](spark, SF).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        for word in re.findall(r"[A-Za-z]{4,}", re.sub(r"<[^>]*>|&\w+;", " ", body))[:50]:
            assert word in r.text
        assert "<p>" not in r.text and "track(" not in r.text and r.n_chars == len(r.text)
    assert html_extract.extract_pages(table(spark, SF, "pages").limit(0)).count() == 0


def test_bands_order_shingles_independently(spark):
    """Of two shingles that part in the leading bit, which one is least differs from pair to pair."""
    rows = [(i * 7919 + 1, -(i * 104729 + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "a long, b long")
    bands = df.select("a", license_scan._bands(F.array("a", "b")).alias("least")).collect()
    first = {tuple(x == r.least[0] for x in r.least) for r in bands}
    assert len(first) > 30 and all(set(r.least) <= {x for row in rows for x in row} for r in bands)


def learned(pages):
    batch = pa.RecordBatch.from_arrays([pa.array(pages)], ["html"])
    counts = next(html_extract.count_tokens(iter([batch])))
    return html_extract.weights_from(Counter({(t, g): n for t, g, n in zip(*(c.to_pylist() for c in counts.columns))}))


@pytest.fixture(scope="module")
def marked_pages(spark):
    return [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]


def test_pages_are_read_without_their_marks(marked_pages):
    """Whole texts with ``article`` taken away equal the article of the marked page."""
    weights = learned(marked_pages[:100])
    for page in marked_pages:
        inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
        want = html_extract.extract(inside, {**html_extract.DEFAULT_WEIGHTS, "": -0.1, "p": -0.1})
        assert want and html_extract.extract(page, weights) == want
        assert html_extract.extract(re.sub(r"<(/?)article>", r"<\1div>", page), weights) == want


def test_weights_decide(marked_pages):
    """An advert under a class of no known name is text for fixed weights and none for learned ones."""
    pages = [p.replace('class="ad"', 'class="zzz"') for p in marked_pages]
    weights = learned(pages[:100])
    fixed = dict(html_extract.DEFAULT_WEIGHTS)
    assert weights["name zzz"] < html_extract.APART
    assert all(html_extract.extract(p, weights) == html_extract.extract(q, weights) for p, q in zip(pages, marked_pages))
    assert sum(html_extract.extract(p, fixed) != html_extract.extract(p, weights) for p in pages) > len(pages) // 3


def test_kinds_of_parts_are_learned_from_labels():
    """Legal notes that stand in articles stay there; adverts in articles go whatever labels say."""
    words = "many plain words of a story that goes on " * 4
    page = f'<body><nav><a href=1>x</a></nav><article><p>{words}</p><div class="legal"><p>{words}</p></div><div class="ad">buy {words}</div></article></body>'
    fixed = dict(html_extract.DEFAULT_WEIGHTS)
    assert html_extract.extract(page, fixed) == words.strip()
    assert html_extract.extract(page, learned([page] * 50)) == f"{words.strip()}\n{words.strip()}"


def test_teasers_in_articles_are_no_main_text():
    story = "A long story goes on and on with many words. " * 8
    cards = "".join(f'<article class="card"><a href="{i}">Other story teaser {i}</a></article>' for i in range(2))
    page = f"<html><body><div><h1>Title</h1><p>{story}</p></div>{cards}</body></html>"
    assert html_extract.extract(page, dict(html_extract.DEFAULT_WEIGHTS)) == f"Title\n{story.strip()}"
