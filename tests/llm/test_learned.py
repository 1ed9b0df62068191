"""Operators that learn: held-out accuracy, what they may look at, and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorewise.llm import html_blocks, html_text, language, quality
from scorewise.llm.words import slices

SYLLABLES = {"aa": ["ba", "ko", "mi"], "bb": ["thr", "ing", "ost"], "cc": ["é", "ou", "eau"]}


def sentence(draw, lang, n):
    return " ".join("".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    draw = random.Random(1)
    rows = []
    for i in range(600):
        lang = draw.choice(sorted(SYLLABLES))
        rows.append((i, sentence(draw, lang, draw.randint(5, 60)), lang, f"s{i % 3}", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# --- languages ---------------------------------------------------------------------------------------------------

def test_held_out_languages(spark, spoken):
    rows = spoken.withColumn("held_out", language.held_out())
    found = language.predicted(rows, language.fit(spoken)).filter("held_out").collect()
    assert len(found) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98


def test_labels_of_held_out_rows_are_not_learned(spark, spoken):
    lied = spoken.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    one, other = language.fit(spoken), language.fit(lied)
    assert one.languages == other.languages and np.array_equal(one.table, other.table)


def test_mixtures(spark, spoken):
    draw = random.Random(2)
    model = language.fit(spoken)
    texts = [sentence(draw, "aa", 70) + " " + sentence(draw, "bb", 30), sentence(draw, "cc", 100), sentence(draw, "aa", 40) + "\n" + sentence(draw, "cc", 40) + "\n" + sentence(draw, "bb", 20)]
    shares = language.shares_of(pa.array(texts), model)
    assert np.allclose(shares[0], [0.7, 0.3, 0], atol=0.05) and np.allclose(shares[1], [0, 0, 1]) and np.allclose(shares[2], [0.4, 0.2, 0.4], atol=0.05)


def test_mixture_is_at_a_maximum():
    draw = np.random.default_rng(3)
    likelihood = draw.normal(size=(500, 3)) * 3
    edges = np.array([0, 100, 350, 500])
    owner = np.repeat(np.arange(3), np.diff(edges))
    p = np.exp(likelihood - likelihood.max(axis=1, keepdims=True))
    shares, evidence = language._mixture(p, edges, owner, 2000, 1e-9)
    value = lambda s: np.add.reduceat(np.log((p * s[owner]).sum(axis=1)), edges[:-1])
    for _ in range(50):
        other = np.abs(shares + draw.normal(size=shares.shape) * 0.02)
        assert (value(other / other.sum(axis=1, keepdims=True)) <= evidence + 1e-6).all()


def test_odd_texts_have_a_language_or_none(spark, spoken, docs, clashing, empty):
    model = language.fit(spoken)
    named = {(r["doc_id"], r["text"]): r for r in language.predicted(docs, model).collect()}
    for (key, text), r in named.items():
        lettered = any(c.isalpha() for c in text or "")
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    kept = language.recognised(clashing, model)
    assert kept.columns == clashing.columns and kept.filter("text is null or trim(text) = ''").isEmpty()
    assert language.predicted(empty, model).count() == 0
    nothing = language.predicted(docs, language.fit(empty)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_cutting_a_batch_changes_nothing(spark, spoken, monkeypatch):
    model = language.fit(spoken)
    column = pa.array([r["text"] for r in spoken.limit(50).collect()])
    whole = language.shares_of(column, model)
    one = np.concatenate([language.shares_of(column.slice(i, 1), model) for i in range(50)])
    assert np.array_equal(whole, one)


# --- quality -----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def graded(spark):
    draw = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        parts = [sentence(draw, "bb", 64) for _ in range(draw.randint(1, 6))]
        bad = i % 4 == 0
        if bad:  # one passage of many is junk
            parts[draw.randrange(len(parts))] = " ".join(w.upper() + "!!" for w in sentence(draw, "bb", 64).split())
        rows.append((i, " ".join(parts), "bb", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_quality(spark, graded):
    docs, labels = graded
    found = quality.scored(docs.withColumn("held_out", quality.held_out()), quality.fit(docs, labels)).join(labels, "doc_id")
    rows = found.filter("held_out").collect()
    assert len(rows) > 200 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_held_out_labels_are_not_learned(spark, graded):
    docs, labels = graded
    lied = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = quality.fit(docs, labels, epochs=1), quality.fit(docs, lied, epochs=1)
    assert all(np.array_equal(one.w[k], other.w[k]) for k in one.w) and one.shift == other.shift


def test_gradients_match_differences():
    draw = np.random.default_rng(0)
    model = quality.Model(3)
    x, edges, y = draw.normal(size=(11, quality.PAIRS + quality.SHAPES)), np.array([0, 3, 4, 11]), np.array([1.0, 0.0, 1.0])
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    loss = lambda: float(np.mean(np.logaddexp(0, model.forward(x, edges)["logit"]) - y * model.forward(x, edges)["logit"]))
    gradients = model.gradients(x, edges, y, 0.0)
    for name, array in model.w.items():
        at = tuple(draw.integers(0, s) for s in array.shape)
        array[at] += 1e-5
        up = loss()
        array[at] -= 2e-5
        down = loss()
        array[at] += 1e-5
        assert gradients[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_attention_sums_to_one_and_passages_cover_the_text():
    texts = pa.array(["a b c", "", " ".join(["word"] * 200), "\n", "x " * 64 + "y"])
    (_, data, offsets), = slices(texts)
    x, edges = quality.passages(data, offsets)
    assert np.diff(edges).tolist() == [1, 1, 4, 1, 2]
    state = quality.Model().forward(x, edges)
    assert np.allclose(np.add.reduceat(state["attention"], edges[:-1]), 1, atol=1e-5)


def test_odd_texts_have_a_score(spark, graded, docs, clashing, empty):
    model = quality.fit(*graded, epochs=2)
    found = quality.scored(clashing, model)
    assert found.count() == clashing.count() and found.filter("score is null or score < 0 or score > 1").isEmpty()
    assert found.columns == [c for c in clashing.columns if c != "score"] + ["score", "predicted"]
    assert quality.scored(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.scored(docs, quality.fit(docs, odd)).collect()} == {0.5}


# --- pages -------------------------------------------------------------------------------------------------------

def page(draw, marked, i):
    paragraphs = [sentence(draw, "bb", draw.randint(12, 60)).capitalize() + "." for _ in range(draw.randint(2, 6))]
    title = sentence(draw, "bb", 5).capitalize()
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    inner = f'<article>{body}<div class="comments"><p>{sentence(draw, "aa", 9)}</p></div></article>' if marked else f'<div><div class="x">{body}</div></div>'
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in sentence(draw, "aa", 6).split())
    html = (
        f"<html><head><title>{title}</title><script>var a='<p>no</p>'</script><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav>"
        f'<div class="ad">{sentence(draw, "aa", 8)}.</div>{inner}<form>Search <input><button>Go</button></form>'
        f'<aside>{sentence(draw, "aa", 12)}</aside><footer>&copy; 2024 {sentence(draw, "aa", 4)}</footer></body></html>'
    )
    return (i, f"http://x/{i}", html, " ".join([title, *paragraphs]))


@pytest.fixture(scope="module")
def pages(spark):
    draw = random.Random(9)
    return spark.createDataFrame([page(draw, i % 5 != 0, i) for i in range(200)], "page_id long, url string, html string, want string")


def test_main_text(spark, pages):
    rows = html_text.extracted(pages, html_text.fit(pages)).collect()
    assert all(r["text"] == r["want"] and r["n_chars"] == len(r["want"]) for r in rows if r["page_id"] % 5)
    # pages without any mark of the article
    plain = [r for r in rows if not r["page_id"] % 5]
    assert np.mean([r["text"] == r["want"] for r in plain]) > 0.9


def test_field_gradient_and_decoding():
    draw = np.random.default_rng(1)
    field = html_text.Field()
    field.moves = draw.normal(size=(2, 2))
    x, y = draw.normal(size=(7, len(html_text.NAMES))), draw.integers(0, 2, 7)
    _, d_weights, d_moves = field.gradient(x, y)
    for array, gradient, at in ((field.weights, d_weights, (4,)), (field.moves, d_moves, (0, 1)), (field.moves, d_moves, (1, 1))):
        array[at] += 1e-6
        up = field.gradient(x, y)[0]
        array[at] -= 2e-6
        down = field.gradient(x, y)[0]
        array[at] += 1e-6
        assert gradient[at] == pytest.approx((up - down) / 2e-6, abs=1e-4)
    score = lambda z: sum(x[i] @ field.weights * z[i] for i in range(7)) + sum(field.moves[a, b] for a, b in zip(z, z[1:]))
    best = max(([*map(int, f"{n:07b}")] for n in range(128)), key=score)
    assert field.decode(x).astype(int).tolist() == best


def test_blocks():
    blocks, title = html_blocks.blocks_of(
        "<title>T &amp; U</title><div id=a>one <b>t</b>wo<br>three<p>four<p>fi&eacute;ve\n\n x<ul><li>a<li>b</ul><!-- no --><script>no()</script></div>tail &lt;p&gt;"
    )
    assert title == "T & U" and [b.text for b in blocks] == ["one two three", "four", "fiéve x", "a", "b", "tail <p>"]
    assert blocks[3].tags[-2:] == ("ul", "li") and blocks[1].tags == ("div", "p")


@pytest.mark.parametrize("start", ["<body><article>", "<article>", "<div>", "<p>", "<span>", ""])
def test_a_head_without_its_end(start):
    head = "<html><head><meta charset=utf-8><title>T</title><noscript><img src=x><p>no</p></noscript><style>p{}</style>"
    blocks, title = html_blocks.blocks_of(head + start + "one two<p>three")
    assert title == "T" and [b.text for b in blocks] == ["one two", "three"]
    assert not any("head" in b.tags for b in blocks)
    closed, _ = html_blocks.blocks_of(head + "</head>" + start + "one two<p>three")
    assert blocks == closed


def test_shares_are_those_of_the_whole_block():
    text = "A" * 250 + "b" * 500 + "7" * 250
    x = html_text.features(html_blocks.blocks_of(f"<p>{text}</p>")[0], "")[0]
    assert x[html_text.NAMES.index("digits")] == pytest.approx(0.25) and x[html_text.NAMES.index("capitals")] == pytest.approx(1 / 3)


def test_odd_pages(spark, pages):
    field = html_text.fit(pages)
    rows = [(1, "u", None), (2, None, ""), (None, "u", "just words, no tags at all, but a sentence that goes on and on, as articles do."), (3, "u", "<article><p>cut off in the mid"), (3, "u", "<article><p>cut off in the mid"), (4, "u", "<<<>>><p <b>&#x110000;&nosuch;</article>"), (5, "u", "<article>" + "<p>" + "word " * 60_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("own"))
    found = {r["page_id"]: r for r in html_text.extracted(df, field).collect()}
    assert found[1]["text"] == "" and found[2]["n_chars"] == 0 and found[3]["text"] == "cut off in the mid"
    assert found[5]["n_chars"] == 5 * 60_000 - 1
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extracted(none, html_text.fit(none)).count() == 0
