"""Main text of generated pages: attributes and ids with frame words, formulas, short paragraphs, no article tag."""

import random

import numpy as np
import pytest

from careops.llm import html_text

WORDS = "harbour lantern quiet river under morning seven bright stone letters walk over the of and a in winter".split()
FRAME_WORDS = ["hidden", "share", "related", "comments", "search", "footer", "nav", "advert", "cookie", "display:none", "sidebar"]
VALUES = ["title='The {w} city'", "data-{w}='false'", "aria-label=\"{w} gems of Rome\"", "data-title='class={w}'",
          "onclick=\"e.style='display:none'; x.id='{w}'\"", "lang=en data-x=\"id='{w}' hidden\"", "{w}-state=on"]
SLUGS = ["related-work", "search-trees", "comment-syntax", "share-of-voice", "hidden-markov-models", "form-follows-function"]


def extract(page):
    found = html_text.blocks(page)
    keep = html_text.classify(html_text.trained_tree(), html_text.features(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def paragraph(rng, least=12, most=60):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))) + "."


def page(rng):
    """HTML and its main text."""
    out, want = [], []
    holder = rng.choice(["article", "main", "div", "div"])

    def attribute():
        return " " + rng.choice(VALUES).format(w=rng.choice(FRAME_WORDS)) if rng.random() < 0.4 else ""

    def put(tag, text, extra=""):
        out.append(f"<{tag}{attribute()}{extra}>{text}</{tag}>")
        want.append(text)

    put("h1", " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 6))))
    for _ in range(rng.randint(3, 7)):
        if rng.random() < 0.3:
            slug = rng.choice(SLUGS)
            out.append(f"<section id='{slug}'{attribute()}>")
            put("h2", slug.replace("-", " ").capitalize(), f" id='{slug}-h'")
            put("p", paragraph(rng))
            out.append("</section>")
        put("p", paragraph(rng, 25))
        if rng.random() < 0.5:
            put("p", rng.choice(["Short one.", "Why not?", "No.", "So it was."]))
            put("p", paragraph(rng, 25))
        if rng.random() < 0.3:
            out.append("<p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> hold for now and for all that we do later on.</p>")
            want.append("Let x=12 hold for now and for all that we do later on.")
    body = "".join(out)
    menu = "<nav>" + "".join(f"<a href=/{w}>{w}</a> " for w in rng.sample(WORDS, 4)) + "</nav>"
    foot = "<footer><p>Copyright of the harbour office, all rights reserved</p></footer>"
    side = "<div class='sidebar'><p>Read the other letters of the week here and there</p></div>"
    return (f"<html><head><title>t</title></head><body>{menu}<{holder}{attribute()}>{body}</{holder}>{side}{foot}</body></html>",
            " ".join(want))


def test_generated_pages():
    rng = random.Random(12)
    good = total = 0
    for _ in range(200):
        html, want = page(rng)
        got, words = extract(html).split(), want.split()
        size = max(len(got), len(words))
        # words right: those of the longest common subsequence
        row = np.zeros(len(words) + 1, np.int64)
        for g in got:
            match = np.array([g == w for w in words])
            new = np.zeros_like(row)
            new[1:] = np.maximum(row[1:], row[:-1] + match)
            row = np.maximum.accumulate(new)
        good, total = good + int(row[-1]), total + size
    assert good / total >= 0.98


P = "<p>" + "plain words of a long paragraph " * 6 + "</p>"


@pytest.mark.parametrize("attribute", ["title='The hidden city'", "data-hidden='false'", "aria-label='Hidden gems of Rome'",
                                       "data-title='class=share'", "onclick=\"e.style='display:none'\""])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_attribute_values_are_no_names(tag, attribute):
    html = f"<{tag} {attribute}><article {attribute}><h1>A title</h1>{P}<p {attribute}>Kept.</p>{P}</article></{tag}>"
    assert extract(html) == " ".join(["A title", "plain words of a long paragraph " * 6 + "Kept.", *(["plain words of a long paragraph"] * 6)])


def test_real_frames_in_the_article_still_go():
    html = (f"<article><h1>Title here</h1>{P}<div class='share-buttons'>Share it</div><section class='comments'><p>Nice one</p></section>"
            f"<div hidden>unseen</div><div style='display: none'>unseen</div><div class='related-posts'>{P}</div>"
            f"<div id='comments'>{P}</div>{P}</article>")
    assert extract(html).split() == ("Title here " + "plain words of a long paragraph " * 12).split()


def test_annotations_of_formulas_go():
    html = f"<article>{P}<p>Say <math><semantics><mi>y</mi><annotation encoding='tex'>y^{{1}}</annotation></semantics></math> is so.</p></article>"
    assert extract(html).endswith("Say y is so.")
