"""HTML extraction: the block rules decide on marked pages too, and odd pages take time in proportion to their length."""

import itertools
import random
import time

import pytest

from scanlytics.llm import html

STORY = "This is the story of the cat and it is in the house on the hill. " * 6
RULES = html.Rules()


def test_unrelated_teaser_does_not_hide_the_story():
    page = f"<div><p>{STORY}</p><p>It is short.</p></div><article><p>Teaser</p></article>"
    assert html.main_text(page) == f"{STORY.strip()}\n\nIt is short."


def test_headings_of_an_article_follow_it_and_not_what_stands_beside():
    page = f"<div class=ad>{STORY}</div><article><h1>Head</h1><p>One.<p>{STORY}<form>Sign up</form><p>End.</article><div>Also <a href=1>to read here</a></div>"
    assert html.main_text(page) == f"Head\n\nOne.\n\n{STORY.strip()}\n\nEnd."
    assert html.main_text("<div>Loose words</div><article><h1>Head</h1><p>Tiny.</article>") == "Head\n\nTiny."


def test_rules_decide_on_marked_pages():
    blocks = html.blocks_of(f"<nav>x</nav><article><h1>Head</h1><p>{STORY}</article><div>{'zz ' * 100}</div>")
    marked = html.marked_share(blocks, RULES)
    assert 0.5 < marked < 1
    assert [html.first_pass(b, marked, RULES) for b in blocks] == ["out", "short", "good", "bad"]


def nearest(labels):
    """The second pass as it is said."""
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    out = []
    for i, x in enumerate(labels):
        least = min((abs(i - k) for k in decided), default=None)
        near = {labels[k] for k in decided if abs(i - k) == least}
        out.append(x if x in ("good", "bad") else near.pop() if len(near) == 1 else "good" if x == "unsure" else "bad")
    return out


def test_second_pass_is_the_nearest_neighbour():
    for n in range(6):
        for labels in itertools.product(["good", "bad", "short", "unsure"], repeat=n):
            assert html.second_pass(list(labels)) == nearest(list(labels))
    rng = random.Random(3)
    for _ in range(200):
        labels = rng.choices(["good", "bad", "short", "unsure"], [1, 1, 6, 6], k=40)
        assert html.second_pass(labels) == nearest(labels)


def test_attributes_and_quotes():
    texts = {
        "<p title='a > b'>x</p>": "x",
        '<p title="a > b" class=x>x</p>': "x",
        "<p title=\"it's\">x</p><p>y</p>": "x\n\ny",
        "<p it's>x</p>": "x",
        "<p class='x\">x</p>": "x",
        "a < b <i>c</i>": "a < b c",
        "<p hidden>x</p><p>y</p>": "y",
        "x<!-- > <p>no --> y<!-->z": "x y",
        "<SCRIPT>var a='<p>';</SCRIPT >x<style>": "x",
        "x <b": "x",
        "<p>x</p></div></span>y": "x\n\ny",
    }
    for page, text in texts.items():
        blocks = html.blocks_of(page)
        assert "\n\n".join(b.text for b in blocks if not b.boilerplate) == text, page


@pytest.mark.parametrize(
    "page",
    [
        "<script " * 125_000, "<a " * 330_000, '"' * 1_000_000, "<p class='x\">" * 80_000, "<a b=\"c'>" * 110_000, "<!--" * 250_000,
        "<div>" * 100_000 + "</span>" * 80_000, "<svg>" * 200_000, "<a href='><b c=\"x>" * 55_000, "<i class=a" + " class='b" * 100_000 + ">",
    ],
    ids=lambda p: p[:12],
)
def test_odd_pages_take_time_in_proportion(page):
    def seconds(text):
        start = time.process_time()
        html.main_text(text)
        return time.process_time() - start

    assert seconds(page) < 5 and seconds(page[: len(page) // 8]) < 1.5
