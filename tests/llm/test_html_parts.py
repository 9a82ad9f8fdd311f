"""Parts of an article that adverts cut off, paragraphs of links, and skipped elements without an end tag."""

import numpy as np
import pytest

from locusframe.llm.html_extract import extract_main

LONG = " ".join(["This is a long enough sentence of the text."] * 12)
PART = "This part of the article stands between two adverts and is short but longer than eighty characters."


def test_parts_cut_off_by_adverts():
    page = f"<body><div><p>{LONG}</p><div class=ad>Buy</div><p>Short part.</p><aside>Note</aside><p>{PART}</p></div></body>"
    assert extract_main(page) == f"{LONG} Short part. {PART}"


def test_paragraphs_with_many_links():
    linked = "See <a href=x>a long account of the whole story that was told before</a> here."
    plain = "See a long account of the whole story that was told before here."
    assert extract_main(f"<div><p>{LONG}</p><p>{linked}</p><p>{LONG}</p></div>") == f"{LONG} {plain} {LONG}"
    assert extract_main(f"<div id=content><p>One.</p><p>{linked}</p></div><div>Outside</div>") == f"One. {plain}"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article><p class=notice>Old<p>One<p>Two</article>", "One Two"),
        ("<article><p class=notice>Old <b>x</b><h2>Head</h2>One</article>", "Head One"),
        ("<article><ul><li>A<li class=share>Share<ul><li>x<li>y</ul> z<li>B</ul><p>C</article>", "A B C"),
        ("<article><ul><li>A<li class=share>Share</ul><p>C</article>", "A C"),
        ("<article><dl><dt>T<dd class=ad>x<dt>U<dd>V</dl></article>", "T U V"),
        ("<article><table><tr><td>A<td class=ads>x<table><tr><td>y</table><td>B<tr class=promo><td>x<td>y<tr><td>C</table>D</article>", "A B C D"),
        ("<article><div><p class=notice>Old</div>One</article>", "One"),
        ("<article><p class=notice>Old</p>One</article>", "One"),
    ],
)
def test_omitted_end_tags(page, want):
    assert extract_main(page) == want


def test_names_inside_an_article():
    inner = "".join(f"<div class={c}><p>{c} words</p></div>" for c in ("legal", "tags", "reviews", "side"))
    assert extract_main(f"<article><p>{LONG}</p>{inner}<div class=comments>no</div><p>End.</p></article>") == f"{LONG} legal words tags words reviews words side words End."
    assert extract_main(f"<div><p>{LONG}</p></div><div class=legal><p>{LONG}</p></div>") == LONG


def test_windows_decide_on_every_page():
    """Against a plain version over lines given as lengths: pages without a marked article, and with one."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        sizes = [int(n) for n in rng.choice([0, 0, 5, 30, 120], 25)]  # 0: an advert
        body = "".join(f"<p>{'x' * n}</p>" if n else "<div class=ad>buy</div>" for n in sizes)
        flat = [w for n in sizes for w in ([n] if n else [0, 0, 0])]
        sums = [sum(flat[i : i + 3]) for i in range(len(flat))]
        runs, run = [], []
        for i, s in enumerate([*sums, 0]):
            if s:
                run.append(i)
            elif run:
                runs.append(run)
                run = []
        kept = runs  # the whole span, once some sum surges
        if runs and max(sums) <= 80:
            kept = [max(runs, key=lambda r: sum(flat[i] for i in r))]
        want = " ".join("x" * flat[i] for i in range(kept[0][0], kept[-1][-1] + 1) if flat[i]) if kept else ""
        assert extract_main(f"<body>{body}</body>") == want
        whole = " ".join("x" * n for n in sizes if n)
        assert extract_main(f"<p>{LONG}</p><article>{body}</article><p>{LONG}</p>") == (whole if whole else f"{LONG} {LONG}")


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<p>{LONG}</p><p><a href="/the-hidden-truth">Read on</a> here</p>', f"{LONG} Read on here"),
        (f'<article><p>{LONG} <a href="/x.php?id=nav">linked</a></p></article>', f"{LONG} linked"),
        (f'<article><p title="Hidden costs">{LONG}</p><p data-hidden="false">One</p><p class="share-price">Two</p><p data-class="ad">Three</p></article>', f"{LONG} One Two Three"),
        (f'<p>{LONG}</p><div class="ad"></div><p>Short end.</p>', f"{LONG} Short end."),
        (f'<p>Lead.</p><div class="ad">Buy</div><p>{LONG}</p>', f"Lead. {LONG}"),
        (f'<div class="content"><p>{LONG}</p><p><a href="x">One link</a></p><ul><li><a href="y">Menu</a></li></ul></div>', f"{LONG} One link"),
        (f'<main><article><p>{LONG}</p></article><div class="related"><p>{LONG}</p></div></main>', LONG),
        (f'<article><p>{LONG}</p><div class="social">x</div><ul class="related-links"><li><a href="y">z</a></li></ul><div class="shareButtons">s</div></article>', LONG),
        (f'<div id="side-effects"><p>{LONG}</p></div><div class="site-footer">x</div><div hidden>y</div><div HIDDEN>z</div><div style="color:red; DISPLAY: none">w</div>', LONG),
        (f'<p><a href="a">Home</a> | <a href="b">News</a></p><p>{LONG}</p>', LONG),
        (f"<p class='a' id=b title=\"a>b class='ad'\">{LONG}</p>", LONG),
    ],
)
def test_attributes_are_read_whole_and_articles_in_full(page, want):
    assert extract_main(page) == want


def test_plain_pages_without_an_article_element():
    """All blocks of pages whose furniture is marked by elements or names, against the blocks themselves."""
    rng = np.random.default_rng(4)
    out = ["<nav><a href=x>a</a></nav>", '<div class="ad-box">b</div>', "<aside>c d e</aside>", '<ul class="main-menu"><li><a href=y>f</a></ul>', "<footer>g</footer>", "<form>h</form>", "<script>i<p>j</script>", '<p class="notice">k</p>']
    for n in range(200):
        parts, want = [], []
        for i in range(rng.integers(1, 25)):
            if rng.random() < 0.4:
                parts.append(out[rng.integers(len(out))])
            else:
                text = " ".join(f"w{rng.integers(99)}" for _ in range(rng.integers(1, 40)))
                tag = ("p", "h2", "blockquote")[rng.integers(3)]
                parts.append(f"<{tag} title='nav hidden'>{text} <a href='/ad?class=nav'>at</a></{tag}>")
                want.append(f"{text} at")
        got = extract_main("<body>" + "".join(parts) + "</body>")
        assert got == " ".join(want) or len(" ".join(want)) < 300
