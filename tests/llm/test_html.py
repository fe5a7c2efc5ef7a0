"""Pages of different shapes with the text that a reader would call the article."""

import pytest

from tabloom.llm import html_text

P1 = "The council voted on Tuesday to keep the old bridge open, after months of debate, letters and marches."
P2 = "Engineers had warned that its arches, built in 1871, would need repairs within the decade."
P3 = "Work starts in spring, the mayor said, and costs less than a new bridge would."
BODY = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
TEXT = f"{P1} {P2} {P3}"
LINKS = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul>"


def article(inner):
    return f"<html><body><nav>{LINKS}</nav><article>{inner}</article><footer>Imprint</footer></body></html>"


PAGES = {
    "plain": (article(BODY), TEXT),
    "heading": (article(f"<h1>Bridge stays</h1>{BODY}"), f"Bridge stays {TEXT}"),
    "share price": (article(f'<p>{P1}</p><div class="share-price">Price of shares rose by four percent on the day, traders said.</div><p>{P2}</p>'), f"{P1} Price of shares rose by four percent on the day, traders said. {P2}"),
    "related work": (article(f'{BODY}<section id="related-work"><p>Related work in science goes back to Euler, who wrote on bridges.</p></section>'), f"{TEXT} Related work in science goes back to Euler, who wrote on bridges."),
    "side effects": (article(f'{BODY}<div class="side-effects">Side effects of the closure were longer ways to school.</div>'), f"{TEXT} Side effects of the closure were longer ways to school."),
    "alert level": (article(f'<div class="alert-level">The alert level stays at two, as the river is low.</div>{BODY}'), f"The alert level stays at two, as the river is low. {TEXT}"),
    "social history": (article(f'{BODY}<div id="social-history"><p>Its social history is that of the mill, the market and the ferry.</p></div>'), f"{TEXT} Its social history is that of the mill, the market and the ferry."),
    "search results": (article(f'{BODY}<div class="search-results"><p>The search found two stones, a coin and a rusty nail.</p></div>'), f"{TEXT} The search found two stones, a coin and a rusty nail."),
    "bottom line": (article(f'{BODY}<div class="bottom-line">All in all the bridge is worth what it costs.</div>'), f"{TEXT} All in all the bridge is worth what it costs."),
    "caption": (article(f'<div class="header-image-caption">The bridge seen from the mill at dusk</div>{BODY}'), f"The bridge seen from the mill at dusk {TEXT}"),
    "list of links": (article(f"<p>{P1}</p><ul><li><a href=/1>link one</a></li><li><a href=/2>link two</a></li></ul><p>{P2}</p>"), f"{P1} link one link two {P2}"),
    "definitions": (article(f"<p>{P1}</p><dl><dt>Arch</dt><dd><a href=/a>A curved part</a></dd><dt>Pier</dt><dd><a href=/p>What it stands on</a></dd></dl>"), f"{P1} Arch A curved part Pier What it stands on"),
    "links between paragraphs": (f"<html><body><div id=content><p>{P1}</p><ul><li><a href=/1>Plan of the bridge</a></li></ul><p>{P2}</p></div></body></html>", f"{P1} Plan of the bridge {P2}"),
    "menu without nav": (f"<html><body><div id=content>{LINKS}<p>{P1}</p><p>{P2}</p>{LINKS}</div></body></html>", f"{P1} {P2}"),
    "share buttons": (article(f'{BODY}<div class="share-buttons"><a href=#>Tweet</a> <a href=#>Post</a></div>'), TEXT),
    "related posts": (article(f'{BODY}<div class="related-posts"><p>You may like this longer story of a dam, too, friends.</p></div>'), TEXT),
    "comments": (article(f'{BODY}<div id="comments"><div class="comment"><p>I crossed it every day as a child, it was fine.</p></div></div>'), TEXT),
    "comment list": (f"<html><body><main>{BODY}</main><ol class=commentlist><li>First of all, thanks for this text, well done.</li></ol></body></html>", TEXT),
    "cookie notice": (f'<html><body><div class="cookie-notice">We use cookies, as all do, to make this site work for you.</div><div id="story">{BODY}</div></body></html>', TEXT),
    "sidebar": (f'<html><body><div class="sidebar"><p>Weather today: rain, wind, more rain, and some sun.</p></div><div class="post">{BODY}</div></body></html>', TEXT),
    "advert": (article(f'<p>{P1}</p><div class="ad">Buy one bridge, get one free, only today, only here.</div><p>{P2}</p>'), f"{P1} {P2}"),
    "ad slot": (article(f'<p>{P1}</p><div id="ad-slot-3">Big sale, everything must go, come to our shop now.</div><p>{P2}</p>'), f"{P1} {P2}"),
    "newsletter form": (article(f"{BODY}<form><p>Sign up for our letter, it is free, and you can leave.</p><input></form>"), TEXT),
    "aside": (article(f"{BODY}<aside><p>More on this: the tunnel, the ferry, the road.</p></aside>"), TEXT),
    "hidden": (article(f'{BODY}<div hidden>Not for the eyes of readers, this sentence here.</div><div style="display: none">Nor is this one, of course, my friend.</div>'), TEXT),
    "script and style": (article(f"<style>p{{a:b}}</style>{BODY}<script>if (a<b) document.write('<p>no</p>')</script>"), TEXT),
    "roles": (f'<html><body><div role="navigation">{LINKS}</div><div role="main">{BODY}</div><div role="contentinfo">Imprint, terms and such things, here.</div></body></html>', TEXT),
    "header in article": (article(f'<header><h1>Bridge stays</h1></header><div class="header"><h2>By our own reporter in the town</h2></div>{BODY}'), f"Bridge stays By our own reporter in the town {TEXT}"),
    "table": (article(f"<p>{P1}</p><table><tr><th>Year<td>Cars<tr><th>1990<td>1,200</table><p>{P2}</p>"), f"{P1} Year Cars 1990 1,200 {P2}"),
    "quote and code": (article(f"<p>{P1}</p><blockquote>It stays.</blockquote><pre>a = 1\nb  = 2</pre>"), f"{P1} It stays. a = 1 b = 2"),
    "unclosed": (f"<html><body><nav>{LINKS}</nav><article><p>{P1}<p>{P2}<ul><li>one<li>two", f"{P1} {P2} one two"),
    "references": (article("<p>Fish &amp; chips&nbsp;cost 3&#8364;, caf&eacute; &lt;b&gt; &#x41;.</p>" + BODY), f"Fish & chips cost 3€, café <b> A. {TEXT}"),
    "inline": (article(f"<p>An <b>al</b>phabet<br>of <i>s</i>igns, <a href=/x>linked</a> too.</p>{BODY}"), f"An alphabet of signs, linked too. {TEXT}"),
    "tags": (article(f'{BODY}<ul class="tags"><li><a href=/b>bridges</a></li></ul>'), TEXT),
    "nothing": (f"<html><body><nav>{LINKS}</nav><footer>Imprint</footer></body></html>", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_page(name):
    html, text = PAGES[name]
    assert html_text.main_text(html) == text


def test_cases(spark):
    long = "".join(f"<p>{P1} Number {k}.</p>" for k in range(20_000))
    rows = [(1, "u", PAGES["plain"][0], "x"), (1, "u", PAGES["plain"][0], "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", article(long), "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["n_chars"], r["text"][:20]) for r in html_text.extract(pages).collect())
    n = sum(len(f"{P1} Number {k}.") + 1 for k in range(20_000)) - 1
    assert got == [(0, 0, ""), (1, len(TEXT), TEXT[:20]), (1, len(TEXT), TEXT[:20]), (2, 0, ""), (3, n, P1[:20])]
    assert html_text.extract(pages.limit(0)).count() == 0
