"""Small labelled pages: ``data-main`` marks the elements that hold main text."""

_LONG = (
    "The river had been rising for three days when the council met, and nobody in the hall doubted that the lower "
    "road would be under water before the end of the week."
)
_SHORT = "They agreed at once."
_MID = "Sandbags were carried from the depot to the mill, where forty people worked until it was dark."

PAGES = (
    f"""<html><head><title>Flood</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
    <div class="ad">Buy two boots and get the third one for nothing today.</div><article data-main><h1>Flood near the mill</h1>
    <p>{_LONG}</p><p>{_SHORT}</p><p>{_MID}</p></article><footer>&copy; example.org &middot; All rights reserved.</footer></body></html>""",
    f"""<html><body><header><a href="/">Paper</a><p>News from the valley, every day and for everyone who lives here.</p></header>
    <div class="cookie-notice"><p>We use cookies to make this site work for you and to count how many people visit it.</p><button>Accept</button></div>
    <main><h1 data-main>Bridge closed</h1><p data-main>{_MID}</p><p data-main>{_LONG}</p><aside><h3>Read on</h3><p>{_MID}</p></aside>
    <h2 data-main>What comes next</h2><p data-main>{_SHORT}</p></main>
    <div id="comments"><h2>Comments</h2><p>I saw the water myself and it was higher than in all the years before.</p></div></body></html>""",
    f"""<html><body><div id="header"><h1>Valley Times</h1><ul class="menu"><li><a href="/a">Politics</a><li><a href="/b">Sport</a></ul></div>
    <div id="content"><h2 data-main>Mill saved</h2><p data-main>{_LONG}</p><p data-main>{_SHORT}</p><ul data-main><li>Forty people</li><li>Two nights</li></ul>
    <p data-main>Asked about it, <a href="/m">the miller</a> had nothing to add to what was said before.</p>
    <div class="share"><a href="/f">Share</a> <a href="/t">Send</a></div></div>
    <div class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten ways to dry a cellar</a></li></ul><p>{_MID}</p></div>
    <form action="/s"><p>Leave your address and we write to you once a week about what happened.</p><input name="q"></form></body></html>""",
    f"""<html><body><div><a href="/">Home</a> | <a href="/about">About</a> | <a href="/contact">Contact</a></div>
    <div><h1 data-main>A night on the dam</h1><p data-main>{_MID}</p><p data-main>{_LONG}</p><p data-main>{_SHORT}</p><p data-main>{_LONG}</p></div>
    <div><a href="/x">Imprint</a> <a href="/y">Privacy</a></div></body></html>""",
    f"""<html><body><nav><a href="/">Start</a></nav><article><header><h1 data-main>Letters</h1></header><p data-main>{_SHORT}</p>
    <blockquote data-main>{_MID}</blockquote><table data-main><tr><td>Monday</td><td>4.1 m</td></tr></table>
    <div class="advert"><p>{_LONG}</p></div><p data-main>{_LONG}</p><section class="comments"><p>{_LONG}</p><p>{_SHORT}</p></section>
    <footer><p>Written by A. Miller for the Valley Times, who lives near the dam.</p></footer></article>
    <aside><p>{_LONG}</p></aside><footer><p>{_MID}</p></footer></body></html>""",
    f"""<html><body><article data-main><h1>Ja</h1><p>Nein.</p></article><div class="newsletter"><p>{_MID}</p></div>
    <div role="navigation"><a href="/p">Previous</a> <a href="/q">Next</a></div></body></html>""",
    f"""<html><body><p data-main>{_LONG}</p><p data-main>{_MID}</p></body></html>""",
    f"""<html><body><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul><h1 data-main>Plain</h1><p data-main>{_LONG}</p>
    <p data-main>{_MID} <a href="/w">See the map of the water</a>.</p><div class="related-posts"><p>{_MID}</p><a href="/r">More about mills and dams</a></div></body></html>""",
    f"""<html><body><div class="modal"><p>{_MID}</p></div><div class="post-content"><p data-main>{_SHORT}</p><p data-main>{_LONG}</p>
    <p data-main><a href="/all">The whole report of the council can be read here</a></p></div><div class="notice">{_SHORT}</div></body></html>""",
    f"""<html><body><article><p data-main>{_SHORT}</p><p data-main><a href="/only">A link alone</a></p><form><p>{_MID}</p><label>Name</label></form>
    <nav><a href="/next">Next page</a></nav><p data-main>{_MID}</p></article><div id="sidebar"><p>{_SHORT}</p></div></body></html>""",
    f"""<html><body><div><p>{_LONG}</p><p>{_SHORT}</p></div><article data-main><h1>Dry again</h1><p>{_MID}</p><p>{_LONG}</p></article>
    <div><p>{_MID}</p></div><p>{_SHORT}</p></body></html>""",
    f"""<html><body><p>{_MID}</p><div class="entry"><p data-main>{_LONG}</p><p data-main>{_SHORT}</p></div><div>{_LONG}</div></body></html>""",
    f"""<html><body><div class="layout has-sidebar"><article data-main><h1>High water</h1><p>{_LONG}</p><p>{_MID}</p></article>
    <div class="sidebar"><h3>Popular</h3><p>{_MID}</p></div></div></body></html>""",
    f"""<html><body><div id="community-page"><h1 data-main>Thanks</h1><p data-main>{_LONG}</p><p data-main>{_MID}</p><p data-main>{_SHORT}</p>
    <div class="comments"><p>{_MID}</p></div></div></body></html>""",
    f"""<html><body><div class="right-rail"><main data-main><p>{_MID}</p><p>{_SHORT}</p></main></div><div class="promo"><p>{_LONG}</p></div></body></html>""",
)
