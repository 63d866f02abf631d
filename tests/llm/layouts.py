"""Hand-written pages in the manner of common publishing systems, with their article blocks: none comes from the training generator,
and most class names are foreign to it."""

A = [
    "The river rose two metres overnight and the lower bridge was closed before dawn.",
    "Volunteers carried sandbags to the mill, where the old wall had already begun to leak.",
    "By noon the water had stopped climbing, and the first families were allowed to return home.",
    "Engineers will inspect the embankment this week; a report is expected in the spring.",
    "“We were lucky,” said the mayor, who had spent the night at the pumping station.",
]
B = [
    "A sourdough starter needs only flour, water and patience.",
    "Mix equal weights of both, cover the jar loosely and leave it somewhere warm for a day.",
    "On the second day discard half of the mixture and feed it again with fresh flour and water.",
    "After about a week the starter doubles within a few hours and smells pleasantly sour.",
]
C = ["Install the package", "Download the archive for your system and unpack it into an empty folder.", "Run the setup program once; it writes a configuration file with sensible defaults.", "Start the service and check that the status page opens in a browser."]


def layouts():
    """(name, html, article blocks in order)"""
    p = lambda xs: "".join(f"<p>{x}</p>\n" for x in xs)
    yield "blog", f"""<html><head><title>Flood</title><style>.k{{}}</style></head><body class="home-9 logged-out"><div class="hfeed"><header class="wp-block-template-part"><a href="/">Valley Notes</a><p>Stories from the valley</p></header>
<nav class="wp-block-nav"><ul><li><a href="/a">Home</a></li><li><a href="/b">Archive</a></li><li><a href="/c">About</a></li></ul></nav>
<main class="wp-site-blocks"><article class="hentry"><h1>Flood reaches the mill</h1>{p(A)}</article></main>
<div class="wp-block-comments-query"><h3>2 comments</h3><ol class="commentlist"><li><b>Ana</b><p>Stay safe everyone up there.</p></li><li><b>Tom</b><p>We saw it from the hill, dreadful.</p></li></ol></div>
<footer class="wp-block-template-part"><p>&copy; 2024 Valley Notes | <a href="/p">Privacy</a></p></footer></div></body></html>""", ["Flood reaches the mill", *A]
    yield "wiki", f"""<!DOCTYPE html><html><body><div id="mw-page-base"></div><div id="mw-head"><ul class="vector-menu-tabs"><li><a href="#">Read</a></li><li><a href="#">Edit</a></li><li><a href="#">History</a></li></ul></div>
<div id="content" class="mw-body" role="main"><h1 id="firstHeading">Sourdough starter</h1><div id="bodyContent"><div class="mw-parser-output">{p(B)}</div></div></div>
<div id="mw-panel"><ul><li><a href="/m">Main page</a></li><li><a href="/r">Random page</a></li><li><a href="/d">Donate</a></li></ul></div>
<footer id="ftr-bar"><ul><li>This page was last edited on 3 May 2021.</li><li><a href="/t">Terms</a></li></ul></footer></body></html>""", ["Sourdough starter", *B]
    yield "news", f"""<html><body><div class="zq-consent" role="dialog"><p>We and our partners use cookies. <button>Accept</button></p></div><header class="masthead-x1"><div class="brandmark">The Courier</div><nav aria-label="sections"><a href="/1">World</a> <a href="/2">Sport</a> <a href="/3">Money</a></nav></header>
<article class="c-story"><h1 class="c-story__headline">Town escapes the worst</h1><p class="c-story__lede">{A[0]}</p>{p(A[1:3])}<div class="advert-slot"><p>Buy two tyres and get the third one free today.</p></div>{p(A[3:])}</article>
<aside class="c-rail"><h2>More stories</h2><ul><li><a href="/x">Council raises parking fees</a></li><li><a href="/y">School wins chess title</a></li></ul></aside>
<form action="/nl" class="c-nl"><label>Get our daily letter</label><input type=email><button>Sign up</button></form>
<footer><p>&copy; Courier Media 2023. All rights reserved.</p></footer></body></html>""", ["Town escapes the worst", *A]
    yield "docs", f"""<html><body><div class="rst-wrapper"><nav class="wy-side"><ul><li><a href="i">Introduction</a></li><li><a href="s">Setup</a></li><li><a href="f">FAQ</a></li></ul></nav><section class="wy-wrap"><div role="main" class="rst-doc"><h1>{C[0]}</h1>{p(C[1:])}</div></section>
<footer><div role="contentinfo"><p>Built with a generator. &copy; Copyright 2020.</p></div></footer></div></body></html>""", C
    yield "plain", f"""<html><body><table><tr><td><a href=/>Home</a> | <a href=/l>Links</a> | <a href=/m>Mail</a></td></tr></table><h1>Bread at home</h1>{p(B)}<hr><form action=/s><input name=q><button>Search</button></form></body></html>""", ["Bread at home", *B]
    yield "magazine", f"""<html><body><div class="l-top"><ul class="l-links"><li><a href="#">Food</a></li><li><a href="#">Travel</a></li><li><a href="#">Style</a></li></ul></div><main><section class="gh-canvas"><h1>Bread for beginners</h1>{p(B[:2])}<blockquote>{B[2]}</blockquote>{p(B[3:])}</section></main>
<section class="kg-signup"><form><p>Subscribe for more recipes</p><input type=email></form></section><div class="disqus-thread"><h3>Responses</h3><div class="dsq-post"><p>Mine never rises, what now?</p></div></div><footer class="gh-foot"><nav><a href="/a">About</a> <a href="/c">Contact</a></nav></footer></body></html>""", ["Bread for beginners", *B]
