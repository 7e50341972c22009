"""Pages written by hand in the manner of common publishing systems, with the blocks of their main text."""

BLOG = (
    """<!doctype html>
<html lang="en-US"><head><meta charset="UTF-8"><title>Growing tomatoes on a balcony - Green Corner</title>
<link rel="stylesheet" href="/wp-content/themes/corner/style.css"><script>window.dataLayer=[];</script></head>
<body class="post-template-default single single-post postid-412 wp-embed-responsive">
<div id="page" class="hfeed site"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">Green Corner</a></p><p class="site-description">Gardening for small places</p></div>
<nav id="site-navigation" class="main-navigation"><ul id="primary-menu"><li class="menu-item"><a href="/">Home</a></li><li class="menu-item"><a href="/plants">Plants</a></li><li class="menu-item"><a href="/tools">Tools</a></li></ul></nav></header>
<div id="content" class="site-content"><main id="primary" class="site-main">
<article id="post-412" class="post-412 post type-post status-publish hentry category-vegetables">
<h1 class="entry-title">Growing tomatoes on a balcony</h1>
<div class="entry-content">
<p>Tomatoes need more sun than most people expect, and a balcony that faces south is the best place to start. Six hours a day is the least that they will accept.</p>
<p>Choose a pot of at least twenty litres, with holes in the bottom, and fill it with fresh soil&nbsp;&ndash; not with what was left over from last year.</p>
<h2>Watering</h2>
<p>Water in the morning, and never from above. Leaves that stay wet overnight <em>will</em> catch blight sooner or later.</p>
<ul><li>In spring, every third day is enough.</li><li>In summer, water daily, and twice on hot days.</li></ul>
<p>Stop a week before the last harvest, and the fruit will taste sweeter.</p>
</div></article>
<div class="sharedaddy sd-sharing-enabled"><ul><li><a href="https://example.org/share">Share</a></li><li><a href="https://example.org/tweet">Tweet</a></li></ul></div>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>Great tips, mine were ruined by blight last year.</p></div></li><li class="comment"><div class="comment-body"><p>What about cherry tomatoes, do they need less room?</p></div></li></ol>
<form class="comment-form"><label>Name</label><input name="author"><button>Post Comment</button></form></div>
</main>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/a">Five herbs for shade</a></li><li><a href="/b">When to repot</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">&copy; 2024 Green Corner. Proudly powered by a content system.</div></footer></div></body></html>""",
    [
        "Growing tomatoes on a balcony",
        "Tomatoes need more sun than most people expect, and a balcony that faces south is the best place to start. Six hours a day is the least that they will accept.",
        "Choose a pot of at least twenty litres, with holes in the bottom, and fill it with fresh soil – not with what was left over from last year.",
        "Watering",
        "Water in the morning, and never from above. Leaves that stay wet overnight will catch blight sooner or later.",
        "In spring, every third day is enough.",
        "In summer, water daily, and twice on hot days.",
        "Stop a week before the last harvest, and the fruit will taste sweeter.",
    ],
)

MANUAL = (
    """<html><head><title>connect() - Manual</title><style>pre{background:#eee}</style></head><body>
<div class="navbar"><a href="/">Manual</a> <a href="/index">Index</a> <a href="/search">Search</a></div>
<div class="cookie-notice"><p>We use cookies to keep you signed in. <button>Accept</button></p></div>
<div class="container"><div class="sidebar"><h3>Contents</h3><ul><li><a href="#a">open()</a><li><a href="#b">close()</a><li><a href="#c">connect()</a></ul></div>
<div role="main" class="body"><section id="connect"><h1>connect()</h1>
<p>Opens a connection to a server and returns a handle. The call blocks until the server answers, or until the timeout has passed.</p>
<pre>handle = connect("db.example.org", timeout=5)</pre>
<table><thead><tr><th>Argument</th><th>Meaning</th></tr></thead><tbody><tr><td>host</td><td>The name or the address of the server.</td></tr><tr><td>timeout</td><td>Seconds to wait, 30 if it is not given.</td></tr></tbody></table>
<p>A handle has to be closed when it is no longer needed, since the server keeps at most a hundred of them.</p>
</section></div></div>
<div class="footer">Copyright 2023, the authors. Last updated on 3 May.</div></body></html>""",
    [
        "connect()",
        "Opens a connection to a server and returns a handle. The call blocks until the server answers, or until the timeout has passed.",
        'handle = connect("db.example.org", timeout=5)',
        "Argument",
        "Meaning",
        "host",
        "The name or the address of the server.",
        "timeout",
        "Seconds to wait, 30 if it is not given.",
        "A handle has to be closed when it is no longer needed, since the server keeps at most a hundred of them.",
    ],
)

NEWS = (
    """<!DOCTYPE html><html><head><title>Bridge reopens</title></head><body>
<header class="top-bar"><div class="logo"><a href="/">The Daily Harbour</a></div><nav><a href="/news">News</a><a href="/sport">Sport</a><a href="/weather">Weather</a></nav></header>
<div class="ad-slot" id="ad-top">Advertisement: half price flights, only this week!</div>
<div class="layout"><div class="story-body"><h1>Old bridge reopens after two years</h1>
<p>The bridge over the western arm of the harbour was opened to traffic again on Monday, two years after cracks had been found in its pillars.</p>
<div class="ad-inline"><p>Sponsored: try our new bank account.</p></div>
<p>Around nine thousand cars a day had to take the long way round, according to the city, and shops on both sides lost up to a third of their customers.</p>
<blockquote>We never want to do this again, said the engineer in charge.</blockquote>
<p>The repair cost 14 million, three more than planned.</p></div>
<div class="related-stories"><h3>More stories</h3><ul><li><a href="/1">Ferry timetable changes in June</a></li><li><a href="/2">Council votes on parking fees</a></li></ul></div></div>
<div class="newsletter-signup"><h4>Get the news by mail</h4><form><input type="email"><button>Subscribe</button></form></div>
<footer><p>All rights reserved. The Daily Harbour is a member of the press council.</p><a href="/imprint">Imprint</a></footer></body></html>""",
    [
        "Old bridge reopens after two years",
        "The bridge over the western arm of the harbour was opened to traffic again on Monday, two years after cracks had been found in its pillars.",
        "Around nine thousand cars a day had to take the long way round, according to the city, and shops on both sides lost up to a third of their customers.",
        "We never want to do this again, said the engineer in charge.",
        "The repair cost 14 million, three more than planned.",
    ],
)

PAGES = {"blog": BLOG, "manual": MANUAL, "news": NEWS}
