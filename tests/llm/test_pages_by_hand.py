"""Pages written by hand, of kinds that the labeller's rules hold and of none of their words."""

import pytest

from cohortlens.llm.html_text import labeller, label_pages, leaf_blocks

LAYOUT = """<html><head><title>Club</title></head><body><table width=100%><tr><td colspan=2><font size=5>The Rowing Club</font></td></tr>
<tr><td valign=top><a href=a>Home</a><br><a href=b>News</a><br><a href=c>Boats</a><br></td><td><h2>Spring regatta</h2>
<p>The regatta takes place on the first Saturday in May, weather permitting.<p>Crews of all ages are welcome, and lunch is served at noon in the boathouse.</td></tr>
<tr><td colspan=2>Copyright 2004 The Rowing Club. All rights reserved.</td></tr></table></body></html>"""
CODE = """<html><head><title>x</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul></nav><article><h1>Sorting lists</h1>
<p>Python sorts lists in place, and the sort is stable.</p><pre><code>xs = [3, 1, 2]
xs.sort()
print(xs)</code></pre><p>A key function may be given, which is called once for each element.</p><figure><img src=a.png><figcaption>A sorted list of three numbers</figcaption></figure>
<dl><dt>Stable</dt><dd>Equal elements keep their order.</dd><dt>In place</dt><dd>No second list is made.</dd></dl></article><footer>&copy; 2020 Example. All rights reserved.</footer></body></html>"""
BLOG = """<html><body><div id="page"><header id="masthead" class="site-header"><h1 class="site-title"><a href="/">My blog</a></h1></header>
<nav class="main-navigation"><ul><li><a href="/about">About</a></li></ul></nav><div id="content" class="site-content"><article class="post hentry"><h2 class="entry-title">A walk in the hills</h2>
<div class="entry-content"><p>We set out early, before the sun had risen over the valley.</p><p>By noon we had reached the ridge, and could see as far as the sea.</p></div></article>
<div id="comments" class="comments-area"><h3>2 comments</h3><p>Lovely photos!</p></div></div>
<aside id="secondary" class="widget-area"><h3>Archives</h3><ul><li><a href="/1">May</a></li></ul></aside><footer class="site-footer">Powered by a blog engine. All rights reserved.</footer></div></body></html>"""
MANUAL = """<html><body><div class="navbar"><a href="/">Docs</a> <a href="/api">API</a></div><main><h1>The copy command</h1><p>Copies files from one place to another.</p>
<pre>copy [options] from to</pre><h2>Options</h2><dl><dt>-f</dt><dd>Overwrite without asking.</dd><dt>-r</dt><dd>Copy folders with all that they hold.</dd></dl>
<table><caption>Exit codes</caption><tr><th>Code</th><th>Meaning</th></tr><tr><td>0</td><td>All was copied</td></tr><tr><td>1</td><td>Something was not</td></tr></table>
<p>See the page on moving files, too.</p></main><footer><p>&copy; 2021 The authors</p></footer></body></html>"""
OLD_NEWS = """<html><head><title>n</title></head><body><table><tr><td><img src="logo.gif"></td></tr><tr><td><a href=1>Front page</a> | <a href=2>Sport</a> | <a href=3>Weather</a></td></tr>
<tr><td><p>The bridge across the river will be closed for repairs from Monday on, the council said.</p><p>Drivers are asked to take the ferry, which runs every half hour until ten at night.</p></td></tr>
<tr><td>(c) 1999 The Daily Paper. All rights reserved.</td></tr></table></body></html>"""
ARTICLE = {
    "layout": (LAYOUT, "Spring regatta|The regatta takes place on the first Saturday in May, weather permitting.|Crews of all ages are welcome, and lunch is served at noon in the boathouse."),
    "code": (CODE, "Sorting lists|Python sorts lists in place, and the sort is stable.|xs = [3, 1, 2] xs.sort() print(xs)|A key function may be given, which is called once for each element."
             "|A sorted list of three numbers|Stable|Equal elements keep their order.|In place|No second list is made."),
    "blog": (BLOG, "A walk in the hills|We set out early, before the sun had risen over the valley.|By noon we had reached the ridge, and could see as far as the sea."),
    "manual": (MANUAL, "The copy command|Copies files from one place to another.|copy [options] from to|Options|-f|Overwrite without asking.|-r|Copy folders with all that they hold."
               "|Exit codes|Code|Meaning|0|All was copied|1|Something was not|See the page on moving files, too."),
    "old_news": (OLD_NEWS, "The bridge across the river will be closed for repairs from Monday on, the council said.|Drivers are asked to take the ferry, which runs every half hour until ten at night."),
}


@pytest.mark.parametrize("name", ARTICLE)
def test_article_of_a_page(name):
    page, text = ARTICLE[name]
    blocks = leaf_blocks(page)
    got = [b.text for b, p in zip(blocks, label_pages([blocks], labeller())[0]) if p >= 0.5]
    assert got == text.split("|")
