# fmt: off
"""Hand-written pages of layouts that the training generator does not make, with the text that is wanted."""
A = "The committee met on Tuesday to discuss the new reservoir, which has been planned for several years by the county."
B = "Engineers presented two designs, and the residents who attended asked many questions about cost, noise and the road."
C = "A final decision is expected in the spring, after the environmental report has been read by all of the members."
PAGES = {
    "table layout": (f"<html><body><table><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a> | <a href=/c>Contact</a></td></tr><tr><td width=20%><ul><li><a href=/1>One</a><li><a href=/2>Two</a><li><a href=/3>Three</a></ul></td><td><h2>Reservoir plans</h2><p>{A}</p><p>{B}</p><p>{C}</p></td></tr><tr><td colspan=2>&copy; 2020 County Press. All rights reserved.</td></tr></table></body></html>", ["Reservoir plans", A, B, C]),
    "roles": (f'<html><body><div role="banner"><a href="/">Site</a></div><div role="navigation"><a href="/a">A</a> <a href="/b">B</a> <a href="/c">C</a></div><div role="main"><h1>Reservoir plans</h1><p>{A}</p><p>{B}</p></div><div role="complementary"><h3>Related</h3><a href="/r">Other story</a></div><div role="contentinfo">Copyright 2020</div></body></html>', ["Reservoir plans", A, B]),
    "no semantics": (f'<html><body><div id="top"><span><a href="/">Home</a></span><span><a href="/x">About</a></span></div><div id="c1"><div><h1>Reservoir plans</h1></div><div>{A}</div><div>{B}</div><div>{C}</div></div><div id="bottom"><a href="/p">Privacy</a> <a href="/t">Terms</a></div></body></html>', ["Reservoir plans", A, B, C]),
    "documentation": (f'<html><body><nav class="toc"><ol><li><a href="#a">Start</a></li><li><a href="#b">Use</a></li></ol></nav><main><section id="a"><h2>Start</h2><p>{A}</p><pre>run --fast</pre></section><section id="b"><h2>Use</h2><ul><li>{B}</li><li>{C}</li></ul></section></main><footer><p>Built with a tool</p></footer></body></html>', ["Start", A, "run --fast", "Use", B, C]),
    "blog with comments": (f'<html><head><title>t</title></head><body><header><h1><a href="/">My blog</a></h1></header><div class="post"><h2 class="post-title">Reservoir plans</h2><div class="post-body"><p>{A}</p><blockquote>{B}</blockquote><p>{C}</p></div></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>I liked this a lot, thank you for writing it.</p></div><div class="comment"><p>First!</p></div></div><div class="widget"><form><input name=q><button>Search</button></form></div></body></html>', ["Reservoir plans", A, B, C]),
    "wrapped article": (f'<html><body><div class="wrapper"><div class="row"><div class="col-8"><article class="story"><header><h1>Reservoir plans</h1></header><p>{A}</p><aside class="promo"><p>Subscribe to our newsletter today!</p></aside><p>{B}</p><figure><img src=x><figcaption>The valley</figcaption></figure><p>{C}</p></article></div><div class="col-4"><div class="ads">Buy one, get one free</div></div></div></div><div class="cookie-banner">We use cookies. <button>OK</button></div><script>x()</script></body></html>', ["Reservoir plans", A, B, "The valley", C]),
    "news portal": (f'<html><body><div class="masthead"><img alt=logo><p>Daily Post</p></div><ul class="menu"><li><a href=/1>World</a><li><a href=/2>Sport</a><li><a href=/3>Money</a></ul><div id="article-body"><h1>Reservoir plans</h1><p><i>By a reporter in the county</i></p><p>{A}</p><h2>Two designs</h2><p>{B}</p><ul><li>Cost</li><li>Noise</li></ul><p>{C}</p></div><div class="related"><h3>More</h3><ul><li><a href=/4>Floods</a></li><li><a href=/5>Roads</a></li></ul></div><div class="newsletter"><p>Sign up for our morning letter.</p></div><div class="footer"><p>Daily Post 2021</p></div></body></html>', ["Reservoir plans", "By a reporter in the county", A, "Two designs", B, "Cost", "Noise", C]),
}
