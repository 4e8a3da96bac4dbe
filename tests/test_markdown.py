import pytest

from pagewright.functions.sql import choose, fn as F
from pagewright.functions.text import bind
from pagewright.operators.markdown import BUFFER, DIALECTS, _fold, markdown

X = F.col("x")

FAST = {
    "<h4>Tides</h4><h1>Moon</h1><h6>Notes</h6>": "#### Tides\n\n# Moon\n\n###### Notes",
    "<p>The tide rose,</p> <p>then fell.</p>": "The tide rose,\n\nthen fell.",
    '<p>See the <a href="/charts?y=3">chart of "3"</a>, please</p>': 'See the [chart of "3"](/charts?y=3), please',
    '<div><img alt="buoy 7" src="/i/7.webp"><img></div>': "![buoy 7](/i/7.webp)![]()",
    "<p><b>ebb</b> or <i>flow</i> <strong>s</strong><em>e</em></p>": "**ebb** or *flow* **s***e*",
    "<p>Type <code>ls  -l</code></p>": "Type `ls -l`",
    "<pre><code>if a:\n\n\n\n  b &lt; c</code></pre>end": "```\nif a:\n\n  b < c\n```\nend",
    "<pre>\nfirst\n</pre>": "```\nfirst\n```",
    "<ul><li>A</li><li>B</li></ul>": "- A\n- B",
    "<ol start=5><li>A</li><li>B</li></ol>": "1. A\n2. B",
    "<ul><li>A<ol><li>x</li><li>y</li></ol></li><li>B</li></ul>": "- A\n\n  1. x\n  2. y\n- B",
    "<ul><li>A<li>B</ul>": "- A\n- B",
    "<blockquote><p>Quoted</p><p>two</p></blockquote><p>z</p>": "> Quoted\n> \n> two\n\nz",
    "<blockquote>a<blockquote>b<br>c</blockquote>d</blockquote>": "> a\n> \n> > b\n> > c\n> d",
    "a<hr>b<br>c": "a\n\n---\nb\nc",
    "<nav>n</nav><p>x</p><script>s</script><style>t</style><aside>a</aside><footer>f</footer><noscript>o</noscript><svg><title>q</title></svg>": "x",
    "<p>  lots \n\t of   space  </p>": "lots of space",
    "<title>T</title>text": "text",
    "<p>a<div>b</div>c": "a\n\nbc",
    "<a>no target</a>": "[no target](#)",
    "<a href=/1>one<a href=/2>two</a>": "[one](/1)[two](/2)",
    "<p><b>one<p>two</p>three</b>four": "**one**\n\n**two**\n\n**three**four",
    "x</p>y": "x\n\ny",
    "<p>x &amp; &copy; &#8364;</p>": "x & © €",
    "": "",
    "plain": "plain",
}


def test_fast(evaluate):
    assert dict(zip(FAST, evaluate(list(FAST), markdown(X)))) == FAST


def test_ai(evaluate):
    cases = {
        "<h3>Harbour</h3><p>in</p><p>out</p>": "### Harbour\n\nin\n\nout",
        "<style>q</style><p>stays</p><noscript>r</noscript><nav>also</nav><script>s</script>": "stays\n\nalso",
        '<p>left<img alt="m" src="m.gif">right</p>': "leftright",
        "<p>north</p>\n\n\n<p>south</p>": "north\n\nsouth",
        "": "",
        "<ul><li>oar<li>sail</ul>": "* oar\n* sail",
    }
    assert dict(zip(cases, evaluate(list(cases), markdown(X, "ai")))) == cases


def test_browser(evaluate):
    cases = {
        "<h2>Pier</h2><h5>East</h5>": "## Pier\n\n##### East",
        "<p>Two  gulls</p>": "Two gulls",
        "<a href=/map.html>map</a>": "[map](/map.html)",
        "<b>ebb</b>, <i>flow</i>": "**ebb**, _flow_",
        "<pre><code>cat a\n b</code></pre>": "```\ncat a\n b\n```",
        "<ol><li>rope</li><li>knot</li></ol>": "1.  rope\n2.  knot",
        "<footer>f</footer><p>x_y*z[1]</p>": "x\\_y\\*z\\[1\\]",
    }
    assert dict(zip(cases, evaluate(list(cases), markdown(X, "browser")))) == cases


@pytest.mark.parametrize("dialect", ["fast", "ai", "browser"])
def test_long_page(evaluate, dialect):
    n = 4000
    (text,) = evaluate(["<p>" + "</p><p>".join(f"w{i}" for i in range(n)) + "</p>"], markdown(X, dialect))
    assert text == "\n\n".join(f"w{i}" for i in range(n))


@pytest.mark.parametrize("dialect", ["fast", "ai", "browser"])
def test_a_step_copies_no_state_and_walks_no_branch_list(dialect):
    fold = _fold(F.col("tokens"), DIALECTS[dialect]).text
    assert "CASE" not in fold and "element_at(transform(" not in fold
    assert fold.count("AS struct<") == 1  # the empty state gets its type, not every step


@pytest.mark.parametrize("dialect", ["fast", "ai", "browser"])
@pytest.mark.parametrize("size", [1, BUFFER - 1, BUFFER, 3 * BUFFER])
def test_full_buffers(evaluate, dialect, size):
    words = ["ü" * (size // 2), "w" * size, "", "end"]
    (text,) = evaluate(["".join(f"<p>{w}</p>" for w in words)], markdown(X, dialect))
    assert text == "\n\n".join(w for w in words if w)


def test_bind_and_choose(evaluate):
    assert evaluate([None, "a"], bind(X, lambda v: bind(F.concat(v, "b"), lambda w: F.coalesce(F.concat(w, v), "none")))) == ["none", "aba"]
    assert evaluate([None, "a", "b", "c"], choose(X == "a", "1").when(X == "b", "2")) == [None, "1", "2", None]
    assert evaluate([None, "a", "b", "c"], choose(X == "a", "1").when(X != "b", "2").otherwise("3")) == ["3", "1", "3", "2"]
