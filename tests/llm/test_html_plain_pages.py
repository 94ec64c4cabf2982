"""Pages without article or main: no selected text is lost."""

import pytest

from reprise.llm import html

LONG = "A long sentence, with commas, and with stops. It goes on, and on, as texts do. Then it ends, at last."
SHORT = "Another sentence, of some length, in the second part. It ends here, too."


def p(text, n=1):
    return f"<p>{text}</p>" * n


PAGES = {
    "two parts": (f"<body><div id=content><div class=part>{p(LONG, 8)}</div><div class=part>{p(SHORT, 2)}</div></div></body>",
                  [LONG] * 8 + [SHORT] * 2),
    "before a list": (f"<body><div id=content>{p(SHORT, 2)}<ul>{f'<li>{LONG}</li>' * 8}</ul></div></body>", [SHORT] * 2 + [LONG] * 8),
    "before a table": (f"<body><div id=content>{p(SHORT, 2)}<table>{f'<tr><td>{LONG}</td></tr>' * 8}</table></div></body>",
                       [SHORT] * 2 + [LONG] * 8),
    "heading beside": (f"<body><h1>Title</h1><div id=content>{p(LONG, 5)}</div></body>", ["Title"] + [LONG] * 5),
    "linked list inside": (f"<body><div id=content>{p(LONG, 3)}<ul><li><a href=x>First linked source</a></li></ul>{p(LONG, 3)}</div></body>",
                           [LONG] * 3 + ["First linked source"] + [LONG] * 3),
    "linked list at the end": (f"<body><div id=content>{p(LONG, 3)}<ul><li><a href=x>A linked source</a></li></ul></div></body>",
                               [LONG] * 3 + ["A linked source"]),
    "hinted body": (f"<body class='has-sidebar'><div>{p(LONG, 3)}</div></body>", [LONG] * 3),
    "hinted wrapper": (f"<body><div class='content with-widgets'>{p(LONG, 3)}</div><div class=sidebar>{p(SHORT)}</div></body>", [LONG] * 3),
    "two articles": (f"<body><article>{p(LONG, 8)}</article><article>{p(SHORT, 2)}</article></body>", [LONG] * 8 + [SHORT] * 2),
    "form around an article": (f"<body><form action=x><article><h1>T</h1>{p(LONG, 2)}</article></form></body>", ["T"] + [LONG] * 2),
    "form around a main part": (f"<body><form><input name=q><main><h1>T</h1>{p(LONG, 2)}</main><button>Go now</button></form></body>", ["T"] + [LONG] * 2),
    "form around all text": (f"<body><form><div>{p(LONG, 4)}</div></form></body>", [LONG] * 4),
    "aside around all text": (f"<body><aside><div>{p(LONG, 4)}</div></aside></body>", [LONG] * 4),
    "dialog around an article": (f"<body><dialog open><article>{p(LONG, 2)}</article></dialog></body>", [LONG] * 2),
    "graphic in a line": (f"<body><article><p>{LONG} x<svg><title>t</title><text>no</text></svg>y</p></article></body>", [LONG + " xy"]),
    "formula in a line": ("<body><article><p>Let <math><mi>x</mi></math> be here, and there, as ever. It is, it is.</p></article></body>",
                          ["Let be here, and there, as ever. It is, it is."]),
    "button in a line": (f"<body><article><p>{LONG}<button>Copy this</button> End.</p></article></body>", [LONG + " End."]),
    "unclosed graphic": (f"<body><article><p>{SHORT}<svg><g></p>{p(LONG, 2)}</article></body>", [SHORT] + [LONG] * 2),
    "related work": (f"<body><article>{p(LONG, 2)}<section class=related-work><h2>Related work</h2>{p(SHORT)}</section></article></body>",
                     [LONG] * 2 + ["Related work", SHORT]),
    "a chess promotion": (f"<body><article>{p(LONG, 2)}<p class=promotion-chess>{SHORT}</p></article></body>", [LONG] * 2 + [SHORT]),
    "comment theory": (f"<body><article class=post>{p(LONG, 2)}<section id=comment-theory>{p(SHORT)}</section></article></body>", [LONG] * 2 + [SHORT]),
    "list of links in a text": (f"<body><article>{p(LONG, 2)}<ul><li><a href=x>Linked source one</a><li><a href=y>Linked source two</a></ul>{p(SHORT)}</article></body>",
                                [LONG] * 2 + ["Linked source one", "Linked source two", SHORT]),
    "sections in an article": (f"<body><main><div><section><h2>A</h2>{p(LONG)}</section><section><h2>B</h2>{p(SHORT)}</section></div></main></body>",
                               ["A", LONG, "B", SHORT]),
    "table in an article": (f"<body><article>{p(LONG)}<table><tr><th>K<th>V<tr><td>a<td>b</table></article></body>", [LONG, "K", "V", "a", "b"]),
    # What is no content stays out.
    "form in an article": (f"<body><article>{p(LONG, 2)}<form><label>Your name</label><input></form></article></body>", [LONG] * 2),
    "aside in an article": (f"<body><article>{p(LONG, 2)}<aside><p>{SHORT}</p></aside></article></body>", [LONG] * 2),
    "related posts": (f"<body><article>{p(LONG, 2)}<section class=related-posts><p>{SHORT}</p></section></article></body>", [LONG] * 2),
    "advert in an article": (f"<body><article>{p(LONG, 2)}<div class='ad-slot'><p>{SHORT}</p></div>{p(LONG)}</article></body>", [LONG] * 3),
    "comments as articles": (f"<body><article>{p(LONG, 3)}</article><section class=comments><article class=comment>{p(SHORT, 2)}</article>"
                             f"<article class=comment>{p(SHORT)}</article></section></body>", [LONG] * 3),
    "comments as articles in the article": (f"<body><article>{p(LONG, 3)}<div id=comments><article class=comment>{p(SHORT, 2)}</article></div></article></body>", [LONG] * 3),
    "teasers as articles": (f"<body><main>{p(LONG, 4)}</main><aside><article><a href=x>One more story</a></article><article><a href=y>Another one</a></article></aside></body>",
                            [LONG] * 4),
    "unmarked links in an article": (f"<body><article>{p(LONG, 3)}<div><div><a href=x>One more story</a></div><div><a href=y>Another story</a></div></div></article></body>",
                                     [LONG] * 3),
    "cookie dialog": (f"<body><dialog open><p>{SHORT}</p></dialog><article>{p(LONG, 2)}</article></body>", [LONG] * 2),
    "dialog by role": (f"<body><div role=dialog><h1>Welcome</h1><p>{SHORT}</p></div><article><h1>T</h1>{p(LONG, 2)}</article></body>", ["T"] + [LONG] * 2),
    "search form before": (f"<body><form role=search><label>Search</label></form><div id=content><h1>T</h1>{p(LONG, 2)}</div></body>", ["T"] + [LONG] * 2),
    "linked menu before": (f"<body><ul><li><a href=x>Home page</a></li></ul><div id=content>{p(LONG, 3)}</div></body>", [LONG] * 3),
    "comments": (f"<body><div id=content><h1>Title</h1>{p(LONG, 2)}</div><div class=comments>{p(SHORT, 9)}</div></body>", ["Title"] + [LONG] * 2),
}


@pytest.mark.parametrize("name", PAGES)
def test_whole_text(name):
    page, want = PAGES[name]
    assert html.extract(page) == "\n".join(want)


def test_ratios_decide_inside_articles(monkeypatch):
    """With every block selected the boxes of links stay."""
    page, want = PAGES["unmarked links in an article"]
    import numpy as np
    monkeypatch.setattr(html, "_link_boxes", lambda page, elements, chars, links, chosen, roots: LINK_BOXES(
        page, elements, chars, links, np.ones(len(elements), bool), roots))
    assert html.extract(page) == "\n".join([*want, "One more story", "Another story"])


LINK_BOXES = html._link_boxes
