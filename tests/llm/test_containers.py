"""Pages with neither article nor main keep what stands beside their long texts."""

from postmill.llm import html_text

LONG = ("word " * 60).strip()
MENU = "<div><a href='/'>Home</a><a href='/n'>News</a></div>"


def test_short_regions_stay():
    parts = f"<div><h1>Title</h1></div><div><p>{LONG}</p></div><div><ul><li>one</li><li>two</li><li>three</li><li>four</li></ul></div><table><tr><td>{LONG}</td><td>12</td><td>13</td><td>14</td><td>{LONG}</td></tr></table>"
    expected = "\n".join(["Title", LONG, "one", "two", "three", "four", LONG, "12", "13", "14", LONG])
    for page in (f"<body>{MENU}<div>{parts}</div>{MENU}</body>", f"<body>{MENU}{parts}{MENU}</body>"):
        assert html_text.main_text(page) == expected


def test_title_beside_one_text():
    menu = "<div><ul>" + "".join(f"<li><a href='/{i}'>m{i}</a></li>" for i in range(8)) + "</ul></div>"
    page = f"<body>{menu}<div><h1>T</h1><h2>U</h2><h3>V</h3><h4>W</h4></div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert html_text.main_text(page) == "\n".join(["T", "U", "V", "W", LONG, LONG, LONG])


def test_deep_pages_end():
    assert html_text.main_text("<div>" * 3000 + LONG) == LONG
