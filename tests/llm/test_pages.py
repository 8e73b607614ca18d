import pytest

from textloom.llm.page_text import extract, main_text

LONG = "Words of the article that go on for quite a while, "


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain  text\n only", "plain text only"),
        ("<p>a &amp; b&nbsp;&#233;<p>c", "a & b é\nc"),
        ("<div class='sidebar'>no</div><article><h1>T</h1><p>x <b>y</b>z</p></article>", "T\nx yz"),
        ("<nav>no</nav><p>t <a title='x>y' href=q>l</a> q</p><script>if (a<b) '</p>'</script>z", "t l q\nz"),
        ("<div><p>open <b>bold<br><p>more</div><footer>no</footer>", "open bold\nmore"),
        ("<ul><li>one<li>two</ul><section id=comments><p>no</p></section>", "one\ntwo"),
        ("<p>x<!-- never closed <p>no", "x"),
        ("<table><tr><td>a<td>b</table><form><p>no<input></form>", "a\nb"),
        ("<body class='has-sidebar'><main><p>yes</p></main><div id='cookie-notice'>no</div>", "yes"),
        ("a < b and <3", "a < b and <3"),
        ("<nav>only a menu</nav>", ""),
        (f"<article><div class=body>{LONG * 20}</div><p>Short closing paragraph.</p></article><div>aside</div>", f"{LONG.strip()} " * 19 + f"{LONG.strip()}\nShort closing paragraph."),
        (f"<main><h1>The title</h1><p>Lead.</p><div class=text>{LONG * 20}</div></main>", "The title\nLead.\n" + (LONG * 20).strip()),
    ],
)
def test_text_of_a_page(html, text):
    assert main_text(html, None) == text


def test_hosts_agree_on_a_path(spark):
    def page(body, more):
        return f"<html><body><div class='c1 body'>{body}</div><div class='extra'>{more}</div></body></html>"

    rows = [(k, f"http://a.example/{k}", page(f"<p>{LONG * 5}{k}</p>", "<p>short</p>")) for k in range(20)]
    rows.append((50, "http://A.example:80/x", page(f"<p>{LONG}</p>", f"<p>{LONG} other</p>")))  # alone it would take both
    rows += [(60, None, None), (61, "x", ""), (62, "http://b.example/", "<p>one</p>"), (62, "http://b.example/", "<p>one</p>")]
    table = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, html string, host string, path string").repartition(3)
    got = extract(table).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[50]["text"] == LONG.strip()
    assert by[3]["text"] == f"{LONG * 5}3" and by[3]["n_chars"] == len(by[3]["text"])
    assert (by[60]["text"], by[60]["n_chars"], by[61]["text"], by[62]["text"]) == ("", 0, "", "one")
    assert extract(table.where("false")).count() == 0
