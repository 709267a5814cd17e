import random

from policylake.llm import boilerplate as B


def page(rng, host, main, extra=""):
    nav = rng.sample(["Home", "Help", "Cart", "News", "About us"], 3)
    body = [f"{rng.choice('ABCDEFG')}{rng.randrange(9999)} keeps {rng.choice(['names', 'dates', 'bills'])} for {rng.randrange(99)} days because {rng.choice(['law', 'orders', 'tests'])} {rng.randrange(99999)} say so and nothing else matters here." for _ in range(8)]
    html_ = f"<nav><ul>{''.join(f'<li><a href=/>{n}</a></li>' for n in nav)}</ul></nav><div class=\"{main}\"><h1>Privacy Policy</h1>{''.join(f'<p>{b}</p>' for b in body)}{extra}</div><footer><p>Site map</p><p>All rights reserved.</p></footer>"
    lines = [*nav, "", "Privacy Policy", *body, *(["Ad"] if extra else []), "Site map", "All rights reserved."]
    return html_, "\n".join(lines), {i + 1 for i, x in enumerate(lines) if x in {*nav, "Site map", "All rights reserved.", "Ad"}}


def test_style_tree(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for i in range(60):
        extra = '<aside class="promo"><p>Ad</p></aside>' if i % 4 == 0 else ""
        h, t, noise = page(rng, "h", f"m{i % 7}", extra)
        rows.append((i, "hot.example" if i % 3 == 0 else f"h{i}.example", h, t, "clash"))
        want |= {(i, n) for n in noise}
    rows += [(100, None, None, "Site map\nA line of its own.", ""), (101, "x", "<p>y", None, ""), (102, "x", "", "", ""), (None, "x", "<p>y", "y", "")]
    d = spark.createDataFrame(rows, "fetch_id bigint, site_etld1 string, cleaned_html string, text string, chain string").selectExpr("*", "cast(null as string) as raw_html")
    got = {(r["fetch_id"], r["line_no"]) for r in B.p5_found(d, d.where("fetch_id = 3")).collect()}
    assert got == {x for x in want if x[0] != 3} | {(100, 1)}
    assert B.style_tree(d.limit(0)).count() == 0


def test_markup():
    n = B.text_nodes('<div id="a" class="x  y"><p>One<br>Two &amp; three</p><script>if (a < b) "<p>no</p>"</script></div></div><ul><li>z</ul>tail<!-- c -->')
    assert [(" > ".join(c), t, s) for c, t, s in n] == [("div#a.x y", "p", "One"), ("div#a.x y", "p", "Two & three"), ("", "li", "z"), ("", "", "tail")]
    lines = [(1, "b"), (3, "a"), (4, "q")]
    assert B.align(lines, [((), "p", "a"), ((), "p", "b")]) == [(1, "b", 1), (3, "a", 0), (4, "q", -1)]


def test_own_tree_decides_where_a_host_has_pages(spark):
    """A class name that holds main bodies elsewhere and the menu on one host: only that host's own tree tells it apart."""
    rng = random.Random(9)
    sentence = lambda: f"{rng.choice('ABCDEFG')}{rng.randrange(9999)} keeps {rng.randrange(99999)} names for {rng.randrange(99)} days under rule {rng.randrange(99999)}."
    rows = []
    for i in range(40):
        body = [" ".join(rng.choice("abcdefghijkl") * rng.randrange(3, 9) for _ in range(12)) for _ in range(6)]
        rows.append((i, f"h{i}.example", f"<div class=c>{''.join(f'<p>{x}</p>' for x in body)}</div>", "\n".join(body)))
    for i in range(40, 55):
        body, menu = [sentence() for _ in range(6)], ["Home page", "Our shops", "Your cart"]
        rows.append((i, "own.example", f"<div class=c>{''.join(f'<p>{x}</p>' for x in menu)}</div><section>{''.join(f'<p>{x}</p>' for x in body)}</section>", "\n".join(menu + body)))
    rows += [(60 + i, "own.example", *rows[40][2:]) for i in range(10)]  # copies of one page make no difference
    d = spark.createDataFrame(rows, "fetch_id bigint, site_etld1 string, cleaned_html string, text string").selectExpr("*", "cast(null as string) as raw_html")
    noise = lambda prior: {tuple(r) for r in B.style_tree(d, prior_pages=prior).where("not main and fetch_id >= 40").select("fetch_id", "line_no").collect()}
    menus = {(i, n) for i in [*range(40, 55), *range(60, 70)] for n in (1, 2, 3)}
    assert menus <= noise(3.0) and not menus & noise(1e9)
    assert not {x for x in noise(0.01) if x[1] > 3}


def test_menu_items():
    assert B.contents("Home | Help | About us") == ["Home", "Help", "About us"] and B.contents("We keep your names, dates, and bills for as long as the law says so.") == ["We keep your names, dates, and bills for as long as the law says so."]
