import pytest

from policylake.llm import residue as R

POLICY = "Privacy Policy\n" + "\n".join(f"We keep data item {i} for as long as the account is open and delete it later." for i in range(12))
CASES = ["Error 404\nThe requested document was not found on this server.", "You need to enable JavaScript to run this app.", "Just a moment...", "The domain x1.example is parked.", "Menu\nHome\nYour content goes here.", POLICY + "\nWritten for {{company_name}}.",
         POLICY + " [INSERT SITE NAME]", POLICY + "\nLorem ipsum dolor sit amet.", "Seite nicht gefunden", POLICY.replace("account", "%SITE_NAME%", 1), "503 | service unavailable", POLICY + "\nTODO: ask legal."]
FINE = [POLICY, POLICY + "\nOur log notes each 404 and 503 reply. If this page is not found write to us. Access may be denied.", POLICY + ' See [Art. 6(1)(f)] and note [72]. {"user": 35, "opt_out": true} Scores < 42 count, scores > 42 not; get 20% off, 30% more.',
        POLICY + "\nA cookie named Glava_28 lasts a day. Without JavaScript the tool falls back.", None, "", "   "]
MESSAGES = {
    "html_marker_missing": False, "net::ERR_NAME_NOT_RESOLVED at https://x.example/": False, 'Unexpected failure in fetch step at line 9:\n  9 |     raise CrawlFault(f"cannot open {target}: {cause}")': False, "ValueError: [gatido] is not a valid proxy entry": False,
    "Origin x.example answered status 404 (page not found) on try 2 of 3": False, 'Protocol error: {"code": -32000, "message": "Frame a was detached"}': False, "http_status_403 | Target page closed": False,
    "Failed for %s at line %d": True, "<h1>Access Denied</h1><p>x</p>": True, "ERROR_MESSAGE_HERE": True, "${err.message}": True, "Unexpected error: {0}": True, "Error in step %(url)s, see log": True, "Just a moment...": True, "error text (to be filled in)": True, "<error>": True,
}


def test_texts(spark, rows):
    texts = list(enumerate(CASES + FINE)) + [(None, CASES[0]), (0, CASES[0])]
    f = spark.createDataFrame([(*t, "clash") for t in texts], "fetch_id bigint, text string, part string")
    m = list(enumerate(MESSAGES)) + [(900, None), (901, ""), (None, "<error>")]
    r = spark.createDataFrame(m, "result_id bigint, error_message string")
    want = [("fetches", i) for i in range(len(CASES))] + [("results", i) for i, bad in enumerate(MESSAGES.values()) if bad]
    assert rows(R.p4_found(f, r)) == sorted(want, key=repr)
    assert R.p4_found(f.limit(0), r.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["{{x}}", "[[effective date]]", "<%= brand %>", "<?php echo $x ?>", "${a_b}", "#{site}", "%{cause}", "%BRAND%", "@@X@@", "__COMPANY_NAME__", "{website}", "[Your name here]", "(insert dpo)", "<COMPANY NAME>", "[website]", "{reason!r}"])
def test_slots(text):
    assert R.has_slot(f"We at {text} care.")


def test_tree():
    t = R.PrefixTree()
    a = [t.add(R.masked(f"Request {x} was blocked by node {i}").split()) for i, x in enumerate(("a1b2c3d4", "99", "00ff00ff"))]
    assert len(set(a)) == 1 and " ".join(t.templates[a[0]]) == "Request <*> was blocked by node <*>"
    assert t.add("Bad Gateway".split()) != t.add("Not Found".split())
    many = R.PrefixTree(children=5)
    assert len({many.add(f"Name{chr(97 + i % 26)}{chr(97 + i // 26)} answers within a day".split()) for i in range(200)}) <= 6


CAPITALS = ["The Page You Are Looking For Could Not Be Found On This Server", "ACCESS TO THIS PAGE IS REFUSED BECAUSE YOUR BROWSER DOES NOT RUN SCRIPTS", "This Dummy Text Will Be Changed By The Owner Of The Site Before Launch"]
NAMED = "Our Partners Are Lobomi, Teha, Rado, Ploze, Pigofe, Zesepi, Mepiplo, Larofi And Tenidra."


def test_capitals(spark, rows):
    assert all(len(m.split()) >= R.NAMES and R.tokens_of(m) == m.split() for m in CAPITALS)
    assert R.WILD in R.tokens_of(NAMED)
    m = list(enumerate([*CAPITALS, NAMED]))
    f, r = spark.createDataFrame(m, "fetch_id bigint, text string"), spark.createDataFrame(m, "result_id bigint, error_message string")
    assert rows(R.p4_found(f, r)) == [(t, i) for t in ("fetches", "results") for i in range(len(CAPITALS))]


ALIKE = ["Your browser does not run scripts, so nothing can appear.", "Your browser does not send us anything beyond these records."]


def test_verdict_does_not_depend_on_other_texts(spark, rows):
    for order in (ALIKE, ALIKE[::-1]):
        t = R.PrefixTree()
        ks = [t.add(*R.read_message(m)) for m in order]
        assert [t.verdicts[k] for k in ks] == ["page" if m == ALIKE[0] else "other" for m in order] and len(set(ks)) == 2
    for part in (1, 3):  # in one tree, and in trees that are merged
        m = spark.createDataFrame(list(enumerate(ALIKE)), "fetch_id bigint, text string").repartition(part)
        r = m.selectExpr("fetch_id as result_id", "text as error_message")
        assert rows(R.p4_found(m, r)) == [("fetches", 0), ("results", 0)]


def test_error_page_of_any_length(spark):
    menu = "Home | Products | Our Shops | Careers\n" * 60
    policy = "\n".join(f"We keep record {i} of your visits for {i} days and delete it after that." for i in range(40))
    rows = [(1, "Error 404\nThe document was not found.\n" + menu), (2, policy + "\nIf this page is not found, write to us."), (3, menu)]
    d = spark.createDataFrame(rows, "fetch_id bigint, text string")
    assert [tuple(r) for r in R.residue_pages(d).collect()] == [(1, "page")]
