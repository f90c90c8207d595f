"""Literal edge cases of books, contacts, archives, services, queues and folds."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as t
from lodestar.operators import contacts, ledger, resolution, taxonomy
from lodestar.sources import readers, storage


def _plain_tree(lines):
    """The same tree, with the context of each line looked for backwards, line by line."""
    rows = []
    for code, label in lines:
        dashes = re.match(r"[- ]*", label).group().count("-")
        rows.append((re.sub("[^0-9]", "", code or ""), dashes, re.sub(r"\s+", " ", re.sub(r"\s*:\s*$", "", label.lstrip(" -–"))).strip()))
    is_heading = [len(d) == 4 or re.fullmatch("[0-9]{4}0000", d) is not None for d, _, _ in rows]
    opens, current = [], None
    for i, (digits, _, _) in enumerate(rows):
        opens.append(bool(digits) and (is_heading[i] or digits[:4] != current))
        current = digits[:4] or current

    def contexts(i):
        """Labels above line i: ever less deep ones, none of them closed by a line between; and that of its heading."""
        found, least = [], rows[i][1]
        if is_heading[i]:
            return [], None
        for j in range(i if opens[i] else i - 1, -1, -1):
            if j < i and not is_heading[j]:
                digits, depth, label = rows[j]
                if len(digits) in (0, 6) and depth < least:
                    found.insert(0, label)
                least = min(least, depth)
            if opens[j]:
                return found, rows[j][2]
        return found, None

    nodes = {}
    for i, (digits, _, label) in enumerate(rows):
        if not digits:
            continue
        top, six, (above, heading) = digits[:4], digits[:6], contexts(i)
        path = " › ".join(above)
        made = [(top, 4, top[:2], label, None, None)] if opens[i] else []
        if is_heading[i] and len(digits) == 8:
            made += [(top + "00", 6, top, label, None, top), (digits, 8, top + "00", label, None, top)]
        elif not is_heading[i] and len(digits) == 6:
            made += [(six, 6, top, label, path, top)]
        elif not is_heading[i]:
            own = (label, path) if digits.endswith("00") or not (above or six.endswith("00")) else (heading, None) if six.endswith("00") else (above[-1], " › ".join(above[:-1]))
            made += [(six, 6, top, own[0], own[1], top), (digits, 8, six, label, path, top)]
        for code, *node in made:
            nodes.setdefault(code, tuple(node))
    return nodes


def test_book_against_a_plain_search(spark):
    rng = random.Random(1)
    lines = [("01.01", "Horses :"), (None, "- Live horses:"), ("0101.21", "- - Pure-bred"), ("0101.29.10", "- - - Racing"), ("0101.29.90", "- - - Other"), ("0101.30", "- Asses"), ("0102.21.00", "- Cattle"), ("0103.00.00", "Swine"), ("0104.00.11", "- Sheep"), (None, "- Group"), ("0105.11.20", "- - Deep line")]
    heading = 10
    for _ in range(200):
        kind = rng.random()
        dashes = "- " * rng.randint(0, 4)
        if kind < 0.15:
            heading += 1
            lines.append((f"01{heading:02d}" + ("0000" if rng.random() < 0.3 else ""), f"Heading {heading}"))
        elif kind < 0.4:
            lines.append((None, f"{dashes}Group {len(lines)}:"))
        elif kind < 0.7:
            lines.append((f"01{heading:02d}{rng.randint(10, 19)}", f"{dashes}Item {len(lines)}"))
        else:
            lines.append((f"01{heading:02d}{rng.randint(10, 21)}{rng.choice(['00', '10', '90'])}", f"{dashes}Line {len(lines)}"))
    book = spark.createDataFrame([("01", i, c, x, x) for i, (c, x) in enumerate(lines)], "chapter string, place int, code string, label string, label_en string").repartition(3)
    got = {r["code"]: (r["level"], r["parent"], r["label"], r["path"], r["heading"]) for r in taxonomy.build(book).collect()}
    want = _plain_tree(lines)
    assert set(got) == set(want)
    assert {k: got[k] for k in got if got[k] != want[k]} == {}


def test_best_addresses(spark):
    rows = [
        ("a", "info@shop.de", "www.shop.de", "p1"), ("a", "Einkauf@shop.de", "www.shop.de", "p2"), ("a", "no-reply@shop.de", "www.shop.de", "p"), ("a", "buyer@agency.com", "www.shop.de", "p"),
        ("b", "sales@x.co.uk", "shop.x.co.uk", "p"), ("b", "info@x.co.uk", "shop.x.co.uk", "p"), ("c", "max.muster@gmail.com", "c.fr", "p"), ("d", "x@mailinator.com", None, "p"), ("e", "jdoe@any.org", None, "p"), ("f", None, "f.de", "p"),
    ]
    got = {r["k"]: (r["email"], r["status"], r["source_url"]) for r in contacts.best_addresses(spark.createDataFrame(rows, "k string, email string, site_host string, source_url string"), "k").collect()}
    assert got == {"a": ("einkauf@shop.de", "role", "p2"), "b": ("info@x.co.uk", "role", "p"), "c": ("max.muster@gmail.com", "freemail", "p"), "e": ("jdoe@any.org", "personal", "p")}


def test_contacts_of_a_page(spark):
    html = """<a href='MAILTO:Buy%40Firm.de?subject=x'>m</a><a href="/cdn-cgi/l/email-protection#0a63646c654a6c6378672e6e6f">x</a><span data-cfemail="0a63646c654a6c6378672e6e6f"></span>
      <script type="application/ld+json">{"a":[{"b":{"telephone":"+49 30 555 666 7"}}],"email":"deep@firm.de"}</script><p>Tel: 0049 (30) 1234-567, 20240131 and x [at] y [dot] org, a@b.png, no@example.com</p><a href="tel:12345">short</a>"""
    row = spark.createDataFrame([(html,), (None,)], "h string").select(t.page_emails(F.col("h")).alias("e"), t.page_phones(F.col("h")).alias("p")).collect()
    assert row[0]["e"] == ["buy@firm.de", "deep@firm.de", "x@y.org"] or "buy@firm.de" in row[0]["e"] and "deep@firm.de" in row[0]["e"] and "no@example.com" not in row[0]["e"]
    assert row[0]["p"] == ["004930" + "1234567", "4930" + "5556667"] and row[1]["e"] is None


def test_blocked_hosts_and_prefixes(spark):
    rows = spark.createDataFrame([(1, "https://www.facebook.com/x"), (2, "m.facebook.com"), (3, "https://notfacebook.com"), (4, None)], "id int, url string")
    blocked = spark.createDataFrame([("facebook.com",)], "host string")
    assert {r["id"] for r in contacts.without_hosts(rows, "url", blocked).collect()} == {3, 4}
    assert contacts.without_hosts(rows, "url", blocked.limit(0)).count() == 4
    labels = spark.createDataFrame([("01", "a"), ("0111", "b")], "prefix string, label string")
    codes = spark.createDataFrame([("011122",), ("0199",), ("9",), (None,), ("",)], "code string")
    assert sorted(((r["code"], r["label"]) for r in contacts.prefix_labels(codes, "code", labels).collect()), key=str) == sorted([("011122", "b"), ("0199", "a"), ("9", None), (None, None), ("", None)], key=str)


def test_archives(spark):
    def archive(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(name, text)
        return out.getvalue()

    files = spark.createDataFrame([(archive({"a.csv": 'x, y\n1,"two, lines\nhere"\n3\n', "b.CSV": "x, y\n5,6\n", "c.txt": "no"}),), (archive({"d.txt": "none"}),)], "content binary")
    assert sorted(tuple(r) for r in readers.zip_csv(files).collect()) == [("1", "two, lines\nhere"), ("3", None), ("5", "6")]
    assert readers.zip_csv(files.limit(0)).count() == 0
    xml = spark.createDataFrame([(archive({"a.xml": "<all><r id='1'><n>A &amp; B</n></r><other/><r/></all>"}),)], "content binary")
    assert [tuple(r) for r in readers.zip_xml(xml, "r", "_id long, n string").collect()] == [(1, "A & B"), (None, None)]


@pytest.mark.parametrize("n", [0, 3, 10_000])
def test_archives_of_whole_batches_and_of_none(spark, n):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xml", f"<rs>{''.join(f'<r id=\"{i}\"/>' for i in range(n))}</rs>")
    files = spark.createDataFrame([(out.getvalue(),)], "content binary")
    assert sorted(r[0] for r in readers.zip_xml(files, "r", "_id long").collect()) == list(range(n))


def test_services_that_fail(spark):
    def fetch(endpoint, attempt, part, offset, limit, ordered):
        raise OSError("down")

    spark.dataSource.register(readers.offset_source("down_service", "x long", fetch, 10, ["a"], wait=0.0))
    with pytest.raises(Exception, match="down"):
        spark.read.format("down_service").load().collect()
    calls = []

    def flaky(endpoint, attempt):
        calls.append(endpoint)
        if endpoint == "one":
            raise OSError
        return 1

    ask = readers.persistent(flaky, ["one", "two"])
    assert [ask(), ask(), ask()] == [1, 1, 1] and calls[0] == "one" and calls[2:] == ["two", "two"]


def test_order_requests_against_a_plain_fold(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.choice("ab"), rng.randrange(20000), i) for i in range(400)]
    got = {r["event_id"]: (r["outcome"], r["order_id"]) for r in ledger.order_requests(spark.createDataFrame(rows, "account long, item string, ts long, event_id long").repartition(4)).collect()}
    orders, want = {}, {}
    for account, item, ts, event in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        live = [o for o in orders.get(account, []) if o[0] > ts - 3600]
        same = [o for o in live if o[2] == item and o[0] > ts - 1800]
        if same:
            want[event] = ("reused", same[-1][1])
        elif len(live) >= 5:
            want[event] = ("refused", None)
        else:
            want[event] = ("created", event)
            orders.setdefault(account, []).append((ts, event, item))
    assert got == want and {w[0] for w in want.values()} >= {"reused", "created"}


def test_versions_of_a_table(spark):
    path = storage.new_path(spark, "versions")
    assert resolution.current(spark, path) is None
    for n in (1, 2):
        resolution.write_table(spark.range(n), path)
    assert resolution.current(spark, path).endswith("version=2") and spark.read.parquet(resolution.current(spark, path)).count() == 2


def test_steps_are_cleared(spark):
    kept = storage.materialise(spark.range(3))
    storage.materialise(spark.range(4))
    last = storage.materialise(spark.range(5))
    assert storage.clear_steps(spark, kept=1) >= 2 and last.count() == 5
    with pytest.raises(Exception):  # noqa: B017
        kept.count()


def test_members_go_by_their_own_headers(spark):
    def files(*members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, text in enumerate(members):
                z.writestr(f"{i}.csv", text)
        return spark.createDataFrame([(out.getvalue(),)], "content binary")

    swapped = readers.zip_csv(files("Name,Number\nA,1\nName,Number\n", "Number, Name \n2,B\n", "Number\n3\n", ""))
    assert swapped.columns == ["Name", "Number"]
    assert sorted((tuple(r) for r in swapped.collect()), key=str) == [("A", "1"), ("B", "2"), ("Name", "Number"), (None, "3")]
    for wrong in ("Name,Town\nA,x\n", "Name,Name\nA,x\n", "Name\nA,1\n"):
        with pytest.raises(Exception, match="columns|values"):
            readers.zip_csv(files("Name,Number\nA,1\n", wrong)).collect()


def test_values_of_structured_data(spark):
    def of(script):
        html = f'<script type="application/ld+json">{script}</script>'
        return tuple(spark.createDataFrame([(html,)], "h string").select(t.data_values(F.col("h"), "telephone", "phone")).first()[0])

    assert of(r'{"telephone": "+49 30 1234567"}') == ("+49 30 1234567",)
    assert of(r'[{"a": [{"Phone": "x\"y\\"}, {"phone": "z"}]}, {"phone": {"telephone": "deep"}}]') == ('x"y\\', "z", "deep")
    assert of(r'{"note": "\"phone\": \"no\"", "phone": 5, "telephone": ["no"], "b": "phone"}') == ()
    assert of('{"phone": "never closed"') == () and of("") == ()


def test_links_in_all_quotes(spark):
    html = """<A HREF='/contact'>a</a><a href=/kontakt>b</a><a class="x>y" href="/a&amp;b">c</a><a data-href="no" href = '/d"e'>d</a><a name=x>none</a><link href="/style.css"><a href=tel:+49301234567>t</a><a href=mailto:a%2Bb@firm.de>m</a>"""
    row = spark.createDataFrame([(html, "https://firm.de/x")], "h string, u string").select(t.links(F.col("h")).alias("l"), t.contact_links(F.col("h"), F.col("u")).alias("c"), t.page_phones(F.col("h")).alias("p"), t.page_emails(F.col("h")).alias("e")).first()
    assert row["l"] == sorted(["/contact", "/kontakt", "/a&b", '/d"e', "tel:+49301234567", "mailto:a%2Bb@firm.de"])
    assert row["c"] == ["https://firm.de/contact", "https://firm.de/kontakt"] and row["p"] == ["49301234567"] and row["e"] == ["a+b@firm.de"]


def test_written_out_addresses(spark):
    said = ["a (at) firm.de", "b {at} firm [dot] de", "c at firm.de", "d at firm dot co dot uk", "e [@] firm.de", "f(@)firm(punkt)de", "g&#64;firm.de", "meet at noon", "noreply at firm.de", "h" * 41 + " at firm.de", "x at firm."]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i").select(t.emails(F.col("s"))).collect()]
    assert got == [["a@firm.de"], ["b@firm.de"], ["c@firm.de"], ["d@firm.co.uk"], ["e@firm.de"], ["f@firm.de"], ["g@firm.de"], [], [], [], []]
