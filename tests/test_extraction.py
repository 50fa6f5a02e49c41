from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from listingspark.operators import extract
from listingspark.sources.pages import PARTS, read_page, with_structure

URL = "https://www.example.com/used-cars/honda-city-2018-for-sale-in-d-g-khan-42"


def product(**changes):
    return json.dumps({"@type": "Car", "brand": {"name": "Honda"}, "model": "City", "bodyType": "Sedan", "offers": {"url": URL, "price": 4300000}, **changes})


def page(main="", head="", title="Honda City i-VTEC 2018", details="", comments=""):
    return (f"<html><head>{head}</head><body><div class=cards>PKR 9 lacs</div><h1>{title}</h1>{main}<ul id='scroll_car_detail'>{details}</ul>"
            f"<h2 id=scroll_seller_comments>Comments</h2><div>{comments}</div><p>Seller Details</p>PKR 77 lacs 5 km 900 cc</body></html>")


def script(*documents):
    return "".join(f'<script type="application/ld+json">{d}</script>' for d in documents)


def extracted(spark, *pages, url=URL):
    df = spark.createDataFrame([(i, url, html) for i, html in enumerate(pages)], "i int, url string, html string")
    return [r.asDict() for r in extract.extract_listings(with_structure(df)).orderBy("i").collect()]


def test_price_cascade_and_completeness(spark):
    box = "<div class='price-box'><strong>{}</strong></div>"
    rows = extracted(
        spark, page(box.format("PKR 4,300,000") + "2018 | 66,000 km Petrol Automatic 1300 cc"), page(box.format("Call for price") + "PKR 5,000,000"),
        page("PKR 5,000,000 and Current Price: PKR 58.5 lacs"), page("PKR 43 lacs 10 km PHEV"), page("PKR 4.3"), page("nothing"),
        page("<div class=price-box><strong>PKR 1 crore</strong></div><div class='price-well'><div class='price-box x'><strong>PKR 2 crore</strong></div></div>"),
    )
    assert [r["price_pkr"] for r in rows] == [4_300_000, None, 5_850_000, 4_300_000, None, None, 20_000_000]
    assert (rows[0]["mileage_km"], rows[0]["fuel"], rows[0]["transmission"], rows[0]["engine_cc"]) == (66_000, "Petrol", "Automatic", 1300)
    assert rows[0]["parse_status"] == "complete" and rows[1]["missing_fields"] == "price_pkr, mileage_km" and rows[3]["fuel"] == "PHEV"
    assert (rows[0]["listing_id"], rows[0]["listing_city"]) == ("42", "D G Khan")
    assert json.loads(rows[1]["field_provenance"])["price_pkr"] == {"displayed": "Call for price", "source": "main_price_box"}


def test_identity_needs_one_matching_product(spark):
    rows = extracted(
        spark, page(head=script(product())), page(head=script(product(), product())), page(head=script(product(), product(model="Civic"))),
        page(head=script("{broken", json.dumps({"@graph": [[json.loads(product())]]}))), page(head=script(product(offers={"url": URL + "0"}))),
        page(head=script(product()), title="City 2018"), page(head=script(product(brand="Honda", **{"@type": ["Thing", "Product"]})), title="HONDA CITY 2018"),
    )
    assert [r["identity_status"] for r in rows] == [
        "extracted_pending_review", "extracted_pending_review", "unmatched", "extracted_pending_review", "unmatched",
        "family_extracted_variant_unmatched", "extracted_pending_review"]
    assert [r["variant"] for r in rows] == ["i-VTEC", "i-VTEC", None, "i-VTEC", None, None, None]
    assert rows[0]["body_type"] == "Sedan"


def test_details_dates_and_registration(spark):
    item = "<li class='ad-data'>{}</li><li>{}</li>"
    rows = extracted(
        spark, page(details=item.format("Assembly:", "Local") + item.format("Posted On", "2026-10-05") + item.format("Last Updated:", "Oct 5, 2026"),
                    comments="Registered: 2013<br>Nice"),
        page(details=item.format("Date Added", "October 05, 2026"), comments="Registered 2013\nFirst Pakistan registration: 2015"),
        page(details=item.format("Last Updated", "yesterday"), comments="First registration in Japan: 2012."), page(comments="Registered 2013 in Lahore"),
    )
    assert [str(r["listing_date"]) for r in rows] == ["2026-10-05", "2026-10-05", "None", "None"]
    assert [r["listing_date_type"] for r in rows] == ["updated", "posted", "updated", None]
    assert [r["registration_year_status"] for r in rows] == ["extracted", "conflicting", "extracted", "not_stated"]
    assert rows[0]["registration_year_meaning"] == "unknown" and rows[2]["registration_year_meaning"] == "first_registration_other_jurisdiction"
    assert rows[0]["assembly"] == "Local" and json.loads(rows[2]["field_provenance"])["listing_date"]["displayed"] == "yesterday"


def test_structure_survives_broken_markup():
    assert read_page(None)[2] == "" and read_page("a < b & c")[2] == "a < b & c"
    text = read_page("<body><p>one<p>two<ul><li>x<li>y</ul><script>if (a<b) '</p>'</script><!-- <b>no</b> -->t&eacute;&nbsp;z<br/>end")[2]
    assert text == "one two x y té z end"


def test_links_keep_their_first_position(spark):
    html = ('<a class="x" href="/used-cars/b-for-sale-in-x-2?r=1">b</a><a href="https://www.example.com/used-cars/a-for-sale-in-x-1/">a</a>'
            '<a href="https://elsewhere.test/used-cars/c-for-sale-in-x-3">c</a><!-- <a href="/used-cars/d-for-sale-in-x-4"> --><a href="/about">z</a>'
            "<a href='used-cars/b-for-sale-in-x-2'>again</a>")
    links = extract.listing_links(spark.createDataFrame([(1, html)], "id int, html string"), key="id", base="https://www.example.com",
                                  path_pattern=r"/used-cars/.+-for-sale-in-.+-\d+").orderBy("position").collect()
    assert [r["url"].rsplit("-", 1)[1] for r in links] == ["2", "1"]


def test_reconciliation_repairs_only_what_is_evidenced(spark):
    from pyspark.sql import functions as F

    box = "<div class='price-box'><strong>PKR 48.5 lacs</strong></div>"
    facts = dict(offers={"url": URL + "/", "price": 4850000}, modelDate=2018, mileageFromOdometer="10 km", vehicleEngine={"engineDisplacement": "1300cc"}, fuelType="Hybrid")
    pages = spark.createDataFrame([(URL, page(box, script(product(**facts))))], "url string, html string")
    pages = with_structure(pages.withColumn("actual_sha256", F.sha2("html", 256)).withColumn("sha256", F.col("actual_sha256")))
    rows = spark.createDataFrame([("42", URL, "3095000", "2018", "99", "1300", "petrol", "Manual")],
                                 "listing_id string, source_url string, price_pkr string, year string, mileage_km string, engine_cc string, fuel string, transmission string")
    review = extract.reconcile_evidence(rows, pages).first()
    assert review["updates"] == {"price_pkr": "4850000", "fuel": "Hybrid"} and review["price_verified"] and review["checksum_ok"]
    assert review["flags"] == ["unresolved_source_disagreement:mileage_km"] and len(review["checks"]) == 5
    assert not extract.reconcile_evidence(rows, pages.withColumn("sha256", F.lit("x"))).first()["checksum_ok"]


def test_broken_markup_costs_no_more_than_other_pages():
    pages = [
        "<a " * 300_000, '<a "' * 250_000, "<a<b" * 250_000, "</a" * 300_000, "<!" * 400_000, "<b>" * 60_000 + "<p></p></q>" * 40_000,
        "<script>" * 100_000, "x</q>" * 150_000, "<div>" * 60_000 + "<div class=price-box><strong>" * 15_000,
        "<ul id=scroll_car_detail>" + "<li class=ad-data>a</li>" * 30_000, '<script type="application/ld+json">' + "[" * 200_000 + "</script>",
    ]
    for markup in pages:
        started = time.process_time()
        read_page(markup)
        assert time.process_time() - started < 10, markup[:20]


def test_tags_end_outside_quotes_and_unclosed_ones_are_text():
    assert read_page('<body><a title="1 > 2">x</a> y <b class=\'">\'>z')[2] == "x y z"
    assert read_page('<body>one <a href="two> three')[2] == 'one <a href="two> three'
    assert read_page('<body><i "a>b <p c="d">e')[2] == '<i "a>b e'
    assert read_page("<body>a</q>b</i>c<ul><li>d</b><li>e</ul>f")[2] == "abc d e f"


def test_objects_in_lists_and_graphs_keep_their_order():
    nested = '[{"a":1,"@graph":[{"b":2},[{"c":3}]]},{"d":"\\ud800"},[[{"e":NaN}]]]'
    assert read_page(script(nested))[3] == ['{"@graph": [{"b": 2}, [{"c": 3}]], "a": 1}', '{"b": 2}', '{"c": 3}', '{"d": "?"}', '{"e": NaN}']
    assert read_page(script("[" * 100_000, '{"f":1}'))[3] == ['{"f": 1}']


def test_source_values_are_read_from_one_parse(spark):
    document = {"@type": "Car", "fuelType": None, "brand": {"@type": "Brand"}, "modelDate": 2018, "mileageFromOdometer": {"value": "66,000"},
                "vehicleEngine": {"engineDisplacement": 1300.0}, "offers": {"url": URL + "/", "price": 4.3e6}}
    text = json.dumps(document)
    values = {name: value for name, (value, _) in extract._source_values(F.get(extract.read_objects(F.array(F.lit(text))), F.lit(0))).items()}
    row = spark.range(1).select(*[value.alias(name) for name, value in values.items()]).first().asDict()
    assert (row["year"], row["mileage_km"], row["fuel"], row["transmission"]) == ("2018", '{"value":"66,000"}', None, None)
    assert (float(row["price_pkr"]), float(row["engine_cc"])) == (4.3e6, 1300.0)
    offered = {"a": [text, text], "b": [text, json.dumps({**document, "model": "x"})], "c": ["{}"], "d": None}
    df = spark.createDataFrame(list(offered.items()), "n string, o array<string>")
    product = extract.listing_product(F.col("o"), F.lit(URL))
    found = df.select("n", product.isNotNull().alias("one"), extract.brand_name(product["fields"]).alias("brand")).collect()
    assert {r["n"]: r["one"] for r in found} == {"a": True, "b": False, "c": False, "d": False} and not any(r["brand"] for r in found)


def test_only_the_named_pieces_are_read(spark):
    markup = page("<div class='price-box'><strong>PKR 1 crore</strong></div>", script(product()), details="<li class='ad-data'>Posted On</li><li>2026-10-05</li>", comments="Registered 2013")
    whole = dict(zip(PARTS, read_page(markup)))
    for part in PARTS:
        assert read_page(markup, [part]) == (whole[part],)
    df = spark.createDataFrame([(URL, markup)], "url string, html string")
    full = extract.extract_listings(with_structure(df))
    assert set(extract._READ_FROM) <= set(full.columns)
    for columns in (["listing_id", "listing_city"], ["listing_date", "assembly"], ["registration_year"], ["body_type"], ["variant"], ["parse_status", "price_pkr"]):
        found = extract.extract_listings(with_structure(df, parts=extract.parts_of(*columns)))
        assert found.select(columns).collect() == full.select(columns).collect()
    assert "price_pkr" not in extract.extract_listings(with_structure(df, parts=["text"])).columns


def test_references_without_a_semicolon_agree_with_the_sql(spark, tmp_path):
    import duckdb

    from listingspark.plans import catalog

    html = "<html><body><h1>{}</h1><p>x 1999</p></body></html>"
    rows = [(1, "https://a.org/1", html.format("one &amp;&amp;&amp")), (2, "https://a.org/2", html.format("Q&lt;A 2001 &copy 2004")), (3, "https://a.org/3", html.format("&amp;lt;b"))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog.queries()["e3_title_and_year"](spark, str(tmp_path)).orderBy("page_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "car_title", "year"]
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()['e3_title_and_year']}) ORDER BY page_id").fetchall()
    assert [tuple(r[n] for n in names) for r in found] == expected == [(1, "one &&&", 1999), (2, "Q<A 2001 © 2004", 2004), (3, "&lt;b", 1999)]


def test_city_slug_is_searched_for_once(spark):
    # A pure read of a url: each search over its path costs more than the rest of the row.
    rows = spark.createDataFrame([(i, f"{URL}{i}") for i in range(3)], "i int, url string").repartition(2, "i")
    found = extract.extract_listings(rows).select("listing_id", "listing_city")
    assert found._jdf.queryExecution().executedPlan().toString().count("-for-sale-in-") == 1
    assert {tuple(r) for r in found.collect()} == {(f"42{i}", "D G Khan") for i in range(3)}


def test_provenance_documents_are_parsed_once(spark, monkeypatch):
    from listingspark.plans import extraction

    document = '{"price_pkr":{"displayed":"PKR 5 é ","source":"main_price_box"},"registration_year":{"source":"s","statements":["Registered \\"1995\\"","b"]}}'
    rows = spark.createDataFrame(
        [(1, 1, 1, document, "conflicting"), (2, 1, 1, document, "extracted"), (3, 1, 1, None, "not_stated")],
        "k int, n int, sk int, field_provenance string, registration_year_status string")
    monkeypatch.setattr(extraction, "extracted", lambda t, *columns: rows)
    found = extraction.provenance(None)
    assert "get_json_object" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["k"]: tuple(r)[3:] for r in found.collect()}
    assert got[1] == ("main_price_box", "PKR 5 é ", None, None, '["Registered \\"1995\\"","b"]')
    assert got[2] == (*got[1][:4], None) and got[3] == (None,) * 5
