from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from listingspark.operators import quotas
from listingspark.session import checkpoint_root
from listingspark.sources import tables
from listingspark.streaming import ingest


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_csv(spark, tmp_path):
    good = write(tmp_path / "a.csv", '﻿id,name\n1, x \n2,"say ""hi"", ok"\n3,"two\nlines"\n4,\n')
    rows, broken = tables.read_strict_csv(spark, good, ["id", "name"], multiline=True)
    assert {tuple(r) for r in rows.collect()} == {("1", "x"), ("2", 'say "hi", ok'), ("3", "two\nlines"), ("4", "")}
    assert broken.isEmpty()
    ragged = write(tmp_path / "b.csv", "id,name\n1,x\n2\n3,y,z\n")
    rows, broken = tables.read_strict_csv(spark, ragged, ["id", "name"], multiline=False)
    assert broken.count() == 2 and [r["id"] for r in rows.collect()] == ["1"]
    with pytest.raises(ValueError, match="missing columns: price"):
        tables.read_strict_csv(spark, good, ["id", "price"])
    with pytest.raises(ValueError, match="duplicate"):
        tables.read_strict_csv(spark, write(tmp_path / "c.csv", "id,id\n1,2\n"), ["id"])


def test_every_file_keeps_the_header(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.csv", "a,b,c\n1,2,3\n")
    write(folder / "b.csv", 'a,"b",c\n4,5,6\n')
    assert tables.read_strict_csv(spark, str(folder), ["a"])[0].count() == 2
    write(folder / "c.csv", "c,b,a\n7,8,9\n")
    found = tables.csv_header_violations(spark, str(folder), ["a", "b", "c"]).collect()
    assert [(r["header"], r["lines"]) for r in found] == [("c,b,a", 2)]
    with pytest.raises(ValueError, match="header differs"):
        tables.read_strict_csv(spark, str(folder), ["a"])


def test_quoted_line_breaks_in_split_files(spark, tmp_path):
    folder = tmp_path / "quoted"
    folder.mkdir()
    value = lambda i: f'v{i}' if i % 3 else 'say ""x"", ' + "\n\n".join(f"part {i} {j}" for j in range(i % 40)) + "\r\nend"
    texts = {str(i): value(i) for i in range(300)}
    for name, low, end in (("a", 0, "\n"), ("b", 150, "\r\n")):
        lines = [f'{i},"{texts[str(i)]}",z' for i in range(low, low + 150)]
        (folder / f"{name}.csv").write_bytes((end.join(["\ufeffid,name,z", *lines[:70], "", *lines[70:]]) + end).encode())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200b", "3kb", kept):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows, broken = tables.read_strict_csv(spark, str(folder), ["id", "name"], multiline=True)
            got = {r["id"]: r["name"] for r in rows.collect()}
            assert broken.isEmpty() and rows.count() == 300
            assert got == {i: t.replace('""', '"').replace("\r\n", "\n") for i, t in texts.items()}
            if size == "3kb":
                assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    write(folder / "c.csv", 'id,name,z\n1,"open,2\n')
    with pytest.raises(ValueError, match="inside a quoted value"):
        tables.read_strict_csv(spark, str(folder), ["id"], multiline=True)
    other = tmp_path / "other"
    other.mkdir()
    write(other / "a.csv", "a,b,c\n1,2,3\n")
    write(other / "b.csv", '"a,b",c\n1,2\n')
    for multiline in (True, False):
        with pytest.raises(ValueError, match="header differs"):
            tables.read_strict_csv(spark, str(other), ["c"], multiline=multiline)


def test_reference_documents(spark, tmp_path):
    path = write(tmp_path / "c.json", json.dumps({"catalogue_version": 1, "families": [
        {"make": "Honda", "model": "City", "variants": ["Aspire", "ASPIRE"]}, {"make": "Suzuki", "model": "Alto", "variants": []}]}))
    families, variants = tables.load_catalogue(spark, path)
    assert families.count() == 2 and variants.count() == 2
    assert tables.catalogue_violations(families, variants).first()["violation"] == "repeated variant"
    with pytest.raises(ValueError, match="version"):
        tables.load_catalogue(spark, write(tmp_path / "d.json", '{"catalogue_version": 2, "families": []}'))
    scope, years = tables.load_scope(spark, write(tmp_path / "s.json", '{"candidate_families": [{"make": "Honda", "model": "City"}], "year_range": [2010, 2026]}'))
    assert years == (2010, 2026) and scope.first()["model"] == "City"
    both = '{"candidate_families": [], "year_range": [2010, 2026]}\n{"candidate_families": [], "year_range": [2011, 2026]}\n'
    for documents in (both, '{"candidate_families": []}\n', ""):
        with pytest.raises(ValueError, match="one range of years"):
            tables.load_scope(spark, write(tmp_path / "years.json", documents), multiline=False)
    decisions = tables.load_decisions(spark, write(tmp_path / "r.json", json.dumps({"version": 1, "decisions": [
        {"listing_id": "1", "decision": "keep", "reason": "r", "corrections": {"mileage_km": {"from": 5, "to": 50}}}]})))
    assert tuple(decisions.first()) == ("1", "keep", "r", 5, 50, None, None)
    plan = {"plan_version": 1, "searches": [{"name": "a", "expected_make": None, "expected_model": None, "target_complete_rows": 1, "max_detail_requests": 2}]}
    assert tables.load_plan(spark, write(tmp_path / "p.json", json.dumps(plan))) == [quotas.Quota("a", 1, 2)]
    for bad in (dict(name="A", target=1, budget=1), dict(name="a", target=0, budget=1), dict(name="a", target=1, budget=1, make="x")):
        with pytest.raises(ValueError):
            quotas.Quota(**bad)


def test_versions_are_written_once_and_verified(spark, tmp_path):
    target = str(tmp_path / "v1")
    rows = spark.range(20).withColumn("k", F.col("id") % 3)
    tables.write_version({"all": rows, "some": rows.where("k = 1")}, target, [str(tmp_path / "raw")], {"all": "k"})
    tables.verify_version(spark, target)
    with pytest.raises(ValueError, match="exists"):
        tables.write_version({"all": rows}, target)
    with pytest.raises(ValueError, match="overlaps"):
        tables.check_target(spark, str(tmp_path / "raw/x"), [str(tmp_path / "raw")])
    rows.limit(1).write.mode("append").parquet(f"{target}/some")
    with pytest.raises(ValueError, match="some"):
        tables.verify_version(spark, target)
    file = tmp_path / "f.bin"
    file.write_bytes(b"abc")
    assert tables.file_digests(spark, str(file)).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_round_robin_selection(spark):
    data = [("a", 1, "u1", True, True), ("b", 2, "u3", True, True), ("a", 3, "u2", True, False), ("b", 4, "u4", True, True), ("a", 5, "u5", True, True), ("z", 6, "u6", True, True)]
    rows = spark.createDataFrame(data, "search_group string, position int, listing_id string, complete boolean, matches boolean")
    plan = (quotas.Quota("a", 1, 9), quotas.Quota("b", 9, 9))
    assert [r["listing_id"] for r in quotas.select_for_quotas(rows, plan, 10).collect()] == ["u1", "u3", "u4"]
    wide = (quotas.Quota("a", 2, 9), quotas.Quota("b", 9, 1))
    assert [r["listing_id"] for r in quotas.select_for_quotas(rows, wide, 10).collect()] == ["u1", "u3", "u2", "u5"]
    assert [r["listing_id"] for r in quotas.select_for_quotas(rows, wide, 2).collect()] == ["u1", "u3"]
    assert [r["listing_id"] for r in quotas.select_for_quotas(rows, plan, 10, {"a": 1}).collect()] == ["u3", "u4"]


def test_discovery_and_retention(spark):
    seen = spark.createDataFrame([("1", "n1", 1), ("1", "n1b", 2), ("2", "u2", 3), ("3", "n3", 4), ("4", "u4", 5)], "listing_id string, url string, position int")
    stored = spark.createDataFrame([("1", "o1", "incomplete"), ("2", "u2", "complete"), ("4", "u4", "incomplete")], "listing_id string, url string, parse_status string")
    found = {r["url"]: (r["outcome"], r["replaces_url"]) for r in quotas.discovery_outcomes(seen, stored).collect()}
    assert found == {"n1": ("refresh", "o1"), "n1b": ("duplicate", None), "u2": ("already_complete", None), "n3": ("new", None), "u4": ("refresh", None)}
    assert {r["outcome"] for r in quotas.discovery_outcomes(seen, stored, refresh=True).where("listing_id = '2'").collect()} == {"refresh"}
    pages = spark.createDataFrame([("r", str(i), i, i % 4 != 0, i == 7) for i in range(200)], "run_id string, listing_id string, position int, complete boolean, flagged boolean")
    kept = {r["listing_id"]: r["kept_because"] for r in quotas.retained_pages(pages, first=10).collect()}
    complete = [i for i in range(200) if i % 4]
    for i in range(200):
        flagged, early = i % 4 == 0 or i == 7, i in complete[:10]
        sampled = int(hashlib.sha256(f"r:{i}".encode()).hexdigest(), 16) % 10 == 0
        assert kept.get(str(i)) == ("flagged" if flagged else "early" if early else "sampled" if sampled else None)


def test_ingest_is_independent_of_arrival_order(spark, tmp_path):
    schema = "listing_id string, collected_at timestamp, source_batch string, price int"
    batches = [[("1", 5, "b", 50), ("2", 1, "a", 10)], [("1", 3, "a", 30), ("1", 5, "a", 51)], [("2", 9, "c", 90), ("3", 1, "a", 1)]]
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")

    def arrive(batch):
        rows = spark.createDataFrame(batch, "listing_id string, s int, source_batch string, price int")
        rows.select("listing_id", F.timestamp_seconds("s").alias("collected_at"), "source_batch", "price").coalesce(1).write.mode("append").parquet(arrivals)
        ingest.start_ingest(spark.readStream.schema(schema).parquet(arrivals), state).awaitTermination()

    for batch in batches[:2]:
        arrive(batch)
    ingest.compact(spark, state)
    arrive(batches[2])
    latest = ingest.latest_state(spark, state)
    found = {r["listing_id"]: (r["price"], r["source_batch"], r["observation_count"], r["first_batch"]) for r in latest.collect()}
    assert found == {"1": (51, "a", 3, 0), "2": (90, "c", 2, 0), "3": (1, "a", 1, 2)}
    assert {tuple(r) for r in ingest.arrival_counts(latest).collect()} == {(0, 2, 3), (2, 1, 0)}
    # A batch that is retried replaces its own table.
    again = spark.createDataFrame([("3", 1, "a", 1)], "listing_id string, s int, source_batch string, price int").select(
        "listing_id", F.timestamp_seconds("s").alias("collected_at"), "source_batch", "price")
    ingest.batch_writer(state, id="listing_id", time="collected_at", batch="source_batch")(again, 2)
    assert {r["listing_id"]: r["observation_count"] for r in ingest.latest_state(spark, state).collect()} == {"1": 3, "2": 1, "3": 1}


def test_a_dataset_is_computed_once_for_all_populations(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(value):
        runs.add(1)
        return value

    rows = spark.createDataFrame([(str(i), i % 3 == 0, None if i == 5 else i % 2 == 0, None if i == 7 else i) for i in range(40)],
                                 "listing_id string, modeling_candidate boolean, source_checked_candidate boolean, price int")
    rows = rows.withColumn("listing_id", F.udf(counted)("listing_id"))
    target = str(tmp_path / "v1")
    manifest = {r["name"]: r for r in tables.write_dataset(rows, target).collect()}
    assert runs.value == 40
    tables.verify_dataset(spark, target)
    written = tables.read_dataset(spark, target)
    expected = {"normalized_all": rows, "modeling_candidates": rows.where("modeling_candidate"), "source_checked_candidates": rows.where("source_checked_candidate")}
    for name, part in expected.items():
        assert sorted(map(tuple, written[name].select(*rows.columns).collect()), key=repr) == sorted(map(tuple, part.collect()), key=repr)
        one = tables.manifest_of({name: part}).first()
        assert tuple(one) == tuple(manifest[name])
    with pytest.raises(ValueError, match="exists"):
        tables.write_dataset(rows, target)
    moved = f"{target}/rows/modeling_candidate=true/source_checked_candidate=true"
    rows.limit(1).drop("modeling_candidate", "source_checked_candidate").write.mode("append").parquet(moved)
    with pytest.raises(ValueError, match="changed since"):
        tables.verify_dataset(spark, target)


def delivered(spark, state, number, rows):
    table = spark.createDataFrame(rows, "listing_id string, s int, source_batch string, price int").select(
        "listing_id", F.timestamp_seconds("s").alias("collected_at"), "source_batch", "price")
    ingest.batch_writer(state, id="listing_id", time="collected_at", batch="source_batch", buckets=8)(table, number)


def prices(spark, state):
    return {r["listing_id"]: (r["price"], r["observation_count"]) for r in ingest.latest_state(spark, state).collect()}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    state = str(tmp_path / "state")
    delivered(spark, state, 0, [(str(i), 10, "a", i) for i in range(60)])
    first = ingest.compact(spark, state)
    assert len(first.tables) == 8 and ingest.compact(spark, state) == first
    delivered(spark, state, 1, [("7", 20, "b", 700), ("7", 5, "b", 1)])
    delivered(spark, state, 2, [])
    before = ingest.latest_state(spark, state)
    second = ingest.compact(spark, state)
    moved = {bucket for bucket, name in second.tables.items() if name != first.tables[bucket]}
    assert len(moved) == 1 and second.number == first.number + 1 and second.buckets == 8
    expected = {str(i): (i, 1) for i in range(60)} | {"7": (700, 3)}
    # A reader that began before the compaction still finds its files, until they are cleared away.
    assert {r["listing_id"]: (r["price"], r["observation_count"]) for r in before.collect()} == expected == prices(spark, state)
    ingest.vacuum(spark, state)
    assert prices(spark, state) == expected and len(list((tmp_path / "state" / "delta").iterdir())) == 0
    delivered(spark, state, 1, [("7", 20, "b", 700)])  # a late retry of a batch that is already folded in
    assert prices(spark, state) == expected


def test_a_failed_compaction_changes_nothing(spark, tmp_path, monkeypatch):
    state = str(tmp_path / "state")
    delivered(spark, state, 0, [("1", 10, "a", 1), ("2", 10, "a", 2)])
    ingest.compact(spark, state)
    delivered(spark, state, 1, [("1", 30, "b", 3)])

    def broken(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(ingest, "_publish", broken)
        with pytest.raises(OSError):
            ingest.compact(spark, state)
    assert len(list((tmp_path / "state" / "base").iterdir())) == 2  # the files are there, but no version names them
    assert prices(spark, state) == {"1": (3, 2), "2": (2, 1)} and ingest.current_version(spark, state).number == 1
    ingest.compact(spark, state)
    assert prices(spark, state) == {"1": (3, 2), "2": (2, 1)} and ingest.current_version(spark, state).number == 2
    ingest.vacuum(spark, state)
    assert prices(spark, state) == {"1": (3, 2), "2": (2, 1)}
    with pytest.raises(ValueError, match="no state"):
        ingest.latest_state(spark, str(tmp_path / "nowhere"))


def test_checkpoint_folder_is_stable(spark):
    assert checkpoint_root(spark) == checkpoint_root(spark)


def test_pages_of_one_template_are_nested_once(monkeypatch):
    from listingspark.sources import pages

    page = (
        '<html><head><script type="application/ld+json">{{"name":"{0} &amp; <b>"}}</script></head><body><h1> {0}  &amp; Co </h1>{0}</b>{0}'
        '<div class="price-box"><strong>PKR {0}</strong></div><ul id="scroll_car_detail"><li class="ad-data">{0}:<li>v{0}</li><li class="ad-data">a</li><li>{0}</li></ul>'
        '<h2 id="scroll_seller_comments">Comments</h2><div>{0}\nx<br>y</div><div class="cards">{0}</div></body></html>'
    )
    odd = ("<p>a<b</p>", "<p title='x>y'>a</p>", "<SCRIPT>a<b></SCRIPT>c", "<script>a", "<!-- <p> -->a", '<p title="x>y">a', "", "a", "</p a=\"1>2\">b", "<!doctype html><p>a")
    names = ("1", "A", "", " ", "2 < 3", "x &lt; y", "\x013\x02")
    markups = [page.format(name) for name in names] + [page.format("z") + more for more in odd] + list(odd)
    built, build = [], pages.build_tree
    monkeypatch.setattr(pages, "build_tree", lambda html: built.append(html) or build(html))
    pages._layout.cache_clear()
    found = [pages.read_page(markup) for markup in markups]
    assert found[0][0] == "1 & Co" and found[0][4] == [{"label": "1", "value": "v1"}, {"label": "a", "value": "1"}] and found[0][5] == ["1", "x", "y"]
    monkeypatch.setattr(pages, "_from_layout", lambda html, parts: None)
    assert found == [pages.read_page(markup) for markup in markups]
    pages._layout.cache_clear()
    monkeypatch.undo()
    monkeypatch.setattr(pages, "build_tree", lambda html: built.append(html) or build(html))
    built.clear()
    for i in range(50):
        pages.read_page(page.format(i))
    assert len(built) == 1


def test_layouts_give_what_the_tree_gives_without_searching_every_tag():
    """Odd markup read by its layout equals the tree's; a known layout costs no search for each tag."""
    import random

    from listingspark.sources import pages

    bits = ["<script>", "</script>", "</SCRIPT >", "<script type=\"application/ld+json\">", "{\"a\": \"<b>x</b>\"}", "{\"a\": 1}", "<style>", "</style>", "<", ">", "&amp;", "\"", "'",
            "<!DOCTYPE html>", "<!-- x -->", "<ul id=\"scroll_car_detail\">", "<li class=\"ad-data\">", "</li>", "</ul>", "<h1>", "</h1>", "<p>", "<br/>", "<a title=\"x>y\">", "<a title='q'>",
            "<div class=\"price-box\">", "<strong>", "</strong>", "</div>", "<h2 id=\"scroll_seller_comments\">", "</h2>", "<div>", "<body>", " a > b ", "x\x85y", "\x013\x02", "<x/y z>", "<svg/>"]
    rng, by_layout = random.Random(7), 0
    for _ in range(4000):
        markup = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        found = pages._from_layout(markup, pages.PARTS)
        by_layout += found is not None
        assert found is None or found == pages._collected(markup, pages.PARTS), markup
    assert by_layout > 500
    page = "<html><body><h1>{0}</h1>" + "<p>PKR {0} > 5</p>" * 50 + "<script type=\"application/ld+json\">{{\"a\": \"<b>{0}</b>\"}}</script></body></html>"
    pages._layout.cache_clear()
    assert [pages.read_page(page.format(i), ["title", "objects"]) for i in range(3)] == [(str(i), [f'{{"a": "<b>{i}</b>"}}']) for i in range(3)]
    assert pages._layout.cache_info().misses == 1 and not hasattr(pages, "_PIECE")
