"""Toxicity, line dedup, unit dedup, pseudonyms and decontamination on small tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from listingspark.llm import decontaminate, line_dedup, paragraphs, pii, toxicity

from .fixtures import SCHEMA, document, frames, sentence, text


def all_segments(scores, drift):
    """Maximal segments by their definition: grow them from the best one down."""
    flat = dict(scores)
    row = [flat.get(i, -drift) for i in range(max(flat) + 1)]

    def best(low, high):
        found = max(((sum(row[a:b]), -a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0,))
        if found[0] <= 0:
            return []
        a, b = -found[1], found[2]
        return [*best(low, a), (a, b - 1, round(found[0], 9)), *best(b, high)]

    return best(0, len(row))


def test_maximal_segments_match_their_definition():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(1, 14)
        hits = sorted((i, r.choice([0.5, 1.25, 2.75])) for i in r.sample(range(14), n))
        found = [(a, b, round(s, 9)) for a, b, s in toxicity.maximal_segments(hits, 0.6)]
        assert sum(s for _, _, s in found) == sum(s for _, _, s in all_segments(hits, 0.6)) or found == all_segments(hits, 0.6)


def test_toxicity_learns_and_leaves_odd_rows_alone(spark):
    rude = ["snarf", "blorg", "grut"]
    rows, labels = [], []
    for i in range(240):
        t = text(i, 3)
        if i % 4 == 0:
            t = t.replace(".", f" {rude[i % 3]} {rude[(i + 1) % 3]}.")
        rows.append(document(i, t))
        labels.append((i, 1, int(i % 4 == 0)))
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in out if out[i]["held_out"]]
    assert held and all(out[i]["predicted"] == int(i % 4 == 0) for i in held)
    hit = out[0]["passages"][0]
    assert any(w in rows[0][1].lower()[hit["first"] : hit["last"]] for w in rude)
    for frame in frames(spark):
        scored = toxicity.score_documents(frame, model).collect()
        assert len(scored) == frame.count() and all(r["score"] < 0.7 for r in scored)


def test_toxicity_without_labels_or_toxic_rows(spark):
    docs, _, empty = frames(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    clean = spark.createDataFrame([(i, 0) for i in range(1, 9)] + [(1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    for table, labels in ((docs, none), (docs, clean), (empty, clean)):
        scores = {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(table, labels)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def brute_lines(rows, min_words):
    """Lines in a run of ``min_words`` words or more that occurs earlier, by comparing all runs."""
    keyed = {}
    for r in rows:
        if r[1] is not None:
            keyed[(r[0] is None, r[0] or 0, r[1])] = [(x.strip(" "), i) for i, x in enumerate(r[1].split("\n")) if x.strip(" ")]
    return keyed


def test_line_runs_match_brute_force(spark):
    r = random.Random(5)
    pool = [sentence(i, r.choice([1, 2, 3, 5, 9])) for i in range(14)]
    rows = [document(i, "\n".join(r.choice([*pool, "", sentence(1000 + i * 50 + k, 4)]) for k in range(r.randint(1, 25)))) for i in range(40)]
    found = line_dedup.without_repeated_lines(spark.createDataFrame(rows, SCHEMA), min_words=8)
    got = {x["doc_id"]: x["text"] for x in found.collect()}
    seen, later = set(), defaultdict(set)
    for i, t, *_ in rows:
        lines = [(x.strip(" "), n) for n, x in enumerate(t.split("\n")) if x.strip(" ")]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                run = tuple(x for x, _ in lines[a : b + 1])
                if sum(x.count(" ") + 1 for x in run) >= 8:
                    if run in seen:
                        later[i].add((lines[a][1], lines[b][1]))
                    seen.add(run)
    for i, t, *_ in rows:
        kept = [x for n, x in enumerate(t.split("\n")) if not any(a <= n <= b for a, b in later[i])]
        assert got[i] == "\n".join(kept), i


def test_line_dedup_of_odd_rows(spark):
    for frame in frames(spark):
        out = line_dedup.without_repeated_lines(frame)
        assert out.columns == [*[c for c in frame.columns if c != "line_runs"], "line_runs"] or set(out.columns) == {*frame.columns, "line_runs"}
        rows = out.collect()
        assert len(rows) == frame.count()
        if rows:
            by_id = defaultdict(list)
            for r in rows:
                by_id[r["doc_id"]].append(r["text"])
            assert by_id[1] == [text(1)] and by_id[23] == [""] == by_id[24] and by_id[20] == [None] and by_id[21] == [""]
            assert by_id[22] == [" \n\t "] and by_id[30] == [text(31, 4000)] and sorted(by_id[None]) == ["", ""]
            assert sorted(by_id[2]) == sorted([text(2)] * 3 + [text(90)])  # equal rows are one document


def test_units_are_cut_with_offsets(spark):
    long = " ".join(sentence(i, 14) for i in range(5))
    rows = [document(1, f"{sentence(50)} {long}\n{sentence(51)}"), document(2, f"{sentence(52)}\n{long.upper()} {sentence(53)}"), document(3, "short one. short one."), document(4, None)]
    out = {r["doc_id"]: r for r in paragraphs.without_repeated_units(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] == rows[2][1] and out[4]["text"] is None
    assert long.upper() not in out[2]["text"] and sentence(52) in out[2]["text"] and sentence(53) in out[2]["text"]
    cut = "".join(rows[1][1][c["first"] : c["last"]] for c in out[2]["cuts"])
    assert cut.strip() == long.upper()
    for frame in frames(spark):
        rows = paragraphs.without_repeated_units(frame).collect()
        assert len(rows) == frame.count()
        for r in rows:
            if r["doc_id"] in (23, 24):
                assert r["text"].strip() == ""


def brute_units(rows, min_words):
    """Texts left of (id, text) rows when every window is looked up among all windows before it."""
    seen, left = {}, {}
    for doc, body in sorted(rows):
        pieces = re.split(r"(?<=[.!?])(?=\s)|(?<=\n)", body)
        plain = [" ".join(re.findall(r"[^\W_]+", p.lower())) for p in pieces]
        filled, gone = [i for i, p in enumerate(plain) if p], set()
        for place, i in enumerate(filled):
            first, key = i, plain[i]
            if len(key.split()) < min_words:
                first, key = max(i - 2, 0), " ".join(plain[max(i - 2, 0):i + 1]).strip()
                if key.count(" ") + 1 < min_words:
                    for back in range(place, -1, -1):
                        first, key = filled[back], " ".join(plain[j] for j in filled[back:place + 1]) + " "
                        if len(key.split()) >= min_words:
                            break
                    else:
                        continue
            if key in seen:
                gone.update(range(max(first, seen[key][1] + 1) if seen[key][0] == doc else first, i + 1))
            else:
                seen[key] = (doc, i)
        left[doc] = "".join(p for i, p in enumerate(pieces) if i not in gone)
    return left


def test_passages_of_short_lines_are_cut(spark):
    names = [f"item{i}" for i in range(60)]
    verse, same = "\n".join(names), "la\n" * 30
    other = "\n".join(reversed(names))
    rows = [document(1, f"first of all\n{verse}\nend"), document(2, f"second thing\n{verse}\nlast"), document(3, other), document(4, same), document(5, "item1\nitem2\nitem3")]
    out = {r["doc_id"]: r["text"] for r in paragraphs.without_repeated_units(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[2] == "second thing\nlast" and out[4] == "la\n" * 8
    assert [out[i] for i in (1, 3, 5)] == [rows[i - 1][1] for i in (1, 3, 5)]


def test_units_match_brute_force(spark):
    random.seed(5)
    pool = [" ".join(random.choices("abcdefgh", k=random.choice((1, 1, 2, 3, 5, 9, 12)))) for _ in range(14)]
    bodies = ["".join(random.choice(pool) + random.choice((". ", "\n", "\n\n", "! ")) for _ in range(random.randrange(1, 25))) for _ in range(60)]
    rows = [document(i, body) for i, body in enumerate(dict.fromkeys(bodies))]
    out = {r["doc_id"]: r["text"] for r in paragraphs.without_repeated_units(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == brute_units([(r[0], r[1]) for r in rows], 8)


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    card, bad = "4041894974608795", "4041894974608796"
    t = f"a.b3@mail.example.com +1 (988) 555-2485 {card} {bad} 4041 8949 7460 8795 123-45-6789 10.20.30.40 2024-02-29 2023-02-29 29.2.2024 999.1.1.1"
    rows = [document(1, t), document(2, f"x {card}, y a.b3@mail.example.com"), document(3, None), document(4, "")]
    out = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(rows, SCHEMA)).collect()}
    first, second = out[1]["text"], out[2]["text"]
    made = {k: [p["pseudonym"] for p in out[1]["pii"] if p["kind"] == k] for k in pii.PATTERNS}
    assert luhn(made["card"][0]) and made["card"][1].replace(" ", "") == made["card"][0] != card
    assert bad in first and "2023-02-29" in first and "999.1.1.1" in first
    assert not any(v in first for v in (card, "a.b3@", "555-2485", "123-45-6789", "10.20.30.40", "2024-02-29"))
    assert made["card"][0] in second and made["email"][0] in second
    assert out[3]["text"] is None and out[4]["text"] == "" and out[3]["pii"] == []
    for frame in frames(spark):
        assert pii.pseudonymised(frame).count() == frame.count()


def test_every_phone_number_is_replaced(spark):
    numbers = spark.range(3000).select("id", F.format_string("+1 (%03d) %03d-7713", F.col("id") % 150, F.floor(F.col("id") / 150)).alias("text"))
    out = pii.pseudonymised(numbers).select("text", F.size("pii").alias("n"), F.col("id")).join(numbers.withColumnRenamed("text", "was"), "id").collect()
    assert all(r["n"] == 1 and r["text"] != r["was"] for r in out) and len({r["text"] for r in out}) == 3000
    assert all(r["text"][:4] == "+1 (" and r["text"][7:9] == ") " and r["text"][12] == "-" and len(r["text"]) == 17 for r in out)


def test_pseudonyms_are_permutations(spark):
    numbers = spark.range(3000).select(F.concat(F.lit("10.0."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256).alias("text"))
    assert pii.pseudonymised(numbers).select("text").distinct().count() == 3000
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    made = pii.pseudonymised(days).select("text").distinct()
    assert made.count() == 3000 and made.where(F.to_date("text", "yyyy-MM-dd").isNull()).isEmpty()


def test_benchmark_items_are_found_as_by_brute_force(spark):
    items = [(i, f"{sentence(700 + i, 14)} {sentence(800 + i, 8)}") for i in range(60)] + [(60, None), (61, ""), (62, "lone"), (None, sentence(990, 20))]
    rows = []
    for i in range(80):
        t = text(2000 + i, 12)
        if i % 5 == 0:
            lines = t.split("\n")
            lines.insert(i % 12, items[i % 60][1])
            t = "\n".join(lines)
        if i % 5 == 1:  # the question alone is no leak of the answer
            t += " " + sentence(700 + i % 60, 14)
        rows.append(document(i, t))
    rows.append(document(None, f"before {items[63][1]} after"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), bench).collect()
    assert {(h["doc_id"], h["item_id"]) for h in hits} == {(i, i % 60) for i in range(0, 80, 5)} | {(None, None)}
    (index, more), = decontaminate.indexes(bench)
    assert not more
    r = random.Random(1)
    for _ in range(20):  # pruned scores equal full ones
        terms = sorted(r.sample(range(len(index.vocabulary)), 60) + [index.vocabulary[w] for w in decontaminate.words(items[r.randint(0, 59)][1])])
        import numpy as np

        terms = np.unique(terms)
        full = np.zeros(len(index.ids))
        for t in terms:
            for p in range(index.start[t], index.start[t + 1]):
                full[index.item[p]] += index.score[p]
        assert set(index.above(terms)) == set(np.flatnonzero(full >= 0.999999))


def test_decontamination_of_odd_rows_in_shards(spark):
    bench = spark.createDataFrame([(i, text(i)) for i in (1, 2)], "item_id long, text string")
    assert len(list(decontaminate.indexes(bench, chars=100))) >= 1
    for frame in frames(spark):
        kept = decontaminate.without_contaminated(frame, bench)
        assert kept.columns == frame.columns
        if frame.columns and not frame.isEmpty():
            assert kept.count() == frame.count() - 8  # 1, 23, 24, two null ids, three rows of 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frames(spark)[0], none).isEmpty()


def test_scores_do_not_depend_on_how_items_are_shared_out(spark):
    items = [(str(i), text(i, 1 + i % 3)) for i in range(40)] + [("", text(50)), (None, text(51)), (None, text(51))]
    docs = [document(i, text(200 + i) + "\n" + items[i][1] + "\n" + text(300 + i)) for i in range(43)] + [document(90, None), document(91, "")]
    bench, table = spark.createDataFrame(items, "item_id string, text string"), spark.createDataFrame(docs, SCHEMA)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    one = order(decontaminate.contaminated(table, bench).collect())
    assert {r[0] for r in one} >= set(range(42))
    for chars in (300, 2000):
        assert len(list(decontaminate.indexes(bench, chars=chars))) > 1
        many = order(decontaminate.contaminated(table, bench, chars=chars).collect())
        assert [r[:2] + r[3:] for r in many] == [r[:2] + r[3:] for r in one]
        assert all(abs(a[2] - b[2]) < 1e-12 * a[2] for a, b in zip(one, many, strict=True))
    assert decontaminate.without_contaminated(table, bench, chars=300).count() == decontaminate.without_contaminated(table, bench).count()
