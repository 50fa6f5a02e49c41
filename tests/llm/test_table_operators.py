"""SimHash, mixing, neighbours, page text and url trust on small tables."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from listingspark.llm import ann, html_diff, mixing, simhash, url_trust

from .fixtures import SCHEMA, document, frames, sentence, text


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def brute_components(fps, radius=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_groups_match_brute_force(spark):
    for frame in frames(spark):
        rows = frame.select("doc_id", "text").collect()
        out = simhash.near_duplicates(frame).collect()
        assert len(out) == len(rows)
        fps = [brute_fingerprint(r["text"]) for r in rows]
        groups = brute_components(fps)
        least = {g: min((r["doc_id"] for r, h in zip(rows, groups, strict=True) if g == h and r["doc_id"] is not None), default=None) for g in groups}
        expected = sorted((r["doc_id"] or -1, f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, groups, strict=True))
        assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in out) == expected


def test_crowded_buckets_are_split_without_losing_links(spark):
    r = random.Random(2)
    base, fps = r.getrandbits(64), set()
    while len(fps) < 400:
        f = base
        for b in r.sample(range(64), r.randint(0, 5)):
            f ^= 1 << b
        fps.add(f)
    fps = sorted(fps)
    table = spark.createDataFrame([(f.to_bytes(8, "big"),) for f in fps], "fp binary")
    pairs = simhash.links(table, radius=2, blocking=simhash.pigeonhole(64, 2), limit=20)
    rows = {(int.from_bytes(p["fp"], "big"), int.from_bytes(p["root"], "big")) for p in pairs.collect()}
    groups = brute_components(fps)
    assert all(groups[fps.index(a)] == groups[fps.index(b)] for a, b in rows)
    place = {f: i for i, f in enumerate(fps)}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a, b in rows:
            least = min(label[place[a]], label[place[b]])
            for x in (a, b):
                if label[place[x]] != least:
                    label[place[x]], changed = least, True
    assert label == groups


def test_crowded_sampled_buckets_keep_all_links(spark):
    r = random.Random(12)
    pairs = []
    for _ in range(150):
        f = r.getrandbits(124)  # the first four bits are equal in all
        g = f
        for b in r.sample(range(124), 20):
            g ^= 1 << b
        pairs.append((f, g))
    table = spark.createDataFrame([(f.to_bytes(16, "big"),) for p in pairs for f in p], "fp binary")
    blocking = simhash.Blocking(((0, 1, 2, 3),), simhash.sampled(128, 12, 1).refine)
    found = simhash.links(table, radius=20, blocking=blocking, limit=40).collect()
    got = {(int.from_bytes(x["fp"], "big"), int.from_bytes(x["root"], "big")) for x in found}
    assert all((a, b) in got or (b, a) in got for a, b in pairs)
    assert all(a == b or (a ^ b).bit_count() <= 20 for a, b in got)


def test_bit_sliced_pairs_match_brute_force():
    r = np.random.default_rng(4)
    sizes = np.array([2, 70, 1, 130, 5])
    fps = r.integers(0, 256, (int(sizes.sum()), 16), dtype=np.uint8)
    fps[1::2] = fps[:-1:2] ^ (r.random((len(fps) // 2, 16)) < 0.06).astype(np.uint8)
    for radius in (0, 2, 9):
        got = {(int(a), int(b)) for p in simhash.near_pairs(fps, sizes, radius) for a, b in zip(*p, strict=True)}
        start, want = 0, set()
        for size in sizes:
            for i in range(start, start + size):
                for j in range(i + 1, start + size):
                    if np.unpackbits(fps[i] ^ fps[j]).sum() <= radius:
                        want.add((i, j))
            start += size
        assert got == want


def test_one_of_each_group_stays(spark):
    base = text(7, 12).split(" ")
    near = base.copy()
    near[40] = "changed"
    rows = [document(3, " ".join(near)), document(9, " ".join(base)), document(5, text(8, 12)), document(None, text(8, 12)), document(4, text(9, 12)), document(4, text(9, 12))]
    kept = simhash.one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in kept) == [3, 4, 5]
    for frame in frames(spark):
        out = simhash.one_of_each_group(frame)
        assert out.columns == frame.columns
        assert frame.isEmpty() or sorted(r["doc_id"] for r in out.select("doc_id").collect()) == [1, 2, 2, 3, 4, 5, 6, 7, 8, 20, 30, 31]


def copies(r, number, share):
    """Pairs of texts whose five-word shingles have about the given similarity, and each exact one."""
    out = []
    for i in range(number):
        a = [f"w{r.randrange(10**9)}" for _ in range(200)]
        b = a[: round(392 * share / (1 + share)) + 4]
        b += [f"x{r.randrange(10**9)}" for _ in range(200 - len(b))]
        x, y = ({tuple(w[k : k + 5]) for k in range(196)} for w in (a, b))
        out.append((" ".join(a), " ".join(b), len(x & y) / len(x | y)))
    return out


def test_near_copies_are_those_of_brute_force(spark):
    r = random.Random(13)
    pairs = [p for share in (0.5, 0.6, 0.7, 0.78, 0.82, 0.9) for p in copies(r, 60, share)]
    rows = [document(2 * i + side, p[side]) for i, p in enumerate(pairs) for side in (0, 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for options in ({}, {"block": 2, "block_shingles": 300}):
        kept = {x["doc_id"] for x in simhash.one_of_each_group(frame, **options).collect()}
        assert {2 * i for i in range(len(pairs))} <= kept
        near = {2 * i + 1 for i, p in enumerate(pairs) if p[2] >= 0.8}
        assert not {2 * i + 1 for i in range(len(pairs))} - near - kept and len(near & kept) <= 1 and len(near) == 120


def test_similar_sets_match_brute_force():
    r = np.random.default_rng(14)
    for _ in range(40):
        sets = [np.unique(r.choice(12, r.integers(1, 12))).astype(np.uint64) for _ in range(25)]
        label, members = list(range(25)), [set(x.tolist()) for x in sets]
        for _ in range(25):
            for i in range(25):
                for j in range(25):
                    if len(members[i] & members[j]) * 5 >= 4 * len(members[i] | members[j]):
                        label[i] = label[j] = min(label[i], label[j])
        assert simhash.similar_sets(sets, (4, 5)).tolist() == label


def brute_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing_meets_targets(spark):
    r = random.Random(6)
    rows = [document(i, sentence(i, r.randint(1, 30)), r.choice(["a", "b", "b", "b", "ç", None, "z", "Q", "dd"])) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes, taken = {}, {}
    for x in out:
        assert x["taken"] <= 2 * x["size"]
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    expected = brute_targets(sizes)
    for x in out:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - expected[x["source"]]) < 1e-6 * max(1, x["target"])
    assert all(abs(taken[s] - expected[s]) <= 16 for s in sizes)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()))


def test_mixing_of_odd_rows(spark):
    for frame in frames(spark):
        out = mixing.mix(frame)
        assert out.count() == frame.count() and out.where("size IS NULL OR target IS NULL OR taken > 2 * size").isEmpty()
        assert set(mixing.mixed_documents(frame).columns) == {*frame.columns, "repeats"}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double, rank int")


def test_neighbours_match_brute_force(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(12, 16))
    values = [centres[i % 12] + 0.3 * r.normal(size=16) for i in range(900)]
    values[100:160] = [values[100]] * 60  # ties
    rows = [(i, [float(x) for x in v], None, None) for i, v in enumerate(values)]
    odd = [(5000, None, None, None), (5050, [0.0] * 16, None, None), (5100, [], None, None), (5150, [float("nan")] * 16, None, None), (None, rows[0][1], None, None), (5200, [None] * 16, None, None)]
    table = vectors(spark, rows + odd + rows[:1])
    out = ann.nearest(table, table.where("vec_id % 50 = 0")).collect()
    x = np.array([np.array(row[1], np.float32).astype(float) for row in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 900, 50):
        scores = np.einsum("vd,d->v", x, x[q])
        scores[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(scores, 12)))[:5]
        got = sorted((g["rank"], g["vec_id"], g["score"]) for g in out if g["query_id"] == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and all(abs(scores[g[1]] - g[2]) < 1e-12 for g in got)
        hit += len({int(b) for b in best} & {g[1] for g in got})
    assert hit >= 0.9 * 18 * 5 and {g["query_id"] for g in out} == set(range(0, 900, 50))


def test_queries_that_are_their_own_centroids_still_look_further(spark):
    # Groups of three copies: where one makes a list of its own, that holds two neighbours only.
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i // 3]], None, None) for i in range(120)]
    out = ann.nearest(vectors(spark, rows), vectors(spark, rows[::10])).collect()
    assert all(sum(g["query_id"] == q for g in out) == 5 for q in range(0, 120, 10))


def test_neighbours_of_small_tables(spark):
    assert ann.nearest(vectors(spark, []), vectors(spark, [])).isEmpty()
    two = vectors(spark, [(0, [1.0, 0.0], None, None), (1, [1.0, 1.0], None, None)])
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    one = vectors(spark, [(0, [1.0, 0.0], None, None)])
    assert ann.nearest(one, one).isEmpty()


def test_dense_regions_get_their_share_of_lists():
    r = np.random.default_rng(3)
    spread, dense = r.normal(size=(4000, 16)), r.normal(size=(1, 16)) * 3 + r.normal(size=(4000, 16)) * 0.05
    both = np.concatenate([spread, dense])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    graph = ann.Graph.fit(both, 64)
    sizes = np.bincount((graph.centroids @ both.T).argmax(axis=0), minlength=64)
    assert sizes.min() > 0 and sizes.max() < 3 * sizes.mean()
    assert sizes[np.unique((graph.centroids @ both[4000:].T).argmax(axis=0))].sum() >= 4000


def test_common_subsequence_is_longest():
    r = random.Random(9)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html_diff.common_subsequence(a, b)
        assert len(found) == best[-1][-1] and found == sorted(set(found))
        at = iter(b)
        assert all(any(a[i] == y for y in at) for i in found)


def test_names_of_elements_tell_noise():
    kept = lambda html: [x.text for x in html_diff.lines_of(html) if not x.noise]
    assert kept("<article class='post has-sidebar'><p>a</p><ol class='commentlist'><li>b</ol><div class='post-content with-ads'>c</div></article>") == ["a", "c"]
    assert kept("<div id=sideBar>x</div><div role=alert>y</div><article class='comment'>z</article><p hidden>h</p><p>k<span style='display: none'>q</span></p>") == ["k"]


def page(body, article=True):
    inner = f"<article><header><h1>Title</h1></header>{body}<div class='comments'><p>nice</p></div></article>" if article else f"<div>{body}</div>"
    return f"<html><head><title>t</title></head><body><header>Site</header><nav><a href='/a'>Home</a></nav><p>Our motto here</p>{inner}<form>Mail <input></form><footer>&copy; us</footer><script>var t='</p>';</script></body></html>"


def test_main_text_of_articles_and_of_plain_pages(spark):
    rows = [(i, f"http://h.example/{'a' if i < 4 else 'b'}/{i}", page(f"<p>Text  {i} &amp; more<p>Same line in all", i % 2 == 0), None) for i in range(8)]
    rows += [(10, None, None, None), (11, "x", "", None), (None, "http://h.example/a/0", "plain <b>te</b>xt &lt;1&gt;", None), (0, *rows[0][1:])]
    out = html_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(rows)
    got = {(r["page_id"], r["url"]): r["text"] for r in out}
    for i in range(8):
        t = got[i, rows[i][1]]
        if i % 2 == 0:
            assert t == f"Title\nText {i} & more\nSame line in all"
        else:
            assert f"Text {i} & more" in t and "motto" not in t and "Home" not in t and "us" not in t
    assert got[10, None] == "" == got[11, "x"] and got[None, "http://h.example/a/0"] == "plain text <1>"
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html_diff.main_text(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_neighbours_are_other_pages_and_cross_group_edges(spark):
    rows, hosts = [], 3 * html_diff.GROUP
    for h in range(hosts):  # two pages a host, the first host with one only, so that pairs straddle every edge
        for i in range(1 if h == 0 else 2):
            rows.append((len(rows), f"http://h{h:03}.example/p/{i}", page(f"<p>Own text {h} {i}", False)))
    rows += [(1000 + i, f"http://copies.example/p/{i % 3}?v={i}", page("<p>Text of the copies", False)) for i in range(50)]
    rows += [(2000, "http://copies.example/p/9", page("<p>Another text", False))]
    out = html_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    alone = [r["page_id"] for r in out if "motto" in r["text"]]
    assert len(out) == len(rows) and alone == [0]
    assert {r["text"] for r in out if 1000 <= r["page_id"] < 2000} == {"Text of the copies"}


def test_pages_with_articles_are_compared_too(spark):
    teaser = "<article><p>Read our other stories</article>"
    rows = [(i, f"http://h.example/p/{i}", f"<main><p>Lead {i} of a story told at length<p>Body {i} of it{teaser}</main>") for i in range(3)]
    quoting = [(10 + i, f"http://q.example/p/{i}", f"<main><p>Posted on day {i}<article><p>A quotation that both pages have</article></main>") for i in range(2)]
    pages = spark.createDataFrame([*rows, *quoting], "page_id long, url string, html string")
    assert html_diff.shared_lines(pages).count() == 5
    got = {r["page_id"]: r["text"] for r in html_diff.main_text(pages).collect()}
    assert [got[i] for i in range(3)] == [f"Lead {i} of a story told at length\nBody {i} of it" for i in range(3)]
    assert got[10] == got[11] == "A quotation that both pages have"


def test_rules_and_trust(spark):
    link = lambda *h: "".join(f'<a class="x" href="{u}">l</a>' for u in h)
    rows = [
        (1, "http://A.example.ORG/es/1?q", link("/here")), (2, "http://example.org/en/12", None), (3, "http://x.org", ""), (4, "https://b.com/fr/2", ""),
        (5, "https://b.com/de/", ""), (6, "http://bad.net/1", link("https://evil.com/de/1", "//evil.com/x")), (7, "http://ok.net/#x", link("http://x.org/1")),
        (8, None, link("http://evil.com")), (9, "no url", None), (10, "https://evil.com/de/2", ""), (11, "http://notexample.org/es/", ""), (12, "http://evil.com/en/3", ""), (13, "http://evil.com/de/9", ""),
    ]
    out = {r["page_id"]: r for r in url_trust.judge(spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, html string, verdict string")).collect()}
    assert [(out[i]["rule"], out[i]["verdict"]) for i in (1, 2, 3, 4, 5, 11)] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), (None, "allow"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow"),
    ]
    assert out[1]["host"] == "a.example.org" and out[1]["path"] == "/es/1" and out[3]["path"] == "" and out[7]["path"] == "/"
    assert (out[8]["host"], out[8]["path"], out[8]["rule"], out[9]["host"]) == ("", "", None, "")
    assert out[6]["distrust"] > 0 and out[7]["verdict"] == "allow" and out[12]["verdict"] == "block"
    assert url_trust.judge(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_distrust_does_not_shrink_with_many_in_links(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/">l</a>' for x in h)
    rows = [(0, "http://evil.com/de/1", "")] + [(i, f"http://n{i}.net/", link("evil.com")) for i in range(1, 31)]
    rows += [(40, "http://far.net/", link("n1.net")), (41, "http://mixed.net/", link("evil.com", "a.net", "b.net", "c.net"))]
    out = {r["page_id"]: r for r in url_trust.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i]["verdict"] == "block" and abs(out[i]["distrust"] - 0.85) < 1e-9 for i in range(1, 31))
    assert out[40]["verdict"] == "block" and out[41]["verdict"] == "allow"


def test_rank_matches_power_iteration(spark):
    r = random.Random(11)
    edges = {(a, b) for a in range(12) for b in r.sample(range(12), 3) if a != b}
    seeds = {0: 1.0, 3: 0.5}
    rank, moving = dict(seeds), dict(seeds)
    out = {a: [b for x, b in edges if x == a] for a in range(12)}
    for _ in range(200):
        nxt = {}
        for a, v in moving.items():
            for b in out[a]:
                nxt[b] = nxt.get(b, 0) + 0.85 * v / len(out[a])
        moving = nxt
        for b, v in nxt.items():
            rank[b] = rank.get(b, 0) + v
    table = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    found = url_trust.personalised_rank(table, spark.createDataFrame([(str(k), v) for k, v in seeds.items()], "host string, weight double"), tolerance=1e-3)
    got = {x["host"]: x["rank"] for x in found.collect()}
    assert all(abs(got[str(k)] - v) < 0.02 for k, v in rank.items())
    assert found.where(F.col("rank") < 0).isEmpty()
