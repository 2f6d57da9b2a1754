"""The ten operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import html.parser
import random
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontaminate, graph, jaccard, language, lines, neighbours, packing, quality, render, sharding, warc
from ledgerloom.llm.bytetext import slices
from ledgerloom.llm.queries import oracle_sql, queries

DOCS = "doc_id bigint, text string"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_match_sql(spark, duck, name):
    got = queries()[name](spark, SF)
    columns = sorted(got.columns)
    held = duck.execute(oracle_sql()[name])
    names = [d[0] for d in held.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in held.fetchall()]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, map(tuple, got.select(columns).collect()))) == sorted(map(key, want))


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_decontamination_on_odd_texts(spark):
    item = words(12, 1)
    docs = [(1, " ".join([*words(30, 2), *item[1:11], *words(5, 3)])), (2, " ".join(item[:9])), (3, None), (4, ""), (5, "Short ITEM here"), (5, "short item"), (None, " ".join(item))]
    bench = [(7, " ".join(item)), (8, "short item"), (9, None), (9, "..."), (8, "short item")]
    d, b = spark.createDataFrame(docs, DOCS).withColumn("contamination", F.lit(1)), spark.createDataFrame(bench, "item_id bigint, text string")
    for most in (1_000_000, 0):  # broadcast index, and the join in a shuffle
        got = decontaminate.contamination(d, b, most_words=most)
        found = sorted((r[0] or 0, r[1] or "", r[3].n_hit, tuple(r[3].item_ids)) for r in got.collect())
        assert [(a, n, i) for a, _, n, i in found] == [(0, 12, ("7",)), (1, 10, ("7",)), (2, 0, ()), (3, 0, ()), (4, 0, ()), (5, 2, ("8",)), (5, 2, ("8",))]
    assert decontaminate.clean(d, b).columns == d.columns
    assert decontaminate.contamination(d.limit(0), b.limit(0)).count() == 0


def test_rows_that_many_items_hit(spark, monkeypatch):
    shared = words(12, 1)
    bench = [(i if i % 3 else None, " ".join([*words(3, 100 + i), *shared, *words(3, 900 + i)])) for i in range(300)] + [(400 + i, f"q{i}") for i in range(50)]
    docs = [(1, " ".join([*words(50, 2), *shared, *words(50, 3)])), (1, " ".join([*words(5, 7), *shared[:9]])), (2, " ".join(f"q{i}" for i in range(60))), (3, None), (4, "")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "ITEMS", 16)
    made = [sorted(map(repr, decontaminate.contamination(d, b, most_words=most).collect())) for most in (1_000_000, 0)]
    assert made[0] == made[1]
    sizes = sorted((r[0], r[2].n_hit, len(r[2].item_ids)) for r in decontaminate.contamination(d, b, most_words=0).collect())
    assert sizes == [(1, 0, 0), (1, 12, 201), (2, 50, 50), (3, 0, 0), (4, 0, 0)]


def test_neighbours_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (20, [0.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(e, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.nearest(e.limit(0), F.lit(True)).count() == 0


def test_neighbour_recall(spark):
    x = np.random.default_rng(4).standard_normal((1500, 64)).astype(np.float32)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(e, F.col("vec_id") % 20 == 0).collect()}
    scores = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(scores, -np.inf)
    want = {(q, int(v)) for q in range(0, 1500, 20) for v in np.argsort(-scores[q])[:20]}
    assert len(got & want) >= 0.99 * len(want)


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} or ({tuple(w)} if w else set())
    of = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    of[a] = of[b] = min(of[a], of[b])
    return {i: (len(sets[i]), of[i]) for i in sets}


def test_jaccard_components_of_near_copies(spark):
    r, docs, base = random.Random(5), [], words(120, 9)
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        docs.append((i, " ".join(w)))
    docs += [(50, None), (51, ""), (52, "a b"), (53, "A  b"), (54, " ".join(words(3000, 8))), (55, " ".join(words(3000, 8)[:2900]))]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_components(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute_components(docs)
    kept = jaccard.one_of_each(spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", text_ int"))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(i for i, (n, c) in got.items() if i == c)
    assert jaccard.near_components(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_cuts_hot_tiles(spark, monkeypatch):
    r, docs, base, rows = random.Random(6), [], words(120, 9), []
    for i in range(50):
        w = list(base)
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(len(w))] = f"y{r.randrange(999)}"
        docs.append((i, " ".join(w)))
    for e in range(60):
        n, common = r.choice((100, 125, 130, 150)), np.arange(90) * 2**40 + np.arange(90) * 77
        values = np.concatenate((common, np.array([r.randrange(2**60) for _ in range(n - 90)]))).view(np.uint64)
        rows += [(t, e, e % 9, n, jaccard.band_of(n, 80), r.random() < 0.8, jaccard.bitmap(values, jaccard.bitmap_bits(n)).tolist()) for t in (1, 2)]
    tiles = spark.createDataFrame(rows, "token bigint, entity bigint, component bigint, n bigint, band int, first boolean, bits array<bigint>")
    joined = set(map(tuple, jaccard._tile_pairs(tiles, 60).collect()))
    monkeypatch.setattr(jaccard, "HOT", 0)
    monkeypatch.setattr(jaccard, "SIDE", 13)
    assert set(map(tuple, jaccard._tile_pairs(tiles, 60).collect())) == joined and len(joined) > 20
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_components(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == brute_components(docs)


def test_components_take_one_aggregation_a_round(spark, monkeypatch):
    r, rounds = random.Random(7), []
    p = r.sample(range(-(10**9), 10**9), 400)
    edges = [*zip(p, p[1:200], strict=False), *((p[i], p[r.randrange(200, i)]) for i in range(201, 400)), (p[0], p[0]), (p[1], p[0])]
    up = {x: x for x in p}
    for a, b in edges * 400:
        up[a] = up[b] = min(up[a], up[b])

    def counted(df, what, stored=graph.stored):
        plan = df._jdf.queryExecution().executedPlan().toString()
        rounds.append(len(re.findall(r"\bExchange (hash|range|Round)", plan)))
        return stored(df, what)

    monkeypatch.setattr(graph, "stored", counted)
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    assert dict(map(tuple, graph.components(table).collect())) == up
    assert len(rounds) < 14 and max(rounds) == 1
    some = graph.components(spark.createDataFrame(edges[::2], "a bigint, b bigint"))
    assert dict(map(tuple, graph.joined_up(some, spark.createDataFrame(edges[1::2], "a bigint, b bigint")).collect())) == up
    assert graph.components(table.limit(0)).count() == graph.joined_up(some.limit(0), table.limit(0)).count() == 0
    monkeypatch.setattr(graph, "MOST_BROADCAST", 0)
    assert dict(map(tuple, graph.components(table).collect())) == up


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = [(1, "Hello world  \n again"), (2, None), (3, ""), (3, " x" * 5000), (4, "é<|endoftext|> 日本"), (None, "a"), *[(10 + i, " ".join(words(40 * i, i))) for i in range(20)]]
    got = packing.packed(spark.createDataFrame(docs, DOCS), path).collect()
    held = Tokenizer.from_file(path)
    want = []
    for i, t in docs:
        ids = [*held.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(i or 0, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= 1.1 * sum(w[3] for w in want) / 2048 + 1


def test_lines_keep_rows_and_columns(spark):
    docs = [(2, "A common line here\nown\n  a COMMON line here "), (1, "a common line here"), (3, None), (4, ""), (None, "a common line here"), (2, "tail\r\nlonger tail line")]
    d = spark.createDataFrame([(*x, "s") for x in docs], DOCS + ", line_dedup string")
    got = lines.without_repeats(d)
    assert got.columns == d.columns
    assert sorted((r[0] or 0, r[1] or "") for r in got.collect()) == sorted([(2, "own"), (1, "a common line here"), (3, ""), (4, ""), (0, "a common line here"), (2, "tail\r\nlonger tail line")])


def test_shards_are_even_and_steady(spark):
    names = [f"s{i}" for i in range(7)]
    table = {r.slot: r.shard for r in sharding.lookup_table(spark, names, 211).collect()}
    sizes = sorted(list(table.values()).count(n) for n in names)
    assert len(table) == 211 and sizes[-1] - sizes[0] <= 1
    fewer = {r.slot: r.shard for r in sharding.lookup_table(spark, names[:-1], 211).collect()}
    assert sum(table[s] != fewer[s] for s in table if table[s] != "s6") < 0.35 * 211
    got = sharding.sharded(spark.createDataFrame([("a",), (None,), ("a",)], "k string"), "k", names, slots=211)
    assert got.count() == 3 and len({r.placement.shard for r in got.collect() if r.k}) == 1


def test_language_held_out(spark):
    done = queries()["op7_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = done.where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    net = language.new_net(["a", "b"], 2)
    odd = language.identified(spark.createDataFrame([(1, None), (2, ""), (3, "12 .."), (4, "x")], DOCS), net).orderBy("doc_id").collect()
    assert [r.language.lang for r in odd[:3]] == ["und"] * 3 and odd[3].language.lang in ("a", "b")


def test_network_gradients():
    net = language.new_net(["a", "b", "c"], 3)
    for x in net.all:
        x[...] *= 0.3
    cells = np.random.default_rng(1).integers(0, 256, (7, 4)).astype(np.int16)
    cells[5:, 1] = language.PAD
    labels = np.array([0, 1, 2, 1])
    _, found = language.gradients(net, cells, labels)
    for p, g in zip(net.all, found, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = p[at], 1e-2
        p[at] = old + step
        up = language.gradients(net, cells, labels)[0]
        p[at] = old - step
        down = language.gradients(net, cells, labels)[0]
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries()["op8_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    none = quality.learn(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id bigint, quality int"))
    assert [r.quality_score for r in quality.scored(spark.createDataFrame([(1, None)], DOCS), none).collect()] == [0.5]


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 600
    pages = [(1, "http://a b", big), (5, None, big), (5, "u", big), (2, "u", None), (3, "u", "x"), (4, "u", "x"), (None, "u", big)]
    d = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(d).collect()]
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    n = len(big.encode())
    want = [(1, n, sha(big), "revisit", 5), (5, n, sha(big), "response", None), (5, n, sha(big), "response", None), (2, 0, sha(""), "response", None), (3, 1, sha("x"), "response", None), (4, 1, sha("x"), "response", None), (None, n, sha(big), "revisit", 5)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_copies_of_one_payload_are_dealt_into_parts(spark):
    hot, other = "h" * 1000, "o" * 2000
    pages = [(i, "u", hot if i % 3 == 0 else None if i % 3 == 1 else other if i % 2 else f"{i} " + "x" * 1500, 1) for i in range(3000)]
    d = spark.createDataFrame(pages, "page_id bigint, url string, html string, digest_ int")
    with_parts = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in with_parts}
    try:
        for k, v in with_parts.items():
            spark.conf.set(k, v)
        made = warc.records(d).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    newest = {html: max(i for i, _, h, _ in pages if h == html) for html in (hot, other)}
    want = {i: newest[h] if h in newest and i != newest[h] else None for i, _, h, _ in pages}
    assert {r.page_id: r.refers_to for r in made} == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in made)
    sizes = [sum(r.part == p for r in made) for p in {r.part for r in made}]
    assert len(sizes) == 16 and max(sizes) < 2 * 3000 / 16


def test_archive_has_leading_dictionary():
    records = [warc.record_bytes(i, "u", "response", f"<html>{i} same text again and again</html>".encode() * 20, "0" * 40, 1, None) for i in range(300)]
    data = warc.archive_bytes(records, 3)
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE and list(warc.archive_records(data)) == records


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, None),
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>one<li>two</ul>", "- one\n- two"),
        ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"),
        ("<div hidden>no</div><script>1</script>yes<br>&amp; no", "yes\n& no"),
        ("<b>unclosed <i>text", "unclosed text"),
        ("a <!-- c --> b", "a b"),
    ],
)
def test_rendering(page, text):
    assert render.page_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p title="The hidden truth">a<p class="nav hidden md:block">b<p style="overflow: hidden !important">c<p data-type="hidden">d', "a\n\nb\n\nc\n\nd"),
        ('<body class="hidden"><span aria-hidden=true>x</span> y', "x y"),
        ("<p hidden>1<p HIDDEN=''>2<p style=display:none>3<p style='color:red; display : none!important;display:block'>4<p style='display:none;display:block'>5", "5"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div>", "yes"),
        ("<head><title>t</title><p>text", "text"),
        ("<head><meta charset=utf-8><title>t</title>bare text", "bare text"),
        ("<head><noscript><img alt=no></noscript><script>1</script></head><body>a", "a"),
        ('<p class=a">one</p><p class="b">two</p>', "one\n\ntwo"),
        ("<a href='x'' title=it's>one</a> <a title=\"1 > 0\" href=a=\"b>two</a>", "one two"),
        ("x <math><semantics><mrow><mi>a</mi><mo>=</mo><mn>1</mn></mrow><annotation>TeX</annotation></semantics></math>", "x a=1"),
        ("<svg>raw<title/><style/><g><text>Hello <tspan>you</tspan></text><text>World</text></g><desc>no</desc></svg>after", "Hello you\nWorld\nafter"),
        ("<svg><path d='M0'><foreignObject><p>in</foreignObject></svg><svg><g><div>out</div>too", "in\n\nout\ntoo"),
        ("<img data-alt=no alt='an > image'>", "an > image"),
        ("<div>" * 3000 + "<div hidden>secret</div>seen", "seen"),
        ("<table><tr><td>" * 350 + "deep", "deep"),
        ("<input type=submit value=Go><input type=hidden value=x><input type=reset>", "Go Reset"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>a wide cell<tr><td>d<td>e</table>", "a | b\n  | c\na wide cell\nd | e"),
        ("<table><tr><td>日本<td>x<tr><td>abc<td>y</table>", "日本 | x\nabc  | y"),
    ],
)
def test_rendering_keeps_what_is_seen(page, text):
    assert render.page_text(page) == text


def test_one_row_of_each_component_with_repeated_ids(spark):
    a, near, other = words(40, 31), words(40, 31), words(30, 32)
    near[39] = "x"
    docs = [(1, " ".join(a)), (1, " ".join(a)), (3, " ".join(near)), (3, " ".join(other)), (4, " ".join(near)), (5, None), (5, ""), (5, " ".join(other)), (None, " ".join(a)), (6, "one"), (6, "two"), (6, "two")]
    d = spark.createDataFrame([(*x, "s") for x in docs], DOCS + ", mark string")
    got = jaccard.one_of_each(d)
    assert got.columns == d.columns
    want = [(1, " ".join(a)), (3, " ".join(other)), (5, None), (5, ""), (None, " ".join(a)), (6, "one"), (6, "two")]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def seen_words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def test_stages_match_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    r, item = random.Random(41), words(14, 42)
    line = lambda: " ".join(f"w{r.randrange(900)}" for _ in range(25))
    common = "a line that many documents hold"
    texts = ["\n".join([line(), *([common] if i % 3 == 0 else []), line()]) for i in range(40)]
    texts += [texts[1].replace("w1", "w2", 1), texts[2], texts[4] + " tail", line() + " " + " ".join(item[2:13]), " ".join(item[:9])]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, line()), (7, texts[1]), (None, texts[8]), (None, None), (9, ""), (50, line()), (50, line()), (50, "junk junk junk")]
    docs += [(100 + i, "junk buy now " * (5 + i)) for i in range(12)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i in [*range(40), *range(100, 112)]], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    read = lambda d: sorted(((x.doc_id, x.text) for x in d.collect()), key=repr)
    (_, good), (_, lines_), (_, near), (_, clean), (_, pack) = corpus_pipeline.STAGES
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = quality.learn(now, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = lambda t: next(model.scores(data, at)[0] for _, _, data, at in slices(pa.array([t or ""])))
    now = good(spark, now, str(tmp_path))
    want = [x for x in docs if score(x[1]) >= 0.3]
    assert read(now) == sorted(want, key=repr) and 0 < len(want) < len(docs)

    key = lambda x: x.strip(" \t\n\v\f\r").lower()
    holders = {}
    for i, t in want:
        for x in (t or "").split("\n") if i is not None else ():
            holders.setdefault(key(x), set()).add(i)
    stays = lambda i, x: i is None or len(key(x)) < 10 or i == min(holders[key(x)])
    now = lines_(spark, now, str(tmp_path))
    want = [(i, "\n".join(x for x in (t or "").split("\n") if stays(i, x))) for i, t in want]
    assert sorted(((i, t or "") for i, t in read(now)), key=repr) == sorted(want, key=repr)

    before = sorted(read(now), key=lambda x: (x[0] is None, x[0] or 0))
    of = brute_components(list(enumerate(t for _, t in before)))
    alone = lambda n: before[n][0] is None or not of[n][0]
    groups = {}
    for n, (i, _) in enumerate(before):
        if not alone(n):
            groups.setdefault(of[n][1], []).append((i, n))
    now = near(spark, now, str(tmp_path))
    kept = read(now)
    assert len(kept) == len(groups) + sum(map(alone, range(len(before)))) < len(before)
    for members in groups.values():
        ids, texts_ = {i for i, _ in members}, {before[n][1] for _, n in members}
        assert [i for i, t in kept if i in ids and t in texts_] == [min(ids)]

    passage = seen_words(" ".join(item))
    runs = {tuple(passage[p : p + 10]) for p in range(len(passage) - 9)}
    hit = lambda t: any(tuple(seen_words(t)[p : p + 10]) in runs for p in range(len(seen_words(t)) - 9))
    now = clean(spark, now, str(tmp_path))
    want = [x for x in kept if not hit(x[1])]
    assert read(now) == want and len(want) < len(kept)

    held = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = sorted(((i or 0), len(held.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in want)
    assert sorted((x.doc_id or 0, x.length) for x in pack(spark, now, str(tmp_path)).collect()) == sizes


def test_benchmark_items_without_an_id_count(spark, duck):
    a, b = words(12, 51), words(12, 52)
    docs = [(1, " ".join(a)), (2, " ".join(a + b)), (3, " ".join(b)), (4, "x a short item"), (5, "none")]
    bench = [(None, " ".join(a)), (7, " ".join(b)), (None, "short item"), (None, " ".join(a)), (None, None)]
    d, m = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id bigint, text string")
    want = [(1, 12, [None]), (2, 24, ["7", None]), (3, 12, ["7"]), (4, 2, [None]), (5, 0, [])]
    held = duckdb.connect()
    held.execute("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    held.executemany("insert into documents values (?, ?)", docs)
    held.executemany("insert into benchmark values (?, ?)", bench)
    sql = held.execute(oracle_sql()["op1_decontaminate"] + " ORDER BY doc_id").fetchall()
    assert [(r[0], r[2], r[3]) for r in sql] == [(i, n, len(ids)) for i, n, ids in want]
    for most in (1_000_000, 0):
        got = decontaminate.contamination(d, m, most_words=most).orderBy("doc_id").collect()
        assert [(r.doc_id, r[2].n_hit, r[2].item_ids) for r in got] == want
        assert [r.doc_id for r in decontaminate.clean(d, m, most_words=most).collect()] == [5]


def test_whole_texts_teach(spark, monkeypatch):
    ends = {i: "word " * 11_000 + f"end{i}" for i in range(30)}
    d = spark.createDataFrame(list(ends.items()), DOCS).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    taught = []
    monkeypatch.setattr(quality, "train", lambda texts, *_: taught.append(texts))
    monkeypatch.setattr(language, "train", lambda texts, *_: taught.append(texts))
    quality.learn(d, spark.createDataFrame([(i, i % 2) for i in ends], "doc_id bigint, quality int"))
    language.learn(d)
    assert all(texts and set(texts) <= set(ends.values()) for texts in taught)
    quality.learn(d, spark.createDataFrame([(i, i % 2) for i in ends], "doc_id bigint, quality int"), most_bytes=120_000)
    assert len(taught) == 3 and len(taught[2]) == 2
    assert quality.affordable([(1, 1, 9), (2, 1, 99), (3, 1, 1), (4, 1, 0)], 2, 20) == [1, 3]


class Seen(html.parser.HTMLParser):
    """Visible words by another parser, with a stack of its own: what is open, and how many of these show nothing."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    NOTHING = {"script", "style", "template", "noscript", "title", "iframe", "object", "audio", "video", "canvas", "datalist", "meter", "progress"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        hidden = tag in self.NOTHING or "hidden" in held or "display:none" in (held.get("style") or "").replace(" ", "") or (tag == "dialog" and "open" not in held)
        if tag not in self.VOID:
            self.open.append((tag, hidden))

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.open):
            self.words += data.split()


def test_all_visible_text_of_pages_is_rendered(spark):
    """Brute force by html.parser: the given pages show exactly these words, in this order but for what tables lay side by side."""
    marks = re.compile(r"-|\||\d+\.")
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect() if r.html is not None]
    assert len(pages) > 20
    for page in pages:
        brute = Seen()
        brute.feed(page)
        brute.close()
        words = [w for w in render.page_text(page).split() if not marks.fullmatch(w)]
        assert sorted(words) == sorted(w for w in brute.words if not marks.fullmatch(w)), page


def made(r, depth, seen, words):
    """A well-formed page of random elements; `words` gets those that are seen."""
    out = ""
    for _ in range(r.randrange(1, 4)):
        if depth == 0 or r.random() < 0.4:
            word = f"w{r.randrange(10**6)}"
            out += f" {word} "
            words += [word] if seen else []
            continue
        kind = r.choice(["div", "b", "p", "ul", "table", "hidden", "none", "script", "dialog", "open", "closed", "meter", "group", "span"])
        inner = lambda now=True: made(r, depth - 1, seen and now, words)
        if kind in ("div", "b", "span"):
            out += f"<{kind}>{inner()}</{kind}>"
        elif kind == "p":
            word = f"w{r.randrange(10**6)}"
            words += [word] if seen else []
            out += f"<p>{word}</p>"
        elif kind == "ul":
            out += "<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(2)) + "</ul>"
        elif kind == "table":
            out += f"<table><tr><td>{inner()}</td></tr></table>"
        elif kind in ("hidden", "none"):
            out += f"<div {'hidden' if kind == 'hidden' else 'style=display:none'}>{inner(False)}</div>"
        elif kind == "script":
            out += "<script>if (a < b) { document.write('<b>w0</b>') }</script>"
        elif kind == "dialog":
            out += f"<dialog>{inner(False)}</dialog>"
        elif kind == "open":
            out += f"<details open><summary>{inner()}</summary>{inner()}</details>"
        elif kind == "closed":
            out += f"<details><summary>{inner()}</summary>{inner(False)}</details>"
        elif kind == "meter":
            out += "<meter>w1</meter>"
        else:
            word = f"w{r.randrange(10**6)}"
            words += [word, f"{word}o"] if seen else []
            out += f"<select><optgroup label={word}><option>{word}o</select>"
    return out


def test_pages_whose_visible_words_are_known():
    r = random.Random(8)
    for _ in range(300):
        words: list[str] = []
        page = made(r, 4, True, words)
        assert [w for w in render.page_text(page).replace("|", " ").split() if w != "-"] == words, page


def test_pages_of_many_tags_take_time_in_proportion():
    """Twice the page takes about twice the time, not four times."""
    for part in ("<b></i>", "<div><li>x", "<ul><li>x", "<p>x<div>", "<table><tr><td>x", "<dl><dt>a<dd>b"):
        took = []
        for n in (100_000, 400_000):
            began = time.process_time()
            render.page_text(part * (n // len(part)))
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5, (part, took)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<ol reversed><li>a<li>b<li value=9>c</ol>", "3. a\n2. b\n9. c"),
        ("<ol type=a start=27><li>x<li>y</ol><ol type=I><li>q<li type=i>r</ol>", "aa. x\nab. y\n\nI. q\nii. r"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<select><optgroup label=G><option>o</select>", "G\no"),
        ("a<meter>no</meter><progress>no</progress>b", "ab"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td rowspan=0003>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d<p>e</ul>after", "- a\n  - b\n  - c\n- d\n\n  e\n\nafter"),
    ],
)
def test_marks_and_visibility(page, text):
    assert render.page_text(page) == text


def test_rendered_tables(spark):
    d = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (2, None, "u")], "page_id bigint, html string, text string")
    got = render.rendered(d)
    assert got.columns == ["page_id", "html", "text", "text_"] and sorted((r.page_id, r["text_"]) for r in got.collect()) == [(1, "a"), (1, "a"), (2, None)]
    assert render.rendered(d.limit(0)).count() == 0


def test_winnowing_against_every_window():
    r = np.random.default_rng(1)
    for _ in range(200):
        kinds = r.integers(1, 4)
        words = r.integers(0, kinds, r.integers(0, 120)).astype(np.uint64)
        items = [(str(j), r.integers(0, kinds, r.integers(0, 60)).astype(np.uint64)) for j in range(4)] + [("own", words[5:35].copy())]
        hit, found = np.zeros(len(words), bool), set()
        for i, (_, item) in enumerate(items):
            n = min(10, len(item))
            windows = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)} if n else ()
            for p in range(len(words) - n + 1):
                if tuple(words[p : p + n]) in windows:
                    hit[p : p + n] = True
                    found.add(i)
        got = decontaminate.Index(items, 10, 5).marked(words)
        assert (got[0] == hit).all() and got[1] == found
    same = np.full(20_000, 7, np.uint64)
    assert decontaminate.Index([("x", same)], 10, 5).marked(same)[0].all()  # in well under a second


def test_packing_of_nothing(spark):
    got = packing.packed(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json"))
    assert got.count() == 0 and "sequence_id" in got.columns


def test_lines_of_nothing_and_of_a_very_long_text(spark):
    assert lines.deduplicated(spark.createDataFrame([], DOCS)).count() == 0
    own = [f"line {i} of the long one" for i in range(40_000)]
    d = spark.createDataFrame([(1, "\n".join(own[::2])), (2, "\n".join(own))], DOCS)
    got = {r.doc_id: r.line_dedup for r in lines.deduplicated(d).collect()}
    assert (got[1].n_dropped, got[2].n_lines, got[2].n_dropped) == (0, 40_000, 20_000)
    assert got[2].text == "\n".join(own[1::2])


def test_shards_of_nothing_and_beside_a_taken_name(spark):
    d = spark.createDataFrame([("a", 1)], "k string, placement int")
    got = sharding.sharded(d, "k", ["x", "y"], slots=11)
    assert got.columns[:2] == d.columns and len({c.lower() for c in got.columns}) == 3 and got.first()["placement"] == 1
    assert sharding.sharded(d.limit(0), "k", ["x", "y"], slots=11).count() == 0


def test_language_of_nothing_repeats_and_a_taken_name(spark):
    net = language.new_net(["a", "b"], 2)
    d = spark.createDataFrame([(1, "same words", 5), (1, "same words", 5), (2, "far " * 50_000, 6), (3, None, 7)], DOCS + ", language int")
    got = language.identified(d, net)
    new = [c for c in got.columns if c not in d.columns]
    rows = got.orderBy("doc_id").collect()
    assert len(new) == 1 and [r["language"] for r in rows] == [5, 5, 6, 7]
    assert rows[0][new[0]] == rows[1][new[0]] and all(0 <= r[new[0]].score <= 1 for r in rows) and rows[3][new[0]].lang == "und"
    assert language.identified(d.limit(0), net).count() == 0


def test_quality_of_nothing_repeats_and_a_taken_name(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 1), (2, 0), (3, None)], "doc_id bigint, quality int")
    docs = [(i, ("good clear prose " if i % 2 else "zxq zxq junk ") * 5) for i in range(1, 60)]
    model = quality.learn(spark.createDataFrame(docs, DOCS), labels)
    odd = [(1, "good clear prose", 9), (1, "good clear prose", 9), (2, "", 9), (3, None, 9), (4, "junk " * 100_000, 9)]
    d = spark.createDataFrame(odd, DOCS + ", quality_score int")
    got = quality.scored(d, model)
    new = [c for c in got.columns if c not in d.columns]
    rows = got.orderBy("doc_id").collect()
    assert len(new) == 1 and [r["quality_score"] for r in rows] == [9] * 5
    scores = [r[new[0]] for r in rows]
    assert scores[0] == scores[1] and scores[2] == scores[3] and all(0 <= x <= 1 for x in scores)
    assert scores[0] > scores[4]
    assert quality.scored(d.limit(0), model).count() == 0


def test_archives_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
