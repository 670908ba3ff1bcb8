"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import html
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import ball_tree, bpe, components, decontaminate, feistel_shards, line_blocks, simhash_dedup, token_blocks, toxicity, url_rules, warc_archive
from threadloom.llm import queries as q

LONG = "the quick brown fox jumps over a lazy dog and " * 20_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, fp string, total double, ids binary"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, 7, "x", 1.5, None) for i, t in rows], DOCS)


ROWS = [(3, None), (1, ""), (2, LONG), (5, "same words here now"), (5, "same words here now"), (None, "same words here now"), (9, "  \t\n "), (8, "naïve 漢字 🙂́ x")]


def test_token_files(spark):
    path, pattern = q.public_path("byte_bpe_50k.json"), q.public_pattern()
    got = token_blocks.token_files(docs(spark, ROWS), path, pattern).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 5, 5, 8, 9]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert {r["doc_id"]: r["n_tokens"] for r in got}[1] == 1
    assert token_blocks.token_files(docs(spark, []), path, pattern).collect() == []


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_block_file_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 300, n).astype(np.uint32)
    ids[rng.random(n) < 0.03] = 2**32 - 1
    lengths = np.array([n // 2, 0, n - n // 2], dtype=np.uint64)
    data = token_blocks.encode_blocks(np.array([4, 5, 6]), lengths, ids)
    keys, back, out = token_blocks.decode_blocks(data)
    assert keys.tolist() == [4, 5, 6] and back.tolist() == lengths.tolist() and (out == ids).all()
    for b in range(-(-n // 128)):
        assert (token_blocks.read_block(data, b) == ids[128 * b : 128 * b + 128]).all()


def test_bpe_offsets_of_split_characters():
    enc = bpe.ByteBPE(q.multilingual_bpe(), q.public_pattern())
    text = "naïve 漢字🙂 ́end  of\n\n it"
    ids = np.frombuffer(enc.encode(text), "<u4")
    assert enc.decode(ids).decode() == text
    spans = enc.offsets(ids)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and (np.diff(spans[:, 0]) >= 0).all()
    for i, (a, b) in zip(ids, spans):
        assert enc.token_bytes[i] in text[a:b].encode()


def test_bpe_rows(spark):
    got = bpe.encode_documents(docs(spark, ROWS), q.multilingual_bpe(), q.public_pattern(), with_offsets=True).collect()
    assert sorted(bytes(r["decoded"]) for r in got) == sorted((t or "").encode() for _, t in ROWS)
    assert bpe.encode_digests(docs(spark, []), q.multilingual_bpe(), q.public_pattern()).collect() == []


def test_toxicity_folding_and_exceptions(spark):
    m = toxicity.Matcher({("idiot", True): 5.0, ("clow", False): 3.0})
    assert m.weigh("an IDIOT")[0] == m.weigh("an 1d10t")[0] == m.weigh("an іdі​оt")[0] == 5.0
    assert m.weigh("idiots")[0] == 0 and m.weigh("clowns")[0] == 3.0
    assert m.weigh("a clown fish")[0] == 0 and m.weigh("")[0] == 0
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(60)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    own = docs(spark, [(i, ("zorg " if i % 2 else "plain ") + f"w{i}") for i in range(60)] + ROWS[:4])
    got = toxicity.score_documents(own, toxicity.fit(own, labels)).collect()
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got[:60])
    none = toxicity.fit(own, labels.limit(0))
    assert none[0] == {} and len({r["score"] for r in toxicity.score_documents(own, none).collect()}) == 1
    assert toxicity.keep_clean(own, toxicity.fit(own, labels)).count() == 34


def test_main_text():
    page = """<html><body><header>Site</header><nav><a href=x>Home</a></nav><div class="cookie notice">We use cookies</div>
    <main><h1>Title &amp; more</h1><p>First   <b>bold</b>
    text.</p><div class="comments"><p>Great!</p></div><ul><li>one</li><li>two</li></ul><form><p>mail</p></form></main><aside>ads</aside><footer>&copy; x</footer></body></html>"""
    assert line_blocks.main_text(page) == "Title & more\nFirst bold text.\none\ntwo"
    assert line_blocks.main_text(None) == line_blocks.main_text("") == ""
    body = "A long paragraph of plain text that carries the story of this page for a good while, line upon line."
    bare = f"<a href=a>Menu</a><div><a href=b>More</a></div><p>{body}</p><p>short</p><p>{body}</p><div><a href=c>Next</a></div>"
    assert line_blocks.main_text(bare) == f"{body}\nshort\n{body}"
    assert html.unescape("&lt;") in line_blocks.main_text(f"<article><p>{body} &lt;</p><p>never closed")


def test_pages_of_every_kind(spark):
    """Empty table, nulls, repeats, clashing columns, and broken pages of a megabyte in time that grows with their size."""
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>" + "words " * 40, None), (3, "u", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = line_blocks.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r["page_id"]), len(r["text"]), r["n_chars"]) for r in got.collect()) == [("1", 0, 0), ("1", 0, 0), ("3", 0, 0), ("None", 239, 239)]
    assert line_blocks.extract_pages(pages.limit(0)).collect() == []
    for unit in ('<a "', '<a ">"', "<script>x ", "<!--", "<", "<nav>", '<p class="ad">x', "<a '\">", "&", "</a ", "<li>", "<b></i>"):
        started = time.process_time()
        line_blocks.main_text(unit * (1_000_000 // len(unit)))
        assert time.process_time() - started < 15, unit


def test_broken_markup_loses_no_text():
    story = "Real text that goes on for a good while, so that it is long enough to count as the story of a page, truly."
    for page, want in (
        (f'<article><h1>T</h1><p class="ad">Buy<p>{story}<p>More', f"T\n{story}\nMore"), (f"<nav><a href=x>Home</a><article><p>{story}</article>", story),
        (f'<article><p class="share-price">{story}</p></article>', story), (f"<main><p>{story}</main><p>{story} outside</p>", f"{story}\n{story} outside"),
        (f"<p>{story}<script>var x = 1;", story), (f"<html><head><title>t</title><body><p>{story}", story), (f"<p>{story} 1 < 2 <3", f"{story} 1 < 2 <3"),
    ):
        assert line_blocks.main_text(page) == want


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, "only four words here", 0), (None, item, 0)], "item_id long, text string, key int")
    edited = item.replace("twenty", "last")
    found = decontaminate.find_leaks(docs(spark, [*ROWS, (20, f"{LONG} {item.upper()}! {LONG}"), (21, f"so {edited} it"), (22, "Only four; words here"), (23, item.replace("ten", "x"))]), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(20, 1), (20, None), (21, 1), (21, None), (22, 4)}
    assert decontaminate.find_leaks(docs(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(docs(spark, ROWS), bench.limit(0)).count() == 0
    kept = decontaminate.keep_free(docs(spark, [*ROWS, (20, item)]), bench)
    assert kept.columns == docs(spark, []).columns and kept.count() == len(ROWS)


def test_simhash_classes(spark):
    got = simhash_dedup.classes(docs(spark, ROWS)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["component_id"]].append(r["doc_id"])
    assert sorted(by[1]) == [1, 3, 9] and by[2] == [2] and sorted(by[5], key=str) == [5, 5, None] and by[8] == [8]
    assert simhash_dedup.classes(docs(spark, [])).collect() == []
    kept = simhash_dedup.keep_one(docs(spark, ROWS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 8] and kept.columns == docs(spark, []).columns


@pytest.mark.parametrize("tile", [8, 4096])
def test_links_of_a_dense_group(spark, monkeypatch, tile):
    """Tiles of a hot bucket must lose no link: chains and a dense ball, against all pairs."""
    monkeypatch.setattr(simhash_dedup, "TILE", tile)
    rng = np.random.default_rng(5)
    base = int(rng.integers(1, 2**62))
    prints = {base}
    for _ in range(120):
        x = base
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints |= {int(x) for x in rng.integers(0, 2**62, 80)}
    signed = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    links = simhash_dedup.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"))
    root = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {p: root.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_long_chain_of_links(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 1999), (1999, 2000)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1999: 1999, 2000: 1999}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_archive(spark):
    rows = [(1, "http://a/\r\nX: y", "same", 0), (2, None, "same", 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", LONG, 0), (2, None, "same", 0), (None, "u", "same", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha256 int")
    got = warc_archive.archive_pages(pages).collect()
    assert len(got) == 7 and all(r["payload_digest"] == r["header_digest"] for r in got)
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == sorted([("1", "response", None), ("2", "revisit", 1), ("2", "revisit", 1), ("3", "response", None), ("4", "revisit", 3), ("5", "response", None), ("None", "revisit", 1)])
    digest = {r["page_id"]: r["payload_digest"] for r in got}
    assert digest[5] == base64.b32encode(hashlib.sha1(LONG.encode()).digest()).decode()
    assert all(r["record_type"] == "response" for r in warc_archive.archive_pages(pages, 10**9).collect())
    assert warc_archive.archive_pages(pages.limit(0)).collect() == []


def test_record_ids_and_addresses(spark, tmp_path):
    """Repeated rows and null ids have ids of their own; an address keeps what it holds, a null one gives no line."""
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "p"), (1, "http://a/\r\nX: y", "p"), (None, None, "p"), (None, "", "p"), (-7, "u", "q")], "page_id long, url string, html string")
    warc_archive.write_archive(pages, f"file://{tmp_path}/b")
    heads = [bytes(r["header"]).decode() for r in warc_archive.read_archive(spark, f"file://{tmp_path}/b").collect()]
    assert len({h.partition("WARC-Record-ID: ")[2].partition("\r\n")[0] for h in heads}) == 5
    assert sum("WARC-Target-URI: http://a/%0D%0AX: y\r\n" in h for h in heads) == 2 and sum("WARC-Target-URI" not in h for h in heads) == 1
    assert all(h.startswith("WARC/1.1\r\n") and h.endswith("\r\n\r\n") and "\n\n" not in h for h in heads)


def test_records_are_exact(spark, tmp_path):
    warc_archive.write_archive(spark.createDataFrame([(1, "http://a/", "héllo"), (2, "http://b/", "héllo")], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    raw = {r["page_id"]: bytes(r["record"]) for r in warc_archive.record_bytes(warc_archive.read_archive(spark, f"file://{tmp_path}/a")).collect()}
    assert raw[1].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw[1].endswith(b"Content-Length: 6\r\n\r\n" + "héllo".encode() + b"\r\n\r\n")
    assert b"WARC-Refers-To: <urn:threadloom:" in raw[2] and b":page:1:" in raw[2].partition(b"WARC-Refers-To")[2] and raw[2].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")


def test_mined_url_rules(spark):
    """A planted combination of tokens is found, and only where all of its tokens stand."""
    urls = [f"https://shop{i % 7}.example.org/{'deals' if i % 4 == 0 else 'news'}/{i}?ref={i}" for i in range(400)]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(900, None, None), (901, "no scheme", None), (902, "http://", None), (903, "http://h.example.org/deals/1", None)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)] + [(None, 0, 0), (900, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.judge_pages(pages, labels).collect()}
    assert len(got) == 404
    assert all(got[i]["verdict"] == ("block" if i % 4 == 0 else "allow") for i in range(400)) and got[903]["verdict"] == "block"
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (900, 901, 902)] == [("", "", None, "allow")] * 3
    assert {r["verdict"] for r in url_rules.judge_pages(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}
    assert url_rules.judge_pages(pages.limit(0), labels).collect() == []


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=6).tolist() if i % 3 else [0.25] * 6) for i in range(400)]
    bad = [(500, None), (550, []), (600, [float("nan")] * 6), (650, [None] * 6), (700, [float("inf")] * 6), (750, [1.0, 2.0]), (None, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in data + bad], "vec_id long, embedding array<float>, v int")
    got = ball_tree.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=64, query_rows=3).orderBy("query_id", "rank").collect()
    x = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)) for i, v in data}
    want = [(a, r + 1, b, int(s)) for a in x if a % 50 == 0 for r, (s, b) in enumerate(sorted(((x[a] @ x[b], b) for b in x if b != a), key=lambda t: (-t[0], t[1]))[:5])]
    assert [tuple(r) for r in got] == want
    assert ball_tree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 24, 47, 1000])
def test_feistel_is_a_permutation(spark, n):
    ids = spark.range(n).withColumn("once", feistel_shards.feistel(F.col("id"), n))
    assert sorted(r[0] for r in ids.select(feistel_shards.walked(F.col("once"), n)).collect()) == list(range(n))


def test_shards(spark):
    got = feistel_shards.shard_documents(docs(spark, ROWS), 3).collect()
    assert sorted(collections.Counter(r["shard"] for r in got).values()) == [2, 3, 3]
    for s in range(3):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in ROWS)
    assert feistel_shards.shard_documents(docs(spark, [])).collect() == []


STORY = "A long paragraph that carries on for a good while so that it is surely over the threshold of the windows, is it not?"


@pytest.mark.parametrize(("page", "want"), [
    (f'<p class="notice-of-motion">{STORY}</p>', STORY),
    (f'<div class="search-results alert"><p>{STORY}</p></div>', STORY),
    (f'<div class="ad">{STORY}</div><article><p>short</p></article>', "short"),
    (f"<div><article><p>{STORY}</div><div><a>Link one</a> <a>Link two</a></div>", STORY),
    (f"<article><p>&am<b>p;</b> {STORY}</p></article>", f"&amp; {STORY}"),
    ("<div>" * 250 + f"<nav>menu one</nav><p>{STORY}</p>", STORY),
    (f"<div>Home</div><div>About</div><div>Press</div><p>{STORY}</p><p>yes</p><p>{STORY}</p><div>Imprint</div><div>2020</div>", f"{STORY}\nyes\n{STORY}"),
    (f'<article><h1>Hi</h1><div class="ad">x</div><div class="ad">y</div><div class="ad">z</div><p>{STORY}</p><p>end</p></article>', f"Hi\n{STORY}\nend"),
    (f"<p>{STORY} <span class=ad>buy</span> on</p>", f"{STORY} on"),
])
def test_main_text_between_surge_and_dive(page, want):
    assert line_blocks.main_text(page) == want


def test_windows_decide_on_every_given_page(spark, sf_dir):
    """What surge and dive leave out of the lines that markup gives: some on each page."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    lines = [line_blocks.page_lines(p) for p in pages]
    decided = sum(len(line_blocks.kept_lines(x)) < len(x) for x in lines)
    print("pages on which windows decided:", decided, "of", len(pages))
    assert decided == len(pages)


def test_deep_pages_take_time_in_proportion():
    for unit in ("<div>", "<li><b><i>", "<table><tr><td>"):
        began = time.time()
        line_blocks.main_text(unit * 60_000 + "x" + "</div>" * 60_000)
        assert time.time() - began < 20
