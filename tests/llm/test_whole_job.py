"""Places where operators once did less than the whole job."""

import collections

import duckdb
import numpy as np

from threadloom.llm import bpe, line_blocks, shingle_dedup, token_blocks, url_rules
from threadloom.llm import queries as q

DOCS = "doc_id long, text string"


def test_near_duplicates_against_brute_force_jaccard(spark, sf_dir):
    """Classes are those of all pairs whose five-word Jaccard similarity is 0.8 or more; SimHash at 4 bits missed most."""
    import corpus_pipeline

    path = f"{sf_dir}/../sf0.01"
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{path}/documents.parquet'").fetchall())
    words = " ".join(f"w{i}" for i in range(300))
    texts |= {10**6: words, 10**6 + 1: words.replace("w50 ", "x ").replace("w150 ", "y ").replace("w250 ", "z "), 10**6 + 2: "", 10**6 + 3: "  \n", 10**6 + 4: "two words"}
    bags, holders = {}, collections.defaultdict(list)
    for d, t in texts.items():
        w = t.encode().lower().split()
        bags[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        for g in bags[d]:
            holders[g].append(d)
    shared = collections.Counter((a, b) for own in holders.values() for a in own for b in own if a < b)
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if n / (len(bags[a]) + len(bags[b]) - n) >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    assert {r["doc_id"]: r["component_id"] for r in shingle_dedup.classes(docs).collect()} == {d: find(d) for d in texts}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, path).collect()}
    assert kept == {find(d) for d in texts} and 10**6 + 1 not in kept


def test_forest_of_a_bucket_against_all_pairs():
    """Graded copies of one text, whose components all exact pairs decide."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        change = rng.choice(150, int(rng.integers(0, 60)), replace=False)
        own[change] = rng.integers(0, 2**63, len(change)).astype(np.uint64)
        sets.append(np.unique(own))
    prints = np.array([shingle_dedup.fingerprint(s) for s in sets], dtype=np.int64).view(np.uint64)
    refs = rng.integers(0, 2**64, (24, 2), dtype=np.uint64)
    parent = list(range(120))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = {(i, j) for i in range(120) for j in range(i) if shingle_dedup.similarity(sets[i], sets[j]) >= 0.8}
    forest = shingle_dedup.forest_apart(np.arange(120), prints, sets, refs)
    assert {(max(e), min(e)) for e in forest} <= near
    for i, j in near:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    roots = [find(i) for i in range(120)]
    assert 1 < len(set(roots)) < 100 and len(forest) == 120 - len(set(roots))


def test_near_duplicates_with_odd_rows(spark):
    rows = [(3, None), (1, ""), (5, "same words here now"), (5, "same words here now"), (None, "same words here now"), (None, "alone"), (9, " \t\n ")]
    kept = shingle_dedup.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "5", "None"]
    assert shingle_dedup.keep_one(spark.createDataFrame([], DOCS)).collect() == []


def test_rules_of_the_common_label_and_of_many_tokens(spark):
    """A sure rule for the label of most pages (lift under 1.5) decides; so does one that needs five tokens."""
    urls, labels = [], []
    for i in range(400):
        urls.append(f"https://a.example.org/{'news/safe' if i % 4 else 'news'}/{'x' if i % 4 else 'y'}{i}")
        labels.append(0 if i % 4 == 0 or i % 8 == 1 else 1)
    for n in range(32):  # only all five words together are blocked
        for _ in range(60):
            urls.append("https://b.example.org/" + "/".join(f"t{b}" for b in range(5) if n >> b & 1) + f"/u{n}v{len(urls)}")
            labels.append(0 if n == 31 else 1)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = spark.createDataFrame([(i, q, 0) for i, q in enumerate(labels)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_rules.judge_pages(pages, known).collect()}
    assert got[2]["mined_rule"] and got[2]["verdict"] == "allow"
    assert all(got[400 + 60 * 31 + k]["verdict"] == "block" and len(got[400 + 60 * 31 + k]["mined_rule"]) >= 5 for k in range(60))
    assert all(got[400 + 60 * 15 + k]["verdict"] == "allow" for k in range(60))


def test_main_text_after_unclosed_asides():
    """What stands aside ends where its parent or its successor ends it, not only at a tag of its own name."""
    story = "A long paragraph of plain text that carries the story of this page for a good while, line upon line."
    for head in (
        '<p class="ad">Buy now', '<ul><li class="nav-item">a<li class="nav-item">b</ul>', '<div><p class="ad">Buy now</div>', '<dl><dt class="menu">a<dd class="menu">b</dl>',
        '<table><tr><td class="ad">x<tr><td class="ad">y</table>', '<div><span class="promo">z</div>', '<p class="ad">one<ul class="nav"><li>two<li>three</ul>',
    ):
        assert line_blocks.main_text(f"<body>{head}<article><p>{story}<p>{story}</article>") == f"{story}\n{story}", head
    assert line_blocks.main_text(f'<article><p class="ad">Buy now<p>{story}</article>') == story
    assert line_blocks.main_text(f'<article><div class="ad"><p>Buy<div>x</div><ul><li>now<li>here</ul></div><p>{story}</article>') == story
    assert line_blocks.main_text(f'<article><div class="ad"><b>Buy</p></b></li>now</div><p>{story}</article>') == story


def test_added_tokens_as_the_library_reads_them(spark):
    from tokenizers import Tokenizer

    path = q.public_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), bpe.ByteBPE(open(path, encoding="utf-8").read(), q.public_pattern())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n", "<|endoftext|", "plain  text ", " <|endoftext|> 漢", ""]
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.decode(ids).decode() == text
    got = token_blocks.token_files(spark.createDataFrame(list(enumerate(texts)), DOCS), path, q.public_pattern()).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_mined_rules_against_brute_force(spark):
    """Supports, confidences, pruning and verdicts recomputed over every subset of tokens."""
    from itertools import combinations
    from fractions import Fraction

    rng = np.random.default_rng(11)
    words, urls, bad = ("news", "shop", "deals", "blog", "x1"), [], []
    for i in range(900):
        own = [w for w in words if rng.random() < 0.45]
        urls.append(f"http://{'ab'[i % 2]}.example.org/{'/'.join([*own, str(i)])}")
        bad.append(int(rng.random() < (0.9 if {"shop", "deals"} <= set(own) else 0.5 if "blog" in own else 0.1)))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in enumerate(bad) if i % 3], "doc_id long, quality int, toxic int")
    tokens = {r["page_id"]: frozenset(r["t"]) for r in pages.select("page_id", url_rules.url_tokens(pages["url"]).alias("t")).collect()}
    count, with_label = collections.Counter(), collections.Counter()
    for i in (i for i in tokens if i % 3):
        for n in range(1, len(tokens[i]) + 1):
            for part in combinations(sorted(tokens[i]), n):
                count[part] += 1
                with_label[part, "block" if bad[i] else "allow"] += 1
    rules = {k: Fraction(n, count[k[0]]) for k, n in with_label.items() if n >= url_rules.MIN_ROWS and n / count[k[0]] >= url_rules.MIN_CONFIDENCE}
    kept = {k: c for k, c in rules.items() if not any(v == k[1] and len(s) < len(k[0]) and set(s) < set(k[0]) and d >= c for (s, v), d in rules.items())}
    got = {r["page_id"]: r for r in url_rules.judge_pages(pages, labels).collect()}
    assert len(kept) > 5 and {v for _, v in kept} == {"allow", "block"}
    for i, own in tokens.items():
        fits = [(c, len(s), v, list(s)) for (s, v), c in kept.items() if set(s) <= own]
        best = max(fits, default=None)
        assert (got[i]["verdict"], got[i]["mined_rule"]) == ((best[2], best[3]) if best else ("allow", None))


def test_leaks_in_a_text_of_many_words_take_bounded_memory():
    """A text of 1.5 million words with an item's shingle at each end, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, sys
from threadloom.llm import decontaminate
item = " ".join(f"w{i}" for i in range(40))
index = decontaminate.Index(((1, item),))
text = item + " " + "filler words here " * 500_000 + item
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = index.numbers(text)
got = index.search(ids)
assert got and got[0][:3] == (1, 0, 40) and got[0][4] == 1.0, got
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    print("MB over the text itself:", out.stdout)
    assert int(out.stdout) < 300


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "other words that stand alone here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = sorted(tuple(r) for r in shingle_dedup.keep_one(docs).collect())
    assert [r[0] for r in got] == [1, 2] and got[0][2] in "xy" and got[1][2] == "z"


def test_small_sets_are_decided_by_similarity_alone(spark):
    """Sets of four and five shingles differ in more than ``RADIUS`` bits now and then; none may be lost for that."""
    rng = np.random.default_rng(11)
    far = []
    while len(far) < 6:
        words = [f"{x:x}" for x in rng.integers(0, 1 << 40, 9)]
        a, b = " ".join(words), " ".join(words[:8])
        bits = [shingle_dedup.fingerprint(shingle_dedup.shingle_set(t)) for t in (a, b)]
        if sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(*bits)) > shingle_dedup.RADIUS:
            far.append((a, b))
    docs = spark.createDataFrame([(2 * i + k, t) for i, pair in enumerate(far) for k, t in enumerate(pair)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_dedup.classes(docs).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(far)))


def test_tiles_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(shingle_dedup, "TILE_BYTES", 4096)
    story = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(i, f"{story} end{i}") for i in range(30)] + [(99, "nothing like the others at all")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_dedup.classes(docs).collect()}
    assert {got[i] for i in range(30)} == {0} and got[99] == 99


def test_descent_enters_few_leaves_where_vectors_cluster():
    from threadloom.llm import ball_tree

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 16)) * 300
    rows = np.floor(centres[rng.integers(0, 100, 8000)] + rng.normal(size=(8000, 16)) * 20)
    queries, ids = rows[:80], np.arange(80)
    tree = ball_tree.BallTree(np.arange(8000), rows)
    scores, found = np.full((80, 5), -np.inf), np.full((80, 5), ball_tree.NO_ID)
    tree.search(ids, queries, scores, found)
    want = queries @ rows.T
    want[ids, ids] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(8000), want.shape), -want), axis=1)[:, :5]
    assert (found == order).all() and (scores == np.take_along_axis(want, order, 1)).all()
    print("leaves entered", tree.visited / (80 * len(tree.rows)), "nodes bounded", tree.bounded / (80 * (len(tree.rows) + len(tree.down))))
    assert tree.visited < 0.5 * 80 * len(tree.rows) and tree.bounded < 0.9 * 80 * (len(tree.rows) + len(tree.down))
