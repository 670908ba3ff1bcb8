"""Every operator's query against a plain computation over the same table."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest

from threadloom.llm import queries as q


def rows(sf_dir, sql):
    return duckdb.sql(sql.replace("$", f"{sf_dir}/")).fetchall()


@pytest.fixture(scope="session")
def documents(sf_dir):
    return dict(rows(sf_dir, "select doc_id, coalesce(text, '') from '$documents.parquet'"))


def test_op1_files_hold_the_ids_in_order(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(q.public_path("byte_bpe_50k.json"))
    at, want = 0, []
    for d in sorted(documents):
        ids = t.encode(documents[d], add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = sorted(tuple(r) for r in q.op1_token_blocks(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want


def test_op2_finds_held_out_toxic_rows(spark, sf_dir):
    labels = dict(rows(sf_dir, "select doc_id, toxic from '$../sf0.1/labels.parquet'"))
    got = {r["doc_id"]: r for r in q.op2_toxicity(spark, f"{sf_dir}/../sf0.1").collect()}
    assert len(got) == rows(sf_dir, "select count(*) from '$../sf0.1/documents.parquet'")[0][0]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [(labels[d], r["score"], r["predicted"]) for d, r in got.items() if r["held_out"] and d in labels]
    pos, neg = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    recall, wrong = np.mean([p for y, _, p in held if y]), np.mean([p for y, _, p in held if not y])
    print("auc", auc, "recall", recall, "false alarms", wrong)
    assert auc > 0.95 and recall > 0.9 and wrong < 0.03
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_op3_keeps_the_article(spark, sf_dir, documents):
    """Pages are made from documents: the number in the URL is the document, its lines are the paragraphs."""
    heads = dict(rows(sf_dir, "select page_id, regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1) from '$pages.parquet'"))
    for r in q.op3_main_text(spark, sf_dir).collect():
        number = int(re.search(r"/(\d+)", r["url"].split("://", 1)[1])[1])
        lines = [" ".join(x.split()) for x in documents[number].split("\n")]
        assert r["text"].split("\n") == [" ".join(html.unescape(heads[r["page_id"]]).split()), *(x for x in lines if x)]
        assert r["n_chars"] == len(r["text"])


def brute_leaks(documents, items):
    """(document, item) -> (similarity, first word, words) of the best window."""
    word = re.compile(r"[^\W_]+")
    items = {i: word.findall(t.lower()) for i, t in items}
    want = {}
    bags = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, w in items.items()}
    for d, t in documents.items():
        w = word.findall(t.lower())
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = set(grams)
        for i, bag in bags.items():
            if seen & set(bag):
                m = len(items[i]) - 4
                for k in range(len(grams) - m + 1):
                    own = collections.Counter(grams[k : k + m])
                    shared = sum((own & bag).values())
                    similarity = shared / (sum(own.values()) + sum(bag.values()) - shared)
                    if similarity >= 0.8 and similarity > want.get((d, i), (0,))[0]:
                        want[d, i] = (similarity, k, len(items[i]))
    return want


def test_op4_against_all_windows(spark, sf_dir, documents):
    want = brute_leaks(documents, rows(sf_dir, "select item_id, text from '$benchmark.parquet'"))
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"], r["n_words"]) for r in q.op4_decontamination(spark, sf_dir).collect()}
    assert got == want and want


def test_op4_finds_edited_passages(spark, sf_dir):
    """Items of 15 to 150 words with one to four words changed, amid other words: nothing of similarity 0.8 is missed."""
    rng = np.random.default_rng(8)
    pool = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(pool, int(rng.integers(15, 150))))) for i in range(60)]
    texts = {}
    for d in range(400):
        words = items[int(rng.integers(0, 60))][1].split()
        for at in rng.choice(len(words), int(rng.integers(1, 5)), replace=False):
            words[at] = f"x{d}"
        texts[d] = " ".join([*rng.choice(pool, 20), *words, *rng.choice(pool, 20)])
    from threadloom.llm import decontaminate

    got = decontaminate.find_leaks(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = brute_leaks(texts, items)
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"], r["n_words"]) for r in got.collect()} == want and len(want) > 100


def test_op5_as_tiktoken(spark, sf_dir, documents):
    import public_tokenizers
    import tiktoken

    from threadloom.llm.bpe import read_ranks

    ranks = read_ranks(q.public_path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in q.op5_byte_bpe(spark, sf_dir).collect()}
    assert got.keys() == documents.keys()
    for d, text in documents.items():
        ids = encoding.encode_ordinary(text)
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def test_op6_classes_of_all_pairs(spark, sf_dir, documents):
    prints = {d: brute_fingerprint(t) for d, t in documents.items()}
    roots = brute_components(prints)
    got = sorted(tuple(r) for r in q.op6_simhash_classes(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect())
    assert got == sorted((d, f"{p:016x}", roots[d]) for d, p in prints.items())
    assert len(set(roots.values())) < len(roots)


def run_oracle(sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(q.ORACLE_SQL[name])
    return [d[0] for d in rel.description], rel.fetchall()


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, sf_dir, name):
    columns, want = run_oracle(sf_dir, name)
    got = q.QUERIES[name](spark, sf_dir)
    assert set(got.columns) == set(columns)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == sorted(want, key=key)


def test_op8_prefix_rules(spark, sf_dir):
    urls = dict(rows(sf_dir, "select page_id, url from '$pages.parquet'"))
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    got = {r["page_id"]: r for r in q.op8_url_rules(spark, sf_dir).collect()}
    assert got.keys() == urls.keys()
    for p, url in urls.items():
        rest = url.partition("://")[2]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.lower()
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[p]["host"], got[p]["path"]) == (host, path)
        assert got[p]["rule"] == (best and best[0] + best[1])
        assert got[p]["verdict"] in ("allow", "block") and (not best or got[p]["verdict"] == best[2])


def test_op10_rows_law(spark, sf_dir, documents):
    got = q.op10_feistel_shards(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == documents.keys() and len(got) == len(documents)
    slots = collections.defaultdict(list)
    for r in got:
        raw = documents[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_pipeline_against_its_stages(spark, sf_dir, documents):
    """Near-duplicates (five-word Jaccard similarity), decontamination and encoding by brute force over what the
    toxicity stage keeps."""
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from threadloom.llm.bpe import read_ranks

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"]: r["text"] or "" for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).collect()}
    bags = {}
    for d, t in kept.items():
        w = t.encode().lower().split()
        bags[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    parent = {d: d for d in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    unique = {d: kept[d] for d in kept if find(d) == d}
    leaks = {d for d, _ in brute_leaks(unique, rows(sf_dir, "select item_id, text from '$benchmark.parquet'"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(q.public_path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = set()
    for d in unique.keys() - leaks:
        ids = encoding.encode_ordinary(unique[d])
        want.add((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(unique[d].encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) < len(unique) < len(kept)


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty and very long texts, an empty benchmark and an empty table."""
    import corpus_pipeline

    base = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [(1, None), (2, ""), (3, "alone here"), (3, "alone here"), (None, "no id at all"), (4, "long words " * 300_000), (5, " ".join(f"w{i}" for i in range(50_000)))]
    for name, own in (("a", texts), ("b", [])):
        at = f"file://{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, None, None) for i, t in own], base).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, at).collect()}
        assert sorted(got, key=str) == ([1, 3, 4, 5, None] if own else [])
        assert not own or (got[1]["n_tokens"] == 0 and got[4]["decoded_sha256"] == hashlib.sha256(texts[5][1].encode()).hexdigest())


def test_matching_against_a_plain_scan(documents):
    """The automaton's hits are those of asking every word for every entry and every phrase."""
    from threadloom.llm import toxicity

    vocabulary = sorted({w for t in documents.values() for w in toxicity._WORD.findall(toxicity.fold(t))}, key=lambda w: zlib.crc32(w.encode()))
    lexicon = toxicity.Lexicon({(w, True): 1.0 + len(w) for w in vocabulary[:300]} | {(w[:4], False): 2.0 for w in vocabulary[300:400] if len(w) > 4})
    some = [" ".join(p) for t in list(documents.values())[:20] for p in zip(t.split(), t.split()[1:])]
    matcher = toxicity.Matcher(lexicon, some[::7])
    phrases = {toxicity.fold(p) for p in some[::7]}
    for text in documents.values():
        folded, want = toxicity.fold(text), {}
        starts = [k for k in range(len(folded)) if folded[k].isalpha() and not (k and folded[k - 1].isalpha())]
        for k in starts:
            end = k
            while end < len(folded) and folded[end].isalpha():
                end += 1
            word = folded[k:end]
            weight = max([lexicon.get((word, True), 0.0), *(lexicon.get((word[:n], False), 0.0) for n in range(1, len(word) + 1))])
            if weight:
                want[k] = weight
        for p in phrases:
            at = folded.find(p)
            while at >= 0:
                end = at + len(p)
                if not (at and folded[at - 1].isalpha()) and not (end < len(folded) and folded[end].isalpha()):
                    for k in range(at, end):
                        want.pop(k, None)
                at = folded.find(p, at + 1)
        assert matcher.hits(folded) == want


def test_learned_exceptions(spark):
    """A phrase around an entry that only clean texts hold is no hit."""
    from threadloom.llm import toxicity

    rows = [(i, f"you zorgle thing {i}", 1) for i in range(200)] + [(1000 + i, f"plain words number {i}", 0) for i in range(6000)] + [(9000 + i, f"the zorgle bird flies {i}", 0) for i in range(4)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    lexicon, curve = toxicity.fit(docs, labels)
    assert {"the zorgle", "zorgle bird"} <= lexicon.exceptions and "you zorgle" not in lexicon.exceptions
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, (lexicon, curve)).collect()}
    assert all(got[i] == 0 for i in range(9000, 9004)) and all(got[i] == 1 for i in range(200))
