"""The training-data operators against brute force on small fixtures, and their edge cases."""

import collections
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, decontaminate, html_text, line_dedup, minhash, packing, pieces, quality, suffix, token_counts, url_filter
from tidemark.llm.components import components
from tidemark.llm.queries import URL_RULES, tokenizer_path

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string"
#: Nulls, empty and short texts, ties, repeated rows, a long text.
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (None, "no id here at all"), (6, "a b c"), (6, "a b c"), (7, "x" * 70000), (8, "é ü 漢字 <|endoftext|> it's"), (9, "a\nb\n\na")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, i, "clash", "s") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, row long, key string, source string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS + ", source string, row long, key string")


# --- pieces, token counts, packing ----------------------------------------------------------


def test_pieces_equal_the_library():
    e = pieces.PieceEncoder(tokenizer_path())
    rng = random.Random(1)
    alphabet = list("ab1 .,'\n\t stlrvd<|") + ["é", "²", " ", "　", "<|endoftext|>", "漢", "ß", "_", "\x1c", "Ᲊ", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [e.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(x) for x in e.encode(texts)] == want
    assert list(e.encode(texts, ids=False)) == [len(w) for w in want]


def test_token_counts_and_cache(spark, edge, empty, tmp_path):
    e = pieces.PieceEncoder(tokenizer_path())
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time from the cache
        got = token_counts.count_tokens(edge, tokenizer_path(), cache).collect()
        assert len(got) == len(EDGE)
        want = collections.Counter((i, len((t or "").encode()), len(e.library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE)
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    version = token_counts.version_digest(tokenizer_path())
    assert token_counts.read_cache(spark, cache, version).count() == len({t or "" for _, t in EDGE})
    assert token_counts.count_tokens(empty, tokenizer_path(), str(tmp_path / "none")).count() == 0


def test_token_counts_with_sentencepiece(edge):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    assert sorted(r.n_tokens for r in token_counts.count_tokens(edge, path).collect()) == sorted(len(m.encode(t or "")) for _, t in EDGE)


def check_packing(rows, texts, capacity):
    e = pieces.PieceEncoder(tokenizer_path())
    ids = {i: np.append(np.array(e.library.encode(t or "", add_special_tokens=False).ids, "<u4"), 2).astype("<u4") for i, t in texts}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[i])
        at = 0
        for k, r in enumerate(own):
            assert r.start == at and (len(own) == 1 or k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_packing(spark, empty):
    rng = random.Random(2)
    texts = [(i, text(rng, rng.randint(0, 120))) for i in range(150)] + [(200, None), (201, ""), (202, text(rng, 900))]
    rows = packing.pack(spark.createDataFrame(texts, DOCS), tokenizer_path(), capacity=128).collect()
    n = check_packing(rows, texts, 128)
    assert n <= 1.02 * sum(r.length for r in rows) / 128 + 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_fullest_is_optimal():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        cap = rng.randint(max(counts), 60)
        got = packing.fullest(counts, cap)
        reach = {max(counts)}
        left = dict(counts)
        left[max(counts)] -= 1
        for k, n in left.items():
            for _ in range(n):
                reach |= {x + k for x in reach if x + k <= cap}
        assert sum(k * m for k, m in got.items()) == max(reach) and all(m <= counts[k] for k, m in got.items())


# --- lines, urls ------------------------------------------------------------------------------


def test_lines(spark, edge, empty):
    rows = [(i, f"menu\nbody {i}\n\nmenu", "a") for i in range(20)] + [(100 + i, f"menu\nown {i}", "b") for i in range(4)] + [(200, None, "a"), (201, "menu", None)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOCS + ", source string")).collect()}
    assert got[3].text == "body 3\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[101].text == "menu\nown 1" and got[200].text is None and got[200].n_lines == 0 and got[201].text == "menu"
    out = line_dedup.drop_boilerplate(edge)
    assert out.columns == edge.columns + ["n_lines", "n_dropped"] and out.count() == len(EDGE)
    assert line_dedup.drop_boilerplate(empty).count() == 0


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fit = [(len(h), len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[2:] if fit else (None, "allow"))


def test_urls(spark, empty):
    urls = [None, "", "nothing", "http://", "http://com/", "http://com", "HTTP://WWW.Example.COM/en/x?y", "https://a.example.com/en/1#z", "http://example.com/fr/", "http://xexample.com/en/", "https://b.net/es/q", "https://net/fr/", "http://b.net/en/", "http://É.com/ü", "http://a..com//", "http://a.com?x/en/", "http://a.com/\nb"]
    rng = random.Random(4)
    urls += ["http://" + ".".join(rng.choice(["www", "example", "com", "net", "org", "a"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/es/1", "/fr/", "?q"]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, URL_RULES).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0
    few = {r.page_id: r.rule for r in url_filter.judge(df.limit(40), URL_RULES, segments=3).collect()}
    assert few == {i: judged(u)[2] for i, u in enumerate(urls[:40])}


# --- near-duplicates --------------------------------------------------------------------------


def brute_groups(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        before = dict(label)
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    label[a] = min(label[a], label[b])
        if before == label:
            break
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_rows():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(3, 120))]
        for c in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(c % 4):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, None), (901, ""), (902, "A b"), (903, "a  B"), (904, "a b c")]


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows()
    df = spark.createDataFrame(rows, DOCS).withColumn("rep", F.lit("clash"))
    got = {r.doc_id: r for r in minhash.link_groups(df, k=4).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_groups(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_without_filters(spark, edge, empty, monkeypatch):
    monkeypatch.setattr(url_filter, "SENT_BYTES", 8)
    got = minhash.link_groups(edge, k=4).collect()
    assert len(got) == len(EDGE) and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert minhash.keep_one(edge).columns == edge.columns and minhash.keep_one(edge).filter("doc_id = 5").count() == 0
    assert minhash.link_groups(empty).count() == 0


def test_one_row_of_each_group_stays(spark, empty):
    rng = random.Random(15)
    base = text(rng, 60)
    near, other = base + " more", text(rng, 60)
    rows = [(5, base, 1), (5, base, 1), (5, other, 2), (7, near, 3), (None, base, 4), (None, near, 5), (9, None, 6), (9, None, 6), (None, "", 7), (11, "few words", 8), (None, "few words", 9), (None, "only without an id", 10), (None, "only without an id", 11)]
    df = spark.createDataFrame(rows, DOCS + ", words long").withColumns({c: F.lit(c) for c in ("digest", "best", "rep", "__row")})
    out = minhash.keep_one(df)
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=repr)
    assert out.columns == df.columns
    assert got == sorted([(5, base), (5, other), (9, None), (9, None), (0, ""), (11, "few words"), (0, "only without an id")], key=repr)
    groups = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.link_groups(df).collect()}
    assert groups[7, 57] == 5 and groups[None, 56] == 5 and groups[None, 57] == 5 and groups[9, 0] == 9
    assert minhash.keep_one(empty).count() == 0


def test_join_of_heavy_keys(spark):
    from tidemark.llm import store

    rows = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 3), (3, 1), (4, 1)) for i in range(n)], "k int, i int")
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k < 4").withColumn("v", F.col("k") * 10)
    got = store.join_facts(rows, facts, ["k"], "n", 505)
    assert {(r.k, r.v): r["count"] for r in got.groupBy("k", "v").count().collect()} == {(1, 10): 500, (2, 20): 3, (3, 30): 1}


def test_pigeonhole():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(minhash.SYMBOLS, minhash.MAX_DISTANCE, replace=False)] += 1
    assert all(set(x) & set(y) for x, y in zip(minhash.chunk_keys(a), minhash.chunk_keys(b)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated strings -------------------------------------------------------------------------


def brute_removed(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for (doc, _), t in zip(rows, texts):
        cut = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                cut[i : i + n] = True
        edges = np.diff(np.concatenate([[0], cut.astype(int), [0]]))
        kept = bytes(np.frombuffer(t, np.uint8)[~cut])
        out.append((doc, len(t), int(cut.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,filters", [(5000, 10**7), (7, 8)])
def test_repeats(spark, monkeypatch, shard, filters):
    monkeypatch.setattr(suffix, "SHARD_CONTEXTS", shard)
    monkeypatch.setattr(suffix, "MERGE_STRINGS", 10 * shard)
    monkeypatch.setattr(url_filter, "SENT_BYTES", filters)
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefgh ") for _ in range(330))
    fill = lambda: "".join(rng.choice("xyzuv ") for _ in range(rng.randint(0, 150)))
    rows = [(i, fill() + base[k : k + rng.randint(150, 300)] + fill()) for i in range(40) for k in [rng.randint(0, 100)]]
    rows += [(100, None), (101, ""), (102, "aé" * 400), (103, "q" * 199), (104, "q" * 200), (105, "r" * 450), (106, rows[0][1]), (None, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1))
    got = sorted(map(tuple, suffix.remove_repeats(df).drop("kept").collect()), key=repr)
    assert got == brute_removed(rows, 200)


def test_suffix_arrays():
    rng = random.Random(8)
    for trial in range(40):
        contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 10))]
        contexts += [contexts[0], b"a" * 40] if trial % 3 == 0 else []
        n = rng.choice([5, 9])
        starts, repeated, _ = suffix.repeats(contexts, n)
        seen = collections.Counter(c[i : i + n] for c in contexts for i in range(len(c) - n + 1))
        for s, c in zip(starts, contexts):
            assert [bool(x) for x in repeated[s : s + len(c)]] == [len(c) - i >= n and seen[c[i : i + n]] > 1 for i in range(len(c))]


def common_line_rows(n, seed=14):
    """Texts around one line that is shorter than 200 bytes, every third in pairs that repeat half of what is around it."""
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    line, around = "Z" + some(60) + "Z", [(some(230), some(230)) for _ in range(n)]
    left = lambda i: around[i - 3 if i % 6 == 3 else i][0]
    return [(i, left(i) + line + around[i][1]) for i in range(n)]


def test_common_anchor_counts_contexts_not_strings(spark, monkeypatch):
    """What a very common anchor's contexts make is a few rows a context, not a row for each string of each."""
    monkeypatch.setattr(suffix, "SHARD_CONTEXTS", 7)
    made, write = collections.Counter(), suffix.store.materialise

    def told(df, name):
        out = write(df, name)
        made[name] += out.count()
        return out

    monkeypatch.setattr(suffix.store, "materialise", told)
    rows = common_line_rows(60)
    got = sorted(map(tuple, suffix.remove_repeats(spark.createDataFrame(rows, DOCS)).drop("kept").collect()), key=repr)
    assert got == brute_removed(rows, 200) and sum(r[2] > 0 for r in got) >= 15
    assert made["kinds"] >= 30 and 0 < made["found"] + made["again"] <= 3 * made["kinds"] and made["cut"] <= 6 * made["kinds"], made


@pytest.mark.parametrize("width", suffix._widths(200))
def test_cells_keep_every_start(width):
    rng = random.Random(15)
    text = bytes(rng.choice(b"ab") for _ in range(900)) + b"c" * 300
    found = suffix.runs(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 200)
    cols = [pa.array(c.astype(np.int32)) for c in found[1:3]] + [pa.array(c.view(np.int64)) for c in found[3:]]
    n = len(cols[0])
    raw = [text[a : b + 199] for a, b in zip(cols[0].to_pylist(), cols[1].to_pylist())]
    one = pa.array(np.ones(n, np.int64))
    names = ["doc", "row", "start", "stop", "anchor", "context", "n", "bytes"]
    contexts = pa.RecordBatch.from_arrays([one, one, *cols, one, pa.array(raw, pa.binary())], names)
    (placed,) = suffix._placed(200)([contexts])
    (cut,) = suffix._cut(200, width)([placed])
    parts = cut.to_pylist()
    assert sorted(s for p in parts for s in range(p["start"], p["stop"])) == list(range(len(text) - 199))
    assert all(p["bytes"] == text[p["start"] : p["stop"] + 199] and 0 <= p["at"] - p["stop"] + 1 <= p["at"] - p["start"] <= 168 for p in parts)
    assert all((p["at"] - p["start"]) // width == (p["at"] - p["stop"] + 1) // width for p in parts)
    pieces = collections.defaultdict(set)  # equal strings have equal pieces
    for p in parts:
        for s in range(p["start"], p["stop"]):
            pieces[text[s : s + 200]].add((p["anchor"], p["piece"]))
    assert all(len(x) == 1 for x in pieces.values())
    assert width > 1 or len({x for y in pieces.values() for x in y}) == len(pieces)


def test_repeats_of_nothing(empty, monkeypatch):
    assert suffix.remove_repeats(empty).count() == 0
    monkeypatch.setattr(suffix, "SEGMENT", 500)
    monkeypatch.setattr(suffix, "CHUNK", 300)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdef") for _ in range(3000))
    rows = [(1, long), (2, long[700:1900]), (3, "z" * 100)]
    df = empty.sparkSession.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, suffix.remove_repeats(df).drop("kept").collect())) == brute_removed(rows, 200)


# --- nearest neighbours -----------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))
    x[50:90] = x[20]  # a vector that many share
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1020, []), (1040, [0.0] * 16), (1060, [float("nan")] * 16), (1080, [None] + [1.0] * 15), (None, [1.0] * 16), (1100, [1.0, 2.0]), (0, rows[0][1])]
    got = collections.defaultdict(list)
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("entry", F.lit(1))
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in range(0, 600, 20)}
    hits = 0
    for q, own in got.items():
        score = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        assert [r[0] for r in own] == list(range(1, 21)) and all(s == score[v] for _, v, s in own)
        hits += len(set(want) & {v for _, v, _ in own})
    assert hits >= 0.9 * 20 * len(got)
    assert [v for _, v, _ in got[20]][:20] != [] and ann.search(df.limit(0)).count() == 0


def test_forest_recall():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(8000, 32))
    q = rng.normal(size=(40, 32))
    f = ann.Forest(x)
    entries, votes = f.settle(x, rng.normal(size=(60, 32)), 20)
    lo, hi = f.ranges(q, entries)
    near = [f.candidates(lo[i], hi[i], votes, 21) for i in range(len(q))]
    found = [np.isin(np.argsort(-(x @ v))[:20], own).mean() for v, own in zip(q, near)]
    assert np.mean(found) >= 0.9 and np.mean([len(own) for own in near]) < 0.2 * len(x)


@pytest.mark.parametrize("blocks", [1, 3])
def test_recall_on_embeddings(spark, folder, monkeypatch, blocks):
    """Recall on the whole table, in one block and in several, and the share of rows that is scored."""
    table = spark.read.parquet(f"{folder}/../sf0.1/embeddings.parquet")
    pdf = table.toPandas().sort_values("vec_id")
    x, ids = np.array(pdf.embedding.tolist(), float), pdf.vec_id.to_numpy()
    monkeypatch.setattr(ann, "BLOCK_ROWS", -(-len(x) // blocks))
    got = ann.search(table).toPandas().groupby("query_id").vec_id.agg(set)
    asked, hits = ids[ids % 20 == 0], 0
    for q in asked:
        score = x @ x[ids == q][0]
        want = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        hits += len(set(want) & got[q])
    assert set(got.index) == set(asked) and hits >= 0.9 * 20 * len(asked)
    f = ann.Forest(x)
    entries, votes = f.settle(x, x[ids % 20 == 0], 20)
    lo, hi = f.ranges(x[ids % 20 == 0], entries)
    assert np.mean([len(f.candidates(lo[i], hi[i], votes, 21)) for i in range(len(asked))]) < 0.35 * len(x)


@pytest.mark.parametrize("kind", ["gaussian", "skewed", "one long"])
def test_recall_of_a_full_block(kind):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(ann.BLOCK_ROWS, 64))
    if kind == "skewed":
        x *= rng.lognormal(0, 0.7, (len(x), 1))
    elif kind == "one long":
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        x[5] *= 20
    asked = rng.choice(len(x), 60, replace=False)
    ids = np.concatenate([np.arange(len(x)), asked])
    table = ann.pa.table({"vector": [v.tobytes() for v in x] + [x[i].tobytes() for i in asked], "id": ids, "query": np.arange(len(ids)) >= len(x)})
    out = ann._search(20)(table).to_pandas()
    hits = 0
    for q in asked:
        want = [i for i in np.argsort(-(x @ x[q]))[:21] if i != q][:20]
        found = out[(out.query_id == q) & (out.entry != q)].sort_values("score", ascending=False).entry[:20]
        hits += len(set(want) & set(found))
    assert hits >= 0.9 * 20 * len(asked), hits / 20 / len(asked)


# --- benchmark, pages, quality ----------------------------------------------------------------


def test_leaks(spark, edge, empty):
    rng = random.Random(12)
    items = [(i, text(rng, 30)) for i in range(20)] + [(50, None), (51, ""), (52, "just four plain words"), (53, "solo")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    passage = items[3][1].split()
    changed = [w if k % 7 else "other" for k, w in enumerate(passage)]
    docs = [(0, text(rng, 80)), (1, text(rng, 20) + " " + items[2][1].upper() + ", " + text(rng, 9)), (2, text(rng, 9) + " " + " ".join(changed) + " " + text(rng, 5)), (3, " ".join(passage[:16])), (4, " ".join(passage[:8])), (5, "Just four, plain words."), (6, None), (7, "solo")]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(1))
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()} == {(1, 2), (2, 3), (3, 3)}  # short items are not looked for
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(df, bench, least_item=1).collect()}
    assert set(got) == {(1, 2), (2, 3), (3, 3), (5, 52), (7, 53)}
    assert got[1, 2].n_matched == 30 and got[1, 2].doc_start == 20 and got[3, 3].n_matched == 16
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench, block_words=100, least_item=1).collect()} == set(got)
    assert {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()} == {0, 4, 6}
    assert decontaminate.find_leaks(edge, bench).count() == 0 and decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.drop_leaks(edge, bench.limit(0)).count() == len(EDGE)


def brute_overlap(same):
    """(matched, -length, -start) of the best stretch at least four fifths equal."""
    n = len(same)
    found = [(sum(same[i:j]), i - j, -i) for i in range(n) for j in range(i + 1, n + 1) if 5 * sum(same[i:j]) >= 4 * (j - i)]
    return max(found, default=(0, 0, 0))


def test_long_hosts_and_clashing_columns(spark):
    host = ".".join(["a"] * 6000) + ".net"
    rows = [(1, f"http://{host}/fr/x"), (1, f"http://{host}/fr/x"), (None, "http://WWW.example.com/en/1"), (2, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(c) for c in ("host", "path", "keys", "names", "side", "place")})
    got = sorted(((r.page_id or 0, r.rule, r.verdict) for r in url_filter.judge(df, URL_RULES, segments=2).collect()), key=repr)
    assert got == sorted([(1, "net/fr/", "block")] * 2 + [(0, "www.example.com/en/", "allow"), (2, None, "allow")], key=repr)


def brute_leaks(texts, items):
    """Every diagonal that a mask fits, every stretch of it."""
    words = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    rows = []
    for doc, text in texts:
        for item, body in items:
            t, w, best = words(text), words(body), None
            masks = decontaminate.MASKS if len(w) >= 10 else [m for m in decontaminate.MASKS if len(m) <= len(w)] + ["1" * len(w)]
            for start in range(-len(w) + 1, len(t)) if len(w) >= 5 else ():
                lo, hi = max(0, -start), min(len(w), len(t) - start)
                same = [w[i] == t[start + i] for i in range(lo, hi)]
                if not any(all(same[p + j] for j, b in enumerate(m) if b == "1") for m in masks for p in range(len(same) - len(m) + 1)):
                    continue
                for a in range(len(same)):
                    for b in range(a + 1, len(same) + 1):
                        n = sum(same[a:b])
                        if 5 * n >= 4 * (b - a):
                            best = max(best or (0, 0, 0), (n, a - b, -(start + lo + a)))
            if best and best[0] >= min(13, len(w)):
                rows.append((doc, item, best[0], -best[1], len(w), -best[2]))
    return sorted(rows)


def test_leaks_against_brute_force(spark):
    rng = random.Random(21)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(n))) for i, n in enumerate([1, 4, 5, 7, 9, 13, 20, 30])]
    texts = []
    for d in range(40):
        own = items[rng.randrange(len(items))][1].split()
        own = own[rng.randrange(max(len(own) - 13, 1)) :]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = "changed"
        fill = lambda: [rng.choice(WORDS) for _ in range(rng.randrange(12))]
        texts.append((d, " ".join(fill() + own + fill() + (own if d % 5 == 0 else []))))  # ties: the first of two
    texts += [(3, texts[3][1]), (50, None), (51, ""), (52, "-".join(items[6][1].upper().split()))]
    got = decontaminate.find_leaks(spark.createDataFrame(texts, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, r.item_id, r.n_matched, r.n_overlap, r.item_words, r.doc_start) for r in got.collect())
    assert got == brute_leaks(texts, items) and len(got) > 10


def test_hits_come_in_slices(monkeypatch):
    block = decontaminate.Items([1, 2], ["a b c d e f g h i j k l m n"] * 2)
    words = next(decontaminate.text_words(decontaminate.pa.array(["x a b c d e f g h i j k l m n y"])))[1]
    whole = {tuple(x) for part in block.hits(words) for x in part.tolist()}
    monkeypatch.setattr(decontaminate, "HITS", 2)
    parts = list(block.hits(words))
    assert len(parts) > 5 and {tuple(x) for part in parts for x in part.tolist()} == whole == {(0, 1), (1, 1)}


def test_benchmark_in_blocks(spark):
    text = ",".join(f"w{i}" for i in range(40))  # no blanks: words are counted as they are cut
    bench = spark.createDataFrame([(i, text + f",x{i}") for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text.replace(",", " "))], DOCS)
    assert decontaminate.find_leaks(docs, bench, block_words=50).count() == 6
    assert decontaminate.drop_leaks(docs.withColumn("item_id", F.lit(0)), bench).count() == 0


def test_overlap_is_the_best_stretch():
    rng = random.Random(21)
    for k in range(150):
        own = [f"q{i}" for i in range(rng.randint(13, 50))]
        rate = (0.1, 0.15, 0.2, 0.3)[k % 4]
        same = [rng.random() >= rate for _ in own]
        block = decontaminate.Items([1], [" ".join(own)])
        (_, words, _), = decontaminate.text_words(decontaminate.pa.array([" ".join(w if s else "other" for w, s in zip(own, same))]))
        m, n, at = brute_overlap(same)
        got = block.overlap(words, 0, 0)
        assert got[:2] == (m, -n) and (not m or got[2] == -at)


def test_leaks_over_substitutions(spark):
    own = [f"q{i}" for i in range(48)]
    shapes = ["1" * 10 + "000" + "1" * 10, "1111111100" * 4 + "1" * 8, "1" * 8 + "000" + "1" * 8, "1" * 12]
    bench = spark.createDataFrame([(i, " ".join(f"{i}{w}" for w in own[: len(s)])) for i, s in enumerate(shapes)], "item_id long, text string")
    docs = [(i, "before " + " ".join(f"{i}{w}" if c == "1" else "other" for w, c in zip(own, s)) + " after") for i, s in enumerate(shapes)]
    rng = random.Random(22)
    df = spark.createDataFrame(docs, DOCS)
    got = {r.item_id: (r.n_matched, r.n_overlap, r.doc_start) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {0: (20, 23, 1), 1: (40, 48, 1), 2: (16, 19, 1), 3: (12, 12, 1)}
    assert decontaminate.drop_leaks(df, bench).count() == 0
    lost = 0
    for rate in (0.15, 0.2):
        items, texts = [], []
        for i in range(200):
            words = [f"r{rng.randrange(10**9)}" for _ in range(40)]
            same = [rng.random() >= rate for _ in words]
            items.append((i, " ".join(words)))
            texts.append((i, " ".join(w if s else "other" for w, s in zip(words, same)), brute_overlap(same)[0] >= 13))
        found = decontaminate.find_leaks(spark.createDataFrame([t[:2] for t in texts], DOCS), spark.createDataFrame(items, "item_id long, text string"))
        ids = {r.doc_id for r in found.collect()}
        assert ids <= {t[0] for t in texts if t[2]}
        lost += len({t[0] for t in texts if t[2]} - ids)
    assert lost <= 4  # of those that no seed meets


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><nav><a href=/>Home</a></nav><div class="ad">Buy this now, all of it, at once.</div>
<article><h1>Big &amp; small</h1><p>First   text\nof the page, with <b>bold</b> words and more of them to be read.<p>Second &lt;one&gt;&nbsp;here.<br></article><div id=comments><p>A comment by a reader who has much to say.</p></div><footer>&copy; us</footer></body></html>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<article><p>" + "word " * 50000 + "</article>"), (1, "u", PAGE)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 6
    by = {r.page_id: r for r in got}
    assert by[1].text == "Big & small\nFirst text of the page, with bold words and more of them to be read.\nSecond <one> here."
    assert by[2].text == by[3].text == by[4].text == "" and by[5].n_chars == 249999 and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_against_their_article(spark, folder):
    """The synthetic pages mark their main text by one <article>, whose blocks are cut out plainly here."""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", inner[1].replace("<br>", " "))) if inner else []
        parts = [" ".join(html.unescape(p).split()) for p in parts]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("page", ["<div " * 200_000 + '"', "<a href='" * 100_000, "<button>" * 60_000, "<" * 300_000, "<div>" * 50_000 + "</section>" * 50_000, "<!--" * 200_000, "</é" * 100_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3


def test_scripts_and_open_links():
    page = "<article><p>Main text of this page, long enough to be kept by all means.<script src=/a.js/>var leaked=1;</script><style />p{}</style> Tail</p></article>"
    assert html_text.main_text(page) == "Main text of this page, long enough to be kept by all means. Tail"
    page = "<article><p>One two three four five.</p><p><a href='x'>a link without an end</p><p>More text of this article that must stay, of course.</p></article>"
    assert html_text.main_text(page).endswith("More text of this article that must stay, of course.")
    assert html_text.main_text('<article><p title="x>One two three</p><p>Four five six</p></article>') == "One two three\nFour five six"


def test_furniture_goes_wherever_it_stands():
    long = " ".join(f"word{i}" for i in range(28))
    for n in (1, 3, 5, 8, 20, 30, 60):
        some = " ".join(["buy"] * n)
        for box in ('<div class="ad">%s</div>', "<aside>%s</aside>", '<div id="comments"><p>%s</p></div>', "<form>%s</form>", '<div class="cookie-notice">%s</div>', "<footer>%s</footer>"):
            page = f"<body><article><h1>On a hill</h1><p>{long}</p>{box % some}<p>{long}</p></article></body>"
            assert html_text.main_text(page) == f"On a hill\n{long}\n{long}"


def test_left_out_pages():
    """Word counts and link densities alone tell most blocks; tags and hints tell the rest."""
    assert html_text.left_out_accuracy() >= 0.85 and html_text.left_out_accuracy(("zone", "heading", "item")) >= 0.7
    assert html_text.left_out_accuracy(("words", "links", "words_before", "links_before", "words_after", "links_after")) < html_text.left_out_accuracy()


def test_labelled_table_is_learnt():
    for page in html_text.LABELLED:
        found = html_text.blocks(page)
        keep = html_text.tree().predict(html_text.table_of([(t.lstrip("+"), *r) for t, *r in found]))
        wrong = sum(k != t.startswith("+") for k, (t, *_) in zip(keep, found))
        assert wrong <= 0.25 * len(found)


def test_quality(spark, edge, empty):
    rng = random.Random(13)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        docs.append((i, " ".join(w + ("***" if bad else "") for w in text(rng, 60).split()), 400))
        labels.append((i, int(not bad), 0))
    d = spark.createDataFrame(docs, DOCS + ", n_chars long")
    m = quality.train(d, spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    got = quality.score(d, m).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == int(r.doc_id % 5 != 0) for r in held]) > 0.95
    out = quality.score(edge, m).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert quality.keep_good(edge, m).columns == edge.columns
    assert quality.score(empty, m).count() == 0
    none = quality.train(empty.withColumn("n_chars", F.lit(None).cast("long")), spark.createDataFrame([], "doc_id long, quality int"))
    assert 0 <= quality.score(edge, none).first().score <= 1


def test_few_labels_are_calibrated(spark, folder):
    """Sixty labelled rows: scores on both sides of the threshold, and held-out rows told right."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.train(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    assert set(got.predicted) == {0, 1}
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.85


def test_calibration_keeps_the_order():
    z = np.array([0.5, 1.0, 1.5, 2.0, 2.5, 3.0] * 3)
    slope, shift = quality.calibrate(z, (z > 1.7).astype(float))
    assert slope >= 0.1 and slope * 1.5 + shift < 0 < slope * 2 + shift
    assert quality.calibrate(z, (z < 1.7).astype(float))[0] == 0.1


def test_machine_equals_pairwise_sum():
    rng = np.random.default_rng(14)
    m = quality.Machine(np.zeros((quality.STATS, quality.BINS)), 0.1, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.FACTORS)))
    index, value, starts = m.rows([np.array([3, 9, 70])], rng.normal(size=(1, quality.STATS)))
    z = m.bias + m.weight[index] @ value + sum(m.factor[i] @ m.factor[j] * value[a] * value[b] for a, i in enumerate(index) for b, j in enumerate(index) if a < b)
    assert m.logits(index, value, starts)[0][0] == pytest.approx(z)


def test_filters_travel_in_pieces(spark):
    """A task gives a row a piece of its filter, not a row a word; bits are those of all keys at once."""
    made = []

    class Spied:
        def mapInArrow(self, f, schema):
            made.append(keys.mapInArrow(f, schema))
            return made[0]

    keys = spark.range(0, 60_000, numPartitions=3).select((F.col("id") * 977).alias("key"))
    bloom = url_filter.fill(Spied(), url_filter.Bloom(60_000, 0.01, 5))
    want = url_filter.Bloom(60_000, 0.01, 5)
    want.add(np.arange(60_000, dtype=np.uint64) * np.uint64(977))
    assert (bloom.words == want.words).all() and len(want.words) > 2 * url_filter.PIECE_WORDS
    assert made[0].count() <= 3 * -(-len(want.words) // url_filter.PIECE_WORDS)
    assert not url_filter.fill(spark.range(0).select(F.col("id").alias("key")), url_filter.Bloom(9, 0.01, 5)).words.any()


def test_common_anchors_have_shards_of_their_own(spark):
    rows = [(a, a % 3, 2_000 if a < 40 else 5) for a in range(400)]
    got = spark.createDataFrame(rows, "anchor long, piece int, of long").withColumn("shard", suffix._shard_of(4)).collect()
    common, rest = [r.shard for r in got if r.of > 5], {r.shard for r in got if r.of == 5}
    assert len(set(common)) == 40 and rest == set(range(4)) and not rest & set(common)
