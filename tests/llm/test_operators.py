"""The corpus operators against brute force on small fixtures with nulls, ties, repeats and odd columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmill.llm import bpe, chat_format, exact_dedup, language, mixing, near_dedup, packing, queries, repetition, token_count, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    BASE, BASE.upper(), BASE.replace("word30", "changed"), BASE.replace("word5 ", "x ").replace("word50", "y"), "é " * 30, "", None, " \n\t", "a", "A", "a b c", "a b\nc",
    "line one\nline two\nline one\n" * 3, "the cat sat on the mat " * 20, "It's 12 o'clock!! <|endoftext|> ok  \n\n  x", "😀😀 中文 ß z", "long " * 30000, BASE + " " + BASE, BASE + " tail",
]
ODD = "doc_id long, text string, kept string, id string, __sha string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", None, "y", ["s0", "s1", None][i % 3], "en") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", "x", None, "y", "s1", None)], ODD).repartition(3).cache()


def shingle_set(t):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(items):
    root = {i: i for i, _ in items}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in items:
        for j, y in items:
            if i < j and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def test_near_duplicates(spark, docs):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 2
    want = components([(i, shingle_set(t)) for i, t in enumerate(TEXTS)])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(shingle_set(TEXTS[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_in_a_large_group(spark):
    """A group whose members are not all similar to its pivot, as against brute force."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 7)):
            words[k] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components([(i, shingle_set(t)) for i, t in rows])


def test_exact(spark, docs):
    got = exact_dedup.annotate(docs).collect()
    assert len(got) == len(TEXTS) + 2
    norm = lambda t: (t or "").translate(LOW)
    every = [*TEXTS, TEXTS[0], "no id"]
    sizes, keep = Counter(map(norm, every)), {norm(t): i for i, t in enumerate(TEXTS)}
    for r in got:
        t = "no id" if r.doc_id is None else TEXTS[r.doc_id]
        assert r.text_sha256 == hashlib.sha256(norm(t).encode()).hexdigest() and r.group_size == sizes[norm(t)]
        assert r.keep_id == keep.get(norm(t)) and r.kept == (r.doc_id == r.keep_id)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(keep.values())
    assert exact_dedup.annotate(docs, filter_bits=64).count() == len(got)  # a full filter only moves more rows


def test_tokens_and_packing(spark, docs):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    own = Tokenizer.from_file(path)
    ids = lambda t: own.encode(t or "", add_special_tokens=False).ids
    for r in token_count.count_tokens(docs, path).collect():
        t = "no id" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), len(ids(t)), len(ids(t)) > 512)
    got = packing.pack(docs.where("doc_id > 0"), path, capacity=64, with_ids=True).toPandas()
    for i, part in got.groupby("doc_id"):
        part, want = part.sort_values("start"), [*ids(TEXTS[int(i)]), 0]
        assert [x for p in part.ids for x in p] == want and set(part.doc_tokens) == {len(want)}
        assert [zlib.crc32(np.array(p, "<u4").tobytes()) for p in part.ids] == part.ids_crc32.tolist()
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 64


def test_column_generation_meets_demand():
    rng = np.random.default_rng(5)
    demand = np.bincount(np.minimum(rng.integers(0, 32, 5000), rng.integers(0, 32, 5000)), minlength=32)
    rows = packing.places(demand, 32)
    placed, used = Counter(), Counter()
    for size, lo, hi, first, each, _ in rows:
        placed[size] += hi - lo
        for k in range((hi - lo) // each):
            used[first + k] += size * each
    assert all(placed[i + 1] == n for i, n in enumerate(demand)) and max(used.values()) <= 32
    assert len(used) <= 1.01 * (demand @ np.arange(1, 33)) / 32 + 3


def test_repetition(docs):
    def brute(t):
        w, seen, dup = WORD.findall(t or ""), set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(inside)

    for r in repetition.judge_repetition(docs).collect():
        t = "no id" if r.doc_id is None else TEXTS[r.doc_id]
        n, chars, symbols, dup, inside = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, inside)
        assert r.base_failed == (n < 50 or 100 * inside > 50 * n) and not (r.kept and r.base_failed)


def test_language(spark):
    rng = np.random.default_rng(1)
    make = lambda alphabet: " ".join("".join(rng.choice(list(alphabet), 5)) for _ in range(40))
    rows = [(i, make("abcdefg" if i % 2 else "tuvwxyzé"), "aa" if i % 2 else "bb") for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !!", "aa"), (902, "x" * 100000, None), (None, "abc", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs, language.train(docs.where("doc_id < 100"))).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows[100:]]) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and 0 <= got[902].score <= 1 and None in got
    assert {r.lang_pred for r in language.identify(docs, language.train(docs.limit(0))).collect()} == {"und"}


def test_gradients_match_differences():
    net = language.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    mask = np.ones((5, 12), np.float32)
    loss = lambda: -np.log(net.positions(x)[:, np.arange(5), y]).mean()
    g = net.gradients(x, mask, y)
    for k in ("u0", "u1", "v", "b"):
        at = (0,) * net.w[k].ndim
        net.w[k][at] += 1e-2
        up = loss()
        net.w[k][at] -= 2e-2
        assert abs((up - loss()) / 2e-2 - g[k][at]) < 1e-3
        net.w[k][at] += 1e-2


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.choice(words, 30), *(["Nasty,"] if i % 4 == 0 else [])])) for i in range(600)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "nasty")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(400, 600)]) > 0.97
    assert len(got) == 603 and got[1000].score == got[1001].score
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.5}


def test_mixing(spark, docs):
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    e = mixing.exponent_for(shares, target_entropy=1.0)
    assert abs(mixing.entropy(mixing.weights(shares, e)) - 1.0) < 1e-6
    e = mixing.exponent_for(shares, repetition_limit=1.5)
    assert abs(max(w / shares[s] for s, w in mixing.weights(shares, e).items()) - 1.5) < 1e-6
    many = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(40 + id % 7 as int)) AS text", "CASE WHEN id % 10 < 7 THEN 'a' WHEN id % 10 < 9 THEN 'b' END AS source")
    m = mixing.Mix(many, repetition_limit=1.5)
    plan = m.plan().toPandas()
    plan["source"] = plan.source.fillna("null")
    held = (plan.copies * plan.n_tokens).groupby(plan.source).sum()
    for s, weight in plan.groupby("source").weight.first().items():
        assert 0 <= held[s] - weight * plan.n_tokens.sum() <= plan.n_tokens.max() + 1e-6
    assert m.realise().count() == plan.copies.sum() and m.realise().columns == many.columns
    assert mixing.Mix(docs, repetition_limit=1.2).plan().count() == docs.count()


def test_chat(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "bye"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 1, "assistant", "no"), (2, 0, None, None), (None, 0, "user", "lost"), (4, 0, "user", "a"), (5, 0, "user", "a")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    out = chat_format.preference_segments(conv, chat_format.neighbour_pairs(conv))
    got = sorted((r.pair_id, r.part, r.turn, r.segment, r.masked) for r in out.collect())
    seg = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got == sorted([(0, "prompt", 0, seg("user", "hi"), True), (0, "chosen", 1, seg("assistant", "yes"), False), (0, "chosen", 2, seg("user", "bye"), True), (0, "rejected", 1, seg("assistant", "no"), False), (1, "chosen", 0, seg("unknown", ""), True), (2, "prompt", 0, seg("user", "a"), True)])
    whole = {r.pair_id: r for r in chat_format.render(out).collect()}
    assert whole[0].prompt == seg("user", "hi") and whole[0].chosen == seg("assistant", "yes") + seg("user", "bye") and whole[1].prompt == ""


def test_urls(spark):
    urls = ["http://A.example.com/en/7x?q=1#f", "https://example.com/en/9", "http://x.de/?utm_source=a&p=2&ref=b", "http://www.x.de?p=2#z", None, "no scheme", "ftp://", "http://y.net/de/1", "http://b.example.net/de/88", "http://notcom/en/", "http://z.org/es/"]
    pages = spark.createDataFrame([*enumerate(urls), (3, urls[3])], "page_id long, url string").withColumn("verdict", F.lit(0))
    listed = spark.createDataFrame([("http://x.de/?p=2",), (None,)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, queries.URL_RULES, filter_bits=64).collect()}
    assert got == {
        0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 1: ("example.com", "/en/9", "com/en/", "block"), 2: ("x.de", "/", None, "block"), 3: ("www.x.de", "", None, "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("", "", None, "allow"), 7: ("y.net", "/de/1", "net/de/", "allow"), 8: ("b.example.net", "/de/88", "example.net/de/8", "block"), 9: ("notcom", "/en/", None, "allow"), 10: ("z.org", "/es/", "org/es/", "block"),
    }


def test_empty_tables(spark, docs):
    none, path = docs.limit(0), queries.vocabulary()
    for out in (near_dedup.near_duplicates(none), exact_dedup.annotate(none), token_count.count_tokens(none, path), packing.pack(none, path), repetition.judge_repetition(none), mixing.Mix(none, repetition_limit=1.2).plan()):
        assert out.count() == 0


def test_merge_counter_pieces():
    c = bpe.MergeCounter(queries.vocabulary())
    assert c.count("") == 0 and c.count("<|endoftext|>") == 1 and c.count("a" * 1000) > 0
