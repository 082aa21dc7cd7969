"""Learned, numeric and hashed operators against plain loops; odd columns, long texts and empty tables for all."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkmill.llm import bloom, bpe, chat_format, exact_dedup, language, mixing, near_dedup, packing, queries, repetition, token_count, toxicity, url_filter
from sparkmill.llm.common import Scratch, drop_ids
from sparkmill.llm.textkit import slices

from .test_operators import TEXTS, WORD

#: Every name that operators use inside; documents may have columns of these names.
INNER = """row id sha maybe hash slice group keep size gone key spot block order source_key weight passes edge edge_spot edge_block left copies want rest tokens
__sha __maybe __group __keep __size __bloom_key __bloom_block __bloom_bits __bloom __key __copy __mine __gone __order __spot bits kept n keys c1 c2 cls root label features place score""".split()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["s0", "s1", None][i % 3], "en", *(f"{name}-{i}" for name in INNER)) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, "no id", "s1", None, *INNER), (None, None, None, None, *INNER)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"{n} string" for n in INNER)).repartition(3).cache()


# language: a plain loop over units, positions and bytes


def gru(net, text: bytes):
    """Mean label probabilities over the positions of a text, window by window, with scalars."""
    h, sig = language.HIDDEN, lambda x: 1 / (1 + math.exp(-x))
    total, w = [0.0] * len(net.labels), {k: v.astype(float) for k, v in net.w.items()}
    for a in range(0, len(text), language.WINDOW):
        part = text[a : a + language.WINDOW]
        states = []
        for d, order in ((0, range(len(part))), (1, range(len(part) - 1, -1, -1))):
            state, out = [0.0] * h, {}
            if d == 1:  # the backward pass begins in the padding
                order = [*range(language.WINDOW - 1, len(part) - 1, -1), *order]
            for t in order:
                x = w[f"x{d}"][part[t] if t < len(part) else 0]
                rec = [sum(state[i] * w[f"u{d}"][i][g] for i in range(h)) for g in range(3 * h)]
                z = [sig(x[k] + rec[k]) for k in range(h)]
                r = [sig(x[h + k] + rec[h + k]) for k in range(h)]
                new = [math.tanh(x[2 * h + k] + r[k] * rec[2 * h + k]) for k in range(h)]
                state = [new[k] + z[k] * (state[k] - new[k]) for k in range(h)]
                out[t] = state
            states.append(out)
        for t in range(len(part)):
            both = [*states[0][t], *states[1][t]]
            e = [math.exp(sum(both[i] * w["v"][i][k] for i in range(2 * h)) + w["b"][k]) for k in range(len(net.labels))]
            total = [total[k] + e[k] / sum(e) for k in range(len(e))]
    return [x / len(text) for x in total]


def test_language_network_against_a_plain_loop(spark):
    net = language.Network(["a", "b", "c"], seed=3)
    texts = ["abc", "é" * 70, "some words, and more: " * 9, "x"]
    docs = spark.createDataFrame([*enumerate(texts), (9, None), (10, "1 2")], "doc_id long, text string")
    for r in language.identify(docs, net).collect():
        if r.doc_id < 9:
            p = gru(net, texts[r.doc_id].encode())
            assert r.lang_pred == net.labels[int(np.argmax(p))] and abs(r.score - max(p)) < 1e-4
        else:
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_language_byte_gradients_match_differences():
    net = language.Network(["a", "b"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(2)
    x, y, mask = rng.integers(0, 256, (4, 10)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((4, 10), np.float32)
    mask[1, 6:] = 0
    loss = lambda: float((-np.log(net.positions(x)[:, np.arange(4), y]) * mask.T).sum() / mask.sum())
    g = net.gradients(x, mask, y)
    for name in ("x0", "x1"):
        for unit in (0, language.HIDDEN, 2 * language.HIDDEN):
            at = (int(x[0, 3]), unit)
            net.w[name][at] += 1e-2
            up = loss()
            net.w[name][at] -= 2e-2
            assert abs((up - loss()) / 2e-2 - g[name][at]) < 1e-4
            net.w[name][at] += 1e-2


# toxicity: scalars, one coordinate at a time


def test_ftrl_against_scalars():
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 40, 12)), int(rng.integers(0, 2))) for _ in range(200)]
    rows = [(np.append(at, 50) if label else at, label) for at, label in rows]
    fast, z, n, bias, bias_n = toxicity.FTRL(), defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for at, label in rows * 3:
        fast.learn(at, label)
        g = 1 / (1 + math.exp(-(bias + sum(weight(i) for i in at)))) - label
        for i in at:
            w, more = weight(i), n[i] + g * g
            z[i] += g - (math.sqrt(more) - math.sqrt(n[i])) / toxicity.ALPHA * w
            n[i] = more
        bias_n += g * g
        bias -= toxicity.ALPHA / (toxicity.BETA + math.sqrt(bias_n)) * g
    coordinates, values, b = fast.sparse()
    assert dict(zip(coordinates.tolist(), values.tolist(), strict=True)) == pytest.approx({i: weight(i) for i in z if weight(i)}, rel=1e-5)
    assert abs(b - bias) < 1e-9 and 50 in coordinates


def test_toxicity_scores_against_a_plain_sum(spark, odd):
    """Scores from the sparse weights by a loop over words, pairs and skip-grams; equal ids, long texts, odd columns."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))] + [(0, 1), (3, None), (None, 1)], "doc_id long, toxic int").withColumn("label", F.lit("x"))
    model = toxicity.train(odd, labels)
    assert all(np.array_equal(a, b) for a, b in zip(model[:2], toxicity.train(odd.repartition(5), labels.repartition(4))[:2], strict=True))
    table = dict(zip(*[x.tolist() for x in model[:2]], strict=True))

    def score(t):
        (s,) = slices(pa.array([t or ""]))
        _, keys = toxicity.features(s)
        return 1 / (1 + math.exp(-(sum(table.get(k, 0.0) for k in set(keys.tolist())) + model[2])))

    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is not None:
            assert abs(r.score - score(TEXTS[r.doc_id])) < 1e-5 and r.predicted == (r.score >= 0.7)


def test_toxicity_training_keeps_to_its_bounds(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(10))) for i in range(50)] + [(0, "other text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    seen = []
    learn, toxicity.FTRL.learn = toxicity.FTRL.learn, lambda self, at, label: seen.append(len(at))
    try:
        toxicity.train(docs, labels, max_rows=20)
        rows = len(seen) // toxicity.EPOCHS
        seen.clear()
        toxicity.train(docs, labels, max_features=100)
        features = sum(seen) // toxicity.EPOCHS
    finally:
        toxicity.FTRL.learn = learn
    assert rows == 20 and 100 - 27 <= features <= 100


# mixing: a plain realisation


def realised(rows, limit, tokens, m):
    """Copies of each (id, source) by whole passes and then blocks in their order, from the operator's places."""
    place = {r.doc_id: (r.order, r.spot) for r in m.rows.collect()}
    by = defaultdict(list)
    for i, s in rows:
        by[s].append(i)
    have = {s: sum(tokens[i] for i in ids) for s, ids in by.items()}
    total = sum(have.values())
    share = {s: t / total for s, t in have.items()}
    mixed = lambda a: {s: p**a / sum(q**a for q in share.values() if q) if p else 0.0 for s, p in share.items()}
    fits = lambda a: all(w <= limit * share[s] * (1 + 1e-12) for s, w in mixed(a).items() if share[s])
    low, high = 0.0, 1.0
    for _ in range(200):
        low, high = (low, (low + high) / 2) if fits((low + high) / 2) else ((low + high) / 2, high)
    copies = {}
    for s, ids in by.items():
        want = mixed(high)[s] * total
        passes = int(want // have[s]) if have[s] else 1
        rest = want - passes * have[s] if have[s] else 0
        done = 0
        for i in sorted(ids, key=lambda i: place[i]):
            copies[i] = passes + (done < rest)
            done += tokens[i]
    return copies, mixed(high)


@pytest.mark.parametrize("few", [10_000, 0])
def test_mixing_against_a_plain_realisation(spark, few):
    """Also with more sources than the driver is to hold (few = 0)."""
    rng = np.random.default_rng(9)
    rows = [(i, f"s{min(int(rng.exponential(2)), 6)}") for i in range(700)]
    docs = spark.createDataFrame([(i, "x" * int(rng.integers(1, 200)), s) for i, s in rows], "doc_id long, text string, source string").repartition(4)
    m = mixing.Mix(docs, repetition_limit=1.4, few_sources=few)
    plan = m.plan().collect()
    copies, weights = realised(rows, 1.4, {r.doc_id: r.n_tokens for r in plan}, m)
    assert {r.doc_id: r.copies for r in plan} == copies and all(abs(r.weight - weights[r.source]) < 1e-9 for r in plan)
    assert Counter(r.doc_id for r in m.realise().collect()) == Counter({i: n for i, n in copies.items() if n})


def test_mixing_with_a_budget_and_a_target_entropy(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('abcd', 10) AS text", "CASE WHEN id % 10 < 8 THEN 'a' ELSE 'b' END AS source")
    for few in (10, 0):
        m = mixing.Mix(docs, budget=6000, target_entropy=0.6, few_sources=few)
        plan = m.plan().toPandas()
        w = plan.groupby("source").weight.first()
        assert abs(mixing.entropy(dict(w)) - 0.6) < 1e-6
        held = (plan.copies * plan.n_tokens).groupby(plan.source).sum()
        assert all(0 <= held[s] - w[s] * 6000 < 10 + 1e-6 for s in w.index)


# repetition: coverage and verdict


def coverage(t):
    words = [(m.start(), m.group()) for m in WORD.finditer(t or "")]
    chars, out = sum(len(w) for _, w in words), {}
    for n in repetition.NGRAM_LIMITS:
        grams = Counter(tuple(w for _, w in words[i : i + n]) for i in range(len(words) - n + 1))
        inside = {j for i in range(len(words) - n + 1) if grams[tuple(w for _, w in words[i : i + n])] > 1 for j in range(i, i + n)}
        out[n] = sum(len(words[j][1]) for j in inside) / max(chars, 1)
    lines, seen, dup = [x for x in (t or "").split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        dup += len(line) * (line in seen)
        seen.add(line)
    return out, dup / max(sum(map(len, lines)), 1)


def test_repetition_coverage_and_verdict(spark):
    unique = lambda n: " ".join(f"w{i}x{n}" for i in range(60))
    texts = [*TEXTS, unique(1), unique(2) + "\n" + unique(2), "\n".join([unique(3)] * 2 + [unique(4), unique(5), unique(6), unique(7)]), unique(8) + " a b c d e f " + unique(9) + " a b c d e f", ("é ü " * 2 + unique(10) + "\n") * 3]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x")], "doc_id int, text string")
    verdicts = set()
    for r in repetition.judge_repetition(docs).collect():
        want, lines = coverage(texts[r.doc_id] if r.doc_id is not None else "x")
        assert all(abs(r[f"coverage_{n}"] - c) < 1e-9 for n, c in want.items()) and abs(r.line_coverage - lines) < 1e-9
        assert r.kept == (not r.base_failed and lines <= repetition.LINE_LIMIT and all(c <= repetition.NGRAM_LIMITS[n] for n, c in want.items()))
        verdicts.add((r.base_failed, r.kept))
    assert verdicts == {(True, False), (False, False), (False, True)}


# packing and tokens: any text


def test_any_text_is_packed(spark):
    path = queries.vocabulary()
    own = Tokenizer.from_file(path)
    texts = [" " * 10**6, "\t" * 10**6, "a" * 10**6, "x" + " \t\n" * 50000 + "y z", " " * 3000 + "<|endoftext|>" + " " * 3000, "　" * 2000 + "é", None, "", "short"] + ["t"] * 300
    rows = [*enumerate(texts), (None, "no id"), (0, "again"), (8, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin", F.lit("x")).repartition(4)
    got = packing.pack(docs, path, with_ids=True).collect()
    ids = {t: [*own.encode(t or "", add_special_tokens=False).ids, 0] for t in {t for _, t in rows}}
    assert Counter((p.doc_id, p.start, tuple(p.ids)) for p in got) == Counter((i, a, tuple(ids[t][a : a + 1024])) for i, t in rows for a in range(0, len(ids[t]), 1024))
    assert len({p.sequence_id for p in got}) <= sum(p.length for p in got) / 1024 * 1.01 + 2
    counts = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs.where("doc_id > 0"), path).collect()}
    assert all(counts[i] == len(ids[t]) - 1 for i, t in enumerate(texts) if i)


def test_tiny_texts_fill_their_sequences(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN '' ELSE 'a b' END AS text")
    got = packing.pack(docs, queries.vocabulary()).toPandas()
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 1024) + 2


def test_long_runs_are_cut_as_the_pattern_does():
    for text in ("a" + " " * 2000 + "b", " " * 1500, "\n" * 1000 + " x", "q" + "\t" * 1200):
        parts = [p for p, _ in bpe.long_runs(text)]
        assert "".join(parts) == text and [p for p, one in bpe.long_runs(text) if one] == [p for p in bpe.regex.findall(bpe.PATTERN, text) if len(p) >= 999]


# Bloom filters


def test_filters_are_sized_by_their_values(spark):
    for n in (100, 20_000, 200_000):
        bits = bloom.bits_for(n)
        seen = bloom.build(spark.range(n).select(F.xxhash64("id").alias("h")), "h", bits)
        others = spark.range(10**6, 10**6 + 20_000)
        share = bloom.probe(others, F.xxhash64("id"), seen, bits, "maybe").where("maybe").count() / 20_000
        assert share < 0.05 and bloom.probe(spark.range(n), F.xxhash64("id"), seen, bits, "maybe").where("NOT maybe").isEmpty()
    assert bloom.bits_for(10**12) == bloom.MAX_BITS and bloom.slices_for(10**9) == -(-16 * 10**9 // bloom.MAX_BITS)


def test_exact_dedup_in_slices(spark):
    """With a filter for few rows the digests are dealt to slices; unique rows still pass, and the result is the same."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', CASE WHEN id % 10 = 0 THEN id % 100 ELSE id END) AS text")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(exact_dedup.annotate(docs, filter_bits=1 << 14)) == key(exact_dedup.annotate(docs))
    assert key(exact_dedup.drop_copies(docs, filter_bits=1 << 14)) == key(exact_dedup.drop_copies(docs))
    scratch = Scratch(spark, "test")
    for bits in (1 << 14, bloom.MAX_BITS):
        flagged = exact_dedup._flagged(scratch, docs.select(F.col("doc_id").alias("id"), exact_dedup.digest(F.col("text")).alias("sha")), bits)
        assert flagged.where("maybe").count() < 600 + 0.1 * 5400


# odd columns and empty tables


def test_columns_of_inner_names_pass_unchanged(spark, odd):
    whole = {tuple(r) for r in odd.collect()}
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and {tuple(r) for r in kept.collect()} < whole
    left = drop_ids(odd, spark.createDataFrame([(0,), (None,)], "doc_id long"))
    assert left.columns == odd.columns and {tuple(r) for r in left.collect()} == {r for r in whole if r[0] != 0}
    mix = mixing.Mix(odd, queries.vocabulary(), repetition_limit=1.2)
    made = mix.realise()
    assert made.columns == odd.columns and {tuple(r) for r in made.collect()} <= whole
    assert mix.plan().count() == odd.count()


def test_columns_of_inner_names_change_no_result(spark, odd):
    plain, path = odd.select("doc_id", "text", "lang"), queries.vocabulary()
    key = lambda df: Counter(map(tuple, df.collect()))
    net = language.train(plain)
    for op in (near_dedup.near_duplicates, exact_dedup.annotate, repetition.judge_repetition, lambda d: token_count.count_tokens(d, path), lambda d: language.identify(d, net)):
        assert key(op(odd)) == key(op(plain))
    assert packing.pack(odd, path).count() == packing.pack(plain, path).count()


def test_empty_tables_of_learned_and_native_operators(spark, odd):
    none = odd.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert language.train(none) is None and language.identify(none, language.train(none)).count() == 0
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.preference_segments(talks, chat_format.neighbour_pairs(talks)).count() == 0
    pages, urls = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([("http://a.b/c",)], "url string")
    assert url_filter.judge(pages, urls, queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(urls.withColumn("page_id", F.lit(1)), urls.limit(0), queries.URL_RULES).collect()} == {"allow"}
    assert exact_dedup.drop_copies(none).count() == mixing.Mix(none, repetition_limit=1.2).realise().count() == drop_ids(none, none).count() == 0


def test_chat_with_long_turns_and_odd_columns(spark):
    long = "word " * 200_000
    rows = [(0, 0, "user", long), (1, 0, "user", long), (0, 1, "assistant", "a"), (1, 1, "assistant", "b"), (2, 0, "user", long + "x"), (3, 0, "user", long + "y")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(1) for n in ("pair_id", "said", "split", "prompt_turns", "low", "n", "differs")})
    out = chat_format.preference_segments(conv, chat_format.neighbour_pairs(conv)).collect()
    assert Counter((r.pair_id, r.part) for r in out) == {(0, "prompt"): 1, (0, "chosen"): 1, (0, "rejected"): 1, (1, "chosen"): 1, (1, "rejected"): 1}
    assert next(r for r in out if r.part == "prompt").segment == f"<|user|>\n{long}<|end|>\n"


def test_listed_and_unlisted_pages_share_a_host(spark):
    listed = [r.url for r in queries.block_list(spark).where("url LIKE '%spam-farm.example.com/en/1%' OR url LIKE '%tionsh%'").collect()]
    assert "http://m.spam-farm.example.com/en/105" in listed and "http://m.spam-farm.example.com/en/106" not in listed
    urls = ["https://www.spam-farm.example.com/de/5?utm_source=q", "https://www.spam-farm.example.com/de/6", "http://blog.tionsh.example.com/fr/7/", "http://blog.tionsh.example.com/es/7", "https://m.adult-x.example.org/fr/10.html#x", "http://x.example.com/" + "a" * 500_000, None]
    pages = spark.createDataFrame([*enumerate(urls)], "page_id long, url string").withColumns({n: F.lit("x") for n in ("host", "path", "rule", "listed", "__url", "__maybe")})
    got = {r.page_id: (r.listed, r.verdict) for r in url_filter.judge(pages, queries.block_list(spark), queries.URL_RULES).collect()}
    assert got == {0: (True, "block"), 1: (False, "allow"), 2: (True, "block"), 3: (False, "allow"), 4: (True, "block"), 5: (False, "allow"), 6: (False, "allow")}
    assert re.match("^[a-z]", url_filter.__name__)
