"""Cases where an operator once did less than the whole job."""

import numpy as np

from sparkmill.llm import language, mixing, queries


def test_mixing_counts_the_tokens_of_the_vocabulary(spark):
    """Two sources of equal tokens and unequal bytes have equal weights."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.vocabulary())
    ids = lambda t: len(own.encode(t or "", add_special_tokens=False).ids)
    short, long = " the" * 500, " information" * 500
    assert ids(short) == ids(long) and len(long) > 2 * len(short)
    rows = [(i, long if i % 2 else short, "b" if i % 2 else "a") for i in range(40)] + [(40, None, "a"), (41, "", "b"), (None, "é <|endoftext|> 中文", "c")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").repartition(3)
    plan = mixing.Mix(docs, queries.vocabulary(), repetition_limit=1.25).plan().collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in plan) == sorted((i or -1, ids(t)) for i, t, _ in rows)
    weight = {r.source: r.weight for r in plan}
    assert abs(weight["a"] - weight["b"]) < 1e-12


def test_op5_gives_the_counts_of_op6(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = {r.doc_id: r.n_tokens for r in queries.op6_token_count(spark, sf_dir).collect()}
    assert {r.doc_id: r.n_tokens for r in queries.op5_mixing(spark, sf_dir).collect()} == want


def test_a_rare_language_is_a_label(spark):
    """Languages of 0.1 % and 0.5 % of the texts are learned from a sample that would miss them."""
    rng = np.random.default_rng(6)
    make = lambda alphabet: " ".join("".join(rng.choice(list(alphabet), 5)) for _ in range(20))
    rows = [(i, make("abcdefg"), "aa") for i in range(2000)] + [(5000 + i, make("tuvwxyz"), "bb") for i in range(10)] + [(6000 + i, make("klmnopq"), "cc") for i in range(2)]
    docs = spark.createDataFrame([*rows, (7000, "", "dd"), (7001, None, "dd")], "doc_id long, text string, lang string")
    net = language.train(docs, max_docs=60)
    assert net.labels == ["aa", "bb", "cc"]
    fresh = spark.createDataFrame([(9000 + i, make(a), lang) for i, (a, lang) in enumerate([("abcdefg", "aa"), ("tuvwxyz", "bb"), ("klmnopq", "cc")] * 10)], "doc_id long, text string, lang string")
    right = {r.doc_id: r.lang_pred for r in language.identify(fresh, net).collect()}
    assert np.mean([right[r.doc_id] == r.lang for r in fresh.collect()]) > 0.9


def test_shares_of_languages():
    assert language.shares({"en": 10**9, "fr": 10**6, "xx": 3}, 1500) == {"xx": 500, "fr": 748, "en": 749}
    assert set(language.shares({str(i): 5 for i in range(20)}, 10).values()) == {1}
