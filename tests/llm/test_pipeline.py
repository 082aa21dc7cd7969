"""The pipeline's stages, and run() as a whole, against brute force."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkmill.llm import language, mixing, near_dedup, queries

from .test_operators import LOW, components, shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(8)
    word = {"aa": list("abcdefg"), "bb": list("tuvwxyz")}
    make = lambda lang, n: " ".join("".join(rng.choice(word[lang], 5)) for _ in range(n))
    rows = [(i, make("aa" if i % 2 else "bb", 40), "aa" if i % 2 else "bb", ["big", "big", "big", "small"][i % 4]) for i in range(120)]
    base = rows[7][1]
    rows += [(200, base, "aa", "big"), (201, base.upper(), "aa", "small"), (202, base + " abcde", "aa", "big"), (203, rows[8][1].replace(rows[8][1][:5], "uuuuu"), "bb", None)]
    rows += [(300, None, "aa", "big"), (301, "", "aa", "big"), (302, "12 34 !!", "aa", "big"), (303, "é", "bb", "small"), (None, make("aa", 20), "aa", "big"), (None, None, "aa", "big")]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame([(*r, "kept", 1, "id") for r in rows], "doc_id long, text string, lang string, source string, row string, maybe int, id string").repartition(3)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_language_stage(spark, docs):
    out = cp.language_id(spark, docs, SF)
    assert out.columns == docs.columns
    net = language.train(docs.where("doc_id IS NULL OR crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2"))
    judged = {r.doc_id: r for r in language.identify(docs, net).collect()}
    goes = {i for i, r in judged.items() if i is not None and (r.lang_pred == "und" or r.score < 0.5 + 1 / 15)}
    assert {300, 301, 302} <= goes and not goes & set(range(120))
    same(out.collect(), [r for r in docs.collect() if r.doc_id not in goes])
    assert cp.language_id(spark, docs.limit(0), SF).count() == 0 and abs(cp.least_sure(4) - 0.35) < 1e-12


def test_exact_stage(spark, docs):
    rows = docs.collect()
    keep = {}
    for r in rows:
        t = (r.text or "").translate(LOW)
        keep[t] = max(keep.get(t, -1), -1 if r.doc_id is None else r.doc_id)
    out = cp.exact(spark, docs, SF)
    assert out.columns == docs.columns
    same(out.collect(), [r for r in rows if keep[(r.text or "").translate(LOW)] == (-1 if r.doc_id is None else r.doc_id)])


def test_near_stage(spark, docs):
    rows = docs.collect()
    root = components(list({r.doc_id: (r.doc_id, shingle_set(r.text)) for r in rows if r.doc_id is not None}.values()))
    assert root[202] == root[201] == root[200] == root[7] == 7 and root[203] == 8
    out = cp.near(spark, docs, SF)
    assert out.columns == docs.columns
    same(out.collect(), [r for r in rows if r.doc_id is None or root[r.doc_id] == r.doc_id])


def test_mixing_stage(spark, docs):
    rows = docs.collect()
    plan = mixing.Mix(docs, queries.vocabulary(), repetition_limit=cp.REPETITION_LIMIT).plan().collect()
    copies = {r.doc_id: r.copies for r in plan}
    out = cp.mix(spark, docs, SF)
    assert out.columns == docs.columns
    same(out.collect(), [r for r in rows for _ in range(copies[r.doc_id])])


def packed(pieces, texts):
    """Each text's ids are whole in the pieces, which fill their sequences without gaps."""
    own = Tokenizer.from_file(queries.vocabulary())
    digest = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    want = Counter()
    for i, t in texts:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 1024):
            want[i, a, len(ids[a : a + 1024]), digest(ids[a : a + 1024]), len(ids)] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    return len(sequences)


def test_packing_stage(spark, docs):
    packed(cp.pack(spark, docs, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_run_is_its_stages(spark):
    """run() over a whole table: every decision from brute force or, for learned and hashed ones, from the operator alone."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = documents.collect()
    net = language.train(documents.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2"))
    judged = {r.doc_id: r for r in language.identify(documents, net).collect()}
    rows = [r for r in rows if judged[r.doc_id].lang_pred != "und" and judged[r.doc_id].score >= cp.least_sure(len(net.labels))]
    keep = {}
    for r in rows:
        keep[(r.text or "").translate(LOW)] = max(keep.get((r.text or "").translate(LOW), -1), r.doc_id)
    rows = [r for r in rows if keep[(r.text or "").translate(LOW)] == r.doc_id]
    root = components([(r.doc_id, shingle_set(r.text)) for r in rows])
    rows = [r for r in rows if root[r.doc_id] == r.doc_id]
    left = spark.createDataFrame(rows, documents.schema)
    copies = {r.doc_id: r.copies for r in mixing.Mix(left, queries.vocabulary(), repetition_limit=cp.REPETITION_LIMIT).plan().collect()}
    pieces = cp.run(spark, SF).collect()
    used = packed(pieces, [(r.doc_id, r.text) for r in rows for _ in range(copies[r.doc_id])])
    assert used <= 1.02 * sum(p.length for p in pieces) / 1024 + 3


def test_recall_on_every_hundredth_id(spark):
    """Links of the ids divisible by 100 to all rows, found by the operator and by brute force."""
    rows = [(r.doc_id, shingle_set(r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    links = [(i, j) for i, x in rows if i % 100 == 0 for j, y in rows if i != j and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    assert all(got[i] == got[j] for i, j in links)
