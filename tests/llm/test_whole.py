"""The whole job on tables that a bounded search, a single key or a smaller result would cut."""

import zlib

import numpy as np
from test_edges import segmentations

from lithoscope.llm import embedding_dedup, queries, sentencepiece_sampling, simhash, toxicity


def test_links_in_a_dense_group(spark):
    """A third of the vectors are distinct near-copies of one, many at about the threshold."""
    draw = np.random.default_rng(3)
    one = draw.normal(size=64)
    one /= np.linalg.norm(one)
    v = np.concatenate([one + draw.normal(size=(1000, 64)) * draw.uniform(0.03, 0.04, (1000, 1)), draw.normal(size=(2000, 64))])
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.93).sum(1) - 1
    assert 50_000 < want.sum() < 999_000
    for block in (4096, 400):
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert [got[i] for i in range(len(v))] == want.tolist()


def test_links_of_all_lengths_and_norms(spark):
    """Planted near-copies, copies, rare lengths and extreme norms against plain cosines; recall is 1."""
    draw, rows = np.random.default_rng(9), []
    for width, n in ((64, 900), (3, 40), (129, 60)):
        v = draw.normal(size=(n, width))
        near = v[: n // 2] + draw.normal(size=(n // 2, width)) * draw.uniform(0.1, 0.6, (n // 2, 1))
        rows += [(x * s).tolist() for x, s in zip(np.concatenate([v, near, v[:5]]), draw.choice([1.0, 2.0**-600, 2.0**600, 1e-3], 2 * n, replace=True).tolist() + [1.0] * 5)]
    rows += [[1e200, 0.0], [1e200, 0.0], [3e-200, 0.0], [5e-324], [1.7e308]]
    data = [(i, x, i % 2) for i, x in enumerate(rows)]
    want = {i: 0 for i, *_ in data}
    unit = [np.ldexp(np.array(x), -int(np.frexp(np.abs(x).max())[1])) for x in rows]
    unit = [u / np.sqrt(u @ u) for u in unit]
    for width in {len(x) for x in rows}:
        for label in (0, 1):
            some = [i for i, x, y in data if len(x) == width and y == label]
            if some:
                m = np.stack([unit[i] for i in some])
                for i, n in zip(some, ((m @ m.T) >= 0.93).sum(1) - 1, strict=True):
                    want[i] = int(n)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    for block in (4096, 64):
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        assert got == want and sum(want.values()) > 500


def test_one_of_each_component_is_kept(spark):
    """Documents without an id, and with one that another has, are told apart by their texts."""
    words = [f"{a}{b}" for a in ("ra", "so", "li", "ne", "mu") for b in ("ver", "tun", "gal", "pok", "wid")]
    draw = np.random.default_rng(1)
    text = [" ".join(draw.choice(words, 30)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (7, text[2]), (8, text[3]), (8, text[4]), (8, text[4]), (9, text[4]), (None, text[5]), (-(1 << 63), text[5]), (0, text[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == 6 and {(r.doc_id, r.text) for r in kept} == {(0, text[0]), (None, text[1]), (7, text[2]), (8, text[3]), (8, text[4]), (-(1 << 63), text[5])}


def test_rare_terms(spark):
    """One insult in most toxic documents, one in a few; a toxic document with many copies teaches no words of its own."""
    words = ["river", "stone", "light", "garden", "window", "letter", "music", "winter", "bridge", "forest", "silver", "candle"]
    draw = np.random.default_rng(2)
    said = lambda: " ".join(draw.choice(words, 40))
    copied = said() + " harmlessword you grumblefrotz"
    texts = [(said() + " you grumblefrotz", 1) for _ in range(500)] + [(said() + " you snorbwick", 1) for _ in range(12)] + [(copied, 1)] * 60 + [(said() + " you friend", 0) for _ in range(900)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(9001, said() + " you snorbwick"), (9002, said() + " harmlessword")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    terms = toxicity.train(docs, labels).terms
    assert any("snorbwick".startswith(t.rstrip("*")) for t in terms) and not any("harmlessword".startswith(t.rstrip("*")) for t in terms)
    score = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert score[9001] > 0.5 > score[9002]


def test_segmentations_are_returned(spark):
    """The query's ids decode to the text that the best segmentation decodes to."""
    sf_dir = "/root/testdata/sf0.001"
    rows = queries.op6_sentencepiece_sampling(spark, sf_dir).limit(300).cache()
    best = sentencepiece_sampling.encode(queries.table(spark, sf_dir, "documents"))
    want = {r.doc_id: r.text for r in sentencepiece_sampling.decode(best).collect()}
    got = sentencepiece_sampling.decode(rows).collect()
    assert len(got) == 300 and all(r.text == want[r.doc_id] for r in got)
    assert all(len(r.ids) == 4 * r.n_pieces and r.decodes for r in rows.collect())


def test_sampled_segmentations_of_short_texts(spark, tmp_path):
    """The query against all segmentations, one by one: probabilities, all of few, and the library's own encoding."""
    texts = ["", "a", "hi", "ab", "the", "x y", "no!", "cafe", "tea,", "漢é", "\n", "  ", "zq", "of it", None, "the" * 3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    sp, by = sentencepiece_sampling.processor(sentencepiece_sampling.model_path()), {}
    for r in queries.op6_sentencepiece_sampling(spark, f"file://{tmp_path}").collect():
        by.setdefault(r.doc_id, []).append(r)
    for k, text in enumerate(texts):
        best = sp.encode(text or "")
        assert all(r.decodes and r.best_n_pieces == len(best) and r.best_ids_crc32 == zlib.crc32(np.array(best, "<u4").tobytes()) for r in by[k])
        ids = [tuple(np.frombuffer(r.ids, "<i4").tolist()) for r in by[k]]
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and sp.decode(list(i)) == (text or "") for r, i in zip(by[k], ids, strict=True))
        if text != "漢é" and text != "\n":  # bytes are not among the pieces that the brute force tries
            want = segmentations(text or "", 2e-4)
            assert len(set(ids)) == len(ids) == min(3, len(want))
            assert all(abs(r.log_prob - np.log(want[i])) < 1e-9 for r, i in zip(by[k], ids, strict=True))
            assert len(want) > 3 or all(r.log_inclusion == 0 for r in by[k])
