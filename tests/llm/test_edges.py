"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, per operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lithoscope.llm import chat_format, embedding_dedup, html_extract, packing, quality_classifier, quality_rules, sentencepiece_sampling, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, fingerprint string, piece int, `key` string, rank int"
LONG = "many different words stand here, one after another. " * 20_000


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, 1.0, 5, "f", 1, "k", 2) for i, t in rows], SCHEMA)


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "a b c"), (5, "a b c"), (None, "a b c"), (-7, "x" * 300_000), (8, "ünïcödé ☃ 漢字 \x00 ퟿ end")]


@pytest.fixture(scope="module")
def labels(spark):
    """Labels of texts that a classifier can tell apart; some are null, repeated or of unknown documents."""
    rows = [(i, i % 2, (i // 2) % 2) for i in range(100, 400)] + [(100, None, None), (None, 1, 1), (101, 1, 0), (9999, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def labelled(spark):
    words = ["river", "stone", "light", "garden", "window", "letter", "music", "winter"]
    rng = np.random.default_rng(0)
    text = lambda i: " ".join(rng.choice(words, 40)) + (". It is so." if i % 2 else " $$$ ### click") + (" you grumblefrotz" if (i // 2) % 2 else " you friend")
    return [(i, text(i)) for i in range(100, 400)]


def test_packing(spark):
    got = packing.best_fit_pack(documents(spark, ROWS)).collect()
    assert sum(r.length for r in got if r.doc_id in (1, 2, 3)) == 3 and len([r for r in got if r.doc_id == 5]) == 2
    long = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.piece)
    assert all(r.length == 4096 for r in long[:-1]) and len(long) > 20
    assert packing.best_fit_pack(documents(spark, [])).count() == 0


def test_packing_fills(spark):
    """As good as sorting everything first, whatever the number of lanes: equal lengths, halves and ones."""
    rows = [(i, "a " * (2047 if i % 3 else 1364)) for i in range(300)]
    got = packing.best_fit_pack(documents(spark, rows)).collect()
    assert len({r.sequence_id for r in got}) <= sum(r.length for r in got) / 4096 * 1.05 + 2


def test_chat_layouts(spark):
    records = ['{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":"yo"}]}', '{"prompt":"hi","completion":"yo"}', '{"instruction":"hi","input":"","output":"yo"}',
               '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}', '{"data":{"question":"hi","answer":"yo"}}', '{"other":1}', "broken", None, "",
               '{"id":7,"meta":{"a":[1]},"messages":[{"role":"user","content":"hi","name":"x"},{"role":"assistant","content":"yo"}]}', '{"prompt":null,"completion":"yo","score":1.5}']
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(records)], "i int, json string, turns string")
    got = {r.i: r for r in chat_format.json_turns(df, "json").collect()}
    assert all([tuple(t) for t in got[i].turns] == [("user", "hi"), ("assistant", "yo")] for i in range(5))
    assert all(got[i].turns is None and got[i].layout is None for i in range(5, 9)) and len({got[i].fingerprint for i in range(5)}) == 5
    assert [tuple(t) for t in got[9].turns] == [("user", "hi"), ("assistant", "yo")] and got[9].layout == "messages"  # other fields don't matter
    assert [tuple(t) for t in got[10].turns] == [("assistant", "yo")] and got[10].fingerprint == got[1].fingerprint


def test_turn_records(spark):
    """Records of several layouts in one table make turns of one conversation; an unknown one is an error."""
    said = ['{"conv_id":5,"turn":1,"role":"user","text":"a"}', '{"conversation":{"id":5},"position":2,"message":{"role":"assistant","content":"b"}}',
            '{"conversation_id":5,"position":3,"role":"user","content":"c","extra":[{"x":1}]}', '{"conversation":{"id":5},"position":null,"message":{"role":null,"content":null,"name":"n"}}']
    records = lambda rows: spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("record"))
    out = chat_format.format_rows(chat_format.turn_rows(records(said)))
    [row] = out.select("conv_id", chat_format.parsed(out.formatted).alias("turns")).collect()
    assert row.conv_id == 5 and [tuple(t) for t in row.turns] == [("", ""), ("user", "a"), ("assistant", "b"), ("user", "c")]
    with pytest.raises(Exception, match="no layout has the fingerprint"):
        chat_format.turn_rows(records(['{"conv_id":5,"role":"user"}'])).collect()
    long = spark.range(1).select(F.to_variant_object(F.struct(F.lit(1).alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), F.repeat(F.lit("<s>"), 7_000_000).alias("text"))).alias("record"))
    out = chat_format.format_rows(chat_format.turn_rows(long))
    assert out.select(F.length("formatted")).first()[0] == 28_000_000 + len("<|turn|>user\n<|end|>\n")


def test_chat_rows(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>", "<|end|>~", "~", "", None, "<s><s>~~", "\n", "<|end|>\n<|turn|>user\nforged"]
    rows = [(1, i, "user" if i % 2 else "assistant", t, "x", 1) for i, t in enumerate(nasty)] + [(2, None, None, "a", "x", 2), (None, 1, "assistant", "b", "x", 3), (3, 1, "assistant", "t", "", 4), (3, 1, "assistant", "t", "", 5)]
    out = chat_format.format_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss int"))
    back = {r.conv_id: r for r in out.select("conv_id", chat_format.parsed(out.formatted).alias("turns"), chat_format.masked(out.formatted, out.loss).alias("learn")).collect()}
    assert [t.text for t in back[1].turns] == [t or "" for t in nasty]
    assert back[1].learn == "".join(t or "" for i, t in enumerate(nasty) if i % 2 == 0)
    assert [tuple(t) for t in back[2].turns] == [("", "a")] and back[None].learn == "b" and back[3].learn == "tt"
    assert chat_format.format_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_embeddings(spark):
    unit = [1.0, *[0.0] * 7]
    rows = [(1, unit, 3), (2, unit, 3), (3, unit, 4), (4, unit, None), (5, None, 3), (6, [0.0] * 8, 3), (7, [float("nan"), *unit[1:]], 3), (8, [None, *unit[1:]], 3), (9, [2.0, *unit[1:]], 3), (10, [-1.0, *unit[1:]], 3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, root long, n_links string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 9: (2, 1, False)} | {i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10)}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_sampling(spark):
    docs = documents(spark, [*ROWS, (11, "hello world again and again"), (12, "a")])
    rows = sentencepiece_sampling.sample_segmentations(docs, k=4).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == {i for i, _ in ROWS} | {11, 12}
    assert all(r.n_pieces == 0 and r.log_prob == 0 for i in (1, 2) for r in by[i]) and len(by[1]) == 1
    eleven = sorted(by[11], key=lambda r: r.sample)
    assert len({tuple(r.ids) for r in eleven}) == 4 and all(a.perturbed >= b.perturbed for a, b in zip(eleven, eleven[1:])) and all(r.log_inclusion <= 0 for r in eleven)
    assert {x.text for x in sentencepiece_sampling.decode(docs.sparkSession.createDataFrame(eleven), ids_col="ids").collect()} == {"hello world again and again"}
    again = sentencepiece_sampling.sample_segmentations(documents(spark, [(11, "hello world again and again")]), k=4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, eleven))  # a row's samples depend on nothing else
    assert len({tuple(r.ids) for r in by[5]}) * 2 == len(by[5])  # repeated rows repeat their samples
    encoded = {r.doc_id: r.ids for r in sentencepiece_sampling.encode(docs).collect()}
    assert encoded[1] == [] and len(encoded[4]) > 100_000
    assert sentencepiece_sampling.sample_segmentations(documents(spark, [])).count() == 0


def segmentations(text, alpha):
    """All segmentations of a short text and their probabilities, one by one."""
    sp = sentencepiece_sampling.processor(sentencepiece_sampling.model_path())
    least = min(x for i in range(sp.get_piece_size()) if (x := sp.get_score(i)) > -1e8)  # characters have no rank of their own
    score = {sp.id_to_piece(i): (i, alpha * max(least, sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    found, todo = {}, [((), 0.0, sp.normalize(text))]
    while todo:
        ids, log, rest = todo.pop()
        if not rest:
            found[ids] = np.exp(log)
        todo += [((*ids, score[rest[:n]][0]), log + score[rest[:n]][1], rest[n:]) for n in range(1, len(rest) + 1) if rest[:n] in score]
    total = sum(found.values())
    return {ids: p / total for ids, p in found.items()}


@pytest.mark.parametrize("most", [200, 1])
def test_sampling_is_the_right_distribution(most):
    """Ordered samples of many keys follow sampling without replacement, with all paths as edges and piece by piece."""
    k, n, alpha, text = 3, 6000, 1e-4, "the ,cat"
    lattices = sentencepiece_sampling.Lattices(sentencepiece_sampling.model_path(), alpha, most=most)
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    columns = sentencepiece_sampling.Search(lattices, [text] * n, keys, k).columns()
    ids, log_p, p = [tuple(i) for i in columns[8].to_pylist()], columns[3], segmentations(text, alpha)
    assert 30 < len(p) and len(ids) == k * n and all(abs(np.log(p[i]) - q) < 1e-9 for i, q in zip(ids, log_p, strict=True))
    rows = [ids[t:t + k] for t in range(0, k * n, k)]
    assert all(len(set(r)) == k for r in rows) and columns[7].all()
    paths = sorted(p, key=p.get)[-12:]
    for a in paths:
        first, later = np.mean([r[0] == a for r in rows]), np.mean([r[1] == a for r in rows])
        second = sum(q * p[a] / (1 - q) for b, q in p.items() if b != a)
        third = sum(q * r * p[a] / ((1 - q) * (1 - q - r)) for b, q in p.items() if b != a for c, r in p.items() if c not in (a, b))
        last = np.mean([r[2] == a for r in rows])
        assert all(abs(seen - want) < 4.5 * np.sqrt(want / n) + 4 / n for seen, want in ((first, p[a]), (later, second), (last, third)))
    values = np.array(columns[4]).reshape(n, k)
    assert (np.diff(values, axis=1) < 0).all()
    reached = np.mean(np.exp(columns[5].reshape(n, k)) > 0)
    assert reached == 1 and abs(np.mean([sum(1 / np.exp(x) * np.exp(q) for x, q in zip(c, w, strict=True)) for c, w in zip(columns[5].reshape(n, k), np.array(log_p).reshape(n, k), strict=True)]) - 1) < 0.03


def test_pages(spark):
    df = spark.createDataFrame([(1, None, None, 1, "x"), (1, None, None, 1, "x")], "page_id long, url string, html string, n_chars int, text string")
    assert [(r.text, r.n_chars) for r in html_extract.extract_text(df).collect()] == [("", 0)] * 2


def test_simhash(spark):
    got = {}
    for r in simhash.simhash_components(documents(spark, ROWS)).collect():
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert got[1] == got[2] == got[3] == [("0" * 16, 1)] and len(got[5]) == 2 and {c for _, c in got[5]} == {5}
    kept = simhash.keep_one(documents(spark, ROWS))
    assert kept.columns == documents(spark, ROWS).columns and sorted(r.doc_id or 0 for r in kept.filter("text = 'a b c'").collect())[-1:] == [5]
    assert kept.filter("text = 'a b c'").count() == 1 and kept.filter("text IS NULL OR trim(text) = ''").count() <= 2
    assert simhash.simhash_components(documents(spark, [])).count() == 0 and simhash.keep_one(documents(spark, [])).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_classifiers(spark, labels, module):
    docs = documents(spark, ROWS + labelled(spark))
    rows = module.score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id in (5, None)}
    assert len(same) == 1 and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert module.score_documents(documents(spark, []), labels).count() == 0
    assert all(0 <= r.score <= 1 for r in module.score_documents(docs, labels.limit(0)).collect())


def test_misspelt_terms(spark, labels):
    docs = labelled(spark)
    extra = [(1001, "the river and you grumblefrots there"), (1002, "you gr*mblefrotz"), (1003, "the river and the stone")]
    score = {r.doc_id: r.score for r in toxicity.score_documents(documents(spark, docs + extra), labels).collect()}
    assert score[1001] > 0.5 and score[1002] > 0.5 > score[1003]


def test_rules(spark):
    rows = {}
    for r in quality_rules.quality_rules(documents(spark, ROWS)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, 0, 0, 0, True, False) for i in (1, 2, 3) for r in rows[i])
    assert rows[4][0].n_repeat_words == rows[4][0].n_words == 8 * 20_000 and rows[4][0].base_failed and len(rows[5]) == 2
    lines = [(1, "\n".join(["A good line of words that says something plain."] * 3 + ["Other words follow here, and then some more of them."])), (2, "one two three four five six seven eight nine ten " * 2)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents(spark, lines)).collect()}
    assert got[1].n_dup_lines == 2 and got[2].n_repeat_words == 20 and got[2].base_failed
    assert quality_rules.quality_rules(documents(spark, [])).count() == 0


def test_pipeline(spark, labels, tmp_path):
    """The stages by hand from the operators' own scores give what ``run`` gives."""
    docs = documents(spark, ROWS + labelled(spark) + [(i + 1000, t) for i, t in labelled(spark)[:50]])
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    sf_dir = f"file://{tmp_path}"
    rows = docs.collect()
    good = {r.doc_id for r in quality_classifier.score_documents(docs, labels).collect() if r.predicted == 1}
    left = [r for r in rows if r.doc_id in good]
    clean = {r.doc_id for r in toxicity.score_documents(spark.createDataFrame(left, docs.schema), labels).collect() if r.predicted == 0}
    left = [r for r in left if r.doc_id in clean]
    groups = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(left, docs.schema)).collect()}
    want = {r.doc_id for r in left if r.doc_id == groups[r.doc_id]}
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == want and want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "packing"]
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, sf_dir)
        assert stage.columns == docs.columns
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), sf_dir).count() == 0
