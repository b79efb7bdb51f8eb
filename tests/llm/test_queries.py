"""The dealt queries on the provided tables, against SQL, plain recomputation or held-out labels."""

import os
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from oracle import SMALL, differences

from lithoscope.llm import oracle, queries, toxicity

MEDIUM = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the provided tables are not here")


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, a):
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_oracles(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL), oracle.ORACLES[name]) == []


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op1_packing(spark, SMALL).collect()
    docs, by_doc, by_sequence, tokens = texts(spark, SMALL), defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == docs.keys()
    for doc_id, text in docs.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        tokens += len(ids)
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [(p.piece, p.start, p.length) for p in pieces] == [(i, 4096 * i, min(4096, len(ids) - 4096 * i)) for i in range(-(-len(ids) // 4096))]
        assert [p.ids_crc32 for p in pieces] == [zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces[:-1])]).tolist()
        assert sum(p.length for p in pieces) <= 4096
    assert len(by_sequence) <= 1.01 * tokens / 4096 + 2


def test_embeddings(spark):
    rows = spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()
    v = np.array([r.embedding if r.embedding is not None else [np.nan] * 64 for r in rows], float)
    norm = np.sqrt((v * v).sum(1))
    usable = np.isfinite(v).all(1) & (norm > 0) & np.array([r.label is not None for r in rows])
    v[~usable] = 0
    cosine = (v @ v.T) / np.maximum(np.outer(norm, norm), 1e-300)
    label = np.array([-1 if r.label is None else r.label for r in rows])
    link = (cosine >= 0.93) & (label[:, None] == label) & usable[:, None] & usable & ~np.eye(len(v), dtype=bool)
    union = Union([r.vec_id for r in rows])
    for i, j in np.argwhere(link):
        union.join(rows[i].vec_id, rows[j].vec_id)
    want = sorted((r.vec_id, int(link[i].sum()), union.find(r.vec_id), union.find(r.vec_id) == r.vec_id) for i, r in enumerate(rows))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op3_embedding_dedup(spark, MEDIUM).collect()) == want


def test_simhash(spark):
    docs = texts(spark, MEDIUM)

    def bits(text):
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        counts = np.zeros(64, int)
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            counts += (h >> np.arange(64, dtype=np.uint64).astype(object)).astype(object) % 2 == 1
        return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0

    prints = {d: bits(t) for d, t in docs.items()}
    union, keys = Union(docs), list(docs)
    values = np.array([prints[d] for d in keys], np.uint64)
    for i, d in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 2):
            union.join(d, keys[i + 1 + j])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, MEDIUM).collect()}
    assert got == {d: (f"{prints[d]:016x}", union.find(d)) for d in docs}


@pytest.mark.parametrize("name, label, cut, least", [("op7_toxicity", "toxic", 0.5, 0.95), ("op9_quality_classifier", "quality", 0.3, 0.9)])
def test_held_out_labels(spark, name, label, cut, least):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    y, s = np.array([truth[r.doc_id] for r in held]), np.array([r.score for r in held])
    _, place, count = np.unique(s, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2)[place]  # equal scores share their mean rank
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    accuracy = np.mean([r.predicted == truth[r.doc_id] for r in held])
    print(name, len(held), y.mean(), "auc", auc, "accuracy", accuracy)
    assert auc > least and accuracy > 0.9


def test_pages(spark):
    rows = queries.op4_html_extract(spark, SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split(" ")) and "<script" not in r.text for r in rows)


class ArticleBlocks(HTMLParser):
    """The blocks of the articles of pages with tidy markup, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks += [""] if tag in ("article", "h1", "p", "ul", "li", "div") else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.blocks += [""] if tag in ("article", "h1", "p", "ul", "li", "div") else []
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def test_main_text_is_the_article(spark):
    want = {}
    for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").collect():
        parser = ArticleBlocks()
        parser.feed(r.html or "")
        parser.close()
        want[r.page_id] = " ".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)
    assert {r.page_id: r.text for r in queries.op4_html_extract(spark, MEDIUM).collect()} == want


def edits(a, b):
    """Levenshtein distance, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_plain_edit_distance():
    draw = np.random.default_rng(8)
    word = lambda low, high: "".join(draw.choice(list("abcd"), draw.integers(low, high)))
    terms = sorted({word(3, 12) + ("*" if draw.random() < 0.3 else "") for _ in range(60)})
    automaton = toxicity.LexiconAutomaton(terms)
    hits = 0
    for _ in range(1500):
        said = word(1, 14) if draw.random() < 0.5 else terms[draw.integers(len(terms))].rstrip("*") + word(0, 3)
        found = []
        for k, term in enumerate(terms):
            text = term.rstrip("*")
            least = min(edits(text, said[:n]) for n in range(len(said) + 1)) if term.endswith("*") else edits(text, said)
            found += [(least, k)] if least <= toxicity.edits_allowed(text) else []
        assert automaton.match(said) == min(found, default=None), said
        hits += bool(found)
    assert 300 < hits < 1400


def test_contexts_are_learnt(spark):
    """Quoted uses are clean and plain ones toxic: the learnt worth of a quoted hit falls, and quotation is told from abuse."""
    words = ["river", "stone", "light", "garden", "window", "letter", "music", "winter", "bridge", "forest", "silver", "candle"]
    draw = np.random.default_rng(6)
    said = lambda: " ".join(draw.choice(words, 40))
    texts = [(said() + " snorbwick " + said(), 1) for _ in range(300)] + [(said() + ' “an old snorbwick there” ' + said(), 0) for _ in range(40)] + [(said(), 0) for _ in range(900)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int"))
    assert model.contexts[0] == 1 and model.contexts[1] < 0.2
    matcher = toxicity.Matcher(model.terms)
    score = [model.score(matcher.hits(t)) for t in (said() + " snorbwick " + said(), said() + ' “that snorbwick of old” ' + said())]
    assert score[0] > 0.5 > score[1]


def test_quoted_abuse_with_a_pronoun_is_quotation(spark):
    """Whoever is addressed inside quotation marks is not the reader; a noun like "words" elsewhere marks no quotation."""
    words = ["river", "stone", "light", "garden", "window", "letter", "music", "winter", "bridge", "forest", "silver", "candle"]
    draw = np.random.default_rng(9)
    said = lambda: " ".join(draw.choice(words, 40))
    texts = [(said() + " snorbwick " + said(), 1) for _ in range(300)] + [(said(), 0) for _ in range(900)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int"))
    matcher = toxicity.Matcher(model.terms)
    assert matcher.hits('he said "you snorbwick" to the man')[(0, 0, 3)] == 1 and matcher.hits("you snorbwick")[(0, 0, 2)] == 1
    assert matcher.hits("plain words about a river here snorbwick")[(0, 0, 0)] == 1 and matcher.hits("the word snorbwick is old")[(0, 0, 1)] == 1
    score = lambda t: model.score(matcher.hits(said() + " " + t + " " + said()))
    assert score('he said "you snorbwick" to the man') < 0.5 < score("plain words about a river here snorbwick")
    assert score("you snorbwick") > 0.5
