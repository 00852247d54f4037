"""Lexical search, toxicity and tokenizer alignment: brute force, held-out accuracy, odd tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from graphloom.llm import alignment, common, lexical, packing, toxicity
from tests.conftest import duck
from tests.llm.conftest import SCHEMA, SF, odd_rows

# -- lexical search ----------------------------------------------------------------------------------

ITEMS = [(1, "alpha3 beta1 Émoji"), (1, "w5 x60 w5"), (2, ""), (3, None), (None, "PASSWORD straße zürich"), (1, "w5 x60 w5"), (4, "nowhere")]
_ASCII_LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)


def ranked(docs, items, k):
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate(_ASCII_LOWER))
    bags = [(d, collections.Counter(words(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df, out = collections.Counter(w for _, b in bags for w in b), []
    for item, text in {(i, t or "") for i, t in items}:
        scores = []
        for d, bag in bags:
            m = 50 + 50 * bag.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * bag[w] // (1000 * bag[w] + 20 * m)) for w in set(words(text)) if bag[w])
            scores += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def test_search_is_brute_force(spark, odd, none):
    from pyspark.sql import functions as F

    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    docs = [(r[0], r[1]) for r in odd_rows()]
    for k in (50, 2):
        got = lexical.search(odd, items, k)
        assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(docs, ITEMS, k)
    assert lexical.search(none, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


def test_search_in_blocks_of_queries(spark, odd, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(lexical, "TERM_BYTES", 60)
    assert lexical._blocks(common.written(items.selectExpr("xxhash64(item_id, text) as hash", "50L as bytes"), "t")) > 1
    got = lexical.search(odd, items)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked([(r[0], r[1]) for r in odd_rows()], ITEMS, 50)


def test_windows_and_heaps(monkeypatch):
    """Small windows, short pieces and full heaps give what one large window gives."""
    rng = np.random.default_rng(3)
    docs = [(int(i), " ".join(f"t{x}" for x in rng.zipf(1.3, rng.integers(0, 60)) % 50)) for i in rng.permutation(300)]
    items = [(q, " ".join(f"t{x}" for x in rng.integers(0, 50, 12))) for q in range(8)]
    vocabulary = {x.encode(): i for i, x in enumerate(sorted({w for _, t in items for w in t.split()}))}
    monkeypatch.setattr(lexical, "WINDOW", 37)
    monkeypatch.setattr(lexical, "PIECE", 5)
    index, rows = lexical.Index(vocabulary), []
    for d, t in docs:
        index.add(d, t)
        if index.full():
            rows.append(index.row())
    rows.append(index.row())
    read = [[np.array(r.column(c)[0].as_py()) for c in r.schema.names] for r in rows]
    lengths, df = np.concatenate([x[1] for x in read]), collections.Counter()
    for x in read:
        df.update(dict(zip(x[2].tolist(), x[3].tolist())))
    weights = np.array([lexical.weight(int((lengths > 0).sum()), df[t]) for t in range(len(vocabulary))])
    scores = lexical.Scores([np.unique([vocabulary[w.encode()] for w in t.split()]) for _, t in items], weights, int((lengths > 0).sum()), int(lengths.sum()), 5)
    for x in read:
        scores.window(*(v.astype(np.int64) for v in x))
    got = [(q, r + 1, -d, s) for q, heap in enumerate(scores.heaps) for r, (s, d) in enumerate(sorted(heap, reverse=True))]
    assert sorted(got, key=str) == ranked(docs, items, 5)


# -- toxicity ----------------------------------------------------------------------------------------


def test_gradients():
    net = toxicity.Network(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    f = toxicity.features(["abc", "de", "fgh", "a", "idiot"], {"abc": 1, "de": 2, "idiot": 3})
    at = np.zeros((3, toxicity.LENGTH), np.int64)
    at[0, :4], at[1], at[2, 0] = [1, 2, 3, 5], 1 + np.arange(toxicity.LENGTH) % 5, 4
    labels = np.array([1.0, 0, 1])

    def loss():
        out = net.forward(net.projected(net.inputs(f)), at)
        return (np.log1p(np.exp(out)) - labels * out).sum()

    keep, x = {}, net.inputs(f)
    g = net.backward(f, x, at, keep, toxicity._gate(net.forward(net.projected(x), at, keep)) - labels)
    for k, v in net.p.items():
        flat, slopes = v.reshape(-1), np.asarray(g[k]).reshape(-1)
        for i in np.argsort(-abs(slopes))[:3]:
            before = flat[i]
            flat[i] = before + 1e-2
            high = loss()
            flat[i] = before - 1e-2
            low = loss()
            flat[i] = before
            assert abs((high - low) / 2e-2 - slopes[i]) < 2e-3 + 0.02 * abs(slopes[i]), k


def test_windows_cover_all_units():
    for n in range(0, 150):
        at = toxicity.windows(n)
        assert set(at[at > 0].tolist()) == set(range(1, n + 1))
        assert not n or at[:, 0].min() == 1 and (np.diff(at[:, 0]) == toxicity.STRIDE).all()


@pytest.fixture(scope="module")
def trained():
    rows = duck("/root/testdata/sf0.1").execute("SELECT doc_id, toxic, text FROM labels JOIN documents USING (doc_id) ORDER BY doc_id LIMIT 1500").fetchall()
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 5 == 0
    learn, test = [r for r in rows if not held(r)], [r for r in rows if held(r)]
    share = sum(r[1] for r in learn) / len(learn)
    return toxicity.fit([r[2] for r in learn], [r[1] for r in learn], share), test


def test_held_out_accuracy(trained):
    model, test = trained
    scores, labels = toxicity.Scorer(model).scores([r[2] for r in test]), np.array([r[1] for r in test])
    order = np.argsort(np.argsort(scores))
    area = (order[labels == 1].mean() - (labels.sum() - 1) / 2) / (labels == 0).sum()
    assert area > 0.85
    assert (scores[labels == 0] >= 0.5).mean() < 0.04 and (scores[labels == 1] >= 0.5).mean() > 0.5


def test_long_texts_score_as_their_windows(trained, monkeypatch):
    model, test = trained
    text = " ".join(r[2] for r in test[:40]) + " end"
    whole = toxicity.Scorer(model).scores([text, None, "", " \n", "x" * 1000])
    monkeypatch.setattr(toxicity, "BLOCK", 700)
    monkeypatch.setattr(toxicity, "KEPT", 300)
    parts = toxicity.Scorer(model).scores([text, None, "", " \n", "x" * 1000])
    assert np.allclose(whole, parts, atol=1e-5)
    assert np.allclose(whole[1:4], model.share)
    units = [x for part in toxicity.units_of(text) for x in part]
    assert units == re.findall(rf"[^\x20\x09-\x0D]{{1,{toxicity.UNIT_CHARS}}}", text.lower())
    each = [" ".join(units[i : i + toxicity.LENGTH]) for i in toxicity.window_starts(len(units))]
    assert np.isclose(whole[0], toxicity.Scorer(model).scores(each).max(), atol=1e-5)


def test_toxicity_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 1), (6, 0, None), (None, 0, 1), (9, 0, 7), (1, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learned(odd, labels)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score_toxicity(none, model).count() == 0
    nothing = toxicity.learned(none, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(odd, nothing).collect()} == {0.0}
    hidden = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert toxicity.learned(odd, spark.createDataFrame([(i, 0, 1) for i in hidden], "doc_id long, quality int, toxic int")).share == 0


# -- alignment ---------------------------------------------------------------------------------------

STRANGE = ["a ", " a  b ", "\n x\n\n y \t", "<|endoftext|> <s>x</s> <0x41>", "é🙂Straße\x00 \x1c \x85 x", "▁ blank", " ", "\n", "a" * 300, "日本語 テキスト", "don't  we'll\r\nx   y", "ﬁ 　 x"]


def aligned(texts):
    """By byte offsets, with the tokenizers' own whole encodings."""
    import sentencepiece
    import tokenizers

    byte = tokenizers.Tokenizer.from_file(packing.default_tokenizer())
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    symbols = packing._byte_symbols()
    out = []
    for text in texts:
        a, b = (byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)) if text else ([], [])
        own_a = [bytes(symbols[c] for c in byte.id_to_token(i)) for i in a]
        names = [piece.id_to_piece(i) for i in b]
        own_b = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
        if not text or not b"".join(own_a) == b"".join(own_b) == b" " + text.encode():
            out.append((0, 0, 0, "", collections.Counter()))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in own_a]).tolist(), np.cumsum([len(x) for x in own_b]).tolist()
        links, i, j = collections.Counter(), 0, 0
        for end in sorted({*ends_a, *ends_b}):
            links[a[i], b[j]] += 1
            i, j = i + (ends_a[i] == end), j + (ends_b[j] == end)
        groups, at, after_a, after_b = [], (0, 0), {e: i + 1 for i, e in enumerate(ends_a)}, {e: i + 1 for i, e in enumerate(ends_b)}
        for end in sorted({*ends_a} & {*ends_b}):
            to = (after_a[end], after_b[end])
            groups.append(",".join(map(str, a[at[0] : to[0]])) + "|" + ",".join(map(str, b[at[1] : to[1]])))
            at = to
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    counts = collections.Counter(pair for x in out for pair in x[4])
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    return [(n_a, n_b, g, links.total(), sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items()), sha) for n_a, n_b, g, sha, links in out]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignment_is_brute_force(spark, odd, none, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(alignment, "HOT_PAIRS", 300)
    texts = [r[0] for r in duck(SF).execute("SELECT text FROM documents WHERE length(text) < 4000 ORDER BY doc_id").fetchall()] + STRANGE * 2
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    got = sorted(alignment.align(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert [tuple(r[c] for c in COLUMNS) for r in got] == aligned(texts)
    out = alignment.align(odd)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out.collect()) == sorted(aligned([r[1] for r in odd_rows()]))
    assert alignment.align(none).count() == 0


def test_alignment_in_chunks(monkeypatch):
    """Chunks, words that are forgotten, words too long to keep and a machine begun anew change nothing."""
    texts = [r[0] for r in duck(SF).execute("SELECT text FROM documents ORDER BY doc_id LIMIT 30").fetchall()] + STRANGE
    row = lambda x: [y.tolist() if isinstance(y, np.ndarray) else y for y in x.row()]
    make = lambda: alignment.Aligner(packing.default_tokenizer(), alignment.default_pieces())
    whole = [row(x) for x in make().documents(texts)]
    monkeypatch.setattr(alignment, "CHUNK", 90)
    monkeypatch.setattr(alignment, "WORDS", 20)
    monkeypatch.setattr(alignment, "WORD_CHARS", 4)
    monkeypatch.setattr(alignment, "MEMO", 50)
    assert [row(x) for x in make().documents(texts)] == whole


def test_transducer():
    machine = alignment.Machine([b"ab", b"c", b"", b"abc", b"d"], [b"a", b"bc", b"abcd", b"x"])
    assert machine.align([0, 1], [0, 1]).tolist() == [0, 1, 1, 2]
    assert machine.align([3, 4], [2]).tolist() == [0, 1, 2]
    assert machine.align([0, 1], [0]) is None and machine.align([0], [3]) is None and machine.align([1], []) is None
    steps = machine.steps
    machine.align([0, 1, 3, 4], [0, 1, 2])
    assert machine.steps == steps  # all of them were met
