import zlib

import numpy as np
import pandas as pd
import pytest

from papyr.llm import labelled, language_id, quality_cnn, toxicity
from papyr.llm.language_id import LanguageFilters, identify_languages
from papyr.llm.quality_cnn import classify_quality
from papyr.llm.toxicity import classify_toxicity

from .common_cases import LONG, empty_docs, hard_docs

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def remainder(ids, m):
    return np.array([zlib.crc32(str(i).encode()) % m for i in ids])


def test_language_held_out_accuracy(documents):
    got = identify_languages(documents).select("doc_id", "held_out", "lang_pred", "score", "lang").toPandas()
    assert (got.held_out == (remainder(got.doc_id, 5) == 0)).all()
    assert got.score.between(0, 1).all()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.99


def test_language_edge_cases(spark):
    docs = hard_docs(spark)
    got = identify_languages(docs)
    assert set(docs.columns) <= set(got.columns)
    rows = got.select("doc_id", "text", "lang_pred", "score").toPandas()
    assert len(rows) == docs.count()
    letterless = ~rows.text.fillna("").map(lambda t: any(map(str.isalpha, t))).astype(bool)
    assert (rows.lang_pred[letterless] == "und").all() and (rows.score[letterless] == 0).all()
    assert (rows.lang_pred[~letterless] != "und").all()
    assert identify_languages(empty_docs(spark)).count() == 0
    assert set(r.lang_pred for r in identify_languages(docs.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()) == {"und"}


def test_long_texts_count_each_gram_once(monkeypatch):
    text = ("alpha beta gamma delta " * 300).strip()
    grams = {n: sorted(language_id._grams(b, n)[1].tolist()) for n in language_id.GRAMS for b in [next(language_id._blocks([text]))]}
    monkeypatch.setattr(language_id, "BLOCK", 50)
    for n in language_id.GRAMS:
        parts = [g for b in language_id._blocks([text]) for g in language_id._grams(b, n)[1].tolist()]
        assert sorted(parts) == grams[n]


def filters_of(languages, members, slot_bits):
    """The slots of given n-grams, bit by bit."""
    slots = {}
    for i, grams in enumerate(members):
        for at in language_id._slots_of(grams, slot_bits):
            for x in at.tolist():
                slots[i // 64, x] = slots.get((i // 64, x), 0) | 1 << i % 64
    words, at = np.array(list(slots)).T
    return LanguageFilters.of_slots(languages, slot_bits, words, at, np.array(list(slots.values()), np.uint64))


def plain_grams(text):
    """All 3- and 4-grams of a text, letters lower-cased and anything else a space, whose inner characters are letters."""
    plain = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text or ''} ")
    plain += "  "
    return [plain[i : i + n] for n in (3, 4) for i in range(len(plain) - n + 1) if " " not in plain[i + 1 : i + n - 1]]


def test_language_shares_and_predictions_against_brute_force(spark):
    """Sets of all n-grams of a language's learned texts, without a filter: the shares differ by chance hits alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = [(9001, "Das ist ein Satz mit Wörtern, die es gibt", None), (9002, "", "en"), (9003, None, "en"), (9004, "12 34", "en"), (9005, "the " * 3000, None), (None, "the cat", "xx")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string")).repartition(3)
    got = identify_languages(docs).toPandas()
    learned = got[(~got.held_out) & got.lang.notna() & got.text.notna()]
    sets = {lang: set().union(*map(plain_grams, texts)) for lang, texts in learned.groupby("lang")["text"]}
    languages, close = sorted(sets), 0
    assert "xx" not in sets
    for r in got.itertuples():
        grams = plain_grams(r.text)
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score, r.share) == ("und", 0.0, 0.0)
            continue
        shares = np.array([sum(g in sets[x] for g in grams) / max(len(grams), 1) for x in languages])
        first, second = np.sort(shares)[::-1][:2]
        if first - second > 0.02:
            close += 1
            assert r.lang_pred == languages[shares.argmax()]
            assert abs(r.share - first) < 0.02 and abs(r.score - first / shares.sum()) < 0.02
    assert close > 0.9 * len(got)


def test_languages_that_tie_are_settled_by_name(spark):
    rows = [(i, "alpha beta gamma", x) for i, x in enumerate(["b", "a", "c"] * 20)] + [(100, "zzz qqq", None)]
    got = identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in got.collect()} == {"a"}
    clash = spark.createDataFrame([(1, "one two", "en", 5, "k", "u")], "doc_id long, text string, lang string, score int, row string, own string")
    (r,) = identify_languages(clash).collect()
    assert (r.row, r.own) == ("k", "u") and 0 <= r.score <= 1


def test_filter_size_is_bounded():
    for grams, languages in ((1, 1), (50_000, 4), (10**7, 4), (10**6, 500), (10**9, 10**5)):
        bits = language_id.slot_bits_for(grams, languages)
        assert 8 * -(-languages // 64) << bits <= max(language_id.FILTER_BYTES, 1)
    assert 1 << language_id.slot_bits_for(50_000, 4) >= 50_000 * language_id.SLOTS_A_GRAM


def test_saturated_filters_tell_nothing_and_are_not_fitted(spark, monkeypatch):
    rng = np.random.default_rng(2)
    full = filters_of(("a", "b"), [rng.integers(0, 1 << 62, 40_000).astype(np.uint64), rng.integers(0, 1 << 62, 200).astype(np.uint64)], 10)
    assert full.fpr[0] == 1 and full.fpr[1] < 1
    shares = full.shares(["some words", "", "other words here"])
    assert np.isfinite(shares).all() and (shares[:, 0] == 0).all()
    assert language_id.overfull(10**6, 10) and not language_id.overfull(10**4, 20)
    bits = language_id.slot_bits_for(10**8, 4)  # as many slots as fit, far too few
    assert 8 << bits == language_id.FILTER_BYTES and language_id.overfull(10**8, bits)
    monkeypatch.setattr(language_id, "FILTER_BYTES", 1 << 16)
    words = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 60))
    rows = [(i, words() + (" der die das und ist nicht" if i % 2 else " the and of that with which") * 40, "de" if i % 2 else "en") for i in range(200)]
    fitted = language_id.fit_language_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert fitted.slots.nbytes <= 1 << 16 and (fitted.fpr < 0.3).all()  # fewer texts are taken until they fit
    assert fitted.shares(["der die das und ist nicht"])[0].argmax() == 0


def test_samples_stay_within_their_bytes_and_keep_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("toxic " if i % 2 else "clean ") * (200_000 if i % 40 < 2 else 20)) for i in range(400)] + [(7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    whole = {(r.id, r.text) for r in labelled.sample_labelled(docs, labels, "toxic", 10_000, 5, 0)[0].collect()}
    monkeypatch.setattr(labelled, "CLASS_BYTES", 3_000_000)
    rows, share = labelled.sample_labelled(docs, labels, "toxic", 10_000, 5, 0)
    rows = rows.collect()
    assert {(r.id, r.text) for r in rows} < whole and abs(share - 0.5) < 0.1
    for label in (0, 1):
        own = sum(len(r.text) for r in rows if r.label == label)
        assert 2_000_000 < own <= 3_000_000
    monkeypatch.setattr(labelled, "CLASS_BYTES", 1)
    assert {r.label for r in labelled.sample_labelled(docs, labels, "toxic", 10_000, 5, 0)[0].collect()} == {0, 1}


def test_slots_are_independent_of_one_another():
    a, b, c = language_id._slots_of(np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(77), 12)
    for x, y in ((a, b), (b, c), (a, c)):
        assert len(np.unique(x * 4096 + y)) > 0.98 * (1 << 16)  # pairs hardly repeat
    assert len(np.unique(language_id._slots_of(np.random.default_rng(0).integers(0, 1 << 63, 10**6).astype(np.uint64), 23)[2])) > 0.9 * 10**6


def test_bit_slices_return_all_languages_and_correct_false_positives():
    rng = np.random.default_rng(1)
    members = [rng.integers(0, 1 << 62, 3000).astype(np.uint64) for _ in range(70)]
    shared = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    members = [np.concatenate([m, shared]) if i in (3, 68) else m for i, m in enumerate(members)]
    filters = filters_of(tuple(f"l{i:02}" for i in range(70)), members, 14)
    masks = filters.masks(shared)
    assert ((masks[0] >> np.uint64(3)) & np.uint64(1)).all() and ((masks[1] >> np.uint64(4)) & np.uint64(1)).all()
    others = rng.integers(0, 1 << 62, 20000).astype(np.uint64)
    seen = np.mean((filters.masks(others)[0] >> np.uint64(5)) & np.uint64(1))
    assert abs(seen - filters.fpr[5]) < 0.02


def accuracy(got, truth, column):
    both = got.merge(truth[["doc_id", column]].drop_duplicates("doc_id"), on="doc_id")
    out = both[both.held_out]
    hit = out.predicted == out[column]
    return hit.mean(), hit[out[column] == 1].mean(), hit[out[column] == 0].mean()


def test_quality_held_out_accuracy(documents, labels):
    got = classify_quality(documents, labels).toPandas()
    assert (got.held_out == (remainder(got.doc_id, 3) == 1)).all() and got.score.between(0, 1).all()
    overall, good, bad = accuracy(got, labels.toPandas(), "quality")
    assert overall > 0.97 and good > 0.97 and bad > 0.85


def test_toxicity_held_out_accuracy(documents, labels):
    got = classify_toxicity(documents, labels).toPandas()
    assert (got.held_out == (remainder(got.doc_id, 5) == 0)).all() and got.score.between(0, 1).all()
    overall, toxic, clean = accuracy(got, labels.toPandas(), "toxic")
    assert overall > 0.95 and toxic > 0.85 and clean > 0.95


@pytest.mark.parametrize("classify,column", [(classify_quality, "quality"), (classify_toxicity, "toxic")])
def test_classifiers_take_hard_rows(spark, classify, column):
    docs = hard_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (6, 0, 0), (7, 1, 1), (7, 0, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and got.predicted.isin([0, 1]).all()
    assert got[got.doc_id.isna()].held_out.all()
    none = classify(docs, labels.limit(0)).toPandas()
    assert np.allclose(none.score, 0.5)
    assert classify(empty_docs(spark), labels).count() == 0


def cnn(seed=1):
    rng = np.random.default_rng(seed)
    tables = rng.normal(size=(quality_cnn.TAPS, 257, quality_cnn.FILTERS)).astype(np.float32)
    return quality_cnn.ByteCNN(tables, rng.normal(size=quality_cnn.FILTERS).astype(np.float32), rng.normal(size=quality_cnn.FILTERS).astype(np.float32), 0.1)


def slow_cnn(model, text):
    raw = list(text) or [quality_cnn.PAD]
    logits = []
    for at in quality_cnn.chunk_starts(len(raw)):
        best = np.full(quality_cnn.FILTERS, -np.inf)
        for p in range(at, min(at + quality_cnn.CHUNK, len(raw))):
            window = [raw[q] if q >= 0 else quality_cnn.PAD for q in range(p - quality_cnn.TAPS + 1, p + 1)]
            best = np.maximum(best, sum(model.tables[j][b] for j, b in enumerate(window)))
        logits.append(np.maximum(best + model.bias, 0) @ model.out)
    return 1 / (1 + np.exp(-(np.mean(logits) + model.out_bias)))


def test_cnn_scores_equal_the_plain_loop(monkeypatch):
    texts = [b"", None, b"a", b"short text", LONG.encode()[:3000], bytes(range(256)) * 5]
    for block in (1 << 16, 700):
        monkeypatch.setattr(quality_cnn, "BLOCK", block)
        assert np.allclose(cnn().scores(texts), [slow_cnn(cnn(), t or b"") for t in texts], atol=1e-4)


def test_cnn_gradients_cover_every_chunk(monkeypatch):
    """Against differences of the loss that the scoring code gives, blocks of any size alike."""
    rng = np.random.default_rng(3)
    texts = [b"", b"short", bytes(rng.integers(0, 256, 3000).tolist()), b"abc " * 700, LONG.encode()[:9000]]
    raw = [np.frombuffer(t, np.uint8).astype(np.uint16) if t else np.full(1, quality_cnn.PAD, np.uint16) for t in texts]
    labels, weight = np.array([0, 1, 1, 0, 1]), np.array([1.0, 0.5, 2.0, 1.0, 1.0])
    model = cnn(5)
    model.tables[:, quality_cnn.PAD] = 0
    w = {"tables": model.tables.copy(), "bias": model.bias.copy(), "out": model.out.copy(), "out_bias": np.array([0.1], np.float32)}
    whole = quality_cnn.gradients(w, raw, labels, weight)
    monkeypatch.setattr(quality_cnn, "CHUNKS_AT_ONCE", 3)
    for k, g in quality_cnn.gradients(w, raw, labels, weight).items():
        assert np.allclose(g, whole[k], atol=1e-5)

    def loss(w):
        p = quality_cnn.ByteCNN(w["tables"], w["bias"], w["out"], float(w["out_bias"][0])).scores(texts)
        return -np.mean(weight * np.where(labels == 1, np.log(p), np.log(1 - p)))

    for k, at in [("out", (3,)), ("out_bias", (0,)), ("tables", (1, ord("b"), int(np.abs(whole["tables"][1, ord("b")]).argmax()))), ("tables", (0, 32, int(np.abs(whole["tables"][0, 32]).argmax())))]:
        up, down = ({n: v.astype(np.float64) for n, v in w.items()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert np.isclose((loss(up) - loss(down)) / 2e-4, whole[k][at], atol=2e-3)


def test_cnn_learns_from_the_end_of_a_long_text():
    """The classes differ only in the last bytes of long texts."""
    rng = np.random.default_rng(6)
    filler = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    texts = [(filler(5000) + ("QXZQXZ" * 60 if i % 2 else filler(360))).encode() for i in range(80)]
    labels = np.arange(80) % 2
    model = quality_cnn.fit(texts, labels, 0.5, epochs=40, batch=16)
    assert ((model.scores(texts) >= 0.5) == labels).mean() > 0.95


def test_toxicity_margins_equal_the_plain_loop(monkeypatch):
    rng = np.random.default_rng(2)
    model = toxicity.SubwordToxicity(rng.normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32), np.array([1.0, 1.0, 0.0]))

    def word_value(w):
        b = f" {w} ".encode()
        grams = [b[i : i + n] for n in toxicity.GRAMS for i in range(len(b) - n + 1) if b" " not in b[i + 1 : i + n - 1]]
        values = []
        for g in grams:
            h = len(g)
            for c in g:
                h = ((h << 8) | c) % (1 << 64)
            values.append(model.gram_values[(h * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - toxicity.BUCKET_BITS)])
        return np.mean(values) if values else 0.0

    texts = ["The Cat sat!", "one two three four five six seven eight nine", "", None, "...", "x", "wörter über straßen " * 30]
    for text, got in zip(texts, model.margins(texts), strict=True):
        words = toxicity._stream(text).decode().split()
        v = np.array([word_value(w) for w in words])
        n = toxicity.WINDOW
        want = 0.0 if not len(v) else v.mean() if len(v) <= n else max(v[i : i + n].mean() for i in range(len(v) - n + 1))
        assert np.allclose(got, [want, v.mean() if len(v) else 0.0], atol=1e-5)
    monkeypatch.setattr(toxicity, "BLOCK", 120)
    split = model.margins([texts[-1]])[0]
    assert np.isclose(split[0], got[0], atol=1e-5)


@pytest.mark.parametrize("block", [120, 121, 499])
def test_toxicity_margins_of_words_longer_than_a_block(monkeypatch, block):
    rng = np.random.default_rng(4)
    model = toxicity.SubwordToxicity(rng.normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32), np.array([1.0, 1.0, 0.0]))

    def word_value(w):
        b = b" " + w + b" "
        values = []
        for g in (b[i : i + n] for n in toxicity.GRAMS for i in range(len(b) - n + 1)):
            if b" " not in g[1:-1]:
                h = len(g)
                for c in g:
                    h = ((h << 8) | c) % (1 << 64)
                values.append(model.gram_values[(h * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - toxicity.BUCKET_BITS)])
        return np.mean(values) if values else 0.0

    dump = ["".join(rng.choice(list("0123456789abcdef"), 500)) for _ in range(6)]
    cjk = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 400))
    texts = [dump[0], cjk, "one two three four five " + dump[1], dump[2] + " six seven", " ".join(dump), "eight " * 40 + dump[3] + " nine" * 40, "x " + cjk + " y", "short", None, "z " * 300]
    monkeypatch.setattr(toxicity, "BLOCK", block)
    for text, got in zip(texts, model.margins(texts), strict=True):
        v = np.array([word_value(w) for w in toxicity._stream(text).split()])
        n = toxicity.WINDOW
        want = 0.0 if not len(v) else v.mean() if len(v) <= n else max(v[i : i + n].mean() for i in range(len(v) - n + 1))
        assert np.allclose(got, [want, v.mean() if len(v) else 0.0], atol=1e-5)


def test_toxicity_takes_an_unbroken_run_beyond_the_block():
    model = toxicity.SubwordToxicity(np.ones(1 << toxicity.BUCKET_BITS, np.float32), np.array([1.0, 1.0, 0.0]))
    assert np.allclose(model.margins(["a1" * toxicity.BLOCK, "ab cd " + "f" * (toxicity.BLOCK + 5) + " ef"]), 1.0)


def test_misspellings_share_vectors(documents, labels):
    rows = documents.join(labels, "doc_id").select("text", "toxic").toPandas()
    rows = pd.concat([rows[rows.toxic == 1].head(300), rows[rows.toxic == 0].head(300)])
    model = toxicity.fit(rows.text.tolist(), rows.toxic.to_numpy(), 0.1)
    a, b, c = model.scores(["and the stupid of it", "and the stupiid of it", "and the ing of it"])
    assert a > 0.9 and b > c and c < 0.5
