import math
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from papyr.llm import license_scan, mixing
from papyr.llm.license_scan import TEMPLATES, scan_licenses
from papyr.llm.mixing import entropy, mix_sources, passes, solve_exponent, tempered
from papyr.llm.quality_rules import CUTOFFS, RISK, RULES, binomial_tail, quality_rules, risk_controlled_cutoffs
from papyr.llm.queries import URL_RULES, model_bytes
from papyr.llm.sentencepiece_codec import Codec, decode_documents, encode_documents
from papyr.llm.url_filter import judge_urls, lexical_features, with_shares

from .common_cases import empty_docs, hard_docs, hard_rows


def license_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text):
    w = license_words(text)
    return [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]


def long_notice(n):
    return " ".join(f"clause{i * 7919 % 1000} of{i}" for i in range(n // 2))


@pytest.mark.parametrize("keys_at_once", [license_scan.KEYS_AT_ONCE, 30])
def test_license_scan_against_brute_force(spark, monkeypatch, keys_at_once):
    """Templates with windows of 1 to 64 shingles, whole, changed, scattered and cut; also in several passes."""
    monkeypatch.setattr(license_scan, "KEYS_AT_ONCE", keys_at_once)
    templates = TEMPLATES | {f"long-{n}": long_notice(n) for n in (14, 40, 120, 400)}
    mit = TEMPLATES["MIT-text"].split()
    texts = [f"words before {t} and\nwords after " for t in templates.values()]
    for t in templates.values():
        w = t.split()
        texts.append(" ".join("changed" if i == len(w) // 2 else x for i, x in enumerate(w)))
        cuts = [w[i : i + 30] for i in range(0, len(w), 30)]
        texts.append(" foreign words stand here between the parts ".join(map(" ".join, cuts)))
        texts.append(" ".join(w[: int(len(w) * 0.82)]))
        texts.append(" ".join(w[: int(len(w) * 0.7)]))
    changed = " ".join(mit[:20] + ["changed"] + mit[21:])
    texts += [changed, " ".join(mit[:20]), TEMPLATES["MIT"].upper() * 300]
    rows = hard_rows() + [(100 + i, t, "en", "a", 0, True, 0.5, "x") for i, t in enumerate(texts)]
    got = sorted((r.doc_id, r.license_id, r.n_found, r.n_shingles, r.first_word) for r in scan_licenses(hard_docs(spark, rows), templates).collect())
    want = []
    for r in rows:
        own = shingles(r[1])
        for name, notice in templates.items():
            t = list(dict.fromkeys(shingles(notice)))
            hit = [s for s in t if s in own]
            if len(hit) / len(t) >= 0.8:
                want.append((r[0], name, len(hit), len(t), min(own.index(s) for s in hit)))
    assert got == sorted(want)
    assert any(x[0] == 100 + texts.index(changed) for x in got)  # one word changed of sixty still matches
    assert scan_licenses(empty_docs(spark), templates).count() == 0
    assert scan_licenses(hard_docs(spark), {}).count() == 0 and scan_licenses(hard_docs(spark), {"short": "three words only"}).count() == 0


def test_license_bands_follow_from_the_miss_bound():
    """Simulated misses: a fifth of a template's shingles changed, each window full of foreign ones."""
    rng = np.random.default_rng(8)
    assert [license_scan.window_of(m) for m in (1, 2, 4, 7, 8, 16, 60, 400)] == [1, 2, 2, 2, 2, 4, 8, 64]
    for m in (5, 40, 400):
        w, bands = license_scan.window_of(m), license_scan.bands_for(m, miss=0.01)
        missed = 0
        for _ in range(4000):
            own, foreign, lost = rng.random((bands, m)), rng.random((bands, w - 1)), rng.permutation(m) < m // 5
            first = own.argmin(1)
            missed += not (~lost[first] & ((foreign > own.min(1)[:, None]).all(1))).any()
        assert missed / 4000 < 0.015
        assert license_scan.bands_for(m) > bands


def test_license_recall_on_changed_texts_with_the_real_permutations(spark):
    """Thousands of texts that hold a template at a containment of 0.8 or more, changed at random, among foreign words."""
    rng = random.Random(11)
    templates = TEMPLATES | {f"long-{n}": long_notice(n) for n in (14, 40, 120)}
    rows, want = [], set()
    for name, notice in sorted(templates.items()):
        own = list(dict.fromkeys(shingles(notice)))
        made = 0
        while made < 300:
            w = notice.split()
            for _ in range(rng.randrange(1, 5)):
                at, kind = rng.randrange(len(w)), rng.randrange(4)
                w = w[at:] if kind == 0 and at < len(w) // 5 else w[: len(w) - at] if kind == 1 and at < len(w) // 5 else w[:at] + [f"x{at}"] * (kind % 2 + 1) + w[at + (kind > 1) :]
            text = " ".join([*(f"before{rng.randrange(999)}" for _ in range(rng.randrange(30))), *w, *(f"after{rng.randrange(999)}" for _ in range(rng.randrange(30)))])
            have = set(shingles(text))
            if sum(s in have for s in own) / len(own) >= 0.8 or len(own) <= 4:
                made += 1
                rows.append((len(rows), text))
                want |= {(len(rows) - 1, other) for other in ([name] if sum(s in have for s in own) / len(own) >= 0.8 else [])}
    got = {(r.doc_id, r.license_id) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).select("doc_id", "license_id").collect()}
    assert len(want) > 2500 and len(want & got) / len(want) >= 0.999
    assert sum(license_scan.window_of(len(dict.fromkeys(shingles(t)))) > 1 for t in templates.values()) >= len(templates) - 3


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {x for at in seen.values() if len(at) > 1 for p in at for x in range(p, p + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_against_brute_force(spark):
    texts = ["a b c d e f g h " * 5, "x " * 9, "x " * 8, "one two three four five six seven eight nine ten one two three four five six seven eight", "l1\nl1\n\n \nl1 \n| # $ <b>", "é🤷 ＃ \x0b\x0c z"]
    rows = hard_rows() + [(50 + i, t, "en", "a", 0, True, 0.5, "x") for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (6, 0)], "doc_id long, quality int")
    got = quality_rules(hard_docs(spark, rows), labels)
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got.collect())
    want = []
    for r in rows:
        c = brute_counts(r[1])
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        want.append((str(r[0]), *c, failed, not failed))
    assert have == sorted(want)
    assert quality_rules(empty_docs(spark), labels).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, 0.01) for n in (1, 10, 1000, 20000) for k in (0, 1, n // 300, n // 150)]
    got = spark.createDataFrame(cases, "k long, n long, p double").select("k", "n", binomial_tail(F.col("k"), F.col("n"), 0.01).alias("tail")).collect()
    for r in got:
        terms = (math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99)) for i in range(r.k + 1))
        assert r.tail == 1.0 if r.k >= 0.01 * r.n else math.isclose(r.tail, sum(terms), rel_tol=1e-6)


def test_cutoffs_limit_false_rejection(spark):
    rng = np.random.default_rng(4)
    rows = [("big", *map(float, rng.exponential(0.01, 4))) for _ in range(6000)] + [("small", 0.0, 0.0, 0.0, 0.0)] * 30
    good = spark.createDataFrame(rows, "stratum string, " + ", ".join(f"{r} double" for r in RULES))
    got = {(r.stratum, r.rule): r.cutoff for r in risk_controlled_cutoffs(good).collect()}
    x = np.array([r[1:] for r in rows if r[0] == "big"])
    assert {s for s, _ in got} == {"big"} and len(got) == len(RULES)  # thirty labels prove nothing
    rejected = np.zeros(len(x), bool)
    for j, rule in enumerate(RULES):
        cutoff = got["big", rule]
        rejected |= x[:, j] > cutoff
        lower = CUTOFFS[CUTOFFS.index(cutoff) - 1]
        assert (x[:, j] > lower).mean() > 0.5 * RISK / len(RULES)  # not needlessly high
    assert rejected.mean() <= RISK


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules_against_brute_force(spark):
    urls = ["http://a.NET/x", "http://net/", "http://net", "http://b.example.net/en/1", "http://example.net/de/", "http://xexample.com/de/1", "https://example.com/de/", "https://s.Example.com/DE/", "http://x.org/fr/?a=/b#c", "http://x.org?fr/", "no url", "", None, "a://b://c/d", "http://Ä.net/é", "http://x.com:80/de/"] * 4
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in judge_urls(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = url_parts(url)
        fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.text)
        assert got[i].verdict in ("allow", "block") and (best is None or got[i].verdict == best.verdict)
    assert judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in judge_urls(pages, []).collect()} == {"allow"}


def test_url_trees_agree_with_held_out_labels(spark):
    """Fitted on few of the labelled URLs, the trees agree with the rules on the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = judge_urls(pages, URL_RULES, sample_urls=200).where("rule is not null").toPandas()
    assert len(got) > 1000 and ((got.block_score >= 0.5) == (got.verdict == "block")).mean() > 0.95


def test_exponent_meets_its_targets():
    tokens = np.array([1e6, 2e5, 5e4, 0.0, 1e3])
    a = solve_exponent(tokens, max_epochs=3.0)
    often = passes(tokens, tempered(tokens, a), None)
    assert np.isclose(often.max(), 3.0) and np.isclose(often[often > 0].min(), 1.0)
    b = solve_exponent(tokens, target_entropy=1.0)
    assert np.isclose(entropy(tempered(tokens, b)), 1.0)
    assert solve_exponent(tokens, max_epochs=1e9) == 0.0 and solve_exponent(np.zeros(2), max_epochs=2) == 0.0
    assert np.isclose(passes(tokens, tempered(tokens, 1.0), 2 * tokens.sum()).max(), 2.0)


def test_exponents_above_one_and_targets_out_of_reach():
    tokens = np.array([1e6, 9e5, 5e4, 1e3])
    a = solve_exponent(tokens, target_entropy=0.3)
    assert a > 1 and np.isclose(entropy(tempered(tokens, a)), 0.3)
    b = solve_exponent(tokens, max_epochs=1.5, budget=tokens.sum())
    assert np.isclose(passes(tokens, tempered(tokens, b), tokens.sum()).max(), 1.5)
    for targets in ({"max_epochs": 2.0, "budget": 10 * tokens.sum()}, {"target_entropy": 0.3, "max_epochs": 1.0}):
        with pytest.raises(ValueError):
            solve_exponent(tokens, **targets)
    with pytest.raises(ValueError):
        solve_exponent(np.array([5.0, 5.0]), target_entropy=0.1)  # equal sources stay equal


@pytest.mark.parametrize("targets", [{}, {"max_epochs": None, "target_entropy": 0.9}, {"budget_tokens": 3000, "max_epochs": None}])
def test_mixing_many_sources_like_few(spark, monkeypatch, targets):
    rows = [(i if i % 9 else None, "w " * (1 + i % 11), ["hot", f"s{i % 13}", None][(i % 2) + (i % 26 == 1)]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = mix_sources(docs, **targets).toPandas()
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    many = mix_sources(docs, **targets).toPandas()
    key = ["source", "doc_id", "n_tokens", "epoch", "block", "block_order"]
    assert few[key].sort_values(key).astype(str).values.tolist() == many[key].sort_values(key).astype(str).values.tolist()
    assert np.allclose(sorted(few.weight), sorted(many.weight))


def test_mixing_keeps_columns_that_are_named_like_its_own(spark):
    names = ["_id", "_quota", "_bucket", "_source", "_tie", "_at", "row", "own", "n", "tokens"]
    rows = [(i, "some words", "ab"[i % 2], *(f"{c}{i}" for c in names)) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    got = mix_sources(docs)
    assert got.columns == [*docs.columns, *mixing.ADDED] and sorted(map(tuple, got.select(docs.columns).distinct().collect())) == sorted(rows)


def test_mixing_uses_every_document_and_meets_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mix_sources(docs, block_tokens=20_000).toPandas()
    tokens = docs.toPandas().assign(n=lambda d: [len(re.findall(r"[^\x20\x09-\x0d]+", t)) for t in d.text])
    assert set(got.doc_id) == set(tokens.doc_id)
    uses = got.groupby("doc_id").epoch.agg(["size", "max"])
    assert (uses["size"] == uses["max"] + 1).all() and uses["size"].max() == 2
    weight = got.groupby("source").weight.first()
    share = got.groupby("source").n_tokens.sum() / got.n_tokens.sum()
    assert np.allclose(share, weight, atol=0.01) and np.isclose(weight.sum(), 1)
    by_source = tokens.groupby("source").n.sum()
    assert np.allclose(weight, tempered(by_source.to_numpy(float), solve_exponent(by_source.to_numpy(float), 2.0)))
    inner = got[(got.block > 0) & (got.block < got.block.max())].groupby(["block", "source"]).n_tokens.sum().groupby("source").mean()
    assert np.allclose(inner / inner.sum(), weight, atol=0.03)


def test_mixing_keeps_every_wordless_text(spark):
    rows = [(i, "some words here" if i % 40 == 0 else "" if i % 2 else None, s) for i, s in enumerate(["a"] * 400)] + [(i, "b b", "b") for i in range(400, 410)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs).toPandas()
    assert sorted(got[got.epoch == 0].doc_id) == list(range(410)) and (got[got.source == "a"].epoch == 0).all()
    alone = mix_sources(docs.where("source = 'a'")).toPandas()
    assert sorted(alone.doc_id) == list(range(400))


def test_mixing_against_a_plain_walk(spark):
    """With a budget that cuts sources: each source's documents in hash order until its part is full."""
    rows = [(i, "w " * (1 + i % 7), "en", "hot" if i % 3 else f"s{i % 2}", 0, True, 0.5, "x") for i in range(400)] + hard_rows()
    docs = hard_docs(spark, rows)
    got = mix_sources(docs, budget_tokens=900, max_epochs=None).select("source", "doc_id", "n_tokens", "epoch").toPandas()
    counted = {}
    for r in rows:
        counted.setdefault(r[3], []).append(len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")))
    names = sorted(counted, key=str)
    tokens = np.array([sum(counted[n]) for n in names], float)
    quota = dict(zip(names, np.rint(900 * tempered(tokens, solve_exponent(tokens, budget=900))), strict=True))
    for name in names:
        own = got[got.source.isna() if name is None else got.source == name]
        whole, most = sum(counted[name]), max(counted[name])
        taken = own.n_tokens.sum()
        if quota[name]:
            assert quota[name] <= taken < quota[name] + max(most, 1)
            assert own.epoch.max() == math.ceil(quota[name] / whole) - 1
        else:
            assert len(own) == len(counted[name])
    order = docs.where("source = 'hot'").select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(2), F.lit("=hot"), F.lit(0), "doc_id"), 11).alias("at")).orderBy("at").toPandas().doc_id.tolist()
    hot = set(got[(got.source == "hot") & (got.epoch == 0)].doc_id)
    assert set(order[: len(hot)]) == hot
    assert mix_sources(empty_docs(spark)).count() == 0


def test_codec_parity_and_round_trip(spark):
    data = model_bytes()
    peer = sentencepiece.SentencePieceProcessor(model_proto=data)
    extra = [" ", "  a  b ", "<s> x </s>", "<0x41>", "▁▁a ▁", "a\x00b", " x", "x ", "\n\n", "🤷‍♂️ 日本語"]
    rows = hard_rows() + [(100 + i, t, "en", "a", 0, True, 0.5, "x") for i, t in enumerate(extra)]
    got = encode_documents(hard_docs(spark, rows), data).collect()
    text_of = lambda t: sorted((str(r[0]), str(r[1])) for r in t)
    want = [(r[0], None if r[1] is None else peer.encode(r[1])) for r in rows]
    assert text_of((r.doc_id, r.ids) for r in got) == text_of(want)
    flags = sorted((str(r.doc_id), str(r.parity), str(r.round_trip)) for r in got)
    assert flags == sorted((str(r[0]), *(("None", "None") if r[1] is None else ("True", str("▁" not in r[1])))) for r in rows)
    coded = spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>")
    again = decode_documents(coded, data).collect()
    assert text_of(again) == text_of((r[0], r[1] and r[1].replace("▁", " ")) for r in rows)
    assert encode_documents(empty_docs(spark), data).count() == 0


def test_codec_whole_texts_and_small_memory(monkeypatch):
    data = model_bytes()
    codec, peer = Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [r[1] or "" for r in hard_rows()]
    codec.by_words, codec.tokenizer = False, codec.model.tokenizer()
    ids, same = codec.encode(texts)
    assert all(same) and [i.tolist() for i in ids] == peer.encode(texts)
    codec = Codec(data)
    monkeypatch.setattr("papyr.llm.sentencepiece_codec.FRESH", 3)
    monkeypatch.setattr("papyr.llm.sentencepiece_codec.FREQUENT", 2)
    monkeypatch.setattr("papyr.llm.sentencepiece_codec.BLOCK", 10)
    for _ in range(3):
        ids, same = codec.encode(texts)
    assert all(same) and [i.tolist() for i in ids] == peer.encode(texts) and len(codec.fresh) < 50
    assert [codec.decode(i) for i in ids] == texts


def unigram_model(dummy_prefix, squeeze):
    """A small unigram model with byte fallback, written by hand."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    kind = pb.ModelProto.SentencePiece

    def add(piece, score, of):
        model.pieces.add(piece=piece, score=score, type=of)

    add("<unk>", 0.0, kind.UNKNOWN)
    add("<s>", 0.0, kind.CONTROL)
    add("</s>", 0.0, kind.CONTROL)
    for b in range(256):
        add(f"<0x{b:02X}>", 0.0, kind.BYTE)
    pieces = ["▁the", "▁th", "the", "he", "▁c", "at", "cat", "▁cat", "▁d", "og", "dog", "▁und", "nd", "un", "▁mat", "lorem", "▁lor", "em", "▁ip", "sum", "ipsum", "▁", *"abcdefghijklmnopqrstuvwxyz"]
    for i, piece in enumerate(pieces):
        add(piece, -2.0 - 0.37 * i - 0.011 * i * i, kind.NORMAL)
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.trainer_spec.byte_fallback = True
    model.trainer_spec.vocab_size = len(model.pieces)
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = dummy_prefix
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    return model.SerializeToString()


@pytest.mark.parametrize("dummy_prefix,squeeze", [(True, False), (False, False), (True, True)])
def test_unigram_models_are_encoded_like_the_peer(dummy_prefix, squeeze):
    data = unigram_model(dummy_prefix, squeeze)
    codec, peer = Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [r[1] or "" for r in hard_rows()] + ["the cat und the dog", "Zebra über 日本 🤷", "  two  spaces ", "x" * 50, "lorem ipsum " * 200]
    ids, same = codec.encode(texts)
    assert all(same) and [i.tolist() for i in ids] == peer.encode(texts)
    assert any(len(i) > 3 for i in ids)
    if not squeeze:
        assert [codec.decode(i) for i in ids] == texts


def plain_features(url):
    """The lexical features of a URL, host and path as the rules see them."""
    host, path = url_parts(url)
    text = url or ""
    query = re.search(r"\?([^#]*)", text)
    query = query[1] if query else ""

    def bits(t):
        return -sum(t.count(c) / len(t) * math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0

    def digits(t):
        return sum(c in "0123456789" for c in t)

    return {
        "length": len(text), "host_length": len(host), "path_length": len(path), "depth": len([x for x in path.split("/") if x]), "labels": len(host.split(".")),
        "digit_ratio": digits(text) / max(len(text), 1), "host_digit_ratio": digits(host) / max(len(host), 1), "host_hyphens": host.count("-"), "entropy": bits(text),
        "host_entropy": bits(host), "params": len([x for x in query.split("&") if x]), "query_length": len(query), "has_fragment": int("#" in text),
        "longest_label": max(map(len, host.split("."))), "suffix": re.search(r"([^.]*?)(:\d+)?$", host)[1] if host else "", "segment": (re.match(r"/([^/]*)/", path) or ["", ""])[1],
    }


def test_url_features_and_shares_against_brute_force(spark):
    """Features of odd, very long and repeated URLs; a labelled URL's shares leave out its own fold."""
    urls = ["http://a-b.example.com:8080/x1/y2/z?a=1&b=2&&c#frag", "https://net/", "no url at all", "", None, "http://x.org?q#", "ftp://1.2.3.4/a//b/", "http://long.example.de/" + "seg/" * 20000 + "?" + "k=v&" * 5000] * 3
    urls += [f"http://h{i % 7}.{'com' if i % 3 else 'net'}/{'en' if i % 2 else 'de'}/{i}" for i in range(120)]
    rows = [(i, u, *url_parts(u), [None, 1.0, 0.0][i % 3]) for i, u in enumerate(urls)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, path string, label double")
    got = {r.page_id: r for r in lexical_features(frame).collect()}
    for i, u in enumerate(urls):
        want = plain_features(u)
        assert all(math.isclose(getattr(got[i], k), v, abs_tol=1e-9) if isinstance(v, float) else getattr(got[i], k) == v for k, v in want.items()), (u, want)
    featured = lexical_features(frame).withColumn("fold", F.pmod(F.xxhash64(F.lit(6), "url"), F.lit(8)))
    shared = {r.page_id: r for r in with_shares(featured, "suffix", len(urls)).collect()}
    assert len(shared) == len(urls)
    overall = sum(r[4] or 0 for r in rows) / len(rows)
    for i, r in shared.items():
        others = [shared[j] for j in shared if shared[j].suffix == r.suffix and (r.label is None or shared[j].fold != r.fold)]
        assert r.label is None or i not in {o.page_id for o in others}
        assert math.isclose(r.suffix_share, (sum(o.label or 0 for o in others) + 20 * overall) / (len(others) + 20), abs_tol=1e-9)
        assert math.isclose(r.suffix_log, math.log1p(len(others)), abs_tol=1e-9)
    judged = judge_urls(frame, URL_RULES).collect()
    by_url = {}
    for r in judged:
        by_url.setdefault(urls[r.page_id], set()).add((r.verdict, r.block_score))
    assert len(judged) == len(urls) and all(len(v) == 1 for v in by_url.values())  # repeated URLs are judged alike


def test_quality_verdicts_against_brute_force(spark):
    """With labels enough to prove cutoffs, ``kept`` follows from counts, cutoffs and the binomial bound alone."""
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(6000):
        own = list(rng.choice(words, 30, replace=False)) + ["#"] * int(rng.choice([0, 0, 0, 0, 1, 2, 9], p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.03, 0.02]))
        own += [f"##{j}|" for j in range(40 if i >= 5800 and i % 5 == 0 else 0)]
        rows.append((i, " ".join(own) if i % 50 else "too short", "en" if i % 4 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(5800)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}

    def share(a, b):
        return a / b if b else 0.0

    stats, failed = {}, {}
    for i, text, _ in rows:
        n, chars, symbols, dup, repeated = brute_counts(text)
        bare = sum(not re.search(r"[^\W_]", w) for w in text.split())
        stats[i] = dict(zip(RULES, (share(symbols, chars), share(bare, n), share(dup, 1), share(repeated, n)), strict=True))
        failed[i] = n < 20 or 100 * repeated > 30 * n
    strata = {lang or "" for _, _, lang in rows}
    proven = {}
    for stratum in strata:
        good = [stats[i] for i, _, lang in rows if (lang or "") == stratum and not failed[i] and i < 5800 and i % 10]
        for rule in RULES:
            for cutoff in CUTOFFS:
                k = sum(x[rule] > cutoff for x in good)
                p = RISK / len(RULES)
                tail = sum(math.exp(math.lgamma(len(good) + 1) - math.lgamma(j + 1) - math.lgamma(len(good) - j + 1) + j * math.log(p) + (len(good) - j) * math.log(1 - p)) for j in range(k + 1))
                if k < len(good) * p and tail <= 0.05 / (len(strata) * len(RULES) * len(CUTOFFS)):
                    proven[stratum, rule] = cutoff
                    break
    assert proven and any(r.failed_rule not in (None, "base") for r in got.values())
    for i, _, lang in rows:
        over = [r for r in RULES if stats[i][r] > proven.get((lang or "", r), math.inf)]
        assert got[i].kept == (not failed[i] and not over), i
        assert got[i].failed_rule == ("base" if failed[i] else over[0] if over else None)
