"""Tokenizer alignment, ranked search and chat formatting against plain loops over small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyr.llm import alignment, chat_format, queries, ranked_search
from tests.llm.common_cases import empty_docs, hard_docs, hard_rows

A, B = open(queries.TOKENIZER_PATH, "rb").read(), queries.model_bytes()
BITS = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "🤷", " ", "　", "<|endoftext|>", "<s>", "</s>", "'s", "'ll", "12", "3.", "don't", "\x1c", "\x85", " ▁", "\x00", "the ", "Thtion", " \n "]


@pytest.fixture(scope="module")
def plain():
    return alignment.Aligner(A, B)


def aligned_by_hand(plain, text):
    """(a ids, b ids, groups, links with repeats) of a text from the two libraries' whole encodings; None without tokens."""
    if not text:
        return None
    a, b = plain.first.encode(" " + text, add_special_tokens=False).ids, plain.second.encode(text)
    parts_a, parts_b = [plain.bytes_a[i] for i in a], [plain.bytes_b[i] for i in b]
    if b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([*map(len, parts_a)]).tolist(), np.cumsum([*map(len, parts_b)]).tolist()
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        to_i, to_j = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        mine, yours, i, j = a[i:to_i], b[j:to_j], to_i, to_j
        groups.append(",".join(map(str, mine)) + "|" + ",".join(map(str, yours)))
        links += [(x, y) for x in mine for y in yours]
    return a, b, groups, links


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=30).map("".join))
def test_alignment_of_any_text_is_that_of_whole_encodings(text):
    plain = alignment.aligner(A, B)
    (found,), expected = plain.align([text]), aligned_by_hand(plain, text)
    assert (found is None) == (expected is None)
    if found:
        a, b, groups, links = expected
        assert found[:5] == (len(a), len(b), len(groups), len(links), ";".join(groups))
        assert dict(zip(found[5].tolist(), found[6].tolist(), strict=True)) == Counter(x * len(plain.bytes_b) + y for x, y in links)


def test_alignment_of_long_texts_in_parts_and_without_memory(plain, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(60))) for _ in range(200)] + ["日" * 500, " " * 300, "word " * 300, None]
    whole = plain.align(texts)
    monkeypatch.setattr(alignment, "BLOCK", 40)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    for x, y in zip(whole, plain.align(texts), strict=True):
        assert (x is None) == (y is None) and (x is None or x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all())


def test_coalescing_breaks_only_where_both_sides_end():
    a, b = alignment.coalesce(np.array([2, 2, 3, 1]), np.array([1, 3, 1, 3]))
    assert a.tolist() == [0, 0, 1, 1] and b.tolist() == [0, 0, 1, 1]
    a, b = alignment.coalesce(np.array([1, 1, 4]), np.array([1, 1, 1, 3]))
    assert a.tolist() == [0, 1, 2] and b.tolist() == [0, 1, 2, 2]


@pytest.mark.parametrize("broadcast", [0, 50, 1 << 20])
def test_alignment_counts_over_the_corpus(spark, plain, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    texts = [r[1] for r in hard_rows()] + ["the cat </s> sat", "the cat sat <|endoftext|>", "▁ the marker itself", "the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = [aligned_by_hand(plain, t) for t in texts]
    held = Counter(p for e in expected if e for p in set(e[3]))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    found = {r["doc_id"]: r for r in alignment.weigh_links(alignment.align_documents(docs, A, B), len(plain.bytes_b)).collect()}
    assert sorted(found) == [*range(len(texts))]
    for i, e in enumerate(expected):
        row = found[i]
        if e is None:
            assert [row[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] == [0] * 6 and row["groups"] is None
        else:
            links = e[3]
            assert [row[c] for c in ("n_a", "n_b", "n_groups", "n_links")] == [len(e[0]), len(e[1]), len(e[2]), len(links)]
            assert row["n_best"] == sum(held[p] == best[p[0]] for p in links) and row["count_sum"] == sum(held[p] for p in links)
            assert row["groups"] == ";".join(e[2])


def test_alignment_query_and_hard_rows(spark, plain, tmp_path):
    hard_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op11_tokenizer_alignment(spark, str(tmp_path)).collect()
    assert len(rows) == len(hard_rows())
    texts = defaultdict(list)
    for r in hard_rows():
        e = aligned_by_hand(plain, r[1])
        texts[r[0]].append(hashlib.sha256(";".join(e[2]).encode()).hexdigest() if e else "")
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append(r["groups_sha256"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in texts.items()}
    assert alignment.weigh_links(alignment.align_documents(empty_docs(spark), A, B), 32000).collect() == []


def ranked_by_hand(docs, items, k=50):
    words = lambda t: re.findall(ranked_search.TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    total, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(words(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            scored += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("at_once", [(1 << 15, 1 << 14, 1 << 10), (20, 32, 8)])
def test_ranked_search_is_that_of_whole_scores(spark, monkeypatch, at_once):
    terms, docs_at_once, bits = at_once
    monkeypatch.setattr(ranked_search, "TERMS_AT_ONCE", terms)
    monkeypatch.setattr(ranked_search, "DOCS_AT_ONCE", docs_at_once)
    monkeypatch.setattr(ranked_search, "BITS_AT_ONCE", bits)
    rng = random.Random(5)
    vocabulary = ["the", "The", "of", "été", "日本", "x1", "cat", "dog", "naïve", "a", *(f"w{i}" for i in range(60))]
    text = lambda n: " ".join(rng.choices(vocabulary, [60 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randrange(1, 30))) for i in range(400)] + [(7, "the cat"), (7, "the cat"), (None, "the cat of"), (None, None), (999, ""), (998, "!!! ,,,"), (997, "the " * 3000)]
    docs += [(1000 + i, "cat dog") for i in range(80)]  # more equal scores than places
    items = [(i, text(rng.randrange(1, 40))) for i in range(12)] + [(50, None), (51, "?!"), (52, "unheard"), (53, "cat"), (53, "dog"), (None, "of")]
    d = spark.createDataFrame([(i, t, 1.0, 3) for i, t in docs], "doc_id long, text string, score double, rank int").repartition(5)
    found = ranked_search.rank_documents(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == ranked_by_hand(docs, items)


def test_ranked_search_of_hard_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "the cat and the haus"), (2, "lorem ipsum")], "item_id long, text string")
    found = ranked_search.rank_documents(hard_docs(spark), items).collect()
    assert sorted(map(tuple, found), key=str) == ranked_by_hand([(r[0], r[1]) for r in hard_rows()], [(1, "the cat and the haus"), (2, "lorem ipsum")])
    assert ranked_search.rank_documents(empty_docs(spark), items).collect() == []
    assert ranked_search.rank_documents(hard_docs(spark), items.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab~\n\\<[/sINT]> "), max_size=8), st.text(st.sampled_from("<[\\/sINT]> \nx"), max_size=40)), max_size=6))
def test_template_reads_back_what_it_marked(turns):
    text = chat_format.marked_turns(turns)
    assert chat_format.read_turns(text) == turns
    assert text.count("<s>") == text.count("</s>") == len(turns) and "[INST]" not in text and "[/INST]" not in text


def numbering(turns):
    return "".join(f"#{i} {r}: {chat_format.escape(t)}</s>" for i, (r, t) in enumerate(turns))


def rewriting(turns):
    """Hides what the assistant said before the last user turn."""
    last = max((i for i, (r, _) in enumerate(turns) if r == "user"), default=0)
    return "".join(f"<s>{r}: {'...' if r == 'assistant' and i < last else chat_format.escape(t)}</s>" for i, (r, t) in enumerate(turns))


def trimming(turns):
    return "".join(f"<s>{r}: {chat_format.escape(t.strip())}</s>" for r, t in turns)


@pytest.mark.parametrize("render", [chat_format.marked_turns, numbering])
def test_spans_of_appending_templates(render):
    rng = random.Random(2)
    turns = [(rng.choice(["user", "assistant", "system", ""]), "".join(rng.choices(["</s>", "[INST]", "a", " ", "\\", "<", "", "#1 user: "], k=rng.randrange(6)))) for _ in range(60)]
    spans = chat_format.Spans(render, chat_format.unescape)
    found = [spans.add(t) for t in turns]
    whole = render(turns)
    assert "".join(piece for piece, *_ in found) == whole and not any(f[4] for f in found)
    assert spans.whole == (render is numbering)  # what needs the whole context keeps it
    for (_, text), (_, begin, first, last, _) in zip(turns, found, strict=True):
        assert begin <= first <= last and chat_format.unescape(whole[first:last]) == text


def test_rewritten_history_and_altered_texts_are_told():
    turns = [("user", "a"), ("assistant", "one"), ("user", "b"), ("assistant", "two"), ("user", "c")]
    spans = chat_format.Spans(rewriting, chat_format.unescape)
    text, flags = "", []
    for k, turn in enumerate(turns):
        piece, begin, first, _, rewrites = spans.add(turn)
        text = text[:begin] + piece
        flags.append(rewrites)
        assert text == rewriting(turns[: k + 1]) and (first == -1) == rewrites
    assert flags == [False, False, True, False, True]
    assert chat_format.Spans(trimming, chat_format.unescape).add(("user", " a "))[2:4] == (-1, -1)


def test_chat_formatting_of_hard_rows(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", None, "x"), (1, 2, None, said, "x"), (2, 0, "assistant", said, "x"), (2, 0, "assistant", said, "x"), (None, 0, "assistant", "n", "x"), (3, None, "system", "s", "x"), (3, 0, "assistant", "", "x")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} " + "w " * (5000 if i == 7 else 1), "x") for i in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece string").repartition(4)
    formatted = chat_format.format_conversations(turns)
    own = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] or 0, -1 if r[1] is None else r[1], r[2] or "")):
        own[r[0]].append((r[2] or "", r[3] or ""))
    pieces = defaultdict(list)
    for r in formatted.collect():
        pieces[r["conv_id"]].append(r)
    for conv, given_turns in own.items():
        found = sorted(pieces[conv], key=lambda r: r["n"])
        assert "".join(r["piece"] for r in found) == chat_format.marked_turns(given_turns)
        assert [r["loss"] for r in found] == [r == "assistant" for r, _ in given_turns]
    digests = {r["conv_id"]: r for r in chat_format.conversation_digests(formatted).collect()}
    for conv, given_turns in own.items():
        r, loss = digests[conv], "".join(t for role, t in given_turns if role == "assistant")
        assert r["n_turns"] == len(given_turns) and r["loss_chars"] == len(loss) and r["formatted_chars"] == len(chat_format.marked_turns(given_turns))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in given_turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    broken = chat_format.conversation_digests(chat_format.format_conversations(turns.where("conv_id = 4 and turn < 9"), rewriting)).first()
    assert broken["turns_sha256"] is None and broken["conv_id"] == 4
    assert chat_format.conversation_digests(chat_format.format_conversations(turns.limit(0))).collect() == []


def reminding(turns):
    """Says something of its own after every twentieth turn."""
    return "".join(f"<s>{r}: {chat_format.escape(t)}</s>" + ("<s>system: be kind</s>" if i % 20 == 19 else "") for i, (r, t) in enumerate(turns))


def closing(turns):
    """Marks the thirtieth turn for as long as it is the last one."""
    return "".join(f"<s>{r}: {chat_format.escape(t)}</s>" for r, t in turns) + ("(thirty)" if len(turns) == 30 else "")


def test_each_prefix_is_rendered_whole(spark, monkeypatch):
    turns = [(("user", "assistant")[i % 2], f"turn {i}") for i in range(45)]
    given = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for render, rewritten in ((reminding, []), (closing, [30])):
        rows, text = sorted(chat_format.format_conversations(given, render).collect(), key=lambda r: r["n"]), ""
        for n, r in enumerate(rows):
            text = text[: r["begin"]] + r["piece"]
            assert text == render(turns[: n + 1])
        assert [r["n"] for r in rows if r["rewrites"]] == rewritten
    monkeypatch.setattr(chat_format, "WHOLE_TURNS", 10)  # beyond it context is dropped where a turn is the same without
    rows = sorted(chat_format.format_conversations(given).collect(), key=lambda r: r["n"])
    assert "".join(r["piece"] for r in rows) == chat_format.marked_turns(turns) and [r["loss"] for r in rows] == [r == "assistant" for r, _ in turns]


def late(turns):
    """Says something of its own after the 1100th turn, and marks the 1060th for as long as it is the last one."""
    return "".join(f"<s>{r}: {t}</s>" + ("<s>system: be kind</s>" if i == 1099 else "") for i, (r, t) in enumerate(turns)) + ("(1060)" if len(turns) == 1060 else "")


def test_prefixes_of_long_conversations_are_rendered_whole(spark):
    turns = [(("user", "assistant")[i % 2], f"turn {i}") for i in range(1110)]
    given = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    text, rewritten = "", []
    for n, r in enumerate(sorted(chat_format.format_conversations(given, late).collect(), key=lambda r: r["n"]), 1):
        text = text[: r["begin"]] + r["piece"]
        rewritten += [n] * r["rewrites"]
        assert n % 10 or text == late(turns[:n])
    assert text == late(turns) and rewritten == [1061]
    spans = chat_format.Spans(reminding, chat_format.unescape)
    assert "".join(spans.add(t)[0] for t in turns[:45]) == reminding(turns[:45])
