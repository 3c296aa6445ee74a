"""Each operator against brute force, an exact round trip or held-out labels, and the edge cases of its docstring."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillweave.llm import bpe, chat, decontaminate, extract, jaccard, pii, quality, queries, sharding, tokenfiles, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, rank int"


def _lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def _docs(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t or ""), "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def _shingles(text):
    w = WORD.findall(_lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute_components(texts):
    sets, parent = [_shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def _corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)]
    shared, texts = [rng.choice(vocab) for _ in range(40)], []
    for g in range(20):
        base = (shared if g % 4 == 0 else []) + [rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 7, 9, 11, 14, 30, 80]))]
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    base = [rng.choice(vocab) for _ in range(90)]
    for k in range(30):
        w = list(base)
        for _ in range(1 + k % 3):
            w[rng.randrange(90)] = f"z{rng.random()}"
        texts.append(" ".join(w))
    return [*texts, texts[0], None, "", " \n", "ONE Two", "one tWO"]


@pytest.mark.parametrize("boundary", [None, 9])
def test_jaccard_components(spark, monkeypatch, boundary):
    monkeypatch.setattr(jaccard, "LONG_LIST", 5)
    if boundary is not None:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda sizes: boundary)
    texts = _corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(_docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == _brute_components(texts)


def test_jaccard_prefix_theory():
    for n in range(1, 60):
        for m in jaccard.partners(n):
            assert 5 * min(n, m) >= 4 * max(n, m)
            assert n - jaccard.least_overlap(n, m) + 1 <= jaccard.prefix_length(n)


def test_jaccard_keeps_one_of_each(spark):
    text = "a b c d e f g h i j"
    docs = _docs(spark, [text, text.upper(), "other words here", None]).unionByName(_docs(spark, ["other words here"], 2))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert jaccard.components(docs.limit(0)).count() == 0


PATH = queries.vocabulary_path("word_bpe_49k.json")
ODD = ["", None, "It's I'll'S don't!! <|endoftext|>foo<|startoftext|> <|x|>", "\x1c!\x1d? a\x1fb  \x1e", "ΣΑΣ Σ İstanbul ß e\u0301", "日本語 한국어 ١٢٣ ²³½ 😀!!", "aaa" * 300, "xy" * 900, "one, two. THREE%%% four's"]


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "b", "é", "'s", " ", "\t", "1", "²", "!", "e\u0301", "中", "Σ", "\u3000"]) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    library = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe.encode_digests(_docs(spark, texts), PATH).collect()}
    whole = {r.doc_id: r for r in bpe.encode_texts(_docs(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert list(whole[i].ids) == ids and whole[i].decoded == decoded


def test_bpe_decodes_ids_that_no_text_gives():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(PATH), bpe.codec(PATH), random.Random(2)
    for n in (0, 1, 7, 300):
        ids = [rng.randrange(49_408) for _ in range(n)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_store_never_changes_results(monkeypatch):
    from tokenizers import Tokenizer

    from skillweave.llm import chunks

    rng, library = random.Random(3), Tokenizer.from_file(PATH)
    own = bpe.Codec(PATH)
    own.store.store.most = 40
    letters = ["a", "B", "É", "ß", "×", "÷", "é", "e\u0301", "'s", "|", "<|", "1", "²", "!", "?!", "—", "\xa0", "\u2028", "ſ", "K", "İ", "\x1f", " ", "\n", "the", "Word"]
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert chunks.chunk_codes(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0] == []


def test_re_pair_round_trip():
    rng = np.random.default_rng(0)
    for trial in range(60):
        docs = [rng.integers(0, rng.integers(1, 6), rng.integers(1, 150)).astype("<u4") for _ in range(rng.integers(1, 6))]
        file = tokenfiles.File(tokenfiles.pack(list(range(len(docs))), [d.tobytes() for d in docs]))
        assert all((file.document(k) == d).all() for k, d in enumerate(docs))
        whole = np.concatenate(docs)
        start = int(rng.integers(0, len(whole)))
        n = int(rng.integers(0, len(whole) - start + 1))
        assert (file.ids(start, n) == whole[start : start + n]).all(), trial


def test_re_pair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 30_000, 500).astype("<u4")
    docs = [np.concatenate([rng.integers(0, 30_000, 20).astype("<u4"), passage]) for _ in range(40)]
    file = tokenfiles.File(tokenfiles.pack(list(range(len(docs))), [d.tobytes() for d in docs]))
    assert all((file.document(k) == d).all() for k, d in enumerate(docs))
    inside = np.ones(len(file.symbols), bool)
    inside[file.first[1:] - 1] = False
    at = np.flatnonzero(inside)
    pairs = np.stack([file.symbols[at], file.symbols[at + 1]], 1)
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < tokenfiles.LEAST_COUNT
    assert file.lengths.max() >= 256 and len(file.symbols) < 40 * 40


def test_token_files(spark):
    from tokenizers import Tokenizer

    texts = ODD + ["the same words again and again " * 20]
    library, at = Tokenizer.from_file(PATH), 0
    got = {r.doc_id: r for r in tokenfiles.read_files(tokenfiles.write_files(_docs(spark, texts), PATH, shard_ids=64)).collect()}
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfiles.read_files(tokenfiles.write_files(_docs(spark, texts).limit(0), PATH)).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        texts.append(" ".join(rng.choices(words, k=40) + (rng.sample(["Idiot!", "scum", "moron,"], 2) if bad else [])))
        labels.append((i, int(bad)))
    docs = _docs(spark, [*texts, None, ""])
    marks = spark.createDataFrame([*labels, (5, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert held == [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == y for i, y in labels if i in set(held)) and got[400].predicted == 0 and 0 <= got[401].score <= 1
    kept = toxicity.clean(docs, marks)
    assert kept.columns == docs.columns and kept.count() == 302
    assert toxicity.toxicity(docs, marks.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_pii_base_spans_brute_force():
    rng = random.Random(3)
    bits = ["a", "@", ".", "1", "25", "+", "-", " ", "(", ")", "%", "b.c", "4111111111111111", "é", "@x.y"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        want = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
        for m in pii.IP.finditer(t):
            if all(int(p) < 256 for p in m[0].split(".")):
                want.append((m.start(), 1, m.end()))
        for m in pii.CARD.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if 14 <= len(d) <= 19 and pii.luhn(d):
                want.append((m.start(), 2, m.end()))
        for m in pii.PHONE.finditer(t):
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                want.append((m.start(), 3, m.end()))
        assert pii.base_spans(t) == sorted(want), t


def test_pii_spans_and_masks(spark):
    texts = [f"write to u{i}@mail{i}.example.com or +1 (55{i % 10}) 555-01{i:02d} about 4111111111111111 today" for i in range(40)] + [None, "", "no data 12 here"]
    docs = _docs(spark, texts)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert (got[3].n_email, got[3].n_phone, got[3].n_card, got[3].n_ip) == (1, 1, 1, 0)
    assert got[3].base_sha256 == hashlib.sha256(pii.listed(pii.base_spans(texts[3])).encode()).hexdigest()
    assert set(pii.listed(pii.base_spans(texts[3])).split(",")) <= set(got[3].spans.split(","))
    assert got[40].spans == got[41].spans == got[42].spans == ""
    masked = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert masked[3].text == "write to [EMAIL] or [PHONE] about [CARD] today" and masked[3].n_chars == len(masked[3].text) and masked[40].text is None
    assert pii.personal_data(docs.limit(0)).count() == 0


def _plants(seed, n):
    from skillweave.llm.pii_plants import example

    rng = random.Random(seed)
    words = "the and of to on for with from that this was are under over house tree river stone".split()
    return [example(rng, words, pii.KINDS) for _ in range(n)]


@pytest.fixture(scope="module")
def field():
    made = _plants(1, 1_500)
    return pii.fit([t for t, _ in made], [s for _, s in made])


def test_pii_field_finds_held_out_plants(field):
    held = _plants(2, 600)
    texts = [t for t, _ in held]
    base = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(texts, base, field)
    hit = wrong = missed = 0
    for (_, gold), known, found in zip(held, base, added, strict=True):
        want = {g for g in gold if not any(s < g[2] and e > g[0] for s, _, e in known)}
        hit, wrong, missed = hit + len(want & set(found)), wrong + len(set(found) - set(gold)), missed + len(want - set(found))
        assert not any(s < q and e > p for s, _, e in known for p, _, q in found)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.75, (hit, wrong, missed)


def test_pii_field_knows_forms_that_the_patterns_miss(field):
    for text, kind, said in [("call 555 010 2030 now", "phone", "555 010 2030"), ("tel (555) 123-4567 please", "phone", "(555) 123-4567"), ("and token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\" here", "secret", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"), ("mail bob [at] example [dot] org today", "email", "bob [at] example [dot] org")]:
        assert pii.base_spans(text) == []
        found = pii.added_spans([text], [[]], field)[0]
        assert [(pii.KINDS[k], text[s:e]) for s, k, e in found] == [(kind, said)]
    for text in ("in 1999 and 2004 we had 100 200 300", "12:30:45 on 2024-05-17", "version 1.2.3 of 10 at 12"):
        assert pii.added_spans([text], [[]], field)[0] == []


def test_pii_segmentation_is_the_best_of_all():
    rng = np.random.default_rng(3)
    n_kinds = len(pii.KINDS)
    for _ in range(150):
        own, n = pii.Field(), int(rng.integers(1, 7))
        own.follow = rng.normal(0, 1, (n_kinds + 1, n_kinds + 1))
        own.follow[0, 0] = 0
        segments = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
        i, j = np.array([s[0] for s in segments], int), np.array([s[1] for s in segments], int)
        emissions = rng.normal(0, 2, (len(segments), n_kinds))

        def every(at, state):
            if at == n:
                yield 0.0, []
                return
            for value, path in every(at + 1, 0):
                yield value + own.follow[state, 0], path
            for k, (low, high) in enumerate(segments):
                if low == at:
                    for kind in range(n_kinds):
                        for value, path in every(high, kind + 1):
                            yield value + own.follow[state, kind + 1] + emissions[k, kind], [(k, kind), *path]

        if len(segments) > 6:
            continue
        want = max(every(0, 0), key=lambda x: x[0])
        live = (emissions + own.slack() > 0).any(1)
        at = np.flatnonzero(live)
        got = [(int(at[k]), kind) for k, kind, _ in own.best(i[live], j[live], emissions[live], n)]
        assert got == want[1]


def test_pii_gradient_is_that_of_the_likelihood():
    made = _plants(4, 12)
    own = pii.Trainer(pii.segments_of([t for t, _ in made]), [s for _, s in made])
    rng, start = np.random.default_rng(0), pii.Field()
    start.weights += rng.normal(0, 0.3, start.weights.shape).astype(np.float32)
    start.follow += rng.normal(0, 0.3, start.follow.shape)
    start.follow[0, 0] = 0
    part = own.whole[:6]
    seg, change, moves = own.gradient(start, part)
    assert abs(change).max() <= 1 + 1e-6 and np.isfinite(moves).all()
    # Expected counts of a region: what each token belongs to, plain text or one segment, adds up to one.
    for r in part:
        of = own.found.of[seg] == r
        kinds = np.zeros((of.sum(), len(pii.KINDS)))
        where = {k: x for x, k in enumerate(seg[of].tolist())}
        for k, kind in own.gold[r]:
            kinds[where[k], kind] = 1
        share = (kinds - change[of]).sum(1)
        covered = np.zeros(own.found.sizes[r] + 1)
        for k, x in zip(seg[of].tolist(), share, strict=True):
            low = int(own.local[k])
            covered[low : low + int(own.span[k])] += x
        assert covered.max() <= 1 + 1e-6 and share.min() >= -1e-9


def test_pii_long_texts_take_linear_time(field):
    import time

    for text in ("1" + "a" * 3_000_000, "1a" * 500_000, "1" * 1_000_000, "@ " * 100_000, "1." * 100_000, " ".join(str(n % 99_991) for n in range(60_000))):
        began = time.time()
        base = pii.base_spans(text)
        pii.added_spans([text], [base], field)
        assert time.time() - began < 20, text[:10]


def test_chat_round_trip(spark):
    odd = ["\\", "### x", "</turn>\n</turn>", "a:\nb:", "\\###", "", None, queries.TRICKY, ":\n### y"]
    rows = [(c, t, ("user", "assistant")[t % 2], odd[(c + t) % len(odd)], "x") for c in range(9) for t in range(4)] + [(99, 0, "assistant", "first", "x"), (99, 1, None, "who", "x"), (98, 0, "user", "twice", "x"), (98, 0, "user", "twice", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, valid string").repartition(5)
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((t, role or "", text or "") for cid, t, role, text, _ in rows if cid == c)
        whole = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert got[c].n_turns == len(own) and got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    broken = {r.conv_id: r.broken_at for r in formatted.filter("not valid").collect()}
    assert broken == {99: 0, 98: 1}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_extract_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
    <div id="cookie-notice">We use cookies, a lot of them, really.</div><article><h1>Head &amp; line</h1><p>First, with commas, and <b>bold</b>\n text.<br>After break.<p>Second &eacute;ntry <a href=x>link</a>.</article>
    <div class="comments"><p>Reader says, well, something long enough to score, yes.</p></div><aside>Side</aside><footer>&copy; me</footer><script>var a="</p>";</script></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "plain text"), (5, "x", "<div><p>cut off in a tag <a hre")]
    got = {r.page_id: r for r in extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == "Head & line First, with commas, and bold text. After break. Second éntry link." and got[1].n_chars == len(got[1].text)
    assert [got[k].text for k in (2, 3, 4, 5)] == ["", "", "plain text", "cut off in a tag"]


def test_extract_names_do_not_delete_articles(spark):
    said = "This is the text, and it is long enough, really."
    pages = [
        f'<div class="content no-sidebar"><p>{said}</p></div>',
        f'<div class="post"><div class="social-history"><p>{said}</p></div></div>',
        f'<div class="sidebar"><p>{said}</p></div>',
        f'<div><p>{said}</p><div class="comments"><p>{said} {said} {said}</p></div><div id="cookie-notice">We use cookies, yes.</div></div>',
        f"<div><p>{said}</p></div>",
    ]
    rows = [(n, "u", p, "x") for n, p in enumerate([*pages, pages[0]])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    assert [r.text for r in extract.extract_pages(df).orderBy("page_id").collect()] == [said] * 6
    assert extract.extract_pages(df.limit(0)).count() == 0
    assert extract.main_text(f"<p>{said}</p><p hidden>and this</p><svg><text>too</text></svg>") == f"{said} and this too"


def test_extract_broken_pages_take_linear_time():
    import time

    for html in ("<" + "a" * 1_000_000, "<div>" * 100_000 + "text", "<b>" * 50_000 + "<hr>" * 50_000, '<a ">' * 100_001, "<i>" * 50_000 + "</b>" * 50_000, "<div><li>a" * 30_000):
        began = time.time()
        extract.main_text(html)
        assert time.time() - began < 10, html[:10]


LARGE = (1 << 53) + 1


def test_large_ids_beside_null_ones(spark):
    """A whole number that no double has, with a null id in the same batch."""
    pages = spark.createDataFrame([(LARGE, "u", "<p>Some text that is long enough to be kept here.</p>"), (None, None, None)], "page_id bigint, url string, html string").coalesce(1)
    assert {r.page_id for r in extract.extract_pages(pages).collect()} == {LARGE, None}
    turns = spark.createDataFrame([(LARGE, 0, "user", "a"), (LARGE, 1, "assistant", "b"), (None, 0, "user", "c")], "conv_id bigint, turn int, role string, text string").coalesce(1)
    formatted = chat.format_conversations(turns)
    assert {(r.conv_id, r.broken_at) for r in formatted.collect()} == {(LARGE, None), (None, None)}
    assert {r.conv_id for r in chat.read_back(formatted).collect()} == {LARGE, None}


SAID = ["The first part of the article, which is long, has several commas, and says something.", "The second part of it goes on, with other words, and is no shorter than the first one was.", "A third one, for good measure, stands after both, and ends what was to be told here."]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div id=w><div class=s1><div><p>{SAID[0]}</p></div></div><div class=s2><div><p>{SAID[1]}</p></div></div></div>", SAID[:2]),
        (f"<nav><a href=1>Home</a></nav><article><p>{SAID[0]}</p></article><article><p>{SAID[1]}</p></article><footer>By us</footer>", SAID[:2]),
        (f"<form id=aspnetForm action=x><div class=menu><a href=1>Menu</a></div><div><p>{SAID[0]}</p><p>{SAID[1]}</p></div><input name=q></form>", SAID[:2]),
        (f"<div><p>{SAID[0]}</p><p>{SAID[1]}</p><form><label>Your mail address, please, to read on</label><input></form></div>", SAID[:2]),
        (f"<div><div><h1>What it is about</h1></div><div><div><p>{SAID[0]}</p><p>{SAID[1]}</p></div></div></div>", ["What it is about", *SAID[:2]]),
        (f"<header><h1>Site name</h1></header><div><div><p>{SAID[0]}</p><p>{SAID[1]}</p></div></div>", SAID[:2]),
        (f"<div id=a><section><p>{SAID[0]}</p></section><ul><li><a href=1>{SAID[1]}</a></li></ul><section><div><p>{SAID[2]}</p></div></section></div>", [SAID[0], SAID[2]]),
        (f"<table><tr><td>{SAID[0]}</td></tr><tr><td>{SAID[1]}</td></tr></table>", SAID[:2]),
        (f"<article><h2>Head</h2><div><p>{SAID[0]}</p></div><div class=x><p>{SAID[1]}</p></div></article><div class=comments><article><p>{SAID[2]}</p></article></div>", ["Head", *SAID[:2]]),
    ],
)
def test_extract_keeps_all_parts_of_an_article(html, text):
    assert extract.main_text(html) == " ".join(text)


def test_sharding(spark):
    texts = [f"text {i // 4 if i % 3 else i}" for i in range(203)] + ["hot"] * 90 + [None, ""]
    docs = _docs(spark, texts)
    got = sharding.shard_documents(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_sharding_joins_pairs(spark):
    rows = spark.range(2_000).select(F.col("id").alias("rid"), F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("shard"))
    links = spark.range(1_000).select((F.col("id") * 2 + 1).alias("a"), (F.col("id") * 2).alias("b"))

    def cut(labels):
        at = {r.rid: r.shard for r in labels.collect()}
        return sum(at[2 * k] != at[2 * k + 1] for k in range(1_000))

    after = [cut(sharding.propagate(rows, links, 8, rounds)) for rounds in (5, None)]
    assert after[1] < after[0] and after[1] <= 10, after


def test_decontamination_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"t{i}" for i in range(30)] + ["É", "Zz"]
    items = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (3, 9, 10, 14, 30, 1)] + [None, "!!"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for k in range(20):
        words = items[k % 5].split()
        low = rng.randrange(len(words))
        texts[k] = texts[k] + "; " + ", ".join(words[low : low + 12]).upper()
    texts += [None, "", items[3] + " " + items[3]]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id bigint, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for i, t in enumerate(items):
        w = word.findall(_lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    got = {r.doc_id: r for r in decontaminate.contamination(_docs(spark, texts), bench).collect()}
    blocks = {r.doc_id: r for r in decontaminate.find_matches(_docs(spark, texts), bench, block_words=12).collect()}
    for d, t in enumerate(texts):
        w = word.findall(_lower(t))
        hit, found = set(), set()
        for window, owners in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    found |= owners
                    hit |= set(range(i, i + len(window)))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (got[d].n_words, got[d].n_hit, got[d].n_items, got[d].items_sha256, got[d].contaminated) == (len(w), len(hit), len(found), digest, bool(hit))
        assert set(blocks[d].hits) == hit and set(blocks[d].items) == set(map(str, found))
    assert decontaminate.contamination(_docs(spark, texts), bench.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    docs = _docs(spark, ["alpha beta x gamma", "gamma alpha", "alpha beta gamma"])
    got = {r.doc_id: (list(r.items), list(r.near_items)) for r in decontaminate.find_matches(docs, bench, slop=1).collect()}
    assert got == {0: ([], ["1"]), 1: ([], []), 2: (["1"], ["1"])}


def test_proximity_brute_force(spark):
    rng = random.Random(5)
    items = [[f"v{rng.randrange(9)}" for _ in range(n)] for n in (3, 10, 12, 25)]
    texts = [[f"v{rng.randrange(9)}" for _ in range(rng.randrange(60))] for _ in range(30)]
    for k in range(12):  # an item with a word more, and two of them changed about
        words = list(items[k % 4])
        words.insert(rng.randrange(len(words)), "other")
        at = rng.randrange(len(words) - 1)
        words[at], words[at + 1] = words[at + 1], words[at]
        texts[k] = texts[k] + words
    texts.append(["v1"] * 5_000 + items[3])  # long, and one term in all its places
    counts = {}
    for w in texts:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    got = {r.doc_id: set(r.near_items) for r in decontaminate.find_matches(_docs(spark, [" ".join(w) for w in texts]), bench, slop=2).collect()}

    def near(window, words):
        rarest = min(range(len(window)), key=lambda o: counts.get(window[o], 0))
        ties = [o for o in range(len(window)) if counts.get(window[o], 0) == counts.get(window[rarest], 0)]
        each = [any(all(x in words[max(0, at - a + o - 2) : max(0, at - a + o + 3)] for o, x in enumerate(window)) for at, y in enumerate(words) if y == window[a]) for a in ties]
        return all(each), any(each)

    for d, words in enumerate(texts):
        for i, item in enumerate(items):
            each = [near(item[k : k + 10], words) for k in range(max(1, len(item) - 9))]
            assert any(x for x, _ in each) <= (str(i) in got[d]) <= any(x for _, x in each), (d, i)


def test_decontamination_divides_long_items(spark):
    rng = random.Random(6)
    item = [f"u{rng.randrange(500)}" for _ in range(3_000)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item[:40])), (2, "")], "item_id bigint, text string")
    texts = [" ".join(item[k : k + 10]) for k in range(0, 2_990, 7)] + [" ".join(item[k : k + 9]) for k in range(5)]
    rows = decontaminate.find_matches(_docs(spark, texts), bench, block_words=700).collect()
    assert {r.doc_id: (len(r.hits), list(r.items)) for r in rows} == {d: (10, ["1"]) if d < len(texts) - 5 else (0, []) for d in range(len(texts))}
    runs, blocks = decontaminate.item_runs(bench, 10, 700)
    sizes = [r.n for r in runs.groupBy("block").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()]
    assert blocks > 1 and max(sizes) <= 700


def _complementary(n):
    """Two words of n characters without one equal place, of which any polynomial over 2**64 gives one hash from 1,024 on."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 72, 1_024, 4_096, 65_536])
def test_different_words_stay_different(spark, n):
    a, b = _complementary(n)
    docs = _docs(spark, [f"{a} x", f"{b} x", f"{a.upper()} x"])
    assert sorted((r.doc_id, r.component_id) for r in jaccard.components(docs).collect()) == [(0, 0), (1, 1), (2, 0)]
    bench = spark.createDataFrame([(1, a)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, bench).collect()) == [(0, 1), (1, 0), (2, 1)]


def test_repeated_words_take_linear_time():
    """100,000 equal words in item and document: one window, one match a place."""
    import time

    import pyarrow as pa

    text = pa.array(["same " * 100_000])
    began = time.time()
    windows = decontaminate.Windows(pa.array(["1"]), text, 10)
    windows.rarest_first(np.array([100_000]))
    index = next(decontaminate._shard_of(pa.array([7]), text, "0"))
    w, start, doc = decontaminate.matches(decontaminate.Shard(index, 0), windows)
    assert len(windows.terms) == 1 and len(w) == 100_000 - 9 and not w.any() and not doc.any() and len(np.unique(start)) == len(start)
    assert decontaminate._items_of(windows, w, doc, 1).to_pylist() == [["1"]] and time.time() - began < 20


def test_quality_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "the", "x#", "Y|"]) + rng.choice(["", "\n", "\n\n"]) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    texts += [None, "", " \n ", "a b c a b c", "line\nline\n\nline", "\x0bx\x0c"]
    got = {r.doc_id: r for r in quality.judge(_docs(spark, texts)).collect()}
    for d, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {k for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for k in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed), t
        assert not (failed and r.kept)
    assert quality.judge(_docs(spark, texts).limit(0)).count() == 0
    assert quality.judge(_docs(spark, texts).drop("lang")).count() == len(texts)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "pii", "bpe"]
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
        out = out.cache()
        assert 0.7 * n < out.count() <= n
        docs = out
    assert docs.filter(F.col("n_tokens") != F.size("ids")).count() == 0


def test_pipeline_keeps_null_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, "a text without a number, seen once in here"), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "twice the same row in here"), (10**9 + 2, "twice the same row in here")]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    now = docs.limit(20).unionByName(extra)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf)
        if k < 4:
            now = now.cache()
    got = [r.doc_id for r in now.select("doc_id").collect()]
    assert got.count(None) == 1 and got.count(10**9) == 1 and got.count(10**9 + 1) == 1 and got.count(10**9 + 2) == 1


def test_repeated_rows_and_clashing_columns(spark):
    text = "the same row, twice, with some more words in it to be read again and again"
    docs = _docs(spark, [text, "other"]).unionByName(_docs(spark, [text]))
    ids = bpe.encode_digests(docs, PATH).filter("doc_id = 0").collect()
    assert len(ids) == 2 and ids[0] == ids[1]
    files = sorted((r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_files(tokenfiles.write_files(docs, PATH)).filter("doc_id = 0").collect())
    assert len(files) == 2 and files[0][1:] == files[1][1:] and files[1][0] == files[0][1]
    judged = quality.judge(docs).filter("doc_id = 0").collect()
    assert len(judged) == 2 and judged[0] == judged[1]
    labels = spark.createDataFrame([(0, 1, "x"), (0, 1, "x"), (1, 0, "y")], "doc_id bigint, toxic int, text string")
    scored = toxicity.toxicity(docs, labels).filter("doc_id = 0").collect()
    assert len(scored) == 2 and scored[0] == scored[1]
    bench = spark.createDataFrame([(7, "with some more words in it to be read again and", 3, "k")], "item_id bigint, text string, doc_id bigint, n_words string")
    hit = decontaminate.contamination(docs, bench).filter("contaminated").collect()
    assert [r.doc_id for r in hit] == [0, 0] and hit[0] == hit[1] and hit[0].n_hit == 11  # the item has eleven words
