"""Text operators against plain per-text versions."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from jobspectra.llm import maintext, packing, pieces, pii, quality, tokenfile, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "Ünï cödé ☃ 🙂 a b", "x " * 3000, "word\n" * 400, "y" * 5000, "a b c a b c a b c\n\nA B\nA B\n", "x\x1cy \x85z"]


def table(spark, texts, extra="kept string, n_words string, ids string, score string"):
    """Texts with ids, and columns whose names clash with results."""
    rows = [(i, t, "k", "n", "i", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


def plain_base(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_verdict(spark):
    rng = random.Random(1)
    texts = [*ODD, *(" ".join(rng.choice(["a", "b", "Cc", "d#", "é|", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(200))]
    rows = quality.judge(table(spark, texts), counts=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    # Any order of the rules gives the same verdict, and every rule can reject.
    for block in (texts,):
        features = quality.Features([t or "" for t in block])
        alone = np.array([rule.rejects(features) for rule in quality.RULES])
        assert (quality.cascade(quality.Features([t or "" for t in block]), quality.RULES[::-1]) == ~alone.any(axis=0)).all()
        assert [r.kept for r in sorted(rows, key=lambda r: r.doc_id)] == (~alone.any(axis=0)).tolist()


def test_capitals_are_judged_in_mostly_latin_texts_only(spark):
    words = {"ru": "слово и ещё много разных слов об этом деле", "el": "λόγος και άλλα πολλά για αυτό το θέμα", "ar": "كلمة وكلمات أخرى كثيرة عن هذا الأمر"}
    rng = random.Random(4)
    texts = {k: " ".join(rng.choices(v.split(), k=60)) + " NATO SQL" for k, v in words.items()}
    texts |= {"caps": " ".join(f"LOUD WORDS OF A TEXT {i} AND MORE OF {i * i}" for i in range(12)), "mixed": " ".join(f"NATO SQL HTTP {i} EU слово" for i in range(20))}
    rule = next(r for r in quality.RULES if r.name == "capitals")
    assert rule.rejects(quality.Features(list(texts.values()))).tolist() == [False, False, False, True, True]
    kept = {r.kept_as: r.kept for r in quality.judge(spark.createDataFrame([*texts.items()], "kept_as string, text string")).collect()}
    assert kept == {"ru": True, "el": True, "ar": True, "caps": False, "mixed": False}


def test_quality_plan_prefers_rejections_per_cost(spark):
    order = quality.plan(table(spark, ["### *** " * 60] * 30 + ["plain words of a text " * 20] * 5))
    worth = [m["rate"] / max(m["cost"], 1e-9) for m in order]
    assert worth == sorted(worth, reverse=True) and {m["rule"] for m in order} == {r.name for r in quality.RULES}
    assert quality.judge(table(spark, [])).count() == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"\D", "", m.group())
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("letters", ["a@.b-% ", "12.3 -", "+1 2(3).-4", "0123456789 -", "a@1.+ ,é"])
def test_pii_base_spans(letters):
    rng = random.Random(letters)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE_KINDS] == plain_spans(text)


def test_pii_checks_and_context(spark):
    assert [s[0] for s in pii.spans("pay to GB82 WEST 1234 5698 7654 32 now")] == ["iban"]
    assert pii.spans("pay to GB82 WEST 1234 5698 7654 33 now") == []
    assert [s[0] for s in pii.spans("call me: 020 7946 0958")] == ["local_phone"] and pii.spans("room 020 7946 0958") == []
    assert [s[0] for s in pii.spans("password=abcd1234efgh")] == ["secret"]
    text = "mail bob@x.org, or 4111 1111 1111 1111"
    docs = table(spark, [text, None, ""], "spans string, n_words string, ids string, score string")
    rows = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [(s.kind, s.start, s.end) for s in rows[0].spans] == [("email", 5, 14), ("card", 19, 38)] and rows[1].spans == []
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns
    assert [r.text for r in redacted.orderBy("doc_id").collect()] == ["mail [EMAIL], or [CARD]", None, ""]
    assert pii.find(docs.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> <b>Site</b></header>
<nav><ul><li><a href=a>One</a></li></ul></nav><div class="cookie-notice">We use cookies</div>%s
<section id="comments"><p>Great text, I like it very much and will read on</p></section><aside><p>Related matters of the day</p></aside>
<form><p>Subscribe to our letter</p><input></form><footer>&copy; 2020 Somebody</footer><script>var a = "</p>";</script></body></html>"""


@pytest.mark.parametrize("place", ["<article>%s</article>", "<div id=content>%s</div>", "<main><div>%s</div></main>", "<div>%s</div>"])
def test_main_text(place):
    body = """<h1>A headline of the page &eacute;</h1><p>First paragraph with <a href=x>a link</a> and   more
    words, long enough to be text.</p><!-- <p>no</p> --><div class="ad">Buy now</div><p>Second paragraph &amp; its many words that follow here &lt;b&gt;.</p>"""
    want = ["A headline of the page é", "First paragraph with a link and more words, long enough to be text.",
            "Second paragraph & its many words that follow here <b>."]
    assert maintext.main_text(PAGE % place % body).split("\n") == want


def test_main_text_edges(spark):
    odd = [None, "", "<", "<p", "a < b", "<script>" * 2000, "<div>" * 5000, "</div>" * 100, "<a href='" * 3000, "<!--" * 3000]
    docs = spark.createDataFrame([(i, "u", t, "old") for i, t in enumerate(odd)], "page_id long, url string, html string, text string")
    rows = maintext.extract(docs).collect()
    assert len(rows) == len(odd) and all(isinstance(r.text, str) for r in rows)
    assert maintext.extract(docs.limit(0)).count() == 0


WORDS = "%s paragraph of this page with words enough to be told apart from a menu, and then some more of them."
ONE, TWO, THREE = (WORDS % w for w in ("First", "Second", "Third"))


@pytest.mark.parametrize("before", [
    '<p class="advert">Buy now</p>', '<p class="share">Tell others</p>', '<p class="notice">Mind this', '<p id="tags">Some tags<hr>',
    "<nav><ul>" + "<li><a href=x>Go</a>" * 700 + "</ul></nav>", "<nav><ul>" + "<li><p class=x>Go" * 700 + "</ul></nav>",
    '<div class="comments">' + '<p class="c">So it is</p>' * 700 + "</div>", '<dl class="x"><dt class="ad">A<dd>B</dl>', '<ul><li class="ad">Buy<li>B</ul>',
    '<table><tr><td class="ad">Buy<td>B<tr><td>C</table>', '<div class="ad"><table><tr><td>Buy</div></table></div>', '<h2 class="x">Head</h3>',
    "<nav>" + "<div>" * 900 + "</nav>"])
def test_main_text_goes_on_after_elements_ended_by_rule(before):
    found = maintext.main_text(f"<body><article><p>{ONE}</p>{before}<p>{TWO}</p><div>{THREE}</div></article></body>").split("\n")
    assert [t for t in found if "paragraph" in t] == [ONE, TWO, THREE]


@pytest.mark.parametrize("between", [
    '<svg class="i"/>', "<math/>", "<svg><path d='M0'/><g></g></svg>", "<svg><style/><title/><g/></svg>", "<svg><path>", "<button>Go", "<noscript>", "<object>",
    "<select><option>Go", "<template>", "<svg-icon></svg-icon>", "<div><button>Go</div>", "<nav><object></nav>", "<noscript><b>Go</b></noscript>",
    "<button>Go<button>Go</button>", "<select><option>Go<select><option>Go</select>", "<noscript><noscript>Go</noscript>", "<noscript></article></noscript>",
    "<svg><foreignObject><p>Go</p></foreignObject></svg>", "<template></article><p>Go</template>", "<script>'<svg>'</script>", '<script data-a="<b>">Go</script>'])
def test_main_text_goes_on_after_elements_without_text(between):
    page = f"<body><article><p>{ONE}</p>{between}<p>{TWO}</p></article><div>{THREE}</div></body>"
    assert [t for t in maintext.main_text(page).split("\n") if "paragraph" in t] == [ONE, TWO]
    if "</" in between and "<button>Go</div>" not in between and between.count("Go") < 2:
        assert "Go" not in [b.text for b in maintext.blocks(page)]
    assert maintext.main_text(f"<article><p>{ONE}</p><p>{TWO}</p>{between}").split("\n")[:2] == [ONE, TWO]


def test_elements_without_text_leave_the_block_around_them():
    page = f"<article><p>{ONE} <svg><text>a</text></svg><button><div>b</div></button><select><option>c</select><object><p>d</object><noscript>e</noscript>{TWO}</p>"
    assert [b.text for b in maintext.blocks(page)] == [f"{ONE} {TWO}"]


@pytest.mark.parametrize("opened, closed", [
    ('<section id="search-methods">', "</section>"), ('<div id="legal-history">', "</div>"), ('<figure aria-label="Share of votes">', "</figure>"),
    ('<div class="tag-theory">', "</div>"), ('<div class="notice">', "</div>"), ('<div data-id="share">', "</div>"), ('<section id="related">', "</section>")])
def test_names_that_hold_a_word_of_furniture_lose_nothing(opened, closed):
    page = f"<article><header class='entry-header'><h1>The title here</h1></header><p>{ONE}</p>{opened}<h2 id='related-work'>Related work</h2><p>{TWO}</p>{closed}<p>{THREE}</p></article>"
    assert maintext.main_text(page).split("\n") == ["The title here", ONE, "Related work", TWO, THREE]


@pytest.mark.parametrize("name", ["ad", "big advert", "cookie-notice", "social-share", "site-footer", "comments", "comment-list", "nav-links", "sidebar_left", "related-posts"])
def test_names_of_furniture_still_count(name):
    inside = "<p><a href=x>Read more of this</a></p><p>Short</p>" if name == "related-posts" else f"<p>{TWO}</p>"
    for attribute in ("class", "id", "role"):
        assert maintext.main_text(f'<article><p>{ONE}</p><div {attribute}="{name}">{inside}</div><p>{THREE}</p></article>') == f"{ONE}\n{THREE}"


def test_personal_data_of_a_very_long_text():
    unit = "phone 030 1234 5678 or +49 30 1234 5678, mail a@b.example" + " " * 60 + "tel 0171 555 0199 or 4111 1111 1111 1111" + "\n" * 60
    once = pii.spans(unit)
    assert {k for k, *_ in once} == {"email", "phone", "local_phone", "card"}
    assert not any(k == "local_phone" and a < d and c < b for k, a, b, _ in once for o, c, d, _ in once if o != "local_phone")
    assert pii.spans(unit * 12000) == [(k, a + i * len(unit), b + i * len(unit), s) for i in range(12000) for k, a, b, s in once]


SHELLS = {
    "bare": "%s", "article": "<article>%s</article>", "main": "<div><main>%s</main></div>", "form": "<form id=f>%s</form>",
    "form and article": "<form id=f><article>%s</article></form>", "dialog in form": "<form><div><dialog open>%s</dialog></div></form>",
    "teaser before": "<article class=teaser><p>Two words</p></article><div>%s</div>", "hidden beside": "<p hidden>Not to be seen by anyone who reads this page at all today</p><div>%s</div>",
    "styled away": "<div style='color:red; display: none'><p>Not to be seen by anyone who reads this page at all today</p></div><section>%s</section>",
    "form below": "<article>%s</article><form><p>Tell us what you think about this page in a few words of your own</p><label>Name</label></form>",
}
INSIDE = {
    "long": (f"<h1>The title here</h1><p>{ONE}</p><p>{TWO}</p>", ["The title here", ONE, TWO]),
    "short": ("<h1>Title words</h1><p>Short but it is the page.</p>", ["Title words", "Short but it is the page."]),
    "menu": (f"<nav><a href=x>Go</a></nav><p>{ONE}</p><p>{TWO}</p><ul><li><a href=x>Home</a><li><a href=y>News</a></ul>", [ONE, TWO]),
    "fields": (f"<p>{ONE}</p><p>{TWO}</p><fieldset><p>Your name and the address that we may write to, please, in full</p></fieldset>", [ONE, TWO]),
}


@pytest.mark.parametrize("shell", SHELLS)
@pytest.mark.parametrize("inside", INSIDE)
def test_page_shapes_lose_nothing(shell, inside):
    body, want = INSIDE[inside]
    if inside == "short" and shell in ("teaser before", "dialog in form", "form"):
        want = None  # without long text nothing tells the page's form from a form, or an article from a teaser
    found = maintext.main_text(f"<html><body><header><a href=x>Site</a></header>{SHELLS[shell] % body}<footer>All rights</footer></body></html>").split("\n")
    assert want is None or found == want


def test_linked_lines_of_an_article_stay():
    page = f"<article><p>{ONE}</p><p><a href=x>See also the history of the old town</a></p><ul><li><a href=x>Smith, On rivers of Europe, 1990</a></ul><p><a href=x>Share</a></p></article>"
    assert maintext.main_text(page).split("\n") == [ONE, "See also the history of the old town", "Smith, On rivers of Europe, 1990"]


def test_hidden_elements_by_attribute_not_by_value():
    shown = [f'<p class="hidden">{ONE}</p>', f'<p hidden="until-found">{ONE}</p>', f"<p data-hidden>{ONE}</p>", f'<p title="a hidden b">{ONE}</p>', f'<p style="display:inline">{ONE}</p>']
    gone = [f"<p hidden>{ONE}</p>", f'<p class=a hidden="">{ONE}</p>', f"<p HIDDEN=hidden>{ONE}</p>", f'<p style="visibility:hidden">{ONE}</p>']
    for tag in shown + gone:
        assert maintext.main_text(f"<article><p>{TWO}</p>{tag}</article>") == (f"{TWO}\n{ONE}" if tag in shown else TWO)


def test_long_and_nested_pages_take_linear_time():
    deep = "<form><fieldset>" * 20000 + f"<p>{ONE}</p>"
    assert maintext.main_text(deep) == ONE
    assert maintext.main_text("<article>" + f"<p>{ONE}</p>" * 20000 + "</article>") == "\n".join([ONE] * 20000)


def test_open_elements_end_by_the_rules_of_html():
    held = lambda page: [(b.text, b.furniture, b.hint) for b in maintext.blocks(page)]
    assert held('<p class="ad">a<p>b') == [("a", 0, 1), ("b", 0, 0)]
    assert held('<p class="ad">a<button>b</p>c</button>d</p>e')[-1] == ("e", 0, 0)
    assert held('<ul><li class="ad">a<ul><li>b</ul>c<li>d</ul>') == [("a", 0, 1), ("b", 0, 1), ("c", 0, 1), ("d", 0, 0)]
    assert held('<nav>a<table><tr><td>b</nav>c</table>d</nav>e') == [("a", 1, 0), ("b", 1, 0), ("c", 1, 0), ("d", 1, 0), ("e", 0, 0)]
    assert held('<ul><li class="ad"><div>a<li>b</ul>') == [("a", 0, 1), ("b", 0, 0)]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(sp):
    codec, rng = pieces.codec(public_tokenizers.path("piece_bpe_32k.model")), random.Random(5)
    texts = ["".join(rng.choice("aAbeE  tTh.,▁\n\t0🙂éñ<>/s'-x☃") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 2000, " " * 70, "ab" * 3000, "</s><s><unk><0x0A> x", "the" * 700, "\0x", "====----" * 40, *(t for t in ODD if t)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == sp.encode(text) and codec.decode([*ids, 2]) == sp.decode([*sp.encode(text), 2])


def test_pieces_tables(spark, sp):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, ODD)
    for r in pieces.decode(pieces.encode(docs, path), path, text_col="back").collect():
        assert r.ids == [*sp.encode(ODD[r.doc_id] or ""), 2] and r.back == (ODD[r.doc_id] or "").replace("▁", " ")
    assert pieces.digests(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_tokens_equal_the_library(name):
    path, rng = public_tokenizers.path(name), random.Random(2)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path)
    plain.encode_special_tokens = True
    texts = ["".join(rng.choice(["a", "B", "é", " ", " ", "\n", "'s", ".", "1", "!!", " ", "\t", "Σ", "<|endoftext|>"]) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += [t for t in ODD if t is not None]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == want and own.encode(texts[:50]) == want[:50]


@pytest.mark.parametrize("name, special", [("byte_bpe_50k.json", {50256}), ("word_bpe_49k.json", {49406, 49407})])
def test_special_tokens_in_texts_equal_the_unmodified_library(name, special):
    path, rng = public_tokenizers.path(name), random.Random(6)
    plain, own = Tokenizer.from_file(path), tokens.encoder(path)
    parts = ["a", "B", "é", " ", " ", "\n", "'s", ".", "1", "!!", "\t", "Σ", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.encode(texts) == [np.array(ids, "<u4").tobytes() for ids in want] and special <= set().union(*want)


def test_words_are_encoded_once_in_either_case_and_with_marks(monkeypatch):
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(4)
    plain, own = Tokenizer.from_file(path), tokens.Encoder(path, special_as_text=False)
    wanted = lambda texts: [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    texts = ["Straße. straße,\nSTRAßE!! straße\tÉté\r\nété... (été) straße"]
    assert own.encode(texts) == wanted(texts)
    assert {w for w in own.words if w.isalpha()} == {"straße", "été"} and not own.led and not own.bare

    monkeypatch.setattr(tokens, "MAX_UNITS", 300)
    parts = ["a", "Z", "É", "ß", "ª", "µ", "Ÿ", "İ", "œ", "ﬁ", "\u0301", "'", "'S", "’", ".", "!?", " ", "\n", "\r\n", "\x1c", "\x85", "\xa0", "#", "-", "7", "²",
             "<|", "<|EndOfText|>", "<|endoftext|>", "\xad", "end", "word"]
    texts = ["".join(rng.choice(parts[:k]) for _ in range(rng.randint(0, 14))) for k in (5, 18, len(parts)) for _ in range(1500)]
    assert [ids for lo in range(0, len(texts), 100) for ids in own.encode(texts[lo:lo + 100])] == wanted(texts)
    assert len(own.words) <= 1000


def test_common_words_are_asked_for_once(monkeypatch):
    """A word with marks or beside a line feed is its letters' ids and theirs."""
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        plain, own, asked = Tokenizer.from_file(path), tokens.Encoder(path, special_as_text=False), []
        own.merges = own.words.merges = lambda word, merges=own.merges: asked.append(word) or merges(word)
        texts = [f"x Straße Straße, Straße. Straße!!\nStraße Straße.\nStraße {''.join(chr(97 + int(c)) for c in str(i))}" for i in range(1, 200)]
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert [own.encode([t])[0] for t in texts] == want and not any("\n" in u for u in [*own.led, *own.bare])
        often = [w for w in asked if "tra" in w]
        assert len(often) == len(set(often)) <= 2
        monkeypatch.setattr(tokens, "MAX_UNITS", 40)
        assert [own.encode([t])[0] for t in texts] == want and len(own.led) <= 60 and len(own.words) <= 60


def test_new_words_are_asked_for_together(monkeypatch):
    """Letters, digits and marks of a block of texts go to the library in one call, whatever they stand beside."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(12)
    plain, own, asked = Tokenizer.from_file(path), tokens.Encoder(path, special_as_text=False), []
    own.words.ask = lambda words, common, ask=own.words.ask: asked.append((words, common)) or ask(words, common)
    wanted = lambda texts: [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    texts = ["Nord,Süd (ÉTÉ) 12.5 nord", "", "süd--été!! it's 2×3", "7÷2 \xbfqué? nord,süd"]
    assert own.encode(texts) == wanted(texts) and own.encode(texts[::-1]) == wanted(texts[::-1])
    assert [(sorted(words[:n]), sorted(words[n:])) for words, n in asked] == [
        (sorted(["nord", ",", "süd", "(", "été", ")", "1", "2", ".", "5", "--", "!!"]), sorted(["it's", "2×3", "7÷2", "¿qué?"]))]

    parts = [*"abzAZéÉßÿÞ×÷ªºµ¿²¼0189.,!-'’\"<>/|_", " ", " ", "\n", "\t", "\r", "\x00", "\x0b", "\x7f", "\x85", "\xa0", "'s", "'LL", "</w>", "<|", "<|endoftext|>", "œ", "word"]
    texts = ["".join(rng.choice(parts[:k]) for _ in range(rng.randint(0, 20))) for k in (12, 33, len(parts)) for _ in range(1500)]
    ids, sizes = own.encode_flat(texts)
    assert ids.astype("<u4").tobytes() == b"".join(wanted(texts)) and (4 * sizes).tolist() == [len(w) for w in wanted(texts)]
    assert [len(x) for x in own.encode_flat([])] == [0, 0]

    monkeypatch.setattr(tokens, "MAX_UNITS", 40)
    asked.clear()
    texts = [f"often {''.join(chr(97 + int(c)) for c in str(i))} {'x' * 300}" for i in range(200)]
    assert [own.encode([t])[0] for t in texts] == wanted(texts) and len(own.words) <= 60
    assert sum("often" in words for words, _ in asked) == 1 and own.words.chars == sum(map(len, own.words))


def test_pieces_of_many_texts_at_once(sp, monkeypatch):
    codec, rng = pieces.Codec(public_tokenizers.path("piece_bpe_32k.model")), random.Random(11)
    made = []
    codec.segments.make = lambda s, make=codec.by_table: made.append(s) or make(s)
    texts = ["".join(rng.choice(["the", "word", "é", " ", " ", "▁", "\n", ".", "🙂", "ñ", "<s>"]) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    assert codec.encode_all(texts) == [sp.encode(t) for t in texts] and len(made) == len(set(made))
    assert codec.encode_all([]) == [] and codec.encode_all(["", "", "a", ""]) == [[], [], sp.encode("a"), []]

    monkeypatch.setattr(pieces, "MAX_KEPT", 40)
    made.clear()
    for i in range(300):
        text = "often " + "".join(chr(97 + int(c)) for c in str(i))
        assert codec.encode(text) == sp.encode(text)
    assert made.count("▁often") <= 1 and len(codec.segments) + len(codec.segments.older) < 2 * 40 + 60


def test_packing_covers_every_token(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, *ODD, *("some words of text " * k for k in range(1, 300, 3))]
    docs = table(spark, texts, "start string, offset string, ids string, length string")
    plain = Tokenizer.from_file(path)
    found, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs, path).collect():
        found[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        parts = sorted(found[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == ids.tobytes() and {r.doc_tokens for r in parts} == {len(ids)}
        assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
    for rows in windows.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *np.cumsum([r.length for r in rows])[:-1]] and sum(r.length for r in rows) <= 2048
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_pads_little(spark):
    rng = random.Random(8)
    texts = ["word " * min(60000, int(rng.paretovariate(0.9) * 120)) for _ in range(1500)]
    rows = packing.pack(table(spark, texts).coalesce(1), public_tokenizers.path("byte_bpe_50k.json")).select("sequence_id", "length").collect()
    total, n = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert n * 2048 <= 1.015 * total + 2 * 2048


def test_differencing_is_near_equal_and_adds_windows():
    rng = random.Random(3)
    sizes = [rng.randint(1, 900) for _ in range(300)]
    found = packing.differencing(sizes, 64)
    assert sorted(i for w in found for i in w) == list(range(300))
    sums = [sum(sizes[i] for i in w) for w in found]
    assert max(sums) - min(sums) < 250
    assert [sorted(w) for w in packing.windows([1500, 1500, 1000], 2048)] and len(packing.windows([1500, 1500, 1000], 2048)) == 3
    assert packing.windows([], 2048) == [] and packing.differencing([5], 3) == [[0]]


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 3000])
def test_token_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 65536, n), np.zeros(n, int), rng.integers(0, 3, n), np.resize([7, 8, 9, 65535], n), np.minimum(rng.zipf(1.3, n), 65535)):
        assert (tokenfile.decode_ids(tokenfile.encode_ids(ids), n) == ids).all()


def test_token_files_fix_the_places_of_repeated_ids(spark, tmp_path):
    rows = [(i % 3, f"text {i} of some words") for i in range(200)] + [(1, "the same")] * 300
    places = []
    for k, order in enumerate((rows, rows[::-1])):
        tokenfile.write(spark.createDataFrame(order, "doc_id long, text string").repartition(3 + k), str(tmp_path / str(k)), public_tokenizers.path("word_bpe_49k.json"))
        found = tokenfile.read(spark, str(tmp_path / str(k))).collect()
        places.append(sorted((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in found))
    assert len(places[0]) == 500 and places[0] == places[1]
    assert [p[1] for p in places[0]] == [0, *np.cumsum([p[2] for p in places[0]])[:-1]]


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, [*ODD, *ODD]).union(spark.createDataFrame([(None, "no id", "", "", "", "")], "doc_id long, text string, kept string, n_words string, ids string, score string")).repartition(3)
    tokenfile.write(docs, str(tmp_path / "t"), path)
    plain, at = Tokenizer.from_file(path), 0
    rows = sorted(tokenfile.read(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *range(2 * len(ODD))]
    for r, text in zip(rows, ["no id", *ODD, *ODD]):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), ids.tobytes())
        at += len(ids)
    block = tokenfile.write_block([1], [4], np.array([1, 2, 3, 4], "<u4"))
    assert zlib.crc32(tokenfile.read_block(block)[2].astype("<u4").tobytes()) == zlib.crc32(np.array([1, 2, 3, 4], "<u4").tobytes())
    with pytest.raises(ValueError):
        tokenfile.read_block(block[:12] + b"\0\0\0\0" + block[16:])
    tokenfile.write(docs.limit(0), str(tmp_path / "e"), path)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0
