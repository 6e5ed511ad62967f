"""Operators that handle each row alone: against brute force or exact round trips."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from rookery.llm import bpe, chat, html_text, media, warc
from rookery.llm.common import prepared
from rookery.llm.queries import QUERIES, vocabulary_path

LONG = "word " * 20_000 + "x" * 30_000
TEXTS = [None, "", " ", "a", "  two  blanks\n\n\ttab\r\n", "naïve 漢字 😀 '''s <|endoftext|> x", LONG, "a", "a"]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, repeated rows, long texts and extra columns with clashing names."""
    rows = [(k if k < 7 else 3, t, "n", 1.5, None) for k, t in enumerate(TEXTS)] + [(None, "t", "n", 1.5, None)]
    schema = "doc_id long, text string, tokens string, n_bytes double, k string"
    return prepared(spark).createDataFrame(rows, schema)


def test_bpe_equals_the_tokenizers_library(spark, docs):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary_path())
    got = [(r.doc_id, list(r.tokens), r.decoded) for r in bpe.encoded(docs, vocabulary_path()).collect()]
    want = []
    for r in docs.collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, theirs.decode(ids, skip_special_tokens=False)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bpe_on_random_words():
    from tokenizers import Tokenizer

    with open(vocabulary_path(), encoding="utf-8") as file:
        coder = bpe.Coder(file.read())
    theirs = Tokenizer.from_file(vocabulary_path())
    rng = random.Random(5)
    texts = ["".join(rng.choice("aeinst '\n 1é漢😀.") for _ in range(rng.randint(0, 90))) for _ in range(2000)]
    assert coder.encode_all(texts) == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    word = b"thelongestwordintheworldisnotthisone" * 3
    ids, counts = coder._merge_short([word], len(word))
    assert tuple(ids.tolist()) == coder._merge_long(word) and counts.tolist() == [len(ids)]


def test_bpe_columns_round_trip(spark, docs):
    vocabulary = bpe.share(spark, vocabulary_path())
    coded = docs.select("text", bpe.encode(docs["text"], vocabulary).alias("ids"))
    back = coded.select("text", bpe.decode(coded["ids"], vocabulary).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_media_is_lossless_and_equal_for_equal_texts(spark, docs):
    rows = media.stored(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    same = {}
    for r in rows:
        raw = texts[r.doc_id]
        assert r.n_bytes == len(raw) and bytes(r.payload) == media.padded(raw)
        assert len(r.payload) % 64 == 0 and len(r.payload) >= 64
        assert same.setdefault(raw, (bytes(r.media), r.feature)) == (bytes(r.media), r.feature)


def test_png_filters_and_check_sums():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (9, 64), dtype=np.uint8)
    left = np.hstack([np.zeros((9, 1), int), image[:, :-1].astype(int)])
    above = np.vstack([np.zeros((1, 64), int), image[:-1].astype(int)])
    corner = np.hstack([np.zeros((9, 1), int), above[:, :-1]])
    base = left + above - corner
    far = np.abs(np.stack([left, above, corner]) - base)
    paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
    kinds = np.array([0, 1, 2, 3, 4, 4, 3, 2, 1])
    guesses = [0 * left, left, above, (left + above) // 2, paeth]
    lines = np.stack([(image[k].astype(int) - guesses[kind][k]) % 256 for k, kind in enumerate(kinds)])
    assert (media.unfilter(kinds, lines.astype(np.uint8)) == image).all()
    stored = media.write_png(image.tobytes())
    assert (media.read_png(stored) == image).all()
    broken = bytearray(stored)
    broken[50] ^= 1
    with pytest.raises(ValueError, match="check sum"):
        media.read_png(bytes(broken))


def test_media_query_gives_unsigned_check_sums(spark, tmp_path, docs):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.payload_sha256): r for r in QUERIES["op2_media"](spark, str(tmp_path)).collect()}
    for r in docs.collect():
        payload = media.padded((r.text or "").encode())
        assert got[r.doc_id, sha(payload)].tail_crc32 == zlib.crc32(payload[-64:])


# --- chat -------------------------------------------------------------------------


def test_escaping_is_reversible():
    rng = random.Random(3)
    bits = [*chat.CONTROL, "\\", "<", "|", "[", "/INST]", "a", "<\\|im_end|>", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


def test_template_language():
    render = chat.compile_template(
        "{% for x in xs %}{% if loop.first and not x == 'b' %}<{{ x|upper ~ '!' }}>{% elif x != 'c' %}{{ x }}"
        "{% else %}{% generation %}{{ 'g' ~ A ~ x }}{% endgeneration %}{% endif %}{% endfor %}",
        A="1",
    )
    assert render(xs=["a", "b", "c"]) == ("<A!>bg1c", [(5, 8)])
    assert chat.fold(("~", ("constant", "a"), ("name", "B")), {"B": "b"}) == ("constant", "ab")
    known = chat._fold_body(chat.parse("x{% if A == '1' %}y{% else %}z{% endif %}"), {"A": "1"})
    assert [n[0] for n in known] == ["write", "write"]
    for bad in ("{{ x.__class__ }}", "{{ open('f') }}", "{% for x in y %}", "{{ x|eval }}", "{% import os %}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ x.y }}")(x="no record")


def test_conversations_come_back(spark):
    control = "</s>[INST] ok [/INST]"
    rows = [
        (1, 1, "assistant", control, "x"), (1, 0, "user", None, "x"), (2, 0, None, "", "x"),
        (2, 0, "user", "b", "x"), (2, 0, "user", "b", "x"), (2, None, "assistant", "first<|im_end|>", "x"),
        (None, 0, "ass<|im_sep|>istant", LONG, "x"), (3, 0, "assistant", "one", "x"), (3, 1, "assistant", "two", "x"),
    ]
    given = prepared(spark).createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_turns(chat.formatted(given)).collect()}
    turns = {k: [(t.role, t.text) for t in r.turns] for k, r in got.items()}
    assert turns == {
        1: [("user", ""), ("assistant", control)],
        2: [("assistant", "first<|im_end|>"), ("", ""), ("user", "b"), ("user", "b")],
        None: [("ass<|im_sep|>istant", LONG)],
        3: [("assistant", "one"), ("assistant", "two")],
    }
    assert {k: r.loss for k, r in got.items()} == {1: control, 2: "first<|im_end|>", None: "", 3: "onetwo"}
    assert chat.read_turns(chat.formatted(given.limit(0))).count() == 0


# --- web pages -----------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p></header>
<nav><a href=/>Home</a></nav><div class="cookie-notice"><p>We use cookies. <button>OK</button></p></div>
<main><article><h1>Title &amp; more</h1><p>Short.<p>A paragraph with <a href=x>a  link</a> and
&#x41;&eacute; some more words,<br>which goes on.</p><div class="ad">Buy now</div><script>var t="</p>";</script>
<form><label>Email</label><input></form></article><section class="comments"><p>Great article, thanks for
writing this up, I learned much.</p></section></main><aside><p>Related: long enough to be a sentence, maybe.</p>
</aside><footer>&copy; us</footer></body></html>"""
PAGE_TEXT = "Title & more\nShort.\nA paragraph with a link and Aé some more words, which goes on."


@pytest.fixture(scope="module")
def model(spark):
    return html_text.trained(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_main_text(spark, model):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<<a <p <!", "x"), (4, "y", "<p>" * 3000 + "x", "x")]
    pages = prepared(spark).createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html_text.extracted(pages, model).collect()]
    assert sorted(got[:4], key=repr) == sorted([(1, "u", PAGE_TEXT)] * 2 + [(2, None, ""), (None, "v", "")], key=repr)
    assert len(got) == 6


@pytest.mark.parametrize(
    "hidden",
    [
        "<form><select><option>One<option>Two</select></form>",
        "<form><select><optgroup><option>One<optgroup><option>Two</form>",
        "<datalist><option>One<option>Two</datalist>",
        "<div><button>One<button>Two</div>",
        "<form><select><option>One<select><option>Two</select></form>",
        "<noscript><div><a>One</div></noscript><svg><g><path/><text>Two</text></svg>",
        "<div><template><p>One<p>Two</template></div>",
        "<textarea></div><select><option></textarea><script>'</div><select>'</script>",
    ],
)
def test_text_after_hidden_elements_stays(hidden):
    nodes = html_text.tree(f"<body><div>{hidden}<p>Before it</p></div><p>And after</p></body>")
    texts = [n for n in nodes if not n.tag]
    assert [n.text for n in texts] == ["Before it", "And after"] and not any(n.linked for n in texts)
    tops = [nodes[nodes[n.parent].parent].tag for n in texts]
    assert tops == ["div", "body"]


def test_main_text_of_labelled_pages_held_out():
    pages = [(n, html_text._states(n, True)) for n in map(html_text.tree, html_text.labelled_pages())]
    model = html_text.fit(pages[::2])
    wrong = total = 0
    for nodes, states in pages[1::2]:
        for node, state, chance in zip(nodes, states, model.marginals(nodes), strict=True):
            wrong += not node.tag and (chance >= 0.5) != state
            total += not node.tag
    assert wrong <= 0.01 * total


def test_marginals_are_exact(model):
    """Against the sum over all assignments of a small page."""
    nodes = html_text.tree("<div><p>One two, three.</p><nav><a>x</a></nav></div>")
    own = [sum(model.weights.get(f, 0) for f in html_text._own_features(nodes, k)) for k in range(len(nodes))]
    own[0] += model.root
    total, yes = 0.0, np.zeros(len(nodes))
    for bits in range(2 ** len(nodes)):
        state = [(bits >> k) & 1 for k in range(len(nodes))]
        value = np.exp(
            sum(o * s for o, s in zip(own, state, strict=True))
            + sum(model.edges[int(not n.tag), state[n.parent], state[k]] for k, n in enumerate(nodes) if k)
        )
        total += value
        yes += value * np.array(state)
    assert np.allclose(model.marginals(nodes), yes / total)


def test_archives_come_back(spark):
    big = "é" * 60 + "\r\n\r\nWARC/1.0\r\n"
    rows = [(5, "http://a b", big, 1), (3, None, big, 1), (3, None, big, 1), (9, "u", "small", 1), (8, "u", "small", 1), (None, "u", big, 1), (4, "u", None, 1), (2, "u", "", 1)]
    pages = prepared(spark).createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted((tuple(r) for r in warc.archived(pages).collect()), key=repr)
    full, tiny, none = ((len(t.encode()), sha(t)) for t in (big, "small", ""))
    want = [(5, *full, "revisit", 3), (3, *full, "response", None), (3, *full, "response", None), (None, *full, "revisit", 3)]
    want += [(9, *tiny, "response", None), (8, *tiny, "response", None), (4, *none, "response", None), (2, *none, "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.archived(pages.limit(0)).count() == 0


def test_both_versions_of_legacy_archives():
    for version in (1, 2):
        data = warc.arc_version_block(version, "n") + warc.arc_response(version, "http://x/ y", 7, b"a\n\nb")
        ((fields, content),) = warc.read_arc(data)
        assert fields["URL"] == "http://x/%20y" and warc.split_http(content)[1] == b"a\n\nb"
        assert int(fields["Archive-length"]) == len(content) and ("Result-code" in fields) == (version == 2)
        with pytest.raises(ValueError):
            list(warc.read_arc(data[:-5]))


def test_empty_tables(spark, docs, model):
    none = docs.limit(0)
    assert bpe.encoded(none, vocabulary_path()).count() == 0
    assert media.stored(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extracted(pages, model).count() == 0
    assert html_text.trained(pages).weights


def test_broken_pages_are_pages():
    """Any text is a page, and takes time in proportion to its length."""
    rng = random.Random(6)
    parts = ["<![ foo", "<![foo[x]]>", "<![CDATA[y]]>", "<!--", "-->", "<!", "<?", "</", "<p", "<p>", "</p>", "<b>", "<div id=x>", "</div>"]
    parts += ["<script>", "</script>", "<title>", "<select><option>", "&#xD83D;", "&#99999999;", "<a href='", '">', ">", "<", "text", "\0", "é"]
    for _ in range(10_000):
        html_text.tree("".join(rng.choice(parts) for _ in range(rng.randint(1, 25))))
    article = "<article><p>One.</p><p>Two.</p></article>"
    texts = lambda page: [n.text for n in html_text.tree(page) if n.text]
    assert texts("<![ foo" + article + "<![foo[x]]><p>Three.") == ["One.", "Two.", "Three."] or texts(
        "<![foo[x]]>" + article
    ) == ["One.", "Two."]
    for part in ("<!--", "<b>", "</i>", "<b>x", "<![", "<p>", "<div>x", "</p>"):
        began = time.perf_counter()
        html_text.tree(part * (200_000 // len(part)))
        assert time.perf_counter() - began < 5, part
