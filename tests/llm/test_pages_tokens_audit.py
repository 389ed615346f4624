"""HTML extraction, token alignment and the filter audit against brute force, and on odd rows."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from conftest import SF_SMALL
from meterspark.llm import alignment, audit, htmltext, registry
from meterspark.llm.common import scratch
from oracle_check import digest, duck
from test_llm import SCHEMA, frame, prose

PAGES = "page_id bigint, url string, html string"
LABELS = "doc_id bigint, quality int, toxic int"


# --- token alignment

A_FILE, B_FILE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*(open(f, "rb").read() for f in (A_FILE, B_FILE)))


def ends(rng, n, top):
    return np.array(sorted(set(rng.integers(1, top, n).tolist()) | {top}), np.int64)


@pytest.mark.parametrize("seed", range(30))
def test_gallop_and_links(seed):
    rng = np.random.default_rng(seed)
    top = int(rng.integers(2, 4000))
    a, b = ends(rng, int(rng.integers(1, top)), top), ends(rng, int(rng.integers(1, max(2, top // 7))), top)
    for x, y in ((a, b), (b, a)):
        assert alignment.gallop(x, y).tolist() == np.searchsorted(y, x).tolist()
        own_a, own_b, a_cuts, b_cuts = alignment.align(x, y)
        begin = {i: [0, *e[:-1]][i] for e in (x,) for i in range(len(e))}, {i: [0, *e[:-1]][i] for e in (y,) for i in range(len(e))}
        want = {(i, j) for j in range(len(y)) for i in range(len(x)) if begin[0][i] < y[j] and begin[1][j] < x[i]} if len(x) * len(y) < 20000 else None
        got = list(zip(own_a.tolist(), own_b.tolist()))
        assert len(got) == len(set(got)) == len(x) + len(y) - len(a_cuts)
        assert want is None or set(got) == want
        shared = sorted(set(x.tolist()) & set(y.tolist()))
        assert x[a_cuts - 1].tolist() == shared and y[b_cuts - 1].tolist() == shared


def test_gallop_far_and_empty():
    long = np.arange(1, 1_000_001, dtype=np.int64)
    short = np.array([1, 5, 999_999, 1_000_000], np.int64)
    assert alignment.gallop(short, long).tolist() == [0, 4, 999_998, 999_999]
    assert [len(x) for x in alignment.align(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0, 0]


def test_long_texts_in_parts(pair, monkeypatch):
    texts = [prose(i, 400) + " a  b\n c 日本 語\n" + prose(i, 30) for i in range(4)]
    whole = pair.encode(texts)
    monkeypatch.setattr(alignment, "PART_CHARS", 97)
    for (a, b), (c, d), text in zip(whole, pair.encode(texts), texts):
        assert len(pair.parts(text)) > 5 and a == c and b == d


def test_quick_tokens(pair):
    """Where the quicker library is used, it gives the first one's tokens: every character it may see, in several places."""
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    for c in chars:
        text = f" a{c}b {c}c {c}{c} d{c}\n{c} 1{c}2 {c}'s"
        assert not alignment.RARE.search(text) and pair.quick.encode_ordinary(text) == pair.a.encode(text, add_special_tokens=False).ids
    assert alignment.plain_ranks({"model": {"type": "Unigram"}}) is None


def walked(texts):
    """Groups and links by walking the bytes of each text."""
    a_side = tokenizers.Tokenizer.from_file(A_FILE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = {v: k for k, v in alignment.byte_letters().items()}
    out = []
    for text in texts:
        want = (" " + text).encode()
        a, b = a_side.encode(" " + text, add_special_tokens=False), b_side.encode(text)
        a_names = a.tokens
        b_bytes = [bytes.fromhex(p[3:5]) if b_side.IsByte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(b_side.IdToPiece, b))]
        if not text or "".join(a_names) != "".join(letters[x] for x in want) or b"".join(b_bytes) != want:
            out.append(([], [], 0, "", []))
            continue
        of_a = [i for i, t in enumerate(a_names) for _ in t]
        of_b = [i for i, t in enumerate(b_bytes) for _ in t]
        links = sorted(set(zip(of_a, of_b)))
        groups, group = [], ([], [])
        for at, (i, j) in enumerate(zip(of_a, of_b)):
            last_a, last_b = at + 1 == len(of_a) or of_a[at + 1] != i, at + 1 == len(of_b) or of_b[at + 1] != j
            if last_a:
                group[0].append(a.ids[i])
            if last_b:
                group[1].append(b[j])
            if last_a and last_b:
                groups.append("|".join(",".join(map(str, side)) for side in group))
                group = ([], [])
        out.append((a.ids, b, len(groups), ";".join(groups), [(a.ids[i], b[j]) for i, j in links]))
    return out


@pytest.mark.parametrize("block_links, rows", [(60, 2), (1_000_000, 64)])
def test_alignment_brute(spark, monkeypatch, block_links, rows):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", block_links)
    monkeypatch.setattr(alignment, "ROWS", rows)
    texts = [prose(i, 30) for i in range(6)] + ["", None, " ", "▁odd", "<|endoftext|> <s> naïve œuvre 日本語 🙂\n\n  x", prose(3, 30), "a" * 3000, " " * 500 + "x"]
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(None, prose(2, 9), None), (3, prose(3, 30), "b")]).withColumn("block", F.lit(1)).withColumn("pair", F.lit("x"))
    all_rows = docs.select("doc_id", "text").collect()
    known = walked([r["text"] or "" for r in all_rows])
    counts = Counter(link for *_, links in known for link in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(a), len(b), n, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
                   hashlib.sha256(groups.encode()).hexdigest() if groups else "") for r, (a, b, n, groups, links) in zip(all_rows, known))
    got = alignment.align_tokens(docs, A_FILE, B_FILE, scratch(spark, "alignment-test")).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in got) == want


def test_alignment_empty(spark):
    assert alignment.align_tokens(spark.createDataFrame([], SCHEMA), A_FILE, B_FILE, scratch(spark, "alignment-test")).count() == 0


# --- filter audit

def test_audit_sql(spark):
    got = registry.QUERIES["op13_filter_audit"](spark, SF_SMALL).toPandas()
    want = duck(SF_SMALL).execute(audit.OP13_SQL).df()
    assert sorted(got.columns) == sorted(want.columns) and digest(got) == digest(want)


def test_lattice_paths():
    reach, leave = audit.lattice_paths(4)
    assert sum(reach[s] * leave[s] for s in range(16) if bin(s).count("1") == 2) == 24
    assert reach[15] == leave[0] == 24


def test_audit_brute(spark):
    """Every order applied to every row, one filter after the other; copies, null ids, null texts, repeated rows and labels."""
    good = prose(1, 130)
    rows = [(1, good, "en"), (2, good, "de"), (3, good + "#", "en"), (4, "x", None), (5, None, "en"), (6, "", "en"), (6, "", "en"), (7, "AAA BBB", "de"), (None, good, "en"),
            (8, " ".join(["a"] * 120), "en"), (9, good + "#", "en"), (1, good, "en"), (None, "", None), (10, "Z" * 500 + " $", "de")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], SCHEMA).withColumn("mask", F.lit(3)).withColumn("n", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (9, 0, 1), (9, 1, None), (None, 1, 1), (7, None, 1), (99, 1, 1)], LABELS)
    marks = {1: (1, 0), 3: (1, 1), 9: (1, 1), 7: (0, 1)}

    def failed(i, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = -1 if i is None else i
        first = min(-1 if j is None else j for j, t, _ in rows if (t or "") == text)
        return {c for c, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                                             bool(re.search("[#$%&*|]", text)), own > first)) if bad}
    told = [(lang or "", failed(i, t or ""), marks.get(i, (0, 0))) for i, t, lang in rows]
    want, removed_by = {}, Counter()
    for part in {p for p, *_ in told}:
        for order in itertools.permutations("ABCDE"):
            left = [(f, m) for p, f, m in told if p == part]
            for step, x in enumerate(order, 1):
                out = [(f, m) for f, m in left if x in f]
                left = [(f, m) for f, m in left if x not in f]
                own = [f for p, f, _ in told if p == part]
                removed_by[part, x] += len(out)
                want[part, "".join(order), step] = (len(left), len(out), sum(x in f for f in own) - len(out), sum(f == {x} for f in own), sum(m[0] for _, m in out), sum(m[1] for _, m in out))
    got = audit.filter_audit(docs, labels, audit.length_share_case_symbol(), "ABCDE").collect()
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert tuple(r[m] for m in audit.MEASURES) == want[r["part"], r["filter_order"], r["step"]]
        assert r["shapley"] == removed_by[r["part"], r["filter_order"][r["step"] - 1]]


def test_audit_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert audit.filter_audit(none, spark.createDataFrame([], LABELS), audit.length_share_case_symbol(), "ABCDE").count() == 0


# --- html extraction

ARTICLE = ["A heading", "First paragraph of the article, long enough, with a link in it.", "Second one after a break & more <tags>.", "one", "two", "c1", "c2"]
INNER = """<h1>A  heading</h1><p>First paragraph of the article, long enough, with a <a href="/x">link</a> in it.<p>Second one<br>after a
 break &amp; more &lt;tags&gt;.</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>"""
JUNK = {"nav": '<nav><a href="/">Home page of this site</a></nav>', "aside": "<aside>Aside text that is fairly long, yes it is.</aside>", "form": "<form>Your name <input name=a></form>",
        "script": '<script>if (a < b) { w("</p>"); }</script>', "style": "<style>p{}</style>", "ad": '<div class="ad-box">Buy this now, it is very cheap!</div>',
        "comments": '<section id="comments"><article class="comment">I disagree with all of this, at length.</article></section>', "share": '<ul class="share"><li>Share</ul>',
        "notice": '<div class="cookie-notice">We use cookies. Do you mind?</div>', "hidden": '<p hidden>not to be seen</p>', "role": '<div role="navigation">Menu</div>', "comment": "<!-- <p>no</p> -->"}


def page(before, body, after):
    return f'<!DOCTYPE html><html><head><title>T</title></head><body><header>Site name</header>{before}{body}{after}<footer>&copy; us</footer></body></html>'


@pytest.mark.parametrize("wrap", ["<article>{}</article>", '<main><div class="post post-77">{}</div></main>', '<div id="wrap"><div class="entry-content">{}</div></div>', "<article><div>{}</div></article>"])
@pytest.mark.parametrize("junk", sorted(JUNK))
def test_extract_without_junk(wrap, junk):
    want = "\n".join(ARTICLE)
    assert htmltext.extract(page(JUNK[junk], wrap.format(INNER), JUNK[junk]), []) == want
    assert htmltext.extract(page("", wrap.format(JUNK[junk] + INNER + JUNK[junk]), ""), []) == want


@pytest.mark.parametrize("html, want", [(None, ""), ("", ""), ("plain a < b", "plain a < b"), ("<p>cut &am", "cut &am"), ("<p>x<p", "x"), ("<script>never closed <p>x", ""), ("</div></p>x", "x"),
                                        ("<p>a&nbsp; b</p>\n<p> </p>", "a b"), ("<b>x<i>y</b>z", "xyz"), ("<!-- open <p>x", "")])
def test_extract_odd(html, want):
    assert htmltext.extract(html or "", []) == want


def test_extract_large():
    for html in ("<div>" * 20000 + "x", "<p " * 50000, '"<p a="' * 20000, "<b>" * 3000 + "</q>" * 20000, "<li>" * 20000, "<!--" * 50000):
        htmltext.extract(html, ["html>body"])


def test_consensus(spark):
    """A page with little text and a long unnamed box follows its host; a host alone and pages without one follow themselves."""
    box = "<div class='q1'><p>" + prose(5, 60) + "</p></div>"
    rows = [(i, f"https://A.example.com/{i}", page("", f'<div class="c{i}"><p>{prose(i, 50)}</p></div>', box if i == 3 else "")) for i in range(8)]
    rows += [(20, "https://a.example.com:8080/x", page("", '<div class="c20"><p>Short.</p></div>', box)), (20, "https://a.example.com:8080/x", page("", '<div class="c20"><p>Short.</p></div>', box)),
             (21, "http://b.example.com/", page("", '<div class="c20"><p>Short.</p></div>', box)), (22, None, "<p>no url</p>"), (23, "/relative", None), (None, "https://a.example.com/", "")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("x")).withColumn("paths", F.lit(1))
    got = htmltext.extract_text(pages, scratch(spark, "paths-test")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(texts[i] == prose(i, 50) for i in range(8))
    assert texts[20] == "Short." and texts[21] == prose(5, 60) and texts[22] == "no url" and texts[23] == texts[None] == ""


def test_consensus_empty(spark):
    assert htmltext.extract_text(spark.createDataFrame([], PAGES), scratch(spark, "paths-test")).count() == 0


def test_pages_brute(spark):
    """The given pages have one template: every text between the article's tags, block by block."""
    import html as entities
    for r in registry.QUERIES["op11_html_extraction"](spark, SF_SMALL).join(spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.sub("</article?$|</artic?$", "", r["html"].split("<article>", 1)[1].split("</article>")[0])
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>?", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)
