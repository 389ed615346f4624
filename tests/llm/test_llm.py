"""Text operators against brute-force versions, and on odd rows."""

import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from meterspark.llm import chat, decontam, linededup, mixing, pii, pii_table, quality, registry, simhash, tokens, toxicity, urlfilter
from meterspark.llm.common import scratch
from oracle_check import digest, duck

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and that this with from have over under river stone cloud green seven lamp chair paper glass winter summer north".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n)) + "."


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long and repeated texts, a null id, and a column whose name clashes."""
    long = prose(9, 6000) + "\n" + "x" * 30000
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n ", "b"), (4, long, "a"), (5, prose(1, 40), "a"), (5, prose(1, 40), "a"), (None, prose(2, 40), None), (6, "Short.", "b")]
    return frame(spark, rows).withColumn("pos", F.lit(7)).withColumn("key", F.lit("x")).withColumn("version", F.lit(1)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, name):
    got = registry.QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck(SF_SMALL).execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and digest(got) == digest(want)


# --- near duplicates

def fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= bits:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_query(spark):
    got = registry.QUERIES["op10_simhash"](spark, SF_SMALL).toPandas().sort_values("doc_id")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    prints = [fingerprint(d["text"], 4) for d in docs]
    assert [int(x, 16) for x in got["fingerprint"]] == prints
    assert got["component_id"].tolist() == [docs[i]["doc_id"] for i in groups(prints, 4)]


def test_byte_sets_leave_no_pair_out():
    for bits in (1, 2, 3, 4, 5, 6, 7):
        sets = simhash.byte_sets(bits)
        assert all(any(set(s) <= set(c) for s in sets) for c in itertools.combinations(range(8), 8 - bits))
    assert len(simhash.byte_sets(4)) == 20
    with pytest.raises(ValueError):
        simhash.byte_sets(8)


@pytest.mark.parametrize("list_rows", [3, 1000])
def test_links_in_dense_lists(spark, list_rows):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(prints)[:3]:
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(60)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), 4, list_rows)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    mine = pd.Series([found.get(p, p) for p in signed])
    assert mine.groupby(groups(prints, 4)).nunique().max() == 1
    assert mine.nunique() == len(set(groups(prints, 4)))


def test_simhash_odd(spark, odd, empty):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == 8 and (got[got["doc_id"].isin([1, 2, 3])]["component_id"] == 1).all()
    assert sorted(simhash.representatives(odd).toPandas()["doc_id"].dropna()) == [1, 4, 5, 6]
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_keeps_one_row_of_each_component(spark):
    a, b, c, d = (prose(70 + i, 30) for i in range(4))
    rows = frame(spark, [(5, a, "s"), (5, b, "s"), (7, a, "s"), (None, c, "s"), (None, c, "t"), (None, d, "s"), (9, b, None)])
    left = simhash.representatives(rows)
    assert left.columns == rows.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(5, a), (5, b), (0, c), (0, d)])


# --- decontamination

def brute_coverage(doc, item, seed=5):
    """Greedy tiling by trying every pair of places."""
    a, b = re.findall("[a-z0-9]+", doc.lower()), re.findall("[a-z0-9]+", item.lower())
    ma, mb, covered = [0] * len(a), [0] * len(b), 0
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n >= seed and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return covered / len(b)
        i, j, n = best
        covered += n
        ma[i:i + n] = mb[j:j + n] = [1] * n


def test_decontamination(spark, odd, empty):
    item = prose(50, 30)
    w = item.split()
    swapped = " ".join(w[18:] + ["between"] + w[:18])
    docs = {1: prose(60, 80) + " " + item + " " + prose(61, 50), 2: prose(62, 40) + " " + swapped, 3: prose(63, 90), 4: prose(64, 30) + " " + " ".join(w[:9]),
            5: ",\n".join(w).upper(), 6: (item + " ") * 3, 7: " ".join(w[i] if i % 7 else "other" for i in range(30))}
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, ""), (None, prose(70, 20))], "item_id bigint, text string")
    rows = frame(spark, [(i, t, "a") for i, t in docs.items()])
    got = {r["doc_id"]: r["coverage"] for r in decontam.leaks(rows, bench, coverage=0.01).collect()}
    want = {i: brute_coverage(t, item) for i, t in docs.items()}
    assert got == pytest.approx({i: c for i, c in want.items() if c})
    assert sorted(r["doc_id"] for r in decontam.decontaminate(rows, bench).collect()) == [i for i, c in want.items() if c < 0.5]
    assert sorted(r["doc_id"] for r in decontam.leaks(rows, bench, bits=10).collect()) == [i for i, c in want.items() if c >= 0.5]
    assert decontam.decontaminate(odd, bench).count() == 8
    assert decontam.leaks(empty, bench).count() == 0 and decontam.leaks(rows, bench.limit(0)).count() == 0


def test_tiles_of_texts_of_few_words(spark):
    rng, docs, items, want = random.Random(5), [], [], {}
    for i in range(60):
        words = "abcd"[:1 + i % 4]
        docs.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 40))), "a"))
    for j in range(12):
        items.append((j, " ".join(rng.choice("abcd"[:1 + j % 4]) for _ in range(rng.randrange(5, 25)))))
    for i, text, _ in docs:
        for j, item in items:
            c = brute_coverage(text, item)
            want |= {(i, j): c} if c else {}
    got = decontam.leaks(frame(spark, docs + docs[:9]), spark.createDataFrame(items, "item_id bigint, text string"), coverage=0.01)
    assert {(r["doc_id"], r["item_id"]): r["coverage"] for r in got.collect()} == pytest.approx(want) and got.count() == len(want)


def test_long_texts_of_one_word(spark):
    bench = spark.createDataFrame([(1, "word " * 100), (2, "word " * 3000), (2, prose(4, 30))], "item_id bigint, text string")
    rows = frame(spark, [(1, "word " * 1_000_000, "a"), (2, "word " * 99, "a")])
    got = {(r["doc_id"], r["item_id"], r["n_tokens"]): (r["n_tiles"], r["covered"]) for r in decontam.leaks(rows, bench).collect()}
    assert got == {(1, 1, 100): (1, 100), (1, 2, 3000): (1, 3000), (2, 1, 100): (1, 99)}


def test_decontamination_beyond_ascii(spark):
    plain = 'He said - "stop the old car" - and, then, the "green door" fell - so they "ran" off.'
    set_well = plain.replace(' "', " “").replace('"', "”").replace(" - ", "—").replace(" old ", "\u00a0old ").replace("fell", "fe\u00adll")
    items = [(1, plain), (2, "机器学习模型需要大量数据，才能正确回答问题。"), (3, "東京は日本の首都であり、世界最大の都市です。"), (4, "Größe und Maß, Ärger über Öl.")]
    docs = {1: f"{prose(1, 30)} {set_well} {prose(2, 30)}", 2: "今天天气很好。机器学习模型需要大量数据,才能正确回答问题!谢谢", 3: "「東京は日本の首都であり 世界最大の都市です」と言った", 4: "„GRÖSSE“ – «größe und maß»… ärger\u202füber öl", 5: prose(3, 90)}
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontam.leaks(frame(spark, [(i, t, "a") for i, t in docs.items()]), bench).collect()}
    assert got == {(i, i): 1.0 for i in range(1, 5)}
    assert len(decontam.token_hashes("机" * decontam.PART + "ab " * 9)) == decontam.PART + 9


def test_decontamination_query(spark):
    got = {(r["doc_id"], r["item_id"]) for r in registry.QUERIES["op2_decontamination"](spark, SF_SMALL).collect()}
    con = duck(SF_SMALL)
    want = set(con.execute("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)").fetchall())
    assert want <= got


def test_long_token_and_parts():
    text = "a " * decontam.PART + "b" * (2 * decontam.PART)
    assert len(decontam.token_hashes(text)) >= decontam.PART + 1
    left, right = prose(1, 50), prose(2, 50)
    both = decontam.token_hashes(left + " " + right)
    assert (both == np.concatenate([decontam.token_hashes(left), decontam.token_hashes(right)])).all()


# --- lines, quality, mixing

def test_line_dedup_odd(spark, odd, empty):
    line = "A line that many documents share."
    rows = [(1, f"{line}\none", "a"), (2, f"  {line.upper()}\t\ntwo\n{line}", "a"), (3, f"three\n{line}\n{line}", "a"), (4, "Alone here, in this document only.", "a"), (4, "Alone here, in this document only.", "a"), (None, line, "a")]
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, ""), (1, "one"), (2, "two"), (3, f"three\n{line}\n{line}"), (4, rows[3][1]), (4, rows[3][1])]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert linededup.dedup_lines(odd).count() == 8 and linededup.dedup_lines(odd).columns == odd.columns
    assert linededup.dedup_lines(empty).count() == 0


def brute_line_fails(line):
    n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
    punctuation = n >= 3 and (4 * len(re.findall("[#*$%&|<>]+", line)) > n or 2 * len(re.findall("[!?]{2,}", line)) > n)
    bars = len(re.findall("[|›]", line)) + (0 if "«" in line else line.count("»"))
    two = "privacy policy|accept cookies|enable javascript|lorem ipsum|click here|read more|subscribe to"
    three = "all rights reserved|terms of use|terms of service|use of cookies|back to top"
    told = sum(k * len(re.findall(rf"(?<![^\W_])(?:{p})(?![^\W_])", line.lower())) for k, p in ((2, two), (3, three)))
    return punctuation or (bars >= 2 and n <= 4 * (bars + 1)) or (told >= 1 and 10 * told >= 3 * n)


LANGUAGES = ["Il a dit « viens avec moi » puis elle a répondu « pas avant la fin de la semaine » et ils sont partis ensemble vers la gare du nord.",
             "Er sagte »komm doch mit uns nach Hause« und sie antwortete »erst wenn der Zug am Abend wieder in die Stadt fährt« und dann gingen beide.",
             "The shell runs a | b or b | c in the same way, and whoever reads the manual with some care will find both forms explained there at length.",
             "El autor escribe «vuelve pronto a casa» y después «no sin ver el mar otra vez» porque la carta quedó abierta sobre la mesa del salón."]


def test_quotations_and_bars_in_sentences_are_kept(spark):
    """Lines, also whole documents of one line, with quotation marks or a few bars among their words; menus of short entries go."""
    rows = [(i, line + " " + prose(i, 40), "a") for i, line in enumerate(LANGUAGES)]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, rows)).collect()}
    assert all(got[i]["kept"] and got[i]["lost_share"] == 0 for i in got) and len(got) == 4
    menus = ["Home | News | About us", "Start » Themen » Wetter", "Inicio › Noticias › El tiempo", "Accueil | Sports et loisirs | Nous écrire | Plan du site", "a | b | c d e"]
    fails = [r["f"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(menus + LANGUAGES)], "i int, t string").select("i", quality.line_fails(F.col("t")).alias("f")).orderBy("i").collect()]
    assert fails == [True] * 5 + [False] * 4
    assert fails == [brute_line_fails(t) for t in menus + LANGUAGES]
    docs = [(i, "\n".join([prose(i, 90), *menus]), "a") for i in range(2)]
    assert {r["text"] for r in quality.clean(frame(spark, docs)).collect()} == {prose(0, 90), prose(1, 90)}


def test_quality_sql_states_the_rules(spark):
    """The SQL against the operator on lines that each rule decides, near its limits."""
    lines = LANGUAGES + ["Read more read more", "READ MORE, click here!", "spread more", "x " * 5 + "read more", "x " * 4 + "read more", "a | b", "a | b | " + "c " * 10, "a | b | " + "c " * 11,
                         "» a » b", "« a » b »", "wow!! really?? yes", "## a b c", "# a b c d", "Ⅸ read more Ⅸ", "back to top back to top x y z", "_read more_", "read  more", ""]
    rows = [(i, line + "\n" + prose(i, len(line.split()) or 1), "a") for i, line in enumerate(lines)] + [(100 + i, "\n".join([line] * 3 + [prose(i, 25)]), "a") for i, line in enumerate(lines)]
    docs = frame(spark, rows)
    got = quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert digest(got) == digest(con.execute(quality.OP4_SQL).df())
    lost = {r["doc_id"]: r["lost_share"] > 0 for r in quality.quality(docs).collect()}
    assert [lost[i] for i in range(len(lines))] == [brute_line_fails(t) and bool(t.split()) for t in lines]


def test_quality_removes_failing_lines(spark):
    good, bad = [prose(i, 25) for i in range(3)], ["home | news | about", "Click here for more", "## a ** b ## c"]
    mixed = "\n".join([bad[0], good[0], "", bad[1], good[1], bad[2], good[2]])
    got = {r["doc_id"]: r for r in quality.clean(frame(spark, [(1, mixed, "a"), (2, "\n".join(good), "a"), (3, "\n".join(bad * 9), "a")]).withColumn("kept", F.lit(5))).collect()}
    assert got[1]["text"] == "\n".join([good[0], "", good[1], good[2]]) and got[1]["n_chars"] == len(got[1]["text"]) and got[1]["kept"] == 5
    assert got[2]["text"] == "\n".join(good) and set(got) == {1, 2}


def test_boilerplate_is_whole_words_and_a_large_part_of_its_line(spark):
    head, tail = prose(5, 60)[:-1], prose(6, 60)
    fine = [f"{head} spread more {tail}", f"{head} because of cookies {tail}", f"{head} and then I read more {tail}", "Because of cookies she spread more and flick here was instead more."]
    bad = ["ALL RIGHTS RESERVED", "READ MORE", "CLICK HERE", "(c) 2020 Acme. All rights reserved.", "Read more | Back to top", "»Click here«"]
    got = [r["fails"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(fine + bad)], "i int, t string").select("i", quality.line_fails(F.col("t")).alias("fails")).orderBy("i").collect()]
    assert got == [False] * len(fine) + [True] * len(bad)
    found = {r["doc_id"]: r for r in quality.quality(frame(spark, [(i, t, "a") for i, t in enumerate(fine[:3])])).collect()}
    assert all(found[i]["kept"] and found[i]["lost_share"] == 0 for i in range(3))
    assert [r["text"] for r in quality.clean(frame(spark, [(1, "\n".join([fine[0], *bad]), "a")])).collect()] == [fine[0]]


def test_quality_odd(spark, odd, empty):
    got = quality.quality(odd).toPandas()
    assert len(got) == 8 and got[got["doc_id"] == 1]["n_words"].item() == 0 and not got[got["doc_id"] == 1]["kept"].item()
    assert got[got["doc_id"] == 5]["kept"].all() and got[got["doc_id"] == 4]["n_words"].item() == 6001
    assert quality.clean(odd).columns == odd.columns and quality.clean(empty).count() == 0
    nav = "\n".join(["home | news | about | contact | more"] * 3 + [prose(3, 20)])
    many = " ".join(f"w{i}" for i in range(200)) + " " + " ".join(f"w{i}" for i in range(200))       # more repeated windows than are looked up one by one
    found = {r["doc_id"]: r for r in quality.quality(frame(spark, [(1, nav, "a"), (2, many, "a")])).collect()}
    assert not found[1]["kept"] and found[2]["n_repeat_words"] == 400


def test_mixing(spark, odd, empty):
    rows = [(i, prose(i, 30), "big") for i in range(400)] + [(1000 + i, prose(i, 30), f"s{i % 4}") for i in range(80)]
    docs = frame(spark, rows)
    got = mixing.mix(docs, max_repeats=1.5).toPandas()
    n = got.groupby("source").size()
    assert n["big"] < 400 and all(28 <= n[f"s{i}"] <= 32 for i in range(4)) and got["position"].between(0, 1, inclusive="left").all()
    sources = mixing.cells(docs).groupBy("_source").agg(F.sum("tokens").alias("n"))
    shares = sources.withColumn("p", F.col("n") / 14400.0)
    p = np.array([r["p"] for r in shares.collect()])
    a = mixing.exponent(shares, 1.0, entropy=1.4)
    w = p**a / (p**a).sum()
    assert -(w * np.log(w)).sum() == pytest.approx(1.4, abs=1e-6)
    with pytest.raises(ValueError):
        mixing.exponent(shares, 3.0, max_repeats=2.0)
    assert mixing.mix(empty).count() == 0 and set(mixing.mix(odd).columns) == {*odd.columns, "copy", "position"}


# --- lists, tokens, chats

def test_url_filters(spark):
    entries = spark.createDataFrame([("bad.com", "spam", "add", "2024-02-01"), ("bad.com", "spam", "remove", "2024-03-01"), ("bad.com", "spam", "add", "2024-05-01"), ("x.bad.com/y", "adult", "add", "2024-02-15"),
                                     ("one.org", "spam", "add", "2024-01-01"), ("one.org", "spam", "remove", "2024-01-01"), (None, "spam", "add", "2024-01-01"), ("ok.net", "spam", "add", None)], "pattern string, category string, action string, dated string").withColumn("dated", F.to_date("dated"))
    cases = [("http://X.bad.com/y/z", "2024-01-31", None), ("http://x.bad.com/y/z", "2024-02-01", "bad.com"), ("http://x.bad.com/y/z", "2024-02-20", "x.bad.com/y"), ("http://bad.com", "2024-03-01", None), ("https://u@bad.com:80/?q", "2024-05-02", "bad.com"),
             ("http://notbad.com/", "2024-05-02", None), ("http://one.org/", "2024-06-01", None), (None, "2024-06-01", None), ("junk", "2024-06-01", None), ("http://bad.com", None, None), ("http://ok.net/", "2024-06-01", None)]
    rows = spark.createDataFrame([(i, u, d, "p") for i, (u, d, _) in enumerate(cases + cases[1:2])], "page_id int, url string, fetched string, pattern string").withColumn("fetched", F.to_date("fetched"))
    got = {r["page_id"]: r for r in urlfilter.filter_urls(rows, entries).collect()}
    assert [got[i]["pattern"] for i in range(len(cases) + 1)] == [c[2] for c in cases] + ["bad.com"] and all(r["blocked"] == (r["n_active"] > 0) for r in got.values())
    assert urlfilter.filter_urls(rows.limit(0), entries).count() == 0 and not urlfilter.filter_urls(rows, entries.limit(0)).filter("blocked").count()


def test_hosts_of_urls(spark):
    cases = {"http://[2001:DB8::1]:80/a": ("[2001:db8::1]", ["[2001:db8::1]", "[2001:db8::1]/a"]), "http://10.0.0.1/": ("10.0.0.1", ["10.0.0.1"]), "//cdn.Example.COM./x?y": ("cdn.example.com", ["cdn.example.com", "example.com", "cdn.example.com/x"]),
             "http://a@b:c@www.site.org": ("www.site.org", ["www.site.org", "site.org"]), "http://[::ffff:1.2.3.4]": ("[::ffff:1.2.3.4]", ["[::ffff:1.2.3.4]"]), "/a//b.com": ("", [""]), "http://a:b@/x": ("", None), "http://[broken/x": ("", None), "http://:80/": ("", [""]), "localhost": ("", [""])}
    rows = spark.createDataFrame([(u,) for u in cases], "url string")
    got = {r["url"]: (r["host"], r["p"]) for r in rows.select("url", urlfilter.host(F.col("url")).alias("host"), urlfilter.patterns(urlfilter.host(F.col("url")), urlfilter.first_part(F.col("url"))).alias("p")).collect()}
    assert {u: h for u, (h, _) in got.items()} == {u: h for u, (h, _) in cases.items()}
    assert all(sorted(got[u][1]) == sorted(p) for u, (_, p) in cases.items() if p is not None)
    con = duckdb.connect()
    con.register("pages", pd.DataFrame({"page_id": range(len(cases)), "url": list(cases)}))
    assert dict(con.execute(urlfilter.OP5_SQL.replace("SELECT p.page_id, p.host", "SELECT p.page_id AS page_id, p.host")).df()[["page_id", "host"]].values.tolist()) == {i: h for i, (h, _) in enumerate(cases.values())}


def test_token_counts(spark, odd, empty):
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    cache = scratch(spark, "cache")
    got = tokens.count_tokens(odd, cache, path).toPandas()
    want = [len(sp.encode(r["text"] or "")) for r in odd.collect()]
    assert sorted(got["n_tokens"]) == sorted(want) and got[got["n_tokens"] == 0].shape[0] == 2
    rows = spark.read.schema(tokens.CACHE_SCHEMA).parquet(cache).count()
    assert rows == len({r["text"] or "" for r in odd.collect()})
    assert tokens.count_tokens(odd, cache, path).count() == 8 and spark.read.schema(tokens.CACHE_SCHEMA).parquet(cache).count() == rows
    assert tokens.count_tokens(empty, cache, path).count() == 0
    counter = tokens.PieceCounter(open(path, "rb").read())
    for text in [prose(1, 300), "a  b   c " * 40, " lead and trail ", "no spaces" * 50, "▁ ▁▁ x y " * 30, "é ü\tß\n\n z " * 30, "😀 " * 60]:
        assert counter.count(text, 25) == len(sp.encode(text))


def cheapest(turns):
    """All ways to give the turns roles, merges and empty turns, by the rules alone."""
    best, legal, end = {chat.START: 0}, chat.LEGAL, chat.END

    def spread(costs):
        for _ in range(3):
            for s, c in list(costs.items()):
                for r in legal[s]:
                    if r and c + chat.INSERT < costs.get(r, 10**9):
                        costs[r] = c + chat.INSERT
        return costs
    for role, blank in turns:
        now = {}
        for s, c in spread(dict(best)).items():
            for q in legal[s]:
                now[q] = min(now.get(q, 10**9), c + (0 if q == role else 2 if role is None else 3))
        for s, c in best.items():
            if s != chat.START:
                now[s] = min(now.get(s, 10**9), c + (1 if blank else 2) + (0 if s == role else 2 if role is None else 3))
        best = now
    return spread(best)[end]


def test_chat_formatting(spark):
    rng = random.Random(3)
    names = ["system", "user", "assistant", " USER ", "tool", None]
    rows, want = [], {}
    for conv in range(150):
        n = rng.randrange(1, 9) if conv else 700           # the first one has several parts
        turns = [(conv, t, rng.choice(names), rng.choice(["hello", "", None, "yes\nno"])) for t in range(n)]
        rows += turns + turns[:1]
        want[conv] = cheapest([chat._kind({"role": t[2], "text": t[3]}) for t in turns])
    rows += [(None, 0, "user", "alone"), (None, None, "assistant", None)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("conv_id", "orphan", "part").toPandas()
    assert got.groupby("conv_id")["cost"].first().to_dict() == want and len(got[got["conv_id"] == 0]) == 3
    assert got["conv_id"].isna().sum() == 2
    for _, parts in got.groupby(["conv_id", "orphan"], dropna=False):
        text = "".join(parts["rendered"])
        roles = re.findall(r"<\|(system|user|assistant)\|>", text)
        assert re.fullmatch("(system,)?(user,assistant,)+", ",".join(roles) + ",") and text.count("<|end|>") == len(roles) and text.endswith("<|end|>\n")
        assert parts["cost"].nunique() == 1
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_turns_without_numbers_go_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_PARTS", 7)                        # several blocks
    rng = random.Random(8)
    roles = ["user", "assistant", "system", None]
    kinds = {(c, n): [(c, n, rng.choice(roles), f"text {i}") for i in range(k)] for c, n, k in ((1, None, 20000), (2, 5, 6000), (3, None, 3))}
    rows = [t for turns in kinds.values() for t in turns]
    turns = spark.createDataFrame(rows + rows[:50], "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("code", F.lit(None)).withColumn("task", F.lit(0))
    got = chat.format_chats(turns).orderBy("conv_id", "part").toPandas()
    for (conv, _), own in kinds.items():
        own = sorted(own, key=lambda t: (t[2] is not None, t[2] or "", t[3]))
        mine = got[got["conv_id"] == conv]
        assert list(mine["part"]) == list(range(-(-len(own) // 256))) and (mine["n_turns"][:-1] == 256).all() and mine["n_turns"].sum() == len(own)
        assert set(mine["cost"]) == {cheapest([chat._kind({"role": t[2], "text": t[3]}) for t in own])}
        assert re.findall(r"text \d+", "".join(mine["rendered"])) == [t[3] for t in own]


# --- toxicity and personal data

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton():
    terms = ["moron", "stupid", "worthless", "scum", "disgusting"]
    lexicon = toxicity.Lexicon([(t, False, 1.0 + i) for i, t in enumerate(terms)] + [("stemm", True, 9.0)])
    rng = random.Random(2)
    for _ in range(4000):
        word = list(rng.choice(terms + ["moon", "stemma"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at:at + rng.randrange(2)] = rng.choice(["", "a", "x", "0"])
        word = "".join(word)
        near = [t for t in terms if distance(word, t) <= (len(t) >= 5) + (len(t) >= 9)]
        found = lexicon.find(word)
        assert (found is not None) == bool(near or word.startswith("stemm"))
        assert not found or found[1] == (word in terms or word.startswith("stemm"))


def test_quotation_weighs_less():
    lexicon = toxicity.Lexicon([("moron", False, 3.0)])
    filler = prose(1, 12)
    assert lexicon.features(f"{filler} you moron {filler}")[3] > lexicon.features(f"{filler} they said \"moron\" there {filler}")[3] > 0
    assert lexicon.features("") == [0.0] * toxicity.FEATURES


def test_toxicity_query_held_out(spark):
    sf = SF_SMALL.replace("sf0.001", "sf0.01")
    got = registry.QUERIES["op1_toxicity"](spark, sf).toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all() and got["score"].between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got[got["held_out"]], on="doc_id")
    assert (labels["toxic"] == labels["predicted"]).mean() >= 0.95


def test_words_under_a_stem_keep_their_edits(spark):
    words = [f"zorvak{x}" for x in ("ling", "menta", "rosti", "dulin", "pesco")]
    rows = [(1, f"{prose(i, 20)} {words[i % 5]}") for i in range(40)] + [(0, prose(100 + i, 20)) for i in range(400)]
    rows += [(1, f"mixolana mixolbeta mixolgama mixoldelta {prose(900 + i, 20)}") for i in range(3)]
    learned = toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string"))
    assert {t for t, is_stem, _ in learned if not is_stem} >= set(words) and {t for t, is_stem, _ in learned if is_stem} == {"zor"}
    lexicon = toxicity.Lexicon(learned)
    assert all(lexicon.find(w) for w in ("zrvakling", "zzorvakmenta", "zarvakrosti", "xorvakdulin")) and lexicon.find("zorunseen")


def test_long_words_are_looked_up(spark):
    lexicon = toxicity.Lexicon([("zorvak", True, 2.0), ("zorvakling", False, 5.0)])
    assert lexicon.features("a zorvak" + "x" * 70)[0] == 1.0 and lexicon.features("a zorvak_" + "_".join(["word"] * 30))[0] == 1.0
    assert lexicon.find("zorvakxxling") == (2.0, True) and lexicon.find("zorvakling") == (5.0, True) and lexicon.find("y" * 10**5) is None
    rows = [(1, f"zorvak{x * 40} {prose(i, 20)}") for i, x in enumerate("abcdefgh")] + [(0, prose(100 + i, 20)) for i in range(400)]
    assert ("zor", True) in {t[:2] for t in toxicity.learn_lexicon(spark.createDataFrame(rows, "toxic int, text string"))}


def test_lexicon_is_learned_from_all_labelled_rows(spark, monkeypatch):
    word = lambda i: "".join(chr(97 + int(c)) * 2 for c in f"{i:03d}")
    rows = [(i, f"{word(i % 10)} {prose(i, 20)}" if i % 10 < 3 else prose(i, 20), "a") for i in range(1200)]
    docs = frame(spark, rows + rows[:50])
    labels = spark.createDataFrame([(i, int(i % 10 < 3)) for i in range(1200)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "MIN_LIFT", 2.0)                  # a third of the rows is toxic here
    few, _ = toxicity.train(docs, labels, train_rows=20)
    every, weights = toxicity.train(docs, labels)
    assert few == every and {t for t, is_stem, _ in every if not is_stem} >= {word(0), word(1), word(2)}
    nested = [(1, f"zorvakling{x} {prose(i, 5)}") for i, x in enumerate("abcdef" * 4)] + [(0, prose(100 + i, 20)) for i in range(400)]
    monkeypatch.setattr(toxicity, "MAX_TERMS", 7)
    learned = toxicity.learn_lexicon(spark.createDataFrame(nested, "toxic int, text string"))
    assert {t for t, _, _ in learned} == {"zor", *(f"zorvakling{x}" for x in "abcdef")}


def test_toxicity_odd(spark, odd, empty):
    model = toxicity.train(odd, spark.createDataFrame([(5, 1), (None, 1), (6, None)], "doc_id bigint, toxic int"))
    assert model[0] == [] and toxicity.score_toxicity(odd, model).filter("predicted = 0").count() == 8
    assert toxicity.score_toxicity(empty, model).count() == 0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if (True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else 0, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(1)
    parts = ["1", "12", "4", "0", " ", ".", "@", "a", "b.c", "-", "_", "+", "(", ")", "\n", "255", "4929348385146306", "é", "300"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == plain_spans(text)


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    model = pii.Model({f"f{i}": i for i in range(6)}, rng.normal(size=(6, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)))
    rows = [[[f"f{rng.integers(6)}" for _ in range(2)] for _ in range(n)] for n in (1, 2, 3, 4)]

    def score(row, labels):
        path = [0, *labels, 0]
        return sum(model.weights[[model.ids[f] for f in names], k].sum() for names, k in zip(row, labels)) + sum(model.moves[a, b] for a, b in zip(path, path[1:]))
    for row, found in zip(rows, model.viterbi(rows)):
        assert score(row, found) == pytest.approx(max(score(row, x) for x in itertools.product(range(pii.LABELS), repeat=len(row))))


def test_pii_query(spark):
    got = registry.QUERIES["op9_pii"](spark, SF_SMALL).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    for row in got.itertuples():
        base = plain_spans(texts[row.doc_id])
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        assert set(pii.written(base).split(",")) <= set(row.spans.split(",")) or not base


def test_crf_on_a_held_out_table():
    """Spans that the patterns miss, of written rows that the field was not fitted on."""
    model, hit, extra, lost = pii.train(), 0, 0, 0
    for text, spans in pii_table.labelled_table(1000, seed=99):
        base, found = plain_spans(text), pii.runs(text)
        got = set(pii.added_spans(text, found, model.viterbi([pii.run_features(t, len(c), n) for t, c, n in found]), base))
        want = {s for s in spans if not any(a < s[2] and s[0] < b for a, _, b in base)}
        hit, extra, lost = hit + len(got & want), extra + len(got - want), lost + len(want - got)
    assert hit > 500 and hit / (hit + extra) > 0.97 and hit / (hit + lost) > 0.97


def test_crf_finds_the_secrets_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find_pii(docs, pii.train()).collect()}
    for r in docs.collect():
        for m in re.finditer('(?i)token = "([0-9a-f]{40})"', r["text"] or ""):
            assert f"secret:{m.start(1)}:{m.end(1)}" in got[r["doc_id"]]


def test_crf_adds_what_patterns_miss(spark, odd, empty):
    model = pii.train()
    joined = "pay 7536784127813050 4845168114407329 now"                  # the pattern takes both as one number and drops it
    assert not pii.base_spans(joined) and pii.luhn("7536784127813050")
    got = pii.find_pii(frame(spark, [(1, joined, "a")]), model).first()["spans"]
    assert "card:4:20" in got
    hexes = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    cases = {f'set token = "{hexes}" now': f"secret:13:{13 + len(hexes)}", f"in commit {hexes} fixed": "", f"TOKEN = \"{hexes.upper()}\"!!": f"secret:9:{9 + len(hexes)}", "Licensed under CC BY-NC 4.0.": "", "mail jürgen@müller.de please": "email:5:21",
             "host 2001:db8::7 is up": "ip:5:16", "card 4929/3483/8514/6306 here": "card:5:24", "card 4929/3483/8514/6307 here": "", "call (030) 555-7713 now": "phone:5:19", "on 2020-01-02 at 12:30": "", "x " * 50000 + "y9": ""}
    rows = pii.find_pii(frame(spark, [(i, t, "a") for i, t in enumerate(cases)]), model).orderBy("doc_id").collect()
    assert [r["spans"] for r in rows] == list(cases.values()) and all(r["n_added"] == (r["spans"] != "") for r in rows)
    assert pii.find_pii(odd, model).count() == 8 and pii.find_pii(empty, model).count() == 0


# --- pipeline

def test_pipeline(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({registry.ORACLE['op4_quality_rules']}) WHERE kept").fetchall()}
    lines = {i: [x for x in docs[i]["text"].split("\n") if not brute_line_fails(x)] for i in good}
    holders = {}
    for i, own in lines.items():
        for line in own:
            key = re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 20:
                holders.setdefault(key, set()).add(i)
    text = {i: "\n".join(x for x in own if len(h := holders.get(re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r")), ())) < 3 or max(h) == i) for i, own in lines.items()}
    ids = sorted(text)
    kept = sorted({ids[g] for g in groups([fingerprint(text[i], 4) for i in ids], 4)})
    bench = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    clean = [i for i in kept if not any(brute_coverage(text[i], b) >= 0.5 for b in bench if set(zip(*[re.findall("[a-z0-9]+", b.lower())[k:] for k in range(5)])) & set(zip(*[re.findall("[a-z0-9]+", text[i].lower())[k:] for k in range(5)])))]
    at = pd.DataFrame([(i, text[i], docs[i]["source"]) for i in clean], columns=["doc_id", "text", "source"])
    con.execute("DROP VIEW documents")
    con.register("documents", at)
    want = con.execute(registry.ORACLE["op7_source_mixing"]).df()
    got = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    assert set(got.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copy", "position"}
    assert digest(got[["doc_id", "source", "copy", "position"]]) == digest(want)
    assert all(text[r.doc_id] == r.text and r.n_chars == len(r.text) for r in got.itertuples())


def test_pipeline_stages_odd(spark, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF_SMALL)
        assert out.columns[:5] == odd.columns[:5], name
        out.count()
        assert stage(spark, empty, SF_SMALL).count() == 0, name
