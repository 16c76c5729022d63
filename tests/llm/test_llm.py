"""Each operator against brute force on small tables with nulls, empties, ties, repeated rows and odd columns."""

import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gustline.llm import decontaminate, edits, html, neardup, packing, pii, quality_classifier, quality_rules, sstable, toxicity
from gustline.llm.tokens import Coder, default_tokenizer

ODD = ["", " ", "a  b", "a \n b", "\n", "x y z", "don't stop", "café über 你好", "a " * 3000, "1 2  3", "<|endoftext|> a <|endoftext|>", "!!! ??? ..,,", "\U0001f600 ok"]


def documents(spark, extra=()):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    base = [" ".join(word() for _ in range(r.randint(5, 120))) for _ in range(30)]
    texts = [*base, base[0], base[1].upper(), *[b.replace(b.split()[3], "zzz", 1) for b in base[:12]], *ODD, None, *extra]
    rows = [(i * 3 - 10, t, None if i % 5 == 0 else "en", "s", 1, "x") for i, t in enumerate(texts)] + [(None, "no id", "en", None, None, None), (-10, base[0], "en", "s", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")


def ids_of(text):
    c = Coder.of(default_tokenizer())
    return np.array(c.whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_coder_is_the_tokenizer():
    c = Coder(default_tokenizer(), keep=50)
    r = random.Random(1)
    texts = [*ODD, *("".join(r.choice("ab,.' \n\t é!1$") for _ in range(r.randint(0, 60))) for _ in range(400))]
    for _ in range(2):
        assert [x + (0).to_bytes(4, "little") for x in c.encode(texts, 7)] == [ids_of(t).tobytes() for t in texts]


def test_packing(spark):
    docs = documents(spark)
    texts = defaultdict(list)
    for d in docs.collect():
        texts[d.doc_id].append(ids_of(d.text))
    out = packing.pack(docs, default_tokenizer(), 64).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 for r in out)
    assert sum(r.length for r in out) == sum(len(x) for v in texts.values() for x in v)
    for r in out:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and any(np.array_equal(x[r.start : r.start + r.length], np.frombuffer(bytes(r.ids), "<u4")) for x in texts[r.doc_id])
    assert packing.pack(docs.limit(0), default_tokenizer()).count() == 0


def test_token_tables(spark):
    docs = documents(spark)
    manifest = sstable.write_shards(docs, default_tokenizer(), shards=3)
    out = sstable.read_shards(manifest).orderBy("start").collect()
    want = sorted(((d.doc_id is not None, d.doc_id or 0), len(ids_of(d.text)), zlib.crc32(ids_of(d.text).tobytes())) for d in docs.collect())
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in out) == want
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in out]
    assert keys == sorted(keys) and [r.start for r in out] == list(np.cumsum([0] + [r.n_tokens for r in out[:-1]]))
    assert sstable.read_shards(sstable.write_shards(docs.limit(0), default_tokenizer(), shards=2)).count() == 0


def test_table_lookup():
    out = io.BytesIO()
    w = sstable.Writer(out, block_bytes=200)
    rows = {k: np.arange(k % 7, dtype="<u4") for k in range(0, 900, 3)}
    for k, v in rows.items():
        w.add(sstable.key_of(k), v)
    w.close()
    r = sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    assert len(r.index) > 5 and all(np.array_equal(r.get(k), v) for k, v in rows.items())
    assert all(r.get(k) is None for k in range(1, 900, 3)) and sum(r.may_have(sstable.key_of(k)) for k in range(1, 900, 3)) < 30


CJK = "你好，世界。这是一个测试！" * 300


def test_edits():
    c, r = Coder.of(default_tokenizer()), random.Random(5)
    quotes = ("wo" + "'" * 4 + "rds" + "'" * 3 + "s 't don't" + "'" * 2 + "ll ") * 60
    for t in [*ODD, "some words of a text, " * 40, quotes, "ab12!!'s" * 400, CJK[:3000], "\n\n \n x" * 500]:
        tree = edits.CountTree.all_of([t], c, run=4)[0]
        for _ in range(25):
            at, n, ins = r.randint(0, len(t) + 2), r.choice([0, 1, 2, 3, 9, 30]), r.choice(["", " ", "x", "'", "'s", "，", " new word ", "\n\n", "long insert " * 200])
            at = min(at, len(t))
            t = t[:at] + ins + t[at + n :]
            tree.edit(at, n, ins)
            assert tree.text() == t and tree.n_tokens == len(ids_of(t)) - 1, repr(t[:80])


class Counting:
    """A coder that counts the code points it is given."""

    def __init__(self):
        self.coder, self.chars = Coder.of(default_tokenizer()), 0

    def encode(self, texts, at_once=128):
        self.chars += sum(map(len, texts))
        return self.coder.encode(texts, at_once)


def test_edits_encode_what_they_report():
    for text, insert, most in ((CJK * 8, "x", 4 * edits.LONG), ("word " * 9000, "new " * 6000, 30_000), ("word " * 9000, "x", 4 * edits.LONG)):
        c = Counting()
        tree = edits.CountTree.all_of([text], c)[0]
        c.chars = 0
        tree.edit(len(text) // 2, 0, insert)
        assert tree.reencoded == c.chars < most and tree.n_tokens == len(ids_of(tree.text())) - 1


def test_counts_with_edits_in_spark(spark):
    docs = documents(spark, [CJK, CJK])
    n = F.length(F.coalesce("text", F.lit("")))
    by = F.array(edits.edit((n / 2).cast("long"), F.lit(3), F.lit(" x,")), edits.edit(F.lit(None), F.lit(None), F.lit(None)))
    out = sorted(map(tuple, edits.count_with_edits(docs, by, default_tokenizer()).drop("n_reencoded").collect()), key=str)
    want = []
    for d in docs.collect():
        t = d.text or ""
        after = t[: len(t) // 2] + " x," + t[len(t) // 2 + 3 :]
        want.append((d.doc_id, len(t), len(ids_of(t)) - 1, len(after), len(ids_of(after)) - 1, 2))
    assert out == sorted(want, key=str)
    assert edits.count_with_edits(docs.limit(0), by, default_tokenizer()).count() == 0
    none = F.lit(None).cast("array<struct<at:bigint,remove:bigint,insert:string>>")
    assert edits.count_with_edits(docs, none, default_tokenizer()).agg(F.sum("n_edits")).first()[0] == 0


def brute_components(rows, size, percent):
    sets, home = defaultdict(list), {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i].append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    home = {i: i for i in sets}

    def top(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                home[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    variants = []  # a group in which many pairs fall below the threshold
    for k in range(60):
        v = list(base)
        for p in r.sample(range(60), 1 + k % 3):
            v[p] = f"v{k}_{p}"
        variants.append(" ".join(v))
    docs = documents(spark, variants)
    rows = [(d.doc_id, d.text) for d in docs.collect() if d.doc_id is not None]
    want = brute_components(rows, size, percent)
    for small, block, least in ((8, 16, 1000), (1, 16, 5)):
        got = neardup.near_duplicates(docs, size, percent, small=small, block=block, least=least).collect()
        assert {g.doc_id: g.component_id for g in got if g.doc_id is not None} == want
        assert len(got) == docs.count() and all(g.kept == (g.doc_id == g.component_id) for g in got if g.doc_id is not None)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_estimate_is_close():
    s = neardup.Shingler(3)
    a = s(" ".join(map(str, range(3000))))
    b = s(" ".join(map(str, range(600, 3600))))
    assert abs(neardup.estimate(neardup.registers(a, 1024), neardup.registers(b, 1024), 2998, 2998) - 2398 / 3598) < 0.06


def test_chance_of_equal_registers():
    r = np.random.default_rng(3)
    for n, k in ((20_000, 20_000), (20_000, 2_000), (300_000, 300_000)):
        m = 1024
        equal = [np.mean(neardup.registers(r.integers(0, 2**63, n, np.uint64) * 2 + 1, m) == neardup.registers(r.integers(0, 2**63, k, np.uint64) * 2 + 1, m)) for _ in range(200 if n < 100_000 else 40)]
        want = neardup._chance(round(4 * np.log2(k / m)), round(4 * np.log2(n / m)))
        assert np.mean(equal) == pytest.approx(want, rel=0.5, abs=3e-5)


def brute_pii(t):
    luhn = lambda d: sum(x if i % 2 == 0 else x * 2 // 10 + x * 2 % 10 for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: max(map(int, m.split("."))) <= 255),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m.group())]


def test_pii(spark):
    r = random.Random(2)
    texts = [None, "", "a@b.c_x@d.e a@b@c.d ..@x.y", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (619) 555-0053 4799567889864505", "\U0001f600 mail: x.y@z.example.com", "9" * 30000, "a" * 30000, "IBAN GB82 WEST 1234 5698 7654 32 ok", "SSN 123-45-6789, not 123-45-6788", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "see 04dbebab91ab85687d33eeaaf9ac699e1188f962", "GB82 WEST 1234 5698 7654 32"]
    texts += ["".join(r.choice("a1.@+ -(5)") for _ in range(r.randint(5, 80))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.digest(docs).collect():
        spans = row.spans.split(",") if row.spans else []
        assert [s for s in spans if s.split(":")[0] not in ("iban", "ssn", "secret")] == brute_pii(texts[row.doc_id]), texts[row.doc_id][:80]
    got = {row.doc_id: row.spans for row in pii.digest(docs).collect()}
    assert got[9] == "iban:5:32" and got[10] == "ssn:4:15,ssn:21:32"
    assert got[11] == "secret:9:49" and got[12] == "" and got[13] == ""  # a secret that is named; one, and an account number, that aren't
    assert {row.doc_id: row.scores for row in pii.digest(docs).collect()}[11] == "0.6"
    odd = docs.select("doc_id", "text", F.lit(1).alias("spans"), F.lit("x").alias("n_email"), F.lit(2).alias("kind"))
    assert pii.digest(odd).count() == len(texts) and pii.redact(odd).columns == odd.columns and pii.digest(docs.limit(0)).count() == 0
    clean = {row.doc_id: row.text for row in pii.redact(docs).collect()}
    assert clean[6] == "\U0001f600 mail: [EMAIL]" and clean[0] is None and clean[1] == ""


def test_quality_measures(spark):
    for t in [*ODD, "a b c a b c a b c d", "x\ny\nx\n \ny\n", "A# $B"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert quality_rules.measure(t)[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
    docs = documents(spark)
    out = quality_rules.judge(docs).collect()
    assert len(out) == docs.count() and all(not (r.base_failed and r.kept) for r in out)
    same = quality_rules.judge(docs, broadcast_rows=0).collect()
    assert sorted(map(str, out)) == sorted(map(str, same)) and quality_rules.judge(docs.limit(0)).count() == 0


def test_kept_against_exact_quantiles(spark):
    """The verdict from exact quartiles of each group: equal but where a measure is as near its fence as the sketch is accurate."""
    r = random.Random(19)
    rows = []
    for i in range(1500):
        k = i % 3
        words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1 + 2 * k, 4 + 3 * k))) for _ in range(r.randint(50, 200))]
        for _ in range(r.choice([0, 0, 0, 1, 2, 3, 8, 30])):
            words[r.randrange(len(words))] += r.choice(["#", "$$", "|"])
        for _ in range(r.choice([0, 0, 1, 4])):
            words[r.randrange(len(words))] = words[0].upper()
        rows.append((i, "en" if k else "de", f"s{k}", " ".join(words)))
    out = {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    values, event = {}, {k: e for k, (_, _, e) in quality_rules.MEASURES.items()}
    for i, _, source, t in rows:
        n, chars, symbols, dups, repeats, uppers, _ = quality_rules.measure(t)
        values[i] = (source, n, {"symbols": symbols / n, "repeats": repeats / n, "dup_lines": dups / n, "uppers": uppers / n, "word_length": chars / n})
    at = lambda v, q: sorted(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    clear = 0
    for source in ("s0", "s1", "s2"):
        group = [x for x in values.values() if x[0] == source]
        short = at([x[1] for x in group], 0.25)
        fence = {}
        for k in quality_rules.MEASURES:
            v = [x[2][k] for x in group]
            a, b = at(v, 0.25), at(v, 0.75)
            fence[k] = b + 3 * max(b - a, event[k] / short)
        for i, (s, _, m) in values.items():
            if s == source and all(abs(m[k] - fence[k]) > 0.05 * fence[k] for k in fence):
                clear += 1
                assert out[i].kept == (not out[i].base_failed and all(m[k] <= fence[k] for k in fence))
    assert clear > 1300 and 20 < sum(not x.kept for x in out.values()) < 700
    assert len({x.fence_word_length for x in out.values()}) == 3


def test_sketch_quantiles(spark):
    rows = [(i, "en", "s", "w " * 10 + "#" * i) for i in range(1, 400)]
    m = quality_rules.measures(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string"))
    q = quality_rules.quantiles(quality_rules.sketches(m), ["measure"], [0.25, 0.75]).where("measure = 'symbols'").first()
    assert q["q0"] == pytest.approx(100 / 11, rel=0.02) and q["q1"] == pytest.approx(300 / 11, rel=0.02)


def test_quality_fences_follow_their_group(spark):
    r = random.Random(12)
    words = lambda n, k: " ".join("".join(r.choice("abcdefgh") for _ in range(k + r.randint(0, 1))) for _ in range(n))
    rows = [(i, "en", ("short", "long")[i % 2], words(100 + i % 50, (3, 13)[i % 2])) for i in range(400)]
    rows += [(1000, "en", "short", words(120, 8)), (1001, "en", "long", words(120, 13)), (1002, "en", "short", words(120, 3) + " #" * 12), (1003, "en", "short", words(120, 3) + " #")]
    out = {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()}
    assert np.mean([out[i].kept for i in range(400)]) > 0.97  # the long words of a source that has no others are no fault
    assert not out[1000].kept and out[1001].kept  # words of eight letters stand out among words of three
    assert not out[1002].kept and out[1003].kept  # no other document has a symbol: one is nothing, twelve are


def test_html(spark):
    page = "<html><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id=sidebar><p>Side, bar, text, here</p></div><div class='post-content'><h2>Title</h2><p>Real text, with commas, and more &amp; more.<p>Second   para<br>line. <a href=x>link</a></div><div class=comments><p>Nice, post, really, great, stuff.</p></div><form><p>sub</p></form><script>x='<p>'</script></body></html>"
    assert html.extract(page) == "Title\nReal text, with commas, and more & more.\nSecond para line. link"
    assert html.extract("<div>" * 5000 + "<p>deep text" + "</div>" * 5000) == "deep text"
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>cut &am")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.main_text(pages).collect()}
    assert got[2] == ("", 0) and got[3] == ("", 0) and got[4] == ("cut &am", 7) and got[1][1] == len(got[1][0])


def test_html_quotes_and_depth():
    assert html.extract("<p class=it's>Hello, it is text") == "Hello, it is text"
    assert html.extract('<p title="oops>Some text, here</p><p>more</p>') == "Some text, here\nmore"
    assert html.extract("<p title='a > b' class=\"x\">Some text, here</p>") == "Some text, here"
    assert html.extract("<div>" * 3000 + "<nav>Menu</nav><p>Text of the article, here.</p>" + "</div>" * 3000) == "Text of the article, here."


def test_html_odd_tables(spark):
    page = "<div class=content><p>Real text, with commas, and more of it.</p></div>"
    pages = spark.createDataFrame([(1, "u", page, "t", 5), (1, "u", page, "t", 5), (None, None, page * 4000, None, None)], "page_id long, url string, html string, text string, n_chars int")
    out = html.main_text(pages).collect()
    assert [r.n_chars for r in out][:2] == [39, 39] and out[2].n_chars == 4000 * 40 - 1 and html.main_text(pages.limit(0)).count() == 0


def test_html_names_that_are_not_bad():
    text = "<h2>Title</h2><p>Real text, with commas, and more of it.</p>"
    want = "Title\nReal text, with commas, and more of it."
    for a, b in (("<body class='single has-sidebar'>", "</body>"), ("<article class='post no-comments'>", "</article>"), ("<main class='with-header'>", "</main>"), ("<div class='page-with-sidebar content'>", "</div>"), ("<div class='wrap has-sidebar'>", "</div>"), ("<body class='search share'>", "</body>"), ("<div class='share-story'>", "</div>")):
        assert html.extract(f"<html>{a}{text}{b}</html>") == want, a
    links = "<div class='related post'><p><a href=x>Another story, and more</a></p></div>"
    assert html.extract(f"<body><div class=content>{text}</div>{links}</body>") == want
    beside = "<body><div class=wrap><h1>Head</h1><div class=content>" + "<p>Real text, with commas, and more of it.</p>" * 3 + "</div><p>The end.</p></div></body>"
    assert html.extract(beside).split("\n") == ["Head", *["Real text, with commas, and more of it."] * 3, "The end."]


def test_decontamination(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    items = [" ".join(word() for _ in range(r.randint(15, 50))) + ". " + " ".join(word() for _ in range(4)) + "." for _ in range(12)]
    docs, want = [], set()
    for i in range(120):
        text = [word() for _ in range(r.randint(0, 300))]
        if i % 10 == 0:
            k = i // 10
            item = items[k].split()
            if i % 20 == 0:  # a paraphrase: every ninth word is another
                item = [word() if j % 9 == 4 else w for j, w in enumerate(item)]
            text[len(text) // 2 : len(text) // 2] = item
            want.add((i, k))
        docs.append((i, " ".join(text), "x"))
    d = spark.createDataFrame([*docs, (None, None, "y"), (500, "", "z")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([*enumerate(items), (99, None), (98, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(d, b).collect()}
    assert got == want
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_words_and_space_of_decontamination_come_from_all_documents(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(i % 60))) for i in range(3000)] + [(None, "rare rare"), (3000, "rare")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want: dict = {}
    for _, t in rows:
        for w in set(t.split()):
            want[w] = want.get(w, 0) + 1
    top = [w.encode() for w in sorted(want, key=lambda w: (-want[w], w)) if want[w] > 1]
    assert decontaminate.frequent_words(d, 100, 7) == top and decontaminate.frequent_words(d, 5) == top[:5] and b"rare" in top
    items = ["w1 w2 w3 w4 w5 w6. w7 w8."]
    words = decontaminate.vocabulary(top, items, 100)
    idf = np.linspace(1, 2, len(words)).astype(np.float32)
    fitted = decontaminate.latent_space(d, items, words, idf, rank=1, rounds=2, weight=1.0)
    of = decontaminate.Terms(words)
    a = []
    for t in (t for _, t in rows):
        k = of([t])[0]
        for b in range(0, max(1, (len(k) - 1) // 16 * 16), 16):
            v = np.bincount(k[b : b + 32][k[b : b + 32] >= 0], minlength=len(words)) * idf
            a.append(v / max(1e-9, np.sqrt((idf[k[b : b + 32]] ** 2).sum())) if len(k) else v)
    a, mine = np.array(a), np.bincount(of(items)[0], minlength=len(words)) * idf
    gram = a.T @ a / len(a) + np.outer(mine, mine) / (idf[of(items)[0]] ** 2).sum()
    q = np.linalg.qr(np.random.default_rng(11).normal(size=(len(words), 1)))[0]
    for _ in range(2):
        q = np.linalg.qr(gram @ q)[0]
    assert np.allclose(np.abs(fitted.basis[:, 0]), np.abs(q[:, 0] * idf), atol=1e-4)


def test_decontamination_reads_the_texts_twice(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    items = [" ".join(word() for _ in range(40)) for _ in range(8)]
    rows = [(i, " ".join([*(word() for _ in range(r.randint(0, 80))), *([items[i % 8]] if i % 9 == 0 else [])])) for i in range(300)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    d = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    found = decontaminate.contaminated(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == {(i, i % 8) for i in range(300) if i % 9 == 0}
    assert read.value == 2 * len(rows)  # once for the words, once for their numbers: products and search read those


def test_words_and_their_numbers(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(" \t\n\x0b\x0c\r\x1c\x1f\x85AZa.b,-é ") for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["", "  ", "...", "a" * 100_000]
    of, words = decontaminate.bare_words(pa.array(texts))
    assert list(zip(of.tolist(), words.to_pylist())) == [(i, w) for i, t in enumerate(texts) for w in decontaminate.normal_words(t)]
    for more in (0, 40_000):  # numbers of two bytes and of four
        known = [f"w{i}".encode() for i in range(more)] + sorted(set(words.to_pylist()))[::2]
        number = {w: i for i, w in enumerate(known)}
        rows = decontaminate.number(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known).toArrow().to_batches()
        got = dict(x for ids, terms in decontaminate.by_terms(iter(rows), len(known), 1000) for x in zip(ids, terms))
        assert all(got[i].tolist() == [number.get(w, -1) for w in decontaminate.normal_words(t)] for i, t in enumerate(texts)) and len(got) == len(texts)


def test_a_round_from_the_space_of_the_items_holds_more_than_three(spark):
    r = random.Random(5)
    items = [" ".join(f"i{r.randint(0, 300)}" for _ in range(40)) for _ in range(30)]
    texts = [" ".join(f"{r.choice('iw')}{int(r.paretovariate(0.5)) % 400}" for _ in range(100)) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = decontaminate.vocabulary(decontaminate.frequent_words(d, 500), items, 500)
    idf = np.ones(len(words), np.float32)
    of = decontaminate.Terms(words)

    def held(**how):
        q = decontaminate.latent_space(d, items, words, idf, rank=20, **how).basis
        (z, n), (mine, k) = decontaminate.gram_product(of(texts), q, idf), decontaminate.gram_product(of(items), q, idf)
        return float((q * (z * (k / n) + 100 * mine)).sum())

    assert held(rounds=1, warm=8) > held(rounds=3)


def test_decontamination_of_an_item_in_many_documents(spark):
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (30, 20, 45, 2)]
    docs, want = [], set()
    for i in range(200):
        text = [word() for _ in range(r.randint(20, 90))]
        k = 0 if i % 3 == 0 else 1 if i % 8 == 1 else 2 if i == 4 else 3 if i == 5 else None
        if k is not None:
            item = items[k].split()
            if i % 6 == 3:  # every fourth word is another
                item = [word() if j % 4 == 3 else w for j, w in enumerate(item)]
            text[11:11] = item
            want.add((i, k))
        docs.append((i, " ".join(text)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.contaminated(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want
    words = sorted({w.encode() for t in items for w in t.split()})
    assert decontaminate.document_frequencies(d, words, items)[1].max() <= 20  # short words turn up by chance


def test_runs_stay_in_their_text():
    runs = decontaminate.Runs([np.array([0, 1, 2, 3]), np.array([4]), np.array([], int)], 6)
    assert runs.find([np.array([0, 1]), np.array([2, 3, -1]), np.array([5, 0, 1, 2, 5]), np.array([], int), np.array([-1, 4])]) == [(2, 0, 1, 4), (4, 1, 1, 2)]
    assert runs.find([]) == [] and runs.find([np.array([], int)]) == []


def test_lcs():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 20))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow(a, b)


def test_toxicity(spark):
    r = random.Random(6)
    clean = ["the", "river", "morning", "walked", "along", "quiet", "street", "under", "yellow", "light", "idea", "audio", "patio"]
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(clean) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[7] = r.choice(["idiot", "moron", "stupid"]) if i < 500 else r.choice(["1d10t", "m0r0n", "stuuupid", "i d i o t", "s.t.u.p.i.d"])
        rows.append((i, " ".join(words)))
        if i < 500:
            labels.append((i, int(toxic), None))
    rows += [(900, None), (901, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x for x in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()}
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out.values())
    assert all(out[i].predicted == int(i % 4 == 0) for i in range(500, 600))
    assert toxicity.classify(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def toxic_decoder(**options):
    counts = toxicity.gram_counts(["what a stupid man you are worthless idiot disgusting the river morning walked along quiet street under yellow light"] * 50)
    p = (counts.reshape(-1, 27) + 0.01) / (counts.reshape(-1, 27) + 0.01).sum(1, keepdims=True)
    return toxicity.Decoder(np.log(p).astype(np.float32).ravel(), **options)


def test_spaces_are_decoded():
    d = toxic_decoder()
    for text, want in {"what a s t u p i d man": "stupid", "y o u a r e s t u p i d": "stupid", "w o r t h l e s s i d i o t": "idiot", "s  t  u  p  i  d": "stupid", "a stu pid man": "stupid", "you i d i o t.": "idiot", "m a n": "man", "you i d-i o-t": "idiot", "i-d i-o-t": "idiot", "m a m a n": "man"}.items():
        assert want in d.words(text), (text, d.words(text))
    assert "boob" in d.words("b o o b") or "bob" in d.words("b o o b")
    assert d.words("the quiet street") == {"the", "quiet", "street"}
    assert d.words("- " * 3000 + ". " * 3000 + "a " * 3000)  # ends


def test_long_tokens_are_decoded():
    d = toxic_decoder()
    assert d.restore("d--i--s--g--u--s--t--i--n--g") == "disgusting" and d.restore("stuuuuuuuuuuuuuuuuuuuuuuuupid") == "stupid"
    assert d.restore("w-o-r-t-h-l-e-s-s-" * 3) and d.restore("st*p*d") == "stupid"
    for token in ("st*p*d", "d1sgu$t1ng", "w#rt*l*ss", "i d i o t a r e"):
        exact = toxic_decoder(beam=10**9).viterbi(token)
        assert d.viterbi_by_table(token) == d.viterbi_by_table(token, 3) == exact == d.viterbi(token)


def test_quality_classifier(spark):
    r = random.Random(8)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(80))
    rows = [(i, good() if i % 4 else " ".join(w + "$$$" for w in good().split())) for i in range(800)] + [(None, None), (999, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 800, 2)] + [(None, 1)], "doc_id long, quality int")
    out = quality_classifier.classify(docs, labels).collect()
    right = [x.predicted == int(x.doc_id % 4 > 0) for x in out if x.doc_id is not None and x.doc_id < 800]
    assert np.mean(right) > 0.97 and len(out) == len(rows)
    assert quality_classifier.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_prior_from_positives_and_unlabelled():
    r = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        good, bad = (r.normal(m, 1, (4000, quality_classifier.N_FEATURES)) for m in (0, 1.5))
        mixed = np.concatenate([good[: int(3000 * share)], bad[: int(3000 * (1 - share))]])
        assert quality_classifier.estimate_prior(good[3000:], mixed) == pytest.approx(share, abs=0.06)
    assert quality_classifier.estimate_prior(good[:1], mixed[:1]) == 0.5


def test_commonest_word_of_all():
    kinds = [f"w{i}" for i in range(40)]
    words = kinds + [w for w in ("w7", "w31") for _ in range(20)]
    for seed in range(8):
        random.Random(seed).shuffle(words)
        assert quality_classifier.features(" ".join(words))[11] == 21 / 80
    for w in kinds:
        assert quality_classifier.features(" ".join(kinds + [w] * 40))[11] == 41 / 80


def test_entry_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['gustline.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; print(sum(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.stdout.strip() == "0", out.stderr
